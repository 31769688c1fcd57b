"""The pipeline's near-duplicate stage against all pairs compared."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from pointweave.llm import similar
from pointweave.operators.components import connected
from tests.llm.test_operators import awkward, prose


def brute_set(text, words=5):
    tokens = (text or "").lower().split()
    return frozenset(" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))) if tokens else frozenset()


def brute_first(rows):
    """The smallest id that each id links to, over rows of ids and texts."""
    sets = {i: brute_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in itertools.combinations(sorted(sets), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 5 * both >= 4 * either:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def edited(rng, text, places):
    words = text.split()
    for at in rng.sample(range(len(words)), places):
        words[at] = f"changed{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    """Copies with up to eight of 200 words changed, around a similarity of 0.8; short, wordless and unlike texts."""
    rng = random.Random(5)
    out = [None, "", " \n", "one two", "One  two", "one two three four five six", prose(rng, 50)]
    for places in (1, 2, 3, 4, 5, 6, 8):
        base = prose(rng, 200)
        out += [base, edited(rng, base, places), edited(rng, base, places)]
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stage_drops_near_copies(spark, rows):
    first = brute_first(rows)
    found = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()}
    assert found == {i for i, f in first.items() if f == i}
    assert 5 < len(first) - len(found) < 18


@pytest.mark.parametrize("most_rows", [4096, 60])
def test_many_near_copies_of_one_text(spark, most_rows):
    rng = random.Random(6)
    base = prose(rng, 146)
    rows = [(i, edited(rng, base, rng.choice((1, 2, 3, 4, 5)))) for i in range(300)] + [(900 + i, edited(rng, base, 30)) for i in range(40)]
    found = {r["id"]: r["component"] for r in similar.near_duplicates(frame(spark, rows), most_rows=most_rows).collect()}
    assert found == brute_first(rows)


def test_meetings_connect_equal_hashes(spark):
    rng = random.Random(7)
    rows = [(rng.choice((1, 2, rng.randrange(10, 400))), n) for n in range(600)]
    df = spark.createDataFrame(rows, "h long, node long").repartition(5)

    def combine(batches):
        for batch in batches:
            if batch.num_rows:
                yield similar._combined([(np.array([h]), np.int64(node)) for h, node in zip(*(c.to_pylist() for c in batch.columns))])

    found = {(r["node"], r["root"]) for r in connected(similar._met(df.mapInArrow(combine, similar.ENTRY))).collect()}
    least: dict[int, int] = {}
    for h, n in rows:
        least[h] = min(n, least.get(h, n))
    assert found == {(n, least[h]) for h, n in rows if n != least[h]}


def test_similar_sets_share_a_shingle_of_their_prefixes():
    rng = np.random.default_rng(8)
    for _ in range(200):
        both = rng.choice(10**6, rng.integers(1, 80), replace=False)
        a, b = (np.unique(np.concatenate((both, rng.choice(10**6, rng.integers(0, 12))))).astype(np.uint64) for _ in range(2))
        rows = {int(x): int(rng.integers(2, 6)) if x in a and x in b else 1 for x in np.union1d(a, b)}
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            heads = [similar.prefix(x, np.array([rows[int(v)] for v in x]), 0.8) for x in (a, b)]
            assert len(np.intersect1d(*heads))


def test_awkward_rows_have_a_component_each(spark):
    rows = awkward()
    texts = {(i, t) for i, t in rows if i is not None}
    found = similar.near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    assert {r["id"]: r["component"] for r in found if r["id"] is not None} == brute_first(sorted(texts, key=str))
