"""The pipeline's stages, each on what the one before it kept, against brute force."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.test_operators import awkward, brute_repeats, brute_secrets, odd_words
from tests.llm.test_similar import brute_first

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], str(FOLDER)).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_return_documents(stages):
    assert all(sorted(s.columns) == sorted(stages[0].columns) for s in stages[1:5])
    assert [r["n_chars"] for r in stages[4].collect()] == [len(r["text"]) for r in stages[4].collect()]


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    marked = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = set(texts(stages[1]))
    clean = [i for i in texts(stages[0]) if marked.get(i) == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert all(texts(stages[0])[i] == t for i, t in texts(stages[1]).items())


def test_one_of_each_group_stays(stages):
    """Groups are of five-word shingle sets with a Jaccard similarity of 0.8 or more, over all pairs."""
    before, after = texts(stages[1]), texts(stages[2])
    first = brute_first(sorted(before.items()))
    assert set(after) == {i for i, f in first.items() if f == i}
    assert len(after) < len(before)


def test_passages_and_secrets_are_gone(stages):
    before, after = texts(stages[2]), texts(stages[3])
    removed = {r[0]: r[2] for r in brute_repeats(sorted(before.items()))}
    assert set(after) == set(before)
    assert all(after[i] == before[i] for i in before if not removed[i])
    assert all(len(before[i].encode()) - len(after[i].encode()) >= removed[i] for i in before)
    redacted = texts(stages[4])
    for i, t in after.items():
        assert (redacted[i] == t) == (not brute_secrets(t)) or "[secret]" in redacted[i]


def test_run_gives_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, str(FOLDER))
    same = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, found.select(*same).collect())) == sorted(map(tuple, stages[5].select(*same).collect()))
    assert {r["doc_id"] for r in found.collect()} == set(texts(stages[4]))


def test_stages_take_awkward_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, rows without an id: each stage keeps the columns, and drops only what it is for."""
    folder = str(tmp_path)
    spark.createDataFrame([(3 * i, int(i % 4 == 0)) for i in range(12)] + [(None, 1), (6, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in awkward()], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == "best_fit_packing":
            assert out.select("sequence_id", "offset").distinct().count() == out.count()
            break
        assert out.columns == docs.columns
        if name in ("suffix_array_dedup", "secret_scan"):
            assert out.count() == docs.count()
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    none = docs.where("false")
    assert all(stage(spark, none, folder).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_secret_stage_knows_all_of_a_long_text(spark, tmp_path):
    """Identifiers made of the words of a single long document stay; a password goes."""
    rng = random.Random(19)
    identifiers = ["".join(w.title() for w in odd_words(rng, 30))[:40] for _ in range(60)]
    rows = [(0, " ".join(odd_words(rng, 40000)))] + [(1 + i, f"see {t} here") for i, t in enumerate(identifiers)] + [(100, "password=hunter22 here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = texts(dict(corpus_pipeline.STAGES)["secret_scan"](spark, docs, str(tmp_path)))
    assert sum(found[i] != t for i, t in rows[:-1]) <= 1 and found[100] == "[secret] here"
