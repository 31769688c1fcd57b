"""The queries themselves, on a folder of awkward rows: against SQL where there is some, else against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from pointweave.llm import packing
from pointweave.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file
from tests.llm.test_operators import awkward, brute_fingerprint, brute_keys, brute_repeats, brute_secrets, brute_top_k, likeness, prose
from tests.test_oracle import canonical

LANGS = ("en", "de", "fr", None)


def documents():
    """(doc_id, text): rows of unique ids, one repeated id with another text, a repeated row, rows without an id."""
    rng = random.Random(21)
    rows = awkward() + [(1000 + i, prose(rng, rng.randint(1, 60))) for i in range(40)]
    return [*rows, (1000, prose(rng, 20)), (2000, "𐌰𐌱𐌲 𝕳𝖊𝖑")]


PAGES = [(1, "a", "x" * 1200), (1, "b", "x" * 1200), (2, "c", "x" * 1200), (2, "c", "x" * 1200), (3, "d", "short"), (4, "d", "short"), (5, None, None), (None, "e", "x" * 1200), (6, "f", "é" * 600), (7, "g\r\nh", "é" * 600)]


def vectors():
    rng = np.random.default_rng(22)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(0, 0.3, (90, 6)))]
    return [*rows, rows[0], rows[20], (40, [0.5] * 6), (200, None), (220, [1.0, None]), (240, [float("nan")] * 6), (260, []), (280, [])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, LANGS[n % 4], "s", None if t is None else len(t)) for n, (i, t) in enumerate(documents())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(k % 3 == 0)) for k, (i, _) in enumerate(documents())] + [(1, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    spark.createDataFrame(vectors(), "vec_id long, embedding array<double>").write.parquet(f"{out}/embeddings.parquet")
    return out


def rows_of(spark, folder, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, folder).collect()), key=str)


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees_on_awkward_rows(spark, folder, name):
    connection = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found, expected = QUERIES[name](spark, folder).toPandas(), connection.execute(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns) and canonical(found) == canonical(expected)


def test_op1(spark, folder):
    expected = []
    names = ("assign", "access", "hex")
    for i, t in documents():
        spans = brute_secrets(t)
        said = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        expected.append((i, *(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(said.encode()).hexdigest()))
    assert rows_of(spark, folder, "op1_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(expected, key=str)
    for r in QUERIES["op1_secrets"](spark, folder).collect():
        base = ",".join(x for x in r["spans"].split(",") if not x.startswith("random"))
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]


def test_op2(spark, folder):
    found = QUERIES["op2_toxicity"](spark, folder).collect()
    assert sorted((r["doc_id"] for r in found), key=str) == sorted((i for i, _ in documents()), key=str)
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"]) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_op3(spark, folder):
    rows = [(i, brute_fingerprint(t)) for i, t in documents()]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        return i if root[i] == i else find(root[i])

    for (a, x), (b, y) in itertools.combinations([r for r in rows if r[0] is not None], 2):
        if (x ^ y).bit_count() <= 2:
            root[max(find(a), find(b))] = min(find(a), find(b))
    found = QUERIES["op3_simhash"](spark, folder).collect()
    assert sorted(((r["doc_id"], r["fingerprint"]) for r in found), key=str) == sorted(((i, f"{x:016x}") for i, x in rows), key=str)
    of: dict = {}
    for i, x in rows:
        if i is not None:
            of.setdefault(x, set()).add(find(i))
    assert all(r["component_id"] in of[int(r["fingerprint"], 16)] for r in found if r["doc_id"] is not None)


def test_op4(spark, folder):
    assert rows_of(spark, folder, "op4_suffixes", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(documents())


def test_op5(spark, folder):
    found = QUERIES["op5_pieces"](spark, folder).collect()
    assert len(found) == len(documents()) and all(r["lossless"] for r in found)


def test_op6(spark, folder):
    expected = []
    for i, _, h in PAGES:
        payload = (h or "").encode()
        last = max((k for k, _, g in PAGES if (g or "") == (h or "") and k is not None), default=None)
        visit = len(payload) >= 1000 and i != last
        expected.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if visit else "response", last if visit else None))
    assert rows_of(spark, folder, "op6_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(expected, key=str)


def test_op7(spark, folder):
    from tokenizers import Tokenizer

    tokenizer, expected, lengths = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), [], []
    for i, t in documents():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, s in enumerate(range(0, len(ids), 4096)):
            own = ids[s : s + 4096]
            lengths.append(len(own))
            expected.append((i, p, s, len(own), zlib.crc32(own.tobytes())))
    assert rows_of(spark, folder, "op7_packing", "doc_id", "piece", "start", "length", "ids_crc32") == sorted(expected, key=str)
    places: dict[int, list[tuple[int, int]]] = {}
    for r in QUERIES["op7_packing"](spark, folder).collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    plan = packing.plan({n: lengths.count(n) for n in lengths}, 4096)
    assert len(places) == max(s + -(-sum(1 for x in lengths if x == n) // each) if f == 0 else 0 for n, f, each, s, _ in plan.tolist()) or len(places) >= -(-sum(lengths) // 4096)


def test_op8(spark, folder):
    found = QUERIES["op8_language"](spark, folder).collect()
    assert sorted((r["doc_id"] for r in found), key=str) == sorted((i for i, _ in documents()), key=str)
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"]) % 4 == 2)
        assert 0 <= r["score"] <= 1
    texts: dict = {}
    for i, t in documents():
        texts.setdefault(i, set()).add(any(map(str.isalpha, t or "")))
    assert all((r["lang_pred"] != "und") in texts[r["doc_id"]] and r["lang_pred"] in ("en", "de", "fr", "und") for r in found)


def test_op9(spark, folder):
    assert rows_of(spark, folder, "op9_top_k", "query_id", "rank", "vec_id", "score") == brute_top_k(vectors())


def test_op10(spark, folder):
    import xxhash

    rows = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) ^ 1 << 63))
    expected = []
    for n, (i, t) in enumerate(rows):
        own, after = t or "", rows[(n + 1) % len(rows)][1] or ""
        e = len(own) // 4
        edited = own[: len(own) - e] + after[:e]
        a, b, c = map(brute_keys, (own, edited, after))
        expected.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(a, b), 9), round(likeness(a, c), 9)))
    found = QUERIES["op10_winnowing"](spark, folder).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found), key=str) == sorted(expected, key=str)
