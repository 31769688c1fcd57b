"""The queries opN_<name> over whole tables, and the pipeline."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import balltree, language, packing, pieces, secrets, simhash, suffixes, toxicity, warc, winnow
from pointweave.llm.common import cut, drop, shared_dir, small_batches, table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    of_kind = [F.expr(f"cast(size(filter(spans, s -> s.kind = {i})) AS long)").alias(f"n_{k}") for i, k in enumerate(secrets.KINDS)]
    base = found.select("doc_id", "spans", F.expr(f"filter(spans, s -> s.kind < {secrets.KINDS.index('random')})").alias("base"))
    return base.select("doc_id", *of_kind, F.sha2(secrets.spelled("base"), 256).alias("base_sha256"), secrets.spelled().alias("spans"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(language.fold("doc_id", 3) != 1).withColumnRenamed("doc_id", "id")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(language.fold("id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    page_id = warc.field("metadata", "page-id").try_cast("long")
    shown = F.struct(*[F.col(f"response.{c}").alias(c) for c in ("type", "record_id", "refers_to", "stated_digest", "payload_digest")]).alias("response")
    captures = cut(warc.assemble(warc.read(spark, path)).select(page_id.alias("page_id"), warc.field("metadata", "payload-length").cast("long").alias("payload_bytes"), shown))
    drop(spark, path)
    return warc.with_origins(captures, {"refers_to": F.col("page_id")}).select(
        "page_id",
        "payload_bytes",
        F.when(F.col("response.type") == "revisit", F.col("response.stated_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        "refers_to",
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("word_bpe_49k.json"))
    return packing.pack(pieces)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    profiles = language.prototypes(docs.where(language.fold("doc_id", 4) != 2))
    found = language.identify(docs, profiles)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(language.fold("id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_next(table(spark, sf_dir, "documents", "doc_id", "text"))


def _lean(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with small Arrow batches."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: _lean(q) for q in (op1_secrets, op2_toxicity, op3_simhash, op4_suffixes, op5_pieces, op6_warc, op7_packing, op8_language, op9_top_k, op10_winnowing)
}

ORACLE_SQL: dict[str, str] = {
    "op4_suffixes": """
        WITH d AS (
            SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), w AS (
            SELECT k, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT k, doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS p FROM d)
        ), f AS (
            SELECT k, doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM w
        ), c AS (
            SELECT k, p, CASE WHEN p > coalesce(lag(p) OVER (PARTITION BY k ORDER BY p), -51) + 50 THEN 1 ELSE 0 END AS new FROM f WHERE first < doc_id
        ), i AS (
            SELECT k, p, sum(new) OVER (PARTITION BY k ORDER BY p) AS island FROM c
        ), s AS (
            SELECT k, island, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY k, island
        ), g AS (
            SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM s
        ), r AS (
            SELECT g.k, sum(b - a) AS removed, count(*) AS spans, max(b) AS last,
                   string_agg(substr(d.h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept
            FROM g JOIN d ON d.k = g.k GROUP BY g.k
        )
        SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r.removed, 0) AS BIGINT) AS n_removed, coalesce(r.spans, 0) AS n_spans,
               sha256(unhex(CASE WHEN r.k IS NULL THEN d.h ELSE r.kept || substr(d.h, CAST(2 * r.last + 1 AS BIGINT)) END)) AS kept_sha256
        FROM d LEFT JOIN r ON r.k = d.k
    """,
    "op6_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html FROM pages
        ), d AS (
            SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
        ), k AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
        FROM k
    """,
    "op9_top_k": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, max(CASE WHEN len(a.q) = 0 THEN 0 ELSE CAST(list_inner_product(a.q, b.q) AS BIGINT) END) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
            WHERE a.vec_id % 20 = 0
            GROUP BY a.vec_id, b.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20
    """,
}
