"""Registered queries of the numbered operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.llm import near_dedup, secret_scan, toxicity
from spanloom.llm.byte_bpe import round_trip
from spanloom.llm.common import table
from spanloom.llm.exact_dedup import deduplicate
from spanloom.llm.html_text import extract
from spanloom.llm.neighbours import nearest
from spanloom.llm.packing import pack
from spanloom.llm.personal_data import find
from spanloom.llm.sharding import place
from spanloom.llm.token_counts import count_tokens
from spanloom.llm.vector_codes import encode
from spanloom.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.learn(docs))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long holds is null here; the operator gives it as a decimal."""
    rows = whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_html_text, op2_token_counts, op3_toxicity, op4_byte_bpe, op5_best_fit_packing,
    op6_personal_data, op7_exact_dedup, op8_near_dedup, op9_secrets,
    op10_nearest_neighbours, op11_embedding_whitening, op12_sharding, op13_vector_codes)}


def vector_codes_sql(rounds: int = 4) -> str:
    """All rounds, one after another: assign by distance, then floor the means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT rid, pos, any_value(part) AS part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
            SELECT p.rid, p.pos, p.part, b.entry, p.norm - 2 * list_dot_product(p.part, b.part) + list_dot_product(b.part, b.part) AS d
            FROM p JOIN b{r} b ON p.pos = b.pos) GROUP BY rid, pos)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT pos, entry, list(floor(s / n) ORDER BY k) AS part FROM (
                SELECT pos, entry, k, sum(part[k]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, width + 1)) AS k FROM w)
                GROUP BY pos, entry, k) GROUP BY pos, entry),
            b{r + 1} AS (SELECT b.pos, b.entry, coalesce(m.part, b.part) AS part FROM b{r} b LEFT JOIN m{r} m
                ON m.pos = b.pos AND m.entry = b.entry)""")
    return f"""
        WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label,
                list_transform(embedding, lambda c: floor(CAST(c AS DOUBLE) * 1024)) AS x FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        w AS (SELECT len(x) // 4 AS width FROM v LIMIT 1),
        p AS MATERIALIZED (SELECT rid, pos, part, list_dot_product(part, part) AS norm FROM (
            SELECT rid, pos, x[pos * width + 1 : pos * width + width] AS part
            FROM v, w, (SELECT unnest(range(4)) AS pos))),
        b0 AS (SELECT pos, rid AS entry, part FROM p WHERE rid < 256), {', '.join(steps)},
        c AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM a{rounds} GROUP BY rid),
        h AS (SELECT sha256(string_agg(CAST(CAST(part[k] AS BIGINT) AS VARCHAR), ',' ORDER BY pos, entry, k)) AS codebooks_sha256
            FROM b{rounds}, (SELECT unnest(range(1, width + 1)) AS k FROM w))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM v JOIN c USING (rid), h"""


ORACLES: dict[str, str] = {
    "op13_vector_codes": vector_codes_sql(),
    "op7_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
}
