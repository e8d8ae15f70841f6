"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.exact_dedup import exact_dedup
from corpusloom.llm.hmm import hmm_score
from corpusloom.llm.knn import top_k
from corpusloom.llm.language_id import identify_language
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.near_dedup import near_dedup
from corpusloom.llm.packing import pack_best_fit
from corpusloom.llm.secrets import scan_secrets
from corpusloom.llm.token_counts import count_tokens
from corpusloom.llm.toxicity import score_toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op5_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_score(documents(spark, sf_dir), train_on=F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("vec_id") % 20 == 0)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    of_kind = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of_kind("assign"), of_kind("access"), of_kind("hex"), F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    found = identify_language(documents(spark, sf_dir), train_on=rest != 0)
    return found.select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_near_dedup": op3_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_hmm_scores": op5_hmm_scores,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_secret_scan": op7_secret_scan,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_mix_sources": op10_mix_sources,
    "pipeline": pipeline,
}

OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), g AS (
  SELECT n, first(doc_id ORDER BY length(x) DESC, doc_id) FILTER (WHERE doc_id IS NOT NULL) AS keep_id, count(*) AS group_size FROM t GROUP BY n
)
SELECT t.doc_id, g.keep_id, g.group_size::BIGINT AS group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.n) AS text_sha256
FROM t JOIN g USING (n)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 13))::BIGINT AS draw FROM documents
), d2 AS (
  SELECT *, ceil(sqrt(size::DOUBLE))::BIGINT AS m FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * words AS cap FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(words) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, encode(source))
), t AS (
  SELECT *, max(CASE WHEN level * weight < cap THEN level END) OVER () AS top FROM l
), g AS (
  SELECT source, words, CASE WHEN top IS NULL THEN cap ELSE least(cap, top * weight) END AS target FROM t
), h AS (
  SELECT *, CASE WHEN words = 0 THEN 0 ELSE floor(target / words) END AS certain FROM g
), h2 AS (
  SELECT *, greatest(target - certain * words, 0) AS rest FROM h
), by_m AS (
  SELECT d2.source, m, any_value(rest) AS rest, sum(size)::DOUBLE AS w FROM d2 JOIN h2 ON d2.source IS NOT DISTINCT FROM h2.source WHERE m > 0 GROUP BY d2.source, m
), tried AS (
  SELECT *, coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sure,
         (rest - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(m * w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
  FROM by_m WINDOW f AS (PARTITION BY source ORDER BY m DESC)
), chance AS (
  SELECT source, arg_max(c, m) AS c, arg_max(sure, m) AS sure FROM tried WHERE c * m < 1 GROUP BY source
), q AS (
  SELECT d2.*, h2.words, h2.target, h2.certain, greatest(h2.rest - coalesce(chance.sure, 0), 0) AS rest, coalesce(chance.c * m, 0) AS f, (draw + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM d2 JOIN h2 ON d2.source IS NOT DISTINCT FROM h2.source LEFT JOIN chance ON d2.source IS NOT DISTINCT FROM chance.source
), r AS (
  SELECT *, sum(CASE WHEN f > 0 AND f < 1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY CASE WHEN f > 0 AND f < 1 THEN (u / (1 - u)) / (f / (1 - f)) ELSE -1 END, doc_id NULLS FIRST, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM q
)
SELECT doc_id, size, words AS source_size, target, draw,
       ((certain + CASE WHEN f >= 1 OR (f > 0 AND rest > 0 AND run - size / 2.0::DOUBLE <= rest) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
"""

OP6_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {"op6_exact_top_k": OP6_SQL, "op4_exact_dedup": OP4_SQL, "op10_mix_sources": OP10_SQL}
