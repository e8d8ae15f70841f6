"""The corpus pipeline: language ID, exact de-duplication, near de-duplication, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.exact_dedup import exact_dedup, without_whitespace
from corpusloom.llm.language_id import identify_language
from corpusloom.llm.mixing import draws, mix_sources
from corpusloom.llm.near_dedup import near_dedup
from corpusloom.llm.packing import pack_best_fit
from corpusloom.llm.scratch import broadcast_checked, free_name, temporary, written

#: Documents whose best language is less probable than this go. On held-out documents (op8's rule) of the small check table 8 of 10251
#: are below it, of which 5 are right; from 0.4 to 0.5 30 of 36 are right, and texts in two languages have 0.4 or more in one of them.
LEAST_SCORE = 0.4
MIX_SEED = "mix"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language stay."""
    found = identify_language(docs, keep=tuple(docs.columns))
    label, score = found.columns[-2:]  # with underscores, if documents have columns of these names
    return found.where((found[label] != "und") & (found[score] >= LEAST_SCORE)).select(*[found[f"`{c}`"] for c in docs.columns])


def joined(docs: DataFrame, decisions: DataFrame, keys: list[tuple[str, Column]], how: str) -> DataFrame:
    """``docs`` joined to ``decisions`` (a written table) on key columns of these, each equal (null to null) to what an expression gives for a document.

    Decisions on some documents (anti- and semi-joins) are broadcast up to 100,000, as counted; more, and decisions on all
    documents, meet these in a shuffled join.
    """
    names = {c: free_name(f"_decided_{c}", docs.columns) for c in decisions.columns}
    decisions = decisions.select(*[F.col(c).alias(n) for c, n in names.items()])
    decisions = decisions.hint("merge") if how == "inner" else broadcast_checked(decisions)
    on = [made.eqNullSafe(F.col(names[c])) for c, made in keys]
    return docs.join(decisions, on, how)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays; of rows that share id and text, the one with the longest original.

    What goes is told by an anti-join, so where few documents go, no texts are moved.
    """
    with temporary(spark) as keep:
        found = exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
        found = written(found, "pipeline-exact")
        found = found.withColumn("sha", F.unhex("text_sha256"))
        gone = keep(written(found.where("not kept or n > 1").select("doc_id", "sha"), "pipeline-gone"))
        repeated = keep(written(found.where("kept and n > 1").select("doc_id", "sha"), "pipeline-repeated"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = [("doc_id", F.col("doc_id")), ("sha", F.unhex(F.sha2(without_whitespace(text).cast("binary"), 256)))]
    out = joined(docs, gone, keys, "left_anti")
    if repeated.isEmpty():
        return out
    row, length = free_name("_row", docs.columns), F.length(text)
    once = joined(docs, repeated, keys, "left_semi").groupBy(*[k.alias(c) for c, k in keys])
    return out.unionByName(once.agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), length).alias(row)).select(f"{row}.*"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays. Rows that share an id are one document; rows without an id stay."""
    gone = written(near_dedup(docs).where("not kept").select("doc_id").distinct(), "pipeline-near")
    return joined(docs, gone, [("doc_id", F.col("doc_id"))], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; documents without words, which the mix neither takes nor drops, stay once.

    Rows that share id and text are taken equally often, as near to what the mix takes of them as that allows.
    """
    copies = F.when(F.col("size") > 0, F.try_divide("taken", "size")).otherwise(1)
    taken = mix_sources(docs, seed=MIX_SEED).groupBy("doc_id", "draw").agg(F.round(F.avg(copies)).cast("int").alias("copies")).where("copies > 0")
    taken = written(taken, "pipeline-mix")
    key = [("doc_id", F.col("doc_id")), ("draw", draws(F.col("doc_id").cast("long"), F.col("text").cast("string"), MIX_SEED))]
    name = free_name("_decided_copies", docs.columns)
    repeats = F.explode(F.sequence(F.lit(1), F.col(name))).alias(free_name("_copy", docs.columns))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return joined(docs, taken, key, "inner").select(*columns, repeats).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document (or piece of one) lies in which sequence."""
    return pack_best_fit(docs)


STAGES = [("language_id", language_id), ("exact_dedup", dedup_exact), ("near_dedup", dedup_near), ("mix_sources", mix), ("best_fit_packing", pack)]

#: Training the language network cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on documents, each written and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"pipeline-{name}")
    return docs
