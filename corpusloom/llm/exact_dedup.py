"""Exact de-duplication with DataFrame functions only.

Texts are equal when they are identical after every white space character is deleted. First only the 128-bit MD5 hashes of that
form meet. Texts whose hash occurs twice or more are then grouped by hash *and* bytes, so that a hash collision never merges
two texts: the byte comparison is the grouping key itself, and map-side partial aggregation folds the copies a task has seen
before anything is shuffled, which keeps a group holding a third of all rows from landing in one task. The decisions go back to
the narrow digest rows by an equi-join that adaptive execution may split. So shuffled texts follow the number of copies, not the
size of the corpus, as long as Spark broadcasts the repeated hashes; beyond that size the texts meet them in a shuffled join.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import WHITESPACE, id_and_text, written


def without_whitespace(text: Column) -> Column:
    for c in WHITESPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the smallest id. Null text counts as
    empty; all empty (or white-space-only) texts are one group. Rows with a null id count in group_size but are chosen only
    if their group has no other; then keep_id is null and they are kept. Repeated rows share their id and so their fate.
    Other columns of ``df`` are ignored, whatever their names; an empty table gives an empty result. Two different texts
    that agreed in both digests would end the query with an error rather than be merged.
    """
    rows = id_and_text(df, id_col, text_col).withColumn("_norm", without_whitespace(F.col("_text"))).withColumn("_h", hash_of(F.col("_norm")))
    digests = written(rows.select("_id", "_h", F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)).alias("_sha")), "exact-digests")
    # only texts whose hash occurs twice or more have anything to be compared with; Spark broadcasts these hashes while they are few
    several = written(digests.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), "exact-several")
    # most code points first, then smallest id, as one fixed-width number so that the aggregation stays hash-based; ids span 2**64 < 10**20
    rank = F.length("_text").cast("decimal(10,0)") * F.lit(Decimal(10**20)) - F.col("_id").cast("decimal(20,0)")
    groups = (
        rows.withColumn("_rank", rank)
        .join(several, "_h", "left_semi")
        .groupBy("_h", "_norm")
        .agg(F.max_by("_id", "_rank").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        .select("_h", F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)).alias("_sha"), "_keep", "_n")
        .groupBy("_h", "_sha")
        .agg(F.first("_keep").alias("_keep"), F.first("_n").alias("_n"), F.count(F.lit(1)).alias("_texts"))
        .withColumn("_n", F.when(F.col("_texts") == 1, F.col("_n")).otherwise(F.raise_error(F.lit("two different texts agree in both digests"))))
    )
    # written, so that both sides of the join are exchanges of their own and a hot group's side can be split; a hash seen once is its own group
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return digests.join(written(groups.select("_h", "_sha", "_keep", "_n"), "exact-groups"), ["_h", "_sha"], "left").select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
