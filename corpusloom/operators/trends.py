"""Word trends over time, and terms that tell two periods apart."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.predicates import word_predicate
from corpusloom.operators.dtm import Dtm
from corpusloom.operators.index import temporal_key


@dataclass(frozen=True)
class TrendOpts:
    """What to compute: weights first (tf, tf_idf, or tf over the document's words), then groups by period and pivot columns."""

    metric: str = "tf"
    temporal_key: str | int | dict = "year"
    pivots: tuple[str, ...] = ()
    filters: dict | None = None
    normalize: bool = False


def transform(dtm: Dtm, opts: TrendOpts) -> DataFrame:
    """Period, pivots, token, value."""
    dtm = dtm.filter(opts.filters) if opts.filters else dtm
    dtm = {"tf": lambda d: d, "tf_idf": lambda d: d.tf_idf(), "tf_normalized": lambda d: d.with_token_counts().normalize_by_raw_counts()}[opts.metric](dtm)
    keys: dict[str, Column] = {"period": temporal_key(F.col("year"), opts.temporal_key), **{p: F.col(p) for p in opts.pivots}}
    grouped = dtm.group_by(keys)
    if not opts.normalize:
        return grouped
    totals = grouped.groupBy(*keys).agg(F.sum("value").alias("_all"))
    return grouped.join(totals, list(keys)).withColumn("value", F.coalesce(F.try_divide(F.col("value").cast("double"), F.col("_all")), F.lit(0.0))).drop("_all")


def extract(grouped: DataFrame, wanted: Iterable[str], top: int, keys: list[str] = ("period",)) -> DataFrame:
    """The rows of the ``top`` most frequent words that match; ties to the smaller word."""
    found = grouped.where(word_predicate(F.col("token"), wanted))
    words = found.groupBy("token").agg(F.sum("value").alias("_v")).orderBy(F.desc("_v"), "token").limit(top)
    return found.join(words.select("token"), "token").select(*keys, "token", "value")  # at most ``top`` rows


def wide(extracted: DataFrame, words: list[str], keys: list[str] = ("period",)) -> DataFrame:
    """One column a word, 0 where it is missing."""
    return extracted.groupBy(*keys).pivot("token", words).agg(F.sum("value")).na.fill(0)


def unnested(wide_frame: DataFrame, keys: list[str]) -> DataFrame:
    """Wide to long again."""
    words = [c for c in wide_frame.columns if c not in keys]
    return wide_frame.unpivot(list(keys), words, "token", "value")


def split_token(df: DataFrame, names: tuple[str, str], sep: str = "/", column: str = "token") -> DataFrame:
    """``w1/w2`` or ``token@tag`` to two columns."""
    parts = F.split(column, "\\Q" + sep + "\\E", 2)
    return df.withColumns({names[0]: parts[0], names[1]: F.get(parts, F.lit(1))})


def discriminating_terms(dtm: Dtm, first: tuple[int, int], second: tuple[int, int], n: int, max_terms: int = 1000) -> DataFrame:
    """Terms by the difference of the shares of documents that have them in two ranges of years.

    Of the ``max_terms`` most frequent terms, the n with the largest absolute difference; group says which range they belong to.
    """
    of = lambda span: F.col("year").between(*span)
    index = dtm.index.select("document_id", F.when(of(first), 1).when(of(second), 2).alias("_g")).where("_g is not null")
    sizes = index.agg(F.count_if(F.col("_g") == 1).alias("_n1"), F.count_if(F.col("_g") == 2).alias("_n2"))
    cells = dtm.cells.join(index, "document_id")
    counts = cells.groupBy("token").agg(F.sum("value").alias("_tf"), F.count_if(F.col("_g") == 1).alias("_d1"), F.count_if(F.col("_g") == 2).alias("_d2"))
    counts = counts.orderBy(F.desc("_tf"), "token").limit(max_terms).join(F.broadcast(sizes))  # one row
    difference = F.coalesce(F.try_divide("_d1", "_n1"), F.lit(0.0)) - F.coalesce(F.try_divide("_d2", "_n2"), F.lit(0.0))
    scored = counts.select("token", F.when(difference >= 0, 1).otherwise(2).alias("group"), F.abs(difference).alias("score"))
    return scored.orderBy(F.desc("score"), "token").limit(n)


def with_options(opts: TrendOpts, **changes) -> TrendOpts:
    """Options are values: results can be kept by them."""
    return replace(opts, **changes)
