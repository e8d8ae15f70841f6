"""Co-occurrence of tokens in context windows, and HAL weights.

A pair's value in a document is the sum over its windows of the product of the two tokens' counts there. For two positions p < q
that is the number of windows holding both, which position arithmetic gives: no window is ever materialised, and the pairs of a
document come out of its own row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.tokens import PAD
from corpusloom.operators.blocks import window_pair_sums
from corpusloom.operators.windows import concept_windows


def _position_pairs(tokens: Column, reach: int, weight) -> Column:
    """Array of (w1, w2, value) over positions p < q <= p + reach; ``weight(p, q, n)``; positions count from 0."""
    n = F.size(tokens)
    positions = F.slice(F.sequence(F.lit(0), n), 1, n)
    ahead = lambda p: F.slice(F.sequence(p + 1, p + 1 + F.lit(reach)), 1, F.greatest(F.lit(0), F.least(F.lit(reach), n - 1 - p)))
    pairs = lambda p: F.transform(ahead(p), lambda q: F.struct(F.get(tokens, p).alias("a"), F.get(tokens, q).alias("b"), weight(p, q, n).alias("v")))
    return F.flatten(F.transform(positions, pairs))


def window_pairs(docs: DataFrame, width: int, keys: Iterable[str] = ("document_id",), tokens: str = "tokens", pad: str = PAD) -> DataFrame:
    """Keys, w1 < w2, value. Pads hold their place but do not pair; a token does not pair with itself."""
    return window_pair_sums(docs, width, keys, tokens, pad)


def window_counts(docs: DataFrame, width: int, keys: Iterable[str] = ("document_id",), tokens: str = "tokens", pad: str = PAD) -> DataFrame:
    """Keys, token, n_windows: how many windows hold the token.

    An occurrence at p is in windows p - width .. p + width; it adds those that the token's previous occurrence has not covered.
    """
    numbered = docs.withColumn("_doc", F.monotonically_increasing_id())  # before the explosion, so that a document has one number
    flat = numbered.select(*keys, "_doc", F.size(tokens).alias("_n"), F.posexplode(tokens).alias("_p", "token")).where(F.col("token") != pad)
    before = F.lag("_p").over(Window.partitionBy("_doc", "token").orderBy("_p"))
    first = F.greatest(F.lit(0), F.col("_p") - width, F.coalesce(before + width + 1, F.lit(0)))
    last = F.least(F.col("_n") - 1, F.col("_p") + width)
    return flat.withColumn("_new", F.greatest(last - first + 1, F.lit(0)).cast("long")).groupBy(*keys, "token").agg(F.sum("_new").alias("n_windows"))


def concept_pairs(docs: DataFrame, width: int, concepts: tuple[str, ...], keys: Iterable[str] = ("document_id",), tokens: str = "tokens", ignore_concept: bool = False) -> DataFrame:
    """A33 with concepts: pairs over the windows that hold a concept word; these are few, so they are spelled out, each with its counts."""
    windows = docs.select(*keys, F.explode(concept_windows(F.col(tokens), width, concepts, ignore_concept)).alias("_w"))
    pairs = F.flatten(F.transform("_w", lambda a, i: F.transform(F.filter("_w", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = windows.select(*keys, F.explode(pairs).alias("_p"))
    return rows.groupBy(*keys, F.col("_p.a").alias("w1"), F.col("_p.b").alias("w2")).agg(F.count(F.lit(1)).alias("value"))


def group_pairs(coo: DataFrame, keys: list[str]) -> DataFrame:
    """Sums per group and pair."""
    return coo.groupBy(*keys, "w1", "w2").agg(F.sum("value").alias("value"))


def above_global_threshold(coo: DataFrame, threshold: float) -> DataFrame:
    """Cells of pairs whose values sum to the threshold or more."""
    pairs = coo.groupBy("w1", "w2").agg(F.sum("value").alias("_sum")).where(F.col("_sum") >= threshold).select("w1", "w2")
    return coo.join(pairs, ["w1", "w2"], "left_semi")


def match(coo: DataFrame, words: Iterable[str]) -> DataFrame:
    """Pairs with one of the words."""
    words = list(words)
    return coo.where(F.col("w1").isin(words) | F.col("w2").isin(words))


def exclude(coo: DataFrame, words: Iterable[str]) -> DataFrame:
    """Pairs with none of the words."""
    words = list(words)
    return coo.where(~F.col("w1").isin(words) & ~F.col("w2").isin(words))


def largest(coo: DataFrame, n: int, keys: list[str], column: str = "value") -> DataFrame:
    """The n largest pairs of each group, ties by the words; tasks cut their lists before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(column), "w1", "w2")
    return coo.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hal_weights(docs: DataFrame, size: int, metric: int = 0, keys: Iterable[str] = (), tokens: str = "tokens") -> DataFrame:
    """Keys, w1, w2 (w1 before w2), weight over forward distances d = 1 .. size: 0: size - d + 1, 1: 1 / d, 2: 1."""
    by = {0: lambda p, q, n: (F.lit(size + 1) - (q - p)).cast("double"), 1: lambda p, q, n: 1.0 / (q - p), 2: lambda p, q, n: F.lit(1.0)}[metric]
    rows = docs.select(*keys, F.explode(_position_pairs(F.col(tokens), size, by)).alias("_p"))
    return rows.groupBy(*keys, F.col("_p.a").alias("w1"), F.col("_p.b").alias("w2")).agg(F.sum("_p.v").alias("weight"))


def hal_frame(docs: DataFrame, size: int, metric: int = 2, keys: Iterable[str] = (), tokens: str = "tokens") -> DataFrame:
    """Unordered pairs with nw_xy (their weight), nw_x, nw_y (windows of size + 1 holding each, counted by members) and cwr = nw_xy / (nw_x + nw_y - nw_xy)."""
    keys = list(keys)
    pairs = hal_weights(docs, size, metric, keys, tokens).where("w1 <> w2").groupBy(*keys, F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).agg(F.sum("weight").alias("nw_xy"))
    n = F.size(tokens)
    members = docs.select(*keys, F.posexplode(tokens).alias("_i", "token"), n.alias("_n")).withColumn("_m", F.least(F.col("_i") + 1, F.lit(size + 1)).cast("double"))
    counts = members.groupBy(*keys, "token").agg(F.sum("_m").alias("_c"))
    out = pairs.join(counts.withColumnsRenamed({"token": "w1", "_c": "nw_x"}), [*keys, "w1"]).join(counts.withColumnsRenamed({"token": "w2", "_c": "nw_y"}), [*keys, "w2"])
    return out.withColumn("cwr", F.coalesce(F.try_divide(F.col("nw_xy"), F.col("nw_x") + F.col("nw_y") - F.col("nw_xy")), F.lit(0.0)))


def glove_frame(docs: DataFrame, size: int, normalize: str | None = "size", keys: Iterable[str] = (), tokens: str = "tokens") -> DataFrame:
    """Unordered pairs of different tokens with nw_xy, the sum of 1 / distance up to ``size``, and cwr: nw_xy over the number of tokens ("size"), the largest nw_xy ("max"), or 1 (None)."""
    keys = list(keys)
    pairs = hal_weights(docs, size, 1, keys, tokens).where("w1 <> w2").groupBy(*keys, F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).agg(F.sum("weight").alias("nw_xy"))
    pairs = pairs.withColumns({"nw_x": F.lit(0), "nw_y": F.lit(0)})
    if normalize is None:
        return pairs.withColumn("cwr", F.col("nw_xy"))
    if normalize not in ("size", "max"):
        raise ValueError(f"unknown normalization: {normalize}")
    norm = docs.groupBy(*keys).agg(F.sum(F.size(tokens)).alias("_norm")) if normalize == "size" else pairs.groupBy(*keys).agg(F.max("nw_xy").alias("_norm"))
    joined = pairs.join(norm, keys) if keys else pairs.join(F.broadcast(norm))  # one row
    return joined.withColumn("cwr", F.col("nw_xy") / F.col("_norm")).where("cwr > 0").drop("_norm")


def window_statistics(docs: DataFrame, width: int, keys: Iterable[str] = ("document_id",), tokens: str = "tokens") -> DataFrame:
    """Keys, n_windows (one a token) and n_tokens, the windows' tokens altogether, from the number of tokens alone."""
    n = F.size(tokens).cast("long")
    side = F.when(n > width, n * width - width * (width + 1) // 2).otherwise((n * (n - 1) / 2).cast("long"))
    return docs.groupBy(*keys).agg(F.sum(n).alias("n_windows"), F.sum(n + 2 * side).alias("n_tokens"))


def token_window_totals(docs: DataFrame, width: int, keys: Iterable[str] = (), tokens: str = "tokens") -> DataFrame:
    """Keys, token, n: how often windows hold the token, each occurrence counted."""
    rows = docs.select(*keys, F.size(tokens).alias("_n"), F.posexplode(tokens).alias("_p", "token"))
    held = (F.least(F.col("_n") - 1, F.col("_p") + width) - F.greatest(F.lit(0), F.col("_p") - width) + 1).cast("long")
    return rows.groupBy(*keys, "token").agg(F.sum(held).alias("n"))


def add_documents(coo: DataFrame, more: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Pairs of further documents added to pairs already counted."""
    return group_pairs(coo.unionByName(more), list(keys))
