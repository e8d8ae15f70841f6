"""Keyness metrics of token pairs as column expressions over a partition's totals.

Notation: c the pair's value, z the partition's sum, a and b the sums of the rows of w1 and w2 in the upper triangle (w1 < w2), so
a word that only ever comes second has b = 0. Undefined and infinite results become 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ln(x: Column) -> Column:
    """Natural logarithm clipped at 1e-10."""
    return F.ln(F.greatest(x, F.lit(1e-10)))


def _ratio(x: Column, y: Column) -> Column:
    return F.try_divide(x, y)


def pmi(c, z, a, b, n, normalize):
    return F.ln(_ratio(c * z, a * b))


def ppmi(c, z, a, b, n, normalize):
    """M4: the normalised form divides by -ln(c * z)."""
    value = pmi(c, z, a, b, n, normalize)
    return F.greatest(_ratio(value, -F.ln(c * z)) if normalize else value, F.lit(0.0))


def dice(c, z, a, b, n, normalize):
    """M5."""
    return _ratio(2.0 * c, a + b)


def llr(c, z, a, b, n, normalize):
    """M6: log-likelihood ratio with the number of contexts taken as z."""
    x = lambda v: v * _ln(v)
    return 2.0 * (x(z) - x(a) - x(b) + x(c) + x(z - a - b + c) + x(a - c) + x(b - c) - x(z - a) - x(z - b))


def llr_dunning(c, z, a, b, n, normalize):
    """M7: the factor -2 stands before the first term only."""
    like = lambda k, m, p: _ln(p) * k + _ln(1 - p) * (m - k)
    p, pi, pj = _ratio(b, z), _ratio(c, a), _ratio(b - c, z - a)
    return -2.0 * like(c, a, p) + like(b - c, z - a, p) - like(c, a, pi) - like(b - c, z - a, pj)


def llr_dunning_words(c, z, a, b, n, normalize):
    """M8: M7 with the number of words for z."""
    return llr_dunning(c, n, a, b, n, normalize)


def hal_cwr(c, z, a, b, n, normalize):
    """M9: common windows over all windows of either word."""
    return _ratio(c, a + b - c)


METRICS: dict[str, Callable[..., Column]] = {"PMI": pmi, "PPMI": ppmi, "DICE": dice, "LLR": llr, "LLR_Z": llr_dunning, "LLR_N": llr_dunning_words, "HAL_cwr": hal_cwr}


def significance(coo: DataFrame, metric: str | Callable, keys: list[str] = (), words: DataFrame | None = None, normalize: bool = False, symmetric: bool = False) -> DataFrame:
    """Keys, w1, w2, value, weight; zero weights are left out.

    ``words``: keys and n_words, for LLR_N. ``symmetric`` takes the sums over both places of a word instead of the first alone.
    """
    keys = list(keys)
    fn = METRICS[metric] if isinstance(metric, str) else metric
    c = F.col("value").cast("double")
    # imported here, as operators import functions
    from corpusloom.operators.blocks import small, with_word_values

    joined, total = with_word_values(coo if hasattr(coo, "from_parts") else coo.where("value <> 0"), keys, symmetric=symmetric)  # sums of windows are never 0
    joined = joined.join(small(total, "totals"), keys) if keys else joined.join(F.broadcast(total))  # without keys one row
    joined = joined.join(small(words.withColumnRenamed("n_words", "_n"), "words"), keys) if words is not None else joined.withColumn("_n", F.lit(None).cast("double"))
    at = [F.coalesce(F.col(x), F.lit(0.0)) for x in ("_a", "_b")]
    weight = fn(c, F.col("_z"), *at, F.col("_n").cast("double"), normalize)
    # exploded, the weight is worked out once; as a column, once for each mention of it
    once = joined.select(*keys, "w1", "w2", "value", F.explode(F.array(weight.cast("double"))).alias("_w"))
    w = F.col("_w")
    finite = F.when(F.isnan(w) | (F.abs(w) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(w, F.lit(0.0)))
    return once.select(*keys, "w1", "w2", "value", finite.alias("weight")).where("weight <> 0")


def hal_cwr_by_windows(coo: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Common window ratio with true window counts (keys, token, n_windows); undefined and negative become 0."""
    from corpusloom.operators.blocks import with_word_values

    joined, _ = with_word_values(coo, keys, windows.withColumnRenamed("n_windows", "n"))
    joined = joined.withColumnsRenamed({"_a": "_x", "_b": "_y"})
    ratio = _ratio(F.col("value").cast("double"), F.col("_x") + F.col("_y") - F.col("value"))
    return joined.select(*keys, "w1", "w2", "value", F.greatest(F.coalesce(ratio, F.lit(0.0)), F.lit(0.0)).alias("weight"))


def weigh(full: DataFrame, concept: DataFrame, keys: list[str], column: str = "weight") -> DataFrame:
    """Concept over full where both have the pair."""
    other = full.select(*keys, "w1", "w2", F.col(column).alias("_full"))
    joined = concept.join(other, [*keys, "w1", "w2"])
    return joined.withColumn(column, F.coalesce(_ratio(F.col(column), F.col("_full")), F.lit(0.0))).drop("_full")


def per_words(coo: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Value over the group's number of words (keys, n_words)."""
    from corpusloom.operators.blocks import small

    return coo.join(small(counts, "words"), keys).withColumn("value", F.coalesce(_ratio(F.col("value").cast("double"), F.col("n_words")), F.lit(0.0))).drop("n_words")
