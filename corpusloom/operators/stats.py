"""Goodness of fit to a uniform distribution, trends, curves and smoothing.

A token's series over D documents (or periods) is long and without zeros; closed forms bring the zeros back through D.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-5


#: The metrics that can be asked for, and their columns.
METRICS = {
    "l2_norm": ("l2_norm",), "slope": ("slope", "intercept"), "chi2_stats": ("chi2_stats", "chi2_p"), "stats": ("min", "max", "mean"),
    "earth_mover": ("earth_mover",), "entropy": ("entropy",), "kld": ("kld",), "skew": ("skew",),
}


def gof_metrics(cells: DataFrame, documents: int, metrics: list[str] | None = None, x_offset: float = 0.0, ordinal: str = "x") -> DataFrame:
    """G1: token, word_count and the columns of the named metrics (all, if None); the slope's line is over ordinals from ``x_offset``."""
    wanted = list(METRICS) if metrics is None else metrics
    if unknown := set(wanted) - set(METRICS):
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    found = goodness_of_fit(cells, documents, ordinal).withColumnRenamed("earth_mover_distance", "earth_mover")
    found = found.withColumn("intercept", F.col("intercept") - F.col("slope") * F.lit(x_offset))
    if "chi2_stats" in wanted:
        found = found.withColumn("chi2_p", chi_squared_p(F.col("chi2_stats"), documents - 1))
    return found.select("token", "word_count", *[c for m in wanted for c in METRICS[m]])


def goodness_of_fit(cells: DataFrame, documents: int, ordinal: str = "x") -> DataFrame:
    """Per token word_count, l2_norm, slope, intercept, chi2_stats, earth_mover_distance, entropy, kld, skew, min, max, mean.

    ``cells``: token, value, and the document's ordinal 0 .. documents - 1, at most one row for each.
    """
    if documents <= 1:
        raise ValueError("at least two documents are needed")
    d, v, x = float(documents), F.col("value").cast("double"), F.col(ordinal).cast("double")
    sums = cells.groupBy("token").agg(
        F.sum(v).alias("_s1"), F.sum(v * v).alias("_s2"), F.sum(v * v * v).alias("_s3"), F.sum(x * v).alias("_xv"), F.count(F.lit(1)).alias("_k"), F.min(v).alias("_min"), F.max(v).alias("_max"),
    )
    mean = F.col("_s1") / d
    deviations = cells.join(sums.select("token", "_s1"), "token").groupBy("token").agg(
        F.sum(F.abs(v - mean)).alias("_abs"), F.sum(v / F.col("_s1") * F.ln(v / F.col("_s1") * d)).alias("entropy"), F.sum((v + EPSILON) * F.ln((v + EPSILON) / (mean + EPSILON))).alias("_kl"),
    )
    x1, x2 = d * (d - 1) / 2, (d - 1) * d * (2 * d - 1) / 6
    slope = (d * F.col("_xv") - x1 * F.col("_s1")) / (d * x2 - x1 * x1)
    empty = d - F.col("_k")
    variance = F.col("_s2") / d - mean * mean
    out = sums.join(deviations, "token")
    return out.select(
        "token",
        F.col("_s1").alias("word_count"),
        ((F.sqrt(F.col("_s2")) * d**0.5 - 1) / (d**0.5 - 1)).alias("l2_norm"),
        slope.alias("slope"),
        (mean - slope * x1 / d).alias("intercept"),
        (F.col("_s2") / mean - F.col("_s1")).alias("chi2_stats"),
        ((F.col("_abs") + empty * mean) / d).alias("earth_mover_distance"),
        "entropy",
        (F.col("_kl") + empty * EPSILON * F.ln(EPSILON / (mean + EPSILON))).alias("kld"),
        F.coalesce(F.try_divide(F.col("_s3") / d - 3 * mean * F.col("_s2") / d + 2 * mean * mean * mean, F.pow(F.greatest(variance, F.lit(0.0)), F.lit(1.5))), F.lit(0.0)).alias("skew"),
        F.when(empty > 0, F.least("_min", F.lit(0.0))).otherwise(F.col("_min")).alias("min"),
        F.when(empty > 0, F.greatest("_max", F.lit(0.0))).otherwise(F.col("_max")).alias("max"),
        mean.alias("mean"),
    )


def most_deviating(gof: DataFrame, metric: str, n: int) -> DataFrame:
    """By the metric's absolute value."""
    return gof.orderBy(F.desc(F.abs(metric)), "token").limit(n)


def slopes(cells: DataFrame, keys: list[str], x: str = "year", y: str = "value") -> DataFrame:
    """Least squares of y on x per key: k, m, and the line's ends at the first and last x."""
    k, m = F.regr_slope(y, x), F.regr_intercept(y, x)
    return cells.groupBy(*keys).agg(k.alias("k"), m.alias("m"), F.min(x).alias("x1"), F.max(x).alias("x2")).withColumns({"y1": F.col("k") * F.col("x1") + F.col("m"), "y2": F.col("k") * F.col("x2") + F.col("m")})


def slopes_with_p(cells: DataFrame, keys: list[str], x: str = "year", y: str = "value") -> DataFrame:
    """``slopes`` and p, the two-sided probability of such a slope if there were none (Student's t); null under three points."""
    r2, n = F.regr_r2(y, x), F.regr_count(y, x)
    tests = cells.groupBy(*keys).agg(r2.alias("_r2"), n.alias("_n"))
    return slopes(cells, keys, x, y).join(tests, list(keys)).withColumn("p", _slope_p(F.col("_r2").cast("double"), F.col("_n").cast("double"))).drop("_r2", "_n")


def _slope_p(r2: Column, n: Column) -> Column:
    @F.pandas_udf("double")
    def run(r2: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if not (c > 2) or r != r else student_tail(r, c - 2) for r, c in zip(r2, n, strict=True)], dtype="float64")

    return run(r2, n)


def student_tail(r2: float, freedom: float) -> float:
    """Two-sided tail of Student's t for a squared correlation: the regularised incomplete beta function I(1 - r2; freedom / 2, 1 / 2)."""
    from math import exp, lgamma, log

    x, a, b = min(1.0, max(0.0, 1 - r2)), freedom / 2, 0.5
    if x in (0.0, 1.0):
        return x

    def fraction(x, a, b):  # the continued fraction of the incomplete beta function
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        h = d
        for m in range(1, 1000):
            for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + term * d or 1e-300)
                c = 1 + term / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def token_count_data(index: DataFrame, grouping: str, columns: list[str], total: str = "n_tokens", normalize: bool = False, smooth: bool = False) -> DataFrame:
    """Sums of count columns by a numeric grouping, on demand over the group's total, and values that are missing (no tokens) interpolated along the grouping.

    A missing value between two known ones lies on the line between them, after the last one it is that one, before the first it stays null.
    """
    sums = index.groupBy(grouping).agg(*[F.sum(c).cast("double").alias(c) for c in columns], F.sum(total).cast("double").alias("_total"))
    if normalize:
        sums = sums.withColumns({c: F.try_divide(c, "_total") for c in columns})
    sums = sums.drop("_total")
    if not smooth:
        return sums
    # one row a group: few
    before, after = Window.orderBy(grouping).rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(grouping).rowsBetween(0, Window.unboundedFollowing)
    x = F.col(grouping)
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(x.cast("double").alias("x"), F.col(c).alias("y")))
        a, b = F.last(known, ignorenulls=True).over(before), F.first(known, ignorenulls=True).over(after)
        between = a["y"] + (b["y"] - a["y"]) * F.try_divide(x - a["x"], b["x"] - a["x"])
        sums = sums.withColumn("_" + c, F.coalesce(F.col(c), between, a["y"]))
    return sums.select(grouping, *[F.col("_" + c).alias(c) for c in columns])


def boxplot(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Quartiles, interquartile range, whiskers at 1.5 of it, number of outliers."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    quartiles = df.groupBy(*keys).agg(q.alias("_q")).select(*keys, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q2"), F.col("_q")[2].alias("q3"))
    quartiles = quartiles.withColumn("iqr", F.col("q3") - F.col("q1")).withColumns({"upper": F.col("q3") + 1.5 * F.col("iqr"), "lower": F.col("q1") - 1.5 * F.col("iqr")})
    joined = df.join(quartiles, list(keys)) if keys else df.join(F.broadcast(quartiles))  # one row
    names = [*keys, "q1", "q2", "q3", "iqr", "upper", "lower"]
    return joined.groupBy(*names).agg(F.count_if((F.col(value) > F.col("upper")) | (F.col(value) < F.col("lower"))).alias("n_outliers"))


def rolling_average(df: DataFrame, order: str, value: str, n: int, keys: list[str] = (), centred: bool = False) -> Column:
    """Mean over the n last rows (or the rows around)."""
    frame = (-(n // 2), n // 2) if centred else (-(n - 1), 0)
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(*frame))


# curves: a series is a token's values by period, so a group is never larger than the number of periods

CURVES: dict[str, Callable] = {
    "linear": lambda x, a, b: a * x + b,
    "poly2": lambda x, a, b, c: a * x**2 + b * x + c,
    "poly3": lambda x, a, b, c, d: a * x**3 + b * x**2 + c * x + d,
    "poly4": lambda x, a, b, c, d, e: a * x**4 + b * x**3 + c * x**2 + d * x + e,
    "gaussian": lambda x, a, b, c: a * np.exp(-((x - b) ** 2) / (2 * c**2 + 1e-12)),
    "sigmoid": lambda x, a, b, c: a / (1 + np.exp(np.clip(-b * (x - c), -500, 500))),
    "inverse": lambda x, a, b: a / (x + 1e-12) + b,
    "square_root": lambda x, a, b: a * np.sqrt(np.maximum(x, 0)) + b,
    "zipf_mandelbrot": lambda x, a, b, c: a / np.power(np.maximum(x + b, 1e-9), c),
}


def least_squares(fn: Callable, x: np.ndarray, y: np.ndarray, start: np.ndarray, steps: int = 200) -> np.ndarray:
    """Levenberg-Marquardt with numerical derivatives."""
    p, damp = start.astype(float), 1e-2
    error = lambda q: float(((y - fn(x, *q)) ** 2).sum())
    now = error(p)
    for _ in range(steps):
        h = 1e-6 * np.maximum(1, np.abs(p))
        base = fn(x, *p)
        jac = np.stack([(fn(x, *(p + h * (np.arange(len(p)) == k))) - base) / h[k] for k in range(len(p))], 1)
        normal = jac.T @ jac
        step = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-9), jac.T @ (y - base), rcond=None)[0]
        new = error(p + step)
        if np.isfinite(new) and new < now:
            done = now - new < 1e-12 * (1 + now)
            p, now, damp = p + step, new, max(damp / 5, 1e-12)
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p


def fit_curve(df: DataFrame, keys: list[str], x: str, y: str, curve: str = "linear", step: float = 0.1) -> DataFrame:
    """Keys, x, y of the fitted curve, sampled at ``step``; x counts from the group's smallest."""
    fn = CURVES[curve]
    n = fn.__code__.co_argcount - 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        xs, ys = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        origin = xs[0]
        if curve.startswith("poly") or curve == "linear":
            degree = min(n - 1, len(xs) - 1)
            p = np.concatenate([np.zeros(n - 1 - degree), np.polyfit(xs - origin, ys, degree)])
        else:
            start = {"gaussian": [ys.max(), (xs - origin).mean(), (xs - origin).std() + 1], "sigmoid": [ys.max(), 1, (xs - origin).mean()]}.get(curve, [1.0] * n)
            p = least_squares(fn, xs - origin, ys, np.array(start, float))
        at = np.arange(0, xs[-1] - origin + step / 2, step)
        out = {k: [pdf[k].iloc[0]] * len(at) for k in keys}
        return pd.DataFrame({**out, "x": at + origin, "y": fn(at, *p)})

    return df.groupBy(*keys).applyInPandas(run, ", ".join([*[f"{k} {df.schema[k].dataType.simpleString()}" for k in keys], "x double, y double"]))


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation (Fritsch-Carlson slopes as harmonic means)."""
    if len(x) < 2:
        return np.full(len(at), y[0])
    h, delta = np.diff(x), np.diff(y) / np.diff(x)
    slope = np.zeros(len(x))
    if len(x) == 2:
        slope[:] = delta[0]
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = delta[:-1] * delta[1:] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            slope[1:-1] = np.where(same, (w1 + w2) / (w1 / delta[:-1] + w2 / delta[1:]), 0.0)

        def end(h0, h1, d0, d1):
            s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            return 0.0 if s * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

        slope[0], slope[-1] = end(h[0], h[1], delta[0], delta[1]), end(h[-1], h[-2], delta[-1], delta[-2])
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    t = (at - x[k]) / h[k]
    return (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h[k] * slope[k] + t**2 * (3 - 2 * t) * y[k + 1] + t**2 * (t - 1) * h[k] * slope[k + 1]


def spline(df: DataFrame, keys: list[str], x: str, y: str, step: float = 0.1) -> DataFrame:
    """Keys, x, y interpolated at ``step``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        xs, ys = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        at = np.arange(xs[0], xs[-1] + step / 2, step)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(at) for k in keys}, "x": at, "y": pchip(xs, ys, at)})

    return df.groupBy(*keys).applyInPandas(run, ", ".join([*[f"{k} {df.schema[k].dataType.simpleString()}" for k in keys], "x double, y double"]))


def chi_squared_tail(stat: float, freedom: int) -> float:
    """P(chi-squared > stat), by the series or the continued fraction of the incomplete gamma function."""
    from math import exp, lgamma, log

    a, x = freedom / 2, stat / 2
    if x <= 0:
        return 1.0
    front = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - total * front)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for n in range(1, 10_000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi_squared_p(stat: Column, freedom: int) -> Column:
    """G4 as a column."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: chi_squared_tail(v, freedom), na_action="ignore")

    return run(stat)
