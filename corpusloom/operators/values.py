"""Helpers on value columns, ranges and sets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_aggregate(df: DataFrame, aggregate: Column, name: str, keys: list[str] = ()) -> DataFrame:
    """``df`` with an aggregate of its group (of all rows, without keys) as a column: partial sums and a join, never one task's window."""
    sums = df.groupBy(*keys).agg(aggregate.alias(name))
    if not keys:
        return df.join(F.broadcast(sums))  # one row
    return df.join(sums, list(keys))


def normalize_values(df: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """Values over the largest of their group; where that is 0, as they are."""
    most = F.col("_most")
    return with_aggregate(df, F.max(column), "_most", keys).withColumn(column, F.when(most == 0, F.col(column).cast("double")).otherwise(F.col(column) / most)).drop("_most")


def normalize_by_norm(df: DataFrame, column: str, order: int = 1, keys: list[str] = ()) -> DataFrame:
    """Values over their group's norm of that order; where it is 0, as they are."""
    norm = F.pow(F.sum(F.pow(F.abs(F.col(column).cast("double")), F.lit(float(order)))), F.lit(1.0 / order))
    return with_aggregate(df, norm, "_norm", keys).withColumn(column, F.col(column) / F.when(F.col("_norm") == 0, 1.0).otherwise(F.col("_norm"))).drop("_norm")


def clamp(column: Column, low: float, high: float) -> Column:
    """M22."""
    return F.greatest(F.lit(low), F.least(column, F.lit(high)))


def project_to_range(share: Column, low: float, high: float) -> Column:
    """0 to low, 1 to high."""
    return F.lit(low) + F.lit(high - low) * share


def scale_to_range(df: DataFrame, column: str, low: float, high: float, keys: list[str] = ()) -> DataFrame:
    """0 to low, the largest of the group to high."""
    return with_aggregate(df, F.max(column), "_most", keys).withColumn(column, project_to_range(F.try_divide(F.col(column), F.col("_most")), low, high)).drop("_most")


def complete_range(df: DataFrame, column: str) -> DataFrame:
    """All whole numbers from the smallest to the largest value; none, if there are none."""
    span = df.agg(F.min(F.col(column).cast("long")).alias("_a"), F.max(F.col(column).cast("long")).alias("_b")).where("_a is not null")
    return span.select(F.explode(F.sequence("_a", "_b")).alias(column))


def value_range(df: DataFrame, column: str = "year") -> DataFrame:
    """One row: the first and the last value."""
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def slim_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """These columns cast, nulls as 0; columns that ``df`` lacks are left out."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(t) for c, t in types.items() if c in df.columns})


def rename_legacy(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Old names of count columns; a column that has its new name already stays."""
    names = names or {"n_terms": "n_tokens", "n_raw_terms": "n_raw_tokens"}
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns and new not in df.columns})


def inverted(df: DataFrame, key: str, values: str) -> DataFrame:
    """A table of lists turned round: each value with its key."""
    return df.select(F.explode(values).alias(values), key)


def only_in_one(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Names that only one of two tables has: column, in_left."""
    a = left.select(column).distinct().withColumn("_a", F.lit(True))
    b = right.select(column).distinct().withColumn("_b", F.lit(True))
    return a.join(b, column, "full").where("_a is null or _b is null").select(column, F.col("_a").isNotNull().alias("in_left"))


def shared_tokens(left: DataFrame, right: DataFrame, column: str = "token") -> DataFrame:
    """The intersection of two vocabularies."""
    return left.select(column).intersect(right.select(column))


def by_partition(parts: dict[object, DataFrame], name: str) -> DataFrame:
    """U4: tables of partitions as one, with the partition as a column."""
    out = None
    for key, df in parts.items():
        df = df.withColumn(name, F.lit(key))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no partitions")
    return out


def distinct_counts(df: DataFrame, keys: list[str], column: str, error: float | None = None) -> DataFrame:
    """Keys, n_distinct: exact, or with a relative standard deviation of ``error`` from sketches of bounded size."""
    count = F.count_distinct(column) if error is None else F.approx_count_distinct(column, error)
    return df.groupBy(*keys).agg(count.alias("n_distinct"))


def json_field(column: Column, path: str, type_: str = "string") -> Column:
    """A value inside JSON text by path (``$.a.b``), null where there is none."""
    return F.get_json_object(column, path).cast(type_)
