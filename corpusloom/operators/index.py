"""Document index operators: attributes, joins, unions, grouping, gaps. An index has one row per document."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.scratch import written

#: Years per period of the named temporal keys.
PERIODS = {"year": 1, "lustrum": 5, "decade": 10}


def temporal_key(year: Column, spec: str | int | dict | None = "year") -> Column:
    """A period's first year; with a dict {period: years}, the period's name or null; with a callable, its result."""
    if callable(spec):
        return spec(year)
    if isinstance(spec, dict):
        pairs = [F.lit(x) for name, years in spec.items() for y in (years if isinstance(years, Iterable) and not isinstance(years, str) else [years]) for x in (y, name)]
        return F.try_element_at(F.create_map(*pairs), year) if pairs else F.lit(None).cast("string")
    k = PERIODS[spec] if isinstance(spec, str) else spec
    return year - F.pmod(year, F.lit(k))


def dense_ids(df: DataFrame, by: list[str], name: str = "document_id") -> DataFrame:
    """Adds strictly increasing ids 0, 1, 2, ... in the order of ``by``.

    Rows are range-partitioned and counted per partition, so no task sees them all: an id is the rank in its partition plus
    the counts of the partitions before, a table with one row per partition. The ranges come from a sample, so the partitioned
    rows are written: read twice, they must be the same.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*by)))
    before = ranged.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).select("_part", "_before")
    return local.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_part", "_rank", "_before")


def is_strictly_increasing(id_col: str = "document_id") -> Column:
    """An aggregate expression: ids are 0 .. n-1, each once."""
    return (F.count(F.lit(1)) == F.count_distinct(id_col)) & (F.coalesce(F.min(id_col), F.lit(0)) == 0) & (F.coalesce(F.max(id_col), F.lit(-1)) == F.count(F.lit(1)) - 1)


def filename_fields(filename: Column, fields: Iterable[str] | dict[str, str | Column]) -> dict[str, Column]:
    """Metadata columns from a file name.

    ``name:separator:position`` takes a piece between separators (a period separates, too); ``name:regexp`` takes the first group
    of a pattern anchored at the start; a Column is taken as it is. Whole numbers stay text; cast them where declared.
    """
    specs = fields.items() if isinstance(fields, dict) else [s.split(":", 1) for s in fields]
    out = {}
    for name, spec in specs:
        if isinstance(spec, Column):
            out[name] = spec
        elif len(parts := spec.rsplit(":", 1)) == 2 and parts[1].lstrip("-").isdigit() and len(parts[0]) >= 1:
            pieces = F.split(F.replace(filename, F.lit("."), F.lit(parts[0])), "\\Q" + parts[0] + "\\E")
            at = int(parts[1])
            out[name] = F.try_element_at(pieces, F.lit(at + 1 if at >= 0 else at))
        else:
            out[name] = F.regexp_extract(filename, f"^(?:{spec})", 1)
    return out


def strip_path_and_extension(filename: Column) -> Column:
    """X69."""
    return F.regexp_replace(F.regexp_replace(filename, r"^.*[/\\]", ""), r"\.[^.]*$", "")


def add_attributes(index: DataFrame, other: DataFrame, on: str = "document_id") -> DataFrame:
    """Inner join."""
    return index.join(other, on, "inner")


def consolidate(index: DataFrame, other: DataFrame, on: str = "document_name") -> DataFrame:
    """Left join of the columns that ``index`` lacks."""
    new = [c for c in other.columns if c not in index.columns]
    return index.join(other.select(on, *new), on, "left")


def overload(df: DataFrame, index: DataFrame, columns: list[str] | None = None, ignores: tuple[str, ...] = (), on: str = "document_id") -> DataFrame:
    """Inner join of the named columns that ``df`` lacks."""
    wanted = [c for c in (columns or index.columns) if c not in df.columns and c not in ignores and c in index.columns]
    return df.join(index.select(on, *wanted), on, "inner") if wanted else df


def update_values(index: DataFrame, new: DataFrame, defaults: dict | None = None, on: str = "document_name") -> DataFrame:
    """Values of ``new`` that are not null win; new columns get defaults."""
    columns = [c for c in new.columns if c != on]
    joined = index.join(new.select(on, *[F.col(c).alias(f"_new_{c}") for c in columns]), on, "left")
    for c in columns:
        choices = [F.col(f"_new_{c}"), *([F.col(c)] if c in index.columns else []), *([F.lit(defaults[c])] if defaults and c in defaults else [])]
        joined = joined.withColumn(c, F.coalesce(*choices)).drop(f"_new_{c}")
    return joined


def extend(index: DataFrame, other: DataFrame, on: str = "document_name") -> DataFrame:
    """Appends documents of names not yet there."""
    return index.unionByName(other.join(index.select(on), on, "left_anti"), allowMissingColumns=True)


def codify(df: DataFrame, column: str, id_column: str) -> DataFrame:
    """Adds dense codes of a category in sorted order from 0; null becomes -1."""
    codes = dense_ids(df.where(F.col(column).isNotNull()).select(column).distinct(), [column], id_column)
    return df.join(codes, column, "left").withColumn(id_column, F.coalesce(F.col(id_column), F.lit(-1)).cast("int"))


def group_documents(index: DataFrame, by: str, name: str = "document_name") -> DataFrame:
    """The names of each group's documents, in order."""
    return index.groupBy(by).agg(F.array_sort(F.collect_list(name)).alias("document_names"))


def count_by(index: DataFrame, by: str) -> DataFrame:
    """Documents of each group; no order is needed beforehand."""
    return index.groupBy(by).agg(F.count(F.lit(1)).alias("n_documents"))


def group_index(index: DataFrame, by: list[str], sums: list[str] = (), members: bool = False) -> DataFrame:
    """Documents per group: n_documents, sums of count columns, year range and size, on demand the members' ids."""
    years = [F.min("year").alias("year_min"), F.max("year").alias("year_max"), (F.max("year") - F.min("year") + 1).alias("year_size")] if "year" in index.columns and "year" not in by else []
    listed = [F.array_sort(F.collect_list("document_id")).alias("document_ids")] if members else []
    return index.groupBy(*by).agg(F.count_distinct("document_id").alias("n_documents"), *[F.sum(c).alias(c) for c in sums], *years, *listed)


def fill_gaps(grouped: DataFrame, key: str, step: int = 1, pivots: list[str] = (), zeros: list[str] = ()) -> DataFrame:
    """A row for each period that no group has, with 0 in the pivot and count columns; one row a missing period."""
    span = grouped.agg(F.min(key).alias("_a"), F.max(key).alias("_b")).where("_a is not null").select(F.explode(F.sequence("_a", "_b", F.lit(step).cast(grouped.schema[key].dataType))).alias(key))
    missing = span.join(grouped.select(key).distinct(), key, "left_anti")
    return grouped.unionByName(missing.select(key, *[F.lit(0).cast(grouped.schema[c].dataType).alias(c) for c in [*pivots, *zeros]]), allowMissingColumns=True)
