"""Small helpers that the operators of this subpackage share, and the written tables that cut their lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.scratch import purge, shared_folder, temporary, written

__all__ = ["WHITESPACE", "WORD", "broadcast_checked", "free_name", "id_and_text", "partitions_for", "purge", "shared_folder", "spread", "temporary", "word_count", "written"]

#: White space of all contracts here: space and U+0009 to U+000D. ``bytes.split()`` splits on exactly these.
WHITESPACE = " \t\n\x0b\x0c\r"
#: Java pattern of one word under that white space.
WORD = r"[^\x20\x09-\x0D]+"


def broadcast_checked(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A written table with a broadcast hint if its counted rows are few; beyond that, left to a join that adaptive execution may split."""
    return F.broadcast(df) if df.count() <= most_rows else df


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores added until no column has it (column names ignore case)."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, as ``_id`` (long) and ``_text`` (string, never null)."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))


def partitions_for(df: DataFrame, rows: int, rows_each: int) -> int:
    """Partitions for a shuffle of ``rows`` rows, ``rows_each`` in one; never fewer than the session's setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def spread(df: DataFrame, rows_each: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many partitions as its shuffle needs; never fewer than the session's setting."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, rows_each), *[F.col(k) for k in keys])


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
