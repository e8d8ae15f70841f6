"""Written intermediate tables: evaluated once, durable, without lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_TABLES: list[str] = []
#: The tables of each open ``temporary`` of this thread.
_OPEN = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where all of Spark runs in this process may it be unset: a temporary one is set then."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = "file://" + local
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back; a lost executor then costs a re-read only."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    for made in getattr(_OPEN, "stack", []):
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables that this thread wrote within, but for those handed to the function that it gives, which hands them back."""
    made: list[str] = []
    kept: set[str] = set()
    _OPEN.stack = [*getattr(_OPEN, "stack", []), made]

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.written_to)
        return df

    try:
        yield keep
    finally:
        _OPEN.stack = _OPEN.stack[:-1]
    for path in made:
        if path not in kept and path in _TABLES:
            _TABLES.remove(path)
            _delete(spark, path)


def purge(spark: SparkSession) -> None:
    """Delete all tables that ``written`` made in this process; call it once the results that read them are stored."""
    while _TABLES:
        _delete(spark, _TABLES.pop())
