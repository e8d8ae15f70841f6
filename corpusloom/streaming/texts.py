"""The stateless beginning of a pipeline on a stream of texts, and running term counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import transform_text
from corpusloom.functions.tokens import TokensTransformOpts, tokenize


def text_stream(spark: SparkSession, path: str, schema: str, files_each: int = 100) -> DataFrame:
    """A stream of documents from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def tokens_of_stream(docs: DataFrame, transforms: str = "normalize-whitespace", opts: TokensTransformOpts | None = None) -> DataFrame:
    """Transformed, tokenized and filtered; ids of tokens are hashes, which need no shared dictionary."""
    tokens = tokenize(F.lower(transform_text(F.col("text"), transforms)))
    tokens = opts.apply(tokens) if opts else tokens
    return docs.select([c for c in docs.columns if c != "text"] + [F.posexplode(tokens).alias("pos", "token")]).withColumn("token_id", F.xxhash64("token"))


def windowed_counts(tokens: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Term counts by tumbling event-time window; rows later than ``late`` are not waited for."""
    return tokens.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "token").agg(F.count(F.lit(1)).alias("tf"))
