"""The relations that the queries run on, each as a DataFrame and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.tokens import tokenize
from corpusloom.operators.dtm import Dtm

Q = {}
SQL = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame and its SQL."""

    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(df: DataFrame, bytes_each: int = 16 << 20) -> DataFrame:
    """A small table dealt to all cores: it may be one file with one row group, which one task would read and work on alone.

    From ``bytes_each`` for each core on, files have splits enough, and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * bytes_each else df


def dealt_by(df: DataFrame, *columns: str, bytes_each: int = 4 << 20) -> DataFrame:
    """Rows of equal values in one partition, as many partitions as the input is large: what is then grouped or joined by these needs no shuffle, and no task more memory for a larger input."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, min(1 << 14, size // bytes_each)), *columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, text, lang, source, year."""
    return spread_out(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(F.col("doc_id").alias("document_id"), "text", "lang", "source", (F.lit(1950) + F.col("doc_id") % 70).alias("year"))


def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, lang, source, year, tokens."""
    return documents(spark, sf_dir).withColumn("tokens", tokenize(F.lower("text"))).drop("text")


def tokens(spark: SparkSession, sf_dir: str, by_document: bool = False) -> DataFrame:
    """document_id, lang, source, year, pos, token; ``by_document``: texts are dealt by their ids, so that sums by document and token need no shuffle of their own."""
    if by_document:
        texts = dealt_by(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", "lang", "source"), "document_id")
        arrays = texts.select("document_id", "lang", "source", (F.lit(1950) + F.col("document_id") % 70).alias("year"), tokenize(F.lower("text")).alias("tokens"))
    else:
        arrays = token_arrays(spark, sf_dir)
    return arrays.select("document_id", "lang", "source", "year", F.posexplode("tokens").alias("pos", "token"))


TOK = r"""tok AS (
  SELECT document_id, lang, source, year, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (
    SELECT doc_id AS document_id, lang, source, 1950 + doc_id % 70 AS year, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents)
)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as documents: document_id, role, tokens; a turn may occur twice, as two documents with one id."""
    rows = spread_out(table(spark, sf_dir, "conversations"))
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("document_id"), "role", tokenize(F.lower("text")).alias("tokens"))


TURNS = r"""turns AS (
  SELECT row_number() OVER () AS rid, conv_id * 1000 + turn AS document_id, role, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM conversations
), ttok AS (
  SELECT rid, document_id, role, len(t) AS n, unnest(t) AS token, unnest(range(len(t))) AS pos FROM turns
)"""


def tag_of(token: Column) -> Column:
    """A made-up part of speech, by form and length."""
    n = F.length(token)
    tag = F.when(token.rlike(r"^\p{N}+$"), "RG")
    for limit, name in ((1, "MID"), (2, "PP"), (3, "DT"), (5, "NN"), (7, "VB"), (9, "JJ")):
        tag = tag.when(n <= limit, name)
    return tag.otherwise("AB")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens with lemma and pos_tag."""
    return tokens(spark, sf_dir).withColumns({"lemma": F.substring("token", 1, 6), "pos_tag": tag_of(F.col("token"))})


TAGGED = TOK + r""", tagged AS (
  SELECT *, substr(token, 1, 6) AS lemma, CASE WHEN regexp_matches(token, '^\p{N}+$') THEN 'RG' WHEN length(token) <= 1 THEN 'MID' WHEN length(token) <= 2 THEN 'PP'
    WHEN length(token) <= 3 THEN 'DT' WHEN length(token) <= 5 THEN 'NN' WHEN length(token) <= 7 THEN 'VB' WHEN length(token) <= 9 THEN 'JJ' ELSE 'AB' END AS pos_tag FROM tok
)"""


def orders_dtm(spark: SparkSession, sf_dir: str) -> Dtm:
    """Orders as documents, parts as tokens, quantities as values."""
    lines = dealt_by(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey", bytes_each=1 << 20)
    cells = lines.groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("token")).agg(F.sum("l_quantity").alias("value"))
    index = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return Dtm(cells, index)


DTM = """cells AS (
  SELECT l_orderkey AS document_id, l_partkey AS token, sum(l_quantity) AS value FROM lineitem GROUP BY ALL
), idx AS (
  SELECT o_orderkey AS document_id, year(o_orderdate)::INT AS year, o_orderstatus AS status, o_orderpriority AS priority FROM orders
)"""


def topic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, topic_id, weight, year: shares of twenty classes of parts in an order's quantity."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_partkey") % 20).cast("int").alias("topic_id"), "l_quantity")
    totals = lines.groupBy("document_id").agg(F.sum("l_quantity").alias("_all"))
    weights = lines.groupBy("document_id", "topic_id").agg(F.sum("l_quantity").alias("_w")).join(totals, "document_id")
    return weights.join(topic_index(spark, sf_dir).select("document_id", "year"), "document_id").select("document_id", "topic_id", (F.col("_w") / F.col("_all")).alias("weight"), "year")


def topic_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    dtm = orders_dtm(spark, sf_dir)
    counts = dtm.cells.groupBy("document_id").agg(F.sum("value").alias("n_tokens"))
    return dtm.index.join(counts, "document_id", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0.0)))


def topic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic_id, token, weight."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy((F.col("l_partkey") % 20).cast("int").alias("topic_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("token")).agg(F.sum("l_quantity").alias("weight"))


DTW = DTM + """, tidx AS (
  SELECT idx.*, coalesce(n, 0.0) AS n_tokens FROM idx LEFT JOIN (SELECT document_id, sum(value) AS n FROM cells GROUP BY 1) USING (document_id)
), dtw AS (
  SELECT document_id, topic_id, w / sum(w) OVER (PARTITION BY document_id) AS weight, year FROM (
    SELECT l_orderkey AS document_id, (l_partkey % 20)::INT AS topic_id, sum(l_quantity) AS w FROM lineitem GROUP BY ALL) JOIN idx USING (document_id)
), ttw AS (
  SELECT (l_partkey % 20)::INT AS topic_id, 'p' || l_partkey AS token, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL
)"""
