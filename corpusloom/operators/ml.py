"""Clustering, projection and topic models, on Spark's own estimators where there are any."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, BisectingKMeans, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpusloom.operators.dtm import Dtm
from corpusloom.operators.index import dense_ids
from corpusloom.operators.lda_em import model_of, topic_sums
from corpusloom.sources.scratch import written


def kmeans(df: DataFrame, column: str, k: int, seed: int = 1, bisecting: bool = False, random_start: bool = False) -> DataFrame:
    """Adds ``cluster``; ``column`` is an array of numbers."""
    data = df.withColumn("_v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster") if bisecting else KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster", initMode="random" if random_start else "k-means||")
    return model.fit(data).transform(data).drop("_v")


def cluster_profiles(df: DataFrame, column: str) -> DataFrame:
    """Mean and median of every component of each cluster."""
    flat = df.select("cluster", F.posexplode(column).alias("component", "_x"))
    return flat.groupBy("cluster", "component").agg(F.avg("_x").alias("mean"), F.median("_x").alias("median"))


def pca(df: DataFrame, column: str, components: int) -> DataFrame:
    """Adds ``projection`` of the centred vectors."""
    means = df.select(F.posexplode(column).alias("_i", "_x")).groupBy("_i").agg(F.avg("_x").alias("_m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_means"))
    centred = df.join(F.broadcast(means)).withColumn("_v", array_to_vector(F.zip_with(column, "_means", lambda x, m: x.cast("double") - m)))  # one row
    return PCA(k=components, inputCol="_v", outputCol="_p").fit(centred).transform(centred).withColumn("projection", vector_to_array("_p")).drop("_v", "_p", "_means")


def distances(points: np.ndarray, metric: str) -> np.ndarray:
    """All distances of ``points``; one component at a time where a metric is a sum or maximum over components."""
    n = len(points)
    if metric in ("cosine", "correlation"):
        x = points - points.mean(1, keepdims=True) if metric == "correlation" else points
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return np.maximum(1 - unit @ unit.T, 0)
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    top, low = np.zeros((n, n)), np.zeros((n, n))
    spread = points.var(0, ddof=1) if n > 1 else np.ones(points.shape[1])
    for k in range(points.shape[1]):
        a, b = points[:, k][:, None], points[:, k][None]
        gap = np.abs(a - b)
        if metric == "chebyshev":
            top = np.maximum(top, gap)
        elif metric in ("cityblock", "braycurtis"):
            top += gap
            low += np.abs(a + b)
        elif metric == "canberra":
            top += np.divide(gap, np.abs(a) + np.abs(b), out=np.zeros((n, n)), where=(a != 0) | (b != 0))
        elif metric in ("hamming", "jaccard"):
            either = (a != 0) | (b != 0)
            top += (gap != 0) & either if metric == "jaccard" else gap != 0
            low += either
        elif metric == "seuclidean":
            top += gap**2 / spread[k] if spread[k] > 0 else 0
        else:
            top += gap**2
    if metric in ("braycurtis", "jaccard"):
        return np.divide(top, low, out=np.zeros((n, n)), where=low > 0)
    return top / points.shape[1] if metric == "hamming" else np.sqrt(top) if metric in ("euclidean", "minkowski", "seuclidean") else top


#: Distances between vectors that ``distances`` knows besides cosine and correlation; "minkowski" is of order 2.
METRICS = ("braycurtis", "canberra", "chebyshev", "cityblock", "euclidean", "hamming", "jaccard", "minkowski", "seuclidean", "sqeuclidean")


def linkage(points: np.ndarray, method: str = "ward", metric: str = "euclidean") -> np.ndarray:
    """Rows (cluster a, cluster b, distance, size) of agglomerative clustering by the Lance-Williams recurrence."""
    n, d = len(points), distances(np.asarray(points, float), metric)
    d = d**2 if method in ("ward", "centroid", "median") else d.astype(float)
    np.fill_diagonal(d, np.inf)
    ids, sizes, live, out = list(range(n)), [1] * n, np.ones(n, bool), []
    for step in range(n - 1):
        flat = np.where(live[:, None] & live[None], d, np.inf)
        i, j = sorted(divmod(int(flat.argmin()), n))
        dij, ni, nj, nk = d[i, j], sizes[i], sizes[j], np.array(sizes)
        out.append((*sorted((ids[i], ids[j])), np.sqrt(dij) if method in ("ward", "centroid", "median") else dij, ni + nj))
        new = {
            "single": lambda: np.minimum(d[i], d[j]),
            "complete": lambda: np.maximum(d[i], d[j]),
            "average": lambda: (ni * d[i] + nj * d[j]) / (ni + nj),
            "weighted": lambda: (d[i] + d[j]) / 2,
            "ward": lambda: ((ni + nk) * d[i] + (nj + nk) * d[j] - nk * dij) / (ni + nj + nk),
            "centroid": lambda: (ni * d[i] + nj * d[j]) / (ni + nj) - ni * nj * dij / (ni + nj) ** 2,
            "median": lambda: (d[i] + d[j]) / 2 - dij / 4,
        }[method]()
        d[i], d[:, i] = new, new
        d[i, i], live[j], sizes[i], ids[i] = np.inf, False, ni + nj, n + step
    return np.array(out).reshape(-1, 4)


def cut(merges: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Cluster number of each point after all merges up to ``threshold``."""
    parent = list(range(2 * n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for step, (a, b, distance, _) in enumerate(merges):
        if distance <= threshold:
            parent[root(int(a))] = parent[root(int(b))] = n + step
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def hierarchical_clusters(df: DataFrame, name: str, column: str, n_top: int, by: str, threshold: float, method: str = "average", metric: str = "euclidean") -> DataFrame:
    """Clusters of the ``n_top`` rows with the largest ``by`` (the feature: it bounds what one task clusters)."""
    top = df.orderBy(F.desc(F.abs(by)), name).limit(n_top).select(F.col(name).cast("string").alias("name"), F.transform(column, lambda x: x.cast("double")).alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        points = np.stack(pdf["v"].map(np.asarray))
        return pd.DataFrame({"name": pdf["name"], "cluster": cut(linkage(points, method, metric), len(points), threshold)})

    return top.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "name string, cluster long")


def _numbered(dtm: Dtm, vocab: DataFrame) -> DataFrame:
    """document_id, _p: token numbers and values of a document."""
    return dtm.cells.join(vocab, "token").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.col("token_id").cast("int").alias("i"), F.col("value").cast("double").alias("x")))).alias("_p"))


def vectors_in(dtm: Dtm, vocab: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """document_id, features: sparse count vectors over a vocabulary (token_id from 0, token) for Spark's estimators.

    Spark has no function that makes sparse vectors, but its JSON reader does, so they are made without Python.
    """
    size = vocab.count()
    pairs = _numbered(dtm, vocab) if pairs is None else pairs
    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).cast("int").alias("size"), F.transform("_p", lambda p: p["i"]).alias("indices"), F.transform("_p", lambda p: p["x"]).alias("values"))
    made = F.from_json(F.to_json(F.struct(vector.alias("features"))), StructType([StructField("features", VectorUDT())]))
    return pairs.select("document_id", made["features"].alias("features"))


def document_vectors(dtm: Dtm) -> tuple[DataFrame, DataFrame]:
    """(document_id, features), (token_id, token)."""
    vocab = dense_ids(dtm.cells.select("token").distinct(), ["token"], "token_id")
    return vectors_in(dtm, vocab), vocab


def train_topics(dtm: Dtm, k: int = 100, max_iter: int = 20, optimizer: str = "online", seed: int = 1, alpha: float | None = None):
    """(model, vocabulary, vectors).

    "em" goes through all documents in each iteration, block by block (``lda_em``); its model is the local one that Spark's gives. "online" draws as many as there are in each, with replacement, so that
    a document is left out of all iterations with a probability of about exp(-max_iter).
    """
    vocab = written(dense_ids(dtm.cells.select("token").distinct(), ["token"], "token_id"), "vocabulary")
    pairs = written(_numbered(dtm, vocab), "vectors")  # read in each of the steps that follow
    vectors = vectors_in(dtm, vocab, pairs)
    lda = LDA(k=k, maxIter=max_iter, optimizer=optimizer, seed=seed, featuresCol="features", subsamplingRate=1.0)
    if alpha:
        lda = lda.setDocConcentration([alpha])
    if optimizer == "em":
        prior, eta = alpha or 50 / k + 1, 1.1  # as Spark has them
        if prior <= 1:
            raise ValueError("the em optimizer takes document concentrations above 1")
        docs = pairs.select(F.transform("_p", lambda p: p["i"]).alias("_i"), F.transform("_p", lambda p: p["x"]).alias("_x"))
        topics = topic_sums(docs, vocab.count(), k, max_iter, seed, prior, eta)
        return model_of(docs.sparkSession, topics, seed, prior, eta), vocab, vectors
    return lda.fit(vectors), vocab, vectors


def predict_topics(model, vectors: DataFrame, minimum_probability: float = 0.005) -> DataFrame:
    """document_id, topic_id, weight."""
    rows = model.transform(vectors).select("document_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic_id", "weight"))
    return rows.where(F.col("weight") >= minimum_probability)


def topic_token_weights(model, vocab: DataFrame, n_tokens: int = 200) -> DataFrame:
    """topic_id, token, weight of each topic's heaviest tokens."""
    rows = model.describeTopics(n_tokens).select(F.col("topic").alias("topic_id"), F.explode(F.arrays_zip("termIndices", "termWeights")).alias("_t"))
    rows = rows.select("topic_id", F.col("_t.termIndices").alias("token_id"), F.col("_t.termWeights").alias("weight")).where("weight > 1e-6")
    return rows.join(vocab, "token_id").select("topic_id", "token", "weight")


def coherence(ttw: DataFrame, cells: DataFrame, n_top: int = 10) -> DataFrame:
    """u_mass of each topic: mean over its ordered pairs of top tokens of ln((documents with both + 1) / documents with the heavier)."""
    from corpusloom.operators.topics import top_tokens

    top = top_tokens(ttw, n_top).select("topic_id", "token", "position")
    # a document's top tokens of one topic come as one list, so that only pairs within a topic are made
    used = cells.select("document_id", "token").distinct().join(top, "token")
    df = used.groupBy("topic_id", "token").agg(F.count(F.lit(1)).alias("df"))
    a, b = top.toDF("topic_id", "w1", "p1"), top.toDF("topic_id", "w2", "p2")
    pairs = a.join(b, "topic_id").where("p1 < p2")
    lists = used.groupBy("topic_id", "document_id").agg(F.array_sort(F.collect_list("position")).alias("_p"))
    met = F.flatten(F.transform("_p", lambda p, i: F.transform(F.slice("_p", i + 2, F.size("_p")), lambda q: F.struct(p.alias("p1"), q.alias("p2")))))
    both = lists.select("topic_id", F.explode(met).alias("_m")).groupBy("topic_id", F.col("_m.p1").alias("p1"), F.col("_m.p2").alias("p2")).agg(F.count(F.lit(1)).alias("both"))
    joined = pairs.join(both, ["topic_id", "p1", "p2"], "left").join(df.withColumnRenamed("token", "w1"), ["topic_id", "w1"])
    return joined.groupBy("topic_id").agg(F.avg(F.ln((F.coalesce("both", F.lit(0)) + 1) / F.col("df"))).alias("u_mass"))


def topic_scores(dtm: Dtm, numbers: list[int], n_top: int = 10, **training) -> DataFrame:
    """For each number of topics a model's mean u_mass coherence and its perplexity, exp(-likelihood bound per token)."""
    rows, spark = [], dtm.cells.sparkSession
    for k in numbers:
        model, vocab, vectors = train_topics(dtm, k, **training)
        score = coherence(topic_token_weights(model, vocab, n_top), dtm.cells, n_top).agg(F.avg("u_mass")).first()[0]
        rows.append((k, score, float(np.exp(model.logPerplexity(vectors)))))
    return spark.createDataFrame(rows, "n_topics int, coherence double, perplexity double")


def train_lsi(dtm: Dtm, k: int) -> tuple[DataFrame, DataFrame]:
    """G21 (LSI): the ``k`` largest singular values of the document-term matrix: (topic_id, token, weight, singular_value), (document_id, topic_id, weight).

    Spark's distributed truncated decomposition; the driver holds k vectors over the vocabulary. A document's weight is its
    counts times the topic's token vector. The sign of a topic is such that its heaviest token is positive.
    """
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    spark = dtm.cells.sparkSession
    vectors, vocab = document_vectors(dtm)
    rows = vectors.select("features").rdd.map(lambda r: Vectors.fromML(r.features))
    found = RowMatrix(rows).computeSVD(k)
    v, s = found.V.toArray(), found.s.toArray()
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(len(s))])
    parts = ((int(i), pd.DataFrame({"topic_id": i, "token_id": np.arange(len(v)), "weight": v[:, i], "singular_value": float(s[i])})) for i in range(len(s)))
    weights = None
    for _, frame in parts:
        one = spark.createDataFrame(frame, "topic_id int, token_id long, weight double, singular_value double")
        weights = one if weights is None else weights.unionByName(one)
    weights = weights.join(vocab, "token_id").select("topic_id", "token", "weight", "singular_value")
    documents = dtm.cells.join(weights, "token").groupBy("document_id", "topic_id").agg(F.sum(F.col("value") * F.col("weight")).alias("weight"))
    return weights, documents
