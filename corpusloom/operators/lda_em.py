"""Latent Dirichlet allocation by expectation-maximisation over blocks of documents.

The algorithm is that of Spark's "em" optimizer (Asuncion et al. 2009): each cell (document, token) has a distribution over topics,
worked out from the sums of its document and of its token, and these sums are taken anew in each iteration, over all cells. Spark
keeps a graph with an edge for each cell in memory, and ships topic vectors along the edges; here a block of documents is one row,
its documents' sums travel with it, and only sums by token of a block are added up. The driver holds one matrix, tokens by topics,
as it does when Spark's own model is asked for its topics.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.clustering import LocalLDAModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.blocks import OWN, ROW, _blocks, _numbers, _row, _whole, unpacked
from corpusloom.sources.scratch import temporary, written

#: Cells of a block, and tokens whose sums make one row.
CELLS, RANGE = 1 << 20, 1 << 13
#: Part of the rows that hold the sums of a block's documents.
STATE = -3
#: What Spark's model has by default.
GAMMA_SHAPE = 100.0
SCHEMA = pa.schema({"block": pa.int64(), "part": pa.int32(), "data": pa.binary()})


def _by(group: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``weights`` by group, groups by topics."""
    return np.stack([np.bincount(group, weights[:, k], n) for k in range(weights.shape[1])], 1)


def topic_sums(docs: DataFrame, size: int, k: int, max_iter: int, seed: int, alpha: float, eta: float) -> np.ndarray:
    """Sums by token (rows) and topic of all cells after ``max_iter`` iterations; docs: _i, _x, token numbers and values of a document."""
    spark = docs.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = lambda b: pc.list_value_length(b.column("_i")).fill_null(0).to_numpy(zero_copy_only=False)
        for i, table in enumerate(_blocks(batches, count, CELLS)):
            lists = _whole(table.column("_i"))
            yield _row(TaskContext.get().partitionId() << 32 | i, OWN, {"_n": pc.list_value_length(lists), "_i": lists.flatten(), "x": _whole(table.column("_x")).flatten()})

    def step(before):
        def run(table: pa.Table) -> pa.Table:
            part = table.column("part").to_pylist()
            got = {p: unpacked(table.column("data")[i].as_buffer()) for i, p in enumerate(part)}
            block, own = table.column("block")[0].as_py(), got[OWN]
            sizes, token, value = _numbers(own["_n"]), _numbers(own["_i"]), own["x"].to_numpy()
            doc = np.repeat(np.arange(len(sizes)), sizes)
            if before is None:
                share = np.random.default_rng([seed % (1 << 63), block]).random((len(token), k))
            else:
                n_wk = before.value
                n_jk = got[STATE]["x"].to_numpy().reshape(-1, k)
                share = (n_wk[token] + (eta - 1)) * (n_jk[doc] + (alpha - 1)) / (n_wk.sum(0) + size * (eta - 1))
            share *= (value / share.sum(1))[:, None]
            rows = [_row(block, STATE, {"x": pa.array(_by(doc, share, len(sizes)).ravel())})]
            used, at = np.unique(token, return_inverse=True)
            sums = _by(at, share, len(used))
            ends = np.searchsorted(used, np.arange(RANGE, size + RANGE, RANGE))
            for p, (s, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if e > s:
                    rows.append(_row(block, p, {"_w": pa.array(used[s:e] - p * RANGE), "x": pa.array(sums[s:e].ravel())}))
            return pa.Table.from_batches(rows, SCHEMA)

        return run

    def add(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        out = np.zeros((min(RANGE, size - part * RANGE), k))
        for data in table.sort_by("block").column("data"):
            got = unpacked(data.as_buffer())
            out[_numbers(got["_w"])] += got["x"].to_numpy().reshape(-1, k)
        return pa.Table.from_batches([pa.record_batch({"part": pa.array([part], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})])

    with temporary(spark):
        blocks = written(docs.mapInArrow(split, ROW), "cells")
        state, n_wk = None, None
        for _ in range(max_iter + 1):
            both = blocks if state is None else blocks.unionByName(state)
            told = None if n_wk is None else spark.sparkContext.broadcast(n_wk)
            made = written(both.groupBy("block").applyInArrow(step(told), ROW), "topics")
            state = made.where(F.col("part") == STATE)
            n_wk = np.zeros((size, k))
            # one row for each RANGE tokens, a matrix of tokens by topics altogether
            for row in made.where("part >= 0").groupBy("part").applyInArrow(add, "part int, data binary").toLocalIterator():
                found = np.frombuffer(row.data).reshape(-1, k)
                n_wk[row.part * RANGE : row.part * RANGE + len(found)] = found
            if told is not None:
                told.destroy()
    return n_wk


def model_of(spark, topics: np.ndarray, seed: int, alpha: float, eta: float, column: str = "features") -> LocalLDAModel:
    """Spark's model of such sums, as its own "em" model makes one to describe topics and to predict."""
    jvm, (size, k) = spark._jvm, topics.shape
    linalg = jvm.org.apache.spark.mllib.linalg
    values = spark.sparkContext._gateway.new_array(jvm.double, size * k)
    at, piece = 0, 1 << 20
    flat = np.asfortranarray(topics).ravel("F").astype(">f8")
    while at < len(flat):
        some = flat[at : at + piece]
        jvm.java.nio.ByteBuffer.wrap(bytearray(some.tobytes())).asDoubleBuffer().get(values, at, len(some))
        at += len(some)
    prior = spark.sparkContext._gateway.new_array(jvm.double, k)
    for i in range(k):
        prior[i] = float(alpha)
    old = jvm.org.apache.spark.mllib.clustering.LocalLDAModel(linalg.DenseMatrix(size, k, values), linalg.DenseVector(prior), float(eta), GAMMA_SHAPE)
    made = jvm.org.apache.spark.ml.clustering.LocalLDAModel(f"lda_em_{uuid.uuid4().hex[:12]}", size, old, spark._jsparkSession)
    model = LocalLDAModel(made)
    model.setFeaturesCol(column)
    model.setSeed(seed)
    return model
