"""Topics by expectation-maximisation over blocks: the steps against loops, and the model that Spark makes of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lda_em, ml
from corpusloom.operators.dtm import Dtm

DOCS = [([0, 1, 3], [2.0, 1.0, 5.0]), ([], []), ([1, 2], [1.0, 4.0]), ([4], [3.0]), ([0, 2, 4], [1.0, 1.0, 2.0])]


def by_loops(k, max_iter, seed, alpha, eta, size=5):
    random = np.random.default_rng([seed, 0])
    cells = [(d, w, x) for d, (words, values) in enumerate(DOCS) for w, x in zip(words, values, strict=True)]
    shares = [random.random(k) for _ in cells]
    for i in range(max_iter + 1):
        if i:
            shares = [(by_word[w] + eta - 1) * (by_doc[d] + alpha - 1) / (sum(by_word) + size * (eta - 1)) for d, w, _ in cells]
        by_doc, by_word = np.zeros((len(DOCS), k)), np.zeros((size, k))
        for (d, w, x), s in zip(cells, shares, strict=True):
            by_doc[d] += x * s / s.sum()
            by_word[w] += x * s / s.sum()
    return by_word


@pytest.mark.parametrize("max_iter", [0, 1, 4])
def test_iterations_are_those_of_loops(spark, monkeypatch, max_iter):
    monkeypatch.setattr(lda_em, "RANGE", 2)
    docs = spark.createDataFrame(DOCS, "_i array<int>, _x array<double>").coalesce(1)
    found = lda_em.topic_sums(docs, 5, 3, max_iter, 7, 2.0, 1.1)
    assert found == pytest.approx(by_loops(3, max_iter, 7, 2.0, 1.1))


def test_small_blocks_keep_all_cells_and_find_the_topics(spark, monkeypatch):
    monkeypatch.setattr(lda_em, "CELLS", 3)
    cells = [(d, f"{'ab'[d % 2]}{w}", 1 + w) for d in range(12) for w in range(4)]
    dtm = Dtm(spark.createDataFrame(cells, "document_id long, token string, value long"), None)
    model, vocab, vectors = ml.train_topics(dtm, k=2, max_iter=60, optimizer="em", seed=3, alpha=1.01)
    assert vectors.count() == 12 and model.topicsMatrix().toArray().sum() == pytest.approx(sum(x for *_, x in cells))
    top = ml.topic_token_weights(model, vocab, 4).groupBy("topic_id").agg(F.collect_set(F.substring("token", 1, 1)).alias("t"), F.sum("weight").alias("s")).collect()
    assert sorted(r.t for r in top) == [["a"], ["b"]] and all(r.s > 0.9 for r in top)
    weights = {(r.document_id, r.topic_id): r.weight for r in ml.predict_topics(model, vectors).collect()}
    assert all(max(weights.get((d, t), 0) for t in (0, 1)) > 0.9 for d in range(12))
    assert {d for d, _ in weights} == set(range(12))


def test_the_model_is_as_sparks_own(spark):
    topics = np.array([[3.0, 1.0], [0.5, 2.0], [4.0, 0.25]])
    model = lda_em.model_of(spark, topics, 5, 26.0, 1.1)
    assert model.topicsMatrix().toArray() == pytest.approx(topics)
    first = model.describeTopics(3).orderBy("topic").first()
    assert list(first.termIndices) == [2, 0, 1] and list(first.termWeights) == pytest.approx([4 / 7.5, 3 / 7.5, 0.5 / 7.5])
    assert model.estimatedDocConcentration().toArray().tolist() == [26.0, 26.0]
