"""Values known from elsewhere or by brute force: statistics, clusters, graphs, models, configured corpora, jobs."""

import itertools
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import keyness
from corpusloom.functions import tokens as tk
from corpusloom.functions.text import transform_text
from corpusloom.operators import dtm, graph, index, ml, stats, tagged, values
from corpusloom.operators import vocabulary as vc
from corpusloom.operators.dtm import Dtm
from corpusloom.plans import catalogue, config
from corpusloom.plans import workflows as wf
from corpusloom.plans.pipeline import Pipeline
from corpusloom.sources import scratch, store
from corpusloom.sources import text as src


def test_tails_of_distributions():
    """Critical values as tables print them."""
    for stat, freedom, p in ((3.841, 1, 0.05), (5.991, 2, 0.05), (18.307, 10, 0.05), (23.209, 10, 0.01), (124.342, 100, 0.05)):
        assert stats.chi_squared_tail(stat, freedom) == pytest.approx(p, rel=2e-3)
    for t, freedom, p in ((12.706, 1, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.984, 100, 0.05)):
        assert stats.student_tail(t * t / (t * t + freedom), freedom) == pytest.approx(p, rel=2e-3)
    assert stats.student_tail(0.0, 5) == 1 and stats.student_tail(1.0, 5) == 0


def test_slopes_with_p(spark):
    rows = [("up", x, 2.0 * x + 1) for x in range(5)] + [("few", 0, 1.0), ("few", 1, 2.0)] + [("flat", x, y) for x, y in enumerate((1.0, 2.0, 2.0, 1.0))]
    rows += [("some", x, y) for x, y in enumerate((1.0, 2.5, 2.0, 4.5, 4.0, 5.5))]
    found = {r.token: r for r in stats.slopes_with_p(spark.createDataFrame(rows, "token string, year int, value double"), ["token"]).collect()}
    assert found["up"].p == pytest.approx(0, abs=1e-9) and found["up"].k == pytest.approx(2) and found["few"].p is None and found["flat"].p == pytest.approx(1)
    x, y = np.arange(6), np.array([1, 2.5, 2, 4.5, 4, 5.5])
    r = np.corrcoef(x, y)[0, 1]
    t, grid = abs(r) * math.sqrt(4 / (1 - r * r)), np.linspace(0, 400, 4_000_001)
    density = math.gamma(2.5) / math.sqrt(4 * math.pi) / math.gamma(2) * (1 + grid**2 / 4) ** -2.5
    within = np.sum((density[1:] + density[:-1]) / 2 * np.diff(grid) * (grid[1:] <= t))
    assert found["some"].p == pytest.approx(1 - 2 * within, abs=1e-4)


def test_missing_counts_are_interpolated(spark):
    rows = [(1990, None), (1991, 2.0), (1993, None), (1994, 8.0), (1997, None)]
    df = spark.createDataFrame([(y, v or 0.0, 0.0 if v is None else 1.0) for y, v in rows], "year int, a double, n_tokens double")
    found = {r.year: r.a for r in stats.token_count_data(df, "year", ["a"], normalize=True, smooth=True).collect()}
    assert found == {1990: None, 1991: 2.0, 1993: 6.0, 1994: 8.0, 1997: 8.0}


def test_curves_go_through_their_points():
    x = np.array([0.0, 1, 3, 4])
    assert stats.pchip(x, np.array([1.0, 3, 7, 9]), np.array([0, 0.5, 2, 4])) == pytest.approx([1, 2, 5, 9])
    y = np.array([0.0, 5, 5, 1])
    at = np.linspace(0, 4, 81)
    found = stats.pchip(x, y, at)
    assert found[[0, 20, 60, 80]] == pytest.approx(y) and found.max() <= 5 + 1e-9 and (np.diff(found[:20]) >= -1e-9).all()


def plain_distance(a, b, metric, points):
    gap = [abs(x - y) for x, y in zip(a, b, strict=True)]
    spread = points.var(0, ddof=1)
    return {
        "euclidean": math.sqrt(sum(g * g for g in gap)), "minkowski": math.sqrt(sum(g * g for g in gap)), "sqeuclidean": sum(g * g for g in gap), "cityblock": sum(gap), "chebyshev": max(gap),
        "braycurtis": sum(gap) / sum(abs(x + y) for x, y in zip(a, b, strict=True)), "canberra": sum(g / (abs(x) + abs(y)) for g, x, y in zip(gap, a, b, strict=True) if x or y),
        "hamming": sum(g > 0 for g in gap) / len(gap), "jaccard": sum(g > 0 for g, x, y in zip(gap, a, b, strict=True) if x or y) / sum(1 for x, y in zip(a, b, strict=True) if x or y),
        "seuclidean": math.sqrt(sum(g * g / s for g, s in zip(gap, spread, strict=True))), "cosine": 1 - np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b),
        "correlation": 1 - np.corrcoef(a, b)[0, 1],
    }[metric]


@pytest.mark.parametrize("metric", [*ml.METRICS, "cosine", "correlation"])
def test_distances_by_definition(metric):
    points = np.random.default_rng(1).integers(0, 4, (7, 5)).astype(float)
    points[:, 0] += np.arange(7)
    found = ml.distances(points, metric)
    for i, j in itertools.combinations(range(7), 2):
        assert found[i, j] == pytest.approx(plain_distance(points[i], points[j], metric, points), abs=1e-9) and found[j, i] == found[i, j]


def test_linkage_as_brute_force():
    """Average and complete linkage by the definition on members."""
    points = np.random.default_rng(2).normal(size=(12, 3))
    d = ml.distances(points, "euclidean")
    for method, of in (("average", np.mean), ("complete", np.max), ("single", np.min)):
        clusters, expected = [[k] for k in range(12)], []
        while len(clusters) > 1:
            a, b = min(itertools.combinations(range(len(clusters)), 2), key=lambda p: of(d[np.ix_(clusters[p[0]], clusters[p[1]])]))  # noqa: B023
            expected.append(of(d[np.ix_(clusters[a], clusters[b])]))
            clusters[a] = clusters[a] + clusters.pop(b)
        assert ml.linkage(points, method)[:, 2] == pytest.approx(expected)


def blobs(spark, n=90):
    rng = np.random.default_rng(3)
    centres = np.array([[0.0, 0, 0], [9, 0, 0], [0, 9, 3]])
    points = [(k, (centres[k % 3] + rng.normal(0, 0.4, 3)).tolist()) for k in range(n)]
    return points, spark.createDataFrame(points, "id long, v array<double>")


def test_kmeans_finds_blobs(spark):
    points, df = blobs(spark)
    for options in ({}, {"bisecting": True}, {"random_start": True, "seed": 5}):
        found = {r.id: r.cluster for r in ml.kmeans(df, "v", 3, **options).collect()}
        groups = {}
        for k, v in points:
            groups.setdefault(found[k], []).append(v)
        inertia = sum(((np.array(g) - np.mean(g, 0)) ** 2).sum() for g in groups.values())
        best = sum(((np.array([v for k, v in points if k % 3 == j]) - np.mean([v for k, v in points if k % 3 == j], 0)) ** 2).sum() for j in range(3))
        assert inertia <= 1.01 * best
    profile = {r.cluster: r for r in ml.cluster_profiles(ml.kmeans(df, "v", 3), "v").where("component = 1").collect()}
    assert sorted(round(r.mean) for r in profile.values()) == [0, 0, 9]


def test_pca_and_lsi_as_numpy(spark):
    points, df = blobs(spark)
    x = np.array([v for _, v in points])
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    found = {r.id: r.projection for r in ml.pca(df, "v", 2).collect()}
    mine = np.array([found[k] for k, _ in points])
    assert np.abs(mine) == pytest.approx(np.abs((x - x.mean(0)) @ vt[:2].T), abs=1e-6)
    rng = np.random.default_rng(4)
    matrix = rng.integers(0, 5, (20, 6)).astype(float)
    cells = spark.createDataFrame([(d, f"t{t}", float(matrix[d, t])) for d in range(20) for t in range(6) if matrix[d, t]], "document_id long, token string, value double")
    tokens, documents = ml.train_lsi(Dtm(cells, None), 3)
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    weights = np.zeros((3, 6))
    for r in tokens.collect():
        weights[r.topic_id, int(r.token[1:])] = r.weight
        assert r.singular_value == pytest.approx(s[r.topic_id])
    assert np.abs(weights) == pytest.approx(np.abs(vt[:3]), abs=1e-6) and (weights.max(1) == np.abs(weights).max(1)).all()
    for r in documents.collect():
        assert abs(r.weight) == pytest.approx(abs(u[r.document_id, r.topic_id] * s[r.topic_id]), abs=1e-6)


def test_topic_scores_and_coherence(spark):
    texts = [["apple", "pear", "fig"], ["apple", "pear"], ["dog", "cat"], ["dog", "cat", "cow"]] * 6
    cells = spark.createDataFrame([(d, t, 1) for d, ts in enumerate(texts) for t in ts], "document_id long, token string, value long")
    found = ml.topic_scores(Dtm(cells, None), [2, 3], n_top=3, max_iter=10).collect()
    assert [r.n_topics for r in found] == [2, 3] and all(r.coherence <= 1 and r.perplexity > 1 for r in found)
    ttw = spark.createDataFrame([(0, "apple", 0.5), (0, "pear", 0.4), (0, "dog", 0.1), (1, "dog", 0.7), (1, "cat", 0.2)], "topic_id int, token string, weight double")
    sets = [set(t) for t in texts]
    count = lambda *w: sum(set(w) <= s for s in sets)
    mass = lambda top: np.mean([math.log((count(a, b) + 1) / count(a)) for a, b in itertools.combinations(top, 2)])
    assert {r.topic_id: r.u_mass for r in ml.coherence(ttw, cells, 3).collect()} == pytest.approx({0: mass(["apple", "pear", "dog"]), 1: mass(["dog", "cat"])})


def rings(spark, groups=6, size=8):
    """Cliques in a ring: each is a community."""
    edges = [(f"{g}-{a}", f"{g}-{b}", 1.0) for g in range(groups) for a, b in itertools.combinations(range(size), 2)]
    edges += [(f"{g}-0", f"{(g + 1) % groups}-1", 1.0) for g in range(groups)]
    return spark.createDataFrame(edges, "source string, target string, weight double")


def test_louvain_in_one_task_and_by_joins(spark):
    edges = rings(spark)
    truth = spark.createDataFrame([(f"{g}-{a}", g) for g in range(6) for a in range(8)], "id string, community long")
    best = graph.modularity(edges, truth)
    assert best == pytest.approx(6 * 28 / 174 - 6 * (58 / 348) ** 2)
    assert graph.modularity(edges, graph.louvain(edges)) == pytest.approx(best)
    found = graph.louvain(edges, most_edges=40)
    assert found.count() == 48 and graph.modularity(edges, found) > 0.85 * best
    with pytest.raises(ValueError, match="edges"):
        graph.louvain(spark.createDataFrame([(f"a{k}", f"b{k}", 0.0) for k in range(5)], "source string, target string, weight double"), most_edges=2)


def test_betweenness_of_pivots_and_its_bound(spark):
    edges = rings(spark, 4, 4)
    whole = {r.id: r.betweenness for r in graph.betweenness(edges).collect()}
    assert {r.id: r.betweenness for r in graph.betweenness(edges, pivots=99).collect()} == whole
    some = {r.id: r.betweenness for r in graph.betweenness(edges, pivots=8).collect()}
    assert sum(some.values()) == pytest.approx(sum(whole.values()), rel=0.5)
    with pytest.raises(ValueError, match="edges"):
        graph.betweenness(edges, most_edges=5)


def test_value_helpers(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 2.0), ("b", -4.0)], "k string, v double")
    assert sorted(r.v for r in values.normalize_values(df, "v", ["k"]).collect()) == [-2.0, 0.0, 0.0, 1.0]
    assert sorted(r.v for r in values.normalize_by_norm(df, "v", 1, ["k"]).collect()) == pytest.approx([-2 / 3, 0, 0, 1 / 3])
    assert sorted(r.v for r in values.scale_to_range(df, "v", 0.0, 10.0).collect()) == [-20.0, 0.0, 0.0, 10.0]
    assert values.complete_range(df.where("false"), "v").count() == 0
    with pytest.raises(ValueError):
        values.by_partition({}, "x")
    both = values.by_partition({"x": df, "y": df.select("k")}, "part")
    assert both.columns == ["k", "v", "part"] and both.where("part = 'y' and v is null").count() == 4
    assert {(r.k, r.in_left) for r in values.only_in_one(df, spark.createDataFrame([("b",), ("c",)], "k string"), "k").collect()} == {("a", True), ("c", False)}
    di = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", None)], "document_name string, lang string")
    assert {r.lang: r.document_names for r in index.group_documents(di, "lang").collect()} == {"x": ["a", "b"], None: ["c"]}
    assert {r.c: r.code for r in index.codify(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string"), "c", "code").collect()} == {"a": 0, "b": 1, None: -1}


def test_topic_files_of_other_programs(spark, tmp_path):
    (tmp_path / "doctopics.txt").write_text("#doc name topic proportion\n0\ta.txt\t1\t0.6\t0\t0.399\t2\t0.001\n1\tb.txt\t2\t1.0\n2\tc.txt\n")
    found = {(r.document_id, r.topic_id): r.weight for r in src.doc_topics(spark, str(tmp_path / "doctopics.txt")).collect()}
    assert found == pytest.approx({(0, 1): 0.6, (0, 0): 0.399, (1, 2): 1.0})
    scaled = src.doc_topics(spark, str(tmp_path / "doctopics.txt"), normalize=True, least=0.1)
    assert {(r.document_id, r.topic_id): r.weight for r in scaled.collect()} == pytest.approx({(0, 1): 0.6 / 0.999, (0, 0): 0.399 / 0.999, (1, 2): 1.0})
    (tmp_path / "words.txt").write_text("0\tapple\t4.01\n0\tdog\t0.01\n1\tdog\t2.01\n")
    assert {(r.topic_id, r.token, r.weight) for r in src.topic_words(spark, str(tmp_path / "words.txt")).collect()} == {(0, "apple", 4.01), (1, "dog", 2.01)}
    (tmp_path / "keys.txt").write_text("0\t0.5\tapple pear\n")
    assert tuple(src.topic_keys(spark, str(tmp_path / "keys.txt")).first()) == (0, 0.5, "apple pear")


def shout(text, mark="!"):
    return F.concat(text, F.lit(mark))


def first_words(p, n):
    return p.project(lambda df: df.withColumn("tokens", F.slice("tokens", 1, n)))


def letters(text):
    return [(w, w.lower(), "NN" if w[0].isupper() else "VB") for w in text.split()]


class Reader:
    def __init__(self, size, more=0):
        self.size, self.more = size, more


CONFIG = {
    "corpus_name": "letters",
    "text_reader_opts": {"filename_pattern": "*.txt", "filename_fields": ["year:_:1"], "types": {"year": "int"}},
    "text_transform_opts": {"preprocessors": "dehyphen,mine,strip", "mine": {"name": "tests.test_further.shout", "arguments": {"mark": " end"}}, "unused": {}},
    "pipelines": {"words": ["tokenize", {"transform_tokens": {"min_len": 2}}, {"tests.test_further.first_words": {"n": 2}}], "matrix": ["tokenize", "to_dtm"]},
    "reader": {"class_name": "tests.test_further.Reader", "options": {"size": 3}},
}


def test_configured_corpus(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(CONFIG))
    for k, t in ((1990, "A gar-\nden is here "), (1991, "x yy zz")):
        (tmp_path / f"doc_{k}.txt").write_text(t)
    c = config.CorpusConfig.load(spark, str(tmp_path / "c.json"))
    assert c.value("text_reader_opts.types.year") == "int" and c.value("a.b", 7) == 7 and c.value("a.b|corpus_name") == "letters"
    assert {(r.year, tuple(r.tokens)) for r in c.pipeline(spark, "words", str(tmp_path)).docs.collect()} == {(1990, ("garden", "is")), (1991, ("yy", "zz"))}
    assert c.pipeline(spark, "matrix", str(tmp_path)).cells.where("token = 'end'").count() == 2
    made = c.resolved("reader", more=2)
    assert (made.size, made.more) == (3, 2)
    for bad in (lambda: c.pipeline(spark, "none"), lambda: c.resolved("none"), lambda: c.resolved("pipelines"), lambda: config.named("no.such.thing")):
        with pytest.raises(ValueError):
            bad()
    registry = config.Registry()
    assert registry.register()(shout) is shout and registry.get("shout") is shout and "x" not in registry
    with pytest.raises(ValueError):
        registry.get("x")


def test_terminal_steps(spark):
    p = Pipeline.read(spark, [("a.txt", "one two"), ("b.txt", "three")]).tokenize()
    assert p.reduce(F.sum(F.size("tokens"))) == 3 and p.project(lambda df: df.where("false")).reduce(lambda: F.max("document_name"), zero="none") == "none"
    assert p.exhaust().project(lambda df: df.where("document_name = 'b'")).single().tokens == ["three"]
    with pytest.raises(ValueError):
        p.single()


def test_jobs_by_name(spark, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    for k, t in enumerate(["Apple eats Pear", "Pear eats Fig", "Dog sees Cat", "Cat sees Cow"] * 3):
        (folder / f"d{k}.txt").write_text(t)
    out = lambda name: str(tmp_path / name)
    wf.main(["pos-tag", str(folder), out("tagged"), "tagger=tests.test_further.letters"])
    wf.main(["vectorize-id", out("tagged"), out("dtm"), "pos_includes=|NN|", "lemmatize=true"])
    assert {r.token for r in store.Store(spark, out("dtm")).load("cells").collect()} == {"apple", "pear", "fig", "dog", "cat", "cow"}
    wf.main(["train-topics-id", out("tagged"), out("tm"), "k=2", "max_iter=3", "pos_excludes=|VB|"])
    assert store.Store(spark, out("tm")).load("topic_token_overview").count() == 2
    wf.main(["predict-topics", str(folder), out("p"), f"model={out('tm')}"])
    wf.main(["merge-topics", out("tm"), out("m"), 'clusters={"a": [0, 1]}'])
    assert store.Store(spark, out("m")).load("topic_token_overview").count() == 1
    assert set(wf.find_models(spark, str(tmp_path))) == {"tm", "p", "m"} and wf.find_models(spark, str(tmp_path))["tm"]["k"] == 2
    with pytest.raises(SystemExit):
        wf.main(["nothing", "a", "b"])


def test_scratch_tables_go(spark):
    with scratch.temporary(spark) as keep:
        one = keep(scratch.written(spark.range(3), "kept"))
        two = scratch.written(spark.range(4), "gone")
    assert one.count() == 3 and store.exists(spark, one.written_to) and not store.exists(spark, two.written_to)
    scratch.purge(spark)
    assert not store.exists(spark, one.written_to)


def test_what_a_matrix_says_of_itself(spark):
    matrix = dtm.from_texts(spark.createDataFrame([(1, "a b a", "x"), (2, "B c", "y"), (3, None, "z")], "document_id long, text string, kind string"))
    assert matrix.shape() == (3, 3) and matrix.has_term("c") and not matrix.has_term("B") and matrix.index.columns == ["document_id", "kind"]
    assert {tuple(r) for r in matrix.transposed().collect()} == {("a", 1, 2), ("b", 1, 1), ("b", 2, 1), ("c", 2, 1)}
    assert matrix.with_index(matrix.index.where("kind = 'y'")).shape() == (1, 2)
    vocab = spark.createDataFrame([(0, "a", 2), (1, "b", 2)], "token_id int, token string, tf long")
    assert vc.lookup(vocab, ["b", "none"]) == {"b": 1}
    more = spark.createDataFrame([(1, 0, "b"), (1, 1, "z"), (1, 2, "c"), (2, 0, "z")], "document_id long, pos int, token string")
    assert {tuple(r) for r in vc.opened(vocab, more).collect()} == {(0, "a", 2), (1, "b", 2), (2, "c", 1), (3, "z", 2)}
    assert [r.token for r in vc.id_range(vc.opened(vocab, more), 1, 2).orderBy("token_id").collect()] == ["b", "c"]
    assert {r.token for r in vc.opened(vocab.where("false"), more).where("token_id < 2").collect()} == {"b", "c"}


def test_single_texts_arrow_files_and_vocabularies(spark, tmp_path):
    import pandas as pd

    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    assert src.read_text(spark, str(tmp_path), "b.txt") == "two" and src.read_text(spark, str(tmp_path), "c.txt") is None
    for k in range(2):
        pd.DataFrame({"token": ["x", f"y{k}"], "n": [1, k]}).to_feather(tmp_path / f"doc_{k}.feather")
    found = src.read_feather(spark, str(tmp_path), "token string, n long")
    assert {tuple(r) for r in found.collect()} == {("doc_0", "x", 1), ("doc_0", "y0", 0), ("doc_1", "x", 1), ("doc_1", "y1", 1)}
    (tmp_path / "vocab.csv").write_text("token\ttoken_id\ttf\na\t0\t7\nb\t1\t\n")
    assert [tuple(r) for r in src.read_vocabulary(spark, str(tmp_path / "vocab.csv")).orderBy("token_id").collect()] == [(0, "a", 7), (1, "b", None)]


def test_texts_out_of_annotated_xml(spark, tmp_path):
    docs = spark.createDataFrame([("d", '<t><s><w pos="NN" lemma="|hus|">Huset</w> <w pos="VB" lemma="|">är</w> <w pos="NN" lemma="|">Stort</w></s></t>')], "document_name string, text string")
    found = wf.extract_texts(spark, docs, str(tmp_path / "out"), tagged.ExtractOpts(lemmatize=True, pos_includes="|NN|"))
    assert [tuple(r) for r in found.collect()] == [("d", "hus stort")]
    assert spark.range(1).select(transform_text(F.lit("Hej,du! a-b 1.5"), "sparv-tokenize")).first()[0] == "Hej , du ! a-b 1.5"
    flags = spark.createDataFrame([("a", True, False), (" ", True, False), ("b", False, False), ("c", True, True)], "token string, is_alpha boolean, is_stop boolean")
    assert [r.token for r in tagged.filter_attributes(flags, is_alpha=True, is_stop=False).collect()] == ["a"]
    assert Pipeline.of_tokens(spark.createDataFrame([(1, ["a", "b", "a"])], "document_id long, tokens array<string>")).to_dtm().cells.count() == 2


def test_own_metrics_and_keys(spark):
    """Callables and columns where names are taken, too."""
    coo = spark.createDataFrame([("a", "b", 4), ("a", "c", 2)], "w1 string, w2 string, value long")
    assert {r.w2: r.weight for r in keyness.significance(coo, lambda c, z, a, b, n, normalize: c / z).collect()} == pytest.approx({"b": 4 / 6, "c": 2 / 6})
    years = spark.createDataFrame([(1991,), (2004,)], "year int")
    assert [r[0] for r in years.select(index.temporal_key(F.col("year"), lambda y: F.when(y < 2000, "old").otherwise("new"))).collect()] == ["old", "new"]
    assert [r[0] for r in years.select(index.filename_fields(F.lit("a.txt"), {"n": F.col("year") + 1})["n"]).collect()] == [1992, 2005]
    matrix = dtm.from_bags(spark.createDataFrame([(1, "a", 1), (2, "a", 1)], "document_id long, token string, value long"))
    assert matrix.filter(F.col("document_id") > 1).cells.count() == 1


def test_stop_words(spark):
    df = spark.createDataFrame([(["the", "house", "and", "of", "garden"],), ([],), (None,)], "tokens array<string>")
    found = [r[0] for r in df.select(tk.remove_stopwords(F.col("tokens"), (*tk.language_stopwords("english"), "house"))).collect()]
    assert found == [["garden"], [], None]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_further_queries_that_have_no_sql(spark):
    folder = "/root/testdata/sf0.001"
    words = set(tk.language_stopwords("english"))
    for r in catalogue.QUERIES["tok_stopwords"](spark, folder).limit(20).collect():
        assert not words & set(r.text.split())
    rows = catalogue.QUERIES["stat_slopes_p"](spark, folder).collect()
    assert rows and all(r.p is None or 0 <= r.p <= 1 for r in rows)
