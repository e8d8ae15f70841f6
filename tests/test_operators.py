"""Small golden examples."""

import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import keyness as ky
from corpusloom.functions import predicates as pr
from corpusloom.functions import text as tx
from corpusloom.functions.tokens import TokensTransformOpts, word_tokenize
from corpusloom.operators import cooccurrence as co
from corpusloom.operators import graph, index, ml, stats, topics
from corpusloom.operators import tagged as tg
from corpusloom.operators.dtm import Dtm, vectorize
from corpusloom.operators.windows import context_windows
from corpusloom.plans import workflows as wf
from corpusloom.plans.pipeline import ContextOpts, Pipeline, Recipe
from corpusloom.sources import store
from corpusloom.sources import text as src
from corpusloom.streaming import texts as st


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_transforms(spark):
    t = lambda s, keys: one(spark, tx.transform_text(F.lit(s), keys))
    assert t("räk-\n  na ihop", "dehyphen") == "räkna\nihop"
    assert t("a-\nb, c", "dehyphen") == "ab\n, c"
    assert t("‘x’ – “y”", "normalize-characters") == "'x' - \"y\""
    assert t("‘x’ – “y”", "normalize-characters?hyphens") == "‘x’ - “y”"
    assert t("  a  \n b ", "dedent") == "a\nb"
    assert t("Ångström été", "strip-accents") == "Angstrom ete"
    assert t("5 € och $", "replace-currency-symbols") == "5 __cur__ och __cur__"
    assert t("Slut.Början", "space-after-sentence") == "Slut. Början"
    assert t(" A  b​\n\n c ", "normalize_whitespace,lowercase") == "a b\n c"
    assert tx.parsed_arguments("a=1&b=x") == ([], {"a": 1, "b": "x"}) and tx.parsed_arguments("[1,b]") == ([1, "b"], {})
    with pytest.raises(KeyError):
        tx.TEXT.get("nonsense")
    known = {"sjö-man": 1, "sjöman": 5, "nord-syd": 3}
    assert one(spark, tx.swedish_dehyphen(F.lit("sjö-\nman nord-\nsyd"), known)) == "sjöman\n nord-syd\n"


def test_word_tokenizer(spark):
    assert one(spark, word_tokenize(F.lit("T.ex. kl. 10.30 sa hon: \"Ja, visst!\" ..."), ("t.ex.", "T.ex.", "kl."))) == ["T.ex.", "kl.", "10.30", "sa", "hon", ":", '"', "Ja", ",", "visst", "!", '"', "..."]


def test_predicates(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(10)], "x int, y string")
    ids = lambda **v: sorted(r.x for r in pr.ValueMask(v).apply(df).collect())
    assert ids(x=(2, 4)) == [2, 3, 4] and ids(x=(False, 3), y="b") == [1, 5, 7, 9] and ids(x=[1, 2], z=3, y=None) == [1, 2]
    assert ids(x=("gt", 7)) == [8, 9] and ids(x=(False, "gt", 1)) == [0, 1] and ids(x={0, 5}) == [0, 5]
    words = spark.createDataFrame([(w,) for w in ("house", "houses", "mouse", "a.b", "axb", "[x")], "w string")
    find = lambda *p: {r.w for r in words.where(pr.word_predicate(F.col("w"), p)).collect()}
    assert find("house*") == {"house", "houses"} and find("*ouse") == {"house", "mouse"} and find("|mou.*|", "a.b") == {"mouse", "a.b"} and find("[mh]ouse*") == {"house", "houses", "mouse"} and find() == set()


CORPUS = ["a a b c c", "a a b", "a b", "a b b", "a b c c c"]


@pytest.fixture
def dtm(spark):
    docs = spark.createDataFrame([(k, t.split(), y) for k, (t, y) in enumerate(zip(CORPUS, [2009, 2013, 2014, 2017, 2017], strict=True))], "document_id long, tokens array<string>, year int")
    return Dtm(vectorize(docs.select("document_id", F.explode("tokens").alias("token"))), docs.drop("tokens"))


def cells(df, *keys):
    return {tuple(r[k] for k in keys): r.value for r in df.collect()}


def test_dtm_grouping(dtm):
    assert cells(dtm.group_by_time("year"), "period", "token")[(2017, "b")] == 3
    lustrum = cells(dtm.group_by_time("lustrum"), "period", "token")
    assert lustrum[(2005, "a")] == 2 and lustrum[(2010, "a")] == 3 and lustrum[(2015, "c")] == 3
    assert cells(dtm.group_by_time("year", "mean"), "period", "token")[(2017, "c")] == 1.5
    assert cells(dtm.group_by_time({"x": [2009], "y": [2013, 2014]}), "period", "token")[("y", "b")] == 2
    gaps = dtm.with_token_counts().group_index({"period": F.col("year")}, step=1)
    rows = {r.period: (r.n_documents, r.n_tokens) for r in gaps.collect()}
    assert rows[2010] == (0, 0) and rows[2017] == (2, 8) and len(rows) == 9


def test_dtm_weights_and_slices(dtm):
    assert {r.token: r.tf for r in dtm.term_frequency().collect()} == {"a": 7, "b": 6, "c": 5}
    assert {r.token for r in dtm.slice_by_tf(6).term_frequency().collect()} == {"a", "b"}
    assert [r.token for r in dtm.top_words(2).collect()] == ["a", "b"]
    l2 = cells(dtm.normalize(1, "l2").cells, "document_id", "token")
    assert l2[(0, "a")] == pytest.approx(2 / 3) and l2[(0, "b")] == pytest.approx(1 / 3)
    idf = 1 + math.log(6 / 3)
    raw = cells(dtm.tf_idf(norm=None).cells, "document_id", "token")
    assert raw[(0, "c")] == pytest.approx(2 * idf) and raw[(0, "a")] == pytest.approx(2)
    assert [r.text for r in dtm.bags().orderBy("document_id").collect()] == CORPUS
    assert {(r.w1, r.w2): r.value for r in dtm.term_pairs().collect()}[("a", "c")] == 7


def test_windows_and_pairs(spark):
    docs = spark.createDataFrame([(0, list("abcab")), (1, ["a", "*", "b"]), (2, [])], "document_id long, tokens array<string>")
    windows = docs.select("document_id", context_windows(F.col("tokens"), 1).alias("w")).orderBy("document_id").collect()
    assert windows[0].w == [["a", "b"], ["a", "b", "c"], ["b", "c", "a"], ["c", "a", "b"], ["a", "b"]]
    assert windows[1].w == [["a"], ["a", "b"], ["b"]] and windows[2].w == []
    found = {(r.document_id, r.w1, r.w2): r.value for r in co.window_pairs(docs, 1).collect()}
    expected = {}
    for d, ws in enumerate(w.w for w in windows):
        for w in ws:
            for x in set(w):
                for y in set(w):
                    if x < y:
                        expected[(d, x, y)] = expected.get((d, x, y), 0) + w.count(x) * w.count(y)
    assert found == expected
    counts = {(r.document_id, r.token): r.n_windows for r in co.window_counts(docs, 1).collect()}
    assert counts == {(0, "a"): 5, (0, "b"): 5, (0, "c"): 3, (1, "a"): 2, (1, "b"): 2}


def test_hal_litmus(spark):
    """The published example sentence with a window of five."""
    docs = spark.createDataFrame([(0, "The Horse Raced Past The Barn Fell .".lower().split())], "document_id long, tokens array<string>")
    w = {(r.w1, r.w2): r.weight for r in co.hal_weights(docs, 5).collect()}
    assert (w[("the", "barn")], w[("the", "horse")], w[("horse", "raced")], w[("raced", "barn")], w[("past", "the")], w[("the", "fell")]) == (5 + 1, 5, 5, 3, 5, 4)


def test_keyness(spark):
    coo = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("b", "c", 2)], "w1 string, w2 string, value long")
    weight = lambda m: {(r.w1, r.w2): r.weight for r in ky.significance(coo, m).collect()}
    assert weight("PPMI") == {("a", "b"): pytest.approx(math.log(3 * 6 / (4 * 2)))}
    assert weight("DICE")[("a", "c")] == pytest.approx(0.5) and weight("HAL_cwr")[("a", "b")] == pytest.approx(1.0)


def test_tagged(spark):
    rows = [(0, k, t, lm, p) for k, (t, lm, p) in enumerate([("The", "the", "DT"), ("Dogs", "dog", "NN"), ("bark", "bark", "VB"), ("at", "at", "PP"), ("New", "new", "PM"), ("York", "york", "PM"), (".", ".", "MAD")])]
    df = spark.createDataFrame(rows, "document_id long, pos int, token string, lemma string, pos_tag string")
    tokens = lambda opts, tr=None: [r.token for r in tg.padded(tg.filter_tagged(df, opts, tr), opts).orderBy("pos").collect()]
    assert tokens(tg.ExtractOpts(lemmatize=True, pos_includes="|NN|VB|", passthroughs=("At",))) == ["dog", "bark", "at"]
    assert tokens(tg.ExtractOpts(target="token", pos_includes="|NN|", pos_paddings="|VB|PP|", passthroughs=("at",))) == ["Dogs", "*", "at"]
    assert tokens(tg.ExtractOpts(lemmatize=True, pos_includes="|NN|PM|", phrases=(("new", "york"),), append_pos=True)) == ["dog@NN", "new_york@PM"]
    assert tokens(tg.ExtractOpts(target="token", blocks=("at",)), TokensTransformOpts(min_len=2, only_alphabetic=True)) == ["The", "Dogs", "bark", "New", "York"]
    counts = tg.group_counts(df).first()
    assert (counts.Noun, counts.Delimiter, counts.n_tokens) == (3, 1, 6)
    assert tg.tags_of("SUC", "Conjunction") == ["KN", "SN"] and "MAD" not in tg.tags_except("SUC", "Noun") and tg.SCHEMES["PennTree"]["WRB"] == "Adverb"


def test_topics(spark):
    dtw = spark.createDataFrame([(0, 0, 0.9, 2000), (0, 1, 0.1, 2000), (1, 1, 1.0, 2000), (2, 0, 0.5, 2002), (2, 1, 0.5, 2002)], "document_id long, topic_id int, weight double, year int")
    di = spark.createDataFrame([(0, 10, 2000), (1, 30, 2000), (2, 20, 2002)], "document_id long, n_tokens int, year int")
    p = {r.topic_id: r.proportion for r in topics.topic_proportions(dtw, di).collect()}
    assert p == {0: pytest.approx(19 / 60), 1: pytest.approx(41 / 60)}
    y = {(r.year, r.topic_id): r for r in topics.yearly_weights(dtw, di, threshold=0.2, n_top=1).collect()}
    assert y[(2000, 1)].average_weight == 1.0 and y[(2000, 1)].true_average_weight == pytest.approx(0.55) and y[(2001, 0)].sum_weight == 0 and y[(2002, 0)].top_n_weight == 1.0
    merged = topics.compress_topics(topics.merge_topics(dtw, {"x": [0, 1]}))
    assert {(r.document_id, r.topic_id): r.weight for r in merged.collect()} == {(0, 0): 1.0, (1, 0): 1.0, (2, 0): 1.0}
    assert topics.TopicWeights(dtw, di).topic_topic_network().first().n_docs == 2


def test_statistics(spark):
    rng = np.random.default_rng(0)
    m = rng.integers(0, 4, (6, 8))
    rows = [(str(t), d, float(m[t, d])) for t in range(6) for d in range(8) if m[t, d]]
    found = {r.token: r for r in stats.goodness_of_fit(spark.createDataFrame(rows, "token string, x int, value double"), 8).collect()}
    for t in range(6):
        v, r = m[t].astype(float), found[str(t)]
        assert r.slope == pytest.approx(np.polyfit(np.arange(8), v, 1)[0], abs=1e-9)
        assert r.chi2_stats == pytest.approx(((v - v.mean()) ** 2 / v.mean()).sum())
        assert r.skew == pytest.approx(((v - v.mean()) ** 3).mean() / v.std() ** 3)
        assert (r.min, r.max, r.mean) == (v.min(), v.max(), pytest.approx(v.mean()))
        assert r.earth_mover_distance == pytest.approx(np.abs(v - v.mean()).mean())
    assert stats.chi_squared_tail(3.841458820694124, 1) == pytest.approx(0.05) and stats.chi_squared_tail(18.307038, 10) == pytest.approx(0.05, rel=1e-5)
    x = np.arange(6.0)
    assert stats.pchip(x, x**2, np.array([0.0, 2.0, 5.0])) == pytest.approx([0, 4, 25])
    assert (np.diff(stats.pchip(x, np.array([0, 0, 1, 5, 5, 6.0]), np.arange(0, 5, 0.1))) >= -1e-12).all()
    y = 3 * np.exp(-((x - 2) ** 2) / (2 * 1.5**2))
    assert stats.least_squares(stats.CURVES["gaussian"], x, y, np.array([1.0, 1.0, 1.0]))[0] == pytest.approx(3, rel=1e-3)


def test_graphs(spark):
    star = spark.createDataFrame([("h", x, 1.0) for x in "abcd"] + [("a", "b", 5.0)], "source string, target string, weight double")
    found = {r.id: r.betweenness for r in graph.betweenness(star).collect()}
    assert found["h"] == pytest.approx(5 / 6) and found["c"] == 0
    cliques = [(x + str(i), x + str(j), 1.0) for x in "pq" for i in range(4) for j in range(i)] + [("p0", "q0", 0.1)]
    groups = {}
    for r in graph.louvain(spark.createDataFrame(cliques, "source string, target string, weight double")).collect():
        groups.setdefault(r.community, set()).add(r.id[0])
    assert sorted(map(sorted, groups.values())) == [["p"], ["q"]]
    assert graph.sub_network(star, 0.5).count() == 1


def test_linkage():
    points = np.array([[0.0], [1.0], [5.0], [6.5]])
    for method in ("single", "complete", "average", "weighted", "ward", "centroid", "median"):
        merges = ml.linkage(points, method)
        assert merges[0, :3].tolist() == [0, 1, 1.0] and merges[1, :2].tolist() == [2, 3]
        assert len(set(ml.cut(merges, 4, 2.0))) == 2
    assert ml.linkage(points, "single")[2, 2] == pytest.approx(4.0) and ml.linkage(points, "complete")[2, 2] == pytest.approx(6.5)


def test_index(spark):
    names = spark.createDataFrame([(f"prot_{y}__{k:02}.txt", y) for y in (1990, 1991) for k in range(5)], "filename string, y int")
    f = index.filename_fields(F.col("filename"), ["year:_:1", r"number:.*__(\d+)\.txt", "kind:_:0"])
    row = names.select(f["year"].alias("y"), f["number"].alias("n"), f["kind"].alias("k")).orderBy("y", "n").first()
    assert tuple(row) == ("1990", "00", "prot")
    di = src.document_index(names, year="y")
    assert [r.document_id for r in di.orderBy("filename").collect()] == list(range(10)) and di.agg(index.is_strictly_increasing().alias("x")).first().x


def test_sources_and_stores(spark, tmp_path):
    for k, t in enumerate(["one two", "två tre"]):
        (tmp_path / f"doc_{k}_x.txt").write_text(t, encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "docs.zip", "w") as z:
        for k, t in enumerate(["one two", "två tre"]):
            z.writestr(f"doc_{k}_x.txt", t)
    expected = {("doc_0_x", "one two", 0), ("doc_1_x", "två tre", 1)}
    for source in (str(tmp_path), str(tmp_path / "docs.zip"), [("doc_0_x.txt", "one two"), ("doc_1_x.txt", "två tre")]):
        docs = src.read_documents(spark, source, fields=["n:_:1"], types={"n": "int"})
        assert {(r.document_name, r.text, r.n) for r in docs.collect()} == expected
    chunked = src.read_tokens(spark, [("d.txt", "a b c d e")], chunk_size=2)
    assert {(r.document_name, tuple(r.tokens)) for r in chunked.collect()} == {("d_001", ("a", "b")), ("d_002", ("c", "d")), ("d_003", ("e",))}
    (tmp_path / "tagged").mkdir()
    (tmp_path / "tagged" / "t.csv").write_text("token\tpos\tbaseform\n#\nHus\tNN\t|hus|\nB:a\tPM\t|\n", encoding="utf-8")
    rows = src.tagged_csv(spark, str(tmp_path / "tagged"), sparv=True).orderBy("pos").collect()
    assert [(r.token, r.lemma, r.pos_tag) for r in rows] == [("Hus", "hus", "NN"), ("B:a", "b:a", "PM")]
    xml = spark.createDataFrame([("d", '<t><s><w pos="NN" lemma="|hus|">Huset</w> <w pos="VB" lemma="|">är</w></s></t>')], "document_name string, text string")
    assert [(r.token, r.lemma) for r in src.tagged_xml(xml).orderBy("pos").collect()] == [("Huset", "hus"), ("är", "är")]
    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("x")
    path = f"{tmp_path}/cp"
    assert store.checkpoint(spark, path, make).count() == store.checkpoint(spark, path, make).count() == 3 and len(made) == 1
    kept = store.Store(spark, f"{tmp_path}/kept")
    kept.save({"a": 1}, cells=spark.createDataFrame([(0, "x", 2), (1, "y", 1)], "document_id long, token string, value long"), index=spark.createDataFrame([(0, 2000), (1, 2000)], "document_id long, year int"))
    assert kept.options() == {"a": 1} and kept.load_dtm(group_by_year=True, n_top=1).cells.first().value == 2
    assert store.find_tags(spark, str(tmp_path)) == ["kept"] and store.remove(spark, path) and not store.exists(spark, path)
    assert one(spark, src.html_text(F.lit("<html><head><title>t</title></head><body><p>a &amp; b</p><script>x</script>c<br>d</body></html>"))) == "a & b\nc\nd"


def test_pipeline(spark, tmp_path):
    recipe = Recipe((lambda p: p.transform_text("dehyphen"), lambda p: p.tokenize())) + Recipe((lambda p: p.transform_tokens(TokensTransformOpts(min_len=2)),))
    p = recipe(Pipeline.read(spark, [("a.txt", "The house. The gar-\nden is green"), ("b.txt", "")]))
    tf = {r.token: r.tf for r in p.to_dtm().term_frequency().collect()}
    assert tf["the"] == 2 and tf["garden"] == 1 and p.to_dtm().document_counts().where("n_tokens = 0").count() == 1
    assert p.vocabulary(2, mask=True).to_dtm().matching(["__low-tf__"]).first().tf == 4
    assert p.to_pairs(ContextOpts(width=1)).count() > 0 and p.to_keyness("DICE").count() > 0 and p.to_pairs(ContextOpts(width=1, concepts=("green",))).count() > 0
    assert p.checkpoint(f"{tmp_path}/p").check(F.col("n_tokens") >= 0, "negative").take(1).docs.count() == 1
    with pytest.raises(Exception, match="never"):
        p.check(F.lit(False), "never").docs.collect()


def test_workflows(spark, tmp_path):
    texts = [(f"d{k}.txt", t) for k, t in enumerate(["apple pear apple fig", "pear fig plum", "dog cat dog", "cat dog cow cow"] * 5)]
    kept = wf.vectorize(spark, texts, f"{tmp_path}/dtm", min_df=2).load_dtm(n_top=2)
    assert {r.token for r in kept.cells.collect()} == {"dog", "apple"}
    bundle = wf.co_occurrence(spark, texts, f"{tmp_path}/coo", ContextOpts(width=1, concepts=("fig",)))
    assert bundle.load("pairs").count() > bundle.load("concept_pairs").count() > 0 and bundle.options()["width"] == 1
    model = wf.train_topics(spark, texts, f"{tmp_path}/tm", k=3, max_iter=3, n_tokens=5)
    assert model.load("document_topic_weights").select("document_id").distinct().count() == 20 and model.load("topic_token_overview").count() == 3
    more = wf.predict_topics(spark, f"{tmp_path}/tm", [("x.txt", "dog unknown")], f"{tmp_path}/p")
    assert more.load("document_topic_weights").agg(F.sum("weight")).first()[0] == pytest.approx(1, abs=0.02)
    merged = wf.merge_topics(spark, f"{tmp_path}/tm", {"a": [0, 2]}, f"{tmp_path}/m")
    assert {r.topic_id for r in merged.load("topic_token_overview").collect()} == {0, 1}


def test_tagger(spark):
    docs = spark.createDataFrame([(1, "a bc"), (2, None)], "document_id long, text string")
    rows = tg.tag(docs, lambda t: [(w, w.upper(), "NN") for w in t.split()]).collect()
    assert [(r.document_id, r.pos, r.token, r.lemma) for r in rows] == [(1, 0, "a", "A"), (1, 1, "bc", "BC")]


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A house a HOUSE"), (2, "b")], "doc_id long, text string").withColumn("ts", F.timestamp_seconds(F.col("doc_id") * 3600))
    docs.write.parquet(f"{tmp_path}/in")
    stream = st.tokens_of_stream(st.text_stream(spark, f"{tmp_path}/in", docs.schema.simpleString()[7:-1].replace(":", " ")), opts=TokensTransformOpts(min_len=2))
    q = st.windowed_counts(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(60)
    assert [(r.token, r.tf) for r in spark.table("counts").collect()] == [("house", 2)]


def test_the_rest_does_not_need_llm():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "corpusloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "corpusloom.llm" in p.read_text()]


def test_unknown_metrics_are_refused():
    with pytest.raises(ValueError, match="unknown metric: manhattan"):
        ml.linkage(np.zeros((3, 2)), "average", "manhattan")
