import random
from collections import Counter

import corpus_pipeline
from corpusloom.llm.language_id import identify_language
from corpusloom.llm.mixing import mix_sources
from tests.llm.helpers import words
from tests.llm.test_exact_dedup import brute as brute_exact
from tests.llm.test_language_models import spoken
from tests.llm.test_near_dedup import brute as brute_near
from tests.llm.test_near_dedup import edited


def corpus():
    rng = random.Random(4)
    rows = [(i, t, lang, f"s{i % 4}", len(t)) for i, t, lang, _ in spoken(120, 2)]
    rows += [(200 + k, rows[k][1].replace(" ", "  "), rows[k][2], "s1", 1) for k in range(10)]
    rows += [(300 + k, edited(rows[k][1], 0.004, rng), rows[k][2], "s2", 1) for k in range(20, 40)]
    rows += [(400, None, "xx", "s0", 0), (401, "12 34", "xx", "s0", 5), (402, "", None, None, 0)]
    return rows


def test_stages_as_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [f(spark, docs, str(tmp_path)).columns for _, f in corpus_pipeline.STAGES[:4]] == [docs.columns] * 4
    kept = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {r[0] for r in kept}
    ids = {i for i, keep, *_ in brute_exact(kept) if i == keep}
    kept = [r for r in kept if r[0] in ids]
    assert {r.doc_id for r in corpus_pipeline.dedup_exact(spark, docs.where("doc_id < 400"), "").collect()} == ids
    near = {i for i, _, c in brute_near(kept) if i == c}
    kept = [r for r in kept if r[0] in near]
    left = spark.createDataFrame(kept, docs.schema)
    taken = {r.doc_id: r.taken // max(1, r["size"]) for r in mix_sources(left).collect()}
    expected = Counter()
    for r in kept:
        expected[r[0]] += len(words(r[1])) * taken[r[0]]
    found = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found[r.doc_id] += r.length
    assert +found == +expected


def test_repeated_rows(spark):
    """Of rows that share id and text one stays; rows that share only the id are decided each."""
    text, other = "house und garten und wald", "something else with seven other words here"
    rows = [(1, text, "xx", "s")] * 3 + [(1, other, "xx", "s"), (2, text, "xx", "s"), (None, other, "xx", "t"), (None, "a b c", None, None), (None, "a b c", None, None), (None, "ab c", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.dedup_exact(spark, docs, "").collect()), key=repr)
    assert kept == sorted([(1, text), (1, other), (None, "a b c")], key=repr)
    again = corpus_pipeline.dedup_near(spark, docs, "").collect()
    assert Counter(r.doc_id for r in again) == {1: 4, None: 4}
    mixed = Counter((r.doc_id, r.text) for r in corpus_pipeline.mix(spark, docs, "").collect())
    assert all(n % 3 == 0 for (i, t), n in mixed.items() if (i, t) == (1, text))


def test_low_scores_go_and_clean_documents_stay(spark):
    """The language stage as the scores of op8's network say."""
    rows = spoken(150, 5) + [(900, "12 34 56", "xx", None), (901, None, "yy", None), (902, "?!", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    scores = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(docs).collect()}
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {i for i, (p, s) in scores.items() if p != "und" and s >= corpus_pipeline.LEAST_SCORE}
    assert not kept & {900, 901, 902} and len(kept) >= 148


def test_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_nulls(spark):
    rows = [(None, "house und garten", "xx", "s"), (1, "house und garten", None, None), (2, "wald und wiese", "xx", "s"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("lang_pred", "score", "kept", "size", "taken", "_copies", "_copy", "_picked_id", "keep_id", "_id", "_text"):
        docs = docs.selectExpr("*", f"'x' AS `{name}`")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {r.score for r in out.collect()} == {"x"}
    assert {r.doc_id for r in corpus_pipeline.STAGES[4][1](spark, docs, "").collect()} == {None, 1, 2}
