"""Pairs counted and joined block by block: whole results, and nothing shuffled for each pair."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import keyness as ky
from corpusloom.operators import blocks
from corpusloom.operators import cooccurrence as co
from corpusloom.plans import catalogue

WORDS = ["a", "b", "the", "the", "the", "é", "zebra", "Zebra", "*", "𝄞", "x" * 30, "å", "und"]


def some_docs(n=60, seed=1):
    r = random.Random(seed)
    docs = [(i % 50, r.choice(["en", None, "de"]), [r.choice(WORDS) for _ in range(r.choice([0, 1, 2, 3, 40]))]) for i in range(n)]
    return [*docs, (7, "en", None), (8, "de", ["a", None, "b", None, "und"])]


def spelled(docs, width, key):
    pairs = Counter()
    for d in docs:
        t = d[2] or []
        for centre in range(len(t)):
            n = Counter(x for x in t[max(0, centre - width) : centre + width + 1] if x is not None and x != "*")
            pairs.update({(*key(d), a, b): n[a] * n[b] for a in n for b in n if a.encode() < b.encode()})
    return dict(pairs)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize(("keys", "key"), [((), lambda d: ()), (("lang",), lambda d: (d[1],)), (("document_id", "lang"), lambda d: d[:2])])
@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_pairs_of_small_blocks(spark, monkeypatch, keys, key, most):
    monkeypatch.setattr(blocks, "TOKENS", most)
    docs = some_docs()
    found = co.window_pairs(spark.createDataFrame(docs, "document_id long, lang string, tokens array<string>"), 2, keys).collect()
    assert len(found) == len({tuple(r)[:-1] for r in found})
    assert {tuple(r)[:-1]: r.value for r in found} == spelled(docs, 2, key)


def test_a_block_whose_numbers_would_not_fit_is_halved():
    docs = [[f"w{i}_{j}" for j in range(64)] for i in range(1 << 10)]
    table = pa.table({"tokens": pa.array(docs), "_k0": pa.array(range(1 << 10))})
    pairs = lambda width: sum(len(blocks.unpacked(r["data"])["_v"]) for r in blocks._counted(table, ["k"], width, "*", 1))
    assert pairs(1) == 1024 * (63 + 62)
    many = pa.table({"tokens": pa.array([[f"{i}_{j}" for j in range(2)] for i in range(1 << 21)]), "_k0": pa.array(range(1 << 21))})
    rows = [blocks.unpacked(r["data"]) for r in blocks._counted(many, ["k"], 1, "*", 1)]
    assert len(rows) > 1 and sum(len(r["_v"]) for r in rows) == 1 << 21


@pytest.mark.parametrize("name", ["cooc_corpus_by_lang", "win_largest_pairs", "cooc_decode_split", "join_exclude_pairs"])
def test_no_row_for_each_pair_is_shuffled(spark, tmp_path, name):
    spark.createDataFrame([(i, "the cat and the dog " * 5, "en", "a") for i in range(5)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    dealt = exchanges(catalogue.QUERIES[name](spark, str(tmp_path)))
    assert not [line for line in dealt if "w1#" in line or "_p#" in line] and any("part#" in line for line in dealt)


def test_all_pairs_of_one_word_are_dealt_to_several_parts():
    words = pa.array(["w", *[f"v{i}" for i in range(100)], "longest"])
    lo, hi = blocks.np.zeros(100, int), blocks.np.arange(1, 101)
    none = blocks.np.zeros(100, blocks.np.uint64)
    assert len(set(blocks._part_of_pairs(words, lo, hi, none, 64).tolist())) > 30
    assert 1 < len(set(blocks._part_of_pairs(words, hi, lo + 101, none, 64).tolist())) <= 4


PAIRS = [("x", "a", "b", 3), ("x", "a", "c", 1), ("x", "b", "c", 5), ("y", "a", "b", 2), ("y", "b", "z", 0), (None, "a", "b", 9), ("y", "c", "d", None), ("x", "é", "𝄞", 4)]


@pytest.mark.parametrize("most", [1, 3, 1 << 20])
@pytest.mark.parametrize("symmetric", [False, True])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_sums_of_words_over_small_blocks(spark, monkeypatch, most, symmetric, kind):
    monkeypatch.setattr(blocks, "PAIRS", most)
    rows = [(*r[:3], r[3] if r[3] is None or kind == "long" else r[3] + 0.5 if r[3] else 0.0) for r in PAIRS]
    coo = spark.createDataFrame(rows, f"lang string, w1 string, w2 string, value {kind}")
    found = ky.significance(coo, lambda c, z, a, b, n, normalize: a * 1e6 + b * 1e3 + z, ["lang"], symmetric=symmetric).collect()
    z, s = Counter(), Counter()
    for lang, w1, w2, v in rows:
        z[lang] += v or 0
        s[lang, w1] += v or 0
        s[lang, w2] += (v or 0) * symmetric
    expected = {(g, a, b, v): s[g, a] * 1e6 + s[g, b] * 1e3 + z[g] for g, a, b, v in rows if v and g}
    assert {tuple(r)[:4]: r.weight for r in found} == pytest.approx(expected) and len(found) == len(expected)


def test_values_given_for_words(spark):
    coo = spark.createDataFrame(PAIRS, "lang string, w1 string, w2 string, value long")
    windows = spark.createDataFrame([("x", "a", 4), ("x", "b", 6), ("x", "c", None), ("y", "a", 2), ("y", "b", 5), (None, "a", 9), (None, "b", 9), ("w", "a", 1)], "lang string, token string, n_windows long")
    found = {tuple(r)[:4]: r.weight for r in ky.hal_cwr_by_windows(coo, windows, ["lang"]).collect()}
    assert found == pytest.approx({r: {("x", "a", "b", 3): 3 / 7, ("y", "a", "b", 2): 2 / 5}.get(r, 0.0) for r in PAIRS})


def test_keys_of_sums_and_of_keyness_may_differ(spark):
    docs = spark.createDataFrame(some_docs(), "document_id long, lang string, tokens array<string>").where("lang is not null")
    per_document = co.window_pairs(docs, 2, ("document_id", "lang"))
    found = ky.significance(per_document, lambda c, z, a, b, n, normalize: z + a / 1e6, ["lang"])
    kept = ky.significance(per_document.select("*"), lambda c, z, a, b, n, normalize: z + a / 1e6, ["lang"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, kept.collect()))


@pytest.mark.parametrize("name", ["key_llr", "key_llr_n", "key_llr_z", "key_dice", "key_ppmi", "key_hal_cwr", "key_per_words"])
def test_keyness_shuffles_words_of_blocks_but_no_pairs(spark, tmp_path, name):
    spark.createDataFrame([(i, "the cat and the dog " * 5, "en", "a") for i in range(5)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    assert not [line for line in exchanges(df) if "w1#" in line or "w2#" in line or "lang#" in line]


def test_a_weight_is_worked_out_once(spark):
    coo = spark.createDataFrame(PAIRS, "lang string, w1 string, w2 string, value long")
    plan = ky.significance(coo, "LLR", ["lang"])._jdf.queryExecution().executedPlan().toString()
    assert max(len(re.findall(r"LOG\(|ln\(", line, re.I)) for line in plan.splitlines()) <= 9


def test_accents_are_stripped_as_unicode_decomposes_them(spark):
    import unicodedata

    from corpusloom.functions import text

    every = ["".join(map(chr, range(a, min(a + 4096, 0xD800)))) for a in range(0, 0xD800, 4096)] + ["".join(map(chr, range(a, a + 4096))) for a in range(0xE000, 0x30000, 4096)] + ["", None, "plain", "éé𝄞"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(every)], "i int, text string").select("i", text.strip_accents(F.col("text")).alias("t"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.i: r.t for r in df.collect()} == {i: t if t is None else unicodedata.normalize("NFD", t).encode("ascii", "ignore").decode() for i, t in enumerate(every)}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_first_places_are_found_without_sorting_all_tokens(spark, kind):
    from corpusloom.operators import vocabulary as vc

    rows = [(3, 0, "c"), (2, 5, "b"), (2, 4, "a"), (-1, 9, "z"), (3, 1, "a"), (2**62, 0, "q"), (-(2**62), 2**31 - 1, "p")]
    tokens = spark.createDataFrame(rows, "document_id long, pos int, token string").withColumn("document_id", F.col("document_id").cast(kind))
    found = [r.token for r in vc.vocabulary(tokens).orderBy("token_id").collect()]
    first = {}
    for d, p, t in sorted(rows, key=lambda r: (r[0] if kind == "long" else str(r[0]), r[1])):
        first.setdefault(t, len(first))
    assert found == sorted(first, key=first.get)
    if kind == "long":
        assert "SortAggregate" not in vc.term_counts(tokens)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["agg_vocab_translate", "join_decode"])
def test_tokens_are_counted_before_they_are_encoded(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = [(len(line) - len(line.lstrip(" :+-")), line) for line in plan.splitlines()]
    depth = next(d for d, line in lines if "generate" in line.lower())
    assert any("Aggregate [token" in line for d, line in lines[: next(i for i, (_, x) in enumerate(lines) if "generate" in x.lower())] if d < depth)


def test_terms_by_language_shuffle_texts_once(spark):
    dealt = exchanges(catalogue.QUERIES["topk_terms_by_lang"](spark, "/root/testdata/sf0.001"))
    assert not [line for line in dealt if "document_id#" in line and "token#" in line]


def test_bags_of_orders_are_dealt_in_partitions_that_follow_the_input(spark):
    plan = catalogue.QUERIES["agg_from_bags"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "l_partkey" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
