import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import hmm
from corpusloom.llm.blocks import Dictionary, make_blocks, pack_pieces, unpack_pieces, unsqueeze
from corpusloom.llm.hmm import Model, forward, hmm_score
from corpusloom.llm.language_id import ByteNetwork, identify_language
from corpusloom.llm.queries import op5_hmm_scores, op8_language_id, op9_token_counts
from corpusloom.llm.token_counts import PartCounts, count_tokens
from corpusloom.llm.toxicity import Features, fit, score_toxicity
from tests.llm.helpers import AWKWARD, awkward, empty, made_up, words


def test_token_counts_as_the_library(spark):
    texts = [t for _, t, *_ in AWKWARD] + ["it's <|endoftext|> we'll  \n\n done<|endoftext|>", "  two  spaces ", "\x1c\x85 　x", "数字 ١٢٣ ²½", "don't\r\n\tstop  "] + made_up(50)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {k: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts)}
    found = count_tokens(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in found} == expected
    assert all(r.over_limit == (r.n_tokens > 1024) for r in found)


def test_token_counts_awkward_and_empty(spark):
    assert count_tokens(awkward(spark)).count() == len(AWKWARD)
    assert count_tokens(empty(spark)).count() == 0


def test_merged_blocks_answer_the_same(spark):
    """With few pieces a part, blocks are merged in groups and dealt to finer parts; ids at the end of long and null ids stay apart."""
    rows = [(k, t) for k, t in enumerate(made_up(300, seed=7, vocabulary=900))] + [(-(2**63), "some words here"), (None, "others there"), (2**63 - 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    as_set = lambda found: {tuple(r) for r in found.collect()}
    whole = as_set(count_tokens(df))
    assert as_set(count_tokens(df, entries=20)) == whole and {r[0] for r in whole} == {i for i, _ in rows}
    exact = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    one, two = (hmm_score(df, train_on=F.col("doc_id") % 7 != 2, states=2, iterations=1, entries=n) for n in (10**9, 20))
    assert as_set(one.select(exact)) == as_set(two.select(exact)) and {r.doc_id for r in one.collect()} == {i for i, _ in rows}
    near = lambda found: {r.doc_id: r.base_score for r in found.collect()}
    assert near(two) == pytest.approx(near(one))


def test_rows_of_the_merged_dictionary_grow_with_the_blocks(spark):
    df = spark.createDataFrame([(k, t, True) for k, t in enumerate(made_up(400, seed=8, vocabulary=2000))], "_id long, _text string, _learn boolean").repartition(16)
    made = make_blocks(df, lambda text: text.encode().split(), sequences=False, parts=4)
    own = Dictionary(made, entries=200, least_row=16, made_with=4)
    assert own.parts > 16
    sizes = [r.n for r in own.merged.where("part >= 0").collect()]
    assert sum(sizes) / len(sizes) > 8 and own.merged.where("part >= 0").count() < made.where("part < 0").count() * own.parts
    pieces = [p for r in own.merged.where("part >= 0").collect() for p in unpack_pieces(r.data)[0]]
    assert set(pieces) == {w for t in made_up(400, seed=8, vocabulary=2000) for w in t.encode().split()}


def test_a_pre_token_of_a_part_is_counted_once():
    """However the part's rows are cut into batches."""
    calls = []

    class Library:
        def count(self, pieces):
            calls.extend(pieces)
            return [len(p) for p in pieces]

    rows = [(block, part, pack_pieces([f"w{part}{k}".encode() for k in range(block % 3, 9)], [0] * (9 - block % 3))) for part in range(3) for block in range(10)]
    counts = PartCounts(lambda: Library())
    for at in range(0, len(rows), 4):
        for (block, part, data), (b, p, got) in zip(rows[at : at + 4], counts(*zip(*rows[at : at + 4], strict=True)), strict=True):
            assert (block, part) == (b, p) and unsqueeze(got)[0][0].tolist() == [len(x) for x in unpack_pieces(data)[0]]
    assert len(calls) == len(set(calls)) == 27


def remainder(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


def test_queries_as_the_contract(spark, tmp_path):
    """Columns that only the queries make: held_out by crc32, and what is counted from the rest."""
    rows = [(i, t, lang) for i, t, lang, _ in spoken(90, 3)] + [(1000 + k, t, lang) for k, (_, t, lang, *_) in enumerate(AWKWARD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {i: [*words(t), b"\n"] for i, t, _ in rows}
    counts = Counter(w for i, t in texts.items() if remainder(i, 7) != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    found = op5_hmm_scores(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        t = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(r.doc_id, 7) == 2, len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
    learned = {lang for i, t, lang in rows if lang is not None and remainder(i, 5) != 0 and t is not None}
    text_of = {i: t for i, t, _ in rows}
    found = op8_language_id(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) and found[0].__fields__ == ["doc_id", "held_out", "lang_pred", "score"]
    for r in found:
        spoken_ = any(map(str.isalpha, text_of[r.doc_id] or ""))
        assert r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and (r.lang_pred in learned if spoken_ else r.lang_pred == "und")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in op9_token_counts(spark, str(tmp_path)).collect():
        size = len(library.encode(text_of[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text_of[r.doc_id] or "").encode()), size, size > 1024)


def all_paths(model, classes):
    """Likelihood by summing over every state path."""
    alpha = model.start * model.emit[classes[0]]
    paths = {(s,): alpha[s] for s in range(len(model.start))}
    for c in classes[1:]:
        paths = {(*p, s): v * model.move[p[-1], s] * model.emit[c, s] for p, v in paths.items() for s in range(len(model.start))}
    return math.log(sum(paths.values()))


def small_model(seed=0, states=3, classes=5):
    rng = np.random.default_rng(seed)
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    return Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def test_forward_is_exact():
    model, rng = small_model(), np.random.default_rng(1)
    sequences = [rng.integers(0, 5, n) for n in (1, 6, 3, 7, 1)]
    logs = forward(model, np.concatenate(sequences), np.cumsum([len(s) for s in sequences]))
    assert logs == pytest.approx([all_paths(model, s) for s in sequences])


def test_expected_counts_by_finite_differences():
    """Baum-Welch counts are parameters times derivatives of the log likelihood."""
    model, rng = small_model(2), np.random.default_rng(3)
    sequences = [rng.integers(0, 5, n) for n in (4, 9, 2)]
    flat, ends = np.concatenate(sequences), np.cumsum([len(s) for s in sequences])
    start, move, emit, total = forward(model, flat, ends, backward=True)
    assert total == pytest.approx(forward(model, flat, ends).sum())
    for name, counts in (("start", start), ("move", move), ("emit", emit)):
        value = getattr(model, name)
        for at in np.ndindex(value.shape):
            up = {n: getattr(model, n).copy() for n in ("start", "move", "emit")}
            up[name][at] *= 1 + 1e-5
            grown = forward(Model(**up), flat, ends).sum()
            assert (grown - total) / 1e-5 == pytest.approx(counts[at], rel=1e-2, abs=1e-3)


def test_hmm_counts_and_base(spark):
    rows = list(enumerate(made_up(80, seed=4))) + [(100, None), (101, ""), (102, "Only Unseen words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = hmm_score(df, train_on=F.col("doc_id") % 4 != 2, states=3, iterations=1).collect()
    texts = {i: [*words(t), b"\n"] for i, t in rows}
    counts = Counter(w for i, t in texts.items() if i % 4 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    for r in found:
        t = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id % 4 == 2, len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert r.score < 0 and math.isfinite(r.score)


def test_hmm_learns_and_is_a_distribution(spark):
    """Two interleaved vocabularies: states tell them apart, so held-out texts gain over single words."""
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("abcdefgh" if k % 2 else "stuvwxyz") for _ in range(60))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = [r for r in hmm_score(df, train_on=F.col("doc_id") % 7 != 2, states=2).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)
    # probabilities of all texts of at most two words of a tiny alphabet cannot exceed 1
    rows = [(k, t) for k, t in enumerate(["a", "b", "a b", "b a", "a a", "b b", "", "c", "c a"])]
    found = hmm_score(spark.createDataFrame(rows, "doc_id long, text string"), states=2, iterations=1).collect()
    assert sum(10**r.score for r in found) < 1


def test_hmm_awkward_and_empty(spark):
    found = hmm_score(awkward(spark)).collect()
    assert len(found) == len(AWKWARD) and not any(r.held_out for r in found)
    assert hmm_score(empty(spark)).count() == 0
    assert hmm.tokens_of(b"") == [b"\n"]


def test_hmm_starts_on_all_training_texts(spark):
    """Short texts, and what stands late in a long one, shape the start as any other token: a sample of long texts misses them."""
    rng = random.Random(5)
    some = lambda letters, n: " ".join(rng.choice(letters) for _ in range(n))
    rows = [(7 * k, some("abcdefgh", 100)) for k in range(1000)] + [(7 * k + 1, some("stuvwxyz", 10)) for k in range(1000)] + [(7 * k + 2, some("stuvwxyz", 10)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for iterations in (0, 1):
        held = [r for r in hmm_score(df, train_on=F.col("doc_id") % 7 != 2, states=2, iterations=iterations).collect() if r.held_out]
        assert len(held) == 20 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_neighbours_by_brute_force():
    rng = np.random.default_rng(6)
    sequences = [rng.integers(0, hmm.OWN + hmm.SHARED, n) for n in (1, 40, 1, 1, 700, 2)]
    after, before, times = Counter(), Counter(), Counter()
    for s in sequences:
        times.update(s.tolist())
        for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True):
            after[a, b % hmm.NEAR] += 1
            before[b, a % hmm.NEAR] += 1
    found = hmm.neighbours(np.concatenate(sequences).astype(np.int32), np.cumsum([len(s) for s in sequences]))
    for counted, expected in zip(found[:2], (after, before), strict=True):
        assert {(int(i), int(j)): int(counted[i, j]) for i, j in np.argwhere(counted)} == expected
    assert {int(i): int(found[2][i]) for i in np.flatnonzero(found[2])} == times


LANGUAGES = {"xx": "akolumi", "yy": "ştrœnßd", "zz": "qwxvyzj"}


def spoken(n, seed):
    rng = random.Random(seed)
    names = sorted(LANGUAGES)
    out = []
    for k in range(n):
        lang = names[k % 3]
        out.append((k, " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 200))), lang, None))
    return out


def test_language_id_held_out_accuracy(spark):
    df = spark.createDataFrame(spoken(300, 1), "doc_id long, text string, lang string, source string")
    found = identify_language(df, train_on=F.col("doc_id") % 5 != 0, per_class=40).collect()
    truth = {i: lang for i, _, lang, _ in spoken(300, 1)}
    held = [r for r in found if r.doc_id % 5 == 0]
    assert len(found) == 300 and all(0 <= r.score <= 1 for r in found)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_id_awkward_and_empty(spark):
    found = {(r.doc_id, r.lang_pred) for r in identify_language(awkward(spark)).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= found and not any(p == "und" for i, p in found if i in (1, 5, 6, 7))
    assert identify_language(empty(spark)).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert identify_language(unlabelled).first().lang_pred == "und"


def test_network_gradient():
    net = ByteNetwork(["a", "b", "c"], embed=3, filters=4)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (5, 16)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        h, *_ = net.pooled(x)
        z = h @ net.p["out"] + net.p["out_b"]
        z -= z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(5), y]))

    g = net._gradient(x, y)
    for name in ("out", "out_b", "f2", "f3", "b4", "embed"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        net.p[name][at] += 1e-5
        up = loss()
        net.p[name][at] -= 2e-5
        down = loss()
        net.p[name][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], rel=1e-3, abs=1e-7)


def test_hidden_is_pooled():
    net = ByteNetwork(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (150, 256)).astype(np.uint8)
    assert np.allclose(net.hidden(x), net.pooled(x)[0], atol=1e-4)


def test_toxicity(spark):
    rng = random.Random(3)
    base = made_up(900, seed=7, least=20)
    rows, labels = [], []
    for k, t in enumerate(base):
        bad = k % 6 == 0
        w = t.split()
        for _ in range(rng.randint(2, 9) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["zorkish", "vlumpox", "Quagger!"]))
        rows.append((k, " ".join(w)))
        if k < 700:
            labels.append((k, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in score_toxicity(df, known).collect()}
    held = range(700, 900)
    assert sum(found[k].toxic == (k % 6 == 0) for k in held) >= 195
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in found.values())
    few = [found[k].severity for k in held if k % 6 == 0 and sum(w in ("zorkish", "vlumpox", "Quagger!") for w in rows[k][1].split()) <= 3]
    none = [found[k].severity for k in held if k % 6]
    assert np.mean(few) > np.mean(none) + 0.5


def test_toxicity_awkward_and_empty(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    assert score_toxicity(awkward(spark), labels).count() == len(AWKWARD)
    assert score_toxicity(empty(spark), labels).count() == 0
    none = score_toxicity(awkward(spark), labels.where("false")).collect()
    assert {(r.grade, r.severity, r.toxic) for r in none} == {(0, 0.0, False)}


def test_ordinal_fit_shares_weights_over_ordered_thresholds():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        g = int(rng.integers(0, 4))
        rows.append(np.unique(np.concatenate([rng.integers(100, 200, 10), np.arange(g)])).astype(np.int32))
        grades.append(g)
    model = fit(rows, grades, 4)
    assert (np.diff(model.thresholds) > 0).all()
    severity = model.above([model.weights[r].sum() for r in rows]).sum(1)
    assert np.corrcoef(severity, grades)[0, 1] > 0.95
    assert len(Features()(b"Hello, hello WORLD")) == len(Features()(b"hello world"))
