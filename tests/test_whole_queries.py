"""Queries over all pairs, tokens and documents, against brute force on a small fixture."""

import math
import re
from collections import Counter

import pytest

from corpusloom.operators import ml
from corpusloom.operators.dtm import vectorize
from corpusloom.plans import catalogue, networks

TEXTS = [
    (0, "The cat saw the dog and the cat ran und so", "en", "a"),
    (1, "rare words meet once", "en", "a"),
    (2, "Der Hund und die Katze und der Hund", "de", "b"),
    (3, "la casa y el perro", "es", "b"),
    (4, "the the the cat", "en", "b"),
    (5, "solo", "es", "a"),
    (6, "common pair " * 20, "en", "a"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def tokens_of(text):
    return re.findall(r"\w+", text.lower())


def pairs_by_lang(width=2):
    """Every window spelled out."""
    pairs = Counter()
    for _, text, lang, _ in TEXTS:
        t = tokens_of(text)
        for centre in range(len(t)):
            n = Counter(t[max(0, centre - width) : centre + width + 1])
            pairs.update({(lang, a, b): n[a] * n[b] for a in n for b in n if a < b})
    return pairs


def rows(spark, folder, name, *columns):
    found = [tuple(r[c] for c in columns) for r in catalogue.QUERIES[name](spark, folder).collect()]
    assert len({r[:-1] for r in found}) == len(found)
    return {r[:-1]: r[-1] for r in found}


def test_all_pairs_are_counted(spark, folder):
    expected = pairs_by_lang()
    assert min(expected.values()) < 25 <= max(expected.values())
    assert rows(spark, folder, "cooc_corpus_by_lang", "lang", "w1", "w2", "value") == expected
    assert rows(spark, folder, "cooc_decode_split", "lang", "first", "second", "value") == expected
    either = {k: v for k, v in expected.items() if {"the", "und"} & set(k[1:])}
    assert rows(spark, folder, "join_match_pairs", "lang", "w1", "w2", "value") == either
    assert rows(spark, folder, "join_exclude_pairs", "lang", "w1", "w2", "value") == {k: v for k, v in expected.items() if k not in either}
    n = Counter()
    for _, text, lang, _ in TEXTS:
        n[lang] += len(tokens_of(text))
    assert rows(spark, folder, "key_per_words", "lang", "w1", "w2", "value") == pytest.approx({k: v / n[k[0]] for k, v in expected.items()}, abs=1e-11)


def ln(x):
    return math.log(max(x, 1e-10))


def x_ln(x):
    return x * ln(x)


def dunning(c, z, a, b):
    like = lambda k, m, p: ln(p) * k + ln(1 - p) * (m - k)
    if a == 0 or z == a:
        return 0.0
    return -2 * like(c, a, b / z) + like(b - c, z - a, b / z) - like(c, a, c / a) - like(b - c, z - a, (b - c) / (z - a))


METRICS = {
    "ppmi": lambda c, z, a, b, n: max(math.log(c * z / (a * b)), 0) if a * b else 0,
    "dice": lambda c, z, a, b, n: 2 * c / (a + b),
    "llr": lambda c, z, a, b, n: 2 * (x_ln(z) - x_ln(a) - x_ln(b) + x_ln(c) + x_ln(z - a - b + c) + x_ln(a - c) + x_ln(b - c) - x_ln(z - a) - x_ln(z - b)),
    "llr_z": lambda c, z, a, b, n: dunning(c, z, a, b),
    "llr_n": lambda c, z, a, b, n: dunning(c, n, a, b),
    "hal_cwr": lambda c, z, a, b, n: c / (a + b - c) if a + b - c else 0,
}


@pytest.mark.parametrize("metric", METRICS)
def test_keyness_takes_its_sums_from_all_pairs(spark, folder, metric):
    pairs, z, firsts, n = pairs_by_lang(), Counter(), Counter(), Counter()
    for (lang, w1, _), value in pairs.items():
        z[lang] += value
        firsts[lang, w1] += value
    for _, text, lang, _ in TEXTS:
        n[lang] += len(tokens_of(text))
    expected = {k: METRICS[metric](v, z[k[0]], firsts[k[0], k[1]], firsts[k[0], k[2]], n[k[0]]) for k, v in pairs.items()}
    found = rows(spark, folder, f"key_{metric}", "lang", "w1", "w2", "weight")
    assert {k: found.get(k, 0.0) for k in expected} == pytest.approx(expected, abs=2e-5) and found.keys() <= expected.keys()
    assert any(pairs[k] < 25 for k in found)


def test_tokens_of_all_languages_are_decoded(spark, folder):
    expected = Counter(t for _, text, *_ in TEXTS for t in tokens_of(text))
    assert rows(spark, folder, "join_decode", "token", "n") == {(t,): n for t, n in expected.items()}


@pytest.mark.parametrize("name", ["ml_lda", "ml_topic_tokens"])
def test_topics_are_trained_on_all_documents_and_tokens(spark, folder, monkeypatch, name):
    asked = {}

    class Asked(Exception):
        pass

    def lda(**options):
        asked.update(options)
        raise Asked

    def all_tokens(tok, **options):
        asked["vectorize"] = options
        return vectorize(tok, **options)

    monkeypatch.setattr(ml, "LDA", lda)
    monkeypatch.setattr(networks, "vectorize", all_tokens)
    with pytest.raises(Asked):
        catalogue.QUERIES[name](spark, folder)
    assert "max_tokens" not in asked["vectorize"]
    assert asked["optimizer"] == "em" and asked["maxIter"] * asked["subsamplingRate"] >= 1
