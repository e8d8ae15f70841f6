import random

import numpy as np
import pytest

from corpusloom.llm import near_dedup as nd
from corpusloom.llm.components import components
from corpusloom.llm.near_dedup import near_dedup
from tests.llm.helpers import AWKWARD, awkward, empty, made_up, words


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """{(id, text): (n_shingles, component)} by all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][0] is not None and rows[a][0] == rows[b][0]
            both = len(sets[a] & sets[b])
            if same or (None not in (rows[a][0], rows[b][0]) and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)):
                root[find(a)] = find(b)
    out = []
    for k, (i, *_) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(members) if members else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_awkward_rows_as_brute_force(spark):
    found = near_dedup(awkward(spark))
    assert rows_of(found) == brute(AWKWARD)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_empty_table(spark):
    assert near_dedup(empty(spark)).count() == 0


def edited(text, share, rng):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**9)}"
    return " ".join(w)


def test_edits_and_shared_passages_as_brute_force(spark):
    rng = random.Random(5)
    passage = made_up(1, seed=9, least=40, most=40)[0]
    rows = []
    for k, base in enumerate(made_up(25, seed=2, least=60, most=160)):
        rows += [(k * 10, base)] + [(k * 10 + j, edited(base, rng.choice([0.005, 0.01, 0.02, 0.04]), rng)) for j in range(1, 5)]
    rows += [(1000 + k, passage + " " + t) for k, t in enumerate(made_up(60, seed=3, least=60, most=90))]
    # one large group of near copies, edited up to beyond the threshold
    base = made_up(1, seed=4, least=150, most=150)[0]
    rows += [(2000 + k, edited(base, rng.uniform(0.005, 0.06), rng)) for k in range(120)]
    rows += [(5000, "one two three"), (5001, "ONE two\tthree"), (5002, "one two four")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(near_dedup(df)) == brute(rows)


def test_families_of_many_blocks_as_brute_force(spark):
    """Chains of edits: neighbours are linked, ends are not, and buckets join all of them to families far larger than a block."""
    rng = random.Random(11)
    rows = []
    for k in range(3):
        text = made_up(1, seed=20 + k, least=120, most=120)[0]
        for j in range(45):
            text = edited(text, 0.012, rng) if j % 9 else edited(edited(text, 0.04, rng), 0.03, rng)
            rows.append((k * 100 + j, text))
    base = made_up(1, seed=30, least=200, most=200)[0].split()
    # sets of many sizes that hold each other: equal sketches bits, different classes of size
    rows += [(1000 + n, " ".join(base[:n])) for n in range(40, 200, 4)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute(rows)
    assert rows_of(near_dedup(df, block=8)) == expected and rows_of(near_dedup(df)) == expected


def test_an_id_with_several_texts_is_one_document(spark):
    a, b, c, d = made_up(4, seed=31, least=30, most=40)
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, d), (11, d), (12, None), (12, c)]
    assert rows_of(near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted([(i, len(shingles(t)), m) for (i, t), m in zip(rows, (3, 3, 3, 3, 9, 9, 9, 12, 9), strict=True)], key=repr)


def test_likely_pairs_lose_none():
    """The sketches of two blocks never refuse a pair that is linked."""
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, 300, dtype=np.uint64)
        sets += [np.sort(base), np.sort(np.concatenate([base[:280], rng.integers(0, 2**63, 20, dtype=np.uint64)])), np.sort(base[: rng.integers(180, 300)])]
    sketches = nd.signatures(sets)[1]
    heads = np.concatenate([[len(sets)], np.arange(len(sets)), np.arange(len(sets)), [len(s) for s in sets], [len(s) for s in sets]]).astype(np.int64).tobytes() + sketches.tobytes()
    block = nd.Block(heads)
    ok = nd.likely_pairs(block, block, 75)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert ok[i, j] or i == j or 100 * both < 75 * (len(a) + len(b) - both)
    assert ok.sum() < 400


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    for similarity in (0.95, 0.85, 0.75):
        errors = []
        for _ in range(30):
            n = 400
            same = int(round(2 * n * similarity / (1 + similarity)))
            base = rng.integers(0, 2**63, 2 * n - same, dtype=np.uint64)
            a, b = np.sort(base[:n]), np.sort(np.concatenate([base[:same], base[n:]]))
            _, sketches = nd.signatures([a, b])
            errors.append(nd.estimated(sketches[0].tobytes(), sketches[1].tobytes()) - similarity)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.2


def test_lower_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        near_dedup(empty(spark), percent=50)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    expected = {v: find(v) for v in root if any(find(w) == find(v) and w != v for w in root)}
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
