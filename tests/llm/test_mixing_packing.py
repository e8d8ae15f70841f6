import math
import random
from collections import defaultdict
from itertools import accumulate

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.packing import fill_ahead, pack_best_fit, pack_block
from corpusloom.llm.queries import OP10_SQL
from tests.llm.helpers import AWKWARD, awkward, empty, made_up, words


def water_filled(sizes, share=1.5, most=2.0):
    """Excess over the caps is shared again by weight until no source is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = share * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        add = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += add[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_taken_words(spark):
    rng = random.Random(1)
    names = ["b", "a", "ü", "Z", None, "c", "hot"]
    rows = [(k, t, rng.choice(names) if k % 3 else "hot") for k, t in enumerate(made_up(3000, seed=1, most=80))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix_sources(df, rows_per_bin=64).collect()
    assert len(found) == len(rows)
    source = {k: s for k, _, s in rows}
    sizes = defaultdict(int)
    for k, t, s in rows:
        sizes[s] += len(words(t))
    expected, taken = water_filled(sizes), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(expected[source[r.doc_id]])
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 40
    again = mix_sources(df.repartition(7), rows_per_bin=10**9).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_inclusion_follows_the_measure(spark):
    """Sources with the same sizes: documents of a size are included about as often as their inclusion probability says."""
    kinds = [1, 4, 9, 16, 25, 36, 49, 64, 100, 400, 900]
    sizes = sorted(kinds * 20)
    rows = [(s * 1000 + k, " ".join(["w"] * n), f"s{s}") for s in range(30) for k, n in enumerate(sizes)]
    found = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.8, weights=(1,)).collect()
    rest, measure = 0.8 * sum(sizes), [math.ceil(math.sqrt(n)) for n in sizes]
    sure = set()
    while True:
        c = (rest - sum(sizes[k] for k in sure)) / sum(sizes[k] * measure[k] for k in range(len(sizes)) if k not in sure)
        more = {k for k in range(len(sizes)) if c * measure[k] >= 1}
        if more <= sure:
            break
        sure |= more
    taken = defaultdict(int)
    for r in found:
        assert r.taken in (0, r["size"])
        taken[r["size"]] += r.taken > 0
    assert sure
    for n in kinds:
        assert taken[n] / 600 == pytest.approx(min(1, c * math.ceil(math.sqrt(n))), abs=0.07)


def test_mix_as_sql(spark, tmp_path):
    rng = random.Random(9)
    names = ["b", "a", "ü", "Z", None, "c", "hot"]
    rows = [(rng.choice([None, 5, k]), t if k % 50 else None, rng.choice(names) if k % 3 else "hot") for k, t in enumerate(made_up(2500, seed=4, most=300))]
    rows += [(3, "one two three four", "same")] * 300 + [(None, "x y", "same")] * 40 + [(k, None, "none") for k in range(20)]
    for n in (1, 3):
        folder = f"{tmp_path}/{n}"
        spark.createDataFrame(rows * n, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        sql = con.execute(f"SELECT doc_id, size, source_size, target, taken, draw FROM ({OP10_SQL})").fetchall()
        for bins in (10**9, 8):
            mixed = [tuple(r) for r in mix_sources(spark.read.parquet(f"{folder}/documents.parquet"), rows_per_bin=bins).collect()]
            assert sorted(mixed, key=repr) == sorted(sql, key=repr)


def test_mixing_awkward_rows(spark):
    found = mix_sources(awkward(spark)).collect()
    assert len(found) == len(AWKWARD)
    assert sorted(r["size"] for r in found) == sorted(len(words(t)) for _, t, *_ in AWKWARD)
    assert mix_sources(empty(spark)).count() == 0


def test_pack_block_fits_and_is_tight():
    rng = random.Random(2)
    sizes = [min(4096, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(2000)]
    bins, starts, lengths = pack_block(sizes)
    used = defaultdict(list)
    for size, b, at in zip(sizes, bins, starts, strict=True):
        used[b].append((at, at + size))
    for b, spans in used.items():
        spans.sort()
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert spans[-1][1] <= lengths[b] and all(c >= lengths[b] or c < spans[-1][1] for c in (512, 1024, 2048, 4096))
    assert sum(sizes) / sum(lengths) > 0.97


def test_packing_keeps_every_word(spark):
    found = pack_best_fit(awkward(spark), capacities=(64, 128), block_docs=4).collect()
    total = defaultdict(int)
    for r in found:
        total[r.doc_id] += r.length
        assert 0 <= r.bin_offset and r.bin_offset + r.length <= r.bin_capacity and r.length <= 128
    expected = defaultdict(int)
    for i, t, *_ in AWKWARD:
        expected[i] += len(words(t))
    assert total == expected
    bins = defaultdict(list)
    for r in found:
        if r.length:
            bins[r.bin_id].append((r.bin_offset, r.bin_offset + r.length))
    for spans in bins.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert pack_best_fit(empty(spark)).count() == 0


def test_repeated_and_null_ids_are_dealt_to_all_blocks(spark):
    text = F.concat_ws(" ", F.array_repeat(F.lit("w"), F.expr("cast(1 + id % 3 as int)")))
    df = spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.lit(8)).alias("doc_id"), text.alias("text"))
    found = pack_best_fit(df, block_docs=500)
    assert found.count() == 6000 and found.where("doc_id = 8").count() == 3000
    per_block = [r[1] for r in found.groupBy(F.shiftright("bin_id", 24)).count().collect()]
    assert len(per_block) > 6 and max(per_block) < 2000
    assert found.agg(F.sum("length")).first()[0] == 12000
    again = pack_best_fit(df.repartition(5), block_docs=500)
    assert found.exceptAll(again).isEmpty() and again.exceptAll(found).isEmpty()


def test_packing_as_brute_force(spark):
    """One block: every piece goes where the plain rule puts it."""
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.choice([0, 3, 5, 20, 90, 200, 300]))) for k in range(300)]
    caps, charge = (32, 64, 128), 16
    pieces = sorted(((i, at, min(128, n - at)) for i, t in rows for n in [len(t.split())] for at in (range(0, n, 128) if n else (0,))), key=lambda p: -p[2])
    bins = []  # [capacity opened, used]
    for k, (_, _, size) in enumerate(pieces):
        fitting = [b for b in bins if b[0] - b[1] >= size and b[0] > b[1]]
        if fitting:
            min(fitting, key=lambda b: b[0] - b[1])[1] += size
            continue
        costs = []
        for c in caps:
            if c >= size:
                put = 0
                for _, _, n in pieces[k:]:
                    put += n if n <= c - put else 0
                costs.append(((c + charge) / max(1, put), c))
        bins.append([min(costs)[1], size])
    expected = sorted((next(c for c in caps if c >= b[1]), b[1]) for b in bins)
    found = defaultdict(lambda: [0, 0])
    for r in pack_best_fit(spark.createDataFrame(rows, "doc_id long, text string"), capacities=caps, charge=charge).collect():
        found[r.bin_id][0] = r.bin_capacity
        found[r.bin_id][1] += r.length
    assert sorted(map(tuple, found.values())) == expected


def test_pack_block_looks_ahead_as_far_as_a_bin_reaches():
    def greedy(falling, at, room):
        put = 0
        for n in falling[at:]:
            put += n if n <= room - put else 0
        return put

    rng = random.Random(3)
    for top in (1, 3, 40, 900):
        falling = sorted((rng.randint(0, top) for _ in range(rng.randint(1, 120))), reverse=True)
        rising, sums = [-n for n in falling], [0, *accumulate(falling)]
        for at in range(len(falling)):
            for room in (0, 1, 7, 64, 512, 4096):
                assert fill_ahead(rising, sums, at, room) == greedy(falling, at, room)
    # short documents reach the largest length, too
    _, _, lengths = pack_block([200] * 2048)
    assert max(lengths) == 4096 and len(lengths) < 110
    sizes = [rng.randint(300, 330) for _ in range(2048)]
    assert sum(pack_block(sizes)[2]) - sum(sizes) < 0.05 * sum(sizes)
