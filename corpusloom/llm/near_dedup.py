"""Near-duplicate detection: MinHash bands for candidates, odd sketches to screen them, full shingle sets to confirm.

1. Every text becomes a set of 5-word shingles, k MinHash samples of it, b band keys over r samples each, and an odd sketch: a
   bitmap in which each sample flips one bit, so that the population count of the XOR of two sketches estimates how many samples
   differ. Equal texts (as word sequences) are one node from here on.
2. Nodes that share a band key are candidates. Instead of all pairs of a bucket, its members are paired with its smallest one, the
   pairs are screened by sketch and confirmed on the full sets, and the components of the confirmed links are found.
3. Buckets whose members are in several components are left. A node there keeps only shingles that some node of another component
   has, too: if these are too few for any link, it is out. This settles what merely shares passages or consists of edits.
4. What is still left is compared without exception. Nodes connected by buckets form families; a family is cut by the sizes of the
   sets, of which only equal or neighbouring classes can be linked, and then into blocks of bounded size. First blocks meet as
   sketches alone: a matrix product counts the XOR bits of all pairs, which says for which nodes of which blocks a pair of different
   components may be similar. Only these blocks meet again with their sets, and the task returns as many links as connect their nodes.
5. The links of step 4 are counted on 64-bit hashes; they are confirmed on the full sets, and should any be refuted, the step runs
   again with other hashes.

So no candidate pair is lost: it was confirmed or refuted, or both its ends are in one component anyway. A pair with a similarity
of 0.75 shares no band with probability (1 - 0.75**r)**b, 1.2e-6 here, and fails the screen with a probability below that.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.scratch import free_name, id_and_text, temporary, written

SHINGLE = 5
ROWS, BANDS = 4, 36
SAMPLES = ROWS * BANDS
SKETCH_BITS = 512
#: Candidates whose sketches put the similarity below this are not compared; over five standard deviations below 0.75.
SCREEN = 0.5

_rng = np.random.default_rng(20240501)
_MULTIPLIERS = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_MIX = _rng.integers(0, 2**63, (ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at U+0020 and U+0009 to U+000D: what the bytes methods do."""
    return text.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """64-bit hashes of a word list's distinct shingles, sorted. Hashes of words are kept, up to a bound."""

    def __init__(self, most: int = 300_000, seed: int = 0) -> None:
        class Words(dict):
            def __missing__(self, word):
                if len(self) >= most:
                    self.clear()
                h = self[word] = xxhash.xxh64_intdigest(word, seed)
                return h

        self.words, self.seed = Words(), seed

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < SHINGLE:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), self.seed + 1)], np.uint64)
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(w) - SHINGLE + 1
        h = w[:n].copy()
        for k in range(1, SHINGLE):
            h = h * _PRIME + w[k : k + n]
        return np.unique(mixed(h))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (sets x BANDS, int64) and odd sketches (sets x SKETCH_BITS/8 bytes) of non-empty sets."""
    least = np.empty((SAMPLES, len(sets)), np.uint32)
    at = 0
    while at < len(sets):  # as many sets at a time as stay in the cache
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 16):
            size += len(sets[end])
            end += 1
        x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *[len(s) for s in sets[at : end - 1]]])
        y = np.empty_like(x)
        for k in range(SAMPLES):
            np.multiply(x, _MULTIPLIERS[k], out=y)
            np.add(y, _SHIFTS[k], out=y)
            least[k, at:end] = np.minimum.reduceat(y, starts)
        at = end
    bits = np.zeros((len(sets), SKETCH_BITS), bool)
    rows = np.arange(len(sets))
    for k in range(SAMPLES):
        bits[rows, mixed(least[k].astype(np.uint64) * np.uint64(SAMPLES) + np.uint64(k)) % np.uint64(SKETCH_BITS)] ^= True
    keys = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sets), b, np.uint64) * _MIX[ROWS]
        for r in range(ROWS):
            h = mixed(h + least[b * ROWS + r].astype(np.uint64) * _MIX[r])
        keys[:, b] = h
    return keys.view(np.int64), np.packbits(bits, axis=1)


def similarity(ones):
    """Estimated from the population count of the XOR of two odd sketches."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(1e-9, 1 - 2 * ones / SKETCH_BITS))


def estimated(a: bytes, b: bytes) -> float:
    return float(similarity(int.bit_count(int.from_bytes(a) ^ int.from_bytes(b))))


def _sign(batches):
    shingles = Shingles()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
        for at in range(0, len(texts), 512):
            known: dict[bytes, int] = {}
            sets, digests, which = [], [], []
            for text in texts[at : at + 512]:
                words = words_of(text)
                digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None
                digests.append(digest)
                if digest is None:
                    which.append(-1)
                elif digest in known:
                    which.append(known[digest])
                else:
                    known[digest] = len(sets)
                    which.append(len(sets))
                    sets.append(shingles(words))
            if sets:
                keys, sketches = signatures(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, len(which)), pa.array([len(sets[k]) if k >= 0 else 0 for k in which], pa.int64()), pa.array(digests, pa.binary()),
                    pa.array([sketches[k].tobytes() if k >= 0 else None for k in which], pa.binary()), pa.array([keys[k] if k >= 0 else None for k in which], pa.list_(pa.int64())),
                ],
                names=["_id", "_n", "_digest", "_sketch", "_keys"],
            )


def confirmed_links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b), without those whose full shingle sets overlap by less than ``percent``. ``texts``: _id, _text."""
    one = texts.select(F.col("_id").alias("a"), F.col("_text").alias("_ta"))
    two = texts.select(F.col("_id").alias("b"), F.col("_text").alias("_tb"))

    def overlap(batches):
        def shingled(text):
            words = words_of(text)
            return set(zip(*[words[k:] for k in range(SHINGLE)], strict=False)) if len(words) >= SHINGLE else {tuple(words)}

        last, own = None, set()
        for batch in batches:
            keep = []
            for row, (ta, tb) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True)):
                if ta != last:
                    last, own = ta, shingled(ta)
                other = shingled(tb)
                both = len(own & other)
                if 100 * both >= percent * (len(own) + len(other) - both):
                    keep.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return pairs.join(two, "b").join(one, "a").select("a", "b", "_ta", "_tb").mapInArrow(overlap, "a long, b long")


def _sizes_fit(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _links_left(members: DataFrame, labels: DataFrame, sketches: DataFrame, texts: DataFrame, percent: int, block: int, seed: int) -> DataFrame | None:
    """Links between nodes of one bucket and different components, enough of them to connect what is linked. ``members``: key, node; ``sketches``: node, _sketch."""
    placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("_c"))
    open_ = _open(written(placed, "near-placed"))
    if open_.isEmpty():
        return None
    nodes_ = open_.select("node", "_c").distinct()
    sets = texts.join(nodes_.select(F.col("node").alias("_id")), "_id").mapInArrow(lambda it: _hashed(it, seed), "node long, _n long, _h array<long>")
    sets = written(sets.dropDuplicates(["node", "_h"]), "near-sets")
    for _ in range(2):
        flat = sets.select("node", "_n", F.explode("_h").alias("_s")).join(open_.select("node", "_c").distinct(), "node")
        crossing = written(flat.groupBy("_s").agg(F.min("_c").alias("_a"), F.max("_c").alias("_b")).where("_a < _b").select("_s"), "near-crossing")
        useful = written(flat.join(crossing, "_s").groupBy("node", "_n").agg(F.collect_list("_s").alias("_h")), "near-useful")
        own = open_.join(useful.select("node", "_n", F.size("_h").alias("_e")), "node")
        own = written(own, "near-sized")
        least = written(own.groupBy("key").agg(F.min("_n").alias("_least")), "near-least")
        other = F.greatest(F.col("_least"), F.ceil(F.col("_n") * percent / 100))  # no partner is smaller
        # written between the join and the next aggregation by key, so that a hot bucket can be split in both
        hopeful = own.join(least, "key").where(100 * F.col("_e") >= percent * (F.col("_n") + other - F.col("_e"))).select("key", "node", "_c")
        open_ = _open(written(hopeful, "near-hopeful"))
        if open_.isEmpty():
            return None
    heads = written(open_.groupBy("key").agg(F.min("node").alias("_low")), "near-heads")
    family = components(open_.join(heads, "key").where("node <> _low").select(F.col("_low").alias("a"), F.col("node").alias("b")))
    # neighbouring classes hold all sizes within a third of each other, with a margin for rounding
    size_class = F.floor(F.log(F.col("_n").cast("double")) / float(np.log(1.005 * 100 / percent))).cast("int")
    family = family.withColumnRenamed("component", "_f").join(open_.select("node", "_c").distinct(), "node").join(useful, "node").withColumn("_s", size_class)
    family = written(family, "near-families")
    sizes = family.groupBy("_f", "_s").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.size("_h")) / (2048 * block))).alias("_blocks"))
    dealt = family.join(sizes, ["_f", "_s"]).withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_blocks"))).join(sketches, "node")
    # small families share a task; a block of a large one is a row group of its own
    dealt = dealt.select("_f", "_s", "_b", "node", "_c", "_n", "_sketch", "_h").repartition("_f", "_s", "_b").sortWithinPartitions("_f", "_s", "_b", "node")
    packed = written(dealt.mapInArrow(_pack_blocks, "_f long, _s int, _b long, _heads binary, _sets binary"), "near-blocks")
    place = ["_f", "_s", "_b"]
    one = packed.select(*place, F.col("_heads").alias("_one"))
    two = packed.select("_f", F.col("_s").alias("_s2"), F.col("_b").alias("_b2"), F.col("_heads").alias("_two"))
    within = one.join(two.withColumn("_s", F.col("_s2")), ["_f", "_s"]).where("_b <= _b2")
    across = one.join(two.withColumn("_s", F.col("_s2") - 1), ["_f", "_s"])
    met = within.unionByName(across).select(*place, "_s2", "_b2", "_one", "_two").repartition(F.xxhash64(*place, "_s2", "_b2"))
    likely = written(met.mapInArrow(lambda it: _screen_blocks(it, percent), "_f long, _s int, _b long, _s2 int, _b2 long, _rows binary, _cols binary"), "near-likely")
    if likely.isEmpty():
        return None
    both = likely.join(packed.select(*place, F.col("_heads").alias("_one"), F.col("_sets").alias("_ones")), place)
    both = both.join(packed.select("_f", F.col("_s").alias("_s2"), F.col("_b").alias("_b2"), F.col("_heads").alias("_two"), F.col("_sets").alias("_twos")), ["_f", "_s2", "_b2"])
    both = both.select("_rows", "_cols", "_one", "_ones", "_two", "_twos").repartition(F.xxhash64("_rows", "_cols", "_one", "_two"))
    return both.mapInArrow(lambda it: _compare_blocks(it, percent), "a long, b long")


def _open(placed: DataFrame) -> DataFrame:
    """The rows of buckets with several components."""
    several = written(placed.groupBy("key").agg(F.min("_c").alias("_x"), F.max("_c").alias("_y")).where("_x < _y").select("key"), "near-several")
    return written(placed.join(several, "key"), "near-open")


def _hashed(batches, seed):
    """node, number and hashes of its shingles."""
    shingles = Shingles(seed=seed)
    for batch in batches:
        sets = [shingles(words_of(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "_n", "_h"])


def _pack_blocks(batches):
    """One row per block: nodes, components, sizes, numbers of useful hashes and sketches; and the hashes."""
    held, rows = None, []

    def done():
        nodes, comps, sizes, sketches, sets = zip(*rows, strict=True)
        heads = np.concatenate([[len(rows)], nodes, comps, sizes, [len(s) for s in sets]]).astype(np.int64).tobytes() + b"".join(sketches)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*held, heads, np.concatenate(sets).tobytes()), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["_f", "_s", "_b", "_heads", "_sets"])

    for batch in batches:
        sets = batch.column(7)
        for k, row in enumerate(zip(*[batch.column(c).to_pylist() for c in range(7)], strict=True)):
            if row[:3] != held:
                if rows:
                    yield done()
                held, rows = row[:3], []
            rows.append((*row[3:], np.sort(sets[k].values.to_numpy())))
    if rows:
        yield done()


class Block:
    """nodes, components, sizes, numbers of useful hashes, and the sketches as rows of bits."""

    def __init__(self, heads: bytes) -> None:
        n = int(np.frombuffer(heads, np.int64, 1)[0])
        self.nodes, self.comps, self.sizes, self.useful = np.frombuffer(heads, np.int64, 4 * n, 8).reshape(4, n)
        self.sketches = np.frombuffer(heads, np.uint8, -1, 8 + 32 * n).reshape(n, -1)

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.sketches, axis=1).astype(np.float32)


def likely_pairs(one: Block, two: Block, percent: int) -> np.ndarray:
    """For each two nodes whether they may be linked: components, sizes, useful hashes, and the sketches' XOR population count."""
    sa, sb, x, y = one.sizes[:, None], two.sizes[None], one.bits(), two.bits()
    both = np.minimum(one.useful[:, None], two.useful[None])
    ok = (one.comps[:, None] != two.comps[None]) & (100 * np.minimum(sa, sb) >= percent * np.maximum(sa, sb)) & (100 * both >= percent * (sa + sb - both))
    if ok.any():
        ones = x.sum(1)[:, None] + y.sum(1)[None] - 2 * (x @ y.T)
        ok &= similarity(ones) >= SCREEN
    return ok


def _screen_blocks(batches, percent):
    """Which blocks have to meet with their sets, and which of their nodes."""
    for batch in batches:
        keep, rows, cols = [], [], []
        for k, (one, two) in enumerate(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)):
            ok = likely_pairs(Block(one), Block(two), percent)
            if ok.any():
                keep.append(k), rows.append(np.packbits(ok.any(1)).tobytes()), cols.append(np.packbits(ok.any(0)).tobytes())
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(keep, pa.int64())) for c in range(5)], pa.array(rows, pa.binary()), pa.array(cols, pa.binary())], names=["_f", "_s", "_b", "_s2", "_b2", "_rows", "_cols"])


def _picked(heads: bytes, sets: bytes, mask: bytes) -> tuple[Block, np.ndarray, np.ndarray]:
    """A block's nodes within the mask, their hashes, and the row of each hash."""
    block = Block(heads)
    keep = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(block.nodes)).astype(bool)
    hashes = np.frombuffer(sets, np.int64)[np.repeat(keep, block.useful)]
    block.nodes, block.comps, block.sizes, block.useful, block.sketches = (a[keep] for a in (block.nodes, block.comps, block.sizes, block.useful, block.sketches))
    return block, hashes, np.repeat(np.arange(len(block.nodes)), block.useful)


def _compare_blocks(batches, percent):
    """Links between any two nodes of different components of two blocks (or one, with itself); a spanning forest of them."""
    for batch in batches:
        out: list[tuple[int, int]] = []
        for row in range(batch.num_rows):
            rows, cols, one, ones, two, twos = (batch.column(c)[row].as_py() for c in range(6))
            a, ha, ra = _picked(one, ones, rows)
            b, hb, rb = _picked(two, twos, cols)
            both = np.zeros((len(a.nodes), len(b.nodes)), np.float32)
            # only shingles that both have count; some thousand of them at a time
            shared = np.intersect1d(ha, hb)
            for at in range(0, len(shared), 4096):
                some = shared[at : at + 4096]
                both += _incidence(some, ha, ra, len(a.nodes)) @ _incidence(some, hb, rb, len(b.nodes)).T
            ok = likely_pairs(a, b, percent) & (100 * both >= percent * (a.sizes[:, None] + b.sizes[None] - both))
            root: dict[int, int] = {}

            def find(v):
                while root.get(v, v) != v:  # noqa: B023
                    v = root[v]  # noqa: B023
                return v

            for i, j in zip(*np.nonzero(ok), strict=True):
                x, y = find(int(a.comps[i])), find(int(b.comps[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(a.nodes[i]), int(b.nodes[j])))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _incidence(some: np.ndarray, hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(some, hashes), len(some) - 1)
    hit = some[at] == hashes
    x = np.zeros((n, len(some)), np.float32)
    x[rows[hit], at[hit]] = 1
    return x


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, block: int = 512) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets (``percent`` >= 75: the bands and
    the screen are made for that). component_id is the smallest id reachable over links, kept tells that it is the row's own.
    A text of fewer than five words is one shingle; null, empty and white-space-only texts have none and are linked with nothing.
    Rows that share an id are one document. A row with a null id is linked with nothing and kept. Other columns are ignored; an
    empty table gives an empty result. ``block``: nodes that meet in one task in step 4. Intermediate tables are deleted at the end.
    """
    if percent < 75:
        raise ValueError("percent must be 75 or more")
    rows = id_and_text(df, id_col, text_col)
    with temporary(df.sparkSession) as keep:
        signed = keep(written(rows.mapInArrow(_sign, "_id long, _n long, _digest binary, _sketch binary, _keys array<long>"), "near-signatures"))
        nodes = written(signed.where("_digest is not null and _id is not null").groupBy("_digest").agg(F.min("_id").alias("node")), "near-nodes")
        own = signed.join(nodes, [signed._id == nodes.node, signed._digest == nodes._digest]).select("node", "_n", "_sketch", "_keys")
        own = written(own.dropDuplicates(["node", "_keys"]), "near-own")
        # the members of every bucket that has more than one
        slots = own.select("node", F.explode("_keys").alias("key"))
        shared = slots.groupBy("key").agg(F.min("node").alias("_low"), F.max("node").alias("_high")).where("_low < _high")
        shared = written(shared, "near-buckets")  # so that a hot bucket's side of the join can be split
        members = written(slots.join(shared, "key"), "near-members")

        pairs = members.where("node <> _low").select(F.col("_low").alias("a"), F.col("node").alias("b")).distinct()
        sketch = own.select("node", "_n", "_sketch")
        pairs = pairs.join(sketch.toDF("a", "_na", "_sa"), "a").join(sketch.toDF("b", "_nb", "_sb"), "b")
        pairs = written(pairs.where(_sizes_fit("_na", "_nb", percent)).mapInArrow(_screen, "a long, b long"), "near-pairs")
        # only texts that are compared at all travel further
        compared = members.select(F.col("node").alias("_id")).distinct()
        texts = written(rows.join(compared, "_id"), "near-texts")
        links = written(confirmed_links(pairs, texts, percent), "near-links")
        # an id with several texts is one document
        texts_of = signed.where("_digest is not null and _id is not null").groupBy("_id").agg(F.min("_digest").alias("_x"), F.max("_digest").alias("_y"))
        several = written(texts_of.where("_x < _y").select("_id"), "near-several-texts")
        if not several.isEmpty():
            placed = written(signed.join(several, "_id").join(nodes, "_digest").select("_id", "node").distinct(), "near-placed-texts")
            low = written(placed.groupBy("_id").agg(F.min("node").alias("_low")), "near-low-texts")
            links = links.unionByName(placed.join(low, "_id").where("node <> _low").select(F.col("_low").alias("a"), F.col("node").alias("b")))
        labels = written(components(links), "near-labels")
        sketch, seed = sketch.groupBy("node").agg(F.first("_sketch").alias("_sketch")), 0
        while (more := _links_left(members.select("key", "node"), labels, sketch, texts, percent, block, seed)) is not None:
            with temporary(df.sparkSession) as keep_link:
                more = written(more, "near-more")
                sure = keep_link(written(confirmed_links(more, texts, percent), "near-sure"))
                refuted = more.count() - sure.count()
            links = labels.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b").unionByName(sure)
            labels = written(components(links), "near-labels")
            if refuted <= 0:
                break
            seed += 1
        by_text = nodes.join(labels, "node", "left").select("_digest", F.coalesce("component", "node").alias("_component"))
        by_text = keep(written(by_text, "near-components"))
    texts_ = signed.where("_digest is not null and _id is not null").select("_id", "_n", "_digest").join(by_text, "_digest").select("_id", "_n", "_component")
    # what is linked with nothing takes no part in the join, where it would be one key
    alone = signed.where("_digest is null or _id is null").select("_id", "_n", F.col("_id").alias("_component"))
    out = texts_.unionByName(alone)
    names = [free_name(c, [id_col]) for c in ("n_shingles", "component_id", "kept")]
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias(names[0]), F.col("_component").alias(names[1]), F.col("_id").eqNullSafe(F.col("_component")).alias(names[2]))


def _screen(batches):
    """Drops pairs whose sketches say that they are not similar enough."""
    for batch in batches:
        at = {n: k for k, n in enumerate(batch.schema.names)}
        keep = [k for k, (x, y) in enumerate(zip(batch.column(at["_sa"]).to_pylist(), batch.column(at["_sb"]).to_pylist(), strict=True)) if estimated(x, y) >= SCREEN]
        yield pa.RecordBatch.from_arrays([batch.column(at[c]).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])
