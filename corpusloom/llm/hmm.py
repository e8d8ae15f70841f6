"""Hidden Markov language model over word classes, with counts of the whole corpus.

A text is a sequence of words and one end. Every token belongs to a class: the most frequent tokens of the training part have a
class of their own, all others share classes by a hash of their last bytes. Latent states emit classes; within a shared class a
token has its smoothed share of the training counts. The likelihood of a text is then

    sum over state paths of  prod  transition * P(class | state)   times   prod  P(token | class),

computed exactly by the scaled forward recursion. Token counts come from all training texts, joined to the documents block by
block (see ``blocks``). Baum-Welch starts from states that are groups of classes with like neighbours, as counted in all training
sequences, and each iteration runs over all of them: blocks add up counts, groups of blocks add those up, and only the groups' sums
reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import ENTRIES, LEARN, Dictionary, answered, ids_of, make_blocks, pack_pieces, squeeze, unpack_pieces, unsqueeze, with_answers
from corpusloom.llm.scratch import free_name, written

#: No word holds white space, so this is no word.
END = b"\n"
STATES = 6
#: Classes of single tokens and classes shared by a hash of the last bytes.
OWN, SHARED = 2048, 1024
#: How the last bytes are cut: enough to tell endings apart.
TAIL = 3
#: Classes are counted by their neighbours' class modulo this. The most frequent tokens have the lowest classes, so they differ in it.
NEAR = 64
#: Sums of counts that reach the driver at most.
FEW = 8


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def shared_class(token: bytes) -> int:
    return OWN + xxhash.xxh32_intdigest(token[-TAIL:]) % SHARED


class Model:
    """start (S), move (S x S), emit (classes x S): probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """Expected counts, each plus a small prior, so that nothing is impossible."""
        emit = emit + 0.01
        return Model((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(1, keepdims=True), emit / emit.sum(0))


def _lockstep(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences by falling length, and how many are longer than t, for each t."""
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
    return order, active


def forward(model: Model, classes: np.ndarray, ends: np.ndarray, backward: bool = False):
    """Natural log likelihood of each sequence; with ``backward``, instead the expected counts (start, move, emit) and their sum.

    All sequences of a block advance together, one position at a time; probabilities are rescaled to sum 1 at each position.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    lengths = ends - starts
    order, active = _lockstep(lengths)
    first = starts[order]
    logs = np.zeros(len(ends))
    alphas, seen = [], []
    alpha = np.broadcast_to(model.start, (len(ends), len(model.start)))
    for t, n in enumerate(active):
        at = classes[first[:n] + t]
        alpha = (alpha[:n] @ model.move if t else alpha[:n]) * model.emit[at]
        scale = alpha.sum(1)
        alpha = alpha / scale[:, None]
        logs[:n] += np.log(scale)
        if backward:
            alphas.append(alpha.astype(np.float32))
            seen.append((at, scale))
    if not backward:
        out = np.empty(len(ends))
        out[order] = logs
        return out
    states = len(model.start)
    start, move = np.zeros_like(model.start), np.zeros_like(model.move)
    gammas = np.empty((len(classes), states), np.float32)
    beta, filled = np.zeros((0, states)), 0
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        beta = np.concatenate([beta, np.ones((n - len(beta), states))])
        at, scale = seen[t]
        gammas[filled : filled + n] = gamma = alphas[t] * beta
        filled += n
        if t:
            out = beta * model.emit[at] / scale[:, None]
            move += alphas[t - 1][:n].T @ out
            beta = out @ model.move.T
        else:
            start += gamma.sum(0)
    met = np.concatenate([at for at, _ in reversed(seen)]) if seen else np.zeros(0, np.int64)
    emit = np.stack([np.bincount(met, gammas[:, s], len(model.emit)) for s in range(states)], 1)
    return start, move * model.move, emit, float(logs.sum())


def neighbours(classes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per class: how often the class modulo ``NEAR`` comes next in a sequence, how often before, and how often the class occurs."""
    follows = np.ones(len(classes), bool)
    follows[ends - 1] = False
    at = np.flatnonzero(follows)
    one, two = classes[at].astype(np.int64), classes[at + 1].astype(np.int64)
    after, before = (np.bincount(a * NEAR + b % NEAR, minlength=(OWN + SHARED) * NEAR).reshape(-1, NEAR) for a, b in ((one, two), (two, one)))
    return after, before, np.bincount(classes, minlength=OWN + SHARED)


def initial(after: np.ndarray, before: np.ndarray, times: np.ndarray, states: int, rounds: int = 30) -> Model:
    """A start from the ``neighbours`` of all sequences: k-means on square roots of shares, where a class weighs what it occurs.

    A state emits the classes of its group by their counts and three tenths of the others', and mostly follows itself.
    """
    near, weight = np.concatenate([after, before], 1), times[:, None]
    shares = np.sqrt((near + near.sum(0) / max(1, near.sum())) / (near.sum(1, keepdims=True) + 1))
    # the heaviest class far from the mean first, then those far from all before
    apart = ((shares - (weight * shares).sum(0) / max(1, times.sum())) ** 2).sum(1)
    centres = np.zeros((states, shares.shape[1]))
    for s in range(states):
        centres[s] = shares[(times * apart).argmax()]
        apart = np.minimum(apart if s else np.inf, ((shares - centres[s]) ** 2).sum(1))
    for _ in range(rounds):
        group = (shares @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        centres = np.stack([(weight * shares)[group == s].sum(0) / n if (n := times[group == s].sum()) else centres[s] for s in range(states)])
    emit = weight * np.where(group[:, None] == np.arange(states), 1.0, 0.3)
    # states that begin alike would stay alike
    emit *= 1 + 0.2 * np.random.default_rng(3).random(emit.shape)
    return Model.from_counts(np.ones(states), 50.0 * np.eye(states) + 1, emit)


def hmm_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_on: Column | None = None, states: int = STATES, iterations: int = 4, entries: int = ENTRIES) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    ``train_on`` (of the id column; all rows, if None) tells the rows that are learned from; held_out is the rest. base_score
    is the add-one unigram model's. Null and empty texts are just their end. The start of Baum-Welch, each of its ``iterations``
    and all counts use every training row. Null ids follow ``train_on`` as it evaluates (null: held out); rows that share an id
    are scored each. Other columns are ignored; an empty table gives an empty result. ``entries``: see ``blocks``.
    """
    spark = df.sparkSession
    flag = F.lit(True) if train_on is None else F.coalesce(train_on, F.lit(False))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"), flag.alias("_learn"))
    blocks = make_blocks(rows, lambda text: tokens_of(text.encode()), sequences=True)
    pieces_of = Dictionary(blocks, entries)

    def totals(batches):
        """Training counts of each token of a part; a part's rows come side by side, and one part is held at a time."""
        held, own = None, {}

        def done():
            keys, counts, part = list(own), list(own.values()), held
            for at in range(0, len(keys), 50_000):
                k = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(k), pa.int32()), pa.array(k, pa.binary()), pa.array(counts[at : at + 50_000], pa.int64()), pa.array([shared_class(x) for x in k], pa.int32())], names=["part", "token", "n", "class"])

        for batch in batches:
            for part, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if part != held:
                    yield from done()
                    held, own = part, {}
                pieces, counts = unpack_pieces(data)
                for p, c in zip(pieces, counts.tolist(), strict=True):
                    if c:
                        own[p] = own.get(p, 0) + c
        yield from done()

    counted = written(pieces_of.dealt(pieces_of.rows()).mapInArrow(totals, "part int, token binary, n long, class int"), "lm-counts")
    n_all, v_all = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # the most frequent tokens: a histogram of the counts by powers of two tells which tokens need not be ordered
    power = F.floor(F.log2(F.col("n").cast("double")))
    least, seen = 0, 0
    for r in sorted(counted.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("v")).collect(), key=lambda r: -r.p):
        least, seen = r.p, seen + r.v
        if seen >= OWN:
            break
    top = counted.where(power >= least).orderBy(F.desc("n"), "token").limit(OWN).collect()
    own = {bytes(r.token): k for k, r in enumerate(top)}
    in_class = {r["class"]: (r.n, r.v) for r in counted.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    size = np.zeros((OWN + SHARED, 2), np.int64)
    for c, (n, v) in in_class.items():
        size[c] = n, v
    for r in top:
        size[r["class"]] -= (r.n, 1)
    sent = spark.sparkContext.broadcast((own, size))

    def answer(block_ids, part_ids, packed):
        """First a part's counts, then, for each block, what it asked: count and class of every piece."""
        own, _ = sent.value
        for block, part, data in zip(block_ids, part_ids, packed, strict=True):
            pieces, counts = unpack_pieces(data)
            if part != state.get("part"):
                state["part"], state["known"] = part, {}
            if block is None:
                state["known"].update(zip(pieces, counts.tolist(), strict=True))
            else:
                n = np.array([state["known"].get(p, 0) for p in pieces], np.int64)
                classes = [own[p] if p in own else shared_class(p) for p in pieces]
                yield block, part, squeeze(n >> 31, n & 0x7FFFFFFF, np.array(classes))

    state: dict = {}

    def packed_rows(batches):
        for batch in batches:
            part = batch.column(0).to_numpy()
            for cut in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                if len(cut):
                    some = batch.slice(int(cut[0]), len(cut))
                    data = pack_pieces(some.column(1).to_pylist(), some.column(2).to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([int(part[cut[0]])], pa.int32()), pa.array([data], pa.binary())], names=["block", "part", "data"])

    known = counted.select("part", "token", "n").mapInArrow(packed_rows, "block long, part int, data binary")
    both = pieces_of.dealt(pieces_of.rows().unionByName(known))

    def rows_of(docs, values):
        """Per block: sums over the documents' tokens that need no model, and the sequences of classes."""
        ids, _, flags, ends, numbers = docs
        n, classes = (values[0].astype(np.int64) << 31) + values[1], values[2]
        _, size = sent.value
        starts = np.concatenate([[0], ends[:-1]])

        def sums(of_piece):
            run = np.concatenate([[0], np.cumsum(of_piece[numbers])])
            return pa.array([(run[ends] - run[starts]).tolist()])

        log = np.log10(n + 1.0)
        inside = np.where(classes < OWN, 0.0, log - np.log10(size[classes].sum(1) + 1.0))
        cols = [pa.array([squeeze(ids, flags, ends, classes[numbers])], pa.binary()), sums((n > 0).astype(np.int64)), sums(log - np.log10(n_all + v_all + 1.0)), sums(inside)]
        yield pa.RecordBatch.from_arrays(cols, names=["docs", "known", "base", "inside"])

    ready = with_answers(blocks, pieces_of.back(answered(both, answer)), rows_of, "docs binary, known array<long>, base array<double>, inside array<double>")
    ready = written(ready, "lm-sequences")
    final = spark.sparkContext.broadcast(trained(ready, states, iterations))

    def score(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                (ids, flags, ends, classes), _ = unsqueeze(batch.column(0)[row].as_py())
                known, base, inside = (batch.column(c)[row].values for c in (1, 2, 3))
                logs = forward(final.value, classes, ends) / np.log(10) + inside.to_numpy()
                sizes = np.diff(ends, prepend=0).astype(np.int64)
                cols = [ids_of(ids, flags), pa.array(flags & LEARN == 0), pa.array(sizes), known, base, pa.array(logs)]
                yield pa.RecordBatch.from_arrays(cols, names=["_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = ready.mapInArrow(score, "_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double").withColumn("train_tokens", F.lit(n_all).cast("long"))
    return out.select(F.col("_id").alias(id_col), *[F.col(c).alias(free_name(c, [id_col])) for c in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")])


def training_part(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Classes and ends of a block's training sequences."""
    (_, flags, ends, classes), _ = unsqueeze(data)
    keep = flags & LEARN > 0
    sizes = np.diff(ends, prepend=0)
    return classes[np.repeat(keep, sizes)], np.cumsum(sizes[keep])


def trained(ready: DataFrame, states: int, iterations: int) -> Model:
    """Baum-Welch, its start included, over all training sequences."""
    spark = ready.sparkSession
    blocks = max(1, ready.count())
    model = initial(*_summed(ready, neighbours, blocks, [(OWN + SHARED, NEAR), (OWN + SHARED, NEAR), (OWN + SHARED,)]), states)
    for _ in range(iterations):
        sent = spark.sparkContext.broadcast(model)
        expected = _summed(ready, lambda *part, sent=sent: forward(sent.value, *part, backward=True)[:3], blocks, [(states,), (states, states), (OWN + SHARED, states)])
        model = Model.from_counts(*expected)
    return model


def _summed(ready: DataFrame, counts_of: Callable, blocks: int, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """Counts (of these shapes) over all training sequences: summed in tasks, then twice in groups, at last the sums of a few groups on the driver."""
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])
    groups = int(np.ceil(np.sqrt(blocks)))

    def batch_of(group: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([zstandard.compress(total.tobytes())], pa.binary())], names=["g", "sums"])

    def count(batches):
        total = np.zeros(cuts[-1])
        for batch in batches:
            for data in batch.column(0).to_pylist():
                classes, ends = training_part(data)
                if len(ends):
                    total += np.concatenate([x.ravel() for x in counts_of(classes, ends)])
        yield batch_of(TaskContext.get().partitionId() % groups, total)

    def add(batches):
        total, group = np.zeros(cuts[-1]), None
        for batch in batches:
            for g, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += np.frombuffer(zstandard.decompress(data))
                group = g
        if group is not None:
            yield batch_of(group % FEW, total)

    sums = ready.select("docs").mapInArrow(count, "g int, sums binary").repartition(groups, "g").mapInArrow(add, "g int, sums binary")
    if groups > FEW:
        sums = sums.repartition(FEW, "g").mapInArrow(add, "g int, sums binary")
    sums = sums.select("sums").collect()
    total = np.sum([np.frombuffer(zstandard.decompress(r.sums)) for r in sums], axis=0) if sums else np.zeros(cuts[-1])
    return [x.reshape(s) for x, s in zip(np.split(total, cuts[:-1]), shapes, strict=True)]
