"""Exact top-k search by inner product with KD-trees per shard.

Vectors are dealt to cells, the leaves of a small KD-tree that median splits of a bounded sample make (at most ``CELLS``), and
within a cell to shards by a hash of their id. Each shard is a KD-tree: median splits along the widest side, down to small leaves
with tight bounding boxes. A query visits leaves best first, by the largest inner product that a leaf's box allows, and stops at
the first leaf whose bound is below its k-th best score. That k-th score is propagated: every query first meets one shard of its
own cell, then the others of its cell, then those of other cells, and takes the k-th score so far along as the bound that a box has
to reach; cells whose box cannot reach it for any query of a block are not visited at all. Queries travel in blocks of bounded
size to shards of bounded size by an equi-join on the shard; the partial lists are merged per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.scratch import free_name, partitions_for, written

LEAF = 64
#: Cells at most, and sampled rows for each; their boxes and splits are all that is sent to every task.
CELLS, SAMPLED = 256, 64
#: No score is below this.
NO_BOUND = -(2**63)


class Tree:
    """Points in leaf order with the boxes of the leaves; ids and points are parallel."""

    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        order: list[np.ndarray] = []

        def split(rows: np.ndarray) -> None:
            if len(rows) <= LEAF:
                order.append(rows)
                return
            own = points[rows]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            half = len(rows) // 2
            by = np.argpartition(own[:, axis], half)
            split(rows[by[:half]])
            split(rows[by[half:]])

        split(np.arange(len(ids)))
        self.ids, self.points = ids[np.concatenate(order)], points[np.concatenate(order)]
        self.ends = np.cumsum([len(o) for o in order])
        starts = self.ends - [len(o) for o in order]
        self.starts = starts
        self.low = np.minimum.reduceat(self.points, starts)
        self.high = np.maximum.reduceat(self.points, starts)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and leaf the largest inner product with any point of the leaf's box, or a little more."""
        return bounds(queries, self.low, self.high)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """(score, id) of each query's best k points with a score of at least ``least``, its own id left out."""
        limits = self.bounds(queries)
        best_first = np.argsort(-limits, axis=1, kind="stable")
        found = []
        for q in range(len(queries)):
            floor, scores, ids = int(least[q]), np.zeros(0, self.points.dtype), np.zeros(0, np.int64)
            order, at, step = best_first[q], 0, 2
            while at < len(order) and limits[q, order[at]] >= floor:
                # a few leaves at a time, as many again each time
                leaves = order[at : at + step]
                leaves = leaves[limits[q, leaves] >= floor]
                rows = np.concatenate([np.arange(self.starts[x], self.ends[x]) for x in leaves])
                rows = rows[self.ids[rows] != query_ids[q]]
                scores, ids = np.concatenate([scores, self.points[rows] @ queries[q]]), np.concatenate([ids, self.ids[rows]])
                keep = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[keep], ids[keep]
                if len(scores) == k:
                    floor = max(floor, int(scores[-1]))
                at += step
                step *= 2
            found.append([(int(s), int(i)) for s, i in zip(scores, ids, strict=True) if s >= least[q]])
        return found


class Cells:
    """Median splits of a sample: for each vector length a full binary tree of (axis, value), cells numbered by its leaves."""

    def __init__(self, sample: dict[int, np.ndarray], depth: int) -> None:
        self.depth, self.trees = depth, {}
        for d, points in sample.items():
            axes, values, parts = np.zeros((1 << depth) - 1, int), np.zeros((1 << depth) - 1, np.int64), [points]
            for node in range(len(axes) if d else 0):
                own = parts[node]
                if len(own):
                    axes[node] = int(np.argmax(own.max(0) - own.min(0)))
                    values[node] = np.partition(own[:, axes[node]], len(own) // 2)[len(own) // 2]
                right = own[:, axes[node]] >= values[node]
                parts += [own[~right], own[right]]
            self.trees[d] = axes, values

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each row; lengths that the sample lacks are all in cell 0."""
        node = np.zeros(len(points), int)
        if points.shape[1] and points.shape[1] in self.trees:
            axes, values = self.trees[points.shape[1]]
            for _ in range(self.depth):
                node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] >= values[node])
            return node - ((1 << self.depth) - 1)
        return node


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """In float64. Of integers too large for it to be exact, the bound is raised by what rounding can lose; it cannot overflow."""
    q, low_, high_ = (a.astype(np.float64) for a in (queries, low, high))
    out = np.maximum(q, 0) @ high_.T + np.minimum(q, 0) @ low_.T
    if queries.dtype != np.float64:
        out += np.abs(q) @ np.maximum(np.abs(low_), np.abs(high_)).T * (q.shape[1] + 4) * 2.0**-52
    return out


def _numbers(points: np.ndarray, most: int) -> np.ndarray:
    """As float64 where every inner product stays exact, else as int64."""
    return points.astype(np.float64) if most * most * max(1, points.shape[1]) < 2**53 else points


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None, k: int = 20, scale: float = 64.0, shard_rows: int = 2048, block_rows: int = 512) -> DataFrame:
    """The k rows with the highest scores of each query: query_id, rank (from 1), the id, score; ties go to the smaller id.

    Components become floor(scale * x); the score is the integer inner product. ``queries`` tells which rows are queries (all,
    if None); a query is never its own candidate, nor is any row with its id. Rows with a null id, a null vector or a null or
    non-finite component take no part; only vectors of the same length are compared. Repeated rows are candidates each, however
    many share an id; a run of them longer than a shard is cut into several trees. Scores must fit in a long. An empty table
    gives an empty result.
    """
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    good = F.col("_id").isNotNull() & F.col("_x").isNotNull() & F.forall("_x", lambda c: F.coalesce((c == c) & (F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), x.alias("_x"), (F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))).alias("_query"))
    rows = written(rows.where(good).select("_id", "_query", F.size("_x").alias("_d"), F.transform("_x", lambda c: F.floor(c * scale).cast("long")).alias("_v")), "knn-vectors")
    count, asked_n = rows.agg(F.count(F.lit(1)), F.count_if("_query")).first()
    shards = max(1, -(-count // shard_rows))
    depth = int(np.log2(max(1, min(CELLS, shards, -(-asked_n // block_rows)))))
    each = max(1, -(-shards // (1 << depth)))  # shards of a cell
    draw, wanted = F.pmod(F.xxhash64("_id", "_v", F.lit(9)), F.lit(1 << 30)), SAMPLED << depth
    sample: dict[int, list] = {}
    for r in rows.where(draw < int(min(1.0, 2 * wanted / max(1, count)) * (1 << 30))).orderBy(draw).limit(wanted).collect() if depth else []:
        sample.setdefault(r._d, []).append(r._v)
    cells = Cells({d: np.array(v, np.int64).reshape(len(v), d) for d, v in sample.items()}, depth)

    def assign(batches):
        for batch in batches:
            lengths, cell = np.array(batch.column(2)), np.zeros(batch.num_rows, np.int32)
            for d in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == d)
                cell[own] = cells.of(batch.column(3).take(pa.array(own)).flatten().to_numpy().reshape(len(own), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["_id", "_query", "_d", "_v", "_cell"])

    dealt = rows.select("_id", "_query", "_d", "_v").mapInArrow(assign, "_id long, _query boolean, _d int, _v array<long>, _cell int")
    dealt = dealt.withColumn("_shard", (F.col("_cell") * each + F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(each))).cast("int"))

    def pack(batches):
        """One row per run of a shard (and vector length) of at most 2 * shard_rows rows: its number, ids and components as bytes."""
        held, ids, vectors, runs = None, [], [], 0

        def done():
            nonlocal runs
            runs += 1
            v = np.array(vectors, np.int64).reshape(len(ids), held[1])
            return pa.RecordBatch.from_pydict(
                {"_shard": pa.array([held[0]], pa.int32()), "_d": pa.array([held[1]], pa.int32()), "_run": pa.array([runs], pa.int64()), "_ids": [np.array(ids, np.int64).tobytes()], "_points": [v.tobytes()]}
            )

        for batch in batches:
            for shard, d, i, v in zip(*[batch.column(c).to_pylist() for c in ("_shard", "_d", "_id", "_v")], strict=True):
                if held != (shard, d) or len(ids) >= 2 * shard_rows:
                    if ids:
                        yield done()
                    held, ids, vectors = (shard, d), [], []
                ids.append(i)
                vectors.append(v)
        if ids:
            yield done()

    packed = "_shard int, _d int, _run long, _ids binary, _points binary"
    sets = dealt.repartition(min(each << depth, partitions_for(rows, count, 1 << 17)), "_shard").sortWithinPartitions("_shard", "_d", "_id").mapInArrow(pack, packed)
    sets = written(sets, "knn-shards")

    def boxes(batches):
        """The box of each cell and vector length that a task sees."""
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for cell, d, low, high in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                low, high = (np.frombuffer(x, np.int64).reshape(-1, d) for x in (low, high))
                if d:
                    a, b = low.min(0), high.max(0)
                    old = held.get((cell, d), (a, b))
                    held[cell, d] = np.minimum(old[0], a), np.maximum(old[1], b)
        yield pa.RecordBatch.from_pydict(
            {"_cell": pa.array([c for c, _ in held], pa.int32()), "_d": pa.array([d for _, d in held], pa.int32()), "_low": pa.array([a.tobytes() for a, _ in held.values()], pa.binary()), "_high": pa.array([b.tobytes() for _, b in held.values()], pa.binary())}
        )

    box = "_cell int, _d int, _low binary, _high binary"
    known = sets.select(F.floor(F.col("_shard") / each).cast("int"), "_d", "_points", F.col("_points").alias("_same")).mapInArrow(boxes, box).repartition("_cell", "_d").mapInArrow(boxes, box)
    frames = {(r._cell, r._d): (np.frombuffer(r._low, np.int64)[None], np.frombuffer(r._high, np.int64)[None]) for r in known.collect()}  # one a cell and length
    asked = dealt.where("_query")
    homes = max(1, -(-asked_n // (block_rows << depth)))
    asked = asked.withColumn("_home", (F.col("_cell") * homes + F.pmod(F.xxhash64("_id", F.lit(6)), F.lit(homes))).cast("int"))

    def blocks(batches, first: int, last: int, others: bool):
        """Queries of one home and length in blocks (ids, components, least scores), once for each shard to visit.

        Shards ``first`` to ``last`` - 1 of the own cell, counted from one that the home tells; or all of other cells whose box
        allows a query of the block its least score.
        """
        held, ids, vectors, least = None, [], [], []

        def done():
            home, d = held
            cell, q, floor = home // homes, np.array(vectors, np.int64).reshape(len(ids), d), np.array(least, np.int64)
            if others:
                to = [c for (c, n), (low, high) in frames.items() if n == d and c != cell and (bounds(q, low, high)[:, 0] >= floor).any()]
                shards_ = [c * each + k for c in to for k in range(each)]
            else:
                shards_ = [cell * each + (home + k) % each for k in range(first, last)]
            block = [np.array(ids, np.int64).tobytes(), q.tobytes(), floor.tobytes()]
            for at in range(0, len(shards_), 64):
                some = shards_[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([d] * len(some), pa.int32()), *[pa.array([x] * len(some), pa.binary()) for x in block]], names=["_shard", "_d", "_qids", "_q", "_least"])

        for batch in batches:
            for home, d, i, v, x in zip(*[batch.column(c).to_pylist() for c in ("_home", "_d", "_id", "_v", "_floor")], strict=True):
                if held != (home, d) or len(ids) >= block_rows:
                    if ids:
                        yield from done()
                    held, ids, vectors, least = (home, d), [], [], []
                ids.append(i)
                vectors.append(v)
                least.append(NO_BOUND if x is None else x)
        if ids:
            yield from done()

    block = "_shard int, _d int, _qids binary, _q binary, _least binary"

    def visit(batches):
        tree, held = None, None
        for batch in batches:
            out: list[tuple] = []
            for r in range(batch.num_rows):
                shard, d, run, ids, points, qids, q, least = (batch.column(c)[r].as_py() for c in ("_shard", "_d", "_run", "_ids", "_points", "_qids", "_q", "_least"))
                asks = np.frombuffer(q, np.int64).reshape(-1, d)
                # a shard lies in one task of pack(), so these three name a run
                if held != (shard, d, run):
                    held = (shard, d, run)
                    v = np.frombuffer(points, np.int64).reshape(-1, d)
                    own, top = np.frombuffer(ids, np.int64), int(np.abs(v).max(initial=0))
                    tree = Tree(own, v) if d else None
                if tree is None:
                    continue
                most = max(top, int(np.abs(asks).max(initial=0)))
                tree.points, tree.low, tree.high = (_numbers(a, most) if most * most * d < 2**53 else a.astype(np.int64) for a in (tree.points, tree.low, tree.high))
                asks_ = _numbers(asks, most)
                for qi, got in zip(np.frombuffer(qids, np.int64).tolist(), tree.search(np.frombuffer(qids, np.int64), asks_, np.frombuffer(least, np.int64), k), strict=True):
                    out += [(qi, i, s) for s, i in got]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["_query", "_vec", "_score"])

    result = "_query long, _vec long, _score long"

    def best(found: DataFrame) -> DataFrame:
        """The k best of each query; tasks cut their lists to k before the shuffle."""
        order = Window.partitionBy("_query").orderBy(F.desc("_score"), "_vec")
        return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)

    # one shard of the own cell, the cell's others, other cells, each time with the k-th score so far as the bound
    found = None
    for first, last, others in ((0, 1, False), (1, each, False), (0, 0, True)):
        if not others and first >= last or others and not depth:
            continue
        if found is None:
            floors = asked.withColumn("_floor", F.lit(None).cast("long"))
        else:
            kth = found.where(F.col("_rank") == k).select(F.col("_query").alias("_id"), F.col("_score").alias("_floor"))
            floors = asked.drop("_query").join(kth, "_id", "left")
        floors = floors.select("_home", "_d", "_id", "_v", "_floor")
        visits = floors.repartition("_home").sortWithinPartitions("_home", "_d", "_id").mapInArrow(lambda it, a=first, b=last, o=others: blocks(it, a, b, o), block)
        more = visits.join(sets, ["_shard", "_d"]).mapInArrow(visit, result)
        found = written(best(more if found is None else found.drop("_rank").unionByName(more)), "knn-best")
    names = [free_name(n, [id_col]) for n in ("query_id", "rank", "score")]
    return found.select(F.col("_query").alias(names[0]), F.col("_rank").cast("int").alias(names[1]), F.col("_vec").alias(id_col), F.col("_score").alias(names[2]))
