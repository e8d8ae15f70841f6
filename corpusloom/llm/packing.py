"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Documents (in pieces of the largest permitted length, when longer) are packed best fit decreasing: a piece goes into the
open bin that it fills best. When none has room, the bin size is opened that costs least for what is still to come: the
cost of a bin of size c is c plus a fixed charge, spread over the words that the pieces still unplaced (the piece itself
and, greedily, the largest that fit beside it) can put into it. At last each bin shrinks to the smallest permitted length
that holds its contents.

Bins are filled within blocks of about ``block_docs`` documents, so the loss is at most the few open bins of each block. Rows that
agree in id and size are interchangeable: they are counted first, and of such a count each ``CHUNK`` copies are dealt to a block
on their own. So an id that many rows share (null, say) does not meet in one task, and the result does not depend on how the
input is partitioned. Blocks are dealt to a number of tasks that follows the rows, several blocks to a task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import partitions_for, word_count, written

CAPACITIES = (512, 1024, 2048, 4096)
#: Copies of one id and size that stay together.
CHUNK = 64


def fill_ahead(rising: list[int], sums: list[int], at: int, room: int) -> int:
    """Words that the pieces from ``at`` on put greedily, largest first, into ``room``.

    ``rising``: the negated sizes of all pieces, largest first; ``sums``: the words before each piece, and of all. A run of
    pieces that fit one after the other is one step; after it less room is left than its last piece took, so steps are few.
    """
    put, k = 0, at
    while room > put and (k := bisect_left(rising, put - room, k)) < len(rising):
        end = bisect_right(sums, sums[k] + room - put, k) - 1
        put += sums[end] - sums[k]
        k = end
    return put


def pack_block(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, charge: int = 16) -> tuple[list[int], list[int], list[int]]:
    """Bin of each size, position of each size in its bin, final length of each bin. ``sizes`` are at most max(capacities)."""
    caps = sorted(capacities)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    rising = [-sizes[i] for i in order]
    sums = [0, *accumulate(sizes[i] for i in order)]
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    used: list[int] = []
    bin_of, start = [0] * len(sizes), [0] * len(sizes)
    for at, i in enumerate(order):
        size = sizes[i]
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            fits = caps[bisect_left(caps, size):]
            left = min(fits, key=lambda c: ((c + charge) / max(1, min(c, fill_ahead(rising, sums, at, c))), c))
            b = len(used)
            used.append(0)
        bin_of[i], start[i] = b, used[b]
        used[b] += size
        if left > size:
            insort(room, (left - size, b))
    return bin_of, start, [caps[bisect_left(caps, u)] for u in used]


def _pack(batches, capacities, charge):
    """Blocks arrive contiguous (sorted); one block is held at a time."""
    top, held, rows = max(capacities), None, []

    def done():
        pieces = [(i, at, min(top, size - at)) for i, size in rows for at in (range(0, size, top) if size else (0,))]
        bins, starts, lengths = pack_block([p[2] for p in pieces], capacities, charge)
        return pa.RecordBatch.from_pydict(
            {
                "_id": pa.array([p[0] for p in pieces], pa.int64()), "_piece_start": pa.array([p[1] for p in pieces], pa.int64()), "_length": pa.array([p[2] for p in pieces], pa.int64()),
                "_bin": pa.array([(held << 24) + b for b in bins], pa.int64()), "_offset": pa.array(starts, pa.int64()), "_capacity": pa.array([lengths[b] for b in bins], pa.int64()),
            }
        )

    for batch in batches:
        for block, i, size, copies in zip(*[batch.column(c).to_pylist() for c in ("_block", "_id", "_size", "_copies")], strict=True):
            if block != held:
                if rows:
                    yield done()
                held, rows = block, []
            rows += [(i, size)] * copies
    if rows:
        yield done()


def pack_best_fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, charge: int = 16, block_docs: int = 2048, size_col: str | None = None) -> DataFrame:
    """One row per piece: id, piece_start, length, bin_id, bin_offset, bin_capacity (sizes in words, or as ``size_col`` says).

    Pieces of a document follow each other by piece_start; a document of at most max(capacities) words is one piece. Empty
    and null texts are one piece of length 0, null or negative sizes count as 0. Within a bin, pieces lie side by side from
    0. Null ids are packed like others, repeated rows each. Blocks are dealt by a hash of id, size and number of the copy, so the
    result does not depend on how the input is partitioned. An empty table gives an empty result.
    """
    size = F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)), F.lit(0)) if size_col else word_count(F.col(f"`{text_col}`").cast("string"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), size.cast("long").alias("_size"))
    rows = written(rows.groupBy("_id", "_size").agg(F.count(F.lit(1)).alias("_n")), "pack-sizes")
    total = rows.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_docs))
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / CHUNK))).alias("_chunk")
    dealt = rows.select("_id", "_size", "_n", chunk).withColumn("_copies", F.least(F.col("_n") - F.col("_chunk") * CHUNK, F.lit(CHUNK)))
    dealt = dealt.select(F.pmod(F.xxhash64("_id", "_size", "_chunk", F.lit(7)), F.lit(blocks)).alias("_block"), "_id", "_size", "_copies")
    dealt = dealt.repartition(min(blocks, partitions_for(rows, total, 1 << 18)), "_block").sortWithinPartitions("_block", "_size", "_id", "_copies")
    packed = dealt.mapInArrow(lambda batches: _pack(batches, capacities, charge), "_id long, _piece_start long, _length long, _bin long, _offset long, _capacity long")
    return packed.select(
        F.col("_id").alias(id_col), F.col("_piece_start").alias("piece_start"), F.col("_length").alias("length"), F.col("_bin").alias("bin_id"), F.col("_offset").alias("bin_offset"), F.col("_capacity").alias("bin_capacity")
    )
