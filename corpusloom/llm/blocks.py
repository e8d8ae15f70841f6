"""Corpus dictionaries joined to documents block by block.

A join of (document, piece) pairs with corpus-wide values of the pieces shuffles every pair. Here a task numbers the distinct
pieces of a *block* (some thousand documents) once; only those distinct pieces travel, dealt by a hash into *parts*, and what
comes back to the block is one value array per part. The documents' own numbers stay in one compressed row per block.

Table ``blocks`` (block, part, n, data): per block one row with part -1 (the documents) and one row per part with its n distinct
pieces and their training counts. The pieces of a block, in part order, are numbered 0, 1, 2, ... in the documents' row.

The number of these parts is the same for any input. Once blocks are written, the pieces in them are counted; where a part would
have more than ``ENTRIES``, ``dictionary`` merges the blocks' rows of a part in groups of blocks, drops what blocks of a group have
in common, and deals the merged pieces to finer parts. The groups are as large as it takes for their rows to hold ``LEAST_ROW``
pieces, so the number of rows grows with the input and not with its square, and a task never holds more than ``ENTRIES`` pieces.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import partitions_for, spread, written

#: Bits of the documents' flags: its pieces count; its id is null (and 0 in the ids).
LEARN, NULL_ID = 1, 2
#: Parts of the blocks themselves.
PARTS = 128
#: Most pieces, counted once for each block or group of blocks that has them, that one part gets.
ENTRIES = 1 << 22
#: Pieces that a row of a group of blocks and a finer part has on average.
LEAST_ROW = 256
ROW = "block long, part int, n int, data binary"


def squeeze(*arrays: np.ndarray, more: bytes = b"") -> bytes:
    """Arrays of int32 (and bytes after them) to one zstd frame; bytes of equal weight lie together, as most high ones are zero."""
    planes = [np.ascontiguousarray(a, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    return zstandard.compress(np.array([len(arrays), *map(len, arrays)], np.int32).tobytes() + b"".join(planes) + more, 1)


def unsqueeze(data: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.decompress(data)
    count = int(np.frombuffer(raw, np.int32, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int32, count, 4), 4 + 4 * count, []
    for n in sizes.tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view(np.int32).ravel())
        at += 4 * n
    return out, raw[at:]


def longs(a: Iterable[int]) -> np.ndarray:
    """int64 as twice as many int32, for ``squeeze``."""
    return np.array(a, np.int64).view(np.int32)


def as_longs(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def ids_of(ids: np.ndarray, flags: np.ndarray) -> pa.Array:
    return pa.array(as_longs(ids), pa.int64(), mask=flags & NULL_ID > 0)


def pack_pieces(pieces: list[bytes], counts: Iterable[int]) -> bytes:
    return squeeze(np.fromiter(map(len, pieces), np.int32, len(pieces)), longs(counts), more=b"".join(pieces))


def unpack_pieces(data: bytes) -> tuple[list[bytes], np.ndarray]:
    (sizes, counts), flat = unsqueeze(data)
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], as_longs(counts)


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "part", "n", "data"])


def make_blocks(df: DataFrame, pieces_of: Callable[[str], list[bytes]], sequences: bool, parts: int = PARTS, most_pieces: int = 1_000_000) -> DataFrame:
    """``df``: _id, _text (not null), _learn (its pieces count). ``pieces_of`` gives a text's pieces in order.

    The documents' row has the arrays ids (longs), sizes (longs: bytes of the text), flags, ends (running number of entries),
    numbers and, unless ``sequences``, times. With ``sequences`` an entry is a piece in its place, else a distinct piece of the
    document (numbers ascending, kept as differences) and how often it occurs. A block ends with the document that brings it to
    ``most_pieces`` pieces. Its id is random, which is safe as the table is written.
    """

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = random.SystemRandom()
        own: dict[bytes, int] = {}
        ids, sizes, flags, numbers = [], [], [], []
        total = 0

        def done():
            keys = list(own)
            part = np.fromiter((xxhash.xxh32_intdigest(k) % parts for k in keys), np.int32, len(keys))
            order = np.argsort(part, kind="stable")
            new = np.empty(len(keys), np.int32)
            new[order] = np.arange(len(keys), dtype=np.int32)
            counts = np.zeros(len(keys), np.int64)
            for flag, n in zip(flags, numbers, strict=True):
                if flag & LEARN:
                    np.add.at(counts, n, 1) if len(n) < 2000 else np.add(counts, np.bincount(n, minlength=len(keys)), out=counts)
            if sequences:
                entries, times = [new[n] for n in numbers], None
            else:
                found = [np.unique(new[n], return_counts=True) for n in numbers]
                entries, times = [np.diff(e, prepend=0) for e, _ in found], np.concatenate([t for _, t in found])
            ends = np.cumsum([len(e) for e in entries])
            docs = squeeze(longs(ids), longs(sizes), np.array(flags), ends, np.concatenate(entries), *([] if times is None else [times]))
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            block, full = rng.getrandbits(62), np.flatnonzero(np.diff(cuts)).tolist()
            order_, counts = order.tolist(), counts[order]
            rows = [(block, -1, 0, docs)]
            for p in full:
                at, end = int(cuts[p]), int(cuts[p + 1])
                rows.append((block, p, end - at, pack_pieces([keys[k] for k in order_[at:end]], counts[at:end])))
            own.clear(), ids.clear(), sizes.clear(), flags.clear(), numbers.clear()
            yield rows_batch(rows)

        for batch in batches:
            for i, text, flag in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                pieces = pieces_of(text)
                for p in pieces:
                    if p not in own:
                        own[p] = len(own)
                numbers.append(np.fromiter(map(own.__getitem__, pieces), np.int32, len(pieces)))
                ids.append(i or 0), sizes.append(len(text.encode())), flags.append(LEARN * bool(flag) + NULL_ID * (i is None))
                total += len(pieces)
                if total >= most_pieces:
                    yield from done()
                    total = 0
        if ids:
            yield from done()

    return written(df.select("_id", "_text", "_learn").mapInArrow(build, ROW), "blocks")


class Dictionary:
    """The pieces of ``blocks`` as rows by part, and the way back of the answers. ``made_with``: the parts of the blocks themselves."""

    def __init__(self, blocks: DataFrame, entries: int = ENTRIES, least_row: int = LEAST_ROW, made_with: int = PARTS) -> None:
        self.blocks, self.coarse, self.merged = blocks, made_with, None
        total, count = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("part") < 0)).first()
        # a task takes parts one after the other, so where they are small it takes several
        self.tasks = max(1, -(-total // entries))
        self.parts = max(made_with, self.tasks)
        if self.parts > made_with:
            self.fine = -(-self.parts // made_with)
            self.parts = self.tasks = self.fine * made_with
            together = max(1, -(-least_row * self.parts * count // total))
            self.merged = self._merge(max(1, -(-count // together)))

    def _merge(self, groups: int) -> DataFrame:
        coarse, fine = self.coarse, self.fine

        def merge(batches):
            """Per group of blocks and part: one row with the blocks' numbers in the merged pieces, and these by finer part."""
            held, taken = None, []

            def done():
                place: dict[bytes, int] = {}
                counts, ids, ends, numbers = np.zeros(0, np.int64), [], [], []
                for block, data in taken:
                    pieces, own = unpack_pieces(data)
                    at = np.fromiter((place.setdefault(p, len(place)) for p in pieces), np.int32, len(pieces))
                    counts = np.concatenate([counts, np.zeros(len(place) - len(counts), np.int64)])
                    counts[at] += own
                    ids.append(block), numbers.append(at), ends.append(len(at))
                keys = list(place)
                part = np.fromiter((xxhash.xxh32_intdigest(k, 1) % fine for k in keys), np.int32, len(keys))
                order = np.argsort(part, kind="stable")
                new = np.empty(len(keys), np.int32)
                new[order] = np.arange(len(keys), dtype=np.int32)
                cuts = np.searchsorted(part[order], np.arange(fine + 1)).tolist()
                key = held[0] * coarse + held[1]
                rows = [(key, -1, 0, squeeze(longs(ids), np.array([held[1]]), np.cumsum(ends), new[np.concatenate(numbers)]))]
                for p in range(fine):
                    if cuts[p] < cuts[p + 1]:
                        some = order[cuts[p] : cuts[p + 1]]
                        rows.append((key, held[1] * fine + p, len(some), pack_pieces([keys[k] for k in some.tolist()], counts[some])))
                return rows_batch(rows)

            for batch in batches:
                for group, part, block, data in zip(*[batch.column(c).to_pylist() for c in ("group", "part", "block", "data")], strict=True):
                    if (group, part) != held:
                        if taken:
                            yield done()
                        held, taken = (group, part), []
                    taken.append((block, data))
            if taken:
                yield done()

        rows = self.blocks.where("part >= 0").select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"), "part", "block", "data")
        rows = rows.repartition(partitions_for(rows, groups * coarse, 64), "group", "part").sortWithinPartitions("group", "part", "block")
        return written(rows.mapInArrow(merge, ROW), "merged-blocks")

    def rows(self) -> DataFrame:
        """(block, part, data): where rows are merged, ``block`` is the group's."""
        return (self.blocks if self.merged is None else self.merged).where("part >= 0").select("block", "part", "data")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows of one part in one task, side by side; those without a block first."""
        return spread(rows, self.tasks, "part").sortWithinPartitions("part", F.col("block").asc_nulls_first())

    def back(self, answers: DataFrame) -> DataFrame:
        """Answers to ``rows`` as answers to the rows of ``blocks``."""
        if self.merged is None:
            return answers

        def split(docs, values):
            blocks, part, ends, numbers = docs
            rows = [(b, int(part[0]), 0, squeeze(*[v[numbers[a:e]] for v in values])) for b, a, e in zip(as_longs(blocks).tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield rows_batch(rows).select(["block", "part", "data"])

        return with_answers(self.merged, answers, split, "block long, part int, data binary")


def answered(rows: DataFrame, answer: Callable) -> DataFrame:
    """``answer`` makes of (block, part, data) batches tuples (block, part, bytes of a ``squeeze``)."""

    def run(batches):
        for batch in batches:
            out = list(answer(*[batch.column(c).to_pylist() for c in range(3)]))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "part", "data"])

    return rows.mapInArrow(run, "block long, part int, data binary")


def with_answers(blocks: DataFrame, answers: DataFrame, rows_of: Callable, schema: str) -> DataFrame:
    """Joins value arrays back to the blocks' documents.

    ``rows_of(docs, values)`` gives RecordBatches of ``schema`` for one block: the arrays of its documents' row, and its answers'
    arrays over all its pieces.
    """
    docs_ = blocks.where("part = -1").select("block", "part", "data")
    rows = docs_.unionByName(answers).repartition(partitions_for(blocks, docs_.count(), 32), "block").sortWithinPartitions("block", "part")

    def finish(batches):
        held, docs, got = None, None, []

        def done():
            return rows_of(docs, [np.concatenate(x) for x in zip(*got, strict=True)])

        for batch in batches:
            for block, part, data in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                if block != held:
                    if held is not None:
                        yield from done()
                    held, got = block, []
                if part < 0:
                    docs = unsqueeze(data)[0]
                else:
                    got.append(unsqueeze(data)[0])
        if held is not None:
            yield from done()

    return rows.mapInArrow(finish, schema)
