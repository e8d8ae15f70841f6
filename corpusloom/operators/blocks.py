"""Pairs of words counted, and joined to values of their words, block by block.

A row for each pair in a shuffle spells both words out, and a corpus has nearly as many different pairs as tokens. Here a task numbers
the words of a *block* (some million tokens or pairs), works on the numbers, and ships its sums in *parts*: one row per block and part,
in which each word is spelled once. A part is chosen by the longer word of a pair, as that is mostly the rarer one and brings few
pairs, and by four classes of the other word, so that no word, however frequent, has all its pairs in one part.

The number of parts follows the input, and so what a task holds does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from corpusloom.sources.scratch import written

#: Most tokens, and most pairs, of a block; one document is never cut.
TOKENS, PAIRS = 3 << 20, 1 << 21
#: Rows of a table that every task may hold.
SMALL = 100_000
#: Rows of an Arrow batch that goes back to Spark.
BATCH = 1 << 16
#: Part of the rows that hold a block's own numbers, and of those that hold its sums by key.
OWN, TOTALS = -1, -2
ROW = "block long, part int, data binary"


def parts_for(df: DataFrame, bytes_each: int = 2 << 20) -> int:
    """Number of parts for an input of this size."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(64, min(8192, size // bytes_each))


def packed(columns: dict[str, pa.Array]) -> bytes:
    """Arrays of any lengths as one compressed Arrow message, whole numbers in as few bytes as they need."""
    small = {}
    for name, a in columns.items():
        if pa.types.is_integer(a.type) and name.startswith("_") and len(a) and not a.null_count:
            v = a.to_numpy(zero_copy_only=False)
            a = pa.array(v.astype(np.promote_types(np.min_scalar_type(v.min()), np.min_scalar_type(v.max()))))
        a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
        small[name] = pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    batch = pa.record_batch(small)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> dict[str, pa.Array]:
    with pa.ipc.open_stream(pa.py_buffer(data)) as stream:
        batch = stream.read_next_batch()
    return {name: batch.column(name).flatten() for name in batch.schema.names}


def _numbers(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(np.int64)


def _numbered(arrays: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """Distinct values of all arrays (null is one), and each array as numbers of these."""
    whole = pa.concat_arrays(arrays)
    coded = pc.dictionary_encode(whole, null_encoding="encode")
    return coded.dictionary, np.split(_numbers(coded.indices), np.cumsum([len(a) for a in arrays])[:-1])


def _tuples(columns: list[pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's tuple of values, and the first row of each tuple."""
    code = np.zeros(n, np.int64)
    for column in columns:
        values, (one,) = _numbered([column])
        code = np.unique(code * max(1, len(values)) + one, return_inverse=True)[1].astype(np.int64)
    return code, np.unique(code, return_index=True)[1]


def _hashes(values: pa.Array) -> np.ndarray:
    """The same in all processes."""
    as_text = values if pa.types.is_string(values.type) else pa.array([None if v is None else str(v) for v in values.to_pylist()], pa.string())
    return pd.util.hash_array(as_text.fill_null("\0").to_numpy(zero_copy_only=False), categorize=False)


def _key_hashes(columns: list[pa.Array], n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for column in columns:
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ _hashes(column)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _part_of_pairs(words: pa.Array, lo: np.ndarray, hi: np.ndarray, key_hash: np.ndarray, parts: int) -> np.ndarray:
    h, size = _hashes(words), _numbers(pc.utf8_length(words))
    longer = np.where(size[lo] > size[hi], lo, hi)
    other = h[lo + hi - longer] & np.uint64(3)
    return (_mixed(h[longer] ^ key_hash + other * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int16)


def _sums(code: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sums of their values."""
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(values[order], first) if len(code) else values


def _batches(rows: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    yield from pa.table(rows).to_batches(max_chunksize=BATCH)


def _blocks(batches: Iterable[pa.RecordBatch], weight, most: int) -> Iterator[pa.Table]:
    """Rows in blocks of ``most`` at the most, as ``weight(batch)`` weighs them; a row is never cut."""
    held, sum_held = [], 0
    for batch in batches:
        ends = np.cumsum(weight(batch))
        at = 0
        while at < batch.num_rows:
            room = most - sum_held + (ends[at - 1] if at else 0)
            to = int(np.searchsorted(ends, room, "right"))
            if to <= at and not held:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                sum_held += int(ends[to - 1] - (ends[at - 1] if at else 0))
                at = to
            if at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, sum_held = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def _counted(table: pa.Table, keys: list[str], width: int, pad: str, parts: int) -> Iterator[dict]:
    """Sums of a block's pairs, one dict of arrays for each part."""
    lists = _whole(table.column("tokens"))
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    if not len(flat):
        return
    coded = pc.dictionary_encode(flat)
    order = _numbers(pc.sort_indices(coded.dictionary))
    words = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order) + 1, np.int64)
    rank[order] = np.arange(len(order))
    rank[-1] = -1
    token = rank[_numbers(coded.indices.fill_null(-1))]
    at_pad = pc.index(words, pa.scalar(pad, words.type)).as_py()
    if at_pad >= 0:
        token[token == at_pad] = -1
    columns = [_whole(table.column(f"_k{i}")) for i in range(len(keys))]
    key, firsts = _tuples(columns, len(lengths))
    v, k, bits = len(words), len(firsts), (2 * width).bit_length()
    if v * v * k >= 1 << (63 - bits) and table.num_rows > 1:
        half = table.num_rows // 2
        yield from _counted(table.slice(0, half), keys, width, pad, parts)
        yield from _counted(table.slice(half), keys, width, pad, parts)
        return
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    pos = np.arange(len(token), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    last, high = np.repeat(lengths - 1, lengths), np.repeat(key, lengths) * v
    found = []
    for d in range(1, 2 * width + 1):
        a, b = token[:-d], token[d:]
        ok = np.flatnonzero((doc[:-d] == doc[d:]) & (a != b) & (a >= 0) & (b >= 0))
        a, b, p = a[ok], b[ok], pos[ok]
        windows = np.minimum(last[ok], p + width) - np.maximum(0, p + d - width) + 1
        found.append(((((high[ok] + np.minimum(a, b)) * v) + np.maximum(a, b)) << bits) | windows)
    both = np.concatenate(found)
    del found, doc, pos, last, high, token
    if not len(both):
        return
    both.sort()
    code, windows = both >> bits, both & ((1 << bits) - 1)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    value, code = np.add.reduceat(windows, first), code[first]
    del both, windows
    rest, hi = np.divmod(code, v)
    key_of, lo = np.divmod(rest, v)
    columns = [c.take(pa.array(firsts)) for c in columns]
    part = _part_of_pairs(words, lo, hi, _key_hashes(columns, k)[key_of], parts)
    yield from _dealt(part, words, columns, key_of, lo, hi, value)


def _dealt(part, words, columns, key_of, lo, hi, value) -> Iterator[dict]:
    order = np.argsort(part, kind="stable")
    part, key_of, lo, hi, value = part[order], key_of[order], lo[order], hi[order], value[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    number = np.empty(max(len(words), len(columns[0]) if columns else 1), np.int64)

    def own(a: np.ndarray, n: int) -> np.ndarray:
        mark = np.zeros(n, bool)
        mark[a] = True
        used = np.flatnonzero(mark)
        number[used] = np.arange(len(used))
        return used

    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
        used = own(np.concatenate([lo[s:e], hi[s:e]]), len(words))
        out = {"_lo": pa.array(number[lo[s:e]]), "_hi": pa.array(number[hi[s:e]]), "_v": pa.array(value[s:e]), "words": words.take(pa.array(used))}
        if columns:
            used = own(key_of[s:e], len(columns[0]))
            out |= {"_k": pa.array(number[key_of[s:e]])} | {f"k{i}": c.take(pa.array(used)) for i, c in enumerate(columns)}
        yield {"part": int(part[s]), "data": packed(out)}


def window_pair_sums(docs: DataFrame, width: int, keys: Iterable[str], tokens: str, pad: str) -> DataFrame:
    """keys, w1 < w2, value: the sums of ``cooccurrence.window_pairs``."""
    keys = list(keys)
    named = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(tokens).alias("tokens"))
    kinds = [docs.schema[k].dataType for k in keys]
    schema = StructType([*[StructField(k, t) for k, t in zip(keys, kinds, strict=True)], StructField("w1", StringType()), StructField("w2", StringType()), StructField("value", LongType())])
    parts = parts_for(named)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = lambda b: pc.list_value_length(b.column("tokens")).fill_null(0).to_numpy(zero_copy_only=False)
        for table in _blocks(batches, size, TOKENS):
            for row in _counted(table, keys, width, pad, parts):
                yield pa.record_batch({"part": pa.array([row["part"]], pa.int32()), "data": pa.array([row["data"]], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        got = [unpacked(d.as_buffer()) for d in table.column("data").combine_chunks()]
        sizes = [len(g["_lo"]) for g in got]
        words, of = _numbered([g["words"] for g in got])
        lo, hi = (np.concatenate([o[_numbers(g[c])] for g, o in zip(got, of, strict=True)]) for c in ("_lo", "_hi"))
        value, v = np.concatenate([_numbers(g["_v"]) for g in got]), len(words)
        high, columns = np.zeros(sum(sizes), np.int64), []
        if keys:
            columns = [pa.concat_arrays([g[f"k{i}"] for g in got]) for i in range(len(keys))]
            key, firsts = _tuples(columns, len(columns[0]))
            columns = [c.take(pa.array(firsts)) for c in columns]
            before = np.cumsum([0, *[len(g["k0"]) for g in got]])[:-1]
            high = np.concatenate([key[_numbers(g["_k"]) + b] for g, b in zip(got, before.tolist(), strict=True)])
        high = high * v + lo
        if int(high.max()) + 1 >= (1 << 63) // v:  # such numbers would not fit
            known, high = np.unique(high, return_inverse=True)
        else:
            known = None
        code, value = _sums(high * v + hi, value)
        high, hi = np.divmod(code, v)
        key, lo = np.divmod(high if known is None else known[high], v)
        rows = {k: c.take(pa.array(key)) for k, c in zip(keys, columns, strict=True)} | {"w1": words.take(pa.array(lo)), "w2": words.take(pa.array(hi)), "value": pa.array(value)}
        return pa.Table.from_batches(list(_batches(rows)))

    dealt = named.mapInArrow(count, "part int, data binary").groupBy("part")
    out = dealt.applyInArrow(add, schema)
    out.from_parts = keys, dealt, add
    return out


def small(df: DataFrame, label: str) -> DataFrame:
    """``df`` written, and broadcast if its counted rows are few."""
    kept = written(df, label)
    return F.broadcast(kept) if kept.count() <= SMALL else kept


def _row(block: int, part: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.record_batch({"block": pa.array([block], pa.int64()), "part": pa.array([part], pa.int32()), "data": pa.array([packed(columns)], pa.binary())})


def _in_parts(block: int, columns: list[pa.Array], words: pa.Array, more: dict[str, pa.Array], parts: int) -> tuple[np.ndarray, list[pa.RecordBatch]]:
    """A row for each part of (keys, word); the order in which the parts have them."""
    key, firsts = _tuples(columns, len(words))
    hashes = _key_hashes([c.take(pa.array(firsts)) for c in columns], len(firsts))
    part = (_mixed(_hashes(words) ^ hashes[key]) % np.uint64(parts)).astype(np.int16)
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    every = {"words": words} | {f"k{i}": c for i, c in enumerate(columns)} | more
    every = {name: a.take(pa.array(order)) for name, a in every.items()}
    rows = [_row(block, int(part[s]), {name: a.slice(s, e - s) for name, a in every.items()}) for s, e in zip(starts, [*starts[1:], len(part)], strict=True)]
    return order, rows


def _block_rows(table: pa.Table, keys: list[str], block: int, symmetric: bool, parts: int) -> Iterator[pa.RecordBatch]:
    n, value = table.num_rows, _whole(table.column("value"))
    c = value.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    columns = [_whole(table.column(f"_k{i}")) for i in range(len(keys))]
    key, firsts = _tuples(columns, n)
    columns = [x.take(pa.array(firsts)) for x in columns]
    yield _row(block, TOTALS, {"_s": pa.array(np.bincount(key, c, len(firsts)))} | {f"k{i}": x for i, x in enumerate(columns)})
    words, (first, second) = _numbered([_whole(table.column("w1")), _whole(table.column("w2"))])
    used, at = np.unique(np.concatenate([key * len(words) + first, key * len(words) + second]), return_inverse=True)
    sums = np.bincount(at[:n], c, len(used)) + (np.bincount(at[n:], c, len(used)) if symmetric else 0.0)
    key, word = np.divmod(used, len(words))
    order, rows = _in_parts(block, [x.take(pa.array(key)) for x in columns], words.take(pa.array(word)), {"_s": pa.array(sums)}, parts)
    yield from rows
    place = np.empty(len(used), np.int64)
    place[order] = np.arange(len(used))
    own = {"_first": pa.array(place[at[:n]]), "_second": pa.array(place[at[n:]]), "_v": value, "_word": pa.array(word[order]), "words": words}
    if columns:
        own |= {"_key": pa.array(key[order])} | {f"k{i}": x for i, x in enumerate(columns)}
    yield _row(block, OWN, own)


def with_word_values(coo: DataFrame, keys: list[str], values: DataFrame | None = None, symmetric: bool = False) -> tuple[DataFrame, DataFrame]:
    """(keys, w1, w2, value, _a, _b), (keys, _z): pairs with a value of either word, null if there is none, and the sums of ``value`` by key.

    ``values``: keys, token, n, each word once a key. Without it a word's value is the sum of its pairs where it is w1 (``symmetric``: or w2).
    Only the distinct words of a block of pairs are shuffled, not its pairs. Sums of ``window_pair_sums`` with the same keys become blocks
    where they are made.
    """
    kinds = [coo.schema[k].dataType for k in keys]
    named = coo.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "w1", "w2", "value")
    parts = parts_for(named, 8 << 20)
    given = values is not None

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, table in enumerate(_blocks(batches, lambda b: np.ones(b.num_rows, np.int64), PAIRS)):
            yield from _block_rows(table, keys, TaskContext.get().partitionId() << 32 | i, symmetric, parts)

    def split_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, lambda b: np.ones(b.num_rows, np.int64), PAIRS):
            yield from _in_parts(-1, [_whole(table.column(f"_k{i}")) for i in range(len(keys))], _whole(table.column("token")), {"_s": _whole(table.column("n"))}, parts)[1]

    def answer(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        got = [unpacked(d.as_buffer()) for d in table.column("data").combine_chunks()]
        sizes = [len(g["words"]) for g in got]
        words, of = _numbered([g["words"] for g in got])
        code, known = np.concatenate(of), pc.is_valid(pa.concat_arrays([g["words"] for g in got])).to_numpy(zero_copy_only=False)
        for i in range(len(keys)):
            column = pa.concat_arrays([g[f"k{i}"] for g in got])
            key, firsts = _tuples([column], len(column))
            code = np.unique(code * len(firsts) + key, return_inverse=True)[1]
            known &= pc.is_valid(column).to_numpy(zero_copy_only=False)
        s = np.concatenate([g["_s"].cast(pa.float64()).to_numpy(zero_copy_only=False) for g in got])
        size = int(code.max()) + 1
        if given:
            told = np.repeat(np.array(blocks) < 0, sizes)
            total, has = np.zeros(size), np.zeros(size, bool)
            total[code[told]], has[code[told]] = s[told], True
        else:
            total, has = np.bincount(code, s, size), np.ones(size, bool)
        answers = zip(blocks, np.split(total[code], np.cumsum(sizes)[:-1]), np.split(has[code] & known, np.cumsum(sizes)[:-1]), strict=True)
        part = table.column("part")[0].as_py()
        rows = [_row(b, part, {"x": pa.array(x), "_ok": pa.array(ok.astype(np.uint8))}) for b, x, ok in answers if b >= 0]
        return pa.Table.from_batches(rows, pa.schema({"block": pa.int64(), "part": pa.int32(), "data": pa.binary()}))

    names = [*keys, "w1", "w2", "value", "_a", "_b"]

    def join(table: pa.Table) -> pa.Table:
        part = _numbers(table.column("part").combine_chunks())
        got = [unpacked(table.column("data")[int(i)].as_buffer()) for i in np.argsort(part)]
        own, answers = got[0], got[1:]
        x = np.concatenate([a["x"].to_numpy() for a in answers])
        missing = np.concatenate([a["_ok"].to_numpy() for a in answers]) == 0
        first, second, word = _numbers(own["_first"]), _numbers(own["_second"]), _numbers(own["_word"])
        of = _numbers(own["_key"])[first] if keys else None
        rows = {k: own[f"k{i}"].take(pa.array(of)) for i, k in enumerate(keys)}
        rows |= {"w1": own["words"].take(pa.array(word[first])), "w2": own["words"].take(pa.array(word[second])), "value": own["_v"].cast(value_type)}
        rows |= {"_a": pa.array(x[first], mask=missing[first]), "_b": pa.array(x[second], mask=missing[second])}
        return pa.Table.from_batches(list(_batches({name: rows[name] for name in names})))

    value_type = _arrow_type(coo, "value")
    made_by, dealt, add = getattr(coo, "from_parts", (None, None, None))
    if made_by == keys:

        def split_part(table: pa.Table) -> pa.Table:
            rows, part = add(table), table.column("part")[0].as_py()
            rows = rows.rename_columns([*[f"_k{i}" for i in range(len(keys))], "w1", "w2", "value"])
            made = (r for i in range(0, rows.num_rows, PAIRS) for r in _block_rows(rows.slice(i, PAIRS), keys, part << 32 | i, symmetric, parts))
            return pa.Table.from_batches(list(made))

        table = written(dealt.applyInArrow(split_part, ROW), "blocks")
    else:
        table = written(named.mapInArrow(split, ROW), "blocks")
    asked = table.where("part >= 0")
    if given:
        told = values.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "token", "n").where("n is not null")
        asked = asked.unionByName(told.mapInArrow(split_values, ROW))
    answers = asked.groupBy("part").applyInArrow(answer, ROW)
    schema = StructType([*[StructField(k, t) for k, t in zip(keys, kinds, strict=True)], *[StructField(w, StringType()) for w in ("w1", "w2")], StructField("value", coo.schema["value"].dataType), StructField("_a", DoubleType()), StructField("_b", DoubleType())])
    joined = table.where(F.col("part") == OWN).unionByName(answers).groupBy("block").applyInArrow(join, schema)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                got = unpacked(data.as_buffer())
                yield pa.record_batch({k: got[f"k{i}"] for i, k in enumerate(keys)} | {"_z": got["_s"]})

    of_keys = StructType([*[StructField(k, t) for k, t in zip(keys, kinds, strict=True)], StructField("_z", DoubleType())])
    sums = table.where(F.col("part") == TOTALS).mapInArrow(totals, of_keys).groupBy(*keys).agg(F.sum("_z").alias("_z"))
    return joined, sums


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
