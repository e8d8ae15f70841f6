"""Secret scans with a recursive decoding worklist.

Every text is scanned for three kinds of secrets. Then a worklist unwraps what a text hides: percent, Unicode and HTML character
escapes, base64 runs (in one line or several, alone or beside other text), and zlib, gzip or raw deflate streams written in any
of these. Each layer is scanned in turn and unwrapped again until nothing new appears; a layer whose content has been seen at
its place is not visited again, which also ends cycles. Every character of a layer knows the span of the original text that it
came from, so what is found at any depth is reported in code points of the original text.

Hostile texts: escapes of escapes are undone layer by layer ``PASSES`` times; a longer chain is then reduced to its end in one step
by a stack, in time that follows the length of the text. Compressed streams are inflated piece by piece: what exceeds ``PIECE``
bytes is scanned in overlapping pieces, so a blob inside a stream that is itself longer than the overlap may be read in parts;
a text's streams are opened until they have given ``MOST_INFLATED`` bytes, a bound against nested bombs. Of layers, digests are kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.scratch import free_name, id_and_text

KINDS = ("assign", "access", "hex")
#: Fixed patterns of the contract, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: Passes over escapes of escapes that are layers of their own.
PASSES = 8
PIECE, OVERLAP = 2 << 20, 64 << 10
MOST_INFLATED = 4 << 30

_CODE = r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#(\d{1,7});|%([0-9A-Fa-f]{2})"
#: The first two groups: a surrogate pair, which only a pass over the text knows.
ESCAPE = re.compile(r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|" + _CODE)
LAST_ESCAPE = re.compile(r"(?:" + _CODE + r")\Z")
LONGEST_ESCAPE = 11
ESCAPE_SIGNS = frozenset("%\\&")
#: The shortest secret (an assignment) has 12 bytes, which base64 writes in 16 characters; any other encoding of one is longer.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, of any width, indented or not.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*[A-Za-z0-9+/_-]++)+={0,2}")
#: Printable UTF-8 within other bytes, from the length of the shortest secret on.
CLEAN = re.compile(
    rb"(?:[\x09-\x0d\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){12,}"
)
STREAM = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]")
#: A separator may stand before a blob: what follows one may be where the blob starts.
BLOB_START = re.compile(r"(?<=[/_-])[A-Za-z0-9+]")
#: Bytes as string literals write them.
LITERAL = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\[abfnrtv0'\"\\]|[\x20-\x5b\x5d-\x7e])+")
LITERAL_BYTE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\([abfnrtv0'\"\\])|([\x20-\x5b\x5d-\x7e])")
LETTERS = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "0": 0, "'": 39, '"': 34, "\\": 92}
LITERAL_STREAM = re.compile(r"\\x1f\\x8b|(?:x|\\x78)(?:\\x01|\^|\\x5e|\\x9c|\\xda)", re.IGNORECASE)

Span = tuple[int, int]


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind number) of the contract's matches, by kind."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_VALUE:
            yield m.start(), m.end(), 0
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST_ACCESS:
            yield m.start(), m.end(), 1
    for m in HEX.finditer(text):
        yield m.start(), m.end(), 2


class Layer:
    """Decoded text; starts and ends: for each of its characters the span of the original text that it came from. Neither ever falls."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, passes: int = 0) -> None:
        self.text, self.starts, self.ends, self.passes = text, starts, ends, passes

    def span(self, start: int, end: int) -> Span:
        return int(self.starts[start]), int(self.ends[end - 1])

    def within(self, outer: Layer | None) -> Layer:
        """This layer of ``outer``'s text, as a layer of the original text."""
        return self if outer is None else Layer(self.text, outer.starts[self.starts], outer.ends[self.ends - 1], self.passes)


class Blob:
    """Decoded bytes, all from one span of the original text."""

    def __init__(self, data: bytes, start: int, end: int) -> None:
        self.data, self.start, self.end = data, start, end

    def within(self, outer: Layer | None) -> Blob:
        return self if outer is None else Blob(self.data, *outer.span(self.start, self.end))


def placed(text: str, start: int, end: int) -> Layer:
    return Layer(text, *(np.broadcast_to(np.int64(x), len(text)) for x in (start, end)))


def _character(groups: tuple[str | None, ...]) -> str | None:
    """What the groups of ``_CODE`` stand for; a percent-encoded byte over 7f is the surrogate that stands for a byte."""
    if groups[6] is not None:
        byte = int(groups[6], 16)
        return chr(byte if byte < 128 else 0xDC00 + byte)
    code = int(groups[5]) if groups[5] is not None else int(next(g for g in groups if g is not None), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def joined_bytes(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Surrogates that stand for bytes made characters, where they are UTF-8; others stay."""
    if not (lone := re.search("[\udc80-\udcff]", text)):
        return text, starts, ends
    out, keep, last = [text[: lone.start()]], list(range(lone.start())), list(range(lone.start()))
    at = lone.start()
    for m in re.finditer("[\udc80-\udcff]+", text):
        out.append(text[at : m.start()])
        keep.extend(range(at, m.start())), last.extend(range(at, m.start()))
        at = m.start()
        for c in m[0].encode("utf-8", "surrogateescape").decode("utf-8", "surrogateescape"):
            size = 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
            out.append(c)
            keep.append(at), last.append(at + size - 1)
            at += size
    out.append(text[at:])
    keep.extend(range(at, len(text))), last.extend(range(at, len(text)))
    return "".join(out), starts[np.array(keep, np.int64)], ends[np.array(last, np.int64)]


def unescaped(text: str) -> Layer | None:
    """The text with each escape replaced once; None if there is none."""
    out: list[str] = []
    starts, ends = array("q"), array("q")
    at = 0
    for m in ESCAPE.finditer(text):
        if m[1] is not None:
            new = chr(0x10000 + (int(m[1], 16) - 0xD800 << 10) + int(m[2], 16) - 0xDC00)
        elif (new := _character(m.groups()[2:])) is None:
            continue
        out += [text[at : m.start()], new]
        starts.extend(range(at, m.start() + 1))
        ends.extend(range(at + 1, m.start() + 1))
        ends.append(m.end())
        at = m.end()
    if not at:
        return None
    out.append(text[at:])
    starts.extend(range(at, len(text)))
    ends.extend(range(at + 1, len(text) + 1))
    return Layer(*joined_bytes("".join(out), np.array(starts, np.int64), np.array(ends, np.int64)))


def reduced(text: str) -> Layer:
    """The text with escapes replaced until none is left, those that other escapes make included; each character is pushed once."""
    out: list[str] = []
    starts, ends, signs = array("q"), array("q"), []  # signs: where in ``out`` an escape may begin
    for i, c in enumerate(text):
        start, end = i, i + 1
        while True:
            if c in ESCAPE_SIGNS:
                signs.append(len(out))
            out.append(c), starts.append(start), ends.append(end)
            if not signs or signs[-1] == len(out) - 1 or len(out) - signs[-1] > LONGEST_ESCAPE or not (m := LAST_ESCAPE.match("".join(out[signs[-1] :]))):
                break
            if (new := _character(m.groups())) is None:
                break
            first = signs.pop()
            c, start, end = new, starts[first], ends[-1]
            del out[first:], starts[first:], ends[first:]
    return Layer(*joined_bytes("".join(out), np.array(starts, np.int64), np.array(ends, np.int64)))


class Inflated:
    """Streams of one text, opened piece by piece; counts what they gave."""

    def __init__(self) -> None:
        self.total = 0

    def pieces(self, data: bytes, at: int, wbits: int) -> Iterator[tuple[bytes, int, bool]]:
        """(what the stream at ``at`` holds, in pieces that overlap; where in ``data`` it has come to; whether it has ended)."""
        stream, source, tail = zlib.decompressobj(wbits), memoryview(data)[at:], b""
        held, size, fed, step = [], 0, 0, 1 << 10
        while fed < len(source) and not stream.eof and self.total < MOST_INFLATED:
            chunk = source[fed : fed + step]
            fed += len(chunk)
            step = min(step * 4, 1 << 20)
            while chunk or stream.unconsumed_tail:
                try:
                    new = stream.decompress(stream.unconsumed_tail or chunk, PIECE)
                except zlib.error:
                    return
                chunk = b""
                if not new and not stream.unconsumed_tail:
                    break
                held.append(new)
                size += len(new)
                self.total += len(new)
                if size >= PIECE:
                    piece = tail + b"".join(held)
                    yield piece, at + fed - len(stream.unused_data), False
                    tail, held, size = piece[-OVERLAP:], [], 0
                if stream.eof or self.total >= MOST_INFLATED:
                    break
        yield tail + b"".join(held), at + fed - len(stream.unused_data), stream.eof

    def streams(self, data: bytes, place: Callable[[int, int], Span]) -> Iterator[Blob]:
        """What zlib and gzip streams anywhere in ``data`` hold, whole or cut off; ``place``: the span of a range of bytes."""
        done = 0
        for m in STREAM.finditer(data):
            if m.start() < done:
                continue
            for inner, end, _ in self.pieces(data, m.start(), 47):
                done = end
                if inner:
                    yield Blob(inner, *place(m.start(), end))

    def raw(self, data: bytes, place: Callable[[int, int], Span]) -> Iterator[Blob]:
        """What ``data`` holds if it is a raw deflate stream of text from its first byte to its last."""
        if data and data[0] & 6 != 6:
            got = list(self.pieces(data, 0, -15))
            if got and got[-1][1] == len(data) and got[-1][2] and all(CLEAN.fullmatch(inner) for inner, _, _ in got):
                for inner, _, _ in got:
                    yield Blob(inner, *place(0, len(data)))


def _line_parts(m: re.Match) -> list[range]:
    """Where in the source the lines of a run are, without its padding."""
    return [range(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[A-Za-z0-9+/_-]+", m[0])]


def from_base64(source: str, m: re.Match, inflated: Inflated) -> Iterator[Layer | Blob]:
    """What a run holds: printable stretches and compressed streams, at all four alignments.

    A character maps to its blob (from a separator or line break on, where there is one), within the lines it is on.
    """
    parts = _line_parts(m)
    body = "".join(source[p.start : p.stop] for p in parts)
    plain = body.replace("-", "+").replace("_", "/")
    decoded = []
    for shift in range(4):
        coded = plain[shift : len(plain) - ((len(plain) - shift) % 4 == 1)]
        decoded.append(base64.b64decode(coded + "=" * (-len(coded) % 4)))
    if CLEAN.fullmatch(decoded[0]):  # text as a whole
        yield placed(decoded[0].decode(), m.start(), m.end()) if len(parts) == 1 else next(_stretches(decoded[0], 0, body, parts, m, [0]))
        return
    begins = sorted({0} | {k.start() for k in BLOB_START.finditer(body)} | {a for a in np.cumsum([len(p) for p in parts])[:-1].tolist()})
    for shift, data in enumerate(decoded):
        aligned = [k for k in begins if k % 4 == shift]
        if CLEAN.search(data):
            yield from _stretches(data, shift, body, parts, m, aligned)
        at = None

        def place(first, end, shift=shift, data=data):
            nonlocal at
            if at is None:
                at = [i for p in parts for i in p]
            last = len(body) - 1 if end >= len(data) else min(len(body), shift + (end + 2) // 3 * 4) - 1
            return at[shift + first // 3 * 4], m.end() if last == len(body) - 1 else at[last] + 1

        streams = 0
        for blob in inflated.streams(data, place):
            streams += 1
            yield blob
        if not streams:
            for k in aligned:
                first = (k - shift) // 4 * 3
                yield from inflated.raw(data[first:], lambda a, b, first=first: place(first + a, first + b))  # noqa: B023


def _stretches(data: bytes, shift: int, body: str, parts: list[range], m: re.Match, aligned: list[int]) -> Iterator[Layer]:
    """Printable stretches of the bytes of a base64 run that is read from its character ``shift`` on."""
    at = np.concatenate([np.arange(p.start, p.stop) for p in parts])
    first_of = np.repeat([p.start for p in parts], [len(p) for p in parts])
    last_of = np.repeat([*[p.stop for p in parts[:-1]], m.end()], [len(p) for p in parts])
    char = lambda byte: shift + byte // 3 * 4

    def last_char(byte_end: np.ndarray) -> np.ndarray:  # of the group of four that holds the byte before
        return np.where(byte_end >= len(data), len(body), np.minimum(len(body), shift + (byte_end + 2) // 3 * 4)) - 1

    for c in CLEAN.finditer(data):
        # the first bytes may be of what stands before the blob, and printable by chance
        k = bisect_left(aligned, shift + -(-c.start() // 3) * 4)
        start = aligned[k] if k < len(aligned) and (aligned[k] - shift) // 4 * 3 <= c.start() + 8 else char(c.start())
        text, raw = c[0].decode(), np.frombuffer(c[0], np.uint8)
        begin = c.start() + np.flatnonzero((raw & 0xC0) != 0x80)
        begin_char, end_char = char(begin), last_char(np.append(begin[1:], c.end()))
        end = int(last_char(np.array(c.end())))
        # a byte before the blob's start is not of the blob
        starts = np.where(begin_char >= start, np.maximum(at[start], first_of[begin_char]), at[begin_char])
        ends = np.where(begin_char >= start, np.minimum(at[end] + 1 if end < len(body) - 1 else m.end(), last_of[end_char]), at[end_char] + 1)
        yield Layer(text, starts, ends)


def from_bytes(source: str, inflated: Inflated) -> Iterator[Blob]:
    """Compressed streams in a text that holds bytes: as surrogates of percent-encoded ones, or as string literals write them."""
    if re.search("[\udc80-\udcff]", source):
        data = source.encode("utf-8", "surrogateescape")
        sizes = np.array([1 if c < "\x80" or "\udc80" <= c <= "\udcff" else len(c.encode()) for c in source])
        char = np.repeat(np.arange(len(source)), sizes)
        yield from inflated.streams(data, lambda a, b: (int(char[a]), int(char[b - 1]) + 1))
    if LITERAL_STREAM.search(source):
        for run in LITERAL.finditer(source):
            if LITERAL_STREAM.search(run[0]):
                found = [(m.start(), m.end(), int(m[1], 16) if m[1] else LETTERS[m[2]] if m[2] else ord(m[3])) for m in LITERAL_BYTE.finditer(run[0])]
                data, begin = bytes(f[2] for f in found), run.start()
                yield from inflated.streams(data, lambda a, b: (begin + found[a][0], begin + found[b - 1][1]))  # noqa: B023


def unwrapped(outer: Layer | None, source: str, inflated: Inflated) -> Iterator[Layer | Blob]:
    """All layers directly below a text, as layers of that text."""
    passes = outer.passes if outer else 0
    if ("%" in source or "\\" in source or "&#" in source) and (once := unescaped(source)):
        layer = once if passes < PASSES else reduced(source)
        layer.passes = passes + 1
        yield layer
    for m in BASE64.finditer(source):
        yield from from_base64(source, m, inflated)
    if "\n" in source:
        for m in WRAPPED.finditer(source):
            if len(m[0]) >= 16:
                yield from from_base64(source, m, inflated)
    if outer is not None or "\\x" in source:
        yield from from_bytes(source, inflated)


def opened(blob: Blob, inflated: Inflated) -> Iterator[Layer | Blob]:
    """The printable stretches and streams in bytes; they have the place of the whole."""
    for c in CLEAN.finditer(blob.data):
        yield placed(c[0].decode(), blob.start, blob.end)
    for inner in inflated.streams(blob.data, lambda a, b: (blob.start, blob.end)):
        yield inner


def layers(text: str) -> Iterator[Layer]:
    """All decoded layers of a text, each once; equal content from another place is another finding."""
    inflated = Inflated()
    seen: set[tuple[bytes, int]] = set()
    work: list[tuple[Layer | None, Iterator[Layer | Blob]]] = [(None, unwrapped(None, text, inflated))]
    while work:
        outer, items = work[-1]
        if (item := next(items, None)) is None:
            work.pop()
            continue
        item = item.within(outer)
        data = item.data if isinstance(item, Blob) else item.text.encode("utf-8", "surrogatepass")
        if not data or (isinstance(item, Layer) and item.text == text):
            continue
        key = (hashlib.blake2b(data, digest_size=16, key=b"blob" if isinstance(item, Blob) else b"text").digest(), item.start if isinstance(item, Blob) else int(item.starts[0]))
        if key in seen:
            continue
        seen.add(key)
        if isinstance(item, Blob):
            work.append((None, opened(item, inflated)))
        else:
            yield item
            work.append((item, unwrapped(item, item.text, inflated)))


def all_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches and of those found in any layer, sorted, each once."""
    spans = {(a, k, b) for a, b, k in base_spans(text)}
    for layer in layers(text):
        for a, b, k in base_spans(layer.text):
            start, end = layer.span(a, b)
            spans.add((start, k, end))
    return sorted(spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base_spans and spans, both arrays of struct(kind, start, end) in code points, end exclusive.

    base_spans: the matches in the text itself, by start, then kind; spans: these and what the decoded layers add. Null and
    empty texts have none. Null ids and repeated rows are returned as they come; other columns are ignored. An empty table
    gives an empty result.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for batch in batches:
            base, every = [], []
            for text in batch.column(1).to_pylist():
                for spans, out in ((sorted((a, k, b) for a, b, k in base_spans(text)), base), (all_spans(text), every)):
                    out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(every, kind)], names=["_id", "base_spans", "spans"])

    struct = "array<struct<kind:string,start:bigint,end:bigint>>"
    found = id_and_text(df, id_col, text_col).mapInArrow(scan, f"_id long, base_spans {struct}, spans {struct}")
    return found.select(found._id.alias(id_col), *[found[c].alias(free_name(c, [id_col])) for c in ("base_spans", "spans")])
