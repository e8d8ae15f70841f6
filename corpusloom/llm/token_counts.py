"""Token counts: pieces are counted once per distinct pre-token of the corpus.

Documents are split into pre-tokens, the tokenizer's library counts the pieces of each distinct pre-token once, in the part
that owns it, and the counts are joined back to the documents' pre-token frequencies (see ``blocks``); ids are never made for
a document.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import ENTRIES, Dictionary, answered, as_longs, ids_of, make_blocks, squeeze, unpack_pieces, with_answers
from corpusloom.llm.scratch import free_name, id_and_text

#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters, digits, punctuation and white space whose classes are the same in every Unicode version and regex library.
PLAIN = regex.compile(r"[\t\n\r -~¡-ɏΑ-ΡΣ-ωА-я‐-‧]*")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PreTokens:
    """Splits a text into the pre-tokens of a byte-level BPE tokenizer, its special strings apart, as the library does by default."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(PRE_TOKEN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __call__(self, text: str) -> list[str]:
        if self.cut and any(s in text for s in self.special):
            return [p for k, run in enumerate(self.cut.split(text)) for p in ([run] if k % 2 else self.plain(run))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.split(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024, entries: int = ENTRIES) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``path``: a byte-level BPE vocabulary that the executors can read, by default the installed public one. Null and empty
    texts have no tokens. Null ids and repeated rows are returned as they come; other columns are ignored; a result column
    that would clash with the id column gets an underscore. An empty table gives an empty result. ``entries``: see ``blocks``.
    """
    rows = id_and_text(df, id_col, text_col).withColumn("_learn", F.lit(False))
    split = _Lazy(path)
    blocks = make_blocks(rows, lambda text: [p.encode() for p in split()(text)], sequences=False)

    def rows_of(docs, values):
        ids, sizes, flags, ends, steps, times = docs
        starts = np.concatenate([[0], ends[:-1]])
        # differences start anew with each document
        run = np.cumsum(steps, dtype=np.int64)
        before = np.concatenate([[0], run])[starts]
        numbers = run - np.repeat(before, np.diff(ends, prepend=0))
        tokens = np.concatenate([[0], np.cumsum(values[0][numbers].astype(np.int64) * times if values else [], dtype=np.int64)])
        counts = tokens[ends] - tokens[starts]
        yield pa.RecordBatch.from_arrays([ids_of(ids, flags), pa.array(as_longs(sizes)), pa.array(counts), pa.array(counts > limit)], names=["_id", "n_bytes", "n_tokens", "over_limit"])

    own = Dictionary(blocks, entries)
    counted = with_answers(blocks, own.back(answered(own.dealt(own.rows()), PartCounts(split))), rows_of, "_id long, n_bytes long, n_tokens long, over_limit boolean")
    return counted.select(counted._id.alias(id_col), *[counted[c].alias(free_name(c, [id_col])) for c in ("n_bytes", "n_tokens", "over_limit")])


class PartCounts:
    """Answers rows of (block, part, pieces) with the pieces' token counts. A part's rows come side by side, in any number of batches; each distinct pre-token of it is counted once."""

    def __init__(self, split: Callable[[], PreTokens]) -> None:
        self.split, self.part, self.known = split, None, {}

    def __call__(self, block_ids, part_ids, packed):
        for block, part, data in zip(block_ids, part_ids, packed, strict=True):
            if part != self.part:
                self.part, self.known = part, {}
            pieces, _ = unpack_pieces(data)
            new = [p for p in pieces if p not in self.known]
            self.known.update(zip(new, self.split().count([p.decode() for p in new]), strict=True))
            yield block, part, squeeze(np.fromiter(map(self.known.__getitem__, pieces), np.int32, len(pieces)))


class _Lazy:
    """Builds the tokenizer once in each process that uses it."""

    def __init__(self, path: str | None) -> None:
        self.path, self.made = path, None

    def __call__(self) -> PreTokens:
        if self.made is None:
            self.made = PreTokens(self.path or default_vocabulary())
        return self.made

    def __reduce__(self):
        return _Lazy, (self.path,)
