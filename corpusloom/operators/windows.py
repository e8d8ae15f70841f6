"""Token windows, phrases and other operators on a document's token sequence.

Documents come as one array of tokens a row, and everything happens inside the row; only results are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.tokens import PAD


def context_windows(tokens: Column, width: int, ignore_pads: bool = True, pad: str = PAD) -> Column:
    """One window of 2 * width + 1 tokens per token, padded at both ends; pads are then removed or kept. No tokens, no windows."""
    padded = F.concat(F.array_repeat(F.lit(pad), width), tokens, F.array_repeat(F.lit(pad), width))
    starts = F.slice(F.sequence(F.lit(1), F.size(tokens) + 1), 1, F.size(tokens))
    windows = F.transform(starts, lambda i: F.slice(padded, i, F.lit(2 * width + 1)))
    return F.transform(windows, lambda w: F.filter(w, lambda t: t != pad)) if ignore_pads else windows


def concept_windows(tokens: Column, width: int, concepts: tuple[str, ...], ignore_concept: bool = False) -> Column:
    """Windows that hold a concept word anywhere, on demand without the concept words themselves."""
    words = F.array(*[F.lit(c) for c in concepts])
    windows = F.filter(context_windows(tokens, width), lambda w: F.arrays_overlap(w, words))
    return F.transform(windows, lambda w: F.filter(w, lambda t: ~t.isin(*concepts))) if ignore_concept else windows


def sliding(tokens: Column, n: int) -> Column:
    """Forward windows of n + 1 tokens."""
    return F.transform(F.slice(F.sequence(F.lit(1), F.size(tokens) + 1), 1, F.size(tokens)), lambda i: F.slice(tokens, i, F.lit(n + 1)))


def phrase_positions(df: DataFrame, phrases: list[tuple[str, ...]], token: str = "token") -> DataFrame:
    """Merges phrases in long tagged tokens (document_id, pos, token): the first token becomes the phrase joined by ``_``, the others ``(*)``.

    A phrase matches consecutive positions; where several begin at one token, the longest wins.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy("pos")
    best = F.lit(None).cast("string")
    size = F.lit(0)
    for phrase in sorted(phrases, key=len):
        hit = F.lit(True)
        for k, word in enumerate(phrase):
            hit &= F.coalesce((F.lead(token, k).over(order) if k else F.col(token)) == word, F.lit(False))
        best, size = F.when(hit, F.lit("_".join(phrase))).otherwise(best), F.when(hit, F.lit(len(phrase))).otherwise(size)
    longest = max(map(len, phrases), default=1)
    found = df.withColumn("_phrase", best).withColumn("_size", size)
    follows = F.lit(False)
    for k in range(1, longest):
        follows |= F.coalesce(F.lag("_size", k).over(order) > k, F.lit(False))
    merged = F.when(F.col("_phrase").isNotNull(), F.col("_phrase")).when(follows, F.lit("(*)")).otherwise(F.col(token))
    return found.withColumn("_merged", merged).withColumn(token, F.col("_merged")).drop("_phrase", "_size", "_merged")
