"""Vocabularies: building, compressing, translating, encoding. Tokens come long: document_id, pos, token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpusloom.operators.index import dense_ids

#: Stand for padding and for tokens that are too rare.
PADDING, LOW_TF = "*", "__low-tf__"


def term_counts(tokens: DataFrame) -> DataFrame:
    """Token, tf, and where it first occurs.

    A place is one number if ids are whole numbers: Spark sums up numbers in hash tables, but sorts all tokens for a least struct.
    """
    place = F.struct("document_id", "pos")
    if isinstance(tokens.schema["document_id"].dataType, IntegralType):
        place = F.col("document_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("pos").cast("decimal(11,0)")
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("tf"), F.min(place).alias("_first"))


def vocabulary(tokens: DataFrame, first_seen: bool = True) -> DataFrame:
    """token_id, token, tf; ids 0, 1, ... in first-seen order, or in the tokens' order."""
    counts = term_counts(tokens)
    ranked = dense_ids(counts, ["_first"], "token_id") if first_seen else dense_ids(counts.select("token", "tf"), ["token"], "token_id")
    return ranked.select(F.col("token_id").cast("int").alias("token_id"), "token", "tf")


def keeps(threshold: int, keep: tuple[str, ...] = ()) -> Column:
    return (F.col("tf") >= threshold) | F.col("token").isin(*keep, PADDING, LOW_TF)


def compress(vocab: DataFrame, threshold: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Token, tf without the rare tokens, whose counts are summed in one row for all of them."""
    masked = F.when(keeps(threshold, keep), F.col("token")).otherwise(F.lit(LOW_TF))
    return vocab.groupBy(masked.alias("token")).agg(F.sum("tf").alias("tf"))


def mask_low_tf(tokens: DataFrame, vocab: DataFrame, threshold: int, keep: tuple[str, ...] = (), drop: bool = False) -> DataFrame:
    """Rare or unknown tokens become ``__low-tf__``, or go."""
    known = vocab.where(keeps(threshold, keep)).select("token")
    if drop:
        exempt = tokens.where(F.col("token").isin(*keep)) if keep else None
        kept = tokens.join(known, "token", "left_semi")
        return kept if exempt is None else kept.unionByName(exempt.join(known, "token", "left_anti"))
    found = tokens.join(known.withColumn("_known", F.lit(True)), "token", "left")
    shown = F.when(F.col("_known") | F.col("token").isin(*keep, PADDING), F.col("token")).otherwise(F.lit(LOW_TF)) if keep else F.when(F.col("_known"), F.col("token")).otherwise(F.lit(LOW_TF))
    return found.withColumn("token", shown).drop("_known")


def encode(tokens: DataFrame, vocab: DataFrame, fallback: int | None = None) -> DataFrame:
    """A10: token ids; unknown tokens go, or get ``fallback``."""
    joined = tokens.join(vocab.select("token", "token_id"), "token", "inner" if fallback is None else "left")
    return joined if fallback is None else joined.withColumn("token_id", F.coalesce("token_id", F.lit(fallback)))


def decode(ids: DataFrame, vocab: DataFrame, id_col: str = "token_id", name: str = "token") -> DataFrame:
    """The tokens of an id column."""
    return ids.join(vocab.select(F.col("token_id").alias(id_col), F.col("token").alias(name)), id_col, "left")


def translate(cells: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Token ids of one vocabulary to those of another, by token; what the other lacks goes."""
    ids = old.select("token", F.col("token_id").alias("_old")).join(new.select("token", F.col("token_id").alias("_new")), "token")
    return cells.join(ids, cells.token_id == ids._old).withColumn("token_id", F.col("_new")).drop("token", "_old", "_new")


def lookup(vocab: DataFrame, tokens: list[str]) -> dict[str, int]:
    """Ids of a few tokens; those that the vocabulary lacks are left out."""
    return {r.token: r.token_id for r in vocab.where(F.col("token").isin(*tokens)).collect()}  # as many rows as tokens


def opened(vocab: DataFrame, tokens: DataFrame) -> DataFrame:
    """The vocabulary and, after its last id, the tokens that it lacks, with their counts."""
    new = term_counts(tokens).select("token", "tf").join(vocab.select("token"), "token", "left_anti")
    last = vocab.agg(F.coalesce(F.max("token_id"), F.lit(-1)).alias("_last"))
    added = dense_ids(new, ["token"], "_k").join(last).select((F.col("_last") + 1 + F.col("_k")).cast("int").alias("token_id"), "token", "tf")  # one row
    return vocab.select("token_id", "token", "tf").unionByName(added)


def id_range(vocab: DataFrame, first: int, last: int) -> DataFrame:
    """The part of the vocabulary between two ids, both included."""
    return vocab.where(F.col("token_id").between(first, last))
