"""Document-term matrices in long form and the operators on them.

Only non-zero cells are rows; whatever needs the zeros takes the number of documents from the index.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.predicates import mask, word_predicate
from corpusloom.functions.tokens import tokenize
from corpusloom.operators.index import fill_gaps, temporal_key


def vectorize(tokens: DataFrame, lowercase: bool = False, stop_words: tuple[str, ...] = (), min_df: float = 1, max_df: float = 1.0, min_tf: int = 1, max_tokens: int | None = None) -> DataFrame:
    """A1, A2: cells (document_id, token, value) of long tokens.

    ``min_df`` and ``max_df`` are numbers of documents, or shares of them if fractional (``max_df`` 1.0: all); ``max_tokens``
    keeps the most frequent ones, ties to the smaller token.
    """
    token = F.lower("token") if lowercase else F.col("token")
    cells = tokens.select("document_id", token.alias("token"))
    if stop_words:
        cells = cells.where(~F.col("token").isin(*stop_words))
    cells = cells.groupBy("document_id", "token").agg(F.count(F.lit(1)).alias("value"))
    if min_df > 1 or isinstance(min_df, float) or max_df != 1.0 or min_tf > 1 or max_tokens:
        terms = cells.groupBy("token").agg(F.sum("value").alias("tf"), F.count(F.lit(1)).alias("df"))
        shares = isinstance(min_df, float) or isinstance(max_df, float) and max_df != 1.0
        n = tokens.agg(F.count_distinct("document_id").alias("n")) if shares else None  # goes through all tokens
        share = lambda x: F.lit(x) * F.col("n") if isinstance(x, float) else F.lit(x)
        terms = terms if n is None else terms.join(F.broadcast(n))  # one row
        at_most = F.lit(True) if max_df == 1.0 and isinstance(max_df, float) else F.col("df") <= share(max_df)
        terms = terms.where((F.col("df") >= share(min_df)) & at_most & (F.col("tf") >= min_tf))
        if max_tokens:
            terms = terms.orderBy(F.desc("tf"), "token").limit(max_tokens)
        cells = cells.join(terms.select("token"), "token", "left_semi")
    return cells


@dataclass(frozen=True)
class Dtm:
    """cells: document_id, token, value; index: document_id and attributes, a row for every document, empty ones too."""

    cells: DataFrame
    index: DataFrame

    # totals

    def term_frequency(self) -> DataFrame:
        """A12."""
        return self.cells.groupBy("token").agg(F.sum("value").alias("tf"))

    def document_counts(self) -> DataFrame:
        """Row sums; 0 for empty documents."""
        sums = self.cells.groupBy("document_id").agg(F.sum("value").alias("n_tokens"))
        return self.index.select("document_id").join(sums, "document_id", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast(sums.schema["n_tokens"].dataType)))

    def with_token_counts(self) -> Dtm:
        """n_tokens, and n_raw_tokens where missing."""
        counts = self.document_counts()
        index = self.index.drop("n_tokens").join(counts, "document_id")
        return replace(self, index=index if "n_raw_tokens" in index.columns else index.withColumn("n_raw_tokens", F.col("n_tokens")))

    def stats(self) -> DataFrame:
        """One row: documents, terms, sum."""
        n = self.index.agg(F.count(F.lit(1)).alias("n_documents"))
        return self.cells.agg(F.count_distinct("token").alias("n_terms"), F.sum("value").alias("total")).join(n)  # one row each

    # what a matrix says of itself

    @property
    def terms(self) -> DataFrame:
        """The tokens that it has."""
        return self.cells.select("token").distinct()

    def shape(self) -> tuple[int, int]:
        """Numbers of documents and of tokens in use."""
        return self.index.count(), self.terms.count()

    def has_term(self, token) -> bool:
        """X75."""
        return not self.cells.where(F.col("token") == token).isEmpty()

    def transposed(self) -> DataFrame:
        """Tokens as documents: document_id (the token), token (the document), value."""
        return self.cells.select(F.col("token").alias("document_id"), F.col("document_id").alias("token"), "value")

    def with_index(self, index: DataFrame) -> Dtm:
        """Another index; documents that it lacks go."""
        return Dtm(self.cells.join(index.select("document_id"), "document_id", "left_semi"), index)

    # filters and slices

    def filter(self, predicate: Column | dict) -> Dtm:
        """documents by a predicate on the index."""
        index = self.index.where(mask(self.index, predicate) if isinstance(predicate, dict) else predicate)
        return Dtm(self.cells.join(index.select("document_id"), "document_id", "left_semi"), index)

    def with_terms(self, terms: DataFrame) -> Dtm:
        return replace(self, cells=self.cells.join(terms.select("token"), "token", "left_semi"))

    def slice_by_tf(self, threshold: float) -> Dtm:
        """T9."""
        return self.with_terms(self.term_frequency().where(F.col("tf") >= threshold))

    def slice_by_n_top(self, n: int) -> Dtm:
        """Ties go to the smaller token."""
        return self.with_terms(self.top_words(n))

    def slice_by_df(self, min_df: int = 1, max_df: int | None = None, max_terms: int | None = None) -> Dtm:
        """Terms by the number of documents that have them."""
        df = self.cells.groupBy("token").agg(F.count_distinct("document_id").alias("df"))
        df = df.where((F.col("df") >= min_df) & (F.lit(True) if max_df is None else F.col("df") <= max_df))
        return self.with_terms(df.orderBy(F.desc("df"), "token").limit(max_terms) if max_terms else df)

    def compress(self, threshold: float, keep: tuple = ()) -> Dtm:
        """Terms above the threshold and the kept ones."""
        return self.with_terms(self.term_frequency().where((F.col("tf") >= threshold) | F.col("token").isin(*keep)))

    def slice_by_terms(self, terms: Iterable) -> Dtm:
        """the named terms only."""
        return replace(self, cells=self.cells.where(F.col("token").isin(*terms)))

    def zero_out(self, terms: Iterable = (), below: float | None = None, others: Dtm | None = None) -> Dtm:
        """cells become zero, that is, go: of named terms, of terms below a total, or where ``others`` has none. The index stays."""
        cells = self.cells.where(~F.col("token").isin(*terms)) if terms else self.cells
        if below is not None:
            cells = cells.join(self.term_frequency().where(F.col("tf") >= below).select("token"), "token", "left_semi")
        if others is not None:
            cells = cells.join(others.cells.where("value <> 0").select("document_id", "token"), ["document_id", "token"], "left_semi")
        return replace(self, cells=cells)

    def matching(self, wanted: Iterable[str]) -> DataFrame:
        """Token and tf of words, globs and |regexps|."""
        return self.term_frequency().where(word_predicate(F.col("token"), wanted))

    # top lists

    def top_words(self, n: int, among: DataFrame | None = None) -> DataFrame:
        """T1, T2, T5, T7."""
        tf = self.term_frequency() if among is None else self.with_terms(among).term_frequency()
        return tf.where("tf > 0").orderBy(F.desc("tf"), "token").limit(n)

    def top_by_category(self, category: str, n: int) -> DataFrame:
        """Category, rank, token, tf; tasks cut their lists before the shuffle."""
        counts = self.cells.join(self.index.select("document_id", category), "document_id").groupBy(category, "token").agg(F.sum("value").alias("tf"))
        return counts.withColumn("rank", F.row_number().over(Window.partitionBy(category).orderBy(F.desc("tf"), "token"))).where(F.col("rank") <= n)

    def top_table(self, category: str, n: int, values: list, kind: str = "token", pad: str = "*") -> DataFrame:
        """T4: one row a rank, one column a category; kind: token, or token/tf."""
        shown = F.col("token").cast("string") if kind == "token" else F.concat_ws("/", F.col("token").cast("string"), F.col("tf").cast("string"))
        wide = self.top_by_category(category, n).withColumn("_shown", shown).groupBy("rank").pivot(category, values).agg(F.first("_shown"))
        return wide.na.fill(pad)

    # weights

    def normalize(self, axis: int = 1, norm: str = "l1") -> Dtm:
        """M1: rows (axis 1) or columns (axis 0) to unit norm."""
        key = "document_id" if axis == 1 else "token"
        v = F.col("value").cast("double")
        size = {"l1": F.sum(F.abs(v)), "l2": F.sqrt(F.sum(v * v)), "max": F.max(F.abs(v))}[norm]
        sizes = self.cells.groupBy(key).agg(size.alias("_size"))
        return replace(self, cells=self.cells.join(sizes, key).select("document_id", "token", F.coalesce(F.try_divide(v, F.col("_size")), F.lit(0.0)).alias("value")))

    def normalize_keeping_magnitude(self, norm: str = "l1") -> Dtm:
        """M1 with keep_magnitude: everything is scaled by the factor of the first document (Q20)."""
        first = self.index.agg(F.min("document_id").alias("document_id"))
        v = F.col("value").cast("double")
        size = {"l1": F.sum(F.abs(v)), "l2": F.sqrt(F.sum(v * v)), "max": F.max(F.abs(v))}[norm]
        factor = self.cells.join(F.broadcast(first), "document_id").agg(size.alias("_factor"))  # one row
        cells = self.normalize(1, norm).cells.join(F.broadcast(factor)).withColumn("value", F.col("value") * F.col("_factor")).drop("_factor")
        return replace(self, cells=cells)

    def normalize_by_raw_counts(self) -> Dtm:
        """M2: value over the document's n_raw_tokens (else n_tokens); 0 where there are none."""
        count = "n_raw_tokens" if "n_raw_tokens" in self.index.columns else "n_tokens"
        joined = self.cells.join(self.index.select("document_id", F.col(count).alias("_n")), "document_id")
        return replace(self, cells=joined.select("document_id", "token", F.coalesce(F.try_divide(F.col("value").cast("double"), F.col("_n")), F.lit(0.0)).alias("value")))

    def tf_idf(self, norm: str | None = "l2", smooth: bool = True) -> Dtm:
        """M3: tf * (ln((1 + n) / (1 + df)) + 1), or ln(n / df) + 1 unsmoothed; then rows to unit norm."""
        n = self.index.agg(F.count(F.lit(1)).alias("_n"))
        df = self.cells.groupBy("token").agg(F.count(F.lit(1)).alias("_df")).join(F.broadcast(n))  # one row
        idf = F.ln((F.col("_n") + 1) / (F.col("_df") + 1)) + 1 if smooth else F.ln(F.col("_n") / F.col("_df")) + 1
        weighed = replace(self, cells=self.cells.join(df, "token").select("document_id", "token", (F.col("value") * idf).alias("value")))
        return weighed.normalize(1, norm) if norm else weighed

    # groups

    def group_by(self, keys: dict[str, Column], aggregate: str = "sum") -> DataFrame:
        """Cells (*keys, token, value) of documents grouped by expressions on the index; a mean divides by all documents of the group."""
        groups = self.index.select("document_id", *[c.alias(k) for k, c in keys.items()]).dropna(subset=list(keys))
        sums = self.cells.join(groups, "document_id").groupBy(*keys, "token").agg(F.sum("value").alias("value"))
        if aggregate == "sum":
            return sums
        sizes = groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        return sums.join(sizes, list(keys)).withColumn("value", F.col("value") / F.col("_n")).drop("_n")

    def group_by_time(self, spec="year", aggregate: str = "sum") -> DataFrame:
        """By period."""
        return self.group_by({"period": temporal_key(F.col("year"), spec)}, aggregate)

    def group_index(self, keys: dict[str, Column], step: int | None = None) -> DataFrame:
        """n_documents and sums per group; with ``step``, a row of zeros for each missing period of the first key."""
        groups = self.index.select("document_id", *[F.col(c) for c in ("n_tokens", "n_raw_tokens") if c in self.index.columns], *[c.alias(k) for k, c in keys.items()]).dropna(subset=list(keys))
        sums = [c for c in ("n_tokens", "n_raw_tokens") if c in groups.columns]
        grouped = groups.groupBy(*keys).agg(F.count_distinct("document_id").alias("n_documents"), *[F.sum(c).alias(c) for c in sums])
        first, *rest = keys
        grouped = fill_gaps(grouped, first, step, rest, ["n_documents", *sums]) if step else grouped
        return grouped.withColumn("document_name", F.concat_ws("_", *[F.col(k).cast("string") for k in keys]))

    def group_by_mapping(self, mapping: dict[int, list[int]], spark) -> DataFrame:
        """Explicit {new row: old rows}."""
        pairs = spark.createDataFrame([(k, int(d)) for k, ds in mapping.items() for d in ds], "category int, document_id long")
        return self.cells.join(pairs, "document_id").groupBy("category", "token").agg(F.sum("value").alias("value"))  # as given by the caller

    # other shapes

    def word_vector(self, word) -> DataFrame:
        """A document's value of one word, 0 where it has none."""
        own = self.cells.where(F.col("token") == word).select("document_id", "value")
        return self.index.select("document_id").join(own, "document_id", "left").withColumn("value", F.coalesce("value", F.lit(0).cast(own.schema["value"].dataType)))

    def bags(self) -> DataFrame:
        """document_id, text with each token as often as it occurs."""
        repeated = self.cells.select("document_id", "token", F.array_repeat(F.col("token").cast("string"), F.col("value").cast("int")).alias("_r"))
        return repeated.groupBy("document_id").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("token", "_r"))), lambda s: s["_r"])), " ").alias("text"))

    def term_pairs(self) -> DataFrame:
        """w1 < w2 and the sum over documents of the product of their values."""
        a, b = self.cells.toDF("document_id", "w1", "v1"), self.cells.toDF("document_id", "w2", "v2")
        return a.join(b, "document_id").where("w1 < w2").groupBy("w1", "w2").agg(F.sum(F.col("v1") * F.col("v2")).alias("value"))


def from_texts(docs: DataFrame, text: str = "text", **options) -> Dtm:
    """A5: from a column of texts; ``options`` as of ``vectorize``."""
    tokens = docs.select("document_id", F.posexplode(tokenize(F.lower(text))).alias("pos", "token"))
    return Dtm(vectorize(tokens, **options), docs.drop(text))


def from_tokens(docs: DataFrame, tokens: str = "tokens", **options) -> Dtm:
    """A5: from a column of token arrays."""
    return Dtm(vectorize(docs.select("document_id", F.posexplode(tokens).alias("pos", "token")), **options), docs.drop(tokens))


def from_bags(bags: DataFrame, index: DataFrame | None = None) -> Dtm:
    """From rows document_id, token, value, equal cells summed; without an index the documents that occur are it."""
    cells = bags.groupBy("document_id", "token").agg(F.sum("value").alias("value"))
    return Dtm(cells, cells.select("document_id").distinct() if index is None else index)


def from_pairs(coo: DataFrame, key: str = "document_id", sep: str = "/") -> Dtm:
    """Pairs as tokens ``w1/w2`` of a matrix."""
    return from_bags(coo.select(F.col(key).alias("document_id"), F.concat_ws(sep, "w1", "w2").alias("token"), "value"))
