"""A fluent, lazy pipeline: every call returns a new one, and nothing runs before a result is asked for.

``Pipeline.read(spark, folder).transform_text("dehyphen").tokenize().transform_tokens(opts).to_dtm()``; two recipes are joined with
``+``. Recipes are functions on pipelines, so own steps are added by ``apply``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.keyness import significance
from corpusloom.functions.text import transform_text
from corpusloom.functions.tokens import TOKEN_PATTERN, TokensTransformOpts, tokenize
from corpusloom.operators import cooccurrence, ml, tagged, vocabulary
from corpusloom.operators.dtm import Dtm, vectorize
from corpusloom.sources.store import Store, checkpoint
from corpusloom.sources.text import read_documents


@dataclass(frozen=True)
class ContextOpts:
    """How token pairs are found."""

    width: int = 2
    concepts: tuple[str, ...] = ()
    ignore_concept: bool = False
    threshold: int = 1


@dataclass(frozen=True)
class Pipeline:
    """docs: document_id, document_name, ..., and one content column: text, tokens, or a row a token (pos, token, lemma, pos_tag)."""

    docs: DataFrame
    vocab: DataFrame | None = None

    @staticmethod
    def read(spark: SparkSession, source, **options) -> Pipeline:
        """Documents of a folder, archive, table or list; ids are hashes of names, which need no order."""
        docs = read_documents(spark, source, **options)
        return Pipeline(docs if "document_id" in docs.columns else docs.withColumn("document_id", F.xxhash64("document_name")))

    @staticmethod
    def of_tokens(docs: DataFrame) -> Pipeline:
        """Documents that are token arrays already (document_id, tokens, ...)."""
        return Pipeline(docs)

    def apply(self, step: Callable[[Pipeline], Pipeline]) -> Pipeline:
        """H4: any step."""
        return step(self)

    def project(self, fn: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """F1, H3."""
        return replace(self, docs=fn(self.docs))

    def transform_text(self, keys: str) -> Pipeline:
        return replace(self, docs=self.docs.withColumn("text", transform_text(F.col("text"), keys)))

    def tokenize(self, pattern: str = TOKEN_PATTERN, lowercase: bool = True) -> Pipeline:
        text = F.lower("text") if lowercase else F.col("text")
        return replace(self, docs=self.docs.withColumn("tokens", tokenize(text, pattern)).drop("text"))

    def transform_tokens(self, opts: TokensTransformOpts) -> Pipeline:
        """Also keeps the numbers of tokens before and after."""
        docs = self.docs.withColumn("n_raw_tokens", F.size("tokens")).withColumn("tokens", opts.apply(F.col("tokens")))
        return replace(self, docs=docs.withColumn("n_tokens", F.size("tokens")))

    def to_text(self) -> Pipeline:
        return replace(self, docs=self.docs.withColumn("text", F.array_join("tokens", " ")).drop("tokens"))

    def index(self) -> DataFrame:
        """The documents' attributes."""
        content = {"text", "tokens", "pos", "token", "lemma", "pos_tag"}
        rows = self.docs.select(*[c for c in self.docs.columns if c not in content])
        return rows.distinct() if "pos" in self.docs.columns else rows

    def long(self) -> DataFrame:
        """document_id, pos, token."""
        return self.docs.select("document_id", F.posexplode("tokens").alias("pos", "token")) if "tokens" in self.docs.columns else self.docs

    def filter_tagged(self, opts: tagged.ExtractOpts, transform: TokensTransformOpts | None = None) -> Pipeline:
        """Tagged rows to arrays of the tokens that pass."""
        found = tagged.padded(tagged.filter_tagged(self.docs, opts, transform, self.vocab), opts)
        return replace(self, docs=self.index().join(tagged.to_documents(found), "document_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))))

    def vocabulary(self, threshold: int = 1, keep: tuple[str, ...] = (), mask: bool = False) -> Pipeline:
        """The vocabulary; with a threshold rare tokens go, or are masked."""
        vocab = vocabulary.term_counts(self.long()).select("token", "tf")
        if threshold <= 1:
            return replace(self, vocab=vocab)
        rows = vocabulary.mask_low_tf(self.long().select("document_id", "pos", "token"), vocab, threshold, keep, drop=not mask)
        docs = self.index().join(tagged.to_documents(rows), "document_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
        return Pipeline(docs, vocabulary.compress(vocab, threshold, keep))

    def to_dtm(self, **options) -> Dtm:
        """A3."""
        return Dtm(vectorize(self.long(), **options), self.index())

    def to_pairs(self, opts: ContextOpts = ContextOpts(), keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
        """A34."""
        pairs = cooccurrence.concept_pairs(self.docs, opts.width, opts.concepts, keys, ignore_concept=opts.ignore_concept) if opts.concepts else cooccurrence.window_pairs(self.docs, opts.width, keys)
        return cooccurrence.above_global_threshold(pairs, opts.threshold) if opts.threshold > 1 else pairs

    def to_keyness(self, metric: str, opts: ContextOpts = ContextOpts(), keys: tuple[str, ...] = ()) -> DataFrame:
        """M13."""
        words = self.docs.groupBy(*keys).agg(F.sum(F.size("tokens")).alias("n_words"))
        return significance(self.to_pairs(opts, keys), metric, list(keys), words if keys else None)

    def to_topics(self, k: int, **options):
        """(model, vocabulary, vectors)."""
        return ml.train_topics(self.to_dtm(), k, **options)

    def checkpoint(self, path: str, force: bool = False) -> Pipeline:
        """K1: from here on the stored documents."""
        return replace(self, docs=checkpoint(self.docs.sparkSession, path, lambda: self.docs, force))

    def tap(self, path: str) -> Pipeline:
        """K7: stores a copy on the way."""
        self.docs.write.mode("overwrite").parquet(path)
        return self

    def check(self, predicate, message: str) -> Pipeline:
        """an error when a row fails."""
        return replace(self, docs=self.docs.where(F.when(predicate, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))))

    def reduce(self, aggregate: Callable[[], Column] | Column, zero=None):
        """All documents folded to one value by an aggregate expression; ``zero`` where there are none. Partial results are made in tasks."""
        value = self.docs.agg(aggregate() if callable(aggregate) else aggregate).first()[0]
        return zero if value is None else value

    def exhaust(self) -> Pipeline:
        """everything is computed and nothing kept."""
        self.docs.write.format("noop").mode("overwrite").save()
        return self

    def single(self):
        """the one row that there is, an error otherwise."""
        rows = self.docs.limit(2).collect()
        if len(rows) != 1:
            raise ValueError("there is not exactly one document")
        return rows[0]

    def take(self, n: int) -> Pipeline:
        """F14."""
        return replace(self, docs=self.docs.orderBy("document_id").limit(n))

    def store(self, folder: str, **options) -> Store:
        """K6."""
        store = Store(self.docs.sparkSession, folder)
        store.save(options, docs=self.docs, **({"vocabulary": self.vocab} if self.vocab is not None else {}))
        return store


@dataclass(frozen=True)
class Recipe:
    """Steps to be applied to pipelines; ``+`` puts one after the other."""

    steps: tuple[Callable[[Pipeline], Pipeline], ...] = ()

    def __add__(self, other: Recipe) -> Recipe:
        return Recipe(self.steps + other.steps)

    def __call__(self, pipeline: Pipeline) -> Pipeline:
        return reduce(lambda p, step: step(p), self.steps, pipeline)
