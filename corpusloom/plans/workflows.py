"""Whole jobs: read, compute, store. ``python -m corpusloom.plans.workflows NAME SOURCE TARGET [key=value ...]`` runs one."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.tokens import TokensTransformOpts
from corpusloom.operators import cooccurrence, ml, tagged, topics, vocabulary
from corpusloom.operators.dtm import Dtm
from corpusloom.plans.config import named
from corpusloom.plans.pipeline import ContextOpts, Pipeline
from corpusloom.sources import text
from corpusloom.sources.store import Store, find_tags


def prepared(spark: SparkSession, source, pattern: str = "*.txt", transforms: str = "dehyphen,normalize-whitespace", min_len: int = 1, fields: tuple[str, ...] = (), tf_threshold: int = 1, keep: tuple[str, ...] = (), mask: bool = False) -> Pipeline:
    """Documents as filtered tokens; with a threshold, rare ones go or are masked before anything is paired or counted."""
    p = Pipeline.read(spark, source, pattern=pattern, fields=fields, transforms=transforms).tokenize().transform_tokens(TokensTransformOpts(min_len=min_len))
    return p.vocabulary(tf_threshold, keep, mask)


def vectorize(spark: SparkSession, source, target: str, min_df: int = 1, min_tf: int = 1, max_tokens: int | None = None, **reading) -> Store:
    """A document-term matrix and its index."""
    store = Store(spark, target)
    store.save_dtm(prepared(spark, source, **reading).to_dtm(min_df=min_df, min_tf=min_tf, max_tokens=max_tokens), min_df=min_df, min_tf=min_tf, max_tokens=max_tokens, **reading)
    return store


def co_occurrence(spark: SparkSession, source, target: str, opts: ContextOpts = ContextOpts(), **reading) -> Store:
    """Pairs by document (and those of concept windows), window counts, the index and the vocabulary."""
    p = prepared(spark, source, keep=opts.concepts, **reading)
    whole = ContextOpts(opts.width, threshold=opts.threshold)
    relations = {"pairs": p.to_pairs(whole), "window_counts": cooccurrence.window_counts(p.docs, opts.width), "index": p.index(), "vocabulary": p.vocab}
    if opts.concepts:
        relations["concept_pairs"] = p.to_pairs(opts)
    store = Store(spark, target)
    store.save({"width": opts.width, "concepts": list(opts.concepts), "threshold": opts.threshold, **reading}, **relations)
    return store


def train_topics(spark: SparkSession, source, target: str, k: int = 100, max_iter: int = 20, seed: int = 1, n_tokens: int = 200, minimum_probability: float = 0.005, **reading) -> Store:
    """A topic model with its relations: weights of tokens and documents, overview, vocabulary, index."""
    return _train(spark, prepared(spark, source, **reading).to_dtm(), target, k, max_iter, seed, n_tokens, minimum_probability, reading)


def _train(spark: SparkSession, dtm: Dtm, target: str, k: int, max_iter: int, seed: int, n_tokens: int, minimum_probability: float, options: dict) -> Store:
    """Trains and stores the model, its options and its relations."""
    model, vocab, vectors = ml.train_topics(dtm, k, max_iter, seed=seed)
    store = Store(spark, target)
    model.write().overwrite().save(f"{target}/model")
    store.save({"k": k, "max_iter": max_iter, "seed": seed, **options}, vocabulary=vocab, index=dtm.index)
    _store_topics(store, ml.topic_token_weights(model, store.load("vocabulary"), n_tokens), ml.predict_topics(model, vectors, minimum_probability), n_tokens)
    return store


def predict_topics(spark: SparkSession, model_folder: str, source, target: str, minimum_probability: float = 0.005, **reading) -> Store:
    """Topic weights of other documents; tokens that the model does not know count for nothing."""
    from pyspark.ml.clustering import DistributedLDAModel, LocalLDAModel

    trained, store = Store(spark, model_folder), Store(spark, target)
    kind = json.loads(spark.read.text(f"{model_folder}/model/metadata").first()[0])["class"]
    model = (DistributedLDAModel if kind.endswith("DistributedLDAModel") else LocalLDAModel).load(f"{model_folder}/model")
    dtm = prepared(spark, source, **reading).to_dtm()
    vectors = ml.vectors_in(dtm, trained.load("vocabulary"))
    store.save({"model": model_folder}, index=dtm.index, vocabulary=trained.load("vocabulary"))
    _store_topics(store, trained.load("topic_token_weights"), ml.predict_topics(model, vectors, minimum_probability), 200)
    return store


def merge_topics(spark: SparkSession, folder: str, clusters: dict[str, list[int]], target: str) -> Store:
    """Topics of a cluster become one, the rest is numbered anew."""
    old, store = Store(spark, folder), Store(spark, target)
    document_weights = topics.merge_topics(old.load("document_topic_weights"), clusters)
    token_weights = topics.merge_topics(old.load("topic_token_weights"), clusters)
    used = token_weights.select("topic_id").unionByName(document_weights.select("topic_id")).distinct()
    codes = topics.compress_topics(used.withColumn("_old", F.col("topic_id")))  # one row a topic
    renumbered = lambda df: df.withColumnRenamed("topic_id", "_old").join(codes, "_old").drop("_old")
    store.save({"clusters": {k: list(v) for k, v in clusters.items()}}, index=old.load("index"), vocabulary=old.load("vocabulary"))
    _store_topics(store, renumbered(token_weights), renumbered(document_weights), 200)
    return store


def _store_topics(store: Store, ttw: DataFrame, dtw: DataFrame, n_tokens: int) -> None:
    options = store.options()
    store.save(options, topic_token_weights=ttw, document_topic_weights=dtw)
    store.save(options, topic_token_overview=topics.overview(store.load("topic_token_weights"), n_tokens))


def load_dtm(spark: SparkSession, folder: str, **slices) -> Dtm:
    """S31."""
    return Store(spark, folder).load_dtm(**slices)


def tag_corpus(spark: SparkSession, source, target: str, tagger: str, **reading) -> Store:
    """Documents tagged by a function given by dotted name (text -> (token, lemma, tag) triples), stored as a row a token with the vocabulary."""
    p = Pipeline.read(spark, source, **reading)
    rows = p.index().join(tagged.tag(p.docs.select("document_id", "text"), named(tagger)), "document_id")
    store = Store(spark, target)
    store.save({"tagger": tagger}, docs=rows, index=p.index())
    store.save(store.options(), vocabulary=vocabulary.vocabulary(store.load("docs"), first_seen=False))
    return store


def extract_texts(spark: SparkSession, docs: DataFrame, target: str, opts: tagged.ExtractOpts = tagged.ExtractOpts(), **names) -> DataFrame:
    """Annotated XML texts (document_name, text) as texts of the tokens that pass, stored and read back: document_name, text."""
    rows = text.tagged_xml(docs, **names).withColumnRenamed("document_name", "document_id")
    found = tagged.to_documents(tagged.padded(tagged.filter_tagged(rows, opts), opts))
    found.select(F.col("document_id").alias("document_name"), F.array_join("tokens", " ").alias("text")).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def find_models(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Names of the topic models below a folder, with their options."""
    return {name: Store(spark, f"{folder}/{name}").options() for name in find_tags(spark, folder, "topic_token_weights")}


def stored(spark: SparkSession, folder: str, pos_includes: str = "", pos_excludes: str = "", lemmatize: bool = False, min_len: int = 1, to_lower: bool = False, tf_threshold: int = 1) -> Pipeline:
    """Tokens of a stored tagged corpus that pass the filters."""
    old = Store(spark, folder)
    opts = tagged.ExtractOpts(lemmatize=lemmatize, pos_includes=pos_includes, pos_excludes=pos_excludes)
    return Pipeline(old.load("docs")).filter_tagged(opts, TokensTransformOpts(min_len=min_len, to_lower=to_lower)).vocabulary(tf_threshold)


def vectorize_stored(spark: SparkSession, folder: str, target: str, min_df: int = 1, min_tf: int = 1, max_tokens: int | None = None, **filters) -> Store:
    """A document-term matrix of a stored tagged corpus."""
    store = Store(spark, target)
    store.save_dtm(stored(spark, folder, **filters).to_dtm(min_df=min_df, min_tf=min_tf, max_tokens=max_tokens), source=folder, **filters)
    return store


def train_topics_stored(spark: SparkSession, folder: str, target: str, k: int = 100, max_iter: int = 20, seed: int = 1, n_tokens: int = 200, minimum_probability: float = 0.005, **filters) -> Store:
    """A topic model of a stored tagged corpus."""
    return _train(spark, stored(spark, folder, **filters).to_dtm(), target, k, max_iter, seed, n_tokens, minimum_probability, {"source": folder, **filters})


def main(args: list[str]) -> None:
    """NAME SOURCE TARGET [key=value ...]; predict-topics also takes model=FOLDER, merge-topics clusters as JSON."""
    name, source, target, *rest = args
    value = lambda v: int(v) if v.lstrip("-").isdigit() else {"true": True, "false": False}.get(v, v)
    options = {k: value(v) for k, v in (r.split("=", 1) for r in rest)}
    jobs = {
        "vectorize": vectorize, "co-occurrence": co_occurrence, "train-topics": train_topics, "vectorize-id": vectorize_stored, "train-topics-id": train_topics_stored, "pos-tag": tag_corpus,
        "predict-topics": lambda spark, source, target, model, **o: predict_topics(spark, model, source, target, **o),
        "merge-topics": lambda spark, source, target, clusters: merge_topics(spark, source, json.loads(clusters), target),
    }
    if name not in jobs:
        raise SystemExit(f"{name} is none of {', '.join(jobs)}")
    jobs[name](SparkSession.builder.appName(f"corpusloom {name}").getOrCreate(), source, target, **options)


if __name__ == "__main__":
    main(sys.argv[1:])
