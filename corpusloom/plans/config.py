"""Corpora described by files: JSON, or YAML where a parser is installed.

    corpus_name: letters
    text_reader_opts: {source: s3a://texts/, filename_pattern: "*.txt", filename_fields: ["year:_:1"], types: {year: int}}
    text_transform_opts: dehyphen,normalize-whitespace
    pipelines:
      words:
        - tokenize
        - transform_tokens: {min_len: 2, to_lower: true}
        - vocabulary: {threshold: 10}

``text_transform_opts`` may name own transforms: {preprocessors: "dehyphen,mine", mine: {name: package.module.function, arguments: {...}}};
such a function takes a column (and the arguments) and gives a column. Steps of a pipeline are its methods, or functions on
pipelines by dotted name.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.tokens import TokensTransformOpts
from corpusloom.plans.pipeline import Pipeline


def dotget(tree: dict, path: str, default=None):
    """A value of nested dictionaries by ``a.b.c``, or by the first of several such paths that there is (``a.b|c.d``)."""
    for one in path.split("|"):
        at = tree
        for key in one.split("."):
            if not isinstance(at, dict) or key not in at:
                break
            at = at[key]
        else:
            return at
    return default


def named(name: str) -> Callable:
    """H2, H5: what a dotted name stands for: a function of a module, or a method of a class in it."""
    parts = name.split(".")
    for cut in range(len(parts) - 1, 0, -1):
        try:
            at = importlib.import_module(".".join(parts[:cut]))
        except ModuleNotFoundError as e:
            # only the name itself may be missing, not what it imports
            if not ".".join(parts[:cut]).startswith(e.name or "?"):
                raise
            continue
        for part in parts[cut:]:
            at = getattr(at, part)
        return at
    raise ValueError(f"nothing has the name {name}")


class Registry:
    """Things by key, registered with a decorator; a key is one thing."""

    def __init__(self) -> None:
        self.items: dict[str, object] = {}

    def register(self, key: str | None = None):
        def add(item):
            self.items[key or item.__name__] = item
            return item

        return add

    def __contains__(self, key: str) -> bool:
        return key in self.items

    def get(self, key: str):
        if key not in self.items:
            raise ValueError(f"{key} is not registered")
        return self.items[key]


def parsed(text: str) -> dict:
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no JSON, and no YAML parser is installed") from e
        return yaml.safe_load(text)


@dataclass(frozen=True)
class CorpusConfig:
    """Values of a corpus's file; everything in it is reached by ``value("a.b", default)``."""

    tree: dict = field(default_factory=dict)

    @staticmethod
    def load(spark: SparkSession, path: str) -> CorpusConfig:
        """From any file system that Spark reaches."""
        return CorpusConfig.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one file

    @staticmethod
    def loads(text: str) -> CorpusConfig:
        return CorpusConfig(parsed(text))

    def value(self, path: str, default=None):
        return dotget(self.tree, path, default)

    def resolved(self, path: str, **given):
        """The object that the value describes: {class_name: dotted name, options: {...}}, or a dotted name alone."""
        what = self.value(path)
        if what is None:
            raise ValueError(f"{path} is not configured")
        if isinstance(what, str):
            return named(what)(**given)
        if "class_name" not in what:
            raise ValueError(f"{path} has no class_name")
        return named(what["class_name"])(**what.get("options", {}), **given)

    def transforms(self) -> tuple[str, dict[str, Callable]]:
        """H2: keys of text transforms, and own transforms by key."""
        opts = self.value("text_transform_opts") or ""
        if isinstance(opts, str):
            return opts, {}
        keys, own = opts.get("preprocessors", ""), {}
        for key, spec in opts.items():
            if key == "preprocessors" or key not in keys.split(","):
                continue
            if "name" not in spec:
                raise ValueError(f"transform {key} has no name")
            own[key] = partial(named(spec["name"]), **spec.get("arguments", {}))
        return keys, own

    def read(self, spark: SparkSession, source=None) -> Pipeline:
        """The corpus's documents, read and transformed."""
        opts = self.value("text_reader_opts", {})
        p = Pipeline.read(spark, source if source is not None else opts["source"], pattern=opts.get("filename_pattern", "*.txt"), fields=opts.get("filename_fields", ()), types=opts.get("types"))
        keys, own = self.transforms()
        for key in filter(None, (k.strip() for k in keys.split(","))):
            p = p.project(lambda df, fx=own[key]: df.withColumn("text", fx(F.col("text")))) if key in own else p.transform_text(key)
        return p

    def pipeline(self, spark: SparkSession, name: str, source=None):
        """The named pipeline on the corpus; its last step may give something else than a pipeline."""
        steps = self.value(f"pipelines.{name}")
        if steps is None:
            raise ValueError(f"there is no pipeline {name}")
        p = self.read(spark, source)
        for step in steps:
            key, options = (step, {}) if isinstance(step, str) else next(iter(step.items()))
            if key == "transform_tokens":
                p = p.transform_tokens(TokensTransformOpts(**options))
            elif hasattr(Pipeline, key):
                p = getattr(p, key)(**options)
            else:
                p = named(key)(p, **options)
        return p
