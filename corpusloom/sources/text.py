"""Readers: text folders, zip archives, CSV, XML, HTML, indexes, lists. All return DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.predicates import value_predicate
from corpusloom.functions.text import transform_text
from corpusloom.functions.tokens import TOKEN_PATTERN, chunks, sentences, tokenize
from corpusloom.operators.index import dense_ids, filename_fields, strip_path_and_extension
from corpusloom.operators.tagged import base_form


def _named(df: DataFrame, filename: Column) -> DataFrame:
    name = F.regexp_replace(filename, r"^.*/", "")
    return df.withColumn("filename", name).withColumn("document_name", strip_path_and_extension(name))


def read_text_folder(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One row a file: filename, document_name, text."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).withColumn("_f", F.col("_metadata.file_path"))
    return _named(files, F.url_decode("_f")).select("filename", "document_name", F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """One row a line, on demand ``name<sep>text``."""
    lines = spark.read.text(path)
    if sep is None:
        return lines.select(F.col("value").alias("text"))
    parts = F.split("value", "\\Q" + sep + "\\E", 2)
    return lines.select(parts[0].alias("document_name"), F.get(parts, F.lit(1)).alias("text"))


def zip_members(batches: Iterator[pd.DataFrame], matches: re.Pattern, encoding: str) -> Iterator[pd.DataFrame]:
    """Members of archives, some megabytes at a time."""
    names, texts, size = [], [], 0
    for batch in batches:
        for content in batch["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for name in sorted(archive.namelist()):
                    if not name.endswith("/") and matches.match(name.rsplit("/", 1)[-1]):
                        data = archive.read(name)
                        names.append(name), texts.append(data.decode(encoding))
                        size += len(data)
                        if size >= 8 << 20:
                            yield pd.DataFrame({"filename": names, "text": texts})
                            names, texts, size = [], [], 0
    if names:
        yield pd.DataFrame({"filename": names, "text": texts})


def read_zip(spark: SparkSession, path: str, pattern: str = "*.txt", encoding: str = "utf-8") -> DataFrame:
    """One row a member of the archive(s): filename, document_name, text. An archive is read by one task and has at most 2 GB; more data come as several archives."""
    import fnmatch

    matches = re.compile(fnmatch.translate(pattern))
    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lambda it: zip_members(it, matches, encoding), "filename string, text string")
    return _named(rows, F.col("filename"))


def read_any(spark: SparkSession, source, pattern: str = "*.txt", names: Iterable[str] | None = None) -> DataFrame:
    """A zip, a folder or file, a DataFrame, texts or (name, text) pairs; ``names`` keeps files of these names."""
    if isinstance(source, DataFrame):
        found = source
    elif isinstance(source, str) and source.endswith(".zip"):
        found = read_zip(spark, source, pattern)
    elif isinstance(source, str):
        found = read_text_folder(spark, source, pattern)
    else:
        pairs = [x if isinstance(x, tuple) else (f"document_{k}.txt", x) for k, x in enumerate(source)]
        found = _named(spark.createDataFrame(pairs, "filename string, text string"), F.col("filename"))
    return found.where(F.col("filename").isin(*names)) if names is not None else found


def read_documents(spark: SparkSession, source, pattern: str = "*.txt", fields: Iterable[str] = (), transforms: str = "", types: dict[str, str] | None = None) -> DataFrame:
    """Read, transform, take metadata from file names (``types``: casts of the fields)."""
    found = read_any(spark, source, pattern)
    if transforms:
        found = found.withColumn("text", transform_text(F.col("text"), transforms))
    for name, column in filename_fields(F.col("filename"), fields).items():
        found = found.withColumn(name, column.cast((types or {}).get(name, "string")))
    return found


def read_tokens(spark: SparkSession, source, chunk_size: int | None = None, pattern: str = TOKEN_PATTERN, **options) -> DataFrame:
    """Documents with arrays of tokens, on demand cut into chunks named ``_001``, ``_002``, ..."""
    docs = read_documents(spark, source, **options).withColumn("tokens", tokenize(F.col("text"), pattern)).drop("text")
    if not chunk_size:
        return docs
    rows = docs.select("*", F.posexplode_outer(chunks(F.col("tokens"), chunk_size)).alias("_k", "_c"))
    number = F.lpad((F.coalesce("_k", F.lit(0)) + 1).cast("string"), 3, "0")
    return rows.withColumns({"document_name": F.concat("document_name", F.lit("_"), number), "tokens": F.coalesce("_c", F.array().cast("array<string>"))}).drop("_k", "_c")


def from_frame(df: DataFrame, text: str = "text", filename: str = "filename", **filters) -> DataFrame:
    """Rows as documents; filters: a pair is a range, a list a set, anything else equality."""
    for name, value in filters.items():
        df = df.where(value_predicate(F.col(name), value))
    return df.withColumnsRenamed({text: "text", filename: "filename"})


def segments(docs: DataFrame, kind: str = "document", size: int = 1000) -> DataFrame:
    """Documents as they are, as sentences, or as chunks of tokens: adds segment (from 0)."""
    if kind == "document":
        return docs.withColumn("segment", F.lit(0))
    if kind == "sentence":
        parts = sentences(F.col("text"))
    else:
        parts = F.transform(chunks(tokenize(F.col("text")), size), lambda c: F.array_join(c, " "))
    return docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(parts).alias("segment", "text"))


def tagged_csv(spark: SparkSession, path: str, text: str = "token", lemma: str = "baseform", tag: str = "pos", sep: str = "\t", sparv: bool = False) -> DataFrame:
    """One row a token: document_name, pos, token, lemma, pos_tag; a file's lines stay in order.

    ``sparv``: the second line is a comment and base forms are lists.
    """
    files = spark.read.text(path, wholetext=True).withColumn("_f", F.url_decode(F.col("_metadata.file_path")))
    named = _named(files, F.col("_f"))
    lines = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")
    header = F.split(lines[0], "\\Q" + sep + "\\E")
    body = F.slice(lines, 3 if sparv else 2, F.size(lines))
    rows = named.select("document_name", header.alias("_h"), F.posexplode(body).alias("pos", "_line"))
    cells = F.split("_line", "\\Q" + sep + "\\E", -1)
    of = lambda name: F.get(cells, F.array_position("_h", F.lit(name)).cast("int") - 1)
    rows = rows.select("document_name", "pos", of(text).alias("token"), of(lemma).alias("lemma"), of(tag).alias("pos_tag"))
    return rows.withColumn("lemma", base_form(F.coalesce("lemma", F.lit("")), F.col("token"))) if sparv else rows


def xml_tokens(content: str, token: str = "w", lemma: str = "lemma", tag: str = "pos") -> list[tuple[str, str, str]]:
    """(token, lemma, tag) of the token elements of an annotated XML text, in order; lemma lists keep their form."""
    out = []
    for e in ElementTree.fromstring(content).iter():
        if e.tag.rsplit("}", 1)[-1] == token:
            word = "".join(e.itertext()).strip()
            out.append((word, e.get(lemma) or e.get("baseform") or "", e.get(tag) or ""))
    return out


def tagged_xml(docs: DataFrame, **names) -> DataFrame:
    """document_name, pos, token, lemma, pos_tag of annotated XML texts (document_name, text)."""

    def run(batches):
        for batch in batches:
            rows = [(d, k, *t) for d, x in zip(batch["document_name"], batch["text"], strict=True) for k, t in enumerate(xml_tokens(x, **names))]
            yield pd.DataFrame(rows, columns=["document_name", "pos", "token", "lemma", "pos_tag"])

    rows = docs.select("document_name", "text").mapInPandas(run, "document_name string, pos int, token string, lemma string, pos_tag string")
    return rows.withColumn("lemma", base_form(F.col("lemma"), F.col("token")))


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags go, block ends become line breaks, the common entities characters."""
    x = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|ul|ol|table|section|article|nav)>", "\n"), r"(?s)<[^>]*>", " ")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(c))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t\x0B\f\r]+", " "), r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def document_index(df: DataFrame, filename: str = "filename", year: str | None = None) -> DataFrame:
    """Adds document_id (by file name), document_name and year."""
    named = df.withColumn("filename", F.col(filename)).withColumn("document_name", strip_path_and_extension(F.col("filename")))
    if year:
        named = named.withColumn("year", F.col(year).cast("int"))
    return dense_ids(named, ["filename"])


def find_document(docs: DataFrame, name: str) -> DataFrame:
    """One document by name."""
    return docs.where(F.col("document_name") == name)


def render(template: str, columns: Iterable[str]) -> Column:
    """A template with ``{column}`` places."""
    pieces = re.split(r"\{(\w+)\}", template)
    known = set(columns)
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if k % 2 and p in known else F.lit(p) for k, p in enumerate(pieces)])


def doc_topics(spark: SparkSession, path: str, normalize: bool = False, least: float = 0.005) -> DataFrame:
    """document_id, topic_id, weight from lines ``id<tab>name<tab>topic<tab>weight<tab>topic<tab>weight...``; lines that begin with # are comments.

    Weights under ``least`` go; on demand a document's others are made to sum to 1.
    """
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(parts[0].cast("long").alias("document_id"), F.slice(parts, 3, F.size(parts)).alias("_p"))
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("_p") / 2).cast("int")), lambda i: F.struct(F.get("_p", 2 * i - 2).cast("double").cast("int").alias("topic_id"), F.get("_p", 2 * i - 1).cast("double").alias("weight")))
    pairs = F.filter(F.when(F.size("_p") >= 2, pairs), lambda p: p["weight"] >= least)
    rows = rows.withColumn("_p", pairs).withColumn("_sum", F.aggregate("_p", F.lit(0.0), lambda a, p: a + p["weight"]) if normalize else F.lit(1.0))
    return rows.select("document_id", "_sum", F.explode("_p").alias("_p")).select("document_id", F.col("_p.topic_id").alias("topic_id"), (F.col("_p.weight") / F.col("_sum")).alias("weight"))


def topic_words(spark: SparkSession, path: str) -> DataFrame:
    """topic_id, token, weight from lines ``topic<tab>token<tab>weight``; the smallest weight is what every token has, so its rows go."""
    rows = spark.read.csv(path, sep="\t", schema="topic_id int, token string, weight double")
    least = rows.agg(F.min("weight").alias("_least"))
    return rows.join(F.broadcast(least)).where("weight > _least").drop("_least")  # one row


def topic_keys(spark: SparkSession, path: str) -> DataFrame:
    """topic_id, alpha, tokens from lines ``topic<tab>alpha<tab>tokens``."""
    return spark.read.csv(path, sep="\t", schema="topic_id int, alpha double, tokens string")


def read_text(spark: SparkSession, source: str, filename: str) -> str | None:
    """The text of one file of a folder or archive, None if there is none of that name."""
    found = read_any(spark, source, pattern=filename).where(F.col("filename") == filename).select("text").take(1)
    return found[0][0] if found else None


def read_feather(spark: SparkSession, path: str, schema: str, pattern: str = "*.feather") -> DataFrame:
    """Arrow files of a folder, one table each: document_name and the columns of ``schema``; write Parquet from it once."""
    import pyarrow as pa
    from pyarrow import feather

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["document_name"], batch["content"], strict=True):
                for chunk in feather.read_table(pa.BufferReader(content)).to_batches(max_chunksize=10_000):
                    frame = chunk.to_pandas()
                    frame.insert(0, "document_name", name)
                    yield frame

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    named = _named(files, F.url_decode(F.col("path"))).select("document_name", "content")
    return named.mapInPandas(run, f"document_name string, {schema}")


def read_vocabulary(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """token_id, token, tf from delimited text with a header; tf is null where there is none."""
    rows = spark.read.csv(path, sep=sep, header=True)
    return rows.select(F.col("token_id").cast("int").alias("token_id"), "token", (F.col("tf") if "tf" in rows.columns else F.lit(None)).cast("long").alias("tf"))
