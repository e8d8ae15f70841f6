"""Operators on tagged tokens: one row a token, with document_id, pos (its place), token, lemma and pos_tag.

The filter stack is one boolean column; its order is fixed: value filters, tag includes and paddings, tag excludes, token mask,
then OR passthrough words, AND NOT blocked words, and at last the term frequency threshold, from which passthroughs are exempt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.predicates import mask
from corpusloom.functions.tokens import PAD, TokensTransformOpts
from corpusloom.operators.vocabulary import mask_low_tf
from corpusloom.operators.windows import phrase_positions

# The tags of three schemes by group, in the schemes' order of tags.
SUC = {
    "AB": "Adverb", "DT": "Pronoun", "HA": "Adverb", "HD": "Pronoun", "HP": "Pronoun", "HS": "Pronoun", "IE": "Adverb", "IN": "Adverb", "JJ": "Adjective", "KN": "Conjunction",
    "NN": "Noun", "PC": "Verb", "PL": "Adverb", "PM": "Noun", "PN": "Pronoun", "PP": "Preposition", "PS": "Pronoun", "RG": "Numeral", "RO": "Numeral", "SN": "Conjunction",
    "UO": "Other", "VB": "Verb", "MAD": "Delimiter", "MID": "Delimiter", "PAD": "Delimiter",
}
UNIVERSAL = {
    "ADJ": "Adjective", "ADP": "Preposition", "ADV": "Adverb", "AUX": "Other", "CONJ": "Conjunction", "CCONJ": "Conjunction", "DET": "Pronoun", "INTJ": "Adverb", "NOUN": "Noun",
    "NUM": "Numeral", "PART": "Adverb", "PRON": "Pronoun", "PROPN": "Noun", "PUNCT": "Delimiter", "SCONJ": "Conjunction", "SYM": "Other", "VERB": "Verb", "X": "Other",
    "EOL": "Delimiter", "SPACE": "Delimiter",
}
PENN_TREE = {
    "$": "Other", "``": "Delimiter", "''": "Delimiter", ",": "Delimiter", "-LRB-": "Delimiter", "-RRB-": "Delimiter", ".": "Delimiter", ":": "Delimiter", "ADD": "Other",
    "AFX": "Adjective", "CC": "Conjunction", "CD": "Numeral", "DT": "Pronoun", "EX": "Pronoun", "FW": "Other", "GW": "Other", "HYPH": "Delimiter", "IN": "Preposition",
    "JJ": "Adjective", "JJR": "Adjective", "JJS": "Adjective", "LS": "Other", "MD": "Verb", "NFP": "Delimiter", "NIL": "Other", "NN": "Noun", "NNP": "Noun", "NNPS": "Noun",
    "NNS": "Noun", "PDT": "Pronoun", "POS": "Adverb", "PRP": "Pronoun", "PRP$": "Pronoun", "RB": "Adverb", "RBR": "Adverb", "RBS": "Adverb", "RP": "Adverb", "SP": "Delimiter",
    "SYM": "Other", "TO": "Adverb", "UH": "Adverb", "VB": "Verb", "VBD": "Verb", "VBG": "Verb", "VBN": "Verb", "VBP": "Verb", "VBZ": "Verb", "WDT": "Pronoun", "WP": "Pronoun",
    "WP$": "Pronoun", "WRB": "Adverb", "XX": "Other", "_SP": "Delimiter",
}
SCHEMES = {"SUC": SUC, "Universal": UNIVERSAL, "PennTree": PENN_TREE}
# The groups, numbered from 1.
GROUPS = ("Pronoun", "Noun", "Verb", "Adverb", "Numeral", "Adjective", "Preposition", "Conjunction", "Delimiter", "Other")


def tags_of(scheme: str, *groups: str) -> list[str]:
    return [t for t, g in SCHEMES[scheme].items() if g in groups]


def tags_except(scheme: str, *tags_or_groups: str) -> list[str]:
    """All tags but the named tags and groups and the delimiters."""
    return [t for t, g in SCHEMES[scheme].items() if t not in tags_or_groups and g not in tags_or_groups and g != "Delimiter"]


def tag_group(tag: Column, scheme: str = "SUC") -> Column:
    """The group of a tag, null if unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in SCHEMES[scheme].items() for x in pair]), tag)


def tag_set(spec: str | tuple | list | set | None) -> list[str]:
    """``|A|B|`` or a collection of tags; an empty string is the set of the empty tag."""
    if spec is None:
        return []
    return sorted(set(spec.strip("|").split("|"))) if isinstance(spec, str) else sorted(spec)


@dataclass(frozen=True)
class ExtractOpts:
    """what to take from tagged tokens."""

    lemmatize: bool = False
    target: str | None = None
    pos_includes: str | tuple = ""
    pos_excludes: str | tuple | None = ""
    pos_paddings: str | tuple = ""
    passthroughs: tuple[str, ...] = ()
    blocks: tuple[str, ...] = ()
    append_pos: bool = False
    phrases: tuple[tuple[str, ...], ...] = ()
    tf_threshold: int = 1
    tf_mask: bool = False
    filters: dict = field(default_factory=dict)

    @property
    def column(self) -> str:
        return self.target or ("lemma" if self.lemmatize else "token")


def filter_tagged(tokens: DataFrame, opts: ExtractOpts, transform: TokensTransformOpts | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """document_id, pos, token (the target), pos_tag of the rows that pass the stack; ``vocab`` (token, tf) serves the threshold."""
    lower = opts.lemmatize or bool(transform and transform.to_lower)
    target = F.lower(opts.column) if lower else F.col(opts.column)
    passing = [p.lower() for p in opts.passthroughs] if lower else list(opts.passthroughs)
    rows = tokens.withColumn("_target", target)
    if opts.phrases:
        phrases = [tuple(w.lower() for w in p) for p in opts.phrases] if lower else list(opts.phrases)
        rows = phrase_positions(rows, phrases, "_target")
        passing += ["_".join(p) for p in phrases]
    keep = mask(rows, opts.filters)
    includes, paddings = [t for t in tag_set(opts.pos_includes) if t], [t for t in tag_set(opts.pos_paddings) if t]
    if includes:
        keep &= F.col("pos_tag").isin(*includes, *paddings)
    if excludes := tag_set(opts.pos_excludes):
        keep &= ~F.col("pos_tag").isin(*excludes)
    if transform:
        keep &= transform.mask(F.col("_target"))
    if passing:
        keep |= F.col("_target").isin(*passing)
    keep &= ~F.col("_target").isin(*opts.blocks, "")
    found = rows.where(keep).select("document_id", "pos", F.col("_target").alias("token"), "pos_tag")
    if opts.tf_threshold > 1 and vocab is not None:
        found = mask_low_tf(found, vocab, opts.tf_threshold, tuple(passing), drop=not opts.tf_mask)
    return found


def padded(found: DataFrame, opts: ExtractOpts) -> DataFrame:
    """tokens of padded tags become ``*`` (passthroughs do not); on demand ``token@TAG``; followers of phrases go."""
    paddings = [t for t in tag_set(opts.pos_paddings) if t]
    out = F.col("token")
    if opts.append_pos:
        out = F.concat_ws("@", F.col("token"), F.col("pos_tag"))
    if paddings:
        pad = F.col("pos_tag").isin(*paddings)
        if opts.passthroughs:
            pad &= ~F.col("token").isin(*opts.passthroughs)
        out = F.when(pad, F.lit(PAD)).otherwise(out)
    rows = found.where(F.col("token") != "(*)") if opts.phrases or opts.append_pos else found
    return rows.withColumn("token", out)


def to_documents(tokens: DataFrame) -> DataFrame:
    """document_id, tokens in their order."""
    return tokens.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("tokens"))


def group_counts(tokens: DataFrame, scheme: str = "SUC") -> DataFrame:
    """document_id, a count per tag group, n_raw_tokens and n_tokens (all but delimiters; unknown tags count)."""
    group = tag_group(F.col("pos_tag"), scheme)
    counts = [F.count_if(group == g).alias(g) for g in GROUPS]
    n = F.count_if(F.coalesce(group, F.lit("")) != "Delimiter")
    return tokens.groupBy("document_id").agg(*counts, n.alias("n_raw_tokens"), n.alias("n_tokens"))


def group_statistics(counts: DataFrame, index: DataFrame, key: Column, pivots: list[str] = (), normalize: bool = False) -> DataFrame:
    """Sums of the group counts per period and pivot columns, on demand over the group's n_tokens."""
    rows = counts.join(index.select("document_id", key.alias("period"), *pivots), "document_id")
    sums = rows.groupBy("period", *pivots).agg(*[F.sum(c).alias(c) for c in (*GROUPS, "n_tokens")])
    return sums.withColumns({g: F.coalesce(F.try_divide(F.col(g), F.col("n_tokens")), F.lit(0.0)) for g in GROUPS}) if normalize else sums


def base_form(lemma: Column, token: Column) -> Column:
    """The first of ``|a|b|``, blanks to ``_``, colons to ``|``, the token where there is none; lower case."""
    first = F.split(F.trim(lemma, F.lit("|")), r"\|")[0]
    first = F.replace(F.replace(first, F.lit(" "), F.lit("_")), F.lit(":"), F.lit("|"))
    return F.lower(F.when(first == "", token).otherwise(first))


def tag(docs: DataFrame, tagger: Callable[[str], list[tuple[str, str, str]]]) -> DataFrame:
    """document_id, pos, token, lemma, pos_tag by any function text -> [(token, lemma, tag)]; built once a task if it has ``setup``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = tagger.setup() if hasattr(tagger, "setup") else tagger
        for batch in batches:
            rows = [(d, k, *t) for d, x in zip(batch["document_id"], batch["text"], strict=True) for k, t in enumerate(fn(x or ""))]
            yield pd.DataFrame(rows, columns=["document_id", "pos", "token", "lemma", "pos_tag"])

    return docs.select("document_id", "text").mapInPandas(run, "document_id long, pos int, token string, lemma string, pos_tag string")


def filter_attributes(tokens: DataFrame, token: str = "token", **flags: bool) -> DataFrame:
    """rows of tokens that are not white space and whose flag columns (is_alpha, is_stop, ...) are as wanted."""
    keep = F.trim(F.col(token)) != ""
    for name, wanted in flags.items():
        keep &= F.col(name) == F.lit(wanted)
    return tokens.where(keep)
