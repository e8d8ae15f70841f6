"""Text transforms as column expressions, and the registry that composes them from a comma-separated specification.

A specification reads left to right: ``"dehyphen,normalize-whitespace"``, with arguments as ``key?arg``, ``key?name=value&name=value``
or ``key?[a,b]``; ``-`` and ``_`` in keys mean the same.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Groups of look-alike characters; the first of a group stands for the rest.
CHARACTER_GROUPS = {
    "hyphens": "-‐‑⁃‒–—―",
    "minuses": "-−－⁻",
    "pluses": "+＋⁺",
    "slashes": "/⁄∕",
    "tildes": "~˜⁓∼∽∿〜～",
    "apostrophes": "'’՚Ꞌꞌ＇",
    "single_quotes": "'‘’‚‛",
    "double_quotes": '"“”„‟',
    "accents": "`´",
    "primes": "′″‴‵‶‷⁗",
}
# Fixed value: capital letters that may follow a period.
CAPITALS = "0-9A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝ\\-\\–"

Transform = Callable[..., Column]


class Registry:
    """Named functions; one function may have several keys."""

    def __init__(self) -> None:
        self.items: dict[str, Callable] = {}

    @staticmethod
    def normal(key: str) -> str:
        return key.strip().lower().replace("_", "-")

    def register(self, keys: str) -> Callable:
        def add(fn):
            self.items.update({self.normal(k): fn for k in keys.split(",")})
            return fn

        return add

    def get(self, key: str) -> Callable:
        """The function of ``key``, with the arguments that follow ``?`` bound."""
        name, _, rest = key.partition("?")
        if self.normal(name) not in self.items:
            raise KeyError(f"unknown transform: {name}")
        fn = self.items[self.normal(name)]
        args, kwargs = parsed_arguments(rest)
        return (lambda x: fn(x, *args, **kwargs)) if args or kwargs else fn

    def compose(self, keys: str) -> Callable:
        """All functions named in ``keys``, left to right."""
        steps = [self.get(k) for k in split_keys(keys)]

        def run(x):
            for step in steps:
                x = step(x)
            return x

        return run


def split_keys(keys: str) -> list[str]:
    """Splits at commas outside brackets."""
    out, depth, word = [], 0, ""
    for c in keys:
        depth += (c == "[") - (c == "]")
        if c == "," and not depth:
            out.append(word)
            word = ""
        else:
            word += c
    return [w.strip() for w in [*out, word] if w.strip()]


def parsed_arguments(rest: str) -> tuple[list, dict]:
    """``a``, ``[a,b]`` or ``name=a&name=b``; digits become integers."""
    value = lambda s: int(s) if s.strip().lstrip("-").isdigit() else s.strip()
    rest = rest.strip()
    if not rest:
        return [], {}
    if rest.startswith("["):
        return [value(s) for s in rest.strip("[]").split(",")], {}
    if "=" in rest:
        return [], {k.strip(): value(v) for k, v in (p.split("=", 1) for p in rest.split("&"))}
    return [value(rest)], {}


TEXT = Registry()


def _chain(x: Column, *steps: tuple[str, str]) -> Column:
    for pattern, new in steps:
        x = F.regexp_replace(x, pattern, new)
    return x


@TEXT.register("normalize-characters")
def normalize_characters(x: Column, groups: str | None = None) -> Column:
    """Every look-alike becomes the first of its group. Without ``groups`` all at once, a double prime then reading as a prime."""
    if groups is None:
        pairs: dict[str, str] = {}
        for members in CHARACTER_GROUPS.values():
            for c in members[1:]:
                pairs.setdefault(c, members[0])
        return F.translate(x, "".join(pairs), "".join(pairs.values()))
    for g in groups.split(","):
        members = CHARACTER_GROUPS[g.strip()]
        x = F.translate(x, members[1:], members[0] * (len(members) - 1))
    return x


@TEXT.register("normalize-whitespace,fix-whitespaces")
def normalize_whitespace(x: Column) -> Column:
    """X2, from the public description of such functions: zero-width characters go, runs of line breaks become one, runs of other white space one space; trimmed."""
    return _chain(x, (r"[\u200B\u2060\uFEFF]", ""), (r"(\r\n|[\n\x0B])+", "\n"), (r"[^\S\n\x0B]+", " "), (r"^[\p{Z}\s]+|[\p{Z}\s]+$", ""))


@TEXT.register("lowercase,to-lower")
def lower(x: Column) -> Column:
    return F.lower(x)


@TEXT.register("uppercase,to-upper")
def upper(x: Column) -> Column:
    return F.upper(x)


@TEXT.register("strip")
def strip(x: Column) -> Column:
    """All Unicode white space at both ends."""
    return _chain(x, (r"^[\p{Z}\s]+", ""), (r"[\p{Z}\s]+$", ""))


@TEXT.register("space-after-period-uppercase,space-after-sentence,fix-space-after-sentence")
def space_after_period_uppercase(x: Column) -> Column:
    """X5."""
    return _chain(x, (rf"\.([{CAPITALS}])", ". $1"), (rf"(?iu)\s\.([{CAPITALS}])", " . $1"), (rf"(?iu)\s'([{CAPITALS}])", " ' $1"))


@TEXT.register("dehyphen,fix-hyphenation")
def dehyphen(x: Column) -> Column:
    """Joins a word broken by a hyphen at a line end; the line break moves behind it."""
    return F.regexp_replace(x, r"(?U)\b(\w+)[-¬]\s*\r?\n\s*(\w+)\s*\b", "$1$2\n")


@TEXT.register("dedent")
def dedent(x: Column) -> Column:
    """Strips every line."""
    return F.array_join(F.transform(F.split(x, "\n", -1), strip), "\n")


def _ascii_of() -> tuple[str, str]:
    """Characters whose canonical decomposition begins with an ASCII character, and those characters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c)).encode("ascii", "ignore").decode()) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.decomposition(chr(c))]
    pairs = [(c, to) for c, to in pairs if to]
    if any(len(to) > 1 for _, to in pairs):
        raise ValueError("a character decomposes to several ASCII characters")
    return "".join(c for c, _ in pairs), "".join(to for _, to in pairs)


@TEXT.register("strip-accents,fix-accents,remove-accents")
def strip_accents(x: Column) -> Column:
    """Decomposes and drops what is not ASCII; character by character, without Python."""
    found, ascii_of = _ascii_of()
    return F.when(x.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(x, found, ascii_of), r"[^\x00-\x7F]+", "")).otherwise(x)


@TEXT.register("normalize-unicode")
def normalize_unicode(x: Column) -> Column:
    """NFC."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return run(x)


@TEXT.register("replace-currency-symbols")
def replace_currency_symbols(x: Column, marker: str = "__cur__") -> Column:
    """X12."""
    return F.regexp_replace(x, r"\p{Sc}", marker)


@TEXT.register("replace-special-characters")
def replace_special_characters(x: Column, replacement: str = " ") -> Column:
    """What is neither word character, white space, punctuation nor letter."""
    return F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}_\p{Z}\s\p{P}]", replacement)


@TEXT.register("insert-space-after-period")
def insert_space_after_period(x: Column) -> Column:
    """X14."""
    return F.regexp_replace(x, r"\.([A-Z])", ". $1")


@TEXT.register("swe-dehyphen,swedish-dehyphen")
def swedish_dehyphen(x: Column, frequencies: dict[str, int] | None = None) -> Column:
    """Joins words broken at line ends if the joined form is at least as frequent as the hyphenated one; a pure function of ``frequencies``."""
    import re

    known = frequencies or {}
    broken = re.compile(r"\b(\w+)[-¬]\s*\r?\n\s*(\w+)\b")

    def decide(m: re.Match) -> str:
        joined, dashed = m[1] + m[2], f"{m[1]}-{m[2]}"
        return (dashed if known.get(dashed.lower(), 0) > known.get(joined.lower(), 0) else joined) + "\n"

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: broken.sub(decide, t), na_action="ignore")

    return run(x)


@TEXT.register("sparv-tokenize,pretokenize")
def word_tokens_apart(x: Column) -> Column:
    """Words and punctuation of the word tokenizer with single blanks between."""
    from corpusloom.functions.tokens import word_tokenize

    return F.array_join(word_tokenize(x), " ")


def transform_text(x: Column, keys: str = "dehyphen,normalize-whitespace") -> Column:
    """Applies the transforms named in ``keys``."""
    return TEXT.compose(keys)(x)
