"""Token array transforms, token predicates and tokenizers as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import Registry

# Which characters count as letters and which as symbols.
ALPHABETIC = "abcdefghijklmnopqrstuvwxyzåäöéàáâãäåæèéêëîïñôöùûÿ"
SYMBOLS = "'\\¢£¥§©®°±øæç•›€™!\"#$%&()*+,./:;<=>?@[]^_`{|}~"
#: Runs of letters, digits and underscores in any script; spelled out, as \w would be ASCII only.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
#: Stands for a token that a padding removed.
PAD = "*"

TOKENS = Registry()


def _class(characters: str) -> str:
    return "[" + "".join("\\" + c if c in "\\[]^-&\"'" else c for c in dict.fromkeys(characters)) + "]"


LETTER_CLASS = _class(ALPHABETIC + ALPHABETIC.upper())
SYMBOL_CLASS = _class(SYMBOLS)


def tokenize(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """All matches of ``pattern``."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


@TOKENS.register("has-alphabetic")
def has_alphabetic(t: Column) -> Column:
    """X20."""
    return F.filter(t, lambda x: x.rlike(r"\p{L}"))


@TOKENS.register("only-any-alphanumeric")
def only_any_alphanumeric(t: Column) -> Column:
    """X21."""
    return F.filter(t, lambda x: x.rlike(r"[\p{L}\p{N}]"))


@TOKENS.register("only-alphabetic")
def only_alphabetic(t: Column) -> Column:
    """Any letter of the fixed set suffices here; the mask of the same name asks for nothing but letters."""
    return F.filter(t, lambda x: x.rlike(LETTER_CLASS))


@TOKENS.register("remove-stopwords")
def remove_stopwords(t: Column, words: tuple[str, ...] | str = ()) -> Column:
    """``words`` or the public list of a language."""
    if isinstance(words, str):
        words = language_stopwords(words)
    return F.filter(t, lambda x: ~x.isin(*words)) if words else t


def language_stopwords(language: str) -> tuple[str, ...]:
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(language))


@TOKENS.register("min-chars,min-len")
def min_chars(t: Column, chars: int = 3) -> Column:
    """X24."""
    return F.filter(t, lambda x: F.length(x) >= chars)


@TOKENS.register("max-chars,max-len")
def max_chars(t: Column, chars: int = 3) -> Column:
    """X24."""
    return F.filter(t, lambda x: F.length(x) <= chars)


@TOKENS.register("to-lower,lowercase")
def to_lower(t: Column) -> Column:
    """X25."""
    return F.transform(t, F.lower)


@TOKENS.register("to-upper,uppercase")
def to_upper(t: Column) -> Column:
    """X25."""
    return F.transform(t, F.upper)


@TOKENS.register("remove-numerals")
def remove_numerals(t: Column) -> Column:
    """X26."""
    return F.filter(t, lambda x: ~x.rlike(r"^\p{N}+$"))


@TOKENS.register("remove-symbols")
def remove_symbols(t: Column) -> Column:
    """Deletes symbol characters, then empty tokens; the mask of the same name drops only tokens of nothing but symbols."""
    return remove_empty(F.transform(t, lambda x: F.regexp_replace(x, SYMBOL_CLASS, "")))


@TOKENS.register("remove-empty")
def remove_empty(t: Column) -> Column:
    """X28."""
    return F.filter(t, lambda x: x != "")


@dataclass(frozen=True)
class TokensTransformOpts:
    """Options of token masks and transforms."""

    to_lower: bool = False
    to_upper: bool = False
    only_alphabetic: bool = False
    only_any_alphanumeric: bool = False
    min_len: int = 0
    max_len: int | None = None
    remove_numerals: bool = False
    remove_symbols: bool = False
    remove_stopwords: str | None = None
    extra_stopwords: tuple[str, ...] = field(default=())

    def stopwords(self) -> tuple[str, ...]:
        return (*(language_stopwords(self.remove_stopwords) if self.remove_stopwords else ()), *self.extra_stopwords)

    def mask(self, token: Column) -> Column:
        """the predicate on one token."""
        keep = token != ""
        if self.min_len > 1:
            keep &= F.length(token) >= self.min_len
        if self.max_len:
            keep &= F.length(token) <= self.max_len
        if self.only_alphabetic:
            keep &= token.rlike(f"^{LETTER_CLASS}*$")
        if self.only_any_alphanumeric:
            keep &= token.rlike(r"[\p{L}\p{N}]")
        if words := self.stopwords():
            keep &= ~token.isin(*words)
        if self.remove_numerals:
            keep &= ~token.rlike(r"^\p{N}+$")
        if self.remove_symbols:
            keep &= ~token.rlike(f"^{SYMBOL_CLASS}*$")
        return keep

    def apply(self, tokens: Column) -> Column:
        """The same as transforms of an array."""
        steps = [("to-lower", self.to_lower), ("to-upper", self.to_upper), ("only-alphabetic", self.only_alphabetic), ("only-any-alphanumeric", self.only_any_alphanumeric)]
        steps += [("remove-numerals", self.remove_numerals), ("remove-symbols", self.remove_symbols)]
        for key, on in steps:
            tokens = TOKENS.get(key)(tokens) if on else tokens
        tokens = min_chars(tokens, self.min_len) if self.min_len > 1 else tokens
        tokens = max_chars(tokens, self.max_len) if self.max_len else tokens
        return remove_stopwords(tokens, self.stopwords())


def chunks(tokens: Column, size: int) -> Column:
    """Consecutive slices of ``size`` tokens."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(size)), lambda i: i < F.size(tokens))
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, F.lit(size)))


def sentences(text: Column) -> Column:
    """Texts of sentences, cut after a period, question or exclamation mark (and closing quotes) that white space and a capital, digit or opening quote follow."""
    return F.filter(F.split(text, r"(?<=[.!?][\"'”’)]{0,1})\s+(?=[\"'“‘(]?[\p{Lu}\p{N}])|\n{2,}"), lambda s: F.length(F.trim(s)) > 0)


# Fixed pattern parts of a word tokenizer: numbers, abbreviations (a parameter), words with inner hyphens or apostrophes, punctuation.
def word_tokenize(text: Column, abbreviations: tuple[str, ...] = ()) -> Column:
    """Words (with inner hyphens, apostrophes, periods between letters), numbers with separators, known abbreviations, punctuation one by one."""
    short = "|".join(a.replace(".", r"\.") for a in sorted(abbreviations, key=len, reverse=True))
    number, word = r"\d+(?:[.,:]\d+)*", r"[\p{L}\p{M}\p{N}_]+(?:[-'’][\p{L}\p{M}\p{N}_]+)*"
    pattern = "|".join(p for p in (f"(?<![\\p{{L}}])(?:{short})" if short else "", rf"\.{{3}}|--+", number + r"(?![\p{L}])", word, r"[^\s\p{L}\p{N}]") if p)
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
