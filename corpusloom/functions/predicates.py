"""Predicates from key-value specifications, word look-up by glob or regular expression, pivot keys."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_predicate(column: Column, value) -> Column:
    """the predicate that one value stands for.

    A list or set: membership. A pair of numbers: between, both ends included. (bool, v): v with that sign. (name, v) or
    (bool, name, v): the named function of ``operator``; (callable, v): that function. Anything else: equality.
    """
    sign = True
    if isinstance(value, tuple):
        if value and isinstance(value[0], bool):
            sign, value = value[0], value[1:]
            value = value[0] if len(value) == 1 else value
    if isinstance(value, tuple) and len(value) == 2 and isinstance(value[0], str) and hasattr(operator, value[0]):
        keep = getattr(operator, value[0])(column, value[1])
    elif isinstance(value, tuple) and len(value) == 2 and callable(value[0]):
        keep = value[0](column, value[1])
    elif isinstance(value, tuple) and len(value) == 2 and all(isinstance(v, (int, float)) for v in value):
        keep = column.between(*value)
    elif isinstance(value, (list, set, frozenset, tuple, range)):
        keep = column.isin(*sorted(value, key=repr))
    else:
        keep = column == value
    return keep if sign else ~keep


def mask(df: DataFrame, values: dict) -> Column:
    """conjunction over ``values``; None and unknown columns are ignored."""
    parts = [value_predicate(F.col(f"`{k}`"), v) for k, v in values.items() if v is not None and k in df.columns]
    return reduce(operator.and_, parts, F.lit(True))


def mask_list(df: DataFrame, masks: Iterable[dict]) -> Column:
    """conjunction over {name, value, sign} entries."""
    parts = [value_predicate(F.col(f"`{m['name']}`"), (bool(m.get("sign", True)), m["value"])) for m in masks if m["name"] in df.columns]
    return reduce(operator.and_, parts, F.lit(True))


@dataclass(frozen=True)
class ValueMask:
    """a reusable predicate."""

    values: dict = field(default_factory=dict)

    def update(self, **values) -> ValueMask:
        return ValueMask({**self.values, **values})

    def hot(self, df: DataFrame) -> list[str]:
        """Attributes that have an effect on ``df``."""
        return [k for k, v in self.values.items() if v is not None and k in df.columns]

    def mask(self, df: DataFrame) -> Column:
        return mask(df, self.values)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.mask(df))


def glob_to_regex(glob: str) -> str:
    """A whole-string pattern of a shell glob: ``*`` any run, ``?`` any character, ``[...]`` a set, ``[!...]`` its complement."""
    out, at = "", 0
    while at < len(glob):
        c, at = glob[at], at + 1
        end = glob.find("]", at + 1) if c == "[" else -1
        if end > 0:
            inside, at = glob[at:end].replace("\\", "\\\\"), end + 1
            out += f"[^{inside[1:]}]" if inside.startswith("!") else f"[{inside}]"
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
    return f"(?s)^(?:{out})$"


def word_predicate(word: Column, wanted: Iterable[str]) -> Column:
    """any of: exact words, globs (only if they hold ``*``), ``|regexp|`` (anchored at the start)."""
    exact, parts = [], []
    for w in wanted:
        if len(w) > 2 and w.startswith("|") and w.endswith("|"):
            parts.append(word.rlike(f"^(?:{w[1:-1]})"))
        elif "*" in w:
            parts.append(word.rlike(glob_to_regex(w)))
        else:
            exact.append(w)
    if exact:
        parts.append(word.isin(*exact))
    return reduce(operator.or_, parts, F.lit(False))


def search_predicate(text: Column, search: str, least: int = 3) -> Column:
    """Case-insensitive regular expression; fewer than ``least`` characters find everything."""
    return text.rlike(f"(?i){search}") if len(search or "") >= least else F.lit(True)


@dataclass(frozen=True)
class PivotKeys:
    """Codebooks of categorical columns: text name -> (id name, {value name: id})."""

    keys: dict[str, tuple[str, dict[str, int]]]

    def filter_values(self, pairs: Iterable[str], sep: str = ": ") -> dict[str, list[int]]:
        """``"key: value"`` strings to {id name: ids}, unknown ones left out."""
        out: dict[str, list[int]] = {}
        for pair in pairs:
            key, _, value = pair.partition(sep)
            name, codes = self.keys.get(key, (None, {}))
            if name and value in codes:
                out.setdefault(name, []).append(codes[value])
        return out

    def decode(self, df: DataFrame, drop: bool = True) -> DataFrame:
        """Id columns to text columns."""
        for text, (name, codes) in self.keys.items():
            if name in df.columns:
                labels = F.create_map(*[F.lit(x) for v, k in codes.items() for x in (k, v)]) if codes else F.lit(None)
                df = df.withColumn(text, F.try_element_at(labels, F.col(name)) if codes else F.lit(None).cast("string"))
                df = df.drop(name) if drop else df
        return df

