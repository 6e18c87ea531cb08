"""Column helpers shared by every operator."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str

KEY_SEPARATOR = chr(31)
MICROS = 1_000_000


def as_column(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def surrogate_key(*parts: ColumnOrName) -> Column:
    """Deterministic key of a natural-key tuple; NULL parts count as a value of their own."""
    texts = [F.coalesce(as_column(p).cast("string"), F.lit("<null>")) for p in parts]
    return F.md5(F.concat_ws(KEY_SEPARATOR, *texts))


def list_text(array: ColumnOrName) -> Column:
    """Array of strings as one comparable string, NULL kept."""
    return F.array_join(as_column(array), chr(30))


def is_true(condition: Column) -> Column:
    """Three-valued condition with NULL read as false."""
    return F.coalesce(condition, F.lit(False))


def epoch_seconds(ts: ColumnOrName) -> Column:
    """Seconds since 1970 as a double, microseconds kept."""
    micros = F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), as_column(ts)
    )
    return micros / F.lit(float(MICROS))


def lookup(values: Mapping, key: Column) -> Column:
    """Fixed-size dictionary lookup as a CASE expression; NULL when the key is unknown."""
    items = iter(values.items())
    first, value = next(items)
    chain = F.when(key == F.lit(first), F.lit(value))
    for k, v in items:
        chain = chain.when(key == F.lit(k), F.lit(v))
    return chain


def java_regex(pattern: str) -> str:
    r"""Pattern with line handling as in Python: only \n ends a line, \v is one character."""
    return "(?d)" + pattern.replace(r"\v", r"\x0B")


def grep_regex(pattern: str) -> str:
    """Basic regular expression (parentheses, braces, bar, plus and query are literal)."""
    outside = re.split(r"(\[[^\]]*\])", pattern)
    quoted = [p if p.startswith("[") else re.sub(r"([(){}|+?])", r"\\\1", p) for p in outside]
    return "".join(quoted)


_ATOM = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.S)
_LONG_ESCAPES = set("0123456789xucpPNkQE")
_QUANTIFIER = re.compile(r"(?:[*+?]|\{[^}]*\})[?+]?")


def mandatory_text(pattern: str) -> tuple[str, bool]:
    """Longest text every match must contain, and whether that text is the whole pattern.

    The pattern is read atom by atom: only plain and escaped characters without a quantifier count. Groups,
    alternatives and inline flags give no text.
    """
    runs, at, whole = [""], 0, True
    while at < len(pattern):
        atom = _ATOM.match(pattern, at)[0]
        at += len(atom)
        quantifier = _QUANTIFIER.match(pattern, at)
        at = quantifier.end() if quantifier else at
        # Groups, alternatives, and escapes that take more than one character.
        if atom in ("(", ")", "|") or atom[0] == "\\" and atom[1:] in _LONG_ESCAPES:
            return "", False
        plain = atom not in (".", "^", "$") and not atom.startswith("[")
        if atom.startswith("\\"):
            atom = atom[1:]
            plain = bool(atom) and not atom.isalnum()
        if plain and not quantifier:
            runs[-1] += atom
        else:
            whole = False
            runs.append("")
    return max(runs, key=len), whole


def text_matches(text: ColumnOrName, pattern: str) -> Column:
    """True where the pattern is found.

    A plain substring search answers literal patterns outright, and keeps the regex engine away
    from rows that cannot match the others.
    """
    col = as_column(text)
    literal, whole = mandatory_text(pattern)
    if whole:
        return col.contains(literal)
    found = col.rlike(java_regex(pattern))
    return col.contains(literal) & found if literal else found


def any_match(text: ColumnOrName, patterns: Sequence[str]) -> Column:
    conditions = [text_matches(text, p) for p in patterns]
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def matches_one_of(text: Column, patterns: Sequence[str]) -> Column:
    out = text.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | text.rlike(p)
    return out


def one_per(rows: DataFrame, key: Sequence[str], few: bool = False) -> DataFrame:
    """The smallest row of each key, by its other columns in order: the same one whatever the partitioning.

    few: distinct rows are few among all, as candidates for a dimension are. Equal rows are then counted
    away first, by hash and where they are, so that only what is left is sorted to find the least.
    """
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.distinct()
    if few:
        rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")
    least = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_least"))
    return least.select(*[c if c in key else F.col(f"_least.{c}").alias(c) for c in rows.columns])


def new_members(candidates: DataFrame, existing: DataFrame | None, key: str) -> DataFrame:
    """One candidate row per key, minus the keys that exist."""
    distinct = one_per(candidates, [key], few=True)
    if existing is None:
        return distinct
    return distinct.join(existing.select(key), key, "left_anti")


def get_or_create(candidates: DataFrame, existing: DataFrame | None, key: str) -> DataFrame:
    """Existing rows followed by the members that were missing."""
    added = new_members(candidates, existing, key)
    if existing is None:
        return added
    return existing.unionByName(added.select(*existing.columns))
