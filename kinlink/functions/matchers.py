"""Matchers of two texts, as Column expressions with values 0..1.

exact, contains, jaccard and numeric stay in the JVM. Ratcliff-Obershelp
similarity (fuzzy) needs Python; it runs as a vectorised function over pairs
that neither equality nor the length bound settles.
"""

from __future__ import annotations

from collections.abc import Mapping
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.errors import ConfigError

WORD_BREAK = r"(?U)[\s\x1c-\x1f]+"
#: decimal and scientific notation, infinities and NaN, underscores between digits
FLOAT = r"(?i)^\s*[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?(?:e[+-]?\d+(?:_\d+)*)?|\.\d+(?:_\d+)*(?:e[+-]?\d+(?:_\d+)*)?|inf(?:inity)?|nan)\s*$"


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def exact(s: Column, t: Column) -> Column:
    return F.when(s == t, 1.0).otherwise(0.0)


def contains(s: Column, t: Column, score: float = 1.0, by_length: bool = False) -> Column:
    c = clamp(F.lit(float(score)))
    if by_length:
        c = clamp(c * F.least(F.length(s), F.length(t)) / F.greatest(F.length(s), F.length(t), F.lit(1)))
    return F.when(s == t, 1.0).when(F.contains(s, t) | F.contains(t, s), c).otherwise(0.0)


def tokens(c: Column) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(F.filter(F.split(c, WORD_BREAK), lambda w: w != ""))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of words; the union's size follows from the intersection's."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def jaccard(s: Column, t: Column) -> Column:
    return overlap(tokens(s), tokens(t))


@F.pandas_udf(T.DoubleType())
def _ratio(s: pd.Series, t: pd.Series) -> pd.Series:
    seen: dict = {}
    out = []
    for a, b in zip(s, t, strict=True):
        if a is None or b is None:
            out.append(None)
            continue
        k = (a, b)
        if k not in seen:
            seen[k] = SequenceMatcher(None, a, b, autojunk=False).ratio()
        out.append(seen[k])
    return pd.Series(out, dtype="float64")


def fuzzy(s: Column, t: Column) -> Column:
    """2M / (|s| + |t|) for the matching blocks of s and t, in that order."""
    return F.when(s == t, 1.0).otherwise(_ratio(s, t))


def hybrid(s: Column, t: Column, options: Mapping | None = None, semantic: Column | None = None) -> Column:
    o = options or {}
    parts = [fuzzy(s, t), jaccard(s, t), contains(s, t, o.get("contains_score", 1.0), bool(o.get("contains_length_sensitive")))]
    if o.get("include_semantic"):
        if semantic is None:
            raise ConfigError("SEMANTIC_PROVIDER_NOT_READY")
        parts.append(semantic)
    return F.greatest(*parts)


def number(c: Column) -> Column:
    """The text as a double where it is written as one, else null."""
    return F.when(c.rlike(FLOAT), F.regexp_replace(F.regexp_replace(c, r"(?<=\d)_(?=\d)", ""), r"\s", "").try_cast("double"))


def numeric(s: Column, t: Column, tolerance: Mapping | None) -> Column:
    """Within tolerance, of two texts."""
    return near(number(s), number(t), tolerance)


def near(a: Column, b: Column, tolerance: Mapping | None) -> Column:
    """Within tolerance, of two numbers; null and NaN are near nothing."""
    if not isinstance(tolerance, Mapping):
        raise ConfigError("NUMERIC_TOLERANCE_REQUIRED")
    mode, value = str(tolerance.get("mode", "")), float(tolerance.get("value", 0.0))
    if mode == "exact":
        ok = a == b
    elif mode == "absolute":
        ok = F.abs(a - b) <= value
    elif mode == "relative":
        ok = F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-12)) <= value
    elif mode == "range":
        ok = (a - b >= float(tolerance.get("min_delta", 0.0))) & (a - b <= float(tolerance.get("max_delta", 0.0)))
    else:
        raise ConfigError("NUMERIC_TOLERANCE_REQUIRED", mode)
    return F.when(ok & ~F.isnan(a) & ~F.isnan(b), 1.0).otherwise(0.0)


def pair_score(matcher: str, s: Column, t: Column, options: Mapping | None = None, semantic: Column | None = None) -> Column:
    """Score of two texts; of two numbers for `numeric`."""
    o = options or {}
    if matcher == "exact":
        return exact(s, t)
    if matcher == "contains":
        return contains(s, t, o.get("contains_score", 1.0), bool(o.get("contains_length_sensitive")))
    if matcher == "fuzzy":
        return fuzzy(s, t)
    if matcher == "hybrid":
        return hybrid(s, t, o, semantic)
    if matcher == "numeric":
        return near(s, t, o.get("tolerance"))
    if matcher == "semantic":
        if semantic is None:
            raise ConfigError("SEMANTIC_PROVIDER_NOT_READY")
        return semantic
    raise ConfigError("MATCHER_NOT_FOUND", matcher)
