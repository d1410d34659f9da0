"""Text normalisation as Column expressions.

A pipeline is a list of steps {"op": name, "options": {...}}; every operator
maps null to null, and an empty pipeline is the identity. All operators stay in
the JVM except Unicode normalisation, for which Spark has no expression; a
pipeline that needs it on text known to be ASCII pays nothing, because the
vectorised function is only reached by other text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.errors import ConfigError

#: white space as Unicode text processing understands it
WS = r"(?U)[\s\x1c-\x1f]"

# fixed values
TEXT_MARKS = {"，": ",", "。": ".", "；": ";", "：": ":", "（": "(", "）": ")", "【": "[", "】": "]", "—": "-", "–": "-", "−": "-", "／": "/"}
DASHES = {"—": "-", "–": "-", "−": "-", "／": "/"}
SPEC_MARKS = {"φ": "Φ", "ϕ": "Φ", "Ø": "Φ", "ø": "Φ", "∅": "Φ", "⌀": "Φ", "✕": "×", "✖": "×", "—": "-", "–": "-", "−": "-"}
COMPACT_PUNCTUATION = " _-/\\()[]{}.,;:，。；："
STANDARD_T_PREFIXES = ("GB", "JB", "HG", "SJ", "HB", "QJ", "CB", "SY", "NY", "DL", "JT", "TB", "YD", "YY")
LEGAL_SUFFIXES = ("股份有限公司", "有限责任公司", "集团有限公司", "集团公司", "有限公司", "公司")
MANUFACTURER_PUNCTUATION = "_-—–/\\()（）[]【】,，.;；:："

Operator = Callable[[Column, Mapping], Column]
_OPERATORS: dict[str, Operator] = {}


def register_operator(name: str, fn: Operator) -> None:
    """Adds or replaces a normalisation operator: (column, options) -> column."""
    _OPERATORS[name] = fn


def _operator(name: str):
    return lambda fn: (register_operator(name, fn), fn)[1]


def operators() -> list[str]:
    return sorted(_OPERATORS)


def apply(c: Column, steps: Sequence[Mapping] | None) -> Column:
    """The pipeline's value for column c, as string."""
    c = c.cast("string")
    for step in steps or ():
        name = str(step.get("op", "identity"))
        if name not in _OPERATORS:
            raise ConfigError("PROCESSING_OPERATOR_NOT_FOUND", name)
        c = _OPERATORS[name](c, dict(step.get("options") or {}))
    return c


def trace(c: Column, steps: Sequence[Mapping] | None, preview: int = 120) -> Column:
    """Array of (operator, input, output) previews, one entry a step."""
    out, before = [], c.cast("string")
    show = lambda x: F.substring(F.coalesce(x, F.lit("")), 1, preview)
    for step in steps or ():
        after = apply(before, [step])
        out.append(F.struct(F.lit(str(step.get("op", "identity"))).alias("operator"), show(before).alias("input"), show(after).alias("output")))
        before = after
    return F.array(*out) if out else F.array().cast("array<struct<operator:string,input:string,output:string>>")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def replace_chars(c: Column, mapping: Mapping[str, str]) -> Column:
    """Every key, one character, by its value of at most one."""
    keep = [k for k in mapping if mapping[k]]
    drop = [k for k in mapping if not mapping[k]]
    return F.translate(c, "".join(keep + drop), "".join(mapping[k] for k in keep))


@lru_cache(maxsize=4)
def _unicode_udf(form: str):
    @F.pandas_udf(T.StringType())
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return normal


def unicode_form(c: Column, form: str = "NFKC") -> Column:
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ConfigError("PROCESSING_PIPELINE_INVALID", form)
    return _unicode_udf(form)(c)


@_operator("identity")
def _identity(c, o):
    return c


@_operator("trim")
def _trim(c, o):
    return strip(c)


@_operator("unicode_normalize")
def _unicode(c, o):
    return unicode_form(c, str(o.get("form", "NFKC")))


@_operator("case_map")
def _case(c, o):
    mode = str(o.get("mode", "lower"))
    if mode not in ("upper", "lower"):
        raise ConfigError("PROCESSING_PIPELINE_INVALID", f"case {mode}")
    return F.upper(c) if mode == "upper" else F.lower(c)


@_operator("whitespace_map")
def _whitespace(c, o):
    return F.regexp_replace(c, f"{WS}+", _plain(str(o.get("replacement", " "))))


@_operator("punctuation_map")
def _punctuation(c, o):
    chars, new = str(o.get("chars", "")), str(o.get("replacement", ""))
    if not chars:
        return c
    if len(new) <= 1:
        return replace_chars(c, dict.fromkeys(chars, new))
    return F.regexp_replace(c, "[" + "".join(f"\\x{{{ord(x):x}}}" for x in dict.fromkeys(chars)) + "]", _plain(new))


def _base(c: Column, o: Mapping, case: str) -> Column:
    """Compatibility form, stripped, in one case. `ascii`: the text is known to be ASCII, which that form leaves alone."""
    c = strip(c if o.get("ascii") else unicode_form(c))
    if case in ("upper", "lower"):
        return F.upper(c) if case == "upper" else F.lower(c)
    if case not in ("keep", "none"):
        raise ConfigError("PROCESSING_PIPELINE_INVALID", f"case {case}")
    return c


@_operator("text_normalize")
def _text(c, o):
    c = replace_chars(_base(c, o, str(o.get("case", "upper"))), TEXT_MARKS)
    c = strip(F.regexp_replace(c, f"{WS}+", " "))
    if o.get("compact"):
        c = F.regexp_replace(replace_chars(c, dict.fromkeys(str(o.get("punctuation", COMPACT_PUNCTUATION)), "")), f"{WS}+", "")
    return c


@_operator("standard_number_normalize")
def _standard(c, o):
    c = replace_chars(_base(c, o, "upper"), DASHES)
    for p in sorted({str(x).upper() for x in o.get("t_prefixes", STANDARD_T_PREFIXES)}, key=lambda x: (-len(x), x)):
        c = F.regexp_replace(c, rf"(?<![A-Z]){_quoted(p)}{WS}*[-/]?{WS}*T(?={WS}*(?U)\d)", _plain(f"{p}/T"))
    c = F.regexp_replace(c, rf"{WS}*([/\-.]){WS}*", "$1")
    return F.regexp_replace(c, f"{WS}+", "") if o.get("remove_spaces", True) else strip(F.regexp_replace(c, f"{WS}+", " "))


@_operator("specification_normalize")
def _specification(c, o):
    c = replace_chars(_base(c, o, "upper"), SPEC_MARKS)
    c = F.regexp_replace(c, rf"(?U)(?<=\d){WS}*[X*×]{WS}*(?=\d)", "×")
    c = F.regexp_replace(c, rf"(?U)Φ{WS}+(?=\d)", "Φ")
    if o.get("strip_mm_unit", True):
        c = F.regexp_replace(c, rf"(?U)(?<=\d){WS}*(?:MM|毫米)(?=$|[^A-Z])", "")
    return F.regexp_replace(c, f"{WS}+", "")


@_operator("model_normalize")
def _model(c, o):
    c = F.regexp_replace(replace_chars(_base(c, o, str(o.get("case", "upper"))), DASHES), f"{WS}+", "")
    return F.regexp_replace(c, r"^[()\[\]{}]+|[()\[\]{}]+$", "") if o.get("strip_wrapping_punctuation") else c


@_operator("manufacturer_normalize")
def _manufacturer(c, o):
    c = _base(c, o, str(o.get("case", "upper")))
    c = replace_chars(F.regexp_replace(c, f"{WS}+", ""), dict.fromkeys(MANUFACTURER_PUNCTUATION, ""))
    suffixes = [str(s) for s in o.get("suffixes", LEGAL_SUFFIXES) if str(s)]
    if o.get("strip_legal_suffix", True) and suffixes:
        # what is left must not be empty, so one suffix may stay as the whole name
        any_ = "|".join(_quoted(s) for s in sorted(set(suffixes), key=lambda s: (-len(s), s)))
        c = F.regexp_replace(c, rf"^((?s:.+?))(?:{any_})+$", "$1")
    return c


@_operator("nullify")
def _nullify(c, o):
    values = [str(v) for v in o.get("values", [])]
    if not o.get("case_sensitive", True):
        return F.when(F.lower(c).isin([v.lower() for v in values]), F.lit(None)).otherwise(c)
    return F.when(c.isin(values), F.lit(None)).otherwise(c)


@_operator("regex_replace")
def _regex(c, o):
    return F.regexp_replace(c, java_pattern(str(o.get("pattern", ""))), java_template(str(o.get("replacement", ""))))


@_operator("substring")
def _substring(c, o):
    """Python slice semantics, negative positions included, in code points."""
    n, start, end = F.length(c), int(o.get("start", 0)), o.get("end")
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    z = n if end is None else F.lit(int(end)) if int(end) >= 0 else F.greatest(n + int(end), F.lit(0))
    return F.when(c.isNotNull(), F.substr(c, a + 1, F.greatest(F.least(z, n) - a, F.lit(0))))


@_operator("dictionary_map")
def _dictionary(c, o):
    mapping = o.get("mapping")
    if not isinstance(mapping, Mapping):
        raise ConfigError("DICTIONARY_NOT_MATERIALIZED")
    mode, missing, exact_case = str(o.get("mode", "exact")), str(o.get("on_missing", "keep")), bool(o.get("case_sensitive", True))
    table = {str(k) if exact_case else str(k).lower(): str(v) for k, v in mapping.items()}
    if mode == "exact":
        if missing not in ("keep", "null"):
            raise ConfigError("PROCESSING_PIPELINE_INVALID", f"on_missing {missing}")
        hit = F.try_element_at(constant_map(table), c if exact_case else F.lower(c))
        return hit if missing == "null" else F.coalesce(hit, c)
    if mode != "replace":
        raise ConfigError("PROCESSING_PIPELINE_INVALID", f"mode {mode}")
    if not table:
        return c
    # one pass: pieces between matches, joined by the matches' replacements; these are never scanned again
    pattern = ("" if exact_case else "(?iu)") + "|".join(_quoted(k) for k in sorted(mapping, key=lambda k: (-len(k), k)))
    pieces = F.split(c, pattern, -1)
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: F.coalesce(F.try_element_at(constant_map(table), m if exact_case else F.lower(m)), m))
    return F.array_join(F.flatten(F.zip_with(pieces, found, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def constant_map(table: Mapping[str, str]) -> Column:
    if not table:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _quoted(s: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&~#\s])", lambda m: f"\\x{{{ord(m.group(1)):x}}}", s)


def _plain(s: str) -> str:
    """A replacement without group references."""
    return s.replace("\\", "\\\\").replace("$", "\\$")


def java_pattern(p: str) -> str:
    """Named groups as Java spells them; its classes as Unicode ones."""
    return "(?U)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", p.replace("(?P<", "(?<"))


def java_template(t: str) -> str:
    """Group references \\1, \\g<1> and \\g<name> as $1 and ${name}."""
    out, i = [], 0
    while i < len(t):
        m = re.match(r"\\(\d+)|\\g<(\w+)>", t[i:])
        if m:
            ref = m.group(1) or m.group(2)
            out.append(f"${ref}" if ref.isdigit() else f"${{{ref}}}")
            i += m.end()
        elif t[i] == "\\" and i + 1 < len(t):
            out.append({"n": "\n", "t": "\t", "r": "\r"}.get(t[i + 1], "\\" + t[i + 1]))
            i += 2
        else:
            out.append(_plain(t[i]))
            i += 1
    return "".join(out)
