"""Op 10: secrets in text, with DataFrame functions only.

Base rules (assign, access, hex) are regular expressions; where a match lies
follows from running sums over the lengths of the matches and of the gaps
between them.

On top of them two character Markov models, of random strings and of ordinary
identifiers, score every token of at least 12 characters by the log-likelihood
ratio of its transitions; tokens above the threshold, which rises for those of
less than 20 characters, and apart from base spans are added as
kind `markov`. The models are trained on the driver from labelled samples
(made by rule in `samples`, or given) and enter the plan as one constant array.

Everything is a projection: no shuffle, no Python worker, one pass over the text.
Null or empty text has no spans; rows are judged one by one.
"""

from __future__ import annotations

import math
import random
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> pattern and the condition on a match m
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1),
    "access": (r"AKIA[A-Z0-9]+", 16),
    "hex": (r"[0-9a-f]{32,}", 32),
}
SYMBOLS = string.ascii_lowercase + "A0_"
_FROM = string.ascii_uppercase + string.digits + "+/_=-"
_TO = "A" * 26 + "0" * 10 + "_" * 5
TOKEN = r"[A-Za-z0-9+/_=-]{12,}"

_WORDS = "get set user name account table value index count list item order total price date time file path read write open close start stop test main config option default handler request response server client session token cache buffer string number field column query result error message event stream thread process worker manager factory service module package version update delete insert select filter group merge split parse format encode decode when where which there their other with that this from have been were will would should could about after before between under over through nation action station information straße einheit freiheit möglich schnell gesellschaft verbindung entwicklung richtung zeichen nicht auch sich werden wurde haben einen eine und der die das gouvernement élément nous vous leur pour dans avec sont cette comme mais plus tout faire être aussi même temps après sans deux donde para como pero este esta todo sobre entre cuando tiempo también porque desde hasta nación mente ción".split()


def samples(n: int = 1500, seed: int = 11) -> tuple[list[str], list[str]]:
    """Labelled samples: random strings, and ordinary identifiers and words."""
    r = random.Random(seed)
    kinds = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.hexdigits.lower()[:16], string.ascii_letters + string.digits + "_-", string.ascii_uppercase + "234567"]
    noise = ["".join(r.choices(kinds[i % len(kinds)], k=r.randint(20, 48))) for i in range(n)]
    words = [w for w in _WORDS if w.isascii()]
    names = []
    for i in range(n):
        w = r.choices(words, k=r.randint(3, 6))
        names.append([("_".join(w)), "".join(x.capitalize() for x in w), "-".join(w), "".join(w), w[0] + "".join(x.capitalize() for x in w[1:]), "_".join(w).upper(), "/".join(w) + f"/v{r.randint(1, 20)}", "_".join(w) + f"_{r.randint(1, 2030)}"][i % 8])
    return noise, names


def _symbols(s: str) -> str:
    return (s.lower() if s == s.upper() else s).translate(str.maketrans(_FROM, _TO))


def train(noise: list[str], names: list[str], smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each transition of two symbols, row by row."""
    k = len(SYMBOLS)
    at = {c: i for i, c in enumerate(SYMBOLS)}
    tables = []
    for strings in (noise, names):
        n = [[smooth] * k for _ in range(k)]
        for s in map(_symbols, strings):
            for a, b in zip(s, s[1:]):
                n[at[a]][at[b]] += 1
        tables.append([[x / sum(row) for x in row] for row in n])
    return [math.log(tables[0][i][j] / tables[1][i][j]) for i in range(k) for j in range(k)]


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _scan(values: Column, merge, zero: Column, block: int = 100) -> Column:
    """For each value the merge of those before it (merge: associative, with zero as its neutral element).

    A block is scanned value by value, and the blocks' totals likewise, so that
    ten thousand values take ten thousand steps of a hundred.
    """
    total = lambda a: F.aggregate(a, zero, merge)
    plain = lambda a: F.transform(a, lambda x, i: total(F.slice(a, 1, i)))

    def cut(a):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda i: F.slice(a, i * block + 1, block))
        return _let(parts, lambda p: _let(F.transform(p, total), lambda t: F.flatten(F.transform(p, lambda c, i: _let(total(F.slice(t, 1, i)), lambda z: F.transform(plain(c), lambda x: merge(z, x)))))))

    return _let(values, lambda a: F.when(F.size(a) <= block, plain(a)).otherwise(cut(a)))


def likelihood(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions; positive: rather random."""
    k = len(SYMBOLS)
    constant = F.array(*[F.lit(round(x, 6)) for x in table])
    s = F.translate(F.when(token == F.upper(token), F.lower(token)).otherwise(token), _FROM, _TO)
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    # the transition into each character, from the code before it; the accumulator holds that code and the sum
    zero = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(c.alias("at"), (acc["sum"] + F.when(acc["at"] < 0, F.lit(0.0)).otherwise(F.element_at(constant, acc["at"] * k + c + 1))).alias("sum"))
    return F.aggregate(codes, zero, step, lambda acc: acc["sum"]) / (F.length(token) - 1)


_NONE = "array<struct<m:string,start:int,end:int>>"


def _located(text: str, pattern: str) -> Column:
    """Array of (m, start, end) for the matches of a pattern in order, from the lengths of the matches and of what lies between them."""
    gaps = lambda: F.split(F.col(text), pattern, -1)

    def place(found):
        sized = _let(gaps(), lambda g: F.transform(found, lambda m, i: F.struct(m.alias("m"), F.length(F.get(g, i)).alias("gap"), F.length(m).alias("size"))))
        add = lambda x, y: x + y
        return _let(sized, lambda z: _let(_scan(F.transform(z, lambda x: x["gap"] + x["size"]), add, F.lit(0)), lambda at: F.zip_with(z, at, lambda x, y: F.struct(x["m"].alias("m"), (y + x["gap"]).alias("start"), (y + x["gap"] + x["size"]).alias("end")))))

    return _let(F.expr(f"regexp_extract_all({text}, {_sql(pattern)}, 0)"), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(F.array().cast(_NONE)))


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span: none that starts before a token's end ends after its start."""
    rows = F.sort_array(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("token"), b["end"].alias("end"), F.lit("").alias("m"))), F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("token"), t["end"].alias("end"), t["m"].alias("m")))))
    ends = lambda r: _scan(F.transform(r, lambda x: F.when(x["token"] == 0, x["end"]).otherwise(F.lit(-1))), lambda x, y: F.greatest(x, y), F.lit(-1))
    starts = lambda r: F.reverse(_scan(F.transform(F.reverse(r), lambda x: F.when(x["token"] == 0, x["start"]).otherwise(F.lit(_FAR))), lambda x, y: F.least(x, y), F.lit(_FAR)))
    keep = lambda r: _let(F.struct(ends(r).alias("e"), starts(r).alias("s")), lambda n: F.filter(r, lambda x, i: (x["token"] == 1) & (F.get(n["e"], i) <= x["start"]) & (F.get(n["s"], i) >= x["end"])))
    return F.when(F.size(base) == 0, tokens).otherwise(F.transform(_let(rows, keep), lambda x: F.struct(x["m"].alias("m"), x["start"].alias("start"), x["end"].alias("end"))))


_FAR = 2**31 - 1


def find_secrets(docs: DataFrame, text: str = "text", threshold: float = 0.35, model: list[float] | None = None, rise: float = 0.12, out: str = "secrets") -> DataFrame:
    """docs with column `out`: array of (start, rank, kind, end) by start, then kind; rank 3 is `markov`.

    A token of less than 20 characters needs `rise` more for each it lacks.
    Existing columns stay; one of that name is replaced. Positions are code
    points, end exclusive. Work is in proportion to a text's length, with tokens
    and matches of any length and number. An empty table gives an empty result.
    """
    model = model or train(*samples())
    t = "__kl_text"
    d = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    spans = []
    for rank, (kind, (pattern, least)) in enumerate(BASE.items()):
        ok = (lambda p: lambda x: F.length(F.regexp_extract(x["m"], p, 1)) >= 8)(pattern) if kind == "assign" else (lambda n: lambda x: F.length(x["m"]) >= n)(least)
        spans.append(F.transform(F.filter(_located(t, pattern), ok), (lambda r, k: lambda x: F.struct(x["start"].alias("start"), F.lit(r).alias("rank"), F.lit(k).alias("kind"), x["end"].alias("end")))(rank, kind)))
    random_ = lambda x: likelihood(x["m"], model) > F.lit(threshold) + F.lit(rise) * F.greatest(F.lit(0), 20 - F.length(x["m"]))
    added = lambda base: F.transform(_let(F.filter(_located(t, TOKEN), random_), lambda z: F.when(F.size(z) == 0, z).otherwise(_apart(z, base))), lambda x: F.struct(x["start"].alias("start"), F.lit(len(BASE)).alias("rank"), F.lit("markov").alias("kind"), x["end"].alias("end")))
    return d.withColumn(out, _let(F.concat(*spans), lambda base: F.sort_array(F.concat(base, added(base))))).drop(t)


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_sha256 and spans of find_secrets' result."""
    base = F.filter("secrets", lambda x: x["rank"] < len(BASE))
    n = [F.size(F.filter("secrets", (lambda k: lambda x: x["kind"] == k)(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return docs.select("doc_id", *n, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", spans: str = "secrets") -> DataFrame:
    """docs with all spans in column `spans` replaced by the mark, overlapping ones by one mark; the column is dropped. Null text stays null."""

    def pieces(x, part):
        # (where the text before a span begins, where the span starts) of the spans that begin past all spans before them; then the end
        reach = _scan(F.transform(x, lambda y: y["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
        heads = _let(reach, lambda at: F.transform(x, lambda y, i: F.when(y["start"] >= F.get(at, i), F.concat(part(F.get(at, i), y["start"] - F.get(at, i)), F.lit(mark))).otherwise(F.lit(""))))
        last = F.array_max(F.transform(x, lambda y: y["end"]))
        return F.concat(F.array_join(heads, ""), part(last, F.length(F.col(text))))

    few = lambda x: pieces(x, lambda at, n: F.substr(F.col(text), at + 1, n))
    # with many spans the text is split once: a substring is found by walking from the start
    many = lambda x: _let(F.split(F.col(text), ""), lambda c: pieces(x, lambda at, n: F.array_join(F.slice(c, at + 1, n), "")))
    done = _let(F.col(spans), lambda x: F.when(F.size(x) <= 32, few(x)).otherwise(many(x)))
    return docs.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(text))).drop(spans)
