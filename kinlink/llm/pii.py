"""Op 7: personal data by weak supervision.

Base kinds (email, ip, card, phone) come from fixed patterns and always stay.
Beyond them, loose candidates (number runs, spelled-out addresses, titled
names) are put to labelers - regular expressions, gazetteers, context words,
a checksum, a shape rule - that vote for, against or abstain. The votes of all
candidates of all documents, base matches included, are counted by pattern;
expectation-maximisation over that table estimates how reliable each labeler
is and how likely each pattern is personal data.

Those likelihoods are the targets of the span classifier: a logistic regression
on what the text shows (the span's shape, its ends, the words and characters
around it), which sees no votes. It learns from `sample` spans at most and
decides alone which candidates are added, apart from base spans, as kind
`number`, `address` or `name`.

One pass over the text; patterns are aggregated before they leave the
executors and there are at most a few thousand of them whatever the corpus.
Null or empty text has no spans; rows are judged one by one; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.shared import cut

KINDS = ("email", "ip", "card", "phone", "number", "address", "name")
N_BASE = 4
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9](?:[\x20()./-]{0,2}[0-9]){6,}")
_SPELLED = re.compile(r"([A-Za-z0-9._-]{2,40})\x20?[\[(](?:at|AT)[\])]\x20?([A-Za-z0-9-]+(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z0-9-]+)+)")
_NAME = re.compile(r"[^\W\d_][\w'-]+(?:\x20[^\W\d_][\w'-]+)?")
_DIGIT = re.compile(r"[0-9]")
TITLES = ("Mr. ", "Mrs. ", "Ms. ", "Miss ", "Dr. ", "Prof. ", "Sir ", "Herr ", "Frau ", "Hr. ", "Fr. ", "M. ", "Mme ", "Mlle ", "Monsieur ", "Madame ", "Sr. ", "Sra. ", "Srta. ", "Don ", "Doña ", "Señor ", "Señora ")
FOR = ("phone", "tel", "call", "fax", "mobile", "cell", "mail", "contact", "card", "visa", "mastercard", "amex", "ssn", "social security", "passport", "account", "iban", "bic", "konto", "telefon", "handy", "anruf", "ausweis", "adresse", "address", "born", "birth", "geboren", "naissance", "téléphone", "portable", "appel", "compte", "carte", "teléfono", "móvil", "llame", "cuenta", "tarjeta", "nacimiento", "dni", "correo")
AGAINST = ("version", "license", "licence", "isbn", "issn", "doi", "page", "figure", "table", "chapter", "token", "sha", "hash", "commit", "uuid", "key", "price", "total", "copyright", "(c)", "id:", "build", "revision", "port", "seite", "preis", "prix", "precio", "página")
CALLING = tuple("+" + c for c in "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "2221", "2720", "6011", "64", "65", "30", "36", "38", "35", "62", "50", "56", "57", "58")
FIRST_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen christopher nancy daniel lisa matthew betty anthony margaret mark sandra paul ashley steven kimberly andrew emily kenneth donna george michelle joshua carol kevin amanda brian dorothy edward melissa anna laura emma peter alice jane henry grace oliver sophie "
    "hans peter klaus jürgen wolfgang heinz günter helmut maria ursula monika petra elisabeth sabine renate helga karin brigitte ingrid erika andrea stefan thorsten uwe dieter lukas leon felix jonas lena lea marie sophia johanna katharina "
    "jean pierre michel andré philippe alain bernard jacques françois laurent nicolas julien antoine marie nathalie isabelle sylvie catherine martine françoise christine monique valérie camille chloé manon inès lucas hugo louis "
    "antonio josé manuel francisco juan carlos javier jesús miguel ángel luis pedro pablo maria carmen josefa isabel ana dolores pilar teresa rosa cristina lucía marta elena paula alba diego sergio alejandro".split()
)
LAST_NAMES = frozenset("smith johnson williams brown jones miller davis wilson taylor anderson thomas jackson white harris martin thompson moore clark lewis walker hall young allen king wright müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch bauer richter klein wolf schröder neumann schwarz zimmermann braun krüger bernard dubois durand moreau laurent simon michel lefebvre leroy roux david bertrand morel fournier girard garcía rodríguez gonzález fernández lópez martínez sánchez pérez gómez jiménez ruiz hernández díaz moreno álvarez romero torres ramírez".split())
DOMAINS = tuple("." + x for x in "com org net edu gov info biz io co uk de fr es it nl be ch at pl pt se no dk fi ie eu us ca au nz br mx ar cl jp cn in ru".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start, then kind."""
    out = []
    last, i = 0, t.find("@")
    while i >= 0:
        s = i
        while s > last and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, i + 1) if s < i else None
        if m:
            last = m.end()
            out.append((s, 0, last))
        i = t.find("@", last if m else i + 1)
    if _DIGIT.search(t):
        for m in _IP.finditer(t):
            if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 12:
                d = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        i = t.find("+")
        while i >= 0:
            m = _PHONE.match(t, i)
            if m and 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((i, 3, m.end()))
            i = t.find("+", m.end() if m else i + 1)
    out.sort()
    return out


def candidates(t: str, base: list[tuple[int, int, int]]):
    """Loose candidates outside base spans: (start, kind, end)."""
    out = []
    if _DIGIT.search(t):
        out += [(m.start(), 4, m.end()) for m in _NUMBER.finditer(t)]
    if "(at)" in t or "[at]" in t or "(AT)" in t or "[AT]" in t:
        out += [(m.start(), 5, m.end()) for m in _SPELLED.finditer(t)]
    for title in TITLES:
        i = t.find(title)
        while i >= 0:
            m = _NAME.match(t, i + len(title))
            if m and m.group()[0].isupper() and (i == 0 or not t[i - 1].isalnum()):
                out.append((m.start(), 6, m.end()))
            i = t.find(title, i + len(title))
    out.sort()
    if base and out:
        starts = np.array([b[0] for b in base])
        ends = np.maximum.accumulate(np.array([b[2] for b in base]))
        out = [c for c in out if not ((n := int(np.searchsorted(starts, c[2]))) and ends[n - 1] > c[0])]
    return out


def votes(t: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    """Votes of the labelers, -1, 0 or 1, then kind and length class: what the classifier sees."""
    s = t[start:end]
    before = t[max(0, start - 32) : start].lower()
    digits = "".join(c for c in s if "0" <= c <= "9")
    n = len(digits)
    regex = 1 if kind < N_BASE or kind == 5 else (-1 if kind == 4 and not 9 <= n <= 15 else 0)
    context = 1 if any(w in before for w in FOR) else -1 if any(w in before for w in AGAINST) else 0
    if kind in (0, 5):
        gazetteer = 1 if s.lower().endswith(DOMAINS) else 0
    elif kind == 6:
        w = s.lower().split()
        gazetteer = 1 if w[0] in FIRST_NAMES or w[-1] in LAST_NAMES else 0
    else:
        gazetteer = 1 if s.startswith(CALLING) or (12 <= n <= 19 and digits.startswith(ISSUERS)) else -1 if n > 19 else 0
    checksum = (1 if luhn(digits) else -1) if kind in (2, 4) and 12 <= n <= 19 else 0
    groups = len(re.findall(r"[0-9]+", s))
    shape = 1 if kind in (0, 1, 3, 5) or (kind in (2, 4) and groups in (3, 4) and n >= 9) else -1 if kind in (2, 4) and (groups == 1 or "/" in s or "." in s) else 0
    return regex, context, gazetteer, checksum, shape, kind, min(n // 3, 7)


N_LABELERS = 5


def reliabilities(v: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Dawid-Skene for two classes over vote patterns: posteriors of class 1 and the labelers' tables [labeler, class, vote]."""
    q = 1 / (1 + np.exp(-v.sum(axis=1)))  # starts from the majority
    table = np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        w = np.stack([(1 - q) * count, q * count])
        for j in range(v.shape[1]):
            for x in range(3):
                table[j, :, x] = (w[:, v[:, j] == x - 1]).sum(axis=1) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        prior = np.clip(w.sum(axis=1) / max(w.sum(), 1e-9), 0.01, 0.99)
        ll = np.log(prior)[:, None] + sum(np.log(table[j][:, v[:, j] + 1]) for j in range(v.shape[1]))
        q = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -50, 50)))
    return q, table


WIDTH = 1 << 11
_WORD = re.compile(r"[^\W\d_]+")


def features(t: str, start: int, kind: int, end: int) -> list[int]:
    """What the classifier sees of a span: hashes of its kind, shape, length, ends and surroundings."""
    s = t[start:end]
    shape = "".join("9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c for c in s[:64])
    brief = re.sub(r"(.)\1+", r"\1+", shape)
    digits, groups = sum("0" <= c <= "9" for c in s), len(re.findall("[0-9]+", s))
    before, after = t[max(0, start - 40) : start], t[end : end + 24]
    told = [f"k{kind}", f"s{kind}{brief[:16]}", f"d{digits}", f"g{groups}:{digits // 3}", f"n{min(len(s) // 4, 12)}", f"f{shape[:3]}", f"l{shape[-3:]}", f"p{s[:2]}"]
    told += [f"b{w}" for w in _WORD.findall(before.lower())[-3:]] + [f"a{w}" for w in _WORD.findall(after.lower())[:1]]
    ends = lambda c: "9" if c.isdigit() else "a" if c.isalpha() else c
    told += [f"<{ends(before[-1:])}", f">{ends(after[:1])}", f"c{before[-2:].strip()[-1:]}"]
    return sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) % WIDTH for x in told})


def train_classifier(rows: list[list[int]], target: np.ndarray, times: np.ndarray, rounds: int = 300, decay: float = 1e-3) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic regression on feature sets, against likelihoods, by Adam over all rows."""
    at = np.array([i for r in rows for i in r], np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = times / times.sum()
    w, m, v = (np.zeros(WIDTH + 1) for _ in range(3))
    w[-1] = np.log((share @ target + 1e-3) / (1 - share @ target + 1e-3))
    for k in range(1, rounds + 1):
        z = np.bincount(of, w[at], len(rows)) + w[-1]
        e = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target)
        g = np.append(np.bincount(at, e[of], WIDTH), e.sum()) + decay * np.append(w[:-1], 0.0) / WIDTH
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return float(w[-1]), w[:-1]


def learn(counts: dict[str, int], spans: list[tuple[str, list[int]]]) -> tuple[float, np.ndarray]:
    """Bias and weights from the counts of all vote patterns and some spans' patterns and features."""
    names = sorted(counts)
    v = np.array([[int(x) for x in n.split(",")[:N_LABELERS]] for n in names])
    q, _ = reliabilities(v, np.array([counts[n] for n in names], float))
    likely = dict(zip(names, q.tolist(), strict=True))
    seen = Counter((p, tuple(f)) for p, f in spans)
    keys = sorted(seen)
    return train_classifier([list(f) for _, f in keys], np.array([likely[p] for p, _ in keys]), np.array([seen[k] for k in keys], float))


SPAN = "start:int,kind:int,end:int"
SCAN = f"doc_id long, base array<struct<{SPAN}>>, loose array<struct<{SPAN},feats:array<int>>>, seen array<struct<votes:string,feats:array<int>>>"


def find_pii(docs: DataFrame, accept: float = 0.5, sample: int = 20_000) -> DataFrame:
    """doc_id, base and added spans (arrays of start, kind, end) of every document of docs (doc_id, text).

    sample: spans that the classifier learns from at most, those with the
    smallest hashes of document and place; the labelers' reliabilities follow
    from all.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]
    feats = ("feats", pa.list_(pa.int32()))
    types = [pa.list_(pa.struct(x)) for x in (place, [*place, feats], [("votes", pa.string()), feats])]

    def scan(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                columns: list[list] = [[], [], []]
                for t in part.column("text").to_pylist():
                    t = t or ""
                    base = base_spans(t)
                    loose = [(*x, features(t, *x)) for x in candidates(t, base)]
                    told = [(x, features(t, *x)) for x in base] + [(x[:3], x[3]) for x in loose]
                    columns[0].append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in base])
                    columns[1].append([dict(zip(("start", "kind", "end", "feats"), x, strict=True)) for x in loose])
                    columns[2].append([{"votes": ",".join(map(str, votes(t, *x))), "feats": f} for x, f in told])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "base", "loose", "seen"])

    found = cut(docs.mapInArrow(scan, SCAN))
    seen = found.select("doc_id", F.posexplode("seen").alias("i", "s"))
    counts = {r["v"]: r["count"] for r in seen.groupBy(F.col("s.votes").alias("v")).count().collect()}  # at most 3^5 x 7 x 8 rows
    if not counts:
        return found.select("doc_id", "base", F.array().cast(f"array<struct<{SPAN}>>").alias("added"))
    some = seen.orderBy(F.xxhash64("doc_id", "i"), "doc_id", "i").limit(sample).select("s.votes", "s.feats").collect()
    bias, w = learn(counts, [(r["votes"], r["feats"]) for r in some])
    weights = F.array(*[F.lit(round(float(x), 6)) for x in w])
    score = lambda x: F.aggregate(x["feats"], F.lit(round(bias, 6)), lambda z, i: z + F.element_at(weights, i + 1))
    least = float(np.log(accept / (1 - accept)))
    added = F.transform(F.filter("loose", lambda x: score(x) >= least), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return found.select("doc_id", "base", added.alias("added"))


def joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    n = [F.size(F.filter("base", (lambda i: lambda x: x["kind"] == i)(i))).cast("long").alias(f"n_{KINDS[i]}") for i in range(N_BASE)]
    return found.select("doc_id", *n, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
