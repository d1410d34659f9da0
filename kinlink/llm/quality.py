"""Op 3: text quality by a sparse ensemble of rules.

Statistics of a text are Spark column expressions. On a bounded sample of
labelled documents, boosted small trees are grown over them (numpy, on the
driver); every path in a tree is a conjunctive rule; a lasso logistic
regression keeps few of them; what is kept is compiled back into one Spark
column. Scoring is therefore a projection inside whole-stage code: no shuffle,
no Python worker, one pass over the text.

Null and empty texts have the statistics of an empty text; rows are judged one
by one; without labels of both classes every score is 0.5. A doc_id that is
labelled twice counts as 1 if any label is; of several texts under one labelled
doc_id the one with the smallest statistics is learnt from. An empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = ("*", "$", "&", "%", "#", "!", "|", ".", ",")
PREFIX = "__kl_q_"
#: names of the statistics, in the order of `statistics`
NAMES = ("chars", "words", "word_len", "lines", "line_len", "line_repeat", "word_repeat", "upper", "digits", *(f"sym{i}" for i in range(len(SYMBOLS))))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with column `PREFIX`<name> for every statistic."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.withColumn(f"{PREFIX}text", t).withColumn(f"{PREFIX}chars", F.length(f"{PREFIX}text").cast("double"))
    d = d.withColumn(f"{PREFIX}w", F.split(f"{PREFIX}text", " ")).withColumn(f"{PREFIX}l", F.split(f"{PREFIX}text", "\n"))
    n, size = F.greatest(f"{PREFIX}chars", F.lit(1.0)), lambda c: F.size(c).cast("double")
    d = d.withColumns({f"{PREFIX}words": size(f"{PREFIX}w"), f"{PREFIX}lines": size(f"{PREFIX}l")})
    d = d.withColumns(
        {
            f"{PREFIX}word_len": n / F.col(f"{PREFIX}words"),
            f"{PREFIX}line_len": n / F.col(f"{PREFIX}lines"),
            f"{PREFIX}line_repeat": 1 - size(F.array_distinct(f"{PREFIX}l")) / F.col(f"{PREFIX}lines"),
            f"{PREFIX}word_repeat": 1 - size(F.array_distinct(f"{PREFIX}w")) / F.col(f"{PREFIX}words"),
            f"{PREFIX}upper": F.regexp_count(f"{PREFIX}text", F.lit("[A-Z]")).cast("double") / n,
            f"{PREFIX}digits": F.regexp_count(f"{PREFIX}text", F.lit("[0-9]")).cast("double") / n,
        }
        | {f"{PREFIX}sym{i}": (F.col(f"{PREFIX}chars") - F.length(F.replace(f"{PREFIX}text", F.lit(c), F.lit("")))) / n for i, c in enumerate(SYMBOLS)}
    )
    return d.drop(f"{PREFIX}text", f"{PREFIX}w", f"{PREFIX}l")


@dataclass(frozen=True)
class Rule:
    """Conjunction of (statistic, is_above, threshold)."""

    parts: tuple[tuple[int, bool, float], ...]

    def on(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, cut in self.parts:
            out &= (x[:, j] > cut) if above else (x[:, j] <= cut)
        return out

    def column(self) -> Column:
        out = None
        for j, above, cut in self.parts:
            c = F.col(f"{PREFIX}{NAMES[j]}")
            c = (c > F.lit(cut)) if above else (c <= F.lit(cut))
            out = c if out is None else out & c
        return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 48, seed: int = 1) -> list[Rule]:
    """Paths of gradient-boosted trees for a logistic loss."""
    r = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(x.shape[1])], 1)  # x <= cuts[k] where code <= k
    f, rules = np.full(len(x), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p) + 1e-6
        rows = np.flatnonzero(r.random(len(x)) < 0.7)
        todo = [(rows, (), 0)]
        step = np.zeros(len(x))
        while todo:
            at, parts, level = todo.pop()
            best = None
            if level < depth and len(at) >= 20:
                gs, hs = g[at].sum(), h[at].sum()
                for j in range(x.shape[1]):
                    if not len(cuts[j]):
                        continue
                    n = len(cuts[j]) + 1
                    gl, hl = np.cumsum(np.bincount(code[at, j], g[at], n))[:-1], np.cumsum(np.bincount(code[at, j], h[at], n))[:-1]
                    nl = np.cumsum(np.bincount(code[at, j], minlength=n))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < 8) | (len(at) - nl < 8)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                        best = (gain[k], j, k)
            if best is None:
                if parts:
                    step += Rule(parts).on(x) * (rate * g[at].sum() / (h[at].sum() + 1))
                continue
            _, j, k = best
            cut = float(cuts[j][k])
            left = code[at, j] <= k
            for above, sub in ((False, at[left]), (True, at[~left])):
                # two bounds on one side of a statistic are one
                kept = tuple(q for q in parts if not (q[0] == j and q[1] == above))
                rules.append(Rule((*kept, (j, above, cut))))
                todo.append((sub, (*kept, (j, above, cut)), level + 1))
        f = f + step
    return list(dict.fromkeys(rules))


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty (accelerated proximal gradient)."""
    n, k = z.shape
    mean = z.mean(axis=0)
    zc = z - mean
    lip = 0.25 * np.linalg.norm(zc, 2) ** 2 / n + 0.25 + 1e-9
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(zc @ v + c))) - y
        w2 = v - (zc.T @ e / n) / lip
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - penalty / lip, 0)
        b2 = c - e.mean() / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b - float(mean @ w), w


@dataclass
class Model:
    bias: float
    rules: list[tuple[Rule, float]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for r, w in self.rules:
            f += w * r.on(x)
        return 1 / (1 + np.exp(-f))

    def column(self) -> Column:
        f = F.lit(self.bias)
        for r, w in self.rules:
            f = f + F.when(r.column(), F.lit(w)).otherwise(0.0)
        return F.lit(1.0) / (1 + F.exp(-f))


def train(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> Model | None:
    y = np.asarray(y, float)
    if len(set(y.tolist())) < 2:
        return None
    rules = grow(x, y)
    b, w = lasso(np.stack([r.on(x) for r in rules], 1).astype(float), y, penalty) if rules else (0.0, [])
    return Model(b, [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4])


def score_quality(docs: DataFrame, labels: DataFrame, usable="true", sample: int = 12_000, column: str = "quality") -> DataFrame:
    """docs with `quality_score` (0 to 1); other columns stay, one of that name is replaced.

    sample: bound on the labelled rows learnt from, those with the smallest
    hashes of doc_id where `usable` holds.
    """
    usable = F.expr(usable) if isinstance(usable, str) else usable
    docs = docs.drop("quality_score")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias(f"{PREFIX}y")).where(usable).where(F.col(f"{PREFIX}y").isin(0, 1) & F.col("doc_id").isNotNull())
    some = known.groupBy("doc_id").agg(F.max(f"{PREFIX}y").alias(f"{PREFIX}y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")).select("doc_id", f"{PREFIX}y", *[f"{PREFIX}{n}" for n in NAMES]).toPandas()
    got = got.sort_values(list(got.columns)).drop_duplicates("doc_id")
    model = train(got[[f"{PREFIX}{n}" for n in NAMES]].to_numpy(float), got[f"{PREFIX}y"].to_numpy(float)) if len(got) else None
    if model is None:
        return docs.withColumn("quality_score", F.lit(0.5))
    return statistics(docs).withColumn("quality_score", model.column()).drop(*[f"{PREFIX}{n}" for n in NAMES])
