"""Op 5: mixing sources to target weights by cube-method balanced sampling.

Targets: sources in order of code point (null last) weigh `weights`,
repeated, and share `share` of all words; a target stops at `most` times its
source's words and the excess is shared again by weight. The rate of a source
is its target over its words: every document is taken floor(rate) times, and
once more with the rest as inclusion probability.

The rest is drawn by the cube method. In a block of documents of one source
the vector of probabilities walks in the null space of the balancing
constraints (words and documents), three undecided documents at a time, until
at most two are undecided; the undecided of all blocks of a source meet in
groups, level by level. `reserve` documents a source do not walk: with the
last two undecided they are the landing problem, settled by the choice among
all subsets whose words come nearest to the target, then whose number of
documents does. Walks are driven by hashes of doc_id, so reruns agree.

No shuffle carries text: only (doc_id, size) of the documents with a
fractional rate. Blocks are of bounded size however large a source is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinlink.llm import textkit as tk
from kinlink.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(col):
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null has none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target words of each source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def walk(p: np.ndarray, size: np.ndarray, coin: np.ndarray) -> np.ndarray:
    """Flight phase: p moves with sum(p) and sum(p*size) kept until at most two entries lie strictly between 0 and 1."""
    p, size, coin = p.tolist(), size.tolist(), coin.tolist()
    eps, hand, i = 1e-9, [], 0
    n = len(p)
    for j in range(n):
        if not eps < p[j] < 1 - eps:
            p[j] = float(round(p[j]))
    while True:
        while len(hand) < 3 and i < n:
            if 0 < p[i] < 1:
                hand.append(i)
            i += 1
        if len(hand) < 3:
            return np.array(p)
        a, b, c = hand
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for x, d in zip(hand, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[x]) / d), min(down, p[x] / d)
            elif d < 0:
                up, down = min(up, -p[x] / d), min(down, -(1 - p[x]) / d)
        step = up if coin[hand[0]] * (up + down) < down else -down
        for x, d in zip(hand, u, strict=True):
            p[x] += step * d
            if p[x] < eps:
                p[x] = 0.0
            elif p[x] > 1 - eps:
                p[x] = 1.0
        hand = [x for x in hand if 0 < p[x] < 1]


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 10_000, fan_in: int = 10_000, reserve: int = 12) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words) and copies of every document of docs.

    Repeated rows are documents of their own; rows that agree in everything
    get one decision each, in a fixed order. A null source is a source. An
    empty table gives an empty result. The driver holds one row a source, and
    the reserve of each: as many as the mixture's table of weights has.
    """
    import pandas as pd  # on the driver alone

    spark = docs.sparkSession
    local = lambda rows, schema: spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], to_arrow_schema(schema)), schema)  # noqa: E731  (rows in the plan: no Python worker reads them)
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    by = {r["source"]: r for r in sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()}  # one row a source
    sizes = {s: int(r["n"]) for s, r in by.items()}
    goal = targets(sizes, weights, share, most)
    rows = [(s, sizes[s], float(goal[s]), goal[s] / sizes[s] if sizes[s] else 0.0, max(1, -(-int(by[s]["docs"]) // block))) for s in sizes]
    plan = local(rows, T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("rate", T.DoubleType()), T.StructField("blocks", T.LongType())]))
    # the number of sources is that of the mixture's table; it is broadcast below 10,000 of them
    plan = F.broadcast(plan) if len(rows) <= 10_000 else plan
    d = sized.alias("d").join(plan.alias("s"), F.expr("d.source <=> s.source")).select("d.doc_id", "d.source", "size", "source_size", "target", "rate", "blocks")
    d = d.withColumn("sure", F.floor(F.col("rate") + 1e-12).cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("sure")))
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks")))

    @tk.frugal
    def fly(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in ("draw", "doc_id", "size")], null_placement="at_end"))
        x, size, draw = t["p"].to_numpy(), t["size"].to_numpy().astype(float), t["draw"].to_numpy()
        coin = (draw.astype(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
        held = reserve if t["block"][0].as_py() == 0 else 0
        p = np.concatenate([x[:held], walk(x[held:], size[held:], coin[held:])])
        return t.set_column(t.schema.get_field_index("p"), t.schema.field("p"), pa.array(p))

    kept = ["doc_id", "source", "size", "source_size", "target", "sure", "p", "block", "draw", "blocks"]
    d = d.withColumn("draw", F.xxhash64(F.lit(7), "doc_id", "size")).select(kept)
    schema = d.schema
    # documents without words or without a fraction need no draw
    still = d.where((F.col("p") <= 1e-9) | (F.col("size") == 0)).withColumn("p", F.lit(0.0))
    moved = cut(d.where((F.col("p") > 1e-9) & (F.col("size") > 0)).groupBy("source", "block").applyInArrow(fly, schema))
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    parts = [still, moved.where(~open_)]
    rest, blocks = moved.where(open_), max((r[4] for r in rows), default=1)
    while blocks > 1:
        blocks = -(-blocks * 2 // fan_in)
        up = cut(rest.withColumn("block", F.pmod(F.col("block"), F.lit(blocks))).groupBy("source", "block").applyInArrow(fly, schema))
        parts.append(up.where(~open_))
        rest = up.where(open_)
    # landing: at most two documents a source are left, and the reserve
    left = rest.toPandas().sort_values(["source", "draw", "doc_id", "size"], ignore_index=True)
    state = [d.where(F.lit(False)), *parts]
    done = None
    for x in state:
        done = x if done is None else done.unionByName(x)
    if len(left):
        sums = done.groupBy("source").agg(F.sum(F.col("size") * (F.col("sure") + F.col("p"))).alias("n")).toPandas()
        have = {None if pd.isna(s) else s: n for s, n in zip(sums["source"], sums["n"], strict=True)}
        for s, g in left.groupby("source", dropna=False):
            s = None if pd.isna(s) else s
            z, sure = g["size"].to_numpy(float), g["sure"].to_numpy(float)
            base = have.get(s, 0.0) + float((z * sure).sum())
            tries = (np.arange(2 ** len(g))[:, None] >> np.arange(len(g))) & 1
            words, number = np.abs(base + tries @ z - goal[s]), np.abs(tries.sum(axis=1) - g["p"].to_numpy(float).sum())
            left.loc[g.index, "p"] = tries[np.lexsort((number, words))[0]].astype(float)
        left = left.astype(object).where(left.notna(), None)
        done = done.unionByName(local(left[kept].itertuples(index=False), schema))
    copies = (F.col("sure") + F.col("p").cast("long")).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))
