"""Op 4: near-duplicate embeddings by a robust-pruned flat graph.

Vectors are compared within a class (equal label, equal dimension) by cosine
in double precision. Equal vectors are one node. A class is covered by
overlapping shards around centroids, which are fitted on a bounded sample and
kept apart by more than the range, so that a dense family is not cut up: a
vector has its home in the nearest shard and visits those nearly as near.

Build. A shard inserts its vectors batch by batch: a beam search of the graph
so far finds a vector's candidates; one that is so near to a leader that all
vectors of its ball link joins the ball, any other becomes a leader with a
robust-pruned list of neighbours, which get it in turn. The lists of all shards
are united by vector into one flat graph.

Search. Each shard searches the united graph for its leaders, from the medoid
and the leader itself; the beam descends greedily and, while half of what it
holds can still hold links, grows, so that the search expands through
everything in range. Balls that it brings together are verified member by
member in double precision, unless their radii leave no doubt. A pair is
counted in one shard and never shuffled: a shard reports link counts and a
spanning forest.

A shard of more than `most` vectors, such as one family that holds a third of
all rows, is no graph's task: it is laid in pieces of `block_bytes`, which meet
two by two and are compared by matrix products, exactly.

`audit_recall` measures the links found against brute force for every vector
whose id is divisible by 50. The broadcasts (centroids, pieces) are bounded by
`max_centroids`.

Vectors that are null, zero, or hold null or non-finite components, and rows
without label, link with nothing and form their own component. A null vec_id
stays null and links with nothing. Rows that repeat are vectors of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.shared import components, cut
from kinlink.llm.textkit import ranges

def prepared(df: DataFrame) -> DataFrame:
    """vec_id, class (label and dimension; null: links with nothing), key (digest of the vector), unit vector as float64 bytes."""

    def unit(batches):
        for b in batches:
            cls, key, vec = [], [], []
            for label, x, vid in zip(b.column("label").to_pylist(), b.column("embedding"), b.column("vec_id").to_pylist(), strict=True):
                v = None
                if label is not None and vid is not None and x.is_valid:
                    got = x.values
                    if len(got) and not got.null_count:
                        v = np.asarray(got, np.float64)
                        # scaled first: squares must neither overflow nor vanish
                        big = np.abs(v).max() if np.isfinite(v).all() else 0.0
                        v = None if big == 0.0 else v / big
                        v = None if v is None else v / np.sqrt((v * v).sum()) + 0.0
                cls.append(None if v is None else f"{label}:{len(v)}")
                key.append(None if v is None else hashlib.md5(v.tobytes()).digest())
                vec.append(None if v is None else v.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cls, pa.string()), pa.array(key, pa.binary()), pa.array(vec, pa.binary())], ["vec_id", "cls", "key", "vec"])

    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(unit, "vec_id long, cls string, key binary, vec binary")


def centroids(x: np.ndarray, k: int, apart: float, rounds: int = 4, flat: int = 1024) -> np.ndarray:
    """Unit centroids of a sample in a fixed order: k at most, no two of a cell more similar than `apart`, moved to the middle of what is theirs.

    More than `flat` are fitted cell by cell, so that no step compares all of
    the sample with all centroids.
    """
    if k > flat and len(x) > k:
        few = int(np.sqrt(k))
        coarse = centroids(x[np.linspace(0, len(x) - 1, min(len(x), 24 * few)).astype(np.int64)], few, 2.0, rounds, flat)
        own = np.concatenate([np.argmax(x[a : a + 4096] @ coarse.T, axis=1) for a in range(0, len(x), 4096)])
        cells = [x[own == j] for j in range(len(coarse))]
        return np.concatenate([centroids(c, max(1, round(k * len(c) / len(x))), apart, rounds, 1 << 62) for c in cells if len(c)])
    c = np.zeros((0, x.shape[1]))
    for a in range(0, len(x), 1024):
        own = x[a : a + 1024]
        own = own[(own @ c.T < apart).all(axis=1)] if len(c) else own
        kept: list[int] = []
        for i in range(len(own)):
            if len(c) + len(kept) < k and (not kept or (own[kept] @ own[i]).max() < apart):
                kept.append(i)
        c = np.concatenate([c, own[kept]])
        if len(c) >= k:
            break
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[a : a + 4096] @ c.T, axis=1) for a in range(0, len(x), 4096)])
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        n = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(n > 1e-9, s / np.maximum(n, 1e-9), c)
    return c


class Cells:
    """Finds the nearest centroids of vectors; many centroids through the cells of a coarser level, of which the `probe` nearest are looked into."""

    def __init__(self, m: np.ndarray, flat: int = 1024, probe: int = 4):
        self.m, self.coarse, self.probe = m, None, probe
        if len(m) > flat:
            order = np.random.default_rng(1).permutation(len(m))
            self.coarse = centroids(m[order], int(np.sqrt(len(m))), 2.0)
            cell = np.concatenate([np.argmax(m[a : a + 4096] @ self.coarse.T, axis=1) for a in range(0, len(m), 4096)])
            self.members = [np.flatnonzero(cell == j) for j in range(len(self.coarse))]

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids of each row, nearest first, and their similarities; -1 and -2 where fewer were met."""
        k = min(k, len(self.m))
        if self.coarse is None:
            s = x @ self.m.T
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            val = np.take_along_axis(s, top, 1)
        else:
            c = x @ self.coarse.T
            p = min(self.probe, c.shape[1])
            look = np.argpartition(-c, p - 1, axis=1)[:, :p]
            top, val = np.full((len(x), k), -1), np.full((len(x), k), -2.0)
            for j in np.unique(look).tolist():
                rows, own = np.flatnonzero((look == j).any(axis=1)), self.members[j]
                if not len(own):
                    continue
                s = x[rows] @ self.m[own].T
                n = min(k, len(own))
                at = np.argpartition(-s, n - 1, axis=1)[:, :n]
                ids, v = np.concatenate([top[rows], own[at]], 1), np.concatenate([val[rows], np.take_along_axis(s, at, 1)], 1)
                o = np.argsort(-v, axis=1, kind="stable")[:, :k]
                top[rows], val[rows] = np.take_along_axis(ids, o, 1), np.take_along_axis(v, o, 1)
        o = np.argsort(-val, axis=1, kind="stable")
        return np.take_along_axis(top, o, 1), np.take_along_axis(val, o, 1)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each node."""
    low = np.arange(n)
    while True:
        was = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (was == low).all():
            return low


def robust_prune(x: np.ndarray, node: int, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of a node among candidates, nearest first; a candidate much nearer to a kept one than to the node goes."""
    v = x[cand]
    dist = 1 - v @ x[node]
    o = np.argsort(dist, kind="stable")
    cand, v, dist = cand[o], v[o], dist[o]
    between, alive, kept = alpha * (1 - v @ v.T), np.ones(len(cand), bool), []
    for i in range(len(cand)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= between[i] > dist
    return cand[kept]


def beam(x: np.ndarray, table: np.ndarray, q: np.ndarray, start: np.ndarray, width: int, stop: float = -2.0) -> tuple[np.ndarray, np.ndarray]:
    """The `width` nearest nodes that greedy searches of the graph reach, for many query vectors at once; -1 where there are fewer.

    table: neighbours of each node, -1 for none; start: first nodes of each
    query, -1 for none. A search goes on while its beam holds a node that it
    has not gone through, among the `width` nearest and not below `stop`
    (a similarity) unless all its beam is.
    """
    n, m = len(x), len(q)
    seen = np.zeros((m, n), bool)
    ids, val, done = np.full((m, width), -1), np.full((m, width), -3.0), np.ones((m, width), bool)
    r, c = np.nonzero(start >= 0)
    ids[r, c], val[r, c], done[r, c] = start[r, c], np.einsum("ij,ij->i", q[r], x[start[r, c]]), False
    seen[r, start[r, c]] = True
    rows = np.arange(m)
    while len(rows):
        v = np.where(done[rows], -4.0, val[rows])
        best = np.argmax(v, axis=1)
        top = v[np.arange(len(rows)), best]
        on = (top > -3.0) & ((top >= stop) | (val[rows].max(axis=1) < stop))
        rows, best = rows[on], best[on]
        if not len(rows):
            break
        done[rows, best] = True
        near = table[ids[rows, best]]
        new = (near >= 0) & ~seen[rows[:, None], near]
        r, c = np.nonzero(new)
        if not len(r):
            continue
        h = near[r, c]
        seen[rows[r], h] = True
        s = np.full(near.shape, -3.0)
        s[r, c] = np.einsum("ij,ij->i", q[rows[r]], x[h])
        some = np.unique(r)
        at = rows[some]
        ids2 = np.concatenate([ids[at], np.where(new[some], near[some], -1)], 1)
        val2 = np.concatenate([val[at], s[some]], 1)
        done2 = np.concatenate([done[at], ~new[some]], 1)
        o = np.argpartition(-val2, width - 1, axis=1)[:, :width]
        ids[at], val[at], done[at] = (np.take_along_axis(z, o, 1) for z in (ids2, val2, done2))
    return ids, val


class Graph:
    """The graph of one shard while it is built: leaders, whose balls hold what is nearer than `ball`, and their lists."""

    def __init__(self, x: np.ndarray, group: np.ndarray, ball: float, degree: int, alpha: float, width: int):
        n = len(x)
        self.x, self.leader = x, np.arange(n)
        table = np.full((n, 2 * degree), -1)
        size = np.zeros(n, np.int64)
        seed = int(np.argmax(x @ x.sum(axis=0)))
        order = np.append(seed, np.delete(np.arange(n), seed))
        a, step = 0, 1
        while a < n:
            batch = order[a : a + step]
            q = x[batch]
            ids = val = None
            if a:
                ids, val = (np.concatenate(v) for v in zip(*[beam(x, table, q[i : i + 256], np.full((len(q[i : i + 256]), 1), seed), width) for i in range(0, len(q), 256)], strict=True))
                near = np.where((ids >= 0) & (group[ids] == group[batch][:, None]), val, -3.0)
                best = near.argmax(axis=1)
                joins = near.max(axis=1) >= ball
                self.leader[batch[joins]] = ids[joins, best[joins]]
                batch, q, ids = batch[~joins], q[~joins], ids[~joins]
            new: list[int] = []
            among = q @ q.T
            for i, node in enumerate(batch.tolist()):
                prior = np.array(new, np.int64)
                if len(prior):
                    own = np.where(group[batch[prior]] == group[node], among[i, prior], -3.0)
                    if own.max() >= ball:
                        self.leader[node] = batch[prior[own.argmax()]]
                        continue
                cand = batch[prior[np.argsort(-among[i, prior], kind="stable")[:degree]]] if len(prior) else prior
                if ids is not None:
                    cand = np.concatenate([ids[i][ids[i] >= 0], cand])
                new.append(i)
                if not len(cand):
                    continue
                kept = robust_prune(x, node, cand, degree, alpha)
                table[node, : len(kept)], size[node] = kept, len(kept)
                for other in kept.tolist():
                    if size[other] == table.shape[1]:
                        fewer = robust_prune(x, other, np.append(table[other], node), degree, alpha)
                        table[other] = -1
                        table[other, : len(fewer)], size[other] = fewer, len(fewer)
                    else:
                        table[other, size[other]] = node
                        size[other] += 1
            a, step = a + step, min(256, max(step * 2, 16))
        self.table = table


def in_range(u: np.ndarray, v: np.ndarray, least: float) -> np.ndarray:
    """Pairs of rows in range; next to the bound decided as the whole operator compares: in double precision, by both norms."""
    s = u @ v.T
    hit = s >= least
    for i, j in zip(*np.nonzero(np.abs(s - least) < 1e-9), strict=True):
        a, b = u[i], v[j]
        hit[i, j] = float((a * b).sum()) / np.sqrt(float((a * a).sum()) * float((b * b).sum())) >= least
    return hit


def counted(home: np.ndarray, visits: np.ndarray, own: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of members (rows a, columns b) this shard counts: both at home here, or one, unless the other's home has both and comes first."""
    here = (home[a] == own)[:, None], (home[b] == own)[None, :]
    met = lambda p, q: (visits[p][:, None, :] == home[q][None, :, None]).any(axis=2)  # noqa: E731  p visits the home of q
    left = here[0] & ~here[1] & ~((home[b] < own)[None, :] & met(a, b))
    right = here[1] & ~here[0] & ~((home[a] < own)[:, None] & met(b, a).T)
    return (here[0] & here[1]) | left | right


def counted_pairs(home: np.ndarray, visits: np.ndarray, own: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As `counted`, for pairs (a[i], b[i])."""
    here = home[a] == own, home[b] == own
    met = lambda p, q: (visits[p] == home[q][:, None]).any(axis=1)
    return (here[0] & here[1]) | (here[0] & ~here[1] & ~((home[b] < own) & met(a, b))) | (here[1] & ~here[0] & ~((home[a] < own) & met(b, a)))


def verified(x: np.ndarray, mult: np.ndarray, home: np.ndarray, visits: np.ndarray, own: int, leader: np.ndarray, radius: np.ndarray, pairs: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Link counts and smallest node reachable, from pairs of leaders whose balls may hold links (a leader with itself included)."""
    n, angle = len(x), np.arccos(least)
    links, low = np.zeros(n, np.int64), np.arange(n)
    o = np.argsort(leader, kind="stable")
    first, count = np.searchsorted(leader[o], np.arange(n)), np.bincount(leader, minlength=n)
    lone = (count[pairs[:, 0]] == 1) & (count[pairs[:, 1]] == 1)
    one = pairs[lone & (pairs[:, 0] != pairs[:, 1])]
    for i in range(0, len(one), 1 << 16):
        a, b = one[i : i + (1 << 16)].T
        s = np.einsum("ij,ij->i", x[a], x[b])
        hit = s >= least
        for k in np.flatnonzero(np.abs(s - least) < 1e-9).tolist():
            hit[k] = in_range(x[a[k : k + 1]], x[b[k : k + 1]], least)[0, 0]
        a, b = a[hit], b[hit]
        low = forest(n, low[a], low[b])[low]
        here = counted_pairs(home, visits, own, a, b)
        np.add.at(links, a[here], mult[b[here]])
        np.add.at(links, b[here], mult[a[here]])
    for p, q in pairs[~lone].tolist():
        a, b = (o[first[k] : first[k] + count[k]] for k in (p, q))
        # members of a ball agree in home and visits
        here = counted_pairs(home, visits, own, a[:1], b[:1])[0]
        sure = 2 * radius[p] if p == q else np.arccos(np.clip(x[p] @ x[q], -1, 1)) + radius[p] + radius[q]
        if sure < angle - 1e-7:  # all pairs link
            low = forest(n, low[np.append(a, np.full(len(b), a[0]))], low[np.append(np.full(len(a), b[0]), b)])[low]
            if here:
                links[a] += mult[b].sum() - (mult[a] if p == q else 0)
                if p != q:
                    links[b] += mult[a].sum()
            continue
        for i in range(0, len(a), 2048):
            u = a[i : i + 2048]
            hit = in_range(x[u], x[b], least)
            if p == q:
                hit[np.arange(len(u)), np.arange(i, i + len(u))] = False
            r, c = np.nonzero(hit & (low[u][:, None] != low[b]))
            if len(r):
                low = forest(n, low[u[r]], low[b[c]])[low]
            if here:
                links[u] += hit @ mult[b]
                if p != q:
                    links[b] += mult[u] @ hit
    return links, low


def compare(x: np.ndarray, mult: np.ndarray, home: np.ndarray, visits: np.ndarray, own: int, sides: list[np.ndarray], least: float, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Link counts and smallest node reachable, over all pairs within one side or between two.

    Tiles of rows meet by matrix products; two tiles whose angle exceeds their
    radii and the range's angle together cannot hold a pair.
    """
    n, angle = len(x), np.arccos(least)
    links, low = np.zeros(n), np.arange(n)
    tiles = []
    for side in sides:
        own_tiles = []
        for at in (side[i : i + tile] for i in range(0, len(side), tile)):
            mid = x[at].sum(axis=0)
            size = np.linalg.norm(mid)
            mid = mid / size if size > 1e-9 else x[at[0]]
            own_tiles.append((at, mid, np.arccos(np.clip(x[at] @ mid, -1, 1)).max()))
        tiles.append(own_tiles)
    if len(sides) == 1:
        meet = [(a, b, i == j) for i, a in enumerate(tiles[0]) for j, b in enumerate(tiles[0][: i + 1])]
    else:
        meet = [(a, b, False) for a in tiles[0] for b in tiles[1]]
    for (a, am, ar), (b, bm, br), same in meet:
        if np.arccos(np.clip(am @ bm, -1, 1)) > ar + br + angle + 1e-6:
            continue
        hit = in_range(x[a], x[b], least)
        if same:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        i, j = np.nonzero(hit & (low[a][:, None] != low[b]))
        if len(i):
            low = forest(n, low[a[i]], low[b[j]])[low]
        hit &= counted(home, visits, own, a, b)
        links[a] += hit @ mult[b].astype(np.float64)
        if not same:
            links[b] += mult[a].astype(np.float64) @ hit
    return links.astype(np.int64), low


def _arrays(t: pa.Table):
    """Of a shard's rows: vectors, nodes, copies, homes, and the other shards of each (padded with -1)."""
    x = np.frombuffer(b"".join(t["vec"].to_pylist())).reshape(t.num_rows, -1)
    ids, mult, home = (np.asarray(t[k].combine_chunks(), np.int64) for k in ("node", "n", "home"))
    lists = t["shards"].to_pylist()
    visits = np.full((t.num_rows, max(1, max(map(len, lists)))), -1, np.int64)
    for i, v in enumerate(lists):
        visits[i, : len(v)] = v
    return x, ids, mult, home, visits


def near_duplicates(vectors: DataFrame, least: float = 0.93, shard: int = 700, overlap: int = 2, margin: float = 0.06, degree: int = 16, alpha: float = 1.2, width: int = 32, per_centroid: int = 24, max_centroids: int = 50_000, most: int = 4_000, block_bytes: int = 8 << 20) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    per_centroid x number of centroids bounds the sample that centroids are
    fitted on. overlap: shards of a vector at most; margin: how much less similar
    than to its home it may be to the others. width: beam of the searches before
    it grows. most: vectors of a shard searched as a graph; larger ones meet in
    pieces of block_bytes of vectors.
    """
    spark = vectors.sparkSession
    rows = cut(prepared(vectors))
    # a vector is known by a number of its own: ids of rows may repeat
    nodes = rows.where("key is not null").groupBy("cls", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min("vec").alias("vec"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    sizes = {r["cls"]: r["count"] for r in nodes.groupBy("cls").count().collect()}  # one row a label
    total = sum(sizes.values())
    per = max(shard, -(-total // max_centroids))
    parts = {c: max(1, -(-n // per)) for c, n in sizes.items()}
    number = {c: i for i, c in enumerate(sorted(sizes))}
    centre: dict[str, Cells] = {}
    large = [c for c in parts if parts[c] > 1]
    if large:
        share = F.create_map(*[F.lit(y) for c in large for y in (c, min(1.0, per_centroid * parts[c] / sizes[c]))]) if len(large) <= 2000 else F.lit(per_centroid / per)
        rate = share[F.col("cls")] if len(large) <= 2000 else share
        picked = nodes.where(F.col("cls").isin(large)) if len(large) <= 2000 else nodes
        got = picked.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < rate * 1_000_000).select("cls", "key", "vec").orderBy("cls", "key").toPandas()
        for c, g in got.groupby("cls"):
            # centroids nearer to each other than the range's angle and a little would cut a dense family up
            centre[c] = Cells(centroids(np.stack([np.frombuffer(v) for v in g["vec"]]), parts[c], least - 0.05))
    shared = spark.sparkContext.broadcast((number, centre))

    def assign(batches):
        number, centre = shared.value
        for b in batches:
            cls, vec = b.column("cls").to_pylist(), b.column("vec").to_pylist()
            home, lists = np.zeros(b.num_rows, np.int64), [[] for _ in cls]
            by: dict[str, list[int]] = {}
            for i, c in enumerate(cls):
                by.setdefault(c, []).append(i)
            for c, at in by.items():
                m, base = centre.get(c), number[c] << 32
                for a in range(0, len(at), 4096):
                    part = at[a : a + 4096]
                    if m is None or len(m.m) == 1:
                        home[part] = base
                        continue
                    top, val = m.nearest(np.stack([np.frombuffer(vec[i]) for i in part]), overlap)
                    home[part] = base + top[:, 0]
                    for i, t, v in zip(part, top.tolist(), val.tolist(), strict=True):
                        lists[i] = [base + j for j, w in zip(t[1:], v[1:], strict=True) if j >= 0 and w >= v[0] - margin]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), b.column("vec"), pa.array(home), pa.array(lists, pa.list_(pa.int64()))], ["node", "n", "vec", "home", "shards"])

    housed = cut(nodes.select("node", "n", "vec", "cls").mapInArrow(assign, "node long, n long, vec binary, home long, shards array<long>"))
    member = housed.withColumn("shard", F.explode(F.concat(F.array("home"), "shards")))
    # one row a centroid; shards too large for a graph, and into how many pieces they go
    over = {r["shard"]: max(2, -(-r["bytes"] // block_bytes)) for r in member.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.octet_length("vec")).alias("bytes")).where(F.col("n") > most).collect()}
    ball = np.cos(0.45 * np.arccos(least))
    inside = member.where(~F.col("shard").isin(list(over))) if over else member

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        x, ids, _, home, visits = _arrays(t)
        group = np.unique(np.concatenate([home[:, None], visits], 1), axis=0, return_inverse=True)[1].ravel()
        g = Graph(x, group, ball, degree, alpha, width)
        return pa.table({"shard": t["shard"], "node": t["node"], "leader": pa.array(ids[g.leader]), "near": pa.array([ids[v[v >= 0]].tolist() for v in g.table], pa.list_(pa.int64()))})

    built = cut(inside.groupBy("shard").applyInArrow(build, "shard long, node long, leader long, near array<long>"))
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # at most `overlap` lists

    def find(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        x, ids, mult, home, visits = _arrays(t)
        n, own = len(ids), t["shard"][0].as_py()
        leader = np.searchsorted(ids, np.asarray(t["leader"].combine_chunks(), np.int64))
        # the united lists, as far as they lie in this shard, lead from ball to ball
        near = t["near"].combine_chunks()
        to, of = np.asarray(near.flatten(), np.int64), np.repeat(np.arange(n), np.asarray(pc.list_value_length(near).fill_null(0)))
        at = np.minimum(np.searchsorted(ids, to), n - 1)
        ok = ids[at] == to
        a, b = leader[of[ok]], leader[at[ok]]
        edge = np.unique(np.concatenate([a * n + b, b * n + a])[np.tile(a != b, 2)])
        a, b = edge // n, edge % n
        count = np.bincount(a, minlength=n)
        table = np.full((n, max(1, int(count.max(initial=0)))), -1)
        table[a, ranges(np.zeros(n, np.int64), count)] = b
        heads = np.unique(leader)
        medoid = heads[np.argmax(x[heads] @ x.sum(axis=0))]
        turn = np.arccos(np.clip(np.einsum("ij,ij->i", x, x[leader]), -1, 1))
        radius = np.zeros(n)
        np.maximum.at(radius, leader, turn)
        reach = np.cos(min(np.pi, np.arccos(least) + 2 * radius.max()))
        pairs, todo, wide = [np.stack([heads, heads], 1)], heads, min(width, len(heads))
        while len(todo) and len(heads) > 1:
            again = []
            if wide > width and wide * 16 > len(heads):  # what has grown so far goes through all there is
                for i in range(0, len(todo), 512):
                    q = todo[i : i + 512]
                    r, c = np.nonzero(np.arccos(np.clip(x[q] @ x[heads].T, -1, 1)) - radius[q][:, None] - radius[heads] <= np.arccos(least) + 1e-9)
                    pairs.append(np.stack([q[r], heads[c]], 1))
                break
            for i in range(0, len(todo), step := max(16, 65_536 // (wide + table.shape[1]))):
                q = todo[i : i + step]
                hit, val = beam(x, table, x[q], np.stack([q, np.where(q == medoid, -1, medoid)], 1), max(2, wide), reach - 0.25)
                far = np.arccos(np.clip(val, -1, 1)) - radius[q][:, None] - radius[hit] <= np.arccos(least) + 1e-9
                good = (hit >= 0) & far
                full = (good.sum(axis=1) * 2 >= wide) & (wide < len(heads))
                again.append(q[full])
                r, c = np.nonzero(good & ~full[:, None])
                pairs.append(np.stack([q[r], hit[r, c]], 1))
            todo, wide = np.concatenate(again), min(wide * 4, len(heads))
        p = np.concatenate(pairs)
        code = np.unique(p.min(axis=1) * n + p.max(axis=1))
        links, low = verified(x, mult, home, visits, own, leader, radius, np.stack([code // n, code % n], 1), least)
        return pa.table({"node": pa.array(ids), "links": pa.array(links), "low": pa.array(ids[low])})

    found = inside.join(built.select("shard", "node", "leader"), ["shard", "node"]).join(united, "node").groupBy("shard").applyInArrow(find, "node long, links long, low long")
    if over:
        laid = spark.sparkContext.broadcast(over)

        def deal(batches):
            for b in batches:
                cells = []
                for s, node in zip(b.column("shard").to_pylist(), b.column("node").to_pylist(), strict=True):
                    k = laid.value[s]
                    own = hash((node, 7)) % k
                    cells.append([(own, min(own, p), max(own, p)) for p in range(k)])
                count = [len(c) for c in cells]
                flat = np.array([c for x in cells for c in x], np.int64).reshape(-1, 3)
                big = pa.Table.from_batches([b]).take(pa.array(np.repeat(np.arange(b.num_rows), count)))
                for k, name in enumerate(("piece", "p", "q")):
                    big = big.append_column(name, pa.array(flat[:, k]))
                yield from big.to_batches(max_chunksize=4096)

        def meet(t: pa.Table) -> pa.Table:
            t = t.sort_by([("piece", "ascending"), ("node", "ascending")])
            x, ids, mult, home, visits = _arrays(t)
            piece = np.asarray(t["piece"].combine_chunks())
            sides = [np.flatnonzero(piece == p) for p in sorted({t["p"][0].as_py(), t["q"][0].as_py()})]
            links, low = compare(x, mult, home, visits, t["shard"][0].as_py(), sides, least)
            some = np.flatnonzero((links > 0) | (low != np.arange(len(low))))
            return pa.table({"node": pa.array(ids[some]), "links": pa.array(links[some]), "low": pa.array(ids[low[some]])})

        outside = member.where(F.col("shard").isin(list(over))).select("shard", "node", "n", "vec", "home", "shards")
        outside = outside.mapInArrow(deal, "shard long, node long, n long, vec binary, home long, shards array<long>, piece long, p long, q long")
        found = found.unionByName(outside.groupBy("shard", "p", "q").applyInArrow(meet, "node long, links long, low long"))
    found = cut(found)
    comp = components(found.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = cut(nodes.select("cls", "key", "node", "least", "n").join(links, "node", "left").join(comp, "node", "left").select("cls", "key", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(named, "component").select("cls", "key", "n_links", "component_id")
    out = rows.where("key is not null").select("vec_id", "cls", "key").join(known, ["cls", "key"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def audit_recall(vectors: DataFrame, result: DataFrame, least: float = 0.93, block: int = 4096) -> float:
    """Share of links, over queries with vec_id divisible by 50 against all vectors, that n_links has."""
    rows = prepared(vectors).where("key is not null")
    q = rows.where("vec_id % 50 = 0").select("vec_id", "cls", "vec").toPandas()  # a stated query set
    shared = vectors.sparkSession.sparkContext.broadcast((q["vec_id"].to_numpy(), q["cls"].to_numpy(), [np.frombuffer(v) for v in q["vec"]]))

    def count(batches):
        ids, cls, vec = shared.value
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            c = np.array(b.column("cls").to_pylist())
            for k in set(c.tolist()):
                x, qi = np.stack([np.frombuffer(v) for v in np.array(b.column("vec").to_pylist(), object)[c == k]]), np.flatnonzero(cls == k)
                for a in range(0, len(x), block):
                    if len(qi):
                        total[qi] += (np.stack([vec[i] for i in qi]) @ x[a : a + block].T >= least).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["vec_id", "n"])

    true = rows.select("cls", "vec").mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    s = true.join(result, "vec_id").agg(F.sum("n").alias("n"), F.sum(F.least("n", "n_links")).alias("got")).first()
    return 1.0 if not s["n"] else s["got"] / s["n"]
