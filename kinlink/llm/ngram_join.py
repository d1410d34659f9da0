"""Op 9: Jaccard self-join of documents on word shingles, exact.

Two sets link when 100 |A n B| >= percent |A u B|. For sizes a and b that
bounds their difference, |A xor B| <= (100 - p)(a + b) / (100 + p).

Universe partition. Sizes fall into bands; for a pair of neighbouring bands the
universe of token hashes is cut into m segments. Each set is indexed by the
hashes of its non-empty segments, and for the first d segments also by their
one-deletion neighbourhoods. A segment allocates 1, or 2 where neighbourhoods
are indexed (m and d per band by the cheapest expected index that suffices);
if what a set allocates exceeds the bound on its differences, every partner
shares an index entry with it (pigeonhole). What a set allocates beyond its
bound is its slack: partners share entries that allocate more than that.

Three passes over ever fewer sets:

1. All sets are indexed, packed 8 bytes an entry. A set whose shared entries
   allocate no more than its slack can have no partner and leaves; the others
   are *open*.
2. Open sets, equal ones as one node, are indexed again by node. An entry's cost
   is the number of its owners. Entries of up to `group` owners give pairs;
   costlier ones get allocation 0. Pairs whose shared allocation is within the
   slack of either go, as do those whose parity bitmaps differ in more bits than
   the sets may differ in tokens (a bound, so nothing is lost). The rest is
   verified: first one pair a set, then those of different components.
3. Sets that costly entries have left with less than their bound, the
   *deficient* ones, can only miss each other, and only through a shared costly
   entry. They are laid in blocks by their costliest entry and component; blocks
   that own a costly entry in common meet in a task, which reports a spanning
   forest of the links. No pairs are made; two blocks of one and the same
   component do not meet.

Hashes find and filter; whether a pair links is decided on the bytes of its
shingles. Equal sets are told by 128 bits of digest.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import textkit as tk
from kinlink.llm.shared import components, cut, text_bytes

U64 = np.uint64
SLICE = 1 << 20
CHUNK_DOCS = 1 << 14
PACKED = "bucket int, chunk long, doc_id long, d0 long, d1 long, n int, s0 int, s1 int, names binary, payload binary"
MET = "kind int, a long, b long, x long, y long"


class Shingles:
    """Shingle sets of some texts: sorted distinct hashes, and where each shingle first stands."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, shingle: int):
        self.low = tk.LOWER[buf]
        self.s, self.e, first = tk.words(self.low, off, tk.NOT_SPACE)
        h = tk.word_hash(self.low, self.s, self.e)
        g = tk.gram_hash(h, shingle)
        self.sets, self.at, self.width = [], [], np.minimum(np.diff(first), shingle)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = g[a : b - shingle + 1] if b - a >= shingle else tk.gram_hash(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)
            u, i = np.unique(own, return_index=True)
            self.sets.append(u)
            self.at.append(a + i)

    def exact(self, i: int) -> set[tuple[bytes, ...]]:
        w, k = int(self.width[i]), sorted(self.at[i].tolist())
        if not k:
            return set()
        words = [self.low[a:b].tobytes() for a, b in zip(self.s[k[0] : k[-1] + w].tolist(), self.e[k[0] : k[-1] + w].tolist(), strict=True)]
        return {tuple(words[j : j + w]) for j in range(len(words) - w + 1)}


def linked(x: Shingles, i: int, y: Shingles, j: int, percent: int) -> bool:
    """Whether two sets link: counted by hashes, then confirmed on the bytes of the shared shingles."""
    a, b = x.sets[i], y.sets[j]
    if not len(a) or not len(b):
        return False
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if 100 * len(ia) < percent * (len(a) + len(b) - len(ia)):
        return False
    w = int(x.width[i])
    if w == int(y.width[j]):
        wa = (x.at[i][ia][:, None] + np.arange(w)).ravel()
        wb = (y.at[j][ib][:, None] + np.arange(w)).ravel()
        size = x.e[wa] - x.s[wa]
        if (size == y.e[wb] - y.s[wb]).all() and (x.low[tk.ranges(x.s[wa], size)] == y.low[tk.ranges(y.s[wb], size)]).all():
            return True
    u, v = x.exact(i), y.exact(j)  # two shingles of one hash: decide without hashes
    return 100 * len(u & v) >= percent * len(u | v)


def digest_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit integers."""
    if not len(s):
        return 0, 0
    size = U64(len(s) * 0x9E3779B1)
    x = np.array([tk.mix(s + U64(0x1234567)).sum(dtype=np.uint64) + size, tk.mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) - size], np.uint64)
    a, b = tk.mix(x).view(np.int64).tolist()
    return a, b


def parity(s: np.ndarray) -> bytes:
    """A bit for each value that an odd number of tokens hash to; two sets differ in as many tokens at least as their bitmaps in bits."""
    bits = 1 << min(15, max(9, int(2 * len(s) - 1).bit_length()))
    at = (tk.mix(s + U64(0x77)) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(x, size: int) -> np.ndarray:
    """A bitmap of parities brought to fewer 64-bit words."""
    v = np.frombuffer(x, np.uint64)
    while len(v) > size:
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return v


class Bands:
    """Size bands and their segmentation for one threshold."""

    def __init__(self, percent: int):
        self.p = percent
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * 100 / percent) + (edges[-1] * 100 % percent == 0)))
        # sizes e[i] .. e[i+1]-1 are band i; a partner's band differs by one at most
        self.edges = np.array(edges)
        self.plan = lru_cache(maxsize=None)(self._plan)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1

    def bound(self, a, b):
        return (100 - self.p) * (a + b) // (100 + self.p)

    def need(self, n: np.ndarray, lower: bool) -> np.ndarray:
        """Allocation a set needs in an instance: as one of the lower band, or of the upper one."""
        band = self.band(n)
        largest = np.minimum(n * 100 // self.p, self.edges[band + 2] - 1) if lower else self.edges[band] - 1
        return self.bound(n, largest) + 1

    def _plan(self, i: int) -> tuple[int, int]:
        """(m, d) of instance i, for sizes of bands i and i+1."""
        lo, mid, hi = (int(self.edges[i + x]) for x in range(3))
        probes = [(lo, True), (mid - 1, True), (mid, False), (hi - 1, False)]
        need = [(a, int(self.need(np.array([a]), low)[0])) for a, low in probes]
        most = max(x for _, x in need)
        best = None
        for m in sorted({max(1, round(most * f)) for f in (0.5, 0.55, 0.6, 0.7, 0.8, 0.9, 1.0, 1.05, 1.1, 1.15, 1.2, 1.25, 1.3, 1.4, 1.5)} | {1, 2, 3}):
            for d in sorted({0, m // 8, m // 4, m // 2, 3 * m // 4, m}):
                worst, cost = math.inf, 0.0
                for a, x in need:
                    t = a / m
                    full, two = 1 - math.exp(-t), 1 - (1 + t) * math.exp(-t)
                    sure = m * full + d * two - 3 * math.sqrt(m * full * (1 - full) + d * two * (1 - two)) - 0.02 * m
                    worst = min(worst, sure - x)
                    cost += m * full + a * d / m
                rank = (worst < 0, cost if worst >= 0 else -worst, m)
                if best is None or rank < best[0]:
                    best = (rank, m, d)
        return best[1], best[2]


def entries(flat: np.ndarray, off: np.ndarray, bands: Bands):
    """Index entries of sets (flat, sorted within off): 64-bit signature, set, flags (role, segment's allocation - 1); and both slacks of the sets."""
    n = np.diff(off)
    own = bands.band(np.maximum(n, 1))
    mixed = tk.mix(flat + U64(0xABCDEF))
    sig_all, set_all, flag_all, slack = [], [], [], []
    high = flat >> U64(32)
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    for role in (0, 1):  # 0: as one of the lower band of instance own; 1: of the upper band of instance own - 1
        inst = own - role
        real = (n > 0) & (inst >= 0)
        plans = {int(i): bands.plan(int(i)) for i in np.unique(inst[real])}
        m = np.array([plans[int(i)][0] if ok else 1 for i, ok in zip(inst, real, strict=True)], np.int64)
        d = np.array([plans[int(i)][1] if ok else 0 for i, ok in zip(inst, real, strict=True)], np.int64)
        keep = real[doc]
        dd, x = doc[keep], mixed[keep]
        seg = ((high[keep] * m.astype(np.uint64)[dd]) >> U64(32)).astype(np.int32)
        if not len(dd):
            slack.append(np.where(real, 0, 1 << 30))
            continue
        i = np.flatnonzero(np.append(True, (dd[1:] != dd[:-1]) | (seg[1:] != seg[:-1])))
        size = np.diff(np.append(i, len(dd)))
        total = np.add.reduceat(x, i)
        seg, dd = seg[i], dd[i]
        salt = tk.mix(seg.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + inst[dd].astype(np.uint64))
        two = (seg < d[dd]) & (size >= 2)
        sig_all.append(tk.mix(total + salt))
        set_all.append(dd)
        flag_all.append(two.astype(np.int8) + np.int8(role * 2))
        some = np.flatnonzero(two)
        if len(some):
            of = np.repeat(some.astype(np.int32), size[some])
            less = (total + salt)[of]
            less -= x[tk.ranges(i[some], size[some])]
            sig_all.append(tk.mix(less))
            set_all.append(dd[of])
            flag_all.append(np.full(len(of), role * 2 + 1, np.int8))
        have = np.bincount(dd, 1 + two, len(n)).astype(np.int64)
        need = bands.need(np.maximum(n, 1), role == 0)
        # no set may be missed where the instance has no other sizes to meet
        slack.append(np.where(real, have - need, 1 << 30))
    cat = lambda v, t: np.concatenate(v) if v else np.zeros(0, t)
    return cat(sig_all, np.uint64), cat(set_all, np.int32), cat(flag_all, np.int8), slack


def _packed(sets: list[np.ndarray], bands: Bands, n_buckets: int, names: np.ndarray | None = None):
    """Both slacks of a chunk's sets, and for each bucket the names of its sets (where given) and its entries: 48 bits of signature, 14 of set, 2 of flags."""
    off = np.append(0, np.cumsum([len(s) for s in sets]))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    sig, of, flag, slack = entries(flat, off, bands)
    del flat
    bucket = (((sig >> U64(48)) * U64(n_buckets)) >> U64(16)).astype(np.int32)
    o = np.argsort(bucket, kind="stable")
    cuts = np.append(0, np.cumsum(np.bincount(bucket, minlength=n_buckets)))
    sig, of, flag = sig[o], of[o], flag[o]
    del bucket, o
    out = []
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[k], cuts[k + 1])
        local, own = of[part], None
        if names is not None:
            used, local = np.unique(local, return_inverse=True)
            own = names[used.astype(np.int64)].tobytes()
        out.append((k, own, ((sig[part] << U64(16)) | (local.astype(np.uint64) << U64(2)) | flag[part].astype(np.uint64)).tobytes()))
    return slack, out


def _unpacked(t: pa.Table):
    """Signatures that two sets or more own, by signature and set: signature, set, role, allocation."""
    sig, name, flag = [], [], []
    for chunk, own, p in zip(t["chunk"].to_pylist(), t["names"].to_pylist(), t["payload"].to_pylist(), strict=True):
        e = np.frombuffer(p, np.uint64)
        local = ((e >> U64(2)) & U64(CHUNK_DOCS - 1)).astype(np.int64)
        sig.append(e >> U64(16))
        name.append(np.frombuffer(own, np.int64)[local] if own is not None else (chunk << 14) + local)
        flag.append((e & U64(3)).astype(np.int8))
    sig, name, flag = map(np.concatenate, (sig, name, flag))
    o = np.argsort(sig, kind="stable")
    s = sig[o]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    o = o[same]
    del s, same
    sig, name, flag = sig[o], name[o], flag[o]
    o = np.lexsort((name, sig))
    sig, name, flag = sig[o], name[o], flag[o]
    new = np.ones(len(o), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])
    sig, name, flag = sig[new], name[new], flag[new]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    return sig, name, flag >> 1, (flag & 1).astype(np.int64) + 1, first, np.diff(np.append(first, len(sig)))


def _met(kind: int, a, b, x=None, y=None) -> pa.Table:
    z = np.zeros(len(a), np.int64)
    return pa.table({"kind": pa.array(np.full(len(a), kind), pa.int32()), **{k: pa.array(z if v is None else np.asarray(v).astype(np.int64)) for k, v in (("a", a), ("b", b), ("x", x), ("y", y))}})


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, percent: int = 75, chunk_bytes: int = 6 << 20, group: int = 16, block: int = 512, filter_bits: int = 23) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    A set holds the distinct runs of `shingle` words (A-Z lower-cased,
    `[^\\x20\\x09-\\x0D]+`); a text with fewer words is one run; null and empty
    texts and texts without words have the empty set and link with nothing.
    component_id is the smallest doc_id reachable; rows with null doc_id can
    connect others and get their component's smallest id. Repeated rows are
    linked rows. group: sets that may own an index entry before it counts as
    costly; block: deficient sets of a block, two of which meet in a task;
    filter_bits: size of the broadcast row filter (2**bits bits).
    """
    assert 50 <= percent <= 100
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_buckets = max(1, -(-text_bytes(docs) // chunk_bytes))
    columns = [x.split()[0] for x in PACKED.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in PACKED.split(", ")]

    def batch(rows: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(rows, t) for c, t in zip(columns, kinds, strict=True)], columns)

    # 1: which sets share enough entries to have a partner at all
    @tk.frugal
    def index(batches):
        bands, part, count = Bands(percent), TaskContext.get().partitionId(), 0

        def emit(ids, sets):
            chunk = (part << 24) + count
            slack, out = _packed(sets, bands, n_buckets)
            d = [digest_of(s) for s in sets]
            at = range(chunk << 14, (chunk << 14) + len(sets))
            yield batch(len(sets), bucket=[x[0] % n_buckets for x in d], chunk=list(at), doc_id=ids, d0=[x[0] for x in d], d1=[x[1] for x in d], n=[len(s) for s in sets], s0=slack[0], s1=slack[1])
            yield batch(len(out), bucket=[x[0] for x in out], chunk=[chunk] * len(out), payload=[x[2] for x in out])

        ids, sets, size = [], [], 0
        for b in batches:
            buf, off = tk.buffer_of(b.column("text"))
            own = b.column("doc_id").to_pylist()
            for a, z in tk.slices(off, SLICE):
                for i in range(a, z, CHUNK_DOCS):
                    j = min(z, i + CHUNK_DOCS)
                    if ids and (size + off[j] - off[i] > chunk_bytes or len(ids) + j - i > CHUNK_DOCS):
                        yield from emit(ids, sets)
                        ids, sets, size, count = [], [], 0, count + 1
                    ids += own[i:j]
                    sets += Shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], shingle).sets
                    size += int(off[j] - off[i])
        if ids:
            yield from emit(ids, sets)

    about = ("doc_id", "d0", "d1", "n", "s0", "s1")

    @tk.frugal
    def share(t: pa.Table) -> pa.Table:
        """Documents as they are, and what their shared entries allocate here: one packed row for each partition that the documents came from."""
        is_doc = pc.is_null(t["payload"])
        d, p = t.filter(is_doc), t.filter(pc.invert(is_doc))
        out = [pa.table({"part": pc.cast(pc.shift_right(d["chunk"], 38), pa.int32()), "ref": d["chunk"], **{c: d[c] for c in about}, "shared": pa.nulls(d.num_rows, pa.binary())})]
        if p.num_rows:
            _, name, role, weight, _, _ = _unpacked(p)
            refs, at = np.unique(name, return_inverse=True)
            w = np.stack([refs, *(np.bincount(at, weight * (role == r), len(refs)).astype(np.int64) for r in (0, 1))], 1)
            parts, first = np.unique(refs >> 38, return_index=True)
            shared = [x.tobytes() for x in np.split(w, first[1:])] if len(parts) else []
            out.append(pa.table({"part": pa.array(parts, pa.int32()), **{c: pa.nulls(len(parts), out[0].schema.field(c).type) for c in ("ref", *about)}, "shared": pa.array(shared, pa.binary())}))
        return pa.concat_tables(out)

    @tk.frugal
    def total(t: pa.Table) -> pa.Table:
        is_doc = pc.is_null(t["shared"])
        d, p = t.filter(is_doc).sort_by("ref"), t.filter(pc.invert(is_doc))
        ref, n, s0, s1 = (np.asarray(d[c].combine_chunks()) for c in ("ref", "n", "s0", "s1"))
        w0, w1 = np.zeros(len(ref), np.int64), np.zeros(len(ref), np.int64)
        for x in p["shared"].to_pylist():
            w = np.frombuffer(x, np.int64).reshape(-1, 3)
            at = np.searchsorted(ref, w[:, 0])
            w0[at] += w[:, 1]
            w1[at] += w[:, 2]
        return pa.table({"ref": d["ref"], **{c: d[c] for c in about}, "open": pa.array((n > 0) & ((w0 > s0) | (w1 > s1)))})

    met = docs.mapInArrow(index, PACKED).groupBy("bucket").applyInArrow(share, "part int, ref long, doc_id long, d0 long, d1 long, n int, s0 int, s1 int, shared binary")
    rows = cut(met.groupBy("part").applyInArrow(total, "ref long, doc_id long, d0 long, d1 long, n int, s0 int, s1 int, open boolean"))
    nodes = cut(rows.where("open").groupBy("d0", "d1").agg(F.min("ref").alias("node"), F.min("doc_id").alias("doc_id"), *[F.min(c).alias(c) for c in ("n", "s0", "s1")]))
    texts = cut(_texts(spark, docs, nodes, shingle, filter_bits))

    # 2: entries of open sets, by node
    @tk.frugal
    def again(batches):
        bands = Bands(percent)

        def emit(ids, sets):
            yield from (batch(1, bucket=[k], names=[own], payload=[p]) for k, own, p in _packed(sets, bands, n_buckets, np.array(ids, np.int64))[1])

        ids, sets, size = [], [], 0
        for b in batches:
            buf, off = tk.buffer_of(b.column("text"))
            own = b.column("node").to_pylist()
            for a, z in tk.slices(off, SLICE):
                for i in range(a, z, CHUNK_DOCS):
                    j = min(z, i + CHUNK_DOCS)
                    if ids and (size + off[j] - off[i] > chunk_bytes or len(ids) + j - i > CHUNK_DOCS):
                        yield from emit(ids, sets)
                        ids, sets, size = [], [], 0
                    ids += own[i:j]
                    sets += Shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], shingle).sets
                    size += int(off[j] - off[i])
        if ids:
            yield from emit(ids, sets)

    @tk.frugal
    def meet(t: pa.Table) -> pa.Table:
        sig, node, role, weight, first, count = _unpacked(t)
        out = [_met(0, [], [])]
        pairs, shared = [], []
        for gap in range(1, group):
            g = np.flatnonzero((count <= group) & (count > gap))
            if not len(g):
                break
            at = tk.ranges(first[g], count[g] - gap)
            pairs.append(np.stack([node[at], node[at + gap]], 1))  # nodes ascend within an entry
            shared.append(np.maximum(weight[at], weight[at + gap]))
        if pairs:
            both, at = np.unique(np.concatenate(pairs), axis=0, return_inverse=True)
            out.append(_met(1, both[:, 0], both[:, 1], np.bincount(at.ravel(), np.concatenate(shared), len(both))))
        big = np.flatnonzero(count > group)
        if len(big):
            at = tk.ranges(first[big], count[big])
            names, inv = np.unique(node[at], return_inverse=True)
            out.append(_met(2, names, names, *(np.bincount(inv, weight[at] * (role[at] == r), len(names)) for r in (0, 1))))
            out.append(_met(3, node[at], sig[at].view(np.int64), np.repeat(node[first[big]], count[big])))
        return pa.concat_tables(out)

    @tk.frugal
    def bitmaps(batches):
        for b in batches:
            buf, off = tk.buffer_of(b.column("text"))
            for a, z in tk.slices(off, SLICE):
                sets = Shingles(buf[off[a] : off[z]], off[a : z + 1] - off[a], shingle).sets
                yield pa.RecordBatch.from_arrays([b.column("node").slice(a, z - a), pa.array([parity(s) for s in sets], pa.binary())], ["node", "bits"])

    met = cut(texts.select("node", "text").mapInArrow(again, PACKED).groupBy("bucket").applyInArrow(meet, MET))
    lost = met.where("kind = 2").groupBy(F.col("a").alias("node")).agg(F.sum("x").alias("l0"), F.sum("y").alias("l1"))
    # what is left of the slacks, as one of the lower and of the upper band; below 0: deficient
    info = nodes.join(lost, "node", "left").select("node", "n", "s0", "s1", (F.col("s0") - F.coalesce("l0", F.lit(0))).alias("e0"), (F.col("s1") - F.coalesce("l1", F.lit(0))).alias("e1"))
    info = cut(info.join(texts.select("node", "text").mapInArrow(bitmaps, "node long, bits binary"), "node"))
    deficient = info.where("e0 < 0 or e1 < 0")

    of = lambda x: info.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("e0").alias(f"e0{x}"), F.least("e0", "e1").alias(f"e{x}"), F.col("bits").alias(f"bits{x}"))
    pairs = met.where("kind = 1").groupBy("a", "b").agg(F.sum("x").alias("shared")).join(of("a"), "a").join(of("b"), "b")
    smaller, larger = F.when(F.col("na") <= F.col("nb"), F.col("e0a")).otherwise(F.col("e0b")), F.when(F.col("na") <= F.col("nb"), F.col("eb")).otherwise(F.col("ea"))
    pairs = pairs.where((F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb")) & (F.col("shared") > F.greatest(smaller, larger)))

    @tk.frugal
    def close(batches):
        for b in batches:
            most = (100 - percent) * (np.asarray(b.column("na")).astype(np.int64) + np.asarray(b.column("nb"))) // (100 + percent)
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("bitsa").to_pylist(), b.column("bitsb").to_pylist(), strict=True)):
                size = min(len(x), len(y)) // 8
                ok[i] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum() <= most[i]
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    pairs = cut(pairs.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(close, "a long, b long"))

    @tk.frugal
    def verify(batches):
        for b in batches:
            x, y = tk.buffer_of(b.column("x")), tk.buffer_of(b.column("y"))
            for i, j in tk.slices(x[1] + y[1], SLICE):
                s, t = (Shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], shingle) for buf, off in (x, y))
                ok = pa.array([linked(s, k, t, k, percent) for k in range(j - i)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(c).slice(i, j - i).filter(ok) for c in ("a", "b")], ["a", "b"])

    text = texts.select("node", "text")

    def links(p: DataFrame) -> DataFrame:
        p = p.join(text.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(text.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        return p.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")

    # one pair a set and, of deficient sets, one hub first: most others then lie within a component
    hubs = met.where("kind = 3 and a <> x").join(deficient.select(F.col("node").alias("a")), "a", "left_semi").groupBy(F.col("a").alias("b")).agg(F.min("x").alias("a"))
    edges = cut(links(pairs.groupBy("b").agg(F.min("a").alias("a")).unionByName(hubs).distinct()))
    comp = components(edges)
    ca, cb = (comp.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    apart = pairs.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    more = cut(links(apart))

    # 3: deficient sets among themselves
    rest = _blocks(met, deficient.select("node", "n", "s0", "s1"), comp, text, shingle, percent, block)
    comp = components(edges.unionByName(more).unionByName(rest))

    ids = nodes.join(comp, "node", "left").select("d0", "d1", "doc_id", F.coalesce("component", "node").alias("c"))
    least = ids.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    known = ids.join(least, "c").select("d0", "d1", "component_id")
    out = rows.where("open").join(known, ["d0", "d1"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = rows.where("not open").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def _blocks(met: DataFrame, deficient: DataFrame, comp: DataFrame, text: DataFrame, shingle: int, percent: int, most: int) -> DataFrame:
    """Links (a, b) that join deficient sets of different components, as far as they share a costly entry."""
    deficient = cut(deficient.join(comp, "node", "left").select("node", "n", "s0", "s1", F.coalesce("component", "node").alias("label")))
    bands = Bands(percent)
    edges = [int(x) for x in bands.edges if x < 1 << 31]
    band = F.expr(f"array_size(filter(array({', '.join(map(str, edges))}), e -> e <= n)) - 1")
    costly = met.where("kind = 3").select(F.col("a").alias("node"), F.col("b").alias("sig")).join(deficient.select("node"), "node", "left_semi")
    # sets whose own entries fall short of the bound can miss any deficient set of a near size: an entry for each of the bands
    short = deficient.where("s0 < 0 or s1 < 0").select("node", band.alias("band"))
    odd = [r["band"] for r in short.select("band").distinct().collect()]  # at most one a band
    if odd:
        near = sorted({b + x for b in odd for x in (-1, 0, 1)})
        costly = costly.unionByName(short.select("node", F.explode(F.expr("transform(array(band - 1, band, band + 1), x -> cast(x as long))")).alias("sig")))
        costly = costly.unionByName(deficient.withColumn("band", band).where(F.col("band").isin(near)).select("node", F.col("band").cast("long").alias("sig"))).distinct()
    costly = cut(costly)
    owners = costly.groupBy("sig").agg(F.count("*").alias("owners"))
    key = costly.join(owners, "sig").groupBy("node").agg(F.max_by("sig", F.struct("owners", "sig")).alias("key"))
    base = deficient.select("node", "label").join(key, "node")
    sizes = base.groupBy("key", "label").agg(F.count("*").alias("c"))
    small = sizes.where(F.col("c") < most).groupBy("key").agg(F.sum("c").alias("few"))
    base = base.join(sizes, ["key", "label"]).join(small, "key", "left")
    place = F.when(F.col("c") >= most, F.xxhash64("key", "label", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / most)))).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("label"), F.ceil(F.col("few") / most))))
    blocks = cut(base.select("node", "label", place.alias("block")))
    own = blocks.groupBy("block").agg(F.min("label").alias("l0"), F.max("label").alias("l1"))
    sets = costly.join(blocks.select("node", "block"), "node").groupBy("sig").agg(F.sort_array(F.collect_set("block")).alias("bs")).select("bs").distinct()
    cells = sets.select(F.explode(F.expr("flatten(transform(bs, (p, i) -> transform(slice(bs, i + 1, size(bs)), q -> struct(p, q))))")).alias("c")).select("c.p", "c.q").distinct()
    cells = cells.join(own.withColumnRenamed("block", "p"), "p").join(own.select(F.col("block").alias("q"), F.col("l0").alias("m0"), F.col("l1").alias("m1")), "q").where("least(l0, m0) <> greatest(l1, m1)").select("p", "q")
    sides = cells.select("p", "q", F.explode(F.expr("if(p = q, array(p), array(p, q))")).alias("block"))

    @tk.frugal
    def compare(t: pa.Table) -> pa.Table:
        node, label = t["node"].to_pylist(), t["label"].to_pylist()
        side = (np.asarray(t["block"].combine_chunks()) == t["p"][0].as_py()).astype(np.int8)
        s = Shingles(*tk.buffer_of(t["text"]), shingle)
        n = np.array([len(x) for x in s.sets])
        up = {}

        def root(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        wide = [np.frombuffer(parity(x), np.uint64) for x in s.sets]
        a, b = [], []
        lone = len(set(side.tolist())) == 1
        order = np.argsort(n, kind="stable")
        one = order if lone else order[side[order] == 1]
        other = order if lone else order[side[order] == 0]
        table: dict[int, np.ndarray] = {}
        for k, i in enumerate(one.tolist()):
            lo, hi = -(-percent * int(n[i]) // 100), int(n[i]) * 100 // percent
            x, y = np.searchsorted(n[other], [lo, hi + 1])
            x = max(x, k + 1) if lone else x
            if x >= y or not n[i]:
                continue
            size = len(wide[other[x]])  # the smallest bitmap among them
            size = min(size, len(wide[i]))
            if size not in table:
                table = {size: np.stack([folded(wide[j], size) if len(wide[j]) >= size else np.zeros(size, np.uint64) for j in other.tolist()])}
            far = np.bitwise_count(table[size][x:y] ^ folded(wide[i], size)).sum(axis=1)
            for j in other[x:y][far <= (100 - percent) * (n[i] + n[other[x:y]]) // (100 + percent)].tolist():
                u, v = root(label[i]), root(label[j])
                if u != v and linked(s, i, s, j, percent):
                    up[max(u, v)] = min(u, v)
                    a.append(node[i])
                    b.append(node[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = sides.join(blocks, "block").join(text, "node").select("p", "q", "block", "node", "label", "text")
    return cut(met.groupBy("p", "q").applyInArrow(compare, "a long, b long"))


def _texts(spark, docs: DataFrame, nodes: DataFrame, shingle: int, bits: int) -> DataFrame:
    """node, text of the nodes, read from one document each.

    A bitmap of 2**bits bits of the wanted ids, built by aggregation, lets the
    scan pass over most other documents before they are shingled; it is of
    fixed size, and the join by digest that follows is what decides.
    """
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    maps = nodes.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m")).collect()  # 2**bits bits at most
    table = np.zeros((1 << bits) + 1 + 8 * 4096, bool)
    for r in maps:
        got = np.unpackbits(np.frombuffer(r["m"], np.uint8), bitorder="little")
        start = (r["k"] - 1) * len(got) + 1 if r["k"] > 0 else 0
        end = min(len(table), start + len(got))
        table[start:end] |= got[: end - start].astype(bool)
    shared = spark.sparkContext.broadcast(np.packbits(table))

    @tk.frugal
    def read(batches):
        on = shared.value
        for b in batches:
            at = np.asarray(b.column("at"))
            b = b.filter(pa.array((on[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            buf, off = tk.buffer_of(b.column("text"))
            for a, z in tk.slices(off, SLICE):
                d = [digest_of(s) for s in Shingles(buf[off[a] : off[z]], off[a : z + 1] - off[a], shingle).sets]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), b.column("text").slice(a, z - a)], ["d0", "d1", "text"])

    got = docs.select(at.alias("at"), "text").mapInArrow(read, "d0 long, d1 long, text string")
    return got.join(nodes.select("d0", "d1", "node"), ["d0", "d1"]).groupBy("node").agg(F.min("text").alias("text"))
