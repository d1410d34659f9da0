"""Op 1: removal of repeated byte strings by two-stage suffix sorting.

Every occurrence of an `span`-byte string in a document is removed when the
string also starts in a document with a smaller doc_id.

Plan, for texts of any total size:

1. *Anchors.* A string of `span` bytes is assigned to the smallest hashed
   k-gram in it (leftmost at ties), which depends on the string alone. Each
   chunk of documents sends its distinct anchor hashes, packed by hash
   bucket; the bucket answers with two bits an anchor: shared with another
   chunk or not, and held by very many chunks or not.
2. *Suffix sorting.* For shared anchors the chunk sends the distinct bytes
   around them (an anchor with very many owners is sent string by string, so
   that no bucket grows with its number of owners). Each bucket sorts the
   suffixes of what it got in two stages - those smaller than their
   successors directly, the others induced by scanning the buckets of first
   bytes - and cuts the order where the common prefix of neighbours is shorter
   than `span`. The smallest doc_id of each run decides.
3. *Removal.* Spans return to their chunk and are cut from the text.

Copies of whole texts are found first by digest and take no part in 1 and 2.
Nulls: a null text is empty; a null doc_id counts as larger than any other.
Rows with equal doc_id never remove from each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import textkit as tk
from kinlink.llm.shared import text_bytes

U64 = np.uint64
NO_ID = np.iinfo(np.int64).max
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
NOTE = "to int, kind int, ref long, payload binary"


def two_stage_order(text: np.ndarray, need: np.ndarray, depth: int) -> np.ndarray:
    """Positions with `need`, ordered by the suffixes that start there, compared over `depth` bytes at least.

    A position whose suffix is larger than its successor's is never compared:
    it follows from the order of its successor.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # S: suffix smaller than its successor; equal neighbours take the type of the run's end; the end counts as largest
    small = np.ones(n, bool)
    small[:-1] = text[:-1] < text[1:]
    change = np.flatnonzero(np.append(text[:-1] != text[1:], True))
    run = np.diff(np.append(-1, change))
    small = np.repeat(small[change], run)
    del change, run
    need = need.copy()
    # successors of larger suffixes are needed too, up to the first smaller one
    idx = np.flatnonzero(need & ~small)
    while len(idx):
        idx = idx[idx + 1 < n] + 1
        idx = idx[~need[idx]]
        need[idx] = True
        idx = idx[~small[idx]]
    direct = np.flatnonzero(need & small)
    pad = np.full(n + depth + 8, 0xFF, np.uint8)
    pad[:n] = text
    words = np.lib.stride_tricks.sliding_window_view(pad, 8)
    by_byte = direct[np.argsort(text[direct], kind="stable")]
    starts = np.searchsorted(text[by_byte], np.arange(256), "left").tolist() + [len(by_byte)]

    def directly(byte: int) -> np.ndarray:
        """The smaller suffixes of one bucket, compared eight bytes at a time."""
        at = by_byte[starts[byte] : starts[byte + 1]]
        if len(at) < 2:
            return at
        keys = [np.ascontiguousarray(words[at + 8 * i]).view(">u8").ravel().astype(np.uint64) for i in range((depth + 7) // 8)]
        return at[np.lexsort(keys[::-1])]

    # buckets of the first byte: induced suffixes, then the directly sorted ones
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger = need & ~small

    def induce(done: np.ndarray, byte: int) -> np.ndarray:
        """Hands the predecessors of `done` to their buckets; returns those that stay in this one."""
        prev = done[done > 0] - 1
        prev = prev[larger[prev]]
        if not len(prev):
            return prev
        c = text[prev]
        by = np.argsort(c, kind="stable")
        prev, c = prev[by], c[by]
        cuts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        own = prev[:0]
        for a, b in zip(cuts, np.append(cuts[1:], len(c)), strict=True):
            if c[a] == byte:
                own = prev[a:b]
            else:
                induced[c[a]].append(prev[a:b])
        return own

    out = []
    for byte in range(256):
        head = np.concatenate(induced[byte]) if induced[byte] else None
        while head is not None and len(head):
            out.append(head)
            head = induce(head, byte)
        own = directly(byte)
        if len(own):
            out.append(own)
            induce(own, byte)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefix_at_least(text: np.ndarray, order: np.ndarray, span: int) -> np.ndarray:
    """For neighbours in `order`: whether their common prefix has `span` bytes."""
    pad = np.zeros(len(text) + span + 8, np.uint8)
    pad[: len(text)] = text
    w = np.lib.stride_tricks.sliding_window_view(pad, 8)
    same = np.ones(max(0, len(order) - 1), bool)
    for at in [*range(0, span - 7, 8), span - 8]:
        live = np.flatnonzero(same)
        a, b = order[live] + at, order[live + 1] + at
        same[live] = (np.ascontiguousarray(w[a]).view(np.uint64) == np.ascontiguousarray(w[b]).view(np.uint64)).ravel()
    return same


class _Chunk:
    """Anchors of one chunk of documents, slice by slice, always in one order."""

    def __init__(self, docs: pa.Table, notes: pa.Table, span: int, k: int, slice_bytes: int):
        ids = docs["doc_id"].combine_chunks()
        ids = np.asarray(ids.fill_null(NO_ID), np.int64) if len(ids) else np.zeros(0, np.int64)
        self.null_id = {i for i, x in enumerate(docs["doc_id"].to_pylist()) if x is None} if docs["doc_id"].null_count else set()
        buf, off = tk.buffer_of(docs["text"])
        order = np.argsort(ids, kind="stable")
        tied = np.flatnonzero(ids[order][1:] == ids[order][:-1])
        if len(tied):  # rows of one doc_id: by text, so that every pass numbers them alike
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], bytes(buf[off[i] : off[i + 1]]))), np.int64)
        self.ids, self.order, self.buf, self.off = ids, order, buf, off
        self.span, self.k, self.slice_bytes = span, k, slice_bytes
        self.copy = np.zeros(len(ids), bool)  # by place in order
        kinds = np.asarray(notes["kind"].combine_chunks()) if notes.num_rows else np.zeros(0, np.int32)
        listed = notes.filter(pa.array(kinds == 0))
        if listed.num_rows:
            want: dict[int, set] = {}
            for i, p in zip(listed["ref"].to_pylist(), listed["payload"].to_pylist(), strict=True):
                want.setdefault(NO_ID if i is None else i, set()).add(p)
            for at, i in enumerate(order):
                if (w := want.get(int(ids[i]))) and hashlib.md5(self.text(at)).digest() in w:
                    self.copy[at] = True
        self.notes = notes.filter(pa.array(kinds != 0))

    def text(self, at: int) -> bytes:
        i = self.order[at]
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()

    def parts(self):
        """Slices: bytes, and of every anchor its hash, document (place in order), first string start, number of strings, start in the document."""
        live = [int(x) for x in np.flatnonzero(~self.copy) if self.off[self.order[x] + 1] - self.off[self.order[x]] >= self.span]
        a = 0
        while a < len(live):
            b, size = a, 0
            while b < len(live) and (b == a or size + (n := int(self.off[self.order[live[b]] + 1] - self.off[self.order[live[b]]])) <= self.slice_bytes):
                size += int(self.off[self.order[live[b]] + 1] - self.off[self.order[live[b]]])
                b += 1
            at = np.array(live[a:b])
            rows = self.order[at]
            buf = np.concatenate([self.buf[self.off[r] : self.off[r + 1]] for r in rows])
            off = np.append(0, np.cumsum(self.off[rows + 1] - self.off[rows]))
            yield (buf, *self.anchors(buf, off, at))
            a = b

    def anchors(self, buf: np.ndarray, off: np.ndarray, at: np.ndarray):
        n, k, span = len(buf), self.k, self.span
        m = n - k + 1
        c = tk.prefix_hash(buf)
        _, inv = tk.powers(n + 1)
        h = tk.mix((c[k:] - c[:m]) * inv[:m])
        key = (h & U64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        w = span - k + 1  # k-grams in a string
        low, width = key, 1
        while width * 2 <= w:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < w:
            low = np.minimum(low[: len(low) - (w - width)], low[w - width :])
        # runs of strings with one anchor, cut where a document begins and where its last string has begun
        new = np.empty(len(low), bool)
        new[0] = True
        np.not_equal(low[1:], low[:-1], out=new[1:])
        new[off[:-1]] = True
        new[off[1:-1] - span + 1] = True
        i = np.flatnonzero(new)
        count = np.diff(np.append(i, len(low)))
        doc = np.searchsorted(off, i, "right") - 1
        own = np.flatnonzero(i <= off[doc + 1] - span)  # the others begin in one document and end in the next
        first, doc = i[own], doc[own]
        return h[(low[first] & U64(0xFFFFFFFF)).astype(np.int64)], at[doc], first, count[own], first - off[doc]


def _six(h: np.ndarray) -> bytes:
    """The low 48 bits of hashes; that two strings agree in them only makes an anchor a candidate."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _of_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _squeeze(*parts: np.ndarray) -> bytes:
    raw = b"".join(x.tobytes() for x in parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(b: bytes) -> bytes:
    return pa.decompress(memoryview(b)[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def _pack(groups: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(groups, np.arange(n + 1))


def remove_repeats(docs: DataFrame, span: int = 50, k: int = 32, chunk_bytes: int = 3 << 20, slice_bytes: int = 1 << 19, hot_chunks: int = 64) -> DataFrame:
    """Removes repeated strings of `span` bytes from docs (doc_id, text).

    chunk_bytes: text handled together in one Python call; hot_chunks: an
    anchor in more chunks than that is sent string by string. Returns doc_id,
    n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte
    offsets). An empty table gives an empty result.
    """
    assert 8 <= k < span
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = text_bytes(docs)
    n_chunks = max(1, -(-total // chunk_bytes))
    n_buckets = n_chunks
    shift = 64 - 32  # buckets come from the hash's low half; the high half orders the anchors
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID))), F.lit(n_chunks)).cast("int"))

    def chunk_of(d, x):
        return _Chunk(d, x, span, k, slice_bytes)

    def bucket_of(h: np.ndarray) -> np.ndarray:
        return (((h & U64(0xFFFFFFFF)) * U64(n_buckets)) >> U64(shift)).astype(np.int64)

    def distinct_anchors(ch: _Chunk, held: list | None = None):
        """Sorted by bucket, then hash; whether two documents of the chunk hold it; where buckets begin. held: gets the slices, but for the hashes; then also the number of every anchor among the distinct."""
        hs, ds = [], []
        for buf, h, doc, *rest in ch.parts():
            hs.append(h)
            ds.append(doc.astype(np.int32))
            if held is not None:
                first, count, start = rest
                held.append((buf, ds[-1], first.astype(np.int32), count.astype(np.uint16), start.astype(np.int32)))
        if not hs:
            z = np.zeros(0, np.uint64)
            return z, np.zeros(0, bool), np.zeros(n_buckets + 1, np.int64), np.zeros(0, np.int32)
        h, d = np.concatenate(hs), np.concatenate(ds)
        del hs, ds
        key = (h << U64(32)) | (h >> U64(32))  # low half first: sorted by bucket too
        o = np.argsort(key)
        key, d = key[o], d[o]
        new = np.append(True, key[1:] != key[:-1])
        i = np.flatnonzero(new)
        multi = np.minimum.reduceat(d, i) != np.maximum.reduceat(d, i)
        number = None
        if held is not None:
            number = np.empty(len(o), np.int32)
            number[o] = np.cumsum(new, dtype=np.int32) - 1
        key = key[i]
        h = (key << U64(32)) | (key >> U64(32))
        return h, multi, _pack(bucket_of(h), n_buckets), number

    # whole copies: all but the smallest doc_id of a text
    texts = docs.where(F.octet_length("text") >= span).select("doc_id", "chunk", F.unhex(F.md5("text")).alias("payload"))
    least = texts.groupBy("payload").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = texts.join(least, "payload").where(F.coalesce("doc_id", F.lit(NO_ID)) > F.col("least")).select(F.col("chunk").alias("to"), F.lit(0).alias("kind"), F.col("doc_id").alias("ref"), "payload")

    def send(key, d, x):
        ch = chunk_of(d, x)
        h, _, at, _ = distinct_anchors(ch)
        own = key[0].as_py()
        b = [i for i in range(n_buckets) if at[i + 1] > at[i]]
        return pa.table({"bucket": pa.array(b, pa.int32()), "chunk": pa.array([own] * len(b), pa.int32()), "payload": pa.array([_six(h[at[i] : at[i + 1]]) for i in b], pa.binary())})

    sent = docs.groupBy("chunk").cogroup(copies.groupBy("to")).applyInArrow(send, "bucket int, chunk int, payload binary")

    def answer(t: pa.Table) -> pa.Table:
        got = [_of_six(x) for x in t["payload"].to_pylist()]
        h = np.concatenate(got)
        o = np.argsort(h)
        s = h[o]
        i = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        n = np.diff(np.append(i, len(s)))
        count = np.empty(len(s), np.int64)
        count[o] = np.repeat(n, n)
        out, a = [], 0
        bucket = t["bucket"][0].as_py()
        for g in got:
            c = count[a : a + len(g)]
            a += len(g)
            out.append(np.packbits(np.concatenate([c > 1, c > hot_chunks])).tobytes() if (c > 1).any() else None)
        keep = [j for j, x in enumerate(out) if x is not None]
        return pa.table({"to": t["chunk"].take(pa.array(keep, pa.int64())), "kind": pa.array([1] * len(keep), pa.int32()), "ref": pa.array([bucket] * len(keep), pa.int64()), "payload": pa.array([out[j] for j in keep], pa.binary())})

    answered = sent.groupBy("bucket").applyInArrow(answer, NOTE)

    def segments(key, d, x):
        ch = chunk_of(d, x)
        own = key[0].as_py()
        held: list = []
        h, shared, at, number = distinct_anchors(ch, held)
        hot = np.zeros(len(h), bool)
        for b, p in zip(ch.notes["ref"].to_pylist(), ch.notes["payload"].to_pylist(), strict=True):
            n = at[b + 1] - at[b]
            bits = np.unpackbits(np.frombuffer(p, np.uint8))[: 2 * n].astype(bool)
            shared[at[b] : at[b + 1]] |= bits[:n]
            hot[at[b] : at[b + 1]] = bits[n:]
        parts, done = [], 0
        for buf, doc, first, count, start in held:
            pos = number[done : done + len(doc)]
            done += len(doc)
            keep = np.flatnonzero(shared[pos])
            doc, first, count, start, pos = doc[keep], first[keep].astype(np.int64), count[keep].astype(np.int64), start[keep].astype(np.int64), pos[keep]
            ah = h[pos]
            split = hot[pos]
            if split.any():  # string by string; where to is told by the string's own hash
                w = np.flatnonzero(split)
                each = count[w]
                f2, s2 = tk.ranges(first[w], each), tk.ranges(start[w], each)
                hot_to = tk.span_hash(tk.prefix_hash(buf), f2, f2 + span)
                rest = np.flatnonzero(~split)
                to = np.concatenate([ah[rest], hot_to])
                doc, first, start = np.concatenate([doc[rest], np.repeat(doc[w], each)]), np.concatenate([first[rest], f2]), np.concatenate([start[rest], s2])
                count = np.concatenate([count[rest], np.ones(len(f2), np.int64)])
            else:
                to = ah
            content = tk.word_hash(buf, first, first + count + span - 1)
            # one text for each content of the slice; the chunk's are joined below
            _, i = np.unique(content, return_index=True)
            lens = count[i] + span - 1
            body = buf[tk.ranges(first[i], lens)]
            parts.append((content, to, doc.astype(np.int32, copy=False), start, count, content[i], body, lens))
        del held, number
        if not parts:
            return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        content, to, doc, start, count = (np.concatenate([p[j] for p in parts]) for j in range(5))
        uc = np.concatenate([p[5] for p in parts])
        ul = np.concatenate([p[7] for p in parts])
        body = np.concatenate([p[6] for p in parts])
        del parts
        ua = np.cumsum(ul) - ul
        names, i = np.unique(uc, return_index=True)
        group = np.searchsorted(names, content)
        least = np.full(len(names), np.iinfo(np.int64).max)
        ids = ch.ids[ch.order][doc]
        np.minimum.at(least, group, ids)
        later = ids > least[group]
        # a later document of this chunk loses all of it at once
        rows = {"bucket": [], "chunk": [], "kind": [], "payload": []}
        if later.any():
            known = np.stack([doc[later].astype(np.int64), start[later], start[later] + count[later] + span - 1])
            rows["bucket"].append(own % n_buckets)
            rows["kind"].append(2)
            rows["payload"].append(_squeeze(known.astype(np.int64)))
        own_occ = np.flatnonzero(~later)
        g, d0, s0 = group[own_occ], doc[own_occ], start[own_occ]
        some = np.empty(len(names), np.uint64)
        some[group] = to
        nwin = np.empty(len(names), np.int64)
        nwin[group] = count
        ub = bucket_of(some)
        seen = np.full(len(names), len(own_occ))
        np.minimum.at(seen, g, np.arange(len(g)))
        o = np.lexsort((seen, ub))  # in document order: what is sent compresses better
        cuts = _pack(ub[o], n_buckets)
        inv = np.empty(len(names), np.int64)
        inv[o] = np.arange(len(names))
        g2 = inv[g]
        oo = np.argsort(g2, kind="stable")
        g2, d0, s0 = g2[oo], d0[oo], s0[oo]
        ocut = np.searchsorted(g2, cuts)
        for b in range(n_buckets):
            a, z = cuts[b], cuts[b + 1]
            if a == z:
                continue
            u = o[a:z]
            l = nwin[u] + span - 1
            txt = body[tk.ranges(ua[i[u]], l)]
            q = slice(ocut[b], ocut[b + 1])
            head = np.array([len(u), len(txt), ocut[b + 1] - ocut[b]], np.int64)
            rows["bucket"].append(b)
            rows["kind"].append(1)
            times = np.bincount(g2[q] - a, minlength=z - a)
            rows["payload"].append(_squeeze(head, np.diff(least[u], prepend=0), nwin[u].astype(np.uint16), txt, times.astype(np.int32), np.diff(d0[q].astype(np.int32), prepend=np.int32(0)), s0[q].astype(np.int32)))
        n = len(rows["bucket"])
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "chunk": pa.array([own] * n, pa.int32()), "kind": pa.array(rows["kind"], pa.int32()), "payload": pa.array(rows["payload"], pa.binary())})

    known = copies.unionByName(answered)
    found = docs.groupBy("chunk").cogroup(known.groupBy("to")).applyInArrow(segments, "bucket int, chunk int, kind int, payload binary")

    def sort(t: pa.Table) -> pa.Table:
        chunks, kinds, loads = t["chunk"].to_pylist(), t["kind"].to_pylist(), t["payload"].to_pylist()
        out_c, out_p = [c for c, k in zip(chunks, kinds, strict=True) if k == 2], [p for p, k in zip(loads, kinds, strict=True) if k == 2]
        least, nwin, texts, occ, owner = [], [], [], [], []
        base = 0
        for c, kind, p in zip(chunks, kinds, loads, strict=True):
            if kind != 1:
                continue
            p = _expand(p)
            nu, nt, no = np.frombuffer(p, np.int64, 3)
            at = 24
            least.append(np.cumsum(np.frombuffer(p, np.int64, nu, at)))
            at += 8 * nu
            nwin.append(np.frombuffer(p, np.uint16, nu, at).astype(np.int64))
            at += 2 * nu
            texts.append(np.frombuffer(p, np.uint8, nt, at))
            at += nt
            g = np.repeat(np.arange(nu), np.frombuffer(p, np.int32, nu, at)) + base
            at += 4 * nu
            d = np.cumsum(np.frombuffer(p, np.int32, no, at), dtype=np.int64)
            at += 4 * no
            occ.append(np.stack([g, d, np.frombuffer(p, np.int32, no, at).astype(np.int64)]))
            owner.append((c, no))
            base += nu
        if base:
            least, nwin, txt, occ = np.concatenate(least), np.concatenate(nwin), np.concatenate(texts), np.concatenate(occ, axis=1)
            lens = nwin + span - 1
            ends = np.cumsum(lens)
            h = tk.word_hash(txt, ends - lens, ends)
            _, i, inv = np.unique(h, return_index=True, return_inverse=True)
            first = np.full(len(i), np.iinfo(np.int64).max)
            np.minimum.at(first, inv, least)
            # one text of each content, ended by a byte that UTF-8 never has
            ul = lens[i]
            body = np.full(int(ul.sum() + len(i)), 0xFF, np.uint8)
            ustart = np.cumsum(ul + 1) - (ul + 1)
            body[tk.ranges(ustart, ul)] = txt[tk.ranges((ends - lens)[i], ul)]
            del txt, texts
            need = np.zeros(len(body), bool)
            valid = tk.ranges(ustart, nwin[i])
            need[valid] = True
            order = two_stage_order(body, need, span)
            order = order[need[order]]
            same = common_prefix_at_least(body, order, span)
            seg = np.repeat(np.arange(len(i)), nwin[i])
            of = np.zeros(len(body), np.int32)
            of[valid] = seg
            run = np.flatnonzero(np.append(True, ~same))
            low = np.minimum.reduceat(first[of[order]], run)
            verdict = np.empty(len(body), np.int64)
            verdict[order] = np.repeat(low, np.diff(np.append(run, len(order))))
            u = inv[occ[0]]
            each = nwin[occ[0]]
            w = tk.ranges(ustart[u], each)
            gone = verdict[w] < np.repeat(least[occ[0]], each)
            start = tk.ranges(occ[2], each)
            which = np.repeat(np.arange(occ.shape[1]), each)
            who = np.repeat(np.arange(len(owner)), [x[1] for x in owner])
            w = np.flatnonzero(gone)
            if len(w):
                s, o2 = start[w], which[w]
                i0 = np.flatnonzero(np.append(True, (o2[1:] != o2[:-1]) | (s[1:] != s[:-1] + 1)))
                last = np.append(i0[1:], len(w)) - 1
                spans = np.stack([occ[1][o2[i0]], s[i0], s[last] + span])
                by = who[o2[i0]]
                cuts = np.searchsorted(by, np.arange(len(owner) + 1))
                for j, (c, _) in enumerate(owner):
                    if cuts[j + 1] > cuts[j]:
                        out_c.append(c)
                        out_p.append(_squeeze(np.ascontiguousarray(spans[:, cuts[j] : cuts[j + 1]])))
        n = len(out_c)
        return pa.table({"to": pa.array(out_c, pa.int32()), "kind": pa.array([2] * n, pa.int32()), "ref": pa.array([None] * n, pa.int64()), "payload": pa.array(out_p, pa.binary())})

    spans = found.groupBy("bucket").applyInArrow(sort, NOTE)

    def apply(key, d, x):
        ch = chunk_of(d, x)
        got = [np.frombuffer(_expand(p), np.int64).reshape(3, -1) for p in ch.notes["payload"].to_pylist()]
        all_ = np.concatenate(got, axis=1) if got else np.zeros((3, 0), np.int64)
        o = np.argsort(all_[0], kind="stable")
        all_ = all_[:, o]
        cuts = np.searchsorted(all_[0], np.arange(len(ch.order) + 1))
        cols: dict[str, list] = {x: [] for x in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for at, row in enumerate(ch.order):
            text = ch.text(at)
            if ch.copy[at]:
                s, e = np.zeros(1, np.int64), np.full(1, len(text))
            else:
                s, e = tk.merge_spans(all_[1, cuts[at] : cuts[at + 1]], all_[2, cuts[at] : cuts[at + 1]])
            sha, last = hashlib.sha256(), 0
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                sha.update(text[last:a])
                last = b
            sha.update(text[last:])
            for name, v in zip(cols, (None if int(row) in ch.null_id else int(ch.ids[row]), len(text), int((e - s).sum()), len(s), sha.hexdigest(), [{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)]), strict=True):
                cols[name].append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(cols.items(), types, strict=True)})

    return docs.groupBy("chunk").cogroup(copies.unionByName(spans).groupBy("to")).applyInArrow(apply, OUT)
