"""Op 6: benchmark passages in documents, by a prefix-filtered set join.

An item's windows are its runs of `window` words (a shorter item is one
window). A window is the set of its shingles; it can only occur where all of
them do, so one shingle, its rarest over all documents, is the necessary
prefix. Documents meet windows on that prefix; the shingle's place in the
window gives the only start that is possible, which must leave the window
inside the document; what remains is compared word by word.

Cost: two passes over the documents (counts, then the join), no shuffle of
text. The windows are broadcast in blocks of `block_bytes` of benchmark text;
a larger benchmark takes more passes, never a larger broadcast.

Words: A-Z lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A null or
empty text has no words; an item without words has no
windows. An item with a null id has windows but no place in n_items and
items_sha256. Repeated rows are judged one by one.
"""

from __future__ import annotations

import hashlib
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.llm import textkit as tk
from kinlink.llm.shared import cut

if TYPE_CHECKING:  # workers do without it
    import pandas as pd

SLICE = 1 << 20
OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Windows:
    """Distinct windows of one block of items, as word hashes and as text."""

    def __init__(self, items: pd.DataFrame, window: int, shingle: int):
        seen: dict[bytes, set] = {}
        for item, text in zip(items["item_id"], items["text"], strict=True):
            buf = tk.LOWER[np.frombuffer((text or "").encode(), np.uint8)] if text else np.zeros(0, np.uint8)
            s, e, _ = tk.words(buf, np.array([0, len(buf)]), tk.ALNUM)
            w = [buf[a:b].tobytes() for a, b in zip(s, e, strict=True)]
            if w:
                for i in range(max(1, len(w) - window + 1)):
                    ids = seen.setdefault(b" ".join(w[i : i + window]), set())
                    if item is not None:
                        ids.add(str(item))
        self.text = sorted(seen)
        self.items = [sorted(seen[t]) for t in self.text]
        self.length = np.array([t.count(b" ") + 1 for t in self.text], np.int64)
        buf = np.frombuffer(b"\n".join(self.text), np.uint8)
        s, e, _ = tk.words(buf, np.array([0, len(buf)]), tk.ALNUM)
        self.hash = tk.span_hash(tk.prefix_hash(buf), s, e)
        self.at = np.cumsum(self.length) - self.length
        self.size = np.minimum(self.length, shingle)  # words in a shingle
        # all shingles: window, place in it, hash, sorted by hash
        n = self.length - self.size + 1
        self.win = np.repeat(np.arange(len(n)), n)
        self.place = tk.ranges(np.zeros(len(n), np.int64), n)
        self.gram = np.zeros(len(self.win), np.uint64)
        for k in np.unique(self.size):
            g = tk.gram_hash(self.hash, int(k))
            m = self.size[self.win] == k
            self.gram[m] = g[self.at[self.win[m]] + self.place[m]]
        self.grams = np.unique(self.gram)
        self.sizes = [int(k) for k in np.unique(self.size)]

    def choose(self, counts: np.ndarray) -> None:
        """Keeps each window's rarest shingle."""
        c = counts[np.searchsorted(self.grams, self.gram)]
        o = np.lexsort((self.place, self.gram, c, self.win))
        first = o[np.flatnonzero(np.append(True, self.win[o][1:] != self.win[o][:-1]))] if len(o) else o
        o = first[np.argsort(self.gram[first], kind="stable")]
        self.win, self.place, self.gram = self.win[o], self.place[o], self.gram[o]
        self.grams = np.unique(self.gram)
        self.from_ = np.append(np.searchsorted(self.gram, self.grams), len(self.gram))


def _sieve(grams: np.ndarray) -> np.ndarray:
    s = np.zeros(1 << 20, bool)
    s[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return s


def _hits(sieve, grams, g):
    """Places in g whose hash is in grams, and where in grams."""
    at = np.flatnonzero(sieve[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
    i = np.searchsorted(grams, g[at])
    ok = i < len(grams)
    ok[ok] = grams[i[ok]] == g[at[ok]]
    return at[ok], i[ok]


def _slices(batches):
    for b in batches:
        buf, off = tk.buffer_of(b.column("text").cast(pa.string()))
        for a, z in tk.slices(off, SLICE):
            low = tk.LOWER[buf[off[a] : off[z]]]
            o = off[a : z + 1] - off[a]
            s, e, first = tk.words(low, o, tk.ALNUM)
            yield b.slice(a, z - a), low, s, e, first, tk.span_hash(tk.prefix_hash(low), s, e)


def _blocks(benchmark: DataFrame, block_bytes: int):
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = max(1, -(-int(b.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // block_bytes))
    for i in range(n):
        yield (b if n == 1 else b.where(F.pmod(F.xxhash64(F.coalesce("item_id", "text")), F.lit(n)) == i)).toPandas()


def hits(docs: DataFrame, items: pd.DataFrame, carry: list[str], window: int = 10, shingle: int = 3, only_clean: bool = False) -> DataFrame:
    """Columns `carry` of docs, n_words, spans (of hit words) and items, against one block of items; only_clean: the carried columns of rows without hits."""
    spark = docs.sparkSession
    w = Windows(items, window, shingle)
    grams, sizes = w.grams, w.sizes

    @tk.frugal
    def count(batches):
        sieve, total = _sieve(grams), np.zeros(len(grams), np.int64)
        for _, _, _, _, first, h in _slices(batches):
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for k in sizes:
                at, i = _hits(sieve, grams, tk.gram_hash(h, k))
                at = doc[at] == doc[at + k - 1]
                total += np.bincount(i[at], minlength=len(grams))
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], ["i", "n"])

    counts = np.zeros(len(grams), np.int64)
    if len(grams):
        got = docs.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()  # at most one row a shingle of the block
        counts[got["i"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    w.choose(counts)
    shared = spark.sparkContext.broadcast(w)

    @tk.frugal
    def join(batches):
        w = shared.value
        sieve = _sieve(w.grams)
        for part, low, s, e, first, h in _slices(batches):
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            starts, wins = [], []
            for k in w.sizes:
                at, i = _hits(sieve, w.grams, tk.gram_hash(h, k))
                n = w.from_[i + 1] - w.from_[i]
                p = tk.ranges(w.from_[i], n)
                at, win, place = np.repeat(at, n), w.win[p], w.place[p]
                begin = at - place
                d = doc[at]
                ok = (w.size[win] == k) & (begin >= first[d]) & (begin + w.length[win] <= first[d + 1])
                starts.append(begin[ok])
                wins.append(win[ok])
            begin, win = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, wins))
            for j in range(int(w.length.max()) if len(w.length) else 0):  # hashes of all words, then the words
                live = w.length[win] > j
                same = np.ones(len(win), bool)
                same[live] = h[begin[live] + j] == w.hash[w.at[win[live]] + j]
                begin, win = begin[same], win[same]
            n_docs = len(first) - 1
            spans: list[list] = [[] for _ in range(n_docs)]
            items: list[set] = [set() for _ in range(n_docs)]
            for b, x in zip(begin.tolist(), win.tolist(), strict=True):
                z = b + int(w.length[x])
                if b" ".join(low[s[q] : e[q]].tobytes() for q in range(b, z)) == w.text[x]:
                    d = int(doc[b])
                    spans[d].append((b - int(first[d]), z - int(first[d])))
                    items[d].update(w.items[x])
            flat = []
            for x in spans:
                a, z = tk.merge_spans(*(np.array(y, np.int64) for y in (zip(*x, strict=True) if x else ((), ()))))
                flat.append(np.stack([a, z], 1).ravel().tolist())
            own = [part.column(c) for c in carry]
            if only_clean:
                clean = pa.array([not x for x in spans], pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(clean) for c in own], carry)
            else:
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(first), pa.int64()), pa.array(flat, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], [*carry, "n_words", "spans", "items"])

    kept = [docs.schema[c] for c in carry]
    if not only_clean:
        kept += [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    return docs.mapInArrow(join, T.StructType(kept))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, block_bytes: int = 16 << 20) -> DataFrame:
    """docs (any columns, among them text) without the rows that hold a window of the benchmark."""
    for b in _blocks(benchmark, block_bytes):
        docs = hits(docs, b, docs.columns, window, shingle, only_clean=True)
    return docs


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, block_bytes: int = 16 << 20) -> DataFrame:
    """Per document of docs (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = docs.select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(benchmark, block_bytes)
    first, more = next(blocks), next(blocks, None)
    if more is not None:  # rows meet again by id and text; equal rows get equal answers
        docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    found = [hits(docs, first, ["row", "doc_id"], window, shingle)]
    if more is not None:
        found = [cut(found[0].withColumn("first", F.lit(True)))]
        # one block of the benchmark at a time on the driver; of later blocks only rows with hits are kept
        while more is not None:
            found.append(cut(hits(docs, more, ["row", "doc_id"], window, shingle).where("size(spans) > 0").withColumn("first", F.lit(False))))
            more = next(blocks, None)

    def digest(batches):
        for b in batches:
            spans, items = b.column("spans").to_pylist(), b.column("items").to_pylist()
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hit])], [x.split()[0] for x in OUT.split(", ")])

    if len(found) == 1:
        return found[0].mapInArrow(digest, OUT)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)

    def merge(t: pa.Table) -> pa.Table:
        copies = int(np.asarray(t["first"]).sum())  # equal rows of the input
        flat = [x for y in t["spans"].to_pylist() for x in y]
        s, e = tk.merge_spans(np.array(flat[::2], np.int64), np.array(flat[1::2], np.int64))
        one = {"row": t["row"][0].as_py(), "doc_id": t["doc_id"][0].as_py(), "n_words": t["n_words"][0].as_py(), "spans": np.stack([s, e], 1).ravel().tolist(), "items": sorted({x for y in t["items"].to_pylist() for x in y})}
        return pa.Table.from_pylist([one] * copies, schema=t.drop_columns(["first"]).schema)

    return every.groupBy("row", "doc_id").applyInArrow(merge, "row long, doc_id long, n_words long, spans array<long>, items array<string>").mapInArrow(digest, OUT)
