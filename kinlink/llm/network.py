"""The network of op 8 and its training, in numpy alone: it is fitted in a small process of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kinlink.llm import textkit as tk

LENGTH, STRIDE, HIDDEN, DIM = 32, 16, 8, 12
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7), (3, 4)
MOST_VOCABULARY = 40_000
SLICE = 1 << 19
#: bytes of a word that are read one by one, from its front and its end; and the classes of bytes
FRONT, END, SYMBOLS, CHAR_DIM = 7, 4, 64, 8
#: words of more bytes are followed by their middles in pieces, one for every PIECE bytes; in shorter ones grams of MIDDLE bytes from these places cover what is not read one by one
WHOLE, PIECE, MIDDLE, PLACES = 15, 8, 4, (6, 8)
_SYMBOL = np.array([28] * 48 + [27] * 10 + [28] * 7 + list(range(1, 27)) + [28] * 6 + list(range(1, 27)) + [28] * 5 + [29 + i % 35 for i in range(128)], np.int32)
U64 = np.uint64
IS_WORD = np.ones(256, bool)
IS_WORD[:0x30] = IS_WORD[0x3A:0x41] = IS_WORD[0x5B:0x61] = IS_WORD[0x7B:0x80] = False


def with_middles(low: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray):
    """Words of more than WHOLE bytes followed by pieces of what lies between their fronts and ends, as words of their own. A piece begins with a character and has at most FRONT + END bytes."""
    long = np.flatnonzero(e - s > WHOLE)
    if not len(long):
        return s, e, first
    at, end = s[long] + FRONT, e[long] - END
    k = -(-(end - at) // PIECE)
    n = tk.ranges(np.zeros(len(long), np.int64), k)
    begin = np.repeat(at, k) + PIECE * n
    for _ in range(3):  # back to the first byte of a character
        begin = begin - ((low[begin] & 0xC0) == 0x80)
    stop = np.append(begin[1:], 0)
    stop[np.cumsum(k) - 1] = end
    o = np.argsort(np.concatenate([np.arange(len(s)), np.repeat(long, k)]), kind="stable")
    more = np.zeros(len(s) + 1, np.int64)
    more[long + 1] = k
    return np.concatenate([s, begin])[o], np.concatenate([e, stop])[o], first + np.cumsum(more)[first]


def features(buf: np.ndarray, off: np.ndarray):
    """Of the distinct words, and pieces of long ones, their hashes, character-gram hashes (words x grams, 0: none) and characters (words x FRONT + END, -1: none); each word's index among them, and first words of the documents."""
    low = tk.LOWER[buf]
    s, e, first = with_middles(low, *tk.words(low, off, IS_WORD))
    c = tk.prefix_hash(low)
    h = tk.span_hash(c, s, e)
    names, i, inv = np.unique(h, return_index=True, return_inverse=True)
    s, e = s[i], e[i]
    grams = []
    for n in PREFIXES:
        ok = e - s >= n
        grams.append(np.where(ok, tk.span_hash(c, s, np.minimum(s + n, e)) ^ U64(0x5555 + n), U64(0)))
    for n in SUFFIXES:
        ok = e - s >= n
        grams.append(np.where(ok, tk.span_hash(c, np.maximum(e - n, s), e) ^ U64(0xAAAA + n), U64(0)))
    for p in PLACES:
        ok = e - s > FRONT + END
        grams.append(np.where(ok, tk.span_hash(c, np.where(ok, s + p, s), np.where(ok, s + p + MIDDLE, s)) ^ U64(0x3333 + p), U64(0)))
    at = np.arange(FRONT + END)
    front = s[:, None] + at
    place = np.where(at < FRONT, front, np.maximum(e[:, None] - (FRONT + END) + at, s[:, None] + FRONT))
    chars = np.where(place < e[:, None], _SYMBOL[low[np.minimum(place, max(len(low) - 1, 0))]] if len(low) else -1, -1)
    return names, np.stack(grams, 1), chars.astype(np.int8), inv, first


def features_of_all(buf: np.ndarray, off: np.ndarray):
    """As `features`, slice by slice; of a word that several slices have only the first one's features are held."""
    known, grams, chars, seen, first, n = np.zeros(0, np.uint64), [], [], [], [np.zeros(1, np.int64)], 0
    order = []
    for a, z in tk.slices(off, SLICE):
        x, g, c, i, f = features(buf[off[a] : off[z]], off[a : z + 1] - off[a])
        new = ~np.isin(x, known)
        known = np.union1d(known, x[new])
        order.append(x[new])
        grams.append(g[new])
        chars.append(c[new])
        seen.append((x, i.astype(np.int32)))
        first.append(f[1:] + n)
        n += int(f[-1])
    o = np.argsort(np.concatenate(order))
    inv = np.concatenate([np.searchsorted(known, x).astype(np.int32)[i] for x, i in seen])
    return known, np.concatenate(grams)[o], np.concatenate(chars)[o], inv, np.concatenate(first)


def windows(first: np.ndarray):
    """First word and number of words of every window, and its document; every document has one at least."""
    n = np.diff(first)
    k = np.maximum(1, -(-(n - STRIDE) // STRIDE))
    doc = np.repeat(np.arange(len(n)), k)
    begin = first[:-1][doc] + STRIDE * tk.ranges(np.zeros(len(n), np.int64), k)
    return begin, np.minimum(LENGTH, first[1:][doc] - begin), doc


def _find(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index + 1 in the sorted vocabulary; 0: not there."""
    if not len(vocabulary):
        return np.zeros(h.shape, np.int32)
    i = np.searchsorted(vocabulary, h)
    i[i == len(vocabulary)] = 0
    return np.where(vocabulary[i] == h, i + 1, 0).astype(np.int32)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The recurrent network, its gradients and Adam."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, seed: int = 3):
        r = np.random.default_rng(seed)
        g = lambda *n: (r.standard_normal(n) / np.sqrt(n[0])).astype(np.float32)
        self.words, self.grams = words, grams
        self.p = {
            "ew": np.concatenate([np.zeros((1, DIM)), 0.1 * r.standard_normal((len(words), DIM))]).astype(np.float32),
            "ec": np.concatenate([np.zeros((1, DIM)), 0.1 * r.standard_normal((len(grams), DIM))]).astype(np.float32),
            "es": np.concatenate([np.zeros((1, CHAR_DIM)), 0.5 * r.standard_normal((SYMBOLS - 1, CHAR_DIM))]).astype(np.float32),
            "wk": g(CHAR_DIM, 3 * DIM), "uk": g(DIM, 2 * DIM), "ck": g(DIM, DIM), "ak": np.zeros(3 * DIM, np.float32),
            "v": np.zeros(2 * HIDDEN, np.float32), "o": g(2 * HIDDEN), "ob": np.full(1, -1.0, np.float32),
        }
        for d in "fb":
            self.p |= {f"w{d}": g(DIM, 3 * HIDDEN), f"u{d}": g(HIDDEN, 2 * HIDDEN), f"c{d}": g(HIDDEN, HIDDEN), f"a{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.slope, self.shift = 1.0, 0.0
        self._m = {k: np.zeros_like(x) for k, x in self.p.items()}
        self._v = {k: np.zeros_like(x) for k, x in self.p.items()}
        self._t = 0

    def inputs(self, names: np.ndarray, grams: np.ndarray):
        return _find(self.words, names), _find(self.grams, grams)

    def embed(self, wi: np.ndarray, gi: np.ndarray, ci: np.ndarray, keep: list | None = None, batch: int = 1 << 14) -> np.ndarray:
        """Vectors of words; keep: what the way back through the characters needs (one batch then)."""
        x = self.p["ew"][wi]
        for j in range(gi.shape[1]):
            x += self.p["ec"][gi[:, j]]
        symbols = self._project(self.p["es"], "k")
        if keep is not None:
            return x + self._run(symbols, ci, "k", keep)
        for a in range(0, len(x), batch):
            x[a : a + batch] += self._run(symbols, ci[a : a + batch], "k", None)
        return x

    def _run(self, x: np.ndarray, idx: np.ndarray, d: str, keep: list | None, every: list | None = None):
        """Last states of one recurrent direction. x: projected inputs, a zero row last; idx: (sequences, time) into x, -1 pads; every: gets the states of all times."""
        u, c = self.p[f"u{d}"], self.p[f"c{d}"]
        size = len(c)
        n, length = idx.shape
        h = np.zeros((n, size), np.float32)
        if every is not None:
            every += [None] * length
        for t in range(length) if d != "b" else range(length - 1, -1, -1):
            a = x[idx[:, t]]
            on = (idx[:, t] >= 0)[:, None]
            zr = _sigmoid(a[:, : 2 * size] + h @ u)
            z, r = zr[:, :size] * on, zr[:, size:]
            rh = r * h
            n_ = np.tanh(a[:, 2 * size :] + rh @ c)
            if keep is not None:
                keep.append((t, h, z, r, n_, rh, on))
            h = h + z * (n_ - h)
            if every is not None:
                every[t] = h
        return h

    def _states(self, x: np.ndarray, idx: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of all times (time, sequences, HIDDEN)."""
        every: list = []
        self._run(x, idx, d, keep, every)
        return np.stack(every)

    def _back(self, d: str, keep: list, idx: np.ndarray, x: np.ndarray, g: dict, last: np.ndarray, each: np.ndarray | None = None) -> np.ndarray:
        """Adds the gradients of one direction's weights to g, from those of its last states and of the states of all times; returns those of its inputs x."""
        u, c, w = self.p[f"u{d}"], self.p[f"c{d}"], self.p[f"w{d}"]
        back = last
        dproj = np.zeros((len(x) + 1, 3 * len(c)), np.float32)
        for t, h0, z, r, n_, rh, on in reversed(keep):
            dht = back if each is None else back + each[t]
            dn = dht * z * (1 - n_ * n_)
            dz = dht * (n_ - h0) * z * (1 - z)
            drh = dn @ c.T
            dr = drh * h0 * r * (1 - r) * on
            dzr = np.concatenate([dz, dr], 1)
            back = dht * (1 - z) + drh * r + dzr @ u.T
            g[f"u{d}"] += h0.T @ dzr
            g[f"c{d}"] += rh.T @ dn
            np.add.at(dproj, idx[:, t], np.concatenate([dzr, dn], 1))
        dproj = dproj[:-1]
        g[f"w{d}"] += x.T @ dproj
        g[f"a{d}"] += dproj.sum(axis=0)
        return dproj @ w.T

    def _project(self, x: np.ndarray, d: str) -> np.ndarray:
        w, a = self.p[f"w{d}"], self.p[f"a{d}"]
        out = np.zeros((len(x) + 1, len(a)), w.dtype)
        np.matmul(x, w, out=out[:-1])
        out[:-1] += a
        return out

    def logits(self, x: np.ndarray, idx: np.ndarray, batch: int = 2048) -> np.ndarray:
        """x: embedded distinct words; idx: (windows, LENGTH) into x, -1 pads."""
        pf, pb = self._project(x, "f"), self._project(x, "b")
        return np.concatenate([self._pool(self._states(pf, i, "f"), self._states(pb, i, "b"), i)[0] for i in (idx[a : a + batch] for a in range(0, len(idx), batch))] or [np.zeros(0)])

    def _pool(self, hf, hb, idx):
        h = np.concatenate([hf, hb], 2)
        s = h @ self.p["v"]
        s = np.where((idx >= 0).T, s, -30.0)
        s = np.exp(s - s.max(axis=0))
        alpha = s / s.sum(axis=0)
        pooled = (alpha[:, :, None] * h).sum(axis=0)
        return pooled @ self.p["o"] + self.p["ob"][0], h, alpha, pooled

    def step(self, wi, gi, ci, idx, y, weight, rate: float, l2: float = 1e-5) -> float:
        """One Adam step on a batch: wi, gi, ci of its distinct words, windows idx, labels y."""
        g = {k: np.zeros_like(x) for k, x in self.p.items()}
        kc: list = []
        x = self.embed(wi, gi, ci, kc)
        kf: list = []
        kb: list = []
        hf = self._states(self._project(x, "f"), idx, "f", kf)
        hb = self._states(self._project(x, "b"), idx, "b", kb)
        logit, h, alpha, pooled = self._pool(hf, hb, idx)
        p = _sigmoid(logit)
        dl = ((p - y) * weight / weight.sum()).astype(np.float32)
        g["ob"][0], g["o"][:] = dl.sum(), pooled.T @ dl
        dp = dl[:, None] * self.p["o"]
        da = (h * dp).sum(axis=2)
        ds = alpha * (da - (alpha * da).sum(axis=0))
        dh = alpha[:, :, None] * dp + ds[:, :, None] * self.p["v"]
        g["v"][:] = np.tensordot(ds, h, ([0, 1], [0, 1]))
        none = np.zeros((len(idx), HIDDEN), np.float32)
        dx = self._back("f", kf, idx, x, g, none, dh[:, :, :HIDDEN]) + self._back("b", kb, idx, x, g, none, dh[:, :, HIDDEN:])
        g["es"] += self._back("k", kc, ci, self.p["es"], g, dx)
        g["es"][0] = 0
        np.add.at(g["ew"], wi, dx)
        for j in range(gi.shape[1]):
            np.add.at(g["ec"], gi[:, j], dx)
        g["ew"][0] = g["ec"][0] = 0
        self._t += 1
        for k, x in self.p.items():
            d = g[k] + l2 * x
            self._m[k] += 0.1 * (d - self._m[k])
            self._v[k] += 0.001 * (d * d - self._v[k])
            x -= rate * (self._m[k] / (1 - 0.9**self._t)) / (np.sqrt(self._v[k] / (1 - 0.999**self._t)) + 1e-8)
        return float(-(weight * np.log(np.where(y > 0, p, 1 - p) + 1e-9)).sum() / weight.sum())

    def trimmed(self):
        """Without the optimiser's state, for shipping."""
        self._m = self._v = {}
        return self


def _gather(begin, count, inv):
    t = np.arange(LENGTH)
    at = begin[:, None] + np.minimum(t, np.maximum(count[:, None] - 1, 0))
    return np.where(t < count[:, None], inv[np.minimum(at, len(inv) - 1)] if len(inv) else -1, -1)


def train(texts: list[str], labels: np.ndarray, prior: float | None = None, rounds: int = 3, seed: int = 5) -> Network | None:
    """The network, trained and calibrated on documents' labels; prior: share of toxic documents where the texts were drawn from."""
    labels = np.asarray(labels).astype(int)
    if len(set(labels.tolist())) < 2:
        return None
    r = np.random.default_rng(seed)
    buf, off = tk.buffer_of(pa.array(texts, pa.string()))
    names, grams, chars, inv, first = features_of_all(buf, off)
    n_texts, texts = len(texts), None
    doc_of_word = np.repeat(np.arange(n_texts, dtype=np.int32), np.diff(first))
    held = r.random(n_texts) < 0.25  # for calibration only
    fit_word = ~held[doc_of_word]

    def odds(columns, docs, n):
        """Documents with each feature: how many, and log-odds of the toxic ones. A feature stands in one column only."""
        pos, all_ = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for ids in columns:
            pair = np.unique(ids.astype(np.int64) * n_texts + docs)
            f, d = pair // n_texts, pair % n_texts
            pos += np.bincount(f[labels[d] == 1], minlength=n)
            all_ += np.bincount(f, minlength=n)
        np1, np0 = max(1, labels[~held].sum()), max(1, (~held).sum() - labels[~held].sum())
        return all_, np.log((pos + 0.5) / (np1 + 1)) - np.log((all_ - pos + 0.5) / (np0 + 1))

    doc_of_word = doc_of_word[fit_word]
    n_word, lo_word = odds([inv[fit_word]], doc_of_word, len(names))
    flat, gid = np.unique(grams, return_inverse=True)
    gid = gid.reshape(grams.shape)
    n_gram, lo_gram = odds((gid[:, j][inv[fit_word]] for j in range(grams.shape[1])), doc_of_word, len(flat))
    del doc_of_word, fit_word, buf
    keep = lambda n, least: np.sort(np.argsort(-n, kind="stable")[: min(MOST_VOCABULARY, int((n >= least).sum()))])
    net = Network(names[keep(n_word, 8)], (lambda g: g[g != 0])(flat[keep(n_gram, 8)]))
    evidence = np.maximum(np.where(n_word >= 8, lo_word, -9), np.where((n_gram >= 8) & (flat != 0), lo_gram, -9)[gid].max(axis=1))
    begin, count, doc = windows(first)
    inv = inv.astype(np.int32)
    idx, score = np.empty((len(begin), LENGTH), np.int32), np.empty(len(begin))
    for a in range(0, len(begin), 4096):  # in parts: the process stays small
        part = slice(a, a + 4096)
        idx[part] = _gather(begin[part], count[part], inv)
        score[part] = np.where(idx[part] >= 0, evidence[np.maximum(idx[part], 0)] if len(evidence) else 0.0, -9.0).max(axis=1)
    wi, gi = net.inputs(names, grams)
    train_w = ~held[doc]
    del names, grams, gid, flat, n_gram, lo_gram, n_word, lo_word, evidence, inv, first, begin, count

    def ranked(score):
        o = np.lexsort((-score, doc))
        place = np.empty(len(doc), int)
        place[o] = tk.ranges(np.zeros(n_texts, np.int64), np.bincount(doc, minlength=n_texts))
        return place

    for it in range(rounds):
        place = ranked(score)
        pos = np.flatnonzero(train_w & (labels[doc] == 1) & (place < 2))
        neg = np.flatnonzero(train_w & (labels[doc] == 0) & ((place < 3) | (r.random(len(doc)) < 0.1)))
        w_all = np.concatenate([pos, neg])
        y_all = np.concatenate([np.ones(len(pos)), np.zeros(len(neg))])
        share = np.where(y_all > 0, 0.5 / max(1, len(pos)), 0.5 / max(1, len(neg))) * len(y_all)
        per_epoch = -(-len(w_all) // 256)  # small samples get as many steps as large ones
        for _ in range(max(3 if it == 0 else 2, -(-150 // max(1, per_epoch)))):
            o = r.permutation(len(w_all))
            for a in range(0, len(o), 256):
                b = o[a : a + 256]
                u, local = np.unique(idx[w_all[b]], return_inverse=True)
                local = local.reshape(-1, LENGTH)
                if u[0] == -1:
                    u, local = u[1:], local - 1
                if len(u):
                    net.step(wi[u], gi[u], chars[u], local, y_all[b], share[b], 0.01 if it < rounds - 1 else 0.004)
        score = net.logits(net.embed(wi, gi, chars), idx)
    top = np.full(n_texts, -np.inf)
    np.maximum.at(top, doc, score)
    # Platt scaling on the documents left out, at the true prior
    x, y = top[held], labels[held].astype(float)
    if len(set(y.tolist())) < 2:
        x, y = top, labels.astype(float)
    q = prior if prior is not None else y.mean()
    w = np.where(y > 0, q / max(1, y.sum()), (1 - q) / max(1, (1 - y).sum()))
    a = np.zeros(2)
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        h = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-5 * np.eye(2)
        a += np.clip(np.linalg.solve(h, z.T @ (w * (y - p)) - 1e-5 * a), -2, 2)
    net.slope, net.shift = float(max(a[0], 1e-3)), float(a[1])
    return net.trimmed()
