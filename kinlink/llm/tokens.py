"""Op 2: token counts that follow edits.

Each document is cut into runs of pre-tokens at places where every
pre-tokenisation has a boundary (a single space between a character that is no
white space and a letter). The runs are the leaves of a segment tree that sums
characters and tokens. An edit re-encodes only the runs that it touches, plus
the neighbours whose common boundary it destroys, and updates the sums above
them; counts of untouched runs stay valid because no pre-token spans a boundary.

Scoring is one pass without shuffle; the vocabulary is read once per Python
worker from `vocabulary`, a path given as parameter; where there is no such file
the query fails with its name. Null and empty texts have no tokens; a text
without any boundary is one run, encoded whole; rows are counted one by one; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the pre-tokenisation that belongs to the vocabulary named above
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("kinlink", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def boundary(text: str, at: int) -> bool:
    """Whether every pre-tokenisation splits text before position `at`."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and text[at + 1].isalpha()


def leaves(text: str, size: int = 400) -> list[str]:
    """Runs of whole pre-tokens, each of about `size` characters or up to the next boundary."""
    out, a, n = [], 0, len(text)
    while a < n:
        b = text.find(" ", a + size)
        while 0 <= b and not boundary(text, b):
            b = text.find(" ", b + 1)
        b = n if b < 0 else b
        out.append(text[a:b])
        a = b
    return out


class CountTree:
    """Segment tree over the runs of one document: sums of characters and tokens."""

    def __init__(self, text: str, count, size: int = 400):
        self.count, self.size, self.encoded = count, size, 0
        self._set(leaves(text, size))

    def _measure(self, run: str) -> int:
        self.encoded += len(run)
        return self.count(run)

    def _set(self, runs: list[str], known: list[int] | None = None):
        self.runs = runs
        n = 1
        while n < max(1, len(runs)):
            n *= 2
        self.n = n
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, r in enumerate(runs):
            self.chars[n + i] = len(r)
            self.tokens[n + i] = self._measure(r) if known is None or known[i] < 0 else known[i]
        for i in range(n - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """Run that holds character `at` (the last one for the end), and where the run starts."""
        i, start = 1, 0
        while i < self.n:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.n, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start..end by `new`."""
        if not self.runs:
            self._set(leaves(new, self.size))
            return
        a, at = self.find(start)
        z, zat = self.find(max(start, end - 1)) if end > start else (a, at)
        # context: a boundary is told by one character before it and two from it on
        if a > 0 and start - at < 2:
            a -= 1
            at -= len(self.runs[a])
        if z + 1 < len(self.runs) and zat + len(self.runs[z]) - end < 1:
            zat += len(self.runs[z])
            z += 1
        old = "".join(self.runs[a : z + 1])
        fresh = leaves(old[: start - at] + new + old[end - at :], self.size)
        if len(fresh) == z + 1 - a:
            for i, r in enumerate(fresh, a):
                if r != self.runs[i]:
                    self.runs[i] = r
                    self._leaf(i, len(r), self._measure(r))
            return
        known = self.tokens[self.n : self.n + a] + [-1] * len(fresh) + self.tokens[self.n + z + 1 : self.n + len(self.runs)]
        self._set(self.runs[:a] + fresh + self.runs[z + 1 :], known)

    def _leaf(self, i: int, chars: int, tokens: int) -> None:
        i += self.n
        dc, dt = chars - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += dc
            self.tokens[i] += dt
            i //= 2

    def text(self) -> str:
        return "".join(self.runs)


def number_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask digit runs of four or more, last first."""
    return [(m.start(), m.end(), "<num>") for m in re.finditer(r"[0-9]{4,}", text)][::-1]


SCHEMA = "doc_id long, n_chars long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_reencoded long"


def count_tokens(docs: DataFrame, edits=number_edits, vocabulary: str = VOCABULARY, size: int = 400) -> DataFrame:
    """Tokens of every text of docs (doc_id, text) before and after `edits(text)`: (start, end, new), each on the text left by those before it."""

    def count(batches):
        enc = encoder(vocabulary)
        one = lambda s: len(enc.encode_ordinary(s))
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for i in range(b.num_rows):
                t = b.column("text")[i].as_py() or ""
                tree = CountTree(t, one, size)
                before, tree.encoded = tree.total, 0
                todo = edits(t)
                for e in todo:
                    tree.edit(*e)
                for c, v in zip(cols, (len(t), before, len(todo), tree.total, tree.encoded), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, SCHEMA)
