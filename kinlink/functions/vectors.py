"""Vector expressions over array columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: tables, sampled coordinates a table, and the seed the coordinates come from
LSH_TABLES, LSH_BITS, LSH_SEED = 48, 16, 16220260923


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def bind(c: Column, fn) -> Column:
    """fn of a value that is computed once: inside array expressions a plain column would be computed anew for every element."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    with_norm = bind(v, lambda w: F.struct(w.alias("w"), norm(w).alias("n")))
    return bind(with_norm, lambda s: F.transform(s["w"], lambda x: x / F.when(s["n"] == 0, 1.0).otherwise(s["n"])))


def int8(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x * 127))).cast("int"))


def q4(v: Column) -> Column:
    """Signed four-bit query, scaled by the largest magnitude."""
    with_most = bind(v, lambda w: F.struct(w.alias("w"), F.array_max(F.transform(w, lambda x: F.abs(x))).alias("m")))
    return bind(with_most, lambda s: F.transform(s["w"], lambda x: F.greatest(F.lit(-7.0), F.least(F.lit(7.0), F.rint(x / F.when(s["m"] == 0, 1.0).otherwise(s["m"]) * 7))).cast("int")))


def sign_bytes(v: Column) -> Column:
    """Sign bits (v >= 0), eight a byte, least significant first."""
    n = F.ceil(F.size(v) / 8).cast("int")
    one = lambda b: F.aggregate(F.sequence(F.lit(0), F.least(F.lit(7), F.size(v) - b * 8 - 1)), F.lit(0), lambda s, i: s + F.when(F.element_at(v, (b * 8 + i + 1).cast("int")) >= 0, F.pow(F.lit(2.0), i).cast("int")).otherwise(0))
    return F.transform(F.sequence(F.lit(0), n - 1), one)


def coarse(q: Column, v: Column) -> Column:
    """Sum of the query's magnitudes where its sign agrees with the target's."""
    return F.aggregate(F.zip_with(q, v, lambda w, x: F.when((w >= 0) == (x >= 0), F.abs(w)).otherwise(0)), F.lit(0), lambda s, x: s + x)


def lsh_positions(dim: int, tables: int = LSH_TABLES, bits: int = LSH_BITS) -> list[list[int]]:
    r = np.random.default_rng(LSH_SEED + dim)
    return [sorted(r.choice(dim, size=min(bits, dim), replace=False).tolist()) for _ in range(tables)]


def lsh_codes(v: Column, dim: int, tables: int = LSH_TABLES, bits: int = LSH_BITS) -> Column:
    """Bucket code of every table; the sampled coordinates enter as one constant array."""
    places = F.array(*[F.array(*[F.lit(p + 1) for p in pos]) for pos in lsh_positions(dim, tables, bits)])
    code = lambda w: lambda pos: F.aggregate(pos, F.struct(F.lit(0).alias("c"), F.lit(1).alias("b")), lambda s, p: F.struct((s["c"] + F.when(F.element_at(w, p) >= 0, s["b"]).otherwise(0)).alias("c"), (s["b"] * 2).alias("b")), lambda s: s["c"])
    return bind(v, lambda w: F.transform(places, code(w)))


def _byte_of(h: Column):
    return lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1


def deterministic_embedding(text: Column, dim: int = 32) -> Column:
    """Test embedding: bytes of sha256(text, counter as 32-bit little endian) scaled to -1..1, then normalised."""
    t = F.encode(text, "UTF-8")
    parts = []
    for counter in range(-(-dim // 32)):
        h = F.sha2(F.concat(t, F.lit(counter.to_bytes(4, "little"))), 256)
        parts.append(bind(h, lambda x: F.transform(F.sequence(F.lit(0), F.lit(31)), _byte_of(x))))
    return normalize(F.slice(F.concat(*parts), 1, dim))
