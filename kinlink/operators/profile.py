"""Profiles of columns, texts and lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKEN_CANDIDATES = (64, 128, 256, 512)
MOST_ENUM_VALUES = 50


def value_kind(c: Column) -> Column:
    """Kind of one text: BOOLEAN, INTEGER, NUMBER, DATE, DATETIME, TEXT; null if blank. Leading zeros make text."""
    t = F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    integer = t.rlike(r"^[+-]?[0-9]+$")
    return (
        F.when(t.isNull() | (t == ""), F.lit(None).cast("string"))
        .when(F.lower(t).isin("true", "false"), "BOOLEAN")
        .when(integer, F.when(t.rlike(r"^[+-]*0[0-9]+$"), "TEXT").otherwise("INTEGER"))
        .when(t.rlike(r"^[+-]?(?:[0-9]+\.[0-9]*|[0-9]*\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), "NUMBER")
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & t.try_cast("date").isNotNull(), "DATE")
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?$") & F.try_to_timestamp(F.regexp_replace(t, r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$", "")).isNotNull(), "DATETIME")
        .otherwise("TEXT")
    )


def datatype(kinds: Column) -> Column:
    """Type of a column from the set of its kinds."""
    only = lambda *k: F.size(F.array_except(kinds, F.array(*[F.lit(x) for x in k]))) == 0
    return (
        F.when(F.size(kinds) == 0, "EMPTY")
        .when(only("INTEGER"), "INTEGER")
        .when(only("INTEGER", "NUMBER"), "NUMBER")
        .when(only("DATE"), "DATE")
        .when(only("DATE", "DATETIME"), "DATETIME")
        .when(only("BOOLEAN"), "BOOLEAN")
        .when(only("TEXT"), "TEXT")
        .otherwise("MIXED")
    )


def enum_candidate(unique: Column, filled: Column, kind: Column) -> Column:
    r = unique / F.greatest(filled, F.lit(1))
    return (
        F.when((unique < 2) | (unique > MOST_ENUM_VALUES), False)
        .when(kind == "BOOLEAN", (unique <= 2) & (filled >= 2))
        .when(unique <= 2, (filled >= 4) & (r <= 0.5))
        .when(unique <= 4, (filled >= unique * 3) & (r <= 1 / 3))
        .when(unique <= 10, (filled >= unique * 4) & (r <= 0.25))
        .otherwise((filled >= unique * 5) & (r <= 0.2))
    )


def long_form(df: DataFrame, columns: Sequence[str], ordinal: str) -> DataFrame:
    """column_name, value (text), ordinal: one row per filled cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    d = df.select(F.col(ordinal).alias("ordinal"), F.inline(cells))
    return d.where(F.coalesce(F.regexp_replace("value", r"(?U)[\s\x1c-\x1f]+", ""), F.lit("")) != "")


def value_counts(df: DataFrame, columns: Sequence[str], ordinal: str) -> DataFrame:
    """Counts of every value of every column and where each was seen first; partial sums before the shuffle."""
    return long_form(df, columns, ordinal).groupBy("column_name", "value").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_seen"))


def column_profile(df: DataFrame, columns: Sequence[str], ordinal: str) -> DataFrame:
    v = value_counts(df, columns, ordinal)
    p = v.withColumn("kind", value_kind(F.col("value"))).groupBy("column_name").agg(F.sum("n").alias("non_empty_count"), F.count("*").alias("unique_count"), F.collect_set("kind").alias("kinds"))
    p = p.withColumn("datatype", datatype(F.col("kinds")))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    p = names.join(F.broadcast(p), "column_name", "left")  # one row a column
    p = p.select("column_name", F.coalesce("non_empty_count", F.lit(0)).cast("long").alias("non_empty_count"), F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count"), F.coalesce("datatype", F.lit("EMPTY")).alias("datatype"))
    return p.withColumn("enum_candidate", enum_candidate(F.col("unique_count"), F.col("non_empty_count"), F.col("datatype")))


def top_values(df: DataFrame, columns: Sequence[str], ordinal: str, k: int = 20) -> DataFrame:
    """The k commonest values of each column; ties by first appearance."""
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), "first_seen", "value")
    return value_counts(df, columns, ordinal).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("column_name", "place", "value", "n")


def token_lengths(df: DataFrame, length: str, candidates: Sequence[int] = TOKEN_CANDIDATES) -> DataFrame:
    """Percentiles (linear, rounded up), truncation rates, and the first candidate length that covers p99."""
    q = (0.5, 0.95, 0.99, 0.999)
    d = df.agg(F.count(length).alias("n"), F.max(length).alias("most"), F.percentile(length, F.array(*[F.lit(x) for x in q])).alias("p"), *[F.round(F.avg((F.col(length) > c).cast("double")), 6).alias(f"truncated_{c}") for c in candidates])
    names = ("p50", "p95", "p99", "p999")
    d = d.select("n", "most", *[F.ceil(F.col("p")[i]).alias(x) for i, x in enumerate(names)], *[f"truncated_{c}" for c in candidates])
    fit = F.lit(candidates[-1])
    for c in reversed(candidates):
        fit = F.when(F.col("p99") <= c, c).otherwise(fit)
    return d.withColumn("recommended_length", fit)


def column_values(df: DataFrame, column: str, ordinal: str, k: int = 20) -> DataFrame:
    """One row about a column: type, distinct values, whether they look like an enumeration, the commonest values (value=n), the values of an enumeration, and whether those are all."""
    p = column_profile(df, [column], ordinal)
    top = top_values(df, [column], ordinal, k).groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("t"))  # k values
    d = p.join(top, "column_name", "left")
    values = F.transform("t", lambda x: x["value"])
    return d.select("column_name", "datatype", "unique_count", "enum_candidate", F.array_join(F.transform("t", lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), ",").alias("top_values"), F.when(F.col("enum_candidate"), F.array_join(values, ",")).otherwise("").alias("values"), (F.coalesce(F.size("t"), F.lit(0)) >= F.col("unique_count")).alias("values_complete"))


def text_profile(df: DataFrame, text: str, most: int = 512, scanned: DataFrame | None = None) -> DataFrame:
    """Rows, filled and distinct texts, rates of empty, repeated and too long ones. scanned: the part of df to profile, if not all; coverage is its share."""
    d = df if scanned is None else scanned
    t = F.coalesce(F.col(text), F.lit(""))
    n, filled = F.count("*"), F.count_if(t != "")
    part = lambda a, b: F.when(b > 0, F.round(a / F.when(b > 0, b), 6)).otherwise(0.0)
    got = d.agg(n.alias("row_count"), filled.alias("filled_rows"), F.count_distinct(F.when(t != "", t)).alias("distinct_texts"), F.max(F.length(t)).alias("longest"), F.count_if(F.length(t) > most).alias("_long"))
    whole = F.lit(1.0)
    if scanned is not None:
        got, whole = got.crossJoin(df.agg(F.count("*").alias("_all"))), part(F.col("row_count"), F.col("_all"))  # one row each
    return got.select("row_count", "filled_rows", "distinct_texts", "longest", part(F.col("row_count") - F.col("filled_rows"), F.col("row_count")).alias("empty_rate"), part(F.col("filled_rows") - F.col("distinct_texts"), F.col("filled_rows")).alias("duplicate_rate"), part(F.col("_long"), F.col("filled_rows")).alias("truncation_rate"), whole.alias("coverage_ratio"))


def latencies(df: DataFrame, seconds: str, rows: str) -> DataFrame:
    """One row about timed batches: median and 95th percentile in milliseconds, rows a second, hours for 1.1 million rows."""
    p = F.percentile(seconds, F.array(F.lit(0.5), F.lit(0.95)))
    d = df.agg(p.alias("p"), (F.sum(rows) / F.sum(seconds)).alias("r"))
    return d.select(F.round(F.col("p")[0] * 1000, 3).alias("p50_ms"), F.round(F.col("p")[1] * 1000, 3).alias("p95_ms"), F.round("r", 3).alias("rows_per_second"), F.round(1_100_000 / F.col("r") / 3600, 3).alias("projected_hours"))


def bottom_k_sample(df: DataFrame, key: str, k: int = 4096, seed: int = 20260915) -> DataFrame:
    """Deterministic uniform sample: the k smallest seeded hashes."""
    h = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    return df.orderBy(h, F.col(key)).limit(k)


def count_stats(df: DataFrame, n: str) -> DataFrame:
    return df.agg(F.round(F.avg(n), 6).alias("mean"), F.expr(f"percentile_disc(0.95) within group (order by {n})").alias("p95"), F.max(n).alias("most"))


def pack_by_budget(lengths: Sequence[int], budget: int, most: int = 64) -> list[list[int]]:
    """Batches of positions, by rising length, with rows x longest <= budget."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if out and len(out[-1]) < most and (len(out[-1]) + 1) * max(1, lengths[i]) <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


