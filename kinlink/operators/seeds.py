"""Seed pairs: rows of two sides that are surely the same thing, by weighted likeness of their fields within a type.

Texts repeat far more than rows do, so the likeness of two texts is worked out
once for each pair of distinct texts of a type, and rows meet by those texts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.functions import matchers, normalize

#: fixed values: texts that stand for nothing, and the likeness of a text that contains the other
NOTHING, CONTAINED = ("", "88", "<NULL>", "-", "/"), 0.86


def plain(c: Column) -> Column:
    """A text in compatibility form and upper case without white space and punctuation; null if it stands for nothing."""
    t = F.upper(F.trim(normalize.apply(c, [{"op": "unicode_normalize", "options": {}}])))
    t = F.when(~t.isin(*NOTHING), F.regexp_replace(t, r"(?U)[\s_\-—–/\\()（）\[\]【】,，.;；:：]+", ""))
    return F.when(t != "", t)


def likeness(a: Column, b: Column) -> Column:
    """1 if equal, 0.86 if one contains the other, else by matching blocks."""
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), CONTAINED).otherwise(matchers.fuzzy(a, b))


def seed_pairs(sources: DataFrame, targets: DataFrame, rules: Mapping[str, Sequence[tuple[str, str, float]]], kind: str, least: float = 0.62, gap: float = 0.02, sure: float = CONTAINED) -> DataFrame:
    """s_ord, t_ord, score, gap of the kept pairs, from sides with `ordinal`, a type in `kind`, and fields.

    rules: for each type (source field, target field, weight). Fields that
    either side lacks count for nothing. A source's best target (of equals the
    first) is kept from `least` on, if it leads the second by `gap` or reaches
    `sure`.
    """
    best = None
    for name, fields in rules.items():
        s, t = sources.where(F.col(kind) == name), targets.where(F.col(kind) == name)
        s = s.select(F.col("ordinal").alias("s_ord"), *[plain(F.col(a)).alias(f"a{i}") for i, (a, _, _) in enumerate(fields)])
        t = t.select(F.col("ordinal").alias("t_ord"), *[plain(F.col(b)).alias(f"b{i}") for i, (_, b, _) in enumerate(fields)])
        alike = lambda x, y, i: x.select(f"a{i}").where(F.col(f"a{i}").isNotNull()).distinct().crossJoin(y.select(f"b{i}").where(F.col(f"b{i}").isNotNull()).distinct()).select(f"a{i}", f"b{i}", likeness(F.col(f"a{i}"), F.col(f"b{i}")).alias(f"l{i}"))
        up, used = F.lit(0.0), F.lit(0.0)
        d = s.crossJoin(t)
        for i, (_, _, weight) in enumerate(fields):
            d = d.join(alike(s, t, i), [f"a{i}", f"b{i}"], "left")
            known = F.col(f"l{i}").isNotNull()
            up, used = up + F.when(known, F.col(f"l{i}") * weight).otherwise(0.0), used + F.when(known, weight).otherwise(0.0)
        d = d.select("s_ord", "t_ord", F.round(F.when(used > 0, up / F.when(used > 0, used)).otherwise(0.0), 6).alias("score"))
        best = d if best is None else best.unionByName(d)
    w = Window.partitionBy("s_ord").orderBy(F.col("score").desc(), "t_ord")
    two = best.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    one = two.groupBy("s_ord").agg(F.min_by("t_ord", "_n").alias("t_ord"), F.max("score").alias("score"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("_second"))
    lead = F.round(F.col("score") - F.coalesce("_second", F.lit(0.0)), 6)
    return one.select("s_ord", "t_ord", "score", lead.alias("gap")).where((F.col("score") >= least) & ((F.col("gap") >= gap) | (F.col("score") >= sure)))
