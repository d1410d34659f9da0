"""Relational content of the result workbook, one table a sheet.

items, candidates and reviews as kept by the store; joins are by
(source_row_id), the key results are partitioned by.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.errors import ConfigError
from kinlink.operators.calibration import status_for
from kinlink.operators.review import latest_review, method_label


def selected_candidate(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """First candidate, by rank, with the item's final code; of equal ranks the one kept first, where candidates have their place as seq. A score that is missing is the next one's."""
    ranked = F.when(F.col("rank").isNotNull(), F.struct("rank", *[c for c in ("seq",) if c in candidates.columns]))
    c = candidates.withColumnRenamed("target_group_code", "final_group_code").groupBy("source_row_id", "final_group_code")
    c = c.agg(F.min("rank").alias("selected_rank"), F.min_by("score", F.when(F.col("score").isNotNull(), ranked)).alias("selected_score"), F.min_by("target_row_number", ranked).alias("selected_row"))
    return items.join(c, ["source_row_id", "final_group_code"], "left").select(*items.columns, "selected_rank", "selected_score", "selected_row")


def summary(items: DataFrame) -> DataFrame:
    return items.groupBy().pivot("current_status", ["MATCHED", "REVIEW", "UNMATCHED"]).agg(F.count(F.lit(1))).na.fill(0)


def final_results(items: DataFrame, candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    r = latest_review(reviews).select("source_row_id", F.col("operator").alias("last_operator"), F.col("operated_at").alias("reviewed_at"))
    d = selected_candidate(items, candidates).join(r, "source_row_id", "left")
    return d.withColumn("method", method_label(F.col("current_status"), F.col("last_operator").isNotNull()))


def top_candidates(items: DataFrame, candidates: DataFrame, top_n: int = 5) -> DataFrame:
    return candidates.where(F.col("rank") <= top_n).join(items.select("source_row_id", "current_status"), "source_row_id")


def audit(log: DataFrame, candidates: DataFrame) -> DataFrame:
    """Log entries with the catalog row of the code they chose."""
    c = candidates.groupBy("source_row_id", F.col("target_group_code").alias("group_code")).agg(F.min("target_row_number").alias("target_row"))
    return log.join(c, ["source_row_id", "group_code"], "left")


def unmatched(items: DataFrame, candidates: DataFrame) -> DataFrame:
    c = candidates.where("rank = 1").select("source_row_id", F.col("target_group_code").alias("best_code"), F.col("score").alias("best_score"))
    return items.where("current_status = 'UNMATCHED'").join(c, "source_row_id", "left")


def veto_compare(items: DataFrame, candidates: DataFrame, success: float) -> DataFrame:
    """What rows would have been without vetoes: candidates carry field_scores (score, weight, score_before_veto)."""
    up = F.aggregate("field_scores", F.lit(0.0), lambda s, f: s + f["score_before_veto"] * f["weight"])
    down = F.aggregate("field_scores", F.lit(0.0), lambda s, f: s + f["weight"])
    pre = F.round(F.when(down > 0, up / F.when(down > 0, down)).otherwise(0.0) * 100, 4)
    c = candidates.withColumn("pre", pre).groupBy("source_row_id").agg(F.max("pre").alias("pre_score"), F.max_by("target_group_code", F.struct(F.col("pre"), -F.col("rank"))).alias("pre_code"), F.max(F.exists("field_scores", lambda f: f["vetoed"])).alias("any_veto"))
    d = items.select("source_row_id", "current_status", "top1_score").join(c, "source_row_id")
    return d.withColumn("pre_status", status_for(F.col("pre_score"), F.lit(float(success)), F.lit(0.0)))


def field_state(score: Column) -> Column:
    """1 exact, 2 partial, 3 different, 4 missing: the worst one counts."""
    return F.when(score.isNull(), 4).when(score >= 0.999999, 1).when(score > 0, 2).otherwise(3)


def column_states(source: Column, target: Column, ruled: Column | None = None) -> Column:
    """State of a column that both sides have: that of the rules over it, else by comparing the trimmed texts; missing wherever a side is."""
    blank = lambda c: F.coalesce(F.regexp_replace(c, r"(?U)\s+", ""), F.lit("")) == ""
    plain = F.when(F.trim(source) == F.trim(target), 1).otherwise(3)
    return F.when(blank(source) | blank(target), 4).otherwise(F.coalesce(ruled, plain) if ruled is not None else plain)


STATES = ("EXACT", "PARTIAL", "DIFFERENT", "MISSING")


def worst_states(scores: DataFrame, *by: str) -> DataFrame:
    """scores: by..., score. State name of the worst score."""
    names = F.array(*[F.lit(s) for s in STATES])
    return scores.groupBy(*by).agg(F.max(field_state(F.col("score"))).alias("p")).select(*by, F.element_at(names, F.col("p")).alias("state"))


def manual_wide(items: DataFrame, candidates: DataFrame, most: int = 5) -> DataFrame:
    """Rows still to be decided, with their best candidates side by side."""
    c = candidates.where(F.col("rank") <= most).groupBy("source_row_id").pivot("rank", list(range(1, most + 1))).agg(F.first("target_group_code").alias("code"), F.first("score").alias("score"))
    c = c.toDF("source_row_id", *[f"{n}_{r}" for r in range(1, most + 1) for n in ("code", "score")])
    return items.where("current_status <> 'MATCHED'").select("source_row_id", "current_status", "top1_score").join(c, "source_row_id", "left")


def candidate_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("source_row_id").agg(F.count("*").alias("n"))


def best_and_second(scores: DataFrame, by: str, score: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col(score).desc())
    d = scores.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    return d.groupBy(by).agg(F.max(F.when(F.col("_n") == 1, F.col(score))).alias("best"), F.max(F.when(F.col("_n") == 2, F.col(score))).alias("second"))


def ordered_rules(rules) -> list:
    """Rules as reports show them: critical ones first, then by falling weight; equals as configured."""
    return sorted(rules, key=lambda r: (not r.critical, -r.weight))


def column_pairs(rules, source_columns, target_columns) -> list[tuple[list[str], list[str], str]]:
    """(source columns, target columns, label) side by side in a report: each column goes to the first rule, in that order, that has columns left on both sides."""
    left, right = dict.fromkeys(source_columns), dict.fromkeys(target_columns)
    out = []
    for r in ordered_rules(rules):
        s, t = [c for c in r.source.columns if c in left], [c for c in r.target.columns if c in right]
        if s and t:
            for names, own in ((left, s), (right, t)):
                for c in own:
                    names.pop(c, None)
            a, b = " / ".join(s), " / ".join(t)
            out.append((s, t, a if a == b else f"{a} ↔ {b}"))
    return out


def merge_template(base: dict, given: dict, path: str = "") -> dict:
    """A report template: the base with the given values in place of its own, at any depth; keys that the base lacks are refused."""
    out = dict(base)
    for k, v in given.items():
        where = f"{path}.{k}" if path else str(k)
        if k not in base:
            raise ConfigError("TEMPLATE_INVALID", f"unknown {where}")
        if isinstance(base[k], dict) != isinstance(v, dict):
            raise ConfigError("TEMPLATE_INVALID", f"{where} has the wrong kind")
        out[k] = merge_template(base[k], v, where) if isinstance(v, dict) else v
    return out


def check_template(t: dict) -> dict:
    """The template, if a workbook can be made from it: sheet names that differ and fit, colours of six hex digits, a number of candidates within 1 to 50."""
    names = [str(x or "").strip() for x in t.get("sheets", {}).values()]
    if not names or not all(names) or len(set(names)) < len(names) or any(len(x) > 31 for x in names):
        raise ConfigError("TEMPLATE_INVALID", "sheets")
    if not 1 <= int(t.get("candidate_top_n") or 0) <= 50:
        raise ConfigError("TEMPLATE_INVALID", "candidate_top_n")

    def colours(d: dict, path: str):
        for k, v in d.items():
            if isinstance(v, dict):
                colours(v, f"{path}.{k}")
            elif k.endswith(("_fill", "_color")) or path.endswith("_fill"):
                if not re.fullmatch(r"#?[0-9A-Fa-f]{6}", str(v or "")):
                    raise ConfigError("TEMPLATE_INVALID", f"{path}.{k}")

    colours(t.get("style", {}), "style")
    return t
