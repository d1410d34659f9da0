"""What-if and re-decision over match items.

items: source_row_id, current_status, top1_score, score_gap, top1_group_code
(and whatever else; it is kept by apply). reviews: source_row_id. Rows with a
human review are never re-decided. Thresholds meet items as a broadcast of
at most `MOST_SCENARIOS` rows, so each preview is one pass with a partial
aggregation; only counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.errors import ConfigError

MOST_SCENARIOS = 100
STATUSES = ("MATCHED", "REVIEW", "UNMATCHED")


def check_thresholds(review: float, success: float) -> None:
    if not 0 <= review < success <= 100:
        raise ConfigError("THRESHOLDS_INVALID", f"{review} / {success}")


def status_for(score: Column, success: Column, review: Column) -> Column:
    """>= success: MATCHED; > 0 and >= review: REVIEW."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= success, "MATCHED").when((s > 0) & (s >= review), "REVIEW").otherwise("UNMATCHED")


def unreviewed(items: DataFrame, reviews: DataFrame) -> DataFrame:
    return items.join(reviews.select("source_row_id").distinct(), "source_row_id", "left_anti")


def protected_count(items: DataFrame, reviews: DataFrame) -> DataFrame:
    return items.join(reviews.select("source_row_id").distinct(), "source_row_id", "left_semi").agg(F.count("*").alias("human_protected"))


def status_summary(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("total"), *[F.count_if(F.col("current_status") == s).alias(s.lower()) for s in STATUSES])


def preview(items: DataFrame, reviews: DataFrame, success: float, review: float = 0.0) -> DataFrame:
    """Transition counts old -> new of the rows without human review."""
    check_thresholds(review, success)
    new = status_for(F.col("top1_score"), F.lit(float(success)), F.lit(float(review)))
    return unreviewed(items, reviews).groupBy(F.col("current_status").alias("old_status"), new.alias("new_status")).agg(F.count("*").alias("n"))


def preview_summary(items: DataFrame, reviews: DataFrame, success: float, review: float = 0.0) -> DataFrame:
    """One row: counts by status before and after, their differences, rows that change, and rows that people protect."""
    check_thresholds(review, success)
    human = reviews.select("source_row_id").distinct().withColumn("_human", F.lit(True))
    new = status_for(F.col("top1_score"), F.lit(float(success)), F.lit(float(review)))
    d = items.join(human, "source_row_id", "left").withColumn("_new", F.when(F.col("_human").isNull(), new).otherwise(F.col("current_status")))
    before = {s: F.count_if(F.col("current_status") == s) for s in STATUSES}
    after = {s: F.count_if(F.col("_new") == s) for s in STATUSES}
    return d.agg(*[before[s].alias(f"before_{s.lower()}") for s in STATUSES], *[after[s].alias(f"after_{s.lower()}") for s in STATUSES], *[(after[s] - before[s]).alias(f"{s.lower()}_delta") for s in STATUSES], F.count_if(F.col("_new") != F.col("current_status")).alias("affected_rows"), F.count_if("_human").alias("human_protected"))


def batch_preview(items: DataFrame, reviews: DataFrame, scenarios: list[tuple[float, float]]) -> DataFrame:
    """Counts per scenario (success, review), numbered from 0."""
    if not 0 < len(scenarios) <= MOST_SCENARIOS:
        raise ConfigError("SCENARIOS_INVALID", str(len(scenarios)))
    for success, review in scenarios:
        check_thresholds(review, success)
    rows = [(i, float(s), float(r)) for i, (s, r) in enumerate(scenarios)]
    plan = items.sparkSession.createDataFrame(rows, "scenario int, success double, review double")
    d = unreviewed(items, reviews).crossJoin(F.broadcast(plan)).withColumn("new", status_for(F.col("top1_score"), F.col("success"), F.col("review")))
    return d.groupBy("scenario", "success", "review").agg(*[F.count_if(F.col("new") == s).alias(s.lower()) for s in STATUSES], F.count_if(F.col("new") != F.col("current_status")).alias("changed"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """Ten buckets of 0..100, zero-filled; below 0 counts as 0, 100 and more as 90. Nulls are left out."""
    v = F.col(value)
    b = F.when(v < 0, 0).when(v >= 100, 90).otherwise(F.floor(v / 10) * 10).cast("int")
    got = df.where(v.isNotNull()).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(0, 100, 10).select(F.col("id").cast("int").alias("bucket"))
    return every.join(F.broadcast(got), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # ten rows


def apply(items: DataFrame, reviews: DataFrame, success: float, review: float = 0.0) -> DataFrame:
    """items with re-decided status and final code where no human has reviewed."""
    check_thresholds(review, success)
    human = reviews.select("source_row_id").distinct().withColumn("_human", F.lit(True))
    new = status_for(F.col("top1_score"), F.lit(float(success)), F.lit(float(review)))
    d = items.join(human, "source_row_id", "left")
    free = F.col("_human").isNull()
    d = d.withColumn("current_status", F.when(free, new).otherwise(F.col("current_status")))
    return d.withColumn("final_group_code", F.when(free, F.when(F.col("current_status") == "MATCHED", F.col("top1_group_code"))).otherwise(F.col("final_group_code"))).drop("_human")


def current_thresholds(base: DataFrame, revisions: DataFrame) -> DataFrame:
    """Thresholds of each task: those of its last revision, else its base."""
    last = revisions.groupBy("task_id").agg(F.max_by(F.struct("success", "review"), "revision_no").alias("r"), F.max("revision_no").alias("revision_no"))
    return base.join(last, "task_id", "left").select("task_id", F.coalesce("r.success", "success").alias("success"), F.coalesce("r.review", "review").alias("review"), F.coalesce("revision_no", F.lit(0)).cast("long").alias("revision_no"))


def next_revision(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("task_id").agg((F.max("revision_no") + 1).alias("next_revision"))


def record_revisions(revisions: DataFrame, *key: str) -> DataFrame:
    """revisions (task_id, key..., seq) with revision_no: numbered from 1 within a task by first appearance; what a task already recorded keeps its number."""
    first = revisions.groupBy("task_id", *key).agg(F.min("seq").alias("_first"))
    first = first.withColumn("revision_no", F.row_number().over(Window.partitionBy("task_id").orderBy("_first"))).drop("_first")
    return revisions.join(first, ["task_id", *key])


def rollback(items: DataFrame, reviews: DataFrame, revisions: DataFrame, revision_no: int) -> DataFrame:
    """items (with task_id) re-decided by the success threshold that revision_no of their task had; tasks without that revision stay as they are."""
    past = revisions.where(F.col("revision_no") == revision_no).groupBy("task_id").agg(F.max("success").alias("_success"))
    human = reviews.select("source_row_id").distinct().withColumn("_human", F.lit(True))
    d = items.join(past, "task_id", "left").join(human, "source_row_id", "left")
    free = F.col("_human").isNull() & F.col("_success").isNotNull()
    d = d.withColumn("current_status", F.when(free, status_for(F.col("top1_score"), F.col("_success"), F.lit(0.0))).otherwise(F.col("current_status")))
    return d.withColumn("final_group_code", F.when(free, F.when(F.col("current_status") == "MATCHED", F.col("top1_group_code"))).otherwise(F.col("final_group_code"))).drop("_human", "_success")


def append_revision(revisions: DataFrame, task_id, success: float, review: float = 0.0, rollback_of: int | None = None) -> DataFrame:
    """The row to append to a task's revisions (task_id, revision_no, success, review, rollback_of): numbers go on from the last."""
    check_thresholds(review, success)
    last = revisions.where(F.col("task_id") == task_id).agg(F.coalesce(F.max("revision_no"), F.lit(0)).alias("n"))
    return last.select(F.lit(task_id).alias("task_id"), (F.col("n") + 1).alias("revision_no"), F.lit(float(success)).alias("success"), F.lit(float(review)).alias("review"), F.lit(rollback_of).cast("long").alias("rollback_of"))


def score_buckets(df: DataFrame, value: str, edges=(0, 20, 40, 60, 70, 80, 88, 95, 100)) -> DataFrame:
    """Counts between edges; the last bucket includes its end."""
    v, b = F.col(value), F.lit(None).cast("double")
    out = None
    for lo, hi in zip(edges, edges[1:]):
        c = (v >= lo) & ((v <= hi) if hi == edges[-1] else (v < hi))
        out = F.when(c, float(lo)) if out is None else out.when(c, float(lo))
    return df.groupBy(out.otherwise(b).alias("bucket")).agg(F.count("*").alias("n"))


