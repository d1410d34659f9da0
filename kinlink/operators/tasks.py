"""Views over tasks, revisions, dictionaries and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run_numbers(tasks: DataFrame, *group: str) -> DataFrame:
    """How often the same thing had run, this one included."""
    w = Window.partitionBy(*group).orderBy("created_at", "task_id")
    return tasks.withColumn("run_number", F.row_number().over(w))


def review_history(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """Item counts by status of every task, with its number within its scheme; tasks without scheme have no number."""
    n = items.groupBy("task_id").agg(F.count("*").alias("n_items"), *[F.count_if(F.col("current_status") == s).alias(s.lower()) for s in ("MATCHED", "REVIEW", "UNMATCHED")])
    d = tasks.join(n, "task_id", "left").na.fill(0, ["n_items", "matched", "review", "unmatched"])
    w = Window.partitionBy("scheme")
    named = F.col("scheme").isNotNull()
    return d.withColumn("sequence", F.when(named, F.row_number().over(w.orderBy("created_at", "task_id")))).withColumn("sequence_total", F.when(named, F.count("*").over(w)))


def latest_version(versions: DataFrame, entity: str = "entity_id", number: str = "version_no") -> DataFrame:
    """Last version of every entity: its whole row."""
    cols = [c for c in versions.columns if c != entity]
    return versions.groupBy(entity).agg(F.max_by(F.struct(*cols), number).alias("r")).select(entity, "r.*")


def duration(start: Column, end: Column) -> tuple[Column, Column]:
    """Milliseconds, and text: h m s with leading zero parts left out."""
    ms = F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
    s = F.floor(ms / 1000)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    text = F.when(ms < 0, F.lit(None).cast("string")).when(h > 0, F.concat(h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m"), (s % 60).cast("string"), F.lit("s"))).when(m > 0, F.concat(m.cast("string"), F.lit("m"), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat((s % 60).cast("string"), F.lit("s")))
    return ms, text


def with_versions(entities: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """Versions with what is known of their entity; versions of unknown entities are left out. `version_place`: 1 for the newest of an entity."""
    w = Window.partitionBy(key).orderBy(F.col("created_at").desc(), F.col("version_id").desc())
    return versions.join(entities, key).withColumn("version_place", F.row_number().over(w))


def task_details(tasks: DataFrame, **parts: DataFrame) -> DataFrame:
    """tasks with the columns of each part (task_id and others) where there is one: lifecycle, actors, runtime, index version. A part's columns are prefixed by its name."""
    for name, part in parts.items():
        tasks = tasks.join(part.select("task_id", *[F.col(c).alias(f"{name}_{c}") for c in part.columns if c != "task_id"]), "task_id", "left")
    return tasks


def claim_next(tasks: DataFrame, waiting=("PENDING", "RECOVERING")) -> DataFrame:
    """tasks (task_id, status, created_at, started_at) with the oldest waiting one being prepared."""
    first = tasks.where(F.col("status").isin(*waiting)).agg(F.min_by("task_id", F.struct("created_at", "task_id")).alias("_claimed"))  # one row
    d = tasks.crossJoin(F.broadcast(first))
    mine = F.col("task_id").eqNullSafe(F.col("_claimed"))
    return d.withColumns({"status": F.when(mine, "PREPARING").otherwise(F.col("status")), "started_at": F.when(mine, F.coalesce("started_at", "created_at")).otherwise(F.col("started_at"))}).drop("_claimed")


def same_children(frozen: DataFrame, bound: DataFrame, key: str, child: str) -> DataFrame:
    """key, same: whether a composite's frozen children and those a run is bound to are the same set."""
    a = frozen.groupBy(key).agg(F.array_sort(F.collect_set(child)).alias("_a"))
    b = bound.groupBy(key).agg(F.array_sort(F.collect_set(child)).alias("_b"))
    return a.join(b, key, "full_outer").select(key, F.col("_a").eqNullSafe(F.col("_b")).alias("same"))


def throughput(progress: DataFrame, window_s: int = 900, most: int = 120) -> DataFrame:
    """progress: task_id, seconds (whole), done, total. Rate since the first sample of the last window_s seconds and the last `most` samples, and remaining seconds."""
    order = Window.partitionBy("task_id").orderBy("seconds", "done")
    d = progress.withColumn("_n", F.row_number().over(order))
    recent = Window.partitionBy("task_id").orderBy("seconds").rangeBetween(-window_s, 0)
    back = most - 1
    d = d.withColumns({"_first": F.min("_n").over(recent), "_ws": F.min("seconds").over(recent), "_wd": F.min_by("done", "_n").over(recent), "_ls": F.lag("seconds", back).over(order), "_ld": F.lag("done", back).over(order)})
    late = F.col("_n") - back > F.col("_first")
    dt, dn = F.col("seconds") - F.when(late, F.col("_ls")).otherwise(F.col("_ws")), F.col("done") - F.when(late, F.col("_ld")).otherwise(F.col("_wd"))
    rate = F.when((dt > 0) & (dn > 0), dn / F.when(dt > 0, dt))
    return d.withColumn("rows_per_second", F.round(rate, 6)).withColumn("eta_seconds", F.when(rate.isNotNull(), F.ceil(F.round((F.col("total") - F.col("done")) / rate, 6)))).drop("_n", "_first", "_ws", "_wd", "_ls", "_ld")


def stale(results: DataFrame, changes: DataFrame) -> DataFrame:
    """Whether anything of a task is newer than its result file."""
    last = changes.groupBy("task_id").agg(F.max("changed_at").alias("last_change"))
    return results.join(last, "task_id", "left").withColumn("stale", F.coalesce(F.col("last_change") > F.col("written_at"), F.lit(False)))


def merge_dictionary(old: DataFrame, new: DataFrame, mode: str = "merge") -> DataFrame:
    """key, value, outcome of merging two (key, value) tables; `replace` drops what only the old one has."""
    j = old.select("key", F.col("value").alias("o")).join(new.select("key", F.col("value").alias("n")), "key", "full_outer")
    out = F.when(F.col("o").isNull(), "ADDED").when(F.col("n").isNull(), "REMOVED" if mode == "replace" else "KEPT").when(F.col("o") == F.col("n"), "SKIPPED").otherwise("UPDATED")
    return j.select("key", F.coalesce("n", "o").alias("value"), out.alias("outcome"))


def first_actor(audit: DataFrame, actions=("CREATE", "START")) -> DataFrame:
    """First event of an entity that carries an actor."""
    d = audit.where(F.col("action").isin(*actions) & F.col("operator").isNotNull())
    return d.groupBy("entity_id").agg(F.min_by(F.struct("operator", "action", "created_at"), F.struct("created_at", "seq")).alias("r")).select("entity_id", "r.operator", "r.action", "r.created_at")


def acceptance(metrics: DataFrame, gates: dict[str, tuple[float, float]]) -> DataFrame:
    """gate, value, outcome of a one-row metrics table: (pass at, block below)."""
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).cast("double").alias("value"), F.when(F.col(g).isNull() | (F.col(g) < lo), "FAIL").when(F.col(g) < hi, "BLOCKED").otherwise("PASS").alias("outcome")) for g, (hi, lo) in gates.items()])
    return metrics.select(F.inline(rows))
