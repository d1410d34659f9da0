"""Human review: an append-only log and the states that follow from it.

log: source_row_id, action, status, group_code, operator, operated_at, seq
(a monotone sequence that breaks ties of operated_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_state(log: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Last entry of each row; rows without one take theirs from `fallback`, of the same columns."""
    w = Window.partitionBy("source_row_id").orderBy(F.col("operated_at").desc(), F.col("seq").desc())
    last = lambda d: d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    out = last(log)
    if fallback is None:
        return out
    return out.unionByName(last(fallback.join(log.select("source_row_id").distinct(), "source_row_id", "left_anti")).select(out.columns))


def latest_review(reviews: DataFrame) -> DataFrame:
    """Operator, action and time of each row's last review, by aggregation alone."""
    return reviews.groupBy("source_row_id").agg(F.max_by(F.struct("operator", "action", "operated_at"), F.struct("operated_at", "seq")).alias("r"), F.count("*").alias("n_reviews")).select("source_row_id", "r.operator", "r.action", "r.operated_at", "n_reviews")


def parse_choice(c: Column) -> Column:
    """Excel choices: `候选N` or `N` -> N, `均不匹配` and its kin -> 0, else null."""
    x = F.regexp_replace(c, r"(?U)\s+", "")
    n = F.regexp_extract(x, r"^(?:候选|candidate|Candidate)?([1-9][0-9]{0,2})(?:\.0)?$", 1)
    return F.when(x.isin("均不匹配", "不匹配", "无匹配", "none", "None"), 0).when(n != "", n.try_cast("int"))


def conflicts(decisions: DataFrame) -> DataFrame:
    """Each row's choices in one batch: applied only where they agree."""
    return decisions.groupBy("source_row_id").agg(F.count("*").alias("n_rows"), F.count_distinct("choice").alias("n_choices"), F.min("choice").alias("choice")).withColumn("outcome", F.when(F.col("n_choices") == 1, "APPLY").otherwise("CONFLICT"))


def bulk_outcomes(decisions: DataFrame, items: DataFrame, candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Outcome of every requested decision (source_row_id, choice, expected_version).

    NOT_FOUND: no such item; CONFLICT: the version moved on; ERROR: no such
    candidate; SKIPPED: the item is already in that state; else SUCCESS.
    """
    d = decisions.join(items.select("source_row_id", "current_status"), "source_row_id", "left")
    d = d.join(state.select("source_row_id", F.col("version").alias("_v"), F.col("group_code").alias("_g")), "source_row_id", "left")
    c = candidates.select("source_row_id", F.col("rank").alias("choice"), F.col("target_group_code").alias("_code"))
    d = d.join(c, ["source_row_id", "choice"], "left")
    out = (
        F.when(F.col("current_status").isNull(), "NOT_FOUND")
        .when(F.coalesce("_v", F.lit(0)) != F.col("expected_version"), "CONFLICT")
        .when((F.col("choice") > 0) & F.col("_code").isNull(), "ERROR")
        .when((F.col("choice") > 0) & F.col("_g").eqNullSafe(F.col("_code")), "SKIPPED")
        .when((F.col("choice") == 0) & (F.col("current_status") == "UNMATCHED"), "SKIPPED")
        .otherwise("SUCCESS")
    )
    return d.select("source_row_id", "choice", out.alias("outcome"))


MATCHES, CANCELS = ("MATCH", "REMATCH", "IMPORT_MATCH"), ("CANCEL_MATCH", "CANCEL_UNMATCHED", "UNDO")


def active_decision(log: DataFrame) -> DataFrame:
    """source_row_id, decision (MATCH or UNMATCHED), code: what the last operation of each row left in force; rows whose last operation cancels have none."""
    last = log.groupBy("source_row_id").agg(F.max_by(F.struct("action", "group_code"), F.struct("operated_at", "seq")).alias("r"))
    kind = F.when(F.col("r.action").isin(*MATCHES), "MATCH").when(F.col("r.action") == "MARK_UNMATCHED", "UNMATCHED")
    return last.select("source_row_id", kind.alias("decision"), F.when(kind == "MATCH", F.col("r.group_code")).alias("code")).where("decision is not null")


def resolved_items(items: DataFrame, log: DataFrame) -> DataFrame:
    """items as the log leaves them: confirmed with the chosen code, unmatched, or, where people decided nothing or took it back, as the match had them."""
    rows = log.select("source_row_id").distinct().withColumn("_touched", F.lit(True))
    d = items.join(rows, "source_row_id", "left").join(active_decision(log), "source_row_id", "left")
    base = F.when(F.col("original_status") == "MATCHED", F.col("top1_group_code"))
    status = F.when(F.col("decision") == "MATCH", "CONFIRMED").when(F.col("decision") == "UNMATCHED", "UNMATCHED").when(F.col("_touched"), F.col("original_status")).otherwise(F.col("current_status"))
    code = F.when(F.col("decision") == "MATCH", F.col("code")).when(F.col("decision") == "UNMATCHED", F.lit(None)).when(F.col("_touched"), base).otherwise(F.col("final_group_code"))
    return d.withColumns({"current_status": status, "final_group_code": code}).drop("decision", "code", "_touched")


def mutation_outcomes(requests: DataFrame, items: DataFrame, candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Outcome of each requested operation (source_row_id, action, group_code) on the state the log leaves.

    NOT_FOUND: no such item, or no candidate with that code; CONFLICT: nothing
    of that kind is in force to change or take back; IDEMPOTENT: already so.
    """
    d = requests.join(items.select("source_row_id", F.lit(True).alias("_item")), "source_row_id", "left").join(active_decision(log), "source_row_id", "left")
    c = candidates.select("source_row_id", F.col("target_group_code").alias("group_code"), F.lit(True).alias("_candidate")).distinct()
    d = d.join(c, ["source_row_id", "group_code"], "left")
    a, now = F.col("action"), F.coalesce("decision", F.lit(""))
    out = (
        F.when(F.col("_item").isNull(), "NOT_FOUND")
        .when((a == "REMATCH") & (now != "MATCH"), "CONFLICT")
        .when(a.isin(*MATCHES) & F.col("_candidate").isNull(), "NOT_FOUND")
        .when(a.isin(*MATCHES) & (now == "MATCH") & (F.col("code") == F.col("group_code")), "IDEMPOTENT")
        .when((a == "MARK_UNMATCHED") & (now == "UNMATCHED"), "IDEMPOTENT")
        .when((a == "CANCEL_MATCH") & (now != "MATCH"), "CONFLICT")
        .when((a == "CANCEL_UNMATCHED") & (now != "UNMATCHED"), "CONFLICT")
        .when((a == "UNDO") & (now == ""), "CONFLICT")
        .otherwise("SUCCESS")
    )
    return d.select(*[F.col(x) for x in requests.columns], out.alias("outcome"))


def import_decisions(rows: DataFrame, task_id: str, items: DataFrame, candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Outcome of every row of a filled-in review workbook: excel_row, task_id, source_row_id, selection.

    Blank selections and repeats of the same choice are SKIPPED, different
    choices for one item a CONFLICT that applies none, unreadable ones and
    those of another task an ERROR; the rest is decided as a review is.
    """
    d = rows.withColumn("_blank", F.coalesce(F.regexp_replace("selection", r"(?U)\s+", ""), F.lit("")) == "").withColumn("choice", parse_choice(F.col("selection")))
    bad = ~F.col("_blank") & (F.col("choice").isNull() | ~F.col("task_id").eqNullSafe(F.lit(task_id)) | F.col("source_row_id").isNull())
    d = d.withColumn("_bad", bad)
    w = Window.partitionBy("source_row_id")
    good = d.where(~F.col("_blank") & ~F.col("_bad")).withColumns({"_first": F.row_number().over(w.orderBy("excel_row")), "_least": F.min("choice").over(w), "_most": F.max("choice").over(w)})
    torn, repeat = F.col("_least") != F.col("_most"), F.col("_first") > 1
    c = candidates.select("source_row_id", F.col("rank").alias("choice"), F.col("target_group_code").alias("group_code")).groupBy("source_row_id", "choice").agg(F.min("group_code").alias("group_code"))
    asked = good.where(~torn & ~repeat).join(c, ["source_row_id", "choice"], "left").withColumn("action", F.when(F.col("choice") == 0, "MARK_UNMATCHED").otherwise("IMPORT_MATCH"))
    done = mutation_outcomes(asked.select("excel_row", "source_row_id", "action", "group_code"), items, candidates, log)
    done = done.select("excel_row", "source_row_id", F.when(F.col("outcome") == "IDEMPOTENT", "SKIPPED").when(F.col("outcome") == "NOT_FOUND", "ERROR").otherwise(F.col("outcome")).alias("outcome"))
    rest = d.where(F.col("_blank") | F.col("_bad")).select("excel_row", "source_row_id", F.when(F.col("_blank"), "SKIPPED").otherwise("ERROR").alias("outcome"))
    return done.unionByName(rest).unionByName(good.where(torn | repeat).select("excel_row", "source_row_id", F.when(torn, "CONFLICT").otherwise("SKIPPED").alias("outcome")))


def _between(d: DataFrame, column: str, bounds: tuple | None) -> DataFrame:
    for low, c in zip(bounds or (), (">=", "<="), strict=False):
        if low is not None:
            d = d.where(f"{column} {c} {float(low)!r}D")
    return d


def workbench(items: DataFrame, candidates: DataFrame, status: str | None = "REVIEW", search: str | None = None, scores: tuple | None = None, seconds: tuple | None = None, gaps: tuple | None = None, conflict: bool | None = None) -> DataFrame:
    """Rows that pass the filters; status ALL or None lets every status pass.

    `search` is an ASCII-case-insensitive LIKE, wildcards live, over id,
    payload, first and final code, and over code and payload of candidates of
    rank 5 or better. Ranges are (least, most), either may be None.
    """
    d = items if status in (None, "ALL") else items.where(F.col("current_status") == status)
    for r, c in ((scores, "top1_score"), (seconds, "second_score"), (gaps, "score_gap")):
        d = _between(d, c, r)
    if conflict is not None:
        d = d.where(F.col("critical_conflict") == conflict)
    q = (search or "").strip()
    if not q:
        return d
    like = lambda df, names: _any(F.coalesce(F.col(c).cast("string").ilike(f"%{q}%"), F.lit(False)) for c in names if c in df.columns)
    hit = candidates.where((F.col("rank") <= 5) & like(candidates, ("target_group_code", "target_payload"))).select("source_row_id").distinct().withColumn("_hit", F.lit(True))
    return d.join(hit, "source_row_id", "left").where(F.col("_hit").isNotNull() | like(d, ("source_id", "source_payload", "top1_group_code", "final_group_code"))).drop("_hit")


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def review_list(items: DataFrame, search: str | None = None, scores: tuple | None = None, seconds: tuple | None = None, gaps: tuple | None = None, conflict: bool | None = None, page_no: int = 1, size: int = 50) -> DataFrame:
    """The plain list of rows to review: search over id, payload and first code alone; by falling score, then id."""
    d = items.where("current_status = 'REVIEW'")
    for r, c in ((scores, "top1_score"), (seconds, "second_score"), (gaps, "score_gap")):
        d = _between(d, c, r)
    if conflict is not None:
        d = d.where(F.col("critical_conflict") == conflict)
    if q := (search or "").strip():
        d = d.where(_any(F.coalesce(F.col(c).cast("string").ilike(f"%{q}%"), F.lit(False)) for c in ("source_id", "source_payload", "top1_group_code") if c in d.columns))
    return d.orderBy(F.col("top1_score").desc_nulls_last(), "source_row_id").offset((page_no - 1) * size).limit(size)


def selection_count(items: DataFrame, ids: DataFrame) -> DataFrame:
    """How many of the requested rows (source_row_id) exist, and how many different ones were requested."""
    asked = ids.select("source_row_id").distinct()
    return asked.join(items.select("source_row_id", F.lit(1).alias("_one")), "source_row_id", "left").agg(F.count("_one").alias("count"), F.count("*").alias("requested_count"))


def page_candidates(rows: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """Candidates of rank `most` or better of the rows of a page (which is small, and broadcast by its limit)."""
    return candidates.where(F.col("rank") <= most).join(rows.select("source_row_id"), "source_row_id", "left_semi")


def log_page(log: DataFrame, offset: int = 0, limit: int = 200, row=None) -> DataFrame:
    """A page of the operation log, newest first; of one row if given."""
    d = log if row is None else log.where(F.col("source_row_id") == row)
    return d.orderBy(F.col("operated_at").desc(), F.col("seq").desc()).offset(offset).limit(limit)


def page(items: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page by falling score, then row number (null last), then id as text."""
    return items.orderBy(F.col("top1_score").desc_nulls_last(), F.coalesce("source_row_number", F.lit(2147483647)), F.col("source_row_id").cast("string")).offset(offset).limit(limit)


def live(items: DataFrame, n: int) -> DataFrame:
    return items.orderBy(F.col("seq").desc()).limit(n)


def method_label(status: Column, reviewed: Column) -> Column:
    return F.when(reviewed & (status == "MATCHED"), "MANUAL_MATCH").when(reviewed, "MANUAL_REJECT").when(status == "MATCHED", "AUTO_MATCH").when(status == "REVIEW", "PENDING_REVIEW").otherwise("NO_MATCH")


def display_mapping(payload: Column, mapping: dict[str, dict[str, str]]) -> Column:
    """Payload map with values replaced by their display form, looked up by the trimmed value of each mapped field."""
    def one(k, v):
        out = v
        for field, table in mapping.items():
            pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
            out = F.when(k == field, F.coalesce(F.try_element_at(pairs, F.trim(v)), v)).otherwise(out)
        return out

    return F.transform_values(payload, one)


def restore(items: DataFrame) -> DataFrame:
    """Back to the statuses the match gave."""
    return items.withColumn("final_group_code", F.when(F.col("original_status") == "MATCHED", F.col("top1_group_code"))).withColumn("current_status", F.col("original_status"))
