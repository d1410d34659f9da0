"""Queries of decision analytics, review, evaluation, task views and exports.

Orders stand for match items, their lines for candidates, events for the review
log and the audit trail, customers for ground truth. All tables enter whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlink.operators import calibration, evaluation, exports, review, tasks
from kinlink.queries import query


def items(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    top = F.round(F.col("o_totalprice") / 5000, 6)
    second = F.greatest(F.round(top - (F.col("o_orderkey") % 50) / 4, 6), F.lit(0.0))
    status = F.when(F.col("o_orderstatus") == "F", "MATCHED").when(F.col("o_orderstatus") == "O", "REVIEW").otherwise("UNMATCHED")
    code = (F.col("o_custkey") % 97).cast("string")
    return o.select(
        F.col("o_orderkey").alias("source_row_id"), F.col("o_custkey").cast("string").alias("source_id"), F.col("o_orderkey").alias("source_row_number"), status.alias("current_status"), status.alias("original_status"), top.alias("top1_score"), second.alias("second_score"), F.round(top - second, 6).alias("score_gap"), code.alias("top1_group_code"),
        F.when(status == "MATCHED", code).alias("final_group_code"), (F.col("o_orderpriority") == "1-URGENT").alias("critical_conflict"), (F.col("o_custkey") % 20).alias("task_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("source_payload"),
    )


def candidates(spark, d, *more):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    f = lambda i, v, w: F.struct(F.lit(i).alias("rule_id"), F.when(v < 0.3, 0.0).otherwise(v).alias("score"), F.lit(w).alias("weight"), (v < 0.3).alias("vetoed"), v.alias("score_before_veto"))
    return line.select(F.col("l_orderkey").alias("source_row_id"), F.col("l_linenumber").alias("rank"), (F.col("l_partkey") % 97).cast("string").alias("target_group_code"), F.col("l_partkey").alias("target_row_number"), (F.col("l_quantity") * 2).alias("score"), F.col("l_returnflag").alias("kind"), F.concat("l_returnflag", "l_linestatus").alias("target_payload"), F.array(f("a", F.col("l_discount") * 10, 60), f("b", F.col("l_tax") * 12.5, 40)).alias("field_scores"), *more)


def log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("source_row_id"), F.col("event_type").alias("action"), F.concat(F.lit("op"), (F.col("event_id") % 7).cast("string")).alias("operator"), F.col("ts").alias("operated_at"), F.col("event_id").alias("seq"), (F.col("event_id") % 97).cast("string").alias("group_code"))


def reviews(spark, d):
    return log(spark, d).where("action = 'error'")


I = "items AS (SELECT *, CASE WHEN current_status = 'MATCHED' THEN top1_group_code END AS final_group_code, round(top1_score - second_score, 6) AS score_gap FROM (SELECT *, greatest(round(top1_score - (source_row_id % 50) / 4.0::DOUBLE, 6), 0.0) AS second_score FROM (SELECT o_orderkey AS source_row_id, CAST(o_custkey AS VARCHAR) AS source_id, CASE o_orderstatus WHEN 'F' THEN 'MATCHED' WHEN 'O' THEN 'REVIEW' ELSE 'UNMATCHED' END AS current_status, round(o_totalprice / 5000, 6) AS top1_score, CAST(o_custkey % 97 AS VARCHAR) AS top1_group_code, o_orderpriority = '1-URGENT' AS critical_conflict, o_custkey % 20 AS task_id, o_orderdate AS created_at, o_orderpriority AS source_payload FROM orders)))"  # noqa: E741
C = "cands AS (SELECT l_orderkey AS source_row_id, l_linenumber AS rank, CAST(l_partkey % 97 AS VARCHAR) AS target_group_code, l_partkey AS target_row_number, l_quantity * 2 AS score, l_returnflag AS kind, l_returnflag || l_linestatus AS target_payload, l_discount * 10 AS a, l_tax * 12.5 AS b FROM lineitem)"
L = "log AS (SELECT user_id AS source_row_id, event_type AS action, 'op' || (event_id % 7) AS operator, ts AS operated_at, event_id AS seq, CAST(event_id % 97 AS VARCHAR) AS group_code FROM events)"
FREE = "free AS (SELECT * FROM items WHERE source_row_id NOT IN (SELECT source_row_id FROM log WHERE action = 'error'))"


def new_status(success, low):
    return f"CASE WHEN top1_score >= {success} THEN 'MATCHED' WHEN top1_score > 0 AND top1_score >= {low} THEN 'REVIEW' ELSE 'UNMATCHED' END"


@query("status_summary", f"WITH {I} SELECT count(*) AS total, count(*) FILTER (current_status = 'MATCHED') AS matched, count(*) FILTER (current_status = 'REVIEW') AS review, count(*) FILTER (current_status = 'UNMATCHED') AS unmatched FROM items")
def status_summary(spark, d):
    return calibration.status_summary(items(spark, d))


@query("redecide_preview", f"WITH {I}, {L}, {FREE} SELECT current_status AS old_status, {new_status(76, 55)} AS new_status, count(*) AS n FROM free GROUP BY 1, 2")
def redecide_preview(spark, d):
    return calibration.preview(items(spark, d), reviews(spark, d), 76, 55)


@query("redecide_summary", f"WITH {I}, {L}, x AS (SELECT current_status, source_row_id IN (SELECT source_row_id FROM log WHERE action = 'error') AS human, {new_status(76, 55)} AS new FROM items), y AS (SELECT *, CASE WHEN human THEN current_status ELSE new END AS now FROM x) SELECT " + ", ".join(f"count(*) FILTER (current_status = '{s}') AS before_{s.lower()}, count(*) FILTER (now = '{s}') AS after_{s.lower()}, count(*) FILTER (now = '{s}') - count(*) FILTER (current_status = '{s}') AS {s.lower()}_delta" for s in ("MATCHED", "REVIEW", "UNMATCHED")) + ", count(*) FILTER (now <> current_status) AS affected_rows, count(*) FILTER (human) AS human_protected FROM y")
def redecide_summary(spark, d):
    return calibration.preview_summary(items(spark, d), reviews(spark, d), 76, 55)


@query("redecide_rollback", f"WITH {I}, {L}, past AS (SELECT user_id % 20 AS task_id, max(CAST(60 + event_id % 40 AS DOUBLE)) AS s FROM events WHERE user_id % 20 < 15 AND event_id % 50 = 7 GROUP BY 1), x AS (SELECT i.*, s, s IS NOT NULL AND i.source_row_id NOT IN (SELECT source_row_id FROM log WHERE action = 'error') AS is_free FROM items i LEFT JOIN past ON past.task_id = i.task_id), y AS (SELECT *, CASE WHEN is_free THEN CASE WHEN top1_score >= s THEN 'MATCHED' WHEN top1_score > 0 THEN 'REVIEW' ELSE 'UNMATCHED' END ELSE current_status END AS now FROM x) SELECT source_row_id, now AS current_status, CASE WHEN is_free THEN CASE WHEN now = 'MATCHED' THEN top1_group_code END ELSE final_group_code END AS final_group_code FROM y")
def redecide_rollback(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("user_id % 20 < 15")
    r = e.select((F.col("user_id") % 20).alias("task_id"), (F.col("event_id") % 50).alias("revision_no"), (60 + F.col("event_id") % 40).cast("double").alias("success"))
    return calibration.rollback(items(spark, d), reviews(spark, d), r, 7).select("source_row_id", "current_status", "final_group_code")


@query("revision_numbers", "WITH r AS (SELECT user_id % 20 AS task_id, event_type || (event_id % 3) AS file, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT task_id, file, CAST(row_number() OVER (PARTITION BY task_id ORDER BY f) AS INTEGER) AS revision_no FROM r")
def revision_numbers(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 20).alias("task_id"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("file"), F.col("event_id").alias("seq"))
    return calibration.record_revisions(e, "file").select("task_id", "file", "revision_no").distinct()


SCENARIOS = [(50 + 5 * i, 5 * i) for i in range(10)]


@query("batch_threshold_preview", f"WITH {I}, {L}, {FREE}, s AS (SELECT CAST(i AS INTEGER) AS scenario, CAST(50 + 5 * i AS DOUBLE) AS success, CAST(5 * i AS DOUBLE) AS review FROM range(0, 10) t(i)), x AS (SELECT s.*, current_status, {new_status('success', 'review')} AS new FROM free, s) SELECT scenario, success, review, count(*) FILTER (new = 'MATCHED') AS matched, count(*) FILTER (new = 'REVIEW') AS review_n, count(*) FILTER (new = 'UNMATCHED') AS unmatched, count(*) FILTER (new <> current_status) AS changed FROM x GROUP BY 1, 2, 3")
def batch_threshold_preview(spark, d):
    b = calibration.batch_preview(items(spark, d), reviews(spark, d), SCENARIOS)
    return b.toDF("scenario", "success", "review", "matched", "review_n", "unmatched", "changed")


def hist_sql(c):
    return f"WITH {I} SELECT CAST(b AS INTEGER) AS bucket, count(items.{c}) AS n FROM range(0, 100, 10) r(b) LEFT JOIN items ON b = CASE WHEN {c} < 0 THEN 0 WHEN {c} >= 100 THEN 90 ELSE floor({c} / 10) * 10 END GROUP BY 1"


@query("score_histogram", hist_sql("top1_score"))
def score_histogram(spark, d):
    return calibration.histogram(items(spark, d), "top1_score")


@query("gap_histogram", hist_sql("score_gap"))
def gap_histogram(spark, d):
    return calibration.histogram(items(spark, d), "score_gap")


@query("human_protected_count", f"WITH {I}, {L} SELECT count(*) AS human_protected FROM items WHERE source_row_id IN (SELECT source_row_id FROM log WHERE action = 'error')")
def human_protected_count(spark, d):
    return calibration.protected_count(items(spark, d), reviews(spark, d))


@query("redecide_apply", f"WITH {I}, {L}, h AS (SELECT DISTINCT source_row_id FROM log WHERE action = 'error'), x AS (SELECT items.source_row_id, items.current_status AS old, items.final_group_code AS code, top1_group_code, h.source_row_id IS NULL AS is_free, {new_status(76, 0)} AS new FROM items LEFT JOIN h ON h.source_row_id = items.source_row_id) SELECT source_row_id, CASE WHEN is_free THEN new ELSE old END AS current_status, CASE WHEN is_free THEN CASE WHEN new = 'MATCHED' THEN top1_group_code END ELSE code END AS final_group_code FROM x")
def redecide_apply(spark, d):
    return calibration.apply(items(spark, d), reviews(spark, d), 76).select("source_row_id", "current_status", "final_group_code")


@query("current_thresholds", "WITH r AS (SELECT user_id % 20 AS task_id, event_id AS revision_no, CAST(60 + event_id % 40 AS DOUBLE) AS success, CAST(event_id % 60 AS DOUBLE) AS review FROM events WHERE user_id % 20 < 15), l AS (SELECT task_id, max(revision_no) AS revision_no, arg_max(success, revision_no) AS success, arg_max(review, revision_no) AS review FROM r GROUP BY 1) SELECT t.task_id, coalesce(l.success, 88.0) AS success, coalesce(l.review, 0.0) AS review, CAST(coalesce(l.revision_no, 0) AS BIGINT) AS revision_no FROM range(0, 20) t(task_id) LEFT JOIN l ON l.task_id = t.task_id")
def current_thresholds(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    r = e.where("user_id % 20 < 15").select((F.col("user_id") % 20).alias("task_id"), F.col("event_id").alias("revision_no"), (60 + F.col("event_id") % 40).cast("double").alias("success"), (F.col("event_id") % 60).cast("double").alias("review"))
    base = spark.range(20).select(F.col("id").alias("task_id"), F.lit(88.0).alias("success"), F.lit(0.0).alias("review"))
    return calibration.current_thresholds(base, r)


@query("latest_manual_state", f"WITH {L} SELECT source_row_id, action, operator, group_code FROM log QUALIFY row_number() OVER (PARTITION BY source_row_id ORDER BY operated_at DESC, seq DESC) = 1")
def latest_manual_state(spark, d):
    return review.latest_state(log(spark, d)).select("source_row_id", "action", "operator", "group_code")


@query("latest_review_per_item", f"WITH {L} SELECT source_row_id, arg_max(operator, struct_pack(a := operated_at, b := seq)) AS operator, arg_max(action, struct_pack(a := operated_at, b := seq)) AS action, count(*) AS n_reviews FROM log GROUP BY 1")
def latest_review_per_item(spark, d):
    return review.latest_review(log(spark, d)).select("source_row_id", "operator", "action", "n_reviews")


@query("decision_conflicts", "WITH x AS (SELECT user_id AS source_row_id, event_id % 3 AS choice FROM events WHERE event_type = 'click') SELECT source_row_id, count(*) AS n_rows, count(DISTINCT choice) AS n_choices, min(choice) AS choice, CASE WHEN count(DISTINCT choice) = 1 THEN 'APPLY' ELSE 'CONFLICT' END AS outcome FROM x GROUP BY 1")
def decision_conflicts(spark, d):
    return review.conflicts(log(spark, d).where("action = 'click'").select("source_row_id", (F.col("seq") % 3).alias("choice")))


@query("bulk_apply_outcomes", f"WITH {I}, {C}, {L}, st AS (SELECT source_row_id, count(*) % 3 AS version, max(group_code) AS g FROM log GROUP BY 1), dec AS (SELECT user_id AS source_row_id, CAST(event_id % 9 AS INTEGER) AS choice, event_id % 3 AS expected_version FROM events) SELECT dec.source_row_id, dec.choice, CASE WHEN current_status IS NULL THEN 'NOT_FOUND' WHEN coalesce(version, 0) <> expected_version THEN 'CONFLICT' WHEN dec.choice > 0 AND target_group_code IS NULL THEN 'ERROR' WHEN dec.choice > 0 AND g IS NOT DISTINCT FROM target_group_code THEN 'SKIPPED' WHEN dec.choice = 0 AND current_status = 'UNMATCHED' THEN 'SKIPPED' ELSE 'SUCCESS' END AS outcome FROM dec LEFT JOIN items USING (source_row_id) LEFT JOIN st ON st.source_row_id = dec.source_row_id LEFT JOIN (SELECT source_row_id, rank, min(target_group_code) AS target_group_code FROM cands GROUP BY 1, 2) c ON c.source_row_id = dec.source_row_id AND c.rank = dec.choice")
def bulk_apply_outcomes(spark, d):
    t = log(spark, d)
    st = t.groupBy("source_row_id").agg((F.count("*") % 3).alias("version"), F.max("group_code").alias("group_code"))
    dec = t.select("source_row_id", (F.col("seq") % 9).cast("int").alias("choice"), (F.col("seq") % 3).alias("expected_version"))
    c = candidates(spark, d).groupBy("source_row_id", "rank").agg(F.min("target_group_code").alias("target_group_code"))
    return review.bulk_outcomes(dec, items(spark, d), c, st)


LIKE = "(source_id ILIKE '%ro%' OR source_payload ILIKE '%ro%' OR top1_group_code ILIKE '%ro%' OR coalesce(final_group_code, '') ILIKE '%ro%' OR source_row_id IN (SELECT source_row_id FROM cands WHERE rank <= 5 AND (target_group_code ILIKE '%ro%' OR target_payload ILIKE '%ro%')))"


@query("workbench_filter", f"WITH {I}, {C} SELECT source_row_id FROM items WHERE current_status = 'REVIEW' AND top1_score BETWEEN 20 AND 80 AND second_score <= 70 AND score_gap >= 0.5 AND critical_conflict = false AND {LIKE}")
def workbench_filter(spark, d):
    return review.workbench(items(spark, d), candidates(spark, d), "REVIEW", "ro", (20, 80), (None, 70), (0.5, None), False).select("source_row_id")


@query("review_list", f"WITH {I} SELECT source_row_id, top1_score FROM items WHERE current_status = 'REVIEW' AND second_score >= 10 AND (source_id ILIKE '%3-M%' OR source_payload ILIKE '%3-M%' OR top1_group_code ILIKE '%3-M%') ORDER BY top1_score DESC, source_row_id LIMIT 50 OFFSET 50")
def review_list(spark, d):
    return review.review_list(items(spark, d), "3-M", seconds=(10, None), page_no=2).select("source_row_id", "top1_score")


@query("selection_count", f"WITH {I}, a AS (SELECT DISTINCT c_custkey * 3 AS source_row_id FROM customer) SELECT count(i.source_row_id) AS count, count(*) AS requested_count FROM a LEFT JOIN items i USING (source_row_id)")
def selection_count(spark, d):
    return review.selection_count(items(spark, d), spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") * 3).alias("source_row_id")))


@query("page_candidates", f"WITH {I}, {C}, p AS (SELECT source_row_id FROM items ORDER BY top1_score DESC NULLS LAST, source_row_id LIMIT 50 OFFSET 100) SELECT source_row_id, rank, target_group_code, score FROM cands WHERE rank <= 3 AND source_row_id IN (SELECT source_row_id FROM p)")
def page_candidates(spark, d):
    return review.page_candidates(review.page(items(spark, d), 100, 50), candidates(spark, d), 3).select("source_row_id", "rank", "target_group_code", "score")


@query("operation_log_page", f"WITH {L} SELECT seq, source_row_id, action FROM log ORDER BY operated_at DESC, seq DESC LIMIT 20 OFFSET 10")
def operation_log_page(spark, d):
    return review.log_page(log(spark, d), 10, 20).select("seq", "source_row_id", "action")


ACTIONS = {"click": "MATCH", "view": "MARK_UNMATCHED", "signup": "REMATCH", "purchase": "UNDO", "error": "IMPORT_MATCH"}


def operations(spark, d):
    """The review log with operations for its actions, and items' candidates as what they chose."""
    a = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return log(spark, d).withColumn("action", a[F.col("action")]).withColumn("group_code", (F.col("seq") % 5).cast("string"))


OPS = "ops AS (SELECT user_id AS source_row_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " END AS action, ts AS operated_at, event_id AS seq, CAST(event_id % 5 AS VARCHAR) AS group_code FROM events)"
M3 = "('MATCH', 'REMATCH', 'IMPORT_MATCH')"


def active_sql(where="true"):
    return f"act AS (SELECT source_row_id, CASE WHEN a IN {M3} THEN 'MATCH' WHEN a = 'MARK_UNMATCHED' THEN 'UNMATCHED' END AS decision, CASE WHEN a IN {M3} THEN g END AS code FROM (SELECT source_row_id, arg_max(action, struct_pack(a := operated_at, b := seq)) AS a, arg_max(group_code, struct_pack(a := operated_at, b := seq)) AS g FROM ops WHERE {where} GROUP BY 1))"


@query("resolved_items", f"WITH {I}, {OPS}, {active_sql()} SELECT i.source_row_id, CASE WHEN decision = 'MATCH' THEN 'CONFIRMED' WHEN decision = 'UNMATCHED' THEN 'UNMATCHED' ELSE current_status END AS current_status, CASE WHEN decision = 'MATCH' THEN code WHEN decision = 'UNMATCHED' THEN NULL ELSE final_group_code END AS final_group_code FROM items i LEFT JOIN act ON act.source_row_id = i.source_row_id")
def resolved_items(spark, d):
    return review.resolved_items(items(spark, d), operations(spark, d)).select("source_row_id", "current_status", "final_group_code")


SMALL = "sc AS (SELECT DISTINCT l_orderkey AS source_row_id, CAST(l_partkey % 5 AS VARCHAR) AS group_code FROM lineitem)"


def few_codes(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    return line.select(F.col("l_orderkey").alias("source_row_id"), F.col("l_linenumber").alias("rank"), (F.col("l_partkey") % 5).cast("string").alias("target_group_code"))


@query("mutation_outcomes", f"WITH {I}, {OPS}, {active_sql('seq % 2 = 0')}, {SMALL}, r AS (SELECT * FROM ops WHERE seq % 2 = 1), j AS (SELECT r.seq, r.source_row_id, action, i.source_row_id IS NOT NULL AS item, sc.group_code IS NOT NULL AS cand, coalesce(decision, '') AS now, code, r.group_code FROM r LEFT JOIN items i ON i.source_row_id = r.source_row_id LEFT JOIN act ON act.source_row_id = r.source_row_id LEFT JOIN sc ON sc.source_row_id = r.source_row_id AND sc.group_code = r.group_code) SELECT seq, source_row_id, action, CASE WHEN NOT item THEN 'NOT_FOUND' WHEN action = 'REMATCH' AND now <> 'MATCH' THEN 'CONFLICT' WHEN action IN {M3} AND NOT cand THEN 'NOT_FOUND' WHEN action IN {M3} AND now = 'MATCH' AND code = group_code THEN 'IDEMPOTENT' WHEN action = 'MARK_UNMATCHED' AND now = 'UNMATCHED' THEN 'IDEMPOTENT' WHEN action = 'UNDO' AND now = '' THEN 'CONFLICT' ELSE 'SUCCESS' END AS outcome FROM j")
def mutation_outcomes(spark, d):
    o = operations(spark, d)
    return review.mutation_outcomes(o.where("seq % 2 = 1").select("seq", "source_row_id", "action", "group_code"), items(spark, d), few_codes(spark, d), o.where("seq % 2 = 0")).select("seq", "source_row_id", "action", "outcome")


@query("workbook_import", f"WITH {I}, {OPS}, {active_sql()}, c AS (SELECT l_orderkey AS source_row_id, l_linenumber AS choice, min(CAST(l_partkey % 5 AS VARCHAR)) AS group_code FROM lineitem GROUP BY 1, 2), w AS (SELECT p_partkey AS excel_row, CASE WHEN p_partkey % 11 = 0 THEN 'other' ELSE 't' END AS task_id, p_partkey % 1500 AS source_row_id, p_partkey % 4 = 3 AND p_size < 10 AS blank, CASE p_partkey % 4 WHEN 0 THEN p_size % 3 + 1 WHEN 1 THEN p_size % 3 + 1 WHEN 2 THEN 0 END AS choice FROM part), good AS (SELECT *, row_number() OVER (PARTITION BY source_row_id ORDER BY excel_row) AS k, min(choice) OVER (PARTITION BY source_row_id) AS lo, max(choice) OVER (PARTITION BY source_row_id) AS hi FROM w WHERE NOT blank AND choice IS NOT NULL AND task_id = 't'), j AS (SELECT g.excel_row, g.source_row_id, CASE WHEN lo <> hi THEN 'CONFLICT' WHEN k > 1 THEN 'SKIPPED' WHEN i.source_row_id IS NULL THEN 'ERROR' WHEN g.choice > 0 AND c.group_code IS NULL THEN 'ERROR' WHEN g.choice > 0 AND decision = 'MATCH' AND code = c.group_code THEN 'SKIPPED' WHEN g.choice = 0 AND decision = 'UNMATCHED' THEN 'SKIPPED' ELSE 'SUCCESS' END AS outcome FROM good g LEFT JOIN items i ON i.source_row_id = g.source_row_id LEFT JOIN c ON c.source_row_id = g.source_row_id AND c.choice = g.choice LEFT JOIN act ON act.source_row_id = g.source_row_id) SELECT * FROM j UNION ALL SELECT excel_row, source_row_id, CASE WHEN blank THEN 'SKIPPED' ELSE 'ERROR' END FROM w WHERE blank OR choice IS NULL OR task_id <> 't'")
def workbook_import(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    k, n = F.col("p_partkey") % 4, (F.col("p_size") % 3 + 1).cast("string")
    text = F.when(k == 0, F.concat(F.lit(" 候选 "), n)).when(k == 1, n).when(k == 2, "均不匹配").when(F.col("p_size") < 10, " ").otherwise(F.col("p_name"))
    rows = p.select(F.col("p_partkey").alias("excel_row"), F.when(F.col("p_partkey") % 11 == 0, "other").otherwise("t").alias("task_id"), (F.col("p_partkey") % 1500).alias("source_row_id"), text.alias("selection"))
    return review.import_decisions(rows, "t", items(spark, d), few_codes(spark, d), operations(spark, d))


@query("workbench_page", f"WITH {I} SELECT source_row_id, top1_score FROM items ORDER BY top1_score DESC NULLS LAST, source_row_id LIMIT 50 OFFSET 100")
def workbench_page(spark, d):
    return review.page(items(spark, d), 100, 50).select("source_row_id", "top1_score")


@query("live_results", f"WITH {I} SELECT source_row_id, current_status FROM items ORDER BY source_row_id DESC LIMIT 20")
def live_results(spark, d):
    return review.live(items(spark, d), 20).select("source_row_id", "current_status")


@query("parse_review_choice", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN 0 END AS choice FROM part")
def parse_review_choice(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    return p.select("p_partkey", review.parse_choice(F.when(k == 0, F.concat(F.lit(" 候选 "), n)).when(k == 1, n).when(k == 2, "均不匹配").otherwise(F.col("p_name"))).alias("choice"))


def truth(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    yes = F.col("c_acctbal") >= 0
    return c.select(F.col("c_custkey").cast("string").alias("truth_key"), F.when(yes, "MATCH").otherwise("NO_MATCH").alias("expected"), F.when(yes, (F.col("c_custkey") % 97).cast("string")).alias("expected_code"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))


def judged(spark, d):
    """Each customer's last order as its item, with a code that is right for two in three."""
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey").alias("o"))
    code = ((F.col("o_custkey") + F.when(F.col("o.o_orderkey") % 3 == 0, 1).otherwise(0)) % 97).cast("string")
    st = F.when(F.col("o.o_orderstatus") == "F", "MATCHED").when(F.col("o.o_orderstatus") == "O", "REVIEW").otherwise("UNMATCHED")
    it = o.select(F.col("o_custkey").cast("string").alias("source_id"), F.col("o.o_orderkey").alias("k"), st.alias("current_status"), F.when(F.col("o.o_orderkey") % 7 == 0, "REVIEW").otherwise(st).alias("original_status"), code.alias("top1_group_code"), F.when(st == "MATCHED", code).alias("final_group_code"), F.round(F.col("o.o_totalprice") / 5000, 6).alias("top1_score"))
    line = spark.read.parquet(f"{d}/lineitem.parquet").join(it.select("source_id", F.col("k").alias("l_orderkey")), "l_orderkey")
    c = line.select("source_id", F.col("l_linenumber").alias("rank"), ((F.col("source_id").cast("long") + F.col("l_partkey") % 3) % 97).cast("string").alias("target_group_code"))
    t = truth(spark, d)
    return evaluation.evaluation_items(t, it, c).join(t.select("truth_key", "segment"), "truth_key")


EV = """t AS (SELECT CAST(c_custkey AS VARCHAR) AS truth_key, c_custkey AS ck, CASE WHEN c_acctbal >= 0 THEN 'MATCH' ELSE 'NO_MATCH' END AS expected, CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey % 97 AS VARCHAR) END AS expected_code, c_mktsegment AS segment FROM customer),
it AS (SELECT *, CAST((ck2 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) % 97 AS VARCHAR) AS top1_group_code, CASE st WHEN 'F' THEN 'MATCHED' WHEN 'O' THEN 'REVIEW' ELSE 'UNMATCHED' END AS current_status, CASE WHEN k % 7 = 0 THEN 'REVIEW' WHEN st = 'F' THEN 'MATCHED' WHEN st = 'O' THEN 'REVIEW' ELSE 'UNMATCHED' END AS original_status FROM (SELECT o_custkey AS ck2, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS st, round(arg_max(o_totalprice, o_orderkey) / 5000, 6) AS top1_score FROM orders GROUP BY 1)),
rk AS (SELECT ck2, CAST((ck2 + l_partkey % 3) % 97 AS VARCHAR) AS code, min(l_linenumber) AS expected_rank FROM it JOIN lineitem ON l_orderkey = k GROUP BY 1, 2),
ev AS (SELECT truth_key, expected, expected_code, segment, current_status, original_status, top1_group_code, CASE WHEN current_status = 'MATCHED' THEN top1_group_code END AS final_group_code, top1_score, expected_rank, CASE WHEN current_status IS NULL THEN 0 ELSE 1 END AS matched_task_row,
CASE WHEN expected = 'MATCH' AND top1_group_code = expected_code THEN 1 ELSE 0 END AS top1_correct, CASE WHEN expected = 'MATCH' THEN CASE WHEN current_status = 'MATCHED' AND top1_group_code = expected_code THEN 1 ELSE 0 END WHEN current_status = 'UNMATCHED' THEN 1 ELSE 0 END AS final_correct
FROM t LEFT JOIN it ON it.ck2 = t.ck LEFT JOIN rk ON rk.ck2 = t.ck AND rk.code = t.expected_code)"""


@query("evaluation_items", f"WITH {EV} SELECT truth_key, expected, expected_code, current_status, top1_group_code, final_group_code, expected_rank, matched_task_row, top1_correct, final_correct FROM ev")
def evaluation_items(spark, d):
    return judged(spark, d).select("truth_key", "expected", "expected_code", "current_status", "top1_group_code", "final_group_code", "expected_rank", "matched_task_row", "top1_correct", "final_correct")


def rsql(a, b):
    return f"CASE WHEN ({b}) > 0 THEN round(({a})::DOUBLE / ({b}), 6) ELSE 0.0 END"


def csql(x):
    return f"count(*) FILTER ({x})"


H, M = "matched_task_row = 1", "matched_task_row = 1 AND expected = 'MATCH'"
N = "matched_task_row = 1 AND expected <> 'MATCH'"
OK = "current_status = 'MATCHED' AND final_group_code = expected_code"


@query("evaluation_metrics", f"WITH {EV} SELECT count(*) AS truth_rows, {csql(H)} AS evaluated_rows, {csql(M)} AS match_rows, {csql(N)} AS no_match_rows, {rsql(csql(H), 'count(*)')} AS coverage, {rsql(csql(M + ' AND top1_correct = 1'), csql(M))} AS top1_accuracy, {rsql(csql(H + ' AND final_correct = 1'), csql(H))} AS final_accuracy, {csql(H + chr(32) + 'AND current_status = ' + repr('MATCHED'))} AS auto_rows, {rsql(csql(M + ' AND ' + OK), csql(H + ' AND current_status = ' + repr('MATCHED')))} AS auto_precision, {rsql(csql(M + ' AND ' + OK), csql(M))} AS auto_recall, {csql(H + ' AND current_status = ' + repr('REVIEW'))} AS review_rows, {rsql(csql(H + ' AND current_status = ' + repr('REVIEW')), csql(H))} AS review_rate, {csql(H + ' AND current_status = ' + repr('UNMATCHED'))} AS unmatched_rows, {rsql(csql(N + ' AND current_status = ' + repr('MATCHED')), csql(N))} AS no_match_false_positive_rate, {rsql(csql(N + ' AND current_status <> ' + repr('MATCHED')), csql(N))} AS no_match_rejection_rate, " + ", ".join(f"{rsql(csql(M + f' AND expected_rank <= {k}'), csql(M))} AS recall_at_{k}" for k in (1, 3, 5, 10)) + " FROM ev")
def evaluation_metrics(spark, d):
    return evaluation.metrics(judged(spark, d))


def full_sql():
    was, now = (lambda x: f"{H} AND original_status = '{x}'"), (lambda x: f"{H} AND current_status = '{x}'")
    right, final = "expected = 'MATCH' AND top1_group_code = expected_code", "final_group_code IS NOT NULL"
    n, nm, nn = csql(H), csql(M), csql(N)
    top, done, tn = csql(H + " AND top1_correct = 1"), csql(H + " AND final_correct = 1"), csql(N + " AND final_correct = 1")
    fp = csql(N + f" AND (current_status IN ('MATCHED', 'CONFIRMED') OR {final})")
    resolved = csql(H + f" AND ({final} OR (expected <> 'MATCH' AND current_status = 'UNMATCHED'))")
    auto, auto_ok, cur, cur_ok = csql(was("MATCHED")), csql(was("MATCHED") + " AND " + right), csql(now("MATCHED")), csql(now("MATCHED") + " AND " + right)
    counts = {"truth_rows": "count(*)", "evaluated_rows": n, "positive_truth_rows": nm, "no_match_truth_rows": nn, "top1_correct": top, "final_correct": done, "automatic_rows": auto, "automatic_correct": auto_ok, "automatic_match_rows": cur, "automatic_match_correct": cur_ok, "review_rows": csql(was("REVIEW")), "current_review_rows": csql(now("REVIEW")), "unmatched_rows": csql(was("UNMATCHED")), "resolved_rows": resolved, "human_changed_rows": csql(H + f" AND {final} AND final_group_code IS DISTINCT FROM top1_group_code"), "no_match_true_negative": tn, "no_match_false_positive": fp}
    rates = {"truth_coverage": rsql(n, "count(*)"), "top1_accuracy": rsql(top, nm), "positive_top1_accuracy": rsql(top, nm), "final_accuracy": rsql(done, n), "human_accuracy_gain": rsql(f"{done} - {top} - {tn}", n), "automatic_accuracy": rsql(auto_ok, auto), "automatic_match_precision": rsql(cur_ok, cur), "review_rate": rsql(counts["review_rows"], n), "current_review_rate": rsql(counts["current_review_rows"], n), "unmatched_rate": rsql(counts["unmatched_rows"], n), "resolved_rate": rsql(resolved, n), "no_match_true_negative_rate": rsql(tn, nn), "no_match_false_positive_rate": rsql(fp, nn), **{f"candidate_recall_at_{k}": rsql(csql(M + f" AND expected_rank <= {k}"), nm) for k in (1, 3, 5, 10)}}
    return f"WITH {EV} SELECT " + ", ".join(f"{v} AS {k}" for k, v in (counts | rates).items()) + " FROM ev"


@query("evaluation_report", full_sql())
def evaluation_report(spark, d):
    return evaluation.full_metrics(judged(spark, d))


@query("score_extremes", f"WITH {EV}, a AS (SELECT 'lowest_correct_top1' AS kind, CAST(row_number() OVER (ORDER BY top1_score NULLS FIRST, truth_key) AS INTEGER) AS place, truth_key, top1_score FROM ev WHERE top1_correct = 1), b AS (SELECT 'highest_true_no_match_top1' AS kind, CAST(row_number() OVER (ORDER BY top1_score DESC NULLS LAST, truth_key) AS INTEGER) AS place, truth_key, top1_score FROM ev WHERE {N}) SELECT * FROM a WHERE place <= 12 UNION ALL SELECT * FROM b WHERE place <= 12")
def score_extremes(spark, d):
    return evaluation.extremes(judged(spark, d)).select("kind", "place", "truth_key", "top1_score")


@query("candidate_recall_at_k", f"WITH {EV} SELECT {csql(M)} AS evaluated_match_rows, " + ", ".join(f"{rsql(csql(M + f' AND expected_rank <= {k}'), csql(M))} AS recall_at_{k}" for k in (1, 3, 5, 10)) + " FROM ev")
def candidate_recall_at_k(spark, d):
    return evaluation.recall_at(judged(spark, d))


@query("evaluation_errors", f"WITH {EV} SELECT truth_key, matched_task_row, final_correct, top1_correct FROM ev ORDER BY matched_task_row, final_correct, top1_correct, truth_key LIMIT 100")
def evaluation_errors(spark, d):
    return evaluation.errors(judged(spark, d), 100).select("truth_key", "matched_task_row", "final_correct", "top1_correct")


@query("quality_by_slice", f"WITH {EV} SELECT segment, expected, count(*) AS n, round(sum(top1_correct)::DOUBLE / count(*), 6) AS top1_accuracy, round(sum(final_correct)::DOUBLE / count(*), 6) AS final_accuracy, round(avg(top1_score), 4) AS mean_score FROM ev GROUP BY GROUPING SETS ((), (segment), (expected))")
def quality_by_slice(spark, d):
    return evaluation.by_slice(judged(spark, d), "segment", "expected")


@query("score_distribution", f"WITH {EV} SELECT expected, count(*) AS n, round(min(top1_score), 4) AS least, " + ", ".join(f"round(quantile_cont(top1_score, {p}), 4) AS p{round(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", round(max(top1_score), 4) AS most FROM ev GROUP BY 1")
def score_distribution(spark, d):
    return evaluation.score_distribution(judged(spark, d), "expected", "top1_score")


CAT = "CASE WHEN matched_task_row = 0 THEN 'MISSING_ROW' WHEN final_correct = 1 THEN 'CORRECT' WHEN expected = 'NO_MATCH' THEN 'FALSE_MATCH' WHEN expected_rank IS NULL THEN 'NOT_RETRIEVED' WHEN expected_rank > 1 THEN 'RANKED_BELOW' ELSE 'BELOW_THRESHOLD' END"


@query("failure_attribution", f"WITH {EV}, c AS (SELECT truth_key, {CAT} AS category FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY truth_key) AS n FROM c) SELECT category, count(*) AS n, string_agg(truth_key, ',' ORDER BY truth_key) FILTER (n <= 12) AS sample FROM r GROUP BY 1")
def failure_attribution(spark, d):
    return evaluation.failure_attribution(judged(spark, d))


@query("field_score_means", f"WITH {C}, f AS (SELECT kind, 'a' AS rule_id, CASE WHEN a < 0.3 THEN 0.0 ELSE a END AS s FROM cands UNION ALL SELECT kind, 'b', CASE WHEN b < 0.3 THEN 0.0 ELSE b END FROM cands) SELECT kind, rule_id, count(*) AS n, round(avg(s), 6) AS mean_score FROM f GROUP BY 1, 2")
def field_score_means(spark, d):
    return evaluation.field_score_means(candidates(spark, d), "kind")


@query("truth_conflicts", "WITH t AS (SELECT CAST(c_nationkey AS VARCHAR) AS truth_key, CASE WHEN c_acctbal >= 0 THEN 'MATCH' ELSE 'NO_MATCH' END AS expected, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_nationkey AS VARCHAR) END AS expected_code FROM customer), x AS (SELECT CASE WHEN expected = 'MATCH' THEN 'MATCH_WITHOUT_CODE' ELSE 'NO_MATCH_WITH_CODE' END AS reason, truth_key FROM t WHERE (expected = 'MATCH') = (expected_code IS NULL) UNION ALL SELECT 'CONFLICT', truth_key FROM t GROUP BY truth_key HAVING count(DISTINCT expected || '/' || coalesce(expected_code, '')) > 1) SELECT reason, truth_key, count(*) AS n FROM x GROUP BY 1, 2")
def truth_conflicts(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    t = c.select(F.col("c_nationkey").cast("string").alias("truth_key"), F.when(F.col("c_acctbal") >= 0, "MATCH").otherwise("NO_MATCH").alias("expected"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey").cast("string")).alias("expected_code"))
    return evaluation.truth_errors(t).groupBy("reason", "truth_key").agg(F.count("*").alias("n"))


def task_table(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_custkey") % 4 > 0, (F.col("o_custkey") % 50).cast("string")).alias("scheme"), F.col("o_custkey").alias("grp"), F.col("o_orderdate").alias("created_at"))


@query("task_list_run_number", "SELECT o_orderkey AS task_id, o_custkey AS grp, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS run_number FROM orders")
def task_list_run_number(spark, d):
    return tasks.run_numbers(task_table(spark, d), "grp").select("task_id", "grp", "run_number")


@query("review_history", "WITH i AS (SELECT l_orderkey AS task_id, count(*) AS n_items, count(*) FILTER (l_returnflag = 'A') AS matched, count(*) FILTER (l_returnflag = 'N') AS review, count(*) FILTER (l_returnflag = 'R') AS unmatched FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey AS task_id, CASE WHEN o_custkey % 4 > 0 THEN CAST(o_custkey % 50 AS VARCHAR) END AS scheme, o_orderdate AS created_at FROM orders) SELECT t.task_id, scheme, coalesce(n_items, 0) AS n_items, coalesce(matched, 0) AS matched, coalesce(review, 0) AS review, coalesce(unmatched, 0) AS unmatched, CASE WHEN scheme IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY scheme ORDER BY created_at, t.task_id) AS INTEGER) END AS sequence, CASE WHEN scheme IS NOT NULL THEN count(*) OVER (PARTITION BY scheme) END AS sequence_total FROM t LEFT JOIN i ON i.task_id = t.task_id")
def review_history(spark, d):
    st = F.when(F.col("l_returnflag") == "A", "MATCHED").when(F.col("l_returnflag") == "N", "REVIEW").otherwise("UNMATCHED")
    i = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("task_id"), st.alias("current_status"))
    return tasks.review_history(task_table(spark, d), i).select("task_id", "scheme", "n_items", "matched", "review", "unmatched", "sequence", "sequence_total")


@query("latest_version", "SELECT user_id AS entity_id, arg_max(event_type, event_id) AS document, max(event_id) AS version_no FROM events GROUP BY 1")
def latest_version(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("document"), F.col("event_id").alias("version_no"))
    return tasks.latest_version(e)


@query("duration_fields", "WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(epoch_ms(l_shipdate) - epoch_ms(o_orderdate) AS BIGINT) AS ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT *, ms // 1000 AS s FROM q) SELECT l_orderkey, l_linenumber, l_partkey, ms, CASE WHEN ms < 0 THEN NULL WHEN s >= 3600 THEN (s // 3600) || 'h' || (s % 3600 // 60) || 'm' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm' || (s % 60) || 's' ELSE s || 's' END AS text FROM s")
def duration_fields(spark, d):
    j = spark.read.parquet(f"{d}/lineitem.parquet").join(spark.read.parquet(f"{d}/orders.parquet"), F.expr("l_orderkey = o_orderkey"))
    ms, text = tasks.duration(F.col("o_orderdate"), F.col("l_shipdate"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", ms.alias("ms"), text.alias("text"))


@query("throughput_eta", "WITH p AS (SELECT user_id AS task_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, event_id AS done FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seconds, done) AS rn FROM p), w AS (SELECT *, min(rn) OVER (PARTITION BY task_id ORDER BY seconds RANGE BETWEEN 864000 PRECEDING AND CURRENT ROW) AS first FROM n), j AS (SELECT w.task_id, w.seconds, w.done, w.seconds - b.seconds AS dt, w.done - b.done AS dn FROM w JOIN n b ON b.task_id = w.task_id AND b.rn = greatest(w.first, w.rn - 2)) SELECT task_id, seconds, done, CASE WHEN dt > 0 AND dn > 0 THEN round(dn::DOUBLE / dt, 6) END AS rows_per_second FROM j")
def throughput_eta(spark, d):
    p = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("task_id"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("seconds"), F.col("event_id").alias("done"), F.lit(20000000).alias("total"))
    return tasks.throughput(p, 864000, 3).select("task_id", "seconds", "done", "rows_per_second")


@query("task_details", "WITH r AS (SELECT l_orderkey AS task_id, min(l_shipdate) AS started, count(*) AS rows FROM lineitem GROUP BY 1), a AS (SELECT user_id AS task_id, arg_min('op' || (event_id % 7), struct_pack(a := ts, b := event_id)) AS operator FROM events WHERE event_type IN ('signup', 'view') GROUP BY 1) SELECT o_orderkey AS task_id, r.started AS runtime_started, r.rows AS runtime_rows, a.operator AS actor_operator FROM orders LEFT JOIN r ON r.task_id = o_orderkey LEFT JOIN a ON a.task_id = o_orderkey")
def task_details(spark, d):
    r = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.min("l_shipdate").alias("started"), F.count("*").alias("rows"))
    e = log(spark, d).select(F.col("source_row_id").alias("entity_id"), "action", "operator", F.col("operated_at").alias("created_at"), "seq")
    a = tasks.first_actor(e, ("signup", "view")).select(F.col("entity_id").alias("task_id"), "operator")
    t = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("task_id"))
    return tasks.task_details(t, runtime=r, actor=a)


@query("catalog_versions", "SELECT c_custkey AS version_id, n_nationkey AS catalog_id, n_name, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey % 100 DESC, c_custkey DESC) AS INTEGER) AS version_place FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 3")
def catalog_versions(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").where("n_regionkey < 3").select(F.col("n_nationkey").alias("catalog_id"), "n_name")
    v = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("version_id"), F.col("c_nationkey").alias("catalog_id"), (F.col("c_custkey") % 100).alias("created_at"))
    return tasks.with_versions(n, v, "catalog_id").select("version_id", "catalog_id", "n_name", "version_place")


@query("claim_next_task", "WITH t AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'RECOVERING' ELSE 'DONE' END AS status, o_orderdate AS created_at FROM orders), c AS (SELECT arg_min(task_id, struct_pack(a := created_at, b := task_id)) AS k FROM t WHERE status <> 'DONE') SELECT task_id, CASE WHEN task_id = k THEN 'PREPARING' ELSE status END AS status, CASE WHEN task_id = k THEN created_at END AS started_at FROM t, c")
def claim_next_task(spark, d):
    st = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "RECOVERING").otherwise("DONE")
    t = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("task_id"), st.alias("status"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp").alias("started_at"))
    return tasks.claim_next(t).select("task_id", "status", "started_at")


@query("children_equal", "WITH a AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey % 2)) AS c FROM lineitem WHERE l_linenumber < 4 GROUP BY 1), b AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey % 2)) AS c FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) SELECT coalesce(a.k, b.k) AS task_id, a.c IS NOT DISTINCT FROM b.c AS same FROM a FULL JOIN b ON a.k = b.k")
def children_equal(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("task_id"), (F.col("l_suppkey") % 2).alias("child"), "l_linenumber")
    return tasks.same_children(line.where("l_linenumber < 4"), line.where("l_linenumber > 1"), "task_id", "child")


@query("result_staleness", "WITH c AS (SELECT o_custkey AS task_id, max(o_orderdate) AS last_change FROM orders GROUP BY 1), r AS (SELECT c_custkey AS task_id, TIMESTAMP '1998-01-01' AS written_at FROM customer) SELECT r.task_id, coalesce(last_change > written_at, false) AS stale FROM r LEFT JOIN c ON c.task_id = r.task_id")
def result_staleness(spark, d):
    r = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("task_id"), F.lit("1998-01-01").cast("timestamp").alias("written_at"))
    c = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("task_id"), F.col("o_orderdate").alias("changed_at"))
    return tasks.stale(r, c).select("task_id", "stale")


@query("dictionary_merge", "WITH o AS (SELECT p_name AS key, min(p_brand) AS value FROM part WHERE p_size < 30 GROUP BY 1), n AS (SELECT p_name AS key, min(p_brand) AS value FROM part WHERE p_size > 20 GROUP BY 1) SELECT coalesce(o.key, n.key) AS key, coalesce(n.value, o.value) AS value, CASE WHEN o.key IS NULL THEN 'ADDED' WHEN n.key IS NULL THEN 'KEPT' WHEN o.value = n.value THEN 'SKIPPED' ELSE 'UPDATED' END AS outcome FROM o FULL JOIN n ON o.key = n.key")
def dictionary_merge(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    t = lambda c: p.where(c).groupBy(F.col("p_name").alias("key")).agg(F.min("p_brand").alias("value"))
    return tasks.merge_dictionary(t("p_size < 30"), t("p_size > 20"))


@query("first_actor_event", f"WITH {L} SELECT source_row_id AS entity_id, arg_min(operator, struct_pack(a := operated_at, b := seq)) AS operator, arg_min(action, struct_pack(a := operated_at, b := seq)) AS action FROM log WHERE action IN ('signup', 'view') AND operator <> 'op0' GROUP BY 1")
def first_actor_event(spark, d):
    a = log(spark, d).select(F.col("source_row_id").alias("entity_id"), "action", F.when(F.col("operator") != "op0", F.col("operator")).alias("operator"), F.col("operated_at").alias("created_at"), "seq")
    return tasks.first_actor(a, ("signup", "view")).select("entity_id", "operator", "action")


@query("acceptance_gate", f"WITH {EV}, m AS (SELECT {rsql(csql(H), 'count(*)')} AS coverage, {rsql(csql(M + ' AND top1_correct = 1'), csql(M))} AS top1_accuracy FROM ev) SELECT gate, value, CASE WHEN value < lo THEN 'FAIL' WHEN value < hi THEN 'BLOCKED' ELSE 'PASS' END AS outcome FROM (SELECT 'coverage' AS gate, coverage AS value, 0.9 AS hi, 0.5 AS lo FROM m UNION ALL SELECT 'top1_accuracy', top1_accuracy, 0.95, 0.6 FROM m)")
def acceptance_gate(spark, d):
    return tasks.acceptance(evaluation.metrics(judged(spark, d)), {"coverage": (0.9, 0.5), "top1_accuracy": (0.95, 0.6)})


@query("export_summary", f'WITH {I} SELECT count(*) FILTER (current_status = \'MATCHED\') AS "MATCHED", count(*) FILTER (current_status = \'REVIEW\') AS "REVIEW", count(*) FILTER (current_status = \'UNMATCHED\') AS "UNMATCHED" FROM items')
def export_summary(spark, d):
    return exports.summary(items(spark, d))


SEL = "sel AS (SELECT source_row_id, target_group_code, min(rank) AS selected_rank, arg_min(score, rank) AS selected_score FROM cands GROUP BY 1, 2)"


@query("summary_selected_candidate", f"WITH {I}, {C}, {SEL} SELECT items.source_row_id, final_group_code, selected_rank, selected_score FROM items LEFT JOIN sel ON sel.source_row_id = items.source_row_id AND sel.target_group_code = final_group_code")
def summary_selected_candidate(spark, d):
    c = candidates(spark, d, F.struct("_metadata.file_path", "_metadata.row_index").alias("seq"))
    return exports.selected_candidate(items(spark, d), c).select("source_row_id", "final_group_code", "selected_rank", "selected_score")


@query("export_final_results", f"WITH {I}, {C}, {SEL}, {L}, r AS (SELECT source_row_id, arg_max(operator, struct_pack(a := operated_at, b := seq)) AS last_operator FROM log WHERE action = 'error' GROUP BY 1) SELECT items.source_row_id, current_status, final_group_code, selected_rank, last_operator, CASE WHEN last_operator IS NOT NULL AND current_status = 'MATCHED' THEN 'MANUAL_MATCH' WHEN last_operator IS NOT NULL THEN 'MANUAL_REJECT' WHEN current_status = 'MATCHED' THEN 'AUTO_MATCH' WHEN current_status = 'REVIEW' THEN 'PENDING_REVIEW' ELSE 'NO_MATCH' END AS method FROM items LEFT JOIN sel ON sel.source_row_id = items.source_row_id AND sel.target_group_code = final_group_code LEFT JOIN r ON r.source_row_id = items.source_row_id")
def export_final_results(spark, d):
    return exports.final_results(items(spark, d), candidates(spark, d), reviews(spark, d)).select("source_row_id", "current_status", "final_group_code", "selected_rank", "last_operator", "method")


@query("export_top_candidates", f"WITH {I}, {C} SELECT source_row_id, rank, target_group_code, score, current_status FROM cands JOIN items USING (source_row_id) WHERE rank <= 5")
def export_top_candidates(spark, d):
    return exports.top_candidates(items(spark, d), candidates(spark, d)).select("source_row_id", "rank", "target_group_code", "score", "current_status")


@query("export_audit", f"WITH {C}, {L}, c AS (SELECT source_row_id, target_group_code AS group_code, min(target_row_number) AS target_row FROM cands GROUP BY 1, 2) SELECT seq, log.source_row_id, action, log.group_code, target_row FROM log LEFT JOIN c ON c.source_row_id = log.source_row_id AND c.group_code = log.group_code")
def export_audit(spark, d):
    return exports.audit(log(spark, d), candidates(spark, d)).select("seq", "source_row_id", "action", "group_code", "target_row")


@query("export_unmatched", f"WITH {I}, {C}, c AS (SELECT source_row_id, min(target_group_code) AS best_code, max(score) AS best_score FROM cands WHERE rank = 1 GROUP BY 1) SELECT items.source_row_id, best_code, best_score FROM items LEFT JOIN c ON c.source_row_id = items.source_row_id WHERE current_status = 'UNMATCHED'")
def export_unmatched(spark, d):
    c = candidates(spark, d).where("rank = 1").groupBy("source_row_id", "rank").agg(F.min("target_group_code").alias("target_group_code"), F.max("score").alias("score"))
    return exports.unmatched(items(spark, d), c).select("source_row_id", "best_code", "best_score")


PRE = "round((a * 60 + b * 40) / 100 * 100, 4)"


@query("export_veto_compare", f"WITH {I}, {C}, c AS (SELECT source_row_id, max({PRE}) AS pre_score, bool_or(a < 0.3 OR b < 0.3) AS any_veto FROM cands GROUP BY 1) SELECT items.source_row_id, current_status, pre_score, any_veto, CASE WHEN pre_score >= 88 THEN 'MATCHED' WHEN pre_score > 0 THEN 'REVIEW' ELSE 'UNMATCHED' END AS pre_status FROM items JOIN c ON c.source_row_id = items.source_row_id")
def export_veto_compare(spark, d):
    return exports.veto_compare(items(spark, d), candidates(spark, d), 88).select("source_row_id", "current_status", "pre_score", "any_veto", "pre_status")


@query("field_states", f"WITH {C}, s AS (SELECT source_row_id, 'a' AS rule_id, a AS v FROM cands UNION ALL SELECT source_row_id, 'b', b FROM cands) SELECT source_row_id, rule_id, ['EXACT', 'PARTIAL', 'DIFFERENT', 'MISSING'][max(CASE WHEN v IS NULL THEN 4 WHEN v >= 0.999999 THEN 1 WHEN v > 0 THEN 2 ELSE 3 END)] AS state FROM s GROUP BY 1, 2")
def field_states(spark, d):
    s = candidates(spark, d).select("source_row_id", F.explode("field_scores").alias("f")).select("source_row_id", "f.rule_id", F.col("f.score_before_veto").alias("score"))
    return exports.worst_states(s, "source_row_id", "rule_id")


@query("manual_review_wide", f"WITH {I}, {C}, c AS (SELECT source_row_id, " + ", ".join(f"max(score) FILTER (rank = {r}) AS score_{r}" for r in range(1, 6)) + " FROM cands GROUP BY 1) SELECT items.source_row_id, current_status, " + ", ".join(f"score_{r}" for r in range(1, 6)) + " FROM items LEFT JOIN c ON c.source_row_id = items.source_row_id WHERE current_status <> 'MATCHED'")
def manual_review_wide(spark, d):
    c = candidates(spark, d).groupBy("source_row_id", "rank").agg(F.max("score").alias("score"), F.min("target_group_code").alias("target_group_code"))
    return exports.manual_wide(items(spark, d), c).select("source_row_id", "current_status", *[f"score_{r}" for r in range(1, 6)])


@query("column_states", "WITH c AS (SELECT p_name, p_brand, min(p_type) AS t_type, min(p_size) AS t_size FROM part GROUP BY 1, 2) SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 4 WHEN p_type = t_type THEN 1 ELSE 3 END AS type_state, CASE WHEN p_size % 2 = 0 THEN 2 WHEN p_size = t_size THEN 1 ELSE 3 END AS size_state FROM part JOIN c USING (p_name, p_brand)")
def column_states(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    c = p.groupBy("p_name", "p_brand").agg(F.min("p_type").alias("t_type"), F.min("p_size").cast("string").alias("t_size"))
    j = p.join(c, ["p_name", "p_brand"])
    ruled = F.when(F.col("p_size") % 2 == 0, exports.field_state(F.lit(0.5)))
    return j.select("p_partkey", exports.column_states(F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(F.col("p_type")), F.col("t_type")).alias("type_state"), exports.column_states(F.col("p_size").cast("string"), F.col("t_size"), ruled).alias("size_state"))
