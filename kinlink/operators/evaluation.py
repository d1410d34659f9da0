"""Ground-truth evaluation of match results.

truth: truth_key, expected (MATCH / NO_MATCH), expected_code. items:
source_id, current_status, top1_group_code, final_group_code, top1_score.
candidates: source_id, rank, target_group_code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECALL_AT = (1, 3, 5, 10)


def truth_errors(truth: DataFrame) -> DataFrame:
    """Rows that make a truth table unusable: reason and key."""
    blank = truth.where(F.coalesce(F.trim("truth_key"), F.lit("")) == "").select(F.lit("BLANK_KEY").alias("reason"), F.lit(None).cast("string").alias("truth_key"))
    code = F.coalesce("expected_code", F.lit("")) != ""
    kind = truth.where(((F.col("expected") == "MATCH") & ~code) | ((F.col("expected") == "NO_MATCH") & code)).select(F.when(F.col("expected") == "MATCH", "MATCH_WITHOUT_CODE").otherwise("NO_MATCH_WITH_CODE").alias("reason"), "truth_key")
    torn = truth.groupBy("truth_key").agg(F.count_distinct(F.struct("expected", F.coalesce("expected_code", F.lit("")))).alias("n")).where("n > 1").select(F.lit("CONFLICT").alias("reason"), "truth_key")
    return blank.unionByName(kind).unionByName(torn)


def evaluation_items(truth: DataFrame, items: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per truth row; truth without an item keeps matched_task_row = 0. NO_MATCH is right where the item ended UNMATCHED without a code."""
    own = truth.select("truth_key", "expected", "expected_code")
    first = F.col("original_status") if "original_status" in items.columns else F.col("current_status")
    d = own.join(items.select(F.col("source_id").alias("truth_key"), "current_status", first.alias("original_status"), "top1_group_code", "final_group_code", "top1_score"), "truth_key", "left")
    ranks = candidates.select(F.col("source_id").alias("truth_key"), F.col("target_group_code").alias("expected_code"), "rank").groupBy("truth_key", "expected_code").agg(F.min("rank").alias("expected_rank"))
    d = d.join(ranks, ["truth_key", "expected_code"], "left")
    is_match = F.col("expected") == "MATCH"
    here = F.col("current_status").isNotNull()
    return d.withColumns(
        {
            "matched_task_row": here.cast("int"),
            "top1_correct": F.coalesce(is_match & (F.col("top1_group_code") == F.col("expected_code")), F.lit(False)).cast("int"),
            "final_correct": F.coalesce(F.when(is_match, F.col("final_group_code") == F.col("expected_code")).otherwise((F.col("current_status") == "UNMATCHED") & (F.coalesce("final_group_code", F.lit("")) == "")), F.lit(False)).cast("int"),
        }
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / F.when(b > 0, b), 6)).otherwise(0.0)


def recall_at(e: DataFrame) -> DataFrame:
    m = (F.col("expected") == "MATCH") & (F.col("matched_task_row") == 1)
    n = F.count_if(m)
    return e.agg(n.alias("evaluated_match_rows"), *[ratio(F.count_if(m & (F.col("expected_rank") <= k)), n).alias(f"recall_at_{k}") for k in RECALL_AT])


def metrics(e: DataFrame) -> DataFrame:
    """All ratios of an evaluation in one global aggregation."""
    here, match = F.col("matched_task_row") == 1, F.col("expected") == "MATCH"
    auto, review = F.col("current_status") == "MATCHED", F.col("current_status") == "REVIEW"
    ok = F.col("final_group_code") == F.col("expected_code")
    n, nm, nn = F.count_if(here), F.count_if(here & match), F.count_if(here & ~match)
    auto_n = F.count_if(here & auto)
    none = lambda x: F.when(nn > 0, F.round(x / F.when(nn > 0, nn), 6))
    return e.agg(
        F.count("*").alias("truth_rows"),
        n.alias("evaluated_rows"),
        nm.alias("match_rows"),
        nn.alias("no_match_rows"),
        ratio(n, F.count("*")).alias("coverage"),
        ratio(F.count_if(here & match & (F.col("top1_correct") == 1)), nm).alias("top1_accuracy"),
        ratio(F.count_if(here & (F.col("final_correct") == 1)), n).alias("final_accuracy"),
        auto_n.alias("auto_rows"),
        ratio(F.count_if(here & auto & match & ok), auto_n).alias("auto_precision"),
        ratio(F.count_if(here & auto & match & ok), nm).alias("auto_recall"),
        F.count_if(here & review).alias("review_rows"),
        ratio(F.count_if(here & review), n).alias("review_rate"),
        F.count_if(here & (F.col("current_status") == "UNMATCHED")).alias("unmatched_rows"),
        none(F.count_if(here & ~match & auto)).alias("no_match_false_positive_rate"),
        none(F.count_if(here & ~match & ~auto)).alias("no_match_rejection_rate"),
        *[ratio(F.count_if(here & match & (F.col("expected_rank") <= k)), nm).alias(f"recall_at_{k}") for k in RECALL_AT],
    )


def full_metrics(e: DataFrame, ks: tuple[int, ...] = RECALL_AT) -> DataFrame:
    """The whole evaluation report in one global aggregation: the task's first decisions, its current ones, and what people changed."""
    here, match = F.col("matched_task_row") == 1, F.col("expected") == "MATCH"
    final = F.coalesce("final_group_code", F.lit("")) != ""
    right = match & (F.col("top1_group_code") == F.col("expected_code"))
    was, now = (lambda x: here & (F.col("original_status") == x)), (lambda x: here & (F.col("current_status") == x))
    n, nm, nn = F.count_if(here), F.count_if(here & match), F.count_if(here & ~match)
    top, done = F.count_if(here & (F.col("top1_correct") == 1)), F.count_if(here & (F.col("final_correct") == 1))
    tn = F.count_if(here & ~match & (F.col("final_correct") == 1))
    fp = F.count_if(here & ~match & (F.col("current_status").isin("MATCHED", "CONFIRMED") | final))
    resolved = F.count_if(here & (final | (~match & (F.col("current_status") == "UNMATCHED"))))
    maybe = lambda a, b: F.when(b > 0, F.round(a / F.when(b > 0, b), 6))
    signed = lambda a, b: F.when(b > 0, F.round(a / F.when(b > 0, b), 6)).otherwise(0.0)
    counts = {
        "truth_rows": F.count("*"), "evaluated_rows": n, "positive_truth_rows": nm, "no_match_truth_rows": nn, "top1_correct": top, "final_correct": done,
        "automatic_rows": F.count_if(was("MATCHED")), "automatic_correct": F.count_if(was("MATCHED") & right), "automatic_match_rows": F.count_if(now("MATCHED")), "automatic_match_correct": F.count_if(now("MATCHED") & right),
        "review_rows": F.count_if(was("REVIEW")), "current_review_rows": F.count_if(now("REVIEW")), "unmatched_rows": F.count_if(was("UNMATCHED")), "resolved_rows": resolved, "human_changed_rows": F.count_if(here & final & ~F.col("final_group_code").eqNullSafe(F.col("top1_group_code"))),
        "no_match_true_negative": tn, "no_match_false_positive": fp,
    }
    rates = {
        "truth_coverage": ratio(n, F.count("*")), "top1_accuracy": ratio(top, nm), "positive_top1_accuracy": ratio(top, nm), "final_accuracy": ratio(done, n), "human_accuracy_gain": signed(done - top - tn, n),
        "automatic_accuracy": ratio(counts["automatic_correct"], counts["automatic_rows"]), "automatic_match_precision": ratio(counts["automatic_match_correct"], counts["automatic_match_rows"]),
        "review_rate": ratio(counts["review_rows"], n), "current_review_rate": ratio(counts["current_review_rows"], n), "unmatched_rate": ratio(counts["unmatched_rows"], n), "resolved_rate": ratio(resolved, n),
        "no_match_true_negative_rate": maybe(tn, nn), "no_match_false_positive_rate": maybe(fp, nn), **{f"candidate_recall_at_{k}": ratio(F.count_if(here & match & (F.col("expected_rank") <= k)), nm) for k in ks},
    }
    return e.agg(*[c.alias(k) for k, c in (counts | rates).items()])


def extremes(e: DataFrame, n: int = 12) -> DataFrame:
    """kind, place, truth_key, top1_score: right first candidates with the lowest scores, and rows without a match with the highest."""
    right, none = e.where("top1_correct = 1"), e.where("expected <> 'MATCH' and matched_task_row = 1")
    pick = lambda d, kind, order: d.orderBy(order, "truth_key").limit(n).select(F.lit(kind).alias("kind"), "truth_key", "top1_score")
    low, high = pick(right, "lowest_correct_top1", F.col("top1_score").asc_nulls_first()), pick(none, "highest_true_no_match_top1", F.col("top1_score").desc_nulls_last())
    rank = lambda d, order: d.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(order, "truth_key")))  # noqa: E731  n rows
    return rank(low, F.col("top1_score").asc_nulls_first()).unionByName(rank(high, F.col("top1_score").desc_nulls_last()))


def errors(e: DataFrame, limit: int) -> DataFrame:
    return e.orderBy("matched_task_row", "final_correct", "top1_correct", "truth_key").limit(limit)


def by_slice(e: DataFrame, *columns: str) -> DataFrame:
    """Counts and accuracies overall and by each column, in one pass of grouping sets."""
    sets = [[], *[[c] for c in columns]]
    n = F.count("*")
    agg = e.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(n.alias("n"), ratio(F.sum("top1_correct"), n).alias("top1_accuracy"), ratio(F.sum("final_correct"), n).alias("final_accuracy"), F.round(F.avg("top1_score"), 4).alias("mean_score"))
    return agg


def score_distribution(df: DataFrame, by: str, value: str) -> DataFrame:
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    return df.groupBy(by).agg(F.count("*").alias("n"), p.alias("p"), F.round(F.min(value), 4).alias("least"), F.round(F.max(value), 4).alias("most")).select(by, "n", "least", *[F.round(F.col("p")[i], 4).alias(f"p{x:02d}") for i, x in enumerate((5, 25, 50, 75, 95))], "most")


def failure_attribution(e: DataFrame, samples: int = 12) -> DataFrame:
    """Failure category, number, and the first keys of each category."""
    c = (
        F.when(F.col("matched_task_row") == 0, "MISSING_ROW")
        .when(F.col("final_correct") == 1, "CORRECT")
        .when((F.col("expected") == "NO_MATCH"), "FALSE_MATCH")
        .when(F.col("expected_rank").isNull(), "NOT_RETRIEVED")
        .when(F.col("expected_rank") > 1, "RANKED_BELOW")
        .otherwise("BELOW_THRESHOLD")
    )
    d = e.select("truth_key", c.alias("category"))
    first = d.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy("truth_key"))).where(F.col("_n") <= samples)
    first = first.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("truth_key")), ",").alias("sample"))
    return d.groupBy("category").agg(F.count("*").alias("n")).join(F.broadcast(first), "category")  # six categories


def field_score_means(candidates: DataFrame, *by: str) -> DataFrame:
    """Mean score of every rule, over exploded field scores."""
    d = candidates.select(*by, F.explode("field_scores").alias("f"))
    return d.groupBy(*by, F.col("f.rule_id").alias("rule_id")).agg(F.count("*").alias("n"), F.round(F.avg("f.score"), 6).alias("mean_score"))
