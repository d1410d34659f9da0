"""Queries of scoring, candidate generation and decision over the part table.

Source: every part. Catalog: distinct (name, brand) with the smallest key as
group code and the smallest size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlink.config import Decision, MatchConfig, Rule, Scope, Side, SourceFilter
from kinlink.errors import ConfigError
from kinlink.functions import matchers
from kinlink.operators import composite
from kinlink.plans import matching
from kinlink.queries import query

CATALOG = "catalog AS (SELECT min(p_partkey) AS t_ord, CAST(min(p_partkey) AS VARCHAR) AS group_code, p_name AS t_name, p_brand AS t_brand, min(p_size) AS t_size, min(p_type) AS t_type FROM part GROUP BY p_name, p_brand)"


def parts(spark, d):
    return spark.read.parquet(f"{d}/part.parquet")


def catalog(spark, d):
    return parts(spark, d).groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("row_ordinal"), F.min("p_partkey").cast("string").alias("group_code"), F.min("p_size").alias("p_size"), F.min("p_type").alias("p_type"))


def side(*c, **k):
    return Side(columns=tuple(c), **k)


def rule(id, column, matcher, weight, **k):
    return Rule(id=id, source=side(column), target=side(column), matcher=matcher, weight=weight, **k)


RULES = (rule("name", "p_name", "exact", 60), rule("brand", "p_brand", "exact", 30), rule("size", "p_size", "numeric", 10, matcher_options={"tolerance": {"mode": "absolute", "value": 2}}))
VETO = (rule("name", "p_name", "exact", 60, critical=True), rule("brand", "p_brand", "exact", 30, veto_threshold=50), rule("size", "p_size", "numeric", 10, matcher_options={"tolerance": {"mode": "absolute", "value": 2}}))


def config(rules=RULES, **k):
    return MatchConfig(rules=rules, group_code_column="group_code", **k)


def run(spark, d, cfg):
    return matching.match(parts(spark, d), catalog(spark, d), cfg, "p_partkey", "row_ordinal")


SCORE = "round((CASE WHEN p_name = t_name THEN 60.0 ELSE 0.0 END + CASE WHEN p_brand = t_brand THEN 30.0 ELSE 0.0 END + CASE WHEN abs(p_size - t_size) <= 2 THEN 10.0 ELSE 0.0 END) / 100.0 * 100, 4)"
STATUS = "CASE WHEN coalesce(top1_score, 0) >= 88 THEN 'MATCHED' WHEN coalesce(top1_score, 0) > 0 THEN 'REVIEW' ELSE 'UNMATCHED' END"


def ranked_sql(score=SCORE, join="JOIN catalog ON true", where="", top=5, extra=""):
    return f"WITH {CATALOG}, pairs AS (SELECT p_partkey AS s_ord, t_ord, group_code, CAST({score} AS DOUBLE) AS score{extra} FROM part {join} {where}), ranked AS (SELECT *, row_number() OVER (PARTITION BY s_ord ORDER BY score DESC, t_ord) AS rank FROM pairs QUALIFY rank <= {top})"


BEST = ", best AS (SELECT s_ord, max(score) FILTER (rank = 1) AS top1_score, max(score) FILTER (rank = 2) AS second_score, max(group_code) FILTER (rank = 1) AS top1_group_code FROM ranked GROUP BY s_ord)"


@query("match_scan_global", ranked_sql() + BEST + f" SELECT p_partkey AS s_ord, {STATUS} AS status, top1_score, top1_group_code, CASE WHEN {STATUS} = 'MATCHED' THEN top1_group_code END AS final_group_code FROM part LEFT JOIN best ON s_ord = p_partkey")
def match_scan_global(spark, d):
    return run(spark, d, config())[0].select("s_ord", "status", "top1_score", "top1_group_code", "final_group_code")


@query("match_topn", ranked_sql() + " SELECT s_ord, CAST(rank AS INTEGER) AS rank, group_code, score FROM ranked")
def match_topn(spark, d):
    return run(spark, d, config())[1].select("s_ord", "rank", "group_code", "score")


@query("score_gap", ranked_sql() + BEST + " SELECT s_ord, top1_score, second_score, round(top1_score - coalesce(second_score, 0), 4) AS score_gap FROM best")
def score_gap(spark, d):
    return run(spark, d, config())[0].select("s_ord", "top1_score", "second_score", "score_gap")


@query("decide_status", ranked_sql() + BEST + f" SELECT {STATUS} AS status, count(*) AS n FROM part LEFT JOIN best ON s_ord = p_partkey GROUP BY 1")
def decide_status(spark, d):
    return run(spark, d, config())[0].groupBy("status").agg(F.count("*").alias("n"))


@query("match_scope_strict", ranked_sql(join="JOIN catalog ON p_type = t_type") + " SELECT s_ord, CAST(rank AS INTEGER) AS rank, group_code, score FROM ranked")
def match_scope_strict(spark, d):
    return run(spark, d, config(scope=Scope("STRICT", "p_type", "p_type")))[1].select("s_ord", "rank", "group_code", "score")


SIZES = {str(i): (str((i % 50) + 1), str((i * 7) % 50 + 1)) for i in range(1, 51)}


@query("match_scope_mapped", ranked_sql(join="JOIN (SELECT DISTINCT i AS a, v AS b FROM (SELECT i, unnest([i % 50 + 1, i * 7 % 50 + 1]) AS v FROM range(1, 51) t(i))) m ON m.a = p_size JOIN catalog ON t_size = m.b") + " SELECT s_ord, CAST(rank AS INTEGER) AS rank, group_code, score FROM ranked")
def match_scope_mapped(spark, d):
    return run(spark, d, config(scope=Scope("MAPPED", "p_size", "p_size", SIZES)))[1].select("s_ord", "rank", "group_code", "score")


@query("source_filter_include", "SELECT p_partkey, p_brand FROM part WHERE trim(coalesce(p_brand, '')) IN ('Brand#11', 'Brand#23')")
def source_filter_include(spark, d):
    return parts(spark, d).where(matching.source_predicate(SourceFilter("p_brand", ("Brand#11", " Brand#23 ", " ")))).select("p_partkey", "p_brand")


@query("source_filter_exclude", "SELECT p_partkey, p_type FROM part WHERE NOT contains(trim(coalesce(p_type, '')), 'STANDARD')")
def source_filter_exclude(spark, d):
    return parts(spark, d).where(matching.source_predicate(SourceFilter("p_type", ("STANDARD",), "exclude", "contains"))).select("p_partkey", "p_type")


def scored(spark, d, rules):
    cfg = config(rules, scope=Scope("STRICT", "p_type", "p_type"))
    p = matching.candidate_pairs(matching.prepare_source(parts(spark, d), cfg, "p_partkey"), matching.prepare_target(catalog(spark, d), cfg, "row_ordinal"), cfg)
    return matching.score_pairs(p, cfg)


def pairs_sql(select, more=""):
    return f"WITH {CATALOG}, p AS (SELECT p_partkey AS s_ord, t_ord, * FROM part JOIN catalog ON p_type = t_type) SELECT {select} FROM p {more}"


@query("score_weighted", pairs_sql(f"s_ord, count(*) AS n, max({SCORE}) AS best, min({SCORE}) AS worst", "GROUP BY s_ord"))
def score_weighted(spark, d):
    return scored(spark, d, RULES).groupBy("s_ord").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min("score").alias("worst"))


COVER = (Rule("code", Side(columns=("p_size",), processors=({"op": "nullify", "options": {"values": ["1", "2", "3", "4", "5"]}},)), side("p_size"), "exact", 90), rule("name", "p_name", "exact", 10))


@query("score_coverage", pairs_sql("s_ord, CASE WHEN p_size <= 5 THEN 0.1 ELSE 1.0 END AS coverage, count(*) AS n, max(CASE WHEN p_size <= 5 THEN CASE WHEN p_name = t_name THEN 100.0 ELSE 0.0 END ELSE round((CASE WHEN p_size = t_size THEN 90.0 ELSE 0 END + CASE WHEN p_name = t_name THEN 10.0 ELSE 0 END), 4) END) AS best", "GROUP BY 1, 2"))
def score_coverage(spark, d):
    return scored(spark, d, COVER).groupBy("s_ord", "coverage").agg(F.count("*").alias("n"), F.max("score").alias("best"))


VSCORE = "CASE WHEN p_brand <> t_brand THEN 0.0 ELSE " + SCORE + " END"


@query("score_veto", pairs_sql(f"s_ord, count(*) FILTER (p_brand <> t_brand) AS vetoed, max({VSCORE}) AS best", "GROUP BY s_ord"))
def score_veto(spark, d):
    return scored(spark, d, VETO).groupBy("s_ord").agg(F.count_if("vetoed").alias("vetoed"), F.max("score").alias("best"))


@query("critical_conflict", pairs_sql("s_ord, count(*) FILTER (p_name <> t_name) AS conflicts, count(*) AS n", "GROUP BY s_ord"))
def critical_conflict(spark, d):
    return scored(spark, d, VETO).groupBy("s_ord").agg(F.count_if("critical_conflict").alias("conflicts"), F.count("*").alias("n"))


@query("score_field_rule", pairs_sql("s_ord, count(*) AS n, sum(CASE WHEN p_name = t_name THEN 1 ELSE 0 END) AS name_hits, sum(CASE WHEN p_brand = t_brand THEN 1 ELSE 0 END) AS brand_hits", "GROUP BY s_ord"))
def score_field_rule(spark, d):
    s = scored(spark, d, RULES)
    return s.groupBy("s_ord").agg(F.count("*").alias("n"), F.sum(F.col("f_0").cast("long")).alias("name_hits"), F.sum(F.col("f_1").cast("long")).alias("brand_hits"))


def matcher_query(name, sql, col, text, prepare=lambda c: c):
    """Scores of all pairs within a type, worked out once for each pair of distinct texts, which are prepared once a text."""

    @query(name, pairs_sql(f"s_ord, count(*) AS n, CAST(sum(CAST(round(({sql}) * 1000000) AS BIGINT)) AS BIGINT) AS total, CAST(max(round({sql}, 6)) AS DOUBLE) AS best", "GROUP BY s_ord"))
    def q(spark, d, col=col, text=text, prepare=prepare):
        ready = lambda df, k, *more: df.groupBy("p_type", F.col(text).cast("string").alias(k)).agg(F.count("*").alias("times")).withColumn(f"{k}_ready", prepare(F.col(k))).drop(*more)
        s, t = ready(parts(spark, d), "s", "times"), ready(catalog(spark, d), "t", "t")
        score = s.join(t, "p_type").withColumn("score", col(F.col("s_ready"), F.col("t_ready")))
        each = score.groupBy("p_type", "s").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.round(F.col("score") * 1000000).cast("long")).alias("total"), F.max(F.round("score", 6)).alias("best"))
        own = parts(spark, d).select(F.col("p_partkey").alias("s_ord"), "p_type", F.col(text).cast("string").alias("s"))
        return own.join(each, own["p_type"].eqNullSafe(each["p_type"]) & own["s"].eqNullSafe(each["s"])).select("s_ord", "n", "total", "best")


matcher_query("score_exact", "CASE WHEN p_name = t_name THEN 1.0 ELSE 0.0 END", matchers.exact, "p_name")
matcher_query("score_contains", "CASE WHEN p_name = t_name THEN 1.0 WHEN contains(p_name, t_name) OR contains(t_name, p_name) THEN 0.9 * least(length(p_name), length(t_name)) / greatest(length(p_name), length(t_name)) ELSE 0.0 END", lambda s, t: matchers.contains(s, t, 0.9, True), "p_name")
matcher_query("score_jaccard", "CASE WHEN p_name = '' OR t_name = '' THEN 0.0 ELSE len(list_intersect(list_distinct(string_split(p_name, ' ')), list_distinct(string_split(t_name, ' '))))::DOUBLE / len(list_distinct(list_concat(string_split(p_name, ' '), string_split(t_name, ' ')))) END", matchers.overlap, "p_name", matchers.tokens)
for _m, _o, _sql in (
    ("exact", {}, "p_size = t_size"),
    ("absolute", {"value": 3}, "abs(p_size - t_size) <= 3"),
    ("relative", {"value": 0.1}, "abs(p_size - t_size) / greatest(abs(t_size)::DOUBLE, 1e-12) <= 0.1"),
    ("range", {"min_delta": -1, "max_delta": 4}, "p_size - t_size BETWEEN -1 AND 4"),
):
    matcher_query(f"score_numeric_{_m}", f"CASE WHEN {_sql} THEN 1.0 ELSE 0.0 END", (lambda o: lambda s, t: matchers.near(s, t, o))({"mode": _m, **_o}), "p_size", matchers.number)


def name_pairs(spark, d):
    """All pairs of distinct names, of which there must be few; only these reach Python."""
    n = parts(spark, d).select("p_name").distinct()
    if n.limit(matching.MOST_SCAN_TARGETS + 1).count() > matching.MOST_SCAN_TARGETS:
        raise ConfigError("SCAN_TOO_LARGE", "names")
    return n.select(F.col("p_name").alias("s")).crossJoin(F.broadcast(n.select(F.col("p_name").alias("t"))))


@query("score_fuzzy")
def score_fuzzy(spark, d):
    return name_pairs(spark, d).select("s", "t", F.round(matchers.fuzzy(F.col("s"), F.col("t")), 6).alias("score"))


@query("score_hybrid")
def score_hybrid(spark, d):
    return name_pairs(spark, d).select("s", "t", F.round(matchers.hybrid(F.col("s"), F.col("t")), 6).alias("score"))


BRANDS = {"BRAND#11": "alpha", "Brand#12": "beta", "BRAND#13": "BRAND#13"}


@query("value_mapping", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'ALPHA' WHEN p_brand = 'Brand#12' THEN 'BETA' ELSE upper(p_brand) END AS mapped, upper(p_brand) AS before, p_brand IN ('Brand#11', 'Brand#12') AS applied, CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN '' ELSE upper(p_brand) END AS unconfigured FROM part")
def value_mapping(spark, d):
    s = Side(columns=("p_brand",), processors=({"op": "case_map", "options": {"mode": "upper"}},))
    m = matching.mapping_trace(s, BRANDS)
    return parts(spark, d).select("p_partkey", F.element_at(matching.value_mapped(s, BRANDS), 1).alias("mapped"), m["before"].alias("before"), m["applied"].alias("applied"), F.array_join(m["unconfigured"], ",").alias("unconfigured"))


@query("field_scores", ranked_sql(score="CASE WHEN p_name = t_name OR p_name = t_brand OR p_brand = t_name OR p_brand = t_brand THEN 100.0 ELSE 0.0 END", join="JOIN catalog ON p_type = t_type", top=2, extra=", p_name, p_brand, t_name, t_brand") + " SELECT s_ord, CAST(rank AS INTEGER) AS rank, score, CASE WHEN score = 0 OR p_name IN (t_name, t_brand) THEN p_name ELSE p_brand END AS source_value, CASE WHEN score = 0 OR p_name = t_name THEN t_name WHEN p_name = t_brand THEN t_brand WHEN p_brand = t_name THEN t_name ELSE t_brand END AS target_value, p_name || ' / ' || p_brand AS before FROM ranked")
def field_scores(spark, d):
    """Which of the texts of both sides made the score of a kept candidate."""
    both = side("p_name", "p_brand", combine="best_of")
    cfg = config((Rule("any", both, both, "exact", 100),), scope=Scope("STRICT", "p_type", "p_type"), decision=Decision(top_n=2))
    found = matching.with_field_scores(run(spark, d, cfg)[1], parts(spark, d), catalog(spark, d), cfg, "p_partkey", "row_ordinal")
    f = F.col("field_scores")[0]
    return found.select("s_ord", "rank", "score", f["source_value"].alias("source_value"), f["target_value"].alias("target_value"), f["source_value_before_mapping"].alias("before"))


@query("fixed_value_rule", "SELECT p_partkey, CASE WHEN p_type = 'STANDARD' THEN 100.0 ELSE 0.0 END AS score FROM part")
def fixed_value_rule(spark, d):
    r = Rule("type", side("p_type"), Side(fixed_value="STANDARD"), "exact", 100)
    return parts(spark, d).select("p_partkey", (F.coalesce(matching.best_pair(r, matching.slim(r, r.source, matching.combined(r.source)), matching.slim(r, r.target, matching.combined(r.target)), None), F.lit(0.0)) * 100).alias("score"))


@query("combine_concat", "SELECT p_partkey, concat_ws('-', nullif(p_brand, ''), nullif(p_type, ''), CAST(p_size AS VARCHAR)) AS v FROM part")
def combine_concat(spark, d):
    return parts(spark, d).select("p_partkey", F.element_at(matching.combined(side("p_brand", "p_type", "p_size", separator="-")), 1).alias("v"))


@query("combine_coalesce", "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_name END, nullif(p_brand, '')) AS v FROM part")
def combine_coalesce(spark, d):
    t = parts(spark, d).withColumn("large", F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.lit("")))
    return t.select("p_partkey", F.element_at(matching.combined(side("large", "p_brand", combine="coalesce")), 1).alias("v"))


@query("combine_best_of", pairs_sql("s_ord, CAST(max(greatest(CASE WHEN p_name = t_name OR p_name = t_brand OR p_brand = t_name OR p_brand = t_brand THEN 1.0 ELSE 0.0 END, 0.0)) AS DOUBLE) AS best, sum(CASE WHEN p_name = t_name OR p_name = t_brand OR p_brand = t_name OR p_brand = t_brand THEN 1 ELSE 0 END) AS hits", "GROUP BY s_ord"))
def combine_best_of(spark, d):
    both = side("p_name", "p_brand", combine="best_of")
    s = scored(spark, d, (Rule("any", both, both, "exact", 100),))
    return s.groupBy("s_ord").agg(F.max("f_0").alias("best"), F.sum(F.col("f_0").cast("long")).alias("hits"))


@query("retrieval_text", "SELECT p_partkey, concat_ws(' ', nullif(p_name, ''), nullif(p_brand, ''), CAST(p_size AS VARCHAR)) AS v FROM part")
def retrieval_text(spark, d):
    return parts(spark, d).select("p_partkey", matching.retrieval_text(RULES + (rule("again", "p_name", "exact", 5), rule("off", "p_type", "exact", 0)), "source").alias("v"))


def child(spark, d, key, rules=RULES):
    t = parts(spark, d).groupBy("p_name", key).agg(F.min("p_partkey").alias("row_ordinal"), F.min("p_partkey").cast("string").alias("group_code"), F.first(F.lit(None).cast("string")).alias("_"))
    cfg = MatchConfig(rules=rules, group_code_column="group_code", decision=Decision(top_n=3))
    return matching.match(parts(spark, d), t, cfg, "p_partkey", "row_ordinal")[1].select("s_ord", "group_code", "score")


_CHILD = "SELECT {i} AS child, p_partkey AS s_ord, group_code, CASE WHEN p_name = t_name THEN {w} ELSE 0.0 END + CASE WHEN part.{k} = t_k THEN {v} ELSE 0.0 END AS score, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN p_name = t_name THEN {w} ELSE 0.0 END + CASE WHEN part.{k} = t_k THEN {v} ELSE 0.0 END DESC, t_ord) AS r FROM part JOIN (SELECT p_name AS t_name, {k} AS t_k, min(p_partkey) AS t_ord, CAST(min(p_partkey) AS VARCHAR) AS group_code FROM part GROUP BY 1, 2) t ON true QUALIFY r <= 3"


@query("composite_merge", f"WITH u AS ({_CHILD.format(i=0, k='p_type', w='70.0', v='30.0')} UNION ALL {_CHILD.format(i=1, k='p_size', w='60.0', v='40.0')}), b AS (SELECT *, row_number() OVER (PARTITION BY s_ord, group_code ORDER BY score DESC, child) AS n FROM u QUALIFY n = 1) SELECT s_ord, group_code, CAST(score AS DOUBLE) AS score, CAST(child AS INTEGER) AS child, CAST(row_number() OVER (PARTITION BY s_ord ORDER BY score DESC, group_code) AS INTEGER) AS rank FROM b QUALIFY rank <= 4")
def composite_merge(spark, d):
    a = child(spark, d, "p_type", (rule("n", "p_name", "exact", 70), rule("k", "p_type", "exact", 30)))
    b = child(spark, d, "p_size", (rule("n", "p_name", "exact", 60), rule("k", "p_size", "exact", 40)))
    return composite.merge([a, b], 4).select("s_ord", "group_code", "score", "child", "rank")


@query("seed_pair_match")
def seed_pair_match(spark, d):
    """Parts of odd size as sources, of even size as targets, alike in name, brand and size within a type."""
    from kinlink.operators.seeds import seed_pairs

    p = parts(spark, d).select(F.col("p_partkey").alias("ordinal"), "p_type", "p_name", "p_brand", F.col("p_size").cast("string").alias("size"))
    key = p.groupBy("p_type", "p_name", "p_brand", "size").agg(F.min("ordinal").alias("ordinal"))
    rules = {k: (("p_name", "p_name", 0.6), ("p_brand", "p_brand", 0.3), ("size", "size", 0.1)) for k in ("STANDARD", "SMALL", "MEDIUM")}
    return seed_pairs(key.where("size % 10 = 1"), key.where("size % 10 = 2"), rules, "p_type")
