"""Queries of the normalisation operators over whole texts, and of profiles and sources.

Documents hold non-ASCII letters that upper and lower alike in both engines;
operators with a compatibility form run on the ASCII columns of part and pages,
which that form leaves alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlink.functions import normalize
from kinlink.operators import profile
from kinlink.queries import query
from kinlink.queries.linkage import parts


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def step(op, **options):
    return [{"op": op, "options": options}]


def on_docs(name, sql, steps):
    @query(name, f"SELECT doc_id, md5({sql}) AS v FROM documents")
    def q(spark, d, steps=steps):
        return docs(spark, d).select("doc_id", F.md5(normalize.apply(F.col("text"), steps)).alias("v"))


def on_parts(name, value, sql, steps):
    @query(name, f"SELECT p_partkey, {sql} AS v FROM part")
    def q(spark, d, value=value, steps=steps):
        return parts(spark, d).select("p_partkey", normalize.apply(value(), steps).alias("v"))


on_docs("norm_identity", "text", [])
on_docs("norm_trim", r"regexp_replace(text, '^\s+|\s+$', '', 'g')", step("trim"))
on_docs("norm_case", "upper(replace(text, 'ß', 'ss'))", step("case_map", mode="upper"))
on_docs("norm_whitespace", r"regexp_replace(text, '\s+', '_', 'g')", step("whitespace_map", replacement="_"))
on_docs("norm_punct", "translate(text, '.,;!', '    ')", step("punctuation_map", chars=".,;!", replacement=" "))
on_docs("norm_regex", r"regexp_replace(text, '([a-z])([0-9])', '\2-\1', 'g')", step("regex_replace", pattern=r"([a-z])([0-9])", replacement=r"\2-\1"))
on_docs("norm_substring", "CASE WHEN length(text) > 12 THEN substr(text, 6, length(text) - 12) ELSE '' END", step("substring", start=5, end=-7))
on_parts("norm_nullify", lambda: F.col("p_brand"), "CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN NULL ELSE p_brand END", step("nullify", values=["Brand#1", "Brand#2"]))
on_parts("norm_text", lambda: F.concat(F.lit("  "), "p_name", F.lit(" / "), "p_brand"), "regexp_replace(upper('  ' || p_name || ' / ' || p_brand), '[ _/().,;:-]', '', 'g')", step("text_normalize", compact=True))
on_parts("norm_standard", lambda: F.concat(F.lit("gb-t "), F.col("p_size").cast("string"), F.lit(" - "), F.col("p_partkey").cast("string")), "'GB/T' || p_size || '-' || p_partkey", step("standard_number_normalize"))
on_parts("norm_spec", lambda: F.concat(F.lit("φ "), F.col("p_size").cast("string"), F.lit(" * "), F.col("p_partkey").cast("string"), F.lit(" mm")), "'Φ' || p_size || '×' || p_partkey", step("specification_normalize"))
on_parts("norm_model", lambda: F.concat(F.lit(" ("), "p_brand", F.lit(") ")), "upper(p_brand)", step("model_normalize", strip_wrapping_punctuation=True))
on_parts("norm_manufacturer", lambda: F.concat("p_name", F.lit("（集团）有限公司公司")), "upper(replace(p_name, ' ', ''))", step("manufacturer_normalize"))
on_parts("dictionary_exact", lambda: F.col("p_type"), "CASE p_type WHEN 'STANDARD' THEN 'std' WHEN 'PROMO' THEN 'pro' END", step("dictionary_map", mapping={"standard": "std", "Promo": "pro"}, case_sensitive=False, on_missing="null"))
on_parts("dictionary_replace", lambda: F.col("p_name"), "replace(replace(replace(replace(p_name, 'red', '~1'), 'ring', '~2'), '~1', 'ring'), '~2', 'red')", step("dictionary_map", mode="replace", mapping={"red": "ring", "ring": "red"}))


@query("norm_nfkc")
def norm_nfkc(spark, d):
    return docs(spark, d).select("doc_id", F.md5(normalize.apply(F.col("text"), step("unicode_normalize"))).alias("v"))


@query("norm_trace", "SELECT p_partkey, p_name AS v0, upper(p_name) AS v1, replace(upper(p_name), ' ', '_') AS v2 FROM part")
def norm_trace(spark, d):
    t = normalize.trace(F.col("p_name"), [{"op": "case_map", "options": {"mode": "upper"}}, {"op": "whitespace_map", "options": {"replacement": "_"}}])
    return parts(spark, d).select("p_partkey", t[0]["input"].alias("v0"), t[0]["output"].alias("v1"), t[1]["output"].alias("v2"))


COLUMNS = ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")
LONG = "long AS (" + " UNION ALL ".join(f"SELECT p_partkey AS ordinal, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM part WHERE {c} IS NOT NULL" for c in COLUMNS) + "), vals AS (SELECT column_name, value, count(*) AS n, min(ordinal) AS first_seen FROM long WHERE trim(value) <> '' GROUP BY 1, 2)"
KIND = "CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN 'INTEGER' WHEN regexp_full_match(value, '[+-]?[0-9]+\\.[0-9]*') THEN 'NUMBER' ELSE 'TEXT' END"
PROFILE = f"WITH {LONG}, p AS (SELECT column_name, CAST(sum(n) AS BIGINT) AS non_empty_count, count(*) AS unique_count, CASE WHEN count(DISTINCT {KIND}) = 1 THEN min({KIND}) WHEN bool_or({KIND} = 'TEXT') THEN 'MIXED' ELSE 'NUMBER' END AS datatype FROM vals GROUP BY 1)"
ENUM = "unique_count BETWEEN 2 AND 50 AND CASE WHEN unique_count <= 2 THEN non_empty_count >= 4 AND unique_count * 2 <= non_empty_count WHEN unique_count <= 4 THEN non_empty_count >= unique_count * 3 WHEN unique_count <= 10 THEN non_empty_count >= unique_count * 4 ELSE non_empty_count >= unique_count * 5 END"


@query("column_profile", PROFILE + f" SELECT *, {ENUM} AS enum_candidate FROM p")
def column_profile(spark, d):
    return profile.column_profile(parts(spark, d), COLUMNS, "p_partkey")


@query("column_datatype", PROFILE + " SELECT column_name, datatype FROM p")
def column_datatype(spark, d):
    return profile.column_profile(parts(spark, d), COLUMNS, "p_partkey").select("column_name", "datatype")


@query("enum_candidates", PROFILE + f" SELECT column_name, unique_count FROM p WHERE {ENUM}")
def enum_candidates(spark, d):
    return profile.column_profile(parts(spark, d), COLUMNS, "p_partkey").where("enum_candidate").select("column_name", "unique_count")


@query("column_top_values", f"WITH {LONG} SELECT column_name, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, first_seen, value) AS INTEGER) AS place, value, n FROM vals QUALIFY place <= 20")
def column_top_values(spark, d):
    return profile.top_values(parts(spark, d), COLUMNS, "p_partkey")


@query("token_length_profile", "WITH q AS (SELECT count(n_chars) AS n, max(n_chars) AS most, quantile_cont(n_chars, [0.5, 0.95, 0.99, 0.999]) AS p, round(avg(CASE WHEN n_chars > 64 THEN 1.0 ELSE 0 END), 6) AS truncated_64, round(avg(CASE WHEN n_chars > 128 THEN 1.0 ELSE 0 END), 6) AS truncated_128, round(avg(CASE WHEN n_chars > 256 THEN 1.0 ELSE 0 END), 6) AS truncated_256, round(avg(CASE WHEN n_chars > 512 THEN 1.0 ELSE 0 END), 6) AS truncated_512 FROM documents) SELECT n, most, CAST(ceil(p[1]) AS BIGINT) AS p50, CAST(ceil(p[2]) AS BIGINT) AS p95, CAST(ceil(p[3]) AS BIGINT) AS p99, CAST(ceil(p[4]) AS BIGINT) AS p999, truncated_64, truncated_128, truncated_256, truncated_512, CASE WHEN ceil(p[3]) <= 64 THEN 64 WHEN ceil(p[3]) <= 128 THEN 128 WHEN ceil(p[3]) <= 256 THEN 256 ELSE 512 END AS recommended_length FROM q")
def token_length_profile(spark, d):
    return profile.token_lengths(docs(spark, d), "n_chars")


@query("text_profile", "WITH q AS (SELECT count(*) AS row_count, count(*) FILTER (coalesce(text, '') <> '') AS filled_rows, count(DISTINCT nullif(text, '')) AS distinct_texts, max(length(text)) AS longest, count(*) FILTER (length(text) > 512) AS l FROM documents WHERE doc_id % 2 = 0) SELECT row_count, filled_rows, distinct_texts, longest, round((row_count - filled_rows) / row_count, 6) AS empty_rate, round((filled_rows - distinct_texts) / filled_rows, 6) AS duplicate_rate, round(l / filled_rows, 6) AS truncation_rate, round(row_count / (SELECT count(*) FROM documents), 6) AS coverage_ratio FROM q")
def text_profile(spark, d):
    t = docs(spark, d)
    return profile.text_profile(t, "text", 512, t.where("doc_id % 2 = 0"))


@query("column_values", f"WITH {LONG}, t AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, first_seen, value) AS place FROM vals WHERE column_name = 'p_type' QUALIFY place <= 20), u AS (SELECT column_name, count(*) AS unique_count FROM vals GROUP BY 1) SELECT column_name, 'TEXT' AS datatype, unique_count, true AS enum_candidate, string_agg(value || '=' || n, ',' ORDER BY place) AS top_values, string_agg(value, ',' ORDER BY place) AS values, count(*) >= unique_count AS values_complete FROM t JOIN u USING (column_name) GROUP BY 1, 2, 3")
def column_values(spark, d):
    return profile.column_values(parts(spark, d), "p_type", "p_partkey")


@query("batch_latencies", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.5) AS a, quantile_cont(l_extendedprice, 0.95) AS b, sum(l_quantity) / sum(l_extendedprice) AS r FROM lineitem) SELECT round(a * 1000, 3) AS p50_ms, round(b * 1000, 3) AS p95_ms, round(r, 3) AS rows_per_second, round(1100000 / r / 3600, 3) AS projected_hours FROM q")
def batch_latencies(spark, d):
    return profile.latencies(spark.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", "l_quantity")


@query("reservoir_sample")
def reservoir_sample(spark, d):
    return profile.bottom_k_sample(spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), "l_partkey"), "k")


@query("candidate_count_stats", "WITH q AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT round(avg(n), 6) AS mean, quantile_disc(n, 0.95) AS p95, max(n) AS most FROM q")
def candidate_count_stats(spark, d):
    return profile.count_stats(spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("n")), "n")


@query("scan_effective_rows", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row_ordinal FROM documents WHERE trim(coalesce(text, '')) <> '' OR trim(coalesce(source, '')) <> ''")
def scan_effective_rows(spark, d):
    from kinlink.sources.layout import effective, with_ordinal

    t = docs(spark, d).select("doc_id", "text", "source")
    return with_ordinal(t.where(effective(["text", "source"])).select("doc_id"), "doc_id", "row_ordinal")


@query("token_budget_batches")
def token_budget_batches(spark, d):
    """Batches of the texts of every source by length within a budget: how many, and how full."""
    import pandas as pd

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        n = f["n_chars"].tolist()
        b = profile.pack_by_budget(n, 65536)
        room = sum(len(x) * max(1, max(n[i] for i in x)) for x in b)
        return pd.DataFrame({"source": [f["source"].iloc[0]], "slice": [f["slice"].iloc[0]], "batches": [len(b)], "efficiency": [round(sum(n) / max(1, room), 6)]})

    t = docs(spark, d).select("source", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("slice"), "n_chars")
    return t.groupBy("source", "slice").applyInPandas(pack, "source string, slice long, batches long, efficiency double")
