"""Queries through files: tables written as CSV, as a workbook and to the result store, and read back; and what a match reads of its sides."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinlink.config import MatchConfig, Rule, Side
from kinlink.operators import review
from kinlink.plans import matching
from kinlink.queries import query
from kinlink.queries.linkage import catalog, parts
from kinlink.queries.review import I, items
from kinlink.sources import store, tabular


def place(spark, kind):
    return f"{store.shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@query("csv_scan", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CASE WHEN p_size > 9 THEN CAST(p_size AS VARCHAR) END AS p_size FROM part WHERE p_partkey % 7 > 0 OR p_size > 9")
def csv_scan(spark, d):
    """Every part in CSV files with empty cells and blank rows, read as nullable text."""
    p = parts(spark, d)
    some = F.col("p_partkey") % 7 > 0
    t = p.select(F.when(some | (F.col("p_size") > 9), F.col("p_partkey").cast("string")).alias("p_partkey"), F.when(some | (F.col("p_size") > 9), F.col("p_name")).alias("p_name"), F.when(F.col("p_size") > 9, F.col("p_size").cast("string")).alias("p_size"))
    path = place(spark, "csv")
    store.write_csv(t, path)
    return tabular.read_rows(spark, f"{path}/*.csv", header_row=1).select("p_partkey", "p_name", "p_size")


@query("workbook_scan", "SELECT n_nationkey + 2 AS row_number, n_nationkey + 1 AS row_ordinal, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS VARCHAR) END AS n_regionkey FROM nation")
def workbook_scan(spark, d):
    """A sheet of a report workbook, read back with its row positions."""
    n = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("n_regionkey"))
    path = place(spark, "workbook") + ".xlsx"
    store.put(spark, path, store.workbook({"Regions": spark.read.parquet(f"{d}/region.parquet"), "Nations": n}))
    return tabular.read_table(spark, path, "Nations", 1)


@query("store_rerun", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS task_id, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS runs FROM orders GROUP BY 1")
def store_rerun(spark, d):
    """Two tasks' results, one of them written twice: a rerun replaces its own partition."""
    o, root = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), place(spark, "store")
    for task, rest, run in (("a", 0, 1), ("b", 1, 1), ("a", 0, 2)):
        store.save(o.where(F.col("o_orderkey") % 2 == rest).withColumn("run", F.lit(run)), root, "items", task)
    return store.load(spark, root, "items").groupBy("task_id").agg(F.count("*").alias("n"), F.sum("run").alias("runs"))


def reading_config():
    name = Side(columns=("p_name",))
    return MatchConfig(rules=(Rule("n", name, name, "exact", 1),), group_code_column="code", source_id_column="ident")


@query("prepared_sources", "SELECT p_partkey AS s_ord, CASE WHEN p_size % 3 = 0 OR p_size % 3 = 1 THEN CAST(p_partkey AS VARCHAR) ELSE p_brand END AS source_id, p_name AS text FROM part")
def prepared_sources(spark, d):
    """Rows without an id, null or blank, go by their position."""
    s = parts(spark, d).withColumn("ident", F.when(F.col("p_size") % 3 == 0, F.lit(None)).when(F.col("p_size") % 3 == 1, "").otherwise(F.col("p_brand")))
    return matching.prepare_source(s, reading_config(), "p_partkey").select("s_ord", "source_id", F.col("s_0").alias("text"))


@query("prepared_targets", "SELECT min(p_partkey) AS t_ord, CAST(min(p_partkey) AS VARCHAR) AS group_code FROM part GROUP BY p_name, p_brand HAVING min(p_partkey) % 3 = 2")
def prepared_targets(spark, d):
    """Catalog rows without a code, null or blank, are left out."""
    t = catalog(spark, d).withColumn("code", F.when(F.col("row_ordinal") % 3 == 0, F.lit(None)).when(F.col("row_ordinal") % 3 == 1, "").otherwise(F.col("group_code")))
    return matching.prepare_target(t, reading_config(), "row_ordinal").select("t_ord", "group_code")


@query("display_mapping", "SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'Std' WHEN 'PROMO' THEN 'Promotion' ELSE p_type END AS type, p_brand AS brand FROM part")
def display_mapping(spark, d):
    p = parts(spark, d).select("p_partkey", F.create_map(F.lit("type"), F.concat(F.lit(" "), "p_type"), F.lit("brand"), F.col("p_brand")).alias("m"))
    shown = review.display_mapping(F.col("m"), {"type": {"STANDARD": "Std", "PROMO": "Promotion"}})
    return p.select("p_partkey", F.trim(shown["type"]).alias("type"), shown["brand"].alias("brand"))


@query("baseline_restore", f"WITH {I} SELECT source_row_id, current_status, CASE WHEN current_status = 'MATCHED' THEN top1_group_code END AS final_group_code FROM items")
def baseline_restore(spark, d):
    changed = items(spark, d).withColumns({"current_status": F.lit("CONFIRMED"), "final_group_code": F.lit("x")})
    return review.restore(changed).select("source_row_id", "current_status", "final_group_code")
