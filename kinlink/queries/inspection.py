"""Queries of file layout and inspection, over the parts of each brand laid out as a sheet: a title row, a header row, then one row a part, some blank."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.queries import query
from kinlink.queries.linkage import parts
from kinlink.sources import layout

NAMED, PLAIN = ("物料编码", "物料名称", "型号规格", "计量单位"), ("code", "name", "kind", "amount")


def grid(spark, d):
    p = parts(spark, d).select("*", F.substring_index("p_brand", "#", -1).cast("int").alias("place"))
    c = lambda v, text: F.struct(v.cast("string").alias("value"), F.lit(text).alias("is_text"))
    none = F.lit(None).cast("struct<value:string,is_text:boolean>")
    row = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 2
    cells = F.array(*[F.when(F.col("p_partkey") % 10 > 0, c(F.col(n), t)) for n, t in (("p_partkey", False), ("p_name", True), ("p_type", True), ("p_size", False))])
    data = p.select(F.col("p_brand").alias("sheet"), "place", row.cast("long").alias("row_number"), cells.alias("cells"))
    sheets = p.select(F.col("p_brand").alias("sheet"), "place").distinct()
    head = lambda names: F.array(*[c(F.lit(f" {n}"), True) for n in names])
    title = sheets.select("sheet", "place", F.lit(1).cast("long").alias("row_number"), F.array(c(F.lit("report of"), True), none, none, none).alias("cells"))
    heads = sheets.select("sheet", "place", F.lit(2).cast("long").alias("row_number"), F.when(F.col("place") % 2 == 0, head(NAMED)).otherwise(head(PLAIN)).alias("cells"))
    return data.unionByName(title).unionByName(heads)


R = "d AS (SELECT p_brand AS sheet, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS place, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 2 AS n, p_partkey % 10 = 0 AS blank, p_partkey, p_name, p_type, p_size FROM part)"
S = R + ", scores AS (SELECT sheet, place, n, CASE WHEN blank THEN 0.0 ELSE 7.0 + 0.2 * CASE WHEN p_partkey = p_size THEN 3 ELSE 4 END END AS score FROM d UNION ALL SELECT DISTINCT sheet, place, 1, 2.7 FROM d UNION ALL SELECT DISTINCT sheet, place, 2, CASE WHEN place % 2 = 0 THEN 20.8 ELSE 10.8 END FROM d), h AS (SELECT sheet, place, CAST(list(score ORDER BY score DESC)[1] AS DOUBLE) AS best, CAST(list(score ORDER BY score DESC)[2] AS DOUBLE) AS second FROM scores WHERE n <= 30 GROUP BY 1, 2), heads AS (SELECT sheet, place, 2 AS header_row, best AS score, least(1.0::DOUBLE, 0.55::DOUBLE + (best - second) / best) AS confidence FROM h)"


@query("header_detect", f"WITH {S} SELECT sheet, CAST(header_row AS INTEGER) AS header_row, round(score, 6) AS score, round(confidence, 6) AS confidence FROM heads")
def header_detect(spark, d):
    return layout.detect_headers(grid(spark, d), "sheet").select("sheet", "header_row", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


@query("column_hints", "WITH t AS (SELECT CASE p_partkey % 5 WHEN 0 THEN '物料编码' WHEN 1 THEN '集 团-码 ' WHEN 2 THEN '型号规格(新)' WHEN 3 THEN '生产厂家名称' ELSE p_name END AS header FROM part) SELECT header, CASE header WHEN '物料编码' THEN 'source_id' WHEN '集 团-码 ' THEN 'group_code' WHEN '型号规格(新)' THEN 'model' WHEN '生产厂家名称' THEN 'material_name' END AS hint, CASE header WHEN '物料编码' THEN 0.99 WHEN '集 团-码 ' THEN 0.99 WHEN '型号规格(新)' THEN 0.82 WHEN '生产厂家名称' THEN 0.82 ELSE 0.0 END::DOUBLE AS confidence, count(*) AS n FROM t GROUP BY 1")
def column_hints(spark, d):
    k = F.col("p_partkey") % 5
    t = parts(spark, d).select(F.when(k == 0, "物料编码").when(k == 1, "集 团-码 ").when(k == 2, "型号规格(新)").when(k == 3, "生产厂家名称").otherwise(F.col("p_name")).alias("header"))
    h = layout.hint(F.col("header"))
    return t.groupBy("header").agg(F.count("*").alias("n")).select("header", h["field"].alias("hint"), h["confidence"].alias("confidence"), "n")


@query("inspect_sheets", f"WITH {S}, r AS (SELECT sheet, count(*) FILTER (NOT blank) AS row_count FROM d GROUP BY 1) SELECT sheet, CAST(header_row AS INTEGER) AS header_row, round(confidence, 3) AS confidence, 4 AS column_count, row_count, false AS row_count_estimated FROM heads JOIN r USING (sheet)")
def inspect_sheets(spark, d):
    return layout.inspect_sheets(grid(spark, d), "sheet")


@query("row_count_estimate", f"WITH {R}, f AS (SELECT sheet, count(*) + 2 AS dimension, count(*) FILTER (n <= 22) AS rows, count(*) FILTER (n <= 22 AND NOT blank) AS seen, max(n) FILTER (n <= 22) AS last FROM d GROUP BY 1) SELECT sheet, CASE WHEN dimension > last THEN seen + CAST(round_even(seen::DOUBLE / greatest(rows, 1) * (dimension - last), 0) AS BIGINT) ELSE seen END AS row_count, dimension > last AS row_count_estimated FROM f")
def row_count_estimate(spark, d):
    return layout.inspect_sheets(grid(spark, d), "sheet", most_rows=20).select("sheet", "row_count", "row_count_estimated")


@query("recommended_sheet", f"WITH {S}, r AS (SELECT sheet, count(*) FILTER (NOT blank) AS row_count FROM d GROUP BY 1) SELECT sheet AS recommended_sheet FROM heads JOIN r USING (sheet) ORDER BY round(confidence, 3) DESC, row_count DESC, place LIMIT 1")
def recommended_sheet(spark, d):
    return layout.recommended_sheet(layout.inspect_sheets(grid(spark, d), "sheet", "place"), "sheet", "place")


CELLS = "c AS (SELECT sheet, place, n, unnest([1, 2, 3, 4]) AS i, unnest([CAST(p_partkey AS VARCHAR), p_name, p_type, CAST(p_size AS VARCHAR)]) AS value FROM d WHERE NOT blank)"


@query("inspect_columns", f"WITH {R}, {CELLS}, s AS (SELECT sheet, place, i, string_agg(value, '|' ORDER BY n) FILTER (k <= 5) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY sheet, i ORDER BY n) AS k FROM c WHERE n <= 22) GROUP BY 1, 2, 3) SELECT sheet, CAST(i AS INTEGER) AS index, CASE WHEN place % 2 = 0 THEN {list(NAMED)}[i] ELSE {list(PLAIN)}[i] END AS header, samples, 'TEXT' AS inferred_type, CASE WHEN place % 2 = 0 THEN ['source_id', 'material_name', 'specification', 'unit'][i] END AS business_hint, CASE WHEN place % 2 = 0 THEN 0.99 ELSE 0.0 END::DOUBLE AS hint_confidence, place % 2 = 0 AND i = 1 AS leading_zero_risk FROM s")
def inspect_columns(spark, d):
    return layout.inspect_columns(grid(spark, d), "sheet").withColumn("samples", F.array_join("samples", "|"))


@query("synonym_pairs", f"WITH {R} SELECT sheet, n AS row_number, CASE WHEN blank THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS source, CASE WHEN blank THEN '' ELSE p_name END AS target FROM d WHERE place % 2 = 0")
def synonym_pairs(spark, d):
    return layout.synonym_pairs(grid(spark, d), "物料编码", "物料名称", "sheet")


@query("row_cap", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100")
def row_cap(spark, d):
    return layout.row_cap(parts(spark, d).select("p_partkey", "p_name"), "p_partkey", 100)
