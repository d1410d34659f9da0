"""Layout of tabular files: header row, business meaning of headers, effective rows, inspection.

A *grid* holds files as they are: any key columns (say, sheet), row_number, and
cells, an array of (value, is_text). What a header means and how much a row
looks like one are expressions over cells, so any number of sheets is
inspected in one plan; aggregation leaves one row a sheet or column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: fixed values: headers that tell what a column means
ALIASES = {
    "source_id": ("matnr", "物料", "物料号", "物料编码", "物资编码"),
    "group_code": ("集团码", "集团编码", "集团物资编码"),
    "material_name": ("物料名称", "物料描述", "名称", "品名", "zwlmc", "maktx"),
    "model": ("型号", "牌号", "系列", "zxh"),
    "specification": ("规格", "型号规格", "详细型号规格", "尺寸", "zxhgg", "zgg"),
    "manufacturer": ("生产厂家", "制造商", "厂家", "品牌", "zsccj"),
    "material_group": ("物料组", "物料类型", "分类", "matkl", "zwlyx"),
    "standard": ("标准", "采用标准", "技术标准", "规范", "标准号", "zcgbz", "zjsbz", "zbzh"),
    "unit": ("计量单位", "单位", "meins"),
}
#: meanings whose numeric cells may have lost leading zeros
CODES = ("source_id", "group_code", "material_group")
FIRST_ROWS, SAMPLE_ROWS, SAMPLES, ESTIMATE_ROWS = 30, 20, 5, 20_000
CELLS = "array<struct<value:string,is_text:boolean>>"
_BLANK = r"(?U)[\s\x1c-\x1f]+"


def _bind(c: Column, fn) -> Column:
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def filled(value: Column) -> Column:
    """Whether a cell holds more than white space."""
    return F.coalesce(F.regexp_replace(value, _BLANK, "") != "", F.lit(False))


def plain_header(value: Column) -> Column:
    """A header without case, white space and punctuation."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"(?U)[\s\x1c-\x1f_\-—–/（）()【】\[\]:：]+", "")


def hint(header: Column) -> Column:
    """(field, confidence) a header stands for: 0.99 if it is an alias, 0.82 if one contains the other, else (null, 0); the first of equals."""
    known = [(field, alias) for field, names in ALIASES.items() for alias in names]
    table = F.array(*[F.struct(F.lit(-i).alias("place"), F.lit(f).alias("field"), F.lit(a).alias("alias")) for i, (f, a) in enumerate(known)])

    def best(h):
        sure = lambda a: F.when(h == a["alias"], 0.99).when(F.contains(h, a["alias"]) | F.contains(a["alias"], h), 0.82).otherwise(0.0)
        return F.array_max(F.transform(table, lambda a: F.struct(sure(a).alias("confidence"), a["place"], a["field"])))

    found = _bind(plain_header(header), best)
    return _bind(found, lambda x: F.struct(F.when(x["confidence"] > 0, x["field"]).alias("field"), x["confidence"].alias("confidence")))


def row_score(cells: Column) -> Column:
    """How much a row looks like a header: cells filled, text among them, known meanings, different values."""
    def score(v):
        text, known = F.size(F.filter(v, lambda c: c["is_text"])), F.size(F.filter(v, lambda c: hint(c["value"])["confidence"] > 0))
        return F.size(v) + 1.5 * text + 2.5 * known + 0.2 * F.size(F.array_distinct(F.transform(v, lambda c: plain_header(c["value"]))))

    return _bind(F.filter(cells, lambda c: filled(c["value"])), score)


def detect_headers(grid: DataFrame, *by: str, first: int = FIRST_ROWS) -> DataFrame:
    """by..., header_row, score, confidence: the row among the first that looks most like a header, and by how much more than the next."""
    d = grid.where(F.col("row_number") <= first).select(*by, "row_number", row_score(F.col("cells")).alias("score"))
    g = d.groupBy(*by).agg(F.max_by("row_number", F.struct(F.col("score"), -F.col("row_number"))).alias("header_row"), F.max("score").alias("score"), F.sort_array(F.collect_list("score"), False).alias("all"))  # at most `first` values
    lead = (F.col("score") - F.coalesce(F.get("all", F.lit(1)), F.lit(0.0))) / F.col("score")
    return g.select(*by, F.col("header_row").cast("int").alias("header_row"), F.col("score").cast("double").alias("score"), F.when(F.col("score") > 0, F.least(F.lit(1.0), 0.55 + lead)).otherwise(0.0).alias("confidence"))


def _data_rows(grid: DataFrame, *by: str) -> DataFrame:
    """Rows below the header with a filled cell under one of its filled cells; adds header_row, confidence, header (cells), effective."""
    h = detect_headers(grid, *by)
    names = grid.join(h, list(by)).where(F.col("row_number") == F.col("header_row")).select(*by, "header_row", "confidence", F.col("cells").alias("header"))
    d = grid.join(names, list(by)).where(F.col("row_number") > F.col("header_row"))
    some = F.exists(F.arrays_zip("header", F.slice("cells", F.lit(1), F.size("header")).alias("cells")), lambda x: filled(x["header"]["value"]) & filled(x["cells"]["value"]))
    return d.withColumn("effective", some)


def row_estimate(seen: Column, rows: Column, last: Column, dimension: Column) -> Column:
    """Effective rows of a sheet of which only a part was read: what was seen, and the same share of the rest."""
    return F.when(dimension > last, seen + F.bround(seen / F.greatest(rows, F.lit(1)) * (dimension - last)).cast("long")).otherwise(seen)


def inspect_sheets(grid: DataFrame, *by: str, most_rows: int | None = None) -> DataFrame:
    """by..., header_row, confidence, column_count, row_count, row_count_estimated. most_rows: rows of a sheet to read before the rest is estimated; all if None."""
    d = _data_rows(grid, *by)
    dimension = grid.groupBy(*by).agg(F.max("row_number").alias("dimension"))
    if most_rows is not None:
        d = d.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("row_number"))).where(F.col("_place") <= most_rows)
    seen = d.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if("effective").alias("seen"), F.max("row_number").alias("last"))
    head = grid.join(detect_headers(grid, *by), list(by)).where(F.col("row_number") == F.col("header_row"))
    head = head.select(*by, "header_row", F.round("confidence", 3).alias("confidence"), F.size(F.filter("cells", lambda c: filled(c["value"]))).alias("column_count"))
    d = head.join(dimension, list(by)).join(seen, list(by), "left").na.fill(0, ["rows", "seen", "last"])
    partly = (F.col("rows") > 0) & (F.col("dimension") > F.col("last")) if most_rows is not None else F.lit(False)
    return d.select(*by, "header_row", "confidence", "column_count", F.when(partly, row_estimate(F.col("seen"), F.col("rows"), F.col("last"), F.col("dimension"))).otherwise(F.col("seen")).cast("long").alias("row_count"), partly.alias("row_count_estimated"))


def inspect_columns(grid: DataFrame, *by: str) -> DataFrame:
    """by..., index (from 1), header, samples (the first five filled cells), inferred_type, business_hint, hint_confidence, leading_zero_risk of every named column."""
    d = _data_rows(grid, *by)
    near = d.where(F.col("row_number") <= F.col("header_row") + SAMPLE_ROWS).select(*by, "row_number", F.posexplode("cells").alias("i", "c")).where(filled(F.col("c.value")))
    got = near.groupBy(*by, "i").agg(F.slice(F.array_sort(F.collect_list(F.struct("row_number", F.col("c.value").alias("value")))), 1, SAMPLES).alias("s"), F.bool_or(~F.col("c.is_text")).alias("numeric"))  # at most SAMPLE_ROWS cells
    head = grid.join(detect_headers(grid, *by), list(by)).where(F.col("row_number") == F.col("header_row")).select(*by, F.posexplode("cells").alias("i", "c")).where(filled(F.col("c.value")))
    h = hint(F.col("c.value"))
    head = head.select(*by, "i", F.regexp_replace("c.value", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "").alias("header"), h["field"].alias("business_hint"), h["confidence"].alias("hint_confidence"))
    d = head.join(got, [*by, "i"], "left")
    risk = F.coalesce(F.col("business_hint").isin(*CODES) & F.col("numeric"), F.lit(False))
    return d.select(*by, (F.col("i") + 1).alias("index"), "header", F.coalesce(F.transform("s", lambda x: x["value"]), F.array().cast("array<string>")).alias("samples"), F.lit("TEXT").alias("inferred_type"), "business_hint", "hint_confidence", risk.alias("leading_zero_risk"))


def recommended_sheet(sheets: DataFrame, sheet: str, place: str) -> DataFrame:
    """The sheet with the surest header, of equals the one with most rows, of equals the first by `place`."""
    return sheets.agg(F.max_by(sheet, F.struct(F.col("confidence"), F.col("row_count"), -F.col(place))).alias("recommended_sheet"))


def synonym_pairs(grid: DataFrame, source: str, target: str, *by: str, first: int = 10) -> DataFrame:
    """by..., row_number, source, target: the two named columns below the first row, among the first ten, that names both; trimmed, missing cells empty."""
    text = lambda c: F.regexp_replace(F.coalesce(c["value"], F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    d = grid.withColumn("texts", F.transform("cells", text))
    at = d.where((F.col("row_number") <= first) & F.array_contains("texts", source) & F.array_contains("texts", target))
    at = at.groupBy(*by).agg(F.min_by(F.struct("row_number", F.array_position("texts", source).alias("s"), F.array_position("texts", target).alias("t")), "row_number").alias("h"))
    d = d.join(at, list(by)).where(F.col("row_number") > F.col("h.row_number"))
    one = lambda k: F.coalesce(F.get("texts", (F.col(k) - 1).cast("int")), F.lit(""))
    return d.select(*by, "row_number", one("h.s").alias("source"), one("h.t").alias("target"))


def effective(columns: Sequence[str]) -> Column:
    """Whether any cell of the row is filled."""
    return F.coalesce(*[F.when(filled(F.col(c).cast("string")), True) for c in columns]).isNotNull()


def row_cap(df: DataFrame, ordinal: str, most: int | None) -> DataFrame:
    """The first rows by ordinal, as for a dry run; all if most is None."""
    return df if most is None else df.orderBy(ordinal).limit(most)


def with_ordinal(df: DataFrame, key: str, name: str = "row_ordinal", partitions: int | None = None) -> DataFrame:
    """Gapless ordinals from 1 in key order (null first), without one task for all rows: rank within ranges of the key plus the rows before each range."""
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = df.approxQuantile(key, [i / n for i in range(1, n)], 0.01) if n > 1 else []
    part = F.lit(0)
    for e in sorted(set(edges)):
        part = part + F.coalesce(F.col(key) > e, F.lit(False)).cast("int")
    d = df.withColumn("_part", part)
    before = d.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    d = d.join(F.broadcast(before.select("_part", "_before")), "_part")
    return d.withColumn(name, (F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(key))).cast("long")).drop("_part", "_before")
