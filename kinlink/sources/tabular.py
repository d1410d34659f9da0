"""CSV and XLSX files as tables of nullable text with row positions.

Quoted line breaks make record numbers sequential within a file, so one file is
one task and many files are many tasks; a file comes in as bytes through
Spark's own reader and needs no shared local path. `row_number` is the visible
row of the file, `row_ordinal` counts the filled rows from 1.
"""

from __future__ import annotations

import csv
import datetime
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.errors import ConfigError
from kinlink.sources import layout

SNIFF, BATCH, FIRST = 256 << 10, 4096, 30
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def encoding_of(head: bytes) -> str:
    """UTF-8, with or without mark, if the first bytes are; else GB 18030."""
    for cut in range(4):  # a character may be cut at the end
        try:
            head[: len(head) - cut].decode("utf-8-sig")
            return "utf-8-sig"
        except UnicodeDecodeError:
            if len(head) < SNIFF:
                break
    return "gb18030"


def csv_records(data: bytes) -> Iterator[list]:
    text = io.TextIOWrapper(io.BytesIO(data), encoding_of(data[:SNIFF]), newline="")
    yield from csv.reader(text)


def date_text(serial: float) -> str:
    """What a date cell's serial number stands for; below 1 a time of day alone."""
    whole = datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=round(serial * 86_400))
    return whole.strftime("%H:%M:%S" if serial < 1 else "%Y-%m-%d %H:%M:%S")


def cell_text(value, kind: str | None, dated: bool = False) -> str | None:
    """Text of a sheet's cell: TRUE/FALSE, dates as such, whole numbers without point, else as it stands."""
    if value is None:
        return None
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if kind in (None, "n"):
        try:
            f = float(value)
        except ValueError:
            return value
        if dated:
            return date_text(f)
        return str(int(f)) if f.is_integer() and abs(f) < 1e15 else repr(f)
    return value


def date_styles(styles: bytes) -> set[int]:
    """Cell styles that show a number as date or time: by the format's number, or by its letters outside quotes and brackets."""
    root = ElementTree.fromstring(styles)
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{{{_NS['m']}}}numFmt")}
    letters = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code).lower()
    xfs = root.find("m:cellXfs", _NS)
    kinds = [int(x.get("numFmtId") or 0) for x in (xfs if xfs is not None else [])]
    return {i for i, k in enumerate(kinds) if 14 <= k <= 22 or 45 <= k <= 47 or 27 <= k <= 36 or 50 <= k <= 58 or re.search("[dmyhs]", letters(own.get(k, "")))}


def sheet_names(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS)]


def xlsx_cells(data: bytes, sheet: str | None = None) -> Iterator[tuple[int, list]]:
    """Rows of one sheet that the file holds, with their numbers, as (text, whether it is text, not a number) or None; gaps between rows are not filled."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): links[s.get(f"{{{_NS['r']}}}id")] for s in book.find("m:sheets", _NS)}
        name = sheet or next(iter(sheets))
        if name not in sheets:
            raise ConfigError("SHEET_NOT_FOUND", name)
        strings: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        dates = date_styles(z.read("xl/styles.xml")) if "xl/styles.xml" in z.namelist() else set()
        path = sheets[name].lstrip("/")
        with z.open(path if path.startswith("xl/") else f"xl/{path}") as f:
            at = 0
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                at = int(row.get("r") or at + 1)
                out: list = []
                for c in row.findall("m:c", _NS):
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    col = len(out)
                    if letters:
                        col = 0
                        for ch in letters.group():
                            col = col * 26 + ord(ch) - 64
                        col -= 1
                    out += [None] * (col - len(out))
                    kind, v = c.get("t"), c.find("m:v", _NS)
                    dated = kind in (None, "n") and int(c.get("s") or 0) in dates
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif kind == "s":
                        text = strings[int(v.text)]
                    else:
                        text = cell_text(None if v is None else v.text, kind, dated)
                    out.append(None if text is None else (text, kind not in (None, "n", "b") and not dated))
                yield at, out
                row.clear()


def numbered_cells(path: str, data: bytes, sheet: str | None) -> Iterator[tuple[int, list]]:
    """(row number, cells as (text, is_text) or None) of a file."""
    low = path.lower()
    if low.endswith((".xlsx", ".xlsm")):
        return xlsx_cells(data, sheet)
    if low.endswith(".xls"):
        raise ConfigError("FILE_TYPE_UNSUPPORTED", path)
    return ((i, [(v, True) for v in r]) for i, r in enumerate(csv_records(data), 1))


def records(path: str, data: bytes, sheet: str | None) -> Iterator[tuple[int, list]]:
    """(row number, texts) of a file."""
    return ((n, [None if c is None else c[0] for c in r]) for n, r in numbered_cells(path, data, sheet))


def first_rows(spark: SparkSession, path: str, sheet: str | None = None, n: int = FIRST) -> list[list]:
    """Texts of the first n rows of the first file, rows that it leaves out as empty ones."""
    def head(batches):
        for b in batches:
            for p, d in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows: list[list] = []
                for number, r in records(p, d, sheet):
                    if number > n:
                        break
                    rows += [[]] * (number - 1 - len(rows)) + [r]
                yield pa.RecordBatch.from_arrays([pa.array([rows], pa.list_(pa.list_(pa.string())))], ["rows"])

    got = spark.read.format("binaryFile").load(path).select("path", "content").orderBy("path").limit(1).mapInArrow(head, "rows array<array<string>>").collect()
    return [list(r) for r in got[0]["rows"]] if got else []


def grid(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """path, sheet, place, row_number, cells of every sheet of the files: what `layout` inspects. first: rows of a sheet to read."""
    cell = pa.list_(pa.struct([("value", pa.string()), ("is_text", pa.bool_())]))

    def parse(batches):
        for b in batches:
            for p, d in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for place, sheet in enumerate(sheet_names(d) if p.lower().endswith((".xlsx", ".xlsm")) else [None]):
                    numbers, rows = [], []
                    for number, r in numbered_cells(p, d, sheet):
                        if first is not None and number > first:
                            break
                        numbers.append(number)
                        rows.append([None if c is None else {"value": c[0], "is_text": c[1]} for c in r])
                        if len(rows) == BATCH:
                            yield _grid_batch(p, sheet, place, numbers, rows, cell)
                            numbers, rows = [], []
                    if rows:
                        yield _grid_batch(p, sheet, place, numbers, rows, cell)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, f"path string, sheet string, place int, row_number long, cells {layout.CELLS}")


def _grid_batch(path, sheet, place, numbers, rows, cell) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([sheet] * n, pa.string()), pa.array([place] * n, pa.int32()), pa.array(numbers, pa.int64()), pa.array(rows, cell)], ["path", "sheet", "place", "row_number", "cells"])


def inspect(spark: SparkSession, path: str, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sheets, columns) of files: header rows, row counts, and what each column holds and may mean; lazily, for all files at once."""
    g = grid(spark, path, first).withColumn("sheet", F.coalesce("sheet", F.lit("")))
    return layout.inspect_sheets(g, "path", "sheet", "place"), layout.inspect_columns(g, "path", "sheet", "place")


_INSPECTED: dict[tuple, tuple] = {}


def inspected(spark: SparkSession, path: str, first: int | None = None, most: int = 32) -> tuple[list, list]:
    """`inspect`, collected (a row a sheet and a row a column) and kept for the `most` last used of unchanged files."""
    stat = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length").orderBy("path").collect()
    key = (path, first, *map(tuple, stat))
    got = _INSPECTED.pop(key, None) or tuple(d.collect() for d in inspect(spark, path, first))
    _INSPECTED[key] = got
    while len(_INSPECTED) > most:
        _INSPECTED.pop(next(iter(_INSPECTED)))
    return got


def header_row_of(spark: SparkSession, path: str, sheet: str | None = None) -> int:
    """Header row of one sheet of the first file."""
    g = grid(spark, path, FIRST)
    g = g.where(F.col("sheet") == sheet) if sheet else g.where("place = 0")
    got = layout.detect_headers(g, "path").orderBy("path").first()
    return got["header_row"] if got else 1


def read_table(spark: SparkSession, path: str, sheet: str | None = None, header_row: int | None = None) -> DataFrame:
    """Table of one file, or of several with the same header: its columns, row_number and row_ordinal. The header row is found if not given; of equal headers the last counts."""
    at = header_row or header_row_of(spark, path, sheet)
    rows = first_rows(spark, path, sheet, max(FIRST, at))
    if not rows or at > len(rows):
        raise ConfigError("HEADER_NOT_FOUND", path)
    columns = list(dict.fromkeys(h.strip() for h in rows[at - 1] if h is not None and h.strip()))
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField("row_number", T.LongType(), False), T.StructField("row_ordinal", T.LongType(), False)])

    def parse(batches):
        for b in batches:
            for p, d in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                is_csv = not p.lower().endswith((".xlsx", ".xlsm"))
                place: dict[str, int] = {}
                out: list[list] = []
                ordinal = 0
                for number, r in records(p, d, sheet):
                    if number < at:
                        continue
                    if number == at:
                        place = {h.strip(): i for i, h in enumerate(r) if h is not None and h.strip()}
                        continue
                    v = [r[i] if i is not None and i < len(r) else None for i in (place.get(c) for c in columns)]
                    if not any(x is not None and x.strip() for x in v):
                        continue
                    ordinal += 1
                    out.append([None if x is None or (is_csv and not x.strip()) else x for x in v] + [number, ordinal])
                    if len(out) == BATCH:
                        yield _batch(out, schema)
                        out = []
                if out:
                    yield _batch(out, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, schema)


def read_rows(spark: SparkSession, path: str, sheet: str | None = None, header_row: int | None = None) -> DataFrame:
    """`read_table` without the visible row numbers."""
    return read_table(spark, path, sheet, header_row).drop("row_number")


def _batch(rows: list[list], schema: T.StructType) -> pa.RecordBatch:
    types = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)


def digest_files(spark: SparkSession, path: str) -> DataFrame:
    """Content digests of files, equal contents once."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), "path").groupBy("sha256", "size_bytes").agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def assemble(spark: SparkSession, path: str, out: str, size: int, sha256: str) -> None:
    """Joins uploaded parts (files of a folder, by name) into one file, which appears at `out` only if its size and digest are right. One part at a time is held."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    draft, target = fs_path(f"{out}.part"), fs_path(out)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    got, digest = 0, hashlib.sha256()
    stream = fs.create(draft, True)
    try:
        for name in sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()):
            data = bytes(spark.read.format("binaryFile").load(name).select("content").first()["content"])
            stream.write(bytearray(data))
            digest.update(data)
            got += len(data)
    finally:
        stream.close()
    if got != size or digest.hexdigest() != sha256:
        fs.delete(draft, False)
        raise ConfigError("UPLOAD_INCOMPLETE", f"{got} of {size} bytes")
    fs.rename(draft, target)
