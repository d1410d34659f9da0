"""Result tables: one Parquet folder each, partitioned by task."""

from __future__ import annotations

import io
import tempfile
import zipfile
from typing import BinaryIO
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.errors import ConfigError

SHEET_ROWS = 1_048_575


def save(df: DataFrame, root: str, table: str, task_id: str) -> None:
    """Replaces the task's partition of a table and leaves other tasks alone, so a rerun is idempotent."""
    df.withColumn("task_id", F.lit(task_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(f"{root}/{table}")


def load(spark: SparkSession, root: str, table: str, task_id: str | None = None) -> DataFrame:
    d = spark.read.parquet(f"{root}/{table}")
    return d if task_id is None else d.where(F.col("task_id") == task_id)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; only in one local process, as in tests, a temporary folder where it is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ConfigError("SHARED_FOLDER_MISSING", "set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="kinlink-")


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file to whatever file system `path` names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def workbook(sheets: dict[str, DataFrame]) -> bytes:
    """A small workbook as bytes; `write_workbook` writes any."""
    out = io.BytesIO()
    write_workbook(sheets, out)
    return out.getvalue()


def write_workbook(sheets: dict[str, DataFrame], out: BinaryIO) -> None:
    """An XLSX workbook of report sheets to an open file, row by row and partition by partition; a sheet's limit is that of the format."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(sheets) + 1)
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, sheets, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        for i, (name, df) in zip(n, sheets.items(), strict=True):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                f.write(_row(1, df.columns))
                for k, r in enumerate(df.toLocalIterator(), 2):
                    if k > SHEET_ROWS + 1:
                        raise ConfigError("SHEET_TOO_LONG", name)
                    f.write(_row(k, r))
                f.write(b"</sheetData></worksheet>")


def _row(k: int, values) -> bytes:
    cells = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' if v is not None else "<c/>" for v in values)
    return f'<row r="{k}">{cells}</row>'.encode()
