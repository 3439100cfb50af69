"""Files made from the given tables, to be read back by the readers."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabml.session import scratch_path

CONTENT = """<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">
<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>
<Default Extension="xml" ContentType="application/xml"/></Types>"""
WORKBOOK = """<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"
 xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>"""
LINKS = """<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>"""
STYLES = """<?xml version="1.0"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>"""


def workbook(pdf: pd.DataFrame) -> bytes:
    """A minimal workbook: strings inline, numbers, truth values and dates as Excel stores them."""
    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, pd.Timestamp):
            days = (v - pd.Timestamp("1899-12-30")).total_seconds() / 86400
            return f'<c s="1"><v>{days!r}</v></c>'
        if isinstance(v, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        return f"<c><v>{v!r}</v></c>"

    lines = ["<row>" + "".join(cell(str(c)) for c in pdf.columns) + "</row>"]
    lines += ["<row>" + "".join(cell(v) for v in row) + "</row>" for row in pdf.astype(object).itertuples(index=False)]
    sheet = ('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
             f"<sheetData>{''.join(lines)}</sheetData></worksheet>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in {"[Content_Types].xml": CONTENT, "xl/workbook.xml": WORKBOOK, "xl/_rels/workbook.xml.rels": LINKS,
                           "xl/styles.xml": STYLES, "xl/worksheets/sheet1.xml": sheet}.items():
            book.writestr(name, text)
    return out.getvalue()


def write_workbooks(df: DataFrame, key: str, rows_per_book: int = 500, sparse: bool = False) -> str:
    """One workbook per block of keys, written by the tasks to the shared folder; ``sparse``
    workbooks leave out columns in which they have no values."""
    folder = scratch_path(df.sparkSession, "books")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs
        uri = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
        system, path = fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")
        system.create_dir(path, recursive=True)
        name = f"part-{pdf['_book'].iloc[0]}.xlsx"
        with system.open_output_stream(f"{path}/{name}") as out:
            pdf = pdf.drop(columns="_book")
            out.write(workbook(pdf.dropna(axis=1, how="all") if sparse else pdf))
        return pd.DataFrame({"name": [name]})

    blocks = df.withColumn("_book", F.floor(F.col(key) / rows_per_book))
    blocks.groupBy("_book").applyInPandas(write, "name string").count()
    return folder


def write_json_arrays(df: DataFrame, key: str, rows_per_file: int = 1000) -> str:
    """Files that each hold one JSON array of records."""
    path = scratch_path(df.sparkSession, "arrays") + ".json"
    records = F.to_json(F.collect_list(F.struct(*df.columns)))
    chunks = df.groupBy(F.floor(F.col(key) / rows_per_file)).agg(records.alias("value")).select("value")
    chunks.write.option("maxRecordsPerFile", 1).text(path)
    return path


def write_task_logs(tasks: DataFrame, key: str, tasks_per_file: int = 1000) -> str:
    """Log files: one JSON object per file, task id → record."""
    path = scratch_path(tasks.sparkSession, "tasks")
    entries = F.map_from_entries(F.collect_list(F.struct("task_id", "task")))
    logs = tasks.groupBy(F.floor(F.col(key) / tasks_per_file)).agg(F.to_json(entries).alias("value")).select("value")
    logs.write.option("maxRecordsPerFile", 1).text(path)
    return path


def write_csv(df: DataFrame, suffix: str, sep: str) -> str:
    path = scratch_path(df.sparkSession, "text") + suffix
    df.write.csv(path, sep=sep, header=True, quote='"', escape='"', nullValue="NA", emptyValue="")
    return path
