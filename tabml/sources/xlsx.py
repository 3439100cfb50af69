"""First sheet of many .xlsx workbooks: one task per workbook, values as typed columns."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabml.functions.columns import col
from tabml.session import materialize
from tabml.sources.files import whole_number, without_na

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# fixed values: built-in number formats that show dates or times
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
BATCH_ROWS = 10_000
ROW_SCHEMA = "book string, row_no bigint, cells map<string, struct<v: string, t: string, p: int>>"


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Header row and typed columns, those of all workbooks, matched by name: the first workbook's
    in their order, then what later ones add. Repeated names get a number, empty ones their place."""
    books = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(
        F.lower("path").endswith(".xlsx")).select("path", "content")
    tasks = min(max(1, books.select("path").count()), 4 * spark.sparkContext.defaultParallelism)
    books = books.repartition(tasks)
    rows = materialize(books.mapInPandas(_parse_books, ROW_SCHEMA), "xlsx")       # the XML is parsed once
    header = rows.select("book", F.explode("cells").alias("name", "cell")).groupBy("name").agg(
        F.min(F.struct("book", "cell.p")).alias("first")).orderBy("first").collect()
    names = [r["name"] for r in header]
    body = rows.filter("row_no > 0").select([F.col("cells")[n].alias(n) for n in names])

    def cell(n):
        value = col(n)["v"]
        return F.when(col(n)["t"] == "s", without_na(value)).otherwise(value)

    checks = []
    for i, n in enumerate(names):
        kind = F.when(cell(n).isNotNull(), col(n)["t"])
        checks.append(F.collect_set(kind).alias(f"k{i}"))
        checks.append(F.count_if((kind == "n") & whole_number(cell(n)).isNull()).alias(f"f{i}"))
    found = body.agg(*checks).first()
    out = []
    for i, n in enumerate(names):
        kinds = set(found[f"k{i}"])
        value = cell(n)
        if kinds <= {"n"}:
            value = value.cast("double" if found[f"f{i}"] or not kinds else "bigint")
        elif kinds == {"b"}:
            value = value == "1"
        elif kinds == {"d"}:
            value = value.cast("timestamp_ntz")
        out.append(value.alias(n))
    return body.select(*out)


def _parse_books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            names, rows = None, []
            for number, cells in enumerate(_sheet_rows(bytes(content))):
                if names is None:
                    names = _names({place: value for place, (value, _) in cells.items()})
                    cells = {place: (None, "s") for place in names}
                for place in cells.keys() - names.keys():
                    names[place] = f"Unnamed: {place}"
                row = {names[p]: {"v": v, "t": t, "p": p} for p, (v, t) in cells.items()}
                rows.append((path, number, row))
                if len(rows) == BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=["book", "row_no", "cells"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["book", "row_no", "cells"])


def _names(header: dict[int, str]) -> dict[int, str]:
    """Column names by place: a repeated one gets .1, .2 and so on."""
    names, seen = {}, set()
    for place in range(max(header, default=-1) + 1):
        name = base = header.get(place) or f"Unnamed: {place}"
        number = 0
        while name in seen:
            number += 1
            name = f"{base}.{number}"
        seen.add(name)
        names[place] = name
    return names


def _sheet_rows(content: bytes) -> Iterator[dict[int, tuple[str, str]]]:
    """Per row {column number: (text, kind)}; kinds: n number, s text, b truth value, d date."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared_strings(book)
        dates = _date_styles(book)
        with book.open(_first_sheet(book)) as sheet:
            for _, element in ElementTree.iterparse(sheet):
                if element.tag != f"{MAIN}row":
                    continue
                cells = {}
                for position, c in enumerate(element.iter(f"{MAIN}c")):
                    value = _cell(c, shared, dates)
                    if value is not None:
                        cells[_column(c.get("r"), position)] = value
                if cells:
                    yield cells
                element.clear()


def _cell(c, shared, dates) -> tuple[str, str] | None:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{MAIN}t")), "s"
    v = c.find(f"{MAIN}v")
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(v.text)], "s"
    if kind in ("str", "b"):
        return v.text, "s" if kind == "str" else "b"
    if kind == "d" or int(c.get("s", 0)) in dates:
        if kind == "d":
            return v.text, "d"
        return (datetime(1899, 12, 30) + timedelta(seconds=round(float(v.text) * 86400))).isoformat(), "d"
    number = float(v.text)
    return (str(int(number)) if number.is_integer() and abs(number) < 2 ** 53 else repr(number)), "n"


def _column(reference: str | None, position: int) -> int:
    if not reference:
        return position
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _part(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    root = _part(book, "xl/sharedStrings.xml")
    return [] if root is None else ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in root.iter(f"{MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    root = _part(book, "xl/styles.xml")
    if root is None:
        return set()
    own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt")
           if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
    cells = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _first_sheet(book: zipfile.ZipFile) -> str:
    workbook, links = _part(book, "xl/workbook.xml"), _part(book, "xl/_rels/workbook.xml.rels")
    first = next(workbook.iter(f"{MAIN}sheet")).get(RELATION)
    target = next(link.get("Target") for link in links if link.get("Id") == first)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
