"""Load a table by file suffix, save it, and keep snapshots.

Text formats are read as strings first; the NA words become NULL and one aggregate decides
the column types, so a stray ``NA`` does not turn a number column into text.
"""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabml.functions.columns import col

# fixed values: words that mean a missing value
NA_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# fixed values: words that mean a truth value
TRUE_WORDS = ["True", "TRUE", "true"]
FALSE_WORDS = ["False", "FALSE", "false"]
WHOLE = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"


def load(spark: SparkSession, path: str) -> DataFrame:
    """Any path Spark can reach; the suffix picks the reader, CSV is the fallback."""
    name = urlparse(path).path.lower().rstrip("/")
    if name.endswith(".xlsx"):
        from tabml.sources.xlsx import read_xlsx
        return read_xlsx(spark, path)
    if name.endswith(".xls"):
        raise ValueError("binary .xls workbooks are not supported; save as .xlsx")
    if name.endswith((".tsv", ".txt")):
        return read_csv(spark, path, sep="\t")
    if name.endswith(".json"):
        return read_json(spark, path)
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv(spark, path)


def read_csv(spark: SparkSession, path: str, sep: str = ",", multiline: bool | None = None) -> DataFrame:
    """Header row, quoted fields, NA words, inferred types.

    A file stays splittable unless one of its lines holds an odd number of quotes, which is how a
    line break inside a field shows; that is looked up once per file unless ``multiline`` is given.
    """
    def strings(paths, broken: bool) -> DataFrame:
        return spark.read.csv(paths, sep=sep, header=True, quote='"', escape='"', multiLine=broken, inferSchema=False)

    if multiline is not None:
        return typed(strings(path, multiline))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    files = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.bool_or(odd).alias("broken"))
    kinds = {r["broken"]: r["files"] for r in files.groupBy("broken").agg(F.collect_list("file").alias("files")).collect()}
    if len(kinds) < 2:
        return typed(strings(path, True in kinds))
    return typed(strings(kinds[False], False).unionByName(strings(kinds[True], True), allowMissingColumns=True))


def read_json(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """Records from JSON files: lines of one record or array each, or one array or record per file.

    Unless ``multiline`` is given, each file is told by its lines: where every line with text is a
    whole value the file is read by lines (and stays splittable), else as one value. Columns are
    those of all files.
    """
    if multiline is not None:
        return spark.read.json(path, multiLine=multiline)
    line = F.trim("value")
    whole = line.rlike(r"^[\[{]") & F.try_parse_json(line).isNotNull()
    lines = spark.read.text(path).filter(F.length(line) > 0).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.bool_and(whole).alias("by_line"))
    kinds = {r["by_line"]: r["n"] for r in lines.groupBy("by_line").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return spark.read.json(path, multiLine=False in kinds)
    parts = [spark.read.json([r["file"] for r in lines.filter(F.col("by_line") == kind).collect()], multiLine=not kind) for kind in (True, False)]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_records(spark: SparkSession, records: dict | list[dict]) -> DataFrame:
    """One record or a list of records handed over by a caller."""
    rows = [records] if isinstance(records, dict) else list(records)
    return spark.createDataFrame(rows)


def without_na(c: Column) -> Column:
    return F.when(~c.isin(NA_WORDS), c)


def whole_number(c: Column) -> Column:
    """The bigint a string holds, else NULL. A cast that fails raises an error inside, which costs far more
    than a look at the text, so only texts that look like a bigint are cast."""
    return F.when(c.rlike(WHOLE) & (F.abs(c.try_cast("double")) < 9.3e18), c.try_cast("bigint"))


def typed(strings: DataFrame) -> DataFrame:
    """Give string columns their types: boolean, bigint, double, else string; no values: double."""
    v = without_na(F.col("value"))
    # a row per cell: one small expression serves all columns, however many there are
    cells = strings.select(F.posexplode(F.array(*[col(name) for name in strings.columns])).alias("i", "value"))
    told = cells.select("i", v.alias("value")).filter("value IS NOT NULL").groupBy("i").agg(
        F.bool_and(F.col("value").isin(TRUE_WORDS + FALSE_WORDS)).alias("boolean"),
        F.bool_and(whole_number(F.col("value")).isNotNull()).alias("whole"),
        F.bool_and(F.col("value").rlike(NUMBER)).alias("number"))
    found = {r["i"]: r for r in told.collect()}
    out = []
    for i, name in enumerate(strings.columns):
        v = without_na(col(name))
        if i in found and found[i]["boolean"]:
            v = v.isin(TRUE_WORDS)
        elif i in found and found[i]["whole"] and found[i]["number"]:
            v = v.try_cast("bigint")
        elif i not in found or found[i]["number"]:
            v = v.try_cast("double")
        out.append(v.alias(name))
    return strings.select(*out)


def save(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header for ``.csv``, JSON lines for ``.json``, Parquet otherwise."""
    name = urlparse(path).path.lower().rstrip("/")
    if name.endswith(".csv"):
        df.write.mode(mode).csv(path, header=True, quote='"', escape='"')
    elif name.endswith(".json"):
        df.write.mode(mode).json(path)
    else:
        df.write.mode(mode).parquet(path)


def snapshot(df: DataFrame, base: str, name: str) -> str:
    """Write a dated copy below ``base`` and return its path."""
    stamp = df.sparkSession.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]
    path = f"{base.rstrip('/')}/{name}_{stamp}"
    df.write.parquet(path)
    return path
