"""Column profiles as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabml.functions.columns import (
    categorical_columns, col, kind_of, numeric_columns, one_row_per_column, present,
)
from tabml.functions.ranks import exact_quantiles

FEW_VALUES = 1_000   # below this sketched distinct count, exact counting is cheap


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, position, missing); NaN counts as missing."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.count_if(present(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)])
    return one_row_per_column(wide, columns, {c: {"missing": F.col(f"m{i}")} for i, c in enumerate(columns)})


def shape(df: DataFrame) -> DataFrame:
    """(n_samples, n_features); like the metadata record, n_features counts every column."""
    return df.agg(F.count(F.lit(1)).alias("n_samples")).withColumn("n_features", F.lit(len(df.columns)).cast("bigint"))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation) and max per numeric column."""
    columns = list(numeric_columns(df) if columns is None else columns)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggregates, fields = [], {}
    for i, c in enumerate(columns):
        x = present(df, c).cast("double")
        for name, e in {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x),
                        "min": F.min(x), "max": F.max(x)}.items():
            aggregates.append(e.alias(f"{name}{i}"))
        q1, q2, q3 = (F.lit(v).cast("double") for v in quartiles[c])
        fields[c] = {"count": F.col(f"count{i}"), "mean": F.col(f"mean{i}"), "std": F.col(f"std{i}"),
                     "min": F.col(f"min{i}"), "p25": q1, "p50": q2, "p75": q3, "max": F.col(f"max{i}")}
    return one_row_per_column(df.agg(*aggregates), columns, fields)


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n) for every non-missing value of the categorical columns."""
    columns = list(categorical_columns(df) if columns is None else columns)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("value")) for c in columns
    ])).alias("s")).select("s.*")
    return long.filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def nunique(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, position, distinct): distinct non-missing values."""
    columns = list(columns or df.columns)
    if approx:
        wide = df.agg(*[F.approx_count_distinct(present(df, c)).alias(f"d{i}") for i, c in enumerate(columns)])
    else:
        wide = _exact_distinct(df, columns)
    return one_row_per_column(wide, columns, {c: {"distinct": F.col(f"d{i}")} for i, c in enumerate(columns)})


def _exact_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with ``d0``, ``d1``, ...: distinct values of each column.

    Columns of one type travel together as (column, value), so a value is shuffled by itself and not
    in a row with an empty place for every other column.
    """
    alike: dict = {}
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        alike.setdefault(T.LongType() if isinstance(kind, T.IntegralType) else kind, []).append((i, c))
    found = None
    for kind, some in alike.items():
        cells = df.select(F.posexplode(F.array(*[present(df, c).cast(kind) for _, c in some])).alias("p", "v"))
        values = cells.filter("v IS NOT NULL").distinct().groupBy("p").agg(F.count(F.lit(1)).alias("n"))
        values = values.select(F.get(F.lit([i for i, _ in some]), F.col("p")).alias("i"), "n")
        found = values if found is None else found.unionByName(values)
    return found.agg(*[F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0).cast("bigint")).alias(f"d{i}") for i in range(len(columns))])


def few_distinct(df: DataFrame, columns: list[str] | None = None) -> dict[str, int | None]:
    """Exact distinct counts where they are small; None where a sketch shows many values.

    One cheap sketch pass sorts out the wide columns, so the exact count never shuffles
    them: the target and task rules only ask whether a count is 2, up to 10 or up to 20.
    """
    columns = list(columns or df.columns)
    rough = df.agg(*[F.approx_count_distinct(present(df, c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    small = [c for i, c in enumerate(columns) if rough[f"d{i}"] <= FEW_VALUES]
    exact = dict.fromkeys(columns)
    if small:
        def plain(c):       # -0.0 and 0.0 are one value
            x = present(df, c)
            return x + 0.0 if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else x
        # few values fit a set, so one pass without a row per column counts them all
        row = df.agg(*[F.size(F.collect_set(plain(c))).cast("bigint").alias(f"d{i}") for i, c in enumerate(small)]).first()
        exact.update({c: row[f"d{i}"] for i, c in enumerate(small)})
    return exact


def feature_types(df: DataFrame, target: str) -> DataFrame:
    """(column, position, kind, present): kinds of the feature columns and how many values they hold."""
    columns = [c for c in df.columns if c != target]
    wide = df.agg(*[F.count(present(df, c)).alias(f"n{i}") for i, c in enumerate(columns)])
    return one_row_per_column(wide, columns, {
        c: {"kind": F.lit(kind_of(df.schema[c].dataType)), "present": F.col(f"n{i}")} for i, c in enumerate(columns)})


def missing_flags(df: DataFrame, target: str | None = None) -> DataFrame:
    """(missing_numeric, missing_categorical): does any feature of the kind miss a value?"""
    def any_missing(columns):
        if not columns:
            return F.lit(False)
        gap = F.lit(False)
        for c in columns:
            gap = gap | present(df, c).isNull()
        return F.coalesce(F.bool_or(gap), F.lit(False))

    skip = () if target is None else (target,)
    return df.agg(any_missing(numeric_columns(df, skip)).alias("missing_numeric"),
                  any_missing(categorical_columns(df, skip)).alias("missing_categorical"))


# fixed values: a text column averages more than 20 characters over its first 10 values
TEXT_SAMPLE = 10
TEXT_LENGTH = 20


def text_columns(df: DataFrame, target: str, key: str | None = None) -> DataFrame:
    """(column, avg_length) of string columns that read like text.

    The first 10 non-missing values in ``key`` order decide. Without a key there is no
    stable order between files, so the average over all rows is used.
    """
    found = None
    for c in categorical_columns(df, exclude=(target,)):
        if key is None:
            part = df.select(col(c).alias("v"))
        else:
            part = df.select(col(key).alias("k"), col(c).alias("v")).filter("v IS NOT NULL").orderBy("k").limit(TEXT_SAMPLE)
        part = part.agg(F.avg(F.length("v")).alias("avg_length")).select(F.lit(c).alias("column"), "avg_length")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.sparkSession.createDataFrame([], "column string, avg_length double")
    return found.filter(F.col("avg_length") > TEXT_LENGTH)


def ingest_summary(df: DataFrame, key: str | None = None) -> DataFrame:
    """(rows, cols, target_column, task_type) right after loading."""
    return metadata(df, key).select(
        F.col("n_samples").alias("rows"), F.lit(",".join(df.columns)).alias("cols"), "target_column", "task_type")


def metadata(df: DataFrame, key: str | None = None, target: str | None = None) -> DataFrame:
    """The one-row dataset record: target, features, task, counts, kinds, missing map, confidence."""
    from tabml.operators.target import classify_task, detect_target, target_scores

    if target is None:
        found = detect_target(df).first()
        name, confidence = found["target_column"], found["confidence_score"]
    else:
        found = target_scores(df).filter(F.col("column") == target).first()
        name, confidence = target, found["score"] if found else 1
    features = [c for c in df.columns if c != name]
    task = classify_task(df, name, key)
    counted = df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        *[F.count_if(present(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(features)])
    pairs = [e for i, c in enumerate(features) for e in (F.lit(c), F.col(f"m{i}"))]
    verdict = task.select(F.struct("task_type", "task_reason", "n_classes")).scalar()
    return counted.select("n_samples", F.create_map(*pairs).alias("missing_values"), verdict.alias("t")).select(
        F.lit(name).alias("target_column"),
        F.lit(features).alias("feature_columns"),
        "t.task_type", "t.task_reason", "n_samples",
        F.lit(len(df.columns)).cast("bigint").alias("n_features"),
        "t.n_classes",
        F.lit(df.schema[name].dataType.simpleString()).alias("target_dtype"),
        F.lit(numeric_columns(df, (name,))).cast("array<string>").alias("numeric_features"),
        F.lit(categorical_columns(df, (name,))).cast("array<string>").alias("categorical_features"),
        "missing_values",
        F.lit(confidence).cast("double").alias("confidence_score"))


def profile(df: DataFrame, key: str | None = None) -> DataFrame:
    """All of the above as one long table (section, column, stat, value)."""
    def long(part: DataFrame, section: str, stats: list[str]) -> DataFrame:
        cells = [F.struct(F.lit(s).alias("stat"), F.col(s).cast("string").alias("value")) for s in stats]
        return part.select(F.lit(section).alias("section"), F.col("column"), F.explode(F.array(*cells)).alias("c")).select(
            "section", "column", "c.stat", "c.value")

    found = metadata(df, key)
    fact = found.first()
    record = df.sparkSession.createDataFrame([fact], found.schema)      # computed once
    facts = record.select(F.lit(None).cast("string").alias("column"), "n_samples", "n_features", "target_column",
                          "task_type", "task_reason", "n_classes", "confidence_score")
    target = fact["target_column"]
    kinds = feature_types(df, target)
    stats = describe(df, numeric_columns(df, (target,)))
    numbers = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    stats = stats.withColumns({n: F.format_string("%.4f", F.round(n, 4) + F.lit(0.0)) for n in numbers})
    dtypes = null_counts(df).withColumn("dtype", _dtype_case(df))
    counts = value_counts(df, categorical_columns(df, (target,))).select(
        F.lit("category").alias("section"), "column", F.col("value").alias("stat"), F.col("n").cast("string").alias("value"))
    return (long(facts, "dataset", [c for c in facts.columns if c != "column"])
            .unionByName(long(dtypes, "column", ["dtype", "missing"]))
            .unionByName(long(kinds, "feature", ["kind"]))
            .unionByName(long(stats, "numeric", ["count", *numbers]))
            .unionByName(counts))


def _dtype_case(df: DataFrame):
    out = F.lit(None).cast("string")
    for name, dtype in df.dtypes:
        out = F.when(F.col("column") == name, dtype).otherwise(out)
    return out
