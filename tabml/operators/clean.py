"""Duplicates, missing values and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabml.functions.columns import categorical_columns, col, normalize_missing, numeric_columns, present
from tabml.functions.ranks import exact_quantiles
from tabml.operators.profile import value_counts
from tabml.session import materialize

FENCE = 1.5   # fixed value: quartile distances allowed beyond the quartiles


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each set of equal rows (missing values count as equal)."""
    return df.dropDuplicates()


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items() if q[0] is not None}


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, ties to the smallest; counted before anything is compared."""
    if not columns:
        return {}
    counted = value_counts(df, columns)
    best = counted.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best"))
    return {r["column"]: r["best"]["value"] for r in best.collect()}


def missing_columns(df: DataFrame, columns: list[str]) -> list[str]:
    if not columns:
        return []
    row = df.agg(*[F.bool_or(present(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"m{i}"]]


def impute_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing numbers become the exact column median; such a column turns to double."""
    columns = missing_columns(df, list(numeric_columns(df) if columns is None else columns))
    fill = medians(df, columns)
    return df.withColumns({c: F.coalesce(present(df, c).cast("double"), F.lit(v)) for c, v in fill.items()}) if fill else df


def impute_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing strings become the most frequent value of the column."""
    columns = missing_columns(df, list(categorical_columns(df) if columns is None else columns))
    fill = modes(df, columns)
    return df.withColumns({c: F.coalesce(col(c), F.lit(v)) for c, v in fill.items()}) if fill else df


def _inside(df: DataFrame, name: str, quartiles: list[float | None]):
    q1, q3 = quartiles
    if q1 is None:
        return F.lit(False)
    reach = FENCE * (q3 - q1)
    return present(df, name).between(q1 - reach, q3 + reach)


def iqr_filter(df: DataFrame, columns: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Drop rows outside the quartile fences, column after column: each column's quartiles
    come from the rows that the columns before it left over.

    Columns are looked at together, as a column that drops no row leaves the quartiles of the next as they
    are; behind one that does, the rest starts anew, with one column first, then two, four and so on.
    """
    n = df.count()
    left = list(numeric_columns(df, exclude) if columns is None else columns)
    together = len(left)
    while left:
        some = left[:together]
        found = exact_quantiles(df, some, [0.25, 0.75], at_most=n * len(some))      # one pass holds the values of all
        fences = [_inside(df, c, found[c]) for c in some]
        drops = df.agg(*[F.bool_or(~F.coalesce(fence, F.lit(False))).alias(f"d{i}") for i, fence in enumerate(fences)]).first()
        first = next((i for i in range(len(some)) if drops[i]), None)
        if first is None:
            left, together = left[len(some):], 2 * together
        else:
            df, left, together = df.filter(fences[first]), left[first + 1:], 1
    return df


def iqr_filter_joint(df: DataFrame, columns: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The one-pass form: all fences come from the same input."""
    columns = list(numeric_columns(df, exclude) if columns is None else columns)
    for c, quartiles in exact_quantiles(df, columns, [0.25, 0.75]).items():
        df = df.filter(_inside(df, c, quartiles))
    return df


def clean(df: DataFrame, remove_duplicates: bool = True, handle_missing: bool = True,
          outlier_removal: bool = True, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Duplicates, then missing values, then outliers; each step is optional."""
    out = normalize_missing(df)
    if remove_duplicates:
        out = materialize(drop_duplicates(out), "distinct")   # the passes below would each repeat the shuffle
    if handle_missing:
        out = impute_mode(impute_median(out))
    if outlier_removal:
        out = iqr_filter(out, exclude=exclude)
    return out


def clean_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(original_rows, processed_rows)."""
    processed = after.agg(F.count(F.lit(1))).scalar()
    return before.agg(F.count(F.lit(1)).alias("original_rows")).withColumn("processed_rows", processed)
