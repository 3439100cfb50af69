"""Column names, kinds and the one missing-value rule (NaN counts as NULL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Column by literal name, also when the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(data_type: T.DataType) -> str:
    """numeric / categorical / boolean / date / other."""
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "categorical"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "other"


def columns_of_kind(df: DataFrame, *kinds: str, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds and f.name not in exclude]


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return columns_of_kind(df, "numeric", exclude=exclude)


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    return columns_of_kind(df, "categorical", exclude=exclude)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL; other types unchanged."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: present(df, n) for n in floating}) if floating else df


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Feature columns not found: {missing}")


def one_row_per_column(row_df: DataFrame, columns: list[str], fields: dict[str, dict[str, Column]]) -> DataFrame:
    """Turn a one-row wide aggregate into one row per source column.

    ``fields[column]`` maps output field names to expressions over ``row_df``.
    """
    structs = [
        F.struct(F.lit(name).alias("column"), F.lit(i).alias("position"),
                 *[e.alias(k) for k, e in fields[name].items()])
        for i, name in enumerate(columns)
    ]
    return row_df.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")
