"""What the operators share: the word rule, free column names, joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: words are runs of anything but these six ASCII characters (Java and Python regex)
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def fresh(taken, *stems: str) -> list[str]:
    """Column names that clash with none of ``taken`` (Spark compares names without case)."""
    used = {name.lower() for name in taken}
    names = []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        names.append(name)
    return names


def named(name: str) -> Column:
    """A column by its name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def own_columns(df: DataFrame) -> list[Column]:
    return [named(name) for name in df.columns]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys adaptive execution can split.

    Spark splits a skewed join partition only if both sides reach the join through its own
    exchange; a side that was just grouped by the keys does not. A further key that follows
    from the others makes the grouped side move once more, which is cheap as it is aggregated.
    """
    [guard] = fresh([*left.columns, *right.columns], "guard")
    follows = F.xxhash64(*keys)
    return left.withColumn(guard, follows).join(right.withColumn(guard, follows), [*keys, guard], how).drop(guard)


def words_of(text: Column) -> Column:
    """The words of a text; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character untouched."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
