"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabml.llm.common import fresh, own_columns
from tabml.llm.text_stats import BASE, ratio, with_stats


@dataclass(frozen=True)
class Rule:
    """A text passes when numerator / denominator lies between the bounds; rules with ``from_words``
    look only at texts of at least so many words."""

    name: str
    numerator: str
    denominator: str
    least: float = float("-inf")
    most: float = float("inf")
    from_words: int = 0


#: the threshold table
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("stop_words", "n_stop_words", "n_words", least=0.02, from_words=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.3),
)


def base_failed(stats: Column) -> Column:
    """Fewer than ten words, or over a fifth of them in repeated windows."""
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


def compiled(stats: Column, rules=RULES) -> Column:
    """Names of the rules that a text fails, as one expression over its statistics."""
    def failed(rule: Rule) -> Column:
        value = ratio(stats[rule.numerator], stats[rule.denominator])
        outside = F.lit(False)
        if rule.least > float("-inf"):
            outside = outside | (value < rule.least)
        if rule.most < float("inf"):
            outside = outside | (value > rule.most)
        return F.when((stats["n_words"] >= rule.from_words) & outside, F.lit(rule.name))
    return F.filter(F.array(*[failed(r) for r in rules], F.lit(None).cast("string")), lambda name: name.isNotNull())


def assess(df: DataFrame, id: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules,
    kept) per row. NULL and empty texts have no words and fail the base rule. NULL ids and repeated
    rows are assessed like others. No rows: no rows. Other columns are not looked at."""
    rows = with_stats(df.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "stats", more=False)
    stats = F.col("stats")
    judged = rows.select("id", "stats", base_failed(stats).alias("base_failed"), compiled(stats, rules).alias("failed_rules"))
    return judged.select("id", *[stats[n].alias(n) for n in BASE], "base_failed", "failed_rules",
                         (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def passing(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``df`` that pass the base rule and the table, with all their columns."""
    [stats] = fresh(df.columns, "stats")
    rows = with_stats(df, text, stats, more=False)
    return rows.where(~base_failed(F.col(stats)) & (F.size(compiled(F.col(stats), rules)) == 0)).select(*own_columns(df))
