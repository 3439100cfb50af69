"""Shared inputs of the registered queries: the given tables and tables derived from them.

Every ``*_SQL`` text is the same rule for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dirty_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with gaps in two columns and repeated rows."""
    base = table(spark, folder, "lineitem")
    base = base.withColumn("l_quantity", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity"))).withColumn(
        "l_returnflag", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_returnflag")))
    return base.unionByName(base.filter("l_orderkey % 13 = 0"))


DIRTY_SQL = """
base AS (SELECT * REPLACE (CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity,
                           CASE WHEN l_orderkey % 11 <> 0 THEN l_returnflag END AS l_returnflag) FROM lineitem),
dirty AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE l_orderkey % 13 = 0)"""


def outlier_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumn(
        "l_extendedprice",
        F.when(F.col("l_partkey") % 97 == 0, F.col("l_extendedprice") * 20).otherwise(F.col("l_extendedprice")))


OUTLIER_SQL = """
outl AS (SELECT * REPLACE (CASE WHEN l_partkey % 97 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS l_extendedprice)
         FROM lineitem)"""


def doc_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents: the share of letters tells the quality."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", "")) / F.col("n_chars")
    docs = table(spark, folder, "documents").select(
        "doc_id", letters.alias("letter_share"), F.col("n_chars").cast("double").alias("n_chars"), "lang", "source")
    return docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")


DOC_QUALITY_SQL = r"""
doc_quality AS (SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) / n_chars AS letter_share,
                       CAST(n_chars AS DOUBLE) AS n_chars, lang, source, quality
                FROM documents JOIN labels USING (doc_id))"""


def part_price(spark: SparkSession, folder: str) -> DataFrame:
    """Parts: the price follows the key's last three digits, the other columns are noise."""
    return table(spark, folder, "part").select(
        "p_partkey", (F.col("p_partkey") % 1000).cast("double").alias("key_mod"), "p_size", "p_type", "p_retailprice")


PART_PRICE_SQL = """
part_price AS (SELECT p_partkey, CAST(p_partkey % 1000 AS DOUBLE) AS key_mod, p_size, p_type, p_retailprice FROM part)"""


def rule_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_quantity") > 25).cast("int").alias("prediction"), (F.col("l_quantity") / 50).alias("score"))


RULE_SQL = """
rule AS (SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INT) AS label,
                CAST(l_quantity > 25 AS INT) AS prediction, l_quantity / 50 AS score FROM lineitem)"""


def flag_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A three-class rule: guess the return flag from the size of the order line."""
    guess = F.when(F.col("l_quantity") > 34, "R").when(F.col("l_quantity") > 10, "N").otherwise("A")
    return table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("label"), guess.alias("prediction"))


FLAG_SQL = """
flag AS (SELECT l_returnflag AS label,
                CASE WHEN l_quantity > 34 THEN 'R' WHEN l_quantity > 10 THEN 'N' ELSE 'A' END AS prediction FROM lineitem)"""


def rule_regression(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("label"),
        (F.col("l_quantity") * 1000 + F.col("l_partkey") % 1000).alias("prediction"))


REGRESSION_SQL = """
reg AS (SELECT l_extendedprice AS label, l_quantity * 1000 + l_partkey % 1000 AS prediction FROM lineitem)"""
