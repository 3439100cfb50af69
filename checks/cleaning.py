"""Cleaning and splitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.profiling import LINEITEM, NUMERIC
from checks.tables import DIRTY_SQL, OUTLIER_SQL, dirty_lineitem, outlier_lineitem, table
from tabml.operators import clean as C
from tabml.operators import split as S

FENCED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def _fence(source: str, c: str) -> str:
    return f"""SELECT * FROM {source} WHERE {c} BETWEEN
 (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {source}) AND
 (SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {source})"""


def _chain(source: str, columns: list[str]) -> tuple[str, str]:
    steps = []
    for i, c in enumerate(columns):
        steps.append(f"f{i} AS ({_fence(source, c)})")
        source = f"f{i}"
    return ",\n".join(steps), source


CHAIN, LAST = _chain("outl", FENCED)
CLEAN_CHAIN, CLEAN_LAST = _chain("filled", NUMERIC)
CLEAN_SQL = f"""WITH {DIRTY_SQL},
uniq AS (SELECT DISTINCT * FROM dirty),
filled AS (SELECT * REPLACE (coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM uniq)) AS l_quantity,
 coalesce(l_returnflag, (SELECT l_returnflag FROM uniq WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag
                         ORDER BY count(*) DESC, l_returnflag LIMIT 1)) AS l_returnflag) FROM uniq),
{CLEAN_CHAIN}"""
HASH = "md5({} || '|42')"


def _clean_report(spark, folder):
    dirty = dirty_lineitem(spark, folder)
    return C.clean_summary(dirty, C.clean(dirty))


def _folds(spark, folder):
    return S.kfold(table(spark, folder, "orders"), ["o_orderkey"]).select("o_orderkey", "fold")


def _restacked(spark, folder):
    split = S.split_random(table(spark, folder, "orders"), ["o_orderkey"])
    whole = S.stack_splits(split.filter("split = 'train'"), split.filter("split = 'test'"))
    return whole.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("n_test"))


QUERIES = {
    "drop_duplicates": lambda s, f: C.drop_duplicates(dirty_lineitem(s, f)),
    "impute_median": lambda s, f: C.impute_median(dirty_lineitem(s, f)),
    "impute_mode": lambda s, f: C.impute_mode(dirty_lineitem(s, f)),
    "iqr_filter": lambda s, f: C.iqr_filter(outlier_lineitem(s, f), exclude=KEYS),
    "iqr_filter_joint": lambda s, f: C.iqr_filter_joint(outlier_lineitem(s, f), exclude=KEYS),
    "clean_dataset": lambda s, f: C.clean(dirty_lineitem(s, f)),
    "clean_summary": _clean_report,
    "split_random": lambda s, f: S.split_random(table(s, f, "orders"), ["o_orderkey"]).select("o_orderkey", "split"),
    "split_stratified": lambda s, f: S.split_stratified(table(s, f, "orders"), ["o_orderkey"], "o_orderstatus").select(
        "o_orderkey", "o_orderstatus", "split"),
    "split_hashed": lambda s, f: S.split_hashed(table(s, f, "orders"), ["o_orderkey"]).select("o_orderkey", "split"),
    "kfold": _folds,
    "stack_splits": _restacked,
}

SPLIT_SQL = f"""SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (ORDER BY {HASH.format('o_orderkey')})
 <= ceil(0.2::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM orders"""

SQL = {
    "drop_duplicates": f"WITH {DIRTY_SQL} SELECT DISTINCT * FROM dirty",
    "impute_median": f"""WITH {DIRTY_SQL} SELECT * REPLACE (coalesce(l_quantity,
 (SELECT quantile_cont(l_quantity, 0.5) FROM dirty)) AS l_quantity) FROM dirty""",
    "impute_mode": f"""WITH {DIRTY_SQL} SELECT * REPLACE (coalesce(l_returnflag, (SELECT l_returnflag FROM dirty
 WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)) AS l_returnflag) FROM dirty""",
    "iqr_filter": f"WITH {OUTLIER_SQL}, {CHAIN} SELECT * FROM {LAST}",
    "iqr_filter_joint": f"WITH {OUTLIER_SQL} SELECT * FROM outl WHERE " + " AND ".join(
        f"""{c} BETWEEN (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM outl)
 AND (SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM outl)""" for c in FENCED),
    "clean_dataset": f"{CLEAN_SQL} SELECT * FROM {CLEAN_LAST}",
    "clean_summary": f"{CLEAN_SQL} SELECT (SELECT count(*) FROM dirty) AS original_rows, (SELECT count(*) FROM {CLEAN_LAST}) AS processed_rows",
    "split_random": f"SELECT o_orderkey, split FROM ({SPLIT_SQL})",
    "split_stratified": f"""WITH classes AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus),
shares AS (SELECT *, sum(n) OVER () AS total, n * ceil(0.2::DOUBLE * sum(n) OVER ()) / sum(n) OVER () AS share FROM classes),
lows AS (SELECT *, floor(share) AS low, ceil(0.2::DOUBLE * total) - sum(floor(share)) OVER () AS rest,
 row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, o_orderstatus) AS place FROM shares),
takes AS (SELECT o_orderstatus, low + CASE WHEN place <= rest THEN 1 ELSE 0 END AS k FROM lows)
SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASH.format('o_orderkey')}) <= k
 THEN 'test' ELSE 'train' END AS split FROM orders JOIN takes USING (o_orderstatus)""",
    "split_hashed": f"""SELECT o_orderkey, CASE WHEN substr({HASH.format('o_orderkey')}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split
 FROM orders""",
    "kfold": f"""SELECT o_orderkey, CAST(CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1)
 ELSE n % 5 + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS BIGINT) AS fold FROM (
 SELECT o_orderkey, row_number() OVER (ORDER BY {HASH.format('o_orderkey')}) - 1 AS r, count(*) OVER () AS n FROM orders)""",
    "stack_splits": f"""SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE split = 'test') AS n_test
 FROM ({SPLIT_SQL}) GROUP BY o_orderstatus""",
}
