"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.tables import DIRTY_SQL, dirty_lineitem, table
from tabml.operators import profile as P

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
NUMERIC = LINEITEM[:8]
TEXT = ["l_returnflag", "l_linestatus"]


def _round(df, names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _describe_sql(source: str, columns: list[str]) -> str:
    return _union(
        f"""SELECT '{c}' AS "column", {i} AS position, count({c}) AS "count", round(avg({c}), 4) AS mean,
 round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS "min", quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25,
 quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75,
 CAST(max({c}) AS DOUBLE) AS "max" FROM {source}""" for i, c in enumerate(columns))


def _metadata(spark, folder):
    record = P.metadata(table(spark, folder, "lineitem"), key="l_orderkey")
    return record.withColumns({
        "feature_columns": F.array_join("feature_columns", ","),
        "numeric_features": F.array_join("numeric_features", ","),
        "categorical_features": F.array_join("categorical_features", ","),
        "missing_values": F.aggregate(F.map_values("missing_values"), F.lit(0).cast("bigint"), lambda a, b: a + b),
    })


def _report_sql() -> str:
    features = [c for c in LINEITEM if c != "l_linestatus"]
    kinds = {**dict.fromkeys(NUMERIC, "numeric"), "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "date"}
    dtypes = {**dict.fromkeys(LINEITEM[:3], "bigint"), "l_linenumber": "int", **dict.fromkeys(LINEITEM[4:8], "double"),
              "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
    parts = [
        """SELECT 'dataset' AS section, NULL AS "column", stat, "value" FROM (
 SELECT CAST(count(*) AS VARCHAR) AS n_samples, '11' AS n_features, 'l_linestatus' AS target_column,
 'binary_classification' AS task_type, 'categorical_target_with_2_classes' AS task_reason,
 CAST(count(DISTINCT l_linestatus) AS VARCHAR) AS n_classes, '10.0' AS confidence_score FROM lineitem)
 UNPIVOT ("value" FOR stat IN (n_samples, n_features, target_column, task_type, task_reason, n_classes, confidence_score))"""]
    for c in LINEITEM:
        parts.append(f"SELECT 'column', '{c}', 'dtype', '{dtypes[c]}'")
        parts.append(f"SELECT 'column', '{c}', 'missing', CAST(count(*) - count({c}) AS VARCHAR) FROM lineitem")
    parts += [f"SELECT 'feature', '{c}', 'kind', '{kinds[c]}'" for c in features]
    for c in NUMERIC:
        stats = {"mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})::DOUBLE", "max": f"max({c})::DOUBLE",
                 "p25": f"quantile_cont({c}::DOUBLE, 0.25)", "p50": f"quantile_cont({c}::DOUBLE, 0.5)",
                 "p75": f"quantile_cont({c}::DOUBLE, 0.75)"}
        parts.append(f"SELECT 'numeric', '{c}', 'count', CAST(count({c}) AS VARCHAR) FROM lineitem")
        parts += [f"SELECT 'numeric', '{c}', '{s}', printf('%.4f', round({e}, 4) + 0.0::DOUBLE) FROM lineitem" for s, e in stats.items()]
    parts.append("SELECT 'category', 'l_returnflag', l_returnflag, CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY l_returnflag")
    return _union(parts)


QUERIES = {
    "profile_nulls": lambda s, f: P.null_counts(dirty_lineitem(s, f)),
    "profile_shape": lambda s, f: P.shape(table(s, f, "lineitem")),
    "profile_numeric": lambda s, f: _round(P.describe(table(s, f, "lineitem")), ["mean", "std"]),
    "profile_numeric_gaps": lambda s, f: _round(P.describe(dirty_lineitem(s, f), ["l_quantity", "l_tax"]), ["mean", "std"]),
    "profile_categories": lambda s, f: P.value_counts(dirty_lineitem(s, f)),
    "profile_distinct": lambda s, f: P.nunique(table(s, f, "lineitem")),
    "feature_types": lambda s, f: P.feature_types(dirty_lineitem(s, f), "l_linestatus"),
    "missing_flags": lambda s, f: P.missing_flags(dirty_lineitem(s, f), "l_linestatus"),
    "text_columns": lambda s, f: _round(P.text_columns(table(s, f, "documents"), "lang", "doc_id"), ["avg_length"]),
    "text_columns_all_rows": lambda s, f: _round(P.text_columns(table(s, f, "conversations"), "role"), ["avg_length"]),
    "dataset_metadata": _metadata,
    "ingest_summary": lambda s, f: P.ingest_summary(table(s, f, "lineitem"), "l_orderkey"),
    "profile_report": lambda s, f: P.profile(table(s, f, "lineitem"), "l_orderkey"),
}

SQL = {
    "profile_nulls": f"WITH {DIRTY_SQL}\n" + _union(
        f"""SELECT '{c}' AS "column", {i} AS position, count(*) - count({c}) AS missing FROM dirty""" for i, c in enumerate(LINEITEM)),
    "profile_shape": "SELECT count(*) AS n_samples, 11 AS n_features FROM lineitem",
    "profile_numeric": _describe_sql("lineitem", NUMERIC),
    "profile_numeric_gaps": f"WITH {DIRTY_SQL}\n" + _describe_sql("dirty", ["l_quantity", "l_tax"]),
    "profile_categories": f"WITH {DIRTY_SQL}\n" + _union(
        f"""SELECT '{c}' AS "column", {c} AS "value", count(*) AS n FROM dirty WHERE {c} IS NOT NULL GROUP BY {c}""" for c in TEXT),
    "profile_distinct": _union(
        f"""SELECT '{c}' AS "column", {i} AS position, count(DISTINCT {c}) AS "distinct" FROM lineitem""" for i, c in enumerate(LINEITEM)),
    "feature_types": f"WITH {DIRTY_SQL}\n" + _union(
        f"""SELECT '{c}' AS "column", {i} AS position,
 '{"numeric" if c in NUMERIC else "categorical" if c in TEXT else "date"}' AS kind, count({c}) AS present FROM dirty"""
        for i, c in enumerate(c for c in LINEITEM if c != "l_linestatus")),
    "missing_flags": f"""WITH {DIRTY_SQL}
SELECT bool_or({" OR ".join(f"{c} IS NULL" for c in NUMERIC)}) AS missing_numeric,
 bool_or(l_returnflag IS NULL) AS missing_categorical FROM dirty""",
    "text_columns": _union(
        f"""SELECT * FROM (SELECT '{c}' AS "column", round(avg(length({c})), 4) AS avg_length
 FROM (SELECT {c} FROM documents WHERE {c} IS NOT NULL ORDER BY doc_id LIMIT 10)) WHERE avg_length > 20""" for c in ["text", "source"]),
    "text_columns_all_rows": """SELECT 'text' AS "column", round(avg(length(text)), 4) AS avg_length
 FROM conversations HAVING avg(length(text)) > 20""",
    "dataset_metadata": f"""SELECT 'l_linestatus' AS target_column, '{",".join(c for c in LINEITEM if c != "l_linestatus")}' AS feature_columns,
 CASE WHEN count(DISTINCT l_linestatus) = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END AS task_type,
 'categorical_target_with_' || count(DISTINCT l_linestatus) || '_classes' AS task_reason, count(*) AS n_samples,
 11 AS n_features, count(DISTINCT l_linestatus) AS n_classes, 'string' AS target_dtype, '{",".join(NUMERIC)}' AS numeric_features,
 'l_returnflag' AS categorical_features, 10 * count(*) - {" - ".join(f"count({c})" for c in LINEITEM if c != "l_linestatus")} AS missing_values,
 10.0 AS confidence_score FROM lineitem""",
    "ingest_summary": f"""SELECT count(*) AS "rows", '{",".join(LINEITEM)}' AS cols, 'l_linestatus' AS target_column,
 CASE WHEN count(DISTINCT l_linestatus) = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END AS task_type FROM lineitem""",
    "profile_report": _report_sql(),
}
