"""Target and task queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks.tables import table
from tabml.operators import target as T
from tabml.plans.train import run_parallel

# columns and kinds of the tables the rules are run on, with the key that orders their rows
SCHEMAS = {
    "region": ("r_regionkey", {"r_regionkey": "n", "r_name": "s"}),
    "nation": ("n_nationkey", {"n_nationkey": "n", "n_name": "s", "n_regionkey": "n"}),
    "customer": ("c_custkey", {"c_custkey": "n", "c_name": "s", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "s"}),
    "supplier": ("s_suppkey", {"s_suppkey": "n", "s_name": "s", "s_nationkey": "n", "s_acctbal": "n"}),
    "part": ("p_partkey", {"p_partkey": "n", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "n", "p_retailprice": "n"}),
    "orders": ("o_orderkey", {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "s", "o_totalprice": "n",
                              "o_orderdate": "d", "o_orderpriority": "s"}),
    "lineitem": ("l_orderkey", {"l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n",
                                "l_extendedprice": "n", "l_discount": "n", "l_tax": "n", "l_returnflag": "s",
                                "l_linestatus": "s", "l_shipdate": "d"}),
    "events": ("event_id", {"event_id": "n", "ts": "d", "user_id": "n", "event_type": "s", "value": "n", "props": "s"}),
    "documents": ("doc_id", {"doc_id": "n", "text": "s", "lang": "s", "source": "s", "n_chars": "n"}),
    "embeddings": ("vec_id", {"vec_id": "n", "embedding": "o", "label": "n"}),
    "pages": ("page_id", {"page_id": "n", "url": "s", "html": "s"}),
    "benchmark": ("item_id", {"item_id": "n", "text": "s"}),
    "labels": ("doc_id", {"doc_id": "n", "quality": "n", "toxic": "n"}),
    "conversations": ("conv_id", {"conv_id": "n", "turn": "n", "role": "s", "text": "s"}),
}
WORDS = "|".join(T.FEATURE_KEYWORDS)


def _distinct_sql(name: str) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS "table", '{c}' AS "column", {i} AS position, '{k}' AS kind, count(DISTINCT {c}) AS ndv FROM {name}"""
        for i, (c, k) in enumerate(SCHEMAS[name][1].items()))


ALL_DISTINCT = "\nUNION ALL\n".join(_distinct_sql(t) for t in SCHEMAS)
SCORES_SQL = f"""
ndv AS ({ALL_DISTINCT}),
scores AS (SELECT * FROM (SELECT *, CASE WHEN ndv = 2 THEN CASE kind WHEN 's' THEN 10 ELSE 8 END
 WHEN ndv BETWEEN 3 AND 10 THEN CASE kind WHEN 's' THEN 6 ELSE 4 END
 WHEN ndv > 10 AND kind = 'n' THEN 2 END AS score FROM ndv
 WHERE NOT regexp_matches(lower("column"), '{WORDS}')) WHERE score IS NOT NULL),
best AS (SELECT "table", "column", score FROM (
 SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY score DESC, position) AS place FROM (
  SELECT "table", "column", position, score FROM scores UNION ALL
  SELECT "table", arg_max("column", position), 1000, 1 FROM ndv GROUP BY "table")) WHERE place = 1)"""


def _texts_sql() -> str:
    parts = [f"""SELECT '{t}' AS "table", '{c}' AS "column", {i} AS position, avg(length({c})) AS avg_length
 FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL ORDER BY {key} LIMIT 10)"""
             for t, (key, columns) in SCHEMAS.items() for i, (c, k) in enumerate(columns.items()) if k == "s" and t != "lineitem"]
    return "\nUNION ALL\n".join(parts)


TASK_SQL = f"""WITH {SCORES_SQL},
texts AS (SELECT x."table", string_agg(x."column", ''', ''' ORDER BY x.position) AS names FROM ({_texts_sql()}) x
 JOIN best b ON b."table" = x."table" AND b."column" <> x."column" WHERE avg_length > 20 GROUP BY x."table"),
facts AS (SELECT b."table", n.kind, n.ndv, t.names FROM best b JOIN ndv n ON n."table" = b."table" AND n."column" = b."column"
 LEFT JOIN texts t ON t."table" = b."table")
SELECT "table", CASE WHEN names IS NOT NULL THEN 'nlp' WHEN kind <> 's' AND ndv > 20 THEN 'regression'
 WHEN ndv = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END AS task_type,
 CASE WHEN names IS NOT NULL THEN 'text_columns_detected: [''' || names || ''']'
 WHEN kind <> 's' AND ndv > 20 THEN 'continuous_target_with_' || ndv || '_unique_values'
 ELSE 'categorical_target_with_' || ndv || '_classes' END AS task_reason, ndv AS n_classes FROM facts"""


def _each(spark, folder, run):
    parts = run_parallel(spark, list(SCHEMAS.items()), lambda item: run(table(spark, folder, item[0]), item[1][0]).select(
        F.lit(item[0]).alias("table"), "*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _tasks(spark, folder):
    def run(df, key):
        target = T.detect_target(df).first()["target_column"]
        return T.classify_task(df, target, key)
    return _each(spark, folder, run)


def _ratio(spark, folder):
    columns = ["l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_discount"]
    df = table(spark, folder, "lineitem")
    return reduce(lambda a, b: a.unionByName(b),
                  [T.classify_task_by_ratio(df, c).select(F.lit(c).alias("target"), "*") for c in columns])


def _choices(spark, folder):
    chosen = T.select_model(_ratio(spark, folder))
    return chosen.withColumn("model_params", F.to_json("model_params"))


RATIO_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS target, CASE WHEN {"FALSE" if c in ("l_returnflag", "l_linestatus") else f"count(DISTINCT {c}) / count(*) >= 0.1"}
 THEN 'regression' WHEN count(DISTINCT {c}) = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END AS task_type,
 count(DISTINCT {c}) AS n_classes FROM lineitem"""
    for c in ["l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_discount"])

QUERIES = {
    "target_scores": lambda s, f: _each(s, f, lambda df, key: T.target_scores(df)),
    "target_column": lambda s, f: _each(s, f, lambda df, key: T.detect_target(df)),
    "task_type": _tasks,
    "class_labels": lambda s, f: T.class_labels(table(s, f, "lineitem"), "l_returnflag"),
    "task_type_ratio": _ratio,
    "select_model": _choices,
    "suggest_models": lambda s, f: T.suggest_models(_ratio(s, f).select("task_type").distinct()),
}

SQL = {
    "target_scores": f"""WITH {SCORES_SQL} SELECT "table", "column", position, score FROM scores""",
    "target_column": f"""WITH {SCORES_SQL} SELECT "table", "column" AS target_column,
 CASE WHEN score >= 8 THEN 'binary_classification_target' WHEN score >= 4 THEN 'multiclass_classification_target'
 WHEN score >= 2 THEN 'regression_target' ELSE 'fallback_last_column' END AS method, score AS confidence_score,
 CASE WHEN score >= 2 THEN 'Rule-based detection: ' || "column" || ' scored ' || score
 ELSE 'No clear target identified, using last column as fallback' END AS reason FROM best""",
    "task_type": TASK_SQL,
    "class_labels": "SELECT DISTINCT l_returnflag AS label FROM lineitem",
    "task_type_ratio": RATIO_SQL,
    "select_model": f"""SELECT *, CASE WHEN task_type = 'regression' THEN 'RandomForestRegressor' WHEN n_classes > 10 THEN 'RandomForestClassifier'
 WHEN n_classes = 2 THEN 'LogisticRegression' ELSE 'KNeighborsClassifier' END AS selected_model,
 CASE selected_model WHEN 'LogisticRegression' THEN '{{"max_iter":1000}}' WHEN 'KNeighborsClassifier' THEN '{{"n_neighbors":5}}'
 ELSE '{{}}' END AS model_params FROM ({RATIO_SQL})""",
    "suggest_models": f"""SELECT task_type, generate_subscripts(models, 1) AS rank, unnest(models) AS model_name FROM (
 SELECT DISTINCT task_type, CASE task_type
 WHEN 'binary_classification' THEN ['LogisticRegression', 'RandomForestClassifier', 'XGBClassifier', 'SVC', 'KNeighborsClassifier']
 WHEN 'multiclass_classification' THEN ['RandomForestClassifier', 'XGBClassifier', 'GradientBoostingClassifier', 'SVC', 'KNeighborsClassifier']
 ELSE ['LinearRegression', 'RandomForestRegressor', 'XGBRegressor', 'SVR', 'Ridge'] END AS models FROM ({RATIO_SQL}))""",
}
