"""Evaluation queries over predictions made by SQL rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.tables import (
    FLAG_SQL, REGRESSION_SQL, RULE_SQL, flag_predictions, rule_predictions, rule_regression, table,
)
from tabml.operators import cluster_metrics as K
from tabml.operators import evaluate as E
from tabml.operators.split import split_random


def rounded(df, digits=4):
    floats = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, digits) for n in floats}) if floats else df


BINARY_SQL = """
m AS (SELECT {by} sum(CAST(label = prediction AS INT)) / count(*) AS accuracy,
 coalesce(sum(CAST(label = 1 AND prediction = 1 AS INT)) / nullif(sum(CAST(prediction = 1 AS INT)), 0), 0) AS "precision",
 coalesce(sum(CAST(label = 1 AND prediction = 1 AS INT)) / nullif(sum(CAST(label = 1 AS INT)), 0), 0) AS recall FROM {source} {group}),
b AS (SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1_score FROM m)"""

CLASS_SQL = f"""{FLAG_SQL},
names AS (SELECT DISTINCT label AS name FROM flag UNION SELECT DISTINCT prediction FROM flag),
cells AS (SELECT name, (SELECT count(*) FROM flag WHERE label = name) AS support,
 (SELECT count(*) FROM flag WHERE prediction = name) AS said,
 (SELECT count(*) FROM flag WHERE label = name AND prediction = name) AS tp FROM names),
pr AS (SELECT *, coalesce(tp / nullif(said, 0), 0) AS "precision", coalesce(tp / nullif(support, 0), 0) AS recall FROM cells),
cls AS (SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1_score FROM pr)"""

REG_METRICS = """avg((label - prediction) ** 2) AS mse, sqrt(avg((label - prediction) ** 2)) AS rmse,
 avg(abs(label - prediction)) AS mae, 1 - avg((label - prediction) ** 2) / var_pop(label) AS r2_score"""

AUC_SQL = """
d AS (SELECT {by} score, sum(label) AS pos, count(*) - sum(label) AS neg FROM {source} GROUP BY {by} score),
w AS (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d),
auc AS (SELECT {by} sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc FROM w {group})"""


def _split_scores(spark, folder):
    """Accuracy of a rule on the train and the test part of orders, side by side."""
    orders = split_random(table(spark, folder, "orders"), ["o_orderkey"])
    scored = orders.select("split", (F.col("o_orderstatus") == "F").cast("int").alias("label"),
                           (F.col("o_totalprice") > 200000).cast("int").alias("prediction"))
    accuracy = E.eval_binary(scored, by=["split"])
    return accuracy.groupBy().agg(F.max(F.when(F.col("split") == "train", F.col("accuracy"))).alias("train_score"),
                                  F.max(F.when(F.col("split") == "test", F.col("accuracy"))).alias("test_score"))


def _dispatch(spark, folder):
    parts = [E.as_long(E.evaluate(rule_predictions(spark, folder), "binary_classification", score="score")),
             E.as_long(E.evaluate(flag_predictions(spark, folder), "multiclass_classification")),
             E.as_long(E.evaluate(rule_regression(spark, folder), "regression")),
             E.as_long(E.evaluate(_clusters(spark, folder), "clustering"))]
    tasks = ["binary_classification", "multiclass_classification", "regression", "clustering"]
    parts = [p.select(F.lit(t).alias("task"), "*") for t, p in zip(tasks, parts)]
    return reduce(DataFrame.unionByName, parts)


def _clusters(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("embedding").alias("features"), F.col("label").alias("prediction"))


def _verdicts(spark, folder):
    reg = E.verdict(E.eval_regression(rule_regression(spark, folder)), "regression")
    bin_ = E.verdict(E.eval_binary(rule_predictions(spark, folder)).drop("pos_label"), "binary_classification")
    many = E.verdict(E.eval_multiclass(flag_predictions(spark, folder)), "multiclass_classification")
    exact, squared = (E.verdict(E.evaluate(_clusters(spark, folder), "clustering", silhouette_form=form), "clustering")
                      for form in ("silhouette_score", "silhouette_squared"))
    tasks = ["regression", "binary", "multiclass", "clustering", "clustering squared"]
    return reduce(DataFrame.unionByName, [p.withColumn("task", F.lit(t)) for t, p in zip(tasks, [reg, bin_, many, exact, squared])])


def _gappy(spark, folder):
    """Scores with NULL and NaN, which count as missing."""
    rows = table(spark, folder, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.when(F.col("l_orderkey") % 7 == 0, float("nan")).when(
        F.col("l_orderkey") % 11 != 0, F.col("l_quantity") / 50).alias("score"))
    return rounded(E.roc_auc(rows), 6)


EMB = """emb AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"""
CELLS = """cells AS (SELECT vec_id, label, generate_subscripts(x, 1) AS d, unnest(x) AS v FROM emb)"""

QUERIES = {
    "eval_binary": lambda s, f: rounded(E.eval_binary(rule_predictions(s, f))),
    "eval_binary_by_group": lambda s, f: rounded(E.eval_binary(rule_predictions(s, f), by=["l_linenumber"])),
    "eval_multiclass": lambda s, f: rounded(E.eval_multiclass(flag_predictions(s, f))),
    "confusion_matrix": lambda s, f: E.confusion_matrix(flag_predictions(s, f)),
    "classification_report": lambda s, f: rounded(E.classification_report(flag_predictions(s, f))),
    "roc_auc": lambda s, f: rounded(E.roc_auc(rule_predictions(s, f)), 6),
    "roc_auc_gaps": _gappy,
    "roc_auc_by_group": lambda s, f: rounded(E.roc_auc(rule_predictions(s, f), by=["l_linenumber"]), 6),
    "eval_regression": lambda s, f: rounded(E.eval_regression(rule_regression(s, f))),
    "eval_dispatch": _dispatch,
    "cluster_sizes": lambda s, f: K.cluster_sizes(table(s, f, "embeddings"), "label"),
    "silhouette": lambda s, f: rounded(K.silhouette(table(s, f, "embeddings"), "embedding", "label"), 6),
    "silhouette_squared": lambda s, f: rounded(K.silhouette_squared(table(s, f, "embeddings"), "embedding", "label"), 6),
    "calinski_harabasz": lambda s, f: rounded(K.calinski_harabasz(table(s, f, "embeddings"), "embedding", "label"), 6),
    "eval_verdict": _verdicts,
    "overfit_flag": lambda s, f: rounded(E.overfit_flag(_split_scores(s, f))),
}


def _long(names, source):
    return "\nUNION ALL\n".join(f"SELECT '{n}' AS metric, round({n}, 4) AS \"value\" FROM {source}" for n in names)


def _texts():
    several = {
        "accuracy": "printf('The model correctly predicts %.1f%% of all samples', round(accuracy * 100, 1))",
        "precision": "printf('Weighted precision of %.1f%% across all classes', round(\"precision\" * 100, 1))",
        "recall": "printf('Weighted recall of %.1f%% across all classes', round(recall * 100, 1))",
        "f1_score": "printf('Weighted F1 score of %.4f across all classes', f1_score)"}
    shape = {
        "calinski_harabasz_score": "printf('Calinski-Harabasz score of %.4f indicates cluster separation', calinski_harabasz_score)",
        "n_clusters": "printf('Model identified %.0f clusters', CAST(n_clusters AS DOUBLE))"}
    rows = {
        ("mse", "reg_m"): "NULL", ("rmse", "reg_m"): "printf('Average prediction error is %.4f units', rmse)",
        ("mae", "reg_m"): "printf('Mean absolute error is %.4f units', mae)",
        ("r2_score", "reg_m"): "printf('The model explains %.1f%% of the variance in the target', round(r2_score * 100, 1))",
        ("accuracy", "b"): "printf('The model correctly predicts %.1f%% of all samples', round(accuracy * 100, 1))",
        ("precision", "b"): "printf('Of samples predicted as positive, %.1f%% are actually positive', round(\"precision\" * 100, 1))",
        ("recall", "b"): "printf('The model correctly identifies %.1f%% of all positive samples', round(recall * 100, 1))",
        ("f1_score", "b"): "printf('F1 score of %.4f provides balanced precision-recall measure', f1_score)",
    }
    tasks = {"reg_m": "regression", "b": "binary", "mc": "multiclass"}
    rows |= {(m, "mc"): t for m, t in several.items()}
    rows = {(m, src, tasks[src]): t for (m, src), t in rows.items()}
    for name, task in (("silhouette_score", "clustering"), ("silhouette_squared", "clustering squared")):
        rows |= {(m, "km", task): t for m, t in {**shape, name: f"printf('Silhouette score of %.4f indicates cluster quality', {name})"}.items()}
    parts = [f"SELECT '{k}' AS task, '{m}' AS metric, round(\"{m}\", 4) AS \"value\", {t} AS \"text\" FROM {src}" for (m, src, k), t in rows.items()]
    overall = [("regression", "r2_score", 0.7, "Good fit", "Needs improvement", "reg_m"), ("binary", "accuracy", 0.8, "Good performance", "Needs improvement", "b"),
               ("multiclass", "accuracy", 0.8, "Good performance", "Needs improvement", "mc"),
               ("clustering", "silhouette_score", 0.5, "Good clustering", "Clusters may need refinement", "km"),
               ("clustering squared", "silhouette_squared", 0.5, "Good clustering", "Clusters may need refinement", "km")]
    parts += [f"SELECT '{k}', 'overall', round({m}, 4), CASE WHEN {m} > {limit} THEN '{good}' ELSE '{poor}' END FROM {src}"
              for k, m, limit, good, poor, src in overall]
    return "\nUNION ALL\n".join(parts)


WEIGHTED = """sum(tp) / sum(support) AS accuracy, sum("precision" * support) / sum(support) AS "precision",
 sum(recall * support) / sum(support) AS recall, sum(f1_score * support) / sum(support) AS f1_score"""
RULE_B = BINARY_SQL.format(by="", source="rule", group="")
CLUSTER_SQL = f"""{EMB}, {CELLS},
g AS (SELECT d, avg(v) AS m FROM cells_of GROUP BY d),
ch AS (SELECT label, d, avg(v) AS m, count(*) AS n, var_pop(v) * count(*) AS w FROM cells_of GROUP BY label, d),
dist AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS total, sum(list_distance(a.x, b.x) ** 2) AS squares, count(*) AS size
 FROM emb a, emb b GROUP BY a.vec_id, a.label, b.label),
ab AS (SELECT vec_id, max(size) FILTER (WHERE label = other) AS n,
 max(total / greatest(size - 1, 1)) FILTER (WHERE label = other) AS a, min(total / size) FILTER (WHERE label <> other) AS b,
 max(squares / greatest(size - 1, 1)) FILTER (WHERE label = other) AS a2, min(squares / size) FILTER (WHERE label <> other) AS b2 FROM dist GROUP BY vec_id),
km AS (SELECT (SELECT count(DISTINCT label) FROM emb) AS n_clusters,
 (SELECT (sum(n * (ch.m - g.m) ** 2) / (SELECT count(DISTINCT label) - 1 FROM emb)) / (sum(w) / (SELECT count(*) - count(DISTINCT label) FROM emb))
  FROM ch JOIN g USING (d)) AS calinski_harabasz_score,
 (SELECT avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) FROM ab) AS silhouette_score,
 (SELECT avg(CASE WHEN n = 1 THEN 0 ELSE (b2 - a2) / greatest(a2, b2) END) FROM ab) AS silhouette_squared)""".replace("cells AS", "cells_of AS")
SHOW = 'round(accuracy, 4) AS accuracy, round("precision", 4) AS "precision", round(recall, 4) AS recall, round(f1_score, 4) AS f1_score'

SQL = {
    "eval_binary": f"WITH {RULE_SQL}, {RULE_B} SELECT 1 AS pos_label, {SHOW} FROM b",
    "eval_binary_by_group": f"""WITH {RULE_SQL}, {BINARY_SQL.format(by="l_linenumber,", source="rule", group="GROUP BY l_linenumber")}
SELECT l_linenumber, 1 AS pos_label, {SHOW} FROM b""",
    "eval_multiclass": f"WITH {CLASS_SQL}, mc AS (SELECT {WEIGHTED} FROM cls) SELECT {SHOW} FROM mc",
    "confusion_matrix": f"""WITH {CLASS_SQL} SELECT a.name AS label, b.name AS prediction,
 (SELECT count(*) FROM flag WHERE label = a.name AND prediction = b.name) AS n FROM names a, names b""",
    "classification_report": f"""WITH {CLASS_SQL}, rep AS (SELECT name, "precision", recall, f1_score, support FROM cls
 UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM cls
 UNION ALL SELECT 'macro avg', avg("precision"), avg(recall), avg(f1_score), sum(support) FROM cls
 UNION ALL SELECT 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1_score * support) / sum(support), sum(support) FROM cls)
SELECT name, round("precision", 4) AS "precision", round(recall, 4) AS recall, round(f1_score, 4) AS f1_score,
 CAST(support AS BIGINT) AS support FROM rep""",
    "roc_auc": f"WITH {RULE_SQL}, {AUC_SQL.format(by='', source='rule', part='', group='')} SELECT round(roc_auc, 6) AS roc_auc FROM auc",
    "roc_auc_by_group": f"""WITH {RULE_SQL},
{AUC_SQL.format(by='l_linenumber,', source='rule', part='PARTITION BY l_linenumber', group='GROUP BY l_linenumber')}
SELECT l_linenumber, round(roc_auc, 6) AS roc_auc FROM auc""",
    "eval_regression": f"""WITH {REGRESSION_SQL}, m AS (SELECT {REG_METRICS} FROM reg)
SELECT round(mse, 4) AS mse, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2_score, 4) AS r2_score FROM m""",
    "eval_dispatch": f"""WITH {RULE_SQL}, {RULE_B}, {AUC_SQL.format(by='', source='rule', part='', group='')}, {CLASS_SQL},
mc AS (SELECT {WEIGHTED} FROM cls), {REGRESSION_SQL}, rm AS (SELECT {REG_METRICS} FROM reg), {CLUSTER_SQL}
SELECT 'binary_classification' AS task, * FROM ({_long(['accuracy', 'precision', 'recall', 'f1_score'], 'b')}
 UNION ALL SELECT 'roc_auc', round(roc_auc, 4) FROM auc)
UNION ALL SELECT 'multiclass_classification', * FROM ({_long(['accuracy', 'precision', 'recall', 'f1_score'], 'mc')})
UNION ALL SELECT 'regression', * FROM ({_long(['mse', 'rmse', 'mae', 'r2_score'], 'rm')})
UNION ALL SELECT 'clustering', * FROM ({_long(['n_clusters', 'calinski_harabasz_score', 'silhouette_score'], 'km')})""",
    "cluster_sizes": "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label",
    "silhouette": f"""WITH {EMB},
dist AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS total, count(*) AS size
 FROM emb a, emb b GROUP BY a.vec_id, a.label, b.label),
ab AS (SELECT vec_id, max(size) FILTER (WHERE label = other) AS n,
 max(total / greatest(size - 1, 1)) FILTER (WHERE label = other) AS a, min(total / size) FILTER (WHERE label <> other) AS b
 FROM dist GROUP BY vec_id)
SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_score FROM ab""",
    "silhouette_squared": f"""WITH {EMB},
dist AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x) ** 2) AS total, count(*) AS size
 FROM emb a, emb b GROUP BY a.vec_id, a.label, b.label),
ab AS (SELECT vec_id, max(size) FILTER (WHERE label = other) AS n,
 max(total / greatest(size - 1, 1)) FILTER (WHERE label = other) AS a, min(total / size) FILTER (WHERE label <> other) AS b
 FROM dist GROUP BY vec_id)
SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_squared FROM ab""",
    "calinski_harabasz": f"""WITH {EMB}, {CELLS},
g AS (SELECT d, avg(v) AS m FROM cells GROUP BY d),
c AS (SELECT label, d, avg(v) AS m, count(*) AS n, var_pop(v) * count(*) AS w FROM cells GROUP BY label, d)
SELECT round((sum(n * (c.m - g.m) ** 2) / (SELECT count(DISTINCT label) - 1 FROM emb)) /
 (sum(w) / (SELECT count(*) - count(DISTINCT label) FROM emb)), 6) AS calinski_harabasz_score FROM c JOIN g USING (d)""",
    "eval_verdict": f"WITH {RULE_SQL}, {RULE_B}, {CLASS_SQL}, mc AS (SELECT {WEIGHTED} FROM cls), {REGRESSION_SQL}, reg_m AS (SELECT {REG_METRICS} FROM reg), {CLUSTER_SQL} {_texts()}",
    "roc_auc_gaps": f"""WITH gaps AS (SELECT CAST(l_returnflag = 'R' AS INT) AS label, l_quantity / 50 AS score FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_orderkey % 11 <> 0),
 {AUC_SQL.format(by='', source='gaps', part='', group='')} SELECT round(roc_auc, 6) AS roc_auc FROM auc""",
    "overfit_flag": f"""WITH s AS (SELECT CASE WHEN row_number() OVER (ORDER BY md5(o_orderkey || '|42')) <= ceil(0.2::DOUBLE * count(*) OVER ())
 THEN 'test' ELSE 'train' END AS split, o_orderstatus = 'F' AS label, o_totalprice > 200000 AS prediction FROM orders),
a AS (SELECT avg(CAST(label = prediction AS INT)) FILTER (WHERE split = 'train') AS train_score,
 avg(CAST(label = prediction AS INT)) FILTER (WHERE split = 'test') AS test_score FROM s)
SELECT round(train_score, 4) AS train_score, round(test_score, 4) AS test_score,
 CASE WHEN train_score > test_score + 0.1 THEN 'Model shows overfitting' ELSE 'Model generalizes well' END AS overfitting FROM a""",
}
