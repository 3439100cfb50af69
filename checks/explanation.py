"""Explanation and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.evaluation import rounded
from checks.modelling import DOC, NB_SQL, PART, STUMPS_SQL, boosted_stumps, line_orders, settled, vector
from checks.tables import DIRTY_SQL, dirty_lineitem, doc_quality, part_price, table
from tabml.operators import attribution as A
from tabml.operators import importance as I
from tabml.operators.profile import metadata
from tabml.operators.target import detect_target
from tabml.operators.tree_paths import model_paths, shapley_trees
from tabml.plans import explain as X
from tabml.plans import train as R
from tabml.session import scratch_path


def _fitted(name, data, spec):
    def run(spark, folder):
        ready = R.prepare(data(spark, folder), *spec)
        return R.fit_model(ready, name), ready
    return run


FOREST = _fitted("RandomForestRegressor", part_price, PART)
TREE = _fitted("DecisionTreeClassifier", doc_quality, DOC)
LOGISTIC = _fitted("LogisticRegression", doc_quality, DOC)
SHORT = ("p_retailprice", ["key_mod", "p_size"], ["p_partkey"], "regression")


def _importance_tree(spark, folder):
    trained, ready = FOREST(spark, folder)
    ready.release()
    return rounded(I.importance_tree(spark, trained.model, trained.prep.slots()))


def _importance_source(spark, folder):
    trained, ready = FOREST(spark, folder)
    ready.release()
    return rounded(I.importance_tree(spark, trained.model, trained.prep.slots(), by_source=True))


def _importance_coef(spark, folder):
    """One feature: the coefficient on the scaled column is slope times its spread."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    prep = R.fit_prep(orders, ["o_custkey"])
    rows = R.add_label(prep.transform(orders), "o_totalprice", None)
    from tabml.operators.models import build, training_facts
    model = build("LinearRegression", training_facts(rows, classification=False)).fit(rows)
    return rounded(I.importance_coef(spark, model, prep.slots()))


def _importance(spark, folder):
    trained, ready = LOGISTIC(spark, folder)
    ready.release()
    return rounded(I.importance(spark, trained.model, trained.prep.slots()))


def _fixed_line(df):
    return df.withColumn("prediction", 900 + 0.1 * F.col("key_mod") + 0.05 * F.col("p_size"))


def _permutation(spark, folder):
    parts = part_price(spark, folder).select("p_partkey", "key_mod", "p_size", F.col("p_retailprice").alias("label"))
    return rounded(I.importance_permutation(parts, ["p_partkey"], ["key_mod", "p_size"], _fixed_line, "regression"))


def _linear_contributions(spark, folder):
    parts = part_price(spark, folder).withColumn("p_size", F.col("p_size").cast("double"))
    means = parts.agg(F.avg("key_mod"), F.avg("p_size")).first()
    return A.shapley_linear(vector(parts, ["key_mod", "p_size"]), ["p_partkey"], [0.1, 0.05], 900.0, ["key_mod", "p_size"], list(means))


def _fitted_line(spark, folder):
    orders = line_orders(spark, folder)
    prep = R.fit_prep(orders, ["o_custkey"])
    rows = R.add_label(prep.transform(orders), "o_totalprice", None)
    model = R.build("LinearRegression", R.training_facts(rows, classification=False)).fit(rows)
    return R.Trained("LinearRegression", "regression", "o_totalprice", ["o_custkey"], None, prep, model, {}), orders


def _shap_line(spark, folder):
    trained, orders = _fitted_line(spark, folder)
    return rounded(X.shap_local(trained, orders, ["o_orderkey"], orders), 2)


def _shap_line_global(spark, folder):
    trained, orders = _fitted_line(spark, folder)
    return rounded(X.shap_global(trained, orders, ["o_orderkey"], orders), 2)


def _shap_sampled_linear(spark, folder):
    """Any scorer may be sampled; of a line the result is known: weight times distance from the mean of the drawn rows."""
    parts = part_price(spark, folder).select("p_partkey", "key_mod", F.col("p_size").cast("double").alias("p_size"))
    features = ["key_mod", "p_size"]
    drawn = A.background_rows(parts, ["p_partkey"], features, rows=100)
    line = lambda d: d.withColumn("output", 900 + 0.1 * F.col("key_mod") + 0.05 * F.col("p_size"))
    return rounded(A.shapley_sampled(parts, ["p_partkey"], features, line, drawn, samples=100))


def _shap_sampled(spark, folder):
    trained, ready = TREE(spark, folder)
    ready.release()
    docs = doc_quality(spark, folder)
    return rounded(X.shap_local(trained, docs, ["doc_id"], docs, samples=20, sampled=True))


def _shap_tree(spark, folder):
    trained, ready = TREE(spark, folder)
    ready.release()
    docs = doc_quality(spark, folder)
    return rounded(X.shap_local(trained, docs, ["doc_id"], docs))


def _shap_boosted(spark, folder):
    """Of trees with one cut each the contributions are known: what a row's side gives beyond the mean of both."""
    model, part = boosted_stumps(spark, folder)
    return rounded(shapley_trees(part, ["p_partkey"], model_paths(model), ["p_size", "key_mod"]))


def _lime(spark, folder):
    trained, ready = TREE(spark, folder)
    ready.release()
    docs = doc_quality(spark, folder)
    return rounded(X.lime_local(trained, docs, ["doc_id"], docs, num_features=10, samples=100))


def _report(spark, folder):
    docs = doc_quality(spark, folder)
    trained, ready = LOGISTIC(spark, folder)
    return settled(X.explain(docs, metadata(docs, "doc_id", target="quality"), trained, ready), ready)


def _target_texts(spark, folder):
    return X.explain_target(detect_target(table(spark, folder, "lineitem")))


def _evaluation_report(spark, folder):
    trained, ready = LOGISTIC(spark, folder)
    return settled(R.evaluation_report(trained, ready), ready)


def _predict(spark, folder):
    """Save a fitted line, load it, score the whole table without looking at the target."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    prep = R.fit_prep(orders, ["o_custkey"])
    rows = R.add_label(prep.transform(orders), "o_totalprice", None)
    from tabml.operators.models import build, training_facts
    model = build("LinearRegression", training_facts(rows, classification=False)).fit(rows)
    path = scratch_path(spark, "model")
    R.Trained("LinearRegression", "regression", "o_totalprice", ["o_custkey"], None, prep, model, {}).save(path)
    return rounded(R.load_trained(spark, path).predict(orders), 2)


def _predict_labels(spark, folder):
    ready = R.prepare(doc_quality(spark, folder), *DOC)
    trained = R.fit_model(ready, "RandomForestClassifier")
    ready.release()
    scored = trained.predict(doc_quality(spark, folder))
    return scored.select("doc_id", "prediction", F.round(F.col("probabilities")["1"], 4).alias("p_good"))


def _probabilities(spark, folder):
    docs = doc_quality(spark, folder)
    features = ["letter_share", "n_chars"]
    prep = R.fit_prep(docs, features, scale=False)
    rows = R.add_label(prep.transform(docs), "quality", [0, 1])
    model = R.build("GaussianNB", R.training_facts(rows, classification=True)).fit(rows)
    scored = R.Trained("GaussianNB", "binary_classification", "quality", features, [0, 1], prep, model, {}).predict(docs)
    return scored.select("doc_id", F.explode("probabilities").alias("class", "value")).withColumn("value", F.round("value", 4))


def _model_info(spark, folder):
    trained, ready = LOGISTIC(spark, folder)
    ready.release()
    return trained.info(spark)


QUERIES = {
    "importance_tree": _importance_tree,
    "importance_tree_by_source": _importance_source,
    "importance_coef": _importance_coef,
    "feature_importance": _importance,
    "importance_permutation": _permutation,
    "shap_global": lambda s, f: rounded(A.shapley_global(_linear_contributions(s, f))),
    "shap_local": lambda s, f: rounded(_linear_contributions(s, f)),
    "shap_line": _shap_line,
    "shap_line_global": _shap_line_global,
    "shap_sampled_linear": _shap_sampled_linear,
    "shap_local_sampled": _shap_sampled,
    "shap_local_tree": _shap_tree,
    "shap_boosted": _shap_boosted,
    "lime_local": _lime,
    "explain_target": _target_texts,
    "explain_prep": lambda s, f: X.explain_prep(dirty_lineitem(s, f), "l_linestatus"),
    "explain_report": _report,
    "eval_report": _evaluation_report,
    "predict_batch": _predict,
    "predict_batch_labels": _predict_labels,
    "predict_proba": _probabilities,
    "model_info": _model_info,
}


def _next(feature: str) -> str:
    order = f"ORDER BY md5(p_partkey || '|42|{feature}')"
    return f"coalesce(lead({feature}) OVER ({order}), first_value({feature}) OVER ({order})) AS next_{feature}"


SQL = {
    "shap_boosted": f"""WITH {STUMPS_SQL},
cuts AS (SELECT feature, x AS cut, value_left AS l, value_right AS r, (nl * value_left + (na - nl) * value_right) / na AS mean FROM cut1
         UNION ALL SELECT feature, x, value_left, value_right, (nl * value_left + (na - nl) * value_right) / na FROM cut2),
cells AS (SELECT p_partkey, 0 AS feature, 'p_size' AS name, p_size::DOUBLE AS x FROM part UNION ALL SELECT p_partkey, 1, 'key_mod', (p_partkey % 100)::DOUBLE FROM part),
base AS (SELECT (SELECT avg(p_retailprice) FROM part) + sum(mean) AS b FROM cuts)
SELECT p_partkey, name AS feature, round(coalesce(sum(CASE WHEN x <= cut THEN l ELSE r END - mean), 0), 4) AS contribution,
       round((SELECT b FROM base), 4) AS base_value
FROM cells LEFT JOIN cuts USING (feature) GROUP BY p_partkey, name""",
    "importance_coef": """SELECT 'numeric__o_custkey' AS feature, round(regr_slope(o_totalprice, o_custkey) * stddev_pop(o_custkey), 4) AS coefficient,
 round(abs(regr_slope(o_totalprice, o_custkey) * stddev_pop(o_custkey)), 4) AS abs_coefficient, 1 AS rank FROM orders""",
    "importance_permutation": f"""WITH p AS (SELECT p_retailprice AS y, CAST(p_partkey % 1000 AS DOUBLE) AS key_mod, p_size, p_partkey FROM part),
n AS (SELECT *, {_next("key_mod")}, {_next("p_size")} FROM p),
s AS (SELECT 1 - avg((y - 900 - 0.1 * key_mod - 0.05 * p_size) ** 2) / var_pop(y) AS base,
 1 - avg((y - 900 - 0.1 * next_key_mod - 0.05 * p_size) ** 2) / var_pop(y) AS a,
 1 - avg((y - 900 - 0.1 * key_mod - 0.05 * next_p_size) ** 2) / var_pop(y) AS b FROM n),
d AS (SELECT 'key_mod' AS feature, base - a AS importance FROM s UNION ALL SELECT 'p_size', base - b FROM s)
SELECT feature, round(importance, 4) AS importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM d""",
    "shap_local": """WITH m AS (SELECT avg(p_partkey % 1000) AS a, avg(p_size) AS b FROM part),
c AS (SELECT p_partkey, 'key_mod' AS feature, 0.1::DOUBLE * (p_partkey % 1000 - a) AS contribution, 900 + 0.1::DOUBLE * a + 0.05::DOUBLE * b AS base_value FROM part, m
 UNION ALL SELECT p_partkey, 'p_size', 0.05::DOUBLE * (p_size - b), 900 + 0.1::DOUBLE * a + 0.05::DOUBLE * b FROM part, m)
SELECT p_partkey, feature, round(contribution, 4) AS contribution, round(base_value, 4) AS base_value FROM c""",
    "shap_global": """WITH m AS (SELECT avg(p_partkey % 1000) AS a, avg(p_size) AS b FROM part)
SELECT 'key_mod' AS feature, round(avg(abs(0.1::DOUBLE * (p_partkey % 1000 - a))), 4) AS importance FROM part, m
UNION ALL SELECT 'p_size', round(avg(abs(0.05::DOUBLE * (p_size - b))), 4) FROM part, m""",
    "shap_line": """WITH f AS (SELECT regr_slope(o_totalprice, o_custkey) AS b, avg(o_custkey) AS m, avg(o_totalprice) AS base FROM orders)
SELECT o_orderkey, 'numeric__o_custkey' AS feature, round(b * (o_custkey - m), 2) AS contribution, round(base, 2) AS base_value FROM orders, f""",
    "shap_line_global": """WITH f AS (SELECT regr_slope(o_totalprice, o_custkey) AS b, avg(o_custkey) AS m FROM orders)
SELECT 'numeric__o_custkey' AS feature, round(avg(abs(b * (o_custkey - m))), 2) AS importance FROM orders, f""",
    "shap_sampled_linear": """WITH p AS (SELECT p_partkey, CAST(p_partkey % 1000 AS DOUBLE) AS k, CAST(p_size AS DOUBLE) AS s FROM part),
d AS (SELECT avg(k) AS mk, avg(s) AS ms FROM (SELECT * FROM p ORDER BY md5(p_partkey || '|42') LIMIT 100))
SELECT p_partkey, 'key_mod' AS feature, round(0.1::DOUBLE * (k - mk), 4) AS contribution, round(900 + 0.1::DOUBLE * mk + 0.05::DOUBLE * ms, 4) AS base_value FROM p, d
UNION ALL SELECT p_partkey, 'p_size', round(0.05::DOUBLE * (s - ms), 4), round(900 + 0.1::DOUBLE * mk + 0.05::DOUBLE * ms, 4) FROM p, d""",
    "explain_target": """WITH s AS (SELECT CASE WHEN count(DISTINCT l_linestatus) = 2 THEN 10.0 ELSE 6.0 END AS score FROM lineitem)
SELECT 'target_column' AS item, 'l_linestatus' AS "text" UNION ALL SELECT 'confidence_score', printf('%.1f', score) FROM s
UNION ALL SELECT 'explanation', printf('The target column ''l_linestatus'' was identified with %.1f%% confidence using intelligent analysis.', score) FROM s
UNION ALL SELECT 'reasoning', CASE WHEN score >= 8 THEN 'This column has strong characteristics of a target variable (binary or categorical with few classes).'
 ELSE 'This column has moderate characteristics of a target variable.' END FROM s""",
    "explain_prep": f"""WITH {DIRTY_SQL} SELECT 'Missing Value Imputation' AS step, 'Median for numeric, Most Frequent for categorical' AS "method",
 'Missing values were detected and will be handled appropriately.' AS reason FROM dirty HAVING count(*) > count(l_quantity) OR count(*) > count(l_returnflag)
UNION ALL SELECT 'Numeric Scaling', 'StandardScaler', 'Numeric features were standardized to have zero mean and unit variance.'
UNION ALL SELECT 'Categorical Encoding', 'OneHotEncoder', 'Categorical features were one-hot encoded to convert them into numerical format.'""",
    "predict_batch": """SELECT o_orderkey, o_custkey, round(a + b * o_custkey, 2) AS prediction FROM orders,
 (SELECT regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a FROM orders)""",
    "predict_proba": f"""WITH {NB_SQL},
p AS (SELECT doc_id, c, exp(l - max(l) OVER (PARTITION BY doc_id)) AS e FROM ll)
SELECT doc_id, CAST(c AS VARCHAR) AS "class", round(e / sum(e) OVER (PARTITION BY doc_id), 4) AS "value" FROM p""",
}
