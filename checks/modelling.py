"""Model, training and leaderboard queries."""

from __future__ import annotations

from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from checks.evaluation import rounded
from checks.tables import DOC_QUALITY_SQL, PART_PRICE_SQL, doc_quality, part_price, table
from tabml.operators import evaluate as E
from tabml.operators.boost import Boosting, Settings
from tabml.operators.knn import knn_classify, knn_regress
from tabml.operators.models import Facts, build, training_facts
from tabml.operators.split import split_random
from tabml.plans import leaderboard as L
from tabml.plans import train as R
from tabml.plans import tune as U
from tabml.session import scratch_path

DOC = ("quality", ["letter_share", "n_chars", "lang", "source"], ["doc_id"], "binary_classification")
PART = ("p_retailprice", ["key_mod", "p_size", "p_type"], ["p_partkey"], "regression")


def boosted_stumps(spark, folder):
    """Two rounds of one level on the part prices, and their rows."""
    part = part_price(spark, folder).select("p_partkey", array_to_vector(F.array(F.col("p_size").cast("double"), F.col("key_mod") % 100)).alias("features"),
                                            F.col("p_retailprice").alias("label"))
    return Boosting(Settings("squared", rounds=2, depth=1)).fit(part), part


def boosted_cuts(spark, folder):
    """The cuts of both rounds."""
    model, _ = boosted_stumps(spark, folder)
    rows = [(i + 1, t.feature[0], round(t.gain[0]), int(model.edges[t.feature[0]][t.cut[0]] // 1), int(t.cover[t.left[0]]),
             round(t.value[t.left[0]], 6), round(t.value[t.left[0] + 1], 6)) for i, [t] in enumerate(model.trees)]
    return spark.createDataFrame(rows, "round int, feature int, gain long, cut long, rows_left long, value_left double, value_right double")


def _round_sql(i: int) -> str:
    """The best cut of the margins of round i, and the margins after it."""
    return f"""
sums{i} AS (SELECT feature, x, sum(m - y) AS g, count(*) AS n FROM
            (SELECT 0 AS feature, a AS x, m, y FROM m{i} UNION ALL SELECT 1, b, m, y FROM m{i}) GROUP BY feature, x),
low{i} AS (SELECT feature, x, sum(g) OVER o AS gl, sum(n) OVER o AS nl, sum(g) OVER w AS ga, sum(n) OVER w AS na FROM sums{i}
           WINDOW o AS (PARTITION BY feature ORDER BY x), w AS (PARTITION BY feature)),
cut{i} AS (SELECT *, gl * gl / (nl + 1) + (ga - gl) * (ga - gl) / (na - nl + 1) - ga * ga / (na + 1) AS gain, -0.3 * gl / (nl + 1) AS value_left,
                  -0.3 * (ga - gl) / (na - nl + 1) AS value_right FROM low{i} WHERE nl < na ORDER BY round(gain, 3) DESC, feature, x LIMIT 1),
m{i + 1} AS (SELECT a, b, y, m + CASE WHEN CASE feature WHEN 0 THEN a ELSE b END <= x THEN value_left ELSE value_right END AS m FROM m{i}, cut{i})"""


STUMPS_SQL = f"""
m1 AS (SELECT p_size::DOUBLE AS a, (p_partkey % 100)::DOUBLE AS b, p_retailprice AS y, avg(p_retailprice) OVER () AS m FROM part),
{_round_sql(1)},{_round_sql(2)}"""
BOOSTED_CUTS_SQL = f"""
WITH {STUMPS_SQL}
SELECT 1::INT AS round, feature::INT AS feature, round(gain)::BIGINT AS gain, x::BIGINT AS cut, nl::BIGINT AS rows_left, round(value_left, 6) AS value_left,
       round(value_right, 6) AS value_right FROM cut1
UNION ALL SELECT 2, feature, round(gain)::BIGINT, x::BIGINT, nl::BIGINT, round(value_left, 6), round(value_right, 6) FROM cut2"""


def settled(df, ready):
    """The few rows of a result, fetched so that the prepared rows can be released."""
    rows = df.sparkSession.createDataFrame(df.collect(), df.schema)
    ready.release()
    return rows


def classifier(name, params=None):
    """Test metrics of one classifier on the labelled documents."""
    def run(spark, folder):
        ready = R.prepare(doc_quality(spark, folder), *DOC)
        trained = R.fit_model(ready, name, params)
        out = rounded(E.as_long(E.evaluate(trained.model.transform(ready.test), ready.task)))
        return settled(out.select(F.lit(name).alias("model"), "metric", "value"), ready)
    return run


def regressor(name, params=None):
    """Test metrics of one regressor on the part prices."""
    def run(spark, folder):
        ready = R.prepare(part_price(spark, folder), *PART)
        trained = R.fit_model(ready, name, params)
        out = rounded(E.as_long(E.evaluate(trained.model.transform(ready.test), ready.task)))
        return settled(out.select(F.lit(name).alias("model"), "metric", "value"), ready)
    return run


def clusterer(name):
    """Cluster sizes on the part prices."""
    def run(spark, folder):
        ready = R.prepare(part_price(spark, folder), "p_retailprice", ["key_mod", "p_size"], ["p_partkey"], "regression")
        model = build(name, Facts(0)).fit(ready.rows)
        return settled(model.transform(ready.rows).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n")), ready)
    return run


def vector(df, columns):
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def _line(name):
    def run(spark, folder):
        rows = vector(table(spark, folder, "lineitem").withColumn("label", F.col("l_extendedprice")), ["l_quantity"])
        model = build(name, training_facts(rows, classification=False)).fit(rows)
        fitted = rows.sparkSession.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")
        return rounded(fitted, 3)
    return run


def _knn_classes(spark, folder):
    rows = split_random(table(spark, folder, "embeddings"), ["vec_id"])
    scored = knn_classify(rows.filter("split = 'train'"), rows.filter("split = 'test'"), 5, "embedding", "label")
    return scored.select("vec_id", "label", "prediction")


def _knn_prices(spark, folder):
    rows = split_random(part_price(spark, folder), ["p_partkey"]).withColumn(
        "x", F.array("key_mod", F.col("p_size").cast("double") * 10))
    scored = knn_regress(rows.filter("split = 'train'"), rows.filter("split = 'test'"), 5, "x", "p_retailprice")
    return rounded(scored.select("p_partkey", "prediction"))


def gaussian_nb(spark, folder):
    rows = vector(doc_quality(spark, folder), ["letter_share", "n_chars"]).withColumn("label", F.col("quality").cast("double"))
    return build("GaussianNB", Facts(0)).fit(rows).transform(rows)


COUNTS = {"letters": r"[^\p{L}]", "digits": "[^0-9]", "spaces": "[^ ]"}


def _multinomial_nb(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", *[F.length(F.regexp_replace("text", p, "")).cast("double").alias(n) for n, p in COUNTS.items()])
    rows = docs.join(table(spark, folder, "labels"), "doc_id").withColumn("label", F.col("quality").cast("double"))
    rows = vector(rows, list(COUNTS))
    scored = build("MultinomialNB", Facts(0)).fit(rows).transform(rows)
    return scored.select("doc_id", F.col("prediction").cast("int").alias("prediction"))


def _trained(spark, folder):
    return R.train_model(doc_quality(spark, folder), *DOC)[1]


def _auto_trained(spark, folder):
    return R.auto_train(part_price(spark, folder), *PART, name="RandomForest")[1]


LINE = ("o_totalprice", ["o_custkey"], ["o_orderkey"], "regression")


def line_orders(spark, folder):
    """One feature and a target: whatever is fitted here has a closed form."""
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _trained_line(spark, folder):
    return R.train_model(line_orders(spark, folder), *LINE, name="LinearRegression", params={}, cv=0)[1]


def _auto_trained_line(spark, folder):
    return R.auto_train(line_orders(spark, folder), *LINE, name="LinearRegression")[1]


def _line_board(spark, folder):
    ready = R.prepare(line_orders(spark, folder), *LINE)
    board = settled(L.benchmark(ready, ["LinearRegression", "NoSuchModel"])[0], ready)
    return board.filter("metric <> 'training_time' OR metric IS NULL").select(
        "position", "model", "metric", "value", F.col("error").isNotNull().alias("failed"))


def _tuned_line(search, **more):
    def run(spark, folder):
        grid = {"alpha": [0.5, 100.0, 10_000.0]}
        return rounded(U.tune(line_orders(spark, folder), *LINE, "Ridge", search, grid=grid, **more)).select("setting", "mean", "std", "place")
    return run


def _cross_validated(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rounded(R.cross_validate(orders, "o_totalprice", ["o_custkey"], ["o_orderkey"], "regression", "LinearRegression"))


def _tuned(name, search, data, spec, **more):
    return lambda s, f: rounded(U.tune(data(s, f), *spec, name, search, **more))


def _board(data, spec, names=None, task=None):
    def run(spark, folder):
        target, features, key, known = spec
        if names is None:
            _, board, _, ready = L.run_benchmark(data(spark, folder), target, features, key, task)
        else:
            ready = R.prepare(data(spark, folder), target, features, key, known)
            board = L.benchmark(ready, names)[0]
        return settled(board, ready)
    return run


def _benchmark_run(spark, folder):
    task, board, _, ready = L.run_benchmark(doc_quality(spark, folder), *DOC[:3])
    place = L.rank(board, R.main_metric(task))
    ready.release()
    return place.select(F.lit(task).alias("task_type"), "place", "model", "value")


THRESHOLDS = list(range(5, 51, 5))


def rule_board(spark, folder):
    """A leaderboard of ten rules 'returned when the quantity exceeds t'; a rule that never fires failed."""
    lines = table(spark, folder, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), "l_quantity")
    each = lines.select("label", "l_quantity", F.posexplode(F.lit(THRESHOLDS)).alias("position", "t"))
    each = each.withColumn("model", F.concat(F.lit("over_"), F.col("t"))).withColumn("prediction", (F.col("l_quantity") > F.col("t")).cast("int"))
    metrics = E.eval_binary(each, by=["position", "model"]).drop("pos_label")
    fired = F.col("recall") > 0
    long = E.as_long(metrics.filter(fired), ["position", "model"]).withColumn("error", F.lit(None).cast("string"))
    failed = metrics.filter(~fired).select("position", "model", F.lit(None).cast("string").alias("metric"),
                                           F.lit(None).cast("double").alias("value"), F.lit("never fires").alias("error"))
    return long.unionByName(failed)


def _compared(spark, folder):
    board = rule_board(spark, folder)
    current = board.filter("model = 'over_25'").select("metric", "value")
    return rounded(L.compare_with_current(board, current))


QUERIES = {
    "fit_logistic": classifier("LogisticRegression"),
    "fit_linear": _line("LinearRegression"),
    "fit_ridge": _line("Ridge"),
    "fit_forest_clf": classifier("RandomForestClassifier"),
    "fit_forest_reg": regressor("RandomForestRegressor"),
    "fit_tree_clf": classifier("DecisionTreeClassifier"),
    "fit_tree_reg": regressor("DecisionTreeRegressor"),
    "fit_gbt_clf": classifier("GradientBoostingClassifier"),
    "fit_xgb_clf": classifier("XGBClassifier"),
    "fit_xgb_reg": regressor("XGBRegressor"),
    "boosted_cuts": boosted_cuts,
    "fit_svc": classifier("SVC"),
    "fit_svr": regressor("SVR"),
    "knn_classify": _knn_classes,
    "knn_regress": _knn_prices,
    "fit_gaussian_nb": lambda s, f: gaussian_nb(s, f).select("doc_id", F.col("prediction").cast("int").alias("prediction")),
    "fit_multinomial_nb": _multinomial_nb,
    "fit_kmeans": clusterer("KMeans"),
    "fit_hierarchical": clusterer("AgglomerativeClustering"),
    "train_model": _trained,
    "auto_train": _auto_trained,
    "train_line": _trained_line,
    "auto_train_line": _auto_trained_line,
    "benchmark_line": _line_board,
    "tune_grid_line": _tuned_line("grid"),
    "cross_validate": _cross_validated,
    "tune_grid": _tuned("LogisticRegression", "grid", doc_quality, DOC),
    "tune_random": _tuned("Ridge", "random", part_price, PART, tries=3),
    "benchmark_classification": _board(doc_quality, DOC, names=L.BENCHMARK_MODELS["classification"]),
    "benchmark_regression": _board(part_price, PART, names=L.BENCHMARK_MODELS["regression"]),
    "benchmark_clustering": _board(part_price, ("p_retailprice", ["key_mod", "p_size"], ["p_partkey"], None), task="clustering"),
    "benchmark_run": _benchmark_run,
    "benchmark_summary": lambda s, f: L.summary(rule_board(s, f), "accuracy"),
    "leaderboard_rank": lambda s, f: L.rank(rule_board(s, f), "f1_score"),
    "train_suggested": lambda s, f: L.train_suggested(doc_quality(s, f), *DOC)[0],
    "auto_train_best": lambda s, f: L.train_best(part_price(s, f), *PART[:3], scratch_path(s, "best"))[1],
    "compare_with_current": _compared,
}

ORDER = "md5({0} || '|42')"
EMB_SPLIT = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY md5(vec_id || '|42')) <= ceil(0.2::DOUBLE * count(*) OVER ()) AS test
      FROM embeddings),
n AS (SELECT q.vec_id, q.label, t.label AS vote, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, t.x), t.label) AS place
      FROM e q JOIN e t ON q.test AND NOT t.test),
v AS (SELECT vec_id, label, vote, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, vote) AS best
      FROM n WHERE place <= 5 GROUP BY vec_id, label, vote)"""
PART_SPLIT = f"""{PART_PRICE_SQL},
p AS (SELECT *, row_number() OVER (ORDER BY md5(p_partkey || '|42')) <= ceil(0.2::DOUBLE * count(*) OVER ()) AS test FROM part_price),
n AS (SELECT q.p_partkey, t.p_retailprice AS y, row_number() OVER (PARTITION BY q.p_partkey
      ORDER BY sqrt((q.key_mod - t.key_mod) ** 2 + (10.0::DOUBLE * q.p_size - 10.0::DOUBLE * t.p_size) ** 2), t.p_retailprice) AS place
      FROM p q JOIN p t ON q.test AND NOT t.test)"""
NB_SQL = f"""{DOC_QUALITY_SQL},
eps AS (SELECT 1e-9 * greatest(var_pop(letter_share), var_pop(n_chars)) AS e FROM doc_quality),
cls AS (SELECT quality AS c, ln(count(*) / (SELECT count(*) FROM doc_quality)) AS prior, avg(letter_share) AS m1, avg(n_chars) AS m2,
 var_pop(letter_share) + any_value(e) AS v1, var_pop(n_chars) + any_value(e) AS v2 FROM doc_quality, eps GROUP BY quality),
ll AS (SELECT doc_id, c, prior - 0.5 * (ln(2 * pi() * v1) + (letter_share - m1) ** 2 / v1 + ln(2 * pi() * v2) + (n_chars - m2) ** 2 / v2) AS l
 FROM doc_quality, cls)"""
RULES = f"""
r AS (SELECT t, 'over_' || t AS model, t // 5 - 1 AS position, l_returnflag = 'R' AS y, l_quantity > t AS p
      FROM lineitem, (SELECT unnest(range(5, 51, 5)) AS t)),
s AS (SELECT model, position, avg(CAST(y = p AS INT)) AS accuracy, coalesce(sum(CAST(y AND p AS INT)) / nullif(sum(CAST(p AS INT)), 0), 0) AS pr,
      sum(CAST(y AND p AS INT)) / sum(CAST(y AS INT)) AS re FROM r GROUP BY model, position),
f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM s),
board AS (SELECT position, model, unnest(['accuracy', 'precision', 'recall', 'f1_score']) AS metric,
      unnest([round(accuracy, 4), round(pr, 4), round(re, 4), round(f1, 4)]) AS val FROM f WHERE re > 0)"""

LINE_SPLIT = """
o AS (SELECT o_custkey AS x, o_totalprice AS y, row_number() OVER (ORDER BY md5(o_orderkey || '|42')) <= ceil(0.2::DOUBLE * count(*) OVER ()) AS test FROM orders),
fit AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM o WHERE NOT test),
sc AS (SELECT test, count(*) AS n, avg((y - a - b * x) ** 2) AS mse, avg(abs(y - a - b * x)) AS mae, 1 - avg((y - a - b * x) ** 2) / var_pop(y) AS r2
       FROM o, fit GROUP BY test)"""
TEST_METRICS = """SELECT {0}'mse' AS metric, round(mse, 4) AS "value"{1} FROM sc WHERE test UNION ALL SELECT {0}'rmse', round(sqrt(mse), 4){1} FROM sc WHERE test
UNION ALL SELECT {0}'mae', round(mae, 4){1} FROM sc WHERE test UNION ALL SELECT {0}'r2_score', round(r2, 4){1} FROM sc WHERE test"""

SQL = {
    "boosted_cuts": BOOSTED_CUTS_SQL,
    "train_line": f"""WITH {LINE_SPLIT} SELECT 'LinearRegression' AS model, CASE WHEN test THEN 'test_score' ELSE 'train_score' END AS metric, round(r2, 4) AS "value" FROM sc
UNION ALL SELECT 'LinearRegression', CASE WHEN test THEN 'test_samples' ELSE 'train_samples' END, n FROM sc""",
    "auto_train_line": f"""WITH {LINE_SPLIT} SELECT 'LinearRegression' AS model, 'training' AS "section", CASE WHEN test THEN 'test_score' ELSE 'train_score' END AS metric, round(r2, 4) AS "value" FROM sc
UNION ALL SELECT 'LinearRegression', 'training', CASE WHEN test THEN 'test_samples' ELSE 'train_samples' END, n FROM sc
UNION ALL SELECT 'LinearRegression', 'evaluation', metric, "value" FROM ({TEST_METRICS.format('', '')})""",
    "benchmark_line": f"""WITH {LINE_SPLIT} {TEST_METRICS.format("1 AS position, 'LinearRegression' AS model, ", ", FALSE AS failed")}
UNION ALL SELECT 2, 'NoSuchModel', NULL, NULL, TRUE""",
    "tune_grid_line": """WITH o AS (SELECT o_custkey AS x, o_totalprice AS y, row_number() OVER (ORDER BY md5(o_orderkey || '|42')) - 1 AS r, count(*) OVER () AS n FROM orders),
k AS (SELECT x, y, CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1) ELSE n % 5 + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM o),
m AS (SELECT f.fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, regr_sxy(y, x) AS sxy
      FROM k JOIN (SELECT DISTINCT fold FROM k) f ON k.fold <> f.fold GROUP BY f.fold),
g AS (SELECT unnest([0, 1, 2]) AS setting, unnest([0.5, 100.0, 10000.0]::DOUBLE[]) AS alpha),
s AS (SELECT setting, k.fold, 1 - avg((y - my - sxy / sx / (n + alpha) * (x - mx) / sx) ** 2) / var_pop(y) AS score FROM k JOIN m ON k.fold = m.fold, g GROUP BY setting, k.fold),
a AS (SELECT setting, avg(score) AS mean, stddev_pop(score) AS std FROM s GROUP BY setting)
SELECT setting, round(mean, 4) AS mean, round(std, 4) AS std, row_number() OVER (ORDER BY mean DESC, setting) AS place FROM a""",
    "fit_linear": """SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope,
 round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem""",
    "fit_ridge": """SELECT round(b, 3) AS slope, round(my - b * mx, 3) AS intercept FROM (
 SELECT regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 1) AS b,
  avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem)""",
    "knn_classify": f"WITH {EMB_SPLIT} SELECT vec_id, label, vote AS prediction FROM v WHERE best = 1",
    "knn_regress": f"WITH {PART_SPLIT} SELECT p_partkey, round(avg(y), 4) AS prediction FROM n WHERE place <= 5 GROUP BY p_partkey",
    "fit_gaussian_nb": f"WITH {NB_SQL} SELECT doc_id, arg_max(c, l) AS prediction FROM ll GROUP BY doc_id",
    "fit_multinomial_nb": r"""WITH d AS (SELECT doc_id, quality AS c, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS a,
 length(regexp_replace(text, '[^0-9]', '', 'g')) AS b, length(regexp_replace(text, '[^ ]', '', 'g')) AS s FROM documents JOIN labels USING (doc_id)),
k AS (SELECT c, ln((count(*)) / (SELECT count(*) FROM d)) AS prior, ln((sum(a) + 1) / (sum(a) + sum(b) + sum(s) + 3)) AS la,
 ln((sum(b) + 1) / (sum(a) + sum(b) + sum(s) + 3)) AS lb, ln((sum(s) + 1) / (sum(a) + sum(b) + sum(s) + 3)) AS ls FROM d GROUP BY c)
SELECT doc_id, arg_max(k.c, prior + a * la + b * lb + s * ls) AS prediction FROM d, k GROUP BY doc_id""",
    "cross_validate": """WITH o AS (SELECT o_custkey AS x, o_totalprice AS y, row_number() OVER (ORDER BY md5(o_orderkey || '|42')) - 1 AS r,
 count(*) OVER () AS n FROM orders),
k AS (SELECT x, y, CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1)
 ELSE n % 5 + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM o),
m AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k JOIN (SELECT DISTINCT fold FROM k) f ON k.fold <> f.fold GROUP BY f.fold)
SELECT CAST(k.fold AS INT) AS fold, round(1 - avg((y - a - b * x) ** 2) / var_pop(y), 4) AS score FROM k JOIN m ON k.fold = m.fold GROUP BY k.fold""",
    "benchmark_summary": f"""WITH {RULES} SELECT 'total_models_tested' AS field, NULL AS rank, NULL AS model, count(*) AS "value" FROM f
UNION ALL SELECT 'successful_models', NULL, NULL, count(*) FROM f WHERE re > 0
UNION ALL SELECT 'failed_models', NULL, NULL, count(*) FROM f WHERE re = 0
UNION ALL SELECT 'top_model', row_number() OVER (ORDER BY val DESC, position), model, val FROM board WHERE metric = 'accuracy'
 QUALIFY row_number() OVER (ORDER BY val DESC, position) <= 3""",
    "leaderboard_rank": f"""WITH {RULES} SELECT model, val AS "value", row_number() OVER (ORDER BY val DESC, position) AS place
 FROM board WHERE metric = 'f1_score'""",
    "compare_with_current": f"""WITH {RULES} SELECT b.model, b.metric, b.val AS "value", c.val AS "current", round(b.val - c.val, 4) AS delta
 FROM board b JOIN board c ON b.metric = c.metric AND c.model = 'over_25'""",
}
