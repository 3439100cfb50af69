"""Readers, registry, monitoring and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as W
from checks.evaluation import rounded
from checks.tables import DIRTY_SQL, RULE_SQL, dirty_lineitem, rule_predictions, table
from tabml.operators import evaluate as E
from tabml.operators import monitor as M
from tabml.operators import registry as G
from tabml.plans import train as R
from tabml.session import scratch_path
from tabml.sources import files as S
from tabml.sources import task_log as T
from tabml.streaming import jobs as J


# --- readers ---

def _csv(spark, folder):
    return S.load(spark, W.write_csv(dirty_lineitem(spark, folder), ".csv", ","))


def _csv_text(spark, folder):
    """Texts with line breaks, quotes and commas."""
    return S.load(spark, W.write_csv(table(spark, folder, "documents"), ".csv", ","))


def _tsv(spark, folder):
    return S.load(spark, W.write_csv(table(spark, folder, "orders"), ".tsv", "\t"))


def _json(spark, folder):
    return S.load(spark, W.write_json_arrays(table(spark, folder, "customer"), "c_custkey"))


def _json_lines(spark, folder):
    path = scratch_path(spark, "lines") + ".json"
    S.save(table(spark, folder, "orders"), path)
    return S.load(spark, path)


def _xlsx_mixed(spark, folder):
    """Every other workbook lacks the balance, the rest the segment."""
    odd = F.floor(F.col("c_custkey") / 50) % 2 == 1
    customers = table(spark, folder, "customer").withColumn("c_acctbal", F.when(odd, F.col("c_acctbal"))).withColumn(
        "c_mktsegment", F.when(~odd, F.col("c_mktsegment")))
    return S.load(spark, W.write_workbooks(customers, "c_custkey", rows_per_book=50, sparse=True) + "/*.xlsx")


def _xlsx(spark, folder):
    customers = table(spark, folder, "customer").withColumn("rich", F.col("c_acctbal") > 5000)
    return S.load(spark, W.write_workbooks(customers, "c_custkey") + "/*.xlsx")


def _snapshot(spark, folder):
    path = S.snapshot(table(spark, folder, "orders"), scratch_path(spark, "copies"), "orders")
    return S.load(spark, path + "/*.parquet")


def _tasks(spark, folder):
    """A log with one task per event; even events carry benchmark results."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    later = F.date_format(F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("user_id").cast("decimal(18,6)")),
                          "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    good = F.to_json(F.struct(F.col("value").alias("rmse"), (F.col("user_id") / 4).alias("training_time")))
    results = F.struct(F.lit("regression").alias("task_type"), F.lit("model_a").alias("best_model_name"),
                       F.col("value").alias("best_score"), F.lit("rmse").alias("best_metric"),
                       F.create_map(F.lit("model_a"), F.from_json(good, "map<string,string>"),
                                    F.lit("model_b"), F.create_map(F.lit("error"), F.lit("no rows"))).alias("all_results"),
                       F.col("user_id").alias("n_samples"), F.lit(4).alias("n_features"))
    task = F.struct(F.concat(F.lit("task-"), "event_id").alias("id"), F.col("event_type").alias("type"),
                    F.when(F.col("event_id") % 2 == 0, "completed").otherwise("failed").alias("status"),
                    F.create_map(F.lit("model_name"), F.lit("RandomForest")).alias("params"),
                    stamp.alias("created_at"), stamp.alias("started_at"), later.alias("completed_at"),
                    F.when(F.col("event_id") % 2 == 0, results).alias("result"),
                    F.when(F.col("event_id") % 2 == 1, "Target column not set").alias("error"),
                    (F.col("event_id") % 101).alias("progress"))
    rows = table(spark, folder, "events").select("event_id", F.concat(F.lit("task-"), "event_id").alias("task_id"), task.alias("task"))
    return T.read_task_log(spark, W.write_task_logs(rows, "event_id"))


def _task_log(spark, folder):
    log = T.with_seconds(_tasks(spark, folder))
    return log.select("task_id", "type", "status", F.col("params")["model_name"].alias("model_name"), "seconds", "error", "progress",
                      F.col("result.best_score").alias("best_score"))


# --- registry ---

def registry_events(spark, folder):
    """Registry events from the event table: two kinds save, the others touch an earlier id."""
    kind = (F.when(F.col("event_type").isin("signup", "click"), "save").when(F.col("event_type") == "purchase", "activate")
            .when(F.col("event_type") == "error", "delete").otherwise("deploy"))
    e = table(spark, folder, "events")
    return e.select(
        F.when(kind == "save", F.col("event_id")).otherwise(F.col("event_id") - 1 - F.col("event_id") % 3).alias("id"),
        kind.alias("event"), F.concat(F.lit("model_"), F.col("user_id") % 20).alias("model_name"),
        F.concat(F.lit("v"), "event_id").alias("version"), F.concat(F.lit("models/m"), "event_id").alias("file_path"),
        F.lit("binary_classification").alias("task_type"), F.lit("label").alias("target_column"),
        (F.col("value") / 100).alias("accuracy"), F.lit(None).cast("double").alias("f1_score"),
        F.lit(None).cast("double").alias("r2_score"), (F.col("user_id") * 10).alias("n_samples"),
        F.lit(4).cast("bigint").alias("n_features"), F.lit("RandomForestClassifier").alias("model_type"),
        F.col("ts").alias("created_at"), F.lit("").alias("description"),
        F.to_json(F.array("event_type", F.concat(F.lit("t"), F.col("user_id") % 3))).alias("tags"))


REGISTRY_SQL = """
reg AS (SELECT CASE WHEN event_type IN ('signup', 'click') THEN event_id ELSE event_id - 1 - event_id % 3 END AS id,
 CASE WHEN event_type IN ('signup', 'click') THEN 'save' WHEN event_type = 'purchase' THEN 'activate'
      WHEN event_type = 'error' THEN 'delete' ELSE 'deploy' END AS event,
 'model_' || user_id % 20 AS model_name, 'v' || event_id AS version, 'models/m' || event_id AS file_path,
 value / 100 AS accuracy, user_id * 10 AS n_samples, ts AS created_at,
 '["' || event_type || '","t' || user_id % 3 || '"]' AS tags FROM events),
live AS (SELECT * FROM reg WHERE event = 'save' AND id NOT IN (SELECT id FROM reg WHERE event = 'delete'))"""


def candidates(spark, folder):
    views = table(spark, folder, "events").filter("event_type = 'view'")
    version = (F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("v"), F.col("event_id") - 1))
               .when(F.col("event_id") % 3 == 2, F.concat(F.lit("c"), F.col("event_id") % 30)))
    return views.select(
        F.concat(F.lit("model_"), F.col("user_id") % 20).alias("model_name"), version.alias("version"),
        F.col("ts").alias("created_at"), F.concat(F.lit("a , b"), F.col("user_id") % 3).alias("tags"), F.lit("").alias("description"),
        F.lit("regression").alias("task_type"), F.lit("y").alias("target_column"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("training_accuracy"), (F.col("value") / 2).alias("evaluation_accuracy"),
        *[F.lit(None).cast("double").alias(f"{p}_{m}") for p in ("training", "evaluation") for m in ("f1_score", "r2_score")],
        F.col("user_id").alias("n_samples"), F.lit(4).cast("bigint").alias("n_features"), F.lit("Ridge").alias("model_type"))


def _saved(spark, folder):
    return G.save_versions(registry_events(spark, folder), candidates(spark, folder)).select(
        "id", "model_name", "version", "file_path", "accuracy", "tags")


def _listed(spark, folder):
    models = G.list_models(registry_events(spark, folder))
    return G.newest_first(models).select("id", "model_name", "version", "accuracy", "n_samples", F.to_json("tags").alias("tags"),
                                         "is_active", "is_deployed")


def _activated(spark, folder):
    """Activate the best living version and list what is active then."""
    events = registry_events(spark, folder)
    best = G.living(events).agg(F.max_by("id", F.struct("accuracy", "id")).alias("id"))
    at = F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")
    both = events.unionByName(G.activate(events, best, at))
    return G.list_models(both).groupBy("is_active").agg(F.count(F.lit(1)).alias("n"), F.max("accuracy").alias("best"))


def _marked(action):
    """Apply the action to every fifth id and count what the list holds afterwards."""
    def run(spark, folder):
        events = registry_events(spark, folder)
        ids = G.saves(events).filter("id % 5 = 0").select("id")
        at = F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")
        both = events.unionByName(action(events, ids, at))
        return G.list_models(both).groupBy("model_name").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("is_deployed").alias("deployed"), F.max("id").alias("newest"))
    return run


def _loaded(spark, folder):
    """Save a fitted line as a version, load it by id, score the table; the version is active then."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    trained = fitted_line(orders)
    registry, models = scratch_path(spark, "registry"), scratch_path(spark, "models")
    for version in ("v1", "v2"):
        number = G.save_version(trained, registry, models, "line", version, tags="a, b", n_samples=orders.count())
    loaded = G.load_version(spark, registry, number - 1)
    active = G.list_models(G.read_events(spark, registry)).filter("is_active").select("version", F.to_json("tags").alias("tags"))
    return rounded(loaded.predict(orders), 2).withColumn("version", active.select("version").scalar()).withColumn(
        "tags", active.select("tags").scalar())


def fitted_line(orders):
    prep = R.fit_prep(orders, ["o_custkey"])
    rows = R.add_label(prep.transform(orders), "o_totalprice", None)
    model = R.build("LinearRegression", R.training_facts(rows, classification=False)).fit(rows)
    return R.Trained("LinearRegression", "regression", "o_totalprice", ["o_custkey"], None, prep, model, {})


def _expired(spark, folder):
    events = registry_events(spark, folder)
    return G.expired(events, events.agg(F.max("created_at")).scalar(), days=1).select("id", "model_name", "version")


# --- monitoring and streams ---

def _threshold(spark, folder):
    scored = table(spark, folder, "lineitem").select(
        "l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_quantity") > 45).cast("int").alias("prediction"))
    accuracy = rounded(E.eval_binary(scored, by=["l_suppkey"])).select("l_suppkey", F.col("accuracy").alias("test_score"))
    return M.threshold(accuracy)


def _event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return J.read_stream(spark, folder, schema, pattern="events.parquet")


def _drained(spark, stream):
    path = scratch_path(spark, "stream")
    J.write_available(stream, path, scratch_path(spark, "progress"))
    return spark.read.parquet(path)


def _stream(spark, folder):
    return _drained(spark, _event_stream(spark, folder))


def _predict_stream(spark, folder):
    """A line fitted on the whole table scores the same table as a stream."""
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    prep = R.fit_prep(events, ["user_id"])
    rows = R.add_label(prep.transform(events), "value", None)
    model = R.build("LinearRegression", R.training_facts(rows, classification=False)).fit(rows)
    trained = R.Trained("LinearRegression", "regression", "value", ["user_id"], None, prep, model, {})
    return rounded(_drained(spark, J.score_stream(trained, _event_stream(spark, folder).select("event_id", "user_id", "value"))))


def _predict_stream_knn(spark, folder):
    """Nearest neighbours score a stream: the key itself is the feature, so one neighbour is the row itself."""
    parts = table(spark, folder, "events").select("event_id", "value")
    prep = R.fit_prep(parts, ["event_id"])
    rows = R.add_label(prep.transform(parts), "value", None)
    model = R.build("KNeighborsRegressor", R.training_facts(rows, classification=False), {"n_neighbors": 1}).fit(rows)
    trained = R.Trained("KNeighborsRegressor", "regression", "value", ["event_id"], None, prep, model, {})
    path = scratch_path(spark, "stream")
    J.score_available(trained, _event_stream(spark, folder).select("event_id", "value"), path, scratch_path(spark, "progress"))
    return rounded(spark.read.parquet(path).drop("batch"))


def _rule(events):
    return events.select("ts", (F.col("event_type") == "purchase").cast("int").alias("label"), (F.col("value") > 30).cast("int").alias("prediction"))


def _shown(windows, digits=4):
    return rounded(windows, digits).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")})


def _quality_stream(spark, folder):
    return _shown(_drained(spark, J.quality_stream(_rule(_event_stream(spark, folder)), "ts")))


def _quality_batch(spark, folder):
    return _shown(M.windowed_quality(_rule(table(spark, folder, "events")), "ts"))


def _drift_stream(spark, folder):
    known = M.baseline(table(spark, folder, "events"), "value")
    return _shown(_drained(spark, J.drift_stream(_event_stream(spark, folder).select("ts", "value"), "ts", "value", known)), 6)


WINDOW = "time_bucket(INTERVAL 30 MINUTES, ts)"
CLOSED = "WHERE start + INTERVAL 30 MINUTES <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"
QUALITY_SQL = f"""
q AS (SELECT {WINDOW} AS start, count(*) AS n, avg(CAST((event_type = 'purchase') = (value > 30) AS INT)) AS accuracy,
 coalesce(count(*) FILTER (WHERE event_type = 'purchase' AND value > 30) / nullif(count(*) FILTER (WHERE value > 30), 0), 0) AS p,
 coalesce(count(*) FILTER (WHERE event_type = 'purchase' AND value > 30) / nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0), 0) AS r
 FROM events GROUP BY 1),
shown AS (SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS "start", strftime(start + INTERVAL 30 MINUTES, '%Y-%m-%d %H:%M:%S') AS "end", n,
 round(accuracy, 4) AS accuracy, round(p, 4) AS "precision", round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1_score,
 CASE WHEN accuracy < 0.7 THEN 'warning' ELSE 'healthy' END AS status FROM q {{where}})"""

QUERIES = {
    "io_csv": _csv,
    "io_csv_text": _csv_text,
    "io_tsv": _tsv,
    "io_json": _json,
    "io_json_lines": _json_lines,
    "io_xlsx": _xlsx,
    "io_xlsx_mixed": _xlsx_mixed,
    "io_snapshot": _snapshot,
    "task_log": _task_log,
    "task_status": lambda s, f: T.task_status(_tasks(s, f), "task-77"),
    "task_leaderboard": lambda s, f: T.task_leaderboard(_tasks(s, f)),
    "io_stream": _stream,
    "registry_save": _saved,
    "registry_list": _listed,
    "registry_activate": _activated,
    "registry_delete": _marked(G.delete),
    "registry_deploy": _marked(G.deploy),
    "registry_expired": _expired,
    "registry_load": _loaded,
    "predict_stream_knn": _predict_stream_knn,
    "monitor_threshold": _threshold,
    "predict_stream": _predict_stream,
    "monitor_quality": _quality_batch,
    "monitor_stream": _quality_stream,
    "monitor_drift": _drift_stream,
}

STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g')"
TASKS_SQL = """t AS (SELECT 'task-' || event_id AS task_id, * FROM events)"""
LIST_SQL = """
last AS (SELECT id, created_at FROM reg WHERE event = 'activate' AND id IN (SELECT id FROM reg WHERE event = 'save') {also}
 ORDER BY created_at DESC, id DESC LIMIT 1)"""
MARK_SQL = """SELECT model_name, count(*) AS n, count(*) FILTER (WHERE {deployed}) AS deployed, max(id) AS newest
 FROM live {where} GROUP BY model_name"""

SQL = {
    "io_csv": f"WITH {DIRTY_SQL} SELECT * REPLACE ({STAMP.format('l_shipdate')} AS l_shipdate) FROM dirty",
    "io_csv_text": "SELECT * FROM documents",
    "io_tsv": f"SELECT * REPLACE ({STAMP.format('o_orderdate')} AS o_orderdate) FROM orders",
    "io_json_lines": f"SELECT * REPLACE ({STAMP.format('o_orderdate')} AS o_orderdate) FROM orders",
    "io_xlsx_mixed": """SELECT * REPLACE (CASE WHEN c_custkey // 50 % 2 = 1 THEN c_acctbal END AS c_acctbal,
 CASE WHEN c_custkey // 50 % 2 = 0 THEN c_mktsegment END AS c_mktsegment) FROM customer""",
    "io_json": "SELECT * FROM customer",
    "io_xlsx": "SELECT *, c_acctbal > 5000 AS rich FROM customer",
    "io_snapshot": "SELECT * FROM orders",
    "task_log": f"""WITH {TASKS_SQL} SELECT task_id, event_type AS "type", CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE 'failed' END AS status,
 'RandomForest' AS model_name, CAST(user_id AS DOUBLE) AS seconds, CASE WHEN event_id % 2 = 1 THEN 'Target column not set' END AS error,
 event_id % 101 AS progress, CASE WHEN event_id % 2 = 0 THEN value END AS best_score FROM t""",
    "task_status": f"""WITH {TASKS_SQL} SELECT task_id, 'failed' AS status, event_id % 101 AS progress, 'Target column not set' AS error,
 CAST(user_id AS DOUBLE) AS seconds FROM t WHERE task_id = 'task-77'""",
    "task_leaderboard": f"""WITH {TASKS_SQL} SELECT task_id, 'regression' AS task_type, 'model_a' AS model, 'rmse' AS metric, value AS "value", NULL AS error
 FROM t WHERE event_id % 2 = 0
UNION ALL SELECT task_id, 'regression', 'model_a', 'training_time', user_id / 4, NULL FROM t WHERE event_id % 2 = 0
UNION ALL SELECT task_id, 'regression', 'model_b', NULL, NULL, 'no rows' FROM t WHERE event_id % 2 = 0""",
    "io_stream": "SELECT * FROM events",
    "registry_save": f"""WITH {REGISTRY_SQL},
c AS (SELECT 'model_' || user_id % 20 AS model_name, CASE event_id % 3 WHEN 1 THEN 'v' || (event_id - 1) WHEN 2 THEN 'c' || event_id % 30
 ELSE 'v' || strftime(ts, '%Y%m%d_%H%M%S') END AS version, ts, CASE WHEN event_id % 2 = 0 AND value <> 0 THEN value ELSE value / 2 END AS accuracy,
 '["a","b' || user_id % 3 || '"]' AS tags FROM events WHERE event_type = 'view'),
u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY model_name, version ORDER BY ts) = 1),
f AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM reg WHERE event = 'save' AND reg.model_name = u.model_name AND reg.version = u.version))
SELECT (SELECT max(id) FROM reg) + row_number() OVER (ORDER BY ts, model_name, version) AS id, model_name, version,
 'models/' || model_name || '_' || version AS file_path, accuracy, tags FROM f""",
    "registry_list": f"""WITH {REGISTRY_SQL}, {LIST_SQL.format(also='')}
SELECT id, model_name, version, accuracy, n_samples, tags,
 (SELECT count(*) FROM last) = 0 OR id = (SELECT id FROM last) OR created_at > (SELECT created_at FROM last) AS is_active,
 id IN (SELECT id FROM reg WHERE event = 'deploy') AS is_deployed FROM live""",
    "registry_activate": f"""WITH {REGISTRY_SQL}, best AS (SELECT id FROM live ORDER BY accuracy DESC, id DESC LIMIT 1)
SELECT id = (SELECT id FROM best) AS is_active, count(*) AS n, max(accuracy) AS best FROM live GROUP BY 1""",
    "registry_delete": f"WITH {REGISTRY_SQL} " + MARK_SQL.format(
        deployed="id IN (SELECT id FROM reg WHERE event = 'deploy')", where="WHERE id % 5 <> 0"),
    "registry_deploy": f"WITH {REGISTRY_SQL} " + MARK_SQL.format(
        deployed="id % 5 = 0 OR id IN (SELECT id FROM reg WHERE event = 'deploy')", where=""),
    "registry_load": """SELECT o_orderkey, o_custkey, round(a + b * o_custkey, 2) AS prediction, 'v1' AS version, '["a","b"]' AS tags FROM orders,
 (SELECT regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a FROM orders)""",
    "predict_stream_knn": "SELECT event_id, round(value, 4) AS prediction FROM events",
    "registry_expired": f"""WITH {REGISTRY_SQL} SELECT id, model_name, version FROM live
 WHERE created_at < (SELECT max(created_at) FROM reg) - INTERVAL 1 DAY""",
    "monitor_threshold": """WITH s AS (SELECT l_suppkey, round(avg(CAST((l_returnflag = 'R') = (l_quantity > 45) AS INT)), 4) AS test_score
 FROM lineitem GROUP BY l_suppkey)
SELECT *, CASE WHEN test_score < 0.7 THEN 'warning' ELSE 'healthy' END AS status,
 CASE WHEN test_score < 0.7 THEN 'Model performance below threshold: ' || test_score ELSE 'Model performance OK' END AS message FROM s""",
    "predict_stream": """SELECT event_id, user_id, round(a + b * user_id, 4) AS prediction FROM events,
 (SELECT regr_slope(value, user_id) AS b, regr_intercept(value, user_id) AS a FROM events)""",
    "monitor_quality": f"WITH {QUALITY_SQL.format(where='')} SELECT * FROM shown",
    "monitor_stream": f"WITH {QUALITY_SQL.format(where=CLOSED)} SELECT * FROM shown",
    "monitor_drift": f"""WITH k AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events),
w AS (SELECT {WINDOW} AS start, count(*) AS n, avg(value) AS mean, (count(*) - count(value)) / count(*) AS gaps FROM events GROUP BY 1)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS "start", strftime(start + INTERVAL 30 MINUTES, '%Y-%m-%d %H:%M:%S') AS "end", n,
 round(mean, 6) AS mean, round(gaps, 6) AS missing, round((mean - m) / s, 6) AS shift, round(gaps, 6) AS missing_change FROM w, k {CLOSED}""",
}
