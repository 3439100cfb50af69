"""Feature preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.evaluation import rounded
from checks.tables import DIRTY_SQL, dirty_lineitem, doc_quality, part_price, table
from tabml.operators import prep as P

DIRTY_FEATURES = ["l_quantity", "l_returnflag"]


def _filled(spark, folder):
    dirty = dirty_lineitem(spark, folder).select("l_orderkey", "l_linenumber", *DIRTY_FEATURES)
    model = P.fit_prep(dirty, DIRTY_FEATURES, scale=False)
    cells = model.transform(dirty)
    names = F.lit([n for n, _ in model.slots()])
    long = cells.select(F.posexplode(P.vector_to_array("features")).alias("slot", "value"))
    return long.groupBy(F.try_element_at(names, F.col("slot") + 1).alias("name"), "value").agg(F.count(F.lit(1)).alias("n"))


def _filled_new(spark, folder):
    """Fitted on rows without gaps, applied to rows with some."""
    model = P.fit_prep(table(spark, folder, "lineitem"), DIRTY_FEATURES, scale=False)
    cells = model.transform(dirty_lineitem(spark, folder))
    names = F.lit([n for n, _ in model.slots()])
    long = cells.select(F.posexplode(P.vector_to_array("features")).alias("slot", "value"))
    return long.groupBy(F.try_element_at(names, F.col("slot") + 1).alias("name"), "value").agg(F.count(F.lit(1)).alias("n"))


def _constant(spark, folder):
    """A category that never varies gives no column."""
    orders = table(spark, folder, "orders").withColumn("shop", F.lit("one"))
    model = P.fit_prep(orders, ["shop", "o_orderstatus", "o_custkey"], scale=False)
    return P.matrix_cells(model.transform(orders), model, "o_orderkey")


def _scaled(spark, folder):
    orders = table(spark, folder, "orders")
    model = P.fit_prep(orders, ["o_totalprice", "o_custkey"])
    return rounded(P.matrix_cells(model.transform(orders), model, "o_orderkey"))


def _onehot(spark, folder):
    orders = table(spark, folder, "orders")
    model = P.fit_prep(orders, ["o_orderstatus", "o_orderpriority"])
    return P.matrix_cells(model.transform(orders), model, "o_orderkey").filter("value = 1").select("o_orderkey", "name")


def _matrix(spark, folder):
    parts = part_price(spark, folder).withColumn("big", F.col("p_size") > 25)
    model = P.fit_prep(parts, ["key_mod", "p_size", "p_type", "big"])
    return rounded(P.matrix_cells(model.transform(parts), model, "p_partkey"))


def _names(spark, folder):
    docs = doc_quality(spark, folder)
    return P.feature_names(docs, P.fit_prep(docs, ["letter_share", "n_chars", "lang", "source"])).select("name", "source")


def _summary(spark, folder):
    docs = doc_quality(spark, folder)
    model = P.fit_prep(docs, ["letter_share", "n_chars", "lang"])
    return P.prep_summary(docs, model, "quality").withColumn("steps", F.array_join("steps", ",")).withColumn(
        "feature_names", F.array_join(F.array_sort("feature_names"), ","))


def _encoded(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return P.encode(orders, "o_orderpriority", P.class_list(orders, "o_orderpriority"))


def _decoded(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    labels = P.class_list(orders, "o_orderpriority")
    return P.decode(P.encode(orders, "o_orderpriority", labels), labels, "label").drop("o_orderpriority")


QUERIES = {
    "prep_impute": _filled,
    "prep_impute_new_rows": _filled_new,
    "prep_onehot_constant": _constant,
    "prep_scale": _scaled,
    "prep_onehot": _onehot,
    "prep_matrix": _matrix,
    "prep_feature_names": _names,
    "prep_summary": _summary,
    "label_encode": _encoded,
    "label_decode": _decoded,
}

SQL = {
    "prep_impute": f"""WITH {DIRTY_SQL},
f AS (SELECT coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM dirty)) AS q,
 coalesce(l_returnflag, (SELECT l_returnflag FROM dirty WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag
                         ORDER BY count(*) DESC, l_returnflag LIMIT 1)) AS r FROM dirty)
SELECT 'numeric__l_quantity' AS name, q AS "value", count(*) AS n FROM f GROUP BY q
UNION ALL SELECT 'categorical__l_returnflag_N', CAST(r = 'N' AS INT), count(*) FROM f GROUP BY CAST(r = 'N' AS INT)
UNION ALL SELECT 'categorical__l_returnflag_R', CAST(r = 'R' AS INT), count(*) FROM f GROUP BY CAST(r = 'R' AS INT)""",
    "prep_impute_new_rows": f"""WITH {DIRTY_SQL},
f AS (SELECT coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem)) AS q,
 coalesce(l_returnflag, (SELECT l_returnflag FROM lineitem GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)) AS r FROM dirty)
SELECT 'numeric__l_quantity' AS name, q AS "value", count(*) AS n FROM f GROUP BY q
UNION ALL SELECT 'categorical__l_returnflag_N', CAST(r = 'N' AS INT), count(*) FROM f GROUP BY CAST(r = 'N' AS INT)
UNION ALL SELECT 'categorical__l_returnflag_R', CAST(r = 'R' AS INT), count(*) FROM f GROUP BY CAST(r = 'R' AS INT)""",
    "prep_onehot_constant": """WITH s AS (SELECT DISTINCT o_orderstatus AS level FROM orders WHERE o_orderstatus <> (SELECT min(o_orderstatus) FROM orders))
SELECT o_orderkey, 'numeric__o_custkey' AS name, CAST(o_custkey AS DOUBLE) AS "value" FROM orders
UNION ALL SELECT o_orderkey, 'categorical__o_orderstatus_' || level, CAST(o_orderstatus = level AS INT) FROM orders, s""",
    "prep_scale": """WITH s AS (SELECT avg(o_totalprice) AS ma, stddev_pop(o_totalprice) AS sa, avg(o_custkey) AS mb,
 stddev_pop(o_custkey) AS sb FROM orders)
SELECT o_orderkey, 'numeric__o_totalprice' AS name, round((o_totalprice - ma) / sa, 4) AS "value" FROM orders, s
UNION ALL SELECT o_orderkey, 'numeric__o_custkey', round((o_custkey - mb) / sb, 4) FROM orders, s""",
    "prep_onehot": """SELECT o_orderkey, 'categorical__o_orderstatus_' || o_orderstatus AS name FROM orders
 WHERE o_orderstatus <> (SELECT min(o_orderstatus) FROM orders)
UNION ALL SELECT o_orderkey, 'categorical__o_orderpriority_' || o_orderpriority FROM orders
 WHERE o_orderpriority <> (SELECT min(o_orderpriority) FROM orders)""",
    "prep_matrix": """WITH s AS (SELECT avg(p_partkey % 1000) AS mk, stddev_pop(p_partkey % 1000) AS sk, avg(p_size) AS ms,
 stddev_pop(p_size) AS ss FROM part), t AS (SELECT DISTINCT p_type AS name FROM part WHERE p_type <> (SELECT min(p_type) FROM part))
SELECT p_partkey, 'numeric__key_mod' AS name, round((p_partkey % 1000 - mk) / sk, 4) AS "value" FROM part, s
UNION ALL SELECT p_partkey, 'numeric__p_size', round((p_size - ms) / ss, 4) FROM part, s
UNION ALL SELECT p_partkey, 'categorical__p_type_' || t.name, CAST(p_type = t.name AS INT) FROM part, t
UNION ALL SELECT p_partkey, 'remainder__big', CAST(p_size > 25 AS INT) FROM part""",
    "prep_feature_names": """WITH d AS (SELECT lang, source FROM documents JOIN labels USING (doc_id))
SELECT 'numeric__letter_share' AS name, 'letter_share' AS source UNION ALL SELECT 'numeric__n_chars', 'n_chars'
UNION ALL SELECT DISTINCT 'categorical__lang_' || lang, 'lang' FROM d WHERE lang <> (SELECT min(lang) FROM d)
UNION ALL SELECT DISTINCT 'categorical__source_' || source, 'source' FROM d WHERE source <> (SELECT min(source) FROM d)""",
    "prep_summary": """WITH d AS (SELECT lang FROM documents JOIN labels USING (doc_id)),
n AS (SELECT 'numeric__letter_share' AS name UNION ALL SELECT 'numeric__n_chars'
 UNION ALL SELECT DISTINCT 'categorical__lang_' || lang FROM d WHERE lang <> (SELECT min(lang) FROM d))
SELECT (SELECT count(*) FROM d) AS n_rows, count(*) AS n_outputs, string_agg(name, ',' ORDER BY name) AS feature_names,
 'quality' AS target_column, FALSE AS target_encoded, 'numeric,categorical' AS steps FROM n""",
    "label_encode": """SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label FROM orders""",
    "label_decode": """SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label, o_orderpriority AS predicted_label FROM orders""",
}
