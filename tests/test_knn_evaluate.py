import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.tables import rule_predictions
from tabml.operators import cluster_metrics as K
from tabml.operators import evaluate as E
from tabml.operators import knn


def brute(train, labels, queries, k):
    out = []
    for q in queries:
        d = np.sqrt(((train - q) ** 2).sum(axis=1))
        near = np.array(labels)[np.lexsort((labels, d))[:k]]
        values, votes = np.unique(near, return_counts=True)
        out.append((values[votes.argmax()], near.mean()))
    return out


@pytest.mark.parametrize("block_rows", [4000, 20])
def test_neighbours_equal_brute_force_with_a_hot_point(spark, monkeypatch, block_rows):
    """A third of the training rows are copies of one point; small blocks force pruning and splitting."""
    monkeypatch.setattr(knn, "CELL_ROWS", block_rows)
    rng = np.random.RandomState(1)
    train = rng.normal(size=(300, 2)) * 5
    train[:100] = [1.0, 1.0]
    labels = rng.randint(0, 4, 300)
    queries = np.vstack([rng.normal(size=(40, 2)) * 5, [[1.0, 1.0]] * 15])
    t = spark.createDataFrame([(x.tolist(), int(y)) for x, y in zip(train, labels)], "features array<double>, label int").repartition(5)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "id int, features array<double>")
    wanted = brute(train, labels, queries, 5)
    old = knn.neighbours.__defaults__
    knn.neighbours.__defaults__ = (*old[:-1], block_rows)
    try:
        classes = {r["id"]: r["prediction"] for r in knn.knn_classify(t, q).collect()}
        means = {r["id"]: r["prediction"] for r in knn.knn_regress(t, q).collect()}
    finally:
        knn.neighbours.__defaults__ = old
    assert len(classes) == len(means) == len(queries)
    for i, (c, m) in enumerate(wanted):
        assert classes[i] == c and abs(means[i] - m) < 1e-12


def test_fewer_rows_than_neighbours(spark):
    t = spark.createDataFrame([([0.0], 1.0), ([1.0], 3.0)], "features array<double>, label double")
    assert knn.knn_regress(t, t, 5).first()["prediction"] == 2.0


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, score double")


def test_zero_division_and_single_class(spark):
    none = scored(spark, [(1, 0, 0.5), (0, 0, 0.5), (1, 0, 0.5)])
    row = E.eval_binary(none).first()
    assert (row["precision"], row["recall"], row["f1_score"], row["pos_label"]) == (0, 0, 0, 1)
    assert E.roc_auc(none).first()["roc_auc"] == 0.5                    # all scores tied
    one = scored(spark, [(0, 0, 0.1), (0, 1, 0.9)])
    assert E.eval_binary(one).first()["pos_label"] == 1
    assert E.roc_auc(one).first()["roc_auc"] is None
    wrong = scored(spark, [(0, 1, 0.9), (1, 0, 0.1)])
    assert E.roc_auc(wrong).first()["roc_auc"] == 0.0


def test_text_labels_and_unseen_predictions(spark):
    df = spark.createDataFrame([("no", "no"), ("yes", "yes"), ("yes", "no"), ("no", "maybe")], "label string, prediction string")
    assert E.eval_binary(df).first()["pos_label"] == "yes"
    assert E.confusion_matrix(df).count() == 9
    report = {r["name"]: r for r in E.classification_report(df).collect()}
    assert report["maybe"]["support"] == 0 and report["maybe"]["recall"] == 0
    assert report["accuracy"]["precision"] == 0.5 and report["weighted avg"]["support"] == 4


def test_auc_in_many_buckets(spark, folder, monkeypatch):
    from tabml.functions import ranks
    df = rule_predictions(spark, folder).withColumn("score", F.col("score") + F.col("l_orderkey") % 97 / 1000)
    one = E.roc_auc(df).first()["roc_auc"]
    old = ranks.running_totals.__defaults__
    ranks.running_totals.__defaults__ = (*old[:-1], 100)
    try:
        assert abs(E.roc_auc(df).first()["roc_auc"] - one) < 1e-12
    finally:
        ranks.running_totals.__defaults__ = old


def test_regression_edge_cases(spark):
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    assert E.eval_regression(flat).first()["r2_score"] == 1.0
    assert E.eval_regression(flat.withColumn("prediction", F.lit(3.0))).first()["r2_score"] == 0.0


def test_unknown_task(spark):
    with pytest.raises(ValueError):
        E.evaluate(scored(spark, [(1, 1, 1.0)]), "nlp")


def silhouette(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        same = c == c[i]
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, c == o].mean() for o in set(c) - {c[i]})
        out.append((b - a) / max(a, b))
    return np.mean(out)


@pytest.mark.parametrize("block_rows", [2000, 30])
def test_silhouette_in_blocks_with_copies_and_a_singleton(spark, block_rows):
    rng = np.random.RandomState(2)
    x = rng.normal(size=(120, 3))
    x[:40] = x[0]
    c = rng.randint(0, 3, 120)
    c[5] = 3
    df = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, c)], "features array<double>, cluster int")
    assert abs(K.silhouette(df, block_rows=block_rows).first()[0] - silhouette(x, c)) < 1e-9


def test_distances_by_products_equal_differences(monkeypatch):
    """Far from the origin, with equal and nearly equal points and lost values; the cells held at once stay few."""
    dice = np.random.default_rng(3)
    a = 1e3 + dice.normal(size=(40, 64))
    b = np.concatenate([a[:10], a[10:20] + 1e-9, 1e3 + dice.normal(size=(30, 64))])
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    monkeypatch.setattr(K, "CHUNK_CELLS", 64)
    assert np.allclose(K._distances(a, b), want, rtol=1e-6, atol=0) and (K._distances(a, a).diagonal() == 0).all()
    near = K._distances(a - a.mean(axis=0), b - a.mean(axis=0))
    assert np.allclose(near, want, rtol=1e-9, atol=1e-15)
    a[0, 0] = np.nan
    assert np.isnan(K._distances(a, b)[0]).all()


def test_the_caller_chooses_the_silhouette(spark):
    from tabml.operators.evaluate import evaluate, verdict
    df = spark.range(100).select(F.array((F.col("id") % 10).cast("double")).alias("features"), (F.col("id") % 10 > 4).cast("int").alias("cluster"))
    for form in ("silhouette_score", "silhouette_squared"):
        metrics = evaluate(df, "clustering", prediction="cluster", silhouette_form=form)
        texts = {r["metric"]: r["text"] for r in verdict(metrics, "clustering").collect()}
        assert form in metrics.columns and texts["overall"] == "Good clustering" and texts[form].startswith("Silhouette score of")


@pytest.mark.parametrize("width", [1, 3, 40])
def test_cells_of_near_groups_are_those_of_all(width):
    """Grouped pivots rule out what a look at all of them rules out, and measure few of them in low dimensions."""
    rng = np.random.default_rng(5)
    centres, x = rng.normal(size=(900, width)), rng.normal(size=(2000, width))
    radii, weights, enough = rng.uniform(0, 0.02, 900), rng.integers(1, 4, 900), 5
    told = np.zeros((len(x), len(centres)), bool)
    measured = 0
    for rows, cells, d, keep in knn._near_cells(x, centres, radii, weights, enough, knn._groups(centres, radii)):
        measured += d.size
        told[np.ix_(rows, cells)] = keep
    d = knn._distances(x, centres)
    order = np.argsort(d + radii, axis=1)
    filled = np.cumsum(weights[order], axis=1) >= enough
    bound = np.take_along_axis(d + radii, order, axis=1)[np.arange(len(d)), filled.argmax(axis=1)]
    assert (told == knn._within(d - radii, bound)).all()
    assert width > 1 or measured < 0.2 * d.size


def test_bounds_of_few_and_of_too_many():
    far, weights = np.array([[3.0, 1.0, 2.0]]), np.array([1, 1, 1])
    assert knn._bound(far, weights, 2)[0] == 2 and knn._bound(far, weights, 4)[0] == np.inf
    many = np.arange(500.0)[None, ::-1].copy()
    light = np.concatenate([np.ones(10, int), np.zeros(490, int)])        # weight lies in the farthest cells only
    assert knn._bound(many, light, 3)[0] == 492


def test_silhouette_deals_points_out_once_and_writes_no_pairs_of_blocks(spark):
    """Files in several parts, clusters that end inside a chunk, more blocks than rows of shuffles could take."""
    rng = np.random.RandomState(6)
    x, c = rng.normal(size=(300, 2)), np.sort(rng.randint(0, 40, 300))
    df = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, c)], "features array<double>, cluster int").repartition(7)
    found = K.silhouette(df, block_rows=10)
    assert abs(found.first()[0] - silhouette(x, c)) < 1e-9
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CoGroup" not in plan


def test_silhouette_of_one_cluster_of_gaps_and_of_no_rows(spark):
    rows = lambda names: spark.createDataFrame([([float(i)], n) for i, n in enumerate(names)], "features array<double>, cluster double")
    assert K.silhouette(rows([1.0, 1.0, 1.0])).first()[0] is None
    assert K.silhouette(rows([])).first()[0] is None
    nan = float("nan")
    known = silhouette(np.array([[0.0], [1.0], [4.0]]), np.array([1, 1, 2]))
    assert abs(K.silhouette(rows([1.0, 1.0, None, nan, 2.0]).filter("cluster IS NOT NULL AND NOT isnan(cluster)")).first()[0] - known) < 1e-9
    assert abs(K.silhouette(rows([1.0, 1.0, None, nan, 2.0])).first()[0] - known * 3 / 5) < 1e-9
