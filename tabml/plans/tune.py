"""Hyper-parameter search: every setting is scored on the same folds and the same prepared rows."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabml.operators import evaluate as E
from tabml.operators.models import build, training_facts
from tabml.operators.prep import LABEL, class_list, fit_prep
from tabml.operators.split import SEED, kfold
from tabml.plans.train import add_label, is_classification, keep, keep_balanced, labelled, main_metric, run_parallel

GRIDS = {
    "LogisticRegression": {"C": [0.1, 1.0, 10.0]},
    "RandomForestClassifier": {"n_estimators": [50, 100], "max_depth": [5, 10]},
    "RandomForestRegressor": {"n_estimators": [50, 100], "max_depth": [5, 10]},
    "DecisionTreeClassifier": {"max_depth": [3, 5, 10]},
    "DecisionTreeRegressor": {"max_depth": [3, 5, 10]},
    "KNeighborsClassifier": {"n_neighbors": [3, 5, 7, 9]},
    "KNeighborsRegressor": {"n_neighbors": [3, 5, 7, 9]},
    "GradientBoostingClassifier": {"max_depth": [3, 5], "learning_rate": [0.1, 0.3]},
    "GaussianNB": {},
    "MultinomialNB": {"alpha": [0.1, 1.0, 10.0]},
    "Ridge": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "SVC": {"C": [0.1, 1.0, 10.0]},
    "SVR": {"alpha": [0.1, 1.0, 10.0]},
    "XGBClassifier": {"max_depth": [3, 6], "learning_rate": [0.1, 0.3]},
    "XGBRegressor": {"max_depth": [3, 6], "learning_rate": [0.1, 0.3]},
}


def settings(name: str, search: str = "grid", tries: int = 5, grid: dict | None = None, seed: int = SEED) -> list[dict]:
    """All settings of the grid, or a seeded sample of them."""
    if grid is None and name not in GRIDS:
        raise ValueError(f"No grid for {name}; give one")
    grid = GRIDS[name] if grid is None else grid
    every = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    if search == "grid":
        return every
    if search == "random":
        return random.Random(seed).sample(every, min(tries, len(every)))
    raise ValueError(f"Unknown search type: {search}")


def tune(df: DataFrame, target: str, features: list[str], key: list[str], task: str, name: str,
         search: str = "grid", cv_folds: int = 5, grid: dict | None = None, tries: int = 5) -> DataFrame:
    """(setting, params, mean, std, place): fold scores of every setting, best first."""
    spark = df.sparkSession
    options = settings(name, search, tries, grid)
    folds = keep(kfold(labelled(df.select(*dict.fromkeys([*key, *features, target])), target), key, cv_folds))
    n = folds.count()
    labels = class_list(folds, target) if is_classification(task) else None
    prepared = {}

    def prepare_fold(i):
        prep = fit_prep(folds.filter(F.col("fold") != i), features, unseen="keep")
        rows = keep_balanced(add_label(prep.transform(folds), target, labels).select(*key, "features", LABEL, "fold"), n, key)
        prepared[i] = rows, training_facts(rows.filter(F.col("fold") != i), classification=is_classification(task))

    def one(item):
        i, s = item
        rows, facts = prepared[i]
        model = build(name, facts, options[s]).fit(rows.filter(F.col("fold") != i).drop("fold"))
        row = E.evaluate(model.transform(rows.filter(F.col("fold") == i)), task).first()
        return s, i, float(row[main_metric(task)])

    try:
        run_parallel(spark, list(range(cv_folds)), prepare_fold)
        scores = run_parallel(spark, list(itertools.product(range(cv_folds), range(len(options)))), one)
    finally:
        for rows, _ in prepared.values():
            rows.unpersist()
        folds.unpersist()
    table = spark.createDataFrame(scores, "setting int, fold int, score double")
    texts = spark.createDataFrame([(i, str(o)) for i, o in enumerate(options)], "setting int, params string")
    means = table.groupBy("setting").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    place = F.row_number().over(Window.orderBy(F.desc("mean"), "setting"))      # one row per setting
    return means.join(texts, "setting").select("setting", "params", "mean", "std", place.alias("place")).orderBy("place")
