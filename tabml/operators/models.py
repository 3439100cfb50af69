"""The model zoo: every name the benchmark, the factory and the suggestions know.

``build(name, facts, params)`` returns a builder with ``fit(prepared) -> model``; every
model has ``transform(prepared)`` and adds ``prediction`` (and ``probability`` where the
method has one). Approximations carry their method in ``METHODS``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabml.operators.bayes import MultinomialBayes
from tabml.operators.boost import Boosting, Settings
from tabml.operators.forest import RandomForest
from tabml.operators.knn import knn_classify, knn_regress
from tabml.operators.svm import LANDMARKS, SupportVectors
from tabml.operators.ward import WardClusters
from tabml.session import read_json, write_json

SEED = 42
FOREST_DEPTH = 10      # deeper trees than Spark's default 5; unlimited depth does not scale
MAX_BINS = 64
TREE_MEMORY_MB = 1024  # node statistics per pass: more nodes split in one scan of the rows

# fixed values: zoo per task, in leaderboard order
BENCHMARK_MODELS = {
    "classification": ["LogisticRegression", "RandomForestClassifier", "KNeighborsClassifier", "DecisionTreeClassifier",
                       "GaussianNB", "SVC"],
    "regression": ["LinearRegression", "RandomForestRegressor", "Ridge", "SVR", "DecisionTreeRegressor", "KNeighborsRegressor"],
    "clustering": ["KMeans", "AgglomerativeClustering"],
}
# fixed values: short names per task
ALIASES = {
    "binary_classification": {"RandomForest": "RandomForestClassifier", "XGB": "XGBClassifier", "KNN": "KNeighborsClassifier"},
    "multiclass_classification": {"RandomForest": "RandomForestClassifier", "XGB": "XGBClassifier", "KNN": "KNeighborsClassifier"},
    "regression": {"RandomForest": "RandomForestRegressor", "XGB": "XGBRegressor"},
}
# fixed values: names a task accepts by itself
TASK_MODELS = {
    "binary_classification": ["LogisticRegression", "RandomForestClassifier", "XGBClassifier", "SVC", "KNeighborsClassifier"],
    "multiclass_classification": ["RandomForestClassifier", "XGBClassifier", "GradientBoostingClassifier", "SVC", "KNeighborsClassifier"],
    "regression": ["LinearRegression", "RandomForestRegressor", "XGBRegressor", "SVR", "Ridge"],
}
# fixed values: what an unknown name becomes
FALLBACK = {"binary_classification": "LogisticRegression", "multiclass_classification": "RandomForestClassifier",
            "regression": "RandomForestRegressor"}
METHODS = {
    "SVC": "RBF kernel on landmarks, hinge loss", "SVR": "RBF kernel on landmarks, tube loss",
    "XGBClassifier": "second-order boosting on histograms", "XGBRegressor": "second-order boosting on histograms",
    "GradientBoostingClassifier": "boosting on histograms, classes jointly",
    "AgglomerativeClustering": "k-means micro-clusters + Ward merge",
    "KNeighborsClassifier": "exact neighbours", "KNeighborsRegressor": "exact neighbours",
}


@dataclass
class Facts:
    """What a builder must know about the prepared training rows."""

    n: int
    label_std: float = 1.0
    n_classes: int = 2


def training_facts(prepared: DataFrame, label: str = "label", classification: bool = True) -> Facts:
    row = prepared.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("std"), F.max(label).alias("top")).first()
    return Facts(row["n"], row["std"] or 1.0, int(row["top"]) + 1 if classification and row["top"] is not None else 2)


@dataclass
class NearestNeighbours:
    """k-NN as a fit/transform pair; the model is the training table itself."""

    regression: bool = False
    k: int = 5
    train: DataFrame | None = field(default=None, repr=False)

    def fit(self, prepared: DataFrame) -> NearestNeighbours:
        return NearestNeighbours(self.regression, self.k, prepared.select("features", "label"))

    def transform(self, prepared: DataFrame) -> DataFrame:
        run = knn_regress if self.regression else knn_classify
        return run(self.train, prepared, self.k)

    def save(self, path: str) -> None:
        self.train.write.parquet(f"{path}/rows")
        write_json(f"{path}/settings", [self.regression, self.k])

    @classmethod
    def load(cls, path: str, spark) -> NearestNeighbours:
        return cls(*read_json(f"{path}/settings"), spark.read.parquet(f"{path}/rows"))


def _logistic(facts, p):
    return C.LogisticRegression(regParam=1.0 / (p.get("C", 1.0) * facts.n), elasticNetParam=0.0, standardization=False,
                                maxIter=p.get("max_iter", 1000), tol=p.get("tol", 1e-6))


def _ridge(facts, p):
    return R.LinearRegression(regParam=p.get("alpha", 1.0) * facts.label_std / facts.n, elasticNetParam=0.0,
                              standardization=False, solver="normal")


def _forest(cls, p, strategy):
    return cls(numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", FOREST_DEPTH), maxBins=MAX_BINS,
               featureSubsetStrategy=strategy, cacheNodeIds=True, maxMemoryInMB=TREE_MEMORY_MB, seed=SEED)


def _tree(cls, p):
    return cls(maxDepth=p.get("max_depth", FOREST_DEPTH), maxBins=MAX_BINS, cacheNodeIds=True, maxMemoryInMB=TREE_MEMORY_MB, seed=SEED)


def _newton(objective, classes, p):
    """Cuts by gradient and hessian with a penalty on leaves."""
    return Boosting(Settings(
        objective, classes, p.get("n_estimators", 100), p.get("max_depth", 6), p.get("learning_rate", 0.3), p.get("reg_lambda", 1.0),
        p.get("gamma", 0.0), p.get("min_child_weight", 1.0), min(p.get("max_bin", 254), 254), prior=objective != "softmax"))


def _friedman(objective, classes, p):
    """Cuts by the variance of the gradient, leaves without a penalty."""
    return Boosting(Settings(objective, classes, p.get("n_estimators", 100), p.get("max_depth", 3), p.get("learning_rate", 0.1), l2=0.0,
                             least_hessian=0.0, newton=False))


def _of_classes(kind, facts, p):
    return kind("softmax", facts.n_classes, p) if facts.n_classes > 2 else kind("logistic", 1, p)


BUILDERS = {
    "LogisticRegression": _logistic,
    "RandomForestClassifier": lambda f, p: _forest(C.RandomForestClassifier, p, "sqrt"),
    "DecisionTreeClassifier": lambda f, p: _tree(C.DecisionTreeClassifier, p),
    "GradientBoostingClassifier": lambda f, p: _of_classes(_friedman, f, p),
    "XGBClassifier": lambda f, p: _of_classes(_newton, f, p),
    "SVC": lambda f, p: SupportVectors("class", f.n_classes, p.get("C", 1.0), landmarks=p.get("landmarks", LANDMARKS)),
    "KNeighborsClassifier": lambda f, p: NearestNeighbours(False, p.get("n_neighbors", 5)),
    "GaussianNB": lambda f, p: C.NaiveBayes(modelType="gaussian"),
    "MultinomialNB": lambda f, p: MultinomialBayes(p.get("alpha", 1.0)),
    "LinearRegression": lambda f, p: R.LinearRegression(regParam=0.0, solver="normal"),
    "Ridge": _ridge,
    "RandomForestRegressor": lambda f, p: RandomForest(p.get("n_estimators", 100), p.get("max_depth", FOREST_DEPTH), MAX_BINS),
    "DecisionTreeRegressor": lambda f, p: _tree(R.DecisionTreeRegressor, p),
    "XGBRegressor": lambda f, p: _newton("squared", 1, p),
    "SVR": lambda f, p: SupportVectors("number", 1, p.get("C", 1.0), p.get("epsilon", 0.1), p.get("landmarks", LANDMARKS)),
    "KNeighborsRegressor": lambda f, p: NearestNeighbours(True, p.get("n_neighbors", 5)),
    "KMeans": lambda f, p: K.KMeans(k=p.get("n_clusters", 3), seed=SEED),
    "AgglomerativeClustering": lambda f, p: WardClusters(k=p.get("n_clusters", 3), seed=SEED),
}


def resolve(name: str, task: str) -> str:
    """The zoo name behind a user's name for a task; unknown names become the task's fallback."""
    if task not in TASK_MODELS:
        raise ValueError(f"Model '{name}' not supported for task type '{task}'")
    name = ALIASES[task].get(name.strip(), name.strip())
    return name if name in TASK_MODELS[task] else FALLBACK[task]


def build(name: str, facts: Facts, params: dict | None = None):
    """Builder by zoo name; an unknown name is a random forest classifier."""
    return BUILDERS.get(name, BUILDERS["RandomForestClassifier"])(facts, params or {})
