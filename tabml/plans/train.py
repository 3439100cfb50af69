"""From a raw table to a fitted, evaluated, savable model."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabml.functions.columns import col, kind_of, present, require_columns
from tabml.operators import evaluate as E
from tabml.operators.bayes import BayesModel
from tabml.operators.boost import Boosted
from tabml.operators.forest import Forest
from tabml.operators.svm import KernelMachine
from tabml.operators.models import NearestNeighbours, build, resolve, training_facts
from tabml.operators.prep import LABEL, Prep, class_list, encode, fit_prep
from tabml.operators.split import kfold, split_random, split_stratified
from tabml.operators.target import select_model
from tabml.operators.ward import WardModel
from tabml.session import read_json, write_json

PARALLEL_FITS = 4      # independent fits submitted at once; Spark shares the executors among them


def run_parallel(spark: SparkSession, work: list, run) -> list:
    """Independent Spark jobs from a few driver threads."""
    if len(work) <= 1:
        return [run(w) for w in work]
    pool = ThreadPool(min(PARALLEL_FITS, len(work)))
    try:
        return pool.map(inheritable_thread_target(spark)(run), work)
    finally:
        pool.close()


def is_classification(task: str) -> bool:
    return task.endswith("classification")


def main_metric(task: str, silhouette_form: str = "silhouette_score") -> str:
    return {"regression": "r2_score", "clustering": silhouette_form}.get(task, "accuracy")


def measured(scored: DataFrame, task: str, by: list[str] = ()) -> DataFrame:
    """Metrics of scored rows, with the ROC AUC of a binary model that has probabilities."""
    if task == "binary_classification" and "probability" in scored.columns:
        return E.evaluate(scored.withColumn("_p", vector_to_array("probability")[1]), task, score="_p", by=by)
    return E.evaluate(scored, task, by=by)


@dataclass
class Trained:
    """A fitted preparation and model with what scoring needs to know."""

    name: str
    task: str
    target: str | None
    features: list[str]
    labels: list | None
    prep: Prep
    model: object
    params: dict

    def prepare(self, df: DataFrame) -> DataFrame:
        """Adds the feature vector, and the label (class code or number) when the target is there."""
        out = self.prep.transform(df)
        return add_label(out, self.target, self.labels) if self.target in df.columns else out

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` as class code or number."""
        return self.model.transform(self.prepare(df))

    def predict(self, df: DataFrame, probabilities: bool = True) -> DataFrame:
        """Input columns without the target, ``prediction`` in the target's own values, and a
        class → probability map where the model has probabilities."""
        inputs = [c for c in df.columns if c != self.target]
        scored = self.model.transform(self.prep.transform(df.select([col(c) for c in inputs])))
        out = [col(c) for c in inputs]
        if self.labels is None:
            out.append(F.col("prediction"))
        else:
            out.append(F.try_element_at(F.lit(self.labels), F.col("prediction").cast("int") + 1).alias("prediction"))
            if probabilities and "probability" in scored.columns:
                names = F.lit([str(x) for x in self.labels])
                out.append(F.map_from_arrays(names, vector_to_array("probability")).alias("probabilities"))
        return scored.select(*out)

    def output(self, df: DataFrame, class_index: int = 0) -> DataFrame:
        """Adds ``output``: the predicted number, or the probability of one class (its 0/1
        vote where the model has no probabilities)."""
        scored = self.model.transform(self.prep.transform(df))
        if self.labels is None:
            return scored.withColumn("output", F.col("prediction").cast("double"))
        if "probability" in scored.columns:
            return scored.withColumn("output", vector_to_array("probability")[class_index])
        return scored.withColumn("output", (F.col("prediction") == class_index).cast("double"))

    def info(self, spark: SparkSession) -> DataFrame:
        """(field, value) about the model."""
        last = self.model.stages[-1] if isinstance(self.model, PipelineModel) else self.model
        fitted = {p.name: str(v) for p, v in last.extractParamMap().items()} if hasattr(last, "extractParamMap") else {}
        if isinstance(last, BayesModel):
            fitted = {"alpha": str(last.alpha)}
        if isinstance(last, (Boosted, KernelMachine)):
            own = last.settings if isinstance(last, KernelMachine) else vars(last.settings)
            fitted = {k: str(v) for k, v in own.items()}
        fields = {"model_type": self.name, "task_type": self.task, "target_column": self.target or "",
                  "n_features": str(len(self.features)), "features": ",".join(self.features),
                  **{f"param.{k}": v for k, v in sorted({**fitted, **{k: str(v) for k, v in self.params.items()}}.items())}}
        return spark.createDataFrame(list(fields.items()), "field string, value string")

    def save(self, path: str) -> None:
        self.prep.save(f"{path}/prep")
        self.model.save(f"{path}/model")
        kind = "knn" if isinstance(self.model, NearestNeighbours) else "ward" if isinstance(self.model, WardModel) else "forest" if isinstance(self.model, Forest) else "boosted" if isinstance(self.model, Boosted) else \
            "kernel" if isinstance(self.model, KernelMachine) else "bayes" if isinstance(self.model, BayesModel) else "spark"
        write_json(f"{path}/about", [kind, self.name, self.task, self.target, self.features, self.labels, self.params])


def load_trained(spark: SparkSession, path: str) -> Trained:
    kind, name, task, target, features, labels, params = read_json(f"{path}/about")
    if kind == "knn":
        model = NearestNeighbours.load(f"{path}/model", spark)
    elif kind == "ward":
        model = WardModel.load(f"{path}/model")
    elif kind in ("forest", "boosted", "kernel", "bayes"):
        model = {"forest": Forest, "boosted": Boosted, "kernel": KernelMachine, "bayes": BayesModel}[kind].load(f"{path}/model")
    else:
        model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
    return Trained(name, task, target, features, labels, Prep.load(f"{path}/prep"), model, params)


def add_label(df: DataFrame, target: str, labels: list | None) -> DataFrame:
    if labels is None:
        return df.withColumn(LABEL, present(df, target).cast("double"))
    return encode(df, target, labels)


def labelled(df: DataFrame, target: str) -> DataFrame:
    """Rows that have a target value; a missing target is not a class."""
    return df.filter(present(df, target).isNotNull())


def split(df: DataFrame, key: list[str], target: str | None, task: str, test_size: float = 0.2) -> DataFrame:
    """Stratified for classification, plain for the rest."""
    if is_classification(task):
        return split_stratified(df, key, target, test_size)
    return split_random(df, key, test_size)


ROWS_PER_TASK = 2_000      # iterative fits on fewer rows gain nothing from another task
FEW_TASKS, MOST_ROWS_PER_TASK = 64, 200_000      # so many tasks do for a middling table, a large one has as many as it needs


def keep(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def keep_balanced(df: DataFrame, n: int, key: list[str]) -> DataFrame:
    """Persist ``n`` rows for iterative fits, dealt by their key into as many partitions as their number
    asks for: models that sample per partition are the same on any number of cores."""
    parts = max(1, min(FEW_TASKS, -(-n // ROWS_PER_TASK)), -(-n // MOST_ROWS_PER_TASK))
    return keep(df.repartition(parts, *[col(k) for k in key]).sortWithinPartitions(*[col(k) for k in key]))


@dataclass
class Prepared:
    """Prepared train and test rows (features, label, split), kept for several fits, and the raw
    rows they come from."""

    prep: Prep
    rows: DataFrame
    raw: DataFrame
    labels: list | None
    features: list[str]
    target: str | None
    task: str
    keys: list[str]

    @property
    def train(self) -> DataFrame:
        return self.rows.filter("split = 'train'")

    @property
    def test(self) -> DataFrame:
        return self.rows.filter("split = 'test'")

    def release(self) -> None:
        self.rows.unpersist()


def prepare(df: DataFrame, target: str | None, features: list[str], key: list[str], task: str, scale: bool = True) -> Prepared:
    """Split, fit the preparation on the training rows, prepare all rows once. Without a target
    (clustering) every row takes part."""
    named = [target] if target is not None else []
    require_columns(df, [*features, *named])
    known = df.select(*dict.fromkeys([*key, *features, *named]))
    known = keep(labelled(known, target) if named else known)    # several passes follow
    n = known.count()
    labels = class_list(known, target) if is_classification(task) else None
    parts = split(known, key, target, task)
    prep = fit_prep(parts.filter("split = 'train'"), features, scale, unseen="keep")
    ready = add_label(prep.transform(parts), target, labels) if named else prep.transform(parts)
    rows = keep_balanced(ready.select(*key, "features", *([LABEL] if named else []), "split"), n, key)
    rows.count()
    known.unpersist()
    return Prepared(prep, rows, parts, labels, features, target, task, key)


def fit_model(ready: Prepared, name: str, params: dict | None = None) -> Trained:
    facts = training_facts(ready.train, classification=is_classification(ready.task))
    model = build(name, facts, params).fit(ready.train)
    return Trained(name, ready.task, ready.target, ready.features, ready.labels, ready.prep, model, params or {})


def scores_by_split(trained: Trained, ready: Prepared) -> dict[str, float]:
    """Accuracy or r2 on the train and the test rows, in one pass."""
    scored = trained.model.transform(ready.rows)
    metrics = E.evaluate(scored, ready.task, by=["split"]).collect()
    return {r["split"]: r[main_metric(ready.task)] for r in metrics}


def cross_validate(df: DataFrame, target: str, features: list[str], key: list[str], task: str, name: str,
                   params: dict | None = None, k: int = 5, scale: bool = True) -> DataFrame:
    """(fold, score): the preparation and the model are fitted anew for every fold."""
    known = labelled(df.select(*dict.fromkeys([*key, *features, target])), target)
    folds = keep(kfold(known, key, k))
    n = folds.count()
    labels = class_list(folds, target) if is_classification(task) else None

    def one(i: int):
        train = folds.filter(F.col("fold") != i)
        prep = fit_prep(train, features, scale, unseen="keep")
        ready = add_label(prep.transform(folds), target, labels).select(*key, "features", LABEL, "fold")
        inner = keep_balanced(ready.filter(F.col("fold") != i).drop("fold"), n, key)
        facts = training_facts(inner, classification=is_classification(task))
        model = build(name, facts, params).fit(inner)
        row = E.evaluate(model.transform(ready.filter(F.col("fold") == i)), task).first()
        inner.unpersist()
        return i, float(row[main_metric(task)])

    try:
        rows = run_parallel(df.sparkSession, list(range(k)), one)
    finally:
        folds.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, score double")


def cv_summary(scores: DataFrame) -> DataFrame:
    """(mean, std): population standard deviation over the folds."""
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def train_model(df: DataFrame, target: str, features: list[str], key: list[str], task: str,
                name: str | None = None, params: dict | None = None, cv: int = 5) -> tuple[Trained, DataFrame]:
    """Fit the selected model and report (metric, value): train and test score, folds, row counts."""
    if name is None:
        known = df.sparkSession.createDataFrame([(task, len(class_list(df, target)) if is_classification(task) else 0)],
                                                "task_type string, n_classes bigint")
        choice = select_model(known).first()
        name, params = choice["selected_model"], choice["model_params"]
    ready = prepare(df, target, features, key, task)
    trained = fit_model(ready, name, params)
    scores = scores_by_split(trained, ready)
    sizes = {r["split"]: r["n"] for r in ready.rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    report = [("train_score", scores["train"]), ("test_score", scores["test"]),
              ("train_samples", float(sizes["train"])), ("test_samples", float(sizes["test"]))]
    spark = df.sparkSession
    table = spark.createDataFrame(report, "metric string, value double")
    if cv:
        folds = cross_validate(ready.raw.filter("split = 'train'"), target, features, key, task, name, params, cv)
        summary = cv_summary(folds)
        table = (table.unionByName(folds.select(F.format_string("cv_score_%d", F.col("fold") + 1).alias("metric"), F.col("score").alias("value")))
                 .unionByName(summary.select(F.lit("cv_mean").alias("metric"), F.col("mean").alias("value")))
                 .unionByName(summary.select(F.lit("cv_std").alias("metric"), F.col("std").alias("value"))))
    ready.release()
    return trained, table.withColumn("value", F.round("value", 4)).select(F.lit(name).alias("model"), "metric", "value")


def auto_train(df: DataFrame, target: str, features: list[str], key: list[str], task: str,
               name: str = "RandomForest") -> tuple[Trained, DataFrame]:
    """Train a named model (aliases allowed); report scores, row counts and the test metrics."""
    ready = prepare(df, target, features, key, task)
    trained = fit_model(ready, resolve(name, task))
    report = training_report(trained, ready)
    ready.release()
    return trained, report


def training_report(trained: Trained, ready: Prepared) -> DataFrame:
    """(section, metric, value): training scores and sizes, then the metrics of the test rows.

    The few rows are fetched, so the prepared rows may be released afterwards.
    """
    scored = trained.model.transform(ready.rows)
    both = E.as_long(measured(scored, ready.task, by=["split"]), ["split"])
    sizes = ready.rows.groupBy("split").agg(F.count(F.lit(1)).cast("double").alias("value"))
    parts = [
        both.filter(F.col("metric") == main_metric(ready.task)).select(
            F.lit("training").alias("section"), F.concat("split", F.lit("_score")).alias("metric"), "value"),
        sizes.select(F.lit("training").alias("section"), F.concat("split", F.lit("_samples")).alias("metric"), "value"),
        both.filter("split = 'test'").select(F.lit("evaluation").alias("section"), "metric", "value"),
    ]
    report = reduce(DataFrame.unionByName, parts).select(F.lit(trained.name).alias("model"), "section", "metric", "value")
    return ready.rows.sparkSession.createDataFrame(report.collect(), report.schema)


def evaluation_report(trained: Trained, ready: Prepared) -> DataFrame:
    """The full report (section, field, value): task, target, model, training scores, metrics of the
    test rows with their sentences, for classes the confusion matrix and class report, and settings."""
    spark = ready.rows.sparkSession
    facts = [("task_type", ready.task), ("target_column", ready.target), ("model_name", trained.name)]
    head = spark.createDataFrame(facts, "field string, value string").select(F.lit("dataset").alias("section"), "field", "value")
    body = training_report(trained, ready).select("section", F.col("metric").alias("field"), F.col("value").cast("string"))
    scored = trained.model.transform(ready.test)
    sentences = E.verdict(E.evaluate(scored, ready.task), ready.task).filter("text IS NOT NULL")
    body = body.unionByName(sentences.select(F.lit("verdict").alias("section"), F.col("metric").alias("field"), F.col("text").alias("value")))
    if is_classification(ready.task):
        names = F.lit([str(x) for x in trained.labels])
        name = lambda c: F.get(names, F.col(c).cast("int"))
        matrix = E.confusion_matrix(scored).select(F.lit("confusion_matrix").alias("section"), F.concat(
            name("label"), F.lit(" as "), name("prediction")).alias("field"), F.col("n").cast("string").alias("value"))
        classes = E.classification_report(scored.select(name("label").alias("label"), name("prediction").alias("prediction")))
        cells = F.array(*[F.struct(F.concat("name", F.lit(f" {m}")).alias("field"), F.round(m, 4).cast("string").alias("value"))
                          for m in ("precision", "recall", "f1_score", "support")])
        report = classes.select(F.lit("class_report").alias("section"), F.inline(cells))
        body = body.unionByName(matrix).unionByName(report)
    return head.unionByName(body).unionByName(trained.info(spark).select(F.lit("model").alias("section"), "field", "value"))


def infer(df: DataFrame, key: str) -> tuple[str, str, list[str]]:
    """(target, task, usable features) by the detection rules."""
    from tabml.operators.profile import metadata
    record = metadata(df, key).first()
    usable = [c for c in record["feature_columns"] if kind_of(df.schema[c].dataType) in ("numeric", "categorical", "boolean") and c != key]
    return record["target_column"], record["task_type"], usable


