"""The explanation report: target, task, model, preparation, performance and importance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabml.functions.columns import categorical_columns, numeric_columns, present
from tabml.operators import importance as I
from tabml.operators.attribution import (
    BACKGROUND_ROWS, background_rows, shapley_global, shapley_linear, shapley_sampled, surrogate_local,
)
from tabml.operators.evaluate import overfit_flag
from tabml.operators.tree_paths import model_paths, shapley_trees
from tabml.plans.train import Prepared, Trained, is_classification, scores_by_split


def explain_target(target: DataFrame) -> DataFrame:
    """(item, text) from a row with target_column and confidence_score."""
    score = F.col("confidence_score").cast("double")
    # fixed values: sentences and limits of the report
    sentence = "The target column '%s' was identified with %.1f%% confidence using intelligent analysis."
    strong = "This column has strong characteristics of a target variable (binary or categorical with few classes)."
    moderate = "This column has moderate characteristics of a target variable."
    fallback = "This column was selected as a fallback option."
    reasoning = F.when(score >= 8, strong).when(score >= 4, moderate).otherwise(fallback)
    return _items(target, {"target_column": F.col("target_column"), "confidence_score": score.cast("string"),
                           "explanation": F.format_string(sentence, "target_column", score), "reasoning": reasoning})


def explain_task(task: DataFrame) -> DataFrame:
    """(item, text) from a row with task_type and task_reason."""
    # fixed values: what the tasks are
    details = {
        "binary_classification": "This is a binary classification problem where the target has exactly two classes.",
        "multiclass_classification": "This is a multiclass classification problem where the target has more than two classes.",
        "regression": "This is a regression problem where the target is a continuous numerical value.",
        "clustering": "This is a clustering problem where no target variable was identified.",
        "nlp": "This is a natural language processing task with text data.",
    }
    text = F.lit(None).cast("string")
    for name, detail in details.items():
        text = F.when(F.col("task_type") == name, detail).otherwise(text)
    sentence = F.format_string("The dataset was classified as a %s task because %s.", "task_type", "task_reason")
    return _items(task, {"task": F.col("task_type"), "reason": F.col("task_reason"), "explanation": sentence, "details": text})


def explain_model(name: str, facts: DataFrame) -> DataFrame:
    """(item, text): the model's benefits and the size of the data (n_samples, n_features, n_classes)."""
    # fixed values: benefits per model family, the first family named in the model name counts
    benefits = {
        "RandomForest": ["Handles both numerical and categorical features well", "Robust to outliers and non-linear relationships",
                         "Provides feature importance rankings", "Good for medium to large datasets"],
        "Logistic": ["Fast training and prediction", "Provides interpretable coefficients",
                     "Good baseline for classification tasks", "Works well with small datasets"],
        "XGB": ["Excellent performance on structured data", "Handles missing values automatically",
                "Provides feature importance", "Good for large datasets"],
        "Linear": ["Simple and interpretable", "Fast training and prediction", "Good baseline for regression tasks",
                   "Works well with linear relationships"],
    }
    family = next((f for f in benefits if f in name), None)
    items = {"selected_model": F.lit(name), **{f: F.col(f).cast("string") for f in ("n_samples", "n_features", "n_classes")}}
    items.update({f"benefit_{i}": F.lit(text) for i, text in enumerate(benefits.get(family, []), 1)})
    return _items(facts, items)


def explain_prep(df: DataFrame, target: str) -> DataFrame:
    """(step, method, reason) of the preparation the table calls for."""
    features = [c for c in df.columns if c != target]
    gaps = F.lit(False)
    for c in features:
        gaps = gaps | present(df, c).isNull()
    # fixed values: steps of the report
    steps = [
        ("Missing Value Imputation", "Median for numeric, Most Frequent for categorical",
         "Missing values were detected and will be handled appropriately.", F.col("gaps")),
        ("Numeric Scaling", "StandardScaler",
         "Numeric features were standardized to have zero mean and unit variance.", F.lit(bool(numeric_columns(df, (target,))))),
        ("Categorical Encoding", "OneHotEncoder",
         "Categorical features were one-hot encoded to convert them into numerical format.", F.lit(bool(categorical_columns(df, (target,))))),
    ]
    rows = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(m).alias("method"), F.lit(r).alias("reason"), on.alias("on"))
                     for s, m, r, on in steps])
    found = df.agg(F.coalesce(F.bool_or(gaps), F.lit(False)).alias("gaps"))
    return found.select(F.explode(rows).alias("r")).select("r.*").filter("on").drop("on")


def explain_performance(scores: DataFrame, task: str) -> DataFrame:
    """(item, text) from a row with train_score and test_score."""
    # fixed values: sentences of the report
    if is_classification(task):
        texts = ("Training accuracy: %.1f%%", "Test accuracy: %.1f%%")
        shown = F.col("train_score") * 100, F.col("test_score") * 100
    else:
        texts = ("Training R² score: %.4f", "Test R² score: %.4f")
        shown = F.col("train_score"), F.col("test_score")
    return _items(overfit_flag(scores), {"train_score": F.format_string(texts[0], shown[0]),
                                         "test_score": F.format_string(texts[1], shown[1]), "overfitting": F.col("overfitting")})


def _items(df: DataFrame, items: dict) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(k).alias("item"), e.cast("string").alias("text")) for k, e in items.items()])
    return df.select(F.explode(cells).alias("c")).select("c.*").filter("text IS NOT NULL")


def explain(df: DataFrame, record: DataFrame, trained: Trained, ready: Prepared) -> DataFrame:
    """(section, item, text): all of the above plus the top features, for a profiled table and a fitted model."""
    spark = df.sparkSession
    scores = scores_by_split(trained, ready)
    table = spark.createDataFrame([(scores["train"], scores["test"])], "train_score double, test_score double")
    prep = explain_prep(df, trained.target).select(F.col("step").alias("item"), F.concat_ws(": ", "method", "reason").alias("text"))
    top = I.importance(spark, trained.model, trained.prep.slots()).select(
        F.concat_ws(" ", F.lit("top"), F.col("rank").cast("string")).alias("item"),
        F.concat_ws(" ", "feature", F.format_string("%.4f", "importance")).alias("text"))
    sections = {"target_detection": explain_target(record), "task_classification": explain_task(record),
                "model_selection": explain_model(trained.name, record), "preprocessing": prep,
                "model_performance": explain_performance(table, trained.task), "feature_importance": top}
    return reduce(DataFrame.unionByName, [p.select(F.lit(s).alias("section"), "item", "text") for s, p in sections.items()])


def shap_local(trained: Trained, df: DataFrame, key: list[str], background: DataFrame, samples: int = 50, class_index: int = 0,
               background_size: int = BACKGROUND_ROWS, sampled: bool = False) -> DataFrame:
    """(key…, feature, contribution, base_value) of every row: exact for linear regression and, from the paths of the
    model, for trees, forests and boosting (prepared features; boosted classes in log-odds); sampled for the
    rest, or if ``sampled`` asks for it."""
    paths = None if sampled else model_paths(trained.model, class_index)
    if paths is not None:
        return shapley_trees(trained.prep.transform(df), key, paths, [n for n, _ in trained.prep.slots()])
    if trained.name in ("LinearRegression", "Ridge"):
        from pyspark.ml.stat import Summarizer
        mean = trained.prep.transform(background).select(Summarizer.mean(F.col("features")).alias("m")).first()["m"]
        names = [n for n, _ in trained.prep.slots()]
        return shapley_linear(trained.prep.transform(df), key, list(trained.model.coefficients), trained.model.intercept,
                              names, list(mean))
    rows = background_rows(background, key, trained.features, background_size)
    return shapley_sampled(df, key, trained.features, lambda d: trained.output(d, class_index), rows, samples)


def shap_global(trained: Trained, df: DataFrame, key: list[str], background: DataFrame, samples: int = 50,
                background_size: int = BACKGROUND_ROWS) -> DataFrame:
    """(feature, importance): mean absolute contribution; a tree model answers with its importances."""
    last = trained.model.stages[-1] if hasattr(trained.model, "stages") else trained.model
    if hasattr(last, "featureImportances"):
        return I.importance_tree(df.sparkSession, trained.model, trained.prep.slots(), top=None).select("feature", "importance")
    return shapley_global(shap_local(trained, df, key, background, samples, background_size=background_size))


def lime_local(trained: Trained, df: DataFrame, key: list[str], background: DataFrame, num_features: int = 10,
               samples: int = 200, class_index: int = 0, background_size: int = BACKGROUND_ROWS) -> DataFrame:
    """(key…, feature, weight, place, base_value): the local surrogate of every row."""
    rows = background_rows(background, key, trained.features, background_size)
    return surrogate_local(df, key, trained.features, lambda d: trained.output(d, class_index), rows, num_features, samples)
