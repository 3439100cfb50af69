"""Which column is the target, and what kind of task does it pose?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabml.functions.columns import col, kind_of, present
from tabml.operators.profile import few_distinct, text_columns

# fixed values: a column whose lower-cased name contains one of these is a feature
FEATURE_KEYWORDS = [
    "id", "name", "country", "state", "city", "zip", "address",
    "phone", "email", "date", "time", "index", "row", "sample",
]
# fixed values: models suggested per task, best first
SUGGESTED_MODELS = {
    "binary_classification": ["LogisticRegression", "RandomForestClassifier", "XGBClassifier", "SVC", "KNeighborsClassifier"],
    "multiclass_classification": ["RandomForestClassifier", "XGBClassifier", "GradientBoostingClassifier", "SVC", "KNeighborsClassifier"],
    "regression": ["LinearRegression", "RandomForestRegressor", "XGBRegressor", "SVR", "Ridge"],
    "other": ["RandomForestClassifier"],
}
MAX_CLASSES = 20       # fixed value: numeric targets up to here are classes
CLASS_RATIO = 0.1      # fixed value: distinct share below which a numeric target is classes


def target_scores(df: DataFrame) -> DataFrame:
    """(column, position, score) of every column that may be the target."""
    counts = few_distinct(df)
    rows = [(c, i, counts[c], kind_of(df.schema[c].dataType)) for i, c in enumerate(df.columns)]
    table = df.sparkSession.createDataFrame(rows, "column string, position int, distinct bigint, kind string")
    is_text = F.col("kind") == "categorical"
    many = F.col("distinct").isNull() | (F.col("distinct") > 10)
    score = (F.when(F.col("distinct") == 2, F.when(is_text, 10).otherwise(8))
             .when(F.col("distinct").between(3, 10), F.when(is_text, 6).otherwise(4))
             .when(many & (F.col("kind") == "numeric"), 2))
    named_feature = F.lower("column").rlike("|".join(FEATURE_KEYWORDS))
    return (table.filter(~named_feature).withColumn("score", score).filter("score IS NOT NULL")
            .select("column", "position", "score"))


def detect_target(df: DataFrame) -> DataFrame:
    """One row: the best scored column (first one on ties), else the last column with score 1."""
    last = df.sparkSession.createDataFrame([(df.columns[-1], len(df.columns), 1)], "column string, position int, score int")
    best = target_scores(df).unionByName(last).orderBy(F.desc("score"), "position").limit(1)
    scored = F.col("score")
    method = (F.when(scored >= 8, "binary_classification_target").when(scored >= 4, "multiclass_classification_target")
              .when(scored >= 2, "regression_target").otherwise("fallback_last_column"))
    reason = F.when(scored >= 2, F.format_string("Rule-based detection: %s scored %d", "column", "score")).otherwise(
        "No clear target identified, using last column as fallback")
    return best.select(F.col("column").alias("target_column"), method.alias("method"),
                       scored.alias("confidence_score"), reason.alias("reason"))


def classify_task(df: DataFrame, target: str, key: str | None = None) -> DataFrame:
    """One row (task_type, task_reason, n_classes): text columns, else the target's distinct values."""
    is_text = kind_of(df.schema[target].dataType) == "categorical"
    found = text_columns(df, target, key).agg(F.collect_set("column")).scalar()
    in_order = F.filter(F.lit(list(df.columns)), lambda c: F.array_contains("found", c))
    n = F.col("n_classes")
    classes = F.when(n == 2, "binary_classification").otherwise("multiclass_classification")
    by_target = classes if is_text else F.when(n <= MAX_CLASSES, classes).otherwise("regression")
    class_reason = F.format_string("categorical_target_with_%d_classes", n)
    by_reason = class_reason if is_text else F.when(n <= MAX_CLASSES, class_reason).otherwise(
        F.format_string("continuous_target_with_%d_unique_values", n))
    has_text = F.size("texts") > 0
    distinct = df.agg(F.count_distinct(present(df, target)).alias("n_classes"))
    return distinct.withColumn("found", found).withColumn("texts", in_order).select(
        F.when(has_text, "nlp").otherwise(by_target).alias("task_type"),
        F.when(has_text, F.concat(F.lit("text_columns_detected: ['"), F.array_join("texts", "', '"), F.lit("']")))
        .otherwise(by_reason).alias("task_reason"),
        "n_classes")


def class_labels(df: DataFrame, target: str) -> DataFrame:
    """(label): the distinct classes of the target in order."""
    return df.select(present(df, target).alias("label")).filter("label IS NOT NULL").distinct().orderBy("label")


def classify_task_by_ratio(df: DataFrame, target: str) -> DataFrame:
    """One row (task_type, n_classes): numeric targets with under 10 % distinct values are classes."""
    y = present(df, target)
    counted = df.agg(F.count_distinct(y).alias("n_classes"), F.count(F.lit(1)).alias("n"))
    classes = F.when(F.col("n_classes") == 2, "binary_classification").otherwise("multiclass_classification")
    if kind_of(df.schema[target].dataType) == "numeric":
        classes = F.when(F.col("n_classes") / F.col("n") < CLASS_RATIO, classes).otherwise("regression")
    return counted.select(classes.alias("task_type"), "n_classes")


def select_model(task: DataFrame) -> DataFrame:
    """Adds the model choice (selected_model, model_params) to a table with task_type and n_classes."""
    is_class, n = F.col("task_type").endswith("classification"), F.col("n_classes")
    model = (F.when(is_class & (n > 10), "RandomForestClassifier").when(is_class & (n == 2), "LogisticRegression")
             .when(is_class, "KNeighborsClassifier").when(F.col("task_type") == "regression", "RandomForestRegressor")
             .when(F.col("task_type") == "clustering", "KMeans").otherwise("RandomForestClassifier"))
    params = (F.when(F.col("selected_model") == "LogisticRegression", F.create_map(F.lit("max_iter"), F.lit(1000)))
              .when(F.col("selected_model") == "KNeighborsClassifier", F.create_map(F.lit("n_neighbors"), F.lit(5)))
              .when(F.col("selected_model") == "KMeans", F.create_map(F.lit("n_clusters"), F.lit(3)))
              .otherwise(F.expr("cast(map() as map<string,int>)")))
    return task.withColumn("selected_model", model).withColumn("model_params", params)


def suggest_models(task: DataFrame) -> DataFrame:
    """(task_type, rank, model_name): the suggestion list of every task in the input."""
    names = F.lit(SUGGESTED_MODELS["other"])
    for name, models in SUGGESTED_MODELS.items():
        names = F.when(F.col("task_type") == name, F.lit(models)).otherwise(names)
    return task.select("task_type", F.posexplode(names).alias("rank", "model_name")).withColumn("rank", F.col("rank") + 1)
