"""Quality classifier: tree paths as rules, lasso logistic weights, rules as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabml.llm.common import fresh, own_columns
from tabml.llm.text_stats import once, ratio, with_stats
from tabml.session import materialize

#: labelled rows that a model is fitted on, at most (about: a hash picks them)
SAMPLE = 20_000
TREES, DEPTH, LASSO = 16, 3, 0.002

#: inputs of the rules, as ratios of the statistics
FEATURES = {
    "log_words": lambda s: F.log1p(s["n_words"].cast("double")),
    "word_length": lambda s: ratio(s["word_chars"], s["n_words"]),
    "symbols": lambda s: ratio(s["n_symbols"], s["n_words"]),
    "stop_words": lambda s: ratio(s["n_stop_words"], s["n_words"]),
    "distinct_words": lambda s: ratio(s["n_distinct_words"], s["n_words"]),
    "repeat_words": lambda s: ratio(s["n_repeat_words"], s["n_words"]),
    "dup_lines": lambda s: ratio(s["n_dup_lines"], s["n_lines"]),
    "line_words": lambda s: ratio(s["n_words"], s["n_lines"]),
    "upper": lambda s: ratio(s["n_upper"], s["word_chars"]),
    "marks": lambda s: ratio(s["n_marks"], s["n_words"]),
    "digits": lambda s: ratio(s["n_digits"], s["word_chars"]),
    "bars": lambda s: ratio(s["n_bars"], s["n_words"]),
}


def with_features(df: DataFrame, text: str, into: str) -> DataFrame:
    [stats] = fresh([*df.columns, into], "stats")
    rows = with_stats(df, text, stats)
    return rows.select(*own_columns(df), once(F.struct(*[f(F.col(stats)).alias(n) for n, f in FEATURES.items()])).alias(into))


@dataclass(frozen=True)
class PathRule:
    """A conjunction of (feature, is at most, threshold) with its weight."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def compiled(self, features: Column) -> Column:
        test = F.lit(True)
        for name, at_most, threshold in self.conditions:
            test = test & ((features[name] <= threshold) if at_most else (features[name] > threshold))
        return test


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[PathRule, ...] = field(default=())

    def score(self, features: Column) -> Column:
        """Probability of label 1 as one column expression."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.compiled(features), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(node, names: list[str], above: tuple = ()) -> list[tuple]:
    """All paths from the root of a fitted tree, one per node below it."""
    found = [above] if above else []
    if node.numDescendants() > 0:
        split = node.split()
        name, threshold = names[split.featureIndex()], split.threshold()
        found += _paths(node.leftChild(), names, (*above, (name, True, threshold)))
        found += _paths(node.rightChild(), names, (*above, (name, False, threshold)))
    return found


def _simplified(path: tuple) -> tuple:
    """Only the tightest bound per feature and side."""
    tight: dict[tuple[str, bool], float] = {}
    for name, at_most, threshold in path:
        old = tight.get((name, at_most))
        tight[name, at_most] = threshold if old is None else (min if at_most else max)(old, threshold)
    return tuple(sorted((n, s, t) for (n, s), t in tight.items()))


def sampled(docs: DataFrame, labels: DataFrame, id: str, label: str, sample: int) -> DataFrame:
    """Documents with the label of a bounded sample, chosen by the hash of their id. Labels that
    are NULL or neither 0 nor 1 are left out; a document labelled more than once has the majority's."""
    marked = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id).alias("id")).agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    marked = materialize(marked, "labels")
    share = min(1.0, sample / max(1, marked.count()))
    few = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.join(F.broadcast(few), docs["doc"] == few["id"]).drop("id", "doc")


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE,
        trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7) -> RuleEnsemble:
    """Fit on at most about ``sample`` labelled documents: a forest of shallow trees on the text
    statistics, its paths as 0/1 rules, and their weights by logistic regression with a lasso.

    Without labels the score is 0.5 everywhere; with one class only it is that class's smoothed
    share. Only statistics of the text go in.
    """
    chosen = sampled(docs.select(F.col(id).alias("doc"), F.col(text).alias("text")), labels, id, label, sample)
    rows = materialize(with_features(chosen.select("label", "text"), "text", "f").select("label", "f.*"), "rule-sample")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        return RuleEnsemble(math.log(share / (1 - share)))
    names = list(FEATURES)
    points = VectorAssembler(inputCols=names, outputCol="v").transform(rows.coalesce(4)).select(F.col("label").cast("double"), "v", *names).persist()
    forest = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(points)
    paths = sorted({_simplified(p) for tree in forest.trees for p in _paths(tree._call_java("rootNode"), names)})
    marks = [F.when(PathRule(p).compiled(F.struct(*names)), 1.0).otherwise(0.0).alias(f"r{i}") for i, p in enumerate(paths)]
    design = VectorAssembler(inputCols=[f"r{i}" for i in range(len(paths))], outputCol="x").transform(points.select("label", *marks)).select("label", "x").persist()
    line = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(design)
    points.unpersist()
    design.unpersist()
    weights = line.coefficients.toArray()
    return RuleEnsemble(float(line.intercept), tuple(PathRule(p, float(w)) for p, w in zip(paths, weights) if w != 0.0))


def score(model: RuleEnsemble, df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) per row. NULL text counts as empty; empty texts are scored by their statistics.
    NULL ids and repeated rows are scored like others. No rows: no rows."""
    rows = with_features(df.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "f")
    return rows.select("id", model.score(F.col("f")).alias("score"))


def accepted(model: RuleEnsemble, df: DataFrame, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` scored at least ``threshold``, with all their columns."""
    [f] = fresh(df.columns, "features")
    return with_features(df, text, f).where(model.score(F.col(f)) >= threshold).select(*own_columns(df))
