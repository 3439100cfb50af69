"""Feature preparation as one fitted ``PipelineModel``.

Numeric block: median fill, then population standardisation. Categorical block: most-frequent fill, then one-hot without the first
category. Booleans pass through. All statistics are aggregates; the fitted stages are
plain Spark stages, so the model saves, loads and scores batch and streaming alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabml.functions.columns import (
    categorical_columns, col, columns_of_kind, numeric_columns, present, require_columns,
)
from tabml.operators.clean import medians, modes
from tabml.session import read_json, write_json

FEATURES = "features"
LABEL = "label"
FEW_LABELS = 100         # up to here a row looks its class up in a list, beyond in a joined table


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scale_statistics(df: DataFrame, columns: list[str], fill: dict[str, float]) -> dict[str, tuple[float, float]]:
    """{column: (mean, population std)} of the filled columns."""
    if not columns:
        return {}
    aggregates = []
    for i, c in enumerate(columns):
        x = present(df, c).cast("double")
        x = F.coalesce(x, F.lit(fill[c])) if c in fill else x
        aggregates += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggregates).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def fill_values(df: DataFrame, features: list[str]) -> tuple[dict[str, float], dict[str, str]]:
    """Medians and modes of all feature columns, also of those without gaps: rows that come later
    may have some. Columns without any value have none."""
    part = df.select([col(f) for f in features])
    found = medians(part, numeric_columns(part)), modes(part, categorical_columns(part))
    return tuple({c: v for c, v in values.items() if v is not None} for values in found)


@dataclass
class Prep:
    """A fitted preparation: the pipeline and the source columns of its blocks."""

    model: PipelineModel
    numeric: list[str]
    categorical: list[str]
    passthrough: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        require_columns(df, [*self.numeric, *self.categorical, *self.passthrough])
        return self.model.transform(df)

    @property
    def steps(self) -> list[str]:
        blocks = {"numeric": self.numeric, "categorical": self.categorical, "remainder": self.passthrough}
        return [name for name, block in blocks.items() if block]

    def slots(self) -> list[tuple[str, str]]:
        """(output name, source column) per slot of the feature vector."""
        slots = [(f"numeric__{c}", c) for c in self.numeric]
        indexer = next((s for s in self.model.stages if isinstance(s, StringIndexerModel)), None)
        for i, c in enumerate(self.categorical):
            slots += [(f"categorical__{c}_{level}", c) for level in list(indexer.labelsArray[i])[:-1]]
        return slots + [(f"remainder__{c}", c) for c in self.passthrough]

    def save(self, path: str) -> None:
        self.model.save(f"{path}/pipeline")
        write_json(f"{path}/columns", [self.numeric, self.categorical, self.passthrough])

    @classmethod
    def load(cls, path: str) -> Prep:
        return cls(PipelineModel.load(f"{path}/pipeline"), *read_json(f"{path}/columns"))


def fit_prep(train: DataFrame, features: list[str], scale: bool = True, unseen: str = "error") -> Prep:
    """Fit the preparation on the training rows; the output vector column is ``features``.

    ``unseen='keep'`` gives categories that training never saw an all-zero block, like the
    first category, instead of an error.
    """
    require_columns(train, features)
    part = train.select([col(f) for f in features])
    numeric, strings = numeric_columns(part), categorical_columns(part)
    flags = columns_of_kind(part, "boolean")
    if not numeric and not strings and not flags:
        raise ValueError("No features to preprocess")
    fill, common = fill_values(part, features)
    statistics = scale_statistics(part, numeric, fill) if scale else {}

    outputs = []
    for i, c in enumerate(numeric):
        x = f"nanvl(CAST({_quote(c)} AS DOUBLE), CAST(NULL AS DOUBLE))"
        x = f"coalesce({x}, CAST({fill[c]!r} AS DOUBLE))" if c in fill else x
        if scale:
            mean, std = statistics[c]
            if mean is None:
                raise ValueError(f"Column '{c}' holds no values")
            x = f"({x} - CAST({mean!r} AS DOUBLE)) / CAST({std or 1.0!r} AS DOUBLE)"
        outputs.append(f"{x} AS _num_{i}")
    for i, c in enumerate(strings):
        outputs.append(f"coalesce({_quote(c)}, {_text(common[c])}) AS _cat_{i}" if c in common else f"{_quote(c)} AS _cat_{i}")
    outputs += [f"CAST({_quote(c)} AS DOUBLE) AS _flag_{i}" for i, c in enumerate(flags)]

    numbers = [f"_num_{i}" for i in range(len(numeric))]
    raw, codes, hots = ([f"_{kind}_{i}" for i in range(len(strings))] for kind in ("cat", "code", "hot"))
    passed = [f"_flag_{i}" for i in range(len(flags))]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(outputs)} FROM __THIS__")]
    helpers = [*numbers, *raw, *codes, *hots, *passed]
    if strings:
        # codes run from the last category down, so dropping the last code drops the first category
        indexer = StringIndexer(inputCols=raw, outputCols=codes, stringOrderType="alphabetDesc", handleInvalid=unseen)
        stages = list(Pipeline(stages=[*stages, indexer]).fit(train).stages)
        several = [i for i, levels in enumerate(stages[-1].labelsArray) if len(levels) > 1]     # one level, no slot
        if unseen == "keep":
            kept = [f"_kept_{i}" for i in range(len(strings))]
            last = [len(levels) - 1.0 for levels in stages[-1].labelsArray]
            moved = ", ".join(f"least({c}, CAST({n} AS DOUBLE)) AS {k}" for c, n, k in zip(codes, last, kept))
            stages.append(SQLTransformer(statement=f"SELECT *, {moved} FROM __THIS__"))
            codes = kept
            helpers += kept
        codes, hots = [codes[i] for i in several], [hots[i] for i in several]
        if hots:
            stages.append(OneHotEncoder(inputCols=codes, outputCols=hots, dropLast=True))
    helpers = [h for h in helpers if not h.startswith("_hot_") or h in hots]
    stages += [VectorAssembler(inputCols=[*numbers, *hots, *passed], outputCol=FEATURES),
               SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(helpers)}) FROM __THIS__")]
    return Prep(Pipeline(stages=stages).fit(train), numeric, strings, flags)


def feature_names(df: DataFrame, prep: Prep) -> DataFrame:
    """(slot, name, source)."""
    rows = [(i, name, source) for i, (name, source) in enumerate(prep.slots())]
    return df.sparkSession.createDataFrame(rows, "slot int, name string, source string")


def prep_summary(df: DataFrame, prep: Prep, target: str) -> DataFrame:
    """One row: shape of the prepared matrix, names, whether the target was encoded, steps."""
    names = [n for n, _ in prep.slots()]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(names)).alias("n_outputs"), F.lit(names).alias("feature_names"), F.lit(target).alias("target_column"),
        F.lit(target in categorical_columns(df)).alias("target_encoded"), F.lit(prep.steps).alias("steps"))


def matrix_cells(prepared: DataFrame, prep: Prep, key: str) -> DataFrame:
    """(key, name, value): the prepared matrix in long form."""
    names = F.lit([n for n, _ in prep.slots()])
    return prepared.select(key, F.posexplode(vector_to_array(FEATURES)).alias("slot", "value")).select(
        key, F.try_element_at(names, F.col("slot") + 1).alias("name"), "value")


def class_list(df: DataFrame, target: str) -> list:
    """The distinct non-missing classes in their own order; they become part of the model."""
    return sorted(r["c"] for r in df.select(present(df, target).alias("c")).filter("c IS NOT NULL").distinct().collect())


def encode(df: DataFrame, target: str, labels: list, output: str = LABEL) -> DataFrame:
    """Class codes 0..k-1 by position in ``labels``; rows of unknown class get NULL."""
    if not labels:
        return df.withColumn(output, F.lit(None).cast("double"))
    known = F.lit(labels).cast(T.ArrayType(df.schema[target].dataType))
    if len(labels) <= FEW_LABELS:
        place = F.array_position(known, col(target))
        return df.withColumn(output, F.when(place > 0, place - 1).cast("double"))
    codes = df.sparkSession.range(1).select(F.posexplode(known).alias("_code", "_label"))
    joined = df.join(codes, col(target) == F.col("_label"), "left")
    return joined.withColumn(output, F.col("_code").cast("double")).drop("_code", "_label")


def decode(df: DataFrame, labels: list, prediction: str = "prediction", output: str = "predicted_label") -> DataFrame:
    """Class codes back to class values; no code, no value (plain element_at would return one)."""
    return df.withColumn(output, F.try_element_at(F.lit(labels), col(prediction).cast("int") + 1))
