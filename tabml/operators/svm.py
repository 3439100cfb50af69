"""Support vector machines with an RBF kernel on landmarks (Williams & Seeger 2001; Chapelle 2007).

Landmarks are drawn by a hash of the features. The kernel between them is whitened, so that a linear machine
on a row's kernel values to the landmarks is the kernel machine of the landmarks' span: with as many
landmarks as distinct rows it is the exact one. The loss (hinge, or beyond a tube around the number) is
smoothed at its corner, ever less, and minimised by Newton steps: in one pass tasks add up gradient and
curvature and an exchange sums them by blocks, so the driver sees one matrix; a second pass tries
several lengths of the step. Equal rows are merged with their number and travel packed. Kernel values are
whitened only for rows that curve the loss: elsewhere the few weights are carried over to plain kernel values.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tabml.operators.kernel import scaled_gamma
from tabml.session import read_json, write_json

LANDMARKS = 512            # grows the accuracy with its cube in time on the driver; told by the model's settings
BLOCK = 64                 # rows of the curvature that travel together
CHUNK_ROWS, CHUNK_CELLS = 1 << 12, 1 << 19      # rows and numbers that are packed into one cell
ROWS_PER_TASK, FEW_TASKS, MOST_ROWS_PER_TASK = 1 << 14, 64, 200_000      # a task sends a matrix: few do for a middling table
SMOOTH = (3, 0.3, 0.03, 0.003, 0.001)      # width of the smoothed corner, in units of the loss's scale
STEPS = 40                 # Newton steps per width at most
LENGTHS = (1, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.005, 0.001)      # lengths of a step that are tried at once
RIDGE = 1e-10              # directions of the landmarks' kernel below this share of the largest are left out


def kernel_values(x: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """Kernel values of rows to landmarks."""
    out = x @ (-2 * landmarks.T)
    out += (x ** 2).sum(axis=1)[:, None]
    out += (landmarks ** 2).sum(axis=1)
    np.maximum(out, 0, out=out)
    out *= -gamma
    return np.exp(out, out=out)


def outputs(kernel: np.ndarray, whiten: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A column per row of ``weights`` (of whitened kernel values and a constant): the weights are carried over to
    the plain kernel values, so rows are not whitened."""
    return kernel @ (whiten @ weights[:, :-1].T) + weights[:, -1]


def _cells(batches: Iterator) -> Iterator:
    """(x, y, times): merged rows, thousands in one cell."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        y, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        rows = max(1, min(CHUNK_ROWS, CHUNK_CELLS // max(1, x.shape[1])))
        parts = [slice(i, i + rows) for i in range(0, len(y), rows)]
        cells = [[np.ascontiguousarray(c[part], "<f8").tobytes() for part in parts] for c in (x, y, times)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cells], ["x", "y", "times"])


def _unpacked(batches: Iterator) -> Iterator:
    """(x, y, times) of the cells, one after the other."""
    for batch in batches:
        for x, y, times in zip(*batch.columns):
            y = np.frombuffer(y.as_buffer())
            yield np.frombuffer(x.as_buffer()).reshape(len(y), -1), y, np.frombuffer(times.as_buffer())


@contextmanager
def packed(prepared: DataFrame, n: int):
    """``n`` rows of features and label for many passes: equal ones once with their number, so copies cost nothing."""
    parts = max(1, min(FEW_TASKS, -(-n // ROWS_PER_TASK)), -(-n // MOST_ROWS_PER_TASK))
    merged = prepared.select("features", F.col("label").cast("double").alias("y")).groupBy("features", "y").agg(F.count("*").cast("double").alias("times"))
    dealt = merged.repartition(parts, "features", "y").select(vector_to_array("features").alias("x"), "y", "times")
    rows = dealt.mapInArrow(_cells, "x binary, y binary, times binary").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def whitening(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    square = (landmarks ** 2).sum(axis=1)
    kernel = np.exp(-gamma * np.maximum(square[:, None] + square - 2 * landmarks @ landmarks.T, 0))
    values, vectors = np.linalg.eigh(kernel)
    own = values > RIDGE * values.max()
    return vectors[:, own] / np.sqrt(values[own])


def losses(kind: str, f: np.ndarray, y: np.ndarray, tube: float, width: float) -> tuple:
    """(loss, first, second derivative) in ``f``, with a parabola of ``width`` in place of the corner."""
    if kind == "number":
        sign, beyond = np.sign(f - y), np.abs(f - y) - tube
    else:
        sign, beyond = -y, 1 - y * f
    loss = np.where(beyond >= width, beyond - width / 2, np.maximum(beyond, 0) ** 2 / (2 * width))
    return loss, sign * np.clip(beyond / width, 0, 1), ((beyond > 0) & (beyond < width)) / width


def targets(kind: str, label: np.ndarray, columns: int) -> np.ndarray:
    """One column of numbers, of -1 and 1 for two classes, or one per class against the rest."""
    if kind == "number":
        return label[:, None]
    if columns == 1:
        return np.where(label[:, None] == 1, 1.0, -1.0)
    return np.where(label[:, None] == np.arange(columns), 1.0, -1.0)


@dataclass
class KernelMachine:
    """A fitted machine; ``settings`` tell landmarks, penalty, tube and kernel width."""

    kind: str
    gamma: float
    landmarks: list = field(repr=False)
    weights: list = field(repr=False)
    settings: dict

    def outputs(self, x: np.ndarray) -> np.ndarray:
        landmarks = np.array(self.landmarks)
        return outputs(kernel_values(x, landmarks, self.gamma), whitening(landmarks, self.gamma), np.array(self.weights))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``."""
        kind, gamma, landmarks, weights = self.kind, self.gamma, np.array(self.landmarks), np.array(self.weights)
        whiten = whitening(landmarks, gamma)

        @F.pandas_udf("double")
        def predicted(x):
            import pandas as pd

            if not len(x):
                return pd.Series([], dtype=float)
            out = outputs(kernel_values(np.stack(x.to_numpy()), landmarks, gamma), whiten, weights)
            if kind == "number":
                return pd.Series(out[:, 0])
            return pd.Series((out[:, 0] > 0).astype(float) if out.shape[1] == 1 else out.argmax(axis=1).astype(float))
        return df.withColumn("prediction", predicted(vector_to_array("features")))

    def save(self, path: str) -> None:
        write_json(path, [self.kind, self.gamma, self.landmarks, self.weights, self.settings])

    @classmethod
    def load(cls, path: str) -> KernelMachine:
        return cls(*read_json(path))


@dataclass
class SupportVectors:
    """Fits ``features`` and ``label``: half the squared weight plus ``penalty`` times the losses."""

    kind: str
    classes: int = 2
    penalty: float = 1.0
    tube: float = 0.1
    landmarks: int = LANDMARKS

    def fit(self, prepared: DataFrame) -> KernelMachine:
        gamma, _ = scaled_gamma(prepared)
        rows = prepared.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
        drawn = rows.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(self.landmarks).collect()      # landmarks x width numbers
        landmarks = np.array([r["x"] for r in drawn], float)
        whiten = whitening(landmarks, gamma)
        columns = 1 if self.kind == "number" or self.classes <= 2 else self.classes
        mean, spread, n = rows.agg(F.avg("y"), F.stddev_pop("y"), F.count("*")).first()
        scale, weights = 1.0, np.zeros((columns, whiten.shape[1] + 1))
        if self.kind == "number":                      # from the mean, where the curvature is not zero everywhere
            scale, weights[0, -1] = spread or 1.0, mean
        with packed(prepared, n) as cells:
            for width in SMOOTH:
                weights = self._descend(cells, landmarks, gamma, whiten, weights, width * scale)
        settings = {"landmarks": len(landmarks), "directions": whiten.shape[1], "penalty": self.penalty, "tube": self.tube, "gamma": gamma}
        return KernelMachine(self.kind, gamma, landmarks.tolist(), weights.tolist(), settings)

    def _descend(self, rows: DataFrame, landmarks, gamma, whiten, weights, width: float):
        """Newton steps until no length of one lowers the loss of any column."""
        for _ in range(STEPS):
            loss, slope, curve = self._sums(rows, landmarks, gamma, whiten, weights, width)
            value = loss * self.penalty + (weights[:, :-1] ** 2).sum(axis=1) / 2
            plain, step = np.append(np.ones(weights.shape[1] - 1), 1e-9), np.zeros_like(weights)
            for k, w in enumerate(weights):
                step[k] = -np.linalg.solve(self.penalty * curve[k] + np.diag(plain), self.penalty * slope[k] + np.append(w[:-1], 0.0))
            tried = self._tried(rows, landmarks, gamma, whiten, weights, step, width) * self.penalty
            tried += np.array([[((w + t * d)[:-1] ** 2).sum() / 2 for t in LENGTHS] for w, d in zip(weights, step)])
            best = tried.argmin(axis=1)
            lower = tried[np.arange(len(weights)), best] < value * (1 - 1e-7)
            weights = weights + np.where(lower, np.array(LENGTHS)[best], 0.0)[:, None] * step
            if not lower.any():
                break
        return weights

    def _tried(self, rows: DataFrame, landmarks, gamma, whiten, weights, step, width: float):
        """Losses per column and length of the step."""
        kind, tube, columns = self.kind, self.tube, len(weights)

        def partial(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros((columns, len(LENGTHS)))
            for x, label, times in _unpacked(batches):
                both = outputs(kernel_values(x, landmarks, gamma), whiten, np.vstack([weights, step]))
                y, f, d = targets(kind, label, columns), both[:, :columns], both[:, columns:]
                for j, t in enumerate(LENGTHS):
                    total[:, j] += times @ losses(kind, f + t * d, y, tube, width)[0]
            k, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(j), pa.array(total.ravel())], ["k", "j", "loss"])
        found = rows.mapInArrow(partial, "k long, j long, loss double").groupBy("k", "j").agg(F.sum("loss").alias("loss")).collect()
        out = np.zeros((columns, len(LENGTHS)))
        for r in found:
            out[r["k"], r["j"]] = r["loss"]
        return out

    def _sums(self, rows: DataFrame, landmarks, gamma, whiten, weights, width: float):
        """Loss, slope and curvature per column, over all rows."""
        kind, tube, columns, size = self.kind, self.tube, len(weights), weights.shape[1]

        def partial(batches: Iterator) -> Iterator:
            import pyarrow as pa

            loss, slope, curve = np.zeros(columns), np.zeros((columns, size)), np.zeros((columns, size, size))
            for x, label, times in _unpacked(batches):
                kernel = kernel_values(x, landmarks, gamma)
                y, f = targets(kind, label, columns), outputs(kernel, whiten, weights)
                for k in range(columns):
                    value, first, second = losses(kind, f[:, k], y[:, k], tube, width)
                    own, first, root = second > 0, first * times, np.sqrt(second * times)
                    loss[k] += times @ value
                    slope[k] += np.append((first @ kernel) @ whiten, first.sum())
                    z = np.hstack([kernel[own] @ whiten, np.ones((own.sum(), 1))]) * root[own, None]
                    curve[k] += z.T @ z
            cells = [(k, -1, np.append(loss[k], slope[k]).tobytes()) for k in range(columns)]
            cells += [(k, b, curve[k, b:b + BLOCK].tobytes()) for k in range(columns) for b in range(0, size, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cells)], ["k", "block", "sums"])

        def whole(batches: Iterator) -> Iterator:
            import pyarrow as pa

            held: dict = {}
            for batch in batches:
                for k, block, cells in zip(*(c.to_pylist() for c in batch.columns)):
                    part = np.frombuffer(cells)
                    held[k, block] = held[k, block] + part if (k, block) in held else part
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*((*key, v.tobytes()) for key, v in held.items()))], ["k", "block", "sums"])
        schema = "k long, block long, sums binary"
        tasks = max(1, columns * size // (4 * BLOCK))
        found = rows.mapInArrow(partial, schema).repartition(tasks, "k", "block").mapInArrow(whole, schema).collect()      # size x size numbers a column
        loss, slope, curve = np.zeros(columns), np.zeros((columns, size)), np.zeros((columns, size, size))
        for r in found:
            part = np.frombuffer(r["sums"])
            if r["block"] < 0:
                loss[r["k"]], slope[r["k"]] = part[0], part[1:]
            else:
                curve[r["k"], r["block"]:r["block"] + BLOCK] = part.reshape(-1, size)
        return loss, slope, curve
