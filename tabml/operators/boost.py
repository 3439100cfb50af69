"""Gradient boosting of regression trees by histograms (Chen & Guestrin 2016; Friedman 2001).

Rows are cut into bins once and travel packed, thousands in one cell. A level of the trees of a round is one job: tasks add up gradient and
hessian per (node, feature, bin), one exchange brings the sums of a node's feature together, and
running sums give the gain of every cut. The driver holds trees and a best cut per node and feature.
Once a node's rows fit a group they are handed over: rows are grouped by node and each group grows the
rest of its tree. Gradients enter the sums as whole numbers, so trees depend neither on the number of
tasks, nor on the order of rows, nor on the level at which nodes are handed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tabml.functions.ranks import exact_quantiles
from tabml.session import read_json, shallow, write_json

MISSING = 255              # the bin of missing values, behind all others
BITS, HEADROOM = 38, 8     # bits of a single gradient, and by how much gradients may outgrow those of the start
HISTOGRAM_CELLS = 1 << 22  # nodes times features times bins of one pass, which bounds a task's memory
GROUP_CELLS = 1 << 22      # rows times features of a node that is finished in a group of its own
GROUP_SHARE = 16           # large tables are grown by jobs until nodes hold such a part of all rows, so that many groups share the rest
CHUNK_ROWS, CHUNK_CELLS = 1 << 14, 1 << 20  # rows and bins that are packed into one cell
TASK_CELLS = 1 << 20       # rows times features that a task goes through in a pass, about
KEPT_ROUNDS = 25           # rounds that each add to the margins of the one before; then margins start from the bins again


@dataclass(frozen=True)
class Settings:
    """What to fit. ``objective``: squared, logistic or softmax. ``newton``: cuts are chosen by
    gradient and hessian, else by the variance of the gradient; leaves always take the Newton step.
    ``prior``: margins start at the log-odds of the classes."""

    objective: str
    classes: int = 1
    rounds: int = 100
    depth: int = 6
    step: float = 0.3
    l2: float = 1.0
    least_gain: float = 0.0
    least_hessian: float = 1.0
    bins: int = 254
    newton: bool = True
    prior: bool = True


@dataclass
class Tree:
    """Nodes in arrays; ``feature`` -1 marks a leaf. Rows with a bin up to ``cut`` go left."""

    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    missing_left: list = field(default_factory=lambda: [False])
    left: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    cover: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool, gain: float) -> int:
        """Number of the left child; the right one is the next."""
        at = len(self.feature)
        self.feature[node], self.cut[node], self.missing_left[node], self.left[node], self.gain[node] = feature, cut, missing_left, at, gain
        for _ in range(2):
            for column, value in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, 0), (self.value, 0.0),
                                  (self.cover, 0.0), (self.gain, 0.0)):
                column.append(value)
        return at

    def graft(self, node: int, other: Tree) -> None:
        """``other`` takes the place of a leaf."""
        at = {0: node}
        for i, f in enumerate(other.feature):
            if f >= 0:
                left = self.split(at[i], f, other.cut[i], other.missing_left[i], other.gain[i])
                at[other.left[i]], at[other.left[i] + 1] = left, left + 1
        for i, own in at.items():
            if i:
                self.value[own], self.cover[own] = other.value[i], other.cover[i]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node each row of bins ends in."""
        feature, cut, side, left = (np.array(c) for c in (self.feature, self.cut, self.missing_left, self.left))
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            own = feature[at]
            if not (own >= 0).any():
                return at
            b = bins[rows, np.maximum(own, 0)]
            right = np.where(b == MISSING, ~side[at], b > cut[at])
            at = np.where(own >= 0, left[at] + right, at)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _unpacked(column, kind, width: int) -> np.ndarray:
    """(rows, width) of all cells of an Arrow column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _chunks(batches: Iterator, width: int, classes: int) -> Iterator[tuple]:
    """(bins, label, margins) of each packed cell; margins None where none are stored yet."""
    for batch in batches:
        for i in range(batch.num_rows):
            bins, label, *margins = (np.frombuffer(column[i].as_buffer(), kind) for column, kind in zip(batch.columns, (np.uint8, float, float)))
            yield bins.reshape(-1, width), label, margins[0].reshape(-1, classes) if margins else None


def binned(values: np.ndarray, edges: list) -> np.ndarray:
    """Bin of each value: how many edges lie below it; missing values have their own."""
    out = np.empty(values.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(values[:, j]), MISSING, np.searchsorted(np.array(e), values[:, j], side="left"))
    return out


def margins_of(trees: list, base: list | np.ndarray, bins: np.ndarray) -> np.ndarray:
    """(rows, classes): the base (per class, or per row and class) and the leaves of all rounds (a list of one tree per class each)."""
    base = np.array(base, float)
    out = base if base.ndim == 2 else np.tile(base, (len(bins), 1))
    for round_trees in trees:
        for k, tree in enumerate(round_trees):
            out[:, k] += tree.leaves(bins)
    return out


def gradients(objective: str, margins: np.ndarray, label: np.ndarray, newton: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, (rows, classes). Newton cuts on several classes take twice the
    second derivative of one class alone, an upper bound of the joint one."""
    if objective == "squared":
        return margins - label[:, None], np.ones_like(margins)
    if objective == "logistic":
        p = 1 / (1 + np.exp(-margins))
        return p - label[:, None], p * (1 - p)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return p - (label[:, None] == np.arange(margins.shape[1])), (2 if newton else 1) * p * (1 - p)


def _bits(n: int, largest: float) -> int:
    """Gradients are counted in units of 2^-bits: n of them fit a long."""
    return min(BITS, 62 - HEADROOM - n.bit_length()) - int(np.ceil(np.log2(largest or 1.0)))


def _edges(rows: DataFrame, width: int, bins: int) -> list:
    """Cut values per feature: exact quantiles, so that bins hold about equal rows."""
    wide = rows.select(*[F.col("values")[j].alias(f"f{j}") for j in range(width)])
    found = exact_quantiles(wide, wide.columns, [i / bins for i in range(1, bins)])
    return [sorted({float(x) for x in found[f"f{j}"] if x is not None and np.isfinite(x)}) for j in range(width)]


def _to_bins(edges: list):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        step = max(1, min(CHUNK_ROWS, CHUNK_CELLS // len(edges)))
        for batch in (b[i:i + step] for b in batches for i in range(0, b.num_rows, step)):
            bins, label = binned(_matrix(batch.column(0)), edges), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, label)], ["bins", "label"])
    return run


def _with_margins(trees: list, base: list, width: int):
    """Adds the leaves of ``trees`` to the margins, which start at the base."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for bins, label, margins in _chunks(batches, width, len(base)):
            margins = margins_of(trees, base if margins is None else margins, bins)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, label, margins)], ["bins", "label", "margins"])
    return run


def add_sums(sums: np.ndarray, slot: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
    """Adds rows to sums (g, h, n) by feature, slot and bin; rows with a negative slot are left out."""
    count, places = sums.shape[2], np.flatnonzero(slot >= 0)
    for start in range(0, len(places), 1 << 14):                # sums of so few are exact in a double
        rows = places[start:start + (1 << 14)]
        at, weights, columns = slot[rows] * (MISSING + 1), (g[rows], h[rows], None), np.ascontiguousarray(bins[rows].T)
        for j, column in enumerate(columns):
            cell = at + column
            for s, weight in enumerate(weights):
                sums[s, j] += np.bincount(cell, weight, count * (MISSING + 1)).astype(np.int64).reshape(count, -1)


def _number(units: int, bits: int) -> float:
    """A sum in units as a number of Python, which tables and files take, not one of numpy."""
    return float(np.ldexp(float(units), -bits))


def _divide(tree: Tree, node: int, cut: dict, bits: tuple[int, int], settings: Settings, first: bool) -> int | None:
    """Splits a node by its best cut; the left child, or None where no cut gains enough."""
    g, h = _number(cut["g"], bits[0]), _number(cut["h"], bits[1])
    factor = settings.step if settings.newton or settings.objective != "softmax" else settings.step * (settings.classes - 1) / settings.classes

    def settle(node, g, h, n):
        tree.value[node], tree.cover[node] = -factor * g / (h + settings.l2) if h + settings.l2 > 0 else 0.0, float(n)
    if first:
        settle(node, g, h, cut["n"])
    if cut["gain"] is None or cut["gain"] <= max(settings.least_gain, 1e-12):
        return None
    left = tree.split(node, cut["feature"], cut["cut"], cut["missing_left"], cut["gain"])
    gl, hl = _number(cut["left_g"], bits[0]), _number(cut["left_h"], bits[1])
    settle(left, gl, hl, cut["left_n"])
    settle(left + 1, g - gl, h - hl, cut["n"] - cut["left_n"])
    return left


def grown(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, bits: tuple[int, int], settings: Settings) -> Tree:
    """The tree of rows that fit a task; ``g`` and ``h`` in units."""
    tree, width, open_nodes = Tree(), bins.shape[1], [0]
    names = [c.split()[0] for c in CUTS[2:]]
    for level in range(depth):
        place = np.full(len(tree.feature), -1)
        at, found = tree.nodes(bins), []
        at_once = max(1, HISTOGRAM_CELLS // (width * (MISSING + 1)))
        for start in range(0, len(open_nodes), at_once):
            part = open_nodes[start:start + at_once]
            place[:] = -1
            place[part] = range(len(part))
            sums = np.zeros((3, width, len(part), MISSING + 1), np.int64)
            add_sums(sums, place[at], bins, g, h)
            for i, node in enumerate(part):
                cuts = [{"feature": j} | dict(zip(names, (*sums[:, j, i].sum(axis=1).tolist(), *best_cut(sums[:, j, i], bits, settings)))) for j in range(width)]
                found.append((node, max(cuts, key=lambda c: (c["gain"] or 0.0, -c["feature"]))))
        lefts = [_divide(tree, node, cut, bits, settings, not level) for node, cut in found]
        open_nodes = [i for left in lefts if left is not None for i in (left, left + 1) if tree.cover[i] > 1]
        if not open_nodes:
            break
    return tree


def _handed(growing: list, slots: dict, settings: Settings, width: int, bits: tuple[int, int]):
    """(slot, bins, g, h), packed, of the rows of the nodes that are handed over."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        places = _places(growing, slots)
        for chunk in _chunks(batches, width, settings.classes):
            bins, g, h = _derived(chunk, settings, bits)
            for k, tree in enumerate(growing):
                slot = places[k][tree.nodes(bins)]
                order = np.argsort(slot, kind="stable")[np.count_nonzero(slot < 0):]
                if len(order):
                    names, starts = np.unique(slot[order], return_index=True)
                    cells = [[x[part].tobytes() for part in np.split(order, starts[1:])] for x in (bins, g[:, k], h[:, k])]
                    yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(c, pa.binary()) for c in cells)], ["slot", "bins", "g", "h"])
    return run


def _places(growing: list, slots: dict) -> list:
    """Per class, the slot of each node of its tree or -1."""
    places = [np.full(len(t.feature), -1) for t in growing]
    for (k, node), slot in slots.items():
        places[k][node] = slot
    return places


def _derived(chunk: tuple, settings: Settings, bits: tuple[int, int]):
    """Bins, gradients and hessians of a chunk, the latter in units."""
    bins, label, margins = chunk
    g, h = gradients(settings.objective, margins, label, settings.newton)
    return bins, np.rint(np.ldexp(g, bits[0])), np.rint(np.ldexp(h, bits[1]))


def _histograms(growing: list, slots: dict, settings: Settings, width: int, bits: tuple[int, int]):
    """(slot, feature, sums): sums (g, h, n) of a task's rows per open node and bin, as bytes. ``slots``: number by (class, node)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums, places = np.zeros((3, width, len(slots), MISSING + 1), np.int64), _places(growing, slots)
        for chunk in _chunks(batches, width, settings.classes):
            bins, g, h = _derived(chunk, settings, bits)
            for k, tree in enumerate(growing):
                add_sums(sums, places[k][tree.nodes(bins)], bins, g[:, k], h[:, k])
        slot, feature = np.nonzero(sums[2].any(axis=2).T)
        cells = [sums[:, f, i].tobytes() for i, f in zip(slot, feature)]
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(feature, pa.int64()), pa.array(cells, pa.binary())], ["slot", "feature", "sums"])
    return run


def best_cut(sums: np.ndarray, bits: tuple[int, int], settings: Settings) -> tuple:
    """(gain, cut, missing_left, g, h, n of the left side) of the best cut of sums (g, h, n) per bin; gain None if
    none is allowed. Missing values go to the side where they gain more, without any to the side with
    more hessian. Of equal gains the first cut counts, with missing values on the right."""
    whole, low = sums.sum(axis=1), np.cumsum(sums[:, :MISSING], axis=1)
    left = np.stack([low, low + sums[:, MISSING:]]) if sums[2, MISSING] else low[None]
    right = whole[:, None] - left

    def parts(x):
        return np.ldexp(x[..., 0, :].astype(float), -bits[0]), np.ldexp(x[..., 1, :].astype(float), -bits[1]), x[..., 2, :].astype(float)

    def score(x):
        g, h, n = parts(x)
        weight = h + settings.l2 if settings.newton else n
        return np.divide(g * g, weight, out=np.zeros_like(g), where=weight > 0)
    allowed = ((left[:, 2] > 0) & (right[:, 2] > 0) & (parts(left)[1] >= settings.least_hessian) & (parts(right)[1] >= settings.least_hessian))
    gain = np.where(allowed, score(left) + score(right) - score(whole[:, None]), -np.inf)
    cut, side = divmod(int(np.argmax(gain.T)), len(gain))
    if gain[side, cut] == -np.inf:
        return None, 0, False, 0, 0, 0
    g, h, n = left[side, :, cut].tolist()
    return float(gain[side, cut]), cut, bool(side) if len(gain) > 1 else 2 * h >= int(whole[1]), g, h, n


def _cuts(bits: tuple[int, int], settings: Settings):
    """(slot, feature, g, h, n, ...): totals and best cut from the sums of all tasks, which come together."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            for slot, feature, cells in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(cells, np.int64).reshape(3, -1)
                held[slot, feature] = held[slot, feature] + part if (slot, feature) in held else part
        rows = [(*key, *cells.sum(axis=1).tolist(), *best_cut(cells, bits, settings)) for key, cells in held.items()]
        columns = zip(*rows) if rows else [[] for _ in CUTS]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 5 + (pa.float64(), pa.int64(), pa.bool_()) + (pa.int64(),) * 3)],
                                         [c.split()[0] for c in CUTS])
    return run


CUTS = ["slot long", "feature long", "g long", "h long", "n long", "gain double", "cut long", "missing_left boolean", "left_g long", "left_h long", "left_n long"]
CELLS_PER_TASK = 1 << 16      # sums of one level that a task brings together, about


@dataclass
class Boosted:
    """A fitted model: rounds of one tree per class on binned features."""

    settings: Settings
    base: list
    edges: list
    trees: list = field(repr=False)

    @property
    def numFeatures(self) -> int:
        return len(self.edges)

    @property
    def featureImportances(self) -> DenseVector:
        """Share of the gain per feature: of its mean gain per cut, or without hessians of its whole gain."""
        total, cuts = np.zeros(len(self.edges)), np.zeros(len(self.edges))
        for tree in (t for r in self.trees for t in r):
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[f] += g
                    cuts[f] += 1
        size = total / np.maximum(cuts, 1) if self.settings.newton else total
        return DenseVector(size / size.sum() if size.sum() > 0 else size)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, and ``probability`` for classes."""
        trees, base, edges, objective = self.trees, self.base, self.edges, self.settings.objective

        @F.pandas_udf("array<double>")
        def outputs(x):
            import pandas as pd

            m = margins_of(trees, base, binned(np.stack(x.to_numpy()).astype(float), edges)) if len(x) else np.zeros((0, len(base)))
            if objective == "logistic":
                p = 1 / (1 + np.exp(-m[:, 0]))
                m = np.stack([1 - p, p], axis=1)
            elif objective == "softmax":
                m = np.exp(m - m.max(axis=1, keepdims=True))
                m /= m.sum(axis=1, keepdims=True)
            return pd.Series(list(m))
        out = df.withColumn("_outputs", outputs(vector_to_array("features")))
        if objective == "squared":
            return out.withColumn("prediction", F.col("_outputs")[0]).drop("_outputs")
        out = out.withColumn("probability", array_to_vector("_outputs"))
        return out.withColumn("prediction", (F.array_position("_outputs", F.array_max("_outputs")) - 1).cast("double")).drop("_outputs")

    def save(self, path: str) -> None:
        write_json(path, [vars(self.settings), self.base, self.edges, [[vars(t) for t in r] for r in self.trees]])

    @classmethod
    def load(cls, path: str) -> Boosted:
        settings, base, edges, trees = read_json(path)
        return cls(Settings(**settings), base, edges, [[Tree(**t) for t in r] for r in trees])


@dataclass
class Boosting:
    """Fits ``features`` (a vector, NaN is missing) and ``label`` (a number, or a class code from 0)."""

    settings: Settings

    def _start(self, rows: DataFrame) -> tuple[int, list, float]:
        """Row count, base margins and the largest gradient at the start."""
        s = self.settings
        if s.objective == "squared":
            n, mean, low, high = rows.agg(F.count("label"), F.avg("label"), F.min("label"), F.max("label")).first()
            return n, [mean or 0.0], max(abs((low or 0.0) - (mean or 0.0)), abs((high or 0.0) - (mean or 0.0)))
        counts = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}      # a row per class
        n = sum(counts.values())
        share = [max(counts.get(k, 0) / n if n else 0.0, 1e-15) for k in range(max(s.classes, 2))]
        if s.objective == "logistic":
            share[1] = min(share[1], 1 - 1e-15)
            return n, [float(np.log(share[1] / (1 - share[1]))) if s.prior else 0.0], 1.0
        return n, [float(np.log(p)) if s.prior else 0.0 for p in share], 1.0

    def fit(self, prepared: DataFrame) -> Boosted:
        s = self.settings
        rows = prepared.select(vector_to_array("features").alias("values"), F.col("label").cast("double").alias("label")).persist(StorageLevel.MEMORY_AND_DISK)
        n, base, largest = self._start(rows)
        first = rows.first()
        edges = _edges(rows, len(first["values"]), s.bins) if first else []
        if not n or not edges:                             # nothing to cut
            rows.unpersist()
            return Boosted(s, base, edges, [])
        tasks = max(prepared.sparkSession.sparkContext.defaultParallelism, n * len(edges) // TASK_CELLS)     # a pass is short: few tasks
        bins = rows.mapInArrow(_to_bins(edges), "bins binary, label binary").coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        bins.count()
        rows.unpersist()
        model, bits = Boosted(s, base, edges, []), (_bits(n, largest), _bits(n, 1.0))
        state = None
        for turn in range(s.rounds):
            anew = turn % KEPT_ROUNDS == 0                 # from the bins, so that lineage stays bounded
            trees, before = model.trees if anew else model.trees[-1:], state
            state = shallow(bins if anew else before).mapInArrow(_with_margins(list(trees), base, len(edges)), "bins binary, label binary, margins binary")
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
            model.trees.append(self._round(state, n, len(edges), bits))
            if before is not None:
                before.unpersist()
        if state is not None:
            state.unpersist()
        bins.unpersist()
        return model

    def _round(self, state: DataFrame, n: int, width: int, bits: tuple[int, int]) -> list:
        """One tree per class: level by level while nodes are large, the rest in a group per node."""
        s = self.settings
        growing = [Tree() for _ in range(s.classes)]
        open_nodes, small, rows = [(k, 0) for k in range(s.classes)], {}, {(k, 0): n for k in range(s.classes)}
        at_once = max(1, HISTOGRAM_CELLS // (width * (MISSING + 1)))
        fits = min(GROUP_CELLS, max(GROUP_CELLS // 4, n * width // GROUP_SHARE))
        for level in range(s.depth):
            small |= {key: s.depth - level for key in open_nodes if 1 < rows[key] * width <= fits or not level and rows[key] == 1}
            open_nodes = [key for key in open_nodes if key not in small and rows[key] > 1]
            if not open_nodes:
                break
            found = []
            for start in range(0, len(open_nodes), at_once):
                slots = {key: i for i, key in enumerate(open_nodes[start:start + at_once])}
                tasks = max(1, len(slots) * width * (MISSING + 1) // CELLS_PER_TASK)
                sums = state.mapInArrow(_histograms(growing, slots, s, width, bits), "slot long, feature long, sums binary")
                cuts = sums.repartition(tasks, "slot", "feature").mapInArrow(_cuts(bits, s), ", ".join(CUTS))
                best: dict = {}
                for r in sorted(cuts.collect(), key=lambda r: r["feature"]):            # a row per node and feature
                    if r["slot"] not in best or (r["gain"] or 0.0) > (best[r["slot"]]["gain"] or 0.0):
                        best[r["slot"]] = r
                found += [(key, best[i]) for key, i in slots.items() if i in best]
            open_nodes = []
            for (k, node), cut in found:
                left = _divide(growing[k], node, cut, bits, s, not level)
                for child in (left, left + 1) if left is not None else ():
                    rows[k, child] = int(growing[k].cover[child])
                    open_nodes.append((k, child))
        self._finish(state, growing, small, width, bits)
        return growing

    def _finish(self, state: DataFrame, growing: list, small: dict, width: int, bits: tuple[int, int]) -> None:
        """Grows what is left of the trees in the nodes of ``small`` (levels left by class and node)."""
        import json

        s, keys = self.settings, list(small)
        if not keys:
            return

        def grow(table):
            import pyarrow as pa

            slot = table["slot"][0].as_py()
            bins, g, h = _unpacked(table["bins"], np.uint8, width), _unpacked(table["g"], float, 1)[:, 0], _unpacked(table["h"], float, 1)[:, 0]
            tree = grown(bins, g, h, small[keys[slot]], bits, s)
            return pa.table({"slot": [slot], "tree": [json.dumps(vars(tree))]})
        handed = state.mapInArrow(_handed(growing, {key: i for i, key in enumerate(keys)}, s, width, bits), "slot long, bins binary, g binary, h binary")
        for r in handed.groupBy("slot").applyInArrow(grow, "slot long, tree string").collect():
            k, node = keys[r["slot"]]
            part = Tree(**json.loads(r["tree"]))
            if not node:
                growing[k].value[0], growing[k].cover[0] = part.value[0], part.cover[0]
            growing[k].graft(node, part)
