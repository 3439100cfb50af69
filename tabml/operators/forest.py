"""Forests of regression trees on bootstrap samples (Breiman 2001), by histograms of sparse bins.

Of a row only the bins that are not the usual one of their feature are kept, so a one-hot block costs one cell whatever
its width; rows with equal bins and label are one with a count. How often a tree draws a row follows from a hash of the row and
the tree, so neither draws nor nodes are stored: a pass finds both anew. A level of all trees is a few jobs: tasks add up
weights and labels per (node, cell), the sums of a tree come together, and running sums give the best cut of each node. Labels enter the
sums as whole numbers, so trees depend neither on the number of tasks nor on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import lgamma, log

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tabml.operators.boost import CELLS_PER_TASK, MISSING, Boosted, Settings, Tree, _matrix, binned

BITS = 50                  # the labels of all rows, in units, add up to less than 2^53: sums are exact in a double
EDGE_ROWS = 10_000         # rows, about, whose values place the cuts that are tried, as in Spark's own forest; all rows are trained on
PASS_CELLS = 1 << 23       # nodes times bins of one pass, which bounds a task's memory
ITEM_CELLS = 1 << 20       # of the nodes whose sums come together in one group
CHUNK_ROWS, CHUNK_CELLS = 1 << 16, 1 << 24    # rows, and rows times features, that are packed into one cell
ROWS_PER_TASK = 1 << 19    # packed rows that a task goes through in a pass, at most about


@dataclass
class Forest(Boosted):
    """A fitted forest: leaves hold their share of the mean of all trees."""

    @property
    def featureImportances(self) -> DenseVector:
        """Gains by feature as shares of their tree, then of all trees."""
        size = np.zeros(len(self.edges))
        for [tree] in self.trees:
            gains = np.bincount(np.maximum(tree.feature, 0), np.where(np.array(tree.feature) >= 0, tree.gain, 0.0), len(size))
            size += gains / (gains.sum() or 1.0)
        return DenseVector(size / size.sum() if size.sum() > 0 else size)


@dataclass
class Cells:
    """Where the bins of each feature lie in one list of cells; two more hold the whole node and nothing."""

    start: np.ndarray          # first cell of each feature
    usual: np.ndarray          # its most frequent bin
    feature: np.ndarray        # feature of each cell
    bin: np.ndarray

    @property
    def count(self) -> int:
        return len(self.feature)


def cuts_of(values: np.ndarray, bins: int) -> list:
    """Cuts midway between values: between all, or where about equal numbers of rows lie between cuts."""
    known, counts = np.unique(values[np.isfinite(values)], return_counts=True)
    if len(known) > bins:
        below = np.cumsum(counts)[:-1]
        wanted = np.arange(1, bins) * (counts.sum() / bins)
        after = np.unique(np.minimum(np.searchsorted(below, wanted), len(below) - 1))
    else:
        after = np.arange(max(0, len(known) - 1))
    # a midpoint that rounds up to the next value would part nothing
    middle = known[after] + (known[after + 1] - known[after]) / 2 if len(after) else known[:0]
    return np.where(middle < known[after + 1], middle, known[after]).tolist() if len(after) else []


def _held(values: np.ndarray, edges: list) -> np.ndarray:
    """Bins of values; missing ones go where the largest go."""
    bins = binned(values, edges)
    return np.where(bins == MISSING, np.array([len(e) for e in edges], np.uint8), bins)


def cells_of(values: np.ndarray, edges: list) -> Cells:
    sizes = np.array([len(e) + 1 for e in edges])
    bins = _held(values, edges)
    usual = np.array([np.bincount(bins[:, j], minlength=k).argmax() for j, k in enumerate(sizes)])
    start = np.cumsum(sizes) - sizes
    feature = np.repeat(np.arange(len(sizes)), sizes)
    return Cells(start, usual, feature, np.arange(len(feature)) - start[feature])


def _sparse(edges: list, cells: Cells):
    """(cells, label): the cells of a row's unusual bins."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        step = max(1, CHUNK_CELLS // 16 // len(edges))
        for batch in (b[i:i + step] for b in batches for i in range(0, b.num_rows, step)):
            bins = _held(_matrix(batch.column(0)), edges)
            row, feature = np.nonzero(bins != cells.usual)
            found = (cells.start[feature] + bins[row, feature]).astype("<i4")
            ends = np.cumsum(np.bincount(row, minlength=len(bins))) * 4
            raw = pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(np.concatenate([[0], ends]).astype("<i4")), pa.py_buffer(found)])
            yield pa.RecordBatch.from_arrays([raw, batch.column(1)], ["cells", "label"])
    return run


PACKED = "cells binary, place binary, label binary, count binary, hash binary"


def _packed(cells: Cells, mean: float, bits: int):
    """Rows in chunks: the distinct lists of cells, filled up with the cell of nothing; each row's place among them; labels in units; rows in order of their count."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        step = max(1, min(CHUNK_ROWS, CHUNK_CELLS // max(1, len(cells.start))))

        def chunk(held):
            raw, label, count, hashes = (pa.concat_arrays([b.column(i) for b in held]) for i in range(4))
            label, count, hashes = (x.to_numpy(zero_copy_only=False) for x in (label, count, hashes))
            told = raw.dictionary_encode()
            known, place = told.dictionary.to_pylist(), told.indices.to_numpy(zero_copy_only=False).astype("<i4")
            own, sizes = np.frombuffer(b"".join(known), "<i4"), np.array([len(x) // 4 for x in known])
            matrix = np.full((len(known), max(1, sizes.max())), cells.count + 1, "<i4")
            matrix[np.repeat(np.arange(len(known)), sizes), np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = own
            order = np.argsort(count, kind="stable")
            parts = (matrix, place[order], np.rint(np.ldexp(label - mean, bits))[order], count[order], hashes[order])
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["cells", "place", "label", "count", "hash"])
        held, rows = [], 0
        for batch in (b[i:i + step] for b in batches for i in range(0, b.num_rows, step)):
            if rows + batch.num_rows > step:
                yield chunk(held)
                held, rows = [], 0
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield chunk(held)
    return run


@lru_cache(maxsize=1024)
def _poisson(mean: int) -> tuple:
    """(least, chances): the sums of chances of Poisson draws from the least one on that may come."""
    spread = 12 * mean ** 0.5 + 20
    least = max(0, int(mean - spread))
    return least, np.cumsum(np.exp([k * log(mean) - mean - lgamma(k + 1) for k in range(least, int(mean + spread) + 1)]))


def draws(hashes: np.ndarray, counts: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree's bootstrap sample holds each row (in order of their count): Poisson with the count as mean."""
    x = hashes.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    share = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53
    out, starts = np.empty(len(share)), np.flatnonzero(np.diff(counts, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(counts)]):
        least, chances = _poisson(int(counts[start]))
        out[start:end] = least + np.searchsorted(chances, share[start:end], side="right")
    return out


def _nodes(tree: tuple, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The node each of ``rows`` ends in. ``tree``: feature (-1: leaf), cut and left child by node."""
    feature, cut, left = tree
    leaf = feature < 0                                           # a leaf leads to itself
    feature, cut, left = np.where(leaf, 0, feature), np.where(leaf, MISSING, cut), np.where(leaf, np.arange(len(leaf)), left)
    at, cells, first = np.zeros(len(rows), np.int64), bins.ravel(), rows * bins.shape[1]
    while not leaf[at].all():
        at = left[at] + (cells[first + feature[at]] > cut[at])
    return at


def _histograms(items: list, cells: Cells):
    """(item, cells, weights, labels): sums of a task's rows per open node and cell, those that are not empty.
    ``items``: (number of the tree, tree, slot of each node or -1, slots)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        wide = cells.count + 2
        sums = [np.zeros((2, slots * wide)) for *_, slots in items]
        for batch in batches:
            for i in range(batch.num_rows):
                own, place, label, count, hashes = (np.frombuffer(c[i].as_buffer(), kind) for c, kind in zip(batch.columns, ("<i4", "<i4", float, np.int64, np.int64)))
                alike = int(place.max()) + 1                     # distinct lists of cells
                own = own.reshape(alike, -1)
                bins = np.tile(cells.usual.astype(np.uint8), (alike, 1))
                row, at = np.nonzero(own < cells.count)
                bins[row, cells.feature[own[row, at]]] = cells.bin[own[row, at]]
                number = None
                for held, (name, tree, places, _) in zip(sums, items):
                    if name != number:
                        number, weight = name, draws(hashes, count, name)
                        whole = [np.bincount(place, x, alike) for x in (weight, weight * label)]
                        drawn = np.flatnonzero(whole[0])
                        node = _nodes(tree, bins, drawn)
                    slot = places[node]
                    rows, slot = drawn[slot >= 0], slot[slot >= 0] * wide
                    at = (slot[:, None] + own[rows]).ravel()
                    for x, to in zip(whole, held):
                        to += np.bincount(slot + cells.count, x[rows], len(to))
                        to += np.bincount(at, np.repeat(x[rows], own.shape[1]), len(to))
        for item, held in enumerate(sums):
            full = np.flatnonzero(held[0])
            if len(full):
                yield pa.RecordBatch.from_arrays([pa.array([item]), *(pa.array([x.tobytes()], pa.binary()) for x in (full.astype("<i4"), held[0, full], held[1, full]))],
                                                 ["item", "cells", "weights", "labels"])
    return run


def best_cuts(weights: np.ndarray, labels: np.ndarray, cells: Cells) -> tuple:
    """(gain, cell, weight, label, weight and label of the left side) of the best cut per slot, from sums (slots, cells and 2 more);
    gain 0 where none parts anything. Of equal gains the first cell counts."""
    whole, sides = [], []
    for x in (weights, labels):
        total, x = x[:, cells.count], x[:, :cells.count].copy()
        x[:, cells.start + cells.usual] = total[:, None] - np.add.reduceat(x, cells.start, axis=1)
        low = np.cumsum(x, axis=1)
        before = np.concatenate([np.zeros((len(x), 1)), low], axis=1)[:, cells.start]
        whole.append(total)
        sides.append(low - before[:, cells.feature])
    (n, s), (left_n, left_s) = whole, sides
    right_n, right_s = n[:, None] - left_n, s[:, None] - left_s
    allowed = (left_n > 0) & (right_n > 0)
    mean = np.divide(left_s, left_n, out=np.zeros_like(left_s), where=allowed) - np.divide(right_s, right_n, out=np.zeros_like(left_s), where=allowed)
    gain = left_n * right_n / n[:, None] * mean ** 2
    best, rows = gain.argmax(axis=1), np.arange(len(gain))
    return gain[rows, best], best, n, s, left_n[rows, best], left_s[rows, best]


CUTS = "item long, slot long, gain double, cell long, n double, s double, left_n double, left_s double"


def _cuts(sizes: list, cells: Cells):
    """Totals and best cut per slot, from the sums of all tasks, which come together."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            for item, at, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                if item not in held:
                    held[item] = np.zeros((2, sizes[item] * (cells.count + 2)))
                at = np.frombuffer(at, "<i4")
                for s, x in enumerate(parts):
                    held[item][s, at] += np.frombuffer(x, float)
        for item in list(held):
            weights, labels = held.pop(item).reshape(2, sizes[item], -1)
            full = np.flatnonzero(weights[:, cells.count])
            gain, cell, *sums = best_cuts(weights[full], labels[full], cells)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(full), item), full, gain, cell, *sums)], [c.split()[0] for c in CUTS.split(", ")])
    return run


@dataclass
class RandomForest:
    """Fits ``features`` (a vector) and ``label`` (a number): every tree on a bootstrap sample of all rows, every feature tried at every node."""

    trees: int = 100
    depth: int = 10
    bins: int = 64

    def fit(self, prepared: DataFrame) -> Forest:
        settings = Settings("squared", rounds=self.trees, depth=self.depth, step=1.0, l2=0.0, bins=self.bins)
        rows = prepared.select(vector_to_array("features").alias("values"), F.col("label").cast("double").alias("label"))
        n, mean, low, high = rows.agg(F.count("label"), F.avg("label"), F.min("label"), F.max("label")).first()
        if not n:
            return Forest(settings, [0.0], [], [])
        largest = max(high - mean, mean - low) or 1.0
        bits = BITS - n.bit_length() - int(np.ceil(np.log2(largest)))
        some = rows.select("values") if n <= EDGE_ROWS else rows.select("values").sample(EDGE_ROWS / n, seed=42)
        values = np.array(some.toArrow()["values"].to_pylist(), float)              # about EDGE_ROWS rows
        values = values if len(values) else np.array([rows.first()["values"]], float)
        edges = [cuts_of(values[:, j], self.bins) for j in range(values.shape[1])]
        cells = cells_of(values, edges)
        merged = rows.mapInArrow(_sparse(edges, cells), "cells binary, label double").groupBy("cells", "label").count()
        merged = merged.withColumn("hash", F.xxhash64("cells", "label"))
        tasks = max(prepared.sparkSession.sparkContext.defaultParallelism, n // ROWS_PER_TASK)
        merged = merged.repartitionByRange(tasks, "cells", "hash").sortWithinPartitions("cells")     # rows with equal cells lie together
        state = merged.mapInArrow(_packed(cells, mean, bits), PACKED).persist(StorageLevel.MEMORY_AND_DISK)
        model = Forest(settings, [mean], edges, [[Tree()] for _ in range(self.trees)])
        open_nodes = [(t, [0]) for t in range(self.trees)]
        for _ in range(self.depth):
            open_nodes = self._level(state, model, open_nodes, cells, bits)
        state.unpersist()
        return model

    def _level(self, state: DataFrame, model: Forest, open_nodes: list, cells: Cells, bits: int) -> list:
        """Splits the open nodes of all trees; the next open ones."""
        wide, parts, after = cells.count + 2, [], {}
        most = max(1, ITEM_CELLS // wide)
        for t, nodes in open_nodes:
            parts += [(t, nodes[i:i + most]) for i in range(0, len(nodes), most)]
        while parts:
            taken, size = [], 0
            while parts and (not taken or size + len(parts[0][1]) * wide <= PASS_CELLS):
                taken.append(parts.pop(0))
                size += len(taken[-1][1]) * wide
            items = []
            for t, nodes in taken:
                [tree] = model.trees[t]
                places = np.full(len(tree.feature), -1)
                places[nodes] = range(len(nodes))
                items.append((t, (np.array(tree.feature), np.array(tree.cut), np.array(tree.left)), places, len(nodes)))
            sums = state.mapInArrow(_histograms(items, cells), "item long, cells binary, weights binary, labels binary")
            found = sums.repartition(max(1, min(len(items), size // CELLS_PER_TASK)), "item").mapInArrow(_cuts([slots for *_, slots in items], cells), CUTS).toArrow()
            for item, slot, gain, cell, *sides in sorted(zip(*(c.to_pylist() for c in found.columns))):     # a row per open node
                t, nodes = taken[item]
                after.setdefault(t, []).extend(self._split(model.trees[t][0], nodes[slot], gain, cells, cell, sides, bits))
        return [(t, nodes) for t, nodes in sorted(after.items()) if nodes]

    def _split(self, tree: Tree, node: int, gain: float, cells: Cells, cell: int, sides: list, bits: int) -> list:
        """Children of the node that may be split further."""
        n, s, left_n, left_s = sides

        def settle(node, n, s):
            tree.value[node], tree.cover[node] = float(np.ldexp(s / n, -bits)) / self.trees, n
        if not node:
            settle(0, n, s)
        if gain <= 0:
            return []
        left = tree.split(node, int(cells.feature[cell]), int(cells.bin[cell]), False, float(np.ldexp(gain, -2 * bits)))
        settle(left, left_n, left_s)
        settle(left + 1, n - left_n, s - left_s)
        return [child for child in (left, left + 1) if tree.cover[child] > 1]
