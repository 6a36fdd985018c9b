"""Balanced multinomial logistic regression over sparse rows: all models of a training run in the same passes.

Rows become blocks of some dozens that are alike, so that a block holds few places, or of thousands where they hold few values, written once, and kept by the executors as bytes, in memory while there is room and else
on disk, as long as models are fitted to them: what a pass reads needs no more than unpacking. A pass over the blocks gives the loss and the gradient of every model
that is still being fitted, the full one and those that leave out a fold; its sums are folded in a tree, so what comes
to the driver are a few arrays of the model's size. The driver keeps a limited-memory BFGS search for each model and
proposes the next point of each. A model is done when no component of its gradient exceeds TOLERANCE.

The loss is the mean of the rows' weighted losses plus the squared coefficients over 2 n, without the intercepts: a
penalty of strength one to the summed loss. A row weighs n / (classes * rows of its class), counted for each model apart.
Classes that a model's rows lack get no probability in it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import settled

#: Most rows of a block, and most cells of its matrix of rows and the places that they hold; values that rows of a longer
#: block may have on average, and most rows of such a block.
BLOCK_ROWS, BLOCK_CELLS = 64, 1 << 21
SHORT_VALUES, SHORT_ROWS = 32, 8192
#: Places by which rows are put beside those like them.
SORTING = 16
TOLERANCE, MOST_PASSES, MEMORY = 1e-5, 1000, 30
#: Bytes of short batches that are joined before blocks are cut from them, and tasks whose sums come to the driver without a tree.
JOINED_BYTES, FEW_TASKS = 1 << 24, 16
#: places (ascending) and values that are not zero; what is null or not a number counts as zero.
SPARSE = "struct<at:array<int>,w:array<double>>"
#: deal: a number of each row, by whose rest it is in a fold; row, cell, w: the rows' values, by row and by number among the
#: block's places; width: one more than the last of these.
BLOCK = "label binary, deal binary, row binary, cell binary, w binary, places binary, width int"
KINDS = {"label": "<i4", "deal": "<i4", "row": "<i4", "cell": "<i4", "w": "<f8", "places": "<i4"}


@dataclass
class Logistic:
    """Coefficients by class and place, intercepts, and the classes that the model knows."""

    coefficients: np.ndarray
    intercepts: np.ndarray
    known: np.ndarray
    passes: int = 0
    converged: bool = True


def _rows_of(features: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, places and values of a column of SPARSE; a null row is all zeros."""
    at, w = features.flatten()  # with the struct's nulls
    sizes = pc.list_value_length(at).fill_null(0).to_numpy(zero_copy_only=False)
    values = w.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), at.flatten().to_numpy(zero_copy_only=False), np.where(np.isfinite(values), values, 0.0)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as one until they have SHORT_ROWS rows or JOINED_BYTES, so that blocks don't follow the session's size of a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= SHORT_ROWS or sum(b.nbytes for b in held) >= JOINED_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _alike(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Its rows by which of its commonest places they hold, then by their number of values."""
    starts, at, _ = _rows_of(pa.concat_arrays([batch.column(0)]))
    sizes = np.diff(starts)
    if len(at) <= SHORT_VALUES * len(batch):
        return batch
    common = np.argsort(-np.bincount(at), kind="stable")[:SORTING]
    bit = np.zeros(at.max() + 1)
    bit[common] = 2.0 ** -np.arange(len(common))
    held = np.bincount(np.repeat(np.arange(len(batch)), sizes), bit[at], len(batch))
    return batch.take(pa.array(np.lexsort((sizes, held))))


def blocks(rows: DataFrame, label: str, key: str) -> DataFrame:
    """Blocks of rows (features, label, key); rows without a label take no part."""
    deal = F.pmod(F.xxhash64(key), F.lit(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_alike, _joined(batches)):
            first = 0
            while first < len(batch):
                rows = min(SHORT_ROWS, len(batch) - first)
                if rows > BLOCK_ROWS and _rows_of(pa.concat_arrays([batch.column(0).slice(first, rows)]))[0][-1] > SHORT_VALUES * rows:
                    rows = BLOCK_ROWS
                while True:
                    part = batch.slice(first, rows)
                    starts, at, w = _rows_of(pa.concat_arrays([part.column(0)]))  # offsets from zero
                    places, cell = np.unique(at, return_inverse=True)
                    if rows == 1 or rows * len(places) <= BLOCK_CELLS:
                        break
                    rows //= 2
                cells = {"label": part.column(1).to_numpy(), "deal": part.column(2).to_numpy(), "row": np.repeat(np.arange(rows), np.diff(starts)), "cell": cell, "w": w, "places": places}
                yield pa.record_batch([*[pa.array([cells[c].astype(kind).tobytes()], pa.binary()) for c, kind in KINDS.items()], pa.array([int(places.max(initial=-1)) + 1], pa.int32())], names=[c.split()[0] for c in BLOCK.split(", ")])
                first += rows

    return settled(rows.where(F.col(label).isNotNull()).select("features", F.col(label).cast("int").alias("label"), deal.cast("int").alias("deal")).mapInArrow(run, BLOCK))


def _logs(scores: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Logarithms of probabilities; unknown classes have none."""
    scores = np.where(known, scores, -np.inf)
    scores = scores - scores.max(axis=-1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=-1, keepdims=True))


def _unpack(block) -> tuple[np.ndarray, ...]:
    """label, deal, the rows as a matrix over the block's places, and these places."""
    label, deal, row, cell, w, places = (np.frombuffer(part, kind) for part, kind in zip(block, KINDS.values(), strict=True))
    x = np.zeros((len(label), len(places)))
    x[row, cell] = w
    return label, deal, x, places


def _products(x: np.ndarray, places: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Rows x models x classes: products of a block with points (models x classes x places, the last place an intercept)."""
    models, classes, width = points.shape
    flat = points.reshape(-1, width)
    return (x @ flat[:, places].T + flat[:, -1]).reshape(-1, models, classes)


def kept(held: DataFrame) -> RDD:
    """The blocks as bytes that executors keep; to be given back with `unpersist`."""
    return held.rdd.map(lambda block: tuple(bytes(block[c]) for c in KINDS)).persist(StorageLevel.MEMORY_AND_DISK)


def _summed(held: DataFrame | RDD, size: int, work) -> np.ndarray:
    """The sum over blocks of what work adds to an array of `size`; added up in each task, then in a tree."""

    def run(rows):
        total = np.zeros(size)
        for block in rows:
            work(total, *_unpack(block))
        yield total

    found = held.rdd.map(lambda block: tuple(block[c] for c in KINDS)) if isinstance(held, DataFrame) else held
    total = found.mapPartitions(run).treeAggregate(0.0, np.add, np.add, 1 if found.getNumPartitions() <= FEW_TASKS else 2)  # arrays of fixed size: DataFrames have no aggregate for their sums
    return total + np.zeros(size)  # where there are no blocks


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """Their product without the linear algebra library, whose threads would wait for those of Spark's tasks."""
    return float(np.einsum("i,i->", a, b))


class _Search:
    """Limited-memory BFGS from zero, with steps cut until the loss falls enough; it is told the loss and gradient of `trial`."""

    def __init__(self, size: int):
        self.point = self.trial = np.zeros(size)
        self.loss, self.gradient, self.steps, self.changes = None, None, [], []
        self.direction, self.step, self.slope, self.done, self.stuck = None, 1.0, 0.0, False, False

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        if self.loss is not None and not loss <= self.loss + 1e-4 * self.step * self.slope:
            self.step /= 2
            self.stuck = self.step < 1e-12  # the loss falls no further in this arithmetic
            self.done, self.trial = self.stuck, self.point + self.step * self.direction
            return
        if self.loss is not None:
            step, change = self.trial - self.point, gradient - self.gradient
            if _dot(step, change) > 1e-12 * _dot(change, change):
                self.steps, self.changes = [*self.steps, step][-MEMORY:], [*self.changes, change][-MEMORY:]
        self.point, self.loss, self.gradient = self.trial, loss, gradient
        if np.abs(gradient).max(initial=0) <= TOLERANCE:
            self.done = True
            return
        self.direction = -self._newton(gradient)
        self.slope = _dot(self.direction, gradient)
        self.step = 1.0 if self.steps else min(1.0, 1.0 / np.abs(gradient).sum())
        self.trial = self.point + self.step * self.direction

    def _newton(self, gradient: np.ndarray) -> np.ndarray:
        """The gradient times the approximate inverse of the second derivatives."""
        q, held = gradient.copy(), []
        for step, change in zip(reversed(self.steps), reversed(self.changes), strict=True):
            share = _dot(step, q) / _dot(step, change)
            q -= share * change
            held.append(share)
        if self.steps:
            q *= _dot(self.steps[-1], self.changes[-1]) / _dot(self.changes[-1], self.changes[-1])
        for step, change, share in zip(self.steps, self.changes, reversed(held), strict=True):
            q += (share - _dot(change, q) / _dot(step, change)) * step
        return q


def class_counts(held: DataFrame, classes: int, folds: int = 1) -> np.ndarray:
    """Rows of each fold and class."""

    def count(total, label, deal, x, places) -> None:
        total += np.bincount(deal % folds * classes + label, minlength=folds * classes)

    return _summed(held, folds * classes, count).reshape(folds, classes)


def fit(held: DataFrame, classes: int, folds: int = 0) -> list[Logistic | None]:
    """The model of all rows of blocks, then for each fold the one of the other rows; None where there are fewer than two classes."""
    places = held.agg(F.max("width")).first()[0] or 0
    counts = class_counts(held, classes, max(folds, 1))
    own = np.concatenate([counts.sum(axis=0, keepdims=True), (counts.sum(axis=0) - counts)[:folds]])  # rows of each model and class
    known = own > 0
    chosen = np.flatnonzero(known.sum(axis=1) > 1)
    n = own.sum(axis=1)
    weight = np.where(known, n[:, None] / (known.sum(axis=1, keepdims=True) * np.maximum(own, 1)), 0.0)
    searches = {m: _Search(classes * (places + 1)) for m in chosen}
    penalized = np.ones((classes, places + 1))
    penalized[:, -1] = 0
    passes = {m: 0 for m in chosen}
    spark, ready = held.sparkSession, kept(held)
    while open_ := [m for m in chosen if not searches[m].done and passes[m] < MOST_PASSES]:
        points = np.stack([searches[m].trial.reshape(classes, places + 1) for m in open_])
        sent = spark.sparkContext.broadcast((points, known[open_], weight[open_] / n[open_, None], np.array(open_)))

        def work(total, label, deal, x, places, sent=sent) -> None:
            """Losses, then gradients, of all open models over a block."""
            points, known, weight, numbers = sent.value
            logs = _logs(_products(x, places, points), known)
            share = weight[:, label].T * (deal[:, None] % max(folds, 1) != numbers - 1)  # rows x models; the full model, number 0, leaves out none
            rows = np.arange(len(label))
            total[: len(numbers)] -= (np.where(share > 0, logs[rows, :, label], 0) * share).sum(axis=0)
            errors = np.exp(logs)
            errors[rows, :, label] -= 1
            errors = (errors * share[:, :, None]).reshape(len(label), -1)
            gradient = total[len(numbers) :].reshape(errors.shape[1], points.shape[2])  # a view
            gradient[:, places] += errors.T @ x
            gradient[:, -1] += errors.sum(axis=0)

        got = _summed(ready, len(open_) + points.size, work)
        sent.destroy()
        losses, gradients = got[: len(open_)], got[len(open_) :].reshape(points.shape)
        for m, point, loss, gradient in zip(open_, points, losses, gradients, strict=True):
            passes[m] += 1
            searches[m].tell(loss + (penalized * point**2).sum() / (2 * n[m]), (gradient + penalized * point / n[m]).ravel())
    ready.unpersist()
    made: list[Logistic | None] = [None] * len(own)
    for m, search in searches.items():
        whole = search.point.reshape(classes, places + 1)
        made[m] = Logistic(whole[:, :-1], whole[:, -1], known[m], passes[m], search.done and not search.stuck)
    return made


def _stacked(models: list[Logistic]) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([np.column_stack([m.coefficients, m.intercepts]) for m in models]), np.stack([m.known for m in models])


def quality(held: DataFrame, models: list[Logistic | None], values: list[float]) -> tuple[float | None, float]:
    """The mean over folds of the share of its rows that its model hits, and the full model's mean distance in `values`, in one pass."""
    numbers = [m for m, model in enumerate(models) if model is not None]
    sent = held.sparkSession.sparkContext.broadcast((*_stacked([models[m] for m in numbers]), np.array(values)))

    def work(total, label, deal, x, places) -> None:
        """For each model hits and rows of its fold; the full model's distances and all rows."""
        points, known, worth = sent.value
        made = np.zeros((len(numbers), 2))
        best = _logs(_products(x, places, points), known).argmax(axis=-1)
        for i, m in enumerate(numbers):
            out = deal % (len(models) - 1) == m - 1 if m else None
            made[i] = [np.abs(worth[best[:, i]] - worth[label]).sum(), len(label)] if m == 0 else [(best[out, i] == label[out]).sum(), out.sum()]
        total += made.ravel()

    got = _summed(held, 2 * len(numbers), work).reshape(-1, 2)
    sent.destroy()
    shares = [hits / rows for m, (hits, rows) in zip(numbers, got, strict=True) if m > 0 and rows]
    return (float(np.mean(shares)) if shares else None), float(got[0, 0] / got[0, 1])


def _scores(starts: np.ndarray, at: np.ndarray, w: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Rows x classes: products of rows with points (classes x places, the last place an intercept)."""
    made = np.zeros((len(starts) - 1, len(points)))
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        made[full] = np.add.reduceat(w[:, None] * points.T[at], starts[full])
    return made + points[:, -1]


def probabilities(model: Logistic, features: str | Column) -> Column:
    """array<double>: a probability for each class."""
    points, known = (part[0] for part in _stacked([model]))

    @F.arrow_udf("array<double>")
    def told(column: pa.Array) -> pa.Array:
        column = pa.concat_arrays([column])
        starts, at, w = _rows_of(column)
        inside = at < points.shape[1] - 1
        if not inside.all():  # places that the model lacks
            starts = np.concatenate([[0], np.cumsum(inside)])[starts]
            at, w = at[inside], w[inside]
        made = np.exp(_logs(_scores(starts, at, w, points), known))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32()), pa.array(made.ravel()))

    return told(features)
