"""Hard negatives by angular triangle filtering.

Components become integers, floor(256 * x). Each row is stored with the angles between it and a few reference
directions. For an anchor at angle s and a row at angle t of one reference, the angle between the two lies between
|s - t| and the lesser of s + t and 2 pi - s - t; over all references the narrowest such interval holds. Its cosines times
the two norms, widened by more than rounding can take away, bound the pair's score. Only pairs whose interval overlaps the
scores in question get their integer inner product.

Rows are range-sorted by nearest reference and angle into stripes, which are narrow in angle and about equally large; a
vector that many rows have spreads over stripes, as row numbers part equals. A stripe's own angles and norms bound the scores
of all its rows, so an anchor is sent only to the stripes that can matter, and rows are never sent to anchors:

1. Each anchor meets its home stripe and takes its best rows of the same label there. The last of them is its floor.
2. It meets the other stripes whose bounds reach its floor; the best of all stripes are its positives.
3. It meets the stripes that a positive's window of scores overlaps, and takes the first rows of other labels in each window.

A task holds one stripe and one batch of anchors, and hands on a few rows an anchor. Where directions are spread evenly in
many dimensions, triangles rule out little and all pairs of anchors and rows are scored, in blocks.

Defined results: rows with a null id, label or vector, or with a component that is null or not finite (256-fold too), take no part. A
vector shorter than others counts as padded with zeros. Repeated rows count as often as they are there, never as other
rows of an anchor of their id; an anchor that is repeated gives its rows once. A positive with a score below zero has an empty
window. Scores are exact at any size; one beyond 64 bits that would be returned raises an error. An empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import bound_batches, discard, written

#: Reference directions, and the rows among which they are chosen, each as far as can be from those before.
REFERENCES, SAMPLE = 16, 2048
#: Rows of a stripe, about, where there are enough of them to keep all tasks busy.
STRIPE_ROWS = 65_536
#: Anchors that are compared with a stripe at once.
STRIP = 32
#: What rounding may take away from a bound, as a share of the norms; angles are kept with 24 bits.
SLACK = 4e-6
#: Below this, products and their hundredfold are exact in 53 bits.
EXACT = 2**53 / 128

ROW, ANCHOR = 0, 1
PLACED = "n long, vec_id long, label long, anchor boolean, q array<double>, angles array<float>, cell int, near float"
STRIPED = "stripe int, n long, vec_id long, label long, anchor boolean, q array<double>, angles array<float>"
#: floor: the least score that matters for positives; wanted: positives' scores, for negatives.
VISIT = "stripe int, kind int, n long, vec_id long, label long, q array<double>, angles array<float>, floor double, wanted array<long>"
FOUND = "n long, nth int, other long, score long"


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of numbers as rows, padded with zeros (or cut, which only references' directions are) to width."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    widest = int(sizes.max(initial=0))
    if (sizes == widest).all():
        made = flat.reshape(len(sizes), widest)
    else:
        made = np.zeros((len(sizes), widest))
        made[np.arange(widest) < sizes[:, None]] = flat
    return made if width is None else _wide(made, width)


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _norms(m: np.ndarray) -> np.ndarray:
    """Lengths of rows, of components of any size."""
    most = np.abs(m).max(axis=1, initial=0)
    return np.sqrt(np.square(m / np.where(most > 0, most, 1)[:, None]).sum(axis=1)) * most


def _directions(m: np.ndarray) -> np.ndarray:
    norms = _norms(m)
    return m / np.where(norms > 0, norms, 1)[:, None]


def _angles(directions: np.ndarray, references: np.ndarray) -> np.ndarray:
    width = max(directions.shape[1], references.shape[1])
    return np.arccos(np.clip(_wide(directions, width) @ _wide(references, width).T, -1, 1)).astype(np.float32)


def choose_references(sample: np.ndarray, most: int = REFERENCES) -> np.ndarray:
    """Directions of rows of the sample, one after the other, each with the least cosine to those before."""
    sample = _directions(sample)
    sample = sample[np.any(sample != 0, axis=1)]
    chosen, nearest = [], np.zeros(len(sample))
    while len(chosen) < min(most, len(sample)):
        chosen.append(sample[int(nearest.argmin())])
        nearest = np.maximum(nearest if len(chosen) > 1 else -1.0, sample @ chosen[-1])
    return np.array(chosen).reshape(len(chosen), sample.shape[1])


def score_bounds(angles: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score between anchors (angles, norm) and things whose angles lie in [low, high] and norms in [least, most].

    All angles are references wide; a row by itself has low = high and least = most. Results are anchors x things."""
    near = np.zeros((len(angles), len(low)), np.float32)
    far = np.full_like(near, np.pi)
    for r in range(angles.shape[1]):
        s, lo, hi = angles[:, r, None], low[None, :, r], high[None, :, r]
        np.maximum(near, np.maximum(lo - s, s - hi), out=near)
        if low is high:
            both = s + lo
            np.minimum(far, np.minimum(both, np.float32(2 * np.pi) - both), out=far)
        else:
            np.minimum(far, np.where(s + hi <= np.pi, s + hi, np.where(s + lo >= np.pi, 2 * np.pi - s - lo, np.pi)), out=far)
    top, bottom = np.cos(near.astype(float)), np.cos(far.astype(float))
    slack = SLACK * norm[:, None] * most + 1
    greatest = norm[:, None] * top * np.where(top >= 0, most, least) + slack
    return norm[:, None] * bottom * np.where(bottom >= 0, least, most) - slack, greatest


def _products(anchors: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products: floats where they are exact, Python integers otherwise."""
    width = max(anchors.shape[1], rows.shape[1])
    anchors, rows = _wide(anchors, width), _wide(rows, width)
    if exact:
        return anchors @ rows.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return whole(anchors) @ whole(rows).T if width else np.zeros((len(anchors), len(rows)), object)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id; ids are in ascending order."""
    if len(scores) > k:
        cut = -np.partition(-scores, k - 1)[k - 1]
        above, level = np.flatnonzero(scores > cut), np.flatnonzero(scores == cut)
        places = np.concatenate([above, level[: k - len(above)]])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))]


class _Stripe:
    """The rows of a stripe in order of vec_id."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        one = lambda name: table[name].combine_chunks()
        ids = one("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], one("label").to_numpy()[order]
        self.q, self.angles = _matrix(one("q"))[order], _matrix(one("angles"))[order].astype(np.float32)
        self.norms = _norms(self.q)
        self.by_label = {label: np.flatnonzero(self.labels == label) for label in np.unique(self.labels)}
        self.others = {label: np.flatnonzero(self.labels != label) for label in self.by_label}

    def overlapping(self, q: np.ndarray, angles: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor those of the rows whose score may lie in [low, high], and their scores."""
        for at in range(0, len(q), STRIP):
            part = slice(at, at + STRIP)
            norms, own, sizes = _norms(q[part]), self.angles[rows], self.norms[rows]
            with np.errstate(invalid="ignore", over="ignore"):
                least, greatest = score_bounds(angles[part], norms, own, own, sizes, sizes)
            may = ~((greatest < low[part, None]) | (least > high[part, None]))  # a bound that overflowed rules nothing out
            some = np.flatnonzero(may.any(axis=0))
            exact = float(norms.max(initial=0)) * float(sizes.max(initial=0)) < EXACT  # inf and nan are not
            scores = _products(q[part], self.q[rows[some]], exact)
            for i in range(len(norms)):
                kept = np.flatnonzero(may[i, some])
                yield at + i, rows[some[kept]], scores[i, kept]


def _visit(rows: DataFrame, visits: DataFrame, stripes: int, work: Callable, what: str) -> DataFrame:
    """work(stripe, anchors' batch) for the anchors that visit each of the stripes, a task a stripe; the results, written."""
    names = [c.split()[0] for c in VISIT.split(", ")]
    held = rows.select("stripe", F.lit(ROW).alias("kind"), "n", "vec_id", "label", "q", "angles", F.lit(None).cast("double").alias("floor"), F.lit(None).cast("array<long>").alias("wanted"))
    both = held.unionByName(visits.select(*[c if c != "kind" else F.lit(ANCHOR).alias("kind") for c in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, stripe, rows_of = None, None, []
        for batch in batches:
            cuts = np.flatnonzero(np.diff(batch.column(0).to_numpy()) | np.diff(batch.column(1).to_numpy())) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                part = batch.slice(start, stop - start)
                if len(part) == 0:
                    continue
                own, kind = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                if own != number:
                    number, stripe, rows_of = own, None, []
                if kind == ROW:
                    rows_of.append(part)
                    continue
                if stripe is None and rows_of:
                    stripe, rows_of = _Stripe(rows_of), []
                if stripe is not None:
                    found = work(stripe, part)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

    return written(both.repartitionById(stripes, "stripe").sortWithinPartitions("stripe", "kind").mapInArrow(run, FOUND), what)


def _positives(k: int) -> Callable:
    def work(stripe: _Stripe, batch: pa.RecordBatch) -> list[tuple]:
        n, ids, labels, floors = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("n", "vec_id", "label", "floor"))
        q, angles = _matrix(batch.column(batch.schema.names.index("q"))), _matrix(batch.column(batch.schema.names.index("angles"))).astype(np.float32)
        found = []
        for label in np.unique(labels):
            mine, rows = np.flatnonzero(labels == label), stripe.by_label.get(label, np.zeros(0, int))
            low = np.where(np.isnan(floors[mine]), -np.inf, floors[mine])
            for i, kept, scores in stripe.overlapping(q[mine], angles[mine], rows, low, np.full(len(mine), np.inf)):
                a = mine[i]
                other = (stripe.ids[kept] != ids[a]) & (scores >= low[i])
                kept, scores = kept[other], scores[other]
                found += [(int(n[a]), 0, int(stripe.ids[kept[p]]), int(scores[p])) for p in _top(scores, stripe.ids[kept], k)]
        return found

    return work


def _negatives(k: int, low: int, high: int) -> Callable:
    def work(stripe: _Stripe, batch: pa.RecordBatch) -> list[tuple]:
        n, labels = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("n", "label"))
        wanted = batch.column(batch.schema.names.index("wanted")).to_pylist()
        q, angles = _matrix(batch.column(batch.schema.names.index("q"))), _matrix(batch.column(batch.schema.names.index("angles"))).astype(np.float32)
        floor = np.array([min(w) * low / 100 - 1 for w in wanted], float)
        ceiling = np.array([max(w) * high / 100 + 1 for w in wanted], float)
        found = []
        for label in np.unique(labels):
            mine, rows = np.flatnonzero(labels == label), stripe.others.get(label, np.arange(len(stripe.ids)))
            for i, kept, scores in stripe.overlapping(q[mine], angles[mine], rows, floor[mine], ceiling[mine]):
                a = mine[i]
                order = np.lexsort((stripe.ids[kept], -scores))
                kept, scores = kept[order], scores[order]
                for nth, score in enumerate(wanted[a]):
                    fits = np.flatnonzero((low * score <= 100 * scores) & (100 * scores <= high * score))[:k]
                    found += [(int(n[a]), nth, int(stripe.ids[kept[p]]), int(scores[p])) for p in fits]
        return found

    return work


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each group, higher scores first, ties by smaller other."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _place(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """Rows as integers, numbered, with their angles and the nearest reference."""
    sent = rows.sparkSession.sparkContext.broadcast(references)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            vectors = batch.column(3)
            q = np.floor(256 * _matrix(vectors))
            angles = _angles(_directions(q), sent.value)
            lists = lambda m, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))
            cell = angles.argmin(axis=1) if angles.size else np.zeros(len(q), int)
            near = angles.min(axis=1, initial=np.inf)
            n = pa.array(np.arange(first, first + len(q)))
            first += len(q)
            yield pa.record_batch([n, *batch.columns[:3], lists(q, pa.float64()), lists(angles, pa.float32()), pa.array(cell, pa.int32()), pa.array(near, pa.float32())], names=[c.split()[0] for c in PLACED.split(", ")])

    return written(rows.mapInArrow(run, PLACED), "placed")


def _striped(placed: DataFrame, parts: int) -> DataFrame:
    names = [c.split()[0] for c in STRIPED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripe = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.record_batch([pa.array(np.full(len(batch), stripe, np.int32)), *batch.columns], names=names)

    return written(placed.repartitionByRange(parts, "cell", "near", "n").select(names[1:]).mapInArrow(run, STRIPED), "stripes")


class _Summary:
    """Angle and norm ranges of all stripes: some numbers a stripe, and so a bounded table."""

    def __init__(self, rows: DataFrame, references: int):
        square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)
        edges = [f(F.col("angles")[r]).alias(f"{name}{r}") for r in range(references) for name, f in (("lo", F.min), ("hi", F.max))]
        got = rows.groupBy("stripe").agg(F.min(F.sqrt(square)).alias("least"), F.max(F.sqrt(square)).alias("most"), *edges).collect()  # a row a stripe
        self.stripes = np.array([r["stripe"] for r in got], np.int32)
        self.low = np.array([[r[f"lo{i}"] for i in range(references)] for r in got], np.float32).reshape(len(got), references)
        self.high = np.array([[r[f"hi{i}"] for i in range(references)] for r in got], np.float32).reshape(len(got), references)
        # norms are sums in another order here and may overflow: wider by a rounding
        self.least = np.array([r["least"] if np.isfinite(r["least"]) else 0 for r in got]) * (1 - 1e-12)
        self.most = np.array([r["most"] for r in got]) * (1 + 1e-12)

    def route(self, anchors: DataFrame) -> DataFrame:
        """anchors (stripe: their home, ..., low, high) with `stripe` for each stripe but home that may have scores in [low, high]; home too if `home`."""
        sent = anchors.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                col = lambda name, b=batch: b.column(b.schema.names.index(name))
                angles, norms = _matrix(col("angles")).astype(np.float32), _norms(_matrix(col("q")))
                with np.errstate(invalid="ignore", over="ignore"):
                    least, greatest = score_bounds(angles, norms, own.low, own.high, own.least, own.most)
                outside = (greatest < col("low").to_numpy(zero_copy_only=False)[:, None]) | (least > col("high").to_numpy(zero_copy_only=False)[:, None])
                lists = [own.stripes[~outside[i]].tolist() for i in range(len(batch))]
                yield pa.record_batch([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "met"])

        return anchors.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in anchors.dtypes) + ", met array<int>")


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, references: int = REFERENCES, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, label, embedding) that `anchor` says.

    An anchor's positives are its best other rows of the same label; for each, the best rows of other labels whose scores are
    between `low` and `high` percent of the positive's are ranked from 1."""
    spark = rows.sparkSession
    bound_batches(spark)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * 256 < float("inf")))
    clean = rows.select("vec_id", F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(SAMPLE).toArrow()
    chosen = choose_references(np.floor(256 * _matrix(sample["embedding"].combine_chunks())), references)
    placed = _place(clean, chosen)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // stripe_rows))
    striped = _striped(placed, parts)
    discard(placed)
    summary = _Summary(striped, len(chosen))
    stripes = int(summary.stripes.max(initial=0)) + 1
    first = F.row_number().over(Window.partitionBy("vec_id", "label", "q").orderBy("n"))
    anchors = striped.where("anchor").withColumn("_first", first).where("_first = 1").select("stripe", "n", "vec_id", "label", "q", "angles")

    none, no_list = F.lit(None).cast("double"), F.lit(None).cast("array<long>")
    home = _visit(striped, anchors.select("*", none.alias("floor"), no_list.alias("wanted")), stripes, _positives(positives), "home")
    floors = _best(home, ["n"], positives).groupBy("n").agg(F.when(F.count("*") == positives, F.min("score").cast("double")).alias("floor"))
    known = anchors.join(floors, "n", "left").withColumns({"low": F.coalesce("floor", F.lit(float("-inf"))), "high": F.lit(float("inf"))})
    away = summary.route(known).withColumn("_to", F.explode("met")).where("_to <> stripe").withColumn("stripe", F.col("_to"))
    rest = _visit(striped, away.select("*", no_list.alias("wanted")), stripes, _positives(positives), "away")
    best = written(_best(home.unionByName(rest), ["n"], positives).select("n", "rank", "other", "score"), "positives")

    wanted = best.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("wanted"))
    ranged = anchors.join(wanted, "n").withColumns({"low": F.array_min("wanted") * F.lit(low / 100) - 1, "high": F.array_max("wanted") * F.lit(high / 100) + 1})
    met = summary.route(ranged.where(F.array_max("wanted") >= 0)).withColumn("stripe", F.explode("met"))
    found = _visit(striped, met.select("*", none.alias("floor")), stripes, _negatives(negatives, low, high), "negatives")
    ranked = _best(found, ["n", "nth"], negatives).select("n", (F.col("nth") + 1).alias("place"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    names = striped.where("anchor").select("n", F.col("vec_id").alias("anchor_id"))
    pairs = best.select("n", F.col("rank").alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    made = ranked.join(pairs, ["n", "place"]).join(names, "n")
    return made.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
