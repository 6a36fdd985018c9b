"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Documents are encoded once and cut into pieces of at most `capacity` tokens; full pieces are sequences of their own.
The other pieces are packed in rounds, class by class from the longest pieces down, as best-fit decreasing would:

1. Pieces and the gaps of open sequences are range-sorted together by size, descending, a gap before a piece of its size.
2. Each range is swept: a piece takes its successor, the smallest gap of the range that holds it.
3. What is left over is matched across ranges. Each range reports how many pieces and how many gaps it has left; a stack over
   these few figures pairs runs of pieces with runs of gaps of the nearest range above, by their ranks in the two ranges. So
   no two pieces claim one gap. Where every gap of a run holds several pieces of the other run it takes as many.
4. Gaps are updated, and the next round begins. When no piece of the class fits any gap, pieces open sequences: range by
   range, where each is filled before the next one opens and the last one, still open, is given up again; in the end, for
   the few pieces that this leaves, as many of the longest open one each as their tokens fill at least.

Equal sizes are parted by number, so a length that a third of all pieces have spreads over ranges. There are as many ranges as the
round's rows need, at most one a shuffle partition. Every round is a written
table; the driver sees three figures a range. A gap is all that is kept of a sequence: its next piece starts at capacity less gap.

Defined results: a null or empty text is the end id alone; null and repeated doc_ids are documents of their own; a document
longer than `capacity` has a shorter first piece unless its length divides evenly; an empty table gives no rows; other columns
play no part. Ties are broken by the pieces' numbers. Sequence numbers mean nothing beyond being equal or not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import vocab
from newsloom.llm.common import bound_batches, discard, steps, written
from newsloom.llm.token_store import library_codec

#: Lengths over these shares of the capacity make the classes.
CLASSES = (1 / 2, 1 / 4, 1 / 8, 1 / 32, 0)
PIECES = "n long, doc_id long, piece int, start long, length int, ids_crc32 long"
PLACED = "n long, sequence_id long, offset int"
GAP, PIECE = 0, 1
#: Pieces and gaps of a range, about, as long as this makes no more ranges than the session has shuffle partitions.
RANGE_ROWS = 20_000
#: A swept row: of a piece its sequence and offset, if it has one; rank: the place among the range's left-over pieces or gaps.
SWEPT = "part int, kind int, id long, size int, sequence_id long, offset int, rank long"


def cut(docs: DataFrame, json_path: str, pattern: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every row of docs (doc_id, text), numbered, each with the checksum of its ids."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab.read_bytes(json_path))
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        codec = library_codec(sent.value, pattern)
        for batch in batches:
            for part in steps(batch, "text"):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), codec.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    stop = (len(ids) // 4 - 1) % capacity + 1
                    start = piece = 0
                    while start < len(ids) // 4:
                        rows.append((number, doc_id, piece, start, stop - start, zlib.crc32(memoryview(ids)[4 * start : 4 * stop])))
                        number, start, stop, piece = number + 1, stop, stop + capacity, piece + 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class _Gaps:
    """Gaps by size; a mask of the sizes that there are finds the smallest one that holds a piece."""

    def __init__(self):
        self.by_size: dict[int, list[int]] = {}
        self.mask = 0

    def add(self, sequence: int, size: int) -> None:
        if size:
            self.by_size.setdefault(size, []).append(sequence)
            self.mask |= 1 << size

    def take(self, least: int) -> tuple[int, int] | None:
        above = self.mask >> least
        if not above:
            return None
        size = least + (above & -above).bit_length() - 1
        held = self.by_size[size]
        sequence = held.pop()
        if not held:
            self.mask ^= 1 << size
        return sequence, size


def _fill(rows: Iterator[tuple[int, int, int]], capacity: int, open_own: bool) -> tuple[list, list, list, int]:
    """One range in descending order. Placed pieces (id, size, sequence, offset), pieces left over (id, size), gaps, the range's least size.

    open_own: a piece that fits no gap opens a sequence; the one opened last is given up, and its pieces are left over."""
    gaps, placed, left, least, last = _Gaps(), [], [], capacity, None
    for kind, number, size in rows:
        least = size
        if kind == GAP:
            gaps.add(number, size)
            continue
        found = gaps.take(size)
        if found is None and open_own:
            found = last = number, capacity
        if found is None:
            left.append((number, size))
        else:
            placed.append((number, size, found[0], capacity - found[1]))
            gaps.add(found[0], found[1] - size)
    if last:
        left += [p[:2] for p in placed if p[2] == last[0]]
        placed = [p for p in placed if p[2] != last[0]]
    rest = [(sequence, size) for size in sorted(gaps.by_size) for sequence in gaps.by_size[size] if not last or sequence != last[0]]
    return placed, left, rest, least


def _ranges(rows: int, most: int) -> int:
    """Ranges for rows pieces and gaps: as many as hold RANGE_ROWS, since a task costs more than a range of a few rows."""
    return max(1, min(most, -(-rows // RANGE_ROWS)))


def _sweep(pieces: DataFrame, gaps: DataFrame, capacity: int, rows: int, open_own: bool = False) -> DataFrame:
    """Steps 1 and 2, or the opening of step 4, over pieces (id, size) and gaps (id, size), `rows` of them."""
    both = gaps.select(F.lit(GAP).alias("kind"), "id", "size").unionByName(pieces.select(F.lit(PIECE).alias("kind"), "id", "size"))
    order = [F.desc("size"), F.col("kind"), F.col("id")]
    parts = _ranges(rows, int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        placed, left, rest, least = _fill(rows, capacity, open_own)
        made = [(part, PIECE, n, size, sequence, offset, None) for n, size, sequence, offset in placed]
        made += [(part, PIECE, n, size, None, None, rank) for rank, (n, size) in enumerate(left)]
        small = sum(size < least for _, size in rest)  # such gaps need not hold what later ranges have left
        made += [(part, GAP, n, size, None, None, rank - small if rank >= small else None) for rank, (n, size) in enumerate(rest)]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        for at in range(0, len(made), 50_000):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made[at : at + 50_000], strict=True), types, strict=True)], names=[c.split()[0] for c in SWEPT.split(", ")])

    return written(both.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, SWEPT), "sweep")


class Run(NamedTuple):
    """Left-over rows of a range from rank `first` on, before rank `stop`: `each` of them to a match, numbered from `match` on."""

    part: int
    kind: int
    first: int
    stop: int
    each: int
    match: int


def across(ranges: list[tuple[int, int, int, int, int]]) -> list[Run]:
    """Step 3 over (range, pieces left, longest of them, gaps left, least of them), in order of size, descending."""
    runs, stack, match = [], [], 0
    for part, pieces, longest, gaps, least in sorted(ranges):
        done = 0
        while done < pieces and stack:
            above, taken, held, size = stack[-1]
            each = size // longest
            matches = min(held - taken, -(-(pieces - done) // each))
            stop = min(pieces, done + matches * each)
            runs += [Run(part, PIECE, done, stop, each, match), Run(above, GAP, taken, taken + matches, 1, match)]
            match, done = match + matches, stop
            stack[-1] = (above, taken + matches, held, size)
            if taken + matches == held:
                stack.pop()
        if gaps:
            stack.append((part, 0, gaps, least))
    return runs


def _linked(swept: DataFrame, runs: list[Run], capacity: int) -> DataFrame:
    """The rows of swept; pieces that runs match have their places, gaps what remains of them."""
    spark = swept.sparkSession
    few = F.broadcast(spark.createDataFrame(runs, "r_part int, r_kind int, r_first long, r_stop long, r_each long, r_match long"))  # two rows a step of the stack: four a range at most
    hit = (F.col("part") == F.col("r_part")) & (F.col("kind") == F.col("r_kind")) & (F.col("rank") >= F.col("r_first")) & (F.col("rank") < F.col("r_stop"))
    # the join is on range and kind; a range has as many rows of few as it meets other ranges
    both = swept.join(few, hit, "left").withColumn("match", F.col("r_match") + F.floor((F.col("rank") - F.col("r_first")) / F.col("r_each")))
    whole = Window.partitionBy("match")
    before = whole.orderBy("kind", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.when(F.col("kind") == PIECE, F.col("size"))
    met = both.where("match is not null").withColumns({"gap": F.first("size").over(before), "sequence": F.first("id").over(before), "so_far": F.coalesce(F.sum(length).over(before), F.lit(0)), "all": F.coalesce(F.sum(length).over(whole), F.lit(0))})
    is_gap = F.col("kind") == GAP
    linked = met.select(
        "kind", "id", F.when(is_gap, F.col("gap") - F.col("all")).otherwise(F.col("size")).cast("int").alias("size"),
        F.when(~is_gap, F.col("sequence")).alias("sequence_id"), F.when(~is_gap, capacity - F.col("gap") + F.col("so_far") - F.col("size")).cast("int").alias("offset"),
    )
    return both.where("match is null").select(linked.columns).unionByName(linked)


class _State:
    """Pieces (id, size) not placed, gaps (id, size), and the tables that hold the placed ones."""

    def __init__(self, spark: SparkSession, pieces: DataFrame, capacity: int):
        self.spark, self.capacity = spark, capacity
        self.pieces, self.gaps = pieces, spark.createDataFrame([], "id long, size int")
        self.placed, self.made = [spark.createDataFrame([], PLACED)], []

    def settle(self, rows: DataFrame, pieces: DataFrame, gaps: DataFrame) -> None:
        """The state after a round that gave rows; pieces and gaps are those that took no part."""
        idle = pieces.select(F.lit(PIECE).alias("kind"), "id", "size").unionByName(gaps.select(F.lit(GAP).alias("kind"), "id", "size"))
        made = written(rows.select("kind", "id", "size", "sequence_id", "offset").unionByName(idle, allowMissingColumns=True), "round")
        self.made.append(made)
        self.placed.append(made.where(f"kind = {PIECE} and sequence_id is not null").select(F.col("id").alias("n"), "sequence_id", "offset"))
        self.pieces = made.where(f"kind = {PIECE} and sequence_id is null").select("id", "size")
        self.gaps = made.where(f"kind = {GAP} and size > 0").select("id", "size")

    def sweep(self, over: int, rows: int, open_own: bool = False) -> DataFrame:
        swept = _sweep(self.pieces.where(f"size > {over}"), self.gaps.where(f"size > {over}" if not open_own else "false"), self.capacity, rows, open_own)
        self.made.append(swept)
        return swept

    def match(self, over: int) -> None:
        """Rounds over the pieces longer than `over`, until none of them fits a gap."""
        while True:
            size = lambda kind, f: f(F.when((F.col("kind") == kind) & (F.col("size") > over), F.col("size")))
            both = self.pieces.select(F.lit(PIECE).alias("kind"), "size").unionByName(self.gaps.select(F.lit(GAP).alias("kind"), "size"))
            seen = both.agg(size(PIECE, F.min).alias("piece"), size(GAP, F.max).alias("gap"), F.count_if(F.col("size") > over).alias("rows")).first()
            if seen["piece"] is None or seen["gap"] is None or seen["piece"] > seen["gap"]:
                return
            swept, left = self.sweep(over, seen["rows"]), F.col("rank").isNotNull()
            of = lambda kind: left & (F.col("kind") == kind)
            figures = swept.groupBy("part").agg(F.count_if(of(PIECE)), F.max(F.when(of(PIECE), F.col("size"))), F.count_if(of(GAP)), F.min(F.when(of(GAP), F.col("size")))).collect()  # a row a range
            runs = across([tuple(x or 0 for x in row) for row in figures])
            rows = _linked(swept, runs, self.capacity) if runs else swept
            self.settle(rows, self.pieces.where(f"size <= {over}"), self.gaps.where(f"size <= {over}"))

    def open_each(self, chosen: DataFrame, rest: DataFrame) -> None:
        """Each of the chosen pieces opens a sequence."""
        own = chosen.select(F.lit(PIECE).alias("kind"), "id", "size", F.col("id").alias("sequence_id"), F.lit(0).alias("offset"))
        gaps = chosen.select(F.lit(GAP).alias("kind"), "id", (self.capacity - F.col("size")).cast("int").alias("size"), F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("int").alias("offset"))
        self.settle(own.unionByName(gaps), rest, self.gaps)

    def open_full(self, over: int) -> None:
        """Sequences for the pieces longer than `over`, filled range by range."""
        if rows := self.pieces.where(f"size > {over}").count():
            self.settle(self.sweep(over, rows, open_own=True), self.pieces.where(f"size <= {over}"), self.gaps)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """n, sequence_id, offset of every row of pieces (n, length), whose n are unique."""
    full = pieces.where(F.col("length") >= capacity).select("n", F.col("n").alias("sequence_id"), F.lit(0).alias("offset"))
    state = _State(pieces.sparkSession, pieces.where(F.col("length") < capacity).select(F.col("n").alias("id"), F.col("length").alias("size")), capacity)
    for share in CLASSES:
        over = int(capacity * share)
        if share >= 1 / 2:  # no two of these fit together
            state.open_each(state.pieces.where(f"size > {over}"), state.pieces.where(f"size <= {over}"))
            continue
        state.match(over)
        state.open_full(over)
    while True:
        state.match(0)
        tokens = state.pieces.agg(F.sum("size").alias("s")).first()["s"]
        if not tokens:
            break
        # a range leaves less than two sequences' tokens, so these are no more than twice the ranges
        longest = state.pieces.orderBy(F.desc("size"), "id").limit(-(-tokens // capacity)).withColumn("_opens", F.lit(True)).select("id", "_opens")
        marked = written(state.pieces.join(F.broadcast(longest), "id", "left"), "opening")
        state.made.append(marked)
        state.open_each(marked.where("_opens").select("id", "size"), marked.where("_opens is null").select("id", "size"))
    result = full
    for table in state.placed:
        result = result.unionByName(table)
    made = written(result, "places")
    discard(*state.made)
    return made


def pack_documents(docs: DataFrame, json_path: str, pattern: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    pieces = written(cut(docs, json_path, pattern, end_id, capacity), "pieces")
    places = pack(pieces.select("n", "length"), capacity)
    return pieces.join(places, "n").select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
