"""Near duplicates by SimHash and anchor-point covering, confirmed by the exact Jaccard similarity of shingles.

1. A text is the set of the XXH64 values of its five-word shingles; equal sets are one class from there on.
   Its fingerprint has WORDS * 64 bits, each 1 if set in over half of the shingles' values (bits beyond the
   first 64 are those of mixed values). Sets of similarity 0.8 differ in about 15 % of the bits.
2. Anchors: every table takes 46 bits of the fingerprint as two blocks of 23. A block's anchors are the words of
   the perfect Golay code, a covering code of radius 3. A class is replicated to every pair of anchors of which
   each lies within the covering radius plus the block's threshold, 1: 28 replicas of 20 bytes a table. Two
   classes that differ in at most one bit of each block meet for certain, and at 15 % in one table of three.
3. Classes are compared at each anchor by 64 bits that no table uses; those within NEAR bits are candidates. A
   dense anchor, one with more candidates than members, first passes on only each member's pair with one leader.
4. Candidates that are near in all bits are compared as sets: those of similarity `least` or more are linked, and
   components of the links are the groups. At dense anchors, all near pairs that are in different groups by then
   are compared in a second turn, in blocks of members, which passes on links only; so a large group of copies is
   joined without making its pairs.

Of the links of similarity 0.8 or more, 0.89 are found at 0.8 itself and 0.98 at 0.87 (`TABLES` is the parameter for
more); groups miss less, as texts have several links. Links that are made are exact but for hash collisions.

Defined results: texts without words (null, empty, white space) are one group; a text of fewer than five words
is one shingle; repeated rows and doc_ids are judged row by row; a null doc_id takes part but never names a
group (a group of such rows alone has none); an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import discard, map_rows, written
from newsloom.llm.components import components
from newsloom.llm.simhash import SEED, shingles

WIDTH, LEAST = 5, 0.8
#: 64-bit words of a fingerprint: the first is compared at anchors, the others give the tables' bits.
WORDS, TABLES = 5, 5
#: The Golay code's length, its check bits, covering radius and generator polynomial.
GOLAY, CHECKS, RADIUS, GENERATOR = 23, 11, 3, 0b101011100011
REACH = RADIUS + 1
#: Bits in which candidates may differ: of the first word, and of all words.
NEAR, NEAR_ALL = 20, 62
#: An anchor is dense if it has more candidates than members; with more than LEADING members it names leaders.
LEADING = 24
#: Members compared at once, and members of a block of a dense anchor.
ROWS, BLOCK = 2048, 512
_AT_ONCE = 4096


def needed(n, least: float):
    """The least overlap of a set of n with one that is similar; a hair low, so that rounding loses nothing."""
    return np.ceil(least * n - 1e-9).astype(np.int64)


def _mixed(x: np.ndarray, turn: int) -> np.ndarray:
    """Another 64-bit value of each hash, for every turn."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """WORDS words of the set's fingerprint."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(own), 255):  # few enough for sums in a byte
        part = own[i : i + 255]
        values = np.stack([part, *(_mixed(part, k) for k in range(1, WORDS))], axis=1)
        ones += np.add.reduce(np.unpackbits(values.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(own), bitorder="little").view("<u8")


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, class, n, fp (its words as bytes) and hashes (sorted, their low 32 bits) of every row of docs (doc_id, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes, fps, low = [], [], [], []
        for text in batch.column(1).to_pylist():
            own = np.unique(shingles(text, width))
            keys.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
            sizes.append(len(own))
            fps.append(wide_fingerprint(own).tobytes())
            low.append(np.unique(own.astype("<u4")).tobytes())
        classes = pa.array(np.array(keys, np.uint64).view(np.int64))
        return pa.record_batch([batch.column(0), classes, pa.array(sizes, pa.int32()), pa.array(fps, pa.binary()), pa.array(low, pa.binary())], names=["doc_id", "class", "n", "fp", "hashes"])

    return map_rows(docs.select("doc_id", "text"), "text", "doc_id long, class long, n int, fp binary, hashes binary", work)


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of every block, and for each syndrome the offsets of weight REACH or less (-1 behind the last)."""
    columns = []
    for place in range(GOLAY):
        value = 1 << place
        for bit in range(GOLAY - 1, CHECKS - 1, -1):
            if value >> bit & 1:
                value ^= GENERATOR << bit - CHECKS
        columns.append(value)
    syndromes = np.zeros(1 << GOLAY, np.uint16)
    for place, column in enumerate(columns):
        syndromes[1 << place : 2 << place] = syndromes[: 1 << place] ^ column
    found: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(REACH + 1):
        for places in combinations(range(GOLAY), weight):
            offset = sum(1 << p for p in places)
            found[syndromes[offset]].append(offset)
    offsets = np.full((1 << CHECKS, max(map(len, found))), -1, np.int32)
    for syndrome, own in enumerate(found):
        offsets[syndrome, : len(own)] = own
    return syndromes, offsets


def _anchors(block: np.ndarray) -> np.ndarray:
    """The anchors within reach of each block, by the upper bits, which tell code words apart; -1 behind the last."""
    syndromes, offsets = _golay()
    own = offsets[syndromes[block]]
    return np.where(own < 0, -1, (block[:, None] ^ own) >> CHECKS)


def replicas(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Table by table: anchors (the table's number above two code words) and the row of fps that each replica is of."""
    bits = np.unpackbits(fps[:, 1:].copy().view(np.uint8), axis=1, bitorder="little")
    powers = 1 << np.arange(GOLAY, dtype=np.int64)
    for table in range(TABLES):
        place = 2 * GOLAY * table
        a, b = (_anchors(bits[:, at : at + GOLAY] @ powers) for at in (place, place + GOLAY))
        both = table << 24 | a[:, :, None] << 12 | b[:, None, :]
        row, i, j = np.nonzero((a >= 0)[:, :, None] & (b >= 0)[:, None, :])
        yield both[row, i, j].astype(np.int32), row


def _leaders(fps: np.ndarray) -> np.ndarray:
    """Each one's leader: the first of those before it that is near and led by itself."""
    leader, left = np.arange(len(fps)), np.arange(len(fps))
    while len(left):
        near = np.bitwise_count(fps[left] ^ fps[left[0]]) <= NEAR
        leader[left[near]] = left[0]
        left = left[~near]
    return leader


def _near_pairs(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x < y of near ones, some rows at a time."""
    for i in range(0, len(fps), ROWS):
        for j in range(i, len(fps), ROWS):
            x, y = np.nonzero(np.bitwise_count(fps[i : i + ROWS, None] ^ fps[None, j : j + ROWS]) <= NEAR)
            x, y = x + i, y + j
            later = x < y
            yield x[later], y[later]


MET = "anchor int, a long, b long"


def _batch(anchors, a, b) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.asarray(x, k)) for x, k in ((anchors, np.int32), (a, np.int64), (b, np.int64))], names=["anchor", "a", "b"])


def _compared(anchors: np.ndarray, classes: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor: candidates (anchor -1, a, b), and members of dense anchors (anchor, class, class)."""
    starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    sizes = np.diff(np.append(starts, len(anchors)))
    number = np.repeat(np.arange(len(starts)), sizes)
    few = np.flatnonzero(sizes[number] <= LEADING)
    left, right = [np.array([], np.int64)], [np.array([], np.int64)]
    for shift in range(1, LEADING):
        same = np.flatnonzero(number[few[shift:]] == number[few[:-shift]]) if len(few) > shift else ()
        if not len(same):
            break
        x, y = few[same], few[same + shift]
        near = np.bitwise_count(fps[x] ^ fps[y]) <= NEAR
        left.append(x[near])
        right.append(y[near])
    x, y = np.concatenate(left), np.concatenate(right)
    dense = np.bincount(number[x], minlength=len(starts)) > sizes
    left, right = [x[~dense[number[x]]]], [y[~dense[number[x]]]]
    for k in np.flatnonzero(sizes > LEADING).tolist():
        members = np.arange(starts[k], starts[k] + sizes[k])
        if sizes[k] <= ROWS:
            x, y = next(_near_pairs(fps[members]))
            if len(x) <= sizes[k]:
                left.append(members[x])
                right.append(members[y])
                continue
        dense[k] = True
        order = members[np.argsort(_mixed(classes[members].view(np.uint64), WORDS), kind="stable")]  # alike at all anchors
        leader = _leaders(fps[order])
        led = leader != np.arange(sizes[k])
        left.append(order[led])
        right.append(order[leader[led]])
    open_ = dense[number]
    if open_.any():
        yield _batch(anchors[open_], classes[open_], classes[open_])
    a, b = classes[np.concatenate(left)], classes[np.concatenate(right)]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
    yield _batch(np.full(len(pairs), -1), pairs[:, 0], pairs[:, 1])


def _by_anchor(batches: Iterator[pa.RecordBatch], work, least: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """work over rows sorted by their first column; rows of one anchor stay together."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        more = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = more if held is None else [np.concatenate([x, y]) for x, y in zip(held, more, strict=True)]
        whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last anchor may go on in the next batch
        if whole >= least:
            yield from work(*(x[:whole] for x in held))
            held = [x[whole:] for x in held]
    if held is not None and len(held[0]):
        yield from work(*held)


def meetings(classes: DataFrame) -> DataFrame:
    """anchor, a, b from classes (class, fp): see _compared."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, WORDS)
            for i in range(0, len(keys), _AT_ONCE):
                for anchors, row in replicas(fps[i : i + _AT_ONCE]):
                    yield pa.record_batch([pa.array(anchors), pa.array(keys[i + row]), pa.array(fps[i + row, 0].view(np.int64))], names=["anchor", "class", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_anchor(batches, lambda anchors, keys, fps: _compared(anchors, keys, fps.view(np.uint64)))

    dealt = classes.select("class", "fp").mapInArrow(spread, "anchor int, class long, fp long").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, MET)


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets, sorted, have the similarity."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    met = int((both[1:] == both[:-1]).sum())
    return met >= least * (len(both) - met) - 1e-9


def second_turn(members: DataFrame, links: DataFrame, made: DataFrame, least: float) -> DataFrame:
    """a, b: links of dense anchors' members (anchor, class) between groups that links have not joined.

    An anchor's members are dealt to blocks, and each pair of blocks is one unit of work."""
    roots = components(links).withColumnRenamed("node", "class")
    rooted = written(members.join(roots, "class", "left").select("anchor", "class", F.coalesce("root", "class").alias("root")), "dense")
    parted = rooted.groupBy("anchor").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y")
    parted = parted.select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class"), "blocks").cast("int").alias("own")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = rooted.join(parted, "anchor").select("anchor", "class", "root", "blocks", own).select("*", other)
    unit = F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")).alias("unit")
    wanted = written(dealt.select(unit, "anchor", "class", "root", "own", "other"), "units")
    sets = made.select("class", "fp", "hashes").join(wanted.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.any_value("fp").alias("fp"), F.any_value("hashes").alias("hashes"))
    sets = written(sets, "sets")
    rows = wanted.join(sets, "class").select("unit", "own", "other", "class", "root", "fp", "hashes")

    def work(units: np.ndarray, own: np.ndarray, other: np.ndarray, keys: np.ndarray, roots: np.ndarray, data: np.ndarray, sets: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps = np.frombuffer(b"".join(data), "<u8").reshape(-1, WORDS)
        starts = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]]))
        found: list[tuple[int, int]] = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(units)], strict=True):
            joined: dict[int, int] = {}

            def root_of(r: int) -> int:
                while r in joined:
                    r = joined[r]
                return r

            for x, y in _near_pairs(fps[start:end, 0]):
                x, y = x + start, y + start
                parted = (roots[x] != roots[y]) & ((own[x] != own[y]) | (own[x] == other[x]))  # a block's own pairs are of one unit only
                x, y = x[parted], y[parted]
                near = np.bitwise_count(fps[x] ^ fps[y]).sum(axis=1)
                order = np.argsort(near, kind="stable")[: int((near <= NEAR_ALL).sum())]
                for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
                    a, b = root_of(int(roots[i])), root_of(int(roots[j]))
                    if a != b and _alike(np.frombuffer(sets[i], "<u4"), np.frombuffer(sets[j], "<u4"), least):
                        joined[a] = b
                        found.append((int(keys[i]), int(keys[j])))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_anchor(batches, work, 1 << 10)

    found = written(rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, "a long, b long").distinct(), "second")
    discard(rooted, wanted, sets)
    return found


def similar(pairs: DataFrame, made: DataFrame, least: float) -> DataFrame:
    """a, b: those of pairs (a, b; repeats allowed) whose sets have the similarity."""
    a, b = (made.groupBy(F.col("class").alias(s)).agg(F.any_value("n").alias(f"n{s}"), F.any_value("fp").alias(f"f{s}")) for s in ("a", "b"))
    both = pairs.distinct().join(a, "a").join(b, "b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            fa, fb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u8").reshape(-1, WORDS) for i in (4, 5))
            good = (np.bitwise_count(fa ^ fb).sum(axis=1) <= NEAR_ALL) & (np.minimum(na, nb) >= needed(np.maximum(na, nb), least))
            yield batch.select(["a", "b"]).filter(pa.array(good))

    near = written(both.select("a", "b", "na", "nb", "fa", "fb").mapInArrow(close, "a long, b long"), "near")
    wanted = near.select(F.col("a").alias("class")).unionByName(near.select(F.col("b").alias("class"))).distinct()
    sets = written(made.select("class", "hashes").join(wanted, "class", "left_semi").groupBy("class").agg(F.any_value("hashes").alias("h")), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_alike(*(np.frombuffer(v.as_buffer(), "<u4") for v in pair), least) for pair in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def side(name: str) -> list[Column]:
        return [F.col("class").alias(name), F.col("h").alias(f"h{name}")]

    pairs = near.join(sets.select(side("a")), "a").join(sets.select(side("b")), "b").select("a", "b", "ha", "hb")
    found = written(pairs.mapInArrow(compare, "a long, b long"), "similar")
    discard(near, sets)
    return found


def groups(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """doc_id, component_id (least doc_id reachable by links) of every row of docs (doc_id, text)."""
    made = written(sketches(docs, width), "shingles")
    classes = made.where("n > 0").groupBy("class").agg(F.any_value("fp").alias("fp"))
    met = written(meetings(classes), "meetings")
    links = similar(met.where("anchor < 0").select("a", "b"), made, least)
    members = met.where("anchor >= 0").select("anchor", F.col("a").alias("class"))
    links = links.unionByName(second_turn(members, links, made, least))
    roots = components(links)
    rows = made.select("doc_id", "class").join(roots.withColumnRenamed("node", "class"), "class", "left").select("doc_id", F.coalesce("root", "class").alias("root"))
    rows = written(rows, "rooted")
    discard(made, met)
    least_ids = written(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(least_ids, "root").select("doc_id", "component_id")
