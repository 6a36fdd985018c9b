"""SimHash near-duplicates, linked by anchor-point covering.

Fingerprints: 64 bits, each 1 if set in over half of the XXH64 values of a text's four-word shingles.

Links: the 64 bits are cut into three blocks, so two fingerprints that differ in at most 4 bits differ in at
most one bit of some block. In each block the anchors are a covering code of radius 1: a perfect Hamming
code on its first 15 bits, with the other bits free. A fingerprint is replicated to every anchor within the
covering radius plus the block's threshold, 2: the anchor nearest to one of a linked pair is then within
reach of the other, and no pair is missed. That is about 45 replicas of 16 bytes for each distinct
fingerprint. Fingerprints are compared at each anchor, over all 64 bits; equal fingerprints are one before
that, and an anchor passes on at most one link a member, to the least one of its group there.

Defined results: a text without words (null, empty, white space) has fingerprint zero, linked like any
other; a text of one to three words is one shingle; repeated rows and doc_ids are judged row by row; a null
doc_id takes part but never names a component (a component of such rows alone has none); an empty table
gives no rows; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import discard, map_rows, written
from newsloom.llm.components import components

WORDS, BITS, NEAR, SEED = 4, 64, 4, 42
#: The blocks' places and widths; with at most NEAR bits that differ, one block has at most NEAR // len(BLOCKS).
BLOCKS = ((0, 22), (22, 21), (43, 21))
HAMMING = 15
#: Above this many fingerprints at an anchor its groups are grown one member at a time instead of by all shifts.
WIDE = 128
_word = re.compile(rb"[^\x20\x09-\x0D]+").findall
_lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """XXH64 values of a text's shingles of `width` words; a shorter text is one shingle, one without words none."""
    words = _word((text or "").encode("utf-8", "surrogatepass").translate(_lower))
    if not words:
        return np.array([], "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(width, len(words)) - 1
    cuts = map(slice, starts[: len(words) - last].tolist(), ends[last:].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in map(joined.__getitem__, cuts)], "<u8")


def fingerprint(text: str | None) -> int:
    h = shingles(text)
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every row of docs (doc_id, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.record_batch([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return map_rows(docs.select("doc_id", "text"), "text", "doc_id long, fp long", work)


def _syndrome(x: int) -> int:
    """Of the Hamming code whose column at place i is i + 1."""
    s = 0
    for i in range(HAMMING):
        s ^= (i + 1) * (x >> i & 1)
    return s


def anchor_offsets(width: int, reach: int) -> list[np.ndarray]:
    """For each syndrome of a point's Hamming part, what to XOR it with to get every anchor within reach."""
    out: list[list[int]] = [[] for _ in range(HAMMING + 1)]
    for weight in range(reach + 1):
        for places in combinations(range(width), weight):
            offset = sum(1 << p for p in places)
            out[_syndrome(offset & ((1 << HAMMING) - 1))].append(offset)
    return [np.array(x, np.uint64) for x in out]


def replicas(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor (block number above the block's bits) and fingerprint of every replica."""
    syndromes = np.array([_syndrome(x) for x in range(1 << HAMMING)], np.int64)
    anchors, whose = [], []
    for number, (place, width) in enumerate(BLOCKS):
        part = fps >> np.uint64(place) & np.uint64((1 << width) - 1)
        s = syndromes[(part & np.uint64((1 << HAMMING) - 1)).astype(np.int64)]
        for value, offsets in enumerate(anchor_offsets(width, reach)):
            own = np.flatnonzero(s == value)
            if len(own) and len(offsets):
                anchors.append((part[own][:, None] ^ offsets[None, :]).ravel() | np.uint64(number << 32))
                whose.append(np.repeat(fps[own], len(offsets)))
    return np.concatenate(anchors), np.concatenate(whose)


def _grow(fps: np.ndarray, near: int) -> np.ndarray:
    """Each one's group number (place of a member): groups grow from a seed over those not yet taken."""
    group, left = np.full(len(fps), -1), np.arange(len(fps))
    while len(left):
        seed, left = left[0], left[1:]
        group[seed], front = seed, [seed]
        while front and len(left):
            close = np.bitwise_count(fps[left] ^ fps[front.pop()]) <= near
            taken, left = left[close], left[~close]
            group[taken] = seed
            front.extend(taken.tolist())
    return group


def _linked(anchors: np.ndarray, fps: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least fingerprint of its group at the anchor) of rows sorted by anchor."""
    n = len(anchors)
    starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    sizes = np.diff(np.append(starts, n))
    label = np.arange(n)
    for start, size in zip(starts[sizes > WIDE].tolist(), sizes[sizes > WIDE].tolist(), strict=True):
        label[start : start + size] = start + _grow(fps[start : start + size], near)
    narrow = np.flatnonzero(np.repeat(sizes <= WIDE, sizes))
    a, f = anchors[narrow], fps[narrow]
    pairs = []
    for shift in range(1, WIDE):
        same = np.flatnonzero(a[shift:] == a[:-shift]) if len(a) > shift else ()
        if not len(same):
            break
        close = same[np.bitwise_count(f[same] ^ f[same + shift]) <= near]
        pairs.append(np.stack([narrow[close], narrow[close + shift]]))
    if pairs:
        x, y = np.concatenate(pairs, axis=1)
        while True:
            low = np.minimum(label[x], label[y])
            before = label.copy()
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            label = label[label]
            if np.array_equal(before, label):
                break
    least = fps.copy()
    np.minimum.at(least, label, fps)
    least = least[label]
    moved = least != fps
    return fps[moved], least[moved]


def links(classes: DataFrame, near: int = NEAR) -> DataFrame:
    """a, b: enough links between the distinct fingerprints of classes (fp) to join all that are within `near` bits."""
    reach = 1 + near // len(BLOCKS)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 4096):
                anchors, whose = replicas(fps[i : i + 4096], reach)
                yield pa.record_batch([pa.array(anchors.view(np.int64)), pa.array(whose.view(np.int64))], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, fps = np.array([], np.int64), np.array([], np.uint64)

        def out(n: int) -> pa.RecordBatch:
            both = np.unique(np.stack(_linked(anchors[:n], fps[:n], near), axis=1), axis=0)
            return pa.record_batch([pa.array(both[:, i].copy().view(np.int64)) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            more = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            anchors, fps = np.concatenate([anchors, more[0]]), np.concatenate([fps, more[1].view(np.uint64)])
            whole = int(np.searchsorted(anchors, anchors[-1])) if len(anchors) else 0  # the last anchor may go on in the next batch
            if whole >= 1 << 15:
                yield out(whole)
                anchors, fps = anchors[whole:], fps[whole:]
        if len(anchors):
            yield out(len(anchors))

    dealt = classes.select("fp").mapInArrow(spread, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (least doc_id reachable by links) of every row of docs (doc_id, text)."""
    made = written(fingerprints(docs), "simhash")
    classes = written(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes, near))
    rooted = written(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = written(rooted.join(least, "root").select("fp", "component_id"), "named")
    discard(classes, rooted, least)
    return made.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
