"""Benchmark decontamination by latent semantic retrieval.

1. Texts become codes of the benchmark's words (other words are -1), written once as a table; all later
   passes read codes. The vocabulary is the benchmark's, so it is bounded by the benchmark block in hand.
2. Passages of PASSAGE words are weighted by TF-IDF, with document frequencies counted over all passages;
   words that are in more than a tenth of them weigh nothing.
   A randomised range finder (one Gaussian projection, summed over all passages by tasks in two levels)
   gives the leading singular values and vectors of the passage matrix by the Nystrom formula.
3. Every text is covered by windows at a stride of SEGMENT words, each item having windows just long enough
   to hold it at any place. Windows and items are compared by cosine in the latent space, each axis scaled
   by its singular value. Pairs of at least `cosine` are candidates. With a cosine of None the latent space is
   not asked: windows that hold `likely` of the item's words, in any order, are candidates, of which a common
   subsequence has no more; this loses nothing and compares every word with every item.
4. A candidate's longest common subsequence with the item, in stretches of 1.25 times the item's length,
   decides: at least `sure` of the item's words is a leak; at least `likely` is one (a paraphrase) if the
   item's answer is there too. The answer is the item's `answer` column if the benchmark has one, else its
   last quarter.

Benchmarks are taken in blocks of `block_items` items, each block against all texts.

Defined results: null or empty texts and items match nothing; words are lower-cased runs of letters, figures
and underscores; repeated rows are
judged row by row; an empty table on either side gives no rows; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import map_rows, written

PASSAGE, SEGMENT = 64, 16
RANK, EXTRA, SEED = 128, 16, 7
#: Words that one step inside a task turns into vectors, words of a stream that is searched at once (both so that the
#: vectors stay in the processor's cache), and terms in a row of summed matrices.
STEP, STREAM, ROWS = 1 << 13, 1 << 13, 256
SALTS = 16
#: The cosine that makes a window a candidate.
COSINE = 0.2
#: Words in more than this share of the passages weigh nothing, unless an item would keep fewer words than LEAST_WORDS.
COMMON, LEAST_WORDS = 0.1, 8
_words = re.compile(r"\w+").findall
_latin = bytes(b if chr(b).isalnum() or chr(b) == "_" else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, figures and underscores, in Latin-1 if the text allows it, else in UTF-8 behind a zero byte."""
    text = (text or "").lower()
    try:
        return text.encode("latin-1").translate(_latin).split()
    except UnicodeEncodeError:
        return [_spelled(w) for w in _words(text)]


def _spelled(word: str) -> bytes:
    try:
        return word.encode("latin-1")
    except UnicodeEncodeError:
        return b"\0" + word.encode("utf-8", "surrogatepass")


class _Codes(dict):
    """Codes of words; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Items:
    """A block of benchmark items as codes of their own vocabulary."""

    ids: list
    vocabulary: dict[bytes, int]
    codes: list[np.ndarray]
    answers: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        """rows: item_id, text, answer or None."""
        cut = [(i, words_of(t), words_of(a)) for i, t, a in rows]
        cut = [x for x in cut if x[1]]
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, t, a in cut for w in (*t, *a)}))}
        code = lambda words: np.array([vocabulary[w] for w in words], np.int32)
        quarter = lambda t: t[-max(3, len(t) // 4) :]
        return cls([i for i, _, _ in cut], vocabulary, [code(t) for _, t, _ in cut], [code(a or quarter(t)) for _, t, a in cut])


@dataclass
class Latent:
    """Word vectors of the latent space and the items in it, by their windows' lengths in segments."""

    vectors: np.ndarray
    groups: dict[int, tuple[np.ndarray, np.ndarray]]


def code_texts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, codes (32-bit) of docs (doc_id, text), as a written table."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        look = _Codes(sent.value).__getitem__
        codes = [np.fromiter(map(look, words_of(text)), "<i4").tobytes() for text in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(codes, pa.binary())], names=["doc_id", "codes"])

    return written(map_rows(docs.select("doc_id", "text"), "text", "doc_id long, codes binary", work), "codes")


def _stretches(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Wanted words of many texts at a time: code and passage number (numbers start anew in each)."""
    wanted = np.append(wanted, False)  # the last, which code -1 takes, stands for unknown words
    for batch in batches:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = passages = 0
        for data in batch.column(1).to_pylist():
            whole = np.frombuffer(data, "<i4")
            for i in range(0, len(whole), STEP):  # a multiple of PASSAGE
                codes = whole[i : i + STEP]
                known = np.flatnonzero(wanted[codes])
                held.append((codes[known], passages + known // PASSAGE))
                passages += -(-len(codes) // PASSAGE)
                total += len(known)
                if total >= STEP:
                    yield np.concatenate([c for c, _ in held]), np.concatenate([p for _, p in held])
                    held, total, passages = [], 0, 0
        if total:
            yield np.concatenate([c for c, _ in held]), np.concatenate([p for _, p in held])


def weights(seen: np.ndarray, passages: int, items: Items) -> np.ndarray:
    """ln((1 + passages) / (1 + passages with the word)) + 1 by word; 0 for the common ones."""
    common = seen > COMMON * passages
    for codes in items.codes:
        if (~common[codes]).sum() < LEAST_WORDS:
            common[codes] = False
    return np.where(common, 0.0, np.log((1 + passages) / (1 + seen)) + 1)


def inverse_frequencies(coded: DataFrame, items: Items) -> np.ndarray:
    """Weights by word; counts over all passages."""
    size = len(items.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for codes, passages in _stretches(batches, np.ones(size, bool)):
            seen += np.bincount(np.unique(passages * size + codes) % size, minlength=size)
        known = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(known), pa.array(seen[known])], names=["term", "n"])

    passages = coded.agg(F.sum(F.ceil(F.octet_length("codes") / (4 * PASSAGE))).alias("n")).first()["n"] or 0
    out = np.zeros(size)
    for row in coded.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():  # a row a word of the benchmark
        out[row["term"]] = row["n"]
    return weights(out, passages, items)


def _add_up(parts: DataFrame) -> DataFrame:
    """Sums of matrices (block, salt, data), streamed through tasks: by block and salt first, then by block."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                more = np.frombuffer(data)
                held[block] = held[block] + more if block in held else more
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([0] * len(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "salt", "data"])

    schema = "block int, salt int, data binary"
    return parts.repartition("block", "salt").mapInArrow(add, schema).repartition("block").mapInArrow(add, schema)


def singular_vectors(coded: DataFrame, idf: np.ndarray, rank: int = RANK, extra: int = EXTRA, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (words by rank) and singular values of the TF-IDF passages.

    With A the passages, Y = A'A W for a Gaussian W; A'A is then about Y (W'Y)^-1 Y'. Y, words by rank, is all
    that the driver gets."""
    size, width = len(idf), min(len(idf), rank + extra)
    sent = coded.sparkSession.sparkContext.broadcast(idf.astype(np.float32))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = sent.value
        gauss = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)
        ahead, total = gauss * weight[:, None], np.zeros((size, width))
        for codes, passages in _stretches(batches, weight > 0):
            starts = np.flatnonzero(np.diff(passages, prepend=-1))
            rows = np.add.reduceat(ahead[codes], starts)
            place = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
            order = np.argsort(codes, kind="stable")
            firsts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            own = codes[order][firsts]
            total[own] += weight[own, None] * np.add.reduceat(rows[place[order]], firsts)
        blocks = range(0, size, ROWS)
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.record_batch([pa.array([b // ROWS for b in blocks], pa.int32()), pa.array([salt] * len(blocks), pa.int32()), pa.array([total[b : b + ROWS].tobytes() for b in blocks], pa.binary())], names=["block", "salt", "data"])

    parts = coded.mapInArrow(project, "block int, salt int, data binary")
    y = np.zeros((size, width))
    for row in _add_up(parts).toLocalIterator():
        y[row["block"] * ROWS : (row["block"] + 1) * ROWS] = np.frombuffer(row["data"]).reshape(-1, width)
    gauss = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32).astype(float)
    core = gauss.T @ y
    values, turn = np.linalg.eigh((core + core.T) / 2)
    values = np.maximum(values, max(values.max(), 1e-30) * 1e-10)
    vectors, scale, _ = np.linalg.svd(y @ (turn / np.sqrt(values)), full_matrices=False)
    return vectors[:, :rank], scale[:rank]


def fold_in(items: Items, idf: np.ndarray, vectors: np.ndarray, scale: np.ndarray) -> Latent:
    """Items in the latent space; words' vectors carry their weight. The last row stands for unknown words."""
    usable = scale > scale.max(initial=0) * 1e-6
    words = (idf[:, None] * vectors[:, usable] / scale[usable]).astype(np.float32)
    words = np.concatenate([words, np.zeros((1, words.shape[1]), np.float32)])
    groups: dict[int, list[int]] = {}
    for k, codes in enumerate(items.codes):
        groups.setdefault(-(-(len(codes) + SEGMENT - 1) // SEGMENT), []).append(k)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return Latent(words, {n: (np.array(own), unit(np.array([words[items.codes[k]].sum(axis=0) for k in own]))) for n, own in groups.items()})


def common_length(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of the item."""
    masks: dict[int, int] = {}
    for i, c in enumerate(item.tolist()):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for c in text.tolist():
        if c in masks:
            met = row & masks[c]
            row = ((row + met) | (row - met)) & full
    return len(item) - row.bit_count()


def stretch(item: np.ndarray) -> int:
    """Words of a text that are held against an item at a time."""
    return int(1.25 * len(item)) + 2


class Matcher:
    """Candidates and checks, inside tasks, over streams of texts with gaps that no window can bridge."""

    def __init__(self, items: Items, latent: Latent, cosine: float | None, likely: float, sure: float):
        self.items, self.latent = items, latent
        self.cosine, self.likely, self.sure = cosine, likely, sure
        self.place = np.full((len(items.ids), len(items.vocabulary) + 1), -1, np.int16 if max(map(len, items.codes), default=0) < 1 << 15 else np.int32)  # a word's place among an item's own words
        self.needed = np.array([likely * len(codes) - 1e-9 for codes in items.codes])
        self.counts = []
        for k, codes in enumerate(items.codes):
            own, n = np.unique(codes, return_counts=True)
            self.place[k, own] = np.arange(len(own))
            self.counts.append(n)
        self.heavy = (latent.vectors != 0).any(axis=1)
        self.member = self.place >= 0
        self.member_of = np.ascontiguousarray(self.member.T.astype(np.uint8))  # a row a word
        self.segments: dict[int, list[int]] = {}  # items by the segments that hold any stretch of theirs, wherever it starts
        for k, codes in enumerate(items.codes):
            self.segments.setdefault(-(-(stretch(codes) + SEGMENT - 1) // SEGMENT), []).append(k)
        self.axis = {int(k): (n, v) for n, (own, vectors) in latent.groups.items() for k, v in zip(own, vectors, strict=True)}
        self.gap = (max(*self.segments, *latent.groups) + 3) * SEGMENT

    @staticmethod
    def _runs(k: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of the same item in windows in a row begin and end: one candidate each."""
        starts = np.flatnonzero((np.diff(k, prepend=-1) != 0) | (np.diff(w, prepend=-2) != 1))
        return starts, np.append(starts[1:], len(k))[: len(starts)] - 1

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """Item, first and last word and best cosine of the windows of a stream, which starts and ends with gaps, that are close to the
        item, and that with a segment on either side hold words enough of it for the share asked for."""
        sums = np.zeros((len(codes) // SEGMENT, self.latent.vectors.shape[1]), np.float32)
        known = np.flatnonzero(self.heavy[codes])
        for i in range(0, len(known), STEP):
            some = known[i : i + STEP]
            at = some // SEGMENT
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            sums[at[starts]] += np.add.reduceat(self.latent.vectors[codes[some]], starts)
        windows, held = sums, 1
        cells = np.where(codes < 0, self.member.shape[1] - 1, codes).astype(np.int64)
        for n, (own, vectors) in sorted(self.latent.groups.items()):
            for i in range(held, n):
                windows = windows[: len(sums) - i] + sums[i:]
            held = n
            close = vectors @ windows.T
            close /= np.maximum(np.sqrt(np.einsum("ij,ij->i", windows, windows)), 1e-12)
            k, w = np.nonzero(close >= self.cosine)
            reach = np.arange(-SEGMENT, (n + 1) * SEGMENT)
            able = np.zeros(len(k), bool)
            for i in range(0, len(k), 4096):
                items, at = own[k[i : i + 4096]], w[i : i + 4096]
                # gaps at both ends, which are close to nothing, keep the reach within the stream; code -1 is a row's last cell
                around = np.take(cells, at[:, None] * SEGMENT + reach)
                around += (items * self.member.shape[1])[:, None]
                met = np.take(self.member, around).sum(axis=1, dtype=np.int32)
                able[i : i + 4096] = met >= self.needed[items]
            k, w = k[able], w[able]
            starts, ends = self._runs(k, w)
            if len(starts):
                best = np.maximum.reduceat(close[k, w], starts)
                for item, first, last, cosine in zip(own[k[starts]].tolist(), w[starts].tolist(), w[ends].tolist(), best.tolist(), strict=True):
                    yield item, first * SEGMENT, (last + n) * SEGMENT, cosine

    def all_candidates(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """The same of windows that hold words enough of the item for the share asked for: no less than any common
        subsequence inside them, so none is missed."""
        sums = np.zeros((len(codes) // SEGMENT + 1, len(self.items.ids)), np.int32)
        for i in range(0, len(sums) - 1, SEGMENT):
            some = codes[i * SEGMENT : min(i + SEGMENT, len(sums) - 1) * SEGMENT]
            sums[i + 1 : i + 1 + len(some) // SEGMENT] = self.member_of[some].reshape(-1, SEGMENT, sums.shape[1]).sum(axis=1, dtype=np.uint8)
        np.cumsum(sums, axis=0, out=sums)
        for n, own in sorted(self.segments.items()):
            held = sums[:, own]
            k, w = np.nonzero((held[n:] - held[:-n] >= self.needed[own]).T)
            starts, ends = self._runs(k, w)
            for item, first, last in zip(k[starts].tolist(), w[starts].tolist(), w[ends].tolist(), strict=True):
                first, last = first * SEGMENT, (last + n) * SEGMENT
                yield own[item], first, last, self.closeness(codes, own[item], first, last)

    def closeness(self, codes: np.ndarray, k: int, first: int, last: int) -> float:
        """The best cosine of the item with a window of a candidate."""
        n, vector = self.axis[k]
        sums = self.latent.vectors[codes[first:last]].reshape(-1, SEGMENT, len(vector)).sum(axis=1)
        windows = sum(sums[i : len(sums) - n + 1 + i] for i in range(n))
        return float((windows @ vector / np.maximum(np.linalg.norm(windows, axis=1), 1e-12)).max())

    def check(self, codes: np.ndarray, k: int, first: int, last: int) -> tuple[float, bool]:
        """The best share of the item in a stretch, and whether the answer is there."""
        item, answer, counts = self.items.codes[k], self.items.answers[k], self.counts[k]
        first = max(0, first - SEGMENT)
        around = codes[first : last + SEGMENT]
        need = self.needed[k]
        places = self.place[k, around]
        met = np.bincount(places[places >= 0], minlength=len(counts))
        if np.minimum(met, counts).sum() < need or common_length(item, around) < need:  # neither is less than a stretch's
            return 0.0, False
        length, stride = stretch(item), max(1, len(item) // 8)
        best, found = 0, False
        held = np.concatenate([[0], np.cumsum(places >= 0)])
        at = np.arange(0, max(1, len(around) - length + stride), stride)
        most = held[np.minimum(at + length, len(around))] - held[at]
        for at, most in zip(at[most >= need].tolist(), most[most >= need].tolist(), strict=True):
            if most <= best:
                continue
            got = common_length(item, around[at : at + length])
            if got > best:
                best = got
                found = common_length(answer, codes[first + at : first + at + length + SEGMENT]) >= self.likely * len(answer)
        return best / len(item), found

    def leaks(self, texts: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, float, float, bool]]:
        """Number of the text, item, cosine, share, answer found, of the best window of each; texts of a number stand together."""
        held: list[tuple[int, np.ndarray]] = []
        total = 0
        for number, codes in texts:
            for i in range(0, max(1, len(codes) - self.gap), STREAM):  # pieces of a long text overlap by a gap's length
                held.append((number, codes[i : i + STREAM + self.gap]))
                total += len(held[-1][1])
                if total >= STREAM:
                    yield from self._stream(held)
                    held, total = [], 0
        yield from self._stream(held)

    def _stream(self, held: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, float, float, bool]]:
        parts, offsets, at = [np.full(self.gap, -1, np.int32)], [], self.gap
        for _, codes in held:
            room = -(-len(codes) // SEGMENT) * SEGMENT - len(codes) + self.gap
            parts += [codes, np.full(room, -1, np.int32)]
            offsets.append(at)
            at += len(codes) + room
        stream = np.concatenate(parts)
        best: dict[tuple[int, int], tuple[float, float, bool]] = {}
        for k, first, last, cosine in self.candidates(stream) if self.cosine is not None else self.all_candidates(stream):
            share, found = self.check(stream, k, first, last)
            if share >= self.sure or share >= self.likely and found:
                number = held[int(np.searchsorted(offsets, last, side="left")) - 1][0]
                if share > best.get((number, k), (0.0, 0.0))[1]:
                    best[number, k] = cosine, share, found
        for (number, k), got in best.items():
            yield number, k, *got


SCHEMA = "doc_id long, item_id long, cosine double, share double, answer_found boolean"


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float | None = COSINE, likely: float = 0.6, sure: float = 0.8, block_items: int = 2000) -> DataFrame:
    """doc_id, item_id, cosine, share, answer_found of every row of docs (doc_id, text) that holds an item of benchmark (item_id, text)."""
    spark = docs.sparkSession
    found = None
    for items in _blocks(benchmark, block_items):
        block = _block_leaks(spark, docs, items, cosine, likely, sure)
        found = block if found is None else found.unionByName(block)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[Items]:
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows: list[tuple] = []
    for row in benchmark.where("item_id is not null").select("item_id", "text", answer.alias("answer")).orderBy("item_id", "text").toLocalIterator():
        rows.append(tuple(row))
        if len(rows) == block_items:
            yield Items.of(rows)
            rows = []
    if rows and (items := Items.of(rows)).ids:
        yield items


def _block_leaks(spark: SparkSession, docs: DataFrame, items: Items, cosine: float | None, likely: float, sure: float) -> DataFrame:
    coded = code_texts(docs, items.vocabulary)
    idf = inverse_frequencies(coded, items)
    latent = fold_in(items, idf, *singular_vectors(coded, idf))
    sent = spark.sparkContext.broadcast((items, latent))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(*sent.value, cosine, likely, sure)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
        for batch in batches:
            doc_ids, best = batch.column(0).to_pylist(), {}
            for number, k, *got in own.leaks((i, np.frombuffer(data, "<i4")) for i, data in enumerate(batch.column(1).to_pylist())):
                if got[1] > best.get((number, k), (0.0, 0.0))[1]:  # a long text may come in several streams
                    best[number, k] = got
            rows = [(doc_ids[number], own.items.ids[k], *got) for (number, k), got in best.items()]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "cosine", "share", "answer_found"])

    return coded.mapInArrow(search, SCHEMA)
