"""Alignment of two tokenizers' tokens by merge-path partitioning.

Both tokenizers encode a space and the text. A token ends at a byte offset; the ends of A's and of B's tokens over many
documents, laid one behind the other, are two ascending sequences. Binary searches along evenly spaced diagonals of their
merge cut them into pieces of equal work that know nothing of each other. A piece merges its ends: between two neighbouring
ends lie one A and one B token, which overlap, and an end that both have closes a group. Where a cut parts two equal ends the
piece behind drops its end and the piece before has its last group closed: this is the stitching, and groups that run over
cuts need no more. A document's size plays no part in a piece's.

Counts of id pairs over all documents take two steps. A task turns some megabytes of text, a chunk, into one row with
each document's figures and its distinct pairs as places in the chunk's list of pairs. Pairs of chunks, not of documents, are
then summed up over the corpus, and each chunk gets back the counts of its own pairs. So a pair that nearly every
document holds is one row a chunk. Nothing is broadcast but the highest count of each A id, a row for an entry of A's vocabulary.

Defined results: texts that are null or empty, or that A's or B's joined bytes don't give back behind their space, have no
tokens: zeros and an empty digest. Special tokens' strings are plain text. Null and repeated doc_ids are documents of their
own; an empty table gives no rows; other columns play no part. Texts of any length are one document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from newsloom.llm import vocab
from newsloom.llm.common import bound_batches, kept_in_worker, steps, written
from newsloom.llm.token_store import LibraryCodec

#: Ends that a piece merges.
PIECE_ENDS = 1 << 17
#: Bytes of text in a chunk, about; a longer text is a chunk alone.
CHUNK_BYTES = 16 << 20
#: Bytes of text that are aligned at once; a step's arrays have some hundred times as many.
STEP_BYTES = 3 << 19
#: Units that a worker remembers, and the longest of them in characters.
MEMO, LONGEST = 250_000, 64
#: More than any vocabulary's ids.
IDS = 1 << 31
CHUNK = "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_pairs array<int>, places binary, times binary, pair array<long>, docs array<int>"
FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class PlainCodec(LibraryCodec):
    """Ids of a byte-level vocabulary with special strings as plain text."""

    def __init__(self, data: bytes, pattern: str):
        super().__init__(data, pattern)
        self.library.encode_special_tokens = self.by_line.encode_special_tokens = True
        self.special = lambda text: None
        byte_of = {letter: byte for byte, letter in vocab.byte_letters().items()}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode() for token, i in self.library.get_vocab().items()}


class PieceCodec(dict):
    """Ids of a sentencepiece BPE model, remembered for units that no piece and so no merge reaches beyond: blanks with the
    word behind them, and line breaks. A model for which that does not hold gets whole texts."""

    def __init__(self, data: bytes):
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(data)
        pieces = [p.piece for p in model.pieces]
        plain = model.normalizer_spec.name == "identity" and not model.normalizer_spec.precompiled_charsmap and not model.normalizer_spec.remove_extra_whitespaces and model.normalizer_spec.add_dummy_prefix
        own = {p.type for p in model.pieces}  # 4: pieces that users defined
        self.cuts = plain and model.trainer_spec.model_type == 2 and 4 not in own and not any(re.search("[^▁]▁", p) for p in pieces)
        self.unit = re.compile(r"\n| *[^ \n]+| +" if not any("\n" in p for p in pieces) else " *[^ ]+| +").findall
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=data)
        model.normalizer_spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.bytes_of = {i: bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace("▁", " ").encode() for i, p in enumerate(model.pieces)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text behind a space that the model adds."""
        if not self.cuts:
            return [np.array(ids, "<u4").tobytes() for ids in self.whole.encode(texts, num_threads=1)]
        if len(self) > MEMO:
            self.clear()
        units = [self.unit(f" {t}") for t in texts]
        missing = list(set(chain.from_iterable(units)).difference(self))
        self.update(zip(missing, (np.array(ids, "<u4").tobytes() for ids in self.bare.encode(missing, num_threads=1)), strict=True))
        look = self.__getitem__
        made = [b"".join(map(look, one)) for one in units]
        for unit in missing:
            if len(unit) > LONGEST:
                del self[unit]
        return made


class _Side:
    """One tokenizer: its codec, its tokens' bytes and sizes, and their ids as text with what may stand behind them."""

    def __init__(self, codec: PlainCodec | PieceCodec, marks: tuple[str, str]):
        self.codec, n = codec, max(codec.bytes_of) + 1
        self.token = [codec.bytes_of.get(i, b"") for i in range(n)]
        self.size = np.array([len(t) for t in self.token])
        self.said = np.array([f"{i}{mark}".encode() for mark in marks for i in range(n)], object)

    def text(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.said[ids + last * len(self.token)]


def _sides(a: bytes, b: bytes, pattern: str) -> tuple[_Side, _Side]:
    key = f"aligned {hashlib.sha256(a).hexdigest()} {hashlib.sha256(b).hexdigest()} {pattern}"
    return kept_in_worker(key, lambda: (_Side(PlainCodec(a, pattern), (",", "|")), _Side(PieceCodec(b), (",", ";"))))


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of a and of b lie before each cut, a cut after every `work` ends of their merge, equal ends of a first."""
    at = np.arange(0, len(a) + len(b) + work, work).clip(max=len(a) + len(b))
    low, high = np.maximum(at - len(b), 0), np.minimum(at, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # a[middle] belongs before the cut if it is no greater than the b that would be the last before it
        before = a[np.minimum(middle, len(a) - 1)] <= b[np.maximum(at - middle - 1, 0)] if len(a) and len(b) else np.full(len(at), len(a) > 0)
        low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)
    return low, at - low


def merge_piece(a: np.ndarray, b: np.ndarray, i: int, j: int, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """A piece: ends a of A's tokens from number i and b of B's from j, behind the end `before`.

    The numbers of the A and the B token of each overlap, whether a group ends with it, and whether the piece
    begins with the end `before`, so that the overlap in front of it ends a group."""
    at_a = np.arange(len(a)) + np.searchsorted(b, a, "left")
    at_b = np.arange(len(b)) + np.searchsorted(a, b, "right")
    ends, of_a = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), bool)
    ends[at_a], ends[at_b], of_a[at_a] = a, b, True
    again = ends == np.concatenate([[before], ends[:-1]])
    closes = np.concatenate([again[1:], [False]]) & ~again
    in_a = i + np.cumsum(of_a) - of_a
    in_b = j + np.cumsum(~of_a) - ~of_a
    return in_a[~again], in_b[~again], closes[~again], bool(len(again) and again[0])


def overlaps(a: np.ndarray, b: np.ndarray, work: int = PIECE_ENDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The A token, the B token and whether a group ends, for each overlap of tokens with the ascending ends a and b."""
    cut_a, cut_b = diagonals(a, b, work)
    made = []
    for k in range(len(cut_a) - 1):
        i, j = cut_a[k], cut_b[k]
        before = max(a[i - 1] if i else 0, b[j - 1] if j else 0)
        made.append(merge_piece(a[i : cut_a[k + 1]], b[j : cut_b[k + 1]], i, j, before))
    for left, right in zip(made, made[1:], strict=False):
        if right[3]:
            left[2][-1:] = True  # stitched: the end that both have lies on the cut
    return tuple(np.concatenate([m[k] for m in made]) if made else np.zeros(0, kind) for k, kind in enumerate((int, int, bool)))


class _Chunk:
    """What a chunk's documents come to."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.doc_id: list = []
        self.figures: dict[str, list[np.ndarray]] = {c: [] for c in [*FIGURES, "n_pairs"]}
        self.digest: list[str] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, doc_ids: list, texts: list[str | None], a: _Side, b: _Side) -> None:
        self.doc_id += doc_ids
        self.bytes += sum(map(len, filter(None, texts)))
        full = [i for i, t in enumerate(texts) if t]
        ids = [[np.frombuffer(raw, "<u4") for raw in side.codec.encode(given)] for side, given in ((a, [f" {texts[i]}" for i in full]), (b, [texts[i] for i in full]))]
        same = [all(b"".join(map(side.token.__getitem__, own.tolist())) == f" {texts[i]}".encode() for side, own in ((a, x), (b, y))) for i, x, y in zip(full, *ids, strict=True)]
        full, (of_a, of_b) = [i for i, fits in zip(full, same, strict=True) if fits], ([x for x, fits in zip(own, same, strict=True) if fits] for own in ids)
        n = {c: np.zeros(len(texts), np.int64) for c in self.figures}
        n["n_a"][full], n["n_b"][full] = list(map(len, of_a)), list(map(len, of_b))
        flat_a, flat_b = (np.concatenate(own).astype(np.int64) if own else np.zeros(0, np.int64) for own in (of_a, of_b))
        link_a, link_b, closes = overlaps(np.cumsum(a.size[flat_a]), np.cumsum(b.size[flat_b]))
        doc_of_a = np.repeat(np.arange(len(texts)), n["n_a"])
        doc = doc_of_a[link_a]
        n["n_links"] += np.bincount(doc, minlength=len(texts))
        n["n_groups"] += np.bincount(doc[closes], minlength=len(texts))
        self._say(flat_a, flat_b, link_a[closes] + 1, link_b[closes] + 1, n, full, a, b)
        # a number for each document, A and B id: documents of a step and two vocabularies fit 63 bits
        held, times = np.unique((doc * len(a.token) + flat_a[link_a]) * len(b.token) + flat_b[link_b], return_counts=True)
        rest, of_b = np.divmod(held, len(b.token))
        doc, of_a = np.divmod(rest, len(a.token))
        n["n_pairs"] += np.bincount(doc, minlength=len(texts))
        self.pairs.append(of_a * IDS + of_b)
        self.times.append(times)
        for c, values in n.items():
            self.figures[c].append(values)

    def _say(self, flat_a, flat_b, stop_a, stop_b, n, full, a: _Side, b: _Side) -> None:
        """The digest of each document's groups; a group's A tokens stand before its B tokens."""
        last_a, last_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
        last_a[stop_a - 1] = last_b[stop_b - 1] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        said = np.empty(len(flat_a) + len(flat_b), object)
        said[np.arange(len(flat_a)) + np.concatenate([[0], stop_b])[group_a]] = a.text(flat_a, last_a)
        said[np.arange(len(flat_b)) + stop_a[group_b] if len(stop_a) else np.zeros(0, int)] = b.text(flat_b, last_b)
        ends = np.cumsum(n["n_a"] + n["n_b"]).tolist()
        said, found = said.tolist(), [""] * len(n["n_a"])
        for i in full:
            found[i] = hashlib.sha256(b"".join(said[ends[i] - int(n["n_a"][i] + n["n_b"][i]) : ends[i]])[:-1]).hexdigest()
        self.digest += found

    def row(self) -> pa.RecordBatch:
        pairs, figures = np.concatenate(self.pairs), {c: np.concatenate(v) for c, v in self.figures.items()}
        own = np.unique(pairs)
        places = np.searchsorted(own, pairs)
        docs = np.bincount(places, minlength=len(own))
        squeeze = zstandard.ZstdCompressor(level=1).compress
        # a document's places ascend, so their differences are small
        steps_ = np.diff(places, prepend=0)
        columns = [[self.number], [self.doc_id], *[[figures[c]] for c in FIGURES], [self.digest], [figures["n_pairs"]], [squeeze(steps_.astype("<i4").tobytes())], [squeeze(np.concatenate(self.times).astype("<i4").tobytes())], [own], [docs]]
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in CHUNK.split(", ")])


def aligned_chunks(docs: DataFrame, json_path: str, model_path: str, pattern: str) -> DataFrame:
    """A row for each chunk of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab.read_bytes(json_path), vocab.read_bytes(model_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(*sent.value, pattern)
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                chunk.add(part.column(0).to_pylist(), part.column(1).to_pylist(), *sides)
                if chunk.bytes >= CHUNK_BYTES:
                    yield chunk.row()
                    chunk, number = _Chunk(number + 1), number + 1
        if chunk.doc_id:
            yield chunk.row()

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, CHUNK)


def _figures(counted: DataFrame) -> DataFrame:
    """The documents of chunks that know their pairs' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                numbers = lambda c, r=row: np.asarray(r[c].values) if r[c].is_valid else np.zeros(0, np.int64)
                unpack = lambda c, r=row: np.frombuffer(zstandard.decompress(r[c].as_py()), "<i4").astype(np.int64)
                places, times = np.cumsum(unpack("places")), unpack("times")
                order = np.argsort(numbers("known"))
                count, best = numbers("count")[order][places], numbers("best")[order][places]
                stops = np.concatenate([[0], np.cumsum(numbers("n_pairs"), dtype=np.int64)])
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[stops]) for x in (np.where(count == best, times, 0), count * times)]
                yield pa.record_batch([row["doc_id"].values, *[row[c].values for c in FIGURES], *map(pa.array, sums), row["groups_sha256"].values], names=[c.split()[0] for c in RESULT.split(", ")])

    return counted.mapInArrow(run, RESULT)


def align(docs: DataFrame, json_path: str, model_path: str, pattern: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text).

    A is a byte-level vocabulary, B a sentencepiece model that puts a space before a text. n_best are the links whose pair
    is in as many documents as any pair of their A id; count_sum sums their pairs' numbers of documents."""
    chunks = written(aligned_chunks(docs, json_path, model_path, pattern), "chunks")
    held = chunks.select("chunk", F.explode(F.arrays_zip("pair", "docs")).alias("p")).select("chunk", "p.pair", "p.docs")
    counts = written(held.groupBy("pair").agg(F.sum("docs").alias("count")), "pair-counts")
    a_id = F.shiftright("pair", 31)
    best = counts.groupBy(a_id.alias("a")).agg(F.max("count").alias("best"))
    known = counts.withColumn("a", a_id).join(F.broadcast(best), "a").select("pair", "count", "best")  # a row an entry of A's vocabulary
    back = held.select("chunk", "pair").join(known, "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "count", "best")).alias("k"))
    told = back.select("chunk", F.col("k.pair").alias("known"), F.col("k.count").alias("count"), F.col("k.best").alias("best"))
    return _figures(chunks.drop("pair", "docs").join(told, "chunk", "left"))
