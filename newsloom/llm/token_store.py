"""Token ids in binary shards of independent zstandard frames with a trailing seek table.

A shard holds the documents of one doc_id range in ascending order, a frame each: the document's ids,
with the end id, as little-endian unsigned 32-bit integers. Behind the frames stand a skippable frame
with the doc_ids and, in the public seekable format, a skippable frame with each frame's compressed size,
decompressed size and checksum (the low 32 bits of the content's XXH64). A reader fetches the tail of a
file, then only the frames that were asked for, and checks each one.

Ids are made and compressed before the only shuffle, which so moves compressed frames. Shards are written
by tasks to temporary names and renamed, so a task that runs twice leaves the same file.

Defined results: a null or empty text is the end id alone; a null doc_id stands before all others; rows
that repeat a doc_id each have a frame, ordered by content; an empty table gives no shards; other columns
play no part. The output folder has to be one that pyarrow's file systems can write (local or mounted
paths, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import vocab
from newsloom.llm.common import kept_in_worker, map_rows

#: Pre-tokens that a worker remembers, and the longest of them in characters.
MEMO, LONGEST = 1_000_000, 64
#: Characters that are cut and looked up at a time, about: their pre-tokens stay in a core's cache.
LOOKED_UP = 100_000
#: Documents in a shard, as long as this makes at most MOST_SHARDS of them.
SHARD_DOCS = 20_000
MOST_SHARDS = 10_000
#: Fixed values of the public seekable format: magic numbers, the flag for checksums, the sizes of an entry and the footer.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
ENTRY, FOOTER = 12, 9
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


class LibraryCodec(dict):
    """Ids of pre-tokens as the tokenizers library gives them, remembered as little-endian 32-bit bytes."""

    def __init__(self, data: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(data.decode())
        self.by_line = Tokenizer.from_str(data.decode())  # takes spelled pre-tokens, a line each
        self.by_line.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.split = vocab.splitter(pattern)
        self.byte_level = vocab.is_byte_level(data) and pattern == vocab.BYTE_LEVEL_PATTERN
        special = vocab.special_strings(data)
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda text: None
        ids = self.library.get_vocab()
        self.opens = np.zeros(max(ids.values()) + 1, bool)  # whether an id's token starts with a space
        self.opens[[i for token, i in ids.items() if token.startswith(vocab.spelled(b" "))]] = True

    def _plain(self, text: str) -> bool:
        return self.byte_level and self.special(text) is None and vocab.cuts_alike(text)

    def _by_library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(one.ids, "<u4") for one in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, tokens: set[str]) -> None:
        """Words behind one space go to the library in one text, already cut and spelled; each starts with a token that opens with the space."""
        words = [t for t in tokens if t.rfind(" ") == 0 and "\n" not in t]
        rest = list(tokens.difference(words))
        ids = np.array(self.by_line.encode_batch_fast([vocab.spelled_lines(words)], add_special_tokens=False)[0].ids, "<u4")
        places = [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
        raw = ids.tobytes()
        self.update(zip(words, map(raw.__getitem__, map(slice, places[:-1], places[1:])), strict=True))
        self.update(zip(rest, (one.tobytes() for one in self._by_library(rest)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        made: list[bytes] = []
        start = size = 0
        for i, text in enumerate(texts, 1):
            size += len(text)
            if size >= LOOKED_UP or i == len(texts):
                made += self._encode_few(texts[start:i])
                start, size = i, 0
        return made

    def _encode_few(self, texts: list[str]) -> list[bytes]:
        if len(self) > MEMO:
            self.clear()
        cut = [self.split(t) if self._plain(t) else None for t in texts]
        tokens = list(chain.from_iterable(filter(None, cut)))
        ids, missing = list(map(self.get, tokens)), set()
        if gaps := [i for i, known in enumerate(ids) if known is None]:
            missing.update(map(tokens.__getitem__, gaps))
            self._learn(missing)
            for i in gaps:
                ids[i] = self[tokens[i]]
        made, at = [], 0
        for text, own in zip(texts, cut, strict=True):
            made.append(self._by_library([text])[0].tobytes() if own is None else b"".join(ids[at : at + len(own)]))
            at += len(own or ())
        for token in missing:
            if len(token) > LONGEST:
                del self[token]
        return made


def library_codec(data: bytes, pattern: str) -> LibraryCodec:
    key = f"library {hashlib.sha256(data).hexdigest()} {pattern}"
    return kept_in_worker(key, lambda: LibraryCodec(data, pattern))


def _checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


def shard_bounds(docs: DataFrame, shard_docs: int = SHARD_DOCS) -> np.ndarray:
    """doc_ids that part the shards: quantiles, so shards hold about as many documents each."""
    rows = docs.count()
    shards = min(MOST_SHARDS, -(-rows // shard_docs))
    if shards < 2:
        return np.array([], np.int64)
    at = F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 10 * shards)
    return np.unique(np.array(docs.agg(at.alias("b")).first()["b"] or [], np.int64))


def frames(docs: DataFrame, json_path: str, pattern: str, end_id: int, bounds: np.ndarray) -> DataFrame:
    """shard, doc_id, frame, raw_bytes, checksum of every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab.read_bytes(json_path), bounds))
    end = struct.pack("<I", end_id)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, parts = sent.value
        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        raw = [ids + end for ids in library_codec(data, pattern).encode([t or "" for t in batch.column(1).to_pylist()])]
        keys = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        shard = np.searchsorted(parts, keys, side="right").astype(np.int32)
        return pa.record_batch([pa.array(shard), batch.column(0), pa.array(map(squeeze, raw), pa.binary()), pa.array(map(len, raw), pa.int64()), pa.array(map(_checksum, raw), pa.int64())], names=["shard", "doc_id", "frame", "raw_bytes", "checksum"])

    return map_rows(docs.select("doc_id", "text"), "text", "shard int, doc_id long, frame binary, raw_bytes long, checksum long", work)


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class _Shard:
    """A shard as it is written: frames go out at once, sizes and ids are held for the tail."""

    def __init__(self, folder: str, number: int):
        self.store, base = fs.FileSystem.from_uri(folder)
        self.number, self.name = number, f"shard-{number:06d}.tzs"
        self.final = f"{base}/{self.name}"
        self.draft = f"{base}/.{self.name}.{uuid.uuid4().hex}"
        self.store.create_dir(base, recursive=True)
        self.out = self.store.open_output_stream(self.draft)
        self.entries, self.ids, self.known = array("I"), array("q"), bytearray()  # 21 bytes a document
        self.tokens = 0

    def add(self, doc_id: int | None, frame: bytes, raw_bytes: int, checksum: int) -> None:
        self.out.write(frame)
        self.entries.extend((len(frame), raw_bytes, checksum))
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.tokens += raw_bytes // 4

    def close(self) -> dict:
        """Writes index and seek table, renames the file; its row in the manifest."""
        index = _skippable(SKIPPABLE_INDEX, np.asarray(self.ids, "<i8").tobytes() + bytes(self.known))
        self.out.write(index)
        self.entries.extend((len(index), 0, _checksum(b"")))
        table = np.asarray(self.entries, "<u4").tobytes()
        self.out.write(_skippable(SKIPPABLE_SEEK, table + struct.pack("<IBI", len(self.ids) + 1, CHECKSUMS, SEEKABLE)))
        self.out.close()
        self.store.move(self.draft, self.final)
        return {"shard": self.number, "file": self.name, "n_docs": len(self.ids), "shard_tokens": self.tokens}


MANIFEST = "shard int, file string, n_docs long, shard_tokens long"


def write_store(docs: DataFrame, folder: str, json_path: str, pattern: str, end_id: int, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encodes docs (doc_id, text) and writes shards under folder; the manifest, a row a shard, kept as Parquet beside them."""
    docs = docs.select("doc_id", "text")
    bounds = shard_bounds(docs, shard_docs)
    made = frames(docs, json_path, pattern, end_id, bounds)
    dealt = made.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for number, doc_id, frame, size, check in zip(numbers, *(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                shard = shard or _Shard(f"{folder}/shards", number)
                shard.add(doc_id, frame, size, check)
        if shard:
            yield pa.RecordBatch.from_pylist([shard.close()], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("shard_tokens", pa.int64())]))

    dealt.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def seek_table(source) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """Of an open shard: entries (compressed, raw bytes, checksum), doc_ids, and each frame's place."""
    size = source.size()
    count, flags, magic = struct.unpack("<IBI", source.read_at(FOOTER, size - FOOTER))
    if magic != SEEKABLE or not flags & CHECKSUMS:
        raise ValueError("not a seekable shard with checksums")
    table_at = size - FOOTER - count * ENTRY
    entries = np.frombuffer(source.read_at(count * ENTRY, table_at), "<u4").reshape(count, 3).astype(np.int64)
    index = source.read_at(int(entries[-1, 0]) - 8, table_at - 8 - int(entries[-1, 0]) + 8)
    n = count - 1
    keys, known = np.frombuffer(index[: 8 * n], "<i8"), np.frombuffer(index[8 * n :], np.uint8)
    places = np.concatenate([[0], np.cumsum(entries[:-1, 0])])
    return entries[:-1], [int(k) if ok else None for k, ok in zip(keys, known, strict=True)], places


def read_store(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian 32-bit) from the shards; only the frames of doc_ids are read, if given."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    plan = manifest.select("file", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)).alias("base"))
    wanted = None if doc_ids is None else frozenset(doc_ids)

    def rows(file: str, base: int) -> Iterator[tuple]:
        store, root = fs.FileSystem.from_uri(f"{folder}/shards")
        expand = zstandard.ZstdDecompressor()
        with store.open_input_file(f"{root}/{file}") as source:
            entries, keys, places = seek_table(source)
            starts = base + np.concatenate([[0], np.cumsum(entries[:, 1] // 4)])
            for i, doc_id in enumerate(keys):
                if wanted is None or doc_id in wanted:
                    size, raw_bytes, check = entries[i].tolist()
                    raw = expand.decompress(source.read_at(size, int(places[i])), max_output_size=raw_bytes)
                    if len(raw) != raw_bytes or _checksum(raw) != check:
                        raise ValueError(f"{file}: frame {i} is damaged")
                    yield doc_id, int(starts[i]), raw_bytes // 4, raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names, kinds = ["doc_id", "start", "n_tokens", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        out = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
        total = 0
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in rows(file, base):
                    held.append(row)
                    total += len(row[3])
                    if total > 8 << 20:
                        yield out()
                        held, total = [], 0
        if held:
            yield out()

    files = max(1, manifest.count())
    return plan.repartition(files, "file").mapInArrow(run, SCHEMA)
