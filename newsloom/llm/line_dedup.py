"""Reversible line dedup: exact reference counts, with sharded cuckoo filters in front of them.

State of an index in the shared folder, by version:
- added and gone: the exact reference-count table as deltas. added holds shard, key (two 64-bit hashes), doc_id and
  n_lines: which documents hold a line's key, and how often; gone holds the doc_ids whose earlier references no
  longer count. `compact` writes them as one table again.
- repeated: shard, key, n_docs, keeper. The keys that at least `min_docs` documents hold.
- filters: a cuckoo filter a shard over the keys of repeated; deletable, so counts that fall take keys out.
  filter_log lists the shards that have one; a filter that it lists but that is lost is an error.

Inserting documents adds their references; a doc_id that the index holds is replaced. Deleting documents takes theirs
away. Both recount only keys that those documents hold or held. Text is restored by that: after a deletion, lines
whose key is no longer repeated come back in what apply returns.

Shards, and the parts that a line of very many documents is spread over, follow from the rows of the first insertion.

Looking up: references whose key the filter does not know are kept for certain; the few others are joined
with the exact table, so a filter's false positives cost a lookup and never a line.

A key is the line with [\\x20\\x09-\\x0D] stripped at both ends and A-Z lower-cased, if it has at least
`min_chars` code points; a repeated key loses all its lines but those in the largest doc_id that holds it.

Defined results: a null or empty text is one empty line; a null doc_id holds no references and keeps all its
lines; rows that repeat a doc_id are one document to the counts and lose the same keys; an empty table gives
no rows; other columns pass through apply whatever their names, those called as apply's own columns with an
underscore behind the latter.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import free_name, fresh_path
from newsloom.llm.url_filter import LOWER, UPPER

BLANKS = " \t\n\x0b\x0c\r"
#: Rows of documents for each shard, the least number of shards, and shards for each part that a line's references are dealt to.
SHARD_ROWS, LEAST_SHARDS, SPREAD = 20_000, 64, 4
SLOTS, LOAD, KICKS = 4, 0.85, 500
REFS = "shard int, h1 long, h2 long, doc_id long, n_lines long"
REPEATED = "shard int, h1 long, h2 long, n_docs long, keeper long"
STATE = "base int, shards int"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class CuckooFilter:
    """16-bit tags in buckets of four; a key's second bucket follows from its first and its tag."""

    def __init__(self, keys: int, table: np.ndarray | None = None):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.random = np.random.default_rng(len(self.table))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _mix(keys.view(np.uint64))
        tag = (h >> np.uint64(48)).astype(np.uint16)
        tag[tag == 0] = 1
        mask = np.uint64(len(self.table) - 1)
        first = (h & mask).astype(np.int64)
        return tag, first, self._other(first, tag)

    def _other(self, place: np.ndarray, tag: np.ndarray) -> np.ndarray:
        return place ^ (_mix(tag.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """False if it ran full; the caller then builds a larger one."""
        for tag, *places in zip(*self._places(keys), strict=True):
            if not self._put(tag, places):
                return False
        return True

    def _put(self, tag: np.uint16, places: list[np.int64]) -> bool:
        for place in places:
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = tag
                return True
        place = places[int(self.random.integers(2))]
        for _ in range(KICKS):
            slot = int(self.random.integers(SLOTS))
            tag, self.table[place, slot] = self.table[place, slot], tag
            place = int(self._other(np.array([place]), np.array([tag], np.uint16))[0])
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = tag
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        for tag, *places in zip(*self._places(keys), strict=True):
            for place in places:
                held = np.flatnonzero(self.table[place] == tag)
                if len(held):
                    self.table[place, held[0]] = 0
                    break

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        tag, a, b = self._places(keys)
        return (self.table[a] == tag[:, None]).any(axis=1) | (self.table[b] == tag[:, None]).any(axis=1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hashes(key: Column) -> Column:
    """128 bits of a key."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def load_filter(shard: int, store: fs.FileSystem, base: str) -> CuckooFilter:
    with store.open_input_file(f"{base}/{shard:06d}.cuckoo") as source:
        return CuckooFilter(0, np.load(io.BytesIO(source.read())))


class LineIndex:
    """The index at a version. Methods that change it return the next version and leave this one as it is."""

    def __init__(self, spark: SparkSession, folder: str | None = None, version: int = 0, min_docs: int = 3, min_chars: int = 20):
        self.spark, self.version = spark, version
        self.folder = folder or fresh_path(spark, "lines")
        self.min_docs, self.min_chars = min_docs, min_chars
        self.base, self.shards = (1, 0) if not version else tuple(spark.read.schema(STATE).parquet(self._path("state")).first())

    def _path(self, what: str, version: int | None = None) -> str:
        return f"{self.folder}/v{self.version if version is None else version}/{what}"

    def _after(self, base: int, shards: int) -> LineIndex:
        """The next version, not yet filled."""
        after = LineIndex(self.spark, self.folder, 0, self.min_docs, self.min_chars)
        after.version, after.base, after.shards = self.version + 1, base, shards
        self.spark.createDataFrame([(base, shards)], STATE).coalesce(1).write.parquet(after._path("state"))
        return after

    @property
    def refs(self) -> DataFrame:
        """Rows of added that no later version takes back."""
        versions = range(self.base, self.version + 1)
        read = lambda what, schema, v: self.spark.read.schema(schema).parquet(self._path(what, v)).withColumn("at", F.lit(v))
        added = [read("added", REFS, v) for v in versions]
        gone = [read("gone", "doc_id long", v) for v in versions if v > self.base]
        if not added:
            return self.spark.createDataFrame([], REFS)
        rows = reduce(DataFrame.unionByName, added)
        if gone:
            last = reduce(DataFrame.unionByName, gone).groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("at").alias("gone_at"))
            rows = rows.join(last, (rows["doc_id"] == last["gone_id"]) & (rows["at"] < last["gone_at"]), "left_anti")
        return rows.drop("at")

    @property
    def repeated(self) -> DataFrame:
        return self.spark.read.schema(REPEATED).parquet(self._path("repeated")) if self.version else self.spark.createDataFrame([], REPEATED)

    def _filtered(self) -> frozenset[int]:
        """Shards that have a filter; a number a shard."""
        if not self.version:
            return frozenset()
        return frozenset(r["shard"] for r in self.spark.read.schema("shard int").parquet(self._path("filter_log")).collect())

    def _keys(self, docs: DataFrame, shards: int) -> DataFrame:
        """shard, h1, h2, doc_id, n_lines of docs (doc_id, text)."""
        lines = docs.where("doc_id is not null").select("doc_id", F.explode(F.split(F.col("text"), "\n")).alias("line"))
        keyed = lines.select("doc_id", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= self.min_chars)
        hashed = keyed.select("doc_id", key_hashes(F.col("key")).alias("h")).select(F.pmod("h.h1", F.lit(shards)).cast("int").alias("shard"), "h.h1", "h.h2", "doc_id")
        salted = hashed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(shards // SPREAD))).repartition("shard", "salt")
        return salted.groupBy("shard", "salt", "h1", "h2", "doc_id").agg(F.count("*").alias("n_lines")).drop("salt").sortWithinPartitions("shard")

    def _count(self, refs: DataFrame) -> DataFrame:
        counted = refs.groupBy("shard", "h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        return counted.where(F.col("n_docs") >= self.min_docs)

    def _fill(self, before: LineIndex, touched: DataFrame | None) -> LineIndex:
        """Counts and filters of a version whose deltas stand. touched: keys (h1, h2) to recount; None recounts all."""
        key = ["h1", "h2"]
        if touched is None:
            repeated = self._count(self.refs)
        else:
            touched = touched.select(key).distinct()
            touched.write.parquet(self._path("touched"))
            touched = self.spark.read.parquet(self._path("touched"))
            repeated = before.repeated.join(touched, key, "left_anti").select("shard", *key, "n_docs", "keeper").unionByName(self._count(self.refs.join(touched, key, "left_semi")))
        repeated.select("shard", *key, "n_docs", "keeper").write.parquet(self._path("repeated"))
        self._write_filters(before)
        return self

    def insert(self, docs: DataFrame) -> LineIndex:
        """With docs (doc_id, text); documents whose doc_ids the index holds are replaced."""
        if not self.version:
            after = self._after(1, max(LEAST_SHARDS, -(-docs.count() // SHARD_ROWS)))
            self._keys(docs, after.shards).write.parquet(after._path("added"))
            return after._fill(self, None)
        after = self._after(self.base, self.shards)
        self._keys(docs, self.shards).write.parquet(after._path("added"))
        docs.select("doc_id").where("doc_id is not null").distinct().write.parquet(after._path("gone"))
        gone = self.spark.read.schema("doc_id long").parquet(after._path("gone"))
        held = self.refs.join(gone, "doc_id", "left_semi")
        return after._fill(self, self.spark.read.schema(REFS).parquet(after._path("added")).select("h1", "h2").unionByName(held.select("h1", "h2")))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of doc_ids (doc_id)."""
        if not self.version:
            return self
        after = self._after(self.base, self.shards)
        doc_ids.select("doc_id").where("doc_id is not null").distinct().write.parquet(after._path("gone"))
        self.spark.createDataFrame([], REFS).write.parquet(after._path("added"))
        gone = self.spark.read.schema("doc_id long").parquet(after._path("gone"))
        return after._fill(self, self.refs.join(gone, "doc_id", "left_semi"))

    def compact(self) -> LineIndex:
        """The same index with its references in one table."""
        if not self.version:
            return self
        after = self._after(self.version + 1, self.shards)
        self.refs.sortWithinPartitions("shard").write.parquet(after._path("added"))
        return after._fill(self, after.refs.limit(0))

    def _write_filters(self, before: LineIndex) -> None:
        """A task a shard: the filter of the version before, less keys that ceased to be repeated, plus new ones."""
        key = ["shard", "h1", "h2"]
        now, old = self.repeated.select(key), before.repeated.select(key)
        both = now.withColumn("is", F.lit(1)).unionByName(old.withColumn("is", F.lit(2))).groupBy(key).agg(F.sum("is").alias("is"))
        folder, old_folder, old_shards = self._path("filters"), before._path("filters"), before._filtered()

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = fs.FileSystem.from_uri(folder)
            store.create_dir(base, recursive=True)
            held: dict[int, list[np.ndarray]] = {}

            def close(shard: int) -> None:
                rows = np.concatenate(held.pop(shard))
                keys, state = rows[:, 0].copy(), rows[:, 1]
                made = load_filter(shard, *fs.FileSystem.from_uri(old_folder)) if shard in old_shards else None
                if made is not None:
                    made.delete(keys[state == 2])
                    if not made.insert(keys[state == 1]):
                        made = None
                size = int((state != 2).sum())
                while made is None:
                    made = CuckooFilter(size)
                    if not made.insert(keys[state != 2]):
                        made, size = None, 2 * size
                out = io.BytesIO()
                np.save(out, made.table)
                draft = f"{base}/.{shard:06d}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as sink:
                    sink.write(out.getvalue())
                store.move(draft, f"{base}/{shard:06d}.cuckoo")

            done: list[int] = []
            for batch in batches:
                shards, h1, state = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                for shard in np.unique(shards).tolist():
                    for earlier in [s for s in held if s != shard]:
                        close(earlier)
                        done.append(earlier)
                    own = shards == shard
                    held.setdefault(shard, []).append(np.stack([h1[own], state[own].astype(np.int64)], axis=1))
            for shard in list(held):
                close(shard)
                done.append(shard)
            yield pa.record_batch([pa.array(done, pa.int32())], names=["shard"])

        dealt = both.select("shard", "h1", F.col("is").cast("long").alias("is")).repartition("shard").sortWithinPartitions("shard", "h1")
        dealt.mapInArrow(build, "shard int").write.parquet(self._path("filter_log"))

    def hits(self, keys: DataFrame) -> DataFrame:
        """Rows of keys (shard, h1, h2, doc_id) that the filters may hold; files sorted by shard read each filter once."""
        folder, known = self._path("filters"), self._filtered()

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = fs.FileSystem.from_uri(folder)
            held: tuple[int, CuckooFilter | None] = (-1, None)
            for batch in batches:
                shards = batch.column(0).to_numpy(zero_copy_only=False)
                h1 = batch.column(1).to_numpy(zero_copy_only=False)
                keep = np.zeros(len(shards), bool)
                for shard in np.unique(shards).tolist():
                    if held[0] != shard:
                        held = (shard, load_filter(shard, store, base) if shard in known else None)
                    if held[1] is not None:
                        own = np.flatnonzero(shards == shard)
                        keep[own] = held[1].may_hold(h1[own].copy())
                yield batch.filter(pa.array(keep))

        return keys.select("shard", "h1", "h2", "doc_id").mapInArrow(probe, "shard int, h1 long, h2 long, doc_id long")

    def drops(self, keys: DataFrame | None = None) -> DataFrame:
        """doc_id, dropped (the hashes of its keys that go), of documents in the index or of keys (shard, h1, h2, doc_id)."""
        exact = self.repeated.select("h1", "h2", "keeper")
        going = self.hits(self.refs if keys is None else keys).join(exact, ["h1", "h2"]).where("doc_id <> keeper")
        return going.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("h1", "h2"))).alias("dropped"))

    def apply(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with `text` less its dropped lines; documents in the index only. Adds _lines and _dropped, the counts before and of dropped ones."""
        columns = docs.columns
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
        by_doc = self.drops()
        joined = rows.join(by_doc, F.col("row.doc_id") == by_doc["doc_id"], "left").select("row", "dropped")
        lines = F.split(F.coalesce(F.col(f"row.`{text}`"), F.lit("")), "\n")
        stays = lambda line: (F.char_length(line_key(line)) < self.min_chars) | ~holds(F.col("dropped"), key_hashes(line_key(line)))
        split = joined.select("row", F.size(lines).cast("long").alias("n"), F.when(F.col("dropped").isNotNull(), F.filter(lines, stays)).alias("kept"))
        gone = F.coalesce(F.col("n") - F.size("kept"), F.lit(0)).cast("long")
        new = F.when(gone > 0, F.array_join("kept", "\n")).otherwise(F.col(f"row.`{text}`"))
        own = [(new if c == text else F.col(f"row.`{c}`")).alias(c) for c in columns]
        return split.select(*own, F.col("n").alias(free_name(columns, "_lines")), gone.alias(free_name(columns, "_dropped")))


def holds(ordered: Column, value: Column) -> Column:
    """Whether an array in ascending order holds value, by halving steps: how many elements are not above it, from the highest bit on."""
    highest = F.floor(F.log2(F.size(ordered))).cast("int")
    bit = lambda i: F.call_function("shiftleft", F.lit(1), i)
    up = lambda n, i: F.when((n + bit(i) <= F.size(ordered)) & (F.get(ordered, n + bit(i) - 1) <= value), n + bit(i)).otherwise(n)
    count = F.aggregate(F.sequence(highest, F.lit(0), F.lit(-1)), F.lit(0), up)
    return F.coalesce(F.get(ordered, count - 1) == value, F.lit(False))
