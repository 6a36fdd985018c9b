"""Keyed tables under one commit log: small writes, merged on read, several tables changed together or not at all.

A table is a base and deltas, Parquet folders partitioned by a hash of the key and sorted by it, bases with a bloom filter
on it. A commit writes one delta for each table that it changes, in proportion to the change, and then one numbered log
entry, which names all folders in force. The entry is put in place only if its number is free, so of two jobs that began at
the same entry one fails with Conflict and nothing of it is seen; a job that dies before its entry leaves folders that no entry
names. Readers see the tables as one entry has them. `compact` folds deltas into a new base, `vacuum` deletes what no kept
entry names.

A commit may carry the number of a batch of a named stream; a batch that is already in is skipped, so a replay changes
nothing. Rows without a key (a null in all of it) take no part. Several rows of a key in one commit: the last by all
columns counts as the latest, the first as the earliest.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a delta's row does to its key's row.
INSERT, UPDATE = 0, 1
BUCKET, SEQ, OP = "_bucket", "_seq", "_op"


class Conflict(Exception):
    """Another commit took the number that this one meant to have."""


@dataclass(frozen=True)
class Table:
    """How the rows of a key become one.

    first: the earliest inserted row, with later updates' non-null columns over it. latest: the row greatest by `order`, then
    the latest; columns in `fixed` keep the earliest row's values. sum: `counters` add up, other columns take the greatest value."""

    schema: str
    key: tuple[str, ...]
    merge: str = "first"
    order: str | None = None
    counters: tuple[str, ...] = ()
    fixed: tuple[str, ...] = ()
    buckets: int = 16


@dataclass
class State:
    """A log entry: the folders in force by table, oldest first, each with its number and whether it is a base; the last batch of each stream."""

    version: int = 0
    folders: dict[str, list[dict]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class KeyedStore:
    """Tables under a root folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._kept = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no overwriting
        self._conflicts = "org.apache.hadoop.fs.FileAlreadyExistsException"

    # The log

    def _log(self, version: int) -> str:
        return f"{self.root}/_log/{version:012d}.json"

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/_log")
        names = [f.getPath().getName() for f in self._files.listStatus(at)] if self._files.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def state(self, version: int | None = None) -> State:
        """The entry of a version, the last by default."""
        held = self.versions()
        if not held or version == 0:
            return State()
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = self._files.open(self._path(self._log(held[-1] if version is None else version)))
        try:
            return State(**json.loads(text.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _put(self, state: State) -> None:
        """Writes the entry beside its place and renames it, which fails where the place is taken."""
        draft = self._path(f"{self.root}/_log/.{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(state.__dict__).encode()))
        out.close()
        try:
            self._context.rename(draft, self._path(self._log(state.version)), self._kept)
        except Exception as failed:
            if self._conflicts in str(getattr(failed, "java_exception", failed)) or isinstance(failed, PySparkException) and self._conflicts in str(failed):
                self._files.delete(draft, False)
                raise Conflict(f"version {state.version} is taken") from failed
            raise

    # Writing

    def _bucket(self, table: Table, key: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(table.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, what: str) -> str:
        """A new folder of rows (the table's columns, SEQ, OP)."""
        table = self.tables[name]
        folder = f"{self.root}/{name}/{what}-{uuid.uuid4().hex}"
        order = [BUCKET, *table.key]
        sized = rows.withColumn(BUCKET, self._bucket(table, [F.col(c) for c in table.key])).repartitionByRange(*order).sortWithinPartitions(*order)
        writer = sized.write.partitionBy(BUCKET)
        for c in table.key if what == "base" else ():  # deltas are small, and sorted
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(folder)
        return folder

    def _shaped(self, name: str, rows: DataFrame, op: int, version: int) -> DataFrame:
        table = self.tables[name]
        schema = StructType.fromDDL(table.schema)
        given = {c.lower() for c in rows.columns}
        cells = [(F.col(f.name) if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        some_key = F.coalesce(*[F.col(c).isNotNull() for c in table.key if c.lower() in given]) if len(table.key) == 1 else F.greatest(*[F.col(c).isNotNull() for c in table.key])
        return rows.select(*cells).where(some_key).withColumns({SEQ: F.lit(version).cast("long"), OP: F.lit(op)})

    def commit(self, inserts: dict[str, DataFrame] | None = None, updates: dict[str, DataFrame] | None = None, batch: tuple[str, int] | None = None, since: int | None = None) -> int | None:
        """Adds inserts and updates to their tables as one new version, and returns it; None if the batch is in already.

        since: the version that the changes were made from; if another commit came after it, Conflict is raised before anything is written.
        Without it the changes are taken not to depend on what was read, and the commit takes the next free number."""
        now = self.state()
        if since is not None and now.version != since:
            raise Conflict(f"version {now.version} came after {since}")
        if batch and now.batches.get(batch[0], -1) >= batch[1]:
            return None
        made: dict[str, list[dict]] = {}
        version = now.version + 1
        for op, changes in ((INSERT, inserts or {}), (UPDATE, updates or {})):
            for name, rows in changes.items():
                made.setdefault(name, []).append({"at": self._write(name, self._shaped(name, rows, op, version), "delta"), "base": False})
        while True:
            folders = {n: [*now.folders.get(n, []), *made.get(n, [])] for n in {**now.folders, **made}}
            try:
                self._put(State(version, folders, now.batches | ({batch[0]: batch[1]} if batch else {})))
                return version
            except Conflict:
                if since is not None:
                    raise
                now = self.state()
                if batch and now.batches.get(batch[0], -1) >= batch[1]:
                    return None
                version = now.version + 1

    # Reading

    def _folder(self, name: str, at: str, number: int) -> DataFrame:
        """number: the folder's place among those in force; it stands above the commit that wrote it, which may have had to take a later number."""
        rows = self.spark.read.schema(f"{self.tables[name].schema}, {SEQ} long, {OP} int, {BUCKET} int").parquet(at)
        return rows.withColumn(SEQ, F.lit(number).cast("long"))

    def _merged(self, name: str, rows: DataFrame) -> DataFrame:
        table = self.tables[name]
        columns = [c for c in StructType.fromDDL(table.schema).names if c not in table.key]
        if table.merge == "first":  # an update before its row was there changes nothing
            since = F.min(F.when(F.col(OP) == INSERT, F.col(SEQ))).over(Window.partitionBy(BUCKET, *table.key))
            rows = rows.withColumn("_since", since).where((F.col(OP) == INSERT) | (F.col(SEQ) > F.col("_since")))
        by = rows.groupBy(BUCKET, *table.key)
        place = F.struct(SEQ, *columns)
        if table.merge == "sum":
            made = [(F.sum(c) if c in table.counters else F.max(c)).alias(c) for c in columns]
            return by.agg(*made)
        if table.merge == "latest":
            rank = F.struct(*([F.struct(table.order, place)] if table.order else [place]))
            whole = F.struct(*columns)
            got = by.agg(F.max_by(whole, rank).alias("_last"), F.min_by(whole, place).alias("_first"))
            return got.select(BUCKET, *table.key, *[F.col(f"{'_first' if c in table.fixed else '_last'}.{c}").alias(c) for c in columns])
        inserted = F.col(OP) == INSERT
        first = F.min_by(F.struct(*columns), F.when(inserted, place))
        over = {c: F.max_by(c, F.when(~inserted & F.col(c).isNotNull(), place)).alias(f"_over_{c}") for c in columns}
        got = by.agg(first.alias("_first"), *over.values())
        return got.select(BUCKET, *table.key, *[F.coalesce(f"_over_{c}", f"_first.{c}").alias(c) for c in columns])

    def _read(self, name: str, state: State, only: Column | None) -> DataFrame:
        """The merged rows, with their buckets."""
        table, names = self.tables[name], StructType.fromDDL(self.tables[name].schema).names
        folders = state.folders.get(name, [])
        if not folders:
            return self.spark.createDataFrame([], f"{table.schema}, {BUCKET} int")
        parts = [(f["base"], self._folder(name, f["at"], i)) for i, f in enumerate(folders)]
        if only is not None:
            parts = [(base, rows.where(only)) for base, rows in parts]
        base = next((rows for is_base, rows in parts if is_base), None)
        deltas = [rows for is_base, rows in parts if not is_base]
        if not deltas:
            return base.select(*names, BUCKET)
        delta = deltas[0]
        for rows in deltas[1:]:
            delta = delta.unionByName(rows)
        if base is None:
            return self._merged(name, delta).select(*names, BUCKET)
        touched = delta.select(BUCKET, *[F.col(c).alias(f"_k_{c}") for c in table.key]).distinct()
        same = (F.col(f"b.{BUCKET}") == F.col(f"t.{BUCKET}")) & F.lit(True)
        for c in table.key:
            same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"t._k_{c}"))
        old, keys = base.alias("b"), touched.alias("t")
        merged = self._merged(name, old.join(keys, same, "left_semi").unionByName(delta))
        return old.join(keys, same, "left_anti").select(*names, BUCKET).unionByName(merged.select(*names, BUCKET))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as a version has it, the last by default."""
        return self._read(name, self.state(version), None).drop(BUCKET)

    def lookup(self, name: str, *key) -> DataFrame:
        """The row of a key: of each folder one bucket is listed, and of its files the row groups that may hold the key are read."""
        table = self.tables[name]
        kinds = {f.name: f.dataType for f in StructType.fromDDL(table.schema)}
        given = [F.lit(v).cast(kinds[c]) for c, v in zip(table.key, key, strict=True)]
        number = self.spark.range(1).select(self._bucket(table, given).alias("b")).first()["b"]
        hit = F.col(BUCKET) == number
        for c, value in zip(table.key, given, strict=True):
            hit = hit & (F.col(c) == value)
        return self._read(name, self.state(), hit).drop(BUCKET)

    # Upkeep

    def compact(self, name: str) -> int:
        """Folds a table's deltas into a new base. Deltas that come meanwhile stay deltas."""
        before = self.state()
        rows = self._read(name, before, None).drop(BUCKET).withColumns({SEQ: F.lit(before.version).cast("long"), OP: F.lit(INSERT)})
        base = {"at": self._write(name, rows, "base"), "base": True}
        folded = {f["at"] for f in before.folders.get(name, [])}
        while True:
            now = self.state()
            held = now.folders.get(name, [])
            if not folded <= {f["at"] for f in held}:
                raise Conflict(f"{name} was compacted meanwhile")
            version = now.version + 1
            try:
                self._put(State(version, now.folders | {name: [base, *[f for f in held if f["at"] not in folded]]}, now.batches))
                return version
            except Conflict:
                continue

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes entries before the last `keep`, and folders that no kept entry names; not while commits are being written."""
        held = self.versions()
        for version in held[:-keep]:
            self._files.delete(self._path(self._log(version)), False)
        named = {f["at"].rstrip("/").rsplit("/", 1)[-1] for v in held[-keep:] for folders in self.state(v).folders.values() for f in folders}
        gone = []
        for name in self.tables:
            at = self._path(f"{self.root}/{name}")
            for status in self._files.listStatus(at) if self._files.exists(at) else []:
                if status.getPath().getName() not in named:
                    self._files.delete(status.getPath(), True)
                    gone.append(status.getPath().toString())
        return gone
