"""Tables as versioned Parquet: inserts, upserts, updates, replacement, pruning, schema evolution.

State changes are functions from tables to the next table; VersionedTable writes that to a new folder and then
moves a pointer file, so readers see one version or the other. One writer a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lookup(table: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of one key; the test reaches the scan."""
    return table.where(F.col(key) == value)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old, and of new the rows (the first by order of columns on ties) whose key it lacks: first write wins."""
    fresh = new.join(old.select(key), key, "left_anti").select(new.columns)
    first = F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key]))
    return old.unionByName(fresh.withColumn("_first", first).where("_first = 1").drop("_first"), allowMissingColumns=True)


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str, id_column: str | None = None) -> DataFrame:
    """One row a key, the latest by `order`, new before old; an existing row's id_column is kept."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    by_key = Window.partitionBy(*keys)
    if id_column:
        both = both.withColumn("_id", F.min(F.struct("_new", id_column)).over(by_key))
    rank = F.row_number().over(by_key.orderBy(F.col("_new").desc(), F.col(order).desc(), *([F.col(id_column).desc()] if id_column else [])))
    kept = both.withColumn("_rank", rank).where("_rank = 1")
    if id_column:
        kept = kept.withColumn(id_column, F.col(f"_id.{id_column}"))
    return kept.select(old.columns)


def upsert_accumulate(old: DataFrame, new: DataFrame, key: str, counters: list[str], latest: list[str]) -> DataFrame:
    """Counters add up, times take the latest."""
    return old.unionByName(new).groupBy(key).agg(*[F.sum(c).alias(c) for c in counters], *[F.max(c).alias(c) for c in latest])


def update_by_key(old: DataFrame, changes: DataFrame, key: str, columns: list[str], reset: list[str] = ()) -> DataFrame:
    """old with the changes' non-null values; columns in `reset` become null where a change touches their row."""
    held = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns]).withColumn("_touched", F.lit(True))
    joined = old.join(held, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_new_{c}", c))
    for c in reset:
        joined = joined.withColumn(c, F.when(F.col("_touched").isNull(), F.col(c)))
    return joined.select(old.columns)


def retain_members(rows: DataFrame, key: str, allowed: DataFrame, allowed_key: str) -> DataFrame:
    """Rows whose key is allowed; all rows if nothing is allowed, as then the list is not to be trusted."""
    keys = allowed.select(F.col(allowed_key).alias(key)).distinct()
    return rows.join(keys, key, "left_semi") if keys.limit(1).count() else rows


def append_version(versions: DataFrame, row: DataFrame) -> DataFrame:
    """versions with the row under the next number."""
    last = versions.agg(F.coalesce(F.max("version"), F.lit(0))).scalar()
    return versions.unionByName(row.withColumn("version", (last + 1).cast("int")), allowMissingColumns=True)


def with_columns(rows: DataFrame, columns: dict[str, str], constants: dict[str, object] | None = None) -> DataFrame:
    """rows with the columns they lack, null or a constant."""
    have = set(rows.columns)
    return rows.withColumns({c: F.lit((constants or {}).get(c)).cast(kind) for c, kind in columns.items() if c not in have})


class VersionedTable:
    """A table of numbered Parquet folders and a pointer to the one in force."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _pointer(self) -> int:
        rows = self.spark.read.schema("version long").parquet(f"{self.path}/_pointers") if self._exists(f"{self.path}/_pointers") else None
        return (rows.agg(F.max("version").alias("v")).first()["v"] or 0) if rows is not None else 0

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def read(self) -> DataFrame:
        version = self._pointer()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{version}") if version else self.spark.createDataFrame([], self.schema)

    def change(self, make: Callable[[DataFrame], DataFrame]) -> int:
        """Writes make(current) as the next version and points to it."""
        version = self._pointer() + 1
        make(self.read()).write.mode("overwrite").parquet(f"{self.path}/v{version}")
        self.spark.range(1).select(F.lit(version).cast("long").alias("version")).write.mode("append").parquet(f"{self.path}/_pointers")
        return version
