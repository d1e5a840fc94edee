"""Stored tables that change: replaced documents, upserts that switch at once, vectors that are made once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discarded, written

#: Partitions of a store, by a hash of the key.
PARTS = 32


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _partition_write(rows: DataFrame, path: str, **options: str) -> None:
    # One task for each part and a share of its rows, so that a part has few files and no task holds a large part whole.
    rows.hint("rebalance", "part").write.partitionBy("part").options(**options).mode("overwrite").parquet(path)


def create(rows: DataFrame, path: str, key: str = "doc_id") -> None:
    """A store of rows, partitioned by a hash of the key."""
    _partition_write(rows.withColumn("part", _part(key)), path)


def replace(rows: DataFrame, gone: DataFrame, path: str, key: str = "doc_id") -> None:
    """In the store: of all keys in `gone` (key) the rows go, and rows (with those keys) come in.

    Only partitions that hold such a key are written; the others keep their
    files. They are made beside the store first, so a job that fails before the
    last step changes nothing; the same call again changes nothing more.
    """
    spark = rows.sparkSession
    keys = gone.select(key).distinct()
    parts = keys.select(_part(key).alias("part")).distinct()  # PARTS rows at most
    old = spark.read.parquet(path).join(F.broadcast(parts), "part", "left_semi")
    new = old.join(keys, key, "left_anti").unionByName(rows.withColumn("part", _part(key)).select(*old.columns))
    staged = written(new, "staged")
    _partition_write(staged, path, partitionOverwriteMode="dynamic")
    # A partition that has lost all its rows is not in what was written.
    left = {r["part"] for r in staged.select("part").distinct().collect()}
    for r in parts.collect():
        if r["part"] not in left:
            _delete(spark, f"{path}/part={r['part']}")
    discarded(staged)


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _delete(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)


class Versioned:
    """A table of rows with one newest row for each key, whose batches switch in at once.

    Parts are folders of Parquet files that never change. A version is a small
    file that names each part's folder (PARTS names) and the last batch; it is
    renamed into place as the last step of a batch, which fails if another
    writer was first. Readers take the newest version, so they see all of a
    batch or nothing; a batch that failed leaves folders that no version names.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def _version(self) -> tuple[int, dict]:
        files, where = _files(self.spark, f"{self.path}/versions")
        if not files.exists(where):
            return 0, {"batch": -1, "parts": {}}
        last = max((int(s.getPath().getName()) for s in files.listStatus(where) if s.getPath().getName().isdigit()), default=0)
        text = self.spark.read.text(f"{self.path}/versions/{last}").first()[0]
        return last, json.loads(text)

    def read(self) -> DataFrame:
        return self._read(self._version()[1])

    def _read(self, version: dict, parts: list[int] | None = None) -> DataFrame:
        folders = sorted({f for p, f in version["parts"].items() if parts is None or int(p) in parts})
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def upsert(self, rows: DataFrame, batch: int, newest: Callable[[DataFrame], DataFrame]) -> bool:
        """Brings a batch in: of all rows of a key those that `newest` leaves. False if the batch is in already."""
        number, version = self._version()
        if batch <= version["batch"]:
            return False
        new = rows.withColumn("part", _part(self.key))
        parts = [r["part"] for r in new.select("part").distinct().collect()]  # PARTS rows at most
        old = self._read(version, parts).withColumn("part", _part(self.key))
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        _partition_write(newest(old.unionByName(new.select(*old.columns))), folder)
        version = {"batch": batch, "parts": version["parts"] | {str(p): f"{folder}/part={p}" for p in parts}}
        files, draft = _files(self.spark, f"{folder}-version")
        out = files.create(draft)
        out.write(json.dumps(version).encode())
        out.close()
        _, target = _files(self.spark, f"{self.path}/versions/{number + 1}")
        files.mkdirs(target.getParent())
        if files.exists(target) or not files.rename(draft, target):
            raise RuntimeError("another writer was first")
        return True


class Memo:
    """Vectors by the key of their text (id, text in; id, key, vector out), each made once.

    The store is bucketed and sorted by key, so that a lookup shuffles the asked
    keys alone, never the store. Appends leave several files in a bucket.
    """

    BUCKETS = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.name = spark, path, f"memo_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"

    def known(self) -> DataFrame | None:
        return self.spark.table(self.name) if self.spark.catalog.tableExists(self.name) else None

    def fresh(self, rows: DataFrame) -> DataFrame:
        """The distinct keys and texts of rows (key, text) that the store has not."""
        rows = rows.select("key", "text").dropDuplicates(["key"])
        known = self.known()
        return rows if known is None else rows.join(known.select("key"), "key", "left_anti")

    def remember(self, made: DataFrame) -> int:
        """Stores made (key, vector), and says how many they were."""
        made = written(made.select("key", "vector"), "made")
        made.write.bucketBy(self.BUCKETS, "key").sortBy("key").option("path", self.path).mode("append").saveAsTable(self.name)
        n = made.count()
        discarded(made)
        return n

    def forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
