"""A keyed Parquet table in hash buckets: an upsert or delete rewrites only the buckets it touches.

``data/<write>/bucket=<n>`` holds the rows of a bucket as one write left them. ``versions/version=<n>``, one small
file a version, names the write that is valid for each bucket. A version exists once its file does, which Spark
puts in place last and in one step: a write that fails on the way leaves the version before it as it was.
Readers open the buckets of one version; what they read is not changed by later writes, only ``expire``
removes writes that no kept version names. One writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

VERSION = "version bigint, bucket int, buckets int, write string"


@dataclass(frozen=True)
class KeyedTable:
    """The table at ``path``, whose rows are told apart by ``key`` (unique, not null)."""

    spark: SparkSession
    path: str
    key: str
    schema: StructType

    def create(self, rows: DataFrame, buckets: int = 64) -> int:
        """The first version, of ``buckets`` buckets: about one for every 128 MB the table will hold."""
        if buckets <= 0:
            raise ValueError("buckets must be positive")
        held = rows.select(self.schema.names)
        return self._commit(1, buckets, {}, range(buckets), held)

    def versions(self) -> list[int]:
        return sorted({r["version"] for r in self._all().select("version").distinct().collect()})

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one unless given."""
        return self._rows(self._version(version)[2])

    def merge(self, changes: DataFrame, deleted: DataFrame | None = None) -> int:
        """Replace rows with the keys of ``changes``, add those that are new, drop the keys of ``deleted``.

        ``changes`` has the columns of the table; of several rows with one key any one stays. A key that is
        both changed and deleted is deleted. Returns the new version.
        """
        last, buckets, valid = self._version(None)
        bucket = self._bucket(buckets)
        new = changes.select(self.schema.names).dropDuplicates([self.key])
        gone = (changes.limit(0) if deleted is None else deleted).select(self.key).distinct()
        keys = new.select(self.key).unionByName(gone)
        touched = sorted(r["bucket"] for r in keys.select(bucket.alias("bucket")).distinct().collect())  # at most all buckets
        before = self._rows({b: w for b, w in valid.items() if b in set(touched)})
        kept = before.join(new.select(self.key), self.key, "left_anti").unionByName(new).join(gone, self.key, "left_anti")
        return self._commit(last + 1, buckets, valid, touched, kept)

    def delete(self, keys: DataFrame) -> int:
        return self.merge(self.spark.createDataFrame([], self.schema), keys)

    def expire(self, keep: int = 2) -> int:
        """Remove writes that none of the last ``keep`` versions names; returns how many went."""
        if keep <= 0:
            raise ValueError("keep must be positive")
        rows = self._all().collect()  # at most buckets rows a version
        old = self.versions()[:-keep]
        used = {r["write"] for r in rows if r["version"] not in old}
        unused = {r["write"] for r in rows} - used - {""}
        for place in [f"versions/version={v}" for v in old] + [f"data/{w}" for w in unused]:
            self._remove(f"{self.path}/{place}")
        return len(unused)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _all(self) -> DataFrame:
        return self.spark.read.schema(VERSION).parquet(f"{self.path}/versions")

    def _version(self, version: int | None) -> tuple[int, int, dict[int, str]]:
        """Number, buckets, and the valid write of each bucket that has rows."""
        every = self._all()
        number = every.agg(F.max("version")).first()[0] if version is None else version
        rows = every.where(F.col("version") == number).collect()
        if not rows:
            raise ValueError(f"no version {number}")
        return number, rows[0]["buckets"], {r["bucket"]: r["write"] for r in rows if r["write"]}

    def _rows(self, valid: dict[int, str]) -> DataFrame:
        if not valid:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{w}/bucket={b}" for b, w in sorted(valid.items())])

    def _commit(self, version: int, buckets: int, valid: dict[int, str], touched, rows: DataFrame) -> int:
        """Write the rows of the touched buckets, then the file of the version."""
        write, touched = uuid.uuid4().hex, set(touched)
        by_bucket = rows.withColumn("bucket", self._bucket(buckets))
        by_bucket.repartition(max(1, min(len(touched), 4096)), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{write}")
        # a bucket that lost all its rows has no folder
        written = self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(f"{self.path}/data/{write}")
        filled = {r["bucket"] for r in written.select("bucket").distinct().collect()}
        named = {b: w for b, w in valid.items() if b not in touched} | {b: write for b in filled}
        rows_of = [(version, b, buckets, named.get(b, "")) for b in range(buckets)]
        self.spark.createDataFrame(rows_of, VERSION).drop("version").coalesce(1).write.parquet(f"{self.path}/versions/version={version}")
        return version

    def _remove(self, path: str) -> None:
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
