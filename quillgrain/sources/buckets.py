"""A Parquet table in hash buckets that a batch changes in part.

Rows lie by a hash of their keys in a fixed number of buckets. A change reads and rewrites only the
buckets it touches, under its own number, and then commits a manifest: the number under which each
bucket was last written. A number that is committed already changes nothing, so a replayed batch is a
no-op; one that failed before its manifest leaves the table as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a table; a manifest has a row for each.
BUCKETS = 64


def _names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, on any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class BucketTable:
    """The table below `place`; its rows have `schema` and are dealt by `keys`."""

    def __init__(self, spark: SparkSession, place: str, keys: list[str], schema: StructType, buckets: int = BUCKETS):
        self.spark, self.place, self.keys, self.schema, self.buckets = spark, place.rstrip("/"), keys, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def numbers(self) -> list[int]:
        """The committed changes, in order; a manifest counts once it is whole."""
        folder = f"{self.place}/manifest"
        return sorted(int(n) for n in _names(self.spark, folder) if n.isdigit() and "_SUCCESS" in _names(self.spark, f"{folder}/{n}"))

    def manifest(self, number: int | None = None) -> dict[int, int]:
        """Bucket -> the change that wrote it last; at most one row for each bucket."""
        done = self.numbers()
        number = number if number is not None else (done[-1] if done else None)
        if number is None:
            return {}
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.place}/manifest/{number}").collect()}

    def read(self, only: set[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        at = {b: v for b, v in self.manifest().items() if only is None or b in only}
        folders = [f"{self.place}/data/{v}/bucket={b}" for b, v in sorted(at.items())]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def change(self, number: int, touched: DataFrame, make: Callable[[DataFrame], DataFrame]) -> bool:
        """Rewrites the buckets of the keys in `touched` as `make` says of their rows; False if it was done before."""
        if number in self.numbers():
            return False
        some = {r.b for r in touched.select(self.bucket().alias("b")).distinct().collect()}  # numbers of buckets
        new = make(self.read(some)).select(*self.schema.names).withColumn("bucket", self.bucket())
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.place}/data/{number}")
        held = {int(n.split("=")[1]) for n in _names(self.spark, f"{self.place}/data/{number}") if n.startswith("bucket=")}
        if not held <= some:
            raise ValueError("a change made rows of keys that it doesn't touch")
        now = {b: v for b, v in self.manifest().items() if b not in some} | {b: number for b in held}
        rows = self.spark.createDataFrame(sorted(now.items()), "bucket int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.place}/manifest/{number}")
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Drops buckets that none of the last `keep` manifests names; how many. A committed number stays known."""
        done = self.numbers()
        used = {(v, b) for n in done[-keep:] for b, v in self.manifest(n).items()}
        gone = 0
        for n in done:
            for name in _names(self.spark, f"{self.place}/data/{n}"):
                if name.startswith("bucket=") and (n, int(name.split("=")[1])) not in used:
                    _drop(self.spark, f"{self.place}/data/{n}/{name}")
                    gone += 1
        return gone
