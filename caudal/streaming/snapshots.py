"""Streaming side: arrivals merged into the latest state per key, duplicates dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from caudal.operators.latest import latest_snapshots


class VersionedTable:
    """A Parquet table as version folders and a pointer: readers never see a half-written version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._p = jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        at = self._p(self.path)
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self._fs.exists(self._p(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def write(self, df: DataFrame, keep: int = 2) -> int:
        """Write the next version; the last ``keep`` stay, so that readers of the one before can finish."""
        found = self.versions()
        n = (found[-1] if found else 0) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{n}")
        for old in found[: max(0, len(found) + 1 - keep)]:
            self._fs.delete(self._p(f"{self.path}/v{old}"), True)
        return n


class BucketedTable(VersionedTable):
    """A versioned table in buckets of a key's hash: a version holds only the buckets that changed.

    A bucket is read from the newest complete version that has it; the one before stays for readers that
    are under way.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        super().__init__(spark, path)
        self.buckets = buckets

    def _held(self) -> dict[int, list[int]]:
        """Versions of each bucket, oldest first."""
        held: dict[int, list[int]] = {}
        for v in self.versions():
            for s in self._fs.listStatus(self._p(f"{self.path}/v{v}")):
                name = s.getPath().getName()
                if name.startswith("bucket="):
                    held.setdefault(int(name[7:]), []).append(v)
        return held

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        paths = [f"{self.path}/v{vs[-1]}/bucket={b}" for b, vs in sorted(self._held().items()) if only is None or b in only]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, df: DataFrame, keep: int = 2) -> int:
        """Write rows with their ``bucket`` as the next version of those buckets."""
        found = self.versions()
        n = (found[-1] if found else 0) + 1
        df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{n}")
        for b, vs in self._held().items():
            for old in vs[:-keep]:
                self._fs.delete(self._p(f"{self.path}/v{old}/bucket={b}"), True)
        return n


def merge_latest(stream: DataFrame, table: VersionedTable, key: str, mode: str | None, synced: str, unique: str, checkpoint: str) -> DataStreamWriter:
    """Keep the latest snapshot of each key over all arrivals; replayed batches change nothing.

    The result equals the batch choice over everything that arrived, whatever the batches were. Of a
    ``BucketedTable`` only the buckets with arrivals are read and written again.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if not isinstance(table, BucketedTable):
            stored = table.read()
            table.write(latest_snapshots(batch if stored is None else stored.unionByName(batch), key, mode, synced, unique))
            return
        touched = [r["b"] for r in batch.select(table.bucket(key).alias("b")).distinct().collect()]  # at most the buckets
        if touched:
            stored = table.read(touched)
            newest = latest_snapshots(batch if stored is None else stored.unionByName(batch), key, mode, synced, unique)
            table.write(newest.withColumn("bucket", table.bucket(key)))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def drop_repeats(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Requests or payloads once each; repeats that come later than ``delay`` are not remembered."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, width: str, delay: str, by: list[str]) -> DataFrame:
    """Counts per time window and group; events later than ``delay`` are dropped."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), *by).agg(F.count("*").alias("n"))


def read_new_files(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    """Stream of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
