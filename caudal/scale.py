"""Helpers that keep plans safe at large scale: shared materialisation and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured JSON size stays under this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``; where that is unset (tests) a local one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="caudal-")
    delete_at_exit(spark, f"file://{folder}")
    spark.sparkContext.setCheckpointDir(folder)
    return jsc.getCheckpointDir().get()


_written: list[str] = []


def cleanup(spark: SparkSession) -> None:
    """Delete the tables that this process wrote into the shared folder; frames built on them end with them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the driver's JVM ends, with or without a session by then."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table into the shared folder and read it back.

    Cuts lineage like ``checkpoint()``, but columnar, so later readers prune columns. The files
    outlive lost executors; they are deleted when the driver ends, or by ``cleanup``.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_size(df: DataFrame) -> int:
    """Exact size of ``df`` as JSON, by one distributed aggregate."""
    return df.select(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("b")).first()["b"] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``F.broadcast(df)`` if its measured size is at most ``limit``, else ``df`` (shuffle join, AQE splits skew).

    Give it a materialised or cheap frame: it is scanned once to be measured.
    """
    return F.broadcast(df) if byte_size(df) <= limit else df


_shipped: set[str] = set()
_shipping = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application: their Python workers import it."""
    sc = spark.sparkContext
    with _shipping:  # another thread's job waits until the package is there
        if sc.applicationId in _shipped:
            return
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="caudal-")
        atexit.register(shutil.rmtree, folder, True)
        archive = Path(folder) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame | list[DataFrame]:
    """Tables ``names`` of the folder ``sf_dir``."""
    ship_package(spark)
    frames = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return frames[0] if len(frames) == 1 else frames
