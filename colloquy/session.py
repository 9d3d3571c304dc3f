"""Session helpers: reliable checkpoints and table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where the session names none, a temporary folder in local mode and an error on a cluster."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.master.partition("[")[0] != "local":
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a shared folder")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="colloquy-shared-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
    return "file://" + _OWN[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it from there: cuts the lineage, survives lost executors.

    The table is deleted when the application ends.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/colloquy-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    _remove_at_exit(spark, at.rpartition("/")[0])
    return spark.read.schema(df.schema).parquet(at)


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    if folder in _TABLES:
        return
    _TABLES.add(folder)

    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the application may be gone already
            pass

    atexit.register(remove)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = 100_000, limit_bytes: int = 64 << 20) -> DataFrame:
    """Join with a written table: broadcast if it has at most ``limit`` rows and ``limit_bytes`` bytes as written, else an ordinary shuffle join (skew is AQE's)."""
    size = int(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return big.join(F.broadcast(small) if size <= limit_bytes and small.limit(limit + 1).count() <= limit else small, on, how)


_OWN: dict[str, str] = {}
_TABLES: set[str] = set()
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():
        out = os.path.join(tempfile.mkdtemp(prefix="colloquy-"), "colloquy.zip")
        atexit.register(shutil.rmtree, os.path.dirname(out), ignore_errors=True)
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(f.relative_to(root.parent)))
        sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows evenly before costly per-row work when the scan yields fewer splits than the cluster has cores."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, cores(df.sparkSession)), *keys)
