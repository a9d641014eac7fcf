"""Session-level helpers: shared working folder, lineage cuts, size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LEFT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, for cut tables.

    It is the checkpoint directory of the context, else the session's
    ``spark.checkpoint.dir``.  Only a session without either, on a local
    master, gets a temporary folder; a cluster without one is an error.
    """
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        conf = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, conf, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(conf)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Workspace:
    """Tables written to the shared folder so that iterative plans restart from
    files instead of a growing lineage; they survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _LEFT.append(self.root)

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` once and return a reader of the written table."""
        path = f"{self.root}/{tag}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        """Delete tables that no live plan reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for tag in tags:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tag}")
            path.getFileSystem(conf).delete(path, True)


@atexit.register
def _clean() -> None:
    for root in _LEFT:
        path = root[5:] if root.startswith("file:") else root
        if path.startswith("/") and Path(path).exists():
            shutil.rmtree(path, ignore_errors=True)


def size_checked(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are at most ``most``;
    beyond that the join stays a shuffle join, which AQE may split on skew."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
