"""Written intermediate tables in the folder that driver and executors share.

A step that is read more than once, or whose lineage must be cut, is written as Parquet below `spark.checkpoint.dir`.
A lost executor then costs a re-read, not a recomputation. Only where that setting is absent (local tests) is a
folder of this machine used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only if the session runs in one local process without any."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="kestrion-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


_USED: dict[str, list[str]] = {}


def used(spark: SparkSession) -> list[str]:
    """The folders in which this application's operators have kept tables so far."""
    return list(_USED.get(spark.sparkContext.applicationId, []))


def clear(spark: SparkSession, but: list[str] | tuple[str, ...] = ()) -> None:
    """Deletes all that this application's operators have kept, but for some folders; their results must have been written or read by then."""
    app = spark.sparkContext.applicationId
    for base in _USED.get(app, []):
        if base not in but:
            Scratch.delete(spark, base)
    _USED[app] = [base for base in _USED.get(app, []) if base in but]


class Scratch:
    """Tables of one operator call, each below a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        _USED.setdefault(spark.sparkContext.applicationId, []).append(self.base)
        self.paths: dict[int, tuple[str, DataFrame]] = {}

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:02d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes `df` and returns a reader of it, with the lineage cut."""
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes what `keep` wrote for frames that nothing reads any more."""
        for df in frames:
            self.delete(self.spark, self.paths.pop(id(df))[0])

    @staticmethod
    def delete(spark: SparkSession, path: str) -> None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
