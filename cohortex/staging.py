"""Lineage cuts that survive the loss of executors.

``stage`` writes a table to the folder that ``spark.checkpoint.dir`` names and
reads it back.  Unlike ``localCheckpoint`` the copy is on shared storage, and
unlike ``checkpoint`` it is columnar, compressed and prunable.  A folder of our
own is set only where the session has none and runs in one process (tests,
notebooks); on a cluster a missing folder is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_made: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one where none is set and the session is local."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cohortex-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/cohortex-{_RUN}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs inside the block are deleted as it ends, not when the driver happens to collect its garbage."""
    was = spark.conf.get(_DROP, None)
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_DROP) if was is None else spark.conf.set(_DROP, was)


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to shared storage; the result reads that copy."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:10]}"
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def release(*dfs: DataFrame) -> None:
    """Delete staged copies that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_staged_path", None)
        if path in _made:
            fs, p = _fs(_made.pop(path), path)
            fs.delete(p, True)


@contextmanager
def released(spark: SparkSession):
    """Everything staged inside the block is deleted when it ends: wrap a query and the action on its result.

    The block gets a list; staged copies that are put into it stay.
    """
    before, kept = set(_made), []
    try:
        yield kept
    finally:
        stay = before | {getattr(d, "_staged_path", None) for d in kept}
        for path in [p for p, s in _made.items() if p not in stay and s is spark]:
            fs, p = _fs(_made.pop(path), path)
            fs.delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
        except Exception:  # the session may be gone; the folder belongs to the cluster
            pass
