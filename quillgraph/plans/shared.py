"""Where intermediate tables go, and how lineage is cut.

Intermediate results live in the folder that every executor shares
(``spark.checkpoint.dir``), so losing an executor never loses them.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only for a local master without any."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _removed(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame | None) -> None:
    """Removes the files of tables that ``cut`` made. Only for those that no plan still to be run reads."""
    for df in tables:
        if df is not None:
            kept = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
            if kept.isDefined():
                _removed(df.sparkSession, kept.get())


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a table that was written to the shared folder."""
    _removed(spark, path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files and checkpoints that nothing refers to any more.

    The cleaner acts when the driver's JVM collects garbage, which a mostly idle driver rarely
    does; long chains of cut steps call this after large ones, so disk use is a step's and not the chain's."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
