"""Tables written to the folder that driver and executors share, and deleted once nothing reads them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Shuffles go with the job that made them, where Spark knows this; a collection alone leaves those of the last job.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where no ``spark.checkpoint.dir`` is set and driver and executors are one process (as in
    tests) a temporary folder of this machine is made and recorded in the session; a cluster without one raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="causeway-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str, *more: DataFrame) -> DataFrame:
    """Writes ``df``, then each of ``more``, to one table in the shared folder and returns the written table.

    This cuts the lineage: a lost executor costs a re-read of files, not a recomputation.  The shuffles of what was
    written are deleted as the write ends; those of other jobs are garbage, and a collection tells Spark so.  Files are
    zstd's, which take less disk than the default's.
    The folder goes when the session's JVM ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        for part in (df, *more):
            part.write.mode("append").option("compression", "zstd").parquet(path)
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
            jvm.System.gc()
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._causeway_path = jpath
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote and nothing reads any more."""
    for df in tables:
        path = df._causeway_path
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
