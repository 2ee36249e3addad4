"""The folder that driver and executors share, and tables in it that end lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Files of a stored table whose rows are bounded by a count.
LEAST_FILES, ROWS_PER_FILE = 8, 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; one of our own only where it is unset, in local mode."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        conf = f"file://{tempfile.mkdtemp(prefix='loomwork-shared-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def stored(df: DataFrame, what: str = "step", scratch: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, so that a lost executor costs no
    earlier stage. The files go when the application ends, or, noted in scratch, with ``dropped``.
    rows, a bound on df's rows where one is known, keeps small tables in few files."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, rows // ROWS_PER_FILE))
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, hadoop_path = _file_system(spark, path)
    files.deleteOnExit(hadoop_path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a step of an iteration. Held on the executors' disks while it is written, so that nothing is
    computed twice; an executor lost meanwhile costs a recomputation, afterwards nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    df.persist(StorageLevel.DISK_ONLY)
    out = df.checkpoint()
    df.unpersist()
    return out


def dropped(spark: SparkSession, scratch: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in scratch:
        files, hadoop_path = _file_system(spark, path)
        files.delete(hadoop_path, True)
    scratch.clear()
