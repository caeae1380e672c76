"""Tables in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; one of our own only where it is unset and Spark runs in one process, as in tests."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="sessionloom-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs a read, not a recomputation.  The shuffle files of the
    write are of no more use; Spark drops them once the driver's garbage is collected.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def committed(spark: SparkSession, root: str, key: str) -> list[int]:
    """The numbers of the folders ``key=number`` in ``root`` that Spark has written whole, in order."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    there = [p.getPath() for p in fs.listStatus(at) if p.getPath().getName().startswith(f"{key}=")]
    return sorted(int(p.getName().split("=")[1]) for p in there if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
