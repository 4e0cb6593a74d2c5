"""Shared storage for intermediate tables, and table access by path."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where it is unset and Spark runs on this machine alone."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="quillspan-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint; for small frames."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; columns can then be pruned.

    The files go when the Python process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspan-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _OWN.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out._held = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that written() gave, once all that reads them has been written itself."""
    for df in frames:
        held = (df.sparkSession, df._held)
        _OWN.remove(held)
        _delete(*held)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer referred to."""
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget() -> None:
    """Delete what written() has left."""
    while _OWN:
        spark, path = _OWN.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already
            return


atexit.register(forget)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
