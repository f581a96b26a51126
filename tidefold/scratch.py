"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_USED: set[str] = set()


def folder(spark: SparkSession) -> str:
    """This application's part of the folder of spark.checkpoint.dir; it goes when the driver's program ends.

    Where none is set and all runs on one machine, as in tests, a local one is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidefold-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tidefold-{spark.sparkContext.applicationId}"
    if path not in _USED:
        _USED.add(path)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(_delete, jvm, conf, path)
    return path


def _delete(jvm, conf, path: str) -> None:
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # the JVM may have ended before; what is left is in the folder that the session named
        pass


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df written as Parquet and read again: its lineage and plan end there, and executors may be lost.

    It is also put between an aggregate and a join with it on the same key: a join that reads two
    exchanges can split a hot key, one that reads an aggregate as it is cannot.
    """
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
