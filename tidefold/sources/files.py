"""Directory listings, file contents, change events, and the sink that carries out file actions."""

from __future__ import annotations

import os
import re
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold import schemas


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, f"^.*?{root.rstrip('/')}/", "")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, size of all files below root; the contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.select(relative(F.col("path"), root).alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))


#: Wanted files up to this number are named to the scan, so that no others are opened; beyond it all are read and joined.
NAMED = 10_000


def contents(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """path, bytes of the wanted files; null bytes for files that are not there."""
    there = [r["path"] for r in listing(spark, root).select("path").join(paths.select("path"), "path", "left_semi").limit(NAMED + 1).collect()]
    if not there:
        return paths.withColumn("bytes", F.lit(None).cast("binary"))
    some = spark.read.format("binaryFile")
    if len(there) <= NAMED:
        rows = some.load([f"{root.rstrip('/')}/" + re.sub(r"([][{}*?,^!\\])", r"\\\1", p) for p in there])
    else:
        rows = some.option("recursiveFileLookup", "true").load(root)
    return paths.join(rows.select(relative(F.col("path"), root).alias("path"), F.col("content").alias("bytes")), "path", "left")


def change_events(spark: SparkSession, directory: str) -> DataFrame:
    """A stream of change events from JSON files."""
    return spark.readStream.schema(schemas.WATCH_EVENTS).json(directory)


def carry_out(actions: DataFrame, root: str) -> list[tuple[str, str]]:
    """Do the actions(verb, path, to_path, bytes) below root, one after another on the driver; returns (path, error) of those that failed.

    This is the one side effect on files; a caller passes what the plans say. Rows come one by one.
    """
    failed = []
    base = Path(root).resolve()

    def at(p: str) -> Path:
        out = (base / p).resolve()
        if base not in out.parents:
            raise ValueError(f"outside of {base}: {p}")
        return out

    for r in actions.select("verb", "path", "to_path", "bytes").toLocalIterator():
        try:
            if r["verb"] == "write":
                at(r["path"]).parent.mkdir(parents=True, exist_ok=True)
                part = at(r["path"]).with_name(at(r["path"]).name + ".tmp")
                part.write_bytes(bytes(r["bytes"]))
                os.replace(part, at(r["path"]))
            elif r["verb"] == "move":
                at(r["to_path"]).parent.mkdir(parents=True, exist_ok=True)
                shutil.move(at(r["path"]), at(r["to_path"]))
            elif r["verb"] == "trash" and at(r["path"]).exists():
                (base / ".trash").mkdir(exist_ok=True)
                shutil.move(at(r["path"]), base / ".trash" / at(r["path"]).name)
        except (OSError, ValueError) as e:
            failed.append((r["path"], str(e)))
    return failed
