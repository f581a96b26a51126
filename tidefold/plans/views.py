"""Temporary views ops, entries, versions, edges, contents, pack_index over the driver's tables, and the marker parser as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tidefold.operators import graph, oplog, textmerge
from tidefold.plans import fixtures


def register(spark: SparkSession, sf_dir: str) -> None:
    rows = fixtures.plain(fixtures.ops(spark, sf_dir))
    versions = graph.build(graph.from_ops(rows))
    for name, df in (("ops", rows), ("entries", oplog.project(rows)), ("versions", versions), ("edges", graph.edges(versions)), ("contents", fixtures.contents(spark, sf_dir)), ("pack_index", fixtures.pack_index(spark, sf_dir))):
        df.createOrReplaceTempView(name)
    register_functions(spark)


def register_functions(spark: SparkSession) -> None:
    """conflict_segments(text): a row for each segment of a marked text, for lateral joins in SQL."""
    @udtf(returnType="pos int, kind string, lines array<string>, ours array<string>, base array<string>, theirs array<string>")
    class ConflictSegments:
        def eval(self, text: str) -> Iterator[tuple]:
            for i, x in enumerate(textmerge.parse(text) if text is not None else []):
                yield i, x["kind"], x["lines"], x["ours"], x["base"], x["theirs"]

    spark.udtf.register("conflict_segments", ConflictSegments)
