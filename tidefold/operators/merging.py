"""Merge and marker kernels as DataFrame operators: cheap cases in Catalyst, the rest by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidefold import schemas
from tidefold.functions import text as tx
from tidefold.operators import textmerge


def _kind(ddl: str) -> T.DataType:
    return T._parse_datatype_string(ddl)


def map_rows(df: DataFrame, name: str, ddl: str, reads: list[str], make: Callable) -> DataFrame:
    """df with a column made of some columns of each row."""
    kind = _kind(ddl)
    arrow = to_arrow_type(kind)
    kept = [x for x in df.columns if x != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 512):
                b = whole.slice(a, 512)
                made = [make(*row) for row in zip(*(b.column(x).to_pylist() for x in reads), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), pa.array(made, arrow)], names=[*kept, name])

    return df.mapInArrow(run, T.StructType([*(df.schema[x] for x in kept), T.StructField(name, kind)]))


def diff_lines(df: DataFrame, a: str, b: str, out: str = "diff") -> DataFrame:
    """Runs of equal, deleted and inserted lines between two text columns."""
    return map_rows(df, out, "array<struct<kind:string,lines:array<string>>>", [a, b], lambda x, y: None if x is None or y is None else [{"kind": k, "lines": v} for k, v in textmerge.diff(textmerge.split_lines(x), textmerge.split_lines(y))])


def three_way(df: DataFrame, base: str = "base", ours: str = "ours", theirs: str = "theirs", out: str = "merge", canonical: bool = False) -> DataFrame:
    """df with the merge of three text columns.

    Rows in which a side is as the other or as the base are answered by a CASE and never leave the JVM;
    only the rest goes through the kernel. Null texts give a null merge.
    """
    b, o, t = (F.regexp_replace(x, "\r\n?", "\n") for x in (base, ours, theirs))
    empty = F.from_json(F.lit("[]"), f"array<{schemas.CHUNK}>")
    clean = lambda x: F.struct(tx.lines(F.col(x)).alias("merged"), empty.alias("conflicts"), F.lit(False).alias("hasConflicts"), F.lit(False).alias("tooLarge"))
    known = F.when((o == t) | (t == b), clean(ours)).when(o == b, clean(theirs)).cast(schemas.MERGED)
    hard = F.coalesce((o != t) & (t != b) & (o != b), F.lit(False))
    easy = df.where(~hard).withColumn(out, known)
    rest = map_rows(df.where(hard), out, schemas.MERGED, [base, ours, theirs], lambda x, y, z: textmerge.three_way(x, y, z, canonical))
    return easy.unionByName(rest)


def render(df: DataFrame, merge: str = "merge", out: str = "marked") -> DataFrame:
    """df with marked text; merges without conflicts are joined without leaving the JVM."""
    clean = F.coalesce(F.size(f"{merge}.conflicts") == 0, F.col(merge).isNull())
    easy = df.where(clean).withColumn(out, F.array_join(f"{merge}.merged", "\n"))
    return easy.unionByName(map_rows(df.where(~clean), out, "string", [merge], textmerge.render))


def parse(df: DataFrame, text: str = "text", out: str = "segments") -> DataFrame:
    return map_rows(df, out, schemas.SEGMENTS, [text], lambda t: None if t is None else textmerge.parse(t))


def segments(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each segment: df's columns, pos, and the segment's fields."""
    return parse(df, text, "_s").select(*df.columns, F.posexplode("_s").alias("pos", "_x")).select(*df.columns, "pos", "_x.*")


def count_conflicts(df: DataFrame, text: str = "text", out: str = "n_conflicts") -> DataFrame:
    """df with the number of conflicts; only texts with an opening mark are parsed."""
    opened = F.coalesce(F.exists(tx.lines(F.col(text)), lambda x: x.startswith(tx.OURS)), F.lit(False))
    easy = df.where(~opened).withColumn(out, F.when(F.col(text).isNotNull(), 0))
    return easy.unionByName(parse(df.where(opened), text, "_s").withColumn(out, F.size(F.filter("_s", lambda x: x["kind"] == "conflict"))).drop("_s"))


def resolve(df: DataFrame, text: str = "text", picks: str = "picks", out: str = "resolved") -> DataFrame:
    """df with every conflict replaced by what its pick takes; only texts with an opening mark are parsed."""
    opened = F.coalesce(F.exists(tx.lines(F.col(text)), lambda x: x.startswith(tx.OURS)), F.lit(False))
    easy = df.where(~opened).withColumn(out, F.array_join(tx.lines(F.col(text)), "\n"))
    return easy.unionByName(map_rows(df.where(opened), out, "string", [text, picks], lambda t, p: textmerge.resolve(t, dict(p) if p else None)))


def bulk_resolve(files: DataFrame, picks: DataFrame) -> DataFrame:
    """files(path, text) resolved by picks(path, picks): path, resolved, n_left, failed; a file without picks or without text fails by itself."""
    some = picks.join(files, "path", "left")
    done = count_conflicts(resolve(some), "resolved", "n_left")
    return done.select("path", "resolved", "n_left", (F.col("text").isNull() | (F.col("n_left") > 0)).alias("failed"))
