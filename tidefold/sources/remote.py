"""What a server does with its log and blobs, as queries over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.operators.blobs import numbered


def pull(log: DataFrame, since: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(records after since by seq, one row with nextCursor and hasMore). limit is the feature: a page."""
    page = log.where(F.col("seq") > since).orderBy("seq").limit(limit + 1)
    records = page.orderBy("seq").limit(limit)
    told = page.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("seq")).alias("s")).select(F.when(F.col("n") == 0, F.lit(since)).otherwise(F.element_at("s", F.least("n", F.lit(limit)).cast("int"))).cast("bigint").alias("nextCursor"), (F.col("n") > limit).alias("hasMore"))
    return records, told


def append(log: DataFrame, incoming: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with seq, missing hashes) of incoming(clientOpId, pos, blobRefs, ...).

    A batch that names a blob the server lacks is refused as a whole; an id that is there already is
    passed over, so that sending again changes nothing. seq goes on without gaps.
    """
    missing = blob_check(incoming.select(F.explode_outer("blobRefs").alias("hash")).where("hash is not null"), blobs)
    first = incoming.groupBy("clientOpId").agg(F.min_by(F.struct(*incoming.columns), "pos").alias("r")).select("r.*")
    new = first.join(log.select("clientOpId"), "clientOpId", "left_anti").select(*incoming.columns)
    refused = missing.agg((F.count("*") > 0).alias("refused"))
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top"))
    one = top.join(refused, F.lit(True))  # one row
    rows = numbered(new, ["pos"]).join(F.broadcast(one), F.lit(True)).where("not refused")
    return rows.select(*incoming.columns, (F.col("top") + F.col("_n") + 1).alias("seq")), missing


def head_cursor(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("headCursor"))


def blob_check(hashes: DataFrame, blobs: DataFrame) -> DataFrame:
    """Distinct hashes that are not held."""
    return hashes.select("hash").distinct().join(blobs.select("hash"), "hash", "left_anti")


def blob_put(blobs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Blobs to insert: the first write of a hash wins."""
    return incoming.dropDuplicates(["hash"]).join(blobs.select("hash"), "hash", "left_anti")


def blob_get(wanted: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held blobs once each, missing rows(pos, hash) as often as asked) of wanted(pos, hash)."""
    held = blobs.join(wanted.select("hash").distinct(), "hash", "left_semi")
    return held, wanted.join(blobs.select("hash"), "hash", "left_anti").orderBy("pos")


def preflight(claim: str, owners: DataFrame, blobs: DataFrame, key_check: str, cap: int = 65536) -> DataFrame:
    """One row: verdict of a claim (free, yours, taken) and the key check's bytes if they are not over the cap. owners(vault, token)."""
    verdict = owners.agg(F.count("*").alias("n"), F.count_if(F.col("token") == claim).alias("mine")).select(F.when(F.col("n") == 0, "free").when(F.col("mine") > 0, "yours").otherwise("taken").alias("verdict"))
    check = blobs.where((F.col("hash") == key_check) & (F.length("bytes") <= cap)).agg(F.first("bytes").alias("keyCheck"))
    return verdict.join(check, F.lit(True))  # one row each
