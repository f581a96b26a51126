"""URL filtering against lists that change over time, as an as-of join.

A list is a log of dated entries (list_name, domain, day, action): "add" makes a domain listed from that
day on, "remove" ends it. Entries become validity intervals [valid_from, valid_to) with a window per
list and domain; a capture of a URL is judged by the intervals that hold at its fetch time, for its
host and for every parent domain. All of it is DataFrame operations.

Captures are first reduced to the distinct (domain, day) that occur, with a partial aggregate, so that
a host with a third of all captures meets its intervals once a day and not once a capture; verdicts go
back to captures by a join that may split a hot host. Intervals of a domain are few (one for each time
it was listed), hosts have at most MAX_LABELS labels, so nothing grows with the square of a group.

Null or malformed URLs have no host, are never listed and are kept. Of several entries for one list,
domain and day the last action in the order add, remove counts (remove wins). A second add while
listed changes nothing. Captures without a fetch day are judged by no entry. Repeated rows are judged
alike. Columns of the input with the names of results give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidefold.llm import common as c

#: The most labels that a host name can have: 253 characters, a dot between any two.
MAX_LABELS = 127


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where there is none."""
    raw = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(raw, r"\.+$", "")
    return F.when(host != "", host)


def parents_of(host: Column) -> Column:
    """The host and its parent domains of at least two labels; the host alone if it has fewer, or so many that it is no host name."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    many = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.array_join(F.slice(labels, i + 1, n), "."))
    return F.when((n >= 2) & (n <= MAX_LABELS), many).otherwise(F.array(host))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, domain, valid_from, valid_to) of entries(list_name, domain, day, action); valid_to null: still listed."""
    day = entries.where("list_name is not null and domain is not null and day is not null and action in ('add', 'remove')").groupBy("list_name", F.lower("domain").alias("domain"), "day").agg(F.max("action").alias("action"))
    by = W.partitionBy("list_name", "domain").orderBy("day")
    turns = day.withColumn("_was", F.lag("action").over(by)).where("_was is null and action = 'add' or action <> _was")
    return turns.withColumn("valid_to", F.lead("day").over(by)).where("action = 'add'").select("list_name", "domain", F.col("day").alias("valid_from"), "valid_to")


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """captures with host, n_lists (lists that hold the URL at its day), first_list and kept."""
    new = ("host", "n_lists", "first_list", "kept")
    own = [x for x in captures.columns if x not in new]  # the input's columns step aside under numbers, whatever their names
    rows = captures.select(*(F.col(f"`{x}`").alias(f"c{i}") for i, x in enumerate(own)), host_of(F.col(f"`{url}`")).alias("_host"), F.col(f"`{day}`").alias("_day"))
    asked = rows.where("_host is not null and _day is not null").groupBy("_host", "_day").agg(F.lit(1).alias("_one"))
    met = asked.select("_host", "_day", F.explode(parents_of(F.col("_host"))).alias("domain"))
    hits = met.join(intervals(entries), "domain").where("valid_from <= _day and (valid_to is null or _day < valid_to)")
    verdict = c.materialize(hits.groupBy("_host", "_day").agg(F.count_distinct("list_name").alias("n_lists"), F.min("list_name").alias("first_list")))
    out = rows.join(verdict, ["_host", "_day"], "left")
    return out.select(*(F.col(f"c{i}").alias(x) for i, x in enumerate(own)), F.col("_host").alias("host"), F.coalesce("n_lists", F.lit(0)).cast("long").alias("n_lists"), "first_list", F.coalesce(F.col("n_lists") == 0, F.lit(True)).alias("kept"))


# --- entries and fetch days from the pages table ----------------------------------------------

#: Days that fetches and list entries fall on, from FIRST_DAY.
DAYS, FIRST_DAY = 720, "2022-01-01"
LISTS = ("adult", "malware", "spam")


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages with the day of their fetch: page_id's remainder, as the table has no time."""
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(DAYS)).cast("int")).alias("day"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated log made of the pages' hosts: every fifth host by the CRC of its name is added to a list, most are removed later and some of these added again."""
    host = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct().withColumn("crc", F.crc32("host"))
    listed = host.where("crc % 5 = 0")
    name = F.element_at(F.array(*(F.lit(x) for x in LISTS)), (F.floor(F.col("crc") / 5) % 3 + 1).cast("int"))
    start = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.floor(F.col("crc") / 15) % 400).cast("int"))
    log = F.array(
        F.struct(start.alias("day"), F.lit("add").alias("action")),
        F.struct(F.when(F.col("crc") % 4 != 1, F.date_add(start, 90)).alias("day"), F.lit("remove").alias("action")),
        F.struct(F.when(F.col("crc") % 4 == 2, F.date_add(start, 200)).alias("day"), F.lit("add").alias("action")),
    )
    return listed.select(name.alias("list_name"), F.col("host").alias("domain"), F.explode(log).alias("e")).select("list_name", "domain", "e.day", "e.action").where("day is not null")
