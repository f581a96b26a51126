"""Hybrid logical clocks as structs (wallTime, counter, deviceId); the struct's own order is the clock's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The form of an id: digits, digits, and a device that may itself have hyphens.
PATTERN = r"^(\d+)-(\d+)-([\s\S]*)\z"


def hlc(wall: Column, counter: Column, device: Column) -> Column:
    return F.struct(wall.cast("bigint").alias("wallTime"), counter.cast("bigint").alias("counter"), device.alias("deviceId"))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1. Strings compare by UTF-8 bytes."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def later(a: Column, b: Column) -> Column:
    """The later of two clocks, of equals the first."""
    return F.when(b > a, b).otherwise(a)


def _padded(x: Column, width: int) -> Column:
    """Zeros on the left up to width; longer numbers stay whole."""
    s = x.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def to_string(x: Column) -> Column:
    """The sortable id of a clock."""
    return F.concat_ws("-", _padded(x["wallTime"], 15), _padded(x["counter"], 8), x["deviceId"])


def from_string(s: Column) -> Column:
    """The clock of an id; null where it has no such form (merge ids, for one)."""
    part = lambda i: F.regexp_extract(s, PATTERN, i)
    return F.when(s.rlike(PATTERN), hlc(part(1), part(2), part(3)))


def issue(events: DataFrame, device: str, seq: str, wall: str, block: int = 4096) -> DataFrame:
    """events with `hlc`: the clock that each device gives its local events in order of seq.

    The wall time is the running maximum and the counter counts events that share it. The maximum is
    taken in blocks of seq and then over the blocks' maxima, so that one device's events are the work
    of many tasks; a group holds `block` events, or those of one clock tick.
    """
    rows = events.withColumn("_block", F.floor(F.col(seq) / block))
    tops = rows.groupBy(device, "_block").agg(F.max(wall).alias("_top"))
    before = tops.withColumn("_before", F.max("_top").over(W.partitionBy(device).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))).drop("_top")
    inner = W.partitionBy(device, "_block").orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    run = rows.withColumn("_local", F.max(wall).over(inner)).join(before, [device, "_block"])
    run = run.withColumn("_wall", F.greatest("_local", F.coalesce("_before", F.lit(0).cast("bigint"))))
    tick = W.partitionBy(device, "_wall").orderBy(seq)
    # a clock starts at (0, 0): events before any wall time count on from there
    counter = F.row_number().over(tick) - F.when(F.col("_wall") > 0, 1).otherwise(0)
    return run.withColumn("hlc", hlc(F.col("_wall"), counter, F.col(device))).drop("_block", "_local", "_before", "_wall")


class Clock:
    """The clock of one device on the driver: for events that mix with those of others."""

    def __init__(self, device: str, wall: int = 0, counter: int = 0):
        self.device, self.wall, self.counter = device, wall, counter

    def now(self, wall: int) -> tuple[int, int, str]:
        """A new time for a local event."""
        return self._tick(wall, [])

    def merge(self, other: tuple[int, int, str], wall: int) -> tuple[int, int, str]:
        """A new time after seeing another device's."""
        return self._tick(wall, [other[:2]])

    def set_current(self, wall: int, counter: int) -> None:
        """Stand at a stored time, or at zero for a device that forgets all."""
        self.wall, self.counter = wall, counter

    def _tick(self, wall: int, seen: list[tuple[int, int]]) -> tuple[int, int, str]:
        top = max([wall, self.wall, *(w for w, _ in seen)])
        at_top = [n for w, n in [(self.wall, self.counter), *seen] if w == top]
        self.wall, self.counter = top, max(at_top) + 1 if at_top else 0
        return self.wall, self.counter, self.device
