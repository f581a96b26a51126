"""Change events and operations as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidefold.functions import hlc
from tidefold.functions import text as tx
from tidefold.operators import oplog

IDLE_MS = 1500
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOLDED = "vault string, seq bigint, id string, fileId string, type string, path string, contentHash string, parents array<string>, wall bigint, counter bigint, device string"


def debounce(events: DataFrame, idle: str = "1500 milliseconds", lateness: str | None = None) -> DataFrame:
    """path, first, last, n of bursts of modifications: a path's burst ends when it is idle. events(path, ts)."""
    rows = events.withWatermark("ts", lateness) if lateness else events
    return rows.groupBy("path", F.session_window("ts", idle).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("w")


def running_projection(ops: DataFrame) -> DataFrame:
    """The file projection of a stream (complete or update mode). There is no watermark: an op may be late by any time, and the state is a row a file."""
    return oplog.project(ops)


class Folder:
    """One vault's registry, folding change events in order of seq into operations.

    Paths move under renames, so that the state is the vault's; vaults are independent.
    """

    def __init__(self, device: str, state: dict | None = None):
        self.files: dict[str, dict] = (state or {}).get("files", {})  # by id: path, hash, head, open, deleted
        self.at: dict[tuple[str, bool], set[str]] = {}  # ids by path, live and deleted
        for i, f in self.files.items():
            self.at.setdefault((f["path"], f["deleted"]), set()).add(i)
        wall, counter = (state or {}).get("clock", (0, 0))
        self.clock = hlc.Clock(device, wall, counter)

    def state(self) -> dict:
        return {"files": self.files, "clock": (self.clock.wall, self.clock.counter)}

    def _at(self, path: str, deleted: bool = False) -> str | None:
        return max(self.at.get((path, deleted), ()), default=None)

    def _set(self, i: str, **new: object) -> None:
        """Change a file, and where it is found."""
        f = self.files.setdefault(i, {"path": None, "hash": None, "head": None, "open": [], "deleted": False})
        self.at.get((f["path"], f["deleted"]), set()).discard(i)
        f.update(new)
        self.at.setdefault((f["path"], f["deleted"]), set()).add(i)

    def _op(self, kind: str, file_id: str, wall: int, parents: list[str]) -> dict:
        import hashlib

        w, n, d = self.clock.now(wall)
        f = self.files[file_id]
        own = f"{w:015d}-{n:08d}-{d}"
        if len(parents) > 1:
            own = "m-" + hashlib.sha256("|".join([f["hash"], "|".join(sorted(parents))]).encode()).hexdigest()
        f["head"] = f["head"] if kind == "move" else own
        return {"id": own, "fileId": file_id, "type": kind, "path": f["path"], "contentHash": f["hash"], "parents": parents, "wall": w, "counter": n, "device": d}

    def event(self, kind: str, path: str, old: str | None, wall: int, data: bytes | None, exists: bool | None = None) -> list[dict]:
        """The operations of one event. exists: is the file there, which makes a deletion a modification."""
        import hashlib
        import uuid

        if kind == "rename":
            i = self._at(old) if old else None
            if i is None:
                return self.event("create", path, None, wall, data)
            self._set(i, path=path)
            return [self._op("move", i, wall, [self.files[i]["head"]])]
        i = self._at(path)
        if kind == "delete" and not exists:
            if i is None:
                return []
            f = self.files[i]
            self._set(i, deleted=True, open=[])
            return [self._op("delete", i, wall, [f["head"]])] if f["hash"] else []
        if data is None:
            return []
        h = hashlib.sha256(data).hexdigest()
        if i is None:
            dead = self._at(path, True)
            i = dead or str(uuid.uuid5(uuid.NAMESPACE_URL, f"{self.clock.device}/{path}/{self.clock.wall}/{self.clock.counter}/{wall}"))
            head = [self.files[i]["head"]] if dead and self.files[i]["head"] else []
            self._set(i, path=path, hash=h, head=head[0] if head else None, open=[], deleted=False)
            return [self._op("update" if head else "create", i, wall, head)]
        f = self.files[i]
        if f["hash"] == h:
            return []
        if len(f["open"]) > 1:
            text = data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n").split("\n")
            marked = any(x.startswith(tx.OURS) for x in text) and any(x.startswith(tx.THEIRS) for x in text)
            f["hash"] = h
            if marked:
                return []
            parents, f["open"] = f["open"], []
            return [self._op("update", i, wall, parents)]
        parents = [f["head"]] if f["head"] else []
        f["hash"] = h
        return [self._op("update" if parents else "create", i, wall, parents)]


def _folded(vault: str, folder: Folder, rows: pd.DataFrame) -> list[dict]:
    out = []
    for r in rows.sort_values("seq").itertuples():
        data = bytes(r.bytes) if r.bytes is not None else None
        out += [{"vault": vault, "seq": int(r.seq), **o} for o in folder.event(r.kind, r.path, r.oldPath, int(r.wall), data, exists=data is not None if r.kind == "delete" else None)]
    return out


_COLUMNS = [x.split()[0] for x in FOLDED.split(", ")]


def fold_batch(events: DataFrame) -> DataFrame:
    """Operations of events(vault, seq, kind, path, oldPath, wall, bytes), vault by vault, as a batch."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_folded(key[0], Folder(f"dev-{key[0]}"), rows), columns=_COLUMNS)

    return events.groupBy("vault").applyInPandas(run, FOLDED)


def fold_stream(events: DataFrame) -> DataFrame:
    """The same as a stream: the state of a vault goes from one trigger to the next."""
    import json

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        folder = Folder(f"dev-{key[0]}", json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(parts), ignore_index=True)
        out = _folded(key[0], folder, rows)
        state.update((json.dumps(folder.state()),))
        yield pd.DataFrame(out, columns=_COLUMNS)

    return events.groupBy("vault").applyInPandasWithState(run, FOLDED, "state string", "append", GroupStateTimeout.NoTimeout)


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str = "clientOpId") -> Callable:
    """A started query that appends each key once to Parquet at path, also when a batch comes again.

    Keys seen are the stream's state, dealt by key: a batch meets its own keys, not the whole target. A batch
    is a folder of its own by its number, and is written over when it comes again after a failure.
    """
    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_all(result: DataFrame, path: str, checkpoint: str) -> Callable:
    """A started query that keeps the whole result of an aggregated stream as Parquet at path; each batch replaces what the one before wrote.

    Executors write it, and nothing goes to the driver. The state is in RocksDB on the executors' disks, not in their
    heaps. A batch that comes again after a failure is written over.
    """
    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    conf, key = result.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, ROCKS)
    try:  # a query takes the settings along when it is started
        return result.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)
