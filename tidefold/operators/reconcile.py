"""Folding of the open heads of a file into one."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.operators import graph, textmerge
from tidefold.scratch import materialize

NODE = "versionId string, parents array<string>, contentHash string, fileId string, text string"
_ROW = f"kind string, {NODE}"


def merge_node(text: str, parents: list[str]) -> tuple[str, str]:
    """(versionId, contentHash) of a merge, as functions.text.merge_id has it."""
    content = hashlib.sha256(text.encode()).hexdigest()
    return "m-" + hashlib.sha256("|".join([content, *sorted(parents)]).encode()).hexdigest(), content


def _rows(found: list[tuple]) -> pa.Table:
    names = [x.split()[0] for x in _ROW.split(", ")]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string()]
    return pa.table({k: pa.array([x[i] for x in found], t) for i, (k, t) in enumerate(zip(names, kinds, strict=True))})


def _files(t: pa.Table) -> tuple[graph.Walk, dict[str, tuple[str, list[str]]]]:
    """The graph of a component and, for each file with work, its head and the leaves to fold."""
    rows = t.to_pylist()
    versions = [x for x in rows if x["head"] is None]
    w = graph.Walk(*([x[k] for x in versions] for k in ("versionId", "parents", "contentHash")))
    return w, {x["fileId"]: (x["head"], sorted(x["parents"])) for x in rows if x["head"] is not None}


def _needed(t: pa.Table) -> pa.Table:
    """Hashes of all texts that folding may read: of the head, the leaves, and the bases of any two of them.

    A merged head comes of some of them, so that its base with a further leaf is one of these.
    """
    w, files = _files(t)
    found = set()
    for head, leaves in files.values():
        every = [head, *leaves]
        found.update(every)
        for n, x in enumerate(every):
            for y in every[n + 1 :]:
                found.update(w.best(x, y))
    k = t.column("k")[0].as_py()
    hashes = sorted({h for v in found if (h := w.hash.get(v))})
    return pa.table({"k": pa.array([k] * len(hashes), pa.string()), "hash": pa.array(hashes, pa.string())})


def _fold(t: pa.Table, texts: pa.Table) -> pa.Table:
    """Heads, merge nodes and held leaves of a component's files."""
    w, files = _files(t)
    text = {x["hash"]: x["text"] for x in texts.to_pylist()}
    out = []
    for file, (head, leaves) in sorted(files.items()):
        open_, turn = list(leaves), 0
        while turn < len(open_):  # the smallest leaf that can be folded; after each fold from the beginning
            leaf = open_[turn]
            if w.is_ancestor(leaf, head):
                open_.pop(turn)
                continue
            base, _ = w.base(head, leaf)
            if base is None:  # without a base, or with several, for now
                turn += 1
                continue
            sides = [text.get(w.hash.get(v) or "") for v in (base, head, leaf)]
            open_.pop(turn)
            if None in sides:
                out.append(("held", leaf, None, None, file, None))
                continue
            merged = textmerge.three_way(*sides, canonical=True)
            if merged["hasConflicts"]:
                continue
            body, parents = "\n".join(merged["merged"]), [head, leaf]
            node, content = merge_node(body, parents)
            out.append(("node", node, parents, content, file, body))
            w.add(node, parents, content)
            text[content] = body
            head, turn = node, 0
        out.append(("head", head, None, None, file, None))
    return _rows(out)


def fold_heads(files: DataFrame, versions: DataFrame, contents: DataFrame, pulled: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files with new heads, merge nodes, held) for files(fileId, head).

    A file's head is merged with the smallest other leaf that is foldable: pulled(versionId) this round, no
    tombstone of deleted(versionId), not an ancestor of the head, with one common base whose bytes are there.
    A clean merge becomes a node and the new head, and so on until no leaf is left that can be folded. A leaf
    that conflicts is tried once and left open; one without bytes is held, so that the cursor does not pass it.

    Only components of the graph with such leaves are looked at, and only the texts that their folding may
    read; a component is one task.
    """
    heads = materialize(files.select("fileId", "head"))
    leaf = graph.leaves(versions).select("fileId", F.explode("leaves").alias("versionId")).join(heads, "fileId").where("versionId <> head")
    leaf = leaf.join(pulled.select("versionId").distinct(), "versionId", "left_semi").join(deleted.select("versionId"), "versionId", "left_anti")
    work = materialize(leaf.groupBy("fileId").agg(F.first("head").alias("head"), F.collect_set("versionId").alias("leaves")))
    together = work.select(F.col("head").alias("a"), F.explode("leaves").alias("b"))
    comps = graph.components(versions, together)
    asked = work.join(comps.select(F.col("versionId").alias("head"), "component"), "head").select(F.col("component").alias("k"), F.lit(None).cast("string").alias("versionId"), F.col("leaves").alias("parents"), F.lit(None).cast("string").alias("contentHash"), "fileId", "head")
    some = comps.join(asked.select(F.col("k").alias("component")).distinct(), "component", "left_semi")
    nodes = versions.join(some, "versionId").select(F.col("component").alias("k"), "versionId", "parents", "contentHash", "fileId", F.lit(None).cast("string").alias("head"))
    rows = materialize(nodes.unionByName(asked))
    needed = materialize(rows.groupBy("k").applyInArrow(_needed, "k string, hash string"))
    texts = contents.join(needed.select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"]).select("hash", F.decode("bytes", "utf-8").alias("text"))
    done = materialize(rows.groupBy("k").cogroup(needed.join(texts, "hash").groupBy("k")).applyInArrow(_fold, _ROW))
    new = done.where("kind = 'head'").select("fileId", F.col("versionId").alias("new"))
    told = heads.join(new, "fileId", "left").select("fileId", F.coalesce("new", "head").alias("head"))
    return told, done.where("kind = 'node'").select(*(x.split()[0] for x in NODE.split(", "))), done.where("kind = 'held'").select("fileId", F.col("versionId").alias("leaf"))
