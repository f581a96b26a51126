"""License texts found by MinHash bands over overlapping windows, then verified by exact containment.

A template is a list of words; its shingles are SHINGLE consecutive words (all of it where it is
shorter). Templates and documents are cut into overlapping windows of WIDE shingles (templates of
fewer: NARROW), a document's beginning an eighth of their size apart, a template's half of it. A window
has a MinHash signature of BANDS bands of ROWS values. An index from band keys to the templates' windows
retrieves (template, place) for a document's windows. Of a copy of which four fifths of the shingles are
left in every part, the window that starts nearest to a template's has a similarity s of at least 0.58
with it, and is missed by all bands with chance (1 - s ** ROWS) ** BANDS, under 3e-4, for each of the
template's windows. Of a template of NARROW to WIDE shingles a copy has a whole window left, which
cannot be missed; those of still fewer are looked up by every single shingle, which cannot either.

A retrieved place, extended by a quarter of the template on both sides, is verified by exact containment: a find has at
least CONTAINMENT of the template's distinct shingles; or it is a part, such as a text cut off, with PART
distinct shingles of the template, and this share of what lies between its first and its last. Finds of
one template that overlap are one. A license that holds another's text gives both; a part within a whole
or longer find is left out, as licenses share passages.

Templates are a parameter; the usual ones are the files in `licenses` and NOTICES. They are some 100 KB,
and the index goes to every task. Each document is scanned by itself, so nothing is shuffled, and hot
sources or groups of copies don't matter. Words are lower-cased (A-Z) and trimmed of punctuation, so that
reflowed or marked-up copies are alike; lone signs are no words. Null and empty texts have no finds. Repeated rows are
scanned alike. Input columns with the names of results give way to them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidefold.llm import common as c

SHINGLE, CONTAINMENT, PART = 5, 0.8, 40
WIDE, NARROW = 32, 8
#: Bands and rows of a window's signature.
BANDS, ROWS = {WIDE: 20, NARROW: 4, 1: 1}, {WIDE: 2, NARROW: 2, 1: 1}
TRIM = ".,;:!?\"'`()[]{}<>*#/-_=|"
#: Usual notices, and the openings of license texts.
NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
}


def license_texts() -> dict[str, str]:
    """The whole texts by name, and the notices."""
    return {f.stem: f.read_text("utf-8") for f in sorted(Path(__file__).with_name("licenses").glob("*.txt"))} | NOTICES


TEMPLATES = license_texts()


@dataclass
class Bare:
    """Words with a hash of each after lower-casing and trimming; lone signs are left out."""

    hashes: np.ndarray
    off: np.ndarray
    place: np.ndarray  # number of each word in its text

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def bare_words(texts: pa.Array) -> Bare:
    w = c.split_words(c.texts_of(texts, lower=True))
    if not len(w.codes):
        return Bare(np.zeros(0, np.uint64), w.off, np.zeros(0, np.int64))
    bare = pc.ascii_trim(w.dictionary, TRIM)
    some = (np.asarray(pc.binary_length(bare)) > 0)[w.codes]
    place = np.arange(len(w.codes)) - np.repeat(w.off[:-1], np.diff(w.off))
    return Bare(c.hash_strings(bare)[w.codes[some]], np.concatenate([[0], np.cumsum(some)])[w.off], place[some])


@dataclass
class Template:
    name: str
    k: int  # words in a shingle
    n: int  # shingles
    distinct: np.ndarray


@dataclass
class Index:
    """Band keys of the templates' windows, and where these are."""

    templates: list[Template]
    keys: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]  # by (k, size): for each band a filter, keys rising, template, offset


def signatures(s: np.ndarray, size: int, step: int):
    """For each band the keys of the windows of `size` shingles that begin at multiples of step."""
    for band in range(BANDS[size]):
        key = None
        for seed in c.seeds(BANDS[size] * ROWS[size], 2 + size)[band * ROWS[size] : (band + 1) * ROWS[size]]:
            low = sliding_min(c.mix(s ^ seed), size)[::step] if size > 1 else s
            with np.errstate(over="ignore"):
                key = low if key is None else c.mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
        yield key


@lru_cache(maxsize=4)
def prepared(templates: tuple[tuple[str, str], ...]) -> Index:
    out, windows = Index([], {}), {}
    for name, text in sorted(templates):
        h = bare_words(pa.array([text])).hashes
        k = min(SHINGLE, len(h))
        if not k:
            continue
        s = c.rolling(h, k)
        size = WIDE if len(s) >= WIDE else NARROW if len(s) >= NARROW else 1
        t = len(out.templates)
        out.templates.append(Template(name, k, len(s), np.unique(s)))
        offsets = np.unique(np.append(np.arange(0, len(s) - size + 1, max(1, size // 2)), len(s) - size))
        for band, key in enumerate(signatures(s, size, 1)):
            windows.setdefault((k, size), {}).setdefault(band, []).append((key[offsets], np.full(len(offsets), t), offsets))
    for kind, bands in windows.items():
        for _, parts in sorted(bands.items()):
            key, t, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            some = np.zeros(1 << 16, bool)
            some[(key & np.uint64(0xFFFF)).astype(np.int64)] = True
            out.keys.setdefault(kind, []).append((some, key[order], t[order], offset[order]))
    return out


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` consecutive values, by doubling."""
    have = 1
    while 2 * have <= size:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if have < size else x


def retrieved(s: np.ndarray, size: int, bands: list) -> tuple[np.ndarray, np.ndarray]:
    """(template, place where it would begin) of all windows of s that share a band with one of a template."""
    step = max(1, size // 8)
    if len(s) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = []
    for key, (some, keys, t, offset) in zip(signatures(s, size, step), bands, strict=True):
        at = np.flatnonzero(some[(key & np.uint64(0xFFFF)).astype(np.int64)])
        lo, hi = np.searchsorted(keys, key[at]), np.searchsorted(keys, key[at], side="right")
        n = hi - lo
        which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        found.append((t[which], np.repeat(at * step, n) - offset[which]))
    t, at = (np.concatenate(x) for x in zip(*found, strict=True))
    both = np.unique(np.stack([t, at]), axis=1)
    return both[0], both[1]


def scan(texts: pa.Array, templates: tuple[tuple[str, str], ...]) -> list[list[tuple[int, str, float, int, bool]]]:
    """For each text its finds: (first word, template, containment, words, whether it is whole)."""
    w = bare_words(texts)
    found: list[list[tuple[int, str, float, int, bool]]] = [[] for _ in range(len(texts))]
    if not len(w.hashes):
        return found
    doc, end = w.doc(), w.off[1:]
    index = prepared(templates)
    for (k, size), bands in index.keys.items():
        s = c.rolling(w.hashes, k)
        s[np.arange(len(s)) + k > end[doc[: len(s)]]] = 0  # shingles that reach into the next text are of no template
        which, places = retrieved(s, size, bands)
        cuts = np.flatnonzero(np.diff(which, prepend=-1))
        for i, at_t in zip(which[cuts], np.split(places, cuts[1:]), strict=True) if len(which) else ():
            t = index.templates[i]
            slack, skip, last = t.n // 4, -(10**18), {}
            for at in at_t.tolist():
                if at < skip:
                    continue
                skip, lo, hi = at + t.n // 8, max(at - slack, 0), min(at + t.n + slack, len(s))
                # a window may begin in one text and hold a find in the next
                for d in range(doc[lo], doc[hi - 1] + 1) if hi > lo else ():
                    a, b = max(lo, w.off[d]), min(hi, max(w.off[d], end[d] - k + 1))
                    if b <= a:
                        continue
                    part = s[a:b]
                    hit = np.flatnonzero(np.isin(part, t.distinct))
                    if not len(hit):
                        continue
                    own = len(np.unique(part[hit]))
                    share = own / len(t.distinct)
                    whole = share >= CONTAINMENT
                    if not whole and (own < PART or len(hit) < CONTAINMENT * (hit[-1] - hit[0] + 1)):
                        continue
                    first, final = int(a + hit[0]), int(a + hit[-1]) + k
                    before = last.get(d)
                    if before and first < before[1]:
                        row = found[d][before[0]]
                        start, final = before[2], max(final, before[1])
                        found[d][before[0]] = (row[0], t.name, max(row[2], share), int(w.place[final - 1] - w.place[start]) + 1, row[4] or whole)
                        last[d] = (before[0], final, start)
                    else:
                        last[d] = (len(found[d]), final, first)
                        found[d].append((int(w.place[first]), t.name, share, int(w.place[final - 1] - w.place[first]) + 1, whole))
    return [_kept(x) for x in found]


def _kept(finds: list[tuple[int, str, float, int, bool]]) -> list[tuple[int, str, float, int, bool]]:
    """The finds in order, without parts that lie within a whole or longer one: licenses share passages."""
    within = lambda x, y: y[0] <= x[0] and x[0] + x[3] <= y[0] + y[3] and (y[4] or y[3] > x[3])
    return sorted(x for x in finds if x[4] or not any(within(x, y) for y in finds if y is not x))


def license_scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`; all: None) with n_finds, licenses (sorted names) and finds (first word, template, containment, words, whole)."""
    given = tuple(sorted((TEMPLATES if templates is None else templates).items()))
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("template", pa.string()), ("containment", pa.float64()), ("n_words", pa.int64()), ("whole", pa.bool_())]))

    def make(texts):
        found = scan(texts, given)
        rows = [[{"first_word": a, "template": b, "containment": x, "n_words": n, "whole": y} for a, b, x, n, y in f] for f in found]
        return [pa.array([len(f) for f in found], pa.int64()), pa.array([sorted({x[1] for x in f}) for f in found], pa.list_(pa.string())), pa.array(rows, kind)]

    fields = [c.field("n_finds", "long"), c.field("licenses", "array<string>"), c.field("finds", "array<struct<first_word:bigint,template:string,containment:double,n_words:bigint,whole:boolean>>")]
    return c.add_columns(docs, text, make, fields, keep)
