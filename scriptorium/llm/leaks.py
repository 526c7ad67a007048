"""Test passages inside training documents, in whole or in part, by a size-partitioned MinHash containment search.

A document leaks an item if both share a run of at least ``run`` consecutive words. Such a run may be a small part of the item
and a vanishing part of the document, so one MinHash of either would miss it. Every passage of ``run`` words, in items and
documents alike, therefore has its own MinHash over its shingles of ``shingle`` words; neighbouring passages mostly share it, which
leaves few distinct values. Items are partitioned by size. In a partition whose items have up to u shingles the run rule asks
for a containment of ``run - shingle + 1`` in u; what shares a value with a document is a candidate and is verified by the exact
containment of its shingles in the document. A last filter keeps what shares a whole run.

The index holds sorted arrays of 64-bit hashes only: about 4 MB for each MB of item text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.arrow import bounded
from scriptorium.functions.wordhash import Words, words_of


@dataclass(frozen=True)
class LeakSpec:
    """``block_chars``: items are searched in blocks of about so many characters, which bounds what is sent to the
    executors whatever the number of items; each block reads the documents once."""

    run: int = 12
    shingle: int = 5
    block_chars: int = 16 << 20

    @property
    def width(self) -> int:
        """Shingles in a run."""
        return self.run - self.shingle + 1


def window_minima(words: Words, spec: LeakSpec) -> tuple[np.ndarray, np.ndarray]:
    """The MinHash of each window of ``run`` words within one text, and the number of the window's first word."""
    hashes, first = words.shingles(spec.shingle)
    width = spec.width
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = hashes[:n].copy()
    for t in range(1, width):
        np.minimum(least, hashes[t : t + n], out=least)
    # A window of shingles lies in one text if its first and last begin just so many words apart.
    keep = first[width - 1 : width - 1 + n] - first[:n] == width - 1
    return least[keep], first[:n][keep]


def _distinct(owner: np.ndarray, hashes: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each owner, laid end to end, and where each owner's begin."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    owner, hashes = owner[keep], hashes[keep]
    return hashes, np.searchsorted(owner, np.arange(owners + 1))


@dataclass
class Partition:
    """Items with up to ``upper`` shingles: the sorted MinHashes of their passages, and the item of each."""

    upper: int
    values: np.ndarray
    item: np.ndarray

    def matches(self, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of a passage and an item with one MinHash: the number of the passage, and the item."""
        low, high = (np.searchsorted(self.values, minima, side) for side in ("left", "right"))
        hit = np.flatnonzero(high > low)
        sizes = (high - low)[hit]
        place = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(hit) else hit
        return np.repeat(hit, sizes), self.item[place]


class ItemIndex:
    """Items numbered from 0; ``ids`` are their names."""

    def __init__(self, items: list[tuple[int, str | None]], spec: LeakSpec, slice_chars: int = 1 << 20) -> None:
        self.ids = np.array([i for i, _ in items], np.int64)
        parts: list[tuple[np.ndarray, ...]] = []
        at = 0
        while at < len(items):  # slices bound the memory of the kernels
            end, chars = at, 0
            while end < len(items) and (end == at or chars + len(items[end][1] or "") <= slice_chars):
                chars += len(items[end][1] or "")
                end += 1
            words = words_of([t for _, t in items[at:end]])
            owner = words.text_of()
            n = end - at
            minima, first = window_minima(words, spec)
            fingerprints = _distinct(owner[first] if len(first) else first, minima, n)
            shingles, start = words.shingles(spec.shingle)
            held = _distinct(owner[start] if len(start) else start, shingles, n)
            runs, start = words.shingles(spec.run)
            parts.append((*fingerprints, *held, *_distinct(owner[start] if len(start) else start, runs, n)))
            at = end
        fingerprints, bounds = _joined([(p[0], p[1]) for p in parts])
        self.shingles, self.shingle_bounds = _joined([(p[2], p[3]) for p in parts])
        self.runs, self.run_bounds = _joined([(p[4], p[5]) for p in parts])
        sizes = np.diff(self.shingle_bounds)
        item = np.repeat(np.arange(len(items), dtype=np.int32), np.diff(bounds))
        level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)[item]
        self.partitions = []
        for x in np.unique(level):
            values, owners = fingerprints[level == x], item[level == x]
            order = np.argsort(values, kind="stable")
            self.partitions.append(Partition(1 << int(x), values[order], owners[order]))

    def memory(self) -> int:
        arrays = [self.ids, self.shingles, self.shingle_bounds, self.runs, self.run_bounds, *(a for p in self.partitions for a in (p.values, p.item))]
        return sum(a.nbytes for a in arrays)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.cumsum([0, *(len(v) for v, _ in parts)])
    return np.concatenate([v for v, _ in parts]), np.concatenate([[0], *(b[1:] + o for (_, b), o in zip(parts, offsets))])


def find_leaks(documents: DataFrame, items: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """``doc_id, item_id, containment, windows, first_word`` for every document (``doc_id, text``) and item (``item_id, text``) that
    share a run of ``spec.run`` words. ``containment`` is the share of the item's distinct shingles that the document holds, ``windows``
    counts the document's runs that the item holds, ``first_word`` is
    the place of the first, from 0. Items shorter than the run, null and empty texts match nothing. Items with a common
    wording are all reported; equal rows of documents are each reported. Equality of words is equality of 64-bit hashes of their runs.

    The documents are read in one pass without a shuffle, per block of items.
    """
    spark = documents.sparkSession
    sizes = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(sizes / spec.block_chars))
    schema = "doc_id bigint, item_id bigint, containment double, windows bigint, first_word bigint"
    result = spark.createDataFrame([], schema)
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").distinct()
        index = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in part.collect() if r[0] is not None], spec))
        result = result.unionByName(_search(documents, index, spec, schema))
    return result


def _search(documents: DataFrame, index, spec: LeakSpec, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ItemIndex = index.value
        for batch in bounded(batches, "text", 2 << 20):
            ids = batch.column("doc_id").to_pylist()
            words = words_of(batch.column("text").to_pylist())
            minima, first = window_minima(words, spec)
            rows = [(ids[row], *found) for row, *found in matched(items, words, minima, first, spec)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], names)

    return documents.select("doc_id", "text").mapInArrow(search, schema)


_FIELDS = [pa.field("doc_id", pa.int64()), pa.field("item_id", pa.int64()), pa.field("containment", pa.float64()), pa.field("windows", pa.int64()), pa.field("first_word", pa.int64())]


def matched(items: ItemIndex, words: Words, minima: np.ndarray, first: np.ndarray, spec: LeakSpec) -> Iterator[tuple[int, int, float, int, int]]:
    """(number of the text, item, containment, windows, first word) of all texts and items that share a run."""
    owner = np.searchsorted(words.bounds, first, side="right") - 1
    for part in items.partitions:
        passage, item = part.matches(minima)
        candidates = np.unique(owner[passage] * len(items.ids) + item)
        for row, item in zip((candidates // len(items.ids)).tolist(), (candidates % len(items.ids)).tolist()):
            text = _slice(words, row)
            wanted = items.shingles[items.shingle_bounds[item] : items.shingle_bounds[item + 1]]
            contained = float(np.isin(wanted, text.shingles(spec.shingle)[0]).mean())
            # A run has this many shingles, fewer only where it repeats itself, and an item of this partition at most ``upper``.
            if contained * part.upper < 1 - 1e-9:
                continue
            runs, start = text.shingles(spec.run)
            held = items.runs[items.run_bounds[item] : items.run_bounds[item + 1]]
            places = start[np.isin(runs, held)]
            if len(places):
                yield row, int(items.ids[item]), contained, len(places), int(places[0])


def _slice(words: Words, row: int) -> Words:
    """One text's words."""
    a, b = words.bounds[row], words.bounds[row + 1]
    return Words(words.hashes[a:b], np.array([0, b - a]), words.starts[a:b], words.ends[a:b], words.offsets[row : row + 1], words.joined)
