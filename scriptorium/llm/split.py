"""Oversized texts cut at natural boundaries, by recursive bisection.

A text over the limit is cut at the strongest boundary near its middle, and so are the halves that still exceed the limit
less the overlap. Then each later piece gets the end of the piece before as its opening. Boundaries of a text are found
once; each cut is a binary search among them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.arrow import bounded


@dataclass(frozen=True)
class SplitSpec:
    limit: int = 2400
    overlap: int = 200

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.limit:
            raise ValueError("overlap must be less than the limit")


#: Strongest first: blank line, line (a list item or table row begins one), list item within a line, sentence, blank. A
#: boundary is where the match ends, so blanks stay with the piece before.
PARAGRAPH, LINE, ITEM, SENTENCE, BLANK, INSIDE = range(6)
_PATTERNS = (
    re.compile(r"\r?\n(?:[^\S\n]*\n)+"),
    re.compile(r"\n|\r(?!\n)|[\x0b\x0c\x85\u2028\u2029]"),
    re.compile(r"\s+(?=(?:[-*•–▪‣◦]|\(?\d{1,3}[.)]|\(?[a-z]\))\s)"),
    re.compile(r"[.!?…。！？][\"'”’»)\]*_]*\s+|[。！？]"),
    re.compile(r"\s+"),
)
_TURN = re.compile(r"(?<!\S)\S")


class _Boundaries:
    def __init__(self, text: str) -> None:
        self.levels = [[m.end() for m in p.finditer(text) if 0 < m.end() < len(text)] for p in _PATTERNS]

    def nearest(self, level: int, low: int, high: int, middle: int) -> int | None:
        """The boundary in low..high that is closest to the middle, the earlier of two."""
        places = self.levels[level]
        a, b = bisect_left(places, low), bisect_right(places, high)
        if a == b:
            return None
        at = bisect_left(places, middle, a, b)
        return min(places[max(a, at - 1) : min(b, at + 1)], key=lambda p: abs(p - middle))

    def cut(self, low: int, high: int) -> tuple[int, int]:
        """Where to cut low..high, and the boundary's level: a natural one within the middle half, else any natural one, else
        a blank, else the middle."""
        middle, quarter = (low + high) // 2, (high - low) // 4
        for near, far in ((low + quarter, high - quarter), (low + 1, high - 1)):
            for level in (PARAGRAPH, LINE, ITEM, SENTENCE):
                place = self.nearest(level, near, far, middle)
                if place is not None:
                    return place, level
        for near, far in ((low + quarter, high - quarter), (low + 1, high - 1)):
            place = self.nearest(BLANK, near, far, middle)
            if place is not None:
                return place, BLANK
        return middle, INSIDE


def cut_places(text: str, spec: SplitSpec) -> list[tuple[int, int]]:
    """Ends of the new parts with their levels, in order; the last is the text's end. A part has at most
    limit - overlap characters, the first one too, so that any overlap fits."""
    boundaries, room = _Boundaries(text), spec.limit - spec.overlap
    done, stack = [], [(0, len(text), PARAGRAPH)]
    while stack:
        low, high, level = stack.pop()
        if high - low <= room:
            done.append((high, level))
            continue
        place, kind = boundaries.cut(low, high)
        stack += [(place, high, level), (low, place, kind)]
    return done


def split_text(text: str, spec: SplitSpec) -> list[tuple[str, int, int]]:
    """The pieces as (piece, length of its overlap, level of the boundary at its end). A text within the limit is one
    piece. Without their overlaps the pieces make up the text."""
    if len(text) <= spec.limit:
        return [(text, 0, PARAGRAPH)]
    pieces: list[tuple[str, int, int]] = []
    start, last = 0, ""
    for end, level in cut_places(text, spec):
        tail = last[len(last) - min(spec.overlap, len(last)) :]
        if tail and len(tail) < len(last):
            # The character before the tail tells whether the tail opens with a word's start.
            turn = _TURN.search(last, len(last) - len(tail))
            tail = last[turn.start() :] if turn else tail
        piece = tail + text[start:end]
        pieces.append((piece, len(tail), level))
        start, last = end, piece
    return pieces


def split_oversized(rows: DataFrame, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """The pieces of every ``id, text`` row whose text exceeds the limit in code points: ``id, text_hash, piece_no`` (from 1),
    ``pieces, piece, overlap, boundary`` (0 blank line, 1 line, 2 list item, 3 sentence, 4 blank, 5 inside a word).
    Equal rows count once; an id with several texts has pieces of each, told apart by ``text_hash``. Null and shorter
    texts give no rows."""
    long = rows.select("id", "text").filter(F.length("text") > spec.limit).withColumn("text_hash", F.xxhash64("text"))
    once = long.groupBy("id", "text_hash").agg(F.first("text").alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            out: list[tuple] = []
            for i, h, text in zip(*(batch.column(c).to_pylist() for c in ("id", "text_hash", "text"))):
                parts = split_text(text, spec)
                out += [(i, h, k + 1, len(parts), piece, overlap, level) for k, (piece, overlap, level) in enumerate(parts)]
            if out:
                types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["id", "text_hash", "piece_no", "pieces", "piece", "overlap", "boundary"])

    return once.mapInArrow(pieces, "id string, text_hash bigint, piece_no int, pieces int, piece string, overlap int, boundary int")
