"""Splitting oversized items at natural boundaries: structure-tree packing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a node may be cut, from the coarsest boundary to the finest; a cut lies at the end of the match.
TEXT_LEVELS = [
    re.compile(r"\n(?=(?:\d+\.?|#|Appendix [A-Z][.:]?|[A-Z]\.)[ \t]+\S)"),
    re.compile(r"\n(?=(?:\d+\.\d+\.?|##|[A-Z]\.\d+\.?)[ \t]+\S)"),
    re.compile(r"\n(?=(?:\d+(?:\.\d+){2,}\.?|#{3,6}|[A-Z](?:\.\d+){2,}\.?)[ \t]+\S)"),
    re.compile(r"</(?:section|table|ul|ol|dl|figure|artwork)>\s*|\f"),
    re.compile(r"\n[ \t]*\n\s*|</(?:t|p|li|dd|tr)>\s*"),
    re.compile(r"\n(?=[ \t]*(?:[-*+o•]|\d+[.)]|[a-z][.)])[ \t]+\S)"),
    re.compile(r"\n"),
    re.compile(r"[.!?。][\"')\]]*\s+"),
    re.compile(r"[;:,]\s+"),
    re.compile(r"\s+"),
]
PATH_LEVELS = [re.compile(r" > "), re.compile(r"[;:,.]\s+"), re.compile(r"\s+")]
_SPACE = re.compile(r"\s")

SCHEMA = "field string, record_id string, unbreakable int, piece_no int, n_pieces int, start long, stop long, piece string, hierarchy_path string"


def pack(text: str, start: int, stop: int, limit: int, levels: list[re.Pattern], level: int = 0) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` that cover text[start:stop]; only nodes over the limit are opened, and siblings are merged while they fit."""
    if stop - start <= limit:
        return [(start, stop)] if stop > start else []
    if level == len(levels):
        return [(at, min(at + limit, stop)) for at in range(start, stop, limit)]
    cuts = [start, *(m.end() for m in levels[level].finditer(text, start, stop) if start < m.end() < stop), stop]
    if len(cuts) == 2:
        return pack(text, start, stop, limit, levels, level + 1)
    merged: list[tuple[int, int]] = []
    for a, b in zip(cuts, cuts[1:]):
        for s, e in pack(text, a, b, limit, levels, level + 1):
            if merged and e - merged[-1][0] <= limit:
                merged[-1] = (merged[-1][0], e)
            else:
                merged.append((s, e))
    return merged


def split_item(text: str, limit: int, overlap: int, levels: list[re.Pattern]) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` characters; each but the first reaches back by up to ``overlap`` to the start of a word."""
    if len(text) <= limit:
        return [(0, len(text))]
    spans = pack(text, 0, len(text), limit - overlap, levels)
    out = []
    for i, (s, e) in enumerate(spans):
        if i and overlap:
            back = max(s - overlap, 0)
            if back:
                m = _SPACE.search(text, back, s - 1)
                back = m.end() if m else back
            s = back
        out.append((s, e))
    return out


def longest_word(text: str) -> int:
    return max(map(len, text.split()), default=0)


def split_oversized(items: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Pieces of every item over its field's limit.

    ``items`` has ``field, record_id, body, hierarchy_path``; ``limits`` gives (limit, overlap) in characters by field.
    Returns one row per piece; ``start`` and ``stop`` are its place in the item, so pieces without their overlaps rebuild
    it. ``unbreakable`` is 1 if the item holds a run without white space longer than its limit. Items within the limit,
    blank or null items and null ids give no row; repeated rows of an id count once (the least text wins if they differ).
    Fields ending in ``path`` are cut as breadcrumbs, the others as texts. Any other columns are ignored.
    """
    over = F.lit(False)
    for field, (limit, _) in limits.items():
        over = over | ((F.col("field") == field) & (F.length("body") > limit))
    wanted = items.where(over & F.col("record_id").isNotNull()).groupBy("field", "record_id").agg(F.min(F.struct("body", "hierarchy_path")).alias("_x"))
    wanted = wanted.select("field", "record_id", "_x.body", "_x.hierarchy_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                limit, overlap = limits[r["field"]]
                text = r["body"]
                if not text.strip():
                    continue
                spans = split_item(text, limit, overlap, PATH_LEVELS if r["field"].endswith("path") else TEXT_LEVELS)
                stuck = int(longest_word(text) > limit)
                rows += [(r["field"], r["record_id"], stuck, i, len(spans), s, e, text[s:e], r["hierarchy_path"]) for i, (s, e) in enumerate(spans)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names)

    return wanted.mapInArrow(run, SCHEMA)
