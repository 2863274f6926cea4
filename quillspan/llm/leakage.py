"""Evaluation texts leaking into training text: winnowing fingerprints, joined and extended."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.kernels import common_run, minimizers
from quillspan.operators.skew import split_join
from quillspan.runtime import stage

#: Characters of evaluation text that may be sent to every executor; a larger test set goes through shuffle joins.
INLINE_CHARS = 4_000_000
#: Rows of one fingerprint, and hits of one item, from which they are joined apart.
HEAVY = 10_000
_OTHER = re.compile(r"[\W_]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_DROP = bytes(i for i in range(128) if not chr(i).isalnum())

SCHEMA = "doc_id long, item_id long, doc_start long, item_start long, length long"


def letters_and_digits(text: str) -> str:
    """Compatibility forms as plain ones, lower case, letters and digits only."""
    if text.isascii():
        return text.encode("ascii").translate(_LOWER, _DROP).decode("ascii")
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).lower())


def _postings(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owner, place, value = minimizers(texts, k, w)
    order = np.argsort(value, kind="stable")
    return value[order], owner[order], place[order]


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, shared: int = 80,
    inline_chars: int = INLINE_CHARS) -> DataFrame:
    """Documents and test items that have ``shared`` consecutive letters and digits in common.

    Returns ``doc_id, item_id, doc_start, item_start, length``, the longest common run of each pair, in characters of
    the reduced texts. Of every window of ``shared - k + 1`` k-grams the least hash is kept on both sides, so every run of
    ``shared`` characters is found; each hit is extended on the texts, so nothing shorter comes out: an item of fewer than
    ``shared`` letters and digits can't leak by this measure (lower ``shared`` for such items). Null ids and texts
    take no part, repeated rows count once per id (runs over several texts of one id are merged), other columns are ignored.
    A test set of at most ``inline_chars`` characters, counted first, is sent to the executors and the corpus is read in one
    pass without a shuffle; a larger one is joined by fingerprint.
    """
    k = max(1, shared // 2)
    w = shared - k + 1
    items = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long")
        .alias("item_id"), F.col(item_text).alias("item_text")).distinct()
    docs = docs.where(F.col(doc_id).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"),
        F.col(doc_text).alias("doc_text"))
    size = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    hits = _inline(docs, items, k, w, shared) if size <= inline_chars else _joined(docs, items, k, w, shared)
    return hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("length", -F.col("doc_start"), -F.col("item_start")))
        .alias("x")).select("doc_id", "item_id", (-F.col("x.col2")).alias("doc_start"), (-F.col("x.col3")).alias("item_start"),
            F.col("x.length").alias("length"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def _inline(docs: DataFrame, items: DataFrame, k: int, w: int, shared: int) -> DataFrame:
    ids, texts = [], []
    for r in items.collect():  # at most inline_chars characters
        ids.append(r["item_id"])
        texts.append(letters_and_digits(r["item_text"]))
    values, owners, places = _postings(texts, k, w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reduced = [letters_and_digits(t) for t in b.column(1).to_pylist()]
            own, at, val = minimizers(reduced, k, w)
            if not len(val) or not len(values):
                continue
            lo, hi = np.searchsorted(values, val, "left"), np.searchsorted(values, val, "right")
            rows, doc_ids, seen = [], b.column(0).to_pylist(), {}
            for n in np.flatnonzero(hi > lo):
                d, p = int(own[n]), int(at[n])
                for m in range(lo[n], hi[n]):
                    i, q = int(owners[m]), int(places[m])
                    if seen.get((d, i, p - q), -1) >= p:  # within a run that is already known
                        continue
                    s, length = common_run(reduced[d], texts[i], p, q, k)
                    seen[d, i, p - q] = s + length - k
                    if length >= shared:
                        rows.append((doc_ids[d], ids[i], s, s - p + q, length))
            if rows:
                yield _batch(rows)

    return docs.mapInArrow(run, SCHEMA)


def _prints(df: DataFrame, key: str, text: str, k: int, w: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, at, val = minimizers([letters_and_digits(t) for t in b.column(1).to_pylist()], k, w)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(at, pa.int64()), pa.array(val.view(np.int64))], ["id", "at", "print"])

    return df.select(key, text).mapInArrow(run, "id long, at long, print long")


def _joined(docs: DataFrame, items: DataFrame, k: int, w: int, shared: int, heavy: int = HEAVY) -> DataFrame:
    """The way for a test set of any size: fingerprints meet in a shuffle join, then the texts of the pairs that met."""
    left = _prints(docs, "doc_id", "doc_text", k, w).select(F.col("id").alias("doc_id"), F.col("at").alias("p"), "print")
    right = _prints(items, "item_id", "item_text", k, w).select(F.col("id").alias("item_id"), F.col("at").alias("q"), "print")
    left, right = stage(left, "prints"), stage(right, "item-prints")
    met = split_join(left, right, "print", heavy).groupBy("doc_id", "item_id", (F.col("p") - F.col("q")).alias("shift")).agg(F.collect_set("p").alias("ps"))
    hits = stage(met, "hits")
    pairs = split_join(hits, items, "item_id", heavy).join(docs, "doc_id").select("doc_id", "item_id", "shift", "ps", "doc_text", "item_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                a, t, done = letters_and_digits(r["doc_text"]), letters_and_digits(r["item_text"]), -1
                for p in sorted(r["ps"]):
                    if p <= done:
                        continue
                    s, length = common_run(a, t, p, p - r["shift"], k)
                    done = s + length - k
                    if length >= shared:
                        rows.append((r["doc_id"], r["item_id"], s, s - r["shift"], length))
            yield _batch(rows)

    return pairs.mapInArrow(run, SCHEMA)
