"""Mixing sources to target weights: capped water-filling over token counts of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.runtime import small_enough, stage

#: Place of the rank file on the driver; a parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sources that water-filling may handle on the driver; the table of targets is checked against it.
MAX_SOURCES = 100_000
_BUCKETS = 4096
_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(df: DataFrame, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` and ``n_tokens``, the tokens of the whole text; a null text has none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    # the rank file is sent along, so executors need no copy of their own
    df.sparkSession.sparkContext.addFile(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(os.path.basename(tokenizer)))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{schema}, n_tokens long")


def water_fill(have: dict[str, int], share: dict[str, float], cap: dict[str, int], total: float) -> dict[str, float]:
    """Tokens per source. Sources that can't reach their part are held at cap x supply, and what they lack goes to the others in proportion to their shares, until nobody is over."""
    given: dict[str, float] = {}
    open_, left = {s for s in share if share[s] > 0}, float(total)
    while open_:
        weight = sum(share[s] for s in open_)
        full = {s for s in open_ if have.get(s, 0) * cap[s] < left * share[s] / weight}
        if not full:
            given |= {s: left * share[s] / weight for s in open_}
            break
        for s in full:
            given[s] = float(have.get(s, 0) * cap[s])
            left -= given[s]
        open_ -= full
    return {s: given.get(s, 0.0) for s in share}


def known_sources(df: DataFrame, source: str = "source") -> DataFrame:
    """``df`` with its source trimmed and in lower case; rows without one are dropped."""
    return df.withColumn(source, F.lower(F.trim(F.col(source)))).where(F.length(source) > 0)


def mix_plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """The mix by source, from ``sizes(source, n_tokens[, n_docs])`` and ``targets(source, target_share, max_repeat)``.

    ``total`` is the size of the mix in tokens, by default that of all rows of ``sizes``, each once. Returns ``source,
    target_share, max_repeat, have_tokens, target_tokens, mix_tokens, repeats, below_target``: ``repeats`` is how often the
    source's documents are used (whole and fractional), ``below_target`` whether the filled mix leaves the source under its
    share, which is so where it can't reach it even at max_repeat. Sources without a target are left out of the mix but count in ``total``; a target without documents gets
    nothing and is below. Null or negative shares and repeats count as 0; a repeated target counts once (greatest share).
    """
    spark = targets.sparkSession
    names = targets.select(F.lower(F.trim("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
        .alias("s"), F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0)).alias("m"))
    names = names.where(F.length("source") > 0).groupBy("source").agg(F.max(F.struct("s", "m")).alias("x")).select("source", "x.*")
    if not small_enough(names, MAX_SOURCES):
        raise ValueError(f"more than {MAX_SOURCES} sources with a target")
    supply = sizes.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    if total is None:
        supply = stage(supply, "supply")
        total = float(supply.agg(F.sum("n")).first()[0] or 0)
    rows = names.join(supply, "source", "left").collect()  # one row per target, at most MAX_SOURCES
    have = {r["source"]: int(r["n"] or 0) for r in rows}
    share, cap = {r["source"]: float(r["s"]) for r in rows}, {r["source"]: int(r["m"]) for r in rows}
    mix = water_fill(have, share, cap, total)
    out = [(s, share[s], cap[s], have[s], share[s] * total, mix[s], mix[s] / have[s] if have[s] else 0.0,
        mix[s] < share[s] * total * (1 - 1e-12)) for s in sorted(have)]
    return spark.createDataFrame(out,
        "source string, target_share double, max_repeat int, have_tokens long, target_tokens double, mix_tokens double, repeats double, below_target boolean")


def draw_mix(docs: DataFrame, plan: DataFrame, doc_id: str, seed: int = 17) -> DataFrame:
    """The selection: ``doc_id, source, n_tokens, copies``, every copy count being the whole part of the source's repeats or one more.

    Which documents get one more is seeded: documents are ordered by a hash of seed and id, and the first ones are taken
    until their tokens fill the fraction. The cut is found from sums over hash buckets, so no source is sorted as a
    whole, and it misses the target by less than one document. Documents with 0 copies are left out.
    """
    h = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"))
    d = docs.join(F.broadcast(plan.select("source", "repeats", "have_tokens")), "source")
    d = d.withColumn("_h", h).withColumn("_bucket", F.pmod("_h", F.lit(_BUCKETS)))
    sums = d.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_in_bucket"))
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in_bucket").over(upto), F.lit(0))).withColumnRenamed("source", "_s").withColumnRenamed("_bucket", "_b")
    d = d.join(sums, (F.col("source") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    d = d.withColumn("_need", (F.col("repeats") - F.floor("repeats")) * F.col("have_tokens"))
    in_bucket = Window.partitionBy("source", "_bucket").orderBy("_h", doc_id).rowsBetween(Window.unboundedPreceding, -1)
    cut = (F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_in_bucket") > F.col("_need"))
    split = d.where(cut).withColumn("_at", F.col("_before") + F.coalesce(F.sum("n_tokens").over(in_bucket), F.lit(0)))
    split = split.withColumn("_more", (F.col("_at") + F.col("n_tokens") / 2 <= F.col("_need")).cast("int"))
    whole = d.where(~cut).withColumn("_at", F.col("_before")).withColumn("_more", (F.col("_before") + F.col("_in_bucket") <= F.col("_need")).cast("int"))
    both = whole.unionByName(split).withColumn("copies", (F.floor("repeats") + F.col("_more")).cast("int"))
    return both.where("copies > 0").select(doc_id, "source", "n_tokens", "copies")


def reached_shares(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """Actual tokens and shares of a drawn mix beside the targets."""
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"), F.sum("copies").alias("drawn_docs"))
    out = plan.join(got, "source", "left").na.fill(0, ["drawn_tokens", "drawn_docs"])
    return out.withColumn("reached_share", F.col("drawn_tokens") / F.nullif(F.sum("drawn_tokens").over(Window.partitionBy(F.lit(1))), F.lit(0)))
