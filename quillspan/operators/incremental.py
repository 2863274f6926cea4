"""Incremental runs: what is new, what is better, and what replaces what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan import schemas as S
from quillspan.operators import audit, compile
from quillspan.runtime import exists, small_enough, stage
from quillspan.sources import readers


def new_rows(feed: DataFrame, existing: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of the feed whose id isn't there yet, each id once (the least row of it), so a repeated run adds nothing."""
    rest = [c for c in feed.columns if c != key]
    fresh = feed.where(F.col(key).isNotNull()).join(existing.select(key).distinct(), key, "left_anti")
    return fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("_x")).select(key, "_x.*").select(*feed.columns)


def document_state(docs: DataFrame) -> DataFrame:
    """``doc_id, source_type`` of documents that are done; placeholders (no status, and a title that is only the number) are to be done again."""
    placeholder = (F.col("status") == "UNKNOWN") & (F.col("title") == F.concat(F.lit("RFC "), F.col("doc_id").cast("string")))
    return docs.where(~F.coalesce(placeholder, F.lit(False))).select("doc_id", "source_type")


def delta_queue(xml: DataFrame, txt: DataFrame, state: DataFrame) -> DataFrame:
    """``doc_id, source_type`` to process: XML of documents that are absent or only there as text, text of documents that are absent and not queued as XML."""
    s = state.groupBy("doc_id").agg(F.min("source_type").alias("_have"))
    a = xml.select("doc_id").distinct().join(s, "doc_id", "left").where("_have is null or _have = 'txt'").select("doc_id", F.lit("xml").alias("source_type"))
    b = txt.select("doc_id").distinct().join(s, "doc_id", "left_anti").join(a, "doc_id", "left_anti").select("doc_id", F.lit("txt").alias("source_type"))
    return a.unionByName(b)


def patched(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key isn't in the new ones, and the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


#: Folders that a compiled corpus is split into by document, so that replacing documents rewrites few of them.
BUCKETS = 64


def _bucket(number: str):
    return F.pmod(F.xxhash64(F.col(number).cast("int")), F.lit(BUCKETS)).cast("int")


def _replace(spark: SparkSession, new: DataFrame, done: DataFrame, number: str, path: str) -> None:
    """Puts the rows of the documents ``done(doc_id)`` in place of what the table holds of them; only the buckets of these documents are rewritten."""
    new = new.withColumn("bucket", _bucket(number))
    if exists(spark, path):
        touched = [r[0] for r in done.select(_bucket("doc_id").alias("b")).distinct().collect()]  # at most BUCKETS
        old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
        ids = done.select(F.col("doc_id").alias(number)).distinct()
        new = stage(old.join(ids, number, "left_anti").unionByName(new), "replaced")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(path)


def run(spark: SparkSession, docs: DataFrame, meta: DataFrame, out: str, full: bool = False) -> DataFrame:
    """Brings a compiled corpus below ``out`` up to date with ``docs(doc_id, source_type, content)`` and gives the queue that was worked off.

    Queued are documents that are absent, and those that are there as text only and now come as XML; with ``full`` all.
    They are parsed and compiled, and their blocks, chunks and telemetry replace what was there of them; documents that
    fail get a telemetry row with the error and keep what they had. A repeated run finds nothing to do. Tables are
    rewritten by buckets of documents, which a repeated run after a failure overwrites again.
    """
    out = out.rstrip("/")
    state = spark.createDataFrame([], "doc_id int, source_type string")
    if exists(spark, f"{out}/telemetry") and not full:
        t = spark.read.parquet(f"{out}/telemetry").where("status = 'success'")
        state = t.select(F.col("doc_id").cast("int").alias("doc_id"), "source_type")
    docs = docs.where("doc_id is not null and content is not null").select(F.col("doc_id").cast("int").alias("doc_id"), "source_type", "content")
    queue = stage(delta_queue(docs.where("source_type = 'xml'"), docs.where("source_type = 'txt'"), state), "queue")
    if small_enough(queue, 0):
        return queue
    once = docs.groupBy("doc_id", "source_type").agg(F.min("content").alias("content"))
    parsed = stage(readers.parse_documents(once.join(queue, ["doc_id", "source_type"])), "parsed")
    failed = parsed.where("error is not null").select("doc_id", "source_type", "error").distinct()
    done = queue.join(failed, "doc_id", "left_anti")
    blocks, chunks = compile.compile_corpus(parsed, meta)
    blocks = stage(blocks, "blocks")
    _replace(spark, blocks, done, "rfc_id", f"{out}/blocks")
    _replace(spark, compile.chunk_blocks(blocks, meta), done, "rfc_number", f"{out}/chunks")
    told = audit.document_telemetry(blocks).withColumnRenamed("rfc_id", "doc_id")
    counts = [c for c in told.columns if c != "doc_id"]
    good = done.join(told, "doc_id", "left").select("doc_id", "source_type", F.lit("success").alias("status"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.lit(None).cast("string").alias("error"))
    bad = failed.select("doc_id", "source_type", F.lit("failed").alias("status"), *[F.lit(0).alias(c) for c in counts],
        F.coalesce("error", F.lit(S.UNTOLD)).alias("error"))
    log = good.unionByName(bad).withColumn("file", F.concat(F.lit("rfc"), F.col("doc_id"), F.lit("."), F.col("source_type")))
    _replace(spark, stage(log, "telemetry"), queue, "doc_id", f"{out}/telemetry")
    from quillspan.sources.sinks import manifest

    manifest(spark.read.parquet(f"{out}/telemetry")).write.mode("overwrite").json(f"{out}/manifest")
    return queue
