"""Quality and telemetry reports over documents, blocks and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan import schemas as S
from quillspan.functions import text as X

#: Upper bounds (exclusive) and names of the length classes; sizes that are reported; the healthy ratio of chunk to source characters.
BUCKETS = [(10, "<10"), (50, "10-50"), (100, "50-100"), (200, "100-200"), (500, "200-500"), (1000, "500-1000"), (2001, "1000-2000"), (None, ">2000")]
LEAST_CHUNK, MOST_RATIO = 12, 1.20


def document_telemetry(blocks: DataFrame) -> DataFrame:
    """One row per document: blocks, statements and characters, 0 where there are none."""
    n = F.length(F.coalesce("normalized_text", F.lit("")))
    return blocks.groupBy("rfc_id").agg(
        F.count(F.lit(1)).cast("int").alias("total_blocks"), F.sum(F.coalesce(F.size("normative_statements"), F.lit(0))).cast("int")
            .alias("normative_rules"), F.sum(n).cast("int").alias("total_chars"),
        F.max(n).alias("max_block_chars"), F.min(n).alias("min_block_chars"),
    )


def corpus_totals(telemetry: DataFrame) -> DataFrame:
    """One row: documents compiled, blocks, rules, and documents by source type."""
    ok = F.col("status") == "success"
    return telemetry.agg(
        F.count_if(ok).alias("documents"), F.coalesce(F.sum(F.when(ok, F.col("total_blocks"))), F.lit(0)).alias("blocks"),
            F.coalesce(F.sum(F.when(ok, F.col("normative_rules"))), F.lit(0)).alias("rules"),
        F.count_if(ok & F.col("file").endswith(".txt")).alias("txt_documents"), F.count_if(ok & F.col("file").endswith(".xml")).alias("xml_documents"),
    )


def telemetry_report(telemetry: DataFrame) -> DataFrame:
    """One row: totals, whole mean of rules per document, mean block size, and the documents of the longest and the shortest block that isn't empty."""
    return telemetry.agg(
        F.count(F.lit(1)).alias("documents"), F.sum("total_blocks").alias("blocks"), F.sum("normative_rules").alias("rules"),
            F.expr("sum(normative_rules) div count(1)").alias("rules_per_document"),
        (F.sum("total_chars") / F.sum("total_blocks")).alias("mean_block_chars"), F.max_by("rfc_id", F.struct("max_block_chars", "rfc_id")).alias("longest_in"),
        F.min_by("rfc_id", F.when(F.col("min_block_chars") > 0, F.struct("min_block_chars", "rfc_id"))).alias("shortest_in"),
    )


def exclusive_percentile(df: DataFrame, group: str, value: str, percent: int = 95) -> DataFrame:
    """``group, n, p``: the exclusive percentile of each group, interpolated and cut to a whole number; one value is its own percentile.

    Values are counted before they are numbered, so a group is as many rows as it has different values.
    """
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group).orderBy(value)
    total = F.sum("c").over(Window.partitionBy(group))
    ranked = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", total)
    j = F.greatest(F.lit(1), F.least(F.expr(f"({percent} * (n + 1)) div 100"), F.col("n") - 1))
    ranked = ranked.withColumn("j", j).withColumn("d", F.lit(percent) * (F.col("n") + 1) - 100 * F.col("j"))
    holds = lambda at: (F.col("upto") >= at) & (F.col("upto") - F.col("c") < at)
    out = ranked.groupBy(group).agg(F.first("n").alias("n"), F.max(F.when(holds(F.col("j")), F.col(value))).alias("x"),
        F.max(F.when(holds(F.col("j") + 1), F.col(value))).alias("y"), F.first("d").alias("d"))
    return out.select(group, "n", F.when(F.col("n") == 1, F.col("x"))
        .otherwise(F.expr("cast((x * (100 - d) + y * d) / 100 as bigint)")).cast("long").alias("p"))


def length_distribution(df: DataFrame, kind: str, text: str) -> DataFrame:
    """``kind, blocks, median_chars, p95_chars, max_chars`` by block type, median and percentile cut to whole numbers."""
    n = df.select(F.col(kind).alias("kind"), F.length(text).alias("chars")).where("chars is not null")
    basic = n.groupBy("kind").agg(F.count(F.lit(1)).alias("blocks"), F.floor(F.median("chars")).alias("median_chars"), F.max("chars").alias("max_chars"))
    return basic.join(exclusive_percentile(n, "kind", "chars").select("kind", F.col("p").alias("p95_chars")), "kind")


def length_class(n: Column) -> Column:
    out = F.lit(BUCKETS[-1][1])
    for most, name in reversed(BUCKETS[:-1]):
        out = F.when(n < most, name).otherwise(out)
    return out


def length_histogram(chunks: DataFrame, text: str = "text_payload") -> DataFrame:
    """Chunks per length class with their share in percent; classes without any are listed with 0."""
    labels = chunks.sparkSession.createDataFrame([(name,) for _, name in BUCKETS], "bucket string")
    counts = chunks.groupBy(length_class(F.length(text)).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    joined = labels.join(counts, "bucket", "left").withColumn("chunks", F.coalesce("c", F.lit(0)))
    return joined.select("bucket", "chunks", (100 * F.col("chunks") / F.nullif(F.sum("chunks").over(Window.partitionBy(F.lit(1))), F.lit(0))).alias("percent"))


def boundary_anomalies(chunks: DataFrame) -> DataFrame:
    """Chunks over the limit (FATAL) or too short to mean anything (WARN)."""
    n = F.length("text_payload")
    level = F.when(n > S.SPLIT_LIMIT, "FATAL").when(n < LEAST_CHUNK, "WARN")
    return chunks.select("chunk_id", n.alias("chars"), level.alias("severity")).where("severity is not null").distinct()


def conservation(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """``rfc_id, source_chars, chunk_chars, ratio, verdict`` of every document with source text: nothing chunked is FATAL, less than the source ERROR, over 1.20 times it WARN."""
    src = blocks.where(~X.is_blank(F.col("normalized_text"))).groupBy("rfc_id").agg(F.sum(F.length("normalized_text")).alias("source_chars"))
    got = chunks.groupBy(F.col("rfc_number").alias("rfc_id")).agg(F.sum(F.length("text_payload")).alias("chunk_chars"))
    j = src.join(got, "rfc_id", "left").withColumn("chunk_chars", F.coalesce("chunk_chars", F.lit(0)))
    ratio = F.col("chunk_chars") / F.col("source_chars")
    return j.withColumn("ratio", ratio).withColumn("verdict", F.when(ratio == 0, "FATAL").when(ratio < 1, "ERROR")
        .when(ratio > MOST_RATIO, "WARN").otherwise("OK"))


def route_counts(chunks: DataFrame) -> DataFrame:
    """Rows per route, and of all routes as 'TOTAL', in one pass."""
    return chunks.rollup("table_route").agg(F.count(F.lit(1)).alias("rows")).withColumn("table_route", F.coalesce("table_route", F.lit("TOTAL")))


def outliers(df: DataFrame, text: str, limit: int = S.SPLIT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Rows over the limit and the others."""
    return df.where(F.length(text) > limit), df.where(F.coalesce(F.length(text), F.lit(0)) <= limit)
