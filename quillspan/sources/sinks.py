"""Sinks: routed tables, shards, reports and manifests, committed by Spark's own protocol."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.runtime import delete

#: Rows of one shard file at most.
SHARD_ROWS = 131_072


def write_routed(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunks as one table partitioned by route, so choosing routes prunes folders."""
    chunks.write.mode(mode).option("compression", "zstd").partitionBy("table_route").parquet(path)


def write_shards(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("append").option("compression", "snappy").option("maxRecordsPerFile", SHARD_ROWS).parquet(path)


def write_csv_report(df: DataFrame, path: str, by: str | None = None) -> None:
    """A report as CSV files with a header, in falling order of ``by`` over the files' names; range partitions are sorted, so no task holds the whole."""
    out = df.orderBy(F.desc(by)) if by else df
    out.write.mode("overwrite").option("header", "true").csv(path)


def write_documents(trees: DataFrame, path: str) -> None:
    """Canonical documents (:func:`quillspan.operators.compile.section_tree`), one JSON object a line."""
    trees.write.mode("overwrite").option("compression", "gzip").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the table, then swaps folders by two renames: readers see the old table, for a moment none, then the new one, and never half of one."""
    spark: SparkSession = df.sparkSession
    beside, old = f"{path.rstrip('/')}_{uuid.uuid4().hex[:8]}", f"{path.rstrip('/')}_old_{uuid.uuid4().hex[:8]}"
    df.write.parquet(beside)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(jvm(path)):
        fs.rename(jvm(path), jvm(old))
    fs.rename(jvm(beside), jvm(path))
    delete(spark, old)


def compact(spark: SparkSession, path: str, routes: list[str], rows: int = SHARD_ROWS) -> None:
    """Rewrites the given routes of a routed table in fewer files; the other partitions stay as they are. :func:`term_statistics` rebuilds what keyword search wants."""
    for route in routes:
        part = f"{path.rstrip('/')}/table_route={route}"
        df = spark.read.parquet(part)
        files = max(1, -(-df.count() // rows))
        replace_table(df.repartition(files), part)


def write_report(df: DataFrame, path: str) -> None:
    """An aggregate as text, a line per row: 'name: value | name: value'. All rows are written."""
    line = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns])
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def accepted(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks that may be stored, and the others with a ``reason``: no id, no document number, an unknown route, or a confidence outside 0..1."""
    from quillspan import schemas as S

    number = F.col("rfc_number").try_cast("int")
    reason = (
        F.when(F.col("chunk_id").isNull(), "no id").when(number.isNull() | (number <= 0), "no document")
            .when(~F.coalesce(F.col("table_route").isin(S.ROUTES), F.lit(False)), "unknown route")
        .when(F.col("parsing_confidence").isNotNull() & (F.isnan("parsing_confidence") | ~F.col("parsing_confidence").between(0, 1)), "confidence")
    )
    judged = chunks.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def term_statistics(chunks: DataFrame, path: str) -> None:
    """Document frequencies of all words by route, and sizes of the routes, as keyword search over a compacted table wants them."""
    from quillspan.operators.search import tokens

    words = chunks.select("table_route", tokens(F.col("text_payload")).alias("t"))
    df = words.select("table_route", F.explode(F.array_distinct("t")).alias("term")).groupBy("table_route", "term").agg(F.count(F.lit(1)).alias("df"))
    sizes = words.groupBy("table_route").agg(F.count(F.lit(1)).alias("chunks"), F.avg(F.size("t")).alias("mean_words"))
    df.write.mode("overwrite").partitionBy("table_route").parquet(f"{path.rstrip('/')}/terms")
    sizes.write.mode("overwrite").parquet(f"{path.rstrip('/')}/routes")


def manifest(telemetry: DataFrame, version: str | None = None) -> DataFrame:
    """One row: totals of a run and its version stamp."""
    from quillspan.operators.audit import corpus_totals

    stamp = F.lit(version) if version else F.date_format(F.current_timestamp(), "yyyy-MM-dd-HHmm")
    return corpus_totals(telemetry).withColumn("dataset_version", stamp)
