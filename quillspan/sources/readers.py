"""Sources: index, documents, errata, chunk feeds and vector shards, each with an explicit schema."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan import schemas as S
from quillspan.functions import parse_txt, parse_xml
from quillspan.functions import text as X
from quillspan.runtime import exists

log = logging.getLogger(__name__)
#: Blocks of one batch that parsers give.
BATCH_BLOCKS = 4096


def read_index_xml(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of an XML index, projected by :func:`project_index`. Of several entries of a number the last in the file wins."""
    raw = spark.read.format("xml").option("rowTag", "rfc-entry").option("mode", "DROPMALFORMED").schema(S.INDEX_XML).load(path)
    return project_index(raw.withColumn("_ord", F.monotonically_increasing_id()))


def project_index(raw: DataFrame) -> DataFrame:
    """Typed index entries with their defaults; rows without a document number are dropped."""
    ids = lambda c: F.filter(F.transform(F.coalesce(F.col(c)["doc-id"], F.array().cast("array<string>")), X.document_number), lambda n: n > 0)
    year = F.col("date.year")
    out = raw.select(
        X.document_number(F.col("doc-id")).alias("rfc_number"),
        F.coalesce("title", F.lit("Unknown Title")).alias("title"),
        F.when(year.rlike(r"^\d+$"), F.struct(year.try_cast("int").alias("year"), X.month_number(F.col("date.month")).alias("month"))).alias("published_at"),
        F.coalesce("current-status", F.lit("UNKNOWN")).alias("status"),
        F.coalesce("stream", F.lit("UNKNOWN")).alias("stream"),
        F.filter(F.transform(F.coalesce("author", F.array().cast("array<struct<name:string>>")), lambda a: a["name"]),
            lambda n: n.isNotNull()).alias("authors"),
        ids("obsoletes").alias("obsoletes"), ids("updates").alias("updates"), ids("updated-by").alias("updated_by"),
        F.lit(None).cast("string").alias("protocol_family"), "_ord",
    ).where("rfc_number > 0")
    cols = [c for c in out.columns if c not in ("rfc_number", "_ord")]
    return out.groupBy("rfc_number").agg(F.max_by(F.struct(*cols), "_ord").alias("e")).select("rfc_number", "e.*")


def _decoded(content: str) -> Column:
    """UTF-8, or Latin-1 where the bytes aren't UTF-8."""
    return F.when(F.is_valid_utf8(F.col(content).cast("string")), F.col(content).cast("string")).otherwise(F.decode(F.col(content), "ISO-8859-1"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, source_type, content, path`` of every rfc<number>.txt or .xml below a folder; files of other names are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,xml,TXT,XML}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = raw.select(F.regexp_extract(name, r"(?i)^rfc(\d+)\.(?:txt|xml)$", 1).try_cast("int").alias("doc_id"),
        F.lower(F.element_at(F.split(name, r"\."), -1)).alias("source_type"), _decoded("content").alias("content"), "path")
    return out.where("doc_id > 0")


def prefer_xml(docs: DataFrame) -> DataFrame:
    """One source per document: XML where there is one, else text."""
    xml, txt = docs.where("source_type = 'xml'"), docs.where("source_type = 'txt'")
    return txt.join(xml.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(xml)


_PARSERS = {"txt": parse_txt.parse, "xml": parse_xml.parse_document}


def parse_documents(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs(doc_id, source_type, content)``. A document that can't be parsed gives one row with ``error``, and never ends the run."""
    schema = T._parse_datatype_string(S.RAW_BLOCK)
    parsers = dict(_PARSERS)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def columns(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []  # of many documents, so that batches are neither tiny nor without bound
            for r in batch.to_pylist():
                own = {"doc_id": r["doc_id"], "source_type": r["source_type"]}
                try:
                    found = [own | b | {"ord": i} for i, b in enumerate(parsers[r["source_type"]](r["doc_id"], r["content"] or ""))]
                except Exception as e:  # noqa: BLE001  a bad document is a row, not a failure
                    found = [own | {"ord": 0, "error": f"{type(e).__name__}: {e}".splitlines()[0]}]
                rows += found
                if len(rows) >= BATCH_BLOCKS:
                    yield columns(rows)
                    rows = []
            if rows:
                yield columns(rows)

    return docs.select("doc_id", "source_type", "content").mapInArrow(run, schema)


def read_errata(spark: SparkSession, path: str) -> DataFrame:
    """The errata ledger of a JSON array. A missing file gives an empty ledger with a warning, and so does one that isn't JSON; any other failure is raised."""
    from quillspan.operators.errata import ledger

    if exists(spark, path):
        raw = spark.read.schema(S.ERRATUM).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    else:
        log.warning("no errata at %s", path)
        raw = spark.createDataFrame([], S.ERRATUM)
    return ledger(raw.withColumn("ord", F.monotonically_increasing_id()))


def read_metadata_map(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of a JSON object keyed by number; entries that aren't objects and keys that aren't numbers are left out."""
    entry = T.StructType([f for f in S.INDEX_ENTRY if f.name != "rfc_number"])
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", T.MapType(T.StringType(), T.StringType())).alias("m"))
    rows = raw.select(F.explode("m").alias("k", "t")).where("t like '{%'").select("k", F.from_json("t", entry)
        .alias("e")).withColumn("rfc_number", F.col("k").try_cast("int")).where("rfc_number is not null and e is not null")
    out = rows.select("rfc_number", "e.*")
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<int>")) for c in ("obsoletes", "updates", "updated_by")}
        | {"title": F.coalesce("title", F.concat(F.lit("RFC "), F.col("rfc_number"))), "status": F.coalesce("status", F.lit("UNKNOWN"))})


def read_chunks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records of a JSON-lines feed; blank and malformed lines and rows without an id are skipped."""
    return spark.read.schema(S.CHUNK).option("mode", "DROPMALFORMED").json(path).where("chunk_id is not null")


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Canonical blocks of documents written as JSON by :func:`quillspan.sources.sinks.write_documents`, in the shape that chunking wants; documents that aren't JSON are left out."""
    raw = spark.read.schema(S.CANONICAL).option("mode", "DROPMALFORMED").json(path).where("rfc_id is not null")
    preface = F.struct(F.lit("preface").alias("section_id"), F.lit("Preface").alias("title"), F.array(F.lit("Preface"))
        .alias("hierarchy_path"), F.lit(1).alias("section_depth"), F.col("preface_blocks").alias("blocks"))
    parts = raw.select("rfc_id", F.posexplode(F.concat(F.array(preface), F.coalesce("sections", F.array().cast(S.SECTIONS)))).alias("section_no", "s"))
    rows = parts.select("rfc_id", "section_no", "s.section_id", "s.title", "s.hierarchy_path", "s.section_depth",
        F.posexplode("s.blocks").alias("block_no", "b"))
    return rows.select("rfc_id", "section_no", "block_no", "section_id", "title", "hierarchy_path", "section_depth", "b.*",
        (F.col("section_no") == 0).alias("is_preface"))


def json_blocks(docs: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """``doc_id, block_type, chars`` of every object, at any depth of any JSON text, that has a block type and a normalized text; texts that aren't JSON give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    todo = [json.loads(text or "null")]
                except ValueError:
                    continue
                while todo:
                    node = todo.pop()
                    if isinstance(node, dict) and "block_type" in node and "normalized_text" in node:
                        for column, value in zip(out, (doc, str(node["block_type"]), len(str(node["normalized_text"] or "")))):
                            column.append(value)
                    todo += reversed(list(node.values() if isinstance(node, dict) else node)) if isinstance(node, (dict, list)) else []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (b.column(0).type, pa.string(), pa.int32()))],
                ["doc_id", "block_type", "chars"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, content).mapInArrow(run, f"doc_id {kind}, block_type string, chars int")


def existing_ids(spark: SparkSession, path: str) -> DataFrame:
    """Chunk ids of Parquet shards or tables. Corrupt files are skipped and a missing folder counts as empty; any other failure is raised, so that nothing is appended twice."""
    if not exists(spark, path):
        return spark.createDataFrame([], "chunk_id string")
    return spark.read.option("ignoreCorruptFiles", "true").schema("chunk_id string").parquet(path).where("chunk_id is not null").distinct()


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry of earlier runs; empty where there is none."""
    return spark.read.schema(S.TELEMETRY).json(path) if exists(spark, path) else spark.createDataFrame([], S.TELEMETRY)


def index_is_stale(spark: SparkSession, source: str, compiled: str) -> bool:
    """Whether a compiled table is older than its source, or missing."""
    newest = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).agg(F.max("modificationTime")).first()[0]
    if not exists(spark, compiled):
        return True
    have = newest(compiled)
    return have is None or newest(source) > have
