"""From raw blocks to canonical blocks, sections and chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan import schemas as S
from quillspan.functions import text as X
from quillspan.operators.ranking import positions
from quillspan.operators.skew import split_join
from quillspan.runtime import maybe_broadcast, stage

#: Blocks of a document that is made one row, and of a section from which it is joined apart.
MOST_BLOCKS, HOT_SECTION = 100_000, 100_000
#: Types of raw blocks in which requirements are looked for.
STATED_TYPES = ["prose", "security", "list", "table"]


def with_statements(blocks: DataFrame) -> DataFrame:
    """Raw blocks with their requirement statements; exempt sections and other block types have none."""
    wanted = F.col("block_type").isin(STATED_TYPES) & ~X.is_exempt(F.col("hierarchy_path"))
    none = F.array().cast("array<struct<keyword:string,statement_text:string>>")
    return blocks.withColumn("normative_statements", F.when(wanted, X.statements(F.col("normalized_text"))).otherwise(none))


def canonical_blocks(raw: DataFrame) -> DataFrame:
    """Canonical blocks: blank ones dropped, types final, ids counted per document and section token in document order."""
    parts = X.section_parts(F.col("hierarchy_path"), F.col("section_number"), F.col("doc_id"))
    kept = raw.where(~X.is_blank(F.col("normalized_text"))).withColumn("_p", parts)
    nth = F.row_number().over(Window.partitionBy("doc_id", "_p.token").orderBy("ord"))
    path = F.split("hierarchy_path", " > ")
    return kept.withColumn("_n", nth).select(
        F.concat(F.lit("rfc"), F.col("doc_id"), F.lit("-"), F.col("_p.token"), F.lit("-blk"), F.col("_n")).alias("block_id"),
            F.col("doc_id").alias("rfc_id"), F.col("_p.section_id").alias("section_id"), F.col("_p.title").alias("title"),
        path.alias("hierarchy_path"), F.size(path).alias("section_depth"), X.final_type(F.col("block_type")).alias("block_type"),
            "sourcecode_type", "source_fragment", "normalized_text", "parsing_confidence", "normative_statements",
        (F.lower("hierarchy_path").isin("document root", "preface")).alias("is_preface"), "ord",
    )


def canonical_rows(blocks: DataFrame) -> DataFrame:
    """Canonical blocks with their place: ``section_no`` counts a document's sections in order of their first block, the preface being 0, and ``block_no`` the blocks of a section.

    The document as rows: whatever its size, no task and no row holds it as a whole.
    """
    keys = ["rfc_id", "is_preface", "section_id", "title", "hierarchy_path", "section_depth"]
    b = stage(blocks.withColumn("_s", F.xxhash64(*keys)), "placed")
    first = b.groupBy("_s", "rfc_id", "is_preface").agg(F.min("ord").alias("_first"))
    numbered = positions(stage(first.where("not is_preface"), "sections"), ["rfc_id"], [F.col("_first").asc(), F.col("_s").asc()], "section_no")
    places = numbered.select("_s", "section_no").unionByName(first.where("is_preface").select("_s", F.lit(0).cast("long").alias("section_no")))
    rows = stage(split_join(b, places, "_s", HOT_SECTION).drop("_s"), "rows")
    return positions(rows, ["rfc_id", "section_no"], [F.col("ord").asc(), F.col("block_id").asc()], "block_no")


def section_tree(blocks: DataFrame) -> DataFrame:
    """One row per document: preface blocks, and sections in order of their first block, each with its blocks in order.

    A row holds a whole document, so documents of more than ``MOST_BLOCKS`` blocks are left to :func:`canonical_rows`.
    """
    large = stage(blocks.groupBy("rfc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_BLOCKS).select("rfc_id"), "large")
    blocks = blocks.join(maybe_broadcast(large), "rfc_id", "left_anti")
    fields = ["block_id", "block_type", "sourcecode_type", "source_fragment", "normalized_text", "parsing_confidence", "normative_statements"]
    block = F.struct("ord", *fields)
    grouped = blocks.groupBy("rfc_id", "is_preface", "section_id", "title", "hierarchy_path", "section_depth").agg(F.min("ord")
        .alias("first"), F.array_sort(F.collect_list(block)).alias("blocks"))
    section = F.struct("first", "section_id", "title", "hierarchy_path", "section_depth",
        F.transform("blocks", lambda b: F.struct(*[b[f].alias(f) for f in fields])).alias("blocks"))
    docs = grouped.groupBy("rfc_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_preface"), section))).alias("s"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_preface"), section))), lambda x: x["blocks"])).alias("preface_blocks"),
    )
    return docs.select("rfc_id", F.transform("s",
        lambda x: F.struct(*[x[f].alias(f) for f in ("section_id", "title", "hierarchy_path", "section_depth", "blocks")])).alias("sections"), "preface_blocks")


def with_metadata(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """``docs(rfc_number, ...)`` with its index entry; a document without an entry gets a placeholder, a missing field its default."""
    m = meta.select("rfc_number", F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}")
        for c in ("title", "status", "stream", "published_at", "obsoletes", "updates", "updated_by")])
    j = docs.join(m, "rfc_number", "left")
    empty = F.array().cast("array<int>")
    return j.select(
        *docs.columns, F.coalesce("_title", F.concat(F.lit("RFC "), F.col("rfc_number"))).alias("title"),
            F.coalesce("_status", F.lit("UNKNOWN")).alias("status"),
        F.coalesce("_stream", F.when(F.col("_known"), "UNKNOWN").otherwise("IETF")).alias("stream"), F.col("_published_at.year")
            .alias("year"), F.col("_published_at.month").alias("month"),
        *[F.coalesce(f"_{c}", empty).alias(c) for c in ("obsoletes", "updates", "updated_by")],
    )


def window_split(text: str, limit: int = S.SPLIT_LIMIT, overlap: int = S.SPLIT_OVERLAP) -> list[str]:
    """Windows of at most ``limit`` characters; a window ends after the last newline of its final stretch, else after the last space, and the next begins ``overlap`` before that end."""
    out, at = [], 0
    while at + limit < len(text):
        tail = text[at + limit - overlap : at + limit] if overlap else ""
        keep = max(tail.rfind("\n"), -1)
        keep = keep if keep >= 0 else tail.rfind(" ")
        end = at + limit if keep < 0 or at + limit - overlap + keep <= at else at + limit - overlap + keep + 1
        out.append(text[at:end])
        at = max(end - overlap, at + 1)
    return [*out, text[at:]] if text else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def _windows(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: window_split(t) if t else [])


def chunk_blocks(blocks: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Chunks of canonical blocks: fragments of at most 2,000 characters with their route, id and the statements they hold whole; with ``meta``, the document's fields on each."""
    shown = F.when(F.col("is_preface"), F.lit("Preface")).otherwise(F.array_join("hierarchy_path",
        " > ")) if "is_preface" in blocks.columns else F.array_join("hierarchy_path", " > ")
    b = blocks.where(~X.is_blank(F.col("normalized_text")))
    # texts within the limit stay in the JVM; only the others are sent to Python
    long = F.length("normalized_text") > S.SPLIT_LIMIT
    parts = b.where(~long).withColumn("_parts", F.array("normalized_text")).unionByName(b.where(long).withColumn("_parts", _windows("normalized_text")))
    rows = parts.select("*", F.posexplode("_parts").alias("_i", "text_payload"))
    out = rows.select(
        F.concat(F.col("block_id"), F.lit("-chunk"), F.lpad(F.col("_i").cast("string"), 3, "0")).alias("chunk_id"), F.col("rfc_id")
            .alias("rfc_number"), "block_type", X.route_of(F.col("block_type")).alias("table_route"), shown.alias("hierarchy_path"),
        "text_payload", "sourcecode_type", "parsing_confidence", X.kept_statements(F.col("normative_statements"),
            F.col("text_payload")).alias("normative_statements"),
    )
    if meta is None:
        return out
    full = with_metadata(out, meta)
    return full.select("chunk_id", "rfc_number", F.col("title").alias("rfc_title"), "status", F.col("year").alias("rfc_year"),
        F.col("month").alias("rfc_month"), "stream", "obsoletes", "updated_by", *out.columns[2:])


def compile_corpus(docs: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical blocks and chunks of parsed documents (the output of ``parse_documents``); rows with an error are left out."""
    blocks = canonical_blocks(with_statements(docs.where("error is null")))
    return blocks, chunk_blocks(blocks, meta)
