"""Errata: the ledger, its digest, and corrections within retrieved texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan import schemas as S
from quillspan.functions import text as X
from quillspan.operators.skew import split_join
from quillspan.runtime import stage

#: Texts of one document from which they are joined apart.
HOT_DOCUMENT = 10_000


def ledger(raw: DataFrame) -> DataFrame:
    """Errata of a known status whose document id is 'RFC' and a number; ``rfc_number`` is added."""
    number = F.trim(F.substring("doc-id", 4, 100)).try_cast("int")
    return raw.where(F.upper("doc-id").startswith("RFC") & F.col("errata_status_code")
        .isin(S.ERRATA_STATUSES)).withColumn("rfc_number", number).where("rfc_number is not null")


def digest(errata: DataFrame) -> DataFrame:
    """``rfc_number, digest``: all errata of a document as one text, in ledger order."""
    line = F.concat(
        F.lit("- Section "), F.coalesce("section", F.lit("Unknown")), F.lit(": "),
            F.coalesce("errata_type_code", F.lit("Technical")), F.lit(" Error ("), F.col("errata_status_code"), F.lit(")\n  ORIGINAL TEXT:\n  "),
        F.coalesce("orig_text", F.lit("")), F.lit("\n  CORRECTED TEXT:\n  "), F.coalesce("correct_text", F.lit("")), F.lit("\n"),
    )
    rows = errata.groupBy("rfc_number").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("x"))
    return rows.select("rfc_number", F.concat(F.lit("\n[CRITICAL ERRATA DETECTED FOR RFC "), F.col("rfc_number").cast("string"),
        F.lit("]\n"), F.array_join(F.transform("x", lambda e: e["line"]), "\n")).alias("digest"))


def matches(hits: DataFrame, errata: DataFrame) -> DataFrame:
    """``chunk_id, corrections``: notes on every erratum of the hit's document whose original text stands in the hit, white space aside, in ledger order.

    The join has the document number as its key and the containment as a residual, so it is never a nested loop; texts of a
    document that has very many of them meet its errata by broadcast.
    """
    e = errata.where(~X.is_blank(F.col("orig_text"))).select("rfc_number", "ord", X.collapse_spaces("orig_text").alias("_want"),
        X.strip_spaces("orig_text").alias("_orig"), X.strip_spaces(F.coalesce("correct_text", F.lit(""))).alias("_right"),
            F.upper("errata_status_code").alias("_status"))
    h = hits.select("chunk_id", "rfc_number", X.collapse_spaces("text_payload").alias("_have")).distinct()
    # Fixed value: the wording of a correction.
    note = F.concat(F.lit("⚠️ [IETF ERRATA ("), F.col("_status"), F.lit(")] The text above contains a known error. Replace:\n'"),
        F.col("_orig"), F.lit("'\nWITH:\n'"), F.col("_right"), F.lit("'"))
    met = split_join(stage(h, "texts"), e, "rfc_number", HOT_DOCUMENT).where(F.col("_have").contains(F.col("_want")))
    rows = met.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("ord", note.alias("note")))).alias("x"))
    return rows.select("chunk_id", F.array_join(F.transform("x", lambda n: n["note"]), "\n\n").alias("corrections"))
