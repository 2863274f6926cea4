"""Row types and fixed vocabularies of the document model."""

from __future__ import annotations

from pyspark.sql import types as T

# Vocabularies of the document model.
BLOCK_TYPES = ["paragraph", "sourcecode", "artwork", "table", "list", "abnf", "security", "references"]
# (Routes are used as a set; the router gives them sorted.)
ROUTES = ["abnf", "artwork", "prose", "references", "security", "sourcecode", "table"]
SOURCECODE_FORMATS = ["yang", "asn.1", "mib", "json", "pseudocode", "c", "go", "python", "xml", "bash", "sh"]
TAG_TYPES = {"t": "prose", "ul": "list", "ol": "list", "dl": "list", "reference": "references", "sourcecode": "sourcecode",
    "artwork": "artwork", "table": "table"}
KEYWORDS = {
    "MUST": "MUST", "REQUIRED": "MUST", "SHALL": "MUST", "MUST NOT": "MUST NOT", "SHALL NOT": "MUST NOT", "SHOULD": "SHOULD", "RECOMMENDED": "SHOULD",
    "SHOULD NOT": "SHOULD NOT", "NOT RECOMMENDED": "SHOULD NOT", "MAY": "MAY", "OPTIONAL": "MAY",
}
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "spring": 4, "summer": 7, "fall": 10, "autumn": 10, "winter": 1,
}
EXEMPT_SECTIONS = ["abstract", "acknowledgments", "acknowledgements", "status of this memo", "table of contents",
    "author's address", "authors' addresses", "copyright notice", "references"]
BACK_MATTER = ["references", "author's address", "authors' addresses", "acknowledgments", "acknowledgements"]
ERRATA_STATUSES = ["Verified", "Reported", "Held for Document Update"]
CHAT_ROLES = ["user", "assistant", "system", "model"]
SPLIT_LIMIT, SPLIT_OVERLAP = 2000, 250
VECTOR_DIM = 256

STATEMENT = T.StructType([T.StructField("keyword", T.StringType()), T.StructField("statement_text", T.StringType())])
DATE = T.StructType([T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())])
_ints, _texts = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())

INDEX_XML = "`doc-id` string, title string, author array<struct<name:string>>, date struct<month:string, year:string>, `current-status` string, stream string, obsoletes struct<`doc-id`:array<string>>, updates struct<`doc-id`:array<string>>, `updated-by` struct<`doc-id`:array<string>>"
INDEX_ENTRY = T.StructType(
    [T.StructField("rfc_number", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("published_at", DATE),
        T.StructField("status", T.StringType()), T.StructField("stream", T.StringType()), T.StructField("authors", _texts)]
    + [T.StructField(c, _ints) for c in ("obsoletes", "updates", "updated_by")]
    + [T.StructField("protocol_family", T.StringType())]
)
ERRATUM = "`doc-id` string, errata_status_code string, errata_type_code string, section string, orig_text string, correct_text string"
RAW_BLOCK = (
    "doc_id int, ord int, hierarchy_path string, block_type string, source_type string, sourcecode_type string, normalized_text string, source_fragment string, parsing_confidence double, "
    "element_id string, section_number string, reference struct<anchor:string, category:string, title:string, target_url:string, doi:string, series_name:string, series_value:string>, error string"
)
CHUNK = (
    "chunk_id string, rfc_number int, rfc_title string, status string, rfc_year int, rfc_month int, stream string, obsoletes array<int>, updated_by array<int>, block_type string, table_route string, hierarchy_path string, "
    "text_payload string, sourcecode_type string, parsing_confidence double, normative_statements array<struct<keyword:string, statement_text:string>>"
)
TELEMETRY = "file string, status string, total_blocks int, normative_rules int, total_chars int, max_block_chars int, min_block_chars int, error string"
_BLOCK = (
    "struct<block_id:string, block_type:string, sourcecode_type:string, source_fragment:string, normalized_text:string, parsing_confidence:double, "
    "normative_statements:array<struct<keyword:string, statement_text:string>>>"
)
SECTIONS = f"array<struct<section_id:string, title:string, hierarchy_path:array<string>, section_depth:int, blocks:array<{_BLOCK}>>>"
CANONICAL = f"rfc_id int, sections {SECTIONS}, preface_blocks array<{_BLOCK}>"
#: What stands for an error that a failed document doesn't tell.
UNTOLD = "The document failed without a message."
