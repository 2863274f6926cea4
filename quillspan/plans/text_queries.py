"""Scalar functions over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan import schemas as S
from quillspan.functions import parse_txt
from quillspan.functions import questions as Q
from quillspan.functions import text as X
from quillspan.operators import compile as comp
from quillspan.runtime import load

_MONTH_NAMES = ["January", " FEB. ", "march", "Spring", "MAY", "June", "Summer", "aug", "Sept", "Autumn", "November", "Decembre"]


def one_block(spark: SparkSession, d: str) -> DataFrame:
    """Blocks without their repeated rows, with the path as a text."""
    return load(spark, d, "blocks").dropDuplicates(["block_id"]).withColumn("path", F.array_join("hierarchy_path", " > "))


def ws_collapse(spark, d):
    c = X.collapse_spaces("text")
    return load(spark, d, "documents").select("doc_id", F.length(c).alias("chars"), F.md5(c.cast("binary")).alias("digest"))


def doc_id_clean(spark, d):
    return load(spark, d, "documents").select("doc_id", X.document_number("text").alias("named_number"))


def fuzzy_month(spark, d):
    names = F.array(*[F.lit(n) for n in _MONTH_NAMES])
    return load(spark, d, "rfc_index").select("entry_ord", X.month_number(F.try_element_at(names, F.col("published_at.month"))).alias("month"))


def block_refine(spark, d):
    raw = F.when(F.col("block_type") == "paragraph", "prose").otherwise(F.col("block_type"))
    return one_block(spark, d).select("block_id", X.refined_type(raw, F.col("path")).alias("refined_type"),
        X.final_type(X.refined_type(raw, F.col("path"))).alias("final_type"))


def section_exempt(spark, d):
    return load(spark, d, "chunks").groupBy("hierarchy_path").agg(F.count(F.lit(1)).alias("rows")).select("hierarchy_path", "rows",
        F.coalesce(X.is_exempt(F.col("hierarchy_path")), F.lit(False)).alias("exempt"))


def sentence_split(spark, d):
    return one_block(spark, d).select("block_id", F.posexplode(X.sentences(F.col("normalized_text")))
        .alias("i", "s")).select("block_id", "i", F.md5(F.col("s").cast("binary")).alias("digest"))


def _stated(spark, d):
    b = comp.with_statements(raw_blocks(spark, d))
    return b.select(F.col("given_id").alias("block_id"), F.explode("normative_statements").alias("s")).select("block_id", "s.keyword", "s.statement_text")


def normative_statements(spark, d):
    return _stated(spark, d)


def normative_counts(spark, d):
    return _stated(spark, d).groupBy("keyword").agg(F.count(F.lit(1)).alias("statements"), F.countDistinct("block_id").alias("blocks"))


def statements_kept(spark, d):
    kept = X.kept_statements(F.col("normative_statements"), F.col("text_payload"))
    return load(spark, d, "chunks").select("chunk_id", F.size("normative_statements").alias("given"), F.size(kept).alias("kept"))


def section_token(spark, d):
    return one_block(spark, d).select("block_id", X.section_parts(F.col("path"), F.lit(None).cast("string"), F.col("rfc_id"))
        .alias("p")).select("block_id", "p.section_id", "p.token", "p.title")


def raw_blocks(spark, d):
    """Blocks as a parser gives them."""
    b = one_block(spark, d)
    return b.select(
        F.col("rfc_id").alias("doc_id"), "ord", F.col("path").alias("hierarchy_path"),
            F.when(F.col("block_type") == "paragraph", "prose").otherwise(F.col("block_type")).alias("block_type"), "sourcecode_type",
        "source_fragment", "normalized_text", "parsing_confidence", F.lit(None).cast("string").alias("section_number"), F.col("block_id").alias("given_id"),
    )


def block_ids(spark, d):
    made = comp.canonical_blocks(comp.with_statements(raw_blocks(spark, d)))
    return made.select(F.col("rfc_id"), "ord", F.col("block_id").alias("new_id"))


def _parsed(function, schema):
    """A function of the text parser as a column function."""

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([function(t) if t is not None else None for t in s])

    return run


def abnf_score(spark, d):
    score = _parsed(parse_txt.grammar_points, "int")
    return one_block(spark, d).select("block_id", score("source_fragment").alias("score")).withColumn("is_abnf", F.col("score") >= X.ABNF_LEAST)


def header_score(spark, d):
    return one_block(spark, d).select("block_id", _parsed(parse_txt.header_points, "int")("source_fragment").alias("score"))


def indent_groups(spark, d):
    def shape(text: str) -> list[int]:
        parts = parse_txt.paragraphs(text)
        return [len(parts), len(parse_txt.visual_blocks(text)), sum(map(parse_txt.indented, parts))]

    rows = load(spark, d, "documents").where("text is not null").select("doc_id", _parsed(shape, "array<long>")("text").alias("x")).where("x[0] > 0")
    return rows.select("doc_id", F.col("x")[0].alias("paragraphs"), F.col("x")[1].alias("blocks"), F.col("x")[2].alias("indented"))


def statement_json(spark, d):
    return load(spark, d, "lance_chunks").dropDuplicates(["chunk_id"]).select("chunk_id",
        F.md5(X.statements_json(F.from_json("normative_statements_json", "array<struct<keyword:string,statement_text:string>>"))
            .cast("binary")).alias("digest"))


def text_previews(spark, d):
    return load(spark, d, "chunks").select("chunk_id", X.preview(F.col("text_payload")).alias("preview")).distinct()


def route_map(spark, d):
    return load(spark, d, "chunks").groupBy("block_type", X.route_of(F.col("block_type")).alias("route"), "table_route").agg(F.count(F.lit(1)).alias("rows"))


def intent_routes(spark, d):
    q = F.col("query_text")
    return load(spark, d, "queries").select("query_id", F.array_join(Q.intents(q), ",").alias("intents"), F.array_join(Q.routes(q), ",").alias("routes"))


def rfc_filter_search(spark, d):
    q = load(spark, d, "queries").select("query_id", Q.named_document(F.col("query_text")).alias("rfc_number")).where("rfc_number is not null")
    return q.join(load(spark, d, "chunks").groupBy("rfc_number").agg(F.count(F.lit(1)).alias("rows")), "rfc_number",
        "left").select("query_id", "rfc_number", F.coalesce("rows", F.lit(0)).alias("rows"))


QUERIES = {f.__name__: f for f in (ws_collapse, doc_id_clean, fuzzy_month, block_refine, section_exempt, sentence_split,
    normative_statements, normative_counts, statements_kept, section_token, block_ids, abnf_score, header_score, indent_groups,
        statement_json, text_previews, route_map, intent_routes, rfc_filter_search)}

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


ONE_BLOCK = "one_block AS (SELECT *, array_to_string(hierarchy_path, ' > ') AS path FROM (SELECT *, row_number() OVER (PARTITION BY block_id) AS rn FROM blocks) WHERE rn = 1)"
_SENTENCES = r"string_split(regexp_replace(normalized_text, '([.!?])[\s\x{0b}]+', '\1' || chr(1), 'g'), chr(1))"
_KW = X.KEYWORD_PATTERN
_EXEMPT = """(list_contains(list_transform(string_split({p}, ' > '), lambda x: lower(x)), 'back') OR lower(trim(regexp_replace(string_split({p}, ' > ')[-1], '(?i)^(appendix\\s+[a-z0-9.]+\\s*)', ''))) IN ({names}))"""
_NAMES = ", ".join("'" + n.replace("'", "''") + "'" for n in S.EXEMPT_SECTIONS)


def sql_exempt(p: str) -> str:
    return _EXEMPT.format(p=p, names=_NAMES)


_STATED = f"""{ONE_BLOCK},
sent AS (SELECT block_id, unnest({_SENTENCES}) AS s FROM one_block WHERE block_type IN ('paragraph', 'security', 'list', 'table') AND NOT {sql_exempt('path')}),
hits AS (SELECT block_id, s, {sql_collapse("unnest(regexp_extract_all(s, '" + _KW + "'))")} AS kw FROM sent WHERE length({sql_strip('s')}) >= 12),
stated AS (SELECT block_id, CASE kw {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in S.KEYWORDS.items())} END AS keyword, {sql_strip('s')} AS statement_text FROM hits)"""

_TOKEN = """
parts AS (SELECT *, string_split(path, ' > ')[-1] AS last, lower(path) IN ('document root', 'preface') AS pre FROM one_block),
tok AS (SELECT *, split_part(last, ' ', 1) AS head, contains(last, ' ') AND regexp_matches(split_part(last, ' ', 1), '\\d') AS num FROM parts),
named AS (SELECT *,
  CASE WHEN pre THEN 'preface' WHEN num THEN head ELSE 'unknown' END AS sid,
  CASE WHEN pre THEN 'preface' WHEN num THEN 'sec' || trim(head, '.') ELSE 'secunknown-' || substr(sha256(rfc_id || ':' || path), 1, 8) END AS token,
  CASE WHEN pre THEN path WHEN num THEN trim(substr(last, length(head) + 2)) ELSE trim(last) END AS ttl FROM tok)"""

_UPPER_FIRST = "upper(first) = first AND lower(first) <> first AND length(first) < 60"
_ROMAN = X.ROMAN_HEADER.replace("(?=[MDCLXVI])", "")


def _case_prefix(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} LIKE '{k}%' THEN {v}" for k, v in S.MONTHS.items()) + " END"


def _intent_case(fmt: str) -> str:
    return ", ".join(fmt.format(p=p.replace("'", "''"), name=n) for n, p in Q.INTENT_WORDS.items())


_ABNF = " + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {n} ELSE 0 END" for p, n in X.ABNF_SIGNALS)

ORACLE = {
    "ws_collapse": f"SELECT doc_id, CAST(length(c) AS INTEGER) AS chars, md5(c) AS digest FROM (SELECT doc_id, {sql_collapse('text')} AS c FROM documents)",
    "doc_id_clean": r"SELECT doc_id, coalesce(try_cast(regexp_extract(text, '(?i)RFC(\d+)', 1) AS INTEGER), 0) AS named_number FROM documents",
    "fuzzy_month": f"SELECT entry_ord, CAST({_case_prefix('m')} AS INTEGER) AS month FROM (SELECT entry_ord, lower(trim({_MONTH_NAMES!r}[published_at.month])) AS m FROM rfc_index)",
    "block_refine": f"""WITH {ONE_BLOCK}, r AS (SELECT block_id, CASE WHEN block_type = 'paragraph' THEN CASE WHEN contains(lower(path), 'security considerations') THEN 'security' WHEN contains(lower(path), 'references') THEN 'references' ELSE 'prose' END ELSE block_type END AS refined_type FROM one_block)
SELECT block_id, refined_type, CASE WHEN refined_type = 'prose' THEN 'paragraph' ELSE refined_type END AS final_type FROM r""",
    "section_exempt": f"SELECT hierarchy_path, count(*) AS rows, coalesce({sql_exempt('hierarchy_path')}, false) AS exempt FROM chunks GROUP BY hierarchy_path",
    "sentence_split": f"WITH {ONE_BLOCK}, s AS (SELECT block_id, {_SENTENCES} AS l FROM one_block) SELECT block_id, CAST(i - 1 AS INTEGER) AS i, md5(l[i]) AS digest FROM s, unnest(range(1, len(l) + 1)) AS t(i)",
    "normative_statements": f"WITH {_STATED} SELECT block_id, keyword, statement_text FROM stated",
    "normative_counts": f"WITH {_STATED} SELECT keyword, count(*) AS statements, count(DISTINCT block_id) AS blocks FROM stated GROUP BY keyword",
    "statements_kept": "SELECT chunk_id, CAST(len(normative_statements) AS INTEGER) AS given, CAST(len(list_filter(normative_statements, lambda s: contains(text_payload, s.statement_text))) AS INTEGER) AS kept FROM chunks",
    "section_token": f"WITH {ONE_BLOCK}, {_TOKEN} SELECT block_id, sid AS section_id, token, ttl AS title FROM named",
    "block_ids": f"WITH {ONE_BLOCK}, {_TOKEN} SELECT rfc_id, ord, 'rfc' || rfc_id || '-' || token || '-blk' || row_number() OVER (PARTITION BY rfc_id, token ORDER BY ord) AS new_id FROM named WHERE length({sql_strip("coalesce(normalized_text, '')")}) > 0",
    "abnf_score": f"""WITH {ONE_BLOCK}, s AS (SELECT block_id, source_fragment AS t, len(regexp_extract_all(source_fragment, '{X.ABNF_RULE}')) AS rules FROM one_block),
p AS (SELECT block_id, CAST(2 * rules + {_ABNF} + CASE WHEN contains(t, '[') AND contains(t, ']') AND rules < 2 THEN -5 ELSE 0 END AS INTEGER) AS score FROM s)
SELECT block_id, score, score >= 8 AS is_abnf FROM p""",
    "header_score": f"""WITH {ONE_BLOCK}, l AS (SELECT block_id, string_split(source_fragment, chr(10)) AS ls FROM one_block),
f AS (SELECT block_id, ls, {sql_strip('ls[1]')} AS first, coalesce(regexp_matches({sql_strip('ls[2]')}, '^[-=_\\s]{{3,}}$'), false) AS ruled, len(list_filter(ls, lambda x: length({sql_strip('x')}) > 0)) AS active FROM l),
g AS (SELECT *, regexp_replace(lower(first), '[.:\\- ]+$', '') AS plain FROM f)
SELECT block_id, CAST(CASE WHEN length(first) = 0 THEN 0 ELSE
  CASE WHEN regexp_matches(plain, '{X.UNNUMBERED_HEADER.replace("'", "''")}') THEN 10 WHEN regexp_matches(first, '{X.NUMERIC_HEADER}') THEN 8 WHEN regexp_matches(first, '{X.APPENDIX_HEADER}') THEN 9
    WHEN regexp_matches(first, '{_ROMAN}') AND regexp_matches(first, '(?i)^[MDCLXVI]') THEN 7 ELSE 0 END
  + CASE WHEN ruled THEN 10 ELSE 0 END + CASE WHEN {_UPPER_FIRST} THEN 4 ELSE 0 END + CASE WHEN active = 1 OR (ruled AND active = 2) THEN 4 ELSE 0 END
  - CASE WHEN first LIKE '%,' OR first LIKE '%;' OR regexp_matches(lower(first), '\\s{{2,}}(?:and|or|the|of)\\s+') THEN 6 ELSE 0 END - CASE WHEN length(first) > 120 THEN 12 ELSE 0 END END AS INTEGER) AS score FROM g""",
    "indent_groups": f"""WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n[\\s\\x{{0b}}]*\\n', chr(1), 'g'), chr(1)) AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, i, regexp_replace(l[i], '^\\n+|\\n+$', '', 'g') AS x FROM p, unnest(range(1, len(l) + 1)) AS t(i) WHERE length({sql_strip('l[i]')}) > 0),
f AS (SELECT doc_id, i, len(list_filter(string_split(x, chr(10)), lambda y: length({sql_strip('y')}) > 0 AND NOT starts_with(y, '    '))) = 0 AS ind FROM e),
g AS (SELECT doc_id, ind, CASE WHEN ind AND coalesce(lag(ind) OVER (PARTITION BY doc_id ORDER BY i), false) THEN 0 ELSE 1 END AS fresh FROM f)
SELECT doc_id, count(*) AS paragraphs, CAST(sum(fresh) AS BIGINT) AS blocks, count(*) FILTER (ind) AS indented FROM g GROUP BY doc_id""",
    "statement_json": "SELECT chunk_id, md5(any_value(normative_statements_json)) AS digest FROM lance_chunks GROUP BY chunk_id",
    "text_previews": "SELECT DISTINCT chunk_id, substr(replace(text_payload, chr(10), ' '), 1, 120) AS preview FROM chunks",
    "route_map": "SELECT block_type, CASE WHEN block_type IN ('abnf', 'artwork', 'references', 'security', 'sourcecode', 'table') THEN block_type ELSE 'prose' END AS route, table_route, count(*) AS rows FROM chunks GROUP BY ALL",
    "intent_routes": f"""WITH i AS (SELECT query_id, list_sort(list_filter([{_intent_case("CASE WHEN regexp_matches(query_text, '{p}') THEN '{name}' END")}], lambda x: x IS NOT NULL)) AS l FROM queries)
SELECT query_id, CASE WHEN len(l) = 0 THEN 'conceptual_explanation' ELSE array_to_string(l, ',') END AS intents,
  array_to_string(list_sort(list_distinct(['prose'] || CASE WHEN list_contains(l, 'syntax_grammar') THEN ['abnf', 'sourcecode'] ELSE [] END || CASE WHEN list_contains(l, 'visual_structure') THEN ['artwork', 'table'] ELSE [] END
    || CASE WHEN list_contains(l, 'security_analysis') THEN ['security'] ELSE [] END || CASE WHEN list_contains(l, 'normative_query') THEN ['abnf'] ELSE [] END || CASE WHEN list_contains(l, 'protocol_history') THEN ['references'] ELSE [] END)), ',') AS routes FROM i""",
    "rfc_filter_search": rf"""WITH q AS (SELECT query_id, try_cast(regexp_extract(query_text, '{Q.NUMBER_IN_QUESTION}', 1) AS INTEGER) AS n FROM queries)
SELECT query_id, n AS rfc_number, (SELECT count(*) FROM chunks c WHERE c.rfc_number = n) AS rows FROM q WHERE n IS NOT NULL""",
}
