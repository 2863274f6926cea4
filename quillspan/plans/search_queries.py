"""Succession, errata, search and retrieval over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import questions as Q
from quillspan.functions import text as X
from quillspan.operators import errata, lineage, retrieval, search
from quillspan.plans import text_queries
from quillspan.plans.hierarchy_queries import valid_entries
from quillspan.plans.text_queries import ONE_BLOCK, one_block, sql_collapse, sql_strip
from quillspan.runtime import load, stage


def _edges(spark, d):
    return lineage.node_edges(load(spark, d, "lineage_nodes"))


def lineage_reverse_edges(spark, d):
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return lineage.reverse_edges(_edges(spark, d)).select("rfc_number", join("obsoleted_by").alias("obsoleted_by"), join("updated_by").alias("updated_by"))


def lineage_active(spark, d):
    return lineage.active_successors(_edges(spark, d))


def lineage_warning(spark, d):
    return lineage.warnings(_edges(spark, d))


def ledger(spark, d):
    """Errata stand-ins: each requirement statement of a block is an erratum of its document, whose status follows its keyword."""
    rows = one_block(spark, d).select("rfc_id", "block_id", F.posexplode("normative_statements").alias("i", "s"))
    status = F.when(F.col("s.keyword") == "MUST", "Verified").when(F.col("s.keyword") == "SHOULD",
        "Reported").when(F.col("s.keyword") == "MAY", "Held for Document Update").otherwise("Rejected")
    return errata.ledger(rows.select(F.concat(F.lit("RFC"), F.col("rfc_id")).alias("doc-id"), status.alias("errata_status_code"),
        F.lit("Technical").alias("errata_type_code"), F.col("block_id").alias("section"), F.col("s.statement_text")
            .alias("orig_text"), F.concat(F.col("s.keyword"), F.lit(" [corrected]")).alias("correct_text"),
                F.concat("block_id", F.lit("/"), F.lpad(F.col("i").cast("string"), 4, "0")).alias("ord")))


def errata_ledger(spark, d):
    return ledger(spark, d).groupBy("rfc_number").agg(F.count(F.lit(1)).alias("errata"))


def errata_digest(spark, d):
    return errata.digest(ledger(spark, d))


def _hits(spark, d):
    return load(spark, d, "retrieval_hits").select("query_id", "chunk_id", "rfc_number", "table_route", "hierarchy_path", "text_payload").distinct()


def errata_theta_join(spark, d):
    c = load(spark, d, "chunks").select("chunk_id", "rfc_number", "text_payload").dropDuplicates(["chunk_id"])
    return errata.matches(c, ledger(spark, d)).select("chunk_id", F.md5(F.col("corrections").cast("binary")).alias("digest"))


def enrich_hits(spark, d):
    out = retrieval.enriched(_hits(spark, d), lineage.warnings(_edges(spark, d)), ledger(spark, d))
    return out.select("query_id", "chunk_id", "is_obsolete", "is_updated", "has_errata", F.md5(F.col("text_payload").cast("binary")).alias("digest"))


def enrich_counters(spark, d):
    return enrich_hits(spark, d).agg(F.count_if("is_obsolete").alias("obsolete"), F.count_if("is_updated").alias("updated"),
        F.count_if("has_errata").alias("with_errata"))


def neighbor_stitch(spark, d):
    out = retrieval.stitched(_hits(spark, d), load(spark, d, "chunks"))
    return out.select("query_id", "chunk_id", F.length("text_payload").alias("chars"), F.md5(F.col("text_payload").cast("binary")).alias("digest"))


def context_format(spark, d):
    h = load(spark, d, "retrieval_hits").groupBy("query_id", "chunk_id").agg(F.max(F.when(~F.isnan("score"), F.col("score")))
        .alias("score"), F.min(F.struct("rfc_number", "table_route", "hierarchy_path", "text_payload"))
            .alias("x")).select("query_id", "chunk_id", "score", "x.*")
    asked = load(spark, d, "queries").select("query_id", "top_k")
    ranked = retrieval.rerank(h.withColumn("score", F.coalesce("score", F.lit(0.0))).join(asked, "query_id"), asked)
    return retrieval.contexts(ranked).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"), F.length("context").alias("chars"))


def rerank_fallback(spark, d):
    h = load(spark, d, "retrieval_hits").groupBy("query_id", "chunk_id").agg(F.max(F.when(~F.isnan("hybrid_score"), F.col("hybrid_score"))).alias("s"))
    h = h.select("query_id", "chunk_id", F.coalesce("s", F.lit(0.0)).alias("score")).join(load(spark, d, "queries").select("query_id", "top_k"), "query_id")
    return retrieval.rerank(h, load(spark, d, "queries")).select("query_id", "chunk_id", "rank")


def last_user_message(spark, d):
    q = load(spark, d, "queries")
    return q.groupBy(F.to_date("asked_at").cast("string").alias("day")).agg(F.max_by("query_text", F.struct("asked_at", "query_id")).alias("last_text"))


# search


def vec_normalize(spark, d):
    u = load(spark, d, "embeddings").withColumn("u", search.unit(F.col("embedding"), 32))
    return u.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[31], 6).alias("last"), F.size("u").alias("dim"))


def dense_topk(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return search.dense_topk(e, q, 10, dim=64).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


def _one_chunk(spark, d):
    return load(spark, d, "chunks").groupBy("chunk_id").agg(F.min(F.struct("rfc_number", "table_route", "hierarchy_path",
        "text_payload")).alias("x")).select("chunk_id", "x.*")


def _ranked(df, k):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_topk(spark, d):
    s = search.bm25_topk(_one_chunk(spark, d), load(spark, d, "queries"), 10)
    return _ranked(s.select("query_id", F.col("item").alias("chunk_id"), "score"), 10)


def per_route_topk(spark, d):
    c = _one_chunk(spark, d)
    s = search.bm25_topk(c, load(spark, d, "queries"), 5, group="table_route")
    return s.select("query_id", "table_route", F.col("item").alias("chunk_id"), "score")


def _with_vectors(spark, d):
    """Chunks that have a usable vector, and questions with one: that of the first chunk, by id, among a question's hits that has any."""
    v = load(spark, d, "lance_chunks").where(search.sound("vector", 256)).groupBy("chunk_id").agg(F.min("vector").alias("vector"))
    c = _one_chunk(spark, d).join(v, "chunk_id")
    hits = load(spark, d, "retrieval_hits").select("query_id", "chunk_id").distinct().join(v, "chunk_id")
    q = load(spark, d, "queries").join(hits.groupBy("query_id").agg(F.min_by("vector", "chunk_id").alias("vector")), "query_id")
    return stage(c, "chunks"), stage(q, "questions")


def hybrid_rrf(spark, d):
    """BM25 over texts and cosine over vectors, fifty of each, fused by reciprocal rank."""
    c, q = _with_vectors(spark, d)
    words = search.bm25_topk(c, q, 50)
    near = search.dense_topk(c, q, 50, "chunk_id", dim=256).select("query_id", F.col("id").alias("item"), F.round("score", 7).alias("score"))
    return search.fuse_ranks([words, near], 10, depth=50).select("query_id", F.col("item").alias("chunk_id"), F.round("score", 8).alias("score"), "rank")


def ann_topk(spark, d):
    """Inverted-file search of every twentieth vector among all, in 64 cells."""
    c, _ = _with_vectors(spark, d)
    q = c.where(F.pmod(F.xxhash64("chunk_id"), F.lit(20)) == 0).select(F.col("chunk_id").alias("query_id"), "vector")
    return search.ann_topk(c, q, 10, "chunk_id", dim=256, cells=64).select("query_id", F.col("id").alias("chunk_id"), "rank")


def retrieve_hybrid_topk(spark, d):
    """Routed hybrid search of the questions that have a vector: per route and over all, cut to what reranking wants."""
    c, q = _with_vectors(spark, d)
    hits = retrieval.candidates(c, q, c.select("chunk_id", "vector"), q.select("query_id", "vector"), 256)
    return retrieval.rerank(hits, q).select("query_id", "chunk_id", "table_route", F.round("score", 8).alias("score"), "rank")


def embed_chunks(spark, d):
    c = _one_chunk(spark, d)
    return search.embed(c, "text_payload").select("chunk_id", F.size("vector").alias("dim"))


def dense_route_topk(spark, d):
    """Encoded questions against the encoded chunks of their routes and of the document they name, with the stand-in encoder; ten per question and route."""
    c, q = search.embed(_one_chunk(spark, d), "text_payload"), search.embed(load(spark, d, "queries"), "query_text", prefix=search.QUERY_PREFIX)
    c, q = stage(c, "chunks"), stage(q, "questions")
    near = retrieval.vector_list(c, q, c.select("chunk_id", "vector"), q.select("query_id", "vector"), F.lit(10))
    return near.select("query_id", "table_route", F.col("item").alias("chunk_id"))


def retrieve_bm25_topk(spark, d):
    c, q = _one_chunk(spark, d), load(spark, d, "queries")
    hits = retrieval.rerank(retrieval.candidates(c, q), q)
    return hits.select("query_id", "rank", retrieval.cited_block(F.col("rank")).alias("block"))


def retrieve_contexts(spark, d):
    out = retrieval.retrieve(_one_chunk(spark, d), load(spark, d, "queries"), lineage.warnings(_edges(spark, d)), ledger(spark, d), retrieval.overlap_scorer)
    return out.select("query_id", F.length("context").alias("chars"), out.context.contains("[SOURCE 1").alias("has_source"), "degraded")


def sound_hits(spark, d):
    """Hits as they come from search, without the malformed ones; scores that are missing count as 0."""
    return retrieval.sound_hits(load(spark, d, "retrieval_hits")).groupBy("table_route").agg(F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("score") == 0).alias("zero"))


def context_audit(spark, d):
    """Contexts of all questions, cited or empty."""
    h = retrieval.sound_hits(load(spark, d, "retrieval_hits")).groupBy("query_id",
        "chunk_id").agg(F.max(F.struct("score", "rfc_number", "table_route", "hierarchy_path", "text_payload"))
            .alias("x")).select("query_id", "chunk_id", "x.*")
    asked = load(spark, d, "queries").select("query_id", "top_k")
    made = retrieval.contexts(retrieval.rerank(h.join(asked, "query_id"), asked))
    return retrieval.audit_contexts(asked.join(made, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(retrieval.EMPTY_CONTEXT))))


QUERIES = {
    f.__name__: f
    for f in (
        lineage_reverse_edges, lineage_active, lineage_warning, errata_ledger, errata_digest, errata_theta_join, enrich_hits,
            enrich_counters, neighbor_stitch, context_format, rerank_fallback, last_user_message, vec_normalize, dense_topk,
        bm25_topk, per_route_topk, hybrid_rrf, ann_topk, embed_chunks, dense_route_topk, retrieve_bm25_topk, retrieve_hybrid_topk,
        retrieve_contexts, sound_hits, context_audit,
    )
}

_LINK = """link AS (SELECT DISTINCT src, dst, kind FROM (
  SELECT rfc_number AS src, unnest(obsoletes) AS dst, 'obsoletes' AS kind FROM lineage_nodes UNION ALL SELECT rfc_number, unnest(updates), 'updates' FROM lineage_nodes UNION ALL SELECT unnest(updated_by), rfc_number, 'updates' FROM lineage_nodes)
  WHERE src > 0 AND dst > 0),
rev AS (SELECT dst AS rfc_number, coalesce(list_sort(list(src) FILTER (kind = 'obsoletes')), []) AS ob, coalesce(list_sort(list(src) FILTER (kind = 'updates')), []) AS ub FROM link GROUP BY dst)"""
_ACTIVE = f"""{_LINK},
up(node, above) AS (SELECT dst, src FROM link WHERE kind = 'obsoletes' UNION SELECT u.node, l.src FROM up u JOIN link l ON l.dst = u.above AND l.kind = 'obsoletes'),
act AS (SELECT DISTINCT node AS rfc_number, above AS active FROM up WHERE above NOT IN (SELECT dst FROM link WHERE kind = 'obsoletes')
  UNION SELECT n, n FROM (SELECT src AS n FROM link UNION SELECT dst FROM link) WHERE n NOT IN (SELECT dst FROM link WHERE kind = 'obsoletes'))"""
_NUM = "array_to_string(list_transform({}, lambda x: 'RFC ' || x), ', ')"
_WARN = f"""{_ACTIVE},
al AS (SELECT rfc_number, list_sort(list(active)) AS al FROM act GROUP BY rfc_number),
warn AS (SELECT rfc_number, len(ob) > 0 AS is_obsolete, len(ub) > 0 AS is_updated,
  CASE WHEN len(ob) > 0 THEN '[TEMPORAL WARNING: This chunk is from RFC ' || rfc_number || ', which is OBSOLETE. It was superseded by ' || {_NUM.format('ob')} || '.' ||
    CASE WHEN al IS NOT NULL AND al <> ob THEN ' The current active standard(s) resolving this lineage are ' || {_NUM.format('al')} || '.' ELSE '' END || ' Evaluate this text with historical caution.]'
  ELSE '[TEMPORAL NOTICE: This chunk is from RFC ' || rfc_number || ', which is active but has been UPDATED by ' || {_NUM.format('ub')} || '. Please consider these later modifications.]' END AS warning
  FROM rev LEFT JOIN al USING (rfc_number))"""
_LEDGER = f"""{ONE_BLOCK},
raw AS (SELECT rfc_id, block_id, i, normative_statements[i] AS s FROM one_block, unnest(range(1, coalesce(len(normative_statements), 0) + 1)) AS t(i)),
err AS (SELECT rfc_id AS rfc_number, block_id AS section, block_id || '/' || lpad(CAST(i - 1 AS VARCHAR), 4, '0') AS ord, s.statement_text AS orig, s.keyword || ' [corrected]' AS fix,
  CASE s.keyword WHEN 'MUST' THEN 'Verified' WHEN 'SHOULD' THEN 'Reported' ELSE 'Held for Document Update' END AS status FROM raw WHERE s.keyword IN ('MUST', 'SHOULD', 'MAY'))"""
_NOTE = f"""'⚠️ [IETF ERRATA (' || upper(status) || ')] The text above contains a known error. Replace:' || chr(10) || '''' || {sql_strip('orig')} || '''' || chr(10) || 'WITH:' || chr(10) || '''' || {sql_strip('fix')} || ''''"""


def _corrections(rows: str) -> str:
    return f"SELECT chunk_id, string_agg({_NOTE}, chr(10) || chr(10) ORDER BY ord) AS corrections FROM {rows} h JOIN err USING (rfc_number) WHERE contains(h.have, {sql_collapse('orig')}) AND length({sql_strip('orig')}) > 0 GROUP BY chunk_id"


_ENRICH = f"""{_WARN}, {_LEDGER},
hit AS (SELECT DISTINCT query_id, chunk_id, rfc_number, table_route, hierarchy_path, text_payload FROM retrieval_hits),
told AS (SELECT *, contains(text_payload, '[TEMPORAL') AS t FROM hit LEFT JOIN (SELECT rfc_number, is_obsolete, is_updated, warning FROM warn) USING (rfc_number)),
noted AS (SELECT query_id, chunk_id, rfc_number, NOT t AND coalesce(is_obsolete, false) AS is_obsolete, NOT t AND coalesce(is_updated, false) AS is_updated, CASE WHEN t OR warning IS NULL THEN text_payload ELSE warning || chr(10) || chr(10) || text_payload END AS body FROM told),
seen AS (SELECT DISTINCT md5(body) AS chunk_id, rfc_number, {sql_collapse('body')} AS have FROM noted WHERE NOT contains(body, '[IETF ERRATA')),
fixed AS ({_corrections('seen')}),
rich AS (SELECT n.query_id, n.chunk_id, is_obsolete, is_updated, corrections IS NOT NULL AS has_errata, body || coalesce(chr(10) || chr(10) || corrections, '') AS body FROM noted n LEFT JOIN fixed f ON f.chunk_id = md5(body))"""
_CHUNK1 = "c1 AS (SELECT chunk_id, x.* FROM (SELECT chunk_id, min({'rfc_number': rfc_number, 'table_route': table_route, 'hierarchy_path': hierarchy_path, 'text_payload': text_payload}) AS x FROM chunks GROUP BY chunk_id))"


def _bm25(col: str, tag: str, asked: str = "queries") -> str:
    """CTEs ending in {tag}(query_id, chunk_id, score)."""
    return f"""w_{tag} AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower({col}), '[^a-z0-9]+'), lambda x: length(x) > 0) AS t FROM c1),
n_{tag} AS (SELECT count(*) AS n, avg(CAST(len(t) AS DOUBLE)) AS a FROM w_{tag}),
p_{tag} AS (SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM w_{tag}) GROUP BY ALL),
d_{tag} AS (SELECT term, count(*) AS df FROM p_{tag} GROUP BY term),
{tag} AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 5) AS score
  FROM (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(query_text), '[^a-z0-9]+')) AS term FROM {asked}) q JOIN p_{tag} USING (term) JOIN d_{tag} USING (term), n_{tag} GROUP BY query_id, chunk_id)"""


_VECTORS = """
one AS (SELECT chunk_id, x.* FROM (SELECT chunk_id, min({'rfc_number': rfc_number, 'table_route': table_route, 'hierarchy_path': hierarchy_path, 'text_payload': text_payload}) AS x FROM chunks GROUP BY chunk_id)),
vec AS (SELECT chunk_id, min(vector) AS v FROM lance_chunks WHERE len(vector) = 256 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
c1 AS (SELECT one.*, v FROM one JOIN vec USING (chunk_id)),
asked AS (SELECT q.query_id, query_text, top_k, try_cast(regexp_extract(query_text, '{number}', 1) AS INTEGER) AS doc, h.v
  FROM queries q JOIN (SELECT query_id, arg_min(v, chunk_id) AS v FROM retrieval_hits JOIN vec USING (chunk_id) GROUP BY query_id) h USING (query_id))""".replace("{number}", Q.NUMBER_IN_QUESTION)
_ROUTES = f"SELECT query_id, routes FROM ({text_queries.ORACLE['intent_routes']})"

ORACLE = {
    "lineage_reverse_edges": f"WITH {_LINK} SELECT rfc_number, array_to_string(ob, ',') AS obsoleted_by, array_to_string(ub, ',') AS updated_by FROM rev",
    "lineage_active": f"WITH RECURSIVE {_ACTIVE} SELECT rfc_number, active FROM act",
    "lineage_warning": f"WITH RECURSIVE {_WARN} SELECT * FROM warn",
    "errata_ledger": f"WITH {_LEDGER} SELECT rfc_number, count(*) AS errata FROM err GROUP BY rfc_number",
    "errata_digest": f"""WITH {_LEDGER} SELECT rfc_number, chr(10) || '[CRITICAL ERRATA DETECTED FOR RFC ' || rfc_number || ']' || chr(10) || string_agg('- Section ' || section || ': Technical Error (' || status || ')' || chr(10) || '  ORIGINAL TEXT:' || chr(10) || '  ' || orig || chr(10) || '  CORRECTED TEXT:' || chr(10) || '  ' || fix || chr(10), chr(10) ORDER BY ord) AS digest
FROM err GROUP BY rfc_number""",
    "errata_theta_join": f"WITH {_LEDGER}, seen AS (SELECT DISTINCT chunk_id, rfc_number, {sql_collapse('text_payload')} AS have FROM chunks), fixed AS ({_corrections('seen')}) SELECT chunk_id, md5(corrections) AS digest FROM fixed",
    "enrich_hits": f"WITH RECURSIVE {_ENRICH} SELECT query_id, chunk_id, is_obsolete, is_updated, has_errata, md5(body) AS digest FROM rich",
    "enrich_counters": f"WITH RECURSIVE {_ENRICH} SELECT count(*) FILTER (is_obsolete) AS obsolete, count(*) FILTER (is_updated) AS updated, count(*) FILTER (has_errata) AS with_errata FROM rich",
    "neighbor_stitch": f"""WITH hit AS (SELECT DISTINCT query_id, chunk_id, text_payload FROM retrieval_hits), c AS (SELECT chunk_id, any_value(text_payload) AS t, regexp_extract(chunk_id, '{retrieval.NEIGHBOUR_ID}', 1) AS p, try_cast(regexp_extract(chunk_id, '{retrieval.NEIGHBOUR_ID}', 2) AS INTEGER) AS b FROM chunks GROUP BY chunk_id),
h AS (SELECT *, regexp_extract(chunk_id, '{retrieval.NEIGHBOUR_ID}', 1) AS p, try_cast(regexp_extract(chunk_id, '{retrieval.NEIGHBOUR_ID}', 2) AS INTEGER) AS b FROM hit),
u AS (SELECT query_id, chunk_id, chunk_id AS k, text_payload AS t FROM hit UNION ALL SELECT h.query_id, h.chunk_id, c.chunk_id, c.t FROM h JOIN c ON c.p = h.p AND c.p <> '' AND (c.b = h.b - 1 OR c.b = h.b + 1)),
j AS (SELECT query_id, chunk_id, string_agg(t, chr(10) || chr(10) ORDER BY k) AS t FROM u GROUP BY ALL)
SELECT query_id, chunk_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM j""",
    "context_format": f"""WITH h AS (SELECT query_id, chunk_id, coalesce(max(CASE WHEN isnan(score) THEN NULL ELSE score END), 0) AS score, min({{'a': rfc_number, 'b': table_route, 'c': hierarchy_path, 'd': text_payload}}) AS x FROM retrieval_hits GROUP BY ALL),
r AS (SELECT h.*, top_k, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM h JOIN queries USING (query_id)),
b AS (SELECT query_id, k, '### [SOURCE ' || k || ': RFC ' || x.a || ' | Format: ' || upper(x.b) || ' | Path: ' || x.c || ']' || chr(10) || {sql_strip("replace(x.d, '### [SOURCE', '--- [SOURCE')")} AS t FROM r WHERE k <= top_k),
c AS (SELECT query_id, '{retrieval.PREAMBLE.strip()}' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) || repeat('-', 65) || chr(10) || chr(10) ORDER BY k) AS t FROM b GROUP BY query_id)
SELECT query_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM c""",
    "rerank_fallback": """WITH h AS (SELECT query_id, chunk_id, coalesce(max(CASE WHEN isnan(hybrid_score) THEN NULL ELSE hybrid_score END), 0) AS s FROM retrieval_hits GROUP BY ALL),
r AS (SELECT query_id, chunk_id, top_k, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS INTEGER) AS rank FROM h JOIN queries USING (query_id)) SELECT query_id, chunk_id, rank FROM r WHERE rank <= top_k""",
    "last_user_message": "SELECT CAST(CAST(asked_at AS DATE) AS VARCHAR) AS day, arg_max(query_text, {'a': asked_at, 'b': query_id}) AS last_text FROM queries GROUP BY 1",
    "vec_normalize": """WITH u AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT *, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS l FROM u)
SELECT vec_id, round(v[1] / l, 6) AS first, round(v[32] / l, 6) AS last, CAST(len(v) AS INTEGER) AS dim FROM n""",
    "dense_topk": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, id, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""",
    "bm25_topk": f"WITH {_CHUNK1}, {_bm25('text_payload', 's')}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10",
    "per_route_topk": f"WITH {_CHUNK1}, {_bm25('text_payload', 's')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, table_route ORDER BY score DESC, chunk_id) AS k FROM s JOIN c1 USING (chunk_id)) SELECT query_id, table_route, chunk_id, score FROM r WHERE k <= 5",
    "embed_chunks": "SELECT DISTINCT chunk_id, CAST(256 AS INTEGER) AS dim FROM chunks",
    "retrieve_bm25_topk": f"""WITH {_CHUNK1}, {_bm25('text_payload', 's')},
asked AS (SELECT query_id, top_k, try_cast(regexp_extract(query_text, '{Q.NUMBER_IN_QUESTION}', 1) AS INTEGER) AS doc FROM queries),
want AS (SELECT a.query_id, top_k, doc, unnest(string_split(routes, ',')) AS table_route FROM asked a JOIN ({_ROUTES}) r USING (query_id)),
words AS (
  SELECT query_id, top_k, c1.*, s.score, row_number() OVER (PARTITION BY query_id, table_route ORDER BY s.score DESC, chunk_id) AS r
  FROM s JOIN c1 USING (chunk_id) JOIN want USING (query_id, table_route) WHERE doc IS NULL OR doc = rfc_number),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM words WHERE r <= 5 * top_k)
SELECT query_id, CAST(k AS INTEGER) AS rank, '### [SOURCE ' || k || ': RFC ' || rfc_number || ' | Format: ' || upper(table_route) || ' | Path: ' || hierarchy_path || ']' || chr(10)
  || {sql_strip("replace(text_payload, '### [SOURCE', '--- [SOURCE')")} AS block FROM pool WHERE k <= top_k""",
    "sound_hits": """SELECT coalesce(table_route, 'Unknown') AS table_route, count(*) AS rows, count(*) FILTER (coalesce(score, 0) = 0 OR isnan(score)) AS zero FROM retrieval_hits
WHERE chunk_id IS NOT NULL AND text_payload IS NOT NULL AND rfc_number IS NOT NULL GROUP BY 1""",
    "context_audit": """WITH h AS (SELECT DISTINCT query_id FROM retrieval_hits WHERE chunk_id IS NOT NULL AND text_payload IS NOT NULL AND rfc_number IS NOT NULL)
SELECT count(*) FILTER (h.query_id IS NOT NULL) AS cited, count(*) FILTER (h.query_id IS NULL) AS empty, CAST(0 AS BIGINT) AS failed FROM queries q LEFT JOIN h USING (query_id)""",
    "hybrid_rrf": f"""WITH {_VECTORS}, {_bm25('text_payload', 's', 'asked')},
near AS (SELECT q.query_id, c.chunk_id, round(list_cosine_similarity(q.v::DOUBLE[], c.v::DOUBLE[]), 7) AS score FROM asked q, c1 c),
b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s UNION ALL
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) FROM near),
f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + r)) AS v FROM b WHERE r <= 50 GROUP BY ALL),
r AS (SELECT query_id, chunk_id, round(v, 8) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY v DESC, chunk_id) AS INTEGER) AS rank FROM f) SELECT * FROM r WHERE rank <= 10""",
    "retrieve_hybrid_topk": f"""WITH {_VECTORS}, {_bm25('text_payload', 's', 'asked')},
want AS (SELECT a.query_id, top_k, doc, unnest(string_split(routes, ',')) AS table_route FROM asked a JOIN ({{routes}}) r USING (query_id)),
fit AS (SELECT w.query_id, w.table_route, top_k, c.chunk_id, c.v FROM want w JOIN c1 c ON c.table_route = w.table_route AND (doc IS NULL OR doc = c.rfc_number)),
near AS (SELECT query_id, f.table_route, f.top_k, chunk_id, round(list_cosine_similarity(q.v::DOUBLE[], f.v::DOUBLE[]), 7) AS score FROM fit f JOIN asked q USING (query_id)),
words AS (SELECT query_id, table_route, top_k, chunk_id, round(s.score, 5) AS score FROM s JOIN fit USING (query_id, chunk_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, table_route ORDER BY score DESC, chunk_id) AS r FROM words UNION ALL
  SELECT *, row_number() OVER (PARTITION BY query_id, table_route ORDER BY score DESC, chunk_id) FROM near),
f AS (SELECT query_id, table_route, any_value(top_k) AS top_k, chunk_id, sum(1.0::DOUBLE / (60 + r)) AS v FROM b WHERE r <= 5 * top_k GROUP BY query_id, table_route, chunk_id),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id, table_route ORDER BY v DESC, chunk_id) AS n FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, chunk_id) AS m FROM g WHERE n <= 5 * top_k)
SELECT query_id, chunk_id, table_route, round(v, 8) AS score, CAST(m AS INTEGER) AS rank FROM h WHERE m <= top_k""".replace("{routes}", _ROUTES),
}
