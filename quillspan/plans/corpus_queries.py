"""Compilation, incremental runs and audits over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspan.operators import audit, compile as comp, incremental
from quillspan.operators.ranking import spread_positions
from quillspan.plans.text_queries import ONE_BLOCK, WS, _TOKEN, one_block, raw_blocks, sql_collapse, sql_strip
from quillspan.runtime import load, shared_root, small_enough
from quillspan.sources import readers, sinks


def index_entries(spark, d):
    """The entry of each document that counts, with its defaults."""
    raw = load(spark, d, "rfc_index").where("rfc_number > 0")
    e = raw.groupBy("rfc_number").agg(F.max_by(F.struct(*[c for c in raw.columns if c != "rfc_number"]), "entry_ord").alias("e")).select("rfc_number", "e.*")
    clean = lambda c: F.filter(F.coalesce(c, F.array().cast("array<int>")), lambda n: n > 0)
    return e.select("rfc_number", "title", "published_at", "status", "stream", "authors",
        *[clean(F.col(c)).alias(c) for c in ("obsoletes", "updates", "updated_by")])


def index_projection(spark, d):
    """Entries in the shape of the XML index, with month names, through the projection that the reader applies."""
    r = load(spark, d, "rfc_index").where("rfc_number is not null")
    names = F.array(*[F.lit(n) for n in ("January", "feb", "March", "APRIL", "may", "June", "Summer", "August", "Sept.", "Autumn", "November", "December")])
    ids = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.transform(F.col(c), lambda n: F.format_string("RFC%04d", n)).alias("doc-id")))
    raw = r.select(
        F.format_string("RFC%04d", "rfc_number").alias("doc-id"), "title", F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("author"),
        F.struct(F.try_element_at(names, F.col("published_at.month")).alias("month"), F.col("published_at.year").cast("string")
            .alias("year")).alias("date"), F.col("status").alias("current-status"), "stream",
        ids("obsoletes").alias("obsoletes"), ids("updates").alias("updates"), ids("updated_by").alias("updated-by"), F.col("entry_ord").alias("_ord"),
    )
    e = readers.project_index(raw)
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return e.select("rfc_number", "title", F.col("published_at.year").alias("year"), F.col("published_at.month").alias("month"),
        "status", "stream", F.size("authors").alias("n_authors"), listed("obsoletes"), listed("updated_by"))


def meta_left_join(spark, d):
    docs = load(spark, d, "blocks").select(F.col("rfc_id").alias("rfc_number")).unionByName(load(spark, d, "lineage_nodes").select("rfc_number")).distinct()
    return comp.with_metadata(docs, index_entries(spark, d)).select("rfc_number", "title", "status", "stream", "year", "month",
        F.size("obsoletes").alias("n_obsoletes"), F.size("updated_by").alias("n_updated_by"))


def chunk_split(spark, d):
    b = one_block(spark, d).drop("path")
    return comp.chunk_blocks(b).select("chunk_id", "table_route", F.length("text_payload").alias("chars"),
        F.md5(F.col("text_payload").cast("binary")).alias("digest"))


def chunk_statements(spark, d):
    b = one_block(spark, d).drop("path")
    return comp.chunk_blocks(b).select("chunk_id", F.explode("normative_statements").alias("s")).select("chunk_id", "s.keyword", "s.statement_text")


def chunk_metadata(spark, d):
    b = one_block(spark, d).drop("path")
    return comp.chunk_blocks(b, index_entries(spark, d)).groupBy("rfc_number", "rfc_title", "status", "rfc_year",
        "stream").agg(F.count(F.lit(1)).alias("chunks"))


def _canonical(spark, d):
    return comp.canonical_blocks(comp.with_statements(raw_blocks(spark, d)))


def canonical_tree(spark, d):
    """Sections of each document from its blocks, preface apart; one row per document."""
    blocks = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + F.size(s["blocks"]))
    return comp.section_tree(_canonical(spark, d)).select("rfc_id", F.size("sections").alias("sections"), blocks("sections")
        .alias("blocks"), F.size("preface_blocks").alias("preface_blocks"))


def canonical_order(spark, d):
    """The place of each block in its document, without any row that holds a document."""
    return comp.canonical_rows(_canonical(spark, d)).select("rfc_id", "ord", "section_no", "block_no")


def canonical_scan(spark, d):
    """Documents written as JSON and read again, back in rows."""
    path = f"{shared_root(spark)}/documents-{uuid.uuid4().hex[:8]}"
    sinks.write_documents(comp.section_tree(_canonical(spark, d)), path)
    return readers.read_canonical(spark, path).select("rfc_id", "block_id", (F.col("section_no")).alias("section_no"),
        (F.col("block_no") + 1).alias("block_no"), F.md5(F.col("normalized_text").cast("binary")).alias("digest"))


def json_descent(spark, d):
    """Blocks found at any depth of JSON documents, by type."""
    docs = comp.section_tree(_canonical(spark, d)).select(F.col("rfc_id").alias("doc_id"), F.to_json(F.struct("sections", "preface_blocks")).alias("content"))
    return readers.json_blocks(docs).groupBy("block_type").agg(F.count(F.lit(1)).alias("blocks"), F.sum("chars").alias("chars"))


def refused_chunks(spark, d):
    """Chunks that may not be stored, by reason; half of the rows are spoilt in one of four ways, told by the length of their texts."""
    h = F.pmod(F.coalesce(F.length("text_payload"), F.lit(0)), F.lit(8))
    c = load(spark, d, "chunks").select(
        F.when(h != 0, F.col("chunk_id")).alias("chunk_id"), F.when(h == 1, F.lit(-1)).otherwise(F.col("rfc_number"))
            .alias("rfc_number"), F.when(h == 2, F.lit("poetry")).otherwise(F.col("table_route")).alias("table_route"),
        F.when(h == 3, F.col("parsing_confidence") + 1.01).otherwise(F.col("parsing_confidence")).alias("parsing_confidence"),
    )
    good, bad = sinks.accepted(c)
    return bad.select("reason").unionByName(good.select(F.lit("accepted").alias("reason"))).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def term_statistics(spark, d):
    path = f"{shared_root(spark)}/terms-{uuid.uuid4().hex[:8]}"
    sinks.term_statistics(load(spark, d, "chunks").select("chunk_id", "table_route", "text_payload").distinct(), path)
    return spark.read.parquet(f"{path}/terms").select(F.col("table_route").cast("string").alias("table_route"), "term", "df")


def parse_txt_documents(spark, d):
    """Texts of the documents table through the plain-text parser and the whole compilation."""
    docs = load(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("int").alias("doc_id"), F.lit("txt")
        .alias("source_type"), F.col("text").alias("content"))
    blocks = comp.canonical_blocks(comp.with_statements(readers.parse_documents(docs).where("error is null")))
    return blocks.groupBy("rfc_id").agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("section_id", "title").alias("sections"),
        F.sum(F.size("normative_statements")).alias("statements"))


def parse_xml_documents(spark, d):
    """Each block as an XML document of its own, in the element of its type, through the XML parser: texts, lists, tables, source code, figures and references."""
    esc = F.replace(F.replace(F.regexp_replace("normalized_text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    b = one_block(spark, d).where("normalized_text is not null").withColumn("x", F.regexp_replace(esc, "\r\n?", "\n"))
    lines = lambda fmt: F.array_join(F.transform(F.split("x", "\n"), lambda line: F.format_string(fmt, line)), "")
    element = (
        F.when(F.col("block_type") == "list", F.concat(F.lit("<ul anchor='"), "block_id", F.lit("'>"), lines("<li>%s</li>"), F.lit("</ul>")))
        .when(F.col("block_type") == "table", F.concat(F.lit("<table anchor='"), "block_id", F.lit("'><tbody>"),
            lines("<tr><td>%s</td><td>1</td></tr>"), F.lit("</tbody></table>")))
        .when(F.col("block_type") == "abnf", F.concat(F.lit("<sourcecode type='abnf' anchor='"), "block_id", F.lit("'>"), "x", F.lit("</sourcecode>")))
        .when(F.col("block_type") == "sourcecode", F.concat(F.lit("<sourcecode anchor='"), "block_id", F.lit("'>"), "x", F.lit("</sourcecode>")))
        .when(F.col("block_type") == "artwork", F.concat(F.lit("<figure><name>Fig</name><artwork anchor='"), "block_id",
            F.lit("'>"), "x", F.lit("</artwork></figure>")))
        .when(F.col("block_type") == "references", F.concat(F.lit("<reference anchor='"), "block_id", F.lit("'><front><title>"),
            "x", F.lit("</title></front></reference>")))
        .otherwise(F.concat(F.lit("<t anchor='"), "block_id", F.lit("'>"), "x", F.lit("</t>")))
    )
    name = F.when(F.col("block_type") == "security", "Security Considerations").otherwise("Body")
    content = F.when(F.col("block_type") == "references", F.concat(F.lit("<rfc><back><references><name>Sources</name>"), element,
        F.lit("</references></back></rfc>"))).otherwise(
        F.concat(F.lit("<rfc><middle><section><name>"), name, F.lit("</name>"), element, F.lit("</section></middle></rfc>"))
    )
    docs = b.select(F.col("rfc_id").alias("doc_id"), F.lit("xml").alias("source_type"), content.alias("content"))
    out = readers.parse_documents(docs)
    return out.select(F.coalesce("element_id", "reference.anchor").alias("block_id"), "block_type", F.col("error").isNotNull()
        .alias("failed"), F.md5(F.col("normalized_text").cast("binary")).alias("digest"))


# incremental


def existing_ids_union(spark, d):
    return load(spark, d, "chunks").select("chunk_id").unionByName(load(spark, d, "lance_chunks").select("chunk_id")).distinct()


def incremental_anti_append(spark, d):
    feed = load(spark, d, "chunks").select("chunk_id", "table_route", "text_payload")
    return incremental.new_rows(feed, load(spark, d, "lance_chunks")).select("chunk_id", "table_route")


def route_semi(spark, d):
    have = load(spark, d, "lance_chunks").select("table_route").distinct()
    return load(spark, d, "chunks").join(have, "table_route", "left_semi").groupBy("table_route").agg(F.count(F.lit(1)).alias("rows"))


def routed_scan(spark, d):
    """Chunks stored by route, and two routes read back; only their folders are scanned."""
    path = f"{shared_root(spark)}/routed-{uuid.uuid4().hex[:8]}"
    sinks.write_routed(load(spark, d, "chunks").select("chunk_id", "table_route", "text_payload").distinct(), path, "overwrite")
    return spark.read.parquet(path).where(F.col("table_route").isin("abnf", "security")).select("chunk_id", F.col("table_route")
        .cast("string").alias("table_route"), F.length("text_payload").alias("chars"))


def _sources(spark, d):
    c = load(spark, d, "chunks").select(F.col("rfc_number").alias("doc_id"), F.when(F.col("parsing_confidence") == 1.0, "xml")
        .otherwise("txt").alias("source_type")).distinct()
    return c


def xml_over_txt(spark, d):
    return readers.prefer_xml(_sources(spark, d))


def _state(spark, d):
    n = load(spark, d, "lineage_nodes").select(F.col("rfc_number").alias("doc_id"), "title", "status",
        F.when(F.size("obsoletes") > 0, "txt").otherwise("xml").alias("source_type"))
    return incremental.document_state(n)


def existing_state(spark, d):
    return _state(spark, d).distinct()


def delta_queue(spark, d):
    s = _sources(spark, d)
    return incremental.delta_queue(s.where("source_type = 'xml'"), s.where("source_type = 'txt'"), _state(spark, d))


def incremental_run(spark, d):
    """Two runs over the documents: first those of a known source as text, then all, of which the German ones come as XML by now, and once more the same. What is stored in the end."""
    out = f"{shared_root(spark)}/corpus-{uuid.uuid4().hex[:8]}"
    t = load(spark, d, "documents").where("text is not null")
    text = t.select(F.col("doc_id").cast("int").alias("doc_id"), F.lit("txt").alias("source_type"), F.col("text").alias("content"), "source")
    esc = F.regexp_replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    xml = t.where("lang = 'de'").select(F.col("doc_id").cast("int").alias("doc_id"), F.lit("xml").alias("source_type"),
        F.concat(F.lit("<rfc><middle><section><name>Text</name><t>"), esc, F.lit("</t></section></middle></rfc>")).alias("content"))
    meta = index_entries(spark, d)
    incremental.run(spark, text.where("source is not null").drop("source"), meta, out)
    incremental.run(spark, text.drop("source").unionByName(xml), meta, out)
    again = incremental.run(spark, text.drop("source").unionByName(xml), meta, out)
    assert small_enough(again, 0)
    told = spark.read.parquet(f"{out}/telemetry")
    types = spark.read.parquet(f"{out}/blocks").groupBy(F.col("rfc_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("stored"))
    return told.join(types, "doc_id", "left").select("doc_id", "source_type", "status",
        (F.coalesce("stored", F.lit(0)) == F.col("total_blocks")).alias("complete"))


def telemetry_patch(spark, d):
    cols = ["rfc_id", "total_blocks", "total_chars"]
    old = audit.document_telemetry(one_block(spark, d)).select(*cols)
    c = load(spark, d, "lance_chunks").dropDuplicates(["chunk_id"]).select(F.col("rfc_number").alias("rfc_id"),
        F.col("text_payload").alias("normalized_text"), F.lit(None).cast("array<int>").alias("normative_statements"))
    return incremental.patched(old, audit.document_telemetry(c).select(*cols), "rfc_id")


# audits


def telemetry_doc(spark, d):
    return audit.document_telemetry(one_block(spark, d))


def _telemetry(spark, d):
    kind = F.when(F.col("rfc_id") >= 8650, ".xml").otherwise(".txt")
    t = audit.document_telemetry(one_block(spark, d))
    return t.withColumn("status", F.when(F.col("total_chars") > 0, "success").otherwise("failed")).withColumn("file",
        F.concat(F.lit("rfc"), F.col("rfc_id"), kind))


def corpus_manifest(spark, d):
    return audit.corpus_totals(_telemetry(spark, d))


def telemetry_report(spark, d):
    return audit.telemetry_report(_telemetry(spark, d)).withColumn("mean_block_chars", F.round("mean_block_chars", 4))


def top_documents(spark, d):
    return _telemetry(spark, d).select("rfc_id", "normative_rules").orderBy(F.desc("normative_rules"), "rfc_id").limit(5)


def length_dist_p95(spark, d):
    return audit.length_distribution(one_block(spark, d), "block_type", "normalized_text")


def length_buckets(spark, d):
    return audit.length_histogram(load(spark, d, "chunks")).withColumn("percent", F.round("percent", 6))


def boundary_anomalies(spark, d):
    return audit.boundary_anomalies(load(spark, d, "chunks"))


def mass_conservation(spark, d):
    b = one_block(spark, d)
    return audit.conservation(b, load(spark, d, "chunks").dropDuplicates(["chunk_id"])).withColumn("ratio", F.round("ratio", 6))


def conservation_counts(spark, d):
    return mass_conservation(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("documents"))


def table_counts(spark, d):
    return audit.route_counts(load(spark, d, "chunks"))


def length_outliers(spark, d):
    big, _ = audit.outliers(one_block(spark, d), "normalized_text")
    return big.select("block_id", "block_type", F.length("normalized_text").alias("chars"))


def outlier_share(spark, d):
    over = F.length("normalized_text") > 2000
    return one_block(spark, d).groupBy("block_type").agg(F.count_if(over).alias("over"), F.round(100 * F.avg(over.cast("int")), 6).alias("percent"))


def batch_parity(spark, d):
    """Batches of 32 by falling length, dealt to two workers; the numbering runs over range partitions, not in one task."""
    c = load(spark, d, "chunks").select("chunk_id", F.coalesce(F.length("text_payload"), F.lit(0)).alias("chars")).distinct().withColumn("g", F.lit(1))
    n = spread_positions(c, ["g"], [F.col("chars").desc(), F.col("chunk_id").asc()], "n")
    return n.select("chunk_id", F.pmod(F.floor((F.col("n") - 1) / 32), F.lit(2)).cast("int").alias("worker"))


def stream_append(spark, d):
    """End state of a streaming append: what is there, a feed of all chunks in JSON lines, and the feed once more."""
    from quillspan import schemas as S
    from quillspan.sources.sinks import write_routed
    from quillspan.streaming.ingest import append_feed

    base = f"{shared_root(spark)}/stream-{uuid.uuid4().hex[:8]}"
    cols = [c.split()[0] for c in S.CHUNK.replace("array<struct<keyword:string, statement_text:string>>", "x").split(", ")]
    chunks = load(spark, d, "chunks").select(*cols)
    have = load(spark, d, "lance_chunks").select("chunk_id", "table_route", "text_payload")
    write_routed(incremental.new_rows(chunks, chunks.join(have, "chunk_id", "left_anti").select("chunk_id")), f"{base}/table")
    for n in (1, 2):
        chunks.write.mode("append").json(f"{base}/feed")
        append_feed(spark, f"{base}/feed", f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/table").select("chunk_id", "table_route")


QUERIES = {
    f.__name__: f
    for f in (
        index_projection, meta_left_join, chunk_split, chunk_statements, chunk_metadata, canonical_tree, canonical_order,
            canonical_scan, json_descent, refused_chunks, term_statistics, incremental_run, parse_txt_documents,
                parse_xml_documents, existing_ids_union, incremental_anti_append, route_semi, routed_scan, xml_over_txt, existing_state, delta_queue,
        telemetry_patch, telemetry_doc, corpus_manifest, telemetry_report, top_documents, length_dist_p95, length_buckets,
            boundary_anomalies, mass_conservation, conservation_counts, table_counts, length_outliers, outlier_share, batch_parity, stream_append,
    )
}

_ENTRY = "entry AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rfc_number ORDER BY entry_ord DESC) AS rn FROM rfc_index WHERE rfc_number > 0) WHERE rn = 1)"
_META = """coalesce(title, 'RFC ' || n) AS title, coalesce(status, 'UNKNOWN') AS status, CASE WHEN rfc_number IS NULL THEN 'IETF' ELSE coalesce(stream, 'UNKNOWN') END AS stream"""


def _last(ch: str) -> str:
    """0-based place of the last ``ch`` in the final stretch, -1 if there is none."""
    return f"length(w) - length(string_split(w, {ch})[-1]) - 1"


_WALK = f"""{ONE_BLOCK},
walk AS (
  SELECT block_id, rfc_id, block_type, normative_statements, normalized_text AS x, 0 AS i, 0 AS s,
    CASE WHEN length(normalized_text) <= 2000 THEN length(normalized_text) ELSE 1751 + (SELECT CASE WHEN contains(w, chr(10)) THEN {_last('chr(10)')} WHEN contains(w, ' ') THEN {_last("' '")} ELSE 249 END FROM (SELECT substr(normalized_text, 1751, 250) AS w)) END AS e
  FROM one_block WHERE length(regexp_replace(normalized_text, '\\s+', '', 'g')) > 0
  UNION ALL
  SELECT block_id, rfc_id, block_type, normative_statements, x, i + 1, e - 250,
    CASE WHEN length(x) - (e - 250) <= 2000 THEN length(x) ELSE e - 250 + 1751 + (SELECT CASE WHEN contains(w, chr(10)) THEN {_last('chr(10)')} WHEN contains(w, ' ') THEN {_last("' '")} ELSE 249 END FROM (SELECT substr(x, e - 250 + 1751, 250) AS w)) END
  FROM walk WHERE e < length(x)),
pieces AS (SELECT *, block_id || '-chunk' || lpad(CAST(i AS VARCHAR), 3, '0') AS chunk_id, substr(x, s + 1, e - s) AS piece FROM walk)"""
_ROUTE = "CASE WHEN block_type IN ('abnf', 'artwork', 'references', 'security', 'sourcecode', 'table') THEN block_type ELSE 'prose' END"
_TELE = f"""{ONE_BLOCK},
tele AS (SELECT rfc_id, CAST(count(*) AS INTEGER) AS total_blocks, CAST(sum(coalesce(len(normative_statements), 0)) AS INTEGER) AS normative_rules, CAST(sum(length(coalesce(normalized_text, ''))) AS INTEGER) AS total_chars,
  CAST(max(length(coalesce(normalized_text, ''))) AS INTEGER) AS max_block_chars, CAST(min(length(coalesce(normalized_text, ''))) AS INTEGER) AS min_block_chars FROM one_block GROUP BY rfc_id)"""
_ONE_CHUNK = "one_chunk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id) AS rn FROM chunks) WHERE rn = 1)"
_SRC = "src AS (SELECT DISTINCT rfc_number AS doc_id, CASE WHEN parsing_confidence = 1.0 THEN 'xml' ELSE 'txt' END AS source_type FROM chunks)"
_STATE = "st AS (SELECT DISTINCT rfc_number AS doc_id, CASE WHEN len(obsoletes) > 0 THEN 'txt' ELSE 'xml' END AS source_type FROM lineage_nodes WHERE NOT coalesce(status = 'UNKNOWN' AND title = 'RFC ' || rfc_number, false))"
_MASS = f"""{ONE_BLOCK}, {_ONE_CHUNK},
a AS (SELECT rfc_id, sum(length(normalized_text)) AS s FROM one_block WHERE length(regexp_replace(normalized_text, '\\s+', '', 'g')) > 0 GROUP BY rfc_id),
b AS (SELECT rfc_number, sum(length(text_payload)) AS c FROM one_chunk GROUP BY rfc_number),
mass AS (SELECT rfc_id, CAST(s AS BIGINT) AS source_chars, CAST(coalesce(c, 0) AS BIGINT) AS chunk_chars, coalesce(c, 0) / s AS r FROM a LEFT JOIN b ON rfc_number = rfc_id),
judged AS (SELECT rfc_id, source_chars, chunk_chars, round(r, 6) AS ratio, CASE WHEN r = 0 THEN 'FATAL' WHEN r < 1 THEN 'ERROR' WHEN r > 1.2 THEN 'WARN' ELSE 'OK' END AS verdict FROM mass)"""
_BUCKET = "CASE " + " ".join(f"WHEN length(text_payload) < {m} THEN '{n}'" for m, n in audit.BUCKETS[:-1]) + f" ELSE '{audit.BUCKETS[-1][1]}' END"

_CANON = f"""{ONE_BLOCK}, {_TOKEN},
canon AS (SELECT *, 'rfc' || rfc_id || '-' || token || '-blk' || row_number() OVER (PARTITION BY rfc_id, token ORDER BY ord) AS new_id FROM named WHERE length({sql_strip("coalesce(normalized_text, '')")}) > 0),
firsts AS (SELECT rfc_id, pre, sid, ttl, path, min(ord) AS f FROM canon GROUP BY ALL),
secs AS (SELECT *, CASE WHEN pre THEN 0 ELSE row_number() OVER (PARTITION BY rfc_id, pre ORDER BY f) END AS section_no FROM firsts),
numbered AS (SELECT c.*, section_no, row_number() OVER (PARTITION BY rfc_id, section_no ORDER BY ord) AS block_no FROM canon c JOIN secs USING (rfc_id, pre, sid, ttl, path))"""

ORACLE = {
    "index_projection": f"""WITH {_ENTRY}, m AS (SELECT *, list_filter(obsoletes, lambda x: x > 0) AS o, list_filter(updated_by, lambda x: x > 0) AS u FROM entry)
SELECT rfc_number, coalesce(title, 'Unknown Title') AS title, published_at.year AS year, CASE WHEN published_at.year IS NOT NULL THEN CASE published_at.month WHEN 7 THEN 7 WHEN 10 THEN 10 ELSE published_at.month END END AS month,
coalesce(status, 'UNKNOWN') AS status, coalesce(stream, 'UNKNOWN') AS stream, CAST(coalesce(len(authors), 0) AS INTEGER) AS n_authors, coalesce(array_to_string(o, ','), '') AS obsoletes, coalesce(array_to_string(u, ','), '') AS updated_by FROM m""",
    "meta_left_join": f"""WITH {_ENTRY}, docs AS (SELECT rfc_id AS n FROM blocks UNION SELECT rfc_number FROM lineage_nodes)
SELECT n AS rfc_number, {_META}, published_at.year AS year, published_at.month AS month, CAST(coalesce(len(list_filter(obsoletes, lambda x: x > 0)), 0) AS INTEGER) AS n_obsoletes, CAST(coalesce(len(list_filter(updated_by, lambda x: x > 0)), 0) AS INTEGER) AS n_updated_by
FROM docs LEFT JOIN entry ON rfc_number = n""",
    "chunk_split": f"WITH RECURSIVE {_WALK} SELECT chunk_id, {_ROUTE} AS table_route, CAST(length(piece) AS INTEGER) AS chars, md5(piece) AS digest FROM pieces",
    "chunk_statements": f"WITH RECURSIVE {_WALK} SELECT chunk_id, st.keyword AS keyword, st.statement_text AS statement_text FROM (SELECT chunk_id, piece, unnest(normative_statements) AS st FROM pieces) WHERE contains(piece, st.statement_text)",
    "chunk_metadata": f"""WITH RECURSIVE {_WALK}, {_ENTRY}, m AS (SELECT rfc_id AS n, * FROM pieces LEFT JOIN entry ON rfc_number = rfc_id)
SELECT n AS rfc_number, coalesce(title, 'RFC ' || n) AS rfc_title, coalesce(status, 'UNKNOWN') AS status, published_at.year AS rfc_year, CASE WHEN rfc_number IS NULL THEN 'IETF' ELSE coalesce(stream, 'UNKNOWN') END AS stream, count(*) AS chunks FROM m GROUP BY ALL""",
    "canonical_tree": f"WITH {_CANON} SELECT rfc_id, CAST(count(DISTINCT (sid, ttl, path)) FILTER (NOT pre) AS INTEGER) AS sections, CAST(count(*) FILTER (NOT pre) AS INTEGER) AS blocks, CAST(count(*) FILTER (pre) AS INTEGER) AS preface_blocks FROM canon GROUP BY rfc_id",
    "canonical_order": f"WITH {_CANON} SELECT rfc_id, ord, section_no, block_no FROM numbered",
    "canonical_scan": f"WITH {_CANON} SELECT rfc_id, new_id AS block_id, CAST(section_no AS INTEGER) AS section_no, CAST(block_no AS INTEGER) AS block_no, md5(normalized_text) AS digest FROM numbered",
    "json_descent": f"WITH {_CANON} SELECT block_type, count(*) AS blocks, CAST(sum(length(normalized_text)) AS BIGINT) AS chars FROM canon GROUP BY block_type",
    "term_statistics": "WITH c AS (SELECT DISTINCT chunk_id, table_route, text_payload FROM chunks), t AS (SELECT table_route, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text_payload), '[^a-z0-9]+'), lambda x: length(x) > 0))) AS term FROM c) SELECT table_route, term, count(*) AS df FROM t GROUP BY ALL",
    "incremental_run": "SELECT CAST(doc_id AS INTEGER) AS doc_id, CASE WHEN lang = 'de' THEN 'xml' ELSE 'txt' END AS source_type, 'success' AS status, true AS complete FROM documents WHERE text IS NOT NULL",
    "parse_xml_documents": f"""WITH {ONE_BLOCK}, b AS (SELECT block_id, block_type, regexp_replace(regexp_replace(normalized_text, '[\\x{{00}}-\\x{{08}}\\x{{0b}}\\x{{0c}}\\x{{0e}}-\\x{{1f}}]', '', 'g'), '\\r\\n?', chr(10), 'g') AS x FROM one_block WHERE normalized_text IS NOT NULL),
l AS (SELECT *, string_split(x, chr(10)) AS ls FROM b)
SELECT block_id, CASE WHEN block_type = 'paragraph' THEN 'prose' ELSE block_type END AS block_type, false AS failed, md5(CASE
  WHEN block_type = 'list' THEN array_to_string(list_transform(list_filter(ls, lambda y: length({sql_strip('y')}) > 0), lambda y: '* ' || {sql_collapse('y')}), chr(10))
  WHEN block_type = 'table' THEN array_to_string(list_transform(ls, lambda y: '| ' || {sql_collapse('y')} || ' | 1 |'), chr(10))
  WHEN block_type IN ('abnf', 'sourcecode') THEN regexp_replace(x, '^\\n+|\\n+$', '', 'g')
  WHEN block_type = 'artwork' THEN '[Fig]' || chr(10) || regexp_replace(x, '^\\n+|\\n+$', '', 'g')
  WHEN block_type = 'references' THEN 'Citations Target [' || block_id || ']: ' || CASE WHEN {sql_collapse('x')} = '' THEN 'Untitled' ELSE {sql_collapse('x')} END || ' by Unknown Authors.'
  ELSE {sql_collapse('x')} END) AS digest FROM l""",
    "existing_ids_union": "SELECT chunk_id FROM chunks UNION SELECT chunk_id FROM lance_chunks",
    "incremental_anti_append": "SELECT chunk_id, min(table_route) AS table_route FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM lance_chunks WHERE chunk_id IS NOT NULL) GROUP BY chunk_id",
    "refused_chunks": """WITH h AS (SELECT coalesce(length(text_payload), 0) % 8 AS h, * FROM chunks),
c AS (SELECT CASE WHEN h <> 0 THEN chunk_id END AS i, CASE WHEN h = 1 THEN -1 ELSE rfc_number END AS n, CASE WHEN h = 2 THEN 'poetry' ELSE table_route END AS r,
  CASE WHEN h = 3 THEN parsing_confidence + 1.01 ELSE parsing_confidence END AS p FROM h)
SELECT CASE WHEN i IS NULL THEN 'no id' WHEN n IS NULL OR n <= 0 THEN 'no document'
  WHEN NOT coalesce(r IN ('abnf', 'artwork', 'prose', 'references', 'security', 'sourcecode', 'table'), false) THEN 'unknown route'
  WHEN p IS NOT NULL AND (isnan(p) OR p NOT BETWEEN 0 AND 1) THEN 'confidence' ELSE 'accepted' END AS reason, count(*) AS rows FROM c GROUP BY 1""",
    "routed_scan": "SELECT DISTINCT chunk_id, table_route, CAST(length(text_payload) AS INTEGER) AS chars FROM chunks WHERE table_route IN ('abnf', 'security')",
    "route_semi": "SELECT table_route, count(*) AS rows FROM chunks WHERE table_route IN (SELECT table_route FROM lance_chunks) GROUP BY table_route",
    "xml_over_txt": f"WITH {_SRC} SELECT doc_id, max(source_type) AS source_type FROM src GROUP BY doc_id",
    "existing_state": f"WITH {_STATE} SELECT doc_id, source_type FROM st",
    "delta_queue": f"""WITH {_SRC}, {_STATE}, s AS (SELECT doc_id, min(source_type) AS have FROM st GROUP BY doc_id), x AS (SELECT doc_id FROM src LEFT JOIN s USING (doc_id) WHERE source_type = 'xml' AND (have IS NULL OR have = 'txt'))
SELECT doc_id, 'xml' AS source_type FROM x UNION ALL SELECT doc_id, 'txt' FROM src WHERE source_type = 'txt' AND doc_id NOT IN (SELECT doc_id FROM s) AND doc_id NOT IN (SELECT doc_id FROM x)""",
    "telemetry_patch": f"""WITH {_TELE}, n AS (SELECT rfc_number AS rfc_id, CAST(count(*) AS INTEGER) AS total_blocks, CAST(sum(length(coalesce(text_payload, ''))) AS INTEGER) AS total_chars FROM (SELECT DISTINCT chunk_id, rfc_number, text_payload FROM lance_chunks) GROUP BY rfc_number)
SELECT rfc_id, total_blocks, total_chars FROM tele WHERE rfc_id NOT IN (SELECT rfc_id FROM n) UNION ALL SELECT * FROM n""",
    "telemetry_doc": f"WITH {_TELE} SELECT * FROM tele",
    "corpus_manifest": f"""WITH {_TELE} SELECT count(*) FILTER (total_chars > 0) AS documents, CAST(sum(total_blocks) FILTER (total_chars > 0) AS BIGINT) AS blocks, CAST(sum(normative_rules) FILTER (total_chars > 0) AS BIGINT) AS rules,
count(*) FILTER (total_chars > 0 AND rfc_id < 8650) AS txt_documents, count(*) FILTER (total_chars > 0 AND rfc_id >= 8650) AS xml_documents FROM tele""",
    "telemetry_report": f"""WITH {_TELE} SELECT count(*) AS documents, CAST(sum(total_blocks) AS BIGINT) AS blocks, CAST(sum(normative_rules) AS BIGINT) AS rules, CAST(sum(normative_rules) // count(*) AS BIGINT) AS rules_per_document, round(sum(total_chars) / sum(total_blocks), 4) AS mean_block_chars,
(SELECT rfc_id FROM tele ORDER BY max_block_chars DESC, rfc_id DESC LIMIT 1) AS longest_in, (SELECT rfc_id FROM tele WHERE min_block_chars > 0 ORDER BY min_block_chars, rfc_id LIMIT 1) AS shortest_in FROM tele""",
    "top_documents": f"WITH {_TELE} SELECT rfc_id, normative_rules FROM tele ORDER BY normative_rules DESC, rfc_id LIMIT 5",
    "length_dist_p95": f"""WITH {ONE_BLOCK}, l AS (SELECT block_type AS kind, length(normalized_text) AS c, row_number() OVER (PARTITION BY block_type ORDER BY length(normalized_text)) AS i, count(*) OVER (PARTITION BY block_type) AS n FROM one_block WHERE normalized_text IS NOT NULL),
j AS (SELECT *, greatest(1, least(95 * (n + 1) // 100, n - 1)) AS j FROM l)
SELECT kind, count(*) AS blocks, CAST(floor(median(c)) AS BIGINT) AS median_chars, CAST(max(c) AS INTEGER) AS max_chars,
  CAST(CASE WHEN any_value(n) = 1 THEN max(c) ELSE trunc((max(c) FILTER (i = j) * (100 - (95 * (any_value(n) + 1) - 100 * any_value(j))) + max(c) FILTER (i = j + 1) * (95 * (any_value(n) + 1) - 100 * any_value(j))) / 100) END AS BIGINT) AS p95_chars FROM j GROUP BY kind""",
    "length_buckets": f"""WITH c AS (SELECT {_BUCKET} AS bucket, count(*) AS c FROM chunks GROUP BY 1), b AS (SELECT unnest({[n for _, n in audit.BUCKETS]!r}) AS bucket)
SELECT bucket, coalesce(c, 0) AS chunks, round(100 * coalesce(c, 0) / (SELECT sum(c) FROM c), 6) AS percent FROM b LEFT JOIN c USING (bucket)""",
    "boundary_anomalies": "SELECT DISTINCT chunk_id, CAST(length(text_payload) AS INTEGER) AS chars, CASE WHEN length(text_payload) > 2000 THEN 'FATAL' ELSE 'WARN' END AS severity FROM chunks WHERE length(text_payload) > 2000 OR length(text_payload) < 12",
    "mass_conservation": f"WITH {_MASS} SELECT * FROM judged",
    "conservation_counts": f"WITH {_MASS} SELECT verdict, count(*) AS documents FROM judged GROUP BY verdict",
    "table_counts": "SELECT coalesce(table_route, 'TOTAL') AS table_route, count(*) AS rows FROM chunks GROUP BY ROLLUP (table_route)",
    "length_outliers": f"WITH {ONE_BLOCK} SELECT block_id, block_type, CAST(length(normalized_text) AS INTEGER) AS chars FROM one_block WHERE length(normalized_text) > 2000",
    "outlier_share": f"WITH {ONE_BLOCK} SELECT block_type, count(*) FILTER (length(normalized_text) > 2000) AS over, round(100 * avg(CAST(length(normalized_text) > 2000 AS INTEGER)), 6) AS percent FROM one_block GROUP BY block_type",
    "batch_parity": "SELECT chunk_id, CAST((row_number() OVER (ORDER BY chars DESC, chunk_id) - 1) // 32 % 2 AS INTEGER) AS worker FROM (SELECT DISTINCT chunk_id, coalesce(length(text_payload), 0) AS chars FROM chunks)",
    "stream_append": "SELECT chunk_id, min(table_route) AS table_route FROM chunks GROUP BY chunk_id",
}
