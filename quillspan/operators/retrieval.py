"""From a question to a cited context: route, search, rerank, stitch, enrich, format."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan import schemas as S
from quillspan.errors import InvalidRequest
from quillspan.functions import questions as Q
from quillspan.functions import text as X
from quillspan.operators import errata as E
from quillspan.operators import search
from quillspan.runtime import maybe_broadcast, stage

#: Candidates searched per wanted result, the default and the most results of a question.
OVERFETCH, DEFAULT_K, MOST_K = 5, 10, 50
# The shape of a chunk id that has neighbours, and the wording of a context.
NEIGHBOUR_ID = r"^(rfc\d+-sec[a-zA-Z0-9_.-]+)-blk(\d+)-chunk"
EMPTY_CONTEXT = "No relevant context found in the document database."
PREAMBLE = "The following context blocks have been retrieved. Use them to formulate your answer, and cite each by its document and path.\n\n"
SEPARATOR = "\n\n" + "-" * 65 + "\n\n"


def check_request(top_k: int, temperature: float = 0.2, question: str = "?", roles: list[str] | None = None) -> None:
    """Bounds of a request, and the roles of its messages; raises InvalidRequest."""
    if strange := set(roles or []) - set(S.CHAT_ROLES):
        raise InvalidRequest(f"unknown roles: {', '.join(sorted(strange))}")
    if not 1 <= top_k <= MOST_K or not 0 <= temperature <= 1 or not question.strip():
        raise InvalidRequest(f"top_k 1..{MOST_K}, temperature 0..1 and a question are needed")


def _asked(queries: DataFrame) -> DataFrame:
    """``query_id, table_route, doc, top_k``: the routes that each question is searched in, and the document it names."""
    q = queries.select("query_id", "top_k", Q.routes(F.col("query_text")).alias("r"), Q.named_document(F.col("query_text")).alias("doc"))
    return q.select("query_id", F.explode("r").alias("table_route"), "doc", "top_k")


def keyword_list(chunks: DataFrame, queries: DataFrame, deep: Column) -> DataFrame:
    """``query_id, table_route, item, score``: of each question and route the ``deep`` best chunks by BM25 (to five decimals) that fit the document it names."""
    number = Q.named_document(F.col("query_text"))
    return search.bm25_topk(chunks, queries, deep, group="table_route", wanted=Q.routes(F.col("query_text")), within=("rfc_number", number))


def vector_list(chunks: DataFrame, queries: DataFrame, vectors: DataFrame, asked: DataFrame, deep: Column, dim: int | None = None) -> DataFrame:
    """The same by cosine: ``vectors(chunk_id, vector)`` of the chunks, ``asked(query_id, vector)`` of the questions.

    A question meets the chunks of its routes only; one that names a document meets the chunks of that document only.
    """
    c = chunks.select("chunk_id", "rfc_number", "table_route").join(vectors, "chunk_id")
    q = _asked(queries).join(asked, "query_id")
    deepest = OVERFETCH * (queries.agg(F.max("top_k")).first()[0] or DEFAULT_K)
    of_route, of_doc = F.xxhash64("table_route"), F.xxhash64("table_route", "doc")
    named = maybe_broadcast(q.where("doc is not null").select("table_route", F.col("doc").alias("rfc_number")).distinct())
    found = [
        search.dense_topk(c.withColumn("part", of_route), q.where("doc is null").withColumn("part", of_route), deepest, "chunk_id", dim=dim, part="part"),
        search.dense_topk(
            c.join(named, ["table_route", "rfc_number"], "left_semi").withColumn("doc", F.col("rfc_number")).withColumn("part", of_doc),
            q.where("doc is not null").withColumn("part", of_doc), deepest, "chunk_id", dim=dim, part="part",
        ),
    ]
    keys = q.withColumn("part", F.when(F.col("doc").isNull(), of_route).otherwise(of_doc)).select("query_id", "part", "table_route", "top_k")
    both = found[0].unionByName(found[1]).select("query_id", "part", F.col("id").alias("item"), F.round("score", 7).alias("score"))
    return _cut(both.join(maybe_broadcast(keys), ["query_id", "part"]), deep)


def _cut(scored: DataFrame, deep: Column) -> DataFrame:
    w = Window.partitionBy("query_id", "table_route").orderBy(F.desc("score"), "item")
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= deep).select("query_id", "table_route", "item", "score")


def candidates(chunks: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, asked: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """Hits for each question: of each of its routes the OVERFETCH * top_k best, then as many over all routes.

    With vectors of chunks and questions a route is searched by BM25 and by cosine, each cut to OVERFETCH * top_k, and the
    lists are fused by reciprocal rank; a chunk that only one of them finds is a candidate. Without vectors BM25 decides.
    Ranks are taken over ids and scores; texts are joined to what is left.
    """
    deep = OVERFETCH * F.col("top_k")
    found = keyword_list(chunks, queries, deep)
    if vectors is not None:
        lists = [found, vector_list(chunks, queries, vectors, asked, deep, dim)]
        found = search.fuse_ranks(lists, OVERFETCH * MOST_K, group=["table_route"]).drop("rank")
        found = _cut(found.join(maybe_broadcast(queries.select("query_id", "top_k")), "query_id"), deep)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item")
    pool = found.join(maybe_broadcast(queries.select("query_id", "top_k")), "query_id").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= deep)
    pool = stage(pool.select("query_id", F.col("item").alias("chunk_id"), "score", "top_k"), "pool")
    texts = chunks.join(maybe_broadcast(pool.select("chunk_id").distinct()), "chunk_id", "left_semi").select("chunk_id",
        "rfc_number", "table_route", "hierarchy_path", "text_payload")
    return pool.join(texts, "chunk_id").select("query_id", "chunk_id", "rfc_number", "table_route", "hierarchy_path", "text_payload", "score", "top_k")


def rerank(hits: DataFrame, queries: DataFrame, scorer: Callable[[list[str], list[str]], list[float]] | None = None) -> DataFrame:
    """The top_k hits of each question by a pair scorer; the search score is kept as ``hybrid_score``. Without a scorer, by the search score.

    A scorer fails on a batch where it raises, gives another number of scores, or a score that isn't a finite number. A question
    of which any hit was in such a batch keeps its search scores for all hits, since the two scales can't be mixed, and its
    hits are marked in ``degraded``; the reason is logged by the worker.
    """
    h = hits.withColumns({"hybrid_score": F.col("score"), "degraded": F.lit(False)})
    if scorer is not None:

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for question, text in batches:
                try:
                    new = pd.Series(scorer(list(question), list(text)), dtype="float64")
                    if len(new) != len(text) or not np.isfinite(new).all():
                        raise ValueError(f"{len(text)} finite scores are needed")
                    yield new
                except Exception:  # noqa: BLE001  degraded, not broken
                    logging.getLogger(__name__).warning("reranking failed, search scores are kept", exc_info=True)
                    yield pd.Series([None] * len(text), dtype="float64")

        h = h.join(queries.select("query_id", F.col("query_text").alias("_q")), "query_id").withColumn("_new", run("_q", "text_payload"))
        h = h.withColumn("degraded", F.max(F.col("_new").isNull()).over(Window.partitionBy("query_id")))
        h = h.withColumn("score", F.when(F.col("degraded"), F.col("hybrid_score")).otherwise(F.col("_new"))).drop("_q", "_new")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return h.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("top_k"))


def overlap_scorer(questions: list[str], texts: list[str]) -> list[float]:
    """Stand-in for a cross-encoder: the share of the question's words that the text has."""
    out = []
    for q, t in zip(questions, texts):
        words, have = set(q.lower().split()), set(t.lower().split())
        out.append(len(words & have) / len(words) if words else 0.0)
    return out


def stitched(hits: DataFrame, chunks: DataFrame, numeric: bool = False) -> DataFrame:
    """Hits with the texts of the blocks before and after theirs, by order of chunk id (of block number if ``numeric``). Hits of other ids stay as they are.

    Neighbours are found by an equality on section and block number, not by a pattern over the table.
    """
    parts = lambda c: (F.regexp_extract(c, NEIGHBOUR_ID, 1), F.regexp_extract(c, NEIGHBOUR_ID, 2).try_cast("int"))
    prefix, blk = parts(F.col("chunk_id"))
    c = chunks.select(F.col("chunk_id").alias("_cid"), F.col("text_payload").alias("_text"), prefix.alias("_prefix"),
        blk.alias("_blk")).where("_prefix <> ''").dropDuplicates(["_cid"])
    wanted = hits.select("query_id", "chunk_id", prefix.alias("_prefix"), F.explode(F.array(blk - 1, blk + 1)).alias("_blk")).where("_prefix <> ''")
    near = c.join(maybe_broadcast(wanted), ["_prefix", "_blk"]).select("query_id", "chunk_id", "_cid", "_text")
    own = hits.select("query_id", "chunk_id", F.col("chunk_id").alias("_cid"), F.col("text_payload").alias("_text"))
    key = F.struct(F.regexp_extract("_cid", r"-blk(\d+)-", 1).try_cast("int").alias("n"), F.col("_cid").alias("c"), F.col("_text")
        .alias("t")) if numeric else F.struct(F.col("_cid").alias("c"), F.col("_text").alias("t"))
    text = near.unionByName(own).groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(key))
        .alias("x")).select("query_id", "chunk_id", F.array_join(F.transform("x", lambda z: z["t"]), "\n\n").alias("_joined"))
    return hits.join(text, ["query_id", "chunk_id"]).withColumn("text_payload", F.col("_joined")).drop("_joined")


def enriched(hits: DataFrame, warnings: DataFrame, errata: DataFrame) -> DataFrame:
    """Hits with succession warnings before and corrections after their text, and flags. Marked texts aren't marked again, so enriching twice is enriching once."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    warnings = stage(warnings, "warnings")
    base = hits.withColumns({c: F.lit(False) for c in ("has_errata", "is_obsolete", "is_updated") if c not in hits.columns})
    w = warnings.select("rfc_number", F.col("is_obsolete").alias("_o"), F.col("is_updated").alias("_u"), F.col("warning").alias("_w"))
    told = F.col("text_payload").contains("[TEMPORAL")
    j = base.join(maybe_broadcast(w), "rfc_number", "left")
    j = j.withColumn("is_obsolete", F.col("is_obsolete") | (~told & flag(F.col("_o")))).withColumn("is_updated",
        F.col("is_updated") | (~told & flag(F.col("_u"))))
    j = j.withColumn("text_payload", F.when(told | F.col("_w").isNull(), F.col("text_payload"))
        .otherwise(F.concat("_w", F.lit("\n\n"), "text_payload"))).drop("_o", "_u", "_w")
    open_ = j.where(~F.col("has_errata") & ~F.col("text_payload").contains("[IETF ERRATA"))
    keyed = open_.withColumn("_key", F.xxhash64("text_payload"))
    fixes = E.matches(keyed.select(F.col("_key").alias("chunk_id"), "rfc_number", "text_payload"), errata).withColumnRenamed("chunk_id", "_key")
    out = j.withColumn("_key", F.xxhash64("text_payload")).join(fixes, "_key", "left")
    out = out.withColumn("has_errata", F.col("has_errata") | F.col("corrections").isNotNull())
    return out.withColumn("text_payload", F.when(F.col("corrections").isNull(), F.col("text_payload"))
        .otherwise(F.concat("text_payload", F.lit("\n\n"), "corrections"))).drop("corrections", "_key")


def cited_block(rank: Column) -> Column:
    """One hit as a block with its citation header; headers within the text are defused."""
    head = F.concat(F.lit("### [SOURCE "), rank.cast("string"), F.lit(": RFC "), F.col("rfc_number").cast("string"),
        F.lit(" | Format: "), F.upper("table_route"), F.lit(" | Path: "), F.col("hierarchy_path"), F.lit("]"))
    return F.concat(head, F.lit("\n"), X.strip_spaces(F.replace("text_payload", F.lit("### [SOURCE"), F.lit("--- [SOURCE"))))


def contexts(hits: DataFrame) -> DataFrame:
    """``query_id, context``: the hits of each question by rank as one text."""
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", cited_block(F.col("rank")).alias("b")))).alias("x"))
    return rows.select("query_id", F.concat(F.lit(PREAMBLE), F.array_join(F.transform("x", lambda z: z["b"]), SEPARATOR)).alias("context"))


def retrieve(chunks: DataFrame, queries: DataFrame, warnings: DataFrame, errata: DataFrame, scorer=None, encoder: search.Encoder
    | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Contexts for a table of questions, in the order search, cap, rerank, stitch, enrich, format. Questions without a hit have the empty context.
    ``query_id, context, degraded``: whether the scorer failed on the question, whose hits then have the order of the search (:func:`rerank`).

    Search is hybrid: questions are encoded, and so are the chunks unless ``vectors(chunk_id, vector)`` are given, which
    must stem from the same encoder. Hits are staged once, since stitching and enriching read them several times.
    """
    one = stage(chunks.dropDuplicates(["chunk_id"]), "chunks")
    known = vectors if vectors is not None else stage(search.embed(one.select("chunk_id", "text_payload"), "text_payload", encoder)
        .select("chunk_id", "vector"), "vectors")
    asked = stage(search.embed(queries.select("query_id", "query_text"), "query_text", encoder, search.QUERY_PREFIX).select("query_id", "vector"), "asked")
    hits = rerank(candidates(one, queries, known, asked, encoder.dim if encoder else None), queries, scorer)
    joined = stage(stitched(stage(hits, "hits"), one), "stitched")
    made = contexts(enriched(joined, warnings, errata)).join(joined.groupBy("query_id").agg(F.max("degraded").alias("degraded")), "query_id")
    return queries.select("query_id").join(made, "query_id", "left").withColumns({"context": F.coalesce("context", F.lit(EMPTY_CONTEXT)),
        "degraded": F.coalesce("degraded", F.lit(False))})


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("CONTEXT:\n"), context, F.lit("\n\nQUESTION:\n"), question, F.lit("\n\nANSWER:"))


def sound_hits(rows: DataFrame) -> DataFrame:
    """Hits that have an id, a text and a document number that is a number; the others are dropped. A missing route or path is 'Unknown', a missing or NaN score 0."""
    good = rows.where("chunk_id is not null and text_payload is not null").withColumn("rfc_number", F.col("rfc_number")
        .try_cast("int")).where("rfc_number is not null")
    score = F.col("score").try_cast("double")
    return good.withColumns({"table_route": F.coalesce("table_route", F.lit("Unknown")),
        "hierarchy_path": F.coalesce("hierarchy_path", F.lit("Unknown")), "score": F.when(F.isnan(score), 0.0).otherwise(F.coalesce(score, F.lit(0.0)))})


REFUSAL = "I can't answer this from the documents at hand."
#: How a model is asked: its freedom, and what it must keep to.
TEMPERATURE, TOP_P = 0.2, 0.8
INSTRUCTION = (
    "Answer from the given context alone. Cite each statement by its source. Keep requirement words as they stand. "
    "Say so where the context is outdated or corrected. If the context doesn't hold the answer, say that it can't be given."
)


def answer(question: str, context: str, generate: Callable[[str], Iterator[str]]) -> Iterator[str]:
    """Streams an answer; an empty context is refused without a call, an error becomes the last piece of text."""
    if EMPTY_CONTEXT in context:
        yield REFUSAL
        return
    try:
        yield from generate(f"CONTEXT:\n{context}\n\nQUESTION:\n{question}\n\nANSWER:")
    except Exception as e:  # noqa: BLE001
        yield f"\n[error: {e}]"


def finished(text: str | None, reason: str | None = "STOP") -> str:
    """A whole answer: what a model said, or a note where it stopped early or said nothing."""
    if reason not in (None, "STOP"):
        return f"[stopped early: {reason}]"
    return text or "[the model gave no text]"


def complies(response: Column) -> Column:
    """Whether a response cites a source or refuses."""
    return response.contains("[Source ") | response.contains(REFUSAL)


def audit_contexts(contexts: DataFrame) -> DataFrame:
    """One row: contexts with a source, contexts that are empty, and contexts without either, which fail the audit."""
    cited, empty = F.col("context").contains("### [SOURCE 1:"), F.col("context") == EMPTY_CONTEXT
    return contexts.agg(F.count_if(cited).alias("cited"), F.count_if(empty).alias("empty"), F.count_if(~cited & ~empty).alias("failed"))
