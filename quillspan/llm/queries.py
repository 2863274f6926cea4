"""Registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm import knn, leakage, mixing, near_dup, quality, rank_fusion, shared_spans, split
from quillspan.runtime import load, stage

TEXT_LIMIT, TEXT_OVERLAP, PATH_LIMIT = 2000, 250, 256


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = knn.nearest_vectors(load(spark, d, "lance_chunks"), "chunk_id", "vector", k=10, dim=256, min_cosine=0.8)
    return near.select(F.least("item", "neighbor").alias("chunk_id_a"), F.greatest("item", "neighbor").alias("chunk_id_b")).distinct()


def p1_neighbors(spark: SparkSession, d: str) -> DataFrame:
    near = knn.nearest_vectors(load(spark, d, "lance_chunks"), "chunk_id", "vector", k=10, dim=256)
    return near.select(F.col("item").alias("chunk_id"), F.col("neighbor").alias("neighbor_id"), F.round("cosine", 4)
        .alias("cosine"), F.col("rank").cast("int").alias("rank"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    c, b = load(spark, d, "chunks"), load(spark, d, "blocks")
    items = c.select(F.lit("chunk_text").alias("field"), F.col("chunk_id").alias("record_id"), F.col("text_payload").alias("body"), "hierarchy_path")
    items = items.unionByName(c.select(F.lit("chunk_path").alias("field"), F.col("chunk_id").alias("record_id"),
        F.col("hierarchy_path").alias("body"), "hierarchy_path"))
    items = items.unionByName(b.select(F.lit("block_text").alias("field"), F.col("block_id").alias("record_id"),
        F.col("normalized_text").alias("body"), F.array_join("hierarchy_path", " > ").alias("hierarchy_path")))
    return split.split_oversized(items, {"chunk_text": (TEXT_LIMIT, TEXT_OVERLAP), "block_text": (TEXT_LIMIT, TEXT_OVERLAP), "chunk_path": (PATH_LIMIT, 0)})


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p3_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each item say together: their text without overlaps, whether each is within the limit, and whether overlaps are."""
    p = _pieces(spark, d)
    w = Window.partitionBy("field", "record_id").orderBy("piece_no")
    p = p.withColumn("_before", F.coalesce(F.lag("stop").over(w), F.lit(0)))
    most = F.when(F.col("field").endswith("path"), PATH_LIMIT).otherwise(TEXT_LIMIT)
    lap = F.when(F.col("field").endswith("path"), 0).otherwise(TEXT_OVERLAP)
    fresh = F.substr("piece", (F.col("_before") - F.col("start") + 1).cast("int"))
    ok = (F.length("piece") <= most) & (F.col("stop") > F.col("_before")) & (F.col("start") <= F.col("_before")) & (F.col("_before") - F.col("start") <= lap)
    ok = ok & (F.length("piece") == F.col("stop") - F.col("start"))
    out = p.select("field", "record_id", "n_pieces", ok.alias("ok"), F.struct("piece_no", fresh.alias("t")).alias("x"))
    out = out.groupBy("field", "record_id").agg(F.min("ok").alias("ok"), (F.count(F.lit(1)) == F.max("n_pieces")).alias("all"),
        F.array_sort(F.collect_list("x")).alias("x"))
    text = F.array_join(F.transform("x", lambda z: z["t"]), "")
    return out.select("field", "record_id", F.md5(text.cast("binary")).alias("digest"), (F.col("ok") & F.col("all")).alias("in_bounds"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 0").select("field", "record_id", "unbreakable")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.fuse_scores(load(spark, d, "retrieval_hits"), ["query_id"], "chunk_id", ["score", "hybrid_score"])


def p4_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Three scores of unequal weight: the two search scores, and the flags of a hit as a third."""
    flags = sum((F.when(F.col(c), -1).otherwise(0) for c in ("has_errata", "is_obsolete", "is_updated")), F.lit(0))
    hits = load(spark, d, "retrieval_hits").withColumn("standing", flags)
    fused = rank_fusion.fuse_scores(hits, ["query_id"], "chunk_id", ["score", "hybrid_score", "standing"], {"score": 3, "hybrid_score": 2, "standing": 1})
    return fused.select("query_id", "chunk_id", "median_rank", F.round("mean_rank", 6).alias("mean_rank"), "position")


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "chunk_id", "median_rank", "position")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).where("position <= 3").select("query_id", "chunk_id")


def _near(spark: SparkSession, d: str) -> near_dup.NearDuplicates:
    return near_dup.NearDuplicates(load(spark, d, "chunks"), "chunk_id", "text_payload", threshold=0.8, min_words=20)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs().select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups().select(F.col("item").alias("chunk_id"), "group_id", "links")


def _spans(spark: SparkSession, d: str) -> shared_spans.SharedSpans:
    c = load(spark, d, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("record_id"), F.col("text_payload").alias("body"))
    b = load(spark, d, "blocks").select(F.lit("block").alias("kind"), F.col("block_id").alias("record_id"), F.col("source_fragment").alias("body"))
    return shared_spans.SharedSpans(c.unionByName(b), span=300)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).coverage().select(F.col("kind").alias("record_kind"), "record_id")


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where in each record the shared passages are."""
    return _spans(spark, d).spans().select(F.col("kind").alias("record_kind"), "record_id", "start", "stop")


def p6_passages(spark: SparkSession, d: str) -> DataFrame:
    """Fuzzy passages of two records, by chains."""
    return _spans(spark, d).passages().withColumnRenamed("kind", "record_kind").withColumn("identity", F.round("identity", 4))


def p6_shared(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).coverage().select(F.col("kind").alias("record_kind"), "record_id", "n_chars", "shared_chars",
        F.round("shared_share", 6).alias("shared_share"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.find_leaks(load(spark, d, "documents"), load(spark, d, "eval_items"), "doc_id", "text", "item_id", "text", shared=80)
    return found.select("doc_id", "item_id")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = mixing.known_sources(load(spark, d, "documents").select("doc_id", "source", "text"))
    return mixing.count_tokens(docs, "text", ["doc_id", "source"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.mix_plan(_tokens(spark, d), load(spark, d, "mix_targets"))
    return plan.where("below_target").select("source")


def p8_plan_chars(spark: SparkSession, d: str) -> DataFrame:
    """The mix with sizes in characters instead of tokens."""
    docs = mixing.known_sources(load(spark, d, "documents").select("doc_id", "source", F.coalesce("n_chars", F.lit(0)).alias("n_tokens")))
    plan = mixing.mix_plan(docs, load(spark, d, "mix_targets"))
    return plan.select("source", "have_tokens", F.round("mix_tokens", 3).alias("mix_tokens"), F.round("repeats", 6).alias("repeats"), "below_target")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    tokens = stage(_tokens(spark, d), "tokens")
    plan = mixing.mix_plan(tokens, load(spark, d, "mix_targets"))
    return mixing.reached_shares(mixing.draw_mix(tokens, plan, "doc_id"), plan)


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    tokens = stage(_tokens(spark, d), "tokens")
    return mixing.draw_mix(tokens, mixing.mix_plan(tokens, load(spark, d, "mix_targets")), "doc_id")


def p9_measures(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(load(spark, d, "documents"), "doc_id", "text")


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    return p9_measures(spark, d).select("doc_id", "n_lines")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_measures(spark, d).where("prose_share < 0.5").select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_neighbors, p3_found, p3_pieces, p3_rebuilt, p4_found, p4_ranking, p4_weighted, p5_found, p5_groups, p6_found,
            p6_shared, p6_spans, p6_passages,
        p7_found, p8_found, p8_plan_chars, p8_shares, p8_selection, p9_found, p9_measures, p9_counts,
    )
}
