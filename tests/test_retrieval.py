import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.errors import InvalidRequest
from quillspan.operators import audit, errata, incremental, lineage, retrieval, search
from quillspan.sources import readers, sinks
from quillspan.streaming import ingest

HIT = "query_id long, chunk_id string, rfc_number int, table_route string, hierarchy_path string, text_payload string, score double, top_k int"


def edges(spark):
    rows = [(2000, 1000, "obsoletes"), (3000, 2000, "obsoletes"), (3001, 2000, "obsoletes"), (5000, 5001, "obsoletes"),
        (5001, 5000, "obsoletes"), (3000, 4000, "updates")]
    return spark.createDataFrame(rows, "src int, dst int, kind string")


def test_lineage(spark):
    act = {}
    for r in lineage.active_successors(edges(spark)).collect():
        act.setdefault(r.rfc_number, set()).add(r.active)
    assert act[1000] == {3000, 3001} and act[3000] == {3000} and 5000 not in act
    w = {r.rfc_number: r for r in lineage.warnings(edges(spark)).collect()}
    assert "superseded by RFC 2000." in w[1000].warning and "RFC 3000, RFC 3001" in w[1000].warning and "UPDATED by RFC 3000" in w[4000].warning and 3000 not in w


def ledger(spark):
    rows = [("RFC1000", "Verified", "Technical", "1", "bad  text", "good text"), ("RFC1000", "Rejected", "T", "1", "x", "y"),
        ("RFCBOGUS", "Verified", "T", "1", "x", "y"), ("rfc2000", "Held for Document Update", None, None, "", "n")]
    raw = spark.createDataFrame(rows,
        "`doc-id` string, errata_status_code string, errata_type_code string, section string, orig_text string, correct_text string")
    return errata.ledger(raw.withColumn("ord", F.monotonically_increasing_id()))


def test_errata(spark, tmp_path):
    assert ledger(spark).count() == 2
    assert "Section Unknown: Technical" in {r.rfc_number: r.digest for r in errata.digest(ledger(spark)).collect()}[2000]
    (tmp_path / "e.json").write_text(json.dumps([{"doc-id": "RFC7", "errata_status_code": "Reported", "orig_text": "a", "correct_text": "b"}]))
    assert readers.read_errata(spark, str(tmp_path / "e.json")).count() == 1 and readers.read_errata(spark, str(tmp_path / "none.json")).count() == 0


def test_enrichment_is_idempotent(spark):
    h = spark.createDataFrame([(1, "a", 1000, "prose", "P", "some bad text here", 1.0, 5), (1, "b", 9, "prose", "P", "plain", 0.5, 5)], HIT)
    w = lineage.warnings(edges(spark))
    once = retrieval.enriched(h, w, ledger(spark))
    got = {r.chunk_id: r for r in once.collect()}
    assert got["a"].is_obsolete and got["a"].has_errata and got["a"].text_payload.startswith("[TEMPORAL WARNING") and "WITH:\n'good text'" in got["a"].text_payload and got["b"].text_payload == "plain"
    twice = retrieval.enriched(once, w, ledger(spark))
    assert {r.chunk_id: r.text_payload for r in twice.collect()} == {k: v.text_payload for k, v in got.items()}


def test_rerank_and_degrading(spark):
    h = spark.createDataFrame([(1, c, 1, "prose", "P", t, s, 2) for c, t, s in (("a", "x", 0.9), ("b", "y", 0.5), ("c", "z", 0.1))], HIT)
    q = spark.createDataFrame([(1, "q")], "query_id long, query_text string")
    order = lambda df: [r.chunk_id for r in df.orderBy("rank").collect()]
    assert order(retrieval.rerank(h, q)) == ["a", "b"]
    assert order(retrieval.rerank(h, q, lambda qs, ts: [{"x": -1.5, "y": 0.0, "z": 5.5}[t] for t in ts])) == ["c", "b"]

    def broken(qs, ts):
        raise RuntimeError

    assert order(retrieval.rerank(h, q, broken)) == ["a", "b"] and order(retrieval.rerank(h, q, lambda qs, ts: [1.0] * (len(ts) + 1))) == ["a", "b"]


def test_failed_reranking_is_marked(spark):
    rows = [(i, f"{i}{c}", 1, "prose", "P", t, s, 3) for i in (1, 2) for c, t, s in (("a", "x", 0.9), ("b", "y", 0.5), ("c", "z", 0.1))]
    h = spark.createDataFrame(rows, HIT)
    q = spark.createDataFrame([(1, "q"), (2, "p")], "query_id long, query_text string")

    def partly(qs, ts):  # batches of one row
        if (qs[0], ts[0]) == ("q", "x"):
            raise RuntimeError
        return [{"x": -1.5, "y": 0.0, "z": 5.5}[t] for t in ts]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = retrieval.rerank(h, q, partly).orderBy("query_id", "rank").collect()
        nan = retrieval.rerank(h, q, lambda qs, ts: [float("nan")] * len(ts)).orderBy("query_id", "rank").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.chunk_id, r.degraded) for r in got] == [("1a", True), ("1b", True), ("1c", True), ("2c", False), ("2b", False), ("2a", False)]
    assert [(r.chunk_id, r.degraded) for r in nan] == [(f"{i}{c}", True) for i in (1, 2) for c in "abc"]
    assert not any(r.degraded for r in retrieval.rerank(h, q).collect())


def test_stitching(spark):
    chunks = spark.createDataFrame([(f"rfc1-sec2-blk{n}-chunk000", f"t{n}")
        for n in (1, 8, 9, 10, 11)] + [("rfc1-preface-blk1-chunk000", "p")], "chunk_id string, text_payload string")
    h = spark.createDataFrame([(1, "rfc1-sec2-blk9-chunk000", 1, "prose", "P", "t9", 1.0, 5),
        (1, "rfc1-preface-blk1-chunk000", 1, "prose", "P", "p", 1.0, 5)], HIT)
    got = {r.chunk_id: r.text_payload for r in retrieval.stitched(h, chunks).collect()}
    assert got["rfc1-sec2-blk9-chunk000"] == "t10\n\nt8\n\nt9" and got["rfc1-preface-blk1-chunk000"] == "p"
    assert {r.chunk_id: r.text_payload for r in retrieval.stitched(h, chunks, numeric=True).collect()}["rfc1-sec2-blk9-chunk000"] == "t8\n\nt9\n\nt10"


def test_contexts(spark):
    h = spark.createDataFrame([(1, "a", 7, "prose", "P", " ### [SOURCE x ", 1.0, 5)], HIT).withColumn("rank", F.lit(1))
    text = retrieval.contexts(h).first().context
    assert text.endswith("### [SOURCE 1: RFC 7 | Format: PROSE | Path: P]\n--- [SOURCE x")
    assert list(retrieval.answer("q", retrieval.EMPTY_CONTEXT, lambda p: iter(["no"]))) == [retrieval.REFUSAL]
    for k, t in ((0, 0.1), (51, 0.1), (5, 1.5)):
        with pytest.raises(InvalidRequest):
            retrieval.check_request(k, t)


def test_dense_matches_brute_force(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(90, 8)).astype(np.float32)
    v[7] = 0
    rows = [(i, [float(x) for x in v[i]]) for i in range(90)] + [(90, [1.0]), (91, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    got = {}
    for x in search.dense_topk(df, df.where("id < 9").withColumnRenamed("id", "query_id"), 5, dim=8, block=16).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.id))
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    for q in range(9):
        if q == 7:
            assert q not in got
            continue
        want = sorted((i for i in range(90) if i != 7), key=lambda i: (-(u[q] @ u[i]), i))[:5]
        assert [i for _, i in sorted(got[q])] == want
    unit = spark.createDataFrame([([3.0, 4.0, 9.0],), ([0.0, 0.0, 1.0],)], "v array<float>").select(search.unit(F.col("v"), 2).alias("u")).collect()
    assert [round(x, 6) for x in unit[0].u] == [0.6, 0.8] and unit[1].u == [0.0,
        0.0] and search.ann_partitions(60_000) == 16 and search.ann_partitions(50_000) == 0


def test_dense_by_parts_and_passes(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(120, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, i % 3, [float(x) for x in v[i]]) for i in range(120)], "id long, part long, vector array<float>")
    q = df.where("id < 12").select(F.col("id").alias("query_id"), F.explode(F.array(F.lit(0), F.lit(2))).alias("part"), "vector")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for passes in (100, 1):
        got = {}
        for x in search.dense_topk(df, q, 4, dim=8, block=1, part="part", questions_a_pass=passes).collect():
            got.setdefault((x.query_id, x.part), []).append((x["rank"], x.id))
        for i in range(12):
            for p in (0, 2):
                want = sorted((j for j in range(120) if j % 3 == p), key=lambda j: -(u[i] @ u[j]))[:4]
                assert [j for _, j in sorted(got[i, p])] == want
    assert search.dense_topk(df.limit(0), q, 4, dim=8).count() == 0 and search.dense_topk(df, q.limit(0), 4, dim=8).count() == 0


def test_inverted_file_recall(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 32))
    v = (centres[r.integers(0, 20, 3000)] * 0.7 + r.normal(size=(3000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(3000)], "id long, vector array<float>")
    q = df.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    found = {(x.query_id, x.id) for x in search.ann_topk(df, q, 10, dim=32, cells=32).collect()}
    exact = {(x.query_id, x.id) for x in search.dense_topk(df, q, 10, dim=32).collect()}
    assert len(found) == len(exact) == 1500 and len(found & exact) >= 0.9 * len(exact)


def test_hybrid_candidates(spark):
    chunks = spark.createDataFrame(
        [("a", 1, "prose", "P", "alpha beta"), ("b", 1, "prose", "P", "gamma"), ("c", 2, "prose", "P", "alpha"), ("d", 1, "table", "P", "alpha")],
        "chunk_id string, rfc_number int, table_route string, hierarchy_path string, text_payload string",
    )
    q = spark.createDataFrame([(1, "alpha", 5), (2, "alpha of RFC 1", 5)], "query_id long, query_text string, top_k int")
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "chunk_id string, vector array<float>")
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0])], "query_id long, vector array<float>")
    got = {(x.query_id, x.chunk_id) for x in retrieval.candidates(chunks, q, vec, asked, 2).collect()}
    assert got == {(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b")}  # b by its vector alone, c isn't of the named document, d of no route
    assert {(x.query_id, x.chunk_id) for x in retrieval.candidates(chunks, q).collect()} == {(1, "a"), (1, "c"), (2, "a")}


def brute_bm25(docs, text):
    """Of each document the score of a question's words, to five decimals."""
    import math
    import re

    words = {i: [w for w in re.split("[^a-z0-9]+", t.lower()) if w] for i, t in docs.items()}
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for w in {w for w in re.split("[^a-z0-9]+", text.lower()) if w}:
        df = sum(w in t for t in words.values())
        for i, t in words.items():
            if tf := t.count(w):
                idf = math.log(1 + (len(words) - df + 0.5) / (df + 0.5))
                out[i] = out.get(i, 0) + idf * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * len(t) / mean))
    return {i: round(x, 5) for i, x in out.items()}


def test_bm25_makes_no_pairs(spark):
    r = np.random.default_rng(5)
    docs = {f"c{i:03}": " ".join(["the", *(f"w{x}" for x in r.zipf(1.6, r.integers(0, 9)) if x < 40)]) for i in range(200)}
    asked = {i: " ".join(["The", *(f"w{x}" for x in r.integers(1, 40, 3))]) for i in range(40)} | {98: "nowhere", 99: "  "}
    c = spark.createDataFrame([*docs.items(), ("none", None)], "chunk_id string, text_payload string")
    q = spark.createDataFrame([*asked.items(), (100, None)], "query_id long, query_text string")
    found = {}
    for block, at_once in ((16_384, 512), (7, 3), (200, 1)):
        best = search.bm25_topk(c.where("text_payload is not null"), q, 5, block=block, questions_a_block=at_once)
        plan = best._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Generate" not in plan  # every question holds "the", every chunk too
        got = {}
        for x in best.collect():
            got.setdefault(x.query_id, []).append((-x.score, x.item))
        found[block] = {i: sorted(v) for i, v in got.items()}
        want = {i: sorted((-s, d) for d, s in brute_bm25(docs, t).items())[:5] for i, t in asked.items()}
        assert found[block] == {i: v for i, v in want.items() if v}
    assert search.bm25_topk(c.limit(0), q, 5).count() == 0 and search.bm25_topk(c, q.limit(0), 5).count() == 0


def test_bm25_by_group(spark):
    texts = {f"c{i:02}": "the " + " ".join(["alpha"] * (i % 4) + ["pad"] * (i % 3)) for i in range(40)}
    route = {c: [None, "prose", "table"][i % 3] for i, c in enumerate(texts)}
    c = spark.createDataFrame([(i, route[i], t) for i, t in texts.items()], "chunk_id string, table_route string, text_payload string")
    q = spark.createDataFrame([(1, "the alpha"), (2, "alpha")], "query_id long, query_text string")
    best = search.bm25_topk(c, q, 3, group="table_route", block=9)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    got = {}
    for x in best.collect():
        got.setdefault((x.query_id, x.table_route), []).append((-x.score, x.item))
    for i, text in ((1, "the alpha"), (2, "alpha")):
        for r in (None, "prose", "table"):
            want = sorted((-s, d) for d, s in brute_bm25(texts, text).items() if route[d] == r)[:3]
            assert sorted(got[i, r]) == want


def test_keyword_list_makes_no_pairs(spark):
    rows = [(f"c{i:02}", [1, 2, 3, None][i % 4], ["prose", "references", "table"][i % 3], "alpha " * (i % 5) + "rfc beta") for i in range(60)]
    c = spark.createDataFrame(rows, "chunk_id string, rfc_number int, table_route string, text_payload string")
    q = spark.createDataFrame([(1, "alpha", 1), (2, "alpha of RFC 2", 1), (3, "history of alpha beta", 2), (4, "beta in RFC 9", 1)],
        "query_id long, query_text string, top_k int")
    best = retrieval.keyword_list(c, q, 2 * F.col("top_k"))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    got = {}
    for x in best.collect():
        got.setdefault((x.query_id, x.table_route), []).append((-x.score, x.item))
    texts = {r[0]: r[3] for r in rows}
    want = {}
    for i, text, doc, routes, n in ((1, "alpha", None, ["prose"], 2), (2, "alpha of RFC 2", 2, ["prose"], 2), (3, "history of alpha beta", None, ["prose",
        "references"], 4)):
        scores = brute_bm25(texts, text)
        for route in routes:
            fit = [(-scores[r[0]], r[0]) for r in rows if r[2] == route and r[0] in scores and (doc is None or r[1] == doc)]
            want[i, route] = sorted(fit)[:n]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_hybrid_rrf_makes_no_pairs(spark):
    from quillspan.plans import registry

    folder = os.environ.get("QUILLSPAN_TEST_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    plan = registry.QUERIES["hybrid_rrf"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_dense_shuffles_no_more_for_more_files(spark):
    df = spark.createDataFrame([(i, [float(i % 7 - 3), 1.0]) for i in range(400)], "id long, vector array<float>").repartition(64)
    best = search.dense_topk(df, df.where("id < 2").withColumnRenamed("id", "query_id"), 3, dim=2)
    assert best.count() == 6
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert f"Coalesce {spark.sparkContext.defaultParallelism}" in plan  # each task gives k rows per query


def test_retrieve_computes_chunks_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(t):
        seen.add(1)
        return t

    rows = [("a", 1, "prose", "P", "alpha beta"), ("b", 1, "prose", "P", "gamma"), ("c", 2, "prose", "P", "alpha")]
    c = spark.createDataFrame(rows, "chunk_id string, rfc_number int, table_route string, hierarchy_path string, text_payload string").coalesce(1)
    q = spark.createDataFrame([(1, "alpha", 5)], "query_id long, query_text string, top_k int")
    out = retrieval.retrieve(c.withColumn("text_payload", text("text_payload")), q, lineage.warnings(edges(spark)), ledger(spark), retrieval.overlap_scorer)
    got = out.collect()
    assert "[SOURCE 1: RFC" in got[0].context and not got[0].degraded and seen.value == 3


def test_percentile(spark):
    import statistics

    for n in (1, 2, 7, 200):
        values = [i * i % 97 for i in range(n)]
        df = spark.createDataFrame([("a", v) for v in values], "g string, v int")
        want = int(statistics.quantiles(values, n=100)[94]) if n > 1 else values[0]
        assert audit.exclusive_percentile(df, "g", "v").first().p == want


def test_delta_and_patch(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id int")
    state = spark.createDataFrame([(1, "txt"), (2, "xml")], "doc_id int, source_type string")
    assert {(r.doc_id, r.source_type) for r in incremental.delta_queue(ids(1, 2, 3), ids(1, 2, 3, 4), state).collect()} == {(1, "xml"), (3, "xml"), (4, "txt")}
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n")], "k int, v string")
    assert {tuple(r) for r in incremental.patched(old, new, "k").collect()} == {(1, "o"), (2, "n")}


def test_sinks_and_stream(spark, tmp_path):
    row = lambda i, t: {"chunk_id": i, "rfc_number": 1, "table_route": t, "text_payload": i}
    feed, table = tmp_path / "feed", str(tmp_path / "table")
    feed.mkdir()
    (feed / "a.jsonl").write_text("\n".join(map(json.dumps, [row("1", "prose"), row("2", "prose"), row("3", "abnf")])) + "\n\nbroken{\n")
    ingest.append_feed(spark, str(feed), table, str(tmp_path / "cp")).awaitTermination()
    (feed / "b.jsonl").write_text("\n".join(map(json.dumps, [row("2", "prose"), row("3", "abnf"), row("4", "abnf")])))
    ingest.append_feed(spark, str(feed), table, str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.chunk_id, r.table_route) for r in spark.read.parquet(table).collect())
    assert got == [("1", "prose"), ("2", "prose"), ("3", "abnf"), ("4", "abnf")]
    sinks.compact(spark, table, ["abnf"])
    assert spark.read.parquet(table).count() == 4
    sinks.replace_table(spark.range(3), str(tmp_path / "t2"))
    sinks.replace_table(spark.range(5), str(tmp_path / "t2"))
    assert spark.read.parquet(str(tmp_path / "t2")).count() == 5
    (tmp_path / "sh").mkdir()
    (tmp_path / "sh" / "bad.parquet").write_bytes(b"nope")
    sinks.write_shards(spark.createDataFrame([("c1",)], "chunk_id string"), str(tmp_path / "sh"))
    assert [r.chunk_id for r in readers.existing_ids(spark, str(tmp_path / "sh"))
        .collect()] == ["c1"] and readers.existing_ids(spark, str(tmp_path / "none")).count() == 0
