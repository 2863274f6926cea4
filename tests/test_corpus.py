"""Compilation from files to stored tables: a whole document, incremental runs, row checks, and what is read back."""

import json

import pytest
from pyspark.sql import functions as F

from quillspan.errors import InvalidRequest
from quillspan.functions import parse_txt
from quillspan.functions import text as X
from quillspan.operators import compile as comp
from quillspan.operators import errata, incremental, lineage, retrieval
from quillspan.sources import readers, sinks

DOCUMENT = """Network Group                                        A. Author
Request for Comments: 9999

                     A Small Test of Parsing

Abstract

   This memo is short.  It defines little.

1.  Introduction

   A sender MUST check the frame before it
   is used, and the text goes on over the

Author                       Standards Track                    [Page 1]
\f
RFC 9999                        Test                        March 2024

   next page. It SHOULD NOT be split.

2.  Syntax

    rule   = 1*DIGIT CRLF
    other  = %x41-5A / rule

2.1.  Figure

    +----+
    | ab |
    +----+

References

   Nothing.
"""


def meta(spark):
    row = [(9999, "A Small Test", (2024, 3), "STANDARD", "IETF", [], [1], [], [])]
    kind = "rfc_number int, title string, published_at struct<year:int,month:int>, status string, stream string, authors array<string>, obsoletes array<int>, updates array<int>, updated_by array<int>"
    return spark.createDataFrame(row, kind)


def compiled(spark, docs):
    raw = readers.parse_documents(spark.createDataFrame(docs, "doc_id int, source_type string, content string"))
    return comp.compile_corpus(raw, meta(spark))


def test_a_document_becomes_this_tree(spark):
    blocks, chunks = compiled(spark, [(9999, "txt", DOCUMENT)])
    tree = comp.section_tree(blocks).first()
    got = [(s.section_id, " > ".join(s.hierarchy_path), [(b.block_type, [x.keyword for x in b.normative_statements]) for b in s.blocks]) for s in tree.sections]
    assert got == [
        ("unknown", "Abstract", [("paragraph", [])]),
        ("unknown", "Introduction", [("paragraph", ["MUST", "SHOULD NOT"])]),
        ("unknown", "Syntax", [("abnf", [])]),
        ("unknown", "Syntax > Figure", [("artwork", [])]),
        ("unknown", "Back > References", [("references", [])]),
    ]
    intro = tree.sections[1].blocks[0].normalized_text
    assert "goes on over the next page." in intro and "Page 1" not in intro and "March 2024" not in intro
    assert len(tree.preface_blocks) == 2 and all(b.block_id.startswith("rfc9999-preface-blk") for b in tree.preface_blocks)
    rows = {r.block_id: (r.section_no, r.block_no) for r in comp.canonical_rows(blocks).collect()}
    want = {b.block_id: (0, n) for n, b in enumerate(tree.preface_blocks, 1)} | {b.block_id: (i, n) for i,
        s in enumerate(tree.sections, 1) for n, b in enumerate(s.blocks, 1)}
    assert rows == want
    one = chunks.where("table_route = 'abnf'").first()
    assert (one.rfc_title, one.rfc_year, one.obsoletes, one.hierarchy_path) == ("A Small Test", 2024, [1], "Syntax")


def test_page_breaks_look_as_far_as_needed():
    long = "   " + "word " * 2000
    text = f"{long}\n\nA                [Page 3]\n\f\nRFC 1    Test\n{chr(10) * 5000}   goes on\n"
    assert len(parse_txt.paragraphs(parse_txt.without_pages(text))) == 1
    assert len(parse_txt.paragraphs(parse_txt.without_pages(text.replace("   goes on", "goes on")))) == 2


def test_trees_are_read_back_and_descended(spark, tmp_path):
    blocks, _ = compiled(spark, [(9999, "txt", DOCUMENT), (1, "txt", "   Only this.\n")])
    path = str(tmp_path / "trees")
    sinks.write_documents(comp.section_tree(blocks), path)
    (tmp_path / "trees" / "broken.json").write_text("{not json\n")
    back = readers.read_canonical(spark, path)
    key = lambda df: sorted((r.rfc_id, r.block_id, r.normalized_text, r.is_preface) for r in df.collect())
    assert key(back) == key(blocks)
    docs = spark.createDataFrame([(1,
        json.dumps({"a": [{"block_type": "x", "normalized_text": "abc", "in": {"block_type": "y", "normalized_text": None}}]})),
            (2, "no json"), (3, None)], "doc_id int, content string")
    assert [(r.doc_id, r.block_type, r.chars) for r in readers.json_blocks(docs).collect()] == [(1, "x", 3), (1, "y", 0)]


def test_incremental_runs(spark, tmp_path):
    out = str(tmp_path / "corpus")
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id int, source_type string, content string")
    first = docs((9999, "txt", DOCUMENT), (2, "txt", "   Some text here.\n"), (3, "xml", "<rfc><broken"))
    assert incremental.run(spark, first, meta(spark), out).count() == 3
    told = lambda: {r.doc_id: (r.source_type, r.status, r.total_blocks) for r in spark.read.parquet(f"{out}/telemetry").collect()}
    before = told()
    assert before[2] == ("txt", "success", 1) and before[3] == ("xml", "failed", 0) and before[9999][1] == "success"
    # what failed is tried again, what is done is not, and XML replaces text
    xml = "<rfc number='2'><middle><section><name>N</name><t>One.</t><t>Two.</t></section></middle></rfc>"
    again = docs((9999, "txt", DOCUMENT), (2, "txt", "   Some text here.\n"), (2, "xml", xml), (3, "xml", "<rfc><broken"))
    assert {(r.doc_id, r.source_type) for r in incremental.run(spark, again, meta(spark), out).collect()} == {(2, "xml"), (3, "xml")}
    assert told()[2] == ("xml", "success", 2) and told()[9999] == before[9999]
    chunks = spark.read.parquet(f"{out}/chunks")
    assert sorted(r.text_payload for r in chunks.where("rfc_number = 2").collect()) == ["One.", "Two."]
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    done = docs((9999, "txt", DOCUMENT), (2, "xml", xml))
    assert incremental.run(spark, done, meta(spark), out).count() == 0
    assert incremental.run(spark, done, meta(spark), out, full=True).count() == 2
    assert json.loads((tmp_path / "corpus" / "manifest").glob("*.json").__next__().read_text())["documents"] == 2


def test_rows_that_may_be_stored(spark):
    rows = [("a", 1, "prose", 0.5), (None, 1, "prose", 0.5), ("b", None, "prose", 0.5), ("c", 0, "prose", 0.5),
        ("d", 1, "poetry", 0.5), ("e", 1, None, 0.5), ("f", 1, "abnf", 1.5), ("g", 1, "abnf", None), ("h", 1, "abnf", float("nan"))]
    good, bad = sinks.accepted(spark.createDataFrame(rows, "chunk_id string, rfc_number int, table_route string, parsing_confidence double"))
    assert {r.chunk_id for r in good.collect()} == {"a", "g"}
    assert sorted((r.chunk_id or "", r.reason) for r in bad.collect()) == [("", "no id"), ("b", "no document"),
        ("c", "no document"), ("d", "unknown route"), ("e", "unknown route"), ("f", "confidence"), ("h", "confidence")]
    df = spark.createDataFrame([("7",), ("x",)], "n string")
    assert df.where("n = '7'").select(X.required_int(F.col("n"), "number").alias("n")).first().n == 7
    with pytest.raises(Exception, match="number: not a whole number: x"):
        df.select(X.required_int(F.col("n"), "number").alias("n")).collect()


def test_lineage_of_a_metadata_file(spark, tmp_path):
    path = tmp_path / "meta.json"
    g = lineage.LineageGraph(spark, str(path))
    ask = spark.createDataFrame([(1,), (2,), (9,)], "rfc_number int")
    assert g.lookup(ask).count() == 0  # no file: nothing is found, nothing fails
    path.write_text(json.dumps({"2": {"title": "Two", "status": "STANDARD", "obsoletes": [1, 0]}, "x": {}, "3": "no object"}))
    assert g.lookup(ask).count() == 0
    g.reload()
    got = {r.rfc_number: r for r in g.lookup(ask).collect()}
    assert set(got) == {1, 2} and got[1].obsoleted_by == [2] and got[2].title == "Two" and got[1].status == "UNKNOWN"


def test_a_failing_read_is_no_empty_table(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("x")
    assert readers.existing_ids(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):  # noqa: B017  an unknown file system is trouble, not absence
        readers.existing_ids(spark, "nofs://x/y").count()
    with pytest.raises(Exception):  # noqa: B017
        readers.read_errata(spark, "nofs://x/y")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i}", i) for i in range(50)], "name string, chars int")
    sinks.write_csv_report(df, str(tmp_path / "csv"), by="chars")
    lines = [line for f in sorted((tmp_path / "csv").glob("part-*")) for line in f.read_text().splitlines() if not line.startswith("name")]
    assert lines == [f"r{i},{i}" for i in range(49, -1, -1)]
    sinks.write_report(df.limit(1), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).first()[0] == "name: r0 | chars: 0"
    sinks.term_statistics(spark.createDataFrame([("abnf", "a b a"), ("abnf", "a"), ("prose", None)],
        "table_route string, text_payload string"), str(tmp_path / "terms"))
    assert {(r.table_route, r.term, r.df) for r in spark.read.parquet(str(tmp_path / "terms" / "terms")).collect()} == {("abnf", "a", 2), ("abnf", "b", 1)}


def test_answers_and_audits(spark):
    assert retrieval.finished("text") == "text" and "MAX_TOKENS" in retrieval.finished("x", "MAX_TOKENS") and retrieval.finished("").startswith("[")
    with pytest.raises(InvalidRequest):
        retrieval.check_request(5, roles=["user", "robot"])
    df = spark.createDataFrame([("### [SOURCE 1: RFC 1",), (retrieval.EMPTY_CONTEXT,), ("neither",)], "context string")
    assert tuple(retrieval.audit_contexts(df).first()) == (1, 1, 1)
    said = spark.createDataFrame([("see [Source 1]",), (retrieval.REFUSAL,), ("no",)], "t string").select(retrieval.complies(F.col("t")).alias("ok")).collect()
    assert [r.ok for r in said] == [True, True, False]
    hits = spark.createDataFrame([("a", "1", None, None, "t", None), ("b", "x", "prose", "P", "t", 1.0),
        (None, "1", "prose", "P", "t", 1.0), ("c", "2", "prose", "P", "t", float("nan"))],
            "chunk_id string, rfc_number string, table_route string, hierarchy_path string, text_payload string, score double")
    assert sorted((r.chunk_id, r.rfc_number, r.table_route, r.score) for r in retrieval.sound_hits(hits)
        .collect()) == [("a", 1, "Unknown", 0.0), ("c", 2, "prose", 0.0)]


def test_errata_of_a_hot_document(spark, monkeypatch):
    monkeypatch.setattr(errata, "HOT_DOCUMENT", 30)
    hits = spark.createDataFrame([(f"c{i}", 1 if i < 60 else 2, f"text {i} has a fault here") for i in range(70)],
        "chunk_id string, rfc_number int, text_payload string")
    raw = spark.createDataFrame([("RFC1", "Verified", "T", "1", "a  fault", "x", 1),
        ("RFC2", "Verified", "T", "1", "a fault", "y", 2)],
            "`doc-id` string, errata_status_code string, errata_type_code string, section string, orig_text string, correct_text string, ord int")
    got = {r.chunk_id: r.corrections for r in errata.matches(hits, errata.ledger(raw)).collect()}
    assert len(got) == 70 and "'x'" in got["c0"] and "'y'" in got["c69"]


def test_a_route_is_read_from_its_folder(spark, tmp_path):
    df = spark.createDataFrame([("a", "abnf"), ("b", "prose")], "chunk_id string, table_route string")
    sinks.write_routed(df, str(tmp_path / "t"), "overwrite")
    found = spark.read.parquet(str(tmp_path / "t")).where("table_route = 'abnf'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(table_route" in plan and [r.chunk_id for r in found.collect()] == ["a"]
