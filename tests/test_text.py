import pytest
from pyspark.sql import functions as F

from quillspan.functions import parse_txt, parse_xml
from quillspan.functions import questions as Q
from quillspan.functions import text as X
from quillspan.operators import compile as comp
from quillspan.sources import readers

MEMO = """Group                                                          A. Writer
Request: 8123                                                   May 2020

                     The Sample Protocol

Abstract

   A sample with odd line
   breaks.

1.  Introduction

   Readers MUST read this sentence first. It SHOULD NOT take
   long to do so.

1.1.  Details

   Text that runs on over

A. Writer                 Informational                  [Page 1]
\x0c
RFC 8123                     Sample                      May 2020

   the page break.

2.  Grammar

    item = "A" SP 1*DIGIT
    list = item / "B"

    +---+---+
    | a | b |
    +---+---+

Appendix A.  Notes

   A note that MUST NOT count.
"""
XML = """<rfc number="8999" xmlns="urn:x"><front><abstract><t>Short <xref target="RFC1"/> text.</t></abstract></front>
<middle><section pn="section-1"><name>Security Considerations</name><t>See <eref target="http://a">this</eref>, which MUST hold.</t>
<figure><name>Fig</name><sourcecode type="abnf">a = b</sourcecode></figure>
<table><thead><tr><th>h</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table><ul><li>one</li><li>two</li></ul>
<section pn="section-1.1"><name>Inner</name><sourcecode type="json">{}</sourcecode><aside><t>said</t></aside></section></section></middle>
<back><references anchor="norm-core"><name>Sources</name><reference anchor="R1"><front><title>T</title><author fullname="A B"/></front><seriesInfo name="RFC" value="1"/><seriesInfo name="DOI" value="10.1/x"/></reference></references></back></rfc>"""


def test_txt_document():
    blocks = list(parse_txt.parse(8123, MEMO))
    by_path = {}
    for b in blocks:
        by_path.setdefault(b["hierarchy_path"], []).append(b)
    assert by_path["Introduction"][0]["normalized_text"].startswith("Readers MUST read")
    assert by_path["Introduction > Details"][0]["normalized_text"] == "Text that runs on over the page break."
    assert [b["block_type"] for b in by_path["Grammar"]] == ["abnf"]  # neighbouring indented blocks are one
    assert list(by_path)[-1] == "Back > Notes"
    assert not any("[Page" in b["source_fragment"] or "\x0c" in b["source_fragment"] for b in blocks)
    assert {b["parsing_confidence"] for b in blocks} == {0.8} and list(parse_txt.parse(5, "Some text.\n"))[0]["parsing_confidence"] == 0.6


def test_xml_document():
    b = list(parse_xml.parse(XML))
    assert [x["block_type"] for x in b] == ["prose", "security", "abnf", "table", "list", "sourcecode", "security", "references"]
    assert b[0]["hierarchy_path"] == "Preface > Untitled Section" and b[0]["normalized_text"] == "Short [RFC1] text."
    texts = [x["normalized_text"] for x in b]
    assert "[Fig]\na = b" in texts and "| h |\n| 1 | 2 |" in texts and "* one\n* two" in texts and "See this [http://a], which MUST hold." in texts
    ref = b[-1]
    assert ref["reference"]["category"] == "Normative" and ref["reference"]["doi"] == "10.1/x" and ref["normalized_text"] == "Citations Target [R1]: T by A B."
    assert [x["section_number"] for x in b if "Inner" in x["hierarchy_path"]] == ["1.1", "1.1"] and [x["normalized_text"]
        for x in parse_xml.parse_document(1, XML)] == texts


def test_compilation_from_files(spark, tmp_path):
    (tmp_path / "rfc8123.txt").write_text(MEMO)
    (tmp_path / "rfc8999.xml").write_text(XML)
    (tmp_path / "rfc8999.txt").write_text("Older form.\n")
    (tmp_path / "rfc7.xml").write_text("<rfc><middle>")
    (tmp_path / "notes.txt").write_text("no number")
    (tmp_path / "rfc12.txt").write_bytes("Caf\xe9 text.\n".encode("latin-1"))
    docs = readers.prefer_xml(readers.read_documents(spark, str(tmp_path)))
    raw = readers.parse_documents(docs)
    assert {(r.doc_id, r.error is not None) for r in raw.collect()} == {(8123, False), (8999, False), (7, True), (12, False)}
    meta = spark.createDataFrame([(8123, "Sample", (2020, 5), "X", "S", ["A"], [1], [], [2], None)], readers.S.INDEX_ENTRY)
    blocks, chunks = comp.compile_corpus(raw, meta)
    b = {r.block_id: r for r in blocks.collect()}
    intro = next(r for r in b.values() if r.hierarchy_path == ["Introduction"])
    assert [s.keyword for s in intro.normative_statements] == ["MUST", "SHOULD NOT"] and intro.block_id.startswith("rfc8123-secunknown-")
    assert all(not r.normative_statements for r in b.values() if r.hierarchy_path[0] == "Back")
    c = chunks.collect()
    assert {(r.rfc_number, r.rfc_title, r.stream) for r in c} == {(8123, "Sample", "S"), (8999, "RFC 8999", "IETF"), (12, "RFC 12", "IETF")}
    tree = comp.section_tree(blocks).where("rfc_id = 8123").first()
    assert [s.title for s in tree.sections] == ["Abstract", "Introduction", "Details", "Grammar", "Notes"] and len(tree.preface_blocks) >= 1


def test_index_xml(spark, tmp_path):
    one = "<rfc-entry><doc-id>RFC{0}</doc-id><title>T{0}</title><author><name>N</name></author><date><month>{1}</month><year>2001</year></date><obsoletes><doc-id>RFC1000</doc-id><doc-id>BCP1</doc-id></obsoletes></rfc-entry>"
    (tmp_path / "i.xml").write_text(f"<rfc-index>{one.format(12, 'January')}{one.format(13, 'Spring')}<rfc-entry><title>none</title></rfc-entry></rfc-index>")
    got = {r.rfc_number: r for r in readers.read_index_xml(spark, str(tmp_path / "i.xml")).collect()}
    assert sorted(got) == [12, 13] and got[12].published_at.month == 1 and got[13].published_at.month == 4 and got[12].obsoletes == [1000] and got[12].stream == "UNKNOWN"


@pytest.mark.parametrize("path,exempt", [("Introduction", False), ("Back > Appendix A", True), ("Appendix A.1 References", True),
    ("Abstract", True), ("1 > Status of This Memo", True), ("Abstract > Body", False)])
def test_exempt(spark, path, exempt):
    assert spark.range(1).select(X.is_exempt(F.lit(path))).first()[0] is exempt


def test_statements(spark):
    one = lambda t: [(s.keyword, s.statement_text) for s in spark.range(1).select(X.statements(F.lit(t))).first()[0]]
    assert one("Colonel MUSTARD SHALLOT eat the OPTIONALITY.") == []
    assert one("You MUST  NOT go there. It is OPTIONAL to stay. MUST.") == [("MUST NOT", "You MUST  NOT go there."), ("MAY", "It is OPTIONAL to stay.")]
    assert one("") == []


def test_section_parts(spark):
    one = lambda p, n: tuple(spark.range(1).select(X.section_parts(F.lit(p), F.lit(n).cast("string"), F.lit(9999))).first()[0])
    assert one("Abstract", None) == ("unknown", "secunknown-d985927a", "Abstract")
    assert one("1. Intro > 1.2. Deep", None) == ("1.2.", "sec1.2", "Deep") and one("A > B", "1.1.") == ("1.1", "sec1.1",
        "B") and one("Preface", None)[0] == "preface"


def test_window_split():
    assert [len(x) for x in comp.window_split("A" * 5000)] == [2000, 2000, 1500]
    first = comp.window_split("A" * 1900 + "\n" + "B" * 49 + " " + "C" * 150)[0]
    assert first.endswith("\n") and len(first) == 1901
    assert comp.window_split("short") == ["short"] and comp.window_split("") == []


def test_questions(spark):
    rows = [("abnf of the header", ["syntax_grammar"], ["abnf", "prose", "sourcecode"]),
        ("What is it?", ["conceptual_explanation"], ["prose"]), ("TLS threats and history",
            ["protocol_history", "security_analysis"], ["prose", "references", "security"])]
    df = spark.createDataFrame([(r[0],) for r in rows], "q string").select("q", Q.intents(F.col("q")).alias("i"), Q.routes(F.col("q")).alias("r"))
    got = {r.q: (r.i, r.r) for r in df.collect()}
    for q, i, r in rows:
        assert got[q] == (i, r)
