"""XML documents to typed blocks. Mixed content has an order that a row source loses, so a document is walked as a tree in Python."""

from __future__ import annotations

import logging
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from quillspan import schemas as S

log = logging.getLogger(__name__)
_CONTAINERS = {"section", "references", "referencegroup", "blockquote", "aside"}
# Words by which a reference list is normative, and series that name a reference.
_NORMATIVE = ["normative", "core", "required", "requirement", "standards", "specifications", "mandatory"]
_SERIES = ["RFC", "INTERNET-DRAFT", "BCP", "STD", "FYI"]


def tag(e: ET.Element) -> str:
    """Name without its namespace; empty for comments and instructions."""
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def kids(e: ET.Element | None, *names: str) -> list[ET.Element]:
    return [c for c in e if tag(c) in names] if e is not None else []


def flat(e: ET.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def _inline(e: ET.Element) -> Iterator[str]:
    """Text with references as 'text [target]'."""
    yield e.text or ""
    for c in e:
        inner = "".join(_inline(c))
        if tag(c) in ("xref", "eref"):
            goal = f"[{c.get('target', 'UNKNOWN' if tag(c) == 'xref' else 'LINK')}]"
            yield f"{inner} {goal}" if inner.strip() else goal
        else:
            yield inner
        yield c.tail or ""


def inline(e: ET.Element) -> str:
    return " ".join("".join(_inline(e)).split())


def markdown_table(table: ET.Element) -> str:
    """Rows of head, body and foot as '| a | b |' lines."""
    rows = [r for part in ("thead", "tbody", "tfoot") for group in kids(table, part) for r in kids(group, "tr")] or kids(table, "tr")
    cells = ([flat(c) for c in kids(r, "td", "th")] for r in rows)
    return "\n".join(f"| {' | '.join(c)} |" for c in cells if c)


def list_lines(e: ET.Element) -> str:
    marks = {"li": "*", "dt": ";", "dd": ":"}
    return "\n".join(f"{marks[tag(c)]} {t}" for c in e if tag(c) in marks and (t := inline(c)))


def citation(e: ET.Element, low_path: str, parent_anchor: str) -> tuple[str, dict]:
    """A reference as a sentence, and its bibliographic fields."""
    titles = [t for t in e.iter() if tag(t) == "title"]
    people = [a.get("fullname") for a in e.iter() if tag(a) == "author" and a.get("fullname") is not None]
    text = f"Citations Target [{e.get('anchor', 'REF')}]: {(flat(titles[0]) if titles else '') or 'Untitled'} by {', '.join(people) or 'Unknown Authors'}."
    context = f"{low_path} {parent_anchor.lower()}"
    front = kids(e, "front")
    own = kids(front[0], "title") if front else []
    meta = {"anchor": e.get("anchor", "UNKNOWN"), "category": "Normative" if any(w in context for w in _NORMATIVE)
        else "Informative", "title": flat(own[0]) if own else None, "target_url": e.get("target"), "doi": None, "series_name": None, "series_value": None}
    for info in kids(e, "seriesInfo"):
        name = info.get("name", "")
        if name.upper() == "DOI":
            meta["doi"] = info.get("value")
        elif name.upper() in _SERIES:
            meta |= {"series_name": name, "series_value": info.get("value")}
    return " ".join(text.split()), meta


def _block(e: ET.Element, path: str, number: str | None, parent_anchor: str, caption: str = "") -> dict:
    kind, low = tag(e), path.lower()
    form = (e.get("type") or "").lower()
    reference = None
    if kind == "t":
        text = inline(e)
    elif kind in ("ul", "ol", "dl"):
        text = list_lines(e)
    elif kind == "reference":
        text, reference = citation(e, low, parent_anchor)
    elif kind == "table":
        text = markdown_table(e)
    else:
        text = "".join(e.itertext()).strip("\n")
    block_type = "abnf" if kind == "sourcecode" and form == "abnf" else S.TAG_TYPES.get(kind, "prose")
    if block_type == "prose":
        block_type = "security" if "security considerations" in low else "references" if "references" in low else "prose"
    tail, e.tail = e.tail, None
    source = ET.tostring(e, encoding="unicode").strip()
    e.tail = tail
    return {
        "hierarchy_path": path, "block_type": block_type, "source_type": "xml", "sourcecode_type": form if kind == "sourcecode"
            and form in S.SOURCECODE_FORMATS else None,
        "normalized_text": f"[{caption}]\n{text}" if caption else text, "source_fragment": source, "parsing_confidence": 1.0,
            "element_id": e.get("anchor") or e.get("pn"), "section_number": number, "reference": reference,
    }


def _walk(e: ET.Element, above: list[str], number: str | None = None) -> Iterator[dict]:
    if tag(e) in ("blockquote", "aside"):
        path = [*above, tag(e).capitalize()]
    else:
        pn = e.get("pn") or ""
        if pn.startswith("section-"):
            number = pn.removeprefix("section-")
            number = number.removeprefix("appendix-").upper() if number.startswith("appendix-") else number
        name = kids(e, "name")
        path = [*above, (flat(name[0]) if name else "") or "Untitled Section"]
    where, anchor = " > ".join(path), e.get("anchor", "")
    for c in e:
        kind = tag(c)
        if kind in _CONTAINERS:
            yield from _walk(c, path, number)
        elif kind in S.TAG_TYPES:
            yield _block(c, where, number, anchor)
        elif kind == "figure":
            name = kids(c, "name")
            for inner in c:
                if tag(inner) in S.TAG_TYPES and tag(inner) != "reference":
                    yield _block(inner, where, number, c.get("anchor", ""), flat(name[0]) if name else "")


def parse(content: str) -> Iterator[dict]:
    """Blocks of a document in order; malformed XML raises ParseError."""
    yield from _blocks(ET.fromstring(content))


def parse_document(doc_id: int, content: str) -> Iterator[dict]:
    """:func:`parse` of a document whose number is known: a root that names another number is noted, and the known one counts."""
    root = ET.fromstring(content)
    stated = root.get("number") or ""
    if stated.isdigit() and int(stated) != doc_id:
        log.warning("document %s names itself %s", doc_id, stated)
    yield from _blocks(root)


def _blocks(root: ET.Element) -> Iterator[dict]:
    for front in kids(root, "front")[:1]:
        for kind, lead in (("abstract", lambda e: []), ("note", lambda e: [e.get("title", "Note")]), ("boilerplate", lambda e: ["Boilerplate"])):
            for e in kids(front, kind):
                yield from _walk(e, ["Preface", *lead(e)])
    for middle in kids(root, "middle")[:1]:
        for e in kids(middle, "section"):
            yield from _walk(e, [])
    for back in kids(root, "back")[:1]:
        for kind in ("section", "references"):
            for e in kids(back, kind):
                yield from _walk(e, ["Back"])
