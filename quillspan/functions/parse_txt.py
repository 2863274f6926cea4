"""Plain-text documents to typed blocks. Headers are told by points and carry state from line to line, so a document is parsed as a whole in Python; everything after it is columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

from quillspan import schemas as S
from quillspan.functions import text as X

# Fixed value: a page's footer, form feed and running header, with the blank lines around them.
_PAGE_BREAK = re.compile(r"\n*[^\n]*\[Page\s+\d+\][^\n]*(?:\r\n?|\n)(?:[^\S\r\n]*(?:\r\n?|\n))*[^\S\r\n]*\x0c(?:[^\S\r\n]*(?:\r\n?|\n))*[^\n]*(?:\r\n?|\n)(?:[^\S\r\n]*(?:\r\n?|\n))*", re.IGNORECASE)
_UNNUMBERED, _NUMERIC, _APPENDIX, _ROMAN = (re.compile(p) for p in (X.UNNUMBERED_HEADER, X.NUMERIC_HEADER, X.APPENDIX_HEADER, X.ROMAN_HEADER))
_SIGNALS = [(re.compile(p), n) for p, n in X.ABNF_SIGNALS]
_RULE = re.compile(X.ABNF_RULE)
# Where a header line runs into its paragraph, a line that underlines, and a joining word after a wide gap.
_SQUASHED = re.compile(r"\s{2,}(?=[A-Z])|(?<=[a-z0-9]\.)\s+(?=[A-Z])")
_RULED = re.compile(r"^[-=_\s]{3,}$")
_JOINER = re.compile(r"\s{2,}(?:and|or|the|of)\s+")
_MODERN_FROM = 1000


def _key(line: str) -> str:
    return line.lower().rstrip(".:- ")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def _nearest(text: str, place: int, way: int) -> str:
    """The line that isn't blank nearest to a place, after it (``way`` 1) or before it (-1), however far away; empty if there is none."""
    while 0 <= place <= len(text):
        end = text.find("\n", place) if way > 0 else text.rfind("\n", 0, place)
        line = text[place : end if end >= 0 else len(text)] if way > 0 else text[end + 1 : place]
        if line.strip():
            return line
        if end < 0:
            break
        place = end + 1 if way > 0 else end
    return ""


def without_pages(text: str) -> str:
    """Joins pages. A paragraph that runs on to the next page goes on; a header or another indent after the break starts a new one."""

    def join(m: re.Match) -> str:
        before, after = _nearest(text, m.start(), -1), _nearest(text, m.end(), 1)
        first = after.strip()
        header = bool(first) and any((_NUMERIC.match(first), _APPENDIX.match(first), _UNNUMBERED.match(_key(first))))
        return "\n\n" if header or _indent(before) != _indent(after) else "\n"

    return _PAGE_BREAK.sub(join, text)


def indented(block: str) -> bool:
    """Every line that isn't blank starts with four spaces."""
    return all(line.startswith("    ") for line in block.split("\n") if line.strip())


def paragraphs(text: str) -> list[str]:
    """Parts between blank lines, without newlines at their ends; blank parts are left out."""
    parts = re.split(r"\n\s*\n", re.sub("\r\n?", "\n", text))
    return [p.strip("\n") for p in parts if p.strip()]


def visual_blocks(text: str) -> list[str]:
    """Paragraphs, with neighbouring indented ones taken together."""
    return ["\n\n".join(run) for fixed, group in groupby(paragraphs(text), indented) for run in ([list(group)] if fixed else [[p] for p in group])]


def grammar_points(block: str) -> int:
    """How much a block looks like a grammar; ``ABNF_LEAST`` and more is one."""
    rules = len(_RULE.findall(block))
    points = X.ABNF_RULE_POINTS * rules + sum(n for p, n in _SIGNALS if p.search(block))
    return points + (X.ABNF_BRACKET_POINTS if rules < 2 and "[" in block and "]" in block else 0)


class _Head(NamedTuple):
    """What tells a header: the first line, whether the second underlines it, the lines that aren't blank, and the pattern with its match."""

    first: str
    ruled: bool
    held: int
    kind: str
    match: re.Match | None


_KINDS = {"numeric": _NUMERIC, "appendix": _APPENDIX, "roman": _ROMAN}
# What a header's patterns and form are worth.
_KIND_POINTS = {"unnumbered": 10, "numeric": 8, "appendix": 9, "roman": 7, "none": 0}
_FORM_POINTS = [
    (10, lambda h: h.ruled),
    (4, lambda h: h.first.isupper() and len(h.first) < 60),
    (4, lambda h: h.held == 1 + h.ruled or h.held == 1),
    (-6, lambda h: h.first[-1:] in (",", ";") or bool(_JOINER.search(h.first.lower()))),
    (-12, lambda h: len(h.first) > 120),
]


def _head(block: str) -> _Head:
    lines = [line.strip() for line in block.split("\n")]
    first = lines[0]
    kind, match = ("unnumbered", None) if _UNNUMBERED.match(_key(first)) else next(((k, m) for k, p in _KINDS.items() if (m := p.match(first))), ("none", None))
    return _Head(first, len(lines) > 1 and bool(_RULED.match(lines[1])), sum(map(bool, lines)), kind, match)


def header_points(block: str) -> int:
    """Points of a block's first line as a section header: its pattern, then its form; a blank first line has none."""
    return _points(_head(block))


def _points(h: _Head) -> int:
    return _KIND_POINTS[h.kind] + sum(n for n, holds in _FORM_POINTS if holds(h)) if h.first else 0


def header(block: str, doc_id: int) -> tuple[str, int, str, str] | None:
    """(first line, depth, title, what follows) of a block that starts with a section header, else None. A title that runs into its paragraph ends where a sentence or a wide gap does, unless it would have more than six words."""
    h = _head(block)
    if not h.first or _points(h) < (10 if doc_id >= _MODERN_FROM else 8):
        return None
    rest = block.split("\n")[1 + h.ruled :]
    title, prose, depth = h.first, "", 1
    if h.match:
        title = h.match.group(2).strip()
        gap = _SQUASHED.search(title)
        if gap and len(title[: gap.start()].split()) <= 6:
            title, prose = title[: gap.start()].strip(), title[gap.end() :].strip()
        depth = 1 if h.kind == "roman" else 1 + h.match.group(1).split()[-1].count(".")
    follows = "\n".join(rest).strip()
    return h.first, depth, title.strip() or h.first, "\n".join(x for x in (prose, follows) if x)


class _Outline:
    """Where the reader stands: titles by number, the last title of each depth, and whether the back matter has begun."""

    def __init__(self) -> None:
        self.by_number: dict[str, str] = {}
        self.open: list[str] = []
        self.back = False

    def enter(self, first: str, depth: int, title: str) -> list[str]:
        appendix = _APPENDIX.match(first)
        numbered = _NUMERIC.match(first)
        level = lambda i: self.open[i] if i < len(self.open) else f"Untitled Level {i + 1}"
        if numbered or appendix:
            lead = "" if numbered else "appendix "
            parts = (numbered.group(1) if numbered else re.sub(r"(?i)^appendix\s+", "", appendix.group(1)).lower()).split(".")
            own = numbered.group(1) if numbered else appendix.group(1).lower()
            self.by_number[own] = title
            path = [self.by_number.get(lead + ".".join(parts[: i + 1]), level(i)) for i in range(len(parts))]
        else:
            path = [*(level(i) for i in range(depth - 1)), title]
        if appendix or _key(first) in S.BACK_MATTER:
            self.back = True
        elif re.match(r"^\d+\.", _key(first)):
            self.back = False
        self.open = path
        return ["Back", *path] if self.back else path


def parse(doc_id: int, content: str) -> Iterator[dict]:
    """Blocks of a document in order."""
    outline, path = _Outline(), ["Document Root"]
    todo = visual_blocks(without_pages(content))[::-1]
    while todo:
        block = todo.pop().strip("\n")
        if not block.strip():
            continue
        if found := header(block, doc_id):
            first, depth, title, follows = found
            path = outline.enter(first, depth, " ".join(title.split()).strip(".:- ") or "Untitled Section")
            if follows.strip():
                todo.append(follows)
            continue
        kind = "prose" if not indented(block) else "abnf" if grammar_points(block) >= X.ABNF_LEAST else "artwork"
        where = " > ".join(path)
        low = where.lower()
        refined = kind if kind != "prose" else "security" if "security considerations" in low else "references" if "references" in low else kind
        yield {
            "hierarchy_path": where, "block_type": refined, "source_type": "txt", "normalized_text": " ".join(block.split())
                if kind == "prose" else block, "source_fragment": block,
            "parsing_confidence": 0.8 if doc_id >= _MODERN_FROM else 0.6,
        }
