"""Column functions over texts, paths and identifiers; all stay inside the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan import schemas as S

#: White space as Python's str.split() takes it.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0  -     　]"

# Patterns of headers, grammar and requirement words.
KEYWORD_PATTERN = r"\b(MUST\s+NOT|MUST|REQUIRED|SHALL\s+NOT|SHALL|SHOULD\s+NOT|SHOULD|NOT\s+RECOMMENDED|RECOMMENDED|MAY|OPTIONAL)\b"
UNNUMBERED_HEADER = r"(?i)^(?:abstract|status\s+of\s+this\s+memo|table\s+of\s+contents|introduction|security\s+considerations|references|authors?'?s?'?\s+addresses?|acknowledgements?)$"
NUMERIC_HEADER = r"^([0-9]+(?:\.[0-9]+)*)(?:\.|\s+)(.*)$"
APPENDIX_HEADER = r"(?i)^(Appendix\s+[A-Z0-9]+(?:\.[0-9]+)*)(?:\.|\s+|-*)(.*)$"
ROMAN_HEADER = r"(?i)^(?=[MDCLXVI])(M*(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))\.\s+(.*)$"
ABNF_SIGNALS = [
    (r"::=", 8), (r" =/ ", 8), (r"%[xdb][0-9a-fA-F.-]+", 6), (r"\b\d*\*+\d*[a-zA-Z]|\b\d+[a-zA-Z]", 4),
        (r"\b(CRLF|DIGIT|ALPHA|HEXDIG|DQUOTE|SP|WSP|OCTET|VCHAR|HTAB|BIT|CHAR|CTL)\b", 3),
    (r"(?m)^\s*(?:if|export|set|chown|chmod)\b", -8),
]
ABNF_RULE, ABNF_RULE_POINTS, ABNF_BRACKET_POINTS, ABNF_LEAST = r"(?m)^\s*[a-zA-Z0-9-]+\s*=\s*", 2, -5, 8
STATEMENT_LEAST = 12


def collapse_spaces(c: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip_spaces(c: Column | str) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column | str) -> Column:
    """True for null and for white space alone."""
    return F.length(strip_spaces(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")))) == 0


def document_number(c: Column | str) -> Column:
    """The digits after 'RFC' anywhere in a text, 0 where there are none or too many for an integer."""
    return F.coalesce(F.regexp_extract(c, r"(?i)RFC(\d+)", 1).try_cast("int"), F.lit(0))


def month_number(c: Column | str) -> Column:
    """Month of a name, an abbreviation or a season, null if unknown."""
    low = F.lower(F.trim(c))
    out = F.lit(None).cast("int")
    for prefix, n in reversed(S.MONTHS.items()):
        out = F.when(low.startswith(prefix), n).otherwise(out)
    return out


def refined_type(kind: Column, path: Column) -> Column:
    """Prose under security considerations or references gets their type; other types stay."""
    low = F.lower(path)
    special = F.when(low.contains("security considerations"), "security").when(low.contains("references"), "references")
    return F.when(kind == "prose", F.coalesce(special, kind)).otherwise(kind)


def final_type(kind: Column) -> Column:
    """'prose' is a paragraph, and so is anything unknown."""
    return F.when(kind.isin(S.BLOCK_TYPES), kind).otherwise(F.lit("paragraph"))


def route_of(kind: Column) -> Column:
    """Route of a block type: paragraphs, lists and unknown types go to prose, the others to a route of their name."""
    return F.when(kind.isin([t for t in S.BLOCK_TYPES if t in S.ROUTES]), kind).otherwise(F.lit("prose"))


def is_exempt(path: Column) -> Column:
    """Whether requirements in a section don't count: anything under 'back', and sections of fixed names."""
    parts = F.split(path, " > ")
    last = F.lower(F.trim(F.regexp_replace(F.element_at(parts, -1), r"(?i)^(appendix\s+[a-z0-9.]+\s*)", "")))
    return F.array_contains(F.transform(parts, F.lower), "back") | last.isin(S.EXEMPT_SECTIONS)


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def statements(c: Column) -> Column:
    """One struct per requirement word of each sentence of twelve characters or more: the word's class and the sentence."""
    words = F.create_map(*[F.lit(x) for x in chain(*S.KEYWORDS.items())])
    long = F.filter(sentences(c), lambda s: F.length(strip_spaces(s)) >= STATEMENT_LEAST)
    found = lambda s: F.transform(F.regexp_extract_all(s, F.lit(KEYWORD_PATTERN), F.lit(1)),
        lambda k: F.struct(words[collapse_spaces(k)].alias("keyword"), strip_spaces(s).alias("statement_text")))
    return F.flatten(F.transform(long, found))


def kept_statements(stmts: Column, fragment: Column) -> Column:
    """Statements whose whole text stands in the fragment."""
    return F.filter(stmts, lambda s: fragment.contains(s["statement_text"]))


def section_parts(path: Column, number: Column, doc: Column) -> Column:
    """Struct of section_id, token and title of a path; unnumbered sections get a token from a hash of document and path."""
    last = F.element_at(F.split(path, " > "), -1)
    head = F.substring_index(last, " ", 1)
    numbered = last.contains(" ") & head.rlike(r"\d")
    rest = F.regexp_replace(last, r"^[^ ]* ", "")
    given = F.regexp_replace(number, r"^\.+|\.+$", "")
    hashed = F.concat(F.lit("secunknown-"), F.substring(F.sha2(F.concat(doc.cast("string"), F.lit(":"), path), 256), 1, 8))
    preface = F.lower(path).isin("document root", "preface")
    has_number = F.length(F.coalesce(number, F.lit(""))) > 0
    return F.struct(
        F.when(preface, "preface").when(has_number, given).when(numbered, head).otherwise("unknown").alias("section_id"),
        F.when(preface, "preface").when(has_number, F.concat(F.lit("sec"), given))
            .when(numbered, F.concat(F.lit("sec"), F.regexp_replace(head, r"^\.+|\.+$", ""))).otherwise(hashed).alias("token"),
        F.when(preface, path).when(has_number, strip_spaces(last)).when(numbered, strip_spaces(rest)).otherwise(strip_spaces(last)).alias("title"),
    )


def preview(c: Column, chars: int = 120) -> Column:
    """The beginning of a text on one line."""
    return F.substring(F.replace(c, F.lit("\n"), F.lit(" ")), 1, chars)


def _ascii_json(quoted: Column) -> Column:
    """JSON text with every character beyond ASCII as an escape of four hex digits, two of them beyond the basic plane."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(ch: Column) -> Column:
        n = F.ascii(ch)
        high, low = F.lit(0xD800) + F.shiftright(n - 0x10000, 10), F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(n < 128, ch).when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high), unit(low)))

    return F.when(quoted.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(quoted, ""), escaped), "")).otherwise(quoted)


def statements_json(stmts: Column) -> Column:
    """Statements as JSON text in ASCII, with a space after each comma and colon; a null array is an empty list."""
    quoted = lambda x: _ascii_json(F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1))
    one = lambda s: F.concat(F.lit('{"keyword": '), quoted(s["keyword"]), F.lit(', "statement_text": '), quoted(s["statement_text"]), F.lit("}"))
    given = F.coalesce(stmts, F.array().cast("array<struct<keyword:string,statement_text:string>>"))
    return F.concat(F.lit("["), F.array_join(F.transform(given, one), ", "), F.lit("]"))


def required_int(c: Column, name: str) -> Column:
    """A whole number that must be there: reading a row without one fails with the column's name."""
    n = c.try_cast("int")
    return F.when(n.isNotNull(), n).otherwise(F.raise_error(F.concat(F.lit(f"{name}: not a whole number: "),
        F.coalesce(c.cast("string"), F.lit("null")))).cast("int"))
