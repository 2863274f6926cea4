"""Intents and routes of a question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words by which a question's intent is told, and the routes of each intent.
INTENT_WORDS = {
    "syntax_grammar": r"(?i)\b(abnf|grammar|syntax|code|parse|format|rule|definition|header format)\b",
    "visual_structure": r"(?i)\b(diagram|figure|artwork|table|flow|state machine|chart|visual)\b",
    "security_analysis": r"(?i)\b(security|attack|vulnerabilit\w*|threats?|mitigation|tls|crypto|encryption|oauth|auth\w*|hack)\b",
    "normative_query": r"(?i)\b(must|should|may|required|shall|mandatory|normative|strict|comply|compliance)\b",
    "protocol_history": r"(?i)\b(history|obsolet\w*|updat\w*|older|version|previous|deprecated|superseded)\b",
}
INTENT_ROUTES = {"syntax_grammar": ["abnf", "sourcecode"], "visual_structure": ["artwork", "table"],
    "security_analysis": ["security"], "normative_query": ["abnf"], "protocol_history": ["references"]}
DEFAULT_INTENT, DEFAULT_ROUTE = "conceptual_explanation", "prose"
NUMBER_IN_QUESTION = r"(?i)\brfc\s*(\d+)\b"


def intents(question: Column) -> Column:
    """Sorted intents of a question; one without any clue asks for a concept."""
    found = F.array_compact(F.array(*[F.when(question.rlike(p), F.lit(name)) for name, p in INTENT_WORDS.items()]))
    return F.when(F.size(found) > 0, F.array_sort(found)).otherwise(F.array(F.lit(DEFAULT_INTENT)))


def routes(question: Column) -> Column:
    """Sorted routes to search; prose is always one of them."""
    each = [F.when(question.rlike(INTENT_WORDS[name]), F.array(*[F.lit(r) for r in rs])).otherwise(F.array().cast("array<string>"))
        for name, rs in INTENT_ROUTES.items()]
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(DEFAULT_ROUTE)), *each)))


def named_document(question: Column) -> Column:
    """The document number that a question names first, or null."""
    return F.nullif(F.regexp_extract(question, NUMBER_IN_QUESTION, 1), F.lit("")).try_cast("int")
