"""Per-document text quality statistics, and how much of a text is running prose."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Thresholds of the rules for prose. They were set on rated documents (see the README); none of them knows a language.
#: Letters that make a word short, and the share of short words that running text has: articles, prepositions and the like, in most languages.
SHORT_WORD, FEW_SHORT, MANY_SHORT = 3, 0.15, 0.75
#: Words from which a passage can be told by its short words, and from which its words must recur as well.
LEAST_WORDS, LONG_PASSAGE = 5, 60
#: Share of tokens that are words as written, with nothing but letters inside, and the mean length of words.
CLEAN_TOKENS, MEAN_LENGTH = 0.7, (2.5, 13.0)
#: Separators within or before a word, for each token, from which a passage isn't writing.
ASTRAY = 0.05
#: Words of a sentence at most, for passages that show sentences by capital and full stop alone.
LONGEST_SENTENCE = 60
#: Share of a long passage's short words that may occur once only; random letters hardly repeat a word.
FRESH_SHORT = 0.75
#: Words of the grams whose repetition is measured, and of the dominant gram.
REPEAT_GRAM, TOP_GRAM = 8, 3
#: Letters of scripts without spaces that stand for one word.
LETTERS_A_WORD = 2

_WORD = re.compile(r"[^\W\d_]+")
#: Marks that may stand at or within a word as written.
_BESIDE = dict.fromkeys(map(ord, "()[]\"'«»„“”‘’¿¡.,;:!?-"))
_ASTRAY = re.compile(r"[,;](?:(?<=[^\W\d_][,;])(?=[^\W\d_])|(?<=\s[,;]))")
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]")
_SENTENCE_END = re.compile("(?<=[.!?])[\"'”»)\\]]*\\s+|(?<=[。！？])")
_DIGITS = re.compile(r"\d+")
_QUOTE = re.compile(r"^\s*(?:[>|]\s?)*\s*>\s?")
_MARK = re.compile(r"^\s*(?:[-*+•·◦‣–—o]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+(?=\S)")
_GAPS = re.compile(r"\S(?: {2,}|\t)(?=\S)")
_BLANK = re.compile(r"\n\s*\n")
_NOT_DIGITS = bytes(i for i in range(256) if not 48 <= i <= 57)
_INVISIBLE = re.compile("[\xad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")
#: Letters that come from reading UTF-8 as another encoding, and replacement characters.
_BROKEN = re.compile("[\xc3\xc2](?![A-Za-z])|\xe2\u20ac|\ufffd")

SCHEMA = (
    "doc_id long, n_words long, n_lines long, mean_word_length double, symbol_ratio double, punct_line_share double, short_word_share double, "
    "list_line_share double, table_line_share double, dup_line_share double, dup_paragraph_share double, repeated_ngram_share double, top_ngram_share double, prose_share double"
)


def plain(text: str) -> str:
    """Compatibility forms as plain ones, without invisible characters."""
    return text if text.isascii() else unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))


def _is_table(line: str, n_words: int) -> bool:
    if line.count("|") >= 2 or line.count("\t") >= 2:
        return True
    cells = max(line.count(";"), line.count(",") - line.count(", "))
    return cells >= 2 and cells + 1 >= n_words / 2 or n_words <= 12 and "  " in line and len(_GAPS.findall(line)) >= 2


def _runs(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all runs of ``n`` words within one text, ordered so that equal runs of a text stand together by place, and where each group of equal ones begins."""
    count = max(0, len(hashes) - n + 1)
    with np.errstate(over="ignore"):
        key = owner[:count].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(n):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[i : i + count]
    place = np.flatnonzero(owner[:count] == owner[n - 1 : n - 1 + count])
    order = np.argsort(key[place], kind="stable")
    key, place = key[place][order], place[order]
    return place, np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))


def _covered(starts: np.ndarray, n: int, sizes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Characters, text by text, of the words that runs of ``n`` words from ``starts`` cover, each counted once."""
    marks = np.zeros(len(sizes) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + n, -1)
    return np.bincount(owner, weights=sizes * (np.cumsum(marks[:-1]) > 0), minlength=texts)


def repetition(texts: list[list[str]], repeat: int = REPEAT_GRAM, top: int = TOP_GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text, given as its words: share of its words that are short, share of the characters that stand in n-grams which the
    text has had before, and share that its most frequent n-gram covers, if it occurs twice or more (of several the one that comes first)."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    words = list(chain.from_iterable(texts))
    owner = np.repeat(np.arange(len(texts)), length)
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)  # compared within one text only
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    total = np.maximum(1, np.bincount(owner, weights=sizes, minlength=len(texts)))
    place, first = _runs(hashes, owner, repeat)
    again = _covered(place[~first], repeat, sizes, owner, len(texts))
    place, first = _runs(hashes, owner, top)
    begin = np.flatnonzero(first)
    times = np.diff(np.append(begin, len(place)))
    several = times > 1
    begin, times = begin[several], times[several]
    best = np.lexsort((place[begin], -times, owner[place[begin]]))
    mine = owner[place[begin[best]]]
    best = best[np.concatenate((np.ones(min(1, len(best)), bool), mine[1:] != mine[:-1]))]
    chosen = np.repeat(begin[best], times[best]) + np.arange(times[best].sum()) - np.repeat(np.cumsum(times[best]) - times[best], times[best])
    short = np.bincount(owner, weights=sizes <= SHORT_WORD, minlength=len(texts)) / np.maximum(1, length)
    return short, again / total, _covered(place[chosen], top, sizes, owner, len(texts)) / total


def _lengths(passage: str, words: list[str]) -> list[int]:
    """Word lengths; in scripts without spaces a word stands for every few letters."""
    if passage.isascii() or not _UNSPACED.search(passage):
        return list(map(len, words))
    out = []
    for w in words:
        out += [LETTERS_A_WORD] * -(-len(w) // LETTERS_A_WORD) if _UNSPACED.search(w) else [len(w)]
    return out


def is_prose(passage: str, words: list[str], listed: bool = False) -> bool:
    """Whether a passage is running text, by its form alone.

    Its tokens must be words as written, of usual length, with separators after words. Then it shows either a share of short words as sentences have
    it (which recur, if the passage is long), or the form of sentences: a capital or a letter without case first,
    a full stop at the end, and not more words between than a sentence has. An entry of a list must show the former.
    """
    n = _lengths(passage, words)
    unspaced = len(n) > len(words)
    if len(n) < LEAST_WORDS or not unspaced and not MEAN_LENGTH[0] <= sum(n) / len(n) <= MEAN_LENGTH[1]:
        return False
    tokens = passage.split()
    if not unspaced and (sum(map(str.isalpha, passage.translate(_BESIDE).split())) < CLEAN_TOKENS * len(tokens)
        or len(_ASTRAY.findall(passage)) > ASTRAY * len(tokens)):
        return False
    short = [w for w in words if len(w) <= SHORT_WORD]
    share = len(short) / len(n)
    if len(n) >= LONG_PASSAGE and not unspaced:
        short = " ".join(short).lower().split(" ")
        times = Counter(short)
        if sum(1 for w in short if times[w] == 1) > FRESH_SHORT * len(short):
            return False
    if not unspaced and (2 if listed else 1) * FEW_SHORT <= share <= MANY_SHORT:
        return True
    first = words[0][0]
    ended = passage.rstrip("\"'”»)]’")[-1:] in (".", "!", "?", "。", "！", "？")
    small = sum(1 for w in words if not w[0].isupper())
    sentences = max(1, sum(passage.count(c) for c in ".!?。！？"))
    return not listed and ended and (first.isupper() or not first.islower()) and 2 * small >= len(words) and len(n) <= LONGEST_SENTENCE * sentences


def measures(text: str | None) -> dict[str, float]:
    """Statistics of one text; every share is 0 for a blank or null text."""
    return measures_of([text])[0]


def measures_of(texts: list[str | None]) -> list[dict[str, float]]:
    """:func:`measures` of several texts; repetition is counted over all of them at once."""
    both = [_measures(t) for t in texts]
    for (m, _), short, again, top in zip(both, *(x.tolist() for x in repetition([w for _, w in both]))):
        m |= {"short_word_share": short, "repeated_ngram_share": again, "top_ngram_share": top}
        m["prose_share"] = min(m["prose_share"], 1 - m["dup_paragraph_share"], 1 - again, 1 - top) if m["n_lines"] else 0.0
    return [m for m, _ in both]


def _measures(text: str | None) -> tuple[dict[str, float], list[str]]:
    """What lines and passages say, and the words in lower case."""
    raw = text or ""
    text = plain(raw).replace("\r", "\n").replace("\f", "\n\n").replace("\u2028", "\n")
    digits = len(text.encode("ascii", "ignore").translate(None, _NOT_DIGITS))
    seen: set[str] = set()
    said: set[str] = set()
    total = prose = letters_all = 0
    n_lines = punct = marked = tabled = repeated = 0
    all_words: list[str] = []
    unit: list[str] = []
    unit_words: list[str] = []
    listed = False

    def close() -> None:
        """Counts the passage at hand; sentences that the text has had before don't count again, whatever their numbers."""
        nonlocal prose
        if unit:
            passage = " ".join(unit)
            if is_prose(passage, unit_words, listed):
                for s in _SENTENCE_END.split(passage):
                    key = _DIGITS.sub("0", s)
                    if key not in said:
                        said.add(key)
                        prose += len(s) - s.count(" ")
            unit.clear()
            unit_words.clear()

    for line in text.split("\n"):
        body = line.strip()
        if not body:
            close()
            continue
        if body[0] in ">|" and body[-1] != "|":
            body = _QUOTE.sub("", body).strip() or body
        n_lines += 1
        solid = len(body) - body.count(" ")
        words = _WORD.findall(body)
        n = len(words)
        letters = sum(map(len, words))
        all_words += words
        letters_all += letters
        total += solid
        punct += body[-1] in ".!?:;\"')。»"
        key = body.lower()
        again = key in seen
        seen.add(key)
        repeated += again
        mark = bool(_MARK.match(body))
        table = _is_table(body, n)
        marked += mark
        tabled += table
        if again or table or letters < 0.6 * solid or mark and n < 8 or not unit and n < LEAST_WORDS and not _UNSPACED.search(body):
            close()
            continue
        if mark:
            close()
        if not unit:
            listed = mark
        unit.append(body)
        unit_words += words
    close()
    broken = len(_BROKEN.findall(raw)) if any(c in raw for c in "\xc3\xc2\xe2\ufffd") else 0
    if broken >= max(5, 0.15 * len(all_words)):  # unreadable, whatever it says
        prose = 0
    paragraphs = [p.strip() for p in _BLANK.split(text) if p.strip()]
    dup = sum(len(p) * (c - 1) for p, c in Counter(paragraphs).items()) / max(1, sum(map(len, paragraphs)))
    share = prose / total if total else 0.0
    return {
        "n_words": len(all_words),
        "n_lines": n_lines,
        "mean_word_length": letters_all / len(all_words) if all_words else 0.0,
        "symbol_ratio": max(0.0, 1 - (letters_all + digits) / total) if total else 0.0,
        "punct_line_share": punct / n_lines if n_lines else 0.0,
        "list_line_share": marked / n_lines if n_lines else 0.0,
        "table_line_share": tabled / n_lines if n_lines else 0.0,
        "dup_line_share": repeated / n_lines if n_lines else 0.0,
        "dup_paragraph_share": dup,
        "prose_share": share,
    }, " ".join(all_words).lower().split(" ") if all_words else []


def text_quality(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of measures per distinct ``doc_id`` (null ids are dropped, the least text counts if an id has several).

    ``prose_share`` is the share of a text's characters, white space aside, that stand in running prose. Lines of mostly
    letters that are neither table rows nor short list entries nor repetitions are joined to passages within their
    paragraph; a passage is prose by the form of its words and sentences (:func:`is_prose`), in any language, and a sentence
    that the text has had before, numbers aside, doesn't count again. Repetition bounds it once more: the share never
    exceeds what duplicate paragraphs, repeated n-grams and the dominant n-gram leave. Every share lies between 0 and 1. A
    null or blank text has 0 in every measure. Other columns are ignored.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64() if c.endswith("long") else pa.float64() for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [m for at in range(0, b.num_rows, 500) for m in measures_of(b.column(1).slice(at, 500).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[c] for r in rows], t) for c, t in zip(names[1:], types[1:]))], names)

    docs = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    measured = docs.mapInArrow(run, SCHEMA)
    return measured.groupBy("doc_id").agg(F.max(F.struct(*names[1:])).alias("x")).select("doc_id", "x.*")
