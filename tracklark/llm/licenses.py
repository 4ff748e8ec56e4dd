"""License scan: fuzzy search for short notices.

Each text becomes lower-cased words joined by single spaces. A notice that may differ in k edits is cut into k + 1
pieces; by the pigeonhole principle one piece stands unchanged in every occurrence within k edits, so exact finds of
the pieces give all candidate windows. In each window the `regex` library's bounded-error matching verifies the edits
(insertions, deletions and substitutions of code points) between word boundaries. Exact places are all reported; fuzzy
ones do not overlap them or each other, and every place within the bound of edits overlaps one that is reported.
Windows have a bounded length, so the time is in proportion to a text's length. Everything happens inside one text, so
nothing is shuffled.

Nulls: a null text counts as empty: no words, no labels, score 0. Repeated rows give repeated results and an empty
table an empty one. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracklark.llm.batches import per_row
from tracklark.session import table

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notices of the method.
NOTICES = BASE | {
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
#: One edit is allowed for so many code points of a notice, up to MOST_EDITS.
CODE_POINTS_PER_EDIT, MOST_EDITS = 8, 3
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(" ")


class Hit(NamedTuple):
    """A verified place in the joined words: code points `start` to `end`."""

    notice: str
    start: int
    end: int
    edits: int


class Searcher(NamedTuple):
    """A notice made ready: its pieces with their offsets, and the bounded-error pattern."""

    notice: str
    most: int
    pieces: list[tuple[int, str]]
    pattern: regex.Pattern


@cache
def searcher(notice: str) -> Searcher:
    most = min(len(notice) // CODE_POINTS_PER_EDIT, MOST_EDITS)
    cuts = [len(notice) * k // (most + 1) for k in range(most + 2)]
    pieces = [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]
    pattern = regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={most}}}(?![^ ])")
    return Searcher(notice, most, pieces, pattern)


def lowered(text: str) -> str:
    """A to Z in lower case; positions stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def seeds(s: Searcher, joined: str) -> list[tuple[int, int]]:
    """The parts of the joined words around each exact find of a piece that can hold an occurrence, by start."""
    found = []
    for offset, piece in s.pieces:
        p = joined.find(piece)
        while p >= 0:
            found.append((max(0, p - offset - s.most), min(len(joined), p - offset + len(s.notice) + s.most)))
            p = joined.find(piece, p + 1)
    return sorted(set(found))


@lru_cache(1 << 14)
def best_match(notice: str, part: str) -> tuple[int, int, int] | None:
    """Start, end and edits of the match with the fewest edits in a short part."""
    m = searcher(notice).pattern.search(part)
    return (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None


def fuzzy(s: Searcher, joined: str, exact: list[int]) -> Iterator[Hit]:
    """Matches with edits, left to right, that overlap neither each other nor the exact places.

    A part is too short for two matches that do not overlap, so every place within the bound of edits overlaps a match.
    """
    free, k = 0, 0
    # Signs that no word holds stand for what is cut off a word at an end of a part; no match can take them all in.
    cut = "\0" * (s.most + 2)
    for a, b in seeds(s, joined):
        while k < len(exact) and exact[k] + len(s.notice) <= a:
            k += 1
        a = max(a, free)
        for j in range(k, len(exact) + 1):
            # The free parts between exact places, each without the space at its end.
            end = min(b, exact[j] - 1) if j < len(exact) else b
            if end - a >= len(s.notice) - s.most:
                before = cut if a and joined[a - 1] != " " else ""
                m = best_match(s.notice, before + joined[a:end] + (cut if end < len(joined) and joined[end] != " " else ""))
                if m:
                    p, q = a + m[0] - len(before), a + m[1] - len(before)
                    yield Hit(s.notice, p, q, m[2])
                    free = a = max(free, q)
            if j == len(exact) or exact[j] >= b:
                break
            free = a = max(free, exact[j] + len(s.notice))


def hits(joined: str, notices: tuple[str, ...] = tuple(NOTICES)) -> list[Hit]:
    """All exact places of each notice, and the non-overlapping fuzzy ones between them."""
    out = []
    for notice in notices:
        s, exact, p = searcher(notice), [], joined.find(notice)
        while p >= 0:
            end = p + len(notice)
            if (p == 0 or joined[p - 1] == " ") and (end == len(joined) or joined[end] == " "):
                exact.append(p)
            p = joined.find(notice, p + 1)
        out += [Hit(notice, p, p + len(notice), 0) for p in exact]
        if s.most:
            out += fuzzy(s, joined, exact)
    return out


def word_starts(joined: str) -> list[int]:
    """Where the words begin."""
    return [0, *(m.end() for m in SPACE.finditer(joined))]


def found(text: str | None) -> tuple[list[str], str, list[Hit]]:
    """The words, the joined words and the hits of a text."""
    words = WORD.findall(lowered(text)) if text else []
    joined = " ".join(words)
    return words, joined, hits(joined) if words else []


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id and an array of spans (label, notice, start, end, edits), in code points of the text."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = StructType([narrow.schema["doc_id"], *StructType.fromDDL("spans array<struct<label:string,notice:string,start:long,end:long,edits:int>>")])

    def start():
        def row(doc_id, text):
            _, joined, there = found(text)
            if not there:
                return doc_id, []
            at, starts = [m.span() for m in WORD.finditer(lowered(text))], word_starts(joined)
            word = lambda p: bisect_right(starts, p) - 1
            return doc_id, [
                {"label": NOTICES[h.notice], "notice": h.notice, "start": at[word(h.start)][0], "end": at[word(h.end - 1)][1], "edits": h.edits}
                for h in sorted(there, key=lambda h: (h.start, h.end, h.notice))
            ]

        return row

    return per_row(narrow, kind, start)


def op4_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the search over all documents."""
    narrow = table(spark, sf_dir, "documents").select("doc_id", "text")

    def start():
        def row(doc_id, text):
            words, joined, there = found(text)
            base = [h for h in there if h.notice in BASE and not h.edits]
            starts = word_starts(joined) if base else []
            places = [bisect_left(starts, h.start) for h in base]
            labels = lambda some: ",".join(sorted({NOTICES[h.notice] for h in some}))
            score = max((1 - h.edits / len(h.notice) for h in there), default=0.0)
            return doc_id, len(words), len(base), min(places, default=None), max(places, default=None), labels(base), labels(there), score

        return row

    kind = StructType(
        [narrow.schema["doc_id"], *StructType.fromDDL("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")]
    )
    return per_row(narrow, kind, start)


QUERIES = {"op4_license_notices": op4_license_notices}
