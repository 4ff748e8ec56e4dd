"""Benchmark decontamination with a generalised suffix automaton.

Words of the test items (lower-cased A to Z, runs of letters, digits and signs beyond ASCII) build one automaton over
all items. A document's words stream through it once while the length of the longest match that ends at each word is
tracked. A match of `window` words or more ends an occurrence of an item's window; an item shorter than the window, but
not empty, counts when all of it occurs.

Scale: documents are never shuffled. Items come to the driver a block at a time, at most `BLOCK_WORDS` words each, and
every block's automaton goes over the documents in its own pass that adds to what the passes before found. Where
the items' bytes don't rule out a second block, a bit table of all windows' numbers (2^23 to 2^27 bits, filled block by
block) goes first, in one pass: only documents that hold a window in the table, a superset of those that hold an item's
window, are written out and searched by the automata. A longer item is cut into pieces that overlap by a window. Items
are read twice at most.

Nulls: a null text has no words; items without words or with a null id are left out. Repeated documents give repeated
rows; repeated item ids count once. No items: nothing is hit. Columns besides the id and text pass through `remove`
untouched whatever their names.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tracklark.llm.batches import per_row
from tracklark.llm.jaccard import fitting_bits, in_table
from tracklark.llm.shingles import U, mix
from tracklark.session import discard, materialize, table

WINDOW = 10
BLOCK_WORDS = 100_000
PASSES = 2
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


class SuffixAutomaton:
    """All parts of all items. edges, link and length by state; state 0 is the empty match.

    whole: the nearest state up the links, this one included, at which a short item is whole. wide: the state that
    holds the last `window` words of a match. items: of those states, the ids of the items they occur in.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.edges: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str]] = []
        short: dict[int, set[str]] = {}
        for name, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
                ends.append((last, name))
            if words and len(words) < window:
                short.setdefault(last, set()).add(name)
        size = len(self.edges)
        self.wide, self.whole = [-1] * size, [-1] * size
        self.items: dict[int, set[str]] = {k: set(v) for k, v in short.items()}
        for s in sorted(range(size), key=self.length.__getitem__):
            up = self.link[s]
            self.whole[s] = s if s in short else (self.whole[up] if up >= 0 else -1)
            if self.length[s] >= window:
                self.wide[s] = self.wide[up] if self.length[up] >= window else s
        for s, name in ends:
            if self.wide[s] >= 0:
                self.items.setdefault(self.wide[s], set()).add(name)

    def _add(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.edges.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.edges) - 1

    def _split(self, at: int, word: bytes, to: int) -> int:
        """The state for `at`'s longest match with `word`, parted from the longer matches of `to` if need be."""
        if self.length[to] == self.length[at] + 1:
            return to
        part = self._add(self.length[at] + 1, dict(self.edges[to]), self.link[to])
        self.link[to] = part
        while at >= 0 and self.edges[at].get(word) == to:
            self.edges[at][word] = part
            at = self.link[at]
        return part

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.edges[last]:
            return self._split(last, word, self.edges[last][word])
        new = self._add(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.edges[at]:
            self.edges[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word, self.edges[at][word])
        return new

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, last word + 1, item ids) of each occurrence, by its end."""
        edges, link, length, wide, whole, window = self.edges, self.link, self.length, self.wide, self.whole, self.window
        state = run = 0
        for k, w in enumerate(words):
            to = edges[state].get(w)
            if to is None:
                while to is None and state:
                    state = link[state]
                    to = edges[state].get(w)
                run = length[state]
                if to is None:
                    continue
            state = to
            run += 1
            if run >= window:
                yield k + 1 - window, k + 1, self.items[wide[state]]
            at = whole[state]
            if at == state and run < length[at]:
                at = whole[link[at]]
            while at > 0:
                yield k + 1 - length[at], k + 1, self.items[at]
                at = whole[link[at]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items with words, by blocks of bounded size; the driver holds one block."""
    block, size = [], 0
    for name, text in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).where(F.col(id_col).isNotNull()).toLocalIterator():
        words = words_of(bytes(text)) if text is not None else []
        step = max(1, most - window + 1)
        for at in range(0, max(1, len(words) - window + 1), step):
            piece = words[at : at + most]
            if block and size + len(piece) > most:
                yield block
                block, size = [], 0
            if piece:
                block.append((name, piece))
                size += len(piece)
    if block:
        yield block


_made: dict[str, SuffixAutomaton] = {}


def automaton(key: str, shared, window: int) -> SuffixAutomaton:
    """Built once for each block in a Python worker; a few are kept."""
    if key not in _made:
        if len(_made) >= PASSES:
            _made.clear()
        _made[key] = SuffixAutomaton(shared.value, window)
    return _made[key]


#: What the passes add to: hit spans of words, the ids of items, and the number of words.
FOUND = "hit array<struct<start:int,end:int>>, items array<string>, n_words long"


def with_hits(docs: DataFrame, keep: list[str], text_col: str, items: DataFrame, item_id: str, item_text: str, window: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each row as (row: its columns named in `keep`, hit, items, n_words)."""
    spark = docs.sparkSession
    found = lambda: blocks(items, item_id, item_text, window, block_words)
    # Two bytes make a word at most; a piece repeats less than a window of the one before.
    words = items.agg(F.sum(F.octet_length(F.col(item_text).cast("binary")) / 2 + 1)).first()[0] or 0
    several = words > block_words
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    kind = StructType([*rows.schema, *StructType.fromDDL(FOUND)])
    done = rows.withColumns({"hit": F.lit(None).cast("array<struct<start:int,end:int>>"), "items": F.lit(None).cast("array<string>"), "n_words": F.lit(None).cast("long")})
    clean = None
    if several:
        marked, _ = materialize(suspects(rows, found(), window, fitting_bits(2 * int(words))))
        clean = marked.where("NOT suspect").select("row", "hit", "items", "n_words")
        done = marked.where("suspect").drop("suspect")
    k, sent, held = 0, [], []
    for block in found():
        k, shared = k + 1, spark.sparkContext.broadcast(block)
        sent.append(shared)
        del block  # the driver holds no more than the next one

        def start(key=uuid.uuid4().hex, shared=shared):
            auto = automaton(key, shared, window)

            def row(row, text, hit, names, _):
                words = words_of(text)
                more = [*auto.matches(words)]
                if not more:
                    return row, text, hit or [], names or [], len(words)
                spans = merged([(a, b) for a, b, _ in more] + [(s["start"], s["end"]) for s in hit or ()])
                known = sorted(set(names or ()).union(*(x for _, _, x in more)))
                return row, text, [{"start": a, "end": b} for a, b in spans], known, len(words)

            return row

        done = per_row(done, kind, start)
        if several and not k % PASSES:
            done, path = materialize(done)
            for one in sent:
                one.destroy()
            discard(spark, *held)
            sent, held = [], [path]
    if not k:
        done = per_row(done, kind, lambda: lambda row, text, *_: (row, text, [], [], len(words_of(text))))
    done = done.drop("text")
    return done if clean is None else done.unionByName(clean)


def suspects(rows: DataFrame, found: Iterator[list[tuple[str, list[bytes]]]], window: int, bits: int) -> DataFrame:
    """The rows (row, text) ready for the passes, and whether they hold a window that can be an item's."""
    lengths, table = set(), np.zeros(1 << (bits - 6), U)
    for block in found:
        for _, words in block:
            lengths.add(min(len(words), window))
            place = window_numbers(word_numbers(words), min(len(words), window)) >> U(64 - bits)
            np.bitwise_or.at(table, (place >> U(6)).astype(np.intp), U(1) << (place & U(63)))
        del block, words
    shared = rows.sparkSession.sparkContext.broadcast((table, sorted(lengths)))

    def start():
        table, lengths = shared.value

        def row(row, text):
            words = words_of(text)
            own = word_numbers(words)
            held = any(in_table(table, window_numbers(own, m).view(np.int64)).any() for m in lengths if m <= len(words))
            return row, text if held else None, [], [], len(words), held

        return row

    return per_row(rows, StructType([*rows.schema, *StructType.fromDDL(FOUND), StructField("suspect", BooleanType())]), start)


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words have equal ones."""
    return np.array([zlib.crc32(w) << 32 | zlib.adler32(w) for w in words], U)


def window_numbers(numbers: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of so many words."""
    n = len(numbers) - length + 1
    total = np.zeros(max(n, 0), U)
    for k in range(length):
        total = mix(total + numbers[k : k + n]) if n > 0 else total
    return total


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hit spans (in words), and the sorted ids of the items found in each document."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_hits(narrow, ["doc_id"], "text", items, item_id, item_text, window)
    return found.select("row.doc_id", "n_words", "hit", "items")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in `spans` and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    parts, free = [], 0
    for a, b in spans:
        parts.append(raw[free : at[a][0]])
        free = at[b - 1][1]
    return b"".join([*parts, raw[free:]]).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most_words: int = WINDOW - 1, most_coverage: float = 0.2) -> DataFrame:
    """`docs` without contamination.

    A document of which more than `most_coverage` of the words are hit goes. From the others, hit spans of more than
    `most_words` words are cut. Cutting may close a gap between the halves of another span, so documents that were cut
    are searched again, by the same rules, until nothing is cut.
    """
    place, names = docs.columns.index(text_col), docs.columns

    def start():
        def row(row, hit, _, __):
            values = [row[c] for c in names] if row is not None else []
            spans = [(s["start"], s["end"]) for s in hit if s["end"] - s["start"] > most_words]
            if spans:
                values[place] = cut(values[place], spans)
            return tuple(values), bool(spans)

        return row

    kind = StructType([StructField("row", docs.schema), StructField("again", BooleanType())])
    out, todo = None, docs
    while True:
        found = with_hits(todo, names, text_col, items, item_id, item_text, window)
        n_hit = F.aggregate("hit", F.lit(0), lambda t, s: t + s["end"] - s["start"])
        kept = per_row(found.where((n_hit == 0) | (n_hit <= most_coverage * F.col("n_words"))), kind, start)
        if most_coverage > 0:
            kept, _ = materialize(kept)
        done = kept.where("NOT again").select("row.*")
        out = done if out is None else out.union(done)
        # With a limit of 0 no document with a hit is left to be cut.
        todo = kept.where("again").select("row.*")
        if most_coverage <= 0 or todo.isEmpty():
            return out


def op1_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of `contamination` over all documents and items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(p) WHERE len(w) > 0
),
m AS (SELECT DISTINCT m FROM iw),
dw AS (
  SELECT rid, m, p, array_to_string(w[p : p + m - 1], ' ') AS g
  FROM d, m, unnest(range(1, len(w) - m + 2)) AS t(p) WHERE len(w) >= m
),
h AS (SELECT dw.rid, dw.p, dw.m, iw.item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g),
n AS (SELECT rid, count(DISTINCT x) AS n_hit FROM h, unnest(range(p, p + m)) AS t(x) GROUP BY rid),
k AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY rid
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.rid = n.rid LEFT JOIN k ON d.rid = k.rid
"""

QUERIES = {"op1_benchmark_matches": op1_benchmark_matches}
ORACLES = {"op1_benchmark_matches": ORACLE}
