"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest vocabulary piece at each place of a word. The automaton gives the
number of pieces in one pass over the code points without building any piece: a trie of the vocabulary in which each
node knows the node reached when no edge fits (its failure link) and how many pieces leaving by that link completes
(its popped count). Words are separated by white space; each starts with the word mark, so pieces that begin with the
mark are word-initial and others continue a word. A code point that no piece holds counts as its UTF-8 bytes.

Nulls: a null text has no words and no tokens. Repeated rows give repeated results, an empty table an empty one. Only
the id and text columns are read. Memory: the automaton, and for each task a cache of at most `CACHED` words of up to `LONGEST_CACHED` code points.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracklark.llm.batches import per_row
from tracklark.session import table

MARK = "▁"
CACHED, LONGEST_CACHED = 1 << 17, 40
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def pieces_of(path: str = TOKENIZER) -> list[str]:
    """The ordinary pieces of a SentencePiece model, read by the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]


class Automaton:
    """goto: the edges of each node; node 0 is the root. link and popped: what leaving a node without an edge does."""

    def __init__(self, pieces: Iterable[str]):
        vocabulary = {p for p in pieces if p}
        # Single code points inside pieces that are no pieces themselves act as pieces of their byte count.
        weight = {c: len(c.encode("utf-8", "surrogatepass")) for p in vocabulary for c in p} | dict.fromkeys(vocabulary, 1)
        self.goto: list[dict[str, int]] = [{}]
        self.link, self.popped, tokens, level = [0], [0], {}, []
        for piece in sorted(weight):
            node = 0
            for c in piece:
                if c not in self.goto[node]:
                    self.goto[node][c] = len(self.goto)
                    self.goto.append({})
                node = self.goto[node][c]
            tokens[node] = weight[piece]
        self.link, self.popped = [0] * len(self.goto), [0] * len(self.goto)
        level = [0]
        while level:
            below = []
            for parent in level:
                for c, node in self.goto[parent].items():
                    below.append(node)
                    if node in tokens:
                        self.popped[node] = tokens[node]
                        continue
                    total, at = self.popped[parent], self.link[parent]
                    while c not in self.goto[at]:
                        total += self.popped[at]
                        at = self.link[at]
                    self.link[node], self.popped[node] = self.goto[at][c], total
            level = below

    def count(self, word: str) -> int:
        """The number of greedy pieces of one word, its mark included."""
        goto, link, popped = self.goto, self.link, self.popped
        total = node = 0
        for c in MARK + word:
            after = goto[node].get(c)
            while after is None:
                if not node:
                    total += len(c.encode("utf-8", "surrogatepass"))
                    after = 0
                    break
                total += popped[node]
                node = link[node]
                after = goto[node].get(c)
            node = after
        while node:
            total += popped[node]
            node = link[node]
        return total


_made: dict[str, Automaton] = {}


def counter(shared) -> Automaton:
    """The automaton of a broadcast vocabulary, built once in each Python worker."""
    if shared.id not in _made:
        _made.clear()
        _made[shared.id] = Automaton(shared.value)
    return _made[shared.id]


class Shared:
    """A broadcast vocabulary with a key that is the same on all workers."""

    def __init__(self, spark: SparkSession, pieces: list[str]):
        self.broadcast = spark.sparkContext.broadcast(pieces)
        self.id = uuid.uuid4().hex

    @property
    def value(self) -> list[str]:
        return self.broadcast.value


def token_counts(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", most_pieces: int = 1_000_000) -> DataFrame:
    """doc_id, n_words and n_tokens of each row. The vocabulary is broadcast; one of over `most_pieces` is refused."""
    if len(pieces) > most_pieces:
        raise ValueError(f"{len(pieces)} pieces are more than {most_pieces}")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = Shared(docs.sparkSession, pieces)

    def start():
        count, known = counter(shared).count, {}

        def row(doc_id, text):
            words, total = text.split() if text else (), 0
            for w in words:
                n = known.get(w)
                if n is None:
                    if len(known) >= CACHED:
                        known.clear()
                    n = count(w)
                    if len(w) <= LONGEST_CACHED:
                        known[w] = n
                total += n
            return doc_id, len(words), total

        return row

    return per_row(narrow, StructType([narrow.schema["doc_id"], *StructType.fromDDL("n_words long, n_tokens long")]), start)


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Word-piece lengths of all documents."""
    return token_counts(table(spark, sf_dir, "documents"), pieces_of(tokenizer))


QUERIES = {"op8_token_counts": op8_token_counts}
