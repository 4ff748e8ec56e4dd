"""Ranked lexical search with MaxScore over shards of an inverted index.

Documents are indexed in shards: a shard has the ids and lengths of some thousand documents and, for each term that an
item of the block holds, the places of the documents that hold it with its occurrences there. What a term adds to a
score depends on counts of the corpus, which are summed from the shards before the search.

A search takes each shard's lists in the order of their upper bounds (the largest addition in the shard), highest
first. Lists are essential, and all their documents are scored, as long as the bounds from there on could bring a new
document among the best; the threshold is the kth score that the task has seen for the item, in earlier shards or in
part in this one. The lists behind are non-essential: they are only probed for documents which the bounds that are left
can still bring to the threshold. So a frequent word is never scored in full once rarer ones have filled the list.

Scale: texts are read once for each block of items and never shuffled. A block has at most `BLOCK_WORDS` words (or one
item) and `BLOCK_ITEMS` items; its terms, weights and items are what is broadcast, one block at a time. Each task sends its k
best documents for each item, which are ranked in two steps, first within `SALTS` parts of each item, so no task ranks
what all tasks sent for one item. The index of a block goes to the shared folder and is deleted afterwards.

Nulls: a null text has no terms, and no document without terms counts. Null ids are ranked behind others of equal score.
Rows that repeat an id are documents, or items, of their own. An item without terms, or whose terms nobody holds, gets no
rows. Empty tables give an empty table; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklark.llm.batches import mapped, slices
from tracklark.llm.decontamination import words_of
from tracklark.session import discard, materialize, table

BEST = 50
BLOCK_WORDS, BLOCK_ITEMS = 100_000, 4096
#: A shard ends with the batch that brings it to so many documents or entries of lists.
SHARD_DOCS, SHARD_ENTRIES = 8192, 1 << 20
SALTS = 32
#: Stands for a null id.
NO_ID = np.iinfo(np.int64).max


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Id and distinct terms of the items that have any, by blocks; the driver holds one."""
    block, size = [], 0
    for name, text in items.select(F.col(id_col), F.col(text_col).cast("binary")).toLocalIterator():
        terms = sorted(set(words_of(bytes(text)))) if text is not None else []
        if not terms:
            continue
        if block and (size + len(terms) > BLOCK_WORDS or len(block) >= BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((name, terms))
        size += len(terms)
    if block:
        yield block


#: A shard: its documents' ids, whether each has one, their numbers of terms; the terms' numbers, where each one's list
#: begins (one more at the end), and the lists' places of documents and occurrences, all as bytes.
SHARD = "ids binary, known binary, n binary, terms binary, starts binary, docs binary, tf binary"
KINDS = {"ids": np.int64, "known": np.bool_, "n": np.int64, "terms": np.int32, "starts": np.int64, "docs": np.int32, "tf": np.int32}


def indexed(docs: DataFrame, id_col: str, text_col: str, vocabulary) -> DataFrame:
    """The shards of all documents with terms, for the terms in the broadcast `vocabulary` (term: number)."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        ids, known, lengths, found, entries = [], [], [], [], 0
        for batch in slices(batches):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if not words:
                    continue
                held = np.array([k for k in map(number, words) if k is not None], np.int32)
                found.append(np.unique(held, return_counts=True))
                entries += len(found[-1][0])
                ids.append(NO_ID if name is None else name)
                known.append(name is not None)
                lengths.append(len(words))
            if len(ids) >= SHARD_DOCS or entries >= SHARD_ENTRIES:
                yield shard(ids, known, lengths, found)
                ids, known, lengths, found, entries = [], [], [], [], 0
        if ids:
            yield shard(ids, known, lengths, found)

    return mapped(narrow, run, SHARD)


def shard(ids: list, known: list, lengths: list, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    term = np.concatenate([t for t, _ in found])
    docs = np.repeat(np.arange(len(found), dtype=np.int32), [len(t) for t, _ in found])
    tf = np.concatenate([n for _, n in found])
    order = np.argsort(term, kind="stable")
    terms, starts = np.unique(term[order], return_index=True)
    parts = {"ids": ids, "known": known, "n": lengths, "terms": terms, "starts": np.append(starts, len(term)), "docs": docs[order], "tf": tf[order]}
    return pa.RecordBatch.from_arrays([pa.array([np.asarray(x, KINDS[c]).tobytes()], pa.binary()) for c, x in parts.items()], names=list(parts))


class Counts(NamedTuple):
    """Documents with terms, all their terms, and by term number the documents that hold it."""

    documents: int
    length: int
    holding: np.ndarray


def counted(shards: DataFrame, terms: int) -> Counts:
    """Counts of the corpus. The documents and their terms come as the numbers -1 and -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, total, length = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            for n, own, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(n, KINDS["n"])
                total, length = total + len(n), length + int(n.sum())
                out[np.frombuffer(own, KINDS["terms"])] += np.diff(np.frombuffer(starts, KINDS["starts"]))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]), pa.int32()), pa.array(np.append(out[at], [total, length]))], names=["term", "n"])

    holding, whole = np.zeros(terms, np.int64), {-1: 0, -2: 0}
    for r in mapped(shards.select("n", "terms", "starts"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r.term < 0:
            whole[r.term] = r.n
        else:
            holding[r.term] = r.n
    return Counts(whole[-1], whole[-2], holding)


def weights(counts: Counts) -> np.ndarray:
    """Of each term, 1000 times the logarithm of its rarity, rounded down; 0 for terms that nobody holds."""
    return np.array([floor(1000 * log((2 * counts.documents + 2) / (2 * int(df) + 1))) if df else 0 for df in counts.holding], np.int64)


def additions(tf: np.ndarray, n: np.ndarray, counts: Counts) -> np.ndarray:
    """What an occurrence count adds to a score for each unit of weight. n: the documents' numbers of terms."""
    tf, top = tf.astype(np.int64), 50 * int(n.max(initial=0)) * counts.documents
    share = 50 * n * counts.documents // counts.length if top < 1 << 63 else np.array([50 * int(x) * counts.documents // counts.length for x in n], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * (50 + share))


class Best:
    """The k best documents that a task has seen for one item: scores and ids, the first one the best."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.known = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A document with a lower score isn't among the best."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        scores, ids, known = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, -scores))[: self.k]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]


def searched(lists: list[tuple[np.ndarray, np.ndarray]], size: int, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the documents of a shard with a score of `least` or more, and maybe of others; none of the k
    best that reach `least` is missing.

    lists: of each term, the rising places of the documents and what it adds to them.
    """
    bounds = np.array([int(a.max()) for _, a in lists], np.int64)
    order = np.argsort(-bounds, kind="stable")
    left = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
    score, done = np.zeros(size, np.int64), 0
    for done, t in enumerate(order):
        if left[done] < least:
            break
        docs, add = lists[t]
        score[docs] += add
        if size > k:
            # k documents have this much already.
            least = max(least, int(np.partition(score, size - k)[size - k]))
    else:
        done = len(order)
    at = np.flatnonzero(score)
    for j in range(done, len(order)):
        at = at[score[at] + left[j] >= least]
        if not len(at):
            break
        docs, add = lists[order[j]]
        place = np.searchsorted(docs, at)
        place[place == len(docs)] = 0
        hit = docs[place] == at
        score[at[hit]] += add[place[hit]]
    at = at[score[at] >= least]
    return at, score[at]


def best_of_tasks(shards: DataFrame, items, k: int) -> DataFrame:
    """item (its place in the block), score and doc_id of each task's best documents. items: the broadcast (terms of each
    item, weights, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, counts = items.value
        best = [Best(k) for _ in terms]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = {c: np.frombuffer(x, KINDS[c]) for c, x in zip(batch.schema.names, row, strict=True)}
                gain = additions(s["tf"], s["n"][s["docs"]], counts) * np.repeat(weight[s["terms"]], np.diff(s["starts"]))
                lists = {t: (s["docs"][a:b], gain[a:b]) for t, a, b in zip(s["terms"].tolist(), s["starts"][:-1].tolist(), s["starts"][1:].tolist(), strict=True) if weight[t] > 0}
                for own, wanted in zip(best, terms, strict=True):
                    if held := [lists[t] for t in wanted if t in lists]:
                        at, score = searched(held, len(s["ids"]), own.least, k)
                        if len(at):
                            own.add(score, s["ids"][at], s["known"][at])
        for q, own in enumerate(best):
            if len(own.scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.ids), q, np.int32)), pa.array(own.scores), pa.array(own.ids, mask=~own.known)], names=["item", "score", "doc_id"])

    return mapped(shards.select(*KINDS), run, "item int, score long, doc_id long")


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    spark = docs.sparkSession
    kind = items.select(item_id).schema[0].dataType.simpleString()
    out = None
    for block in blocks(items, item_id, item_text):
        vocabulary = {t: n for n, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        shared = spark.sparkContext.broadcast(vocabulary)
        shards, held = materialize(indexed(docs, id_col, text_col, shared))
        counts = counted(shards, len(vocabulary))
        wanted = spark.sparkContext.broadcast(([[vocabulary[t] for t in terms] for _, terms in block], weights(counts), counts))
        found = best_of_tasks(shards, wanted, k).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        order = (F.desc("score"), F.col("doc_id").asc_nulls_last())
        for by in (["item", "salt"], ["item"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, name) for n, (name, _) in enumerate(block)], f"item int, item_id {kind}")
        part, _ = materialize(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        discard(spark, held)
        shared.destroy()
        wanted.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
i AS MATERIALIZED (SELECT row_number() OVER () AS iid, item_id, list_distinct({_TERMS}) AS w FROM benchmark),
n AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
t AS MATERIALIZED (SELECT rid, t, CAST(count(*) AS BIGINT) AS tf FROM d, unnest(w) AS u(t) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY t, n_docs),
m AS (SELECT rid, doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM n, c),
s AS (
  SELECT iid, item_id, rid, doc_id, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM (SELECT iid, item_id, unnest(w) AS t FROM i) q JOIN t USING (t) JOIN f USING (t) JOIN m USING (rid) GROUP BY ALL
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLES = {"op13_ranked_search": ORACLE}
