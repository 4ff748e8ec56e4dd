"""Ranked search against SQL and a plain version."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from tests.llm.test_operators import same_as_sql
from tracklark.llm import ranked

DOCS = "doc_id long, text string, item_id string, score long, n_chars long"
ITEMS = "item_id long, text string, doc_id long"


def plain_terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_ranks(docs, items, k):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, length = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    weight = {t: floor(1000 * log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, c, n in counts:
            m = 50 + 50 * n * n_docs // length
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort(key=lambda x: x[:3])
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(found[:k], 1)]
    return out


def drawn(draw, n, most, words):
    return " ".join(draw.choice(words) + draw.choice(["", ".", "\t", "-x"]) for _ in range(draw.randint(n, most)))


@pytest.mark.parametrize("docs_in_shard, k", [(5, 3), (8192, 3), (7, 50)])
def test_ranks_equal_a_plain_version(spark, monkeypatch, docs_in_shard, k):
    monkeypatch.setattr(ranked, "SHARD_DOCS", docs_in_shard)
    monkeypatch.setattr(ranked, "BLOCK_WORDS", 25)
    draw = random.Random(docs_in_shard + k)
    # A few words are in most texts, others in few.
    words = ["the"] * 40 + ["of", "É", "ÀB", "Über"] * 8 + [f"w{k}" for k in range(60)]
    docs = [(i, drawn(draw, 0, 40, words)) for i in range(120)] + [(None, "w1 w2 the"), (None, "w1 w2 the"), (3, "w1 w2 the"), (3, "w1 w2 the"), (500, None), (501, ""), (502, " .;"), (503, "w7 " * 30000 + "w8")]
    docs += [(600 + i, "w1 w2 the of") for i in range(30)]
    items = [(i, drawn(draw, 1, 12, words)) for i in range(25)] + [(7, None), (8, ""), (None, "w1 THE w2"), (9, "nobody holds this"), (4, "w1"), (4, "w1"), (30, "w7 W8 w8")]
    draw.shuffle(docs)
    got = ranked.ranked(spark.createDataFrame([(i, t, "a", 1, 0) for i, t in docs], DOCS).repartition(4), spark.createDataFrame([(i, t, 5) for i, t in items], ITEMS), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain_ranks(docs, items, k)))


def test_lists_that_cannot_qualify_are_only_probed():
    draw = np.random.default_rng(2)
    for _ in range(200):
        size, k = int(draw.integers(1, 60)), int(draw.integers(1, 8))
        lists = []
        for _ in range(draw.integers(1, 6)):
            docs = np.flatnonzero(draw.random(size) < draw.random())
            if len(docs):
                lists.append((docs.astype(np.int32), draw.integers(1, 1 + 10 ** int(draw.integers(1, 4)), len(docs))))
        if not lists:
            continue
        score = np.zeros(size, int)
        for docs, add in lists:
            score[docs] += add
        least = int(draw.integers(1, 500))
        at, found = ranked.searched(lists, size, least, k)
        assert (score[at] == found).all() and (found >= least).all()
        kth = max(least, sorted(score, reverse=True)[k - 1] if size >= k else 0, 1)
        assert set(np.flatnonzero(score >= kth)) <= set(at.tolist())


def test_large_counts_stay_exact():
    counts = ranked.Counts(10**11, 3 * 10**13, np.zeros(1, np.int64))
    n, tf = np.array([10**7, 400, 1]), np.array([12, 3, 1])
    expected = [10**9 * int(t) // (1000 * int(t) + 20 * (50 + 50 * int(x) * 10**11 // (3 * 10**13))) for t, x in zip(tf, n, strict=True)]
    assert ranked.additions(tf, n, counts).tolist() == expected


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", 0, 0)], DOCS), spark.createDataFrame([(1, "b", 0)], ITEMS)
    assert ranked.ranked(docs.where("false"), items).count() == 0
    got = ranked.ranked(docs, items.where("false"))
    assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_query_equals_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, ranked, "op13_ranked_search")
