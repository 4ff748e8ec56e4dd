"""Circulant MinHash against all pairs."""

import random

import numpy as np
import pytest

from tests.llm.test_jaccard import DOCS, edited, plain_set
from tests.llm.test_operators import same_as_sql
from tracklark.llm import minhash
from tracklark.llm.shingles import U, mix


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for k, (name, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        root_id = min(ids) if ids and sets[k] else name
        out.append((name, len(sets[k]), root_id, name == root_id))
    return sorted(out, key=str)


def compare(spark, rows, partitions=3):
    docs = spark.createDataFrame([(k, t, "x", "y", 0) for k, t in rows], DOCS).withColumnsRenamed({"lang": "cls", "source": "component_id", "n_chars": "kept"}).repartition(partitions)
    got = minhash.components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_components(rows)


def test_groups_of_copies_chains_and_boilerplate(spark):
    draw, rows = random.Random(21), []
    shared = [f"s{k}" for k in range(60)]
    for group in range(6):
        base = [f"g{group}w{draw.randrange(400)}" for _ in range(draw.choice([40, 90, 200]))] + (shared if group % 2 else [])
        # A star whose arms are barely linked to the middle or not at all, near and exact copies, and a drifting chain.
        rows += [" ".join(edited(draw, base, draw.choice([1, 2, 3, 5]))) for _ in range(25)] + [" ".join(base)] * 4
        for _ in range(8):
            base = edited(draw, base, 1)
            rows.append(" ".join(base))
    # Many texts of which most is one passage, none linked to any other.
    rows += [" ".join([f"u{k}x{j}" for j in range(14)] + shared) for k in range(40)]
    rows += ["", None, "one", "ONE", "one two three four", "One two three\tfour", "one two three five", " \n", "É é É é É", "é é é é é", "w " * 30000, "w " * 5]
    draw.shuffle(rows)
    compare(spark, [*enumerate(rows)] + [(None, "one"), (3, rows[3]), (7, "other words of the same id"), (None, "alone without an id")])


def test_links_at_the_threshold(spark):
    # 37 shared shingles of 43 or 44 in all: 0.860 and 0.841.
    words = [f"w{k}" for k in range(44)]
    rows = [(0, " ".join(words[:41])), (1, " ".join(words[:44])), (2, " ".join(["x"] + words[:41] + ["y", "z"])), (3, " ".join(f"q{k}" for k in range(11))), (4, " ".join(f"q{k}" for k in range(10)))]
    compare(spark, rows)


def test_random_texts_of_few_words(spark):
    draw = random.Random(22)
    compare(spark, [(k, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 14)))) for k in range(150)])


def test_empty_tables_and_one_row_of_each_component(spark):
    assert minhash.components(spark.createDataFrame([], DOCS)).count() == 0
    words = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(5, words, "a", "b", 1), (2, words + " more", "c", "d", 2), (9, "other text", "e", "f", 3), (10, None, "g", "h", 4), (None, words, "i", "j", 5)], DOCS)
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 9, 10]


@pytest.mark.parametrize("n", [1, 7, minhash.TOKENS - 1, 3 * minhash.TOKENS + 5])
def test_signatures_equal_their_definition(n):
    draw = np.random.default_rng(n)
    sets = [draw.integers(0, 2**63, k).astype(U) for k in (3, n, 1, 2 * minhash.TOKENS, 50)]
    starts = np.append(0, np.cumsum([len(s) for s in sets])[:-1])
    got = minhash.least_values(np.concatenate(sets), starts, 6)
    for s, own in zip(sets, got, strict=True):
        scattered = mix(s ^ minhash.FIRST) + minhash.SECOND
        assert own.tolist() == [int(mix(scattered - U(k)).min()) for k in range(6)]


def test_agreement_is_the_similarity_and_bands_find_links():
    draw = np.random.default_rng(3)
    agree, found = [], 0
    for _ in range(300):
        both, one, two = (draw.integers(0, 2**63, k).astype(U) for k in (34, 3, 3))
        a, b = np.append(both, one), np.append(both, two)
        x, y = minhash.least_values(np.append(a, b), np.array([0, len(a)]))
        agree.append((x == y).mean())
        found += bool((minhash.bands_of(x[None]) == minhash.bands_of(y[None])).any())
    assert abs(np.mean(agree) - 34 / 40) < 0.01 and found == 300


def test_query_equals_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, minhash, "op12_circulant_minhash")
