"""Vector codes against SQL and a plain version."""

import hashlib
import random
from collections import Counter
from math import floor, isfinite

import numpy as np
import pytest

from tests.llm.test_operators import same_as_sql
from tracklark.llm import codes

ROWS = "vec_id long, embedding array<float>, label int, code string, label_error long"


def plain(rows, parts, entries, rounds, scale):
    """(vec_id, code, error, label_error) of the rows that take part, and the codebooks."""
    kept = [(i, label, [floor(scale * float(x)) for x in v]) for i, v, label in rows if v and all(x is not None and isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return [], []
    p = len(kept[0][2]) // parts
    cut = [[v[k * p : (k + 1) * p] for k in range(parts)] for *_, v in kept]
    books = [[[*row[k]] for row in cut[:entries]] for k in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda part, k: min((away(part, c), e) for e, c in enumerate(books[k]))
    for _ in range(rounds):
        near = [[best(row[k], k)[1] for k in range(parts)] for row in cut]
        for k in range(parts):
            for e in range(len(books[k])):
                if own := [row[k] for row, n in zip(cut, near, strict=True) if n[k] == e]:
                    books[k][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[best(row[k], k) for k in range(parts)] for row in cut]
    error = [sum(d for d, _ in f) for f in found]
    total = Counter()
    for (_, label, _), e in zip(kept, error, strict=True):
        total[label] += e
    return [(i, "".join(f"{e:02x}" for _, e in f), e, total[label]) for (i, label, _), f, e in zip(kept, found, error, strict=True)], books


def vectors(draw, n, d, spread=2.0):
    return [(k, [draw.choice([-1, 1]) * draw.random() * spread for _ in range(d)], draw.choice([None, 1, 1, 1, 2])) for k in range(n)]


def made(spark, rows, partitions):
    return spark.createDataFrame([(i, v, label, "clash", 7) for i, v, label in rows], ROWS).repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 5])
def test_codes_equal_a_plain_version(spark, partitions):
    draw = random.Random(5)
    rows = vectors(draw, 150, 12) + [(k, [0.25] * 12, 1) for k in range(150, 190)]
    rows += [(3, rows[9][1], 2), (3, rows[9][1], 2), (None, rows[4][1], None), (200, None, 1), (201, [None] + [0.5] * 11, 1), (202, [float("nan")] * 12, 2), (203, [float("inf")] + [0.0] * 11, 2)]
    rows += [(204, [0.5] * 8, 1), (205, [0.5] * 7, 1), (206, [], None), (207, [3e38] * 12, 1)]
    draw.shuffle(rows)
    got, books = codes.compressed(made(spark, rows, partitions), parts=4, entries=7, rounds=5, scale=64)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error"]
    of_most = [r for r in rows if r[0] not in (204, 205, 206, 207)]
    # Floats of 32 bits are exact in this plain version as well.
    of_most = [(i, v and [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in of_most]
    expected, plain_books = plain(of_most, 4, 7, 5, 64)
    assert sorted(map(str, ((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()))) == sorted(map(str, expected))
    assert books.tolist() == plain_books
    assert codes.digest(books) == hashlib.sha256(",".join(str(x) for part in plain_books for c in part for x in c).encode()).hexdigest()
    one = got.where("vec_id = 150").first()
    assert sum((16 - x) ** 2 for x in codes.decoded(one.code, books)) == one.error


def test_large_numbers_are_exact(spark):
    rows = [(k, [float((-1) ** k * (2**27 - 8 * k)), float(8 * k)], None) for k in range(40)]
    got, books = codes.compressed(made(spark, rows, 3), parts=1, entries=3, rounds=4, scale=4)
    expected, plain_books = plain(rows, 1, 3, 4, 4)
    assert books.tolist() == plain_books
    assert sorted((r.vec_id, r.code, r.error) for r in got.collect()) == sorted(r[:3] for r in expected)


def test_few_rows_and_none(spark):
    got, books = codes.compressed(made(spark, [(2, [1.0] * 8, 1), (1, [2.0] * 8, 1)], 2))
    assert [(r.vec_id, r.code, r.error) for r in got.orderBy("vec_id").collect()] == [(1, "00" * 8, 0), (2, "01" * 8, 0)] and books.shape == (8, 2, 1)
    for rows in ([], [(1, None, 1), (2, [], 1)]):
        got, books = codes.compressed(made(spark, rows, 2))
        assert got.count() == 0 and books.size == 0 and codes.digest(books) == hashlib.sha256(b"").hexdigest()


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "FEW_LABELS", 1)
    rows = vectors(random.Random(6), 60, 8)
    got, _ = codes.compressed(made(spark, rows, 3), parts=2, entries=4, rounds=2)
    expected, _ = plain([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows], 2, 4, 2, codes.SCALE)
    assert sorted((r.vec_id, r.label_error) for r in got.collect()) == sorted((r[0], r[3]) for r in expected)


def test_query_equals_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, codes, "op11_vector_codes")
