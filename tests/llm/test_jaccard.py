"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tracklark.llm import components, jaccard, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


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
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for k, (name, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((name, len(sets[k]), min(ids) if ids and sets[k] else name))
    return sorted(out, key=str)


def compare(spark, rows, partitions=3):
    docs = spark.createDataFrame([(k, t, "x", "y", 0) for k, t in rows], DOCS).withColumnsRenamed({"lang": "cls", "source": "component_id"}).repartition(partitions)
    got = jaccard.components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_components(rows)


def edited(draw, words, n):
    words = list(words)
    for _ in range(n):
        k = draw.randrange(len(words))
        match draw.randrange(3):
            case 0:
                words[k] = f"new{draw.random()}"
            case 1:
                del words[k]
            case _:
                words.insert(k, f"more{draw.random()}")
    return words


def test_groups_of_copies_chains_and_boilerplate(spark):
    draw, rows = random.Random(11), []
    shared = [f"s{k}" for k in range(40)]
    for group in range(6):
        base = [f"g{group}w{draw.randrange(400)}" for _ in range(draw.choice([30, 80, 200]))] + (shared if group % 2 else [])
        # A star whose arms are barely linked to the middle, near and exact copies, and a drifting chain.
        rows += [" ".join(edited(draw, base, draw.choice([1, 2, 3, 5]))) for _ in range(25)] + [" ".join(base)] * 4
        for _ in range(8):
            base = edited(draw, base, 1)
            rows.append(" ".join(base))
    rows += [" ".join([f"u{k}x{j}" for j in range(20)] + shared) for k in range(20)]
    rows += ["", None, "one", "ONE", "one two three four", "One two three\tfour", "one two three five", " \n", "É é É é É", "é é é é é", "w " * 30000, "w " * 5]
    draw.shuffle(rows)
    compare(spark, [*enumerate(rows)] + [(None, "one"), (3, rows[3]), (7, "other words of the same id")])


def test_random_texts_of_few_words(spark):
    draw = random.Random(12)
    rows = [(k, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 12)))) for k in range(150)]
    compare(spark, rows)


def test_empty_and_unlinked_tables(spark):
    compare(spark, [], 1)
    compare(spark, [(1, None), (2, "a b c d e f g"), (3, "x y")])


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(100))
    docs = spark.createDataFrame([(5, text, "a", "b", 1), (4, text + " more", "a", "b", 2), (9, "alone", "a", "b", 3), (None, text, None, None, None), (8, None, "a", "b", 4)], DOCS)
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "8", "9", "None"]


def test_rows_that_repeat_an_id_stay_if_their_texts_are_others(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "xy")
    rows = [(3, one, "a"), (7, one, "b"), (7, two, "c"), (3, one, "d"), (3, one, "d"), (3, two.upper(), "e"), (9, "", "f"), (9, "", "f"), (8, two, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls string").repartition(4)
    kept = sorted((r.doc_id, plain_set(r.text) == plain_set(one), r.cls) for r in jaccard.deduplicate(docs).collect())
    # One row of (3, one), the row (3, TWO) and both empty ones; (7, two) and (8, two) link to (3, TWO).
    assert [k[:2] for k in kept] == [(3, False), (3, True), (9, False), (9, False)] and kept[1][2] in "ad"
    plain = spark.createDataFrame([(3, one, "a"), (7, one, "b"), (7, two, "c")], "doc_id long, text string, cls string")
    assert sorted((r.doc_id, r.cls) for r in jaccard.deduplicate(plain).collect()) == [(3, "a"), (7, "c")]


def test_many_ids_are_looked_up_in_a_table(spark, monkeypatch):
    draw = random.Random(31)
    base = [" ".join(f"g{g}w{draw.randrange(99)}" for _ in range(40)) for g in range(8)]
    rows = [(k % 50 if k % 9 else None, draw.choice([*base, None, "", f"alone {k} and so on"]), "x", "y", k) for k in range(140)]
    docs = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "_marked", "source": "doc"}).repartition(3)
    few = sorted(map(str, jaccard.deduplicate(docs).collect()))
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    assert sorted(map(str, jaccard.deduplicate(docs).collect())) == few


def test_class_numbers_that_several_sets_share(spark):
    rows = [(k, " ".join(f"{k // 3}w{j}" for j in range(30)) + (" end" if k % 3 else "")) for k in range(40)]
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), bits=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_components(rows)


def pairs_of(spark, lists, leaders, most):
    """All pairs that rounds of led_pairs list, until no list is open."""
    out, rounds = set(), 0
    while True:
        led = jaccard.led_pairs(lists, leaders, most).collect()
        out |= {(r.x, r.y) for r in led if not r.kind}
        rounds += 1
        still = [(r.x, r.y, r.before, r.place, r.y, bytes([200] * jaccard.RANGES)) for r in led if r.kind]
        if not still:
            return out, rounds
        lists, leaders = spark.createDataFrame(still, "token long, cls long, before long, place long, comp long, ranges binary"), leaders * 16


@pytest.mark.parametrize("most", [jaccard.LIST_ROWS, 30])
def test_lists_of_any_length_give_all_their_pairs(spark, most):
    draw, kind = random.Random(4), "token long, cls long, before long, place long, comp long"
    rows = []
    for token, size in ((5, 2), (6, 16), (7, 17), (9, 40), (-3, 300)):
        members = draw.sample(range(-(10**6), 10**6), size)
        rows += [(token, c, k, 100 << 32 | 1, c) for k, c in enumerate(members)] + [(token, members[0], 0, 100 << 32 | 1, members[0])]
    got, rounds = pairs_of(spark, spark.createDataFrame(rows, kind).repartition(3), 1, most)
    by = {t: sorted({r[1] for r in rows if r[0] == t}) for t in {r[0] for r in rows}}
    assert got == {(a, b) for own in by.values() for k, a in enumerate(own) for b in own[k + 1 :]} and rounds > 2
    parts = [*jaccard.parts_of_lists(np.repeat([1, 2, 3], [5, 40000, 7]))]
    assert [p.stop for p in parts][-1] == 40012 and all(p.stop in (5, 40005, 40012) for p in parts)


def test_a_long_list_of_unlinked_members_streams():
    """20,000 members that share a token, in batches: no more than a part is held."""
    n = 20000
    batch = lambda token, cls: pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), token)), *(pa.array(cls) for _ in range(4))], names=list("abcde"))
    batches = [batch(8, np.arange(k, min(k + 999, n))) for k in range(0, n, 999)]
    parts = [*jaccard.sorted_lists(iter(batches), 2500)]
    assert not any(done for done, _ in parts[:-1]) and max(len(c[0]) for _, c in parts) < 4000
    assert np.concatenate([c[1] for _, c in parts]).tolist() == list(range(n))
    more = [*jaccard.sorted_lists(iter([batch(7, np.arange(5)), *batches, batch(8, np.arange(n - 1, n + 2)), batch(9, np.arange(3))]), 2500)]
    assert [len(c[0]) for done, c in more if done] == [5, 3] and sum(len(c[0]) for done, c in more if not done) == n + 2


def test_numbers_of_words_do_not_depend_on_their_place():
    texts = ["", "a", None, "the Cat  sat\ton the mat and the cat sat on it", "the cat sat on the mat", "é ß", "x" * 5000]
    one = [s.tolist() for s in shingles.sets_of(pa.array(texts))]
    for k, t in enumerate(texts):
        assert next(iter(shingles.sets_of(pa.array([t])))).tolist() == one[k]
        assert len(one[k]) == len(plain_set(t))
    assert [s.tolist() for s in shingles.sets_of(pa.array(texts).slice(3, 3))] == one[3:6]
    saved, shingles.CHUNK = shingles.CHUNK, 8
    try:
        assert [s.tolist() for s in shingles.sets_of(pa.array(texts))] == one
    finally:
        shingles.CHUNK = saved


@pytest.mark.parametrize("seed", range(3))
def test_component_roots(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for a, b in edges for x in (a, b) if find(x) != x or any(y != x and find(y) == x for y in root)}
    for one_task in (1000, 4):
        got = {r.node: r.root for r in components.roots(spark.createDataFrame(edges, "a long, b long"), one_task)[0].collect()}
        assert got == want
