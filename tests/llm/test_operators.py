"""Decontamination, sharding, language, search, packing and chat against plain versions."""

import hashlib
import random
import re
import weakref
import zlib

import duckdb
import numpy as np
import pytest

from tracklark.llm import chat, decontamination, language, packing, sharding, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"


def same_as_sql(spark, sf_dir, module, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    ran = con.execute(module.ORACLES[name])
    columns = [c[0] for c in ran.description]
    got = module.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in got.select(*columns).collect()) == order(ran.fetchall())


@pytest.mark.parametrize("module, name", [(decontamination, "op1_benchmark_matches"), (sharding, "op2_proportional_shards"), (vectors, "op6_vector_top_k"), (chat, "op10_chat_branches")])
def test_query_equals_sql(spark, sf_dir, module, name):
    same_as_sql(spark, sf_dir, module, name)


# Decontamination


def plain_hits(words, items, window):
    hit, ids = set(), set()
    for name, item in items:
        m = min(window, len(item))
        for p in range(len(item) - m + 1) if item else ():
            for k in range(len(words) - m + 1):
                if words[k : k + m] == item[p : p + m]:
                    hit.update(range(k, k + m))
                    ids.add(name)
    return hit, ids


def test_automaton_equals_plain_windows():
    draw = random.Random(1)
    for _ in range(400):
        items = [(str(k), [bytes([97 + draw.randrange(3)]) for _ in range(draw.randint(0, 9))]) for k in range(draw.randint(0, 5))]
        words = [bytes([97 + draw.randrange(4)]) for _ in range(draw.randint(0, 30))]
        window = draw.randint(1, 6)
        found = [*decontamination.SuffixAutomaton(items, window).matches(words)]
        assert ({k for a, b, _ in found for k in range(a, b)}, {n for _, _, x in found for n in x}) == plain_hits(words, items, window)


def test_small_blocks_of_items_find_the_same(spark):
    draw = random.Random(2)
    text = lambda n: " ".join(draw.choice("abcd") for _ in range(n))
    items = [(k % 9, text(draw.randint(0, 30))) for k in range(12)] + [(None, "a b"), (3, None)]
    docs = [(k, text(draw.randint(0, 60)), "en", None, 0) for k in range(40)] + [(None, None, None, None, None), (0, "", None, None, 0)]
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    found = decontamination.with_hits(frames[0], ["doc_id", "text"], "text", frames[1], "item_id", "text", 5, block_words=11)
    split = lambda t: decontamination.words_of(t.encode() if t else None)
    listed = [(str(k), split(t)) for k, t in items if k is not None]
    rows = found.collect()
    assert len(rows) == len(docs)
    for r in rows:
        hit, ids = plain_hits(split(r.row.text), listed, 5)
        assert ({k for s in r.hit for k in range(s.start, s.end)}, set(r["items"])) == (hit, ids) and r.n_words == len(split(r.row.text))


class Block(list):
    """A list that can be watched, and is sent as a plain one."""

    __hash__, __eq__ = object.__hash__, object.__eq__

    def __reduce__(self):
        return list, ([*self],)


def test_the_driver_holds_one_block_and_reads_items_twice(spark, monkeypatch):
    plain, alive, most, readings = decontamination.blocks, weakref.WeakSet(), [0], []

    def watched(*a):
        readings.append(1)
        for block in plain(*a):
            most[0] = max(most[0], len(alive) + 1)
            own = Block(block)
            alive.add(own)
            del block
            yield own
            del own

    monkeypatch.setattr(decontamination, "blocks", watched)
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(14))) for k in range(30)], ITEMS)
    docs = spark.createDataFrame([(k, f"before i{k}w1 " + " ".join(f"i{k}w{j}" for j in range(2, 14)), None, None, 0) for k in range(0, 60, 3)], DOCS)
    found = decontamination.with_hits(docs, ["doc_id"], "text", items, "item_id", "text", 10, block_words=40).select("row.doc_id", "items").collect()
    assert sorted((r.doc_id, r["items"]) for r in found) == [(k, [str(k)] if k < 30 else []) for k in range(0, 60, 3)]
    # The generator still has its own when the next is asked for.
    assert len(readings) == 2 and most[0] <= 2


def test_removal(spark):
    leak = "one two three four five six seven eight nine ten eleven twelve"
    rest = " ".join(f"w{k}" for k in range(100))
    docs = spark.createDataFrame([(1, rest + ". " + leak.title() + "! " + rest, "x", None, 0), (2, leak, None, None, 0), (3, rest, None, None, 0), (4, None, None, None, None)], DOCS).withColumnsRenamed({"lang": "hit", "source": "row"})
    items = spark.createDataFrame([(7, leak)], ITEMS)
    kept = {r.doc_id: r for r in decontamination.remove(docs, items).collect()}
    assert sorted(kept) == [1, 3, 4] and kept[1].text == rest + ". ! " + rest and kept[3].text == rest and kept[1].hit == "x"
    assert sorted(r.doc_id for r in decontamination.remove(docs, items, most_coverage=0).collect()) == [3, 4]
    assert decontamination.remove(docs.limit(0), items).count() == 0 and decontamination.remove(docs, items.limit(0)).count() == 4
    assert [r.n_words for r in decontamination.contamination(docs, items.limit(0)).orderBy("doc_id").collect()] == [212, 12, 100, 0]


def test_removal_looks_again_where_cutting_closes_a_gap(spark):
    leak, other = "one two three four five six seven eight nine ten", " ".join(f"b{k}" for k in range(10))
    rest = " ".join(f"w{k}" for k in range(200))
    halves = f"{leak[:18]} {other} {leak[19:]}"
    docs = spark.createDataFrame([(1, f"{rest} {halves} end", None, None, 0), (2, rest, None, None, 0)], DOCS)
    items = spark.createDataFrame([(7, leak), (8, other)], ITEMS)
    kept = {r.doc_id: r.text.split() for r in decontamination.remove(docs, items).collect()}
    assert kept == {1: [*rest.split(), "end"], 2: rest.split()}


# Sharding


def test_shards_match_the_mixture_with_ties_nulls_and_repeats(spark):
    rows = [(k % 500, "té" * (k % 7), "en", "hot" if k % 3 else ("s%d" % (k % 5) if k % 2 else None), 0) for k in range(3000)] + [(None, None, None, None, None)] * 5
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "rank").withColumnRenamed("n_chars", "shard")
    got = sharding.interleave(docs, shards=8, bucket_rows=64).toPandas()
    assert len(got) == 3005 and got.groupby("shard").size().between(375, 376).all()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    assert (got[got.doc_id.isna()][["size", "text_crc32"]].values == [1, 0]).all()
    crc = {k % 7: zlib.crc32(("té" * (k % 7)).encode()) for k in range(7)}
    assert set(got.text_crc32) <= set(crc.values()) | {0}
    docs = spark.createDataFrame([(k, "x", None, "a" if k % 4 else "b", 0) for k in range(4000)], DOCS)
    mix = sharding.interleave(docs, bucket_rows=100).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert mix[mix.source == "b"].groupby("shard").size().between(124, 126).all()
    again = sharding.interleave(docs.repartition(7), bucket_rows=999).toPandas().sort_values("doc_id")
    assert (again.slot.values == mix.sort_values("doc_id").slot.values).all()
    assert sharding.interleave(docs.limit(0)).count() == 0


# Language


def test_language_accuracy_and_rejection(spark):
    got = language.op5_language_centroids(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert len(got) == 1000 and (held.lang == held.lang_pred).mean() > 0.97 and both.rejected.mean() < 0.01
    assert (both.held_out == both.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 5 == 0)).all() and got.score.between(0, 1).all()
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(train.withColumnRenamed("n_chars", "mixed"))
    odd = ["", None, "12 34 !", "xq7 zzkv " * 200, "ΑΒΓ δεζ ηθι " * 200, "a"]
    frame = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(odd)], DOCS)
    found = {r.doc_id: r for r in language.predicted(frame, model).collect()}
    assert [found[k].lang_pred == "und" for k in range(6)] == [True] * 3 + [False] * 3
    assert [found[k].rejected for k in range(6)] == [True] * 5 + [False]
    assert language.keep_known(frame.withColumnRenamed("lang", "rejected"), model).count() == 1
    empty = language.fit(frame.limit(0))
    assert {r.lang_pred for r in language.predicted(frame, empty).collect()} == {"und"}


def test_predictions_equal_a_plain_nearest_centroid(spark):
    """Weights, k-means and cosines by loops over dictionaries, with the n-grams' buckets from the library."""
    draw = random.Random(21)
    words = {"aa": ["lorem", "ipsum", "dolor", "sit"], "bb": ["der", "die", "das", "und", "Straße"], "cc": ["один", "два", "три"]}
    rows = [(k, " ".join(draw.choices(words[lang], k=draw.randint(1, 30))), lang if k % 11 else None, None, 0) for k, lang in enumerate(draw.choices(list(words), k=150))]
    rows += [rows[3], rows[3], (None, "der die das", "bb", None, 0), (500, None, "aa", None, 0), (501, "", "aa", None, 0), (502, "12", "cc", None, 0), (503, "lorem " * 20000, "aa", None, 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    model = language.fit(docs, centroids=2)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.lang_pred, round(r.score, 5)) for r in language.predicted(docs, model).collect())

    counts = {}
    for n, r in enumerate(rows):
        g = language.grams(r[1])
        if g is not None:
            counts[n] = {b: int((g == b).sum()) for b in set(g.tolist())} if len(g) < 10**4 else dict(zip(*(x.tolist() for x in np.unique(g, return_counts=True)), strict=True))
    learned = [n for n in counts if rows[n][2] is not None]
    df = {}
    for n in learned:
        for b in counts[n]:
            df[b] = df.get(b, 0) + 1
    idf = lambda b: np.log((len(learned) + 1) / (df.get(b, 0) + 1)) + 1

    def unit(c):
        v = {b: np.log1p(x) * idf(b) for b, x in c.items()}
        size = sum(x * x for x in v.values()) ** 0.5
        return {b: x / size for b, x in v.items()}

    dot = lambda u, v: sum(x * v.get(b, 0.0) for b, x in u.items())

    def mean(vs):
        out = {}
        for v in vs:
            for b, x in v.items():
                out[b] = out.get(b, 0.0) + x / len(vs)
        return out

    def scaled(v):
        size = sum(x * x for x in v.values()) ** 0.5
        return {b: x / size for b, x in v.items()}

    centroids = []
    for lang in sorted(words):
        seen, vs = set(), []
        for n in learned:
            if rows[n][2] == lang and (rows[n][0], rows[n][1]) not in seen:
                seen.add((rows[n][0], rows[n][1]))
                vs.append(unit(counts[n]))
        middle = mean(vs)
        picked = [max(vs, key=lambda v: dot(v, middle))]
        picked.append(min(vs, key=lambda v: dot(v, picked[0])))
        for _ in range(12):
            own = [max((0, 1), key=lambda j: dot(v, picked[j])) for v in vs]
            picked = [scaled(mean([v for v, j in zip(vs, own) if j == c])) if c in own else picked[c] for c in (0, 1)]
        centroids += [(lang, c) for c in picked]
    want = []
    for n, r in enumerate(rows):
        if n in counts:
            v = unit(counts[n])
            score, lang = max(((dot(v, c), lang) for lang, c in centroids), key=lambda x: x[0])
            want.append((r[0] is None, r[0] or 0, lang, round(score, 5)))
        else:
            want.append((r[0] is None, r[0] or 0, "und", 0.0))
    want.sort()
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, want)) < 2e-3


def test_no_language_is_lost_to_repeats_and_models_do_not_depend_on_partitions(spark, monkeypatch):
    """20,000 equal rows of one language, digits that are no text, and a hot language beside a rare one."""
    draw = random.Random(22)
    rows = [(1, "lorem ipsum dolor", "xx", None, 0)] * 20000 + [(k, "".join(draw.choice("0123456789 ") for _ in range(12)), "zz", None, 0) for k in range(5000)]
    rows += [(k, " ".join(draw.choice(["der", "die", "das", "und"]) for _ in range(12)), "yy", None, 0) for k in range(200)] + [(k, "uno dos tres quattro", "zz", None, 0) for k in (7001, 7002)]
    rows += [(k, " ".join(draw.choice(["один", "два", "три"]) for _ in range(6)), "hot", None, 0) for k in range(9000)]
    docs = spark.createDataFrame(rows, DOCS)
    sent, models = [], []
    plain = language.sample_vectors

    def counted(*a):
        sent.append(plain(*a))
        return sent[-1]

    monkeypatch.setattr(language, "sample_vectors", counted)
    for partitions in (1, 7):
        models.append(language.fit(docs.repartition(partitions)))
    one, seven = models
    assert sorted(set(one.langs)) == ["hot", "xx", "yy", "zz"] and one.langs == seven.langs
    assert (one.centroids == seven.centroids).all() and (one.least == seven.least).all() and (one.idf == seven.idf).all()
    assert [len([x for x in s if x[0] == "xx"]) for s in sent] == [1, 1] and all(len(s) <= language.SAMPLE for s in sent)
    assert language.keep_known(docs.where("lang = 'xx'"), one).count() == 20000
    assert {r.lang_pred for r in language.predicted(docs.where("doc_id >= 7001 AND lang = 'zz'"), one).collect()} == {"zz"}


# Search


def plain_top(ids, rows, k):
    out = []
    for q, v in zip(ids, rows):
        if q is not None and q % 5 == 0 and v is not None:
            scores = sorted((-int(np.dot(v, w)), p) for p, w in zip(ids, rows) if w is not None and len(w) == len(v) and p != q)
            out += [(q, n + 1, p, -s) for n, (s, p) in enumerate(scores[:k])]
    return sorted(out)


def test_search_equals_brute_force_with_ties_and_odd_rows(spark):
    draw = np.random.default_rng(3)
    rows = [[float(x) for x in draw.integers(-9, 9, 6)] for _ in range(700)] + [[1.0] * 6] * 300 + [[2.0, 3.0]] * 4 + [[1e9] * 6]
    ids = list(range(len(rows)))
    bad = [(5000, None), (5005, [1.0, None, 2.0, 1.0, 1.0, 1.0]), (5010, [float("nan")] * 6), (5015, [float("inf")] * 6), (None, [1.0] * 6)]
    frame = spark.createDataFrame([*zip(ids, rows), *bad], "vec_id long, embedding array<double>").repartition(5)
    for block in (4096, 50):
        got = vectors.top_k(frame, frame.where("vec_id % 5 = 0"), 7, query_block=block).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, int(r.score)) for r in got) == plain_top(ids, rows, 7)
    assert vectors.top_k(frame.limit(0), frame.limit(0)).count() == 0 and vectors.top_k(frame, frame.where("vec_id = 5000")).count() == 0


def test_equal_vectors_leave_few_candidates(spark, monkeypatch):
    rows = [(k, [3.0, -1.0, 2.0]) for k in range(8000)] + [(9000 + k, [2.0, 2.0, float(k)]) for k in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    file, edges, _ = vectors.index(frame)
    few, _ = vectors.told_apart(file, 6)
    assert sorted(r.vec_id for r in few.select("vec_id").collect()) == [0, 1, 2, 3, 4, 5, 9000, 9001, 9002]
    queries = [(r[0], np.array(r[1])) for r in rows[::20]]
    shared = spark.sparkContext.broadcast((queries, edges))
    assert vectors.scanned(few, shared, 6).count() <= len(queries) * 2 * 6
    # What a task holds is bounded, and what it passes on early is the same.
    draw = np.random.default_rng(9)
    near = spark.createDataFrame([(k, [float(x) for x in draw.integers(90, 93, 8)]) for k in range(600)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(vectors, "HELD", 100)
    got = vectors.top_k(near, near.where("vec_id % 5 = 0"), 7).collect()
    both = near.orderBy("vec_id").collect()
    assert sorted((r.query_id, r.rank, r.vec_id, int(r.score)) for r in got) == plain_top([r.vec_id for r in both], [r.embedding for r in both], 7)


def test_parts_of_which_no_row_can_qualify(spark, monkeypatch):
    """A few long vectors first, then many short ones, in parts of a few rows."""
    monkeypatch.setattr(vectors, "ROWS_AT_ONCE", 8)
    draw = np.random.default_rng(15)
    rows = [(k, [float(x) for x in draw.integers(900, 1000, 4)]) for k in range(40)] + [(k, [float(x) for x in draw.integers(0, 5, 4)]) for k in range(40, 500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = vectors.top_k(frame, frame.where("vec_id % 5 = 0"), 7).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, int(r.score)) for r in got) == plain_top([r[0] for r in rows], [r[1] for r in rows], 7)


def test_search_query_leaves_out_vectors_that_are_not_finite(spark, tmp_path):
    draw = np.random.default_rng(7)
    rows = [(k, [float(x) for x in draw.normal(0, 1, 4)]) for k in range(60)]
    nan, inf = float("nan"), float("inf")
    odd = [(80, [nan] * 4), (100, [inf, 1.0, 1.0, 1.0]), (101, [inf] * 4), (102, [-inf] * 4), (103, [nan, 9.0, 9.0, 9.0]), (120, None), (104, [None, 9.0, 9.0, 9.0])]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(vectors.ORACLE).fetchall()
    got = vectors.op6_vector_top_k(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r[0] for r in want} == {0, 20, 40}


# Packing


def test_packing_keeps_every_token_and_fills_bins(spark):
    draw = random.Random(4)
    rows = [(k % 900, draw.randint(0, 3000) if k % 50 else 30000 + k) for k in range(1000)] + [(None, None), (1, -5)]
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens long").selectExpr("*", "1 AS bin_id")
    got = packing.best_fit(docs, block_rows=300).toPandas()
    assert got.n_tokens.sum() == sum(max(n or 0, 0) for _, n in rows) and got.groupby(["doc_id"], dropna=False).ngroups == 901
    for _, b in got.groupby("bin_id"):
        b = b.sort_values(["bin_start", "n_tokens"])
        assert (b.bin_start.values == np.concatenate([[0], b.n_tokens.cumsum().values[:-1]])).all()
        assert b.bin_used.iloc[0] == b.n_tokens.sum() <= b.bin_length.iloc[0] == min(x for x in packing.LENGTHS if x >= b.n_tokens.sum())
    assert got.n_tokens.sum() / got.groupby("bin_id").bin_length.first().sum() > 0.95
    assert packing.best_fit(docs.limit(0)).count() == 0


def test_joint_lengths_are_no_dearer_than_any_one_length():
    draw = random.Random(5)
    for _ in range(30):
        sizes = [draw.randint(0, 512) for _ in range(draw.randint(1, 200))]
        _, used, fitted = packing.pack(sizes)
        for one in packing.LENGTHS:
            _, full = packing.fit(sorted(sizes, reverse=True), one, (one,), packing.price)
            assert sum(map(packing.price, fitted)) <= len(full) * packing.price(one)
        assert sum(used) == sum(sizes)


def plain_best_fit(sizes, floor, lengths, cost):
    """Each size, longest first, into the open bin with the least room that holds it, by looking at all bins."""
    bins = []
    for size in sorted(sizes, reverse=True):
        fits = [b for b in bins if b[0] - b[1] >= size]
        if fits:
            min(fits, key=lambda b: b[0] - b[1])[1] += size
        else:
            bins.append([min((x for x in lengths if x >= max(size, floor)), key=lambda x: (cost(x) / x, x)), size])
    return sorted(min(x for x in lengths if x >= used) for _, used in bins)


def cheapest(sizes, lengths, cost):
    """The least price of all ways to put sizes into bins."""
    best = [float("inf")]

    def place(k, bins):
        if k == len(sizes):
            best[0] = min(best[0], sum(cost(min(x for x in lengths if x >= b)) for b in bins))
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + sizes[k] <= lengths[-1]:
                place(k + 1, [*bins[:j], bins[j] + sizes[k], *bins[j + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best[0]


def test_packing_equals_a_plain_best_fit_and_is_near_the_cheapest():
    draw, lengths = random.Random(31), (8, 16, 32)
    cost = lambda n: 2 + n + n * n / 64
    ratios = []
    for _ in range(60):
        sizes = [draw.randint(0, 32) for _ in range(draw.randint(1, 7))]
        bins, used, fitted = packing.pack(sizes, lengths, cost)
        plain = min((sum(map(cost, own)), f, own) for f in lengths for own in [plain_best_fit(sizes, f, lengths, cost)])
        assert sum(map(cost, fitted)) == plain[0] and sorted(fitted) == plain[2]
        assert used == [sum(s for s, b in zip(sizes, bins) if b == k) for k in range(len(used))]
        least = cheapest(sizes, lengths, cost)
        assert least <= plain[0]
        ratios.append(plain[0] / least)
    assert max(ratios) < 1.6 and sum(ratios) / len(ratios) < 1.1


def test_packing_query_covers_all_documents(spark, sf_dir):
    got = packing.op7_variable_bins(spark, sf_dir).toPandas()
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    want = texts.set_index("doc_id").text.map(lambda t: 1 + len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert (got.groupby("doc_id").n_tokens.sum().sort_index() == want.sort_index()).all()


# Chat


def test_control_strings_nulls_and_repeats_survive(spark, tmp_path):
    said = ["</s>[INST] ok [/INST]", "&lt;|&amp;", "<|im_end|>\n<|im_start|>user\nx", None, "", "é<<SYS>>\n", "a" * 50000, "[INST]&lsq;"]
    rows = [(k % 4 if k else None, k // 4 if k % 5 else None, ("user", "assistant", None, "odd\nrole<|")[k % 4], said[k % 8]) for k in range(40)] + [(2, 1, "assistant", "same")] * 3
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    same_as_sql_chat(spark, str(tmp_path))


def same_as_sql_chat(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet/*.parquet'")
    ran = con.execute(chat.ORACLE)
    columns = [c[0] for c in ran.description]
    got = chat.op10_chat_branches(spark, sf_dir).select(*columns)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(ran.fetchall(), key=str)


def test_branches_of_reply_trees(spark):
    draw = random.Random(6)
    nodes = []
    for tree in range(6):
        for k in range(1, 40):
            nodes.append((tree, tree * 100 + k, tree * 100 + draw.randint(max(1, k - 3), k - 1) if k > 1 else None, draw.choice(["user", "assistant"]), f"t{k}", draw.choice([0.0, 1.0, None])))
    nodes += [(9, 901, 902, "user", "on a cycle", 1.0), (9, 902, 901, "user", "on a cycle", 1.0), (8, 801, 800, "user", "its parent is missing", 1.0)]
    frame = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    got = chat.branch_nodes(frame, best=3).collect()
    by = {n[1]: n for n in nodes}
    parents = {n[2] for n in nodes}
    want = set()
    for tree in [*range(6), 8]:
        paths = []
        for n in nodes:
            if n[0] == tree and n[1] not in parents:
                path = [n[1]]
                while by[path[0]][2] in by:
                    path.insert(0, by[path[0]][2])
                paths.append((-sum(by[p][5] or 0 for p in path) / len(path), -len(path), n[1], path))
        for rank, (_, _, leaf, path) in enumerate(sorted(paths)[:3], 1):
            want |= {(tree, leaf, rank, d, by[p][3], by[p][4]) for d, p in enumerate(path, 1)}
    assert {(r.tree, r.branch, r["rank"], r.depth, r.role, r.text) for r in got} == want and len(got) == len(want)
    one = chat.formatted(chat.branch_nodes(frame)).where("tree = 0").first()
    assert all(one.formatted[m.start : m.start + m.length].startswith("t") for m in one.mask)
    assert chat.formatted(chat.branch_nodes(frame.limit(0))).count() == 0


def test_text_ids_do_not_clash_with_missing_ones(spark):
    rows = [(None, 1, "user", "null"), ("", 1, "user", "empty"), ("", 2, "assistant", "more"), ("-", 1, "user", "dash"), ("=", 1, "user", "sign"), (None, 2, "assistant", "null too")]
    frame = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = sorted(((r.tree, r.depth, r.text) for r in chat.branch_nodes(chat.conversation_nodes(frame)).collect()), key=str)
    assert got == sorted(((c, t, x) for c, t, _, x in rows), key=str)


def test_chat_plan_has_no_python(spark, sf_dir):
    plan = chat.op10_chat_branches(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and hashlib
