"""The pipeline against a plain version of it."""

import corpus_pipeline
import pytest

from tests.llm.test_jaccard import plain_components
from tracklark.llm import decontamination, language, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    """The tables after each stage, as the driver makes them."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('stages')}/{k}"
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_each_stage_equals_its_plain_version(spark, sf_dir, kept):
    first, known, single, clean, safe, bins = kept
    for df in kept[:-1]:
        assert df.columns == first.columns
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    model = language.fit(first.where(~language.held_out()))
    assert rows(known).keys() == {k for k, r in rows(first).items() if not model.predict(r.text)[2]}
    assert known.count() >= 0.98 * first.count()
    assert rows(single).keys() == {k for k, _, c in plain_components([(r.doc_id, r.text) for r in known.collect()]) if c == k}
    items = [(str(r.item_id), decontamination.words_of(r.text.encode())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[p : p + 10]) for _, w in items for p in range(len(w) - 9)}
    hit = lambda w: any(tuple(w[k : k + 10]) in windows for k in range(len(w)))
    assert min(len(w) for _, w in items) >= 10
    want = {k for k, r in rows(single).items() if not hit(decontamination.words_of(r.text.encode()))}
    assert rows(clean).keys() == want and len(want) < single.count()
    plain = {k: secrets.redacted(r.text) for k, r in rows(clean).items()}
    assert {k: r.text for k, r in rows(safe).items()} == plain and any("[REDACTED]" in t for t in plain.values())
    packed = bins.groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in packed} == {k: 1 + len(t.encode().split()) for k, t in plain.items()}


def test_run_and_empty_documents(spark, sf_dir, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3)]
    spark.createDataFrame(odd, DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {1, 2, None}


def test_repeated_ids_and_columns_with_names_of_its_own(spark, sf_dir, tmp_path):
    """Rows that share an id but no text all stay, whatever the other columns are called."""
    first = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 400").dropDuplicates(["text"])
    texts = [r.text for r in first.select("text").orderBy("text").limit(24).collect()]
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, cls long, hit string, id int, suspect string, items string, again boolean, stays string"
    rows = [(k // 2, t, "en", "s", len(t), f"r{k}", k, "h", k, "x", None, None, f"s{k}") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, kind).repartition(3)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
    got = kept.collect()
    single = {c for c, _, k in plain_components([(n, t) for n, t in enumerate(texts)]) if c == k}
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    windows = {tuple(w[p : p + 10]) for w in (decontamination.words_of(r.text.encode()) for r in items) for p in range(len(w) - 9)}
    words = [decontamination.words_of(t.encode()) for t in texts]
    clean = {n for n, w in enumerate(words) if not any(tuple(w[k : k + 10]) in windows for k in range(len(w)))}
    assert {int(r.stays[1:]) for r in got} == single & clean and all(r.row == f"r{r.cls}" and r.doc_id == r.cls // 2 for r in got)
    assert len({r.doc_id for r in got}) < len(got)
    stage = corpus_pipeline.STAGES[-1][1]
    assert stage(spark, kept, sf_dir).where("piece = 0").count() == len(got)
