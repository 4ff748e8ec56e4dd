"""Language identification by the nearest of several centroids per language.

A text becomes a TF-IDF vector of hashed code-point n-grams (1 to 3 of them, over lower-case letters with every run of
other signs as one space), scaled to length 1. Each language has up to `CENTROIDS` centroids from spherical k-means on
a bounded sample of labelled rows. A text gets the language of the centroid with the highest cosine and is rejected if
its distance to it is far beyond what texts of its length have in the sample.

Fitting reads the texts twice. The first pass counts document frequencies over all learnable rows and keeps, in each
task, the smallest distinct hashes of id and text of each language, as many as the sample could take: at most `SAMPLE`
in all, but `CENTROIDS` of each language, so no language is left out, however often rows repeat. These hashes are merged
and cut again, first within `SALTS` parts of a language. The second pass counts the n-grams of the rows chosen, once for
each hash and task; repeats are merged by a shuffle, so the driver gets each row of the sample once, besides one number
for each of the `BUCKETS` buckets. The driver sorts the sample by hash, so a model doesn't depend on partitions.
Prediction reads each whole text once, without a shuffle; the model broadcast is `BUCKETS` floats for each centroid,
and at most `MOST_LANGUAGES` languages are accepted.

Nulls: a text that is null or has no letter gets `und` with score 0 and is rejected. Rows without a label are not
learned from; without any learnable row every prediction is `und`. Repeated rows count and are predicted each for
itself, an empty table gives an empty table. `keep_known` passes all columns through whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache
from math import sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracklark.llm.batches import mapped, per_row, slices
from tracklark.session import discard, materialize, table

BUCKETS, CENTROIDS, SAMPLE, MOST_LANGUAGES = 1 << 12, 4, 3200, 400
#: A text is rejected below this share of the cosine that all but `ODD` of the sample texts of its length reach.
SLACK, ODD = 0.6, 0.02
#: So many sample texts of a size tell the bound for that size.
TOLD = 32
#: Hashes of a language are ranked within so many parts first.
SALTS = 32
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is none."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in map(chr, range(sys.maxunicode + 1)):
        if c.isalpha():
            low = c.lower()
            out[ord(c)] = ord(low) if len(low) == 1 else ord(c)
    return out


def grams(text: str | None) -> np.ndarray | None:
    """The bucket of each n-gram of a text; none if it has no letter."""
    if not text:
        return None
    c = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = c == 32
    if blank.all():
        return None
    c = c[~(blank & np.append(True, blank[:-1]))]
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint32)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(3266489917) + one[2:]
    mix = np.concatenate([one, two, three])
    mix ^= mix >> np.uint32(16)
    mix *= np.uint32(2146121005)
    return (mix >> np.uint32(32 - (BUCKETS.bit_length() - 1))).astype(np.intp)


class Model(NamedTuple):
    """langs: of each centroid. least: by power of two of the number of n-grams, the least cosine accepted."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: np.ndarray

    def vector(self, found: np.ndarray) -> np.ndarray:
        v = np.log1p(np.bincount(found, minlength=BUCKETS)) * self.idf
        return v / (sqrt(v @ v) or 1.0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether the distance rejects it."""
        found = grams(text)
        if found is None or not self.langs:
            return UNKNOWN, 0.0, True
        scores = self.centroids @ self.vector(found)
        best = int(scores.argmax())
        score = min(max(float(scores[best]), 0.0), 1.0)
        return self.langs[best], score, bool(score < self.least[size_class(len(found))])


def size_class(n: int) -> int:
    return min(n.bit_length(), 63)


def surveyed(rows: DataFrame) -> DataFrame:
    """bucket and df: in how many texts of a task each bucket occurs (at `BUCKETS`, the number of texts); and, in rows
    without a bucket, lang and mixed: the smallest distinct hashes of each language, as many as the sample can take.

    rows: lang, mixed, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, least = np.zeros(BUCKETS + 1, np.int64), 0, {}
        for batch in slices(batches):
            for lang, mixed, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (found := grams(text)) is None:
                    continue
                df[np.unique(found) if len(found) < BUCKETS else np.flatnonzero(np.bincount(found, minlength=BUCKETS))] += 1
                n += 1
                least.setdefault(lang, set()).add(mixed)
                # All rows have at least the languages of this task, so more of one are never wanted.
                if len(least[lang]) > 2 * (most := wanted(len(least))):
                    least[lang] = set(sorted(least[lang])[:most])
        df[BUCKETS] = n
        at = np.flatnonzero(df)
        both = [(lang, m) for lang, own in least.items() for m in sorted(own)[: wanted(len(least))]]
        none = pa.nulls(len(both), pa.int32()), pa.nulls(len(both), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64()), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.int64())], names=["bucket", "df", "lang", "mixed"])
        yield pa.RecordBatch.from_arrays([*none, pa.array([x for x, _ in both], pa.string()), pa.array([m for _, m in both], pa.int64())], names=["bucket", "df", "lang", "mixed"])

    return mapped(rows, run, "bucket int, df long, lang string, mixed long")


def wanted(languages: int) -> int:
    """Rows of the sample for each language."""
    return max(CENTROIDS, SAMPLE // max(languages, 1))


def frequencies(survey: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts."""
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in survey.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        out[r.bucket] = r.df
    return out[:BUCKETS], int(out[BUCKETS])


def sample_vectors(rows: DataFrame, survey: DataFrame) -> list[tuple[str, np.ndarray, int]]:
    """Label, counts by bucket and number of n-grams of the sampled rows, in order of label and hash; the counts are made
    on executors."""
    hashes = survey.where("bucket IS NULL").select("lang", "mixed")
    languages = hashes.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return []
    chosen = hashes.distinct().withColumn("salt", F.pmod("mixed", F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("mixed"))).where(F.col("rank") <= wanted(languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = set()
        for batch in slices(batches):
            out = []
            for lang, mixed, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Rows of one hash repeat each other.
                if (lang, mixed) not in taken:
                    taken.add((lang, mixed))
                    g = grams(text)
                    out.append((lang, mixed, np.bincount(g, minlength=BUCKETS).astype(np.int32).tobytes(), len(g)))
            if out:
                lang, mixed, counts, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(mixed, pa.int64()), pa.array(counts, pa.binary()), pa.array(n, pa.int64())], names=["lang", "mixed", "counts", "n"])

    picked = rows.join(F.broadcast(chosen.select("lang", "mixed")), ["lang", "mixed"]).select("lang", "mixed", "text")
    once = mapped(picked, run, "lang string, mixed long, counts binary, n long").groupBy("lang", "mixed").agg(F.min(F.struct("n", "counts")).alias("of"))
    found = sorted(once.select("lang", "mixed", "of.n", "of.counts").collect(), key=lambda r: (r["lang"], r["mixed"]))
    return [(r["lang"], np.frombuffer(r["counts"], np.int32), r["n"]) for r in found]


def spherical_means(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids of unit rows by cosine, started at rows far from each other."""
    picked = [int((v @ v.mean(axis=0)).argmax())]
    while len(picked) < min(k, len(v)):
        picked.append(int((v @ v[picked].T).max(axis=1).argmin()))
    c = v[picked]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.stack([v[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", centroids: int = CENTROIDS) -> Model:
    """A model of the rows that have a text and a label."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.select("lang", F.xxhash64("doc_id", "text").alias("mixed"), "text")
    survey, held = materialize(surveyed(rows))
    df, n = frequencies(survey)
    idf = (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)
    model = Model(idf, np.zeros((0, BUCKETS), np.float32), [], np.zeros(64))
    by: dict[str, list[tuple[np.ndarray, int]]] = {}
    for lang, counts, size in sample_vectors(rows, survey):
        v = np.log1p(counts).astype(np.float32) * idf
        by.setdefault(lang, []).append((v / np.linalg.norm(v), size))
    discard(labelled.sparkSession, held)
    found, langs, reached = [], [], [[] for _ in range(64)]
    for lang in sorted(by):
        v = np.stack([x for x, _ in by[lang]])
        c = spherical_means(v, centroids)
        found.append(c)
        langs += [lang] * len(c)
        for score, (_, size) in zip((v @ c.T).max(axis=1), by[lang], strict=True):
            reached[size_class(size)].append(score)
    # A few texts tell no quantile, so a size with too few of them takes the bound of the next shorter one; and as
    # longer texts are nearer to their centroids, no size has a higher bound than a longer one.
    least = np.zeros(64)
    for k in range(1, 64):
        least[k] = SLACK * np.quantile(reached[k], ODD) if len(reached[k]) >= TOLD else least[k - 1]
    least = np.minimum.accumulate(least[::-1])[::-1]
    return model._replace(centroids=np.vstack(found).astype(np.float32) if found else model.centroids, langs=langs, least=least)


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        predict = shared.value.predict
        return lambda doc_id, text: (doc_id, *predict(text))

    return per_row(narrow, StructType([narrow.schema["doc_id"], *StructType.fromDDL("lang_pred string, score double, rejected boolean")]), start)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for batch in slices(batches):
            yield batch.filter(pa.array([not predict(t)[2] for t in batch.column(place).to_pylist()], pa.bool_()))

    return mapped(docs, run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row belongs to the fold that is never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op5_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents by a model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predicted(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op5_language_centroids": op5_language_centroids}
