"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Texts are sets of five-word shingles, numbers of 64 bits; two link if 100 * |intersection| >= 85 * |union|. A first
permutation of all 2^64 numbers scatters a set; coordinate k of its signature is the least value that a second
permutation takes on the scattered set moved round by k places. So two permutations make all `BANDS` * `ROWS`
coordinates, and two sets agree in one with the chance of their similarity. `ROWS` coordinates in a row are a band, and
sets with an equal band are candidates.

A pair at the threshold is in no common band with a chance of (1 - 0.85^4)^32 = 5.5e-11, a pair at 0.95 with one of
5e-24; and it changes a component only if no other path joins the two. Nothing else can lose a link: candidates are
tested by counts in ranges of token numbers, which bound the overlap from above, and then on their full sets.

Bands are lists in the sense of `jaccard`, whose rounds work here as well: short lists give all their pairs, in longer
ones members pair with a few leaders at a time, verified links join components, and a list is dropped once it lies
within one component or every member has led. No list has a cap, and none is held as a whole.

Scale: whole texts are read three times and not shuffled: for classes of equal sets, for signatures (once for each class
and task) and for the store of the classes that are in a pair or an open list. `BANDS` postings of four numbers are
shuffled for each class, whatever the length of its text. Broadcasts are bounded as in `jaccard`.

Nulls: null texts and texts without words have an empty set and link with nothing. Null ids are ignored as component
ids. Repeated rows are rows of their own, in one class. An empty table gives an empty table. Other columns are not read;
`deduplicate` passes them through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.llm import jaccard
from tracklark.llm.batches import mapped, slices
from tracklark.llm.shingles import STEP, U, mix, sets_of
from tracklark.session import table

BANDS, ROWS = 32, 4
#: Ranges that token numbers are cut into for the test of counts: enough that texts of a few hundred words which miss the
#: threshold by a little fail it.
RANGES = 256
#: 37 / 17 of the overlap reach the sum of both sizes at a similarity of 0.85.
SHARE = 17, 37
#: Tokens worked on at a time, so that all steps of the second permutation find them in the processor's cache.
TOKENS = 1 << 14
#: What makes the two permutations and the bands' numbers differ.
FIRST, SECOND = U(0x8CB92BA72F3D8DD7), U(0xA0761D6478BD642F)
#: Fixed multipliers of the second permutation, both odd.
ONE, TWO = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
PLACES = mix(np.arange(1, ROWS + 1, dtype=U) * U(STEP)) | U(1)
BAND = mix(np.arange(101, 101 + BANDS, dtype=U) * U(STEP))


def least_values(tokens: np.ndarray, starts: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (sets x coordinates) of sets that stand one behind the other and begin at `starts`; none is empty."""
    out = np.full((len(starts), coordinates), np.iinfo(U).max, U)
    ends = np.append(starts[1:], len(tokens))
    at = 0
    while at < len(starts):
        # Whole sets of about TOKENS tokens, or a part of one set.
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + TOKENS, "right")))
        for a in range(int(starts[at]), int(ends[to - 1]), TOKENS if to == at + 1 else len(tokens)):
            b = min(a + TOKENS, int(ends[at])) if to == at + 1 else int(ends[to - 1])
            scattered = mix(tokens[a:b] ^ FIRST) + SECOND
            own = starts[at:to] - starts[at] if to > at + 1 else np.zeros(1, np.int64)
            x, y = np.empty_like(scattered), np.empty_like(scattered)
            for k in range(coordinates):
                # The set moved round by k, under the second permutation.
                np.subtract(scattered, U(k), out=x)
                for shift, factor in ((30, ONE), (27, TWO)):
                    np.right_shift(x, U(shift), out=y)
                    np.bitwise_xor(x, y, out=x)
                    np.multiply(x, factor, out=x)
                np.right_shift(x, U(31), out=y)
                np.bitwise_xor(x, y, out=x)
                np.minimum(out[at:to, k], np.minimum.reduceat(x, own), out=out[at:to, k])
        at = to
    return out


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """The bands' numbers (sets x bands)."""
    return mix((signatures.reshape(len(signatures), -1, ROWS) * PLACES).sum(axis=2, dtype=U) + BAND[: signatures.shape[1] // ROWS])


def postings(texts: DataFrame, model) -> DataFrame:
    """token (a band's number), cls, before (the number of the band before) and place (the set's size and the band's
    place in one number) of each set, as `jaccard.led_pairs` takes them: a pair that shares the band before as well is
    found in that band's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, bits, torn), seen = model.value, set()
        for batch in slices(batches, jaccard.ROWS):
            held, names = [], []
            for tokens in sets_of(batch.column(0)):
                if not len(tokens) or (cls := jaccard.class_number(tokens, bits, torn)[0]) in seen:
                    continue
                if len(seen) >= jaccard.REMEMBERED:
                    seen.clear()
                seen.add(cls)
                held.append(tokens)
                names.append(cls)
            if held:
                size = np.array([len(t) for t in held])
                band = bands_of(least_values(np.concatenate(held), np.append(0, np.cumsum(size)[:-1])))
                band = band.view(np.int64)
                place = (size << 32)[:, None] | np.arange(BANDS)
                columns = band, np.repeat(np.array(names, np.int64), BANDS), np.roll(band, 1, axis=1), place
                yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in columns], names=["token", "cls", "before", "place"])

    return mapped(texts, run, "token long, cls long, before long, place long")


def stored(texts: DataFrame, classes: DataFrame, model) -> DataFrame:
    """Text and counts by ranges of the classes wanted and of those that collide with them in the bit table."""
    shared = texts.sparkSession.sparkContext.broadcast(jaccard.bit_table(classes, jaccard.fitting_bits(classes.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, bits, torn), seen = model.value, set()
        for batch in slices(batches, jaccard.ROWS):
            out = []
            for k, s in enumerate(sets_of(batch.column(0))):
                if not len(s) or (cls := jaccard.class_number(s, bits, torn)[0]) in seen or not jaccard.in_table(shared.value, np.array([cls]))[0]:
                    continue
                if len(seen) >= jaccard.REMEMBERED:
                    seen.clear()
                seen.add(cls)
                out.append((k, cls, jaccard.range_counts(s, RANGES)))
            if out:
                k, cls, ranges = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), batch.column(0).take(pa.array(k, pa.int64())), pa.array(ranges, pa.binary())], names=["cls", "text", "ranges"])

    return mapped(texts, run, "cls long, text string, ranges binary")


def enough(both: int, total: int) -> bool:
    """Whether two sets with `both` tokens in common and `total` tokens, counted apart, link."""
    return SHARE[1] * both >= SHARE[0] * total


def candidates(pairs: DataFrame, store: DataFrame, n: int) -> DataFrame:
    """The pairs whose counts by ranges leave enough room for a link."""

    def ready(row):
        return jaccard.ranges_of([row[0]], RANGES)[0].astype(np.int64)

    def test(own, row):
        others = ready(row)
        return enough(int(np.minimum(own, others).sum()), int(own.sum() + others.sum()))

    return jaccard.met(pairs, store.select("cls", "ranges"), n, ready, test)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (rising tokens) link."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return enough(int((a[at] == b).sum()), len(a) + len(b))


CIRCULANT = jaccard.Method(postings, stored, candidates, links, sketch=False, share=SHARE, ordered=False, ranges=RANGES)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (whether the row has the component's id) of each row."""
    found = jaccard.components(docs, id_col, text_col, method=CIRCULANT)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns, as `jaccard.deduplicate` says."""
    return jaccard.deduplicate(docs, id_col, text_col, CIRCULANT)


def op12_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return components(table(spark, sf_dir, "documents"))


QUERIES = {"op12_circulant_minhash": op12_circulant_minhash}
ORACLES = {"op12_circulant_minhash": jaccard.ORACLE.replace(">= 80 *", ">= 85 *").replace("min(o.doc_id) AS component_id", "min(o.doc_id) AS component_id, any_value(d.doc_id) IS NOT DISTINCT FROM min(o.doc_id) AS kept")}
