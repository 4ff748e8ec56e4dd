"""Compression of vectors to short codes with integer codebooks, one for each part of a vector.

Components become whole numbers, floor(scale * x); a vector is cut into equal consecutive parts, and each part is
replaced by the number of its nearest codebook entry. Codebooks start as the parts of the first rows by id. A round
sends them to all tasks, which assign every part and return sums and counts for each entry; these are added by a
grouped shuffle, and each entry becomes the floor of its mean. All arithmetic is in whole numbers, so results depend on
neither the order of rows nor their partitions.

Nearest entries: |x - c|^2 = |x|^2 - 2 x.c + |c|^2, all products as int64 matrices, the first of equal distances.

Scale: the rows are written once as whole numbers and read once in each round; nothing of a row is shuffled. A task
returns at most one number for each component of the codebooks, and so does the shuffle's result, which is all that
comes to the driver (parts * entries * length of a part numbers). Sums over tasks are decimals and don't overflow. Label
totals are joined to the rows as a broadcast where there are at most `FEW_LABELS`, else by a shuffle.

Nulls: rows whose vector is null or holds a null or a component that isn't finite take no part. Neither do vectors of
another length than most rows have (the longer one of equally frequent lengths), of a length that the number of parts
doesn't divide, or with whole numbers so large that a squared distance would not fit into 62 bits. Equal ids are ordered
by their vectors, null ids come last. Fewer rows than entries give as many entries as rows. Repeated rows count each for
itself, an empty table gives an empty table, and only the columns named are read. A label's total that doesn't fit into
a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracklark.llm.batches import mapped, slices
from tracklark.session import discard, materialize, small_enough, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: So many label totals at most are broadcast (some 20 bytes each for numbers).
FEW_LABELS = 100_000


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, length and the whole numbers of the rows that can take part."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    narrow = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = StructType([narrow.schema["vec_id"], narrow.schema["label"], *StructType.fromDDL("length int, v array<int>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(batch.column(2).is_valid())
            length = batch.column(2).value_lengths().to_numpy().astype(np.int64)
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)  # null components as NaN
            with np.errstate(invalid="ignore", over="ignore"):
                numbers = np.floor(x * float(scale))
            # The bound of a component depends on the length of a part.
            bound = np.array([min(isqrt((1 << 60) // max(n // parts, 1)), (1 << 31) - 1) for n in length.tolist()], float)
            fine = np.isfinite(x) & (np.abs(numbers) < np.repeat(bound, length))
            bad = np.append(0, np.cumsum(~fine))
            last = np.cumsum(length)
            ok = (length > 0) & (length % parts == 0) & (bad[last] == bad[last - length])
            kept = numbers[np.repeat(ok, length)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length[ok])), pa.int32()), pa.array(kept))
            rows = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(length[ok].astype(np.int32)), lists], names=["vec_id", "label", "length", "v"])

    return mapped(narrow, run, kind)


def matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Rows x parts x length of a part, from lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1)


def nearest(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part and its squared distance. v: rows x parts x p; books: parts x entries x p."""
    entry, away = np.zeros(v.shape[:2], np.int64), np.zeros(v.shape[:2], np.int64)
    norms = (books * books).sum(axis=2)
    for k in range(v.shape[1]):
        x = np.ascontiguousarray(v[:, k])
        distance = norms[k] - 2 * (x @ books[k].T)
        entry[:, k] = distance.argmin(axis=1)
        away[:, k] = distance.min(axis=1) + (x * x).sum(axis=1)
    return entry, away


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over the rows."""
    parts, entries, p = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in slices(batches):
            v = matrix(batch.column(0), parts)
            entry, _ = nearest(v, books)
            for k in range(parts):
                own = np.zeros((entries, len(v)), np.int64)
                own[entry[:, k], np.arange(len(v))] = 1
                total[k] += own @ np.ascontiguousarray(v[:, k])
                count[k] += own.sum(axis=1)
        part, at = np.nonzero(count)
        flat = total[part, at]
        names = [np.repeat(x, p).astype(np.int32) for x in (part, at)] + [np.tile(np.arange(p, dtype=np.int32), len(part))]
        yield pa.RecordBatch.from_arrays([*map(pa.array, names), pa.array(flat.ravel()), pa.array(np.repeat(count[part, at], p))], names=["part", "entry", "place", "total", "count"])

    sums = mapped(rows.select("v"), run, "part int, entry int, place int, total long, count long").groupBy("part", "entry", "place")
    out = books.copy()
    for r in sums.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("count").alias("count")).collect():
        out[r.part, r.entry, r.place] = int(r.total) // r["count"]
    shared.destroy()
    return out


def fitted(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x length of a part) of the rows, all of one length."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = moved(rows, books)
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits for each part) and error, the sum of squared distances."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kind = StructType([rows.schema["vec_id"], rows.schema["label"], *StructType.fromDDL("code string, error long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            entry, away = nearest(matrix(batch.column(2), len(shared.value)), shared.value)
            code = [row.tobytes().hex() for row in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(away.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return mapped(rows.select("vec_id", "label", "v"), run, kind)


def decoded(code: str, books: np.ndarray) -> list[int]:
    """The whole numbers that a code stands for."""
    return [int(x) for k, entry in enumerate(bytes.fromhex(code)) for x in books[k, entry]]


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error and label_error (the sum of errors of all rows of the label) of the rows that take
    part; and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a part's code is one byte: 1 to 256 entries")
    spark = vectors.sparkSession
    rows, held = materialize(whole_numbers(vectors, id_col, vector_col, label_col, parts, scale))
    lengths = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).limit(2).collect()
    length = lengths[0]["length"] if lengths else parts
    if len(lengths) > 1:
        rows = rows.where(F.col("length") == length)
    books = fitted(rows, length, parts, entries, rounds) if lengths else np.zeros((parts, 0, 1), np.int64)
    done, _ = materialize(encoded(rows, books))
    discard(spark, held)
    by_label = done.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    if small_enough(by_label, FEW_LABELS):
        by_label = F.broadcast(by_label)
    return done.join(by_label, done["label"].eqNullSafe(by_label["of"])).drop("of"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, and the digest of the codebooks."""
    found, books = compressed(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in SQL: each round is a table of nearest entries (n) and one of codebooks (c)."""
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"""d{k} AS MATERIALIZED (SELECT rid, v.part, entry, sum((v.x - c.x) * (v.x - c.x)) AS away FROM v JOIN c{k} c ON v.part = c.part AND v.place = c.place GROUP BY ALL),
n{k} AS MATERIALIZED (SELECT rid, part, arg_min(entry, (away, entry)) AS entry, min(away) AS away FROM d{k} GROUP BY ALL)"""
        )
        if k < rounds:
            steps.append(
                f"""s{k} AS (SELECT n.part, n.entry, v.place, sum(v.x) AS t, count(*) AS n FROM n{k} n JOIN v ON v.rid = n.rid AND v.part = n.part GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.place, CAST(coalesce((t - ((t % n) + n) % n) // n, c.x) AS BIGINT) AS x FROM c{k} c LEFT JOIN s{k} s ON s.part = c.part AND s.entry = c.entry AND s.place = c.place)"""
            )
    return f"""
WITH e AS (
  SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, z) AS rid, * FROM e),
v AS MATERIALIZED (
  SELECT rid, (k - 1) // (len(z) // {parts}) AS part, (k - 1) % (len(z) // {parts}) AS place, z[k] AS x FROM r, unnest(range(1, len(z) + 1)) AS t(k)
),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, place, x FROM v WHERE rid <= {entries}),
{",".join(steps)},
o AS (SELECT rid, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(away) AS BIGINT) AS error FROM n{rounds} GROUP BY rid),
b AS (SELECT sha256(coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place), '')) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN o USING (rid), b
"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLES = {"op11_vector_codes": oracle()}
