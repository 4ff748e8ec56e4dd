"""Exact top-k inner-product search with vector-approximation files.

The index is a Parquet table of rows, their approximations and their exact vectors in columns of their own, so a scan
of approximations reads nothing else. An approximation has one byte for each component, the number of the quantile
cell the component lies in. Cells come from a bounded sample (`SAMPLE` vectors, the smallest hashes of the ids), with
the outermost edges at the true least and greatest component of all rows, so every row is indexed and every cell has
finite edges.

A search scans the approximations: the edges of a row's cells give a lower and an upper bound of its score for each
query. Each task drops rows whose upper bound is below the kth lower bound that it has seen, and what the tasks leave is
cut once more by the kth lower bound of all. Exact vectors are then read in order of falling upper bounds: those of the
`FIRST` x k best bounds first, whose kth score tells which of the others can still be among the best; only these follow.

Of rows with equal vectors, which no bound tells apart, only the k + 1 smallest ids can be results (one may be the
query's own row), so the others leave the file before the search. A task passes on what it has found whenever that is
more than `HELD` candidates after pruning.

Scale: queries come to the driver in blocks of `QUERY_BLOCK`, of which one at a time is broadcast; each block scans all
approximations once. Only row numbers and bounds are shuffled and ranked, and exact vectors only where rows are left
over (joined by row number; on large tables Spark filters the vectors by a Bloom filter of the rows first). Results of
blocks are written to the shared folder.

Nulls: vectors that are null, or hold a null or non-finite component, take no part, and so do rows with a null id.
Vectors of another length than the query's are no candidates for it; an empty vector scores 0 with other empty ones.
Repeated ids are rows of their own: the query's own row is left out, which other rows of the same id and vector are
not; ties go to the smaller id. An empty table gives an empty table. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklark.llm.batches import mapped, slices
from tracklark.session import discard, materialize, table

CELLS = 256
SAMPLE = 2048
QUERY_BLOCK = 4096
#: Queries whose bounds for some rows are held at a time.
QUERIES_AT_ONCE = 256
#: Exact vectors are read for so many times k of the highest bounds first.
FIRST = 2
#: Rows whose bounds are worked out at a time.
ROWS_AT_ONCE = 512
#: A task holds so many candidates (32 bytes each) at most, and those of one part of a batch.
HELD = 1 << 20
#: Rows with equal vectors are ranked within so many parts first.
SALTS = 32
#: Exact in double precision while all sums stay below this.
EXACT = float(1 << 53)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and the vector as doubles, of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)


def cell_edges(rows: DataFrame, cells: int = CELLS) -> dict[int, np.ndarray]:
    """By vector length, an array of (component, edge): rising edges of the cells."""
    ends = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"))
    sample = defaultdict(list)
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect():
        sample[len(r.v)].append(r.v)
    out = {}
    for r in ends.collect():
        seen = np.array(sample[r.d], float).reshape(-1, r.d)
        inner = np.quantile(seen, np.linspace(0, 1, cells + 1)[1:-1], axis=0).T if len(seen) else np.zeros((r.d, cells - 1))
        inner = np.clip(inner, r.low, r.high)
        out[r.d] = np.hstack([np.full((r.d, 1), r.low), inner, np.full((r.d, 1), r.high)])
    return out


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = CELLS) -> tuple[DataFrame, dict[int, np.ndarray], str]:
    """The vector-approximation file: row (a number), mark (equal for equal vectors), size, cells (a byte for each
    component), vec_id and v; the cells' edges; and where the file is."""
    rows = usable(vectors, id_col, vector_col)
    edges = cell_edges(rows, cells)
    shared = vectors.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks: list[bytes] = [b""] * batch.num_rows
            size = np.zeros(batch.num_rows, np.int32)
            for d, at, v in by_length(batch.column(1)):
                size[at] = d
                if d:
                    own = shared.value[d]
                    code = np.stack([np.searchsorted(own[k, 1:-1], v[:, k], "right") for k in range(d)], axis=1).astype(np.uint8)
                    for p, row in zip(at, code, strict=True):
                        marks[p] = row.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(marks, pa.binary()), batch.column(0), batch.column(1)], names=["size", "cells", "vec_id", "v"])

    marked = mapped(rows, run, "size int, cells binary, vec_id long, v array<double>")
    done, path = materialize(marked.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("v").alias("mark"), "*"))
    shared.destroy()
    return done, edges, path


def told_apart(file: DataFrame, most: int) -> tuple[DataFrame, str | None]:
    """The file without rows that at least `most` rows of the same vector and smaller ids stand before; and where it is,
    if it was written anew."""
    many = file.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("mark")
    if many.isEmpty():
        return file, None
    few = file.join(many, "mark", "left_semi").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    for by in (["mark", "v", "salt"], ["mark", "v"]):
        few = few.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id", "row"))).where(F.col("at") <= most)
    return materialize(file.join(many, "mark", "left_anti").unionByName(few.select(*file.columns)))


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) for each vector length of a list column without nulls."""
    size = np.diff(column.offsets.to_numpy())
    first = column.offsets.to_numpy()[:-1]
    flat = column.values.to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield int(d), at, flat[first[at][:, None] + np.arange(d)]


class Bounds:
    """The rows of one task that can be among the best k of each query of one vector length, by their approximations."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None, k: int):
        self.edges, self.k = edges, k
        self.plus, self.minus = np.maximum(vectors, 0), np.minimum(vectors, 0)
        self.lows = np.full((len(vectors), k), -np.inf)
        self.found: list[np.ndarray] = []
        self.held = 0

    def add(self, rows: np.ndarray, code: np.ndarray | None) -> None:
        if code is not None:
            k = np.arange(code.shape[1])
            left, right = self.edges[k, code].T, self.edges[k, code + 1].T
        for q in range(0, len(self.lows), QUERIES_AT_ONCE):
            own = slice(q, q + QUERIES_AT_ONCE)
            plus, minus, least = self.plus[own], self.minus[own], self.lows[own].min(axis=1)
            # Sums of doubles that are no integers round; bounds get the slack that this can take.
            high = np.zeros((len(least), len(rows))) if code is None else plus @ right + minus @ left
            high += 1e-12 * (np.abs(high) + 1)
            # Only rows that can be among the best need their lower bound.
            n, at = np.nonzero(high >= least[:, None])
            if code is None:
                low = np.zeros(len(n))
            elif 8 * len(n) > high.size:
                low = (plus @ left + minus @ right)[n, at]
            else:
                low = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", plus[a], left.T[b]) + np.einsum("ij,ij->i", minus[a], right.T[b]) for a, b in zip(np.array_split(n, len(n) // 8192 + 1), np.array_split(at, len(n) // 8192 + 1), strict=True))])
            low -= 1e-12 * (np.abs(low) + 1)
            self.raise_least(q, n, low)
            keep = high[n, at] >= self.lows[own].min(axis=1)[n]
            n, at, low = n[keep], at[keep], low[keep]
            self.found.append(np.rec.fromarrays([n + q, rows[at], low, high[n, at]], names="n,row,low,high"))
            self.held += len(n)

    def raise_least(self, first: int, n: np.ndarray, low: np.ndarray) -> None:
        """Take lower bounds of queries (first + n, rising) into their k best ones."""
        if not len(n):
            return
        start = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
        for a, b in zip(start, [*start[1:], len(n)], strict=True):
            own = self.lows[first + n[a]]
            both = np.concatenate([own, low[a:b]])
            self.lows[first + n[a]] = np.partition(both, len(both) - self.k)[-self.k :]

    def prune(self) -> None:
        """Drop what later rows have ruled out."""
        both = np.concatenate(self.found)
        self.found = [both[both["high"] >= self.lows.min(axis=1)[both["n"]]]]
        self.held = len(self.found[0])

    def taken(self, most: int) -> np.ndarray | None:
        """What was found so far, if more than `most` of it is left after pruning; it is forgotten then."""
        if self.held > most:
            self.prune()
        if self.held <= most:
            return None
        out, self.found, self.held = self.found[0], [], 0
        return out


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; whole numbers too large for doubles are summed as Python's integers."""
    if vectors.size and np.abs(vectors).max() * max(np.abs(query).max(), 1) * len(query) >= EXACT and (query == np.floor(query)).all():
        return np.array([sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in vectors], dtype=object)
    return vectors @ query


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = CELLS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score (double) of the k best rows for each row of `queries`, its own row left out.

    A query whose row is among `vectors` is recognised by its id and vector; one such row is left out.
    """
    spark = vectors.sparkSession
    file, edges, path = index(vectors, id_col, vector_col, cells)
    todo = usable(queries, id_col, vector_col).toLocalIterator()
    file, other = told_apart(file, k + 1)
    parts = []
    while block := list(islice(todo, query_block)):
        parts.append(searched(file, edges, [(r.vec_id, np.array(r.v, float)) for r in block], k))
    discard(spark, path, *([other] if other else []))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def scanned(file: DataFrame, shared, most: int, held: int | None = None) -> DataFrame:
    """n (a query of the block), row, low and high of the rows that each task leaves for each query, by bounds of the
    score. shared: the broadcast (block, edges)."""
    held = held or HELD

    def out(found: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(found), 1 << 16):
            part = found[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(names[part["n"]]), *(pa.array(part[c].copy()) for c in ("row", "low", "high"))], names=["n", "row", "low", "high"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, edges = shared.value
        sets = defaultdict(list)
        for n, (_, v) in enumerate(block):
            sets[len(v)].append(n)
        names = {d: np.array(own, np.int32) for d, own in sets.items()}
        bounds = {d: Bounds(np.stack([block[n][1] for n in own]), edges.get(d), most) for d, own in sets.items()}
        for batch in batches:
            rows, size, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                for a in range(0, len(at) if d in bounds else 0, ROWS_AT_ONCE):
                    p = at[a : a + ROWS_AT_ONCE]
                    code = np.frombuffer(b"".join(marks.take(pa.array(p)).to_pylist()), np.uint8).reshape(-1, d).astype(np.intp) if d else None
                    bounds[d].add(rows[p], code)
                    if (full := bounds[d].taken(held)) is not None:
                        yield from out(full, names[d])
        for d, one in bounds.items():
            if one.found:
                one.prune()
                yield from out(one.found[0], names[d])

    return mapped(file.select("row", "size", "cells"), scan, "n int, row long, low double, high double")


def searched(file: DataFrame, edges: dict[int, np.ndarray], block: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """The best k for each query of a block."""
    spark = file.sparkSession
    shared = spark.sparkContext.broadcast((block, edges))
    # One more than k, since the query's own row is left out at the end.
    most = k + 1

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, _ = shared.value
        for batch in slices(batches):
            n, names = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            query, score, own = np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n), bool)
            for _, at, v in by_length(batch.column(2)):
                for q in np.unique(n[at]):
                    name, vector = block[q]
                    p = np.flatnonzero(n[at] == q)
                    query[at[p]], score[at[p]] = name, exact(v[p], vector).astype(float)
                    own[at[p]] = (names[at[p]] == name) & (v[p] == vector).all(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(query), batch.column(1), pa.array(score), pa.array(own)], names=["n", "query_id", "vec_id", "score", "own"])

    def ranks(*order):
        return F.row_number().over(Window.partitionBy("n").orderBy(*order))

    def read(some: DataFrame) -> DataFrame:
        """Exact scores of (n, row)."""
        both = some.select("n", "row").join(file.select("row", "vec_id", "v"), "row").select("n", "vec_id", "v")
        return mapped(both, scores, "n int, query_id long, vec_id long, score double, own boolean")

    seen, seen_path = materialize(scanned(file, shared, most))
    # The kth lower bound of all tasks cuts once more; at is a row's place in the order of reading.
    lows = seen.select("n", "low", ranks(F.desc("low")).alias("at")).where(F.col("at") == most).select("n", F.col("low").alias("least"))
    left = seen.join(lows, "n", "left").where("least IS NULL OR high >= least").drop("least")
    left, left_path = materialize(left.withColumn("at", ranks(F.desc("high"), "row")))
    first, first_path = materialize(read(left.where(F.col("at") <= FIRST * most)))
    # The rows behind those that their bound still lets in.
    kth = first.select("n", "score", ranks(F.desc("score")).alias("at")).where(F.col("at") == most).select("n", F.col("score").alias("least"))
    rest = left.where(F.col("at") > FIRST * most).join(kth, "n").where("high >= least")
    # One more than k are ranked, of which the first own row goes.
    top = first.unionByName(read(rest)).withColumn("at", ranks(F.desc("score"), "vec_id")).where(F.col("at") <= most)
    top = top.withColumn("mine", F.min(F.when(F.col("own"), F.col("at"))).over(Window.partitionBy("n"))).where("mine IS NULL OR at <> mine")
    top = top.withColumn("rank", F.col("at") - F.coalesce((F.col("at") > F.col("mine")).cast("int"), F.lit(0)))
    out, _ = materialize(top.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    discard(spark, seen_path, left_path, first_path)
    shared.destroy()
    return out


def op6_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all integer vectors for each query row."""
    # floor() gives whole numbers for NaN and infinities too, so rows that take no part go before it.
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", F.transform("v", lambda x: F.floor(x * 64.0).cast("double")).alias("embedding"))
    found = top_k(rows, rows.where(F.col("vec_id") % 20 == 0), 20)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


ORACLE = """
WITH e AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q, e c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op6_vector_top_k": op6_vector_top_k}
ORACLES = {"op6_vector_top_k": ORACLE}
