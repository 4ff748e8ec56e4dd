"""Variable-capacity best-fit packing into several permitted sequence lengths.

A bin's price is its sequence length plus a fixed part and an attention part. Documents are packed in blocks: those
of one task, `BLOCK_ROWS` rows at a time. In a block, pieces go longest first into the open bin they fill best,
whatever its capacity; if none has room, a bin of the permitted length opens that is cheapest for a token, but no
shorter than an opening floor. Each permitted length is tried as that floor, every bin is downsized to the shortest
permitted length that holds its contents, and the floor with the least total price is kept. Documents longer than the
longest bin are cut into pieces, so no token is lost.

Scale: nothing is shuffled or collected; a task holds one block of ids and lengths. Each block ends with at most a
few half-filled bins, which downsizing shrinks.

Nulls: a null or negative length counts as 0 and the document still gets one piece of no tokens. Repeated rows are
packed each for itself. An empty table gives an empty table. Only the id and the length are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracklark.llm.batches import mapped, per_row
from tracklark.session import table

LENGTHS = (512, 1024, 2048, 4096, 8192)
BLOCK_ROWS = 1 << 15
OUT = "piece int, start long, n_tokens long, bin_id long, bin_start long, bin_used long, bin_length long"


def price(length: int) -> float:
    """A sequence's cost: a fixed part, its tokens, and attention, which grows with the square."""
    return 64 + length + length * length / 65536


def fit(sizes: list[int], floor: int, lengths: tuple[int, ...], cost: Callable[[int], float]) -> tuple[list[int], list[int]]:
    """Best fit of sizes in descending order with bins no shorter than `floor`: each size's bin, and each bin's contents."""
    room: list[int] = []  # distinct free rooms in order
    having: dict[int, list[int]] = {}
    bins: list[int] = []
    used: list[int] = []
    for size in sizes:
        k = bisect_left(room, size)
        if k < len(room):
            free = room[k]
            b = having[free].pop()
            if not having[free]:
                del having[free], room[k]
        else:
            b, free = len(used), min((x for x in lengths if x >= max(size, floor)), key=lambda x: (cost(x) / x, x))
            used.append(0)
        bins.append(b)
        used[b] += size
        if left := free - size:
            if left not in having:
                insort(room, left)
                having[left] = []
            having[left].append(b)
    return bins, used


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = price) -> tuple[list[int], list[int], list[int]]:
    """Bins of one block: each size's bin, and each bin's contents and downsized length."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    falling = [sizes[k] for k in order]
    shrunk = lambda used: [lengths[bisect_left(lengths, u)] for u in used]
    found = []
    for floor in lengths:
        bins, used = fit(falling, floor, lengths, cost)
        fitted = shrunk(used)
        found.append((sum(map(cost, fitted)), floor, bins, used, fitted))
    _, _, bins, used, fitted = min(found, key=lambda x: x[:2])
    out = [0] * len(sizes)
    for k, b in zip(order, bins, strict=True):
        out[k] = b
    return out, used, fitted


def best_fit(docs: DataFrame, length_col: str = "n_tokens", id_col: str = "doc_id", lengths: tuple[int, ...] = LENGTHS, block_rows: int = BLOCK_ROWS, cost: Callable[[int], float] = price) -> DataFrame:
    """One row for each piece of each document: where it starts, its bin, and where in the bin it stands."""
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    kind = StructType([narrow.schema["doc_id"], *StructType.fromDDL(OUT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(kind)
        made = TaskContext.get().partitionId() << 40

        def packed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            pieces = [(d, p, at, min(longest, n - at)) for d, n in rows for p, at in enumerate(range(0, max(n, 1), longest))]
            bins, used, fitted = pack([x[3] for x in pieces], lengths, cost)
            filled = [0] * len(used)
            out = []
            for (d, p, at, size), b in zip(pieces, bins, strict=True):
                out.append((d, p, at, size, made + b, filled[b], used[b], fitted[b]))
                filled[b] += size
            made += len(used)
            for k in range(0, len(out), 1 << 16):
                columns = zip(*out[k : k + (1 << 16)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, into, strict=True)], schema=into)

        held: list[tuple] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= block_rows:
                yield from packed(held[:block_rows])
                del held[:block_rows]
        if held:
            yield from packed(held)

    return mapped(narrow, run, kind)


def with_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens: the words between white space, and one for the end mark."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = StructType([narrow.schema["doc_id"], *StructType.fromDDL("n_tokens long")])
    return per_row(narrow, kind, lambda: lambda doc_id, text: (doc_id, 1 + len((text or b"").split())))


def op7_variable_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed."""
    return best_fit(with_lengths(table(spark, sf_dir, "documents")))


QUERIES = {"op7_variable_bins": op7_variable_bins}
