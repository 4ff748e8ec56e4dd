"""N-gram Jaccard join with filters of several global token orders.

Texts are sets of five-word shingles; two link if 5 * |intersection| >= 4 * |union|. If sets that link are sorted by
any one order of all tokens, their prefixes of n - ceil(4n / 5) + 1 tokens share a token. Three orders are used. All
put the tokens first that are rare in the corpus (by a sketch of shingle counts, so that passages which many texts
repeat come last) and differ in how they order tokens as rare as each other. Candidates are intersected before any set
is sent:

1. Postings of the prefixes under the first order are grouped by token; sizes and positions are tested there.
2. The pairs found meet their prefixes under the second and the third order and go unless they share a token of each.
   They also go if counts by `RANGES` ranges of token numbers leave too small an overlap.
3. The pairs left meet their sets for the exact count.

Only connectivity is asked for, so pairs inside a component need not all be listed. Texts with equal sets are one
class. A list of up to `SHORT_LIST` members gives all its pairs at once, each only in the list of the first token that
both have (their tokens before it differ). In a longer list the members pair with a few leaders at a time (1, then 64,
then 4096 more), the same classes in all lists; leaders and members that verified links already connect are not paired,
and later rounds test counts by ranges inside the list. Of the pairs of the first round each member tries the first of its
leaders; the others follow only where they still join two components. Lists are dropped once they lie
within one component or every member has led. So no link between different components is missed, and the pairs of a
round are at most a fixed number for each posting. A list of any length streams by its leaders; it is never held.

Scale: whole texts are read three times and not shuffled; postings (four numbers) are shuffled once. Classes that are in
a pair or an open list after the first round are stored again, as texts with their filters' data; verification
reads that store. Sets are sent for pairs only, dealt by leader and salt, so that a hot leader spreads over tasks. What
is broadcast has a size bound: one byte for each of 2^SKETCH_BITS counters, and a bit table of the wanted classes (2^23
to 2^27 bits; collisions cost time, not results). Intermediate tables go to the shared folder.

Class numbers have 64 bits and are checked by 64 more: numbers that two different sets share are found in the table of
all rows, sent to the tasks (some hundreds among 10^11 sets) and replaced by numbers from both.

Nulls: null texts and texts without words have an empty set and link with nothing. Null ids are ignored as component
ids. Repeated rows are rows of their own, in one class. An empty table gives an empty table. `deduplicate` passes
all columns through whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tracklark.llm.batches import mapped, slices
from tracklark.llm.components import roots
from tracklark.llm.shingles import U, mix, set_numbers, sets_of
from tracklark.session import discard, materialize, small_enough, table

#: The sketch has 2^SKETCH_BITS counters and travels in segments.
SKETCH_BITS, SEGMENT = 22, 1 << 16
#: Classes that a task has sent are remembered up to this number.
REMEMBERED = 1 << 16
#: So many pairs at most are broadcast (24 bytes each) to meet their sets without a shuffle; more are joined.
BROADCAST_PAIRS = 500_000
#: So many ids of rows that may go are broadcast at most; more are looked up in a bit table in Python.
BROADCAST_IDS = 1_000_000
#: Rows of texts whose sets are held at a time.
ROWS = 512
#: Ranges that token numbers are cut into for the test of counts.
RANGES = 64
#: The table of wanted classes has 2^23 bits, or more for more classes, up to 2^27.
LEAST_BITS, MOST_BITS = 23, 27
#: Lists of so many members give all pairs in the first round.
SHORT_LIST = 16
#: Each round has so many times more leaders than the one before, up to a bound.
MORE_LEADERS, MOST_LEADERS = 64, 4096
#: Sets link if so many times their overlap is at least so many times the sum of their sizes (4 / 9: similarity 0.8).
SHARE = 4, 9
#: Pairs of one leader are dealt to tasks so many at a time.
LEADER_PAIRS = 512


def required(n):
    """The least overlap of a set of n tokens with any set it links to."""
    return (4 * n + 4) // 5


def class_number(tokens: np.ndarray, bits: int, torn: frozenset) -> tuple[int, int]:
    """A set's class and the number that checks it. torn: classes that stood for several sets."""
    one, two = set_numbers(tokens)
    if bits < 64:
        one &= (1 << bits) - 1
    return (one ^ two if one in torn else one), two


def classed(docs: DataFrame, id_col: str, text_col: str, bits: int = 64, sketch: bool = True) -> DataFrame:
    """doc_id, n_shingles, cls and check (null without shingles) of each row; and, in rows with `at`, segments of the
    counts of tokens by their highest bits, each class counted once in a task (none without `sketch`)."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_shingles", "cls", "check", "at", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, held, size = np.zeros(1 << SKETCH_BITS, np.uint32), set(), [], 0
        for batch in slices(batches, ROWS):
            found = []
            for s in sets_of(batch.column(1)):
                if not len(s):
                    found.append((0, None, None))
                    continue
                cls, check = class_number(s, bits, frozenset())
                found.append((len(s), cls, check))
                if sketch and check not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(check)
                    held.append((s >> U(64 - SKETCH_BITS)).astype(np.uint32))
                    size += len(s)
            if size > 1 << 20:
                count(total, held)
                held, size = [], 0
            n, cls, check = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(check, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        if held:
            count(total, held)
        for p in range(0, len(total), SEGMENT):
            part = total[p : p + SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([p], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], names=names)

    return mapped(narrow, run, "doc_id long, n_shingles long, cls long, check long, at int, counts binary")


def count(total: np.ndarray, places: list[np.ndarray]) -> None:
    at, n = np.unique(np.concatenate(places), return_counts=True)
    total[at] += n.astype(np.uint32)


def rarity(parts: DataFrame) -> np.ndarray:
    """A byte for each counter of the sketch: 0 for counts that chance explains, then one more for each power of two.

    parts: at and counts. Where the corpus is so large that all counters are full, tokens still stand out whose count
    is above the spread of the mean.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint32)
                if at not in sums:
                    sums[at] = np.zeros(SEGMENT, np.int64)
                sums[at] += own
        for at, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["at", "counts"])

    total = np.zeros(1 << SKETCH_BITS, np.int64)
    found = mapped(parts.repartition(16, "at"), add, "at int, counts binary").toArrow()
    for at, counts in zip(found["at"].to_pylist(), found["counts"].to_pylist(), strict=True):
        total[at : at + SEGMENT] = np.frombuffer(zlib.decompress(counts), np.int64)
    mean = total.mean()
    above = total - (mean + 4 * np.sqrt(mean))
    return np.ceil(np.log2(np.maximum(above, 0) + 1)).astype(np.uint8)


def prefix(tokens: np.ndarray, rare: np.ndarray, order: int) -> np.ndarray:
    """The prefix of a set under an order, sorted by it."""
    n = len(tokens)
    length = n - required(n) + 1
    key = (rare[(tokens >> U(64 - SKETCH_BITS)).astype(np.intp)].astype(U) << U(58)) | (mix(tokens + U(order * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(6))
    first = np.argpartition(key, length - 1)[:length] if length < n else np.arange(n)
    return tokens[first[np.argsort(key[first])]]


def postings(texts: DataFrame, model) -> DataFrame:
    """token, cls, before and place of the prefix of each set under the first order. before: the token before it;
    place: the set's size and the token's position in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rare, bits, torn), seen = model.value, set()
        for batch in slices(batches, ROWS):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for tokens in sets_of(batch.column(0)):
                n = len(tokens)
                if not n or (cls := class_number(tokens, bits, torn)[0]) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(cls)
                first = prefix(tokens, rare, 0).view(np.int64)
                place = np.arange(len(first)) | n << 32
                for column, values in zip(out, (first, np.full(len(first), cls), np.append(0, first[:-1]), place), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["token", "cls", "before", "place"])

    return mapped(texts, run, "token long, cls long, before long, place long")


NAMES = ["kind", "x", "y", "before", "place"]
#: Rows of lists worked on at a time; a longer list streams by its leaders.
LIST_ROWS = 1 << 15


def sorted_lists(batches: Iterator[pa.RecordBatch], most: int = LIST_ROWS) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Rows sorted by token and class, without repeats, in parts: (True, columns of whole lists) or (False, columns of
    a part of one list). Parts of one list follow each other; of a list no more than a part is held."""
    held, last, long = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        token, cls = columns[:2]
        # A class is sent by every task that has a copy.
        new = np.append(last != (token[0], cls[0]), (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))
        last = token[-1], cls[-1]
        columns = [c[new] for c in columns]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
        if long is not None and len(columns[0]):
            # The list that was cut goes on in front, if it does.
            end = int(np.searchsorted(columns[0], long, "right"))
            if end:
                yield False, [c[:end] for c in columns]
            long = long if end == len(columns[0]) else None
            columns = [c[end:] for c in columns]
        token = columns[0]
        cut = int(np.searchsorted(token, token[-1])) if len(token) else 0
        if cut:
            yield True, [c[:cut] for c in columns]
        held = [c[cut:] for c in columns]
        if len(held[0]) > most:
            long = held[0][0]
            yield False, held
            held = None
    if held is not None and len(held[0]):
        yield True, held


def led_pairs(lists: DataFrame, leaders: int, most: int = LIST_ROWS, share: tuple[int, int] = SHARE, ordered: bool = True, sketch: int = RANGES) -> DataFrame:
    """Pairs (kind 0, x < y) of the first `leaders` members of each list with all members behind them, of short lists
    all pairs; and the members (kind 1: token, class) that have not led yet, if a list stays open.

    lists: token, cls, before, place, comp, and after the first round ranges (`sketch` of them), which pairs are tested
    with at once. ordered: whether tokens in common stand only from this token's position on.
    """
    first_round = len(lists.columns) == 5

    def tested(cls, before, place, comp, ranges, x, y, skip) -> np.ndarray:
        """The pairs (rows x, y) that may link. skip: those found in the list of an earlier token as well."""
        ok = comp[x] != comp[y]
        if skip is not None:
            ok &= ~skip | (before[x] != before[y]) | (place[x] & 0xFFFFFFFF == 0) | (place[y] & 0xFFFFFFFF == 0)
        x, y = x[ok], y[ok]
        n, m, pos_n, pos_m = place[x] >> 32, place[y] >> 32, place[x] & 0xFFFFFFFF, place[y] & 0xFFFFFFFF
        # This token, if it is the first in common, and all behind it.
        rest = np.minimum(n - pos_n, m - pos_m) if ordered else np.minimum(n, m)
        ok = share[1] * rest >= share[0] * (n + m)
        x, y = x[ok], y[ok]
        if ranges is not None:
            ok = may_link(ranges, x, y, share)
            x, y = x[ok], y[ok]
        return np.stack([cls[x], cls[y]], axis=1)

    def whole(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, comp = columns[0], columns[4]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(start, len(token)))
        keep = np.repeat((size > 1) & (np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)), size)
        if not keep.any():
            return
        token, cls, before, place, comp, *more = (c[keep] for c in columns)
        ranges = ranges_of(more[0], sketch) if more else None
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(start, len(token)))
        first, long = np.repeat(start, size), np.repeat(size > SHORT_LIST, size)
        rank = np.arange(len(token)) - first
        pairs, held = [], 0
        for r in range(min(max(leaders, SHORT_LIST), int(size.max()))):
            y = np.flatnonzero(rank > r if r < leaders else (rank > r) & ~long)
            # A leader of the first round ties its list together at once.
            found = tested(cls, before, place, comp, ranges, first[y] + r, y, ~long[y] if first_round else np.ones(len(y), bool))
            pairs.append(found)
            held += len(found)
            if held > LIST_ROWS:
                yield pairs_out(pairs)
                pairs, held = [], 0
        if held:
            yield pairs_out(pairs)
        yield from open_out(long & (rank >= leaders), token, cls, before, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: list[np.ndarray] = []
        of = None
        for done, columns in sorted_lists(batches, most):
            if done:
                for at in parts_of_lists(columns[0]):
                    yield from whole([c[at] for c in columns])
                continue
            # Part of a long list: its leaders, held from its first parts, come before the rows.
            if of != columns[0][0]:
                of, lead = columns[0][0], [c[:0] for c in columns]
            k, led = leaders - len(lead[0]), len(lead[0])
            lead = [np.concatenate([a, b[: max(k, 0)]]) for a, b in zip(lead, columns, strict=True)]
            both = [np.concatenate([a[:led], b]) for a, b in zip(lead, columns, strict=True)]
            token, cls, before, place, comp, *more = both
            ranges = ranges_of(more[0], sketch) if more else None
            rank = np.arange(len(token))
            for r in range(len(lead[0])):
                y = rank[max(r + 1, led) :]
                found = tested(cls, before, place, comp, ranges, np.full(len(y), r), y, None if first_round else np.ones(len(y), bool))
                if len(found):
                    yield pairs_out([found])
            yield from open_out(rank >= max(led, len(lead[0])), token, cls, before, place)

    return mapped(lists.repartition("token").sortWithinPartitions("token", "cls"), run, "kind byte, x long, y long, before long, place long")


def parts_of_lists(token: np.ndarray) -> Iterator[slice]:
    """Parts of about LIST_ROWS rows that end between lists."""
    at = 0
    while at < len(token):
        end = len(token)
        if end - at > LIST_ROWS:
            end = int(np.searchsorted(token, token[at + LIST_ROWS]))
            end = end if end > at else int(np.searchsorted(token, token[at], "right"))
        yield slice(at, end)
        at = end


def pairs_out(pairs: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate(pairs)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(both), np.int8)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.nulls(len(both), pa.int64()), pa.nulls(len(both), pa.int64())], names=NAMES)


def open_out(stay: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    if stay.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(stay.sum(), np.int8)), *(pa.array(c[stay]) for c in columns)], names=NAMES)


def range_counts(tokens: np.ndarray, ranges: int = RANGES) -> bytes:
    """How many tokens lie in each of so many equal ranges of token numbers (a power of two)."""
    counts = np.bincount((tokens >> U(64 - ranges.bit_length() + 1)).astype(np.intp), minlength=ranges)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def ranges_of(column, ranges: int = RANGES) -> np.ndarray:
    """Counts by ranges; those of large sets take four bytes each."""
    if all(len(b) == ranges for b in column):
        return np.frombuffer(b"".join(column), np.uint8).reshape(-1, ranges)
    return np.stack([np.frombuffer(b, np.uint8 if len(b) == ranges else np.uint32) for b in column])


def may_link(ranges: np.ndarray, x: np.ndarray, y: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """Which pairs of rows can share enough tokens: in each range at most the smaller of both counts."""
    out = np.zeros(len(x), bool)
    size = ranges.sum(axis=1, dtype=np.int64)
    for k in range(0, len(x), 1 << 14):
        a, b = x[k : k + (1 << 14)], y[k : k + (1 << 14)]
        out[k : k + (1 << 14)] = share[1] * np.minimum(ranges[a], ranges[b]).sum(axis=1, dtype=np.int64) >= share[0] * (size[a] + size[b])
    return out


def bit_table(numbers: DataFrame, bits: int) -> np.ndarray:
    """A table of 2^bits bits that holds all of `numbers` (one long column, repeats allowed)."""
    col = numbers.columns[0]
    place = F.shiftrightunsigned(col, 64 - bits)
    words = numbers.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{col}`, {64 - bits}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 6), np.int64)
    found = words.toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(U)


def fitting_bits(rows: int) -> int:
    """Eight bits for each row, within the bounds."""
    return min(max((8 * rows).bit_length(), LEAST_BITS), MOST_BITS)


def in_table(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    place = numbers.view(U) >> U(64 - (len(bits).bit_length() - 1) - 6)
    return (bits[(place >> U(6)).astype(np.intp)] >> (place & U(63))) & U(1) != 0


#: What the store holds of a class: its text, counts by ranges, and two prefixes (32 bits of each token, sorted).
STORE = "cls long, text string, ranges binary, second binary, third binary"


def stored(texts: DataFrame, classes: DataFrame, model) -> DataFrame:
    """The store of the classes wanted and of those that collide with them in the bit table. Each task sends a class
    once while it remembers it."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(bit_table(classes, fitting_bits(classes.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rare, bits, torn), seen = model.value, set()
        short = lambda t: np.sort((t >> U(32)).astype(np.uint32)).tobytes()
        for batch in slices(batches, ROWS):
            out = []
            for k, s in enumerate(sets_of(batch.column(0))):
                if not len(s) or (cls := class_number(s, bits, torn)[0]) in seen or not in_table(shared.value, np.array([cls]))[0]:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(cls)
                out.append((k, cls, range_counts(s), short(prefix(s, rare, 1)), short(prefix(s, rare, 2))))
            if out:
                k, cls, *rest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), batch.column(0).take(pa.array(k, pa.int64())), *(pa.array(x, pa.binary()) for x in rest)], names=["cls", "text", "ranges", "second", "third"])

    return mapped(texts, run, STORE)


def dealt(pairs: DataFrame) -> DataFrame:
    """Where classes go so that pairs (a, b) meet: cls, a, salt, b. A class goes to each of its leaders' tasks as a
    member, and as a leader (b is null) to each of its own."""
    leaders = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / LEADER_PAIRS) + 1).cast("int").alias("salts"))
    members = pairs.join(leaders, "a").select(F.col("b").alias("cls"), "a", F.pmod(F.xxhash64("b"), F.col("salts").cast("long")).cast("int").alias("salt"), "b")
    return members.unionByName(leaders.select(F.col("a").alias("cls"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b")))


def met(pairs: DataFrame, store: DataFrame, n: int, ready, test) -> DataFrame:
    """The pairs (a, b), n in number, for which test(ready(row of a), row of b) holds. store: cls, then the columns of
    the rows."""
    sent = dealt(pairs)
    if n <= BROADCAST_PAIRS:
        sent = F.broadcast(sent)
    rest = store.columns[1:]
    both = store.join(sent, "cls").select("a", "salt", "b", *rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own, last = None, None, None
        for batch in slices(batches):
            out = []
            for a, b, *row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), *(c.to_pylist() for c in batch.columns[3:]), strict=True):
                if b is None:
                    if a != lead:
                        lead, own, last = a, ready(row), None
                elif a == lead and b != last:
                    last = b
                    if test(own, row):
                        out.append((a, b))
            if out:
                x, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return mapped(both, run, "a long, b long")


def candidates(pairs: DataFrame, store: DataFrame, n: int) -> DataFrame:
    """The pairs that share a prefix token under the second and the third order as well and may link by ranges."""

    def ready(row):
        ranges, *prefixes = row
        counts = ranges_of([ranges])[0].astype(np.int64)
        return counts, counts.sum(), *(np.frombuffer(p, np.uint32) for p in prefixes)

    def test(own, row):
        counts, size, *prefixes = own
        others = ranges_of([row[0]])[0]
        if 9 * int(np.minimum(counts, others).sum()) < 4 * (int(size) + int(others.sum(dtype=np.int64))):
            return False
        return all(shares(p, np.frombuffer(q, np.uint32)) for p, q in zip(prefixes, row[1:], strict=True))

    return met(pairs, store.select("cls", "ranges", "second", "third"), n, ready, test)


def shares(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays have an element in common."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return bool((a[at] == b).any())


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (rising tokens) link."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return 9 * int((a[at] == b).sum()) >= 4 * (len(a) + len(b))


class Method(NamedTuple):
    """How candidates are found, for `class_roots`: the rows of the first lists, the store of classes that are in pairs
    or open lists (cls, text, ranges and more), the pairs that pass what the store tells of them, and the exact test.
    sketch: whether the lists need counts of tokens. share, ordered and ranges: as `led_pairs` takes them."""

    postings: Callable
    stored: Callable
    candidates: Callable
    links: Callable
    sketch: bool = True
    share: tuple[int, int] = SHARE
    ordered: bool = True
    ranges: int = RANGES


PREFIXES = Method(postings, stored, candidates, links)


def verified(pairs: DataFrame, store: DataFrame, n: int, links: Callable = links) -> DataFrame:
    """The pairs (a, b) that link."""
    spark = pairs.sparkSession
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    shared = spark.sparkContext.broadcast(bit_table(wanted, fitting_bits(2 * n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            part = batch.filter(pa.array(in_table(shared.value, batch.column(0).to_numpy())))
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets_of(part.column(1))], pa.binary())], names=["cls", "tokens"])

    sets = mapped(store.select("cls", "text"), run, "cls long, tokens binary")
    return met(pairs, sets, n, lambda row: np.frombuffer(row[0], U), lambda own, row: links(own, np.frombuffer(row[0], U)))


def class_roots(texts: DataFrame, rare: np.ndarray | None, bits: int = 64, torn: frozenset = frozenset(), method: Method = PREFIXES) -> tuple[DataFrame, list[str]]:
    """node and root of the classes that link with others, over all rows of `texts` (one column); and its paths."""
    spark = texts.sparkSession
    model = spark.sparkContext.broadcast((rare, bits, torn))
    lists = method.postings(texts, model).withColumn("comp", F.col("cls"))
    leaders, found, kept, paths = 1, None, [], []
    store = tried = edges = ranges = None

    def held(df: DataFrame) -> DataFrame:
        done, path = materialize(df)
        paths.append(path)
        return done

    def with_comp(pairs: DataFrame) -> DataFrame:
        """Only the pairs of different components."""
        if found is None:
            return pairs
        own = lambda side: found.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        return pairs.join(own("a"), "a", "left").join(own("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")

    def link(pairs: DataFrame) -> None:
        """Verify pairs and join the components that they connect."""
        nonlocal edges, found
        if n := pairs.count():
            new = held(verified(pairs, store, n, method.links))
            edges = new if edges is None else edges.unionByName(new)
            found, path = roots(edges)
            kept.append(path)

    while True:
        led = held(led_pairs(lists, leaders, share=method.share, ordered=method.ordered, sketch=method.ranges))
        pairs = led.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        pairs = held(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        if store is None:
            # All classes of later rounds are in this round's lists and pairs.
            classes = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(led.where("kind = 1").select(F.col("y").alias("cls")))
            store = held(method.stored(texts, held(classes.distinct()), model))
        if n := pairs.count():
            passed = method.candidates(pairs, store, n)
            if tried is None:
                passed = held(passed.withColumn("first", F.min("a").over(Window.partitionBy("b"))))
                link(passed.where("a = first").select("a", "b"))
                link(held(with_comp(passed.where("a <> first").select("a", "b"))))
            else:
                link(held(passed))
            tried = pairs if tried is None else tried.unionByName(pairs)
        still = led.where("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("cls"), "before", "place")
        if still.isEmpty():
            break
        lists = still.withColumn("comp", F.col("cls"))
        if found is not None:
            lists = still.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("token", "cls", "before", "place", F.coalesce("root", "cls").alias("comp"))
        if ranges is None:
            ranges = held(store.groupBy("cls").agg(F.min("ranges").alias("ranges")))
        lists = lists.join(ranges, "cls").select("token", "cls", "before", "place", "comp", "ranges")
        leaders = min(MORE_LEADERS * leaders, MOST_LEADERS)
    out = found if found is not None else spark.createDataFrame([], "node long, root long")
    discard(spark, *paths, *kept[:-1])
    model.destroy()
    return out, kept[-1:]


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64, method: Method = PREFIXES) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    return grouped(docs, id_col, text_col, bits, method)[0].select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def grouped(docs: DataFrame, id_col: str, text_col: str, bits: int = 64, method: Method = PREFIXES) -> tuple[DataFrame, frozenset]:
    """doc_id, n_shingles, cls, root and component_id (both null if the row is alone; component_id also if no row of
    its component has an id); and the class numbers that stood for several sets."""
    spark = docs.sparkSession
    both, _ = materialize(classed(docs, id_col, text_col, bits, method.sketch))
    rare = rarity(both.where("at IS NOT NULL").select("at", "counts")) if method.sketch else None
    rows = both.where("at IS NULL").drop("at", "counts")
    torn = frozenset(r[0] for r in rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").select("cls").collect())
    if torn:
        several = spark.createDataFrame([(c,) for c in torn], "cls long").withColumn("torn", F.lit(True))
        rows = rows.join(F.broadcast(several), "cls", "left").withColumn("cls", F.when(F.col("torn"), F.col("cls").bitwiseXOR(F.col("check"))).otherwise(F.col("cls")))
    rows = rows.select("doc_id", "n_shingles", "cls")
    linked, paths = class_roots(docs.select(F.col(text_col).alias("text")), rare, bits, torn, method)
    least = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    joined = least.join(linked.withColumnRenamed("node", "cls"), "cls")
    by_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    alone = least.where("copies > 1").join(linked.select(F.col("node").alias("cls")), "cls", "left_anti")
    named = joined.join(by_root, "root").select("cls", "root", "component_id").unionByName(alone.select("cls", F.col("cls").alias("root"), F.col("least").alias("component_id")))
    named, _ = materialize(named)
    discard(spark, *paths)
    return rows.join(named, "cls", "left"), torn


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", method: Method = PREFIXES) -> DataFrame:
    """One row of each group of rows that links connect, with all columns; rows without shingles or without an id all
    stay.

    The row with the smallest id stays; of several rows of that id with the same shingles the one with the smallest
    hash of its columns. A row is known by its id and its class, so rows that repeat an id stay if their texts are
    others. Only the texts of ids of which some row goes are shuffled.
    """
    spark = docs.sparkSession
    found, torn = grouped(docs, id_col, text_col, method=method)
    rows, held = materialize(found.where("root IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", "cls", "root").agg(F.count(F.lit(1)).alias("rows")))
    stays = rows.groupBy("root").agg(F.min(F.struct("doc_id", "cls")).alias("first")).select("first.doc_id", "first.cls", F.lit(True).alias("stays"))
    marked, _ = materialize(rows.join(stays, ["doc_id", "cls"], "left").select("doc_id", "cls", "rows", F.col("stays").isNull().alias("goes")).where("goes OR rows > 1"))
    schema, own_id = docs.schema, docs[f"`{id_col}`"].cast("long")
    mark = "marked" + "_" * max(map(len, docs.columns))  # no column's name
    ids = marked.select(F.col("doc_id").alias(mark)).distinct()
    if small_enough(ids, BROADCAST_IDS):
        # The rows of all other ids stay as they are, without a visit to Python.
        ids = F.broadcast(ids)
        clear, some = docs.join(ids, own_id == F.col(mark), "left_anti"), docs.join(ids, own_id == F.col(mark), "left_semi")
    else:
        clear, some = split_by_table(docs, own_id, ids)
    kind = StructType([StructField("row", schema), *StructType.fromDDL("doc_id long, cls long")])
    keyed = some.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cls = [class_number(s, 64, torn)[0] if len(s) else None for s in sets_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cls, pa.int64())], names=["row", "doc_id", "cls"])

    found, _ = materialize(mapped(keyed, named, kind))
    # Rows without shingles all stay; of the others one for each id and class that doesn't go.
    one = found.where("cls IS NOT NULL").groupBy("doc_id", "cls").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    kept = one.join(marked.where("goes").select("doc_id", "cls"), ["doc_id", "cls"], "left_anti").select("row.*")
    discard(spark, held)
    return clear.unionByName(kept).unionByName(found.where("cls IS NULL").select("row.*"))


def split_by_table(docs: DataFrame, own_id, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ids are surely not among `ids`, and the others, by a bit table."""
    spark, schema = docs.sparkSession, docs.schema
    hashes = ids.select(F.xxhash64(ids.columns[0]).alias("id"))
    shared = spark.sparkContext.broadcast(bit_table(hashes, fitting_bits(hashes.count())))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own_id.isNotNull().alias("known"), F.xxhash64(own_id).alias("id"))

    def part(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                held = in_table(shared.value, batch.column(2).to_numpy()) & batch.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_struct_array(batch.column(0).filter(pa.array(held == wanted)))

        return mapped(keyed, run, schema)

    return part(False), part(True)


def op9_ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT rid, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh
  FROM d
),
u AS (SELECT rid, md5(x) AS x FROM s, unnest(sh) AS t(x)),
n AS (SELECT rid, len(sh) AS n FROM s),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.rid <> b.rid GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT any_value(d.doc_id) AS doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM r JOIN d ON d.rid = r.a JOIN d o ON o.rid = r.b JOIN n ON n.rid = r.a GROUP BY r.a
"""

QUERIES = {"op9_ngram_components": op9_ngram_components}
ORACLES = {"op9_ngram_components": ORACLE}
