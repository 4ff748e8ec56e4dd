"""Matching of tracks: shared-frame scores, greedy and optimal one-to-one matching, selection of the longest."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from tracklark.functions.assignment import assign_counts, assign_sparse
from tracklark.functions.expressions import number_in
from tracklark.operators.graph import labels
from tracklark.operators.regions import with_inside
from tracklark.operators.spatial import dealt, within_radius
from tracklark.operators.steps import steps
from tracklark.session import discard, materialize, small_enough

# Shared frames needed, the largest mean distance, and the latest first frame of the red channel.
MIN_SHARED, MAX_MEAN_NM, RED, RED_LATEST_START, MAX_SEED_UM = 5, 2000.0, "R", 3, 3.0
#: Scores of a component that one task solves, some 200 bytes each.
MOST_SCORES = 5_000_000
#: Candidates of a reference that optimal matching lists at first.
NEAREST = 16
#: Up to so many pairs of rows that share a frame are all scored.
FEW_PAIRS = 5_000_000
#: So many rows of a profile at most are broadcast.
FEW_CHANNELS = 100_000


#: A task pairs about so many rows, holding up to so many rows of references, so many pairs at a time.
TASK_PAIRS, HELD_ROWS, PAIRS = 200_000_000, 500_000, 500_000
#: Below so many pairs a task is not worth its start.
LEAST_PAIRS = 1_000_000


def shared_frame_scores(refs: DataFrame, cands: DataFrame, least: int = MIN_SHARED, nearest: int | None = None) -> DataFrame:
    """Mean distance of each (ref, cand) pair of a channel over the frames both have, if those are `least` or more; with
    `nearest` only of so many nearest candidates of each reference (more of equal distance may go).

    refs: channel, ref, frame, x, y; cands: channel, cand, frame, x, y. Pairs of rows grow with the square of the tracks and
    are never shuffled: references and candidates are dealt to blocks, and a task holds a block of references and streams
    a block of candidates track by track, so that it sees all rows of a pair. Each row goes to as many tasks as the other
    side has blocks.
    """
    spark = refs.sparkSession
    sides = (refs.select("channel", "frame", "ref", *place()), cands.select("channel", "frame", "cand", *place()))
    sides = [df.dropna(subset=["channel", "frame"]) for df in sides]
    counts = [df.groupBy("channel", "frame").agg(F.count(F.lit(1)).cast("double").alias(n)) for df, n in zip(sides, ("refs", "cands"))]
    by_channel = counts[0].join(counts[1], ["channel", "frame"]).groupBy("channel").agg(F.sum(F.col("refs") * F.col("cands")).alias("pairs"), F.sum("refs").alias("rows"))
    pairs, rows, channels = by_channel.agg(F.max("pairs"), F.max("rows"), F.count(F.lit(1))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = max(1, ceil((rows or 0) / HELD_ROWS))
    wanted = max(min((pairs or 0) / LEAST_PAIRS, 2 * tasks / max(channels, 1)), (pairs or 0) / TASK_PAIRS)
    streamed = max(1, ceil(wanted / held))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    r = sides[0].select("channel", block("ref", held).alias("_i"), every(streamed).alias("_j"), F.lit(0).alias("_kind"), "ref", F.lit(None).cast(cands.schema["cand"].dataType).alias("cand"), "frame", "x", "y")
    c = sides[1].select("channel", every(held).alias("_i"), block("cand", streamed).alias("_j"), F.lit(1).alias("_kind"), F.lit(None).cast(refs.schema["ref"].dataType).alias("ref"), "cand", "frame", "x", "y")
    out = StructType([StructField(n, (refs if n in refs.columns else cands).schema[n].dataType) for n in ("channel", "ref", "cand")] + [StructField("shared", LongType()), StructField("mean_distance", DoubleType())])
    whole = r.union(c).repartition(max(tasks, max(channels, 1) * held * streamed), "channel", "_i", "_j").sortWithinPartitions("channel", "_i", "_j", "_kind", "cand")
    return whole.mapInArrow(partial(block_scores, least=least, nearest=nearest, schema=to_arrow_schema(out)), out)


def place() -> tuple[Column, Column]:
    return F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")


def runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of one value of `names` after another, in pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        new = np.zeros(batch.num_rows - 1, bool)
        for n in names:
            code = table[n].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new |= code[1:] != code[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield tuple(table[n][a].as_py() for n in names), table.slice(a, b - a)


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each row's number among the distinct values, and those."""
    found = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy().astype(np.int64), found.dictionary


class Held:
    """The references of a block by frame, and what is found for them."""

    def __init__(self, table: pa.Table, least: int, nearest: int | None, schema: pa.Schema):
        self.least, self.nearest, self.schema, self.channel = least, nearest, schema, table["channel"][0]
        of, self.refs = numbers(table["ref"])
        frame = table["frame"].to_numpy()
        order = np.argsort(frame, kind="stable")
        self.of, self.x, self.y = of[order], *[table[c].to_numpy()[order] for c in ("x", "y")]
        self.known = (table["x"].is_valid().to_numpy() & table["y"].is_valid().to_numpy())[order]
        self.frames, self.first = np.unique(frame[order], return_index=True)
        self.size = np.diff(np.append(self.first, len(frame)))
        # The nearest candidates so far, and beyond which distance one cannot be among them.
        self.kept: list[pa.Table] = []
        self.limit = np.full(len(self.refs), np.inf)

    def scores(self, cands: pa.Table) -> Iterator[pa.Table]:
        """Of whole tracks of candidates, some at a time."""
        at = np.searchsorted(self.frames, cands["frame"].to_numpy()).clip(0, len(self.frames) - 1)
        size = np.where(self.frames[at] == cands["frame"].to_numpy(), self.size[at], 0)
        of, names = numbers(cands["cand"])
        x, y = cands["x"].to_numpy(), cands["y"].to_numpy()
        known = cands["x"].is_valid().to_numpy() & cands["y"].is_valid().to_numpy()
        # Tracks follow each other, so their numbers rise.
        ends = np.flatnonzero(np.append(of[1:] != of[:-1], True)) + 1
        done = np.cumsum(size)[ends - 1] // PAIRS
        cuts = [0, *ends[np.flatnonzero(np.append(done[1:] != done[:-1], True))].tolist()]
        for a, b in zip(cuts, cuts[1:]):
            n = size[a:b]
            if n.sum():
                row = np.repeat(self.first[at[a:b]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                mine = np.repeat(np.arange(a, b), n)
                dx, dy = self.x[row] - x[mine], self.y[row] - y[mine]
                d = np.sqrt(dx * dx + dy * dy)
                yield from self.summed((of[mine] - of[a]) * len(self.refs) + self.of[row], d, self.known[row] & known[mine], names.slice(of[a], of[b - 1] - of[a] + 1))

    def summed(self, pair: np.ndarray, d: np.ndarray, known: np.ndarray, cands: pa.Array) -> Iterator[pa.Table]:
        cells, named = len(cands) * len(self.refs), None
        if cells > 8 * len(pair):
            named, pair = np.unique(pair, return_inverse=True)
            cells = len(named)
        shared = np.bincount(pair, minlength=cells)
        hit = np.flatnonzero(shared >= max(self.least, 1))
        full = bool(known.all())
        total = np.bincount(pair, weights=d if full else np.where(known, d, 0.0), minlength=cells)[hit]
        of = shared[hit] if full else np.bincount(pair, weights=known, minlength=cells)[hit]
        mean = total / np.maximum(of, 1)
        cand, ref = np.divmod(hit if named is None else named[hit], len(self.refs))
        shared, missing = shared[hit], of == 0
        if self.nearest:
            near = ~missing & ~np.isnan(mean) & (mean < self.limit[ref])
            cand, ref, shared, mean, missing = (v[near] for v in (cand, ref, shared, mean, missing))
        if len(ref):
            found = pa.table({"_ref": ref, "cand": cands.take(pa.array(cand)), "shared": shared, "mean_distance": pa.array(mean, mask=missing)})
            if not self.nearest:
                yield self.named(found)
                return
            self.kept.append(found)
            if sum(t.num_rows for t in self.kept) > max(PAIRS, 2 * self.nearest * len(self.refs)):
                self.prune()

    def prune(self) -> None:
        kept = pa.concat_tables(self.kept)
        ref, mean = kept["_ref"].to_numpy(), kept["mean_distance"].to_numpy()
        order = np.lexsort((mean, ref))
        rank = np.arange(len(order)) - np.searchsorted(ref[order], ref[order])
        at_end = order[rank == self.nearest - 1]
        self.limit[ref[at_end]] = mean[at_end]
        self.kept = [kept.take(pa.array(order[rank < self.nearest]))]

    def named(self, found: pa.Table) -> pa.Table:
        columns = {"channel": pa.repeat(self.channel, found.num_rows), "ref": self.refs.take(found["_ref"].combine_chunks())}
        return pa.table({**columns, **{n: found[n] for n in ("cand", "shared", "mean_distance")}}).cast(self.schema)

    def rest(self) -> Iterator[pa.Table]:
        if self.kept:
            self.prune()
            yield self.named(self.kept[0])


def block_scores(batches: Iterator[pa.RecordBatch], least: int, nearest: int | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Scores of blocks one after another; of each the references come first, then the candidates by track."""
    name, tables, held = None, [], None

    def passed(last: bool) -> Iterator[pa.RecordBatch]:
        """What the candidates read so far give, but for the last track's unless it is over."""
        nonlocal tables
        cands = pa.concat_tables(tables)
        of = numbers(cands["cand"])[0]
        whole = len(of) if last else int(np.searchsorted(of, of[-1]))
        tables = [cands.slice(whole)] if whole < len(of) else []
        if whole:
            for found in held.scores(cands.slice(0, whole)):
                yield from found.to_batches()

    def ended() -> Iterator[pa.RecordBatch]:
        if name and name[-1] and held:
            if tables:
                yield from passed(True)
            for found in held.rest():
                yield from found.to_batches()

    for now, table in runs(batches, "channel", "_i", "_j", "_kind"):
        if now != name:
            yield from ended()
            if now[-1]:
                held = Held(pa.concat_tables(tables), least, nearest, schema) if name and name[:-1] == now[:-1] else None
            name, tables = now, []
        if not now[-1] or held:
            tables.append(table)
        if now[-1] and held:
            yield from passed(False)
    yield from ended()


def scored(refs: DataFrame, cands: DataFrame, least: int, on: tuple[str, ...]) -> DataFrame:
    """The scores of `shared_frame_scores` for the rows that agree in `on`, by a join, for few pairs."""
    right = cands.select("channel", "frame", "cand", F.col("x").alias("cx"), F.col("y").alias("cy"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    pairs = refs.join(right, [*on]).groupBy("channel", "ref", "cand")
    return pairs.agg(F.count(F.lit(1)).alias("shared"), F.avg(F.sqrt(dx * dx + dy * dy)).alias("mean_distance")).where(F.col("shared") >= least)


def greedy_matches(scores: DataFrame) -> DataFrame:
    """One-to-one pairs of each channel, nearest first (ties by ref, then cand), as a fold over the sorted pairs has them.

    In each round the pairs that are first for both their sides are taken, and all other pairs of those sides go: no pair
    before them can touch either side, so the fold takes them too. Where sides tie all with all (copies of tracks), the
    round takes the whole block, first with first and so on. Rounds are aggregates and joins by side, so a channel is
    spread over all tasks; usually a constant share of the pairs is decided in each. Rounds are written to the shared
    folder. Repeated pairs count once, with their least distance; nulls in any column are left out.
    """
    spark, names = scores.sparkSession, scores.columns
    sides = (["channel", "ref"], ["channel", "cand"])
    known = scores.dropna(subset=["channel", "ref", "cand", "mean_distance"])
    left, held = materialize(known.groupBy("channel", "ref", "cand").agg(F.min("mean_distance").alias("mean_distance")))
    taken, done = None, []
    while True:
        near = left
        for by, other in zip(sides, ("cand", "ref")):
            ties = left.groupBy(*by, "mean_distance").agg(F.min(other).alias("first"), F.count(F.lit(1)).alias("n"))
            near = near.join(ties.groupBy(*by).agg(F.min(F.struct("mean_distance", "first", "n")).alias(f"of_{by[1]}")), by)
        near = near.where("mean_distance = of_ref.mean_distance AND mean_distance = of_cand.mean_distance")
        near, path = materialize(near.select("channel", "ref", "cand", F.struct("mean_distance", F.col("of_ref.first").alias("c"), F.col("of_cand.first").alias("r")).alias("block"), F.col("of_ref.n").alias("of_ref"), F.col("of_cand.n").alias("of_cand")))
        # All of a block tie with all others of it and nothing else comes as early for any.
        size = F.count(F.lit(1))
        whole = near.groupBy("channel", "block").agg(size.alias("n"), F.count_distinct("ref").alias("refs"), F.count_distinct("cand").alias("cands"), F.max("of_ref").alias("of_ref"), F.max("of_cand").alias("of_cand"))
        whole = whole.where("n > 1 AND n = refs * cands AND of_ref = cands AND of_cand = refs").select("channel", "block")
        place = lambda c: F.dense_rank().over(Window.partitionBy("channel", "block").orderBy(c))
        paired = near.join(whole, ["channel", "block"]).withColumns({"i": place("ref"), "j": place("cand")}).where("i = j")
        won = near.where("ref = block.r AND cand = block.c").select("channel", "ref", "cand").union(paired.select("channel", "ref", "cand")).distinct()
        won, won_path = materialize(won)
        discard(spark, path)
        done.append(won_path)
        if won.isEmpty():
            break
        taken = won if taken is None else taken.unionByName(won)
        rest = left
        for by in sides:
            rest = rest.join(won.select(*by), by, "left_anti")
        left, path = materialize(rest)
        discard(spark, held)
        held = path
    discard(spark, held)
    if taken is None:
        return scores.limit(0)
    # A pair that is repeated keeps its least distance.
    kept = scores.join(taken, ["channel", "ref", "cand"]).groupBy("channel", "ref", "cand").agg(F.min_by(F.struct(*names), "mean_distance").alias("row"))
    out, _ = materialize(kept.select("row.*").select(*names))
    discard(spark, *done)
    return out


def nearest_matches(refs: DataFrame, cands: DataFrame, least: int = MIN_SHARED, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """`greedy_matches` of `shared_frame_scores`, without the scores of pairs that are never nearest.

    Pairs that share a frame grow with the square of the tracks, but each track is matched once. A mean distance of at
    most r has a frame with at most r, so a range join of the frames lists all pairs up to r and the fold over those is
    final up to r. What it matches goes, and r doubles for the rest, until the rest has few pairs or r spans everything;
    then the rest is scored whole. The first r is where a reference has about one neighbour, if places were spread evenly.
    """
    spark = refs.sparkSession
    keys = {"ref": ["channel", "ref"], "cand": ["channel", "cand"]}
    rest, held = {}, {}
    for side, df in (("ref", refs), ("cand", cands)):
        rest[side], held[side] = materialize(df.select("channel", "frame", side, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["channel", "frame", side]))
    reach, taken = None, None
    while True:
        counts = [rest[side].groupBy("channel", "frame").agg(F.count(F.lit(1)).cast("double").alias(f"n_{side}")) for side in rest]
        pairs = counts[0].join(counts[1], ["channel", "frame"]).agg(F.sum(F.col("n_ref") * F.col("n_cand"))).first()[0] or 0.0
        if reach is None:
            finite = [F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in ("x", "y")]
            wide, high = rest["ref"].select("x", "y").union(rest["cand"].select("x", "y")).agg(*[F.coalesce(F.max(c) - F.min(c), F.lit(0.0)) for c in finite]).first()
            number = rest["ref"].select(*keys["ref"]).distinct().count()
            reach = (wide * high * number / pairs / 3.14) ** 0.5 if pairs else 0.0
        if pairs <= few_pairs or not 0 < reach < wide + high:
            break
        placed = rest["ref"].select("channel", "frame", "ref", F.col("x").alias("rx"), F.col("y").alias("ry"))
        # Rounding must not take a frame away; what lies beyond the reach goes by the mean.
        near = within_radius(dealt(rest["cand"], "channel", "frame"), placed, reach * (1 + 1e-9), ("channel", "frame")).select("channel", "ref", "cand").distinct()
        # All frames of the pairs that are near in one.
        found = near.join(rest["ref"], keys["ref"])
        scores, path = materialize(scored(found, rest["cand"], least, ("channel", "cand", "frame")).where(F.col("mean_distance") <= reach))
        won = greedy_matches(scores)
        discard(spark, path)
        taken = won if taken is None else taken.unionByName(won)
        for side in rest:
            after, path = materialize(rest[side].join(won.select(*keys[side]), keys[side], "left_anti"))
            discard(spark, held[side])
            rest[side], held[side] = after, path
        reach *= 2
    last = greedy_matches(shared_frame_scores(rest["ref"], rest["cand"], least))
    return last if taken is None else taken.unionByName(last)


def match_decisions(refs: DataFrame, cands: DataFrame, max_mean: float = MAX_MEAN_NM, red: str = RED, latest: int = RED_LATEST_START, written: DataFrame | None = None, least: int = MIN_SHARED) -> DataFrame:
    """One row for each reference track with its match and status. A rejected pair still uses up its candidate. With
    `written` (channel, ref: what has an output file), accepted pairs without one are `accepted_missing_file`."""
    chosen = nearest_matches(refs, cands, least)
    first = cands.groupBy("channel", "cand").agg(F.min("frame").alias("cand_first"))
    rows = refs.select("channel", "ref").distinct().join(chosen, ["channel", "ref"], "left").join(first, ["channel", "cand"], "left")
    status = (
        F.when(F.col("cand").isNull(), "no_match")
        .when(F.col("mean_distance") > max_mean, "rejected_distance")
        .when((F.col("channel") == red) & (F.col("cand_first") > latest), "rejected_red_late_start")
        .otherwise("saved")
    )
    rows = rows.withColumn("status", status)
    if written is not None:
        rows = rows.join(written.select("channel", "ref").distinct().withColumn("written", F.lit(True)), ["channel", "ref"], "left")
        rows = rows.withColumn("status", F.when((F.col("status") == "saved") & F.col("written").isNull(), "accepted_missing_file").otherwise(F.col("status")))
    return rows.select("channel", "ref", "cand", F.coalesce("shared", F.lit(0)).alias("shared"), "mean_distance", "status")


def optimal_matches(scores: DataFrame, most: float = MAX_SEED_UM, most_scores: int = MOST_SCORES) -> DataFrame:
    """One-to-one pairs of each channel: as many as possible, and of those the least total distance; pairs beyond `most`
    are rejected afterwards. Nulls in any column are left out, and of repeated pairs the nearest counts.

    What one part of the score graph takes does not touch the others, so each connected component is solved for itself,
    on lists of its scores. A task holds a component; one of more than `most_scores` scores is refused.
    """
    pairs = scores.dropna(subset=["channel", "ref", "cand", "mean_distance"]).withColumns({"a": F.xxhash64(F.lit("ref"), "channel", "ref"), "b": F.xxhash64(F.lit("cand"), "channel", "cand")})
    pairs, _ = materialize(pairs)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    part = labels(nodes, pairs.select("a", "b")).select(F.col("node").alias("a"), "label")
    kind, names = StructType([*scores.schema]), scores.columns

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most_scores:
            raise ValueError(f"a component has {len(pdf)} scores, more than {most_scores}")
        pdf = pdf.sort_values(["channel", "ref", "cand", "mean_distance"]).drop_duplicates(["channel", "ref", "cand"])
        # Two channels share a component only if hashes of their sides are equal, so sides are named by both.
        refs, cands = (pdf.groupby(["channel", side], sort=True).ngroup().to_numpy() for side in ("ref", "cand"))
        found = assign_sparse(refs.tolist(), cands.tolist(), pdf.mean_distance.tolist())
        chosen = pdf.iloc[found]
        return chosen[chosen.mean_distance <= most][names]

    return pairs.join(part, "a").select("label", *names).groupBy("label").applyInPandas(solve, kind)


def classes(tracks: DataFrame, side: str) -> DataFrame:
    """channel, side, points (frame, x, y, in order), of (the least track of the same points) and its place among them."""
    known = tracks.dropna(subset=["channel", "frame", side]).select("channel", side, F.struct("frame", *place()).alias("point"))
    sets = known.groupBy("channel", side).agg(F.sort_array(F.collect_list("point")).alias("points"))
    same = Window.partitionBy("channel", "points")
    return sets.withColumns({"of": F.min(side).over(same), "place": F.row_number().over(same.orderBy(side)) - 1})


def optimal_track_matches(refs: DataFrame, cands: DataFrame, least: int = MIN_SHARED, most: float = MAX_SEED_UM, nearest: int = NEAREST, most_scores: int = MOST_SCORES) -> DataFrame:
    """`optimal_matches` of `shared_frame_scores`, without the scores of pairs that the optimum has no use for.

    Tracks with the same points count as one that stands for all of them. Each reference has a list of its nearest
    candidates. The optimum over the lists also gives each reference a price; pairs that were left out change nothing where
    they cost as much as that or more. References whose lists end before their price get longer ones, until there are none.
    """
    spark = refs.sparkSession
    members = {side: materialize(classes(df, side)) for side, df in (("ref", refs), ("cand", cands))}
    size = {side: df.groupBy("channel", F.col("of").alias(side)).agg(F.count(F.lit(1)).alias(f"{side}s")) for side, (df, _) in members.items()}
    alone = {side: df.where("place = 0").select("channel", side, F.inline("points")) for side, (df, _) in members.items()}
    names = ["channel", "ref", "cand", "shared", "mean_distance"]

    def lists(sought: DataFrame, n: int) -> tuple[DataFrame, str]:
        found = shared_frame_scores(sought, alone["cand"], least, n)
        by = Window.partitionBy("channel", "ref").orderBy("mean_distance", "cand")
        found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
        whole = Window.partitionBy("channel", "ref")
        # Candidates that are not on the list are at least so far.
        ends = F.when(F.max("rank").over(whole) == n, F.max("mean_distance").over(whole)).otherwise(float("inf"))
        return materialize(found.withColumn("ends", ends).drop("rank").join(size["ref"], ["channel", "ref"]).join(size["cand"], ["channel", "cand"]).select(*names, "ends", "refs", "cands"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most_scores:
            raise ValueError(f"a component has {len(pdf)} scores, more than {most_scores}")
        pdf = pdf.sort_values(["channel", "ref", "cand"]).reset_index(drop=True)
        rows, columns = (pdf.groupby(["channel", side], sort=True).ngroup().to_numpy() for side in ("ref", "cand"))
        first = lambda of: np.unique(of, return_index=True)[1]
        taken, price = assign_counts(rows.tolist(), columns.tolist(), pdf.mean_distance.tolist(), pdf.refs.to_numpy()[first(rows)].tolist(), pdf.cands.to_numpy()[first(columns)].tolist())
        chosen = pdf.iloc[[k for k, _ in taken]].assign(n=[n for _, n in taken], longer=False)
        short = pdf.iloc[first(rows)]
        short = short[np.array(price) > short.ends.to_numpy()].assign(n=0, longer=True)
        return pd.concat([chosen, short])[[*names, "n", "longer"]]

    held, paths = lists(alone["ref"], nearest)
    paths = [paths]
    while True:
        pairs, at = materialize(held.withColumns({"a": F.xxhash64(F.lit("ref"), "channel", "ref"), "b": F.xxhash64(F.lit("cand"), "channel", "cand")}))
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        part = labels(nodes, pairs.select("a", "b")).select(F.col("node").alias("a"), "label")
        kind = StructType([*held.select(*names).schema, StructField("n", LongType()), StructField("longer", BooleanType())])
        solved, solved_at = materialize(pairs.join(part, "a").drop("a", "b").groupBy("label").applyInPandas(solve, kind))
        discard(spark, at)
        more = solved.where("longer").select("channel", "ref")
        if more.isEmpty():
            break
        nearest *= 4
        longer, path = lists(alone["ref"].join(more, ["channel", "ref"], "left_semi"), nearest)
        held, together = materialize(held.join(more, ["channel", "ref"], "left_anti").unionByName(longer))
        discard(spark, solved_at, path, *paths)
        paths = [together]
    discard(spark, *paths)
    # The first of the tracks that a class stands for go to the first candidates, and so on.
    before = lambda side, other: F.sum("n").over(Window.partitionBy("channel", side).orderBy(other)) - F.col("n")
    units = solved.where(~F.col("longer") & (F.col("mean_distance") <= most)).withColumns({"_r": before("ref", "cand"), "_c": before("cand", "ref")})
    units = units.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    for side, offset in (("ref", "_r"), ("cand", "_c")):
        own = members[side][0].select("channel", F.col("of").alias(side), F.col("place").cast("long").alias("_at"), F.col(side).alias(f"_{side}"))
        units = units.withColumn("_at", F.col(offset) + F.col("_k")).join(own, ["channel", side, "_at"]).drop("_at")
    return units.select("channel", F.col("_ref").alias("ref"), F.col("_cand").alias("cand"), "shared", "mean_distance")


def candidate_audit(moved: DataFrame, inside: str | None = None, by: tuple[str, ...] = ("channel", "cand")) -> DataFrame:
    """Measures of each candidate from what `steps` returns; `inside` names a boolean column of points inside the ROI."""
    span = F.max("frame") - F.min("frame") + 1
    measures = {
        "points": F.count(F.lit(1)),
        "first_frame": F.min("frame"),
        "last_frame": F.max("frame"),
        "frame_span": span,
        "temporal_coverage": F.count(F.lit(1)) / span,
        "max_missing": F.coalesce(F.max(F.col("gap") - 1), F.lit(0)),
        "median_step": F.coalesce(F.median("step"), F.lit(0.0)),
        "p95_step": F.coalesce(F.percentile("step", F.lit(0.95)), F.lit(0.0)),
    }
    if inside:
        measures["inside_fraction"] = F.avg(F.col(inside).cast("double"))
    return moved.groupBy(*by).agg(*[c.alias(n) for n, c in measures.items()])


def profile_audit(points: DataFrame, roi: DataFrame, profile: DataFrame, pixel_nm: float, by: tuple[str, ...] = ("allele", "channel", "cand"), roi_by: tuple[str, ...] = ("allele",)) -> DataFrame:
    """The whole audit of candidates in nanometres: what the profile (a small dimension by channel) says of the channel,
    the candidate's number and file, and the measures, with steps in pixels and the share of points in the static ROI.

    points: by, file, frame, x_nm, y_nm; roi: roi_by, y, x. Pixel coordinates start at 0, so one is taken off.
    """
    pixel = lambda c: F.col(c) / pixel_nm - 1.0
    placed = with_inside(points.withColumns({"x": pixel("x_nm"), "y": pixel("y_nm")}), roi, roi_by)
    files = points.groupBy(*by).agg(F.min("file").alias("file"))
    found = candidate_audit(steps(placed, by), "inside", by).join(files, list(by)).join(F.broadcast(profile) if small_enough(profile, FEW_CHANNELS) else profile, "channel", "left")
    return found.withColumn("number", F.coalesce(number_in(F.col("file"), r"traj(\d+)"), F.lit(0).cast("long")))


def with_emphasis(cands: DataFrame, chosen: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Adds whether a candidate is among the chosen ones."""
    flag = chosen.select(*by).distinct().withColumn("emphasis", F.lit(True))
    return cands.join(flag, list(by), "left").withColumn("emphasis", F.coalesce("emphasis", F.lit(False)))


def longest(audit: DataFrame, by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """The candidate with most points; then the longer span, the earlier start, the smaller number."""
    order = Window.partitionBy(*by).orderBy(F.desc("points"), F.desc("frame_span"), "first_frame", "cand")
    return audit.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def selection_audit(audit: DataFrame, grid: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A row for each combination in `grid` (a small dimension), with its number of candidates and the selected one;
    combinations without candidates have 0 and status `no_candidate`."""
    counts = audit.groupBy(*by).agg(F.count(F.lit(1)).alias("candidates"))
    best = longest(audit, by).select(*by, "cand", "points", "frame_span")
    rows = grid.join(counts, list(by), "left").join(best, list(by), "left")
    return rows.withColumns({"candidates": F.coalesce("candidates", F.lit(0)), "status": F.when(F.col("cand").isNull(), "no_candidate").otherwise("selected")})
