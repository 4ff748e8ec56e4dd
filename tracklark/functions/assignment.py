"""Optimal assignment for the small groups that linking and matching make."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of a cost matrix with the least total, as many as its shorter side (shortest augmenting paths)."""
    if 0 in cost.shape:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for row in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, column, far = row, -1, 0.0
        while True:
            through = far + cost[at] - row_price[at] - column_price
            better = ~done & (through < reach)
            reach[better], via[better] = through[better], column
            column = int(np.where(done, np.inf, reach).argmin())
            far, done[column] = reach[column], True
            if row_of[column] < 0:
                break
            at = row_of[column]
        seen = np.flatnonzero(done)
        row_price[row] += far
        inner = seen[row_of[seen] >= 0]
        row_price[row_of[inner]] += far - reach[inner]
        column_price[seen] -= far - reach[seen]
        while column >= 0:
            before = via[column]
            row_of[column] = row_of[before] if before >= 0 else row
            column = before
    return sorted((int(r), c) for c, r in enumerate(row_of) if r >= 0)


def assign_sparse(rows: list[int], columns: list[int], cost: list[float]) -> list[int]:
    """Of the pairs (row, column, cost), numbered from 0, places of a one-to-one choice with as many pairs as possible
    and of those the least total cost. Memory is in proportion to the pairs.

    Rows are placed one after another by the shortest augmenting path over lists of pairs. Each row also has a place of
    its own that costs more than all pairs together: a row that ends there stays alone.
    """
    if not rows:
        return []
    n, m = max(rows) + 1, max(columns) + 1
    at: list[list[int]] = [[] for _ in range(n)]
    for k, r in enumerate(rows):
        at[r].append(k)
    least = min(cost)
    cost = [c - least for c in cost]  # the number of pairs is settled first, so a constant changes nothing
    alone = sum(cost) + 1.0
    # Columns from m on are the rows' own places. pair: of each column the pair taken, -1 if free, -2 if a row's own.
    pair, row_of, column_of = [-1] * (m + n), [-1] * (m + n), [-1] * n
    row_price, column_price = [0.0] * n, [0.0] * (m + n)
    for row in range(n):
        far, via, done = {}, {}, {}
        heap: list[tuple[float, int]] = []
        r, base, last = row, 0.0, -1
        while True:
            for k in (*at[r], -2):
                c, price = (m + r, alone) if k == -2 else (columns[k], cost[k])
                if c in done:
                    continue
                through = base + price - row_price[r] - column_price[c]
                if through < far.get(c, float("inf")):
                    far[c], via[c] = through, (r, k)
                    heappush(heap, (through, c))
            while True:
                base, last = heappop(heap)
                if last not in done and base == far[last]:
                    break
            done[last] = base
            if row_of[last] < 0:
                break
            r = row_of[last]
        row_price[row] += base
        for c, d in done.items():
            if c != last:
                row_price[row_of[c]] += base - d
            column_price[c] -= base - d
        while True:
            r, k = via[last]
            before = column_of[r]
            row_of[last], pair[last], column_of[r] = r, k, last
            if r == row:
                break
            last = before
    return [k for k in pair if k >= 0]


def assign_counts(rows: list[int], columns: list[int], cost: list[float], supply: list[int], room: list[int], alone: float | None = None) -> tuple[list[tuple[int, int]], list[float]]:
    """`assign_sparse` where row r stands for `supply[r]` equal rows and column c for `room[c]` equal columns: (place of a
    pair, how many take it), and the price of each row: a pair that was left out changes nothing if it costs as much as
    its row's price or more, as prices of columns are never above zero.

    A row may stay alone for the cost `alone`; without it as many as possible are paired. Each row's pairs are looked at
    from the cheapest on, only as far as they can matter.
    """
    every: list[list[int]] = [[] for _ in supply]
    place: dict[tuple[int, int], int] = {}
    for k in sorted(range(len(cost)), key=cost.__getitem__):
        if place.setdefault((rows[k], columns[k]), k) == k:
            every[rows[k]].append(k)
    if alone is None:
        alone = 1.0 + sum(abs(c) for c in cost)
    pairs = lambda r: (np.array([columns[k] for k in every[r]]), np.array([cost[k] for k in every[r]]))
    near = [[(cost[k], cost[k], columns[k]) for k in own] for own in every]
    taken, row_price = assign_lists(near, supply, room, alone, float("inf"), pairs)
    return [(place[r, c], n) for r, c, n in taken], row_price


#: Pairs of a row that are looked at together, that a list made anew has at first, and that are too many to look at.
TOGETHER, ANEW, MANY = 4, 24, 40


def assign_lists(near: list[list[tuple[float, float, int]]], supply: list[int], room: list[int], alone: float, known: float, pairs: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[int, int, int]], list[float]]:
    """`assign_counts` over each row's list of (cost, cost, column), cheapest first: (row, column, how many), and row
    prices. The lists hold the pairs that cost less than `known`; `pairs(row)` gives columns and costs of all.

    The price that all rows with something left pay rises together, up to `alone`. Each grows a tree of the columns that
    cost just that price and of the rows that hold them, whose prices rise with it, while their columns' fall. A tree that
    comes to a column with room passes one on along its way and is taken down; the other trees stay as they are. So a
    long way is searched once, not from its start for each row.

    A list is taken up again only when the price has come as far as its next pair. Where prices of columns have fallen,
    costs say little, and a list is made anew with the price that each pair had then, from which it can only rise.
    """
    n, m, never = len(supply), len(room), float("inf")
    upto, wanted, fallen, falling = [known] * n, [ANEW] * n, np.zeros(m), np.full(m, never)
    # A cheapest pair may cost less than nothing.
    price = min([0.0, *(own[0][0] for own in near if own)])
    need, left = [*supply], [*room]
    # Prices when a tree took a row or column, and the common price then; both change steadily inside a tree.
    row_price, row_since, column_price, column_since = [price] * n, [price] * n, [0.0] * m, [0.0] * m
    # The tree of each, and from where it was reached; how often a column left one.
    row_tree, row_via, column_tree, column_via, went = [-1] * n, [-1] * n, [-1] * m, [-1] * m, [0] * m
    # Of each column how many of a row hold it, and the best offer of each tree; of each row the columns it holds.
    held: list[dict[int, int]] = [{} for _ in range(m)]
    offers: list[dict[int, tuple[float, int]]] = [{} for _ in range(m)]
    holds: list[set[int]] = [set() for _ in range(n)]
    # Root, rows and columns of each tree.
    trees: dict[int, tuple[int, list[int], list[int]]] = {}
    made, seen = 0, [0] * n
    # Rows whose lists are to be looked at now, and (price, column, row, tree, of when): when a tree's row comes to a
    # column; without a column, -1, when its list goes on.
    fresh: list[int] = []
    heap: list[tuple[float, int, int, int, int]] = []

    def listed(r: int) -> None:
        columns, cost = pairs(r)
        keys = cost - fallen[columns] + np.maximum(price - falling[columns], 0.0)
        upto[r] = never
        if len(keys) > wanted[r]:
            upto[r] = np.partition(keys, wanted[r])[wanted[r]].item()
            low = np.flatnonzero(keys <= upto[r])
            columns, cost, keys = columns[low], cost[low], keys[low]
        order = np.argsort(keys, kind="stable")
        near[r] = [*zip(keys[order].tolist(), cost[order].tolist(), columns[order].tolist())]

    def enter(r: int, tree: int, via: int) -> None:
        if seen[r] > MANY:
            wanted[r] = ANEW
            listed(r)
        row_tree[r], row_via[r], row_since[r], seen[r] = tree, via, price, 0
        trees[tree][1].append(r)
        fresh.append(r)

    for r in range(n):
        if need[r]:
            trees[made] = r, [], []
            enter(r, made, -1)
            made += 1
    while fresh or heap:
        if fresh:
            r, c = fresh.pop(), -1
            tree = row_tree[r]
        else:
            at, c, r, tree, when = heappop(heap)
            if at >= alone:
                break
            if row_tree[r] != tree or c >= 0 and (column_tree[c] >= 0 or went[c] != when):
                continue
            price = max(price, at)
        if c < 0:
            own, k, off = near[r], seen[r], row_since[r] - row_price[r]
            size, end = len(own), k + TOGETHER
            while True:
                if k < size:
                    key, cost, c = own[k]
                elif upto[r] < never:
                    key, c = upto[r], -1
                else:
                    break
                if (k >= end or c < 0) and off + key > price:
                    heappush(heap, (off + key, -1, r, tree, 0))
                    break
                if c < 0:
                    wanted[r] *= 2
                    listed(r)
                    own, k = near[r], 0
                    size = len(own)
                    continue
                k += 1
                where = column_tree[c]
                if where == tree:
                    continue
                offered, cost = offers[c], off + cost
                if tree not in offered or cost < offered[tree][0]:
                    offered[tree] = cost, r
                    if where < 0:
                        heappush(heap, (cost - column_price[c], c, r, tree, went[c]))
            seen[r] = k
            continue
        if not left[c]:
            column_tree[c], column_via[c], column_since[c], falling[c] = tree, r, price, price
            trees[tree][2].append(c)
            for other in held[c]:
                if row_tree[other] < 0:
                    enter(other, tree, c)
            continue
        # The way back: what each row on it gives up goes to the row before.
        root, rows, columns = trees.pop(tree)
        way = [(r, c)]
        while r != root:
            c = row_via[r]
            r = column_via[c]
            way.append((r, c))
        given = [(r, c) for (r, _), (_, c) in zip(way, way[1:])]
        amount = min(need[root], left[way[0][1]], *[held[c][r] for r, c in given])
        for r, c in given:
            held[c][r] -= amount
            if not held[c][r]:
                del held[c][r]
                holds[r].remove(c)
        for r, c in way:
            held[c][r] = held[c].get(r, 0) + amount
            holds[r].add(c)
        left[way[0][1]] -= amount
        need[root] -= amount
        for r in rows:
            row_price[r] += price - row_since[r]
            row_tree[r] = -1
        for c in columns:
            fallen[c] = column_price[c] = column_price[c] - (price - column_since[c])
            column_tree[c], falling[c] = -1, never
            went[c] += 1
        if need[root]:
            trees[made] = root, [], []
            enter(root, made, -1)
            made += 1
        # A row that holds a column of another tree goes on with it, and other trees come to the columns set free.
        for r in rows:
            for c in holds[r]:
                if column_tree[c] >= 0 and row_tree[r] < 0:
                    enter(r, column_tree[c], c)
        for c in columns:
            offers[c] = {t: x for t, x in offers[c].items() if t in trees}
            for t, (cost, r) in offers[c].items():
                heappush(heap, (cost - column_price[c], c, r, t, went[c]))
    for r in range(n):
        if row_tree[r] >= 0:
            row_price[r] += alone - row_since[r]
    return [(r, c, taken) for c, own in enumerate(held) for r, taken in own.items()], row_price
