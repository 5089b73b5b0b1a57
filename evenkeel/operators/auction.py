"""Minimum-cost pairing of two sides by auction: most pairs first, then the least total cost.

Both sides bid. An item may bid for a partner at the pair's cost or for its own place at a cost no
re-pairing can make up for; a partner may bid for its own place or for the place of an item it
could be paired with, both for nothing. Everyone ends up somewhere, and whoever sits with a
partner is paired, so the number of places equals the number of bidders and prices may be carried
from a coarse bidding step to a finer one.

Costs are whole multiples of the largest one over `grid`; with a last step below one part in the
number of bidders the result is optimal for these costs.

A cell with up to `TASK_PAIRS` pairs of its sides is solved in one task from its items, by bids
without a step and shortest augmenting paths (`pair_whole`); one with up to `TASK_EDGES // 8` items by
such paths among near partners (`flows`), with more pairs listed until prices prove that no other helps
(`matching.pair_near`). A list of up to `TASK_EDGES` possible pairs is solved by the auction. In a
larger one the bidders are dealt into blocks: a block lets its free bidders bid against each other at the prices it was given,
each place goes to the highest bid of all blocks, and those who lose bid again in the next round.
Old prices can only be too low, which leaves a winner's choice as good as it was.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

TASK_EDGES = 2_000_000  # possible pairs of a cell, or bids of a block, that one task holds
TASK_PAIRS = 1 << 22  # items times partners of a cell whose costs (32 MB) one task holds
FINER = 8  # by which the bidding step shrinks


def grid(n: int, m: int) -> int:
    """Steps of the largest cost, so that prices stay below 2**62."""
    size = n + m
    return max(1, min(1 << 32, (1 << 61) // (size * (size + 1) * (min(n, m) + 1))))


def bidding(first: np.ndarray, place: np.ndarray, cost: np.ndarray, price: np.ndarray, step: int) -> np.ndarray:
    """Lets all bidders bid until each holds a place; raises `price` and returns the holder of each place.

    Bidder i may bid for the places from first[i] to first[i + 1].
    """
    holder = np.full(len(price), -1)
    free = np.arange(len(first) - 1)
    while len(free):
        counts = first[free + 1] - first[free]
        starts = np.cumsum(counts) - counts
        own = np.arange(counts.sum()) + np.repeat(first[free] - starts, counts)
        total = cost[own] + price[place[own]]
        least = np.minimum.reduceat(total, starts)
        of = np.repeat(np.arange(len(free)), counts)
        hit = np.flatnonzero(total == least[of])
        best = hit[np.unique(of[hit], return_index=True)[1]]
        total[best] = np.iinfo(np.int64).max
        second = np.minimum.reduceat(total, starts)
        raised = np.where(counts > 1, second - least, 0) + step
        target = place[own[best]]
        bid = price[target] + raised
        order = np.lexsort((bid, target))
        last = np.append(np.flatnonzero(np.diff(target[order])), len(order) - 1)
        won = order[last]
        out = holder[target[won]]
        holder[target[won]] = free[won]
        price[target[won]] = bid[won]
        lost = np.ones(len(free), bool)
        lost[won] = False
        free = np.sort(np.concatenate([free[lost], out[out >= 0]]))
    return holder


def places(item: np.ndarray, partner: np.ndarray, cost: np.ndarray, alone: int, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bids as rows by bidder: n items and m partners as bidders, m partners and n items as places."""
    bidder = np.concatenate([item, np.arange(n), n + np.arange(m), n + partner])
    place = np.concatenate([partner, m + np.arange(n), np.arange(m), m + item])
    paid = np.concatenate([cost, np.full(n, alone), np.zeros(m + len(cost), np.int64)]).astype(np.int64)
    order = np.argsort(bidder, kind="stable")
    return np.searchsorted(bidder[order], np.arange(n + m + 1)), place[order], paid[order]


def steps(largest: int) -> list[int]:
    """Bidding steps from a quarter of the largest cost down to 1."""
    out = [max(1, largest // 4)]
    while out[-1] > 1:
        out.append(max(1, out[-1] // FINER))
    return out


def pair(item: np.ndarray, partner: np.ndarray, cost: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paired items and partners, and for each item the dearest pair it would still take up, among possible pairs."""
    if not len(cost):
        return np.zeros(0, int), np.zeros(0, int), np.full(n, np.inf)
    top, parts, size = float(cost.max()) or 1.0, grid(n, m), n + m
    whole = np.rint(cost / top * parts).astype(np.int64) * (size + 1)
    alone = (min(n, m) * parts + 1) * (size + 1)
    first, place, paid = places(item, partner, whole, alone, n, m)
    price = np.zeros(n + m, np.int64)
    for step in steps(alone):
        holder = bidding(first, place, paid, price, step)
    worth = np.minimum.reduceat(paid + price[place], first[:-1])[:n] - price[m:]
    hit = np.flatnonzero((holder[:m] >= 0) & (holder[:m] < n))
    reach = np.where(worth >= alone // 2, np.inf, worth / (size + 1) / parts * top)
    return holder[:m][hit], hit, reach


def pair_whole(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns paired: most pairs with a finite cost first, then the least total cost.

    Costs are whole multiples of the largest over up to 2**32 steps; a forbidden pair costs more than all others.
    """
    possible = np.isfinite(cost)
    rows, columns = np.flatnonzero(possible.any(1)), np.flatnonzero(possible.any(0))
    if not len(rows):
        return rows, columns
    if len(rows) < cost.shape[0] or len(columns) < cost.shape[1]:
        cost = cost[np.ix_(rows, columns)]
    flipped = cost.shape[0] > cost.shape[1]
    whole = np.empty(cost.shape[::-1] if flipped else cost.shape, np.int64)
    n = len(whole)
    top = max((float(c[np.isfinite(c)].max()) for c in cost), default=0.0) or 1.0
    parts = max(1, min(1 << 32, (1 << 61) // (n + 1) ** 2))
    forbidden = (n + 1) * parts
    for k in range(n):
        c = cost[:, k] if flipped else cost[k]
        fine = np.isfinite(c)
        whole[k] = np.where(fine, np.rint(np.where(fine, c, 0.0) / top * parts), forbidden)
    del cost
    at = assigned(whole)
    hit = np.flatnonzero(whole[np.arange(n), at] < forbidden)
    return (rows[at[hit]], columns[hit]) if flipped else (rows[hit], columns[at[hit]])


def assigned(cost: np.ndarray) -> np.ndarray:
    """The column of each row, of a whole-numbered matrix with no more rows than columns, by least total.

    Rows first bid for columns without a step; those left over are placed along shortest paths. A
    column's price only falls, and only once it is taken.
    """
    n, m = cost.shape
    if m == 1:
        return np.zeros(n, int)
    far = np.iinfo(np.int64).max
    price, row_of, column_of = np.zeros(m, np.int64), np.full(m, -1), np.full(n, -1)
    left = list(range(n))
    for _ in range(3):
        todo, left = left[::-1], []
        bids = 4 * n
        while todo:
            row, bids = todo.pop(), bids - 1
            total = cost[row] - price
            column = int(total.argmin())
            least, total[column] = total[column], far
            other = int(total.argmin())
            gain = total[other] - least
            price[column] -= gain
            if not gain and row_of[column] >= 0:
                column = other
            out = row_of[column]
            row_of[column], column_of[row] = row, column
            if out >= 0:
                column_of[out] = -1
                (todo if gain and bids > 0 else left).append(out)
    for row in np.flatnonzero(column_of < 0):
        reach, back = cost[row] - price, np.full(m, row)
        waiting, spare, done, order = reach.copy(), np.flatnonzero(row_of < 0), np.zeros(m, bool), []
        while True:
            column, end = int(waiting.argmin()), spare[waiting[spare].argmin()]
            length = waiting[column]
            if waiting[end] == length:
                break
            done[column], waiting[column] = True, far
            order.append(column)
            holder = row_of[column]
            total = cost[holder] - price
            total += length - total[column]
            nearer = np.flatnonzero((total < reach) & ~done)
            reach[nearer] = waiting[nearer] = total[nearer]
            back[nearer] = holder
        price[order] += reach[order] - length
        column = end
        while True:
            holder = back[column]
            row_of[column] = holder
            column_of[holder], column = column, column_of[holder]
            if holder == row:
                break
    return column_of


def flows(first: np.ndarray, column: np.ndarray, cost: np.ndarray, supply: np.ndarray, room: np.ndarray, alone: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """Units of each row by column, of least total cost, and the columns' prices.

    Row i has `supply` units and pairs first[i] to first[i + 1], sorted by column; a unit may stay alone
    at a cost no re-pairing makes up for. Each row's units go along shortest paths; a column's price
    only falls, and only once the column is full.
    """
    n, m, far = len(supply), len(room), np.iinfo(np.int64).max
    price, spare, left = np.zeros(m, np.int64), room.tolist(), supply.tolist()
    held: list[dict[int, int]] = [{} for _ in range(m)]
    reach, waiting, back = (np.empty(m, np.int64) for _ in range(3))

    def pairs(row: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(first[row], first[row + 1])
        return column[at], cost[at] - price[column[at]]

    for row in range(n):
        while left[row]:
            reach.fill(far)
            waiting.fill(far)
            places, total = pairs(row)
            reach[places] = waiting[places] = total
            back[places] = row
            met, via, stay, last = [], {row: -1}, alone, row
            while True:
                end = int(waiting.argmin())
                length = int(waiting[end])
                if stay <= length:
                    end, length = -1, stay
                    break
                if spare[end]:
                    break
                waiting[end] = far
                met.append(end)
                for holder in held[end]:
                    if holder in via:
                        continue
                    via[holder] = end
                    places, total = pairs(holder)
                    total += length - total[np.searchsorted(places, end)]
                    here = length - int(cost[first[holder] + np.searchsorted(places, end)] - price[end]) + alone
                    if here < stay:
                        stay, last = here, holder
                    near = total < reach[places]
                    places, total = places[near], total[near]
                    reach[places] = waiting[places] = total
                    back[places] = holder
            price[met] += reach[met] - length
            path = [(last if end < 0 else int(back[end]), end)]
            while path[-1][0] != row:
                end = via[path[-1][0]]
                path.append((int(back[end]), end))
            units = min([left[row], *([] if path[0][1] < 0 else [spare[path[0][1]]]), *(held[left_][holder] for (holder, _), (_, left_) in zip(path, path[1:]))])
            for (holder, _), (_, given) in zip(path, path[1:]):
                held[given][holder] -= units
                if not held[given][holder]:
                    del held[given][holder]
            for holder, taken in path:
                if taken >= 0:
                    held[taken][holder] = held[taken].get(holder, 0) + units
            if path[0][1] >= 0:
                spare[path[0][1]] -= units
            left[row] -= units
    return held, price


def paired(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pairs (by, item_id, control_id, reach) among `edges` (by, item_id, control_id, cost).

    `reach` bounds the cost at which another pair of the item could still improve the total.
    """
    by = list(by)
    edges = cut(edges.select(*by, "item_id", "control_id", "cost"))
    sizes = cut(edges.groupBy(*by).agg(F.count("*").alias("_edges"), F.max("cost").alias("_top"), F.count_distinct("item_id").alias("_n"),
                                       F.count_distinct("control_id").alias("_m")))
    types = "".join(f"{k} {edges.schema[k].dataType.simpleString()}, " for k in by)
    schema = f"{types}item_id bigint, control_id bigint, reach double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_id", "control_id"])
        items, i = np.unique(pdf["item_id"].to_numpy(), return_inverse=True)
        partners, j = np.unique(pdf["control_id"].to_numpy(), return_inverse=True)
        a, b, reach = pair(i, j, pdf["cost"].to_numpy(), len(items), len(partners))
        out = pd.DataFrame({"item_id": items[a], "control_id": partners[b], "reach": reach[a]})
        for k in by:
            out[k] = pdf[k].iloc[0]
        return out[[*by, "item_id", "control_id", "reach"]]

    small = edges.join(sizes.where(F.col("_edges") <= TASK_EDGES).select(*by), by, "left_semi")
    found = small.groupBy(*by).applyInPandas(solve, schema)
    large = sizes.where(F.col("_edges") > TASK_EDGES)
    if not large.take(1):
        return found
    return found.unionByName(in_rounds(edges.join(large, by), by, schema))


def in_rounds(edges: DataFrame, by: list[str], schema: str) -> DataFrame:
    """The same over cells of any size; `edges` also has _edges, _top, _n and _m of its cell."""
    size = F.col("_n") + F.col("_m")
    part = "CAST(greatest(1, least(4294967296, floor(2305843009213693952 / (CAST(_n + _m AS DOUBLE) * (_n + _m + 1) * (least(_n, _m) + 1))))) AS BIGINT)"
    alone = (F.least("_n", "_m") * F.col("_part") + 1) * (size + 1)
    edges = (edges.withColumn("_part", F.expr(part)).withColumn("_alone", alone)
             .withColumn("_paid", F.rint(F.col("cost") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0) * F.col("_part")).cast("long") * (size + 1)))
    cells = ["_top", "_part", "_alone", "_edges", "_n", "_m"]

    def bids(own: bool, bidder: str, own_place: bool, place: str, paid) -> DataFrame:
        return edges.select(*by, *cells, F.lit(own).alias("own"), F.col(bidder).alias("bidder"), F.lit(own_place).alias("at"), F.col(place).alias("place"), paid.alias("paid"))

    nothing = F.lit(0).cast("long")
    arcs = (bids(True, "item_id", False, "control_id", F.col("_paid")).unionByName(bids(False, "control_id", True, "item_id", nothing))
            .unionByName(bids(True, "item_id", True, "item_id", F.col("_alone")).distinct()).unionByName(bids(False, "control_id", False, "control_id", nothing).distinct()))
    blocks = F.ceil(2 * F.col("_edges") / F.lit(TASK_EDGES)) * 2
    arcs = cut(arcs.withColumn("block", F.pmod(F.xxhash64("own", "bidder"), blocks)))
    bidders = cut(arcs.select(*by, "own", "bidder").distinct())
    types = "".join(f"{k} {arcs.schema[k].dataType.simpleString()}, " for k in by)
    held_schema = f"{types}at boolean, place bigint, price bigint, own boolean, bidder bigint"
    held = arcs.sparkSession.createDataFrame([], held_schema)
    schedule = steps(arcs.agg(F.max("_alone")).first()[0])

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["own", "bidder", "at", "place"])
        who = pdf[["own", "bidder"]].drop_duplicates()
        first = np.append(np.flatnonzero(~pdf.duplicated(["own", "bidder"]).to_numpy()), len(pdf))
        key, where = np.unique(np.rec.fromarrays([pdf["at"].to_numpy(bool), pdf["place"].to_numpy(np.int64)]), return_inverse=True)
        price = np.zeros(len(key), np.int64)
        price[where] = pdf["price"].to_numpy(np.int64)
        holder = bidding(first, where, pdf["paid"].to_numpy(np.int64), price, int(pdf["step"].iloc[0]))
        won = np.flatnonzero(holder >= 0)
        out = pd.DataFrame({"at": key.f0[won], "place": key.f1[won], "price": price[won],
                            "own": who["own"].to_numpy()[holder[won]], "bidder": who["bidder"].to_numpy()[holder[won]]})
        for k in by:
            out[k] = pdf[k].iloc[0]
        return out[[*by, "at", "place", "price", "own", "bidder"]]

    for step in schedule:
        held = held.withColumns({"own": F.lit(None).cast("boolean"), "bidder": F.lit(None).cast("long")})
        free = bidders
        while free.take(1):
            at_work = (arcs.join(free, [*by, "own", "bidder"], "left_semi").join(held.select(*by, "at", "place", "price"), [*by, "at", "place"], "left")
                       .select(*by, "block", "own", "bidder", "at", "place", "paid", F.coalesce("price", nothing).alias("price"), F.lit(step).cast("long").alias("step")))
            new = at_work.groupBy(*by, "block").applyInPandas(local, held_schema)
            held = cut(held.unionByName(new).groupBy(*by, "at", "place").agg(F.max(F.struct("price", "own", "bidder")).alias("h"))
                       .select(*by, "at", "place", "h.price", "h.own", "h.bidder"))
            free = bidders.join(held.where("bidder IS NOT NULL").select(*by, "own", "bidder"), [*by, "own", "bidder"], "left_anti")
    price = held.select(*by, "at", "place", "price")
    least = (arcs.where("own").join(price, [*by, "at", "place"], "left")
             .groupBy(*by, F.col("bidder").alias("item_id"), *cells).agg(F.min(F.col("paid") + F.coalesce("price", nothing)).alias("least")))
    seat = price.where("at").select(*by, F.col("place").alias("item_id"), F.col("price").alias("seat"))
    worth = F.col("least") - F.coalesce("seat", nothing)
    reach = F.when(worth >= F.col("_alone") / 2, float("inf")).otherwise(worth / (size + 1) / F.col("_part") * F.col("_top"))
    reached = least.join(seat, [*by, "item_id"], "left").select(*by, "item_id", reach.alias("reach"))
    won = held.where("own AND NOT at").select(*by, F.col("bidder").alias("item_id"), F.col("place").alias("control_id"))
    return won.join(reached, [*by, "item_id"]).select(*by, "item_id", "control_id", "reach")
