"""Pairing by auction against exhaustive search, shortest augmenting paths, and in rounds."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import auction, matching


def exhaustive(cost):
    """Most pairs, then least cost, of a matrix with forbidden (infinite) entries."""
    n, m = cost.shape
    best = (0, 0.0)
    for size in range(1, min(n, m) + 1):
        for rows in itertools.combinations(range(n), size):
            for columns in itertools.permutations(range(m), size):
                total = sum(cost[i, j] for i, j in zip(rows, columns))
                if np.isfinite(total) and (size > best[0] or total < best[1]):
                    best = (size, total)
    return best


def by_paths(cost):
    """Least total of a full assignment of rows, by adding rows along shortest paths."""
    n, m = cost.shape
    row_of, u, v = np.full(m, -1), np.zeros(n), np.zeros(m)
    for new in range(n):
        reach, back, done, row, column, far = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool), new, -1, 0.0
        while True:
            step = far + cost[row] - u[row] - v
            better = ~done & (step < reach)
            reach[better], back[better] = step[better], column
            column = int(np.where(done, np.inf, reach).argmin())
            far = reach[column]
            done[column] = True
            if row_of[column] < 0:
                break
            row = row_of[column]
        seen = done & (np.arange(m) != column)
        u[new] += far
        u[row_of[seen]] += far - reach[seen]
        v[seen] -= far - reach[seen]
        while column >= 0:
            row_of[column], column = (row_of[back[column]] if back[column] >= 0 else new), back[column]
    hit = np.flatnonzero(row_of >= 0)
    return cost[row_of[hit], hit].sum()


def solve(cost):
    i, j = np.nonzero(np.isfinite(cost))
    a, b, reach = auction.pair(i, j, cost[i, j], *cost.shape)
    assert len(set(a)) == len(a) and len(set(b)) == len(b)
    return len(a), cost[a, b].sum(), reach


def test_auction_equals_exhaustive_search():
    rng = np.random.default_rng(0)
    for k in range(150):
        n, m = rng.integers(1, 5, 2)
        cost = np.where(rng.random((n, m)) < (0.5 if k % 2 else 0.9), rng.integers(0, 5, (n, m)) / 4 if k % 3 else rng.random((n, m)), np.inf)
        pairs, total, _ = solve(cost)
        want = exhaustive(cost)
        assert pairs == want[0] and total == pytest.approx(want[1], abs=1e-6), cost
    assert solve(np.zeros((3, 3)))[:2] == (3, 0.0) and solve(np.full((2, 2), np.inf))[:2] == (0, 0.0)


def test_more_pairs_come_before_less_cost():
    cost = np.array([[0.01, 0.04], [0.03, np.inf]])
    a, b, _ = auction.pair(*np.nonzero(np.isfinite(cost)), cost[np.isfinite(cost)], 2, 2)
    assert sorted(zip(a, b)) == [(0, 1), (1, 0)]


@pytest.mark.parametrize(("n", "m"), [(300, 300), (120, 300), (300, 90)])
def test_large_cells_cost_as_little_as_shortest_paths(n, m):
    rng = np.random.default_rng(n + m)
    x, y = rng.normal(size=(n, 3)), rng.normal(size=(m, 3))
    cost = ((x[:, None] - y[None]) ** 2).sum(2)
    pairs, total, _ = solve(cost)
    assert pairs == min(n, m) and total == pytest.approx(by_paths(cost if n <= m else cost.T), abs=1e-7)


def cells(spark, sizes, seed=5):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for cell, (n, m) in sizes.items():
        for selected in [True] * n + [False] * m:
            rows.append((k, cell, selected, float(rng.normal()), [float(v) for v in rng.normal(size=2) * 0.3]))
            k += 1
    return spark.createDataFrame(rows, "item_id long, cell string, selected boolean, intercept double, profile array<double>")


def totals(items, pairs):
    rows = {r.item_id: r for r in items.collect()}
    out: dict = {}
    for p in pairs.collect():
        a, b = rows[p.item_id], rows[p.control_id]
        assert a.selected and not b.selected and a.cell == b.cell == p.cell
        cost = (a.intercept - b.intercept) ** 2 + sum((x - y) ** 2 for x, y in zip(a.profile, b.profile))
        n, t = out.get(p.cell, (0, 0.0))
        out[p.cell] = (n + 1, t + cost)
    assert pairs.select("item_id").distinct().count() == pairs.select("control_id").distinct().count() == pairs.count()
    return out


def test_cells_of_any_size_give_the_same_total(spark, monkeypatch):
    items = cells(spark, {"a": (6, 8), "b": (1, 2), "c": (3, 0)})
    near = {k: totals(items, matching.pair_optimal(items, [], k)) for k in (None, 0.5)}
    assert near[None]["a"][0] == 6 and near[None]["b"][0] == 1 and "c" not in near[None]
    monkeypatch.setattr(auction, "TASK_EDGES", 10)
    monkeypatch.setattr(auction, "FINER", 1 << 20)
    got = totals(items, matching.pair_optimal(items, [], 0.5))
    assert {k: (n, pytest.approx(t, abs=1e-6)) for k, (n, t) in near[0.5].items()} == got


def test_widening_finds_the_unrestricted_pairing(spark):
    for sizes in ({"a": (12, 30)}, {"a": (30, 12)}):
        items = cells(spark, sizes, seed=9)
        want = totals(items, matching.pair_optimal(items, [], None))
        sides = items.groupBy("cell").agg(F.count_if("selected").alias("_n"), F.count_if(~F.col("selected")).alias("_m"))
        got = totals(items, matching.pair_widening(items.join(sides, "cell"), []))
        assert got == {k: (n, pytest.approx(t, abs=1e-6)) for k, (n, t) in want.items()}


def test_empty_tables_have_no_pairs(spark):
    items = cells(spark, {"a": (1, 1)}).limit(0)
    assert matching.pair_optimal(items, [], None).count() == 0 and matching.pair_optimal(items, [], 1.0).count() == 0


def test_whole_cells_equal_exhaustive_search_and_shortest_paths():
    rng = np.random.default_rng(1)
    for k in range(150):
        n, m = rng.integers(1, 6, 2)
        cost = np.where(rng.random((n, m)) < (0.5 if k % 2 else 0.9), rng.integers(0, 5, (n, m)) / 4 if k % 3 else rng.random((n, m)), np.inf)
        a, b = auction.pair_whole(cost)
        want = exhaustive(cost)
        assert len(set(a)) == len(set(b)) == len(a) == want[0] and cost[a, b].sum() == pytest.approx(want[1], abs=1e-6), cost
    for n, m in ((1200, 1200), (200, 900), (900, 200)):
        x, y = rng.normal(size=(n, 8)), np.tile(rng.normal(size=(m // 2, 8)), (2, 1))
        cost = ((x[:, None] - y[None]) ** 2).sum(2)
        a, b = auction.pair_whole(cost)
        assert len(a) == min(n, m) and cost[a, b].sum() == pytest.approx(by_paths(cost if n <= m else cost.T), abs=1e-6)


def test_cells_beyond_a_task_go_by_rounds(spark, monkeypatch):
    items = cells(spark, {"a": (6, 8), "b": (1, 2), "c": (3, 0)})
    want = totals(items, matching.pair_optimal(items, [], 0.5))
    called, rounds = [], auction.in_rounds
    monkeypatch.setattr(auction, "in_rounds", lambda *a: called.append(1) or rounds(*a))
    monkeypatch.setattr(auction, "TASK_PAIRS", 1)
    monkeypatch.setattr(auction, "TASK_EDGES", 10)
    monkeypatch.setattr(auction, "FINER", 1 << 20)
    assert totals(items, matching.pair_optimal(items, [], 0.5)) == {k: (n, pytest.approx(t, abs=1e-6)) for k, (n, t) in want.items()} and called


def test_cells_of_millions_of_pairs_are_not_listed(spark, monkeypatch):
    monkeypatch.setattr(auction, "paired", lambda *a: pytest.fail("pairs are listed"))
    items = cells(spark, {"a": (1500, 1500)})
    assert [matching.pair_optimal(items, [], k).count() for k in (None, 9.0)] == [1500, 1500]


@pytest.mark.parametrize(("nearest", "more", "strip"), [(1, 1, 30), (2, 1, 1 << 24), (3, 2, 30), (64, 16, 1 << 24)])
def test_few_near_partners_give_the_best_pairing(monkeypatch, nearest, more, strip):
    for name, value in (("NEAREST", nearest), ("MORE", more), ("STRIP", strip)):
        monkeypatch.setattr(matching, name, value)
    rng = np.random.default_rng(nearest)
    for k in range(60):
        n, m = rng.integers(1, 40, 2)
        x, y = (rng.normal(size=(size, 3)) * 0.3 for size in (n, m))
        if k % 3 == 0:  # points that come several times
            x, y = np.round(x * 4) / 4, np.round(y * 4) / 4
        a, b = (pd.DataFrame({"intercept": s[:, 0], "profile": list(s[:, 1:])}) for s in (x, y))
        if k % 5 == 0:
            a.at[0, "profile"], b.at[0, "intercept"] = np.ones(4), np.nan
        for caliper in (None, 0.3, 0.6):
            cost = matching._costs(a, b, caliper)
            want, (i, j) = auction.pair_whole(cost), matching.pair_near(a, b, caliper)
            assert len(set(i)) == len(set(j)) == len(i) == len(want[0]) and cost[i, j].sum() == pytest.approx(cost[want].sum(), abs=1e-6)


def test_cells_beyond_all_pairs_are_solved_in_a_task(spark, monkeypatch):
    items = cells(spark, {"a": (60, 80), "b": (30, 20)})
    want = {k: totals(items, matching.pair_optimal(items, [], k)) for k in (None, 0.5)}
    monkeypatch.setattr(auction, "TASK_PAIRS", 100)
    for name in ("pair_widening", "pair_candidates"):
        monkeypatch.setattr(matching, name, lambda *a: pytest.fail("pairs are listed"))
    for k in (None, 0.5):
        assert totals(items, matching.pair_optimal(items, [], k)) == {c: (n, pytest.approx(t, abs=1e-6)) for c, (n, t) in want[k].items()}
