"""The greedy plan against a plain walk over all rows."""

import random

import pytest

from lotwatch.operators import portfolio


def walk(rows, budget):
    taken, left = [], {}
    for group, rank, cost, key in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        if cost is not None and cost <= left.setdefault(group, budget):
            left[group] -= cost
            taken.append((group, key))
    return sorted(taken)


def plan(spark, rows, budget):
    df = spark.createDataFrame(rows, "g int, rank int, cost int, k int")
    return sorted(map(tuple, portfolio.greedy_plan(df, ["g"], "rank", "cost", "k", budget).collect()))


@pytest.mark.parametrize("budget", [0, 10, 37])
def test_greedy_plan_walks_all_rows(spark, budget):
    """Group 1 has 1,500 dear rows before those that fit; the others are of all costs, none and null too."""
    r = random.Random(5)
    rows = [(1, i, 50, i) for i in range(1500)] + [(1, 2000 + i, 3, 5000 + i) for i in range(20)]
    rows += [(g, r.randrange(300), r.choice([0, 0, None, *range(1, 60)]), 10_000 * g + i) for g in (2, 3) for i in range(400)]
    got = plan(spark, rows, budget)
    assert got == walk(rows, budget)
    assert budget == 0 or any(g == 1 for g, _ in got)


def test_greedy_plan_without_budget_or_with_a_negative_cost(spark):
    assert plan(spark, [(1, 1, 0, 1), (1, 2, 1, 2)], -1) == []
    with pytest.raises(Exception, match="negative"):
        plan(spark, [(1, 1, 2, 1), (1, 2, -1, 2)], 5)
