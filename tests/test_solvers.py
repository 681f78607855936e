import datetime as dt
import tracemalloc
from itertools import chain, combinations, permutations, product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.operators import solvers
from ledgerloom.operators.solvers import Found, assign_sparse, assign_square, disambiguate, hungarian, solve_edges, subset_sums


@given(st.integers(1, 5), st.randoms())
@settings(max_examples=60, deadline=None)
def test_hungarian_is_cheapest(n, draw):
    cost = np.array([[draw.randint(0, 50) for _ in range(n)] for _ in range(n)], dtype=float)
    got = hungarian(cost)
    assert sorted(got) == list(range(n))
    assert sum(cost[i, j] for i, j in enumerate(got)) == min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n)))


def test_a_pair_binds_below_twice_the_sink():
    assert assign_square(np.array([[99.0]]), 50) == [(0, 0)]
    assert assign_square(np.array([[101.0]]), 50) == []


def flow_cost(bound, cost, sink):
    return sum(int(cost[i, j] * 1000) for i, j in bound) + int(sink * 1000) * (cost.shape[1] - len(bound))


@given(st.integers(1, 3), st.integers(1, 4), st.randoms())
@settings(max_examples=60, deadline=None)
def test_flow_is_cheapest(n, m, draw):
    cost = np.array([[draw.randint(0, 90) for _ in range(m)] for _ in range(n)], dtype=float)
    got = assign_sparse(n, m, [(i, j, cost[i, j]) for i in range(n) for j in range(m)], 50, 2, 1000)
    best = min(
        flow_cost([(i, j) for j, i in enumerate(c) if i is not None], cost, 50)
        for c in product([None, *range(n)], repeat=m)
        if all(c.count(i) <= 2 for i in range(n)) and all(i is None or cost[i, j] < 50 for j, i in enumerate(c))
    )
    assert flow_cost(got, cost, 50) == best


def test_an_empty_side_is_no_method():
    assert solve_edges(0, 3, [], 50, 2) == ("none", [])


@given(st.integers(1, 6), st.randoms())
@settings(max_examples=60, deadline=None)
def test_even_components_cost_the_same_by_edges_and_by_matrix(n, draw):
    edges = [(i, j, draw.randint(0, 130)) for i in range(n) for j in range(n) if draw.random() < 0.6]
    price = {(i, j): c for i, j, c in edges}
    open_cost = lambda bound: sum(price[b] for b in bound) + 100 * (n - len(bound))
    dense = solve_edges(n, n, edges, 50, 2)
    keep, solvers.DENSE = solvers.DENSE, 0
    try:
        sparse = solve_edges(n, n, edges, 50, 2)
    finally:
        solvers.DENSE = keep
    assert dense[0] == sparse[0] == "hungarian" and open_cost(dense[1]) == open_cost(sparse[1]) and all(price[b] < 100 for b in sparse[1])


def test_a_large_component_is_solved_over_its_edges():
    n = 1500
    edges = [(i, (i + d) % n, 10.0 + 7 * d) for i in range(n) for d in (0, 1)]
    assert solve_edges(n, n, edges, 50, 2)[1] == [(i, i) for i in range(n)]


def brute(amounts, target, delta):
    some = chain.from_iterable(combinations(range(len(amounts)), k) for k in range(1, len(amounts) + 1))
    return {s for s in some if abs(sum(amounts[i] for i in s) - target) <= delta}


@given(st.lists(st.integers(-40, 60), min_size=1, max_size=8), st.integers(-60, 200), st.integers(0, 5))
@settings(max_examples=100, deadline=None)
def test_subset_sums_match_brute_force(amounts, target, delta):
    assert set(subset_sums(amounts, target, delta, 10**6).solutions) == brute(amounts, target, delta)


@given(st.lists(st.integers(-(10**9), 10**9), min_size=1, max_size=9), st.data())
@settings(max_examples=50, deadline=None)
def test_wide_sums_meet_in_the_middle(amounts, data):
    chosen = data.draw(st.sets(st.integers(0, len(amounts) - 1), min_size=1))
    target = sum(amounts[i] for i in chosen)
    assert set(subset_sums(amounts, target, 3, 10**6).solutions) == brute(amounts, target, 3)


def test_exact_hits_come_first_and_the_cap_is_told():
    found = subset_sums([5, 5, 5, 5], 5, 0, 3)
    assert found.truncated and len(found.solutions) == 3
    assert subset_sums([5, 5, 5], 5, 0, 3).truncated and not subset_sums([5, 5], 5, 0, 3).truncated
    assert subset_sums([10**9, 10**9, -1], 10**9, 0, 2).truncated
    assert subset_sums([10, 11], 10, 1, 5).solutions == [(0,), (1,)]
    assert subset_sums([1], 1000, 3, 5).method == "unreachable"


def test_a_small_target_in_a_large_pool_is_found():
    """The target bounds the bitset when no amount is negative, whatever the pool adds up to."""
    pool = [1_000_003 + 2_000_000 * k for k in range(60)] + [50, 70]
    assert sum(pool) > 40_000_000
    assert set(subset_sums(pool, 4_000_126, 0, 5).solutions) == {(0, 1, 60, 61)}
    assert set(subset_sums(pool, 3_000_003, 3, 5).solutions) == {(1,)}
    assert subset_sums([-1, *pool], 4_000_126, 0, 5).method == "intractable"


@given(st.lists(st.integers(0, 60), min_size=1, max_size=9), st.integers(-5, 200), st.integers(0, 5))
@settings(max_examples=100, deadline=None)
def test_positive_sums_match_brute_force(amounts, target, delta):
    assert set(subset_sums(amounts, target, delta, 10**6).solutions) == brute(amounts, target, delta)


@given(st.lists(st.integers(-6, 12), max_size=8), st.integers(-10, 40), st.integers(0, 3), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_few_amounts_are_summed_for_what_the_bitset_finds(amounts, target, delta, most):
    few = subset_sums(amounts, target, delta, most)
    keep, solvers.FEW = solvers.FEW, -1
    try:
        assert few == subset_sums(amounts, target, delta, most)
    finally:
        solvers.FEW = keep


def test_a_large_amount_alone_takes_no_bitset():
    """A claim or two for each of a million orders: megabytes and milliseconds for each are hours in all."""
    tracemalloc.start()
    try:
        assert subset_sums([39_000_000], 39_000_000, 0, 5).solutions == [(0,)]
        assert subset_sums([15_600_000, 23_400_000], 39_000_000, 0, 5).solutions == [(0, 1)]
        assert tracemalloc.get_traced_memory()[1] < 100_000
    finally:
        tracemalloc.stop()


DAY = dt.datetime(2025, 1, 1)


@pytest.mark.parametrize(
    ("solutions", "groups", "days", "want"),
    [
        ([], [], [], (None, 0.0, "NO_SUBSET_FOUND")),
        ([(0,)], ["a"], [DAY], ((0,), 0.99, "unique")),
        ([(0, 1), (1, 2)], ["a", "a", "b"], [DAY] * 3, ((0, 1), 0.85, "one payout group")),
        ([(0, 1), (1, 2)], ["a", "b", "c"], [DAY, DAY, DAY + dt.timedelta(days=2)], ((0, 1), 0.75, "tightest dates")),
        ([(0, 1), (2,)], ["a", "b", "c"], [DAY] * 3, ((2,), 0.85, "one payout group")),
        ([(0, 1), (1, 2)], ["a", "b", "c"], [DAY] * 3, (None, 0.0, "AMBIGUOUS_SUBSET")),
    ],
)
def test_tiebreaks_cascade(solutions, groups, days, want):
    assert disambiguate(Found("bitset", solutions), groups, days) == want


def test_a_truncated_search_is_ambiguous():
    assert disambiguate(Found("bitset", [(0,)], True), ["a"], [DAY])[2] == "AMBIGUOUS_SUBSET"
