"""The real algorithms: assignment and subset sums, in plain Python and numpy.

They run in grouped pandas functions, one call for each component or credit;
inputs are sorted by id first, so ties always resolve the same way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from heapq import heappop, heappush
from math import isqrt

import numpy as np

WIDEST_BITSET = 40_000_000
LARGEST_HALF = 22
#: Amounts whose subsets are all summed instead of filling a bitset, which is as wide as the target is large.
FEW = 12


def hungarian(cost: np.ndarray) -> list[int]:
    """Column of each row in a cheapest perfect assignment of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    row_of = np.full(n + 1, -1)
    u, v = np.zeros(n), np.zeros(n + 1)
    for i in range(n):
        row_of[n] = i
        at, least, came, done = n, np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, dtype=bool)
        while row_of[at] >= 0:
            done[at] = True
            r = row_of[at]
            open_ = ~done[:n]
            through = cost[r] - u[r] - v[:n]
            better = open_ & (through < least)
            least[better], came[better] = through[better], at
            nxt = int(np.argmin(np.where(open_, least, np.inf)))
            step = least[nxt]
            u[row_of[done]] += step
            v[done] -= step
            least[open_] -= step
            at = nxt
        while at != n:
            row_of[at] = row_of[came[at]]
            at = came[at]
    out = [0] * n
    for j in range(n):
        out[row_of[j]] = j
    return out


def assign_square(cost: np.ndarray, sink: float) -> list[tuple[int, int]]:
    """Hungarian with a way out for both sides: a pair binds only below twice the sink."""
    n, m = cost.shape
    padded = np.full((n + m, n + m), float(sink))
    padded[:n, :m] = cost
    padded[n:, m:] = 0.0
    return [(i, j) for i, j in enumerate(hungarian(padded)[:n]) if j < m]


def assign_sparse(n: int, m: int, edges: Sequence[tuple[int, int, float]], bypass: float, capacity: int, unit: int) -> list[tuple[int, int]]:
    """Min-cost flow over the given (order, settlement, cost) edges alone, costs cut to whole parts of ``unit``.

    Every settlement binds to an order, which takes ``capacity`` of them, or
    bypasses at its cost; an edge that isn't below that is never taken.
    """
    source, target = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, price = [], [], []

    def edge(a: int, b: int, most: int, weight: int) -> None:
        for x, y, c, w in ((a, b, most, weight), (b, a, 0, -weight)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            price.append(w)

    bindings = {}
    for j in range(m):
        edge(source, n + j, 1, 0)
        edge(n + j, target, 1, int(bypass * unit))
    for i, j, cost in sorted(edges):
        if cost < bypass:
            bindings[len(to)] = (i, j)
            edge(n + j, i, 1, int(cost * unit))
    for i in range(n):
        edge(i, target, capacity, 0)
    height = [0] * len(graph)
    for _ in range(m):
        dist, by, queue = [float("inf")] * len(graph), [-1] * len(graph), [(0, source)]
        dist[source] = 0
        while queue:
            d, x = heappop(queue)
            if d >= dist[target]:  # no shorter way is left, and what is farther gets the target's height
                break
            if d > dist[x]:
                continue
            for e in graph[x]:
                new = d + price[e] + height[x] - height[to[e]]
                if room[e] and new < dist[to[e]]:
                    dist[to[e]], by[to[e]] = new, e
                    heappush(queue, (new, to[e]))
        if dist[target] == float("inf"):
            break
        height = [h + min(d, dist[target]) for h, d in zip(height, dist, strict=True)]
        x = target
        while x != source:
            room[by[x]] -= 1
            room[by[x] ^ 1] += 1
            x = to[by[x] ^ 1]
    return sorted(b for e, b in bindings.items() if not room[e])


#: Orders of an even component up to which a dense matrix is solved.
DENSE = 64


def solve_edges(n: int, m: int, edges: Sequence[tuple[int, int, float]], sink: float, capacity: int, even: bool | None = None) -> tuple[str, list[tuple[int, int]]]:
    """(method, bound pairs) of a component of n orders and m settlements, or of a block of one, ``even`` telling of the whole.

    In an even one each side may stay open at the sink's cost, so a pair binds
    below twice that.  As many orders as settlements stay open then, so the same
    cheapest cost is found with one binding an order and a bypass at twice the
    sink, over the edges alone: that is how large ones are solved.
    """
    if not n or not m:
        return "none", []
    if not (n == m if even is None else even):
        return "mincostflow", assign_sparse(n, m, edges, sink, capacity, 1000)
    if max(n, m) > DENSE:
        return "hungarian", assign_sparse(n, m, edges, 2 * sink, 1, 1_000_000)
    cost = np.full((n, m), 1e6)
    for i, j, c in edges:
        cost[i, j] = c
    return "hungarian", assign_square(cost, sink)


@dataclass(frozen=True)
class Found:
    method: str
    solutions: list[tuple[int, ...]]
    truncated: bool = False


def subset_sums(amounts: Sequence[int], target: int, delta: int, most: int) -> Found:
    """Non-empty subsets whose sum is within ``delta`` of the target: exact first, then nearest, then the smaller sum.

    With no negative amount, sums above the target don't matter: larger amounts
    are left out and the bitset ends there, however large the pool's total is.
    ``truncated`` is told as soon as ``most`` solutions are found: there may be more.
    Every few bitsets one is kept and those between are made again when needed.
    Up to ``FEW`` amounts are summed one subset after the other, for the same
    solutions in the same order; ``method`` names what the width asks for.
    """
    low, high = sum(a for a in amounts if a < 0), sum(a for a in amounts if a > 0)
    if target + delta < low or target - delta > high:
        return Found("unreachable", [])
    if low == 0 and max(amounts, default=0) > target + delta:
        at = [i for i, a in enumerate(amounts) if a <= target + delta]
        found = subset_sums([amounts[i] for i in at], target, delta, most)
        return Found(found.method, [tuple(at[i] for i in s) for s in found.solutions], found.truncated)
    top = high if low else min(high, target + delta)
    if top - low <= WIDEST_BITSET and len(amounts) <= FEW:
        sums_of = [0]  # at its bit mask
        for a in amounts:
            sums_of += [x + a for x in sums_of]
        hits = sorted((abs(x - target), x, m) for m, x in enumerate(sums_of) if m and abs(x - target) <= delta)
        return Found("bitset", [tuple(i for i in range(len(amounts)) if m >> i & 1) for _, _, m in hits[:most]], len(hits) >= most)
    wanted = sorted((s for s in range(max(low, target - delta), min(high, target + delta) + 1)), key=lambda s: (abs(s - target), s))
    if top - low <= WIDEST_BITSET:
        mask = (1 << top - low + 1) - 1
        step = isqrt(len(amounts)) + 1

        def grown(bits: int, a: int) -> int:
            return (bits | bits << abs(a)) & mask

        kept, bits = [1], 1
        for i, a in enumerate(amounts, 1):
            bits = grown(bits, a)
            if i % step == 0:
                kept.append(bits)
        made: tuple[int, list[int]] = (-1, [])

        def reach(i: int) -> int:
            """Sums of the first i amounts."""
            nonlocal made
            if made[0] != i // step:
                row = [kept[i // step]]
                for a in amounts[i - i % step : i - i % step + step - 1]:
                    row.append(grown(row[-1], a))
                made = i // step, row
            return made[1][i % step]

        base = [0]
        for a in amounts:
            base.append(base[-1] + min(a, 0))
        out: list[tuple[int, ...]] = []
        for total in wanted:
            if not bits >> (total - low) & 1:
                continue
            open_ = [(len(amounts), total, ())]
            while open_:
                i, left, chosen = open_.pop()
                if i == 0:
                    if left == 0 and chosen:
                        out.append(chosen)
                        if len(out) >= most:
                            return Found("bitset", out, True)
                    continue
                a = amounts[i - 1]
                for nxt, taken in ((left - a, (i - 1, *chosen)), (left, chosen)):
                    at = nxt - base[i - 1]
                    if at >= 0 and reach(i - 1) >> at & 1:
                        open_.append((i - 1, nxt, taken))
        return Found("bitset", out)
    half = len(amounts) // 2
    if len(amounts) - half > LARGEST_HALF:
        return Found("intractable", [])

    def sums(part: Sequence[int]) -> np.ndarray:
        """Sum of every subset, at its bit mask."""
        out = np.zeros(1, dtype=np.int64)
        for x in part:
            out = np.concatenate((out, out + x))
        return out

    left, right = sums(amounts[:half]), sums(amounts[half:])
    order = np.argsort(right, kind="stable")
    first = np.searchsorted(right[order], target - delta - left, "left")
    count = np.searchsorted(right[order], target + delta - left, "right") - first
    mask = np.repeat(np.arange(len(left)), count)
    other = order[np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))]
    chosen, total = mask | other << half, left[mask] + right[other]
    chosen, total = chosen[chosen > 0], total[chosen > 0]
    best = np.lexsort((chosen, total, np.abs(total - target)))
    return Found("meet_in_the_middle", [tuple(i for i in range(len(amounts)) if int(m) >> i & 1) for m in chosen[best[:most]]], len(chosen) >= most)


def disambiguate(found: Found, groups: Sequence[str], days: Sequence) -> tuple[tuple[int, ...] | None, float, str]:
    """The one subset to believe: (members, confidence, reason), or None with the reason why not.

    Survivors cascade: a criterion that leaves some narrows the choice for the next.
    """
    options = found.solutions
    if not options:
        return None, 0.0, "NO_SUBSET_FOUND"
    if found.truncated:
        return None, 0.0, "AMBIGUOUS_SUBSET"
    if len(options) == 1:
        return options[0], 0.99, "unique"
    spread = lambda s: (max(days[i] for i in s) - min(days[i] for i in s)).days
    one_group = [s for s in options if len({groups[i] for i in s}) == 1]
    options = one_group or options
    if len(options) == 1:
        return options[0], 0.85, "one payout group"
    for rank, confidence, reason in ((spread, 0.75, "tightest dates"), (len, 0.65, "fewest members")):
        least = min(map(rank, options))
        options = [s for s in options if rank(s) == least]
        if len(options) == 1:
            return options[0], confidence, reason
    return None, 0.0, "AMBIGUOUS_SUBSET"


__all__ = ["Found", "assign_sparse", "assign_square", "disambiguate", "hungarian", "solve_edges", "subset_sums"]
