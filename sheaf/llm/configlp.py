"""The configuration linear program of bin packing, over a histogram of lengths.

A configuration is a multiset of lengths that fits a bin. The program covers every length as often as it occurs with the least
number of configurations; it has more columns than could be listed, so it is solved by multiplicative weights: a length's weight
grows with what covering it has cost, and an unbounded knapsack over the bin's capacity, solved by dynamic programming, prices
the configurations by these weights. Everything here works on the histogram, which has at most as many
entries as a bin has places, whatever the table's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


LONG_FIRST = 8  # odds of a length go with this power of it: what is hard to place goes first


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """best[c]: the largest value of a multiset of `lengths` (ascending) of total at most c."""
    best = np.zeros(capacity + 1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for c, k in enumerate(fitting):
        if k:
            best[c] = max(best[c - 1], (values[:k] + best[c - lengths[:k]]).max())
    return best


@dataclass
class Fractional:
    """Configurations with how often each is taken (parts of one, too), and a lower bound on the number of bins."""

    shares: dict[tuple[int, ...], float]
    bound: float


def solve(
    lengths: np.ndarray, counts: np.ndarray, capacity: int, passes: int = 4, eta: float = 1.0, tolerance: float = 0.005, part: float = 0.5, rounds: int = 60, seed: int = 0,
) -> Fractional:
    """Multiplicative weights. lengths: ascending and distinct; counts: how often each occurs.

    A length is worth its tokens times a weight. A round prices once by these worths; of the configurations worth at least
    1 - tolerance of the best, several are traced back through the table of the dynamic program, a length at a time, with odds by
    the stock left that favour long pieces, and each is raised by `part` of what its scarcest length allows, so nothing is
    covered twice; covered lengths drop out. A pass ends when all is covered. Then a length's weight is multiplied by what it
    has cost to the power eta: the mean of capacity over tokens of the configurations that took it. The next pass begins anew
    with these weights. Any weights give a lower bound, the total worth over the best configuration's; the pass with the
    fewest bins and the largest bound are kept. The draws are seeded: equal histograms, equal plans.
    """
    draw = np.random.default_rng(seed)
    place = {int(n): i for i, n in enumerate(lengths)}
    weights, bound, kept = np.zeros(len(lengths)), 0.0, None
    for _ in range(passes):
        stock, shares = counts.astype(float), {}
        for _ in range(rounds):
            where = np.flatnonzero(stock > 1e-3 * counts)
            if not len(where):
                break
            sizes, n_of, rest = lengths[where], counts[where], stock[where]
            value = sizes * np.exp(weights[where] - weights[where].max())
            best = knapsack(sizes, value, capacity)
            bound = max(bound, float((value * n_of).sum() / best[capacity]))
            failed = 0
            for luck in draw.random((max(64, len(sizes) // 4), 16)).tolist():
                config = traced(sizes, value, best, rest > 1e-3 * n_of, rest, (tolerance + 1e-9) * best[capacity], luck)
                if config is None:  # what would be worth enough has run out meanwhile: other prices are due
                    failed += 1
                    if failed > 8:
                        break
                    continue
                at, n = np.unique(config, return_counts=True)
                often = float((rest[at] / n).min())
                often = often if often < 1 else part * often
                rest[at] -= often * n
                key = tuple(sizes[sorted(config, reverse=True)].tolist())
                shares[key] = shares.get(key, 0.0) + often
            stock[where] = rest
        if (stock > 1e-3 * counts).any():  # rounds ran out: what is left, alone
            for i in np.flatnonzero(stock > 1e-3 * counts):
                key = (int(lengths[i]),) * (capacity // int(lengths[i]))
                shares[key] = shares.get(key, 0.0) + float(stock[i]) / len(key)
        if kept is None or sum(shares.values()) < sum(kept.values()):
            kept = shares
        cost = np.zeros(len(lengths))
        for c, x in shares.items():
            for n in c:
                cost[place[n]] += x * capacity / sum(c)
        weights += eta * np.log(np.maximum(cost / counts, 1e-9))
        if sum(kept.values()) <= 1.002 * bound:
            break
    return Fractional(kept, bound)


def traced(sizes: np.ndarray, value: np.ndarray, best: np.ndarray, there: np.ndarray, stock: np.ndarray, slack: float, luck: list[float]) -> list[int] | None:
    """Places of the lengths of one configuration that loses at most `slack` of the best value, of lengths that are there; None if the draw fails."""
    room, config = len(best) - 1, []
    while k := int(np.searchsorted(sizes, room, "right")):
        loss = best[room] - (value[:k] + best[room - sizes[:k]])
        good = np.flatnonzero((loss <= slack) & there[:k])
        if not len(good):
            return config if config and best[room] <= slack else None
        odds = np.cumsum(stock[good] * (sizes[good] / sizes[-1]) ** LONG_FIRST)
        i = int(good[min(int(np.searchsorted(odds, luck[len(config) % len(luck)] * odds[-1], "right")), len(good) - 1)])
        config.append(i)
        slack -= max(0.0, float(loss[i]))
        room -= int(sizes[i])
    return config


@dataclass
class Plan:
    """Bins of one kind: each holds (length, copies) from the longest to the shortest; `bins` of them, numbered from `first`."""

    lengths: tuple[tuple[int, int], ...]
    first: int
    bins: int


def fill(left: dict[int, int], order: list[int], room: int) -> list[int]:
    """Lengths still left whose total comes nearest to `room` from below, long ones first; each at most once (a sum of subsets as bits)."""
    reach, steps = 1, []
    full, mask = 1 << room, (1 << (room + 1)) - 1
    for n in order:
        if n <= room and left[n] > 0:
            steps.append((n, reach))
            reach |= (reach << n) & mask
            if reach & full:
                break
    at, out = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> at & 1:
            out.append(n)
            at -= n
    return out


def round_up(fractional: Fractional, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[Plan]:
    """Whole bins: shares are cumulated and cut to whole numbers, as far as the lengths are left; what remains goes into bins around
    its longest length, filled as near to the brim as the lengths left allow, each kind as often as they last."""
    left = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    plans, bins, carry = [], 0, 0.0

    def add(config: list[int], often: int) -> None:
        nonlocal bins
        kinds = sorted(((n, config.count(n)) for n in set(config)), reverse=True)
        for n, k in kinds:
            left[n] -= k * often
        plans.append(Plan(tuple(kinds), bins, often))
        bins += often

    for c, share in sorted(fractional.shares.items(), key=lambda x: (-sum(x[0]), x[0])):
        carry += share
        if carry >= 1:
            often = min(int(carry), *(left[n] // c.count(n) for n in set(c)))
            carry -= int(carry)
            if often > 0:
                add(list(c), often)
    order = sorted((n for n, k in left.items() if k), reverse=True)
    while order:
        longest = order[0]
        left[longest] -= 1  # the bin's first; the rest is chosen without it
        config, room = [longest], capacity - longest
        while room and (more := fill(left, order, room)):
            config += more
            room -= sum(more)
            for n in more:
                left[n] -= 1
        for n in config:
            left[n] += 1
        add(config, min(left[n] // config.count(n) for n in set(config)))
        order = [n for n in order if left[n]]
    return plans


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, **options) -> tuple[list[Plan], float]:
    """Plans that use every length exactly as often as it occurs, and the program's lower bound on their number of bins."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    if not len(lengths):
        return [], 0.0
    if lengths.min() < 1 or lengths.max() > capacity or counts.min() < 1:
        raise ValueError("lengths must lie within the capacity and occur")
    found = solve(lengths, counts, capacity, **options)
    return round_up(found, lengths, counts, capacity), found.bound
