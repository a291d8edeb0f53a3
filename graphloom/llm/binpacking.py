"""A grouping genetic algorithm for bin packing, inside one task."""

from __future__ import annotations

import random
from bisect import bisect_left, insort

Bins = list[list[int]]


def best_fit(sizes: list[int], items: list[int], bins: Bins, room: list[int], capacity: int) -> None:
    """Puts items, largest first, each into the fullest bin that has room."""
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for i in sorted(items, key=lambda i: -sizes[i]):
        at = bisect_left(free, (sizes[i], -1))
        if at == len(free):
            b, left = len(bins), capacity
            bins.append([])
            room.append(capacity)
        else:
            left, b = free.pop(at)
        bins[b].append(i)
        room[b] = left - sizes[i]
        if room[b] > 0:
            insort(free, (room[b], b))


def tight_fit(sizes: list[int], capacity: int, rng: random.Random, tries: int = 8) -> Bins:
    """Fills bin after bin: the largest item left, then what leaves the least room.

    Of some random companions, each with its best-fitting third, and the single best
    fit, the tightest is taken; then best fits until nothing goes in.
    """
    free = sorted((z, i) for i, z in enumerate(sizes))
    bins: Bins = []
    while free:
        z, i = free.pop()
        own, room = [i], capacity - z
        while room and free:
            top = bisect_left(free, (room + 1, -1))
            if not top:
                break
            best, chosen = room - free[top - 1][0], (top - 1,)
            for _ in range(tries if best else 0):
                b = rng.randrange(top)
                left = room - free[b][0]
                c = bisect_left(free, (left + 1, -1)) - 1
                if c == b:
                    c -= 1
                slack = left - free[c][0] if c >= 0 else left
                if slack < best:
                    best, chosen = slack, (b, c) if c >= 0 else (b,)
            for at in sorted(chosen, reverse=True):
                z, i = free.pop(at)
                own.append(i)
                room -= z
        bins.append(own)
    return bins


def fitness(room: list[int], capacity: int) -> float:
    """The mean squared fill of the bins; greater is better."""
    return sum((1 - r / capacity) ** 2 for r in room) / max(1, len(room))


def exchange(sizes: list[int], bins: Bins, room: list[int], free: list[int]) -> list[int]:
    """Swaps items of bins for greater free ones that fill them better; what is free after."""
    pool = sorted((sizes[i], i) for i in free)
    for b, own in enumerate(bins):
        if not pool:
            break
        n = 0
        while room[b] and n < len(own):
            z = sizes[own[n]]
            at = bisect_left(pool, (z + room[b] + 1, -1)) - 1
            if at >= 0 and pool[at][0] > z:
                bigger, i = pool.pop(at)
                insort(pool, (z, own[n]))
                own[n] = i
                room[b] -= bigger - z
            n += 1
    return [i for _, i in pool]


def cross(sizes: list[int], capacity: int, donor: Bins, host: Bins, rng: random.Random) -> Bins:
    """Injects well-filled bins of the donor, whole, into the host.

    Bins of the host that hold an injected item are dissolved, so nothing occurs
    twice. As mutation the emptiest of the kept bins and some random ones are opened
    too. What is displaced is first exchanged against smaller items of the kept
    bins, where that fills them better, and then best-fitted.
    """
    fill = [sum(sizes[i] for i in b) for b in donor]
    ranked = sorted(range(len(donor)), key=lambda b: -fill[b])
    best = ranked[: max(1, len(ranked) // 2)]
    chosen = rng.sample(best, max(1, len(best) // 2)) if best else []
    injected = {i for b in chosen for i in donor[b]}
    kept, displaced = [], []
    for b in host:
        if injected.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in injected]
    kept.sort(key=lambda b: sum(sizes[i] for i in b))
    opened = set(range(min(len(kept), 1 + len(kept) // 20)))
    opened |= {rng.randrange(len(kept)) for _ in range(len(kept) // 10)}
    displaced += [i for n in opened for i in kept[n]]
    bins = [list(donor[b]) for b in chosen] + [b for n, b in enumerate(kept) if n not in opened]
    room = [capacity - sum(sizes[i] for i in b) for b in bins]
    best_fit(sizes, exchange(sizes, bins, room, displaced), bins, room, capacity)
    return bins


def evolve(sizes: list[int], capacity: int, start: list[Bins], seed: int, generations: int, population: int) -> Bins:
    """The best packing found from the given ones and new random ones."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)  # as few bins as the sum of sizes allows
    everyone = [*start]
    while len(everyone) < population:
        if any(len(bins) <= least for bins in everyone):
            break
        if len(everyone) == len(start):
            bins = []
            best_fit(sizes, list(range(len(sizes))), bins, [], capacity)
        else:
            bins = tight_fit(sizes, capacity, rng)
        everyone.append(bins)

    def score(bins: Bins) -> tuple[int, float]:
        return -len(bins), fitness([capacity - sum(sizes[i] for i in b) for b in bins], capacity)

    ranked = sorted(((score(b), n, b) for n, b in enumerate(everyone)), key=lambda x: (x[0], -x[1]), reverse=True)
    n = len(everyone)
    for _ in range(generations):
        if len(ranked[0][2]) <= least:
            break
        one, two = rng.sample(ranked, 2) if len(ranked) > 1 else (ranked[0], ranked[0])
        for donor, host in ((one, two), (two, one)):
            child = cross(sizes, capacity, donor[2], host[2], rng)
            n += 1
            ranked.append((score(child), n, child))
        ranked = sorted(ranked, key=lambda x: (x[0], -x[1]), reverse=True)[:population]
    return ranked[0][2]
