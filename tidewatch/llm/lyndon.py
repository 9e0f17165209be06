"""Suffix arrays by linear grouping over Lyndon prefixes (Baier 2016), without recursion or renaming.

Phase 1 keeps suffixes in groups that are refined from first symbols to their longest Lyndon
prefixes. Groups are taken in descending order; each suffix of a group finds its previous
smaller one (the nearest to the left in a lower group) by following pointers already set, and
those suffixes move, by how many of the group point at them, to new groups right above their
old ones. Phase 2 runs through the array in ascending order and puts, for each suffix, the one
that starts before it and then its chain of previous smaller ones at the next free places of
their groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of a sequence of integers (0 or more, few beyond its length) in ascending order; a suffix sorts before those that it is a prefix of."""
    n = len(symbols)
    if not n:
        return []
    order = by_symbol(symbols)
    place, group, size = [0] * n, [0] * n, [0] * n  # of a suffix in order; start of its group; of the group with that start
    first, last = 0, None
    for i, s in enumerate(order):
        if symbols[s] != last:
            first, last = i, symbols[s]
        place[s], group[s] = i, first
        size[first] += 1
    before = [-1] * n
    end = n - 1
    while end >= 0:
        g = group[order[end]]
        if g == end:
            s = order[end]
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[s] = p
            if p >= 0:
                _raise((p,), order, place, group, size)
        else:
            chain: dict[int, int] = {}  # a suffix of this group to the one left of it that its pointer has to pass
            for s in order[g : end + 1]:
                p = s - 1
                while p >= 0 and group[p] > g:
                    p = before[p]
                before[s] = p
                if p >= 0 and group[p] == g:
                    chain[s] = p
            for s in chain:  # each link is followed once
                passed, p = [], s
                while p in chain and before[p] == chain[p]:
                    passed.append(p)
                    p = before[p]
                p = before[p]
                for x in passed:
                    before[x] = p
            pointed: dict[int, int] = {}
            for s in order[g : end + 1]:
                if (p := before[s]) >= 0:
                    pointed[p] = pointed.get(p, 0) + 1
            if pointed:
                most = max(pointed.values())
                if most == 1:
                    _raise(pointed, order, place, group, size)
                else:
                    by: dict[int, list[int]] = {}
                    for p, k in pointed.items():
                        by.setdefault(k, []).append(p)
                    for k in sorted(by, reverse=True):
                        _raise(by[k], order, place, group, size)
        end = g - 1
    # Phase 2. The empty suffix is the least: its predecessors come first.
    free = list(range(n))
    out, done = [-1] * n, [False] * n
    s = n - 1
    while s >= 0 and not done[s]:
        g = group[s]
        out[free[g]] = s
        free[g] += 1
        done[s] = True
        s = before[s]
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = True
            s = before[s]
    return out


def by_symbol(symbols: Sequence[int]) -> list[int]:
    """Places in the order of their symbols (0 or more), by counting."""
    counts = [0] * (max(symbols) + 2)
    for x in symbols:
        counts[x + 1] += 1
    at = list(accumulate(counts))
    out = [0] * len(symbols)
    for i, x in enumerate(symbols):
        out[at[x]] = i
        at[x] += 1
    return out


def _raise(suffixes, order: list[int], place: list[int], group: list[int], size: list[int]) -> None:
    """Moves suffixes out of their groups, into one new group right above each old one."""
    for s in suffixes:
        g = group[s]
        size[g] -= 1
        at, to = place[s], g + size[g]
        if at != to:
            other = order[to]
            order[at], order[to] = other, s
            place[other], place[s] = at, to
    starts = [group[s] + size[group[s]] for s in suffixes]  # all before any is counted: a group that went whole starts where it did
    for s, new in zip(suffixes, starts):
        group[s] = new
        size[new] += 1


def repeated(symbols: Sequence[int], starts: Sequence[int], length: int) -> list[bool]:
    """For each start, whether the `length` symbols from it also start at another of the starts.

    Equal runs are neighbours in the suffix array restricted to the starts. A run that would
    pass the end of the sequence is repeated nowhere."""
    at = {s: i for i, s in enumerate(starts)}
    out = [False] * len(starts)
    last, run = None, None
    for s in suffix_array(symbols):
        i = at.get(s)
        if i is None:
            continue
        own = symbols[s : s + length]
        if own == run and len(own) == length:
            out[i] = out[last] = True
        last, run = i, own
    return out
