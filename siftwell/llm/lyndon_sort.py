"""Suffix arrays by linear grouping, without recursion and renaming.

Phase 1 takes suffix groups in descending order.  Each suffix of the group points to its previous
smaller suffix, the nearest one to the left in a lower group; the suffixes pointed at are split
off their groups by how many pointers they got and move up behind what stays.  In the end each
group holds the suffixes with one Lyndon prefix.  Phase 2 walks the suffix array from the smallest
suffix and emits each group's order by following the same pointers.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> list[int]:
    """Suffix array of an integer sequence whose last symbol is its unique smallest one."""
    n = len(text)
    if n == 0:
        return []
    order = np.argsort(text, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(text[order]) != 0, True])
    members: list[list[int]] = [order[a:b].tolist() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    count = len(members)
    group = np.empty(n, np.int64)
    group[order] = np.repeat(np.arange(count), np.diff(edges))
    group = group.tolist()
    lower, higher = list(range(-1, count - 1)), [*range(1, count), -1]
    back = list(range(n))  # nearest place at or left of each that isn't taken yet; -1: none
    smaller = [-1] * n
    final: list[list[int]] = []
    g = count - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        if own:
            final.append(own)
            for i in own:
                back[i] = i - 1
            tally: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0:
                    k = back[j]
                    if k == j:
                        break
                    if k >= 0:
                        back[j] = back[k]
                    j = k
                if j >= 0:
                    smaller[i] = j
                    tally[j] = tally.get(j, 0) + 1
            if tally:
                split: dict[tuple[int, int], list[int]] = {}
                for j, times in tally.items():
                    key = (group[j], times)
                    if key in split:
                        split[key].append(j)
                    else:
                        split[key] = [j]
                for h, times in sorted(split, reverse=True) if len(split) > 1 else split:
                    moved = split[h, times]
                    new = len(members)
                    members.append(moved)
                    for j in moved:
                        group[j] = new
                    up = higher[h]  # directly above what stays of h
                    lower.append(h)
                    higher.append(up)
                    higher[h] = new
                    lower[up] = new
                    # groups of h with more pointers were put in before and stand higher
        members[g] = []
        g = lower[g]
    final.reverse()
    front, at = [0] * n, 0
    start_of = [0] * len(final)
    for k, own in enumerate(final):
        start_of[k] = at
        for i in own:
            front[i] = k
        at += len(own)
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            k = front[s]
            out[start_of[k]] = s
            start_of[k] += 1
            placed[s] = 1
            s = smaller[s]
    return out


def common_prefixes(text: list[int], order: list[int], stop: int) -> list[int]:
    """Of each suffix and the one before it in the order, the common symbols up to the first one not over stop."""
    n = len(text)
    rank, out, h = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            while text[i + h] == text[j + h] and text[i + h] > stop:
                h += 1
            out[r] = h
        if h:
            h -= 1
    return out
