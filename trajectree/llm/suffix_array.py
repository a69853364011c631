"""Suffix arrays in linear grouping steps (after Baier, 2016), for the strings that one task compares."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence


def suffix_array(s: Sequence[int]) -> list[int]:
    """Starts of the suffixes of s in order. s ends with a symbol that is smaller than all others.

    Suffixes are grouped by a prefix of their Lyndon prefix, at first the first symbol. Groups are taken in descending order: each suffix of a group lends
    its prefix to the suffix at its previous-smaller pointer, the nearest one before it in a smaller group; those that receive the same number of such
    prefixes leave their group together, as a group just above it. In the end a group holds the suffixes of one Lyndon prefix, and the order inside each
    follows from the order of what comes after the prefix, in one ascending pass. Nothing is renamed.
    """
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for k, i in enumerate(order):
        if s[i] != s[order[start]]:
            start = k
        place[i], group[i] = k, start
        size[start] += 1
    smaller = [-1] * n
    top = n
    while top:
        first = group[order[top - 1]]
        if top - first == 1:  # most groups hold one suffix: the same steps for it alone
            i = order[first]
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = smaller[p]
            smaller[i], top = p, first
            if p >= 0 and size[old := group[p]] > 1:
                fresh = old + size[old] - 1
                hole, last = place[p], order[fresh]
                order[hole], place[last] = last, hole
                order[fresh], place[p], group[p] = p, fresh, fresh
                size[old], size[fresh] = fresh - old, 1
            continue
        lent: Counter[int] = Counter()
        for i in sorted(order[first:top]):
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                lent[p] += 1
        top = first
        # Those with more prefixes of this group stand higher: they leave first, each time from the end of their old group.
        leaving: dict[tuple[int, int], list[int]] = defaultdict(list)
        for p, times in lent.items():
            leaving[group[p], -times].append(p)
        for (old, _), out in sorted(leaving.items()):
            end = old + size[old]
            fresh = end - len(out)
            if fresh == old:
                continue
            # A swap with what stands at the end: those that leave fill the last places.
            holes = [place[i] for i in out if place[i] < fresh]
            if holes:
                gone = set(out)
                staying = [i for i in order[fresh:end] if i not in gone]
            else:
                staying = []
            for hole, i in zip(holes, staying):
                order[hole], place[i] = i, hole
            for k, i in enumerate(out, fresh):
                order[k], place[i], group[i] = i, k, fresh
            size[old], size[fresh] = fresh - old, len(out)
    # What follows a suffix's Lyndon prefix is the suffix that reaches it by its chain of pointers.
    result, free, placed = [0] * n, list(range(n)), [False] * n
    result[0], placed[n - 1] = n - 1, True
    for k in range(n):
        i = result[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            result[free[g]], placed[i] = i, True
            free[g] += 1
            i = smaller[i]
    return result


def longest_shared(s: Sequence[int], order: list[int]) -> list[int]:
    """For each start, the longest prefix that its suffix shares with any other."""
    n = len(s)
    rank, longest = [0] * n, [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    shared = 0
    for i in range(n):
        if not rank[i]:
            shared = 0
            continue
        j = order[rank[i] - 1]
        while i + shared < n and j + shared < n and s[i + shared] == s[j + shared]:
            shared += 1
        longest[i] = max(longest[i], shared)
        longest[j] = max(longest[j], shared)
        shared = max(0, shared - 1)
    return longest
