"""Suffix sorting by linear grouping construction.

Suffixes are grouped by a prefix that grows to their Lyndon prefix.  Groups are handled in descending order: each suffix
points to the previous one in a smaller group, and what is pointed at m times by the group at hand moves behind the rest of
its own group, the more often the further.  When all groups are handled, suffixes of a group differ only by what follows
the Lyndon prefix; going through the order as it is emitted places each suffix before whose start a smaller one ends.  Ranks
are never renamed and nothing recurs.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of text, whose last symbol must be smaller than all others."""
    n = len(text)
    if n < 2:
        return list(range(n))
    # a group is a range of the order, named by its first place
    of = [0] * n
    members: list = [None] * n
    start_of_end = [0] * n
    end_of = [0] * n
    by: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by.setdefault(c, []).append(i)
    at = 0
    for c in sorted(by):
        own = by[c]
        for i in own:
            of[i] = at
        members[at] = own
        start_of_end[at + len(own) - 1] = at
        end_of[at] = at + len(own) - 1
        at += len(own)

    previous = [-1] * n
    end = n - 1
    while end >= 0:
        start = start_of_end[end]
        hit: list[int] = []
        times: list[int] = []
        last = -1
        own, members[start] = members[start], None
        if end == start and len(own) == 1:  # mostly
            i = own[0]
            j = i - 1
            while j >= 0 and of[j] >= start:
                j = previous[j]
            previous[i] = j
            end = start - 1
            if j >= 0:
                g = of[j]
                to = end_of[g]
                if to != g:
                    of[j] = start_of_end[to] = end_of[to] = to
                    members[to] = (j,)
                    start_of_end[to - 1], end_of[g] = g, to - 1
            continue
        for i in own:
            if of[i] != start:
                continue  # moved away since it was listed
            j = i - 1
            while j >= 0 and of[j] >= start:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                if j == last:
                    times[-1] += 1
                else:
                    hit.append(j)
                    times.append(1)
                    last = j
        if hit:
            if len(hit) == 1:
                levels = [hit]
            else:
                most = max(times)
                if most == 1:
                    levels = [hit]
                else:
                    found: dict[int, list[int]] = {}
                    for j, m in zip(hit, times):
                        found.setdefault(m, []).append(j)
                    levels = [found[m] for m in sorted(found, reverse=True)]
            for level in levels:
                split: dict[int, list[int]] = {}
                for j in level:
                    g = of[j]
                    if g in split:
                        split[g].append(j)
                    else:
                        split[g] = [j]
                for g, moved in split.items():
                    to = end_of[g]
                    new = to + 1 - len(moved)
                    if new == g:
                        continue  # the whole group
                    for j in moved:
                        of[j] = new
                    members[new] = moved
                    start_of_end[to], end_of[new] = new, to
                    start_of_end[new - 1], end_of[g] = g, new - 1
        end = start - 1

    order = [0] * n
    placed = bytearray(n)
    free = list(range(n))  # next free place of a group
    order[0] = n - 1
    placed[n - 1] = 1
    for r in range(n):
        j = order[r] - 1
        while j >= 0 and not placed[j]:
            g = of[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return order
