"""Suffix arrays by linear grouping over Lyndon prefixes.

First the suffixes are grouped by their Lyndon prefix. Groups are taken in descending order; the members of the
group at hand find the nearest earlier suffix in a smaller group (their previous-smaller pointer), and those
suffixes, extended by one or more copies of the group's prefix, leave their group for new ones right above it,
more copies lying higher. Each suffix is extended once for every copy, so the total work is that of the text,
and groups are never renamed. Then, smallest suffix first, the suffixes whose Lyndon prefix ends where that
suffix starts are written to the next free place of their group.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order (a proper prefix comes first)."""
    n = len(text)
    if not n:
        return []
    # members of each group, the group below it, and whether it was taken already
    members: list[list[int]] = []
    below: list[int] = []
    above: list[int] = []
    home = [0] * n
    numbers: dict[int, int] = {}
    for symbol in sorted(set(text)):
        numbers[symbol] = len(members)
        below.append(len(members) - 1)
        above.append(len(members) + 1)
        members.append([])
    for i, symbol in enumerate(text):
        g = numbers[symbol]
        home[i] = g
        members[g].append(i)
    highest = len(members) - 1
    above[highest] = -1
    taken = [False] * (len(members) + n)
    smaller = [-1] * n
    at = highest
    while at >= 0:
        taken[at] = True
        now = [i for i in members[at] if home[i] == at]
        now.sort()
        members[at] = now
        copies: dict[int, int] = {}
        for i in now:
            j = i - 1
            while j >= 0 and taken[home[j]]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                copies[j] = copies.get(j, 0) + 1
        if copies:
            moves: dict[tuple[int, int], list[int]] = {}
            for p, count in copies.items():
                key = (count, home[p])
                if key in moves:
                    moves[key].append(p)
                else:
                    moves[key] = [p]
            for count, old in sorted(moves, reverse=True) if len(moves) > 1 else moves:
                moved = moves[count, old]
                new = len(members)
                if new >= len(taken):
                    taken.extend([False] * n)
                members.append(moved)
                for p in moved:
                    home[p] = new
                over = above[old]
                above.append(over)
                below.append(old)
                above[old] = new
                if over >= 0:
                    below[over] = new
                else:
                    highest = new
        at = below[at]
    # the groups' first places, from the smallest group
    free = [0] * len(members)
    g = 0
    place = 0
    while g >= 0:
        free[g] = place
        place += len(members[g])
        g = above[g]
    out = [-1] * n
    placed = [False] * n
    for k in range(-1, n):
        j = (n if k < 0 else out[k]) - 1
        while j >= 0 and not placed[j]:
            placed[j] = True
            g = home[j]
            out[free[g]] = j
            free[g] += 1
            j = smaller[j]
    return out
