"""Suffix order by linear grouping: Lyndon prefixes first, order inside the groups second.

Written from the published description of grouping suffix sorting (Baier 2016): no renaming, no recursion.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_order(text: Sequence[int]) -> list[int]:
    """Start positions of all suffixes in ascending order; a suffix that is a prefix of another comes first.

    Phase 1 keeps the suffixes in groups of equal prefixes, ordered ascending, at first one for each symbol, and
    takes the groups from the top. For every member the pointer to the nearest place before it in a lower group
    (the previous smaller one) names a suffix whose known prefix ends exactly where the member begins. That suffix
    takes the member's prefix over, as often as the group follows it in a row, and moves to a group of its own
    just above its old one. When the lowest group is done, each suffix stands with the others of its longest
    Lyndon prefix. Phase 2 reads the order from left to right: what follows a suffix's Lyndon prefix is a smaller
    suffix, so its place is known before, and hands the next free place of its group to the suffix in front.
    """
    n = len(text)
    if not n:
        return []
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        if c in by_symbol:
            by_symbol[c].append(i)
        else:
            by_symbol[c] = [i]
    members = [by_symbol[c] for c in sorted(by_symbol)]
    group = [0] * n
    for g, those in enumerate(members):
        for i in those:
            group[i] = g
    length = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    before = list(range(-1, n - 1))
    done = bytearray(n)

    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            done[i] = 1
        follows: dict[int, int] = {}
        for i in own:
            p = before[i]
            while p >= 0 and done[p]:
                q = before[p]
                if q >= 0:
                    before[p] = before[q] if done[q] else q
                p = q
            before[i] = p
            if p >= 0:
                follows[p] = follows.get(p, 0) + 1
        if follows:
            moves: dict[tuple[int, int], list[int]] = {}
            for p, times in follows.items():
                key = (group[p], times)
                if key in moves:
                    moves[key].append(p)
                else:
                    moves[key] = [p]
            size, last, under = length[g], -1, -1
            for old, times in sorted(moves) if len(moves) > 1 else moves:
                if old != last:
                    last = under = old
                new = len(members)
                those = moves[old, times]
                members.append(those)
                length.append(length[old] + times * size)
                over = above[under]
                below.append(under)
                above.append(over)
                above[under] = new
                if over >= 0:
                    below[over] = new
                under = new
                for p in those:
                    group[p] = new
        g = below[g]

    place = [0] * len(members)
    g, at = 0, 0  # group 0 is that of the least symbol and stays the lowest
    while g >= 0:
        place[g] = at
        at += len(members[g])
        g = above[g]
    first = [-1] * (n + 1)
    after = [-1] * n
    for i in range(n):
        end = i + length[group[i]]
        after[i] = first[end]
        first[end] = i
    order = [0] * n
    i = first[n]
    while i >= 0:
        g = group[i]
        order[place[g]] = i
        place[g] += 1
        i = after[i]
    for k in range(n):
        i = first[order[k]]
        while i >= 0:
            g = group[i]
            order[place[g]] = i
            place[g] += 1
            i = after[i]
    return order
