"""Linear suffix sorting by grouping, after Baier (2016).

Suffixes are first grouped by their first symbol. Groups are taken in descending order; each
suffix of a group finds the nearest suffix to its left in a smaller group (its previous smaller
one) by following pointers, and the suffixes found are moved, by how often they were found, into
new groups just above their old ones. Then every group holds the suffixes that share one Lyndon
prefix, and one pass over the growing order, following the same pointers, places each suffix at
its group's next free place. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations


def suffix_array(symbols) -> list[int]:
    """Order of all suffixes of ``symbols`` (integers), the empty one not included."""
    n = len(symbols)
    group, members, below, above = _first_groups(symbols)
    previous = [-1] * (n + 1)
    done = bytearray(n + 1)
    current = len(members) - 1
    while current >= 0:
        _split(current, group, members, below, above, previous, done)
        current = below[current]
    return _ordered(n, group, members, below, above, previous)


def _first_groups(symbols):
    """Groups by first symbol in a linked list; the end of the text is a group of its own, 0."""
    n = len(symbols)
    number = {symbol: at + 1 for at, symbol in enumerate(sorted(set(symbols)))}
    group = [number[symbol] for symbol in symbols] + [0]
    members = [[] for _ in range(len(number) + 1)]
    for at in range(n + 1):
        members[group[at]].append(at)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    return group, members, below, above


def _split(current, group, members, below, above, previous, done):
    """Find the previous smaller suffix of each suffix of a group and move those found."""
    own = [at for at in members[current] if group[at] == current]
    members[current] = own
    found: list[int] = []
    times: list[int] = []
    for at in own:
        left = at - 1
        while left >= 0 and done[left]:
            left = previous[left]
        if left >= 0 and group[left] == current:
            # The nearest one left of it in the same group has been seen already.
            left = previous[left]
        previous[at] = left
        done[at] = 1
        if left < 0:
            continue
        # Suffixes come from left to right, so equal finds follow each other.
        if found and found[-1] == left:
            times[-1] += 1
        else:
            found.append(left)
            times.append(1)
    if not found:
        return
    highest = max(times)
    levels = [found] if highest == 1 else _by_times(found, times)
    for level in levels:
        fresh: dict[int, int] = {}
        for at in level:
            old = group[at]
            new = fresh.get(old)
            if new is None:
                new = fresh[old] = len(members)
                members.append([])
                after = above[old]
                below.append(old)
                above.append(after)
                above[old] = new
                if after >= 0:
                    below[after] = new
            group[at] = new
            members[new].append(at)


def _by_times(found, times):
    """Those found most often first: each later level goes below the one before."""
    levels: dict[int, list[int]] = {}
    for at, n in zip(found, times):
        levels.setdefault(n, []).append(at)
    return [levels[n] for n in sorted(levels, reverse=True)]


def _ordered(n, group, members, below, above, previous):
    """The second phase: place suffixes at their groups' free places."""
    place = [0] * len(members)
    at, start = 0, 0
    while at >= 0:
        place[at] = start
        start += len(members[at])
        at = above[at]
    order = [n] + [-1] * n
    placed = bytearray(n + 1)
    for i in range(n + 1):
        suffix = order[i] - 1
        while suffix >= 0 and not placed[suffix]:
            order[place[group[suffix]]] = suffix
            place[group[suffix]] += 1
            placed[suffix] = 1
            suffix = previous[suffix]
    return order[1:]
