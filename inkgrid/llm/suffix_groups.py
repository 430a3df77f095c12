"""Suffix arrays of many short texts at once, by linear grouping construction.

Phase one keeps the suffixes of a text in groups that are ordered among themselves, at first by
their first symbol. Groups are handled in descending order. A suffix of the group at hand points to
its previous smaller suffix (the nearest one before it in a lower group); what a group points to
moves into new groups behind the rest of its own group, the more often pointed to the higher. In the
end a group is the suffixes with one Lyndon prefix. Phase two walks the suffix array upwards: from
each entry it follows the previous-smaller pointers from the position before it, and every suffix
met that has no place yet takes the next one of its group. Nothing is renamed or sorted recursively.

All texts of a batch take each step together, so a step costs array operations over the batch and
not interpreted work for each text. The members of a group stay side by side, so a step touches only
the group that each text has at hand; a text that is ahead in its suffix array does not wait.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffix arrays by row.

    ``symbols`` is an integer matrix; row ``r`` uses ``lengths[r]`` symbols, of which the last must
    be its only smallest one. Entries beyond a row's length are -1.
    """
    lanes, width = symbols.shape
    base, none = np.arange(lanes) * width, lanes * width  # none: the place before each text, in no group
    # Places and suffixes are numbered through all texts. suffix: what stands at a place, and its inverse place. group:
    # first place of a suffix's group. last: by first place, the last one of the group.
    key = np.where(np.arange(width) < lengths[:, None], symbols.astype(np.uint16), np.uint16(0xFFFF))
    order = np.argsort(key, axis=1, kind="stable")
    key = np.take_along_axis(key, order, 1)
    suffix = (order + base[:, None]).ravel()
    new = np.ones((lanes, width), bool)
    new[:, 1:] = key[:, 1:] != key[:, :-1]
    begin = np.flatnonzero(new)
    extent = np.diff(np.append(begin, none))
    place, group, last = (np.empty(none + 1, np.int64) for _ in range(3))
    place[suffix] = np.arange(none)
    group[suffix] = np.repeat(begin, extent)
    group[none] = -1
    last[begin] = begin + extent - 1
    before = np.arange(-1, none)
    before[base] = none
    back = before.copy()
    top, least = base + lengths - 1, base + 1  # last place of the group at hand; place 0 is the last symbol's, to which nothing points
    while len(top := top[(live := np.flatnonzero(top >= least))]):
        least = least[live]
        low = group[suffix[top]]
        n = top - low + 1
        alone = n == 1
        one, many = np.flatnonzero(alone), np.flatnonzero(~alone)
        members = n[many]
        ends = np.cumsum(members)
        own = np.repeat(low[many], members)
        member = suffix[np.concatenate([low[one], own + np.arange(len(own)) - np.repeat(ends - members, members)])]
        floor = np.concatenate([low[one], own])
        at = back[member]
        open_ = np.flatnonzero(group[at] >= floor)
        while len(open_):
            at[open_] = to = back[at[open_]]
            open_ = open_[group[to] >= floor[open_]]
        back[member] = at
        # A group of one points to one suffix, which moves behind the rest of its group.
        parents = at[: len(one)]
        parents = parents[parents < none]
        of = group[parents]
        slot = last[of]
        left = place[parents]
        moved = suffix[slot]
        suffix[left], place[moved] = moved, left
        suffix[slot], place[parents] = parents, slot
        last[of] = slot - 1
        last[slot] = slot
        group[parents] = slot
        parents = np.sort(at[len(one) :])
        fresh = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]])) if len(parents) else parents
        times = np.diff(np.append(fresh, len(parents)))
        parents = parents[fresh]
        if len(parents) and parents[-1] == none:
            parents, times = parents[:-1], times[:-1]
        if len(parents):
            of = group[parents]
            order = np.argsort(of * (width + 1) - times)
            parents, times, of = parents[order], times[order], of[order]
            new = np.ones(len(of), bool)
            new[1:] = of[1:] != of[:-1]
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(of)))
            end = last[of[begin]]
            # The most pointed to come first here and last in the group.
            slot = np.repeat(end + begin, count) - np.arange(len(of))
            left = place[parents]
            tail = np.repeat(end - count, count)
            stay = suffix[slot]
            place[parents] = -1
            stay = stay[place[stay] >= 0]
            left = left[left <= tail]
            suffix[left], place[stay] = stay, left
            suffix[slot], place[parents] = parents, slot
            last[of[begin]] = end - count
            new[1:] |= times[1:] != times[:-1]
            piece = np.flatnonzero(new)
            extent = np.diff(np.append(piece, len(of)))
            first = slot[piece] - extent + 1
            last[first] = slot[piece]
            group[parents] = np.repeat(first, extent)
        top = low - 1
    out = np.full(none, -1, np.int64)
    out[base] = base + lengths - 1
    placed = np.ones(none + 1, bool)
    placed[:-1] = (np.arange(width) >= lengths[:, None] - 1).ravel()
    free = np.arange(none)  # next free place of each group
    stop = base + lengths
    here = base.copy()  # how far each suffix array has been walked
    at = before[out[here]]
    while len(here):
        # Suffixes before the last symbol have only it below them.
        k = np.flatnonzero(~placed[at])
        a = at[k]
        slot = group[a]
        to = free[slot]
        out[to] = a
        free[slot] = to + 1
        placed[a] = True
        at[k] = back[a]
        k = np.flatnonzero(placed[at])
        here[k] = to = here[k] + 1
        if (to >= stop[k]).any():
            k = here < stop
            here, at, stop = here[k], at[k], stop[k]
            k = np.flatnonzero(placed[at])
            to = here[k]
        at[k] = before[out[to]]
    out = out.reshape(lanes, width)
    return np.where(out >= 0, out - base[:, None], -1)
