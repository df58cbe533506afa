"""Suffix arrays by linear grouping, for many strings in lockstep.

Suffixes are first grouped by their first symbol.  Groups are then taken in descending order: each
member points to the nearest suffix to its left that stands in a lower group (its previous smaller
suffix), and the suffixes pointed at are split off their own groups by how often the group points
at them.  When all groups are done, a group holds the suffixes that share one Lyndon prefix.  A
second, ascending pass then emits the order inside the groups: each emitted suffix releases the
ones whose next smaller suffix it is, along the same pointers.  Nothing is renamed and nothing
recurses; work is linear in the number of symbols.

One string alone would take an interpreted step for each group.  Here a step treats the next group
of every string at once with array operations.
"""

from __future__ import annotations

import numpy as np

#: Reserved symbols: the guard in front of a string and the sentinel behind it; others must be larger.
GUARD, SENTINEL = 0, 1


def suffix_arrays(text: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Suffix arrays of the strings ``text[off[b]:off[b+1]]``, as positions in ``text``, string after string.

    Each string starts with GUARD and ends with SENTINEL, and holds neither elsewhere; their two
    suffixes come first.
    """
    n, blocks = len(text), len(off) - 1
    block = np.repeat(np.arange(blocks), np.diff(off))
    key = block.astype(np.int64) << 32 | text.astype(np.int64)
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    length = np.diff(np.r_[first, n])
    size = np.zeros(n, np.int64)
    size[first] = length
    where = np.empty(n, np.int64)
    where[sa] = np.arange(n)
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(first, length)
    prev = np.arange(-1, n - 1, dtype=np.int64)
    _group_by_lyndon_prefix(off, sa, where, group, size, prev)
    return _emit(off, group, prev)


def _group_by_lyndon_prefix(off, sa, where, group, size, prev) -> None:
    done = np.zeros(len(sa), bool)
    touched = np.zeros(len(sa), bool)
    top, floor = off[1:].copy(), off[:-1] + 2
    live = np.flatnonzero(top > floor)
    while len(live):
        end = top[live]
        start = group[sa[end - 1]]
        count = end - start
        top[live] = start
        live = live[start > floor[live]]
        if len(start) == count.sum():
            mem = sa[start]
        else:
            mem = sa[np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
        done[mem] = True
        p = mem - 1
        hop = done[p]
        if hop.any():
            at = np.flatnonzero(hop)
            while len(at):
                p[at] = prev[p[at]]
                prev[mem[at]] = p[at]
                at = at[done[p[at]]]
        # How often this group points at each suffix; order by (group, count).
        s = np.sort(p)
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        q, c = s[head], np.diff(np.r_[head, len(s)])
        g = group[q]
        big = size[g] > 1
        if not big.all():
            q, c, g = q[big], c[big], g[big]
        if not len(q):
            continue
        o = np.argsort(g << 20 | c, kind="stable")
        q, c, g = q[o], c[o], g[o]
        lead = np.r_[True, g[1:] != g[:-1]]
        at = np.flatnonzero(lead)
        many = np.diff(np.r_[at, len(g)])
        tail = g[at] + size[g[at]] - many  # the touched go to the end of their group
        to = np.repeat(tail - at, many) + np.arange(len(g))
        touched[q] = True
        there = sa[to]
        moved = there[~touched[there]]
        old = where[q]
        holes = old[old < np.repeat(tail, many)]
        touched[q] = False
        sa[holes] = moved
        where[moved] = holes
        sa[to] = q
        where[q] = to
        size[g[at]] -= many
        cut = np.flatnonzero(lead | np.r_[True, c[1:] != c[:-1]])
        run = np.diff(np.r_[cut, len(g)])
        size[to[cut]] = run
        group[q] = np.repeat(to[cut], run)


def _emit(off, group, prev) -> np.ndarray:
    n = len(group)
    out = np.full(n, -1, np.int64)
    done = np.zeros(n, bool)
    front = np.arange(n, dtype=np.int64)
    out[off[:-1]], out[off[:-1] + 1] = off[:-1], off[1:] - 1
    done[off[:-1]] = done[off[1:] - 1] = True
    order = np.argsort(-np.diff(off), kind="stable")
    starts, lens = off[:-1][order], np.diff(off)[order]
    live = len(starts)
    for i in range(1, int(lens[0]) if live else 0):
        while live and lens[live - 1] <= i:
            live -= 1
        j = out[starts[:live] + i] - 1
        j = j[~done[j]]
        while len(j):
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            done[j] = True
            j = prev[j]
            j = j[~done[j]]
    return out
