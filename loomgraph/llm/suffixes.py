"""Suffix order of many texts at once: prefix doubling and common prefixes over whole arrays.

A rank is the place at which the class of a position begins in the order, counted from 1; positions of a class agree in the
prefix looked at so far. Sorting a class splits it and moves no other, so a round costs only what is still open.
"""

from __future__ import annotations

import numpy as np


def classes(keys: np.ndarray) -> np.ndarray:
    """The rank of each position by its key alone, equal keys in one class."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    begins = np.ones(len(keys), bool)
    begins[1:] = held[1:] != held[:-1]
    out = np.empty(len(keys), np.int32)
    out[order] = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0)) + 1
    return out


def doubled(rank: np.ndarray, ends: np.ndarray, width: int = 1) -> list[np.ndarray]:
    """Ranks by prefixes of width, 2 * width, 4 * width ... symbols, until no class can be split any more.

    rank: by the first width symbols, a prefix cut off by its text's end included. ends: where the text of each position
    ends. A suffix that ends comes before those that go on; suffixes that are equal as a whole stay one class.
    """
    levels, n = [rank], len(rank)
    counts = np.bincount(rank, minlength=n + 2)
    open_ = np.flatnonzero((counts[rank] > 1) & (np.arange(n) + width < ends))
    if len(open_):
        # a class is split as a whole, with those of its members that end
        waiting = np.zeros(n + 2, bool)
        waiting[rank[open_]] = True
        open_ = np.flatnonzero(waiting[rank])
    while len(open_):
        now = levels[-1]
        after = open_ + width
        inside = after < ends[open_]
        following = np.where(inside, now[np.minimum(after, n - 1)], 0)
        old = now[open_]
        keys = old.astype(np.int64) * (n + 2) + following
        order = np.argsort(keys, kind="stable")
        held, was, place = keys[order], old[order], np.arange(len(order))
        begins = np.ones(len(order), bool)
        begins[1:] = held[1:] != held[:-1]
        first = np.ones(len(order), bool)
        first[1:] = was[1:] != was[:-1]
        new = was + np.maximum.accumulate(np.where(begins, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        level = now.copy()
        level[open_[order]] = new
        levels.append(level)
        width *= 2
        alone = begins.copy()
        alone[:-1] &= begins[1:]
        going = ~alone & (held % (n + 2) > 0)
        open_ = open_[order[going]]
    return levels


def common_prefixes(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """How many symbols each suffix of the order shares with the one before it; levels of doubled() with width 1.

    The suffixes must be distinct wherever they are in one class at first.
    """
    out = np.zeros(len(order), np.int64)
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    tops = []
    for level in levels[1:]:
        same = level[order[at]] == level[order[at - 1]]
        tops.append(at[~same])
        at = at[same]
    tops.append(at)
    a, b = order[np.zeros(0, np.int64)], order[np.zeros(0, np.int64)]
    places, shared = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for t in range(len(levels) - 1, -1, -1):
        fresh = tops[t]
        step = 1 << t
        if len(places):
            level, n = levels[t], len(order)
            x, y = a + shared, b + shared
            # what the pair shares ends inside both texts, so a place beyond them is never equal
            same = (x < n) & (y < n)
            same &= level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)]
            shared = shared + np.where(same, step, 0)
        places, shared = np.concatenate([places, fresh]), np.concatenate([shared, np.full(len(fresh), step, np.int64)])
        a, b = order[places - 1], order[places]
    out[places] = shared
    return out


def inner_nodes(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the suffix tree whose leaves stand in order: place, low and high of every inner node of depth 1 or more.

    shared: common_prefixes(). A node of several children is told as nodes of two: the one at place has the leaves low to place - 1
    on its left and place to high - 1 on its right, and depth shared[place]; a pair of leaves parts at just one node.
    """
    at = np.flatnonzero(shared > 0)
    if not len(at):
        return at, at, at
    n = len(shared)
    depth = shared[at]
    gaps = np.flatnonzero(np.diff(at) > 1)
    longest = int(np.diff(np.concatenate(([-1], gaps, [len(at) - 1]))).max())
    tables = [shared]
    while 1 << len(tables) <= longest:
        step, last = 1 << (len(tables) - 1), tables[-1]
        table = last.copy()
        table[:-step] = np.minimum(last[:-step], last[step:])
        table[-step:] = 0
        tables.append(table)
    low, high = at - 1, at + 1
    for t in range(len(tables) - 1, -1, -1):
        step, table = 1 << t, tables[t]
        # leftward only deeper ones, rightward also equally deep ones: the leftmost of these parts the others
        begin = low - step + 1
        low = np.where((begin >= 0) & (table[np.maximum(begin, 0)] > depth), low - step, low)
        high = np.where((high + step <= n) & (table[np.minimum(high, n - 1)] >= depth), high + step, high)
    return at, low, high
