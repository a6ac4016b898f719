"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, repeats.

A shard is a list of byte strings. Each string ends with a mark of its own, below all
bytes, so that suffixes of different strings are told apart and none runs into the next.
"""

from __future__ import annotations

import numpy as np

FIRST = 7  # symbols of 9 bits that the first sort compares at once


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes (places in a text with one mark after each string), and their ranks.

    data holds the strings' bytes one after the other, ends where each ends in it.
    """
    sizes = np.diff(ends, prepend=0)
    total = len(data) + len(ends)
    marks = ends + np.arange(len(ends))
    symbol = np.zeros(total + FIRST, "u8")
    body = np.ones(total, bool)
    body[marks] = False
    symbol[:total][body] = data.astype("u8") + np.uint64(1)
    owner = np.repeat(np.arange(len(ends)), sizes + 1)
    left = marks[owner] - np.arange(total)  # symbols before the mark
    key = np.zeros(total, "u8")
    for k in range(FIRST):
        key <<= np.uint64(9)
        key |= np.where(left >= k, symbol[k : k + total], np.uint64(0))
    order = np.argsort(key, kind="stable")  # equal keys with a mark stay in the order of strings
    sorted_key = key[order]
    new = np.ones(total, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | (left[order[1:]] < FIRST)
    group = np.maximum.accumulate(np.where(new, np.arange(total), 0))
    rank = np.empty(total, "i8")
    rank[order] = group
    h = FIRST
    alone = new & np.append(new[1:], True)
    slots = np.flatnonzero(~alone)  # the places in order that are not settled
    while len(slots):
        at = order[slots]
        second = rank[np.minimum(at + h, total - 1)]
        pair = (rank[at].astype("u8") << np.uint64(32)) | second.astype("u8")
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in order, for all strings side by side.

    A suffix's prefix is at most one shorter than that of the suffix one place earlier in
    its string; so each string is walked once, and numpy walks them together. Prefixes
    stop at the ends of strings.
    """
    total = len(data) + len(ends)
    marks = ends + np.arange(len(ends))
    starts = np.concatenate([[0], marks[:-1] + 1])
    text = np.zeros(total + 8, "u1")
    body = np.ones(total, bool)
    body[marks] = False
    text[:total][body] = data
    eight = np.zeros(total, "u8")  # eight bytes from each place, to compare at once
    for k in range(8):
        eight |= text[k : k + total].astype("u8") << np.uint64(8 * k)
    stop = np.repeat(marks, marks - starts + 1)
    before = np.empty(total, "i8")
    before[order[1:]], before[order[0]] = order[:-1], -1
    out = np.zeros(total, "i8")
    live = np.flatnonzero(marks > starts)
    place, h = starts[live].copy(), np.zeros(len(live), "i8")
    while len(live):
        other = before[place]
        h = np.maximum(h - 1, 0)
        h[other < 0] = 0
        limit = np.where(other < 0, 0, np.minimum(stop[place] - place, stop[other] - other))
        go = np.flatnonzero(h < limit)
        while len(go):
            x = eight[place[go] + h[go]] ^ eight[other[go] + h[go]]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype("f8")).astype("i8") >> 3)
            h[go] = np.minimum(h[go] + same, limit[go])
            go = go[(same == 8) & (h[go] < limit[go])]
        out[place] = h
        place = place + 1
        more = place < marks[live]
        live, place, h = live[more], place[more], h[more]
    return out[order]


def repeats(strings: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every place at which `span` bytes start that start at another place too: string, place, run.

    Places with the same run have the same `span` bytes.
    """
    sizes = np.array([len(s) for s in strings], "i8")
    data, ends = np.frombuffer(b"".join(strings), "u1"), np.cumsum(sizes)
    none = np.empty(0, "i8")
    if not len(data):
        return none, none, none
    order, rank = suffix_array(data, ends)
    same = common_prefixes(data, ends, order, rank) >= span
    run = np.cumsum(~same)
    member = same.copy()
    member[:-1] |= same[1:]
    at = order[member]
    owner = np.repeat(np.arange(len(ends)), sizes + 1)[at]
    return owner, at - (ends + np.arange(len(ends)) - sizes)[owner], run[member]
