"""The Burrows-Wheeler transform and common prefixes of a collection of short strings, built column by column.

Every round takes one more symbol from the end of each string, from right to left, and inserts the suffix that
begins with it. Its place follows from the transform so far: it stands as many rows into its symbol's part as
that symbol occurs above the row of the suffix without it. Its common prefix with the row above is one more
than the smallest common prefix between the two rows they come from. Transform, common prefixes and owners are
read and written in sequence, once in each round.
"""

from __future__ import annotations

import numpy as np


def _ranges_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of ``values[low:high]`` for ranges that are not empty."""
    if not len(low):
        return np.zeros(0, values.dtype)
    # from the last range to the first, so that nothing is reduced between two of them
    order = np.argsort(low)[::-1]
    places = np.stack([low[order], high[order]], 1).ravel()
    out = np.empty(len(low), values.dtype)
    out[order] = np.minimum.reduceat(np.append(values, values.dtype.type(0)), places)[::2]
    return out


def collection_suffixes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Sorted suffixes of the strings ``data[start : start + length]``: ``(string, offset, common, symbol)`` by row.

    ``common`` is the common prefix with the row above, ends of different strings being different; ``symbol``
    is one more than the byte before the suffix, or 0. Lengths are at most 65535.
    """
    m = len(starts)
    symbol = np.zeros(m, np.uint16)
    common = np.zeros(m, np.uint16)
    owner = (np.arange(m, dtype=np.int64) << 16) | lengths
    row = np.arange(m)
    for done in range(int(lengths.max()) if m else 0):
        going = np.flatnonzero(lengths > done)
        byte = data[starts[going] + lengths[going] - done - 1].astype(np.uint16) + 1
        symbol[row[going]] = byte
        order = np.argsort(symbol, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = row[going]
        k = place[at]
        ended = np.searchsorted(symbol[order], 1) if done else 0
        # common prefix with the row above, and that of the row below with the new one
        above = order[np.maximum(k - 1, 0)]
        tied = (k > 0) & (symbol[above] == byte)
        fresh = np.zeros(len(going), np.uint16)
        fresh[tied] = _ranges_min(common, above[tied] + 1, at[tied] + 1) + 1
        below = order[np.minimum(k + 1, len(order) - 1)]
        next_tied = (k + 1 < len(order)) & (symbol[below] == byte)
        lower = _ranges_min(common, at[next_tied] + 1, below[next_tied] + 1) + 1
        target = k - ended + m
        down = target[next_tied] + 1
        # insert
        size = len(symbol) + len(going)
        old = np.ones(size, bool)
        old[target] = False
        grown = np.empty(size, np.uint16), np.empty(size, np.uint16), np.empty(size, np.int64)
        for new, kept in zip(grown, (symbol, common, owner)):
            new[old] = kept
        shift = np.flatnonzero(old)
        symbol, common, owner = grown
        symbol[target], common[target] = 0, fresh
        owner[target] = (going.astype(np.int64) << 16) | (lengths[going] - done - 1)
        common[down] = lower
        row = shift[row]
        row[going] = target
    return owner >> 16, owner & 0xFFFF, common, symbol


def repeats(data, starts, lengths, doc, place, width: int):
    """``(string, offset)`` of every window of ``width`` bytes that also starts earlier in another place.

    ``doc`` and ``place`` order the strings' windows: by document, then by ``place + offset``.
    """
    _, rank = np.unique(doc, return_inverse=True)
    where = (rank.astype(np.int64) << 40) | place
    # equal strings enter once, held by the first; all others go whole
    content = np.array([data[s : s + n].tobytes() for s, n in zip(starts.tolist(), lengths.tolist())], dtype=object)
    held: dict[bytes, int] = {}
    for i in np.argsort(where, kind="stable").tolist():
        held.setdefault(content[i], i)
    once = np.array(sorted(held.values()), np.int64)
    again = np.setdiff1d(np.arange(len(starts)), once)
    again = again[where[again] > where[[held[c] for c in content[again]]]] if len(again) else again
    spare = np.repeat(again, lengths[again] - width + 1)
    begun = np.cumsum(lengths[again] - width + 1) - (lengths[again] - width + 1)
    slide = np.arange(len(spare)) - np.repeat(begun, lengths[again] - width + 1)
    string, offset, common, _ = collection_suffixes(data, starts[once], lengths[once])
    string = once[string]
    whole = np.flatnonzero(lengths[string] - offset >= width)
    if not len(whole):
        return spare, slide
    group = np.cumsum(common < width)[whole]
    string, offset = string[whole], offset[whole]
    key = where[string] + offset
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    first = np.repeat(np.minimum.reduceat(key, head), np.diff(np.append(head, len(key))))
    later = key > first
    return np.append(string[later], spare), np.append(offset[later], slide)
