"""Words, word shingles and their hashes for Arrow batches of texts, in numpy.

A text column is one byte buffer; words are runs of word bytes in it. Hashes are polynomial over the
bytes (modulo 2^64, random byte values, letters A-Z as a-z) and mixed; two different strings share a
64-bit hash with probability 2^-64 or so, which the callers take as equality.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time; bounds the 8-byte intermediates.
SLICE = 1 << 18
BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


def byte_class(kind: str) -> np.ndarray:
    """Which bytes belong to words: ``space`` - all but white space; ``alnum`` - ASCII letters, digits and all non-ASCII."""
    b = np.arange(256)
    if kind == "space":
        return ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))
    if kind == "alnum":
        return ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x61) & (b <= 0x7A)) | ((b >= 0x41) & (b <= 0x5A)) | (b >= 0x80)
    raise ValueError(kind)


def folded_values() -> np.ndarray:
    """The random value of each byte, with A-Z as a-z."""
    values = _VALUES.copy()
    values[0x41:0x5B] = values[0x61:0x7B]
    return values


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h.copy()
    part = np.empty_like(h)
    h ^= np.right_shift(h, np.uint64(30), out=part)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= np.right_shift(h, np.uint64(27), out=part)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= np.right_shift(h, np.uint64(31), out=part)
    return h


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2^64 for i up to n."""

    def run(b):
        out = np.full(n + 1, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(base), run(pow(base, -1, 1 << 64))


@cache
def _slice_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(SLICE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row bounds in them; null rows are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    bounds = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(bounds: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    out, at, n = [], 0, len(bounds) - 1
    while at < n:
        to = max(int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1, at + 1)
        out.append((at, min(to, n)))
        at = to
    return out


def word_spans(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends`` of all words in bytes, and the word bounds of each row."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    here, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(here & (~before | cut))
    ends = np.flatnonzero(before & (~here | cut))
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each span; the spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    at, longest = 0, SLICE
    up, down = _slice_powers()
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + SLICE, "right")), at + 1)
        low, high = int(starts[at]), int(ends[to - 1])
        if high - low > longest:
            longest = high - low
            up, down = powers(longest)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[: high - low], out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = to
    return mix(out)


def row_words(data, bounds, is_word, values) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows and the word bounds of each row."""
    starts, ends, rows = word_spans(data, bounds, is_word)
    return span_hashes(data, starts, ends, values), rows


def shingles(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word shingles in row order, and the row of each.

    A row of fewer words, but not none, has its whole sequence as its one shingle.
    """
    count = np.diff(rows)
    kept = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), kept)
    first = np.arange(len(row)) + np.repeat(rows[:-1] - (np.cumsum(kept) - kept), kept)
    # sums of n neighbours at every word, also across rows; those that are a row's are taken after that
    total, part = np.zeros(len(words), np.uint64), np.empty(len(words), np.uint64)
    factor, factors = 0xE7037ED1A0B428DB, []
    for j in range(min(n, len(words))):
        total[: len(words) - j] += np.multiply(words[j:], np.uint64(factor), out=part[: len(words) - j])
        factors.append(np.uint64(factor))
        factor = factor * 0x8EBC6AF09C88C6E3 & (1 << 64) - 1 | 1
    total = total[first]
    length = np.minimum(count, n)
    for size in range(1, n):  # rows with fewer words: their own sums
        of = np.flatnonzero(length == size)
        if len(of):
            place = np.cumsum(kept)[of] - 1
            total[place] = sum(words[rows[of] + j] * factors[j] for j in range(size))
    total += np.repeat(length, kept).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return mix(total), row


def distinct(tokens: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's tokens sorted and once, and the bounds of each row. ``row`` is ascending."""
    order = np.argsort(tokens)
    at = row[order]
    order = order[np.argsort(at.astype(np.uint16) if n_rows < 65536 else at, kind="stable")]
    tokens, row = tokens[order], row[order]
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
    tokens, row = tokens[fresh], row[fresh]
    return tokens, np.searchsorted(row, np.arange(n_rows + 1))


def once(tokens: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's tokens once, where they first occur, and the bounds of each row. ``row`` is ascending.

    Cheaper than ``distinct`` where few tokens repeat: a sum of token and row is sorted alone, and only tokens whose sum
    occurs again are looked at. Tokens are hashes of 64 bits, so different ones share a sum about as rarely as a hash.
    """
    both = tokens + row.astype(np.uint64) * np.uint64(BASE)
    order = np.sort(both)
    again = order[1:][order[1:] == order[:-1]]
    if len(again):
        high = np.zeros(1 << 16, bool)
        high[again >> np.uint64(48)] = True
        at = np.flatnonzero(high[both >> np.uint64(48)])
        place = np.minimum(np.searchsorted(again, both[at]), len(again) - 1)
        at = at[again[place] == both[at]]
        at = at[np.argsort(both[at], kind="stable")]
        late = np.zeros(len(at), bool)
        late[1:] = both[at[1:]] == both[at[:-1]]
        keep = np.ones(len(tokens), bool)
        keep[at[late]] = False
        tokens, row = tokens[keep], row[keep]
    bounds = np.zeros(n_rows + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=n_rows), out=bounds[1:])
    return tokens, bounds


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by row, modulo 2^64 for unsigned numbers."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[bounds[1:]] - total[bounds[:-1]]


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(values.view(np.int64))
