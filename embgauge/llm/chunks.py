"""Texts as sequences of chunks that tokenizers encode alone as they do in the text, each distinct chunk once.

A chunk is spaces, tabs and line feeds and what follows them up to the next. Byte-level BPE splits a text before white
space that follows another character, and no piece of the SentencePiece model has one of these three after another
character; so neither merges across a border of chunks. Most words of a corpus repeat: a worker keeps the tokens of
the chunks that it has met most, up to a fixed number and size, and encodes the others when they come. Equal 64-bit
hashes of their bytes make chunks equal.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from embgauge.llm import words

#: Bytes of text that one step works on; chunks and bytes of chunks that a worker keeps; bytes encoded together,
#: and characters of such strings in one call of a tokenizer.
BLOCK, MOST, MOST_BYTES, TOGETHER, AT_ONCE = 2 << 20, 3 << 19, 1 << 25, 1 << 15, 1 << 18
_VALUES = words.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(words.BASE))
_is_space = np.zeros(256, bool)
_is_space[[0x20, 0x09, 0x0A]] = True
#: Other white space, of Python or of a tokenizer, which may also end a piece; texts with it are cut at fewer places.
_ODD_BYTES = np.zeros(256, bool)
_ODD_BYTES[[0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_ODD = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CUTS = re.compile(r"(?<=\S)(?=[ \n])")


def _odd_places(data: np.ndarray) -> np.ndarray:
    found = [np.flatnonzero(_ODD_BYTES[data])]
    for lead in {c.encode()[0] for c in _ODD}:
        at = np.flatnonzero(data == lead)
        tails = [c.encode()[1:] for c in _ODD if c.encode()[0] == lead]
        at = at[at + len(tails[0]) < len(data)]
        rest = data[at[:, None] + np.arange(1, len(tails[0]) + 1)] if len(at) else np.zeros((0, len(tails[0])), np.uint8)
        hit = np.zeros(len(at), bool)
        for tail in tails:
            hit |= (rest == np.frombuffer(tail, np.uint8)).all(1)
        found.append(at[hit])
    return np.concatenate(found)


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the chunks of texts start in their bytes."""
    space = _is_space[data]
    start = np.zeros(len(data), bool)
    start[1:] = space[1:] & ~space[:-1]
    odd = np.unique(np.searchsorted(bounds, _odd_places(data), "right") - 1)
    for row in odd.tolist():
        low, high = int(bounds[row]), int(bounds[row + 1])
        text = data[low:high].tobytes().decode()
        sizes = [len(c.encode()) for c in _CUTS.split(text)]
        start[low:high] = False
        start[low + np.cumsum([0, *sizes[:-1]])] = True
    start[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return np.flatnonzero(start)


def groups(chunks: list[str], sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of neighbours that can be encoded as one string: all start with white space and end with something else."""
    out, low, size = [], 0, 0
    for i, (chunk, n) in enumerate(zip(chunks, sizes.tolist())):
        joins = chunk[0] in " \t\n" and not chunk[-1].isspace()
        if i > low and (not joins or size + n > TOGETHER):
            out.append((low, i))
            low, size = i, 0
        size += n
        if not joins:
            out.append((low, i + 1))
            low, size = i + 1, 0
    if low < len(chunks):
        out.append((low, len(chunks)))
    return out


class Ragged:
    """Rows of numbers of different lengths, in one array."""

    def __init__(self, dtype):
        self.values, self.bounds = np.zeros(0, dtype), np.zeros(1, np.int64)

    def add(self, counts: np.ndarray, values: np.ndarray) -> None:
        self.values = np.concatenate([self.values, values.astype(self.values.dtype)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])

    def at(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of ``rows`` one after another, and how many each has."""
        counts = self.bounds[rows + 1] - self.bounds[rows]
        total = np.cumsum(counts)
        places = np.repeat(self.bounds[rows] - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)
        return self.values[places], counts

    def only(self, rows: np.ndarray) -> None:
        values, counts = self.at(rows)
        self.values, self.bounds = values, np.concatenate([[0], np.cumsum(counts)])


class Table:
    """Codes of distinct chunks. ``learn(chunks, sizes)`` is told of new ones in order, ``thin(codes)`` which stay."""

    def __init__(self, learn, thin, most: int = MOST, most_bytes: int = MOST_BYTES):
        self.learn, self.thin, self.most, self.most_bytes = learn, thin, most, most_bytes
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.uses, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all chunks of the texts, and the bounds of each text. They hold until the next call."""
        if len(self.hashes) > self.most or self.sizes.sum() > self.most_bytes:
            self._thin()
        starts = cuts(data, bounds)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes = words.span_hashes(data, starts, ends, _VALUES)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, unique)
        new = np.ones(len(unique), bool)
        inner = place < len(self.hashes)
        new[inner] = self.hashes[place[inner]] != unique[inner]
        fresh = np.flatnonzero(new)
        if len(fresh):
            low, high = starts[first[fresh]], ends[first[fresh]]
            self.learn([data[s:e].tobytes().decode() for s, e in zip(low.tolist(), high.tolist())], high - low)
            codes = len(self.uses) + np.arange(len(fresh))
            self.hashes = np.insert(self.hashes, place[fresh], unique[fresh])
            self.places = np.insert(self.places, place[fresh], codes)
            self.sizes = np.append(self.sizes, high - low)
            self.uses = np.append(self.uses, np.zeros(len(fresh), np.int64))
            place = place + np.cumsum(new) - new
        code = self.places[place]
        self.uses[code] += np.bincount(inverse, minlength=len(unique))
        return code[inverse], np.searchsorted(starts, bounds)

    def _thin(self) -> None:
        order = np.argsort(-self.uses, kind="stable")[: self.most // 2]
        order = np.sort(order[np.cumsum(self.sizes[order]) <= self.most_bytes // 2])
        code = np.full(len(self.uses), -1)
        code[order] = np.arange(len(order))
        own = code[self.places]
        self.hashes, self.places = self.hashes[own >= 0], own[own >= 0]
        self.uses, self.sizes = self.uses[order] // 2, self.sizes[order]
        self.thin(order)


def with_space(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a column of texts with a space in front of each that is not null or empty."""
    data, bounds = words.text_bytes(column)
    full = bounds[:-1] < bounds[1:]
    return np.insert(data, bounds[:-1][full], 0x20), bounds + np.concatenate([[0], np.cumsum(full)])


class ByteBpe:
    """A byte-level BPE tokenizer of the ``tokenizers`` library, from its JSON file's bytes.

    ``plain`` makes the strings of special tokens ordinary text.
    """

    def __init__(self, raw: bytes, plain: bool = False):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        cuts = json.loads(raw).get("pre_tokenizer") or {}
        if cuts.get("type") != "ByteLevel" or cuts.get("add_prefix_space") or not cuts.get("use_regex", True):
            raise ValueError("not a byte-level BPE file whose texts are cut by the usual pattern")
        if json.loads(raw).get("normalizer"):
            raise ValueError("a normalizer would change bytes")
        self.tokenizer = Tokenizer.from_buffer(raw)
        self.tokenizer.encode_special_tokens = plain
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        octet = {chr(b): b for b in shown}
        octet |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.spelled = [b""] * (max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.spelled[i] = token.encode() if token in special else bytes([octet[c] for c in token])
        self.size = np.array([len(s) for s in self.spelled], np.int64)

    def encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has; no offsets are made, and a call has a bounded size."""
        sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found, counts = [np.zeros(0, np.int64)], []
        for low, high in words.blocks(sizes, AT_ONCE):
            made = [e.ids for e in self.tokenizer.encode_batch_fast(texts[low:high], add_special_tokens=False)]
            counts += map(len, made)
            found.append(np.fromiter(chain.from_iterable(made), np.int64))
        return np.concatenate(found), np.array(counts, np.int64)


_kept: dict = {}


def kept(kind, raw: bytes, make):
    """``make()``, once for each worker, ``kind`` and file: what tasks of a worker have learned stays."""
    key = kind, hashlib.sha256(raw).digest()
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]
