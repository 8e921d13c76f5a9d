"""Hierarchical multi-length packing of tokenised documents, without padding.

Documents go to tiers of context sizes, powers of two up to the longest window. Whole windows are cut off a long
document; what is left of it, or a shorter document, belongs to the smallest tier it fits in. Tiers are packed from
the longest on: a piece opens a window, and the gap behind it takes the longest piece of it or a shorter tier that
fits, again and again; a gap that no piece fits takes the head of one, the rest goes back to its tier. So every
window is full and a window has one cut at most. What is left at the end of a task becomes windows of smaller powers
of two. Full windows of a tier are put into step groups of equal token counts, those of like attention cost (squares
of the pieces' lengths) together, so that the workers of a training step finish together.

Each task packs the rows of its own partition, so no token moves between executors, and it holds one block of texts
and the pieces that wait for a window.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from embgauge.llm import words
from embgauge.llm.chunks import BLOCK, ByteBpe, Ragged, Table, groups, kept

#: Tokens of a window, of the shortest tier, and of a step group.
WINDOW, SHORTEST, STEP = 2048, 256, 32768
#: Tokens that may wait for a window between two blocks of texts.
WAITING = 1 << 20


class Ids:
    """Token ids of texts, by chunks."""

    def __init__(self, raw: bytes):
        self.bpe, self.ids = ByteBpe(raw), Ragged(np.uint32)
        self.table = Table(self._learn, self.ids.only)

    def _learn(self, chunks: list[str], sizes: np.ndarray) -> None:
        cut = groups(chunks, sizes)
        ids, held = self.bpe.ids(["".join(chunks[low:high]) for low, high in cut])
        # the tokens of a chunk end where its bytes do, group by group
        bounds, ends = np.append([low for low, _ in cut], len(chunks)), np.cumsum(held)
        own = np.repeat(np.arange(len(cut)), np.diff(bounds))
        spelled, size = np.append(0, np.cumsum(self.bpe.size[ids])), np.append(0, np.cumsum(sizes))
        place = spelled[(ends - held)[own]] + size[1:] - size[bounds[own]]
        upto = np.minimum(np.searchsorted(spelled[1:], place, "right"), ends[own])
        self.ids.add(np.diff(upto, prepend=0), ids)

    def __call__(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, each text's followed by ``end``, and the bounds of each text."""
        codes, bounds = self.table(*words.text_bytes(column))
        ids, counts = self.ids.at(codes)
        upto = np.concatenate([[0], np.cumsum(counts)])[bounds]
        return np.insert(ids, upto[1:], end).astype(np.uint32), upto + np.arange(len(upto))


class Waiting:
    """Pieces by length; the longest of at most a given length, or the shortest above it, in a few operations."""

    def __init__(self):
        self.by_length, self.lengths, self.total = defaultdict(list), 0, 0

    def put(self, piece) -> None:
        n = len(piece[3])
        self.by_length[n].append(piece)
        self.lengths |= 1 << n
        self.total += n

    def _take(self, n: int):
        own = self.by_length[n]
        piece = own.pop()
        if not own:
            self.lengths ^= 1 << n
        self.total -= n
        return piece

    def longest(self, most: int):
        below = self.lengths & (1 << most + 1) - 1
        return self._take(below.bit_length() - 1) if below else None

    def shortest(self):
        return self._take((self.lengths & -self.lengths).bit_length() - 1) if self.lengths else None


class Packer:
    """Windows out of pieces ``(document, its tokens, start, ids)``; ``window`` is told of each full one."""

    def __init__(self, window, longest: int, shortest: int):
        self.window, self.longest, self.waiting = window, longest, Waiting()
        self.tiers = []
        while longest >= shortest:
            self.tiers.append(longest)
            longest //= 2

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.longest * self.longest
        for at in range(0, whole, self.longest):
            self.window(self.longest, [(doc, len(ids), at, ids[at : at + self.longest])])
        if whole < len(ids):
            self.waiting.put((doc, len(ids), whole, ids[whole:]))

    def _fill(self, size: int) -> None:
        """One window of ``size`` tokens; at least so many wait."""
        held, gap = [], size
        while gap:
            piece = self.waiting.longest(gap)
            if piece is None:
                doc, n, start, ids = self.waiting.shortest()
                self.waiting.put((doc, n, start + gap, ids[gap:]))
                piece = doc, n, start, ids[:gap]
            held.append(piece)
            gap -= len(piece[3])
        self.window(size, held)

    def pack(self, keep: int) -> None:
        """Fill windows, tier by tier, until at most ``keep`` tokens wait."""
        for size in self.tiers:
            opens = (1 << size + 1) - (1 << size // 2 + 1)  # lengths over half the window
            while self.waiting.total > max(keep, size - 1) and self.waiting.lengths & opens:
                self._fill(size)
        while self.waiting.total > max(keep, self.tiers[-1] - 1):
            self._fill(self.tiers[-1])

    def close(self) -> None:
        """Everything that waits goes into windows: the tiers', then one of each smaller power of two that is needed."""
        self.pack(0)
        while self.waiting.total:
            self._fill(1 << self.waiting.total.bit_length() - 1)


class Steps:
    """Step groups of full windows: equal tokens, like cost. ``emit`` gets the windows of a group."""

    def __init__(self, emit, tokens: int):
        self.emit, self.tokens, self.held = emit, tokens, defaultdict(list)

    def add(self, size: int, pieces: list) -> None:
        cost = sum(len(p[3]) ** 2 for p in pieces)
        self.held[size].append((cost, len(self.held[size]), pieces))

    def flush(self, last: bool) -> None:
        for size, own in self.held.items():
            own.sort()
            n = max(self.tokens // size, 1)
            upto = len(own) if last else len(own) // n * n
            for at in range(0, upto, n):
                self.emit(size, [pieces for _, _, pieces in own[at : at + n]])
            self.held[size] = [(cost, i, pieces) for i, (cost, _, pieces) in enumerate(own[upto:])]


COLUMNS = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens int, step_group long"
)


def _packed(sent, id_type, longest, shortest, step_tokens, end, with_ids):
    def run(batches):
        encode = kept("packing", sent.value, lambda: Ids(sent.value))
        # partition numbers make ids unique: no task numbers two thousand million windows
        sequence = group = TaskContext.get().partitionId() << 31
        rows: list[tuple] = []

        def emit(size, windows):
            nonlocal sequence, group
            for pieces in windows:
                at = 0
                for doc, n, start, ids in pieces:
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, at, size, group, ids))
                    at += len(ids)
                sequence += 1
            group += 1

        def batch():
            columns = list(zip(*rows)) if rows else [[]] * 10
            made = [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:7]]]
            made += [pa.array(columns[7], pa.int32()), pa.array(columns[8], pa.int64())]
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            if with_ids:
                lengths = np.concatenate([[0], np.cumsum([len(x) for x in columns[9]])]).astype(np.int32)
                flat = np.concatenate(columns[9]).astype(np.int32) if rows else np.zeros(0, np.int32)
                made.append(pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names=["id", *names])

        steps = Steps(emit, step_tokens)
        packer = Packer(steps.add, longest, shortest)
        for big in batches:
            _, bounds = words.text_bytes(big.column("text"))
            for low, high in words.blocks(bounds, BLOCK):
                part = big.slice(low, high - low)
                ids, upto = encode(part.column("text"), end)
                for doc, a, b in zip(part.column("id").to_pylist(), upto[:-1].tolist(), upto[1:].tolist()):
                    packer.add(doc, ids[a:b])
                packer.pack(WAITING)
                steps.flush(False)
                yield batch()
        packer.close()
        steps.flush(True)
        yield batch()

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    shortest: int = SHORTEST,
    step_tokens: int = STEP,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """``id`` and ``COLUMNS`` for every piece of every row of ``docs``; with ``ids`` as an array on request.

    A row's tokens are those of its whole text (special tokens are not added), then ``end_id``; a null or empty text
    has the end id only. Each token lies in exactly one piece. A window (``sequence_id``) holds its pieces one after
    another from ``offset`` 0 and is full: ``sequence_tokens`` is ``window`` or a smaller power of two. Windows of a
    ``step_group`` have equal sizes and, but for the last group of each size in a task, ``step_tokens`` tokens together.
    Repeated rows are packed each by itself, null ids stay null, and an empty table has no pieces. Other columns are
    not read. Windows follow the partitions: another partitioning gives other, equally full windows.

    The tokenizer's file is read by the driver and sent; its size is the vocabulary's.
    """
    if window & (window - 1) or shortest & (shortest - 1) or not 0 < shortest <= window:
        raise ValueError("window sizes must be powers of two")
    with open(tokenizer_path, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    run = _packed(sent, to_arrow_type(kind), window, shortest, step_tokens, end_id, with_ids)
    return rows.mapInArrow(run, f"id {kind.simpleString()}, {COLUMNS}" + (", ids array<int>" if with_ids else ""))
