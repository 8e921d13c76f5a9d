"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

The encoding of every prefix of a word ends in one token, and that token is the only one that both ends there
and is compatible with the last token of the prefix before it. So one pass of an automaton over the word
fills a table of last tokens, and the ids are read off backwards. Two neighbours are compatible if no merge
across their border would have come before the merges inside them.

Words are cut where no merge can reach: before a run of spaces and around characters without a piece. Equal
words of a task are encoded once; the table of words is started anew when it is full.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from types import SimpleNamespace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embgauge.llm import words

SPACE = "▁"
#: Bytes of text that one numpy step works on; words kept at a time; pairs whose compatibility is kept.
BLOCK, MOST_WORDS, MOST_PAIRS = 2 << 20, 1 << 20, 1 << 19
NORMAL, BYTE = 1, 6
SHIFT = 21


def _fields(raw: bytes):
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


def read_model(path: str) -> SimpleNamespace:
    """What encoding needs of a model file, as plain tables.

    The model must be BPE with byte fallback, an identity normaliser that keeps white space and puts a space
    in front, and no piece with a space after another character.
    """
    with open(path, "rb") as file:
        raw = file.read()
    pieces, kinds, scores, trainer, normaliser = [], [], [], {}, {}
    for field, value in _fields(raw):
        if field == 1:
            entry = dict(_fields(value))
            pieces.append(entry[1].decode())
            scores.append(struct.unpack("<f", entry.get(2, b"\0\0\0\0"))[0])
            kinds.append(entry.get(3, NORMAL))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normaliser = dict(_fields(value))
    normal = [i for i, k in enumerate(kinds) if k == NORMAL]
    plain = (normaliser.get(1) == b"identity" or not normaliser.get(2)) and normaliser.get(3, 1) and not normaliser.get(4, 1)
    if trainer.get(3) != 2 or not trainer.get(35) or not plain or any(SPACE in pieces[i].lstrip(SPACE) for i in normal):
        raise ValueError(f"{path} is not a BPE model with byte fallback and plain normalisation")
    of = {pieces[i]: i for i in normal}
    order = sorted((i for i in normal if len(pieces[i]) > 1), key=lambda i: -scores[i])
    rank = dict.fromkeys(normal, -1) | {t: r for r, t in enumerate(order)}
    pairs, halves = {}, {}
    for token in order:
        text = pieces[token]
        for k in range(1, len(text)):
            a, b = of.get(text[:k]), of.get(text[k:])
            if a is not None and b is not None:
                pairs[a << SHIFT | b] = token
    for token in order:
        found = _merged([of[c] for c in pieces[token]] if all(c in of for c in pieces[token]) else [], pairs, rank)
        if found and found[0] == [token]:
            halves[token] = found[1]
    octets = [0] * 256
    for i, kind in enumerate(kinds):
        if kind == BYTE:
            octets[int(pieces[i][1:-1], 16)] = i
    spelled = [
        bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k == NORMAL else b""
        for p, k in zip(pieces, kinds)
    ]
    usable = {pieces[i]: i for i in normal if len(pieces[i]) == 1 or i in halves}
    end = trainer.get(42, 2)
    return SimpleNamespace(usable=usable, rank=rank, pairs=pairs, halves=halves, octets=octets, spelled=spelled, end=end)


def _merged(tokens: list, pairs: dict, rank: dict):
    """Plain BPE of a short sequence: the tokens left, and the two that the last merge joined."""
    last = None
    while len(tokens) > 1:
        best = min((rank[pairs[k]], i) for i in range(len(tokens) - 1) if (k := tokens[i] << SHIFT | tokens[i + 1]) in pairs) if any(
            tokens[i] << SHIFT | tokens[i + 1] in pairs for i in range(len(tokens) - 1)
        ) else None
        if best is None:
            break
        i = best[1]
        last = tokens[i], tokens[i + 1]
        tokens = [*tokens[:i], pairs[last[0] << SHIFT | last[1]], *tokens[i + 2 :]]
    return tokens, last


class Encoder:
    """Encodes words of one task; keeps what it has found, up to fixed numbers of entries."""

    def __init__(self, model: SimpleNamespace):
        self.model = model
        self.automaton = ahocorasick.Automaton()
        for piece, token in model.usable.items():
            self.automaton.add_word(piece, (len(piece), token))
        self.automaton.make_automaton()
        self.size = {token: len(piece) for piece, token in model.usable.items()}
        self.fits: dict[int, bool] = {}
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(p) for p in model.usable if len(p) == 1]] = True
        self.values = words.mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(words.BASE))
        self.forget()

    def forget(self):
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.ends = array("i"), array("q", [0])

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` next to ``b``: undo the latest merge on either side of the border, step by step.

        A merge of the two that face each other would have come first if its rank is below that of the merge
        that was undone before; of equal ranks the left one comes first.
        """
        pairs, rank, halves = self.model.pairs, self.model.rank, self.model.halves
        limit = len(rank)
        while True:
            joined = pairs.get(a << SHIFT | b)
            if joined is not None and rank[joined] < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit, a = rank[a], halves[a][1]
            else:
                limit, b = rank[b] + 1, halves[b][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word whose characters all have pieces."""
        last = [0] * (len(word) + 1)
        done, fits = -1, self.fits
        for end, (size, token) in self.automaton.iter(word):
            if end == done:
                continue
            start = end + 1 - size
            if start:
                key = last[start] << SHIFT | token
                good = fits.get(key)
                if good is None:
                    if len(fits) >= MOST_PAIRS:
                        fits.clear()
                    good = fits[key] = self.compatible(last[start], token)
                if not good:
                    continue
            last[end + 1] = token
            done = end
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= self.size[last[at]]
        ids.reverse()
        return ids

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's with the end id, and the bounds of each text."""
        block = "".join([SPACE + t if t else "" for t in texts]).replace(" ", SPACE)
        length = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        points = np.frombuffer(block.encode("utf-32-le"), "<u4")
        first = np.cumsum(length) - length
        cut = np.zeros(len(points) + 1, bool)
        cut[first] = True
        strange = ~self.known[points]
        space = points == ord(SPACE)
        cut[:-1] |= strange | space & ~np.append(False, space[:-1])
        cut[1:-1] |= strange[:-1]
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        hashes = words.span_hashes(points, starts, ends, self.values)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(unique) > MOST_WORDS:
            self.forget()
        place = np.searchsorted(self.hashes, unique)
        new = np.ones(len(unique), bool)
        inner = place < len(self.hashes)
        new[inner] = self.hashes[place[inner]] != unique[inner]
        fresh = np.flatnonzero(new)
        base = len(self.ends) - 1
        for i in where[fresh].tolist():
            s, e = int(starts[i]), int(ends[i])
            if strange[s]:
                self.flat.extend([self.model.octets[b] for b in block[s].encode()])
            else:
                self.flat.extend(self.encode_word(block[s:e]))
            self.ends.append(len(self.flat))
        self.places = np.insert(self.places, place[fresh], base + np.arange(len(fresh)))
        self.hashes = np.insert(self.hashes, place[fresh], unique[fresh])
        word = self.places[np.searchsorted(self.hashes, unique)][inverse]
        bounds = np.frombuffer(self.ends, np.int64)
        count = bounds[word + 1] - bounds[word]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = np.frombuffer(self.flat, np.int32)[
            np.repeat(bounds[word] - total[:-1], count) + np.arange(total[-1])
        ] if len(word) else np.zeros(0, np.int32)
        # the end id after each text
        held = total[np.searchsorted(starts, np.append(first, len(points)))]
        held[-1] = total[-1]
        out = np.insert(ids, held[1:], self.model.end)
        del bounds
        return out, held + np.arange(len(texts) + 1)


def decoded(model: SimpleNamespace, ids: list[int]) -> bytes:
    """The text of the ids in UTF-8: spaces for space marks, bytes for byte pieces, without the space put in front."""
    text = b"".join(map(model.spelled.__getitem__, ids))
    return text[1:].decode("utf-8", "replace").encode() if text[:1] == b" " else text.decode("utf-8", "replace").encode()


def _encoder(sent) -> Encoder:
    return Encoder(sent.value)


def _texts(batch: pa.RecordBatch):
    """Slices of a batch of about BLOCK bytes, with their texts."""
    _, bounds = words.text_bytes(batch.column("text"))
    for low, high in words.blocks(bounds, BLOCK):
        part = batch.slice(low, high - low)
        yield part, part.column("text").to_pylist()


def _ids(sent):
    def run(batches):
        encoder = _encoder(sent)
        for batch in batches:
            for part, texts in _texts(batch):
                ids, bounds = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))],
                    names=["id", "ids"],
                )

    return run


def _plain(sent):
    def run(batches):
        model = sent.value
        for batch in batches:
            texts = [None if ids is None else decoded(model, ids).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return run


KINDS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def _digests(sent, columns):
    def run(batches):
        encoder = _encoder(sent)
        decimal = [str(i).encode() for i in range(len(encoder.model.spelled))]
        for batch in batches:
            for part, texts in _texts(batch):
                ids, bounds = encoder.encode(texts)
                a, b = [], []
                for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = ids[low:high].tolist()
                    if "ids_sha256" in columns:
                        a.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, own))).hexdigest())
                    b.append(hashlib.sha256(decoded(encoder.model, own)).hexdigest())
                made = {
                    "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                    "n_tokens": pa.array(np.diff(bounds).astype(np.int64)),
                    "ids_sha256": pa.array(a, pa.string()),
                    "decoded_sha256": pa.array(b, pa.string()),
                }
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *[made[c] for c in columns]], names=["id", *columns]
                )

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)`` for every row of ``docs``: the ids of its whole text and the end id, no begin id, no sampling.

    Null and empty texts have the end id only. Repeated rows give a result row each, null ids stay null. Of
    other columns none is read. The model file is read by the driver and sent; its size is the vocabulary's.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    rows = _rows(docs, id_col, text_col)
    return rows.mapInArrow(_ids(sent), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` for every row of ``encoded``; null for null ids, empty for none. Control ids have no text."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_plain(sent), f"id {rows.schema['id'].dataType.simpleString()}, text string")


def round_trip(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    columns=("n_tokens", "ids_sha256", "decoded_sha256"),
) -> DataFrame:
    """``id`` and ``columns``, any of ``ids, n_tokens, ids_sha256, decoded_sha256``, for every row of ``docs``.

    ``ids`` are those of ``encode``, counted by ``n_tokens``; ``ids_sha256`` is over the decimal ids with single
    spaces between them, ``decoded_sha256`` over what ``decode`` makes of them. Special cases are those of ``encode``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    rows = _rows(docs, id_col, text_col)
    schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *[f"{c} {KINDS[c]}" for c in columns]])
    return rows.mapInArrow(_digests(sent, columns), schema)
