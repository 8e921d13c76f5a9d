"""Two tokenizers' tokens of the same texts, aligned by bytes, and how often ids are linked in the corpus.

Both libraries say which characters a token covers (character offsets of ``tokenizers``, and of ``sentencepiece`` the
spans of its result; its immutable proto is called ``offset_mapping`` in the installed version). Those are coarse cuts:
a token that covers whole characters ends where they say. Tokens inside a character, such as byte-fallback pieces
and halves of multibyte characters, have no cut of their own there; they end where their decoded bytes do. Two tokens
are linked if their byte ranges overlap, so every stretch between neighbouring cuts of either side is one link.

Chunks of text are aligned once (``chunks``), and texts once: what each row has of each id pair is written to a table,
with the pair counts of its task. Spark adds these up, and a pass over that table looks up what its pairs count.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from embgauge.llm import words
from embgauge.llm.chunks import BLOCK, ByteBpe, Ragged, Table, groups, kept, with_space
from embgauge.llm.shared import discard, stored

#: A pair's key is the first id times 2^32 and the second id.
SHIFT = 32
#: Pairs whose counts are sent to all executors (17 bytes each); beyond it documents meet counts in a join.
SENT_PAIRS = 1 << 22
#: Put before chunks that are encoded, so that they stand inside a text; its tokens are left out.
LEAD = " ."
SPACE = "▁"


class PieceBpe:
    """A BPE model with byte fallback of the ``sentencepiece`` library, from its file's bytes."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(raw)
        self.spelled = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.spelled.append(bytes([int(piece[3:5], 16)]))
                continue
            usual = not (self.model.is_control(i) or self.model.is_unknown(i))
            if usual and (SPACE in piece.lstrip(SPACE) or any(c in " \t\n" for c in piece)):
                raise ValueError("a piece has white space after another character")
            self.spelled.append(piece.replace(SPACE, " ").encode())
        self.size = np.array([len(s) for s in self.spelled], np.int64)
        if b"".join(self.spelled[i] for i in self.model.encode(" \n  x ")) != b"  \n  x ":
            raise ValueError("the model does not keep white space behind the space that it puts in front")

    def encode(self, text: str):
        return self.model.encode(text, return_type="offset_mapping", num_threads=1)


def _ends(ids: np.ndarray, offsets: np.ndarray, size: np.ndarray, byte_at: np.ndarray) -> np.ndarray:
    """Where tokens end in bytes: the library's cut if a token covers whole characters, else by its decoded bytes."""
    low, high, n = byte_at[offsets[:, 0]], byte_at[offsets[:, 1]], size[ids]
    return np.where(high - low == n, high, np.cumsum(n))


class Aligner:
    """Ids, links and groups of chunks under both tokenizers."""

    def __init__(self, a_raw: bytes, b_raw: bytes):
        self.a, self.b = ByteBpe(a_raw, plain=True), PieceBpe(b_raw)
        decimal = [str(i) for i in range(max(len(self.a.size), len(self.b.size)))]
        self.texts = {mark: [d + mark for d in decimal] for mark in ",|;"}
        self.forget()

    def forget(self):
        #: the keys of all pairs met, and of each chunk the numbers of its links' pairs
        self.keys, self.numbers = np.zeros(0, np.int64), {}
        self.links = Ragged(np.int32)
        #: per chunk: tokens of both sides, groups, and whether its bytes are not those of the text
        self.facts = np.zeros((0, 4), np.int64)
        self.groups: list[str] = []
        self.table = Table(self._learn, self._only)

    def _only(self, codes):
        self.links.only(codes)
        self.facts = self.facts[codes]
        self.groups = [self.groups[i] for i in codes.tolist()]

    def _learn(self, chunks: list[str], sizes: np.ndarray) -> None:
        learned = []
        for low, high in groups(chunks, sizes):
            found = self._aligned(chunks[low:high], sizes[low:high])
            if found is None and high > low + 1:
                learned += [self._aligned(chunks[i : i + 1], sizes[i : i + 1]) for i in range(low, high)]
            else:
                learned.append(found)
        none = np.zeros(1, np.int64), np.zeros(0, np.int64), np.array([[0, 0, 0, 1]]), [""]
        counts, links, facts, strings = zip(*[none if part is None else part for part in learned])
        pairs, inverse = np.unique(np.concatenate(links), return_inverse=True)
        number = np.array([self.numbers.setdefault(k, len(self.numbers)) for k in pairs.tolist()], np.int32)
        self.keys = np.append(self.keys, pairs[number >= len(self.keys)])
        self.links.add(np.concatenate(counts), number[inverse])
        self.facts = np.concatenate([self.facts, *facts])
        for own in strings:
            self.groups.extend(own)

    def _sides(self, chunks: list[str]):
        """Ids and byte ends of both sides, or None if their bytes are not the chunks'."""
        text = LEAD + "".join(chunks)
        raw = text.encode()
        if text.isascii():
            byte_at = np.arange(len(text) + 1)
        else:
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            byte_at = np.concatenate([[0], np.cumsum(wide)])
        first = self.a.encode(text)
        second = self.b.encode(text[1:])
        out = []
        for model, ids, offsets, shift in (
            (self.a, first.ids, first.offsets, 0),
            (self.b, second["ids"], second["offsets"], 1),
        ):
            if b"".join(map(model.spelled.__getitem__, ids)) != raw:
                return None
            ids, offsets = np.array(ids, np.int64), np.array(offsets, np.int64) + shift
            ends = _ends(ids, offsets, model.size, byte_at) - len(LEAD)
            inside = ends > 0
            if (np.diff(ends) <= 0).any() or (ends == 0).sum() != 1:
                raise ValueError("token offsets and decoded bytes do not agree")
            out.append((ids[inside], ends[inside]))
        return out

    def _aligned(self, chunks: list[str], sizes: np.ndarray):
        sides = self._sides(chunks)
        if sides is None:
            return None
        (a, a_ends), (b, b_ends) = sides
        borders = np.cumsum(sizes)
        every = np.sort(np.concatenate([a_ends, b_ends]))
        again = every[1:] == every[:-1]
        cuts, both = every[np.append(True, ~again)], every[1:][again]
        links = a[np.searchsorted(a_ends, cuts)] << SHIFT | b[np.searchsorted(b_ends, cuts)]
        count = lambda ends: np.diff(np.searchsorted(ends, borders, "right"), prepend=0)
        facts = np.stack([count(a_ends), count(b_ends), count(both), np.zeros(len(chunks), np.int64)], 1)
        # tokens of both sides by group, the first side's first
        group = np.concatenate([np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)])
        side = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        order = np.argsort(group * 2 + side, kind="stable")
        key = (group * 2 + side)[order]
        last = np.append(key[1:] != key[:-1], True)
        mark = np.where(last, 1 + (key & 1), 0)
        comma, bar, semicolon = (self.texts[m] for m in ",|;")
        ids = np.concatenate([a, b])[order].tolist()
        spelt = [(comma, bar, semicolon)[m][i] for m, i in zip(mark.tolist(), ids)]
        upto = np.cumsum(facts[:, 0] + facts[:, 1]).tolist()
        strings = ["".join(spelt[s:e]) for s, e in zip([0, *upto[:-1]], upto)]
        return count(cuts), links, facts, strings

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the chunks of each text with a space in front, and bounds; a text that has no tokens has none."""
        codes, bounds = self.table(*with_space(column))
        sizes = np.diff(bounds)
        bad = np.concatenate([[0], np.cumsum(self.facts[codes, 3])])
        good = bad[bounds[1:]] == bad[bounds[:-1]]
        return codes[np.repeat(good, sizes)], np.concatenate([[0], np.cumsum(np.where(good, sizes, 0))])


def _aligner(sent) -> Aligner:
    a, b = sent.value
    return kept("token_align", a + b"\0" + b, lambda: Aligner(a, b))


def _slices(batch: pa.RecordBatch):
    _, bounds = words.text_bytes(batch.column("text"))
    for low, high in words.blocks(bounds, BLOCK):
        yield batch.slice(low, high - low)


def _send(docs, a_path, b_path):
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as file:
            files.append(file.read())
    return docs.sparkSession.sparkContext.broadcast(tuple(files))


FACTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
PAIRS = "array<struct<pair:bigint,times:bigint>>"
NAMES = ["id", *[c.split()[0] for c in FACTS.split(", ")], "pairs", "whole"]


def _lists(bounds, keys, times) -> pa.Array:
    rows = pa.StructArray.from_arrays([pa.array(keys), pa.array(times)], names=["pair", "times"])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows)


def _aligned(sent, id_type):
    """``NAMES`` of each row: facts, and how often it has each pair; last the pairs of the ``whole`` task."""

    def run(batches):
        align, total = _aligner(sent), np.zeros(0, np.int64)
        for big in batches:
            for part in _slices(big):
                codes, bounds = align(part.column("text"))
                links, sizes = align.links.at(codes)
                text = np.repeat(np.repeat(np.arange(part.num_rows), np.diff(bounds)), sizes)
                n = len(align.keys)
                found, times = np.unique(text * max(n, 1) + links, return_counts=True)
                text, pair = np.divmod(found, max(n, 1))
                total = np.append(total, np.zeros(n - len(total), np.int64)) + np.bincount(pair, times, n).astype(np.int64)
                pairs = _lists(np.searchsorted(text, np.arange(part.num_rows + 1)), align.keys[pair], times)
                made = [part.column("id").cast(id_type), *_facts(align, codes, bounds), pairs]
                yield pa.RecordBatch.from_arrays([*made, pa.array(np.zeros(part.num_rows, bool))], names=NAMES)
        held = np.flatnonzero(total)
        void = [pa.nulls(1, t) for t in (id_type, *[pa.int64()] * 4, pa.string())]
        pairs = _lists(np.array([0, len(held)]), align.keys[held], total[held])
        yield pa.RecordBatch.from_arrays([*void, pairs, pa.array([True])], names=NAMES)

    return run


def _described(rows: DataFrame, sent) -> DataFrame:
    kind = rows.schema["id"].dataType
    schema = f"id {kind.simpleString()}, {FACTS}, pairs {PAIRS}, whole boolean"
    return stored(rows.mapInArrow(_aligned(sent, to_arrow_type(kind)), schema))


def _counts(described: DataFrame) -> DataFrame:
    pairs = described.where("whole").select(F.explode("pairs").alias("p")).select("p.*")
    return pairs.groupBy("pair").agg(F.sum("times").alias("n"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """``(a, b, n)``: how many links of the corpus hold the ids ``a`` and ``b`` linked."""
    rows = docs.select(F.lit(0).alias("id"), F.col(text_col).cast("string").alias("text"))
    a, b = F.shiftright("pair", SHIFT).alias("a"), F.expr(f"pair & {(1 << SHIFT) - 1}L").alias("b")
    return _counts(_described(rows, _send(docs, a_path, b_path))).select(a, b, "n")


def _sums(sent):
    """Each row with what the counts of its pairs are."""

    def run(batches):
        with pa.ipc.open_stream(io.BytesIO(sent.value)) as stream:
            held = stream.read_all()
        keys, n, best = (held[c].to_numpy() for c in ("pair", "n", "best"))
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times = lists.flatten().flatten()
            bounds, times = lists.offsets.to_numpy(), times.to_numpy()
            at = np.searchsorted(keys, pairs.to_numpy())
            made = []
            for x in (best, n):
                total = np.concatenate([[0], np.cumsum(x[at] * times, dtype=np.int64)])
                made.append(pa.array(np.diff(total[bounds - bounds[0]])))
            rest = [batch.column(c) for c in NAMES[:-2]]
            yield pa.RecordBatch.from_arrays([*rest, *made], names=[*NAMES[:-2], "n_best", "count_sum"])

    return run


def _facts(align, codes, bounds) -> list:
    facts = align.facts[codes]
    links = (align.links.bounds[1:] - align.links.bounds[:-1])[codes]
    sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (*facts[:, :3].T, links)]
    strings, spelt, codes = align.groups, [], codes.tolist()
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        joined = "".join(map(strings.__getitem__, codes[low:high]))[:-1]
        spelt.append(hashlib.sha256(joined.encode()).hexdigest() if high > low else "")
    return [*map(pa.array, sums), pa.array(spelt, pa.string())]


def align(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sent_pairs: int = SENT_PAIRS,
) -> DataFrame:
    """For every row of ``docs``: ``id``, ``FACTS``, ``groups_sha256``, ``n_best`` and ``count_sum``.

    Side a encodes a space and the text with the byte-level BPE file ``a_path``, side b the text with the piece model
    ``b_path``, which puts the space itself. ``n_groups`` counts the stretches between bytes where tokens of both sides
    end, ``n_links`` the overlapping pairs of tokens. A link's count is how many links of all rows hold its two ids;
    ``count_sum`` adds them up, ``n_best`` counts the links that no other first id of their second id beats.

    A text that is null or empty, or whose tokens of either side do not spell it, has zeros and the digest ''.
    Repeated rows give a result row each and count each, null ids stay null, an empty table gives none; other columns
    are not read. At most ``sent_pairs`` counts are sent to the executors; if the corpus has more id pairs, the rows'
    distinct pairs meet the counts in a join. Files are read by the driver and sent; their size is the vocabularies'.
    """
    spark, sent = docs.sparkSession, _send(docs, a_path, b_path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    described = _described(rows, sent)
    counted = stored(_counts(described))
    token = F.expr(f"pair & {(1 << SHIFT) - 1}L")
    most = counted.groupBy(token.alias("b")).agg(F.max("n").alias("most"))
    counts = counted.withColumn("b", token).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    own = described.where("not whole").drop("whole")
    if counted.count() <= sent_pairs:
        table = counts.toArrow().sort_by("pair").combine_chunks()
        held = io.BytesIO()
        with pa.ipc.new_stream(held, table.schema) as stream:
            stream.write_table(table)
        discard(counted)
        known = spark.sparkContext.broadcast(held.getvalue())
        kind = rows.schema["id"].dataType.simpleString()
        return own.mapInArrow(_sums(known), f"id {kind}, {FACTS}, n_best long, count_sum long")
    # texts with equal groups have equal pairs, and meet their sums by that digest
    links = own.dropDuplicates(["groups_sha256"]).select("groups_sha256", F.explode("pairs").alias("p"))
    links = links.select("groups_sha256", "p.*")
    sums = links.join(counts, "pair").groupBy("groups_sha256").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    return own.drop("pairs").join(sums, "groups_sha256", "left").fillna(0, ["n_best", "count_sum"])
