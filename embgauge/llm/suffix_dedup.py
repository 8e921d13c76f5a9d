"""Removal of repeated byte strings by a collection Burrows-Wheeler transform.

Windows of ``width`` bytes meet by their minimizer: the smallest hash of the short grams inside a window.
Neighbouring windows with one minimizer form a piece. Copies of a piece enter once, held by the first; all
others go whole. A minimizer that occurs once in the corpus cannot lie in a repeated window. Pieces that share
a minimizer but differ are cut into shorter strings whose windows share a core, nearly as long as a window;
strings whose core occurs twice are put into collections, whose transform and common prefixes are built column
by column. Windows that a collection holds twice are rows with a common prefix of ``width`` bytes or more.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from embgauge.llm import words
from embgauge.llm.collection_bwt import repeats
from embgauge.llm.shared import id_filter, may_hold, stored

#: Bytes in a gram; bytes of text that one numpy step works on; strings in a collection, about.
GRAM, BLOCK, STRINGS = 24, 1 << 20, 4096
LOW = np.uint64((1 << 22) - 1)

#: Windows that share a core, at most.
SLIDE = 11

PIECES = "gram long, piece long, id long, version long, place long, gone boolean"
CORES = "core long, id long, version long, at int, length int"
STRING = "core long, part int, id long, version long, at int, string binary"
SPAN = "id long, version long, start int, stop int"
TEXTS = "id long, text string, version long"


def _totals(data: np.ndarray, values: np.ndarray, up: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    return total


def _least(keys: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` neighbours, from running minima within fixed stretches."""
    n = len(keys)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    grid = full.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def cut_pieces(data: np.ndarray, bounds: np.ndarray, width: int, values, up, down):
    """``(doc, at, length, mark, gram, piece)`` of all pieces of some documents.

    ``mark`` is the place of the minimizer in the piece; ``gram`` and ``piece`` are hashes.
    """
    w = width - GRAM + 1
    none = [np.zeros(0, t) for t in (*[np.int64] * 4, np.uint64, np.uint64)]
    if len(data) < width:
        return none
    total = _totals(data, values, up)
    grams = words.mix((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
    key = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    least = (_least(key, w) & LOW).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.maximum(np.diff(bounds) - width + 1, 0))
    held = np.maximum(np.diff(bounds) - width + 1, 0)
    first = np.cumsum(held) - held
    start = np.arange(len(doc)) - first[doc] + bounds[:-1][doc]
    if not len(start):
        return none
    mark = least[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(fresh)
    low = start[head]
    high = start[np.append(head[1:], len(start)) - 1] + width
    mark = mark[head]
    content = (total[high] - total[low]) * down[low]
    inside = (high - low).astype(np.uint64) << np.uint64(32) | (mark - low).astype(np.uint64)
    piece = words.mix(content ^ words.mix(inside))
    return doc[head], low - bounds[:-1][doc[head]], high - low, mark - low, grams[mark], piece


def long_bounds(bounds: np.ndarray, width: int):
    """Stretches of at most BLOCK bytes to work on, for rows that may be longer: ``(row, from, to)`` lists.

    A longer row is worked on in stretches that overlap by one window less a byte.
    """
    out = []
    for low, high in words.blocks(bounds, BLOCK):
        if high - low > 1 or bounds[high] - bounds[low] <= 2 * BLOCK:
            out.append((low, high, 0, int(bounds[high] - bounds[low])))
            continue
        size = int(bounds[high] - bounds[low])
        for at in range(0, max(size - width + 1, 1), BLOCK):
            out.append((low, high, at, min(at + BLOCK + width - 1, size)))
    return out


def _spans(ids, versions, starts, stops):
    """Overlapping or touching spans of one text as one, sorted."""
    order = np.lexsort((starts, versions, ids))
    ids, versions, starts, stops = (x[order] for x in (ids, versions, starts, stops))
    if not len(ids):
        return ids, versions, starts, stops
    rank = np.cumsum(np.append(False, (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1]))).astype(np.int64)
    reach = np.maximum.accumulate((rank << 40) + stops)
    fresh = np.ones(len(ids), bool)
    fresh[1:] = ((rank[1:] << 40) + starts[1:]) > reach[:-1]
    head = np.flatnonzero(fresh)
    last = np.append(head[1:], len(ids)) - 1
    return ids[head], versions[head], starts[head], reach[last] - (rank[last] << 40)


def _packed(at, length, mark):
    return (at << 20) | (length << 10) | mark


def _pieces(width: int):
    """Pieces of all texts; of equal ones in a block only the first, the others as spans that are gone."""

    def run(batches):
        values = words._VALUES
        up, down = words.powers(2 * BLOCK + width)
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, bounds = words.text_bytes(batch.column(1))
            for low, high, begin, end in long_bounds(bounds, width):
                part = data[bounds[low] + begin : bounds[low] + end]
                inner = bounds[low : high + 1] - bounds[low] if high - low > 1 else np.array([0, end - begin])
                doc, at, length, mark, gram, piece = cut_pieces(part, inner, width, values, up, down)
                if not len(doc):
                    continue
                own, version, at = ids[low:high][doc], versions[low:high][doc], at + begin
                order = np.lexsort((at, version, own, piece, gram))
                own, version, at, length, mark, gram, piece = (
                    x[order] for x in (own, version, at, length, mark, gram, piece)
                )
                same = np.zeros(len(own), bool)
                same[1:] = (gram[1:] == gram[:-1]) & (piece[1:] == piece[:-1])
                head = np.flatnonzero(~same)
                first = np.repeat(head, np.diff(np.append(head, len(own))))
                later = same & ((own != own[first]) | (version != version[first]) | (at != at[first]))
                keep = ~same
                s_id, s_version, s_start, s_stop = _spans(own[later], version[later], at[later], (at + length)[later])
                # spans that are gone are spread by their place
                spread = words.mix(s_id.astype(np.uint64) ^ words.mix(s_start.astype(np.uint64)))
                place = _packed(at[keep], length[keep], mark[keep])
                yield pa.RecordBatch.from_arrays(
                    [
                        words.signed(np.append(gram[keep], spread)),
                        pa.concat_arrays([words.signed(piece[keep]), pa.array(s_stop)]),
                        pa.array(np.append(own[keep], s_id)),
                        pa.array(np.append(version[keep], s_version)),
                        pa.array(np.append(place, s_start)),
                        pa.array(np.arange(len(place) + len(s_id)) >= len(place)),
                    ],
                    names=["gram", "piece", "id", "version", "place", "gone"],
                )

    return run


def _only(wanted):
    """The rows whose id the filter may hold."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_hold(wanted.value, batch.column(0).to_numpy())))

    return run


def _cores(width: int):
    """The strings of the wanted pieces: their windows by how far the minimizer is from the window's start."""

    def run(batches):
        values = words._VALUES
        most = width - SLIDE + 1
        for batch in batches:
            data, bounds = words.text_bytes(batch.column("text"))
            lists = batch.column("pieces")
            held = np.diff(lists.offsets.to_numpy())
            place = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(held)), held)
            at, length, mark = place >> 20, (place >> 10) & 1023, place & 1023
            ids, versions = batch.column("id").to_numpy(), batch.column("version").to_numpy()
            for low, high in words.blocks(bounds, BLOCK):
                here = slice(*np.searchsorted(row, [low, high]))
                part = data[bounds[low] : bounds[high]]
                up, down = words.powers(len(part))
                total = _totals(part, values, up)
                out = []
                for k in range(-(-(width - GRAM + 1) // SLIDE)):
                    last = np.minimum(length[here] - width, mark[here] - SLIDE * k)
                    first = np.maximum(0, mark[here] - SLIDE * k - SLIDE + 1)
                    ok = last >= first
                    start = (bounds[row[here]] - bounds[low] + at[here] + mark[here] - SLIDE * k)[ok]
                    core = words.mix(((total[start + most] - total[start]) * down[start]) ^ np.uint64(k))
                    size = (last - first)[ok] + width
                    doc = row[here][ok]
                    out.append((core, ids[doc], versions[doc], (at[here] + first)[ok], size))
                core, own, version, begin, size = (np.concatenate(x) for x in zip(*out))
                made = [words.signed(core), pa.array(own), pa.array(version)]
                made += [pa.array(begin.astype(np.int32)), pa.array(size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(made, names=["core", "id", "version", "at", "length"])

    return run


def _strings(width: int):
    """The bytes of the wanted strings; where one core has too many, single windows dealt out by content."""

    def run(batches):
        for batch in batches:
            core, part, own, versions, at, out = [], [], [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("id", "version", "text", "strings"))
            for doc, version, text, pieces in zip(*columns):
                raw = text.encode()
                for piece in pieces:
                    low, high, parts = piece["at"], piece["at"] + piece["length"], piece["parts"]
                    cuts = [(low, high, 0)]
                    if parts > 1:
                        cuts = []
                        for p in range(low, high - width + 1):
                            digest = hashlib.blake2b(raw[p : p + width], digest_size=8).digest()
                            cuts.append((p, p + width, int.from_bytes(digest, "big") % parts))
                    for low, high, share in cuts:
                        core.append(piece["core"])
                        part.append(share)
                        own.append(doc)
                        versions.append(version)
                        at.append(low)
                        out.append(raw[low:high])
            yield pa.RecordBatch.from_arrays(
                [pa.array(core, pa.int64()), pa.array(part, pa.int32()), pa.array(own, pa.int64())]
                + [pa.array(versions, pa.int64()), pa.array(at, pa.int32()), pa.array(out, pa.binary())],
                names=["core", "part", "id", "version", "at", "string"],
            )

    return run


def _collections(width: int):
    """Windows that occur before, from collections of whole ``(core, part)`` groups; the input is sorted by them."""

    def solve(batch):
        data, bounds = words.text_bytes(batch.column("string"))
        own, version = batch.column("id").to_numpy(), batch.column("version").to_numpy()
        at = batch.column("at").to_numpy().astype(np.int64)
        order = np.lexsort((version, own))
        new = (np.diff(own[order]) != 0) | (np.diff(version[order]) != 0)
        text = np.empty(len(own), np.int64)
        text[order] = np.cumsum(np.append(False, new))
        string, offset = repeats(data, bounds[:-1], np.diff(bounds), text, at, width)
        start = at[string] + offset
        ids, versions, start, stop = _spans(own[string], version[string], start, start + width)
        made = [pa.array(ids), pa.array(versions), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))]
        return pa.RecordBatch.from_arrays(made, names=["id", "version", "start", "stop"])

    def run(batches):
        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            while len(rest) > STRINGS:
                core, part = rest.column("core").to_numpy(), rest.column("part").to_numpy()
                change = np.flatnonzero((core[1:] != core[:-1]) | (part[1:] != part[:-1])) + 1
                if not len(change):
                    break
                to = int(change[max(np.searchsorted(change, STRINGS, "right") - 1, 0)])
                yield solve(rest.slice(0, to))
                rest = rest.slice(to)
        if rest is not None and len(rest):
            yield solve(rest)

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("version"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100) -> DataFrame:
    """``(id, version, start, stop)``: spans of bytes that together hold every window of ``width`` bytes that also starts
    earlier, in a smaller id or before in the same one. Spans may overlap. ``version`` is a hash of the text, and
    orders different texts of one id."""
    if width < 2 * GRAM or width > 1000:
        raise ValueError(f"width must be from {2 * GRAM} to 1000")
    texts = _texts(docs, id_col, text_col).where("id is not null and text is not null")
    held = Window.partitionBy("gram")
    place = F.struct("id", "version", "place")
    met = texts.mapInArrow(_pieces(width), PIECES).select(
        "*",
        F.count("*").over(held).alias("n"),
        (F.min("piece").over(held) != F.max("piece").over(held)).alias("mixed"),
    )
    met = met.where("gone or n > 1").withColumn("first", F.min(place).over(Window.partitionBy("gram", "piece")) == place)
    met = stored(met.select("id", "version", "place", "piece", "gone", "first", "mixed"))
    gone = F.col("place").cast("int").alias("start"), F.col("piece").cast("int").alias("stop")
    local = met.where("gone").select("id", "version", *gone)
    at = F.shiftright("place", 20)
    length = F.shiftright("place", 10).bitwiseAND(F.lit(1023))
    equal = met.where("not gone and not first").select(
        "id", "version", at.cast("int").alias("start"), (at + length).cast("int").alias("stop")
    )
    asked = met.where("not gone and first and mixed").groupBy("id", "version").agg(F.collect_set("place").alias("pieces"))
    asked = stored(asked)
    some = texts.mapInArrow(_only(id_filter(asked.select("id"))), TEXTS)
    cores = some.dropDuplicates(["id", "version"]).join(asked, ["id", "version"]).mapInArrow(_cores(width), CORES)
    count = F.count("*").over(Window.partitionBy("core"))
    parts = F.ceil(F.col("n") / STRINGS).cast("int").alias("parts")
    twice = cores.withColumn("n", count).where("n > 1")
    twice = stored(twice.groupBy("id", "version").agg(F.collect_set(F.struct("core", "at", "length", parts)).alias("strings")))
    some = texts.mapInArrow(_only(id_filter(twice.select("id"))), TEXTS)
    strings = some.dropDuplicates(["id", "version"]).join(twice, ["id", "version"]).mapInArrow(_strings(width), STRING)
    strings = strings.repartition("core", "part").sortWithinPartitions("core", "part", "id", "version", "at")
    found = strings.mapInArrow(_collections(width), SPAN)
    return local.unionByName(equal).unionByName(found)


def _cut(columns):
    def run(batches):
        for batch in batches:
            n, removed, spans, digest, kept, merged = [], [], [], [], [], []
            for text, found in zip(batch.column("text"), batch.column("spans")):
                raw, out, at = (text.as_py() or "").encode(), [], 0
                runs = []
                for s, e in sorted((x["start"], x["stop"]) for x in found.as_py() or []):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(e, runs[-1][1])
                    else:
                        runs.append([s, e])
                for s, e in runs:
                    out.append(raw[at:s])
                    at = e
                out = b"".join([*out, raw[at:]])
                n.append(len(raw))
                removed.append(len(raw) - len(out))
                spans.append(len(runs))
                digest.append(hashlib.sha256(out).hexdigest())
                kept.append(out)
                merged.append([{"start": s, "stop": e} for s, e in runs])
            made = {
                "id": batch.column("id"),
                "n_bytes": pa.array(n, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": pa.array(digest, pa.string()),
                "kept": pa.array(kept, pa.binary()),
                "spans": pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            }
            yield pa.RecordBatch.from_arrays([made[c] for c in columns], names=list(columns))

    return run


KINDS = {
    "id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string",
    "kept": "binary", "spans": "array<struct<start:int,stop:int>>",
}


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 100,
    columns=("id", "n_bytes", "n_removed", "n_spans", "kept"),
) -> DataFrame:
    """For every row of ``docs`` its text in UTF-8 without the bytes covered by a string of ``width`` bytes that
    also starts earlier (smaller id, or same document and earlier start). Overlapping occurrences count; strings
    lie within one document and are judged on the input.

    ``columns`` are any of ``id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans``; ``n_spans`` counts
    maximal removed runs. The kept bytes may begin or end inside a character.

    Null and empty texts have no bytes; shorter texts than ``width`` lose nothing. Rows that share an id and a text are
    one document and lose the same bytes; different texts of one id are documents of their own, ordered by a hash of the
    text. Rows with a null id keep all and are not looked at. Ids are
    integers. Of other columns none is read.
    """
    found = repeated_spans(docs, id_col, text_col, width)
    spans = found.groupBy("id", "version").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    texts = _texts(docs, id_col, text_col)
    schema = ", ".join(f"{c} {KINDS[c]}" for c in columns)
    return texts.join(spans, ["id", "version"], "left").mapInArrow(_cut(columns), schema)
