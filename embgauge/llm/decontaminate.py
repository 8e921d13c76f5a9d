"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a block of documents. Its suffix array orders the word positions that can start a match by the words
that follow, as deep as a window is long. Every suffix of every benchmark item is binary-searched in it; the
range found has all places of the suffix's first words, and neighbouring hits on one diagonal join into the
longest verbatim matches. Benchmark texts go to all tasks in blocks of a fixed size, one pass for each block.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embgauge.llm import words
from embgauge.llm.shared import stored

#: Bytes of text in a shard, and of benchmark text that is broadcast at once.
SHARD, MOST = 4 << 20, 16 << 20

MATCH = "struct<start:int,words:int,item:string,item_start:int>"
SCHEMA = f"id long, text string, n_words long, matches array<{MATCH}>"
_MATCH = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("item", pa.string()), ("item_start", pa.int32())])


def suffixes_of(items: pa.Array, texts: pa.Array, depth: int) -> SimpleNamespace:
    """All item suffixes that can start a window, as sortable keys of ``depth`` word numbers: plain arrays, to be sent."""
    data, bounds = words.text_bytes(texts)
    hashes, rows = words.row_words(data, bounds, words.byte_class("alnum"), words.folded_values())
    vocabulary = np.unique(hashes)
    ids = np.append(np.searchsorted(vocabulary, hashes) + 1, np.zeros(depth, np.int64))
    count = np.diff(rows)
    length = np.minimum(count, depth)
    starts = np.where(count > 0, count - length + 1, 0)
    item = np.repeat(np.arange(len(count)), starts)
    start = np.arange(len(item)) - np.repeat(np.cumsum(starts) - starts, starts)
    at, length = rows[:-1][item] + start, length[item]
    grid = ids[at[:, None] + np.arange(depth)] if len(at) else np.zeros((0, depth), np.int64)
    past = np.arange(depth) >= length[:, None]
    return SimpleNamespace(
        depth=depth,
        vocabulary=vocabulary,
        item=item,
        start=start,
        length=length,
        low=keys(np.where(past, 0, grid)),
        high=keys(np.where(past, 0xFFFFFFFF, grid)),
        shortest=int(length.min()) if len(at) else 0,
        names=np.array(items.to_pylist(), dtype=object),
    )


def keys(grid: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort as the rows do."""
    rows = np.ascontiguousarray(grid.astype(">u4"))
    return rows.view(f"S{4 * grid.shape[1]}").ravel() if grid.size else np.zeros(0, f"S{4 * grid.shape[1]}")


def shard_matches(found: SimpleNamespace, hashes: np.ndarray, rows: np.ndarray):
    """``(doc, start, words, suffix)`` of the longest matches of one shard, in order of documents."""
    n_docs, depth = len(rows) - 1, found.depth
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not len(hashes) or not found.shortest:
        return none
    place = np.minimum(np.searchsorted(found.vocabulary, hashes), len(found.vocabulary) - 1)
    number = np.where(found.vocabulary[place] == hashes, place + 1, 0)
    doc = np.repeat(np.arange(n_docs), np.diff(rows))
    # a 0 after each document, so that no match crosses documents
    text = np.zeros(len(number) + n_docs + depth, np.int64)
    at = np.arange(len(number)) + doc
    text[at] = number
    # how many known words follow each position: what cannot hold the shortest window need not be in the array
    unknown = np.flatnonzero(text == 0)
    follows = unknown[np.searchsorted(unknown, at)] - at
    array = at[follows >= found.shortest]
    if not len(array):
        return none
    key = keys(text[array[:, None] + np.arange(depth)])
    order = np.argsort(key, kind="stable")
    array, key = array[order], key[order]
    low, high = np.searchsorted(key, found.low, "left"), np.searchsorted(key, found.high, "right")
    many = np.maximum(high - low, 0)
    suffix = np.repeat(np.arange(len(many)), many)
    if not len(suffix):
        return none
    spot = array[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(suffix))]
    # hits on one diagonal of one item join
    item, start = found.item[suffix], found.start[suffix]
    order = np.lexsort((spot, spot - start, item))
    suffix, spot, item, start = suffix[order], spot[order], item[order], start[order]
    fresh = np.ones(len(spot), bool)
    fresh[1:] = (item[1:] != item[:-1]) | (spot[1:] != spot[:-1] + 1) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(fresh)
    run = np.diff(np.append(head, len(spot)))
    size = found.length[suffix[head]] + run - 1
    where = spot[head]
    owner = np.searchsorted(rows[:-1] + np.arange(n_docs), where, "right") - 1
    order = np.lexsort((where, owner))
    return owner[order], (where - owner - rows[owner])[order], size[order], suffix[head][order]


def _shards(suffixes, texts: pa.Array):
    """For shards of rows: their range, word bounds and ``shard_matches``."""
    is_word, values = words.byte_class("alnum"), words.folded_values()
    data, bounds = words.text_bytes(texts)
    for low, high in words.blocks(bounds, SHARD):
        part = data[bounds[low] : bounds[high]]
        hashes, rows = words.row_words(part, bounds[low : high + 1] - bounds[low], is_word, values)
        yield low, high, rows, shard_matches(suffixes, hashes, rows)


def _pass(sent):
    def run(batches):
        found = sent.value
        for batch in batches:
            for low, high, rows, (doc, start, size, suffix) in _shards(found, batch.column("text")):
                part = batch.slice(low, high - low)
                new = pa.StructArray.from_arrays(
                    [
                        pa.array(start.astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        pa.array(found.names[found.item[suffix]].tolist(), pa.string()),
                        pa.array(found.start[suffix].astype(np.int32)),
                    ],
                    fields=list(_MATCH),
                )
                ends = np.searchsorted(doc, np.arange(high - low + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), new)
                before = part.column("matches")
                if len(before.flatten()):
                    joined = [[*a, *b] for a, b in zip(before.to_pylist(), lists.to_pylist())]
                    lists = pa.array(joined, pa.list_(_MATCH))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text"), pa.array(np.diff(rows)), lists],
                    names=["id", "text", "n_words", "matches"],
                )

    return run


def _clean(sent, text: int):
    def run(batches):
        for batch in batches:
            for low, high, _, (doc, *_) in _shards(sent.value, batch.column(text)):
                hit = np.zeros(high - low, bool)
                hit[doc] = True
                yield batch.slice(low, high - low).filter(pa.array(~hit))

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int):
    """The suffixes of the benchmark in broadcast blocks of about ``most`` bytes, and whether it is the last."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    items = items.where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * total // most))
    share = F.pmod(F.xxhash64("item"), F.lit(parts))
    for k in range(parts):
        block = items.where(share == k).toArrow()
        column = lambda c: block[c].combine_chunks() if len(block) else pa.array([], pa.string())
        yield spark.sparkContext.broadcast(suffixes_of(column("item"), column("text"), window)), k + 1 == parts


def verbatim_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    most: int = MOST,
) -> DataFrame:
    """``(id, n_words, matches)`` for every row of ``docs``: its longest verbatim matches with benchmark items.

    Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z as a-z. A match has at least ``window``
    words, or the whole item if the item has fewer; it has the places in words, from 0, in document and item.

    Null and empty texts have no words and no matches, nor have items without words or with a null id. Repeated
    rows and repeated items count each. An empty benchmark matches nothing. Of other columns none is read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(f"array<{MATCH}>").alias("matches"),
    )
    for sent, last in _blocks(benchmark, item_col, item_text_col, window, most):
        rows = rows.mapInArrow(_pass(sent), SCHEMA)
        if not last:
            rows = stored(rows)
            sent.unpersist()
    return rows.drop("text")


def contamination(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items, longest, contaminated)`` for every row of ``docs``.

    ``n_hit`` counts the words inside any match, ``items`` has the matched item ids once, sorted as strings.
    Parameters and special cases are those of ``verbatim_matches``.
    """
    found = verbatim_matches(docs, benchmark, **columns)
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    step = lambda s, m: F.struct(
        (s["hit"] + F.greatest(F.lit(0), m["start"] + m["words"] - F.greatest(s["end"], m["start"]))).alias("hit"),
        F.greatest(s["end"], m["start"] + m["words"]).alias("end"),
    )
    hit = F.aggregate(F.array_sort("matches"), start, step, lambda s: s["hit"])
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    return found.select(
        "id",
        "n_words",
        hit.cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).alias("longest"),
        (F.size("matches") > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    most: int = MOST,
) -> DataFrame:
    """``docs`` without the rows that hold a match; all columns stay and no row moves.

    What a match is, and the special cases, are those of ``verbatim_matches``. The text column is a string.
    """
    for sent, last in _blocks(benchmark, item_col, item_text_col, window, most):
        docs = docs.mapInArrow(_clean(sent, docs.columns.index(text_col)), docs.schema)
        if not last:
            docs = stored(docs)
            sent.unpersist()
    return docs
