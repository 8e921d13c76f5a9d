"""Phrase collocations: frequent phrases by partitions, counted exactly, scored by their weakest cut.

Partitions (SON): the corpus is dealt into a few shards, and a phrase that is frequent in the corpus is frequent in
some shard at a support lowered to the shard's share of the language's words. Each shard is mined completely, order by
order: a phrase is counted in a shard only if the shorter ones inside it are frequent there. The phrases frequent in
any shard are united, without those that the bounds of the other shards keep from being frequent, and a last pass counts
them in the shards that have not counted them yet. So counts are those of the whole corpus.

A shard is as large as the corpus allows and is mined by many tasks: they count in numpy, and Spark adds up. Which
phrases an earlier pass found reaches the tasks as a bitmap of bounded size. It says yes for all of them and for a few
others, which costs work and changes no count. Phrases are 64-bit hashes until the last pass, which has their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from embgauge.llm import words
from embgauge.llm.shared import discard, stored

#: Words of the longest phrase; bytes of text that one step works on; phrases that a task counts before it sends them.
LONGEST, BLOCK, HELD = 5, 2 << 20, 1 << 21
#: Phrases that the last pass holds in a task. Sizes of a bitmap, in bits.
HELD_LAST, FEWEST_BITS, MOST_BITS = 1 << 18, 1 << 16, 1 << 27
#: Rows of a batch that is sent to Spark.
ROWS = 1 << 16
#: The passes over a shard: the orders each counts, and the order that must be frequent for it.
PASSES = (((1, 2), None), ((3,), 2), ((4, 5), 3))
#: A cell is a shard, times 2^48, and two numbers of a language there: see ``_cells``.
SHARD, NEED, MOST_SHARDS = 48, 32, 62
BREAKS = b".,;:!?\n\x0b\x0c\r"

_is_break = np.zeros(256, bool)
_is_break[list(BREAKS)] = True
_is_word = ~_is_break
_is_word[[0x20, 0x09]] = False
_plain = np.arange(256, dtype=np.uint8)
_plain[0x41:0x5B] += 0x20
_plain[0x09] = 0x20


def _steps(batch: pa.RecordBatch):
    """``bytes, bounds, rows`` of about BLOCK bytes; a longer text is cut where no phrase can reach across."""
    data, bounds = words.text_bytes(batch.column("text"))
    for low, high in words.blocks(bounds, BLOCK):
        first, last = int(bounds[low]), int(bounds[high])
        if last - first <= BLOCK or high > low + 1:
            yield data[first:last], bounds[low : high + 1] - first, np.arange(low, high)
            continue
        ends = np.flatnonzero(_is_break[data[first:last]]) + 1 + first
        while last - first > BLOCK:
            near = int(np.searchsorted(ends, first + BLOCK, "right"))
            cut = int(ends[near - 1]) if near and ends[near - 1] > first else int(ends[near]) if near < len(ends) else last
            yield data[first:cut], np.array([0, cut - first]), np.array([low])
            first = cut
        if first < last:
            yield data[first:last], np.array([0, last - first]), np.array([low])


class _Grams:
    """Hashes of the phrases of a step, by order. ``inside[n][i]``: words i to i+n-1 lie in one piece."""

    def __init__(self, data, bounds, lang: np.ndarray):
        self.starts, self.ends, rows = words.word_spans(data, bounds, _is_word)
        hashes = words.span_hashes(data, self.starts, self.ends, words.folded_values())
        self.row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        breaks = np.cumsum(_is_break[data], dtype=np.int32)[self.starts]
        new = (np.diff(breaks, prepend=-1) != 0) | (np.diff(self.row, prepend=-1) != 0)
        piece = np.cumsum(new, dtype=np.int32)
        self.n, total = len(hashes), lang[self.row] * np.uint64(0xA0761D6478BD642F)
        self.keys, self.inside, factor = {}, {}, 0xE7037ED1A0B428DB
        for n in range(1, LONGEST + 1):
            m = max(self.n - n + 1, 0)
            total = total[:m] + hashes[n - 1 :] * np.uint64(factor)
            factor = factor * 0x8EBC6AF09C88C6E3 & (1 << 64) - 1 | 1
            self.keys[n] = words.mix(total + np.uint64(n))
            self.inside[n] = piece[:m] == piece[n - 1 :]


def _marked(keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Keys that differ by shard, as ``_mark`` makes them in Spark."""
    shard = shard.astype(np.uint64)
    return keys ^ (shard << np.uint64(8)) ^ (shard << np.uint64(40))


def _mark(key, shard):
    return key.bitwiseXOR(F.shiftleft(shard, 8)).bitwiseXOR(F.shiftleft(shard, 40))


def _bitmap(keys: DataFrame):
    """A bitmap of the long column ``key`` with two bits for each, broadcast; sixteen bits a key up to MOST_BITS."""
    bits = FEWEST_BITS
    while bits < MOST_BITS and bits < 16 * keys.count():
        bits *= 2
    place = lambda shift: F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(bits - 1))
    found = (
        keys.select(F.explode(F.array(place(0), place(32))).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .toArrow()
    )
    held = np.zeros(bits // 64, np.int64)
    held[found["word"].to_numpy()] = found["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(held.view(np.uint8))


def _held(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    mask, out = np.uint64(8 * len(bitmap) - 1), None
    for shift in (0, 32):
        bit = keys >> np.uint64(shift) & mask
        one = bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
        out = one if out is None else out & one
    return out == 1


def _column(batch, name, kind) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(kind)


def _word_totals(batches):
    for batch in batches:
        count = np.zeros(batch.num_rows, np.int64)
        for data, bounds, rows in _steps(batch):
            count[rows] += np.diff(words.word_spans(data, bounds, _is_word)[2])
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("shard"), pa.array(count)], names=["lang", "shard", "n"]
        )


def _mined(orders, below, bitmap):
    """Phrases of ``orders`` by ``(gram, cell)``: those whose parts of order ``below`` the bitmap holds for the shard."""

    def run(batches):
        grams, cells, counts, size = [], [], [], 0

        def sent():
            gram, cell, n = (np.concatenate(x) for x in (grams, cells, counts))
            for own in (grams, cells, counts):
                own.clear()
            marked = _marked(gram, cell >> SHARD)
            order = np.argsort(marked)
            marked = marked[order]
            first = np.flatnonzero(np.append(True, marked[1:] != marked[:-1]))
            n = np.add.reduceat(n[order], first)
            order = order[first]
            for at in range(0, len(first), ROWS):
                own = order[at : at + ROWS]
                made = [words.signed(gram[own]), pa.array(cell[own]), pa.array(n[at : at + ROWS])]
                yield pa.RecordBatch.from_arrays(made, names=["gram", "cell", "n"])

        for big in batches:
            lang, cell_of = _column(big, "lang_key", np.int64).view(np.uint64), _column(big, "cell", np.int64)
            for data, bounds, rows in _steps(big):
                found = _Grams(data, bounds, lang[rows])
                cell = cell_of[rows][found.row]
                known = None
                if below:
                    known = found.inside[below].copy()
                    at = np.flatnonzero(known)
                    known[at] = _held(bitmap.value, _marked(found.keys[below][at], cell[at] >> SHARD))
                for n in orders:
                    taken = found.inside[n].copy()
                    if below:
                        for j in range(n - below + 1):
                            taken &= known[j : j + len(taken)]
                    at = np.flatnonzero(taken)
                    if not len(at):
                        continue
                    gram, own = found.keys[n][at], cell[at]
                    _, first, uses = np.unique(_marked(gram, own >> SHARD), return_index=True, return_counts=True)
                    grams.append(gram[first])
                    cells.append(own[first])
                    counts.append(uses)
                    size += len(first)
                if size > HELD:
                    yield from sent()
                    size = 0
        if size:
            yield from sent()

    return run


def _counted(asked, homes):
    """``(gram, shard, n, words, lang, phrase)`` of the phrases asked for in a shard; with their texts at home only."""

    def run(batches):
        slots: dict[tuple, int] = {}
        grams, shards, counts, orders, langs, texts = [], [], [], [], [], []

        def batch():
            made = [words.signed(np.array(grams, np.uint64)), pa.array(shards, pa.int64()), pa.array(counts, pa.int64())]
            made += [pa.array(orders, pa.int32()), pa.array(langs, pa.string()), pa.array(texts, pa.string())]
            slots.clear()
            for own in (grams, shards, counts, orders, langs, texts):
                own.clear()
            return pa.RecordBatch.from_arrays(made, names=["gram", "shard", "n", "words", "lang", "phrase"])

        for big in batches:
            key, lang = _column(big, "lang_key", np.int64).view(np.uint64), big.column("lang").to_pylist()
            shard_of = _column(big, "cell", np.int64) >> SHARD
            for data, bounds, rows in _steps(big):
                found, flat = _Grams(data, bounds, key[rows]), _plain[data].tobytes()
                shard = shard_of[rows][found.row]
                for n in range(1, LONGEST + 1):
                    at = np.flatnonzero(found.inside[n])
                    marked = _marked(found.keys[n][at], shard[at])
                    held = _held(asked.value, marked)
                    at, marked = at[held], marked[held]
                    unique, first, uses = np.unique(marked, return_index=True, return_counts=True)
                    slot = np.array([slots.get(k, -1) for k in unique.tolist()], np.int64)
                    for i, times in zip(slot[slot >= 0].tolist(), uses[slot >= 0].tolist()):
                        counts[i] += times
                    fresh = np.flatnonzero(slot < 0)
                    slots.update(zip(unique[fresh].tolist(), range(len(counts), len(counts) + len(fresh))))
                    at, home = at[first[fresh]], _held(homes.value, unique[fresh])
                    counts.extend(uses[fresh].tolist())
                    grams.extend(found.keys[n][at].tolist())
                    shards.extend(shard[at].tolist())
                    orders.extend([n] * len(at))
                    low, high = found.starts[at].tolist(), found.ends[at + n - 1].tolist()
                    for s, e, row, own in zip(low, high, rows[found.row[at]].tolist(), home.tolist()):
                        langs.append(lang[row] if own else None)
                        text = flat[s:e] if own else None
                        texts.append(b" ".join(text.split()).decode() if own else None)
                if len(counts) > HELD_LAST:
                    yield batch()
        if counts:
            yield batch()

    return run


def _cells(totals: DataFrame, least: int) -> DataFrame:
    """``(lang, shard, cell)``: the shard's number, what the known shards of a phrase must have beyond their bounds, and
    the bound of this one.

    A phrase with ``least`` occurrences in the corpus has at least ``bound = ceil(least * words of the shard / words)``
    in one of its shards. Where it has not, it has ``bound - 1`` at most; so it is frequent only if the counts of the
    shards where it has exceed their ``bound - 1`` by ``need = least - sum(bound - 1)`` together.
    """
    by_lang = totals.groupBy("lang").agg(F.sum("n").alias("all"))
    bound = F.ceil(F.col("n").cast("decimal(20,0)") * least / F.col("all")).cast("long")
    bounds = totals.where("n > 0").join(by_lang, "lang").select("lang", "shard", bound.alias("bound"))
    need = bounds.groupBy("lang").agg((F.lit(least) - F.sum(F.col("bound") - 1)).alias("need"))
    cell = F.shiftleft("shard", SHARD).bitwiseOR(F.shiftleft("need", NEED)).bitwiseOR(F.col("bound"))
    return bounds.join(need, "lang").select("lang", "shard", cell.alias("cell"))


def frequent_phrases(
    docs: DataFrame, least: int = 100, shards: int = 8, lang_col: str = "lang", text_col: str = "text", shard=None
) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, n)`` of all phrases of one to five words with ``n >= least``, and ``(lang, n)``.

    ``n`` counts the occurrences in all texts, overlapping ones too; the second table has all words of a language.
    ``shard`` is a column that a row has in every scan (such as its file's name), by default a hash of its text; equal
    values meet in one of ``shards`` shards. Fewer, larger shards leave fewer phrases to count in the end.
    """
    if not 0 < shards <= MOST_SHARDS:
        raise ValueError(f"from 1 to {MOST_SHARDS} shards")
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    named = F.xxhash64(F.col(text_col) if shard is None else shard)
    rows = docs.select(
        lang.alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.pmod(named, F.lit(shards)).cast("long").alias("shard"),
    )
    totals = rows.mapInArrow(_word_totals, "lang string, shard long, n long").groupBy("lang", "shard").agg(F.sum("n").alias("n"))
    totals = stored(totals)
    cells = stored(_cells(totals, least))
    rows = rows.join(cells, ["lang", "shard"]).select("lang", F.xxhash64("lang").alias("lang_key"), "cell", "text")
    part = F.shiftright("cell", SHARD)
    bound = F.col("cell").bitwiseAND(F.lit((1 << NEED) - 1))
    need = F.shiftright("cell", NEED).bitwiseAND(F.lit((1 << SHARD - NEED) - 1))
    passes, bitmap = [], None
    for orders, below in PASSES:
        found = rows.drop("lang").mapInArrow(_mined(orders, below, bitmap), "gram long, cell long, n long")
        found = stored(found.groupBy("gram", "cell").agg(F.sum("n").alias("n")).where(F.col("n") >= bound))
        if bitmap is not None:
            bitmap.unpersist()
        bitmap = _bitmap(found.select(_mark(F.col("gram"), part).alias("key")))
        passes.append(found)
    bitmap.unpersist()
    united = passes[0].unionByName(passes[1]).unionByName(passes[2]).withColumn("shard", part).groupBy("gram").agg(
        F.sum("n").alias("known"),
        F.sum(F.col("n") - bound + 1).alias("beyond"),
        F.max(need).alias("need"),
        F.collect_set("shard").alias("counted"),
        F.max_by("shard", "n").alias("home"),
    )
    united = stored(united.where("beyond >= need").drop("beyond", "need"))
    discard(*passes)
    others = F.array_except(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>"), F.col("counted"))
    pairs = stored(united.select("gram", F.explode(F.array_append(others, F.col("home"))).alias("shard")))
    asked = _bitmap(pairs.select(_mark(F.col("gram"), F.col("shard")).alias("key")))
    homes = _bitmap(united.select(_mark(F.col("gram"), F.col("home")).alias("key")))
    last = "gram long, shard long, n long, words int, lang string, phrase string"
    found = rows.mapInArrow(_counted(asked, homes), last).groupBy("gram", "shard").agg(
        F.sum("n").alias("n"), F.max("words").alias("words"), F.max("lang").alias("lang"), F.max("phrase").alias("phrase")
    )
    fresh = F.when(~F.array_contains("counted", F.col("shard")), F.col("n")).otherwise(0)
    found = found.join(united, "gram").groupBy("gram").agg(
        F.max("lang").alias("lang"),
        F.max("phrase").alias("phrase"),
        F.max("words").alias("words"),
        (F.max("known") + F.sum(fresh)).alias("n"),
    )
    found = stored(found.where(F.col("n") >= least).select("lang", "phrase", "words", "n"))
    discard(united, pairs, cells)
    asked.unpersist()
    homes.unpersist()
    return found, totals.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(
    docs: DataFrame,
    least: int = 100,
    top: int = 2000,
    shards: int = 8,
    lang_col: str = "lang",
    text_col: str = "text",
    shard=None,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two to five words of each language.

    ``a`` counts the phrase, ``l`` and ``r`` its parts before and after the cut with the lowest
    ``score = floor(1000 * a * n / (l * r))``, of equal scores the first cut; ``n`` counts all words of the language.
    A phrase inside a longer one that occurs as often is left out. Ranks are by score, count and phrase.

    Null texts are empty, a null language is ``und``; rows without words and empty tables give no phrases; repeated
    rows count each. Columns other than the two (and those of ``shard``) are not read.
    """
    found, by_lang = frequent_phrases(docs, least, shards, lang_col, text_col, shard)
    own = found.where("words >= 2")
    # a longer phrase that occurs as often has one with a single word more in between, which occurs as often too
    inner = found.where("words >= 3").select("lang", "words", "n", F.expr(
        "explode(array(substring_index(phrase, ' ', words - 1), substring_index(phrase, ' ', 1 - words)))"
    ).alias("phrase")).select("lang", "phrase", "n").distinct()
    left = own.join(inner, ["lang", "phrase", "n"], "left_anti").join(by_lang.withColumnRenamed("n", "all"), "lang")
    cuts = left.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    parts = found.where(F.col("words") < LONGEST)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr(
        "(cast(1000 as decimal(4,0)) * cast(n as decimal(15,0)) * cast(all as decimal(17,0)))"
        " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    ))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("weakest")
    scored = cuts.groupBy("lang", "phrase", "n", "all").agg(weakest).select(
        "lang", "phrase", F.col("n").alias("a"), "weakest.l", "weakest.r", F.col("all").alias("n"), "weakest.score"
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
