"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct word shingles. Equal token sets are one set, held by its first line. Sets are
ordered by rarity; two sets can only be similar if their prefixes share a token (prefix filter), their sizes are
close (length filter) and enough tokens follow the first shared one (positional filter). What is left is
verified exactly, and the later line of a similar pair goes. Whether a line goes depends on the input lines
only, not on what became of the earlier one.

A group of near copies is not compared pair by pair: first every set is compared with the earliest set of its
min-hash. A set found there to be a later match is decided; it stays as a possible earlier partner of
undecided sets only.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from embgauge.llm import rarity, words
from embgauge.llm.shared import discard, free_name, id_filter, may_hold, stored

#: Bytes of text that one numpy step works on, and steps whose tokens are looked through for repeats together.
STEP, STEPS = 1 << 20, 4
NEWLINE, BLANKS = 0x0A, " \t\n\x0b\x0c\r"

LINES = "id long, line int, n int, k1 long, k2 long, m1 long, m2 long, token long, cnt long"
TOKENS = "id long, line int, tokens array<long>"
PREFIX = "id long, line int, short int, tokens array<long>"


def _lines(batch: pa.RecordBatch, n: int, wanted: np.ndarray | None = None, level: np.ndarray | None = None):
    """For some documents at a time: id and number of each line, distinct shingle hashes and their line bounds.

    With ``level`` the hashes are ``rarity.ranked``, and in order.
    """
    is_word, values = words.byte_class("space"), words.folded_values()
    data, bounds = words.text_bytes(batch.column(1))
    ids = batch.column(0).to_numpy()
    for low, high in words.blocks(bounds, STEP):
        part, docs = data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
        breaks = np.flatnonzero(part == NEWLINE)
        held = np.diff(np.searchsorted(breaks, docs)) + 1
        doc = np.repeat(np.arange(high - low), held)
        first = np.cumsum(held) - held
        number = np.arange(len(doc)) - first[doc]
        starts = np.empty(len(doc), np.int64)
        starts[first] = docs[:-1]
        starts[number > 0] = breaks + 1
        ends = np.append(starts[1:], len(part))
        at = ids[low:high][doc]
        if wanted is not None:
            keep = may_hold(wanted, place(at, number))
            starts, ends, at, number = starts[keep], ends[keep], at[keep], number[keep]
            length = ends - starts
            part = part[np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())]
            ends = np.cumsum(length)
            starts = ends - length
        hashes, rows = words.row_words(part, np.append(starts, len(part)), is_word, values)
        tokens, row = words.shingles(hashes, rows, n)
        if level is None:
            tokens, rows = words.once(tokens, row, len(at))
        else:
            tokens, rows = words.distinct(rarity.ranked(tokens, level), row, len(at))
        yield at, number.astype(np.int32), tokens, rows


#: Odd multipliers of fewer than 32 bits: products of 31-bit numbers with them stay within a long.
SPREAD = 0x5E3779B1, 0x46EBCA77


def place(ids, lines):
    """A long for a line of a document, for filters, with its bits spread; the same in ``place_column``."""
    low = (ids ^ (ids.view(np.uint64) >> np.uint64(31)).view(np.int64)) & 0x7FFFFFFF
    return low * SPREAD[0] ^ lines.astype(np.int64) * SPREAD[1]


def place_column(ids, lines):
    low = F.col(ids).bitwiseXOR(F.shiftrightunsigned(ids, 31)).bitwiseAND(F.lit(0x7FFFFFFF))
    return (low * F.lit(SPREAD[0]).cast("long")).bitwiseXOR(F.col(lines).cast("long") * F.lit(SPREAD[1]).cast("long"))


def _scan(n: int):
    """All lines that have words, with what names their set and two min-hashes; and the tokens that several lines
    of a few steps hold."""
    names = ["id", "line", "n", "k1", "k2", "m1", "m2", "token", "cnt"]

    def repeated(seen):
        token, cnt = rarity.repeats(np.concatenate(seen))
        void = [pa.nulls(len(token), t) for t in (pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4)]
        return pa.RecordBatch.from_arrays([*void, token, cnt], names=names)

    def run(batches):
        for batch in batches:
            seen = []
            for ids, lines, tokens, at in _lines(batch, n):
                seen.append(tokens)
                if len(seen) == STEPS:
                    yield repeated(seen)
                    seen = []
                full = np.flatnonzero(np.diff(at))
                if not len(full):
                    continue
                sums = [words.row_sums(words.mix(tokens ^ np.uint64(s)), at)[full] for s in (0x51, 0xA7)]
                a, b = (np.minimum.reduceat(words.mix(tokens ^ np.uint64(s)), at[full]) for s in (0xB3, 0xC9))
                none = [pa.nulls(len(full), pa.int64())] * 2
                columns = [pa.array(ids[full]), pa.array(lines[full]), pa.array(np.diff(at)[full].astype(np.int32))]
                columns += [words.signed(s) for s in (*sums, a, b)]
                yield pa.RecordBatch.from_arrays([*columns, *none], names=names)
            if seen:
                yield repeated(seen)

    return run


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words.signed(values))


def _token_rows(n: int, wanted):
    def run(batches):
        for batch in batches:
            for ids, lines, tokens, at in _lines(batch, n, wanted.value):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(lines), _lists(tokens, at)], names=["id", "line", "tokens"]
                )

    return run


def _prefixes(n: int, num: int, den: int, level, wanted):
    def run(batches):
        for batch in batches:
            for ids, lines, order, bounds in _lines(batch, n, wanted.value, level.value):
                size = np.diff(bounds)
                long = np.where(size > 0, size - -(-num * size // den) + 1, 0)
                short = np.where(size > 0, size - -(-2 * num * size // (num + den)) + 1, 0)
                ends = np.cumsum(long)
                pick = np.repeat(bounds[:-1] - (ends - long), long) + np.arange(long.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids),
                        pa.array(lines),
                        pa.array(short.astype(np.int32)),
                        _lists(order[pick], np.append(0, ends)),
                    ],
                    names=["id", "line", "short", "tokens"],
                )

    return run


def _fetch(texts: DataFrame, lines: DataFrame, kernel, schema: str) -> DataFrame:
    """What ``kernel`` finds for each ``(id, line)`` of ``lines``: column ``at``, its own, and the others of ``lines``."""
    wanted = id_filter(lines.select(place_column("id", "line").alias("id")))
    found = texts.mapInArrow(kernel(wanted), schema).join(lines, ["id", "line"])
    return found.dropDuplicates(["id", "line"]).select(F.struct("id", "line").alias("at"), *found.columns[2:])


def _first(rows: DataFrame) -> list:
    """The smallest ``(id, line)`` of a group; one number orders the lines, so groups are hashed, not sorted.

    A long is enough for ids of 31 bits, at a fraction of what a decimal costs.
    """
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    if low is None or -(1 << 31) <= low <= high < 1 << 31:
        place = F.shiftleft("id", 32).bitwiseOR(F.col("line").cast("long"))
    else:
        place = F.col("id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("line").cast("decimal(10,0)")
    return [F.min("id").alias("id"), F.min_by("line", place).alias("line")]


def kept_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """``(id, lines)``: for each document that keeps lines with words, their numbers from 0, in no order."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where("id is not null")
    scan = stored(texts.mapInArrow(_scan(n), LINES), hashes=True)
    level = spark.sparkContext.broadcast(
        rarity.repeat_levels(scan.where("token is not null").select("token", F.col("cnt").alias("n")))
    )
    lines = scan.where("token is null")
    sets = lines.groupBy("k1", "k2", "n").agg(*_first(lines), F.min("m1").alias("m1"), F.min("m2").alias("m2"))
    sets = stored(sets.select(F.struct("id", "line").alias("first"), "n", "m1", "m2"), hashes=True)
    discard(scan)
    # smaller sets are similar to equal ones only
    large = sets.where(F.col("n") * (den - num) >= num)

    def similar(t1, t2):
        both = F.size(F.array_intersect(t1, t2))
        return both * (num + den) >= (F.size(t1) + F.size(t2)) * num

    # every set against a set of its min-hashes in the first document that has one, if it is earlier and their sizes
    # are close; which of a document's sets is of no matter, as the join below finds what this does not
    slots = large.select("first", "n", F.explode(F.array("m1", "m2")).alias("least"))
    hubs = slots.select("first.*", "n", "least").groupBy("least").agg(
        F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in ("line", "n")], F.count("*").alias("held")
    )
    hubs = hubs.where("held > 1").select("least", F.struct("id", "line").alias("hub"), F.col("n").alias("m"))
    m = F.col("m")
    close = (m * den >= F.col("n") * num) & (F.col("n") * den >= m * num) & (F.col("first") > F.col("hub"))
    pairs = stored(slots.join(hubs, "least").where(close).select("first", "hub").distinct())
    lines = pairs.select(F.explode(F.array("first", "hub")).alias("at")).select("at.*").distinct()
    held = stored(_fetch(texts, lines, lambda wanted: _token_rows(n, wanted), TOKENS), hashes=True)
    decided = (
        pairs.join(held.select(F.col("at").alias("first"), F.col("tokens").alias("t1")), "first")
        .join(held.select(F.col("at").alias("hub"), F.col("tokens").alias("t2")), "hub")
        .where(similar("t1", "t2"))
        .select("first", F.lit(True).alias("decided"))
        .distinct()
    )
    state = stored(sets.join(decided, "first", "left").select("first", "n", F.coalesce("decided", F.lit(False)).alias("decided")))
    discard(pairs, held, sets)

    # undecided sets against all that can match them
    large = state.where(F.col("n") * (den - num) >= num)
    lines = large.select("first.*", "n", "decided")
    rare = _fetch(texts, lines, lambda wanted: _prefixes(n, num, den, level, wanted), PREFIX)
    rare = stored(rare.withColumnRenamed("at", "first").select("first", "n", "decided", "short", "tokens"), hashes=True)
    place = F.col("first.id"), F.col("first.line")
    left = rare.where("not decided").select(F.posexplode("tokens").alias("i", "token"), *place, "n").toDF(
        "i", "token", "q_id", "q_line", "n"
    )
    part = F.when(F.col("decided"), F.col("tokens")).otherwise(F.slice("tokens", 1, F.col("short")))
    right = rare.select(F.posexplode(part).alias("j", "token"), *place, "n", "decided").toDF(
        "j", "token", "s_id", "s_line", "m", "decided"
    )
    later = (F.col("s_id") < F.col("q_id")) | ((F.col("s_id") == F.col("q_id")) & (F.col("s_line") < F.col("q_line")))
    order = F.when(F.col("decided"), later).otherwise((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & later))
    close = (F.col("m") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("m") * num)
    follow = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    enough = follow * (num + den) >= (F.col("n") + F.col("m")) * num
    pairs = left.join(right, "token").where(close & enough & order).select("q_id", "q_line", "s_id", "s_line").distinct()
    pairs = stored(
        pairs.select(
            F.struct(F.col("q_id").alias("id"), F.col("q_line").alias("line")).alias("q"),
            F.struct(F.col("s_id").alias("id"), F.col("s_line").alias("line")).alias("s"),
        )
    )
    discard(rare)
    lines = pairs.select(F.explode(F.array("q", "s")).alias("at")).select("at.*").distinct()
    held = stored(_fetch(texts, lines, lambda wanted: _token_rows(n, wanted), TOKENS), hashes=True)
    found = (
        pairs.join(held.select(F.col("at").alias("q"), F.col("tokens").alias("t1")), "q")
        .join(held.select(F.col("at").alias("s"), F.col("tokens").alias("t2")), "s")
        .where(similar("t1", "t2"))
        .select(F.greatest("q", "s").alias("first"))
    )
    kept = state.where("not decided").join(found, "first", "left_anti")
    return kept.groupBy(F.col("first.id").alias("id")).agg(F.collect_list("first.line").alias("lines"))


REWRITTEN = T.StructType().add("text", "string").add("n_lines", "integer").add("n_removed", "integer")


@F.pandas_udf(REWRITTEN)
def _rewritten(text: pd.Series, lines: pd.Series) -> pd.DataFrame:
    out = []
    for t, keep in zip(text, lines):
        if t is None:
            out.append((None, 0, 0))
            continue
        every = t.split("\n")
        keep = None if keep is None else set(keep)
        left = [x for i, x in enumerate(every) if keep is None or i in keep or not x.strip(BLANKS)]
        out.append(("\n".join(left), len(every), len(every) - len(left)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])


# A filter on what it finds would else be a second run of it on all texts, in workers of its own.
_rewritten = _rewritten.asNondeterministic()


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """``docs`` with later matches of lines removed from the text, and ``line_count, lines_removed``.

    Lines end at newlines. A line's words are runs of bytes other than white space, A-Z as a-z; its tokens are
    its distinct ``n``-word shingles, or its whole word sequence if it has fewer. A line goes when an earlier
    line (smaller id, then smaller number) has the same tokens, or a Jaccard similarity of ``num/den`` or more.
    Lines without words stay.

    A null text stays null, with no lines; a document may be left with an empty text. Rows that share an id are
    one document and keep the same lines. Rows with a null id stay as they are. All columns of ``docs`` stay; where one
    has the name of a new column, the new one's gets underscores (``line_count_``). The new ones come last.
    """
    at, left, new = (free_name(docs.columns, c) for c in ("kept_id", "kept_lines", "rewritten"))
    count, removed = (free_name(docs.columns, c) for c in ("line_count", "lines_removed"))
    kept = kept_lines(docs, id_col, text_col, n, num, den).select(F.col("id").alias(at), F.col("lines").alias(left))
    both = docs.join(kept, F.col(id_col).cast("long") == F.col(at), "left")
    lines = F.when(F.col(id_col).isNotNull(), F.coalesce(left, F.array().cast("array<int>")))
    both = both.withColumn(new, _rewritten(F.col(text_col).cast("string"), lines))
    columns = [F.col(f"{new}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return both.select(*columns, F.col(f"{new}.n_lines").alias(count), F.col(f"{new}.n_removed").alias(removed))
