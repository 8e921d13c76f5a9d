"""N-gram Jaccard join by a token-group matrix.

Similar documents are put into groups: documents with the same shingle set are one, and documents that a
verified link ties to the first holder of their min-hashes form a group, cut into chunks. The matrix holds for
each token the groups whose union has it. A query document opens a group only if its overlap with the
group's union can reach the threshold, first by bitmaps of the tokens, which are a small part of their size, then by
the tokens themselves; then it is compared with the group's members, exactly.

Nothing is quadratic in a group of copies: copies of one set are one row, members of one group are already
linked and never compared again, and a token has one matrix row for a whole chunk of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embgauge.llm import rarity, words
from embgauge.llm.shared import components, discard, id_filter, may_hold, stored

#: Bytes of text that one numpy step works on, and steps whose tokens are looked through for repeats together.
STEP, STEPS = 1 << 20, 4
#: Min-hashes of a document, and how many of them it must share with a hub to be compared with it.
HASHES, SHARED = 4, 2
#: Documents and tokens in a chunk of a group, about.
CHUNK, CHUNK_TOKENS = 64, 1 << 17
#: Passes over the groups when they are opened; a pass shuffles the token sets that are part of it.
PASSES = 4
#: Bits of a document's bitmap: the least power of two that gives each token two, within these.
BITS_LEAST, BITS_MOST = 64, 1 << 20

PROFILE = "id long, n long, k1 long, k2 long, mins array<long>, token long, cnt long"
TOKENS = "id long, tokens array<long>"
PREFIX = "id long, n long, short int, tokens array<long>, bits array<long>"


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words.signed(values))


def _sets(batch: pa.RecordBatch, n: int, level: np.ndarray | None = None):
    """For some rows at a time: ids, distinct shingle hashes and their row bounds.

    With ``level`` the hashes are ``rarity.ranked``, and in order.
    """
    is_word, values = words.byte_class("space"), words.folded_values()
    data, bounds = words.text_bytes(batch.column(1))
    ids = batch.column(0)
    for low, high in words.blocks(bounds, STEP):
        part = data[bounds[low] : bounds[high]]
        hashes, rows = words.row_words(part, bounds[low : high + 1] - bounds[low], is_word, values)
        tokens, row = words.shingles(hashes, rows, n)
        if level is None:
            tokens, at = words.once(tokens, row, high - low)
        else:
            tokens, at = words.distinct(rarity.ranked(tokens, level), row, high - low)
        yield ids.slice(low, high - low), tokens, at


def _profiles(n: int):
    names = ["id", "n", "k1", "k2", "mins", "token", "cnt"]

    def repeated(seen):
        token, cnt = rarity.repeats(np.concatenate(seen))
        void = [*[pa.nulls(len(token), pa.int64())] * 4, pa.nulls(len(token), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*void, token, cnt], names=names)

    def run(batches):
        seeds = np.random.default_rng(7).integers(0, 1 << 64, HASHES, dtype=np.uint64)
        for batch in batches:
            seen = []
            for ids, tokens, at in _sets(batch, n):
                seen.append(tokens)
                if len(seen) == STEPS:
                    yield repeated(seen)
                    seen = []
                count, full = np.diff(at), np.flatnonzero(np.diff(at))
                least = np.zeros((len(count), HASHES), np.uint64)
                for j, seed in enumerate(seeds):
                    if len(full):
                        least[full, j] = np.minimum.reduceat(words.mix(tokens ^ seed), at[full])
                sums = [words.row_sums(words.mix(tokens ^ s), at) for s in (np.uint64(0x51), np.uint64(0xA7))]
                none = [pa.nulls(len(count), pa.int64())] * 2
                mins = _lists(least.ravel(), np.arange(len(count) + 1) * HASHES)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(count), words.signed(sums[0]), words.signed(sums[1]), mins, *none], names=names
                )
            if seen:
                yield repeated(seen)

    return run


def _bitmaps(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's tokens in a bitmap of 64-bit words, by their lowest bits, and the bounds of each row in words."""
    count = np.diff(bounds)
    size = np.left_shift(1, np.ceil(np.log2(np.clip(2 * count, BITS_LEAST, BITS_MOST))).astype(np.int64))
    ends = np.append(0, np.cumsum(size))
    held = np.zeros(ends[-1], bool)
    held[np.repeat(ends[:-1], count) + (tokens & np.repeat(size - 1, count).astype(np.uint64)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").view("<u8"), ends // 64


def _token_rows(n: int, wanted):
    def run(batches):
        bitmap = wanted.value
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(bitmap, batch.column(0).to_numpy())))
            for ids, tokens, at in _sets(batch, n):
                yield pa.RecordBatch.from_arrays([ids, _lists(tokens, at)], names=["id", "tokens"])

    return run


def _prefixes(n: int, num: int, den: int, level, wanted):
    """The rarest tokens of each document: enough that two linked ones share one of them; all its tokens as a bitmap.

    A query looks with ``n - ceil(t n) + 1`` tokens; the ``short`` first ones are enough for a document
    that is looked for by queries of its own size or larger.
    """

    def run(batches):
        table, bitmap = level.value, wanted.value
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(bitmap, batch.column(0).to_numpy())))
            for ids, order, bounds in _sets(batch, n, table):
                size = np.diff(bounds)
                long = size - -(-num * size // den) + 1
                short = size - -(-2 * num * size // (num + den)) + 1
                long, short = np.where(size > 0, long, 0), np.where(size > 0, short, 0)
                ends = np.cumsum(long)
                pick = np.repeat(bounds[:-1] - (ends - long), long) + np.arange(ends[-1] if len(ends) else 0)
                rarest, bits = _lists(order[pick], np.append(0, ends)), _lists(*_bitmaps(order, bounds))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(size), pa.array(short.astype(np.int32)), rarest, bits],
                    names=["id", "n", "short", "tokens", "bits"],
                )

    return run


def _similar(overlap, a, b, num, den):
    return overlap * (num + den) >= (a + b) * num


def _may_open(met: DataFrame, rare: DataFrame, num: int, den: int) -> DataFrame:
    """Rows ``(q, n, comp, chunk)`` of ``met`` whose query may share enough tokens with the union of the chunk.

    A bit that the query has and the union has not stands for a token, or more, that the union has not. The union's
    bitmap is as long as its shortest member's, and never longer than a query's that has no fewer tokens.
    """
    many = rare.where("held > 1").select("comp", "chunk", "bits")
    least = many.groupBy("comp", "chunk").agg(F.min(F.size("bits")).alias("words"))
    at = F.col("pos") % F.col("words")
    words_ = many.join(least, ["comp", "chunk"]).select("comp", "chunk", "words", F.posexplode("bits").alias("pos", "word"))
    words_ = words_.groupBy("comp", "chunk", at.alias("at")).agg(F.bit_or("word").alias("word"))
    unions = words_.groupBy("comp", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", "word")))["word"].alias("union"))
    unions = rare.where("held = 1").select("comp", "chunk", F.col("bits").alias("union")).unionByName(unions)
    sought = rare.select(F.col("rep").alias("q"), "size", "bits").dropDuplicates(["q"])
    both = met.join(sought, "q").join(unions, ["comp", "chunk"])
    word = lambda x, i: F.bit_count(x.bitwiseAND(F.bitwise_not(F.get("union", i % F.size("union")))))
    missing = F.aggregate(F.transform("bits", word), F.lit(0), lambda s, x: s + x)
    enough = (F.col("size") - missing) * den >= F.col("n") * num
    return both.where((F.size("union") > F.size("bits")) | enough).select("q", "n", "comp", "chunk")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``: classes of documents linked by similarity.

    Words are runs of bytes other than white space, A-Z as a-z; a document's set has its distinct ``n``-word
    shingles, or its whole sequence if it has fewer words. Two documents link when
    ``den * intersection >= num * union``. ``component_id`` is the smallest id reachable by links.

    Null or empty texts have no shingles and no links. Repeated rows give one result row each; rows that share
    an id are one document. Rows with a null id have a null component. Ids are integers. Of other columns none
    is read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = stored(texts.mapInArrow(_profiles(n), PROFILE), hashes=True)
    level = spark.sparkContext.broadcast(
        rarity.repeat_levels(profile.where("token is not null").select("token", F.col("cnt").alias("n")))
    )
    rows = profile.where("token is null").select("id", "n", "k1", "k2", "mins")
    sets = stored(
        rows.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.first("mins").alias("mins"))
    )
    named = texts.where("id is not null")

    # groups: documents tied to the first holder of their min-hashes
    slots = sets.select("rep", "n", F.posexplode("mins").alias("slot", "value"))
    hubs = slots.groupBy("slot", "value").agg(F.min("rep").alias("hub"), F.count("*").alias("held")).where("held > 1")
    near = slots.join(hubs, ["slot", "value"]).where("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("same"))
    near = stored(near.where(F.col("same") >= SHARED).select("rep", "hub"))
    ids = near.select(F.explode(F.array("rep", "hub")).alias("id")).distinct()
    held = stored(
        named.mapInArrow(_token_rows(n, id_filter(ids)), TOKENS).join(ids, "id", "left_semi").dropDuplicates(["id"]),
        hashes=True,
    )
    stars = (
        near.join(held.select(F.col("id").alias("rep"), F.col("tokens").alias("t1")), "rep")
        .join(held.select(F.col("id").alias("hub"), F.col("tokens").alias("t2")), "hub")
        .where(
            _similar(F.size(F.array_intersect("t1", "t2")), F.size("t1"), F.size("t2"), F.lit(num), F.lit(den))
        )
        .select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    )
    stars = stored(stars)
    discard(near, held)
    tied = components(stars)
    member = sets.select("rep", "n").join(tied, F.col("rep") == F.col("node"), "left")
    member = member.select("rep", "n", F.coalesce("component", "rep").alias("comp"))
    sizes = member.groupBy("comp").agg(F.count("*").alias("held"), F.sum("n").alias("all"))
    chunk = F.pmod(F.xxhash64("rep"), F.ceil(F.greatest(F.col("held") / CHUNK, F.col("all") / CHUNK_TOKENS)))
    member = member.join(sizes, "comp").select("rep", "n", "comp", "held", chunk.alias("chunk"))
    member = stored(member)

    # the matrix, and the queries that share a rare token with a group they are not part of
    wanted = id_filter(member.select(F.col("rep").alias("id")))
    rare = named.mapInArrow(_prefixes(n, num, den, level, wanted), PREFIX).dropDuplicates(["id"])
    rare = rare.withColumnRenamed("n", "size").join(member, F.col("id") == F.col("rep"))
    rare = stored(rare.select("rep", "n", "comp", "chunk", "held", "short", "tokens", "size", "bits"), hashes=True)
    indexed = rare.select("n", "comp", "chunk", "held", F.explode(F.slice("tokens", 1, F.col("short"))).alias("token"))
    lone = indexed.where("held = 1").select("token", "comp", "chunk", F.col("n").alias("low"), F.col("n").alias("high"))
    grouped = indexed.where("held > 1").groupBy("token", "comp", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    matrix = lone.unionByName(grouped)
    query = rare.select(F.explode("tokens").alias("token"), F.col("rep").alias("q"), F.col("comp").alias("own"), "n")
    match = (F.col("own") != F.col("comp")) & (F.col("n") >= F.col("low")) & (F.col("high") * den >= F.col("n") * num)
    met = stored(query.join(matrix, "token").where(match).select("q", "n", "comp", "chunk").distinct())
    open_ = stored(_may_open(met, rare, num, den))
    discard(met, rare)

    # bound by the union of the group's tokens, then compare with its members; a token set knows the passes it is part
    # of, as a member and as a query, so that a pass shuffles its own sets only
    nth_of = F.pmod(F.xxhash64("comp", "chunk"), F.lit(PASSES)).cast("int")
    wanted = open_.select("comp", "chunk").distinct()
    inside = member.join(wanted, ["comp", "chunk"], "left_semi").select(
        F.col("rep").alias("id"), "comp", "chunk", F.col("n").alias("m"), nth_of.alias("as_member"), F.lit(0).alias("as_query")
    )
    asking = open_.select(F.col("q").alias("id"), nth_of.alias("nth")).distinct().select(
        "id", F.expr("shiftleft(1, nth)").alias("as_query")
    )
    place = [F.max(c).alias(c) for c in ("comp", "chunk", "m", "as_member")]
    ids = stored(
        inside.unionByName(asking, allowMissingColumns=True).groupBy("id").agg(*place, F.bit_or("as_query").alias("as_query"))
    )
    held = stored(
        named.mapInArrow(_token_rows(n, id_filter(ids.select("id"))), TOKENS).join(ids, "id").dropDuplicates(["id"]),
        hashes=True,
    )
    found, written = stars, [stars]
    for nth in range(PASSES):
        turn = nth_of == nth
        parts = held.where(F.col("as_member") == nth).select("comp", "chunk", F.col("id").alias("rep"), "m", "tokens")
        unions = parts.groupBy("comp", "chunk").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"))
        sought = held.where(F.col("as_query").bitwiseAND(F.lit(1 << nth)) != 0)
        asked = open_.where(turn).join(sought.select(F.col("id").alias("q"), F.col("tokens").alias("sought")), "q")
        opened = asked.join(unions, ["comp", "chunk"]).where(
            F.size(F.array_intersect("sought", "union")) * den >= F.col("n") * num
        )
        links = (
            opened.drop("union")
            .join(parts, ["comp", "chunk"])
            .where((F.col("m") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("m") * num))
            .where(_similar(F.size(F.array_intersect("sought", "tokens")), F.col("n"), F.col("m"), F.lit(num), F.lit(den)))
            .select(F.col("q").alias("a"), F.col("rep").alias("b"))
        )
        written.append(stored(links))
        found = found.unionByName(written[-1])
    discard(open_, ids, held, member)
    classes = components(found)
    discard(*written)
    final = sets.select("k1", "k2", "n", "rep").join(classes, F.col("rep") == F.col("node"), "left")
    final = final.select("k1", "k2", "n", F.coalesce("component", "rep").alias("linked"))
    out = rows.drop("mins").join(final, ["k1", "k2", "n"], "left")
    smallest = F.when(F.col("id").isNotNull(), F.coalesce("linked", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), smallest.alias("component_id"))
