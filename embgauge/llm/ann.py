"""Nearest neighbours by largest inner product, with an adaptive dimension scan of probed lists.

Vectors get one more coordinate that makes all norms equal, so the largest inner product is the smallest
distance, and are rotated at random. Lists are the cells of centroids; a query probes the nearest ones. In a
list, distances are summed up over blocks of columns; after each block a test on the partial distance gives up the
candidates that are farther than the k-th best so far with high confidence. What is left is scored exactly on the
original vectors.

Lists are dealt out in chunks, and so are the queries of a list, so no group of near copies meets in one task. Of
equal vectors only the smallest ids can be among the nearest; no more than those are kept.
"""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from embgauge.llm.shared import stored

#: Rows the centroids are fitted on, lists at most, vectors and queries in one group, about.
SAMPLE, MOST_LISTS, CHUNK, QUERIES = 16384, 4096, 2048, 512
#: Columns in a block, and the confidence of the test in standard deviations.
COLUMNS, EPSILON = 16, 2.1


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy().astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def prepared(x: np.ndarray, top: float, rotation: np.ndarray, query: bool = False) -> np.ndarray:
    """Rows with the coordinate that evens out the norms (0 for queries), rotated."""
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0))
    return np.concatenate([x, rest[:, None]], 1) @ rotation


def centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's centroids from evenly spaced starting rows; a cell that gets empty keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cell = np.argmin(np.einsum("ij,ij->i", c, c) - 2 * x @ c.T, axis=1)
        n = np.bincount(cell, minlength=k)
        order = np.argsort(cell, kind="stable")
        total = np.add.reduceat(x[order], np.minimum(np.cumsum(n) - n, len(x) - 1))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _assigned(sent):
    def run(batches):
        index = sent.value
        for batch in batches:
            x = _matrix(batch.column("v"))
            if not len(x):
                continue
            y = prepared(x, index.top, index.rotation)
            cell = np.argmin(index.half - y @ index.centroids.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "v", "list"])

    return run


def _probes(sent, k: int, share: float):
    def run(batches):
        index, counts = sent.value, sent.value.counts
        probes = int(np.ceil(share * len(index.centroids)))
        for batch in batches:
            x = _matrix(batch.column("v"))
            if not len(x):
                continue
            y = prepared(x, index.top, index.rotation, query=True)
            near = np.argsort(index.half - y @ index.centroids.T, axis=1)
            held = np.cumsum(counts[near], axis=1)
            # more lists where the nearest ones hold too few vectors
            need = np.minimum(np.maximum((held < k + 1).sum(axis=1) + 1, probes), near.shape[1])
            row = np.repeat(np.arange(len(x)), need)
            lists = near[np.arange(near.shape[1]) < need[:, None]].astype(np.int32)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(lists)], names=["q", "v", "list"])

    return run


def _tightened(limit, part, x, q, k):
    """The k-th best distance is at most the largest one of any k rows: those of the smallest partial distances."""
    first = np.argpartition(part, k - 1, axis=1)[:, :k]
    gap = x[first] - q[:, None]
    found = np.einsum("ijk,ijk->ij", gap, gap).max(axis=1) * (1 + 1e-9) + 1e-12
    return found if limit is None else np.minimum(limit, found)


def scan(x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(query, row)`` of the rows of ``x`` that may be among the ``k`` nearest of each row of ``q``; rotated vectors.

    As long as most candidates are left their columns are summed up as matrix products, then one by one. The k-th
    best distance known so far gets tighter after each block. In the end partial distances are whole: of what is left, the
    k smallest and what ties with them remain.
    """
    width = x.shape[1]
    if len(x) <= k:
        return np.repeat(np.arange(len(q)), len(x)), np.tile(np.arange(len(x)), len(q))
    part, pairs, limit = np.zeros((len(q), len(x))), None, None
    for low in range(0, width, COLUMNS):
        high = min(low + COLUMNS, width)
        a, b = q[:, low:high], x[:, low:high]
        if pairs is None:
            part += np.einsum("ij,ij->i", a, a)[:, None]
            part += np.einsum("ij,ij->i", b, b)
            part -= 2 * (a @ b.T)
            limit = _tightened(limit, part, x, q, k)
        else:
            gap = a[pairs[0]] - b[pairs[1]]
            part = part + np.einsum("ij,ij->i", gap, gap)
        bound = limit * (high / width) * (1 + EPSILON / np.sqrt(high) * (high < width)) ** 2
        if pairs is None:
            given_up = part > bound[:, None]
            part[given_up] = np.inf
            if high == width or given_up.mean() > 0.9:
                pairs = np.nonzero(np.isfinite(part))
                part = part[pairs]
        else:
            keep = part <= bound[pairs[0]]
            pairs, part = (pairs[0][keep], pairs[1][keep]), part[keep]
    # each query's k-th smallest whole distance
    order = np.lexsort((part, pairs[0]))
    query, row, part = pairs[0][order], pairs[1][order], part[order]
    first = np.searchsorted(query, np.arange(len(q)))
    last = np.minimum(first + k, np.append(first[1:], len(query))) - 1
    near = part <= (part[np.maximum(last, 0)] * (1 + 1e-9) + 1e-12)[query] if len(part) else np.zeros(0, bool)
    return query[near], row[near]


def _searched(sent, k: int):
    def run(index_rows: pa.Table, query_rows: pa.Table):
        index = sent.value
        row, ids, own, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if index_rows.num_rows and query_rows.num_rows:
            x, q = (_matrix(t.column("v").combine_chunks()) for t in (index_rows, query_rows))
            ids, own = index_rows.column("id").to_numpy(), query_rows.column("q").to_numpy()
            at, row = scan(prepared(x, index.top, index.rotation), prepared(q, index.top, index.rotation, query=True), k + 1)
            other = ids[row] != own[at]
            at, row = at[other], row[other]
            score = (x[row] * q[at]).sum(axis=1)
            order = np.lexsort((ids[row], -score, at))
            at, row, score = at[order], row[order], score[order]
            best = np.arange(len(at)) - np.searchsorted(at, at) < k
            row, own, score = row[best], own[at[best]], score[best]
        return pa.table({"query_id": own, "vec_id": ids[row], "score": score})

    return run


def build(vectors: DataFrame, seed: int = 5) -> SimpleNamespace:
    """What index and search need of ``(id, v)``: norm bound, rotation, centroids. A quarter of the root
    of the rows are lists; the centroids are fitted on the SAMPLE rows of the smallest hashes."""
    size = F.size("v")
    n, top = vectors.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    width = vectors.groupBy(size.alias("w")).count().orderBy(F.desc("count"), "w").first()
    if not n:
        return SimpleNamespace(width=0)
    width = width["w"]
    draw = np.random.default_rng(seed)
    rotation = np.linalg.qr(draw.normal(size=(width + 1, width + 1)))[0]
    some = vectors.where(size == width).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    x = prepared(_matrix(some["v"].combine_chunks()), top, rotation)
    c = centroids(x, int(np.clip(round(np.sqrt(n) / 4), 1, min(MOST_LISTS, len(x)))))
    return SimpleNamespace(
        width=width, top=float(top), rotation=rotation, centroids=c, half=np.einsum("ij,ij->i", c, c) / 2, counts=None
    )


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of the vectors that are not null, zero or with null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    return rows.where(F.forall("v", lambda x: F.coalesce(fine(x), F.lit(False))) & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    share: float = 0.75,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest found among all vectors but its own id.

    ``queries`` has the columns of ``vectors``. ``score`` is the inner product in double precision on the original
    vectors; ties go to the smaller id. A query probes ``share`` of the lists,
    and more until they hold ``k`` others.

    Vectors that are null, zero or hold null or non-finite components take no part on either side, nor those of
    another width than the most common one. Rows of one id and equal vectors count once. Fewer than ``k``
    candidates are all returned; an empty table returns nothing. Of other columns none is read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    index = build(rows)
    schema = "query_id long, vec_id long, score double"
    if not index.width:
        empty = spark.createDataFrame([], schema)
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    sent = spark.sparkContext.broadcast(index)
    same = Window.partitionBy("list", "a", "b").orderBy("id")
    lists = (
        rows.where(F.size("v") == index.width)
        .mapInArrow(_assigned(sent), "id long, v array<double>, list int")
        .withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), "v")})
        .withColumn("nth", F.row_number().over(same))
        .where(F.col("nth") <= k + 1)
        .select("list", "id", "v")
    )
    lists = stored(lists)
    counted = lists.groupBy("list").agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(len(index.centroids), np.int64)
    counts[counted["list"].to_numpy()] = counted["n"].to_numpy()
    index.counts = counts
    sent = spark.sparkContext.broadcast(index)
    asked = usable(queries, id_col, vector_col).where(F.size("v") == index.width).dropDuplicates(["id"])
    asked = stored(asked.mapInArrow(_probes(sent, k, share), "q long, v array<double>, list int"))
    sizes = lists.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    loads = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    deal = sizes.join(loads, "list")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = lists.join(deal, "list").select(
        "list", dealt("id", "chunks").alias("chunk"), each("parts").alias("part"), "id", "v"
    )
    right = asked.join(deal, "list").select("list", each("chunks").alias("chunk"), dealt("q", "parts").alias("part"), "q", "v")
    key = ["list", "chunk", "part"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_searched(sent, k), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
