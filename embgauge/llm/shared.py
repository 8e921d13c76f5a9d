"""Tables in the cluster's shared folder, and links between rows turned into classes."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager, nullcontext

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local master without the setting gets its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores after it as it takes to differ from all ``columns``, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of an Arrow batch that a text kernel gets: a task holds a batch in the JVM, on its way and in Python.
BATCH = 8 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH):
    """Jobs started inside send Python batches of at most ``size`` bytes; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before.rstrip("b")), size) if before.rstrip("b").isdigit() else size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, hashes: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut, a lost executor costs a re-read.

    ``hashes`` says that a kernel makes the table of texts and that it is mostly hashes: the kernel gets small batches,
    and no dictionaries are tried, as hashes would not get smaller by it.

    The table is deleted by ``discard``, or when the application ends. The shuffles it came from are of no more
    use; a collection on the driver lets Spark's cleaner delete their files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with small_batches(spark) if hashes else nullcontext():
        df.write.option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for table in tables:
        place, files = _place(table.sparkSession, table.stored_at)
        files.delete(place, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; the component is its smallest node.

    Alternating large-star and small-star rounds: edges never grow in number, a hub's neighbours meet in
    partial aggregates and in joins that adaptive execution can split, and every round is a written table.
    Loops and repeated edges count once. Nodes without an edge do not appear.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")
    )
    pairs, before = stored(pairs.distinct()), None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        linked = large.join(low, "v")
        small = linked.select("v", F.col("m").alias("u")).unionByName(
            linked.where(F.col("u") != F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        )
        last, pairs = pairs, stored(small.distinct())
        discard(last)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)


#: Bits of an id filter; its size does not depend on the number of ids.
FILTER_BITS = 1 << 23


def id_filter(ids: DataFrame):
    """A fixed-size bitmap of the long column ``id``: a scan leaves out most rows that a later join would drop.

    It says yes for every id of the table and for some others, so the join stays.
    """
    bit = F.col("id").bitwiseXOR(F.shiftrightunsigned("id", 23)).bitwiseAND(F.lit(FILTER_BITS - 1))
    words = (
        ids.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8))


def may_hold(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each long id whether the bitmap of ``id_filter`` may hold it."""
    u = ids.astype(np.int64).view(np.uint64)
    bit = ((u ^ (u >> np.uint64(23))) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
