"""Labelled text, sentence pairs and gold scores as DataFrames with an explicit row key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from embgauge.sources.catalogue import Catalogue
from embgauge.sources.tsv import FORMAT, read_records


TSV_OPTIONS = {**FORMAT, "header": True}


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tab-separated file with a header; quoted fields may hold line ends. Without a schema all
    columns are strings, named by the header; nothing is inferred. A file is one task: ``read_records`` reads it in blocks."""
    reader = spark.read.options(**TSV_OPTIONS, multiLine=True, mode="FAILFAST")
    return (reader.schema(schema) if schema else reader).csv(path)


def with_row_ids(df: DataFrame, column: str = "row_id", first: list[str] = ()) -> DataFrame:
    """Number keyless rows once, at load: by the columns ``first``, then file name, then file position.

    A row's index within its file block plus the rows of all earlier blocks; only one count per
    block is shuffled. Call it on a freshly read table and write the result before joining on it.
    """
    block = [*first, "_path", "_start", "_part"]
    tagged = df.withColumns(
        {
            "_path": F.input_file_name(),
            "_start": F.input_file_block_start(),
            "_part": F.spark_partition_id(),
            "_id": F.monotonically_increasing_id(),
        }
    )
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*block)
        .agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
        .select(*block, "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    kept = [c for c in df.columns if c not in first]
    return tagged.join(F.broadcast(offsets), block).select(
        (F.col("_offset") + F.col("_id") - F.col("_first")).alias(column), *kept
    )


def read_dataset(spark: SparkSession, name: str, catalogue: Catalogue, schema: str = "text string, label int") -> DataFrame:
    """One dataset as ``(dataset, split, side, row_id, <schema columns>)``.

    A keyless TSV is read in blocks and gets ``row_id`` by position, counted over its splits together; a Parquet
    entry must carry ``row_id`` itself. Where the entry asks for it, rows are dealt out by ``row_id``, which
    a later aggregation by that key reuses.
    """
    entry = catalogue[name]
    keyed = "row_id" in [*T.StructType.fromDDL(schema).names, *(entry.columns or ())]
    parts, seen = [], 0
    for number, (split, path) in enumerate(entry.files.items()):
        ids = []
        if entry.format == "parquet":
            part = spark.read.parquet(path)
        elif keyed:
            part = read_tsv(spark, path, schema)
        else:
            part, count = read_records(spark, path, schema, "row_id", seen)
            ids, seen = ["row_id"], seen + count
        if entry.columns:
            part = part.select(*ids, *[F.col(theirs).alias(ours) for ours, theirs in entry.columns.items()])
        parts.append(part.withColumns({"split": F.lit(split), "_number": F.lit(number)}))
    rows = reduce(DataFrame.unionByName, parts)
    if "row_id" not in rows.columns:
        rows = with_row_ids(rows, first=["_number"])
    if entry.spread:
        rows = rows.repartition("row_id")
    rest = [c for c in rows.columns if c not in ("row_id", "split", "_number")]
    return rows.select(
        F.lit(entry.base_name).alias("dataset"),
        "split",
        F.lit(entry.side).cast("int").alias("side"),
        "row_id",
        *rest,
    )


def read_scores(spark: SparkSession, path: str, key: str = "pair_id") -> DataFrame:
    """Gold scores of a pair dataset, one column ``score``, keyed by position."""
    return read_records(spark, path, "score double", key)[0]


def read_pair_labels(spark: SparkSession, train: str, test: str) -> DataFrame:
    """Pair labels of both splits stacked, train first: ``(pair_id, split, label)``."""
    parts, seen = [], 0
    for split, path in (("train", train), ("test", test)):
        rows, count = read_records(spark, path, "score int", "pair_id", seen)
        parts.append(rows.select("pair_id", F.lit(split).alias("split"), F.col("score").alias("label")))
        seen += count
    return parts[0].unionByName(parts[1])


def apply_contract(df: DataFrame, aliases: dict | None = None) -> DataFrame:
    """Check and order columns: ``text`` string, ``label`` integer, every other column floating.

    ``row_id``, ``dataset``, ``split`` and ``side`` are keys, not features. The label cast is an
    ANSI cast, so a label that is no number fails the job.
    """
    # Fixed value: the other name under which text columns come.
    for old, new in (aliases or {"SMILES": "text"}).items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    for needed in ("text", "label"):
        if needed not in df.columns:
            raise ValueError(f"column {needed!r} is missing")
    if not isinstance(df.schema["text"].dataType, T.StringType):
        raise ValueError("column 'text' must be a string")
    keys = [c for c in ("dataset", "split", "side", "row_id") if c in df.columns]
    features = [c for c in df.columns if c not in ("text", "label", *keys)]
    floating = (T.FloatType, T.DoubleType)
    for name in features:
        kind = df.schema[name].dataType
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, floating):
            raise ValueError(f"column {name!r} must be floating point")
    return df.select(*keys, "text", F.col("label").cast("int").alias("label"), *features)
