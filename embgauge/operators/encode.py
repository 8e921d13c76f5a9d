"""Text to vectors as a batch job, and the encoders that need no model files."""

from __future__ import annotations

import hashlib
import re
import sys
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from embgauge.functions.kernels import to_lists
from embgauge.functions.text import Profile, prepare_text, words
from embgauge.session import keep
from embgauge.sources.embeddings import write_embeddings


def _loaded(name: str, build):
    """The encoder of this Python worker, built once and kept while the worker lives."""
    kept = sys.modules.setdefault("_embgauge_worker", ModuleType("_embgauge_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, build())
    return getattr(kept, name)


def encode(
    df: DataFrame,
    build,
    text_col: str = "text",
    profile: Profile = Profile("plain"),
    out: str = "embedding",
) -> DataFrame:
    """Add ``out`` = encoder(text): each partition streams through the encoder, nothing is grouped.

    ``build()`` runs on the worker and returns an object whose ``encode(texts)`` gives one row per
    text. Texts go in batches of ``profile.batch_size`` after the profile's null rule and prompt.
    """
    others = list(df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    size, name = profile.batch_size, hashlib.md5(cloudpickle.dumps(build)).hexdigest()

    def run(batches):
        encoder = _loaded(name, build)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if any(t is None for t in texts):
                raise ValueError(f"profile {profile.name!r} has no rule for missing text")
            parts = [np.asarray(encoder.encode(texts[i : i + size])) for i in range(0, len(texts), size)]
            if parts:
                columns = [*batch.columns[:-1], to_lists(np.vstack(parts))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    prepared = df.select(*others, prepare_text(F.col(text_col), profile).alias("_prepared"))
    return prepared.mapInArrow(run, schema)


def _ngrams(tokens: list[str], n: int) -> list[str]:
    grams = list(tokens)
    for size in range(2, n + 1):
        grams += map(" ".join, zip(*[tokens[i:] for i in range(size)]))
    return grams


# Bytes of digests that are looked at together.
DIGEST_BYTES = 4 << 20


class HashedNgrams:
    """Signed counts of word n-grams in ``width`` hashed buckets, scaled to unit length."""

    def __init__(self, width: int = 32, n: int = 2):
        self.width, self.n = width, n

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        split, md5 = re.compile(r"[ \t\r\n]+").split, hashlib.md5
        for row, text in enumerate(texts):
            trimmed = text.strip(" \t\r\n")
            grams = _ngrams(split(trimmed), self.n) if trimmed else []
            for start in range(0, len(grams), DIGEST_BYTES // 16):
                digests = b"".join([md5(g.encode()).digest() for g in grams[start : start + DIGEST_BYTES // 16]])
                numbers = np.frombuffer(digests, dtype=">u4").reshape(-1, 4)
                # the bucket by the first eight digits, the sign by the ninth
                bucket, minus = numbers[:, 0] % self.width, numbers[:, 1] >> 31
                cells = np.bincount(bucket + self.width * minus.astype(np.int64), minlength=2 * self.width)
                out[row] += cells[: self.width] - cells[self.width :]
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=out, where=norms > 0)


def hashed_ngrams(width: int = 32, n: int = 2):
    return lambda: HashedNgrams(width, n)


def encode_hashed(
    df: DataFrame, key: str = "row_id", text_col: str = "text", width: int = 32, n: int = 2
) -> DataFrame:
    """The hashed n-gram encoding with built-in functions only: ``(key, embedding)``.

    One aggregation by text and bucket, then one by text; the partial aggregate turns the tokens of a
    text into a row per bucket before the shuffle.
    """
    tokens = words(F.coalesce(F.col(text_col), F.lit("")))
    # word i of a gram stands in its own column, null beyond the text's end, so that grams are put together row by row
    shifted = [F.col("_t").alias("w0")]
    for i in range(1, n):
        left = F.greatest(F.size("_t") - i, F.lit(0))
        shifted.append(F.slice("_t", F.lit(i + 1), left).alias(f"w{i}"))
    placed = df.select(key, tokens.alias("_t")).select(key, F.explode_outer(F.arrays_zip(*shifted)).alias("_w"))
    each = placed.select(key, *[F.col(f"_w.w{i}").alias(f"_w{i}") for i in range(n)])
    grams = [F.col("_w0")]
    for i in range(1, n):
        grams.append(F.when(F.col(f"_w{i}").isNotNull(), F.concat_ws(" ", *[f"_w{j}" for j in range(i + 1)])))
    exploded = each.select(key, F.explode(F.array(*grams)).alias("gram"))
    digest = F.md5(F.col("gram"))
    hashed = exploded.select(
        key,
        (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % width).cast("int").alias("bucket"),
        F.when(F.substring(digest, 9, 1) < "8", 1).otherwise(-1).alias("sign"),
    )
    # one sum for a text's bucket; the buckets of a text, few rows, are set side by side after that
    totals = hashed.groupBy(key, "bucket").agg(F.sum("sign").alias("total"))
    cells = [F.coalesce(F.sum(F.when(F.col("bucket") == i, F.col("total"))), F.lit(0)) for i in range(width)]
    counts = totals.groupBy(key).agg(*[c.cast("double").alias(f"_{i}") for i, c in enumerate(cells)])
    vector = counts.select(key, F.array(*[f"_{i}" for i in range(width)]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return vector.withColumn("norm", norm).select(
        key, F.transform("v", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0)).alias("embedding")
    )


# The vocabulary's vectors are held by the driver and sent to the executors.
MAX_WORD_VECTORS = 100_000_000


def encode_word2vec(
    df: DataFrame,
    key: str = "row_id",
    text_col: str = "text",
    width: int = 32,
    seed: int = 0,
    min_count: int = 5,
    parts: int = 8,
) -> DataFrame:
    """Mean of word vectors learned from the same texts: ``(key, embedding)``.

    The vectors depend on ``parts``, the number of pieces that are learned from at a time.
    """
    tokens = keep(df.select(key, words(F.coalesce(F.col(text_col), F.lit(""))).alias("_t")))
    frequent = tokens.select(F.explode("_t").alias("w")).groupBy("w").count().where(F.col("count") >= min_count).count()
    if frequent * width > MAX_WORD_VECTORS:
        raise ValueError(f"a vocabulary of {frequent} words is too large; raise min_count")
    model = Word2Vec(
        vectorSize=width,
        minCount=min_count,
        seed=seed,
        numPartitions=parts,
        inputCol="_t",
        outputCol="_v",
    ).fit(tokens)
    return model.transform(tokens).select(key, vector_to_array("_v").alias("embedding"))


def encode_sweep(datasets: DataFrame, encoders: dict, root: str, text_col: str = "text") -> None:
    """Encode the union of all datasets with each encoder and write it to the embedding store.

    ``datasets`` carries ``dataset, split, side, row_id``; ``encoders`` maps a profile to a builder.
    """
    for profile, build in encoders.items():
        rows = encode(datasets, build, text_col, profile).withColumn("encoder", F.lit(profile.name))
        write_embeddings(rows, root, "replace")
