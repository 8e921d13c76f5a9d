"""An order of hashed tokens by how often they repeat, from counts over all rows in a table of fixed size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Size of the table of ``repeat_levels``, and how many tokens it marks at most.
REPEAT_BITS, MARKED = 22, 1 << 18


def repeats(tokens: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The tokens that occur more than once, as longs, and how often.

    Of a token in f of the corpus' sets, dealt over b blocks, about f^2 / 2b pairs meet in a block: what would make
    many candidates is seen in some blocks, what would make few in none.
    """
    tokens = np.sort(tokens)
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(tokens)))
    many = count > 1
    return pa.array(tokens[first[many]].view(np.int64)), pa.array(count[many])


def repeat_levels(counts: DataFrame) -> np.ndarray:
    """Levels for ``ranked`` from ``(token, n)`` of all blocks: half octaves of the sums; tokens not marked have 0.

    The table marks the most frequent tokens, whole levels of them; it places tokens in an order and drops none.
    """
    level = F.least(F.floor(2 * F.log2(F.sum("n"))), F.lit(63)).cast("int")
    tokens = counts.groupBy("token").agg(level.alias("level"))
    by_level = dict(tokens.groupBy("level").count().collect())
    lowest, held = 64, 0
    while lowest > 1 and held + by_level.get(lowest - 1, 0) <= MARKED:
        lowest -= 1
        held += by_level.get(lowest, 0)
    bucket = F.shiftrightunsigned("token", 64 - REPEAT_BITS).cast("int")
    marked = tokens.where(F.col("level") >= lowest).groupBy(bucket.alias("bucket")).agg(F.max("level").alias("level"))
    marked = marked.toArrow()
    out = np.zeros(1 << REPEAT_BITS, np.uint8)
    out[marked["bucket"].to_numpy()] = marked["level"].to_numpy()
    return out


def ranked(tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Tokens as 64-bit numbers whose order is (level, hash): rare ones first. Equal tokens stay equal."""
    bits = len(level).bit_length() - 1
    high = level[(tokens >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    return (high << np.uint64(58)) | (tokens >> np.uint64(6))
