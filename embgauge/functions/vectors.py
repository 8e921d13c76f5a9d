"""Column functions on vectors, ``array<float>`` or ``array<double>``.

Vectors are stored, shuffled and handed to Arrow as they are; arithmetic is in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F, types as T

from embgauge.functions.kernels import to_matrix


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(vector) -> Column:
    return _col(vector).cast("array<double>")


def assemble(columns) -> Column:
    """Wide numeric columns to one vector."""
    return F.array(*[_col(c).cast("double") for c in columns])


def abs_diff(a, b) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: F.abs(x - y))


def hadamard(a, b) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)


def add(a, b) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x - y)


def pair_features(a, b) -> Column:
    """``[|a - b| ; a * b]``, width 2d."""
    return F.concat(abs_diff(a, b), hadamard(a, b))


def cosine_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosine of two matrices; a zero vector gives 0."""
    norms = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
    dots = np.einsum("ij,ij->i", x, y)
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


@F.arrow_udf(T.DoubleType())
def _cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(cosine_of(to_matrix(a), to_matrix(b)))


@F.arrow_udf(T.DoubleType())
def _euclidean(a: pa.Array, b: pa.Array) -> pa.Array:
    gap = to_matrix(a) - to_matrix(b)
    return pa.array(np.sqrt(np.einsum("ij,ij->i", gap, gap)))


def cosine(a, b) -> Column:
    return _cosine(_col(a), _col(b))


def euclidean(a, b) -> Column:
    return _euclidean(_col(a), _col(b))


def mean_vector(vector) -> Column:
    """Aggregate: element-wise mean, partially aggregated on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_doubles(vector))))


def mean_by_entry(vector, width: int) -> Column:
    """Aggregate: element-wise mean of vectors of one width, by numbers that a hash aggregation holds.

    Missing vectors, missing entries and other widths fail.
    """
    v = _col(vector)
    wrong = F.raise_error(f"a vector is missing, holds nulls or has another width than {width}").cast("double")
    entries = [F.coalesce(F.get(v, F.lit(i)).cast("double"), wrong) for i in range(width)]
    if entries:
        entries[0] = F.when(F.size(v) == width, entries[0]).otherwise(wrong)
    return F.array(*[F.avg(entry) for entry in entries]).cast("array<double>")


def vector_at_most(vector, order, width: int) -> Column:
    """Aggregate: the vector where ``order`` is greatest, by numbers that a hash aggregation holds."""
    v = _col(vector)
    whole = F.array(*[F.max_by(F.get(v, F.lit(i)), _col(order)) for i in range(width)])
    found = F.max_by(F.size(v), _col(order))
    wrong = F.raise_error(f"a vector has another width than {width}")
    return F.when(found == width, whole).when(found >= 0, F.array(wrong.cast("double")))


def sum_vector(vector) -> Column:
    """Aggregate: element-wise sum, partially aggregated on the map side."""
    return vector_to_array(Summarizer.sum(array_to_vector(as_doubles(vector))))


def at_places(value: Column, places: int = 6) -> Column:
    """Rounded for comparison; adding zero folds -0.0 into 0.0."""
    return F.round(value, places) + F.lit(0.0)
