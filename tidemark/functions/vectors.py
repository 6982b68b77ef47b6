"""Hash vectors and cosine scores as columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidemark.functions.text import words

DEFAULT_DIMS = 384


def hash_slots(tokens: list[str], dims: int) -> np.ndarray:
    """Slots of tokens: the first four digest bytes as a little-endian number, mod ``dims``."""
    return np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "little") % dims for t in tokens], dtype=np.int64)


def unit_vectors(texts: pa.Array, dims: int) -> pa.Array:
    """Dense unit vectors of token lists by counts per slot; no tokens give the zero vector. Each
    distinct token of a batch is hashed once."""
    coded = texts.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    slot = hash_slots(coded.dictionary.to_pylist(), dims)[coded.indices.to_numpy(zero_copy_only=False)]
    counts = np.bincount(owner * dims + slot, minlength=len(texts) * dims).reshape(len(texts), dims)
    norms = np.sqrt(np.maximum((counts * counts).sum(axis=1), 1).astype(np.float64))
    values = (counts / norms[:, None]).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dims, pa.int32()), pa.array(values.ravel()))


def hash_embedding(text: Column, dims: int = DEFAULT_DIMS) -> Column:
    """The hash vector of a text. It is made in Python: bind it to a column before it is used twice."""

    def embed(tokens: pa.Array) -> pa.Array:
        return unit_vectors(tokens, dims)

    return F.arrow_udf(embed, ArrayType(FloatType(), False))(words(F.lower(text)))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(
        left, right, lambda a, b: a.cast("double") * b.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda acc, value: acc + value)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors; null when one of them is zero."""
    size = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(size > 0, dot(left, right) / size)


def cosine_score(value: Column) -> Column:
    """Map a cosine from [-1, 1] to the engine's score scale [0, 1]."""
    return (value + 1) / 2
