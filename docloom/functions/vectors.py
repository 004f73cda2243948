"""Vector functions on array columns and pluggable encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import _col, bind, tokens


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def normalize(a, epsilon: float = 1e-8) -> Column:
    a = _col(a)
    return bind(norm(a) + epsilon, lambda length: F.transform(a, lambda x: x.cast("double") / length))


def quantize_int8(a) -> Column:
    """Struct of a scale and bytes: value ~ code * scale / 127."""
    a = _col(a)
    largest = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))

    def encode_with(scale: Column) -> Column:
        codes = F.transform(a, lambda x: F.when(scale > 0, F.round(x.cast("double") / scale * 127)).otherwise(0).cast("byte"))
        return F.struct(scale.alias("scale"), codes.alias("codes"))

    return bind(largest, encode_with)


def dequantize_int8(q) -> Column:
    q = _col(q)
    return F.transform(q["codes"], lambda c: c.cast("double") * q["scale"] / 127)


def hashed_words(text, dims: int = 64) -> Column:
    """Dense default encoder: hashed word counts, L2-normalised, without leaving the JVM."""
    slots = F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))

    def count(held: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(held, lambda s: s == i)).cast("double")
        )

    return bind(bind(slots, count), normalize)


Encoder = Callable[[pd.Series], pd.Series]


def encode(df: DataFrame, text: str, out: str, encoder: Encoder | None = None, dims: int = 64) -> DataFrame:
    """Add a dense vector column; a model comes in as a batch function on pandas Series.

    The function is called per Arrow batch, so it can load its model once per worker.
    """
    if encoder is None:
        return df.withColumn(out, hashed_words(text, dims))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield encoder(batch)

    return df.withColumn(out, run(F.col(text)))


def sparse_weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse default encoder: rows (key, term, weight) with weight log1p(tf) * idf."""
    words = df.select(key, F.explode(tokens(text)).alias("term")).where(F.col("term") != "")
    tf = words.groupBy(key, "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df"))
    total = df.select(F.count("*").alias("n")).scalar()
    weight = F.log1p(F.col("tf")) * F.log(1 + total / F.col("df"))
    return tf.join(idf, "term").select(key, "term", weight.alias("weight"))


def explode_sparse(df: DataFrame, key: str, sparse: str) -> DataFrame:
    """Rows (key, index, value) of a struct{indices, values} column."""
    pairs = F.arrays_zip(F.col(f"{sparse}.indices").alias("index"), F.col(f"{sparse}.values").alias("value"))
    return df.select(key, F.inline(pairs))
