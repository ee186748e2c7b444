"""Vectors as arrays of doubles: cosine and hashed trigram embeddings."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: Python's \w without the underscore, one or more; the same for Python.
TOKEN = r"([\p{L}\p{N}]+)"
_TOKENS = re.compile(r"[^\W_]+")


def choose_embedder(name: str, configured: dict[str, bool], local: str = "hash") -> str:
    """The embedder of a setting: a name as it is; ``auto`` is the first configured one, else the local hash."""
    return name if name != "auto" else next((k for k, there in configured.items() if there), local)


def by_index(items: Column) -> Column:
    """Vectors of struct(index, embedding) items in the order of their indices."""
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(x["index"].alias("index"), x["embedding"].alias("embedding")))), lambda x: x["embedding"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, zero_norm: float = 1.0) -> Column:
    """0 for empty vectors and unequal dimensions; a norm of zero counts as ``zero_norm``."""
    length = norm(a) * norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable, dot(a, b) / F.when(length == 0, F.lit(zero_norm)).otherwise(length)).otherwise(F.lit(0.0))


def trigrams(text: Column, token: str = TOKEN) -> Column:
    """Trigrams of each lower-case token between ^ and $, in order."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(token), F.lit(1))
    return F.flatten(F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substr(F.concat(F.lit("^"), t, F.lit("$")), i, F.lit(3)))))


def bucket_and_sign(gram: Column, dim: int, digest: str = "md5") -> tuple[Column, Column]:
    """The bucket: the digest's first four bytes, little-endian, modulo the dimension; the sign: parity of the fifth."""
    hexed = F.md5(gram.cast("binary")) if digest == "md5" else F.sha2(gram.cast("binary"), 256)
    swapped = F.concat(*[F.substring(hexed, k, 2) for k in (7, 5, 3, 1)])
    odd = F.conv(F.substring(hexed, 9, 2), 16, 10).cast("int") % 2 == 1
    return (F.conv(swapped, 16, 10).cast("long") % dim).cast("int"), F.when(odd, 1).otherwise(-1)


def hashed_buckets(df: DataFrame, key: str, text: str, dim: int = 512, digest: str = "md5") -> DataFrame:
    """(key, bucket, weight): sums of signs by bucket before normalising; map-side partial sums."""
    grams = df.select(key, F.explode(trigrams(F.col(text))).alias("gram"))
    bucket, sign = bucket_and_sign(F.col("gram"), dim, digest)
    return grams.groupBy(key, bucket.alias("bucket")).agg(F.sum(sign).cast("long").alias("weight"))


def hash_vector(text: str | None, dim: int = 512) -> np.ndarray:
    """The same sums as a unit vector, for one text in Python; a text without tokens is the zero vector."""
    marked = [f"^{token}$" for token in _TOKENS.findall((text or "").lower())]
    digests = b"".join(hashlib.md5(word[i : i + 3].encode()).digest() for word in marked for i in range(len(word) - 2))
    table = np.frombuffer(digests, np.dtype([("bucket", "<u4"), ("parity", "u1"), ("rest", "V11")]))
    sums = np.bincount(table["bucket"] % dim, weights=(table["parity"] & 1) * 2.0 - 1.0, minlength=dim).astype(float)
    length = np.linalg.norm(sums)
    return sums / length if length else sums


def hashed_embedding(text: Column, dim: int = 512) -> Column:
    """A unit vector per row without a shuffle, in an Arrow UDF; nested folds would sum up anew for each bucket."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: hash_vector(x, dim))

    return embed(text)
