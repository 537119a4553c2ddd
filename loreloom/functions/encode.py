"""Arrow UDFs: Unicode folding and the pluggable text encoder."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An encoder turns a list of texts into a (n, dim) float32 matrix.
Encoder = Callable[[list[str]], np.ndarray]
EncoderFactory = Callable[[], Encoder]

DEFAULT_DIM = 256


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def nfkc(c: Column) -> Column:
    return _nfkc(c)


def hashing_encoder(dim: int = DEFAULT_DIM) -> EncoderFactory:
    """Signed feature hashing of lower-case words, unit length; blank text is the zero vector.

    A word's place is its MD5: the first eight hex digits modulo *dim*, the ninth gives the sign. Any engine can repeat that.
    """

    def build() -> Encoder:
        import hashlib
        import re

        word = re.compile("[^\\x20\\x09-\\x0d]+")

        @lru_cache(maxsize=1 << 18)
        def place(w: str) -> int:
            """Slot, plus *dim* for a negative sign."""
            h = hashlib.md5(w.encode()).hexdigest()
            return int(h[:8], 16) % dim + (0 if h[8] >= "8" else dim)

        def encode(texts: list[str]) -> np.ndarray:
            words = [word.findall(t.lower()) for t in texts]
            rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
            # Every distinct word of the batch is hashed once.
            codes, distinct = pd.factorize(np.array(list(chain.from_iterable(words)), dtype=object))
            places = np.array([place(w) for w in distinct], np.int64)[codes]
            counts = np.bincount(rows * 2 * dim + places, minlength=len(texts) * 2 * dim).reshape(len(texts), 2, dim)
            out = (counts[:, 0] - counts[:, 1]).astype(np.float64)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            np.divide(out, norms, out=out, where=norms > 0)
            return out.astype(np.float32)

        return encode

    return build


def dense_encoder(factory: EncoderFactory | None = None, batch_size: int | None = None):
    """Iterator pandas UDF text -> array<float>; the encoder is built once per Python worker.

    Texts are ordered by length inside a batch so that a model pads as little as possible; a model is given 32 texts at
    a time unless told otherwise, the hashing encoder 1,024. The
    result can be registered by name: ``spark.udf.register("encode", dense_encoder())``.
    """
    make = factory or hashing_encoder()
    size = batch_size or (32 if factory else 1_024)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for batch in batches:
            texts = batch.fillna("").tolist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            out: list = [None] * len(texts)
            for start in range(0, len(order), size):
                part = order[start : start + size]
                for i, vector in zip(part, encode([texts[i] for i in part])):
                    out[i] = vector
            yield pd.Series(out)

    return encode_text
