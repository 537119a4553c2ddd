"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"  # runs of anything but ASCII white space


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name no column of *df* clashes with, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def utf8_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def crc32_text(text: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))


def id_remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo *parts*; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def strings(column: pa.Array) -> list[str]:
    """Python strings of a text column, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column in one array, and the offsets of its rows (null is empty)."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return raw, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of many texts at once, as 64-bit hashes of their bytes.

    *breaks* are the bytes between words. ASCII letters count as lower case. A word's hash is a polynomial in
    random values of its bytes, mixed; it is the same in any text, task or process.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, breaks: bytes, most: int):
        kind = np.arange(256, dtype=np.uint8)
        kind[65:91] += 32
        self.lower = kind
        self.value = mix(kind.astype(np.uint64) + np.uint64(1))
        self.inside = np.ones(256, bool)
        self.inside[list(breaks)] = False
        self.value[~self.inside] = 0
        self.most = most  # bytes of the largest chunk
        self.power = self._powers(self.BASE)
        self.inverse = self._powers(np.uint64(pow(int(self.BASE), -1, 1 << 64)))

    def _powers(self, base: np.uint64) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.most, base)]))

    def find(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first byte, end and hash of every word, in order."""
        inside = self.inside[raw]
        borders = np.diff(inside, prepend=False, append=False)
        cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]  # two texts without a break between them
        cut = np.unique(cut[inside[cut - 1] & inside[cut]])
        edges = np.flatnonzero(borders)
        start, stop = np.sort(np.append(edges[::2], cut)), np.sort(np.append(edges[1::2], cut))
        if not len(start):
            return np.empty(0, np.int64), start, stop, np.empty(0, np.uint64)
        if len(raw) > self.most:
            self.__init__(bytes(np.flatnonzero(~self.inside).tolist()), len(raw))
        sums = np.add.reduceat(self.value[raw] * self.power[:len(raw)], start)
        return np.searchsorted(offsets, start, "right") - 1, start, stop, mix(sums * self.inverse[start])


def give_back() -> None:
    """Return what was freed to the system, as a worker's other tasks, of any stage, run beside it for as long as the job.

    Arrow's pool and the C library keep freed memory for themselves; where the library cannot trim, nothing happens.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def row_chunks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about *size* bytes each."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end
        at = end


def slices(column: pa.Array, size: int) -> Iterator[pa.Array]:
    """Whole texts of a column in slices of about *size* bytes."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for first, last in row_chunks(np.concatenate([[0], np.cumsum(lengths)]), size):
        yield column.slice(first, last - first)


def text_chunks(column: pa.Array, size: int) -> Iterator[list[str]]:
    """Whole texts of a column in lists of about *size* bytes, so that few texts are Python strings at a time."""
    return map(strings, slices(column, size))


class Remembered:
    """What was learned of words, in two generations: a word not asked for while a generation fills up is forgotten.

    A generation ends with *most* words, so at most about twice as many are kept.
    """

    def __init__(self, learn: Callable[[list[str]], list], most: int):
        self.learn, self.most = learn, most
        self.new: dict = {}
        self.old: dict = {}

    def of(self, words: Iterable[str]) -> Callable:
        """A look-up that knows all of the distinct *words*."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        unseen = []
        for word in words:
            if word not in new:
                if word in old:
                    new[word] = old[word]
                else:
                    unseen.append(word)
        if unseen:
            new.update(zip(unseen, self.learn(unseen), strict=True))
        return new.__getitem__
