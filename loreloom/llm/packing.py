"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``CAPACITY`` tokens; only longer documents are cut, from the end, so
their first piece may be shorter. Pieces of one length are interchangeable, so the bins are chosen on the
histogram of lengths, at most ``CAPACITY`` rows whatever the corpus: the longest piece left opens a bin, a
bitset subset-sum over the lengths available finds the fullest feasible combination, and the combination
is removed as often as the counts allow. Pieces are then numbered inside their length (in blocks, so a hot
length is no single task) and find their bin and place by number.

Defined results: null texts are empty and pack their end token; repeated rows are pieces of their own; an
empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreloom.llm.common import buffer_of, give_back, slices
from loreloom.session import cut_lineage, in_few_parts

CAPACITY = 1_024
END = 2
CACHE = 300_000  # words that a worker remembers between chunks
CHUNK = 4 << 20  # bytes of text split at once
JOINED = 256  # words encoded in one row
ROWS = 32  # rows encoded in one call
BLOCK = 512  # pieces of one length numbered together
# The tokenizer's own split (contractions, letters, digits, others, white space) is made for characters
# on which all versions of Unicode agree. Texts with others are encoded whole.
LETTER, DIGIT = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
WHITE = "\t-\r \x85\xa0   "
UNUSUAL = "[^\\x00-ɏ‐-‧   ‰-⁞]"
BETWEEN = "\ue000"  # an unusual character
SPACE, QUOTE = 32, 39
KINDS = np.array([next((k for k, kind in enumerate((WHITE, LETTER, DIGIT)) if re.match(f"[{kind}]", chr(c))), 3) for c in range(0x2060)], np.uint8)
ONE, TWO = list(b"stmd"), [256 * a + b for a, b in (b"re", b"ve", b"ll")]  # contractions behind a quote


def kinds(raw: np.ndarray) -> np.ndarray:
    """Per byte of usual texts the kind of its character: 0 white space, 1 letter, 2 digit, 3 other."""
    kind = KINDS[raw]
    wide = np.flatnonzero(raw >= 0xC0)
    lead = raw[wide].astype(np.int64)
    two, three = wide[lead < 0xE0], wide[lead >= 0xE0]
    kind[two] = kind[two + 1] = KINDS[(lead[lead < 0xE0] & 31) << 6 | raw[two + 1] & 63]
    low = (raw[three + 1].astype(np.int64) & 63) << 6 | raw[three + 2] & 63
    kind[three] = kind[three + 1] = kind[three + 2] = KINDS[(lead[lead >= 0xE0] & 15) << 12 | low]
    return kind


def word_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pre-tokens of usual texts, in order."""
    n, kind = len(raw), kinds(raw)
    first = np.ones(n + 3, bool)  # of a text
    first[:n] = False
    first[offsets] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # The last character of white space stands alone before a word, or belongs to it if it is a space.
    word = np.flatnonzero((kind[1:] != 0) & (kind[:-1] == 0)) + 1
    word = word[~first[word]]
    last = word - 1
    for _ in range(2):
        last = last - (raw[last] & 0xC0 == 0x80)
    start[last] = True
    start[word[raw[last] == SPACE]] = False
    quote = np.flatnonzero((raw == QUOTE) & start[:n])
    quote = quote[~first[quote + 1]]
    one = quote[np.isin(raw[quote + 1], ONE)]
    quote = quote[~first[quote + 2]]
    two = quote[np.isin(raw[quote + 1].astype(np.int64) << 8 | raw[quote + 2], TWO)]
    start[one + 1] = start[two + 1] = False
    start[one + 2] = start[two + 3] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Token ids as little-endian 32-bit words; each distinct pre-token of a chunk is looked up once, and encoded if not remembered.

    Broadcast, so that a Python worker keeps its tokenizer and what it has encoded over all its tasks.
    """

    def __init__(self, definition: str):
        self.definition = definition
        self.tokenizer = None

    def __getstate__(self):
        return {"definition": self.definition, "tokenizer": None}

    def prepare(self) -> Encoder:
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer, pre_tokenizers

            self.tokenizer = Tokenizer.from_str(self.definition)
            self.library = self.tokenizer.pre_tokenizer
            self.split = pre_tokenizers.Sequence([
                pre_tokenizers.Split(BETWEEN, "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
            vocabulary = self.tokenizer.get_vocab()  # a character of a token stands for a byte
            self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.bytes[i] = len(token)
            self.known, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
            self.asked, self.chunks = np.empty(0, np.int64), 0  # the chunk that last asked for a word
        return self

    def tokens(self, texts: list[str], pre_tokenizer) -> list[np.ndarray]:
        self.tokenizer.pre_tokenizer = pre_tokenizer
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of pre-tokens; many go in one call and are cut by their bytes."""
        rows = pa.LargeListArray.from_arrays(np.append(np.arange(0, len(words), JOINED), len(words)), words)
        rows = pc.binary_join(rows, pa.scalar(BETWEEN, words.type))
        calls = (rows.slice(at, ROWS).to_pylist() for at in range(0, len(rows), ROWS))
        ids = np.concatenate([ids for call in calls for ids in self.tokens(call, self.split)])
        ends = np.cumsum(pc.binary_length(words).to_numpy())
        cuts = 4 * np.append(0, np.searchsorted(np.cumsum(self.bytes[ids]), ends, "right"))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])

    def forget(self) -> None:
        """Keeps the words asked for last."""
        if len(self.known) > CACHE:
            kept = np.sort(np.argpartition(self.asked, -CACHE)[-CACHE:])
            self.known, self.ids, self.asked = self.known.take(pa.array(kept)), self.ids.take(pa.array(kept)), self.asked[kept]

    def places(self, words: pa.LargeStringArray) -> np.ndarray:
        """Where the distinct *words* stand among the known ones; those that were not there are learned."""
        self.forget()
        found = pc.index_in(words, value_set=self.known)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            unseen = words.filter(found.is_null())
            at[at < 0] = len(self.known) + np.arange(len(unseen))
            self.known, self.ids = pa.concat_arrays([self.known, unseen]), pa.concat_arrays([self.ids, self.encoded(unseen)])
            self.asked = np.append(self.asked, np.zeros(len(unseen), np.int64))
        self.chunks += 1
        self.asked[at] = self.chunks
        return at

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, UNUSUAL)
        for special in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, special))
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.tokens([texts[i].as_py()], self.library)[0].tobytes()
        usual = pc.invert(whole)
        for i, found in zip(np.flatnonzero(usual.to_numpy(zero_copy_only=False)).tolist(), self.usual(texts.filter(usual)), strict=True):
            out[i] = found
        return out

    def lean(self, texts: pa.Array) -> list[bytes]:
        """As `encode`; what the chunk took besides its ids and the words remembered goes back to the system."""
        ids = self.encode(texts)
        give_back()
        return ids

    def usual(self, texts: pa.Array) -> list[bytes]:
        """Texts cut into pre-tokens; each distinct one is looked up once for all texts."""
        raw, offsets = buffer_of(texts)
        if not len(raw):
            return [b""] * len(texts)
        starts = word_starts(raw, offsets)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw))
        numbered = words.dictionary_encode()
        at = self.places(numbered.dictionary)
        found = self.ids.take(pa.array(at[numbered.indices.to_numpy()]))
        ends, ids = np.frombuffer(found.buffers()[1], np.int64), memoryview(found.buffers()[2])
        cuts = ends[np.searchsorted(starts, offsets)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def pieces(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", *, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(Encoder(f.read()))
    closing = array("I", [end]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.prepare()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            encoded = (ids + closing for part in slices(batch.column(1), CHUNK) for ids in encoder.lean(part))
            for i, ids in enumerate(encoded):
                n = len(ids) // 4
                for k, at in enumerate(range(n % capacity - capacity if n % capacity else 0, n, capacity)):
                    first, last = max(at, 0), at + capacity
                    row.append(i), piece.append(k), start.append(first), length.append(last - first), crc.append(zlib.crc32(ids[4 * first:4 * last]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of the combination of the available lengths that fills *room* best, long pieces first."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        times = min(counts[length], room // length)
        if not times:
            continue
        steps.append((length, times, reach))
        part = 1
        while times:
            take = min(part, times)
            reach |= (reach << (take * length)) & mask
            times -= take
            part *= 2
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, []
    for length, times, before in reversed(steps):
        used = next(k for k in range(times + 1) if left >= k * length and before >> (left - k * length) & 1)
        if used:
            chosen.append((length, used))
            left -= used * length
    return chosen


def bins(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first number, times in a bin, first bin, offset): pieces of a length from that number on, until the next row's."""
    counts = {length: n for length, n in histogram.items() if n}
    used, rows, first_bin = dict.fromkeys(counts, 0), [], 0
    while counts:
        longest = max(counts)
        rest = {length: n - (length == longest) for length, n in counts.items()}
        combination = dict(fullest(rest, capacity - longest))
        combination[longest] = combination.get(longest, 0) + 1
        repeat = min(counts[length] // times for length, times in combination.items())
        offset = 0
        for length, times in sorted(combination.items(), reverse=True):
            rows.append((length, used[length], times, first_bin, offset))
            offset += times * length
            used[length] += times * repeat
            counts[length] -= times * repeat
            if not counts[length]:
                del counts[length]
        first_bin += repeat
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def numbered(rows: DataFrame, histogram: DataFrame) -> DataFrame:
    """*rows* with __number, gapless from 0 inside each length."""
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    blocks = rows.join(F.broadcast(histogram.select("length", F.ceil(F.col("n") / BLOCK).alias("__blocks"))), "length").withColumn("__h", order)
    blocks = blocks.withColumn("__block", F.pmod("__h", "__blocks")).drop("__blocks")
    ahead = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("length", "__block").agg(F.count("*").alias("__n")).select(
        "length", "__block", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("length", "__block").orderBy("__h", "doc_id", "piece", "start")
    ranked = blocks.withColumn("__rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["length", "__block"]).withColumn("__number", F.col("__start") + F.col("__rank")).drop("__block", "__h", "__start", "__rank")


def pack(rows: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """*rows* (one per piece, with its length) with sequence_id and offset."""
    rows = cut_lineage(rows)
    histogram = cut_lineage(in_few_parts(rows.groupBy("length").agg(F.count("*").alias("n")), capacity))  # at most one row per length
    counts = {r.length: r.n for r in histogram.collect()}
    plan = rows.sparkSession.sparkContext.broadcast(bins(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, number):
        import pandas as pd

        length, number, table = length.to_numpy(), number.to_numpy(), plan.value
        row = table[np.searchsorted((table[:, 0] << 48) + table[:, 1], (length << 48) + number, "right") - 1]
        nth = number - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + nth // row[:, 2], "offset": row[:, 4] + nth % row[:, 2] * length})

    placed = in_few_parts(numbered(rows, histogram), sum(counts.values())).withColumn("__at", place("length", "__number"))
    return placed.select(*rows.columns, "__at.sequence_id", "__at.offset")


def packed(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", *, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer_file, doc_id, text, capacity=capacity, end=end), capacity=capacity)
