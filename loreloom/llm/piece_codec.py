"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda.

A text starts as single characters. The agenda holds the adjacent pairs of symbols whose join is in the vocabulary; the
pair with the best score, of equal scores the leftmost, is joined, and the pairs with its neighbours enter the agenda.
What is left when the agenda is empty are the pieces; characters outside the vocabulary become byte pieces.

Where the vocabulary proves that no join crosses the start of a run of spaces or of a line feed, texts are cut there and
a worker encodes each distinct part once. Short parts are worked on together, one agenda per part held in columns; each
step joins the best pair of every part. Long parts have a heap and linked symbols of their own, so their work grows as
n log n. Every part learned is checked against the library before it is used, many in one call per Arrow batch; a
difference fails the job.

Defined results: null counts as the empty text, which has no ids and decodes to itself; ids of documents are carried as
they are, repeated or null; columns other than the two named are not read; an empty table gives an empty table. A null
list of ids decodes to null.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import Remembered, text_chunks

SPACE = "▁"  # how the model writes a space
CHUNK = 1 << 20  # bytes of text worked on at once
LONG = 64  # symbols from which a part has its own heap
JOINED = 64  # parts the library encodes in one text for the check
CACHE = 300_000  # parts of a generation that a worker remembers; two generations are kept
PART = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")
NONE = np.int64((1 << 63) - 1)
CODES = 0x110000


class Vocabulary:
    """Pieces, scores and joins of a merge-type model, as arrays."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model, self.sp = model, SentencePieceProcessor(model_proto=model)
        sp, size = self.sp, self.sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        if any(sp.is_unused(i) for i in range(size)):
            raise ValueError("models with unused pieces split them again, which is not covered")
        pieces = {sp.id_to_piece(i): i for i in range(size) if not special[i]}
        self.size = size
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        scores = np.array([sp.get_score(i) for i in range(size)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)  # 0 is joined first
        self.symbol = np.arange(CODES, dtype=np.int64) + size  # of a code point: its piece, or a number beyond all pieces
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        joins = {}
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if (cut == 1 or left in pieces) and (len(right) == 1 or right in pieces):
                    joins[self._of(pieces, left) * (size + CODES) + self._of(pieces, right)] = i
        self.keys = np.array(sorted(joins), np.int64)
        self.joined = np.array([joins[k] for k in self.keys.tolist()], np.int64)
        self.join = joins
        # No join crosses into a run of spaces or to a line feed.
        self.apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p[1:] for p in pieces)
        blank = sp.encode("a")  # the library puts one space in front and keeps all others
        self.plain = sp.encode("a  a", out_type=str) != sp.encode("a a", out_type=str) and sp.id_to_piece(blank[0])[0] == SPACE
        if not self.plain:
            raise ValueError("only models that add one space in front and keep all others are covered")
        self.control = np.array([sp.is_control(i) or sp.is_unknown(i) for i in range(size)])
        self.texts = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        self.decimal = np.frombuffer(b"".join(b"%d," % i + bytes(8 - len(b"%d," % i)) for i in range(size)), np.uint64)

    def _of(self, pieces: dict[str, int], symbol: str) -> int:
        return pieces[symbol] if symbol in pieces else self.size + ord(symbol)

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols join to, or -1."""
        key = left * (self.size + CODES) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], -1)

    def heap(self, symbols: list[int]) -> list[int]:
        """Symbols left of one part: the agenda is a heap of (rank, place, left, right) over linked symbols."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        base, join, rank = self.size + CODES, self.join, self.rank.tolist()
        agenda = [(rank[i], k, a, b) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if (i := join.get(a * base + b)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, k, a, b = heapq.heappop(agenda)
            nxt = after[k]
            if symbols[k] != a or nxt >= len(symbols) or symbols[nxt] != b:
                continue  # one of the two was joined with another
            symbols[k], symbols[nxt] = join[a * base + b], -1
            after[k] = end = after[nxt]
            if end < len(symbols):
                before[end] = k
                if (i := join.get(symbols[k] * base + symbols[end])) is not None:
                    heapq.heappush(agenda, (rank[i], k, symbols[k], symbols[end]))
            if (prior := before[k]) >= 0 and (i := join.get(symbols[prior] * base + symbols[k])) is not None:
                heapq.heappush(agenda, (rank[i], prior, symbols[prior], symbols[k]))
        return [s for s in symbols if s >= 0]

    def columns(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of many parts, and their numbers: every step joins the best pair of each part's agenda."""
        lengths = np.diff(np.append(starts, len(symbols)))
        part = np.repeat(np.arange(len(starts)), lengths)
        gives = np.append(self.found(symbols[:-1], symbols[1:]), -1)
        gives[np.append(starts[1:], len(symbols)) - 1] = -1
        # The agenda of a part is its stretch of the column: the rank of the join, then the place.
        agenda = np.where(gives >= 0, (self.rank[gives] << 32) + np.arange(len(symbols)), NONE)
        place = np.arange(len(symbols))
        done_part, done_symbol = [], []
        while len(symbols):
            first = np.flatnonzero(np.diff(part, prepend=-1))
            best = np.minimum.reduceat(agenda, first)
            sizes = np.diff(np.append(first, len(symbols)))
            if (ended := best == NONE).any():
                gone = np.repeat(ended, sizes)
                done_part.append(part[gone])
                done_symbol.append(symbols[gone])
                symbols, part, gives, agenda, place = (c[~gone] for c in (symbols, part, gives, agenda, place))
                best, sizes = best[~ended], sizes[~ended]
                if not len(symbols):
                    break
            at = np.flatnonzero(agenda == np.repeat(best, sizes))
            symbols[at] = gives[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, part, gives, agenda, place = (c[stay] for c in (symbols, part, gives, agenda, place))
            at = at - np.arange(len(at))
            near = np.concatenate([at, at[at > 0] - 1])
            right = np.minimum(near + 1, len(symbols) - 1)
            new = np.where((near + 1 < len(symbols)) & (part[near] == part[right]), self.found(symbols[near], symbols[right]), -1)
            gives[near] = new
            agenda[near] = np.where(new >= 0, (self.rank[new] << 32) + place[near], NONE)
        if not done_part:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        part, symbol = np.concatenate(done_part), np.concatenate(done_symbol)
        order = np.argsort(part, kind="stable")
        return symbol[order], part[order]

    def ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts in a row, spaces written as the model writes them, and the number of ids of each part."""
        lengths = np.array([len(p) for p in parts], np.int64)
        symbols = self.symbol[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        part = np.repeat(np.arange(len(parts)), lengths)
        short = lengths <= LONG
        mine = short[part]
        inside = lengths[short & (lengths > 0)]
        found, of = self.columns(symbols[mine], np.cumsum(inside) - inside)
        numbers = np.flatnonzero(short & (lengths > 0))
        ids, owner = [found], [numbers[of]]
        begin = np.cumsum(lengths) - lengths
        for i in np.flatnonzero(~short):
            left = self.heap(symbols[begin[i]:begin[i] + lengths[i]].tolist())
            ids.append(np.array(left, np.int64))
            owner.append(np.full(len(left), i))
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        ids, owner = ids[order], owner[order]
        if (ids >= self.size).any():
            ids, times = self.with_bytes(ids)
            owner = np.repeat(owner, times)
        return ids, np.bincount(owner, minlength=len(parts))

    def with_bytes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols outside the vocabulary as byte pieces, or as the unknown id where the model has none; ids of each symbol."""
        times = np.ones(len(symbols), np.int64)
        odd = np.flatnonzero(symbols >= self.size)
        spelled = [[self.bytes[b] for b in chr(s - self.size).encode()] if self.bytes else [self.sp.unk_id()] for s in symbols[odd].tolist()]
        times[odd] = [len(x) for x in spelled]
        ids = np.repeat(symbols, times)
        ids[ids >= self.size] = [i for x in spelled for i in x]
        return ids, times


class Codec:
    """Encodes and decodes; broadcast, so that a Python worker keeps its vocabulary and what it has learned."""

    def __init__(self, model: bytes):
        self.model, self.words = model, None

    def __getstate__(self):
        return {"model": self.model, "words": None}

    def prepare(self) -> Codec:
        if self.words is None:
            self.words = Vocabulary(self.model)
            self.known = Remembered(self.learn, CACHE)
        return self

    def learn(self, parts: list[str]) -> list[bytes]:
        ids, counts = self.words.ids(parts)
        self.check(parts, ids, counts)
        raw, ends = ids.astype(np.uint32).tobytes(), (4 * np.cumsum(counts)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def check(self, parts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Compare with the library, many parts in one text where parts encode apart."""
        step = JOINED if self.words.apart else 1
        # A part of nothing but spaces ends its text, since spaces that follow would join it.
        cuts = sorted({*range(0, len(parts), step), *(i for i, p in enumerate(parts[:-1], 1) if p[-1] == SPACE)})
        texts = ["".join(parts[a:b]) for a, b in zip(cuts, [*cuts[1:], len(parts)])]
        # The library adds a space in front: a text that begins with one is given without it, another loses the added one.
        asked = [t.replace(SPACE, " ")[t[0] == SPACE:] for t in texts]
        added = len(self.words.ids([SPACE])[0])
        sums = np.add.reduceat(counts, cuts).tolist()
        at = 0
        for text, theirs, n in zip(texts, self.words.sp.encode(asked, num_threads=1), sums, strict=True):
            own = ids[at:at + n].tolist()
            at += n
            # An empty text gets no space from the library.
            if text != SPACE and own != (theirs if text[0] == SPACE else theirs[added:]):
                raise ValueError(f"the agenda and the library differ within {text!r}")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit words."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        split = [PART.findall(t) if self.words.apart else [t][:len(t)] for t in marked]
        known = self.known.of(set().union(*split))
        return [b"".join(map(known, parts)) for parts in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces in a row, bytes joined to characters, the space in front removed.

        Encoding yields neither control ids nor bytes that are no character; such lists of ids are left to the library.
        """
        raw = b"".join(map(self.words.texts.__getitem__, ids.tolist()))
        try:
            if len(ids) and not self.words.control[ids].any():
                return raw.decode()[raw[:1] == b" " and not self.words.sp.is_byte(int(ids[0])):]
        except UnicodeDecodeError:
            pass
        return self.words.sp.decode(ids.tolist())

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        raw = self.words.decimal[ids].view(np.uint8)
        return raw[raw != 0].tobytes()[:-1]


def _codec(docs: DataFrame, model_file: str):
    with open(model_file, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(Codec(f.read()))


def encoded(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, ids (list of int). The model travels with the tasks; executors need no file."""
    shared = _codec(docs, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.prepare()
        for batch in batches:
            found = [i for part in text_chunks(batch.column(1), CHUNK) for i in codec.encode(part)]
            offsets = pa.array(np.cumsum([0, *(len(i) // 4 for i in found)]), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, model_file: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: doc_id, text."""
    shared = _codec(rows, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.prepare()
        for batch in batches:
            texts = [None if i is None else codec.decode(np.array(i, np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema[doc_id].dataType.simpleString()
    return rows.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def round_trips(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; encoded and decoded in one pass, neither leaves its worker."""
    shared = _codec(docs, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.prepare()
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for part in text_chunks(batch.column(1), CHUNK):
                for found in codec.encode(part):
                    ids = np.frombuffer(found, np.uint32)
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(codec.decimals(ids)).hexdigest())
                    of_text.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
