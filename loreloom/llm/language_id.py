"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Every language has a probability for each piece; a word's
probability is the sum over all its segmentations into pieces, by the forward algorithm. Piece probabilities are
learned by expectation maximisation on the word counts of a bounded sample: at most ``SAMPLE`` texts of each
language, those with the smallest hash. A text's score adds up its words; its language is the likeliest.

Words are runs of letters in lower case, all of them, each in parts of at most ``PART`` letters. Defined results:
null texts and texts without a letter are ``und`` with score 0; ties go to the first language in code-point order;
without learnable rows every text is ``und``; repeated rows are predicted each; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.llm.common import Words, buffer_of, id_remainder, mix, row_chunks
from loreloom.llm.token_counts import SPACE
from loreloom.session import cut_lineage

SAMPLE = 400  # texts of each language, at most
BROADCAST_LANGUAGES = 10_000  # rows of the broadcast table of languages, at most; more are joined by a shuffle
PARTS, HELD_OUT = 5, 0
PART = 32  # letters of a word scored together, far from the limits of double precision
LONGEST = 12  # characters of a piece
ROUNDS = 4
SMOOTH, UNKNOWN = 0.05, 1e-4  # count added to every piece; probability of a letter that no piece holds
CACHE = 400_000  # words a worker remembers
UND = "und"
CHUNK = 1 << 20  # bytes of text worked on at once
BREAKS = bytes(b for b in range(128) if not chr(b).isalpha())
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-case words, each in parts; the first part of a word starts with the vocabulary's space mark."""
    return [p for w in LETTERS.findall(text.lower()) if any(map(str.isalpha, w)) for p in parts_of(w)]


def parts_of(word: str) -> list[str]:
    return [SPACE + word] if len(word) <= PART else [(SPACE if at == 0 else "") + word[at:at + PART] for at in range(0, len(word), PART)]


def vocabulary(model: bytes) -> dict[str, int]:
    """The pieces of a SentencePiece model that can be part of a lower-case word, numbered."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    kept = sorted(p for p in pieces if len(p) <= LONGEST and p == p.lower() and p.strip(SPACE).isalpha() or p == SPACE)
    return {p: i for i, p in enumerate(kept)}


class Pieces:
    """The vocabulary by the hashes of its pieces, so that all substrings of many words are looked up at once."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    BITS = 20

    def __init__(self, numbers: dict[str, int]):
        self.count = len(numbers)
        names = list(numbers)
        codes, start, size = self.codes(names)
        sums, inverse = self.sums(codes)
        keys = mix((sums[start + size] - sums[start]) * inverse[start])
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], np.array([numbers[n] for n in names], int)[order]
        self.perhaps = np.zeros(1 << self.BITS, bool)
        self.perhaps[keys >> np.uint64(64 - self.BITS)] = True

    @staticmethod
    def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all words in a row; first place and length of each word."""
        size = np.array([len(w) for w in words], int)
        return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.cumsum(size) - size, size

    def sums(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of a polynomial in the code points, and the inverse powers that move a place to the front."""
        power = np.cumprod(np.append(np.ones(1, np.uint64), np.full(len(codes), self.BASE)))
        back = np.uint64(pow(int(self.BASE), -1, 1 << 64))
        inverse = np.cumprod(np.append(np.ones(1, np.uint64), np.full(len(codes), back)))
        return np.append(np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * power[:-1])), inverse

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, -1 for none."""
        out = np.full(len(keys), -1)
        at = np.flatnonzero(self.perhaps[keys >> np.uint64(64 - self.BITS)])
        place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        hit = self.keys[place] == keys[at]
        out[at[hit]] = self.numbers[place[hit]]
        return out


class Lattice:
    """All ways to cut words into pieces: arcs (word, from, to, piece), by the position where they end."""

    def __init__(self, words: list[str], pieces: Pieces):
        codes, start, self.size = pieces.codes(words)
        sums, inverse = pieces.sums(codes)
        word = np.repeat(np.arange(len(words)), self.size)
        begin = np.arange(len(codes)) - start[word]
        left = self.size[word] - begin
        arcs = []
        for length in range(1, LONGEST + 1):
            at = np.flatnonzero(left >= length)
            piece = pieces.find(mix((sums[at + length] - sums[at]) * inverse[at]))
            if length == 1:
                piece[piece < 0] = pieces.count  # an unknown letter
            at, piece = at[piece >= 0], piece[piece >= 0]
            arcs.append(np.stack([word[at], begin[at], begin[at] + length, piece], 1))
        table = np.concatenate(arcs)
        self.by_end = table[np.argsort(table[:, 2].astype(np.int16), kind="stable")]
        self.cuts = np.searchsorted(self.by_end[:, 2], np.arange(self.size.max(initial=0) + 2))

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """prob: languages x pieces. Probability of each word's every head, languages x words x positions."""
        words, longest = len(self.size), self.size.max(initial=0)
        alpha = np.zeros((len(prob), words, longest + 1))
        alpha[:, :, 0] = 1
        for end in range(1, longest + 1):
            w, begin, _, piece = self.by_end[self.cuts[end]:self.cuts[end + 1]].T
            for a, p in zip(alpha, prob, strict=True):
                a[:, end] = np.bincount(w, a[w, begin] * p[piece], words)
        return alpha

    def expected(self, prob: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, the words weighed by their counts; one language."""
        alpha = self.forward(prob[None])[0]
        beta = np.zeros_like(alpha)
        beta[np.arange(len(self.size)), self.size] = 1
        uses = np.zeros(len(prob))
        total = alpha[np.arange(len(self.size)), self.size]
        for end in range(alpha.shape[1] - 1, 0, -1):
            w, begin, _, piece = self.by_end[self.cuts[end]:self.cuts[end + 1]].T
            onward = prob[piece] * beta[w, end]
            uses += np.bincount(piece, alpha[w, begin] * onward / total[w] * times[w], len(prob))
            np.add.at(beta, (w, begin), onward)
        return uses


def fit(words: list[str], times: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Piece probabilities of one language; the last is that of an unknown letter."""
    prob = np.full(pieces.count + 1, 1 / pieces.count)
    prob[-1] = UNKNOWN
    lattice = Lattice(words, pieces)
    for _ in range(ROUNDS):
        uses = lattice.expected(prob, times)[:-1] + SMOOTH
        prob[:-1] = uses / uses.sum()
    return prob


class Scorer:
    """Broadcast, so that a Python worker keeps the words it has scored over all its tasks.

    Texts are cut at ASCII characters that are no letters; each distinct piece between them is scored once.
    """

    def __init__(self, languages: list[str], prob: np.ndarray, pieces: Pieces):
        self.languages, self.prob, self.pieces, self.finder = languages, prob, pieces, None
        self.forget()

    def __getstate__(self):
        return self.__dict__ | {"finder": None, "known": {}, "logs": self.logs[:0], "letters": self.letters[:0]}

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.logs, self.letters = np.zeros((0, len(self.languages))), np.zeros(0, bool)

    def learn(self, hashes: list[int], raw: list[str]) -> None:
        """Score raw words: the sums over their lower-case words, and whether they have any."""
        split = [words_of(w) for w in raw]
        flat = [p for parts in split for p in parts]
        logs = np.zeros((len(raw), len(self.languages)))
        of = np.repeat(np.arange(len(raw)), [len(parts) for parts in split])
        for at in range(0, len(flat), 20_000):
            part = flat[at:at + 20_000]
            lattice = Lattice(part, self.pieces)
            last = lattice.forward(self.prob)[:, np.arange(len(part)), lattice.size]
            np.add.at(logs, of[at:at + len(part)], np.log(last).T)
        self.known.update(zip(hashes, range(len(self.known), len(self.known) + len(raw)), strict=True))
        self.logs, self.letters = np.concatenate([self.logs, logs]), np.append(self.letters, [len(parts) > 0 for parts in split])

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if self.finder is None:
            self.finder = Words(BREAKS, CHUNK)
        raw, offsets = buffer_of(texts)
        total, spoke = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        for first, last in row_chunks(offsets, CHUNK) if self.languages else ():
            part, ends = raw[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
            row, start, stop, hashes = self.finder.find(part, ends)
            distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.known) > CACHE:
                self.forget()
            keys = distinct.tolist()
            fresh = [i for i, h in enumerate(keys) if h not in self.known]
            self.learn([keys[i] for i in fresh], [part[start[at[i]]:stop[at[i]]].tobytes().decode() for i in fresh])
            place = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[inverse]
            for i in range(len(self.languages)):
                total[first:last, i] = np.bincount(row, self.logs[place, i], last - first)
            spoke[first:last] = np.bincount(row, self.letters[place], last - first) > 0
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts))
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.languages[b] if s else UND for b, s in zip(best, spoke, strict=True)], np.where(spoke, score, 0.0)


def learn(rows: DataFrame, model: bytes, text: str, lang: str, doc_id: str, *, most: int = SAMPLE) -> Scorer:
    """Fit a scorer on at most *most* texts of each language; the languages are fitted side by side."""
    keyed = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id)).alias("h"), F.col(text).alias("text"))
    counts = cut_lineage(keyed.groupBy("lang").agg(F.count("*").alias("n")))
    beside = F.broadcast(counts) if counts.count() <= BROADCAST_LANGUAGES else counts
    # About 1.5 times the sample by a threshold on the hash, so that the exact choice sorts few rows.
    share = F.col("h").cast("double") / F.lit(2.0**64) + 0.5 < (1.5 * most + 50) / F.col("n")
    chosen = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    sample = keyed.join(beside, "lang").where(share).withColumn("r", F.row_number().over(chosen)).where(F.col("r") <= most)
    pieces = Pieces(vocabulary(model))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            seen = Counter((lang, w) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                                              pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    def fit_one(table: pa.Table) -> pa.Table:
        words = sorted(zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True))
        prob = fit([w for w, _ in words], np.array([n for _, n in words], float), pieces)
        return pa.table({"lang": table["lang"][:1], "prob": pa.array([prob.tobytes()], pa.binary())})

    words = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    fitted = sorted(cut_lineage(words).groupBy("lang").applyInArrow(fit_one, "lang string, prob binary").collect(), key=lambda r: r.lang.encode())
    prob = np.stack([np.frombuffer(r.prob) for r in fitted]) if fitted else np.zeros((0, pieces.count + 1))
    return Scorer([r.lang for r in fitted], prob, pieces)


def languages(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", *,
              parts: int = PARTS, held_out: int = HELD_OUT, most: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; nothing is learned from held-out ids."""
    with open(model_file, "rb") as f:
        model = f.read()
    out: Column = id_remainder(doc_id, parts) == held_out
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs.where(~out), model, text, lang, doc_id, most=most))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = shared.value.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), out.alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
