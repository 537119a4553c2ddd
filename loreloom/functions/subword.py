"""A sub-word tokenizer: the best path through the lattice of a vocabulary's pieces.

A word is white space's next neighbour with a word mark in front; every piece that matches somewhere in it is an edge of
its lattice, and the path of least total cost gives the tokens (of paths of one cost, that whose last pieces are longer).
Tokens never cross white space, so token counts of texts add up and a text can be counted, cut and joined anywhere
between words.

One Arrow pass writes the borders of the tokens into the text (``mark``): a word mark at the start of each word and a
joint between its tokens. Everything after that is column expressions on marked text: ``Pieces.tokenizer`` plugs into the
chunkers, counts, windows and truncation, and ``unmark`` takes the borders out again. So chunking by sub-words
stays in the JVM, and a text is tokenized once however often its parts are counted. A token keeps its borders when the
word it belongs to is cut.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loreloom.functions.text import Tokenizer

WORD_MARK, JOINT = "▁", "\u2060"
REMEMBERED = 4 << 20  # characters of the words of a generation that a worker remembers; two generations are kept
MARKED_AT_ONCE = 1 << 20  # characters of the texts marked at once, if a text is not longer
LEARNED_AT_ONCE = 1 << 18  # characters of the words whose lattices are walked side by side, if a word is not longer
UNIT = 1_000_000  # costs are whole numbers of this share, so that sums do not depend on their order
UNKNOWN = 10 * UNIT  # what a character outside the vocabulary costs beyond the dearest piece
FAR = 1 << 60
_WORD = re.compile(r"\S+")
_TOKEN = rf"(?U)[^\s\x1c-\x1f{JOINT}]+"

MARKED = Tokenizer(
    encode=lambda c: F.regexp_extract_all(c, F.lit(f"({_TOKEN})")),
    decode=lambda a: F.replace(F.array_join(a, JOINT), F.lit(JOINT + WORD_MARK), F.lit(" " + WORD_MARK)),
    count=lambda c: F.regexp_count(c, F.lit(_TOKEN)),
    additive=True,
)


def piece_costs(model: bytes) -> dict[str, int]:
    """Costs of the pieces of a SentencePiece model: minus the log-probabilities of a unigram model.

    The scores of a merge-type model are ranks; Zipf's law turns rank r of n into the probability 1 / (r ln n).
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = [sp.get_score(i) for i in ids]
    if all(s == int(s) for s in scores):
        rank = {s: r for r, s in enumerate(sorted(set(scores), reverse=True), 1)}
        scores = [-math.log(rank[s] * math.log(len(ids))) for s in scores]
    return {sp.id_to_piece(i): round(-s * UNIT) for i, s in zip(ids, scores, strict=True)}


class Lattice:
    """Pieces as a trie in sorted columns, walked for many words at once."""

    def __init__(self, costs: dict[str, int]):
        self.longest = max(map(len, costs), default=1)
        self.unknown = max(costs.values(), default=0) + UNKNOWN
        nodes: dict[tuple[int, int], int] = {}
        cost = [FAR]
        for piece in sorted(costs):
            node = 0
            for ch in piece:
                node = nodes.setdefault((node, ord(ch)), len(cost))
                if node == len(cost):
                    cost.append(FAR)
            cost[node] = costs[piece]
        steps = sorted((n << 21 | c, to) for (n, c), to in nodes.items())
        self.keys = np.array([k for k, _ in steps], np.int64)
        self.to = np.array([t for _, t in steps], np.int64)
        self.cost = np.array(cost, np.int64)

    def _next(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = node << 21 | code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def borders(self, words: list[str]) -> np.ndarray:
        """Whether a token ends before each character of the words in a row; words are not empty."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in words])
        start = np.cumsum(lengths) - lengths
        # best[p + word]: cost of the cheapest path to place p of a word, each word with one place more than characters.
        base = start + np.arange(len(words))
        best, back = np.full(len(codes) + len(words), FAR), np.zeros(len(codes) + len(words), np.int64)
        best[base] = 0
        order = np.argsort(-lengths, kind="stable")
        alive = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0) + 1), "left")  # words longer than a place
        for place in range(int(lengths.max(initial=0))):
            own = order[:alive[place]]
            here, char, left = base[own] + place, start[own] + place, lengths[own] - place
            # A character by itself, known or not.
            dear = best[here] + self.unknown
            better = dear < best[here + 1]
            best[here[better] + 1], back[here[better] + 1] = dear[better], 1
            node = np.zeros(len(own), np.int64)
            for size in range(1, min(self.longest, int(left.max(initial=0))) + 1):
                node = self._next(node, codes[char + size - 1])
                stay = (node >= 0)
                cost = np.where(stay, best[here] + self.cost[node], FAR)
                # Earlier starts come first, so of equal costs the longer last piece stays.
                better = cost < best[here + size]
                best[here[better] + size], back[here[better] + size] = cost[better], size
                stay &= left > size
                if not stay.any():
                    break
                node, here, char, left = node[stay], here[stay], char[stay], left[stay]
        border = np.zeros(len(codes) + len(words), bool)
        at = base + lengths
        while len(at):
            at = at - back[at]
            border[at] = True
            at = at[back[at] > 0]
        inside = np.ones(len(border), bool)
        inside[base + lengths] = False
        return border[inside]


def bounded(texts: list, most: int) -> Iterator[list]:
    """*texts* in order, in lists of at most *most* characters or one text."""
    part, size = [], 0
    for t in texts:
        n = len(t) if t else 0
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


class Marker:
    """Writes token borders into texts; broadcast, so that a Python worker keeps its lattice and the words it has met."""

    def __init__(self, costs: dict[str, int]):
        self.costs, self.lattice = costs, None

    def __getstate__(self):
        return {"costs": self.costs, "lattice": None}

    def prepare(self) -> Marker:
        if self.lattice is None:
            self.lattice, self.new, self.old, self.held = Lattice(self.costs), {}, {}, 0
        return self

    def learn(self, words: list[str]) -> None:
        marked = [WORD_MARK + w for w in words]
        text = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) for w in marked])
        border = self.lattice.borders(marked)
        border[np.cumsum(lengths) - lengths] = False
        out = np.insert(text, np.flatnonzero(border), ord(JOINT)).tobytes().decode("utf-32-le")
        ends = np.cumsum(lengths + np.add.reduceat(border, np.cumsum(lengths) - lengths)).tolist()
        self.new.update((w, out[a:b]) for w, a, b in zip(words, [0, *ends], ends))

    def mark(self, texts: list[str | None]) -> list[str | None]:
        clean = [t if t is None else t.replace(WORD_MARK, " ").replace(JOINT, " ") for t in texts]
        if self.held > REMEMBERED:
            self.new, self.old, self.held = {}, self.new, 0
        unseen = []
        for w in set().union(*(_WORD.findall(t) for t in clean if t)):
            if w not in self.new:
                self.held += len(w)
                if w in self.old:
                    self.new[w] = self.old[w]
                else:
                    unseen.append(w)
        for part in bounded(unseen, LEARNED_AT_ONCE):
            self.learn(part)
        known = self.new
        return [t if t is None else _WORD.sub(lambda m: known[m[0]], t) for t in clean]


class Pieces:
    """The tokenizer of a vocabulary: ``mark`` a text column, use ``tokenizer`` on it, ``unmark`` what comes out."""

    tokenizer = MARKED

    def __init__(self, spark: SparkSession, costs: dict[str, int]):
        shared = spark.sparkContext.broadcast(Marker(costs))

        @F.pandas_udf("string")
        def mark(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            marker = shared.value.prepare()
            for batch in batches:
                for part in bounded([None if t is None else t for t in batch], MARKED_AT_ONCE):
                    yield pd.Series(marker.mark(part), dtype=object)

        self.mark = mark

    @staticmethod
    def unmark(c: Column) -> Column:
        return F.translate(c, WORD_MARK + JOINT, "")

    @staticmethod
    def tokens(c: Column) -> Column:
        """Tokens of marked text, the first of a word with the word mark."""
        return MARKED.encode(c)


def pieces_of(spark: SparkSession, model_file: str) -> Pieces:
    """The tokenizer of a SentencePiece file; the file is read on the driver and travels with the tasks."""
    with open(model_file, "rb") as f:
        return Pieces(spark, piece_costs(f.read()))
