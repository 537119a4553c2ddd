"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words and their heads of four and five bytes, hashed; a text is the set of its terms.
The score is the logistic of bias + linear weights + pairwise products of the terms' factors, so a pair such
as an insult with a group's name has a weight of its own beside those of its parts.

The machine is fitted on the driver by AdaGrad on a bounded sample: the ``SAMPLE`` learnable labelled rows with
the smallest hash of their id. All counts of terms in that sample decide which terms the machine knows.

Defined results: null and empty texts have no terms and score the logistic of the bias; labels that are null or
contradict each other for one id are left out (any 1 wins over 0); without labels of both classes every score
is the share of label 1, or 0 without labels; repeated rows are scored each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import Words, buffer_of, fresh, give_back, id_remainder, mix, row_chunks
from loreloom.session import cut_lineage

SAMPLE = 12_000  # labelled rows the machine is fitted on, at most
SPACE = 1 << 18  # hashed terms
FACTORS = 4
EPOCHS = 12
THRESHOLD = 0.7
PARTS, HELD_OUT = 3, 1
LEAST, CHI = 3, 15.0  # a term the machine knows: in so many texts of the sample, and so dependent on the label
CHUNK = 1 << 20  # bytes of text worked on at once
HEADS = (4, 5)
BREAKS = bytes(b for b in range(128) if not chr(b).isalpha())


class Terms:
    """Distinct hashed terms of texts."""

    def __init__(self):
        self.words = Words(BREAKS, CHUNK)

    def of(self, raw: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of every distinct term, by row and term; *known* restricts the terms."""
        keys = [np.empty(0, np.int64)]
        for first, last in row_chunks(offsets, CHUNK):
            part, ends = raw[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
            row, start, stop, word = self.words.find(part, ends)
            letters = np.append(self.words.lower[part], np.zeros(max(HEADS), np.uint8))
            found = [word]
            for length in HEADS:
                head = np.full(len(start), length, np.uint64)
                for k in range(length):
                    head = (head << np.uint64(8)) | letters[start + k]
                found.append(np.where(stop - start >= length, mix(head), word))
            for hashes in found:
                term = (hashes >> np.uint64(64 - SPACE.bit_length() + 1)).astype(np.int64)
                use = slice(None) if known is None else known[term]
                keys.append((row[use] + first) * SPACE + term[use])
        key = np.unique(np.concatenate(keys))
        return key // SPACE, key % SPACE


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Machine:
    """bias, linear weights and factors by term."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray, known: np.ndarray):
        self.bias, self.weights, self.factors, self.known = bias, weights, factors, known

    def scores(self, rows: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        total = self.bias + np.bincount(row, self.weights[term], rows)
        size = np.maximum(np.bincount(row, minlength=rows), 1)
        for factor in self.factors:
            v = factor[term]
            total += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows)) / size
        return logistic(total)


def telling(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The terms that depend on the label, by the chi-square of their counts over the whole sample."""
    count = lambda picked: np.bincount(np.concatenate([np.empty(0, np.int64), *picked]), minlength=SPACE).astype(float)
    both, toxic, n, ones = count(docs), count([d for d, y in zip(docs, labels, strict=True) if y]), max(len(docs), 1), labels.sum()
    expected = both * ones / n
    chi = (toxic - expected) ** 2 / np.maximum(expected * (1 - ones / n) * (1 - both / n), 1e-9)
    return (both >= LEAST) & (chi > CHI)


def fit(docs: list[np.ndarray], labels: np.ndarray, *, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """A machine from the terms and labels of the sample."""
    rng = np.random.default_rng(seed)
    known = telling(docs, labels)
    weights, v = np.zeros(SPACE), rng.normal(0, 0.02, (factors, SPACE)) * known
    share = labels.mean() if len(labels) else 0.0
    if not 0 < share < 1:
        return Machine(40.0 if share else -40.0, weights, 0 * v, np.zeros(SPACE, bool))
    bias, gw, gv, gb = float(np.log(share / (1 - share))), np.full(SPACE, 1e-6), np.full((factors, SPACE), 1e-6), 1e-6
    docs = [d[known[d]] for d in docs]
    size = np.array([max(len(d), 1) for d in docs])
    rate, hold, batch = 0.1, 1e-5, 64
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), batch):
            pick = order[at:at + batch]
            term = np.concatenate([docs[i] for i in pick])
            row = np.repeat(np.arange(len(pick)), [len(docs[i]) for i in pick])
            used, place = np.unique(term, return_inverse=True)
            n, of = size[pick], v[:, used]
            here = of[:, place]
            sums = np.stack([np.bincount(row, h, len(pick)) for h in here])
            squares = np.stack([np.bincount(row, h * h, len(pick)) for h in here])
            score = bias + np.bincount(row, weights[term], len(pick)) + (0.5 * (sums ** 2 - squares) / n).sum(0)
            error = logistic(score) - labels[pick]
            step = np.bincount(place, error[row], len(used)) + hold * len(pick) * weights[used]
            gw[used] += step ** 2
            weights[used] -= rate * step / np.sqrt(gw[used])
            pull = np.stack([np.bincount(place, (error / n)[row] * (s[row] - h), len(used)) for s, h in zip(sums, here, strict=True)]) + hold * len(pick) * of
            gv[:, used] += pull ** 2
            v[:, used] -= 0.5 * rate * pull / np.sqrt(gv[:, used])
            gb += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(gb)
    return Machine(bias, weights, v, known)


def sample_of(labels: DataFrame, learnable: Column, doc_id: str = "doc_id", label: str = "toxic", *, most: int = SAMPLE) -> DataFrame:
    """At most *most* labelled ids, those with the smallest hash."""
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & learnable)
    return (rows.groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__label"))
            .orderBy(F.xxhash64("__id"), "__id").limit(most))


def learn(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text", *, most: int = SAMPLE) -> Machine:
    """Fit a machine on the texts of the sample; at most *most* ids, so the sample may be broadcast and its terms collected."""
    sample = cut_lineage(sample)
    # Of rows with one id, the text with the smallest hash stands for it.
    texts = (docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(sample), "__id"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            raw, offsets = buffer_of(batch.column(2))
            row, term = terms.of(raw, offsets)
            parts = np.split(term.astype(np.int32), np.searchsorted(row, np.arange(1, len(batch))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p.tobytes() for p in parts], pa.binary())], ["id", "label", "terms"])
            del raw, offsets, row, term, parts
            give_back()

    kind = docs.schema[doc_id].dataType.simpleString()
    read_in = texts.select("__id", "__label", "__text").mapInArrow(read, f"id {kind}, label int, terms binary")
    rows = read_in.groupBy("id").agg(F.max("label").alias("label"), F.min("terms").alias("terms")).orderBy("id").collect()
    return fit([np.frombuffer(r.terms, np.int32).astype(np.int64) for r in rows], np.array([r.label for r in rows], float))


def scored(docs: DataFrame, machine: Machine, text: str, out: str) -> DataFrame:
    """*docs* with the column *out*, the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        machine = shared.value
        raw, offsets = buffer_of(texts)
        row, term = Terms().of(raw, offsets, machine.known)
        scores = pa.array(machine.scores(len(texts), row, term), pa.float64())
        del raw, offsets, row, term
        give_back()
        return scores

    return docs.withColumn(out, score(F.coalesce(F.col(text), F.lit(""))))


def toxic_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", *,
                 parts: int = PARTS, held_out: int = HELD_OUT, threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted; nothing is learned from the labels of held-out ids."""
    machine = learn(docs, sample_of(labels, id_remainder(doc_id, parts) != held_out, doc_id, label, most=most), doc_id, text, most=most)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (id_remainder(doc_id, parts) == held_out).alias("held_out"), F.col(text).alias("__text"))
    return scored(rows, machine, "__text", "score").drop("__text").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", *,
               parts: int = PARTS, held_out: int = HELD_OUT, threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """*docs* without those predicted toxic, all columns as they were."""
    machine = learn(docs, sample_of(labels, id_remainder(doc_id, parts) != held_out, doc_id, label, most=most), doc_id, text, most=most)
    score = fresh(docs, "__score")
    return scored(docs, machine, text, score).where(F.col(score) < threshold).drop(score)
