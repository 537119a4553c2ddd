"""Token counts of a SentencePiece BPE model by the whole-token shortcut.

Offline, two things are proved from the vocabulary: (1) no piece holds a space mark behind another character
and none holds a line feed, so no merge crosses the start of a pre-token (a run of spaces with what follows,
or a line feed with what follows) and pre-tokens encode independently; (2) which vocabulary strings encode
alone as exactly one token. Counting then looks pre-tokens up among the proven strings and merges only the
rest, each distinct one once per worker. A model without property (1) has its texts encoded whole.

Defined results: null counts as the empty text, which has 0 tokens; ids are carried as they are, repeated
or null; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import text_chunks

SPACE = "▁"  # how the model writes a space
CHUNK = 1 << 20  # bytes of text split at once
CACHE = 600_000  # pre-tokens a worker remembers
LIMIT = 4_096
PRE_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")


def prove(model: bytes) -> tuple[bool, frozenset[str]]:
    """Whether pre-tokens encode independently, and the pre-tokens proven to be one token."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
    # The checks on blanks guard the assumption that the model adds one space in front and keeps all others.
    apart = apart and sp.encode("a b", out_type=str) == sp.encode("a", out_type=str) + sp.encode("b", out_type=str)
    apart = apart and sp.encode(" \nb") == sp.encode(" ") + sp.encode("\nb")[1:] if apart else False
    words = [p[1:] for p in pieces if p[0] == SPACE and len(p) > 1 and p[1] != SPACE]
    alone = sp.encode(words)
    return apart, frozenset(w for w, ids in zip(words, alone, strict=True) if ids == [pieces[SPACE + w]])


class Counter:
    """Counts tokens of texts from counts of their pre-tokens.

    Broadcast, so that a Python worker keeps its model and what it has merged over all its tasks.
    """

    def __init__(self, model: bytes):
        self.model, (self.apart, self.proven) = model, prove(model)
        self.sp, self.known = None, {}

    def __getstate__(self):
        return self.__dict__ | {"sp": None, "known": {}}

    def prepare(self) -> Counter:
        if self.sp is None:
            from sentencepiece import SentencePieceProcessor

            self.sp = SentencePieceProcessor(model_proto=self.model)
            self.known = dict.fromkeys(self.proven, 1)
        return self

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens without the space mark that each carries in front; those behind a line feed carry none and keep it."""
        text = text.replace(SPACE, " ")
        easy = text.replace("\n", " \n")
        if "  " in easy or easy[0] == " " or easy[-1] == " ":
            return [p[1:] if p[0] == " " else p for p in PRE_TOKEN.findall(" " + text)]
        return easy.split(" ")

    def merged(self, words: list[str]) -> None:
        """Let the library merge pre-tokens not known yet."""
        blank = len(self.sp.encode("a"))
        asked = [w if w.strip(" ") else "a " + w for w in words]
        for word, text, ids in zip(words, asked, self.sp.encode(asked, num_threads=1), strict=True):
            self.known[word] = len(ids) - (blank if text is not word else word[0] == "\n")

    def count(self, texts: list[str]) -> list[int]:
        if not self.apart or any("\0" in t for t in texts):
            return [len(ids) for ids in self.sp.encode(texts, num_threads=1)] if texts else []
        split = [self.pre_tokens(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known = dict.fromkeys(self.proven, 1)
        self.merged(list(set().union(*split) - self.known.keys()))
        known = self.known.__getitem__
        return [sum(map(known, words)) for words in split]


def token_counts(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", *, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit. The model travels with the tasks; executors need no file."""
    with open(model_file, "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(Counter(model))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value.prepare()
        for batch in batches:
            ns = [n for part in text_chunks(batch.column(2), CHUNK) for n in counter.count(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array([n > limit for n in ns], pa.bool_())],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
