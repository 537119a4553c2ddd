import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from loreloom.llm import packing, token_counts

MODEL, JSON = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " a", "a  b", "a \n b", "\n", "\n\nx", " \n \n", "a\n", "  ", "\t\n x\n  y  \n", "a▁b▁▁c", "▁", "日本語 text", "'s it's 'RE  12 ½x", "\x1c\x1dx y", "a　b",
        "<s></s> <unk>", "a\r\nb", "🙂 ok ", "<0x0A>\n<0x0A>", "…“q” — x", " ▁ \n▁", "\u0085 x", "<|endoftext|> a", "a\x00b c"]


def test_counts_are_those_of_the_library(odd_docs, no_docs):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=MODEL)
    got = token_counts.token_counts(odd_docs, MODEL, limit=100).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or "")), len(sp.encode(r.text or "")) > 100) for r in odd_docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(no_docs, MODEL).count() == 0
    counter = token_counts.Counter(open(MODEL, "rb").read()).prepare()
    assert [counter.count([t])[0] for t in HARD] == [len(sp.encode(t)) for t in HARD]


def test_whole_tokens_are_proven():
    counter = token_counts.Counter(open(MODEL, "rb").read()).prepare()
    assert counter.apart and len(counter.proven) > 10_000
    assert all(len(ids) == 1 for ids in counter.sp.encode(sorted(counter.proven)))


def test_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 3)
    counter = token_counts.Counter(open(MODEL, "rb").read()).prepare()
    for _ in range(3):
        assert counter.count(["qqzz xxyy", "zzxx qqzz"]) == [len(i) for i in counter.sp.encode(["qqzz xxyy", "zzxx qqzz"])]


def test_ids_are_those_of_the_library(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    encoder = packing.Encoder(open(JSON, encoding="utf-8").read()).prepare()
    for size in (600_000, 2):
        monkeypatch.setattr(packing, "CACHE", size)
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(HARD)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in HARD]


def test_pre_tokens_are_those_of_the_library(monkeypatch):
    import random

    from tokenizers import Tokenizer

    parts = [*" \n\t\x85\xa0\u2028\u202f\x1c_ªéßɏ½²…–“×a1.,", "  ", "\r\n", "'", "''", "'s", "'S", "'t", "'re", "'ve", "'ll", "'l", "'r", "s", "re", "ll", "Word", "23", "!?"]
    odd, r = [*parts, *"日🙂\u3000\u2009\u0301\ue000", "<|endoftext|>"], random.Random(11)
    tokenizer = Tokenizer.from_file(JSON)
    encoder = packing.Encoder(open(JSON, encoding="utf-8").read()).prepare()
    for size in (300_000, 3):
        monkeypatch.setattr(packing, "CACHE", size)
        for _ in range(600):
            texts = ["".join(r.choices(parts if r.random() < 0.9 else odd, k=r.randrange(14))) for _ in range(r.randrange(1, 12))]
            got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
            assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_words_cost_little_beside_the_library(monkeypatch):
    """20,000 words before nine signs, none of which the encoder has met."""
    import random
    import time

    from tokenizers import Tokenizer

    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "false")
    r = random.Random(3)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randrange(2, 9))) for _ in range(20_000)]
    texts = [" ".join(r.choice(words) + r.choice([*",.;:!?\n", ".\n", "),"]) for _ in range(500)) for _ in range(400)]
    took = {"library": [], "encoder": []}
    for _ in range(3):
        tokenizer = Tokenizer.from_file(JSON)
        encoder = packing.Encoder(open(JSON, encoding="utf-8").read()).prepare()
        begin = time.process_time()
        want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        middle = time.process_time()
        got = encoder.encode(texts)
        took["library"].append(middle - begin), took["encoder"].append(time.process_time() - middle)
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == want
    assert min(took["encoder"]) < 0.25 * min(took["library"])


@pytest.mark.parametrize("name", ["odd_docs", "skewed_docs", "no_docs"])
def test_packing(request, name):
    from tokenizers import Tokenizer

    docs, capacity = request.getfixturevalue(name), 64
    tokenizer = Tokenizer.from_file(JSON)
    rows = packing.packed(docs, JSON, capacity=capacity).collect()
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.1 * total / capacity + 1


def test_fullest_against_all_combinations():
    import itertools
    import random

    r = random.Random(5)
    for _ in range(100):
        counts = {r.randrange(1, 20): r.randrange(1, 4) for _ in range(4)}
        room = r.randrange(0, 40)
        sums = [sum(k * t for k, t in zip(counts, times, strict=True)) for times in itertools.product(*[range(n + 1) for n in counts.values()])]
        chosen = packing.fullest(counts, room)
        assert sum(k * t for k, t in chosen) == max(s for s in sums if s <= room)
        assert all(t <= counts[k] for k, t in chosen)


def test_bins_use_every_piece_once():
    histogram = {1024: 5, 1000: 7, 600: 11, 424: 9, 24: 3, 1: 50}
    table = packing.bins(histogram)
    taken = defaultdict(int)
    for length, first, *_ in table.tolist():
        assert first == 0 or first <= histogram[length]
        taken[length] += 1
    assert set(taken) == set(histogram) and len(packing.bins({})) == 0
