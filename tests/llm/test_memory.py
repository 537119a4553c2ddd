"""What workers hold on to, and how many files the stages write."""

import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from loreloom import session
from loreloom.llm import mixing, ngram_join, packing
from loreloom.llm.common import give_back

SPLITS = 60


@pytest.fixture
def many_parts(spark):
    """As many partitions as the session asks for, whatever they hold."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(SPLITS))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def held() -> int:
    """MB of this process without mapped files."""
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024


def test_freed_memory_goes_back():
    kept = [pa.array(np.arange(1 << 13)).take(pa.array(np.arange(1 << 13))) for _ in range(3_000)]  # 64 KB each
    kept = kept[::1_000]
    before = held()
    give_back()
    assert held() < before - 100 and all(len(k) == 1 << 13 for k in kept)


def test_encoder_gives_back_after_every_chunk(monkeypatch):
    calls = []
    monkeypatch.setattr(packing, "give_back", lambda: calls.append(1))
    encoder = packing.Encoder(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")).prepare()
    texts = pa.array(["plain text of a few words", None, "日本語"])
    assert encoder.lean(texts) == encoder.encode(texts) and len(calls) == 1


def test_rounds_write_few_files(many_parts, skewed_docs, monkeypatch):
    """Tables of a few hundred rows are not written in as many files as the session has shuffle partitions."""
    files, parts = [], []
    keep, cut = session.Scratch.keep, ngram_join.cut_lineage

    def kept(self, df, *how, **more):
        table = keep(self, df, *how, **more)
        if more.get("bounded", True):  # pairs are as many as there are
            files.append(len(table.inputFiles()))
        return table

    def lineage(df):
        out = cut(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    want = {r.doc_id for r in ngram_join.drop_near_copies(skewed_docs).collect()}
    monkeypatch.setattr(session.Scratch, "keep", kept)
    monkeypatch.setattr(ngram_join, "cut_lineage", lineage)
    out = ngram_join.drop_near_copies(skewed_docs)
    cores = many_parts.sparkContext.defaultParallelism
    assert {r.doc_id for r in out.collect()} == want
    assert files and max(files) <= cores and max(parts) <= cores and out.rdd.getNumPartitions() <= max(cores, 5)


def test_small_tables_of_mixing_and_packing(many_parts, skewed_docs, monkeypatch):
    parts = []
    for module in (mixing, packing):
        cut = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=cut: (out := cut(df), parts.append(out.rdd.getNumPartitions()))[0])
    few = max(many_parts.sparkContext.defaultParallelism, 5)
    mixed = mixing.mixed(skewed_docs)
    packed = packing.packed(skewed_docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert mixed.rdd.getNumPartitions() <= few and packed.rdd.getNumPartitions() <= few and max(parts) <= few
    assert packed.count() == len({(r.doc_id, r.piece) for r in packed.collect()})


def test_stages_gather_small_splits(many_parts, skewed_docs, tmp_path):
    skewed_docs.repartition(SPLITS).write.parquet(str(tmp_path / "docs"))
    many_parts.conf.set("spark.sql.files.openCostInBytes", "1g")  # a split for each file
    try:
        docs = many_parts.read.parquet(str(tmp_path / "docs"))
        assert docs.rdd.getNumPartitions() == SPLITS
        cores = many_parts.sparkContext.defaultParallelism
        assert session.gathered(docs, "text").rdd.getNumPartitions() == cores
        assert session.gathered(docs, "text", 1).rdd.getNumPartitions() == SPLITS  # enough text for every split
        alone = corpus_pipeline.without_copies(many_parts, docs, "")
        assert alone.rdd.getNumPartitions() <= 2 * cores
        assert alone.count() == len({r.text for r in skewed_docs.collect()})
    finally:
        many_parts.conf.unset("spark.sql.files.openCostInBytes")
