"""The corpus pipeline: every stage works on what the one before kept, and its decisions take effect."""

from __future__ import annotations

import re

import corpus_pipeline
import public_tokenizers
from moodloom.llm import mixing, pii
from test_jaccard import expected as groups
from test_operators import plain_spans

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    quality, single, clean, mixed, pieces = kept
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) >= 50 for r in quality)
    want = groups([(r.doc_id, r.text) for r in quality])
    assert sorted(r.doc_id for r in single) == sorted({c for _, _, c in want})
    before = {r.doc_id: r.text for r in single}
    assert sorted(before) == sorted(r.doc_id for r in clean)
    for r in clean:
        assert plain_spans(r.text) == [] or plain_spans(before[r.doc_id])
        assert r.text == before[r.doc_id] or plain_spans(before[r.doc_id]) or "[" in r.text
        assert not plain_spans(before[r.doc_id]) or any(f"[{k.upper()}]" in r.text for k in pii.KINDS)
    frame = spark.createDataFrame(clean)
    taken = {r.doc_id: r.times for r in mixing.mixed_words(frame).collect()}
    times = {d: sum(r.doc_id == d for r in mixed) for d in taken}
    assert times == taken
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(p.length for p in pieces) == sum(len(tokens.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    once = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "doc_tokens").collect()))
    assert once and sorted((r.doc_id, r.doc_tokens) for r in docs.where("start = 0").collect()) == sorted((r[0], r[3]) for r in once if r[1] == 0)
