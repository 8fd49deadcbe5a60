"""Each stage of the pipeline against plain Python on its own input."""

import public_tokenizers

import corpus_pipeline as pipeline
from parcelyard.llm import byte_bpe

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert set(pipeline.COLUMNS) <= set(docs.columns)
    assert len(seen["language"]) > 150
    lines = [x.strip() for r in seen["lines"].values() for x in r.text.split("\n") if x.strip()]
    assert len(lines) == len(set(lines)) and all(len(r.text) == r.n_chars for r in seen["lines"].values())
    words = {i: r.text.lower().split() for i, r in seen["near_duplicates"].items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    ids = sorted(sets)
    assert not [(a, b) for n, a in enumerate(ids) for b in ids[:n] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    bench = [r.text.lower() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not [i for i, r in seen["decontaminated"].items() if any(b in r.text.lower() for b in bench)]
    codec = byte_bpe.loaded(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in seen["encoded"].values():
        import numpy as np

        assert codec.decode(np.array(r.ids, "<u4").tobytes()).decode() == r.text


def test_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
