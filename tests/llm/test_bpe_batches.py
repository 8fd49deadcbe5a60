"""Ids of whole Arrow batches."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from parcelyard.llm import byte_bpe


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.loaded(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("most", [1, 20, 1_000_000])
def test_lists_equal_single_texts(codec, monkeypatch, most):
    monkeypatch.setattr(byte_bpe, "BATCH_CHARS", most)
    texts = [None, "", "One line.\nAnother, 12 345 words.", "åäö 北京 \U0001f600", None, "x" * 50, " "]
    for rows in (texts, texts[:2], []):
        got = byte_bpe.id_lists(codec, pa.array(rows, pa.string()))
        assert got.type.value_type == pa.int32()
        assert got.to_pylist() == [np.frombuffer(codec.encode([t or ""])[0], "<i4").tolist() for t in rows]
    part = byte_bpe.id_lists(codec, pa.array(texts, pa.string()).slice(2, 2))
    assert part.to_pylist() == byte_bpe.id_lists(codec, pa.array(texts, pa.string())).to_pylist()[2:4]


def test_a_batch_is_never_all_pythons(codec, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BATCH_CHARS", 20_000)
    rows = pa.array([f"word {i % 9} and so on, " * 200 for i in range(2_000)], pa.string())
    byte_bpe.id_lists(codec, rows.slice(0, 50))
    tracemalloc.start()
    ids = byte_bpe.id_lists(codec, rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.5 * 4 * len(ids.values) + 2_000_000
