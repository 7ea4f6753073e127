"""Memory of Python workers: what the encoder holds of a block, and that functions of groups give memory back."""

import inspect
import tracemalloc

import public_tokenizers as P
import pytest

import corpus_pipeline
from fluvial.llm import bpe, common


def test_encoder_holds_each_distinct_chunk_once():
    codec = bpe.Codec(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    texts = [" ".join(f"river{(i * k) % 97}" for k in range(2_000)) for i in range(200)]  # 400,000 chunks, 97 different
    want = codec.encode(texts[:1])
    tracemalloc.start()
    got = codec.encode(t for t in texts)
    peak = tracemalloc.get_traced_memory()[1] - sum(map(len, got))
    tracemalloc.stop()
    assert got[:1] == want
    assert peak < 12_000_000  # a string for each chunk alone has over 22 MB


def test_functions_of_groups_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    one, two = common.relieved(lambda a: a + 1), common.relieved(lambda a, b: a // b)
    assert [len(inspect.getfullargspec(f).args) for f in (one, two)] == [1, 2]  # Spark reads the kind of function off that
    assert (one(1), two(6, 3), len(given)) == (2, 2, 2)
    with pytest.raises(ZeroDivisionError):
        two(1, 0)
    assert len(given) == 3


def test_pipeline_encodes_in_small_blocks(monkeypatch, spark):
    seen = {}
    monkeypatch.setattr(bpe, "encode_documents", lambda *a, **options: seen.update(options))
    corpus_pipeline.encode(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "")
    assert seen["block_chars"] <= 1_000_000
