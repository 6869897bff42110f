"""What operators hold in workers and in batches, which a long session has to bear (round 2, F1)."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import bpe, common, language_id, ngram_join

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def own_batches(spark):
    before = spark.conf.get(BATCH, None)
    spark.conf.unset(BATCH)
    yield spark
    spark.conf.unset(BATCH)
    if before:
        spark.conf.set(BATCH, before)


def largest_batch(spark):
    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat('long text ', 1000) AS text").mapInArrow(size, "n long, size long").collect()
    assert sum(r["n"] for r in rows) == 3000
    return max(r["size"] for r in rows)


def test_batches_of_long_texts_are_bounded_by_bytes(own_batches):
    docs = own_batches.createDataFrame([(i, "some text here", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert language_id.language_id(docs).count() == 9
    assert largest_batch(own_batches) < common.BATCH_BYTES + 100_000


def test_batch_size_of_the_session_holds(own_batches):
    own_batches.conf.set(BATCH, "1000000")
    ngram_join.with_fingerprint(own_batches.createDataFrame([("a b",)], "text string"), "text", "fp").collect()
    assert own_batches.conf.get(BATCH) == "1000000"


def test_a_long_text_leaves_no_table_behind():
    text = b"one two three four five six seven " * 60_000
    ngram_join._powers.clear()
    long, short, again = ngram_join.shingle_sets([text, b"a b c d e f"]), ngram_join.shingle_sets([b"a b c d e f"]), ngram_join.shingle_sets([text[:3400]])
    assert (long[1] == short[0]).all() and (long[0] == again[0]).all() and len(long[0]) == 7
    assert sum(p.nbytes for p in ngram_join._powers) <= 8 << 20


def anonymous_mb():
    return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_other_operators_free_the_vocabulary():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    v = bpe.vocabulary(path)
    for i in range(100_000):
        v.coded(f"word{i} {np.base_repr(i * 7919, 36).lower()}")
    common.free_tables("bpe")
    assert bpe.vocabulary(path) is v
    held = anonymous_mb()
    del v
    common.free_tables()
    assert not bpe._loaded and anonymous_mb() < held - 50
    assert bpe.vocabulary(path).encode("hello") == bpe.Vocabulary(path).encode("hello")
