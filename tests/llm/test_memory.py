"""What a Python worker takes for a batch, and what it holds between tasks."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm import lang_id, word_bpe
from tidemark.llm.common import map_batches

TEXTS = ["", "a", "  ", "Ab  cd\n\n12 ef", "1234567890" * 5, "äÖ" * 9 + "!?" * 11 + "Σας ΟΔΟΣ" * 3, "x" + " " * 30 + "y", "\ud800 word"]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 50, 1 << 19])
def test_profiles_are_the_same_in_blocks_of_any_size(monkeypatch, block):
    monkeypatch.setattr(lang_id, "BLOCK", block)
    group = np.array([0, 1, 2, 0, 3, 1, 2, 1])
    doc, kind, count, rows = lang_id.trigram_counts(TEXTS)
    found, known = lang_id.profiles(TEXTS, group, 4, 64)
    assert (found == lang_id.bundle(group[doc], kind, count, rows, 4, 64)).all()
    assert known.tolist() == [True, True, True, False]


def test_memory_of_languages_does_not_grow_with_a_text():
    text = "Some words of a text, again and again. " * 100_000
    lang_id.predict_texts(["warm"], {"aa": np.ones(lang_id.DIMENSIONS)})
    tracemalloc.start()
    lang_id.predict_texts([text], {"aa": np.ones(lang_id.DIMENSIONS)})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # 4 million characters; it was 100 bytes for each


def test_a_worker_holds_no_table_of_words_between_tasks(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('word', id, ' and ', id) AS text").coalesce(1)
    assert word_bpe.encode(docs).where("n_tokens > 0").count() == 50

    def held(batch):
        bpe = word_bpe.word_bpe(public_tokenizers.path(word_bpe.TOKENIZER))
        return pa.RecordBatch.from_arrays([pa.array([len(bpe.known)] * batch.num_rows, pa.int64())], names=["id"])

    assert map_batches(spark.range(8).repartition(8), held, "id long").agg({"id": "max"}).first()[0] == 0
