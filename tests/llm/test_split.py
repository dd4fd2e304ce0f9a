"""Words of a batch by Arrow are those of each text."""

import numpy as np
import pyarrow as pa

from tidemark.llm import pseudo_likelihood as lm


def test_words_of_a_batch_are_those_of_each_text():
    rng = np.random.default_rng(5)
    letters = [*"abAB zZ", "\t", "\n", "\v", "\f", "\r", "\x1c", "\x85", "\xa0", "Ä", "é", " ", "\0", "𝄞", " ", " "]
    rows = ["".join(rng.choice(letters, rng.integers(0, 12))) for _ in range(3000)] + ["", None, " ", " \n ", "x"]
    for texts in (rows, ["a b", "c"], [""], [None, None], []):
        words, ends = lm.split(pa.array(texts, pa.string()))
        flat = words.to_pylist()
        assert [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)] == [lm.words_of(x or "") for x in texts]
        assert ends[0] == 0 and ends[-1] == len(flat)


def test_the_leaf_of_an_ending_is_looked_up_once_for_a_batch(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a Rare a"), (2, None), (3, " B a\nrare ")], "doc_id long, text string").coalesce(1)
    lexicon = lm.fit_lexicon(lm.count_words(docs))
    seen, shared_leaf = [], lm.shared_leaf
    lexicon.known.pop(b"rare")
    monkeypatch.setattr(lm, "shared_leaf", lambda word, *a: seen.append(word) or shared_leaf(word, *a))

    class Here:
        value = lexicon

    batch = pa.RecordBatch.from_arrays([pa.array(["a b a Rare a", None, " B a\nrare "])], names=["text"])
    steps = []
    monkeypatch.setattr(lm, "map_batches", lambda df, step, schema: steps.append(step) or df)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: Here)
    lm.encoded(docs, lexicon, "leaves", "total", "lacking")
    out = steps[0](batch).to_pylist()
    assert seen == [b"are"]
    alone = [lexicon.look_up(lm.words_of(x)) for x in ("a b a Rare a", "", " B a\nrare ")]
    assert [x["leaves"] for x in out] == [x[0].astype("<u2").tobytes() for x in alone]
    assert np.allclose([x["total"] for x in out], [x[1].sum() for x in alone])
    assert [x["lacking"] for x in out] == [[b"rare"], [], [b"rare"]]
