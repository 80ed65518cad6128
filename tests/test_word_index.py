import numpy as np
import pyarrow as pa

from lexivec.operators import encoding, word_index
from lexivec.operators import vocabulary as voc


def test_finds_words_and_no_others():
    words = ["", "a", "b", "ab", "ba", "é", "名前", "x" * 300, *(f"w{i}" for i in range(5000))]
    index = word_index.word_index(pa.array(words), np.arange(len(words), dtype=np.int32) * 3)
    asked = ["ab", None, "nothing", *reversed(words), "w5000", "aa", "x" * 299]
    want = {word: 3 * n for n, word in enumerate(words)}
    assert index.find(pa.array(asked)).tolist() == [want.get(word, -1) for word in asked]
    assert index.find(pa.array(asked).slice(2, 40)).tolist() == [want.get(word, -1) for word in asked[2:42]]
    assert word_index.word_index(pa.array([], pa.string()), np.zeros(0, np.int32)).find(pa.array(["a"])).tolist() == [-1]
    assert len(np.unique(word_index.word_hashes(pa.array(words)))) == len(words)


def test_equal_hashes_do_no_harm(monkeypatch):
    monkeypatch.setattr(word_index, "word_hashes", lambda words: np.full(len(words), 1 << 60, np.uint64))
    words = [f"w{i}" for i in range(40)]
    index = word_index.word_index(pa.array(words), np.arange(40, dtype=np.int32))
    assert index.find(pa.array(["w39", "w0", "w40", "w7"])).tolist() == [39, 0, -1, 7]


def test_arrays_and_dictionary_encode_alike(spark):
    rows = spark.createDataFrame([(["a", "b", "x", "a", None, "c"],), ([],), (None,), (["x"],), (["c", "ß"],)], "tokens array<string>")
    vocab = voc.rank_vocabulary(spark.createDataFrame([("a", 5), ("b", 4), ("c", 2), ("ß", 1)], "word string, cnt bigint"))
    forms = [[r["ids"] for r in encoding.encode_in_place(rows, vocab, dictionary_limit=limit).select("ids").collect()]
             for limit in (0, 1 << 20)]
    assert forms[0] == forms[1] and forms[0][0] == [0, 1, 0, 2]


def test_a_vocabulary_of_two_million_words_is_encoded_without_a_shuffle(spark, monkeypatch):
    # What a text of six times the driver's 1 GB has by the growth of its vocabulary; the words are not made here.
    monkeypatch.setattr(encoding, "table_bytes", lambda vocab: 47 * 2_000_000)
    rows = spark.createDataFrame([(1, ["a", "b"])], "doc_id bigint, tokens array<string>")
    vocab = voc.rank_vocabulary(spark.createDataFrame([("a", 5), ("b", 4)], "word string, cnt bigint"))
    for found in (encoding.encode_keyed(rows, "doc_id", vocab), encoding.encode_corpus(rows, vocab)):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.first()["ids"] == [0, 1]
