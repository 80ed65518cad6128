"""Encoding equals the library's on any text, also when it is joined from parts."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexivec.llm import bpe
from lexivec.llm.encoders import ByteEncoder, WordEncoder

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
PARTS = ["don't", "'", "''s", " ", "  ", "\n", "\t \n", "the", "unbelievable", "été", "über", "1", "23", "4567", "...", "!?",
         "<|endoftext|>", "<|endof", "text|>", "日本語", "。", "🙂", "́", " ", "᠎", "a" * 40, "xyz" * 30,
         "0123456789" * 6, "'" * 9, "Σ", "ΑΣ", "İ", "<|startoftext|>", "\x1c", "\r\n", "token = \"9b0b\"", "語" * 30]


@pytest.fixture(scope="module")
def byte():
    return ByteEncoder(BYTE)


def texts(n, seed, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + (" " if rng.random() < 0.4 else "") for _ in range(rng.randrange(most)))
            for _ in range(n)]


@pytest.mark.parametrize(("kind", "path"), [(ByteEncoder, BYTE), (WordEncoder, WORD)])
def test_encoder_equals_library(kind, path):
    coder, library = kind(path), Tokenizer.from_file(path)
    for text in ["", " ", "a", *texts(3000, 1)]:
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_cache_may_overflow(monkeypatch):
    monkeypatch.setattr("lexivec.llm.encoders.CACHE_PIECES", 3)
    coder, library = ByteEncoder(BYTE), Tokenizer.from_file(BYTE)
    for text in ["a b c d e b a", "b a z y", "z a b " + "q" * 99 + " b", *texts(300, 5)]:
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_decoding_is_the_librarys(byte):
    library = Tokenizer.from_file(BYTE)
    rng = np.random.default_rng(3)
    for _ in range(300):
        ids = rng.integers(0, 50257, rng.integers(0, 20)).tolist()
        assert byte.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("size", [1, 3, 7, 20, 61])
def test_tree_concatenation(byte, size, monkeypatch):
    monkeypatch.setattr(bpe, "FIRST_WINDOW", 4)
    unsplit = ["ab" * 500, "語" * 300, "'" * 200 + "s", "x" * 333 + "<|endoftext|>" + "y" * 200, "1" * 400,
               "aéb" * 200, "'s't're" * 50, "Pneumono" * 60]
    for text in [*unsplit, *texts(250, size)]:
        if not text:
            continue
        parts = [(p.encode(), np.asarray(byte.encode(p), np.uint32))
                 for p in (text[i:i + size] for i in range(0, len(text), size))]
        assert bpe.tree_concatenation(byte, parts).tolist() == byte.encode(text).tolist(), text


def test_window_stays_small_in_unsplit_text(byte):
    """One common token on each side settles a seam inside an endless word."""
    seen = []
    class Watched(ByteEncoder):
        def encode(self, text):
            seen.append(len(text))
            return super().encode(text)
    coder = Watched(BYTE)
    half = "".join(random.Random(2).choice("abcdefghij") for _ in range(40_000))
    ids = np.asarray(byte.encode(half), np.uint32)
    joined = bpe.join_encodings(coder, (half.encode(), ids), (half.encode(), ids))[1]
    assert joined.tolist() == byte.encode(half + half).tolist() and max(seen) < 2000


def test_query_rows(spark):
    rows = [(1, "short text", 5), (1, "short text", 5), (2, None, 6), (3, "", 7), (None, "w " * 50, 8),
            (4, "long " * 40 + "unsplit" * 60, 9), (5, "long " * 40 + "unsplit" * 60, 1), (4, "long " * 40 + "unsplit" * 60, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body int").repartition(3)
    got = bpe.encode_texts(docs, BYTE, long_chars=64)
    assert got.columns == ["doc_id", "body", "ids"]
    library = Tokenizer.from_file(BYTE)
    want = sorted((str(d), b, library.encode(t or "", add_special_tokens=False).ids) for d, t, b in rows)
    assert sorted((str(r.doc_id), r.body, list(r.ids)) for r in got.collect()) == want
    back = bpe.decode_ids(got, BYTE).select("decoded").collect()
    assert sorted(r.decoded for r in back) == sorted(t or "" for _, t, _ in rows)
    assert bpe.encode_texts(docs.limit(0), BYTE).count() == 0
