"""Exact encoders over the tokenizers library, with a bounded cache of repeated pieces.

Both cut a text only where the tokenizer itself always cuts, whatever stands around, and ask the
library for each distinct piece once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np

CACHE_PIECES = 1 << 20
CACHED_CHARS = 64  # longer pieces are rarely seen again

_encoders: dict[tuple[str, str], "PieceEncoder"] = {}


class PieceEncoder:
    """``cut`` splits a text into pieces that are encoded one by one; ids are kept as packed numbers."""

    def __init__(self, path: str):
        # Spark runs a worker per core; threads inside it would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, self.kind).tobytes() for ids in self.library(texts)]

    def cut(self, text: str) -> list[str]:
        raise NotImplementedError

    def new_pieces(self, pieces: list[str]) -> list[bytes]:
        return self.packed(pieces)

    def first_pieces(self, pieces: list[str]) -> list[bytes]:
        return [self.cache[p] for p in pieces]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. The library is asked once for all pieces that are new."""
        cut = [self.cut(t) for t in texts]
        cache = self.cache
        new = [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in cache]
        if len(cache) + len(new) > CACHE_PIECES:
            cache.clear()
            new = list(dict.fromkeys(chain.from_iterable(cut)))
        cache.update(zip(new, self.new_pieces(new)))
        firsts = self.first_pieces([pieces[0] for pieces in cut])
        out = []
        for first, pieces in zip(firsts, cut):
            found = list(map(cache.__getitem__, pieces))
            found[0] = first
            out.append(np.frombuffer(b"".join(found), self.kind))
        for p in new:
            if len(p) > CACHED_CHARS:
                del cache[p]
        return out


class ByteEncoder(PieceEncoder):
    """Byte-level BPE. A single space between two other signs always begins a word of its own, so
    the text on either side is encoded independently."""

    CUT = re.compile("(?<=[^\\s\u180e]) (?=[^\\s\u180e])")

    def __init__(self, path: str):
        super().__init__(path)
        self.special = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        back = {c: b for b, c in enumerate(byte_signs())}
        self.bytes = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for content, i in self.special.items():
            self.bytes[i] = content
        self.sizes = np.array([len(b) for b in self.bytes])

    def cut(self, text: str) -> list[str]:
        return self.CUT.split(text)

    def new_pieces(self, pieces: list[str]) -> list[bytes]:
        """All behind a space, encoded as one text; the bytes that the ids stand for tell them apart."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 4096):
            some = pieces[at:at + 4096]
            # Only pieces with a plain sign at either end are cut apart at the spaces put between them.
            if all(p and "!" <= p[0] <= "~" and "!" <= p[-1] <= "~" for p in some):
                ids = np.array(self.library([" " + " ".join(some)])[0], self.kind)
                ends = np.cumsum(self.sizes[ids])
                stops = np.searchsorted(ends, np.cumsum([len(p.encode()) + 1 for p in some])) + 1
                data, width = ids.tobytes(), self.kind.itemsize
                starts = [0, *(stops[:-1] * width).tolist()]
                out += [data[i:j] for i, j in zip(starts, (stops * width).tolist())]
            else:
                out += self.packed([" " + p for p in some])
        return out

    def first_pieces(self, pieces: list[str]) -> list[bytes]:
        return self.packed(pieces)

    def raw(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.raw(ids).decode("utf-8", "replace")


class WordEncoder(PieceEncoder):
    """BPE whose words never cross white space and which drops it."""

    TAIL = re.compile("(?<=[a-z])[,.](?=[ \\n])")

    def cut(self, text: str) -> list[str]:
        if "<|" not in text:  # else lower-casing might spell a special token
            text = text.encode().lower().decode()
        parts = self.TAIL.sub(r" \g<0>", text).replace("\n", " ").split(" ")
        return list(filter(None, parts)) or [""] if "" in parts else parts


def byte_signs() -> list[str]:
    """The printable sign by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in signs):
        signs[b] = chr(256 + n)
    return [signs[b] for b in range(256)]


def encoder(kind: type[PieceEncoder], path: str) -> PieceEncoder:
    """One encoder of a kind and file per Python worker."""
    key = (kind.__name__, path)
    if key not in _encoders:
        _encoders[key] = kind(path)
    return _encoders[key]


def release_encoders() -> None:
    """Gives back the encoders of a Python worker that has turned to other work: workers outlive their tasks."""
    _encoders.clear()
