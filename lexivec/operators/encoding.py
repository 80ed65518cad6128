"""Sentences of words to sentences of word ids, without unknown words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.operators.lookup import BROADCAST_LIMIT_BYTES, lookup_join, table_bytes
from lexivec.operators.word_index import WordIndex, word_index
from lexivec.sources.corpus import explode_tokens
from lexivec.sources.shared_tables import write_table

# A vocabulary up to this size is held by every Python worker, as a dictionary up to the lower size, which takes about five times
# as much memory, and as arrays beyond, which take less than it.
IN_PLACE_LIMIT_BYTES = 256 << 20
DICTIONARY_LIMIT_BYTES = 16 << 20
# Words worked on at a time within a batch.
SLICE_WORDS = 1 << 18


def token_ids(tokens: DataFrame, key: str, vocab: DataFrame,
              limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``key, pos, word_id`` of every known token; ``pos`` counts all tokens of the sentence."""
    ids = vocab.select("word", "word_id")
    rows = lookup_join(explode_tokens(tokens, key), ids, "word", (key, "pos"), limit=limit)
    return rows.select(key, "pos", "word_id")


def encode_by_join(tokens: DataFrame, key: str, vocab: DataFrame,
                   limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``key, ids`` by joining tokens to the vocabulary; works for any vocabulary size.

    ``key`` must be unique. A group then holds the tokens of one input row, never more.
    Sentences without a known word are left out.
    """
    found = token_ids(tokens, key, vocab, limit)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "word_id")))
    return found.groupBy(key).agg(F.transform(ordered, lambda t: t["word_id"]).alias("ids"))


def word_slices(tokens: pa.Array, words: int = SLICE_WORDS) -> list[pa.Array]:
    """Consecutive rows of at most ``words`` words together, or one longer row; an empty array gives itself."""
    ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    parts, first, before = [], 0, 0
    while first < len(ends):
        stop = max(first + 1, int(np.searchsorted(ends, before + words, side="right")))
        parts.append(tokens.slice(first, stop - first))
        first, before = stop, ends[stop - 1]
    return parts or [tokens]


def id_encoder(ids_by_word: Broadcast):
    """Arrow function from token arrays to id arrays. Looks up each distinct token of a slice of a batch
    once; the rest is array work, whose memory the slice bounds."""

    def encode_slice(tokens: pa.Array) -> pa.Array:
        table = ids_by_word.value
        lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = tokens.flatten().dictionary_encode()
        if isinstance(table, WordIndex):
            known = table.find(coded.dictionary)
        else:
            known = np.fromiter((table.get(w, -1) for w in coded.dictionary.to_pylist()),
                                dtype=np.int32, count=len(coded.dictionary))
        known = np.append(known, np.int32(-1))  # null tokens
        codes = coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)
        ids = known[codes]
        kept = ids >= 0
        kept_before = np.concatenate(([0], np.cumsum(kept)))
        ends = np.concatenate(([0], np.cumsum(lengths)))
        offsets = kept_before[ends].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[kept]))

    @F.arrow_udf("array<int>")
    def encode(tokens: pa.Array) -> pa.Array:
        return pa.concat_arrays([encode_slice(part) for part in word_slices(tokens)])

    # A filter on the ids must not be moved below a shuffle, where it would encode everything once more.
    return encode.asNondeterministic()


def encode_in_place(tokens: DataFrame, vocab: DataFrame, input_col: str = "tokens",
                    dictionary_limit: int = DICTIONARY_LIMIT_BYTES) -> DataFrame:
    """Adds ``ids`` without a shuffle. The vocabulary must fit a broadcast."""
    pairs = vocab.select("word", "word_id").toArrow()
    if pairs.nbytes > dictionary_limit:
        table = word_index(pairs["word"].combine_chunks(), pairs["word_id"].to_numpy())
    else:
        table = dict(zip(pairs["word"].to_pylist(), pairs["word_id"].to_pylist()))
    encode = id_encoder(tokens.sparkSession.sparkContext.broadcast(table))
    return tokens.withColumn("ids", encode(F.col(input_col)))


def encode_corpus(tokens: DataFrame, vocab: DataFrame,
                  limit: int = IN_PLACE_LIMIT_BYTES) -> DataFrame:
    """``ids`` of every sentence, by whichever form the vocabulary size allows."""
    sentences = tokens.select("tokens").filter(F.col("tokens").isNotNull())
    if table_bytes(vocab) <= limit:
        return encode_in_place(sentences, vocab).select("ids")
    keyed = write_table(sentences.withColumn("row", F.monotonically_increasing_id()), "rows")
    return encode_by_join(keyed, "row", vocab, limit).select("ids")


def encode_keyed(tokens: DataFrame, key: str, vocab: DataFrame,
                 limit: int = IN_PLACE_LIMIT_BYTES) -> DataFrame:
    """``key, ids`` of rows with a unique ``key``, by whichever form the vocabulary size allows. Sentences
    without a known word are left out."""
    if table_bytes(vocab) <= limit:
        return encode_in_place(tokens, vocab).select(key, "ids").filter(F.size("ids") > 0)
    return encode_by_join(tokens, key, vocab, limit)


def chunk_arrays(ids: Column | str, max_length: int) -> Column:
    """Splits an array into arrays of at most ``max_length``; none for an empty one."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    starts = F.when(F.size(ids) > 0, F.sequence(F.lit(1), F.size(ids), F.lit(max_length)))
    return F.transform(starts, lambda s: F.slice(ids, s, F.lit(max_length)))


def sentence_chunks(encoded: DataFrame, max_length: int, *keys: str) -> DataFrame:
    """``keys, chunk, ids``: chunks of at most ``max_length`` known words."""
    return encoded.select(*keys, F.posexplode(chunk_arrays("ids", max_length)).alias("chunk", "ids"))
