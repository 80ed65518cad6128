"""Training: epochs of parallel learners whose weights are averaged.

The sentences are placed once: a table with one bucket per learner, in which every epoch finds them without a shuffle. A learner
streams through its bucket, cuts windows and draws in numpy, and reads the weights changed so far
from the table of the epoch before. Only rows it changed come out, in blocks; blocks are averaged by number and
written to the shared folder. No weights and no words pass through the driver: it sees the histogram
of counts and one row per learner.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions.draws import md5_expression
from lexivec.functions.place_draws import RADIUS, SUBSAMPLE, place_keys, place_units
from lexivec.functions.vectors import l2_norm
from lexivec.operators.count_runs import CountRuns, NegativeLine, count_runs
from lexivec.operators.encoding import encode_corpus, sentence_chunks
from lexivec.operators.huffman import HuffmanTree, huffman_tree
from lexivec.operators.vocabulary import (
    cap_vocabulary, min_count_filter, rank_vocabulary, train_word_total, word_counts,
)
from lexivec.plans.kernel import INIT_BLOCK, Learner, initial_block, learning_rate
from lexivec.settings import TrainSettings
from lexivec.sources.dictionary import read_dictionary
from lexivec.sources.shared_tables import drop_table, unshuffled_buckets, write_bucketed, write_table
from lexivec.sources.sorted_tables import with_total_before, write_in_order

FLOAT_BYTES = 4
# Examples are mixed within pieces of so many words, and the rate and the speed are noted as often.
PIECE_WORDS = 10_000
# Weights travel in blocks of about so many numbers.
BLOCK_NUMBERS = 1 << 18

BLOCK_COLUMNS = "kind string, block bigint, learner int, ids binary, vectors binary"
NOTE_COLUMNS = "step int, words bigint, examples bigint, loss double, alpha double, seconds double"
EPOCH_SCHEMA = f"{BLOCK_COLUMNS}, {NOTE_COLUMNS}"
NOTE = "note"
EARLIER = -1  # in place of a learner: weights from before the epoch


@dataclass(frozen=True)
class Trained:
    """``model``: word, word_id, vector, count, norm. ``metrics``: one row per learner and epoch. ``progress``: one row
    per learner, epoch and ``PIECE_WORDS`` words."""

    model: DataFrame
    metrics: DataFrame | None
    progress: DataFrame | None = None


@dataclass(frozen=True)
class SideTables:
    """What each learner knows of the words: a few numbers per distinct count."""

    runs: CountRuns
    line: NegativeLine | None
    tree: HuffmanTree | None
    keep: np.ndarray | None


def learn_vocabulary(tokens: DataFrame, settings: TrainSettings) -> DataFrame:
    """``word, cnt, word_id`` from the corpus or from the user's dictionary."""
    if settings.custom_dic:
        counts = read_dictionary(tokens.sparkSession, settings.custom_dic)
    else:
        counts = word_counts(tokens)
    ranked = rank_vocabulary(min_count_filter(counts, settings.min_count))
    return cap_vocabulary(ranked, settings.max_vocab_size, settings.min_count)


def check_weight_size(words: int, settings: TrainSettings) -> None:
    if words == 0:
        raise ValueError("the vocabulary is empty: lower min_count or raise max_vocab_size")
    outputs = int(settings.hs) + int(settings.negative > 0)
    cells = words * (settings.vector_size + outputs * settings.output_size)
    needed = (cells * FLOAT_BYTES) >> 20
    if needed > settings.learner_memory_mb:
        raise ValueError(
            f"{words} words need {needed} MB of weights per learner, more than "
            f"{settings.learner_memory_mb}: raise min_count or learner_memory_mb, set max_vocab_size or "
            "lower vector_size")


def side_tables(vocab: DataFrame, settings: TrainSettings) -> SideTables:
    runs = count_runs(vocab)
    total = int((runs.counts * runs.sizes).sum())
    return SideTables(
        runs, NegativeLine(runs) if settings.negative > 0 and runs.words > 1 else None,
        huffman_tree(runs) if settings.hs else None, runs.keep(settings.sample, total) if settings.sample > 0 else None)


def encoded_sentences(tokens: DataFrame, vocab: DataFrame, settings: TrainSettings) -> DataFrame:
    """``sentence, ids``: all chunks of known words, numbered.

    A sentence's number is its rank by a hash of its ids and the ids. It depends on the set of
    sentences only, not on files, cores or how they were encoded; equal sentences are interchangeable
    and still have numbers of their own.
    """
    chunks = sentence_chunks(encode_corpus(tokens, vocab), settings.max_sentence_length).select("ids")
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    # A range sort reads its rows twice; words are encoded once.
    named = write_table(chunks.withColumn("name", F.md5(text)), "named")
    ordered = write_in_order(named, "name", "ids", label="ordered")
    drop_table(named)
    ranked = with_total_before(ordered, F.lit(1), "start")
    rows = write_table(ranked.select((F.col("start") + F.col("row")).alias("sentence"), "ids"), "sentences")
    drop_table(ordered)
    return rows


def shuffle_sentences(sentences: DataFrame, learners: int, seed: int) -> DataFrame:
    """Adds ``learner`` and ``turn``, the place in the learner's order.

    Both come from a hash of the row number, not of the content, so copies of one sentence
    spread over all learners.
    """
    number = F.col("sentence").cast("string")
    learner = F.pmod(md5_expression(seed, 0, number, F.lit("learner")), F.lit(learners)).cast("int")
    turn = md5_expression(seed, 0, number, F.lit("turn"))
    return sentences.select(learner.alias("learner"), turn.alias("turn"), "sentence", "ids")


def bucket_names(spark: SparkSession, learners: int) -> DataFrame:
    """``learner, place``: numbers that Spark's bucketing sends to as many buckets, one each."""
    many = spark.range(learners * 64).select(F.col("id").cast("int").alias("place"))
    return many.groupBy(F.pmod(F.hash("place"), F.lit(learners)).alias("learner")).agg(F.min("place").alias("place"))


def placed_sentences(sentences: DataFrame, learners: int, seed: int) -> DataFrame:
    """``place, learner, turn, sentence, ids`` as a bucketed table: one shuffle for all epochs."""
    rows = shuffle_sentences(sentences, learners, seed)
    named = rows.join(F.broadcast(bucket_names(sentences.sparkSession, learners)), "learner")
    dealt = named.select("place", "learner", "turn", "sentence", "ids").repartition(learners, "place")
    return write_bucketed(dealt, "place", learners, "placed", "turn", "sentence")


def block_rows(width: int) -> int:
    return max(1, BLOCK_NUMBERS // width)


def weight_path(weights: DataFrame) -> str | None:
    """Where a task can read a written table by itself; None if only Spark reaches the store."""
    files = weights.inputFiles()
    if not files:
        return None
    folder = files[0].rsplit("/", 1)[0]
    try:
        store, path = pafs.FileSystem.from_uri(folder)
        return folder if store.get_file_info(path).type == pafs.FileType.Directory else None
    except (pa.ArrowException, OSError, ValueError):
        return None


def put_block(learner: Learner, kind: str, block: int, ids: bytes, vectors: bytes) -> None:
    matrix = learner.weights[kind]
    width = matrix.shape[1]
    at = block * block_rows(width) + np.frombuffer(ids, np.int32)
    matrix[at] = np.frombuffer(vectors, np.float32).reshape(-1, width)


def read_weights(learner: Learner, folder: str) -> None:
    store, path = pafs.FileSystem.from_uri(folder)
    table = ds.dataset(path, format="parquet", filesystem=store)
    wanted = ds.field("kind").isin(list(learner.weights))
    for batch in table.to_batches(columns=["kind", "block", "ids", "vectors"], filter=wanted, batch_size=16):
        for kind, block, ids, vectors in zip(*(c.to_pylist() for c in batch.columns)):
            put_block(learner, kind, block, ids, vectors)


def learner_rows(placed: DataFrame, weights: DataFrame | None, learners: int, direct: bool) -> DataFrame:
    """What the learners read: their buckets in order. Where tasks cannot read the weights themselves, a copy
    of the blocks comes first, which costs a shuffle of sentences and copies."""
    if weights is None or direct:
        return placed.sortWithinPartitions("place", "turn", "sentence")
    names = F.broadcast(placed.select("place", "learner").distinct())
    copies = weights.select("kind", "block", "ids", "vectors").crossJoin(names).select(
        "place", "learner", F.lit(-1).cast("bigint").alias("turn"), F.col("block").alias("sentence"), "kind",
        F.col("ids").alias("rows"), "vectors")
    return (placed.unionByName(copies, allowMissingColumns=True).repartition(learners, "place")
            .sortWithinPartitions("place", "turn", "sentence"))


@dataclass
class Piece:
    """Consecutive sentences of a learner, end to end."""

    sentence: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray


def pieces_of(rows: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    """Whole sentences of ``PIECE_WORDS`` words or a little more, however the batches are cut."""
    held = Piece(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    for batch in rows:
        lists = batch.column("ids")
        held = Piece(np.concatenate((held.sentence, batch.column("sentence").to_numpy())),
                     np.concatenate((held.lengths, lists.value_lengths().to_numpy(zero_copy_only=False))),
                     np.concatenate((held.ids, lists.flatten().to_numpy(zero_copy_only=False))))
        ends = np.cumsum(held.lengths)
        first = word = 0
        while len(ends) and ends[-1] - word >= PIECE_WORDS:
            stop = int(np.searchsorted(ends, word + PIECE_WORDS)) + 1
            yield Piece(held.sentence[first:stop], held.lengths[first:stop], held.ids[word:ends[stop - 1]])
            first, word = stop, int(ends[stop - 1])
        held = Piece(held.sentence[first:], held.lengths[first:], held.ids[word:])
    if len(held.ids):
        yield held


@dataclass
class Windows:
    """Examples of a piece, one per word: contexts end to end, left to right, without the center."""

    centers: np.ndarray
    radius: np.ndarray
    n_left: np.ndarray
    context: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray


def windows_of(piece: Piece, settings: TrainSettings, epoch: int, side: SideTables) -> Windows:
    """A center dropped by subsampling has an empty context: it trains nothing but counts towards the
    schedule, and stays in the contexts of its neighbours."""
    window, n = settings.window_size, len(piece.ids)
    starts = np.cumsum(piece.lengths) - piece.lengths
    owner = np.repeat(np.arange(len(piece.lengths)), piece.lengths)
    pos = np.arange(n) - starts[owner]
    keys = place_keys(settings.seed, epoch, piece.sentence[owner], pos)
    radius = window - (place_units(keys, RADIUS) * window).astype(np.int64)
    reach = radius
    if side.keep is not None:
        kept = place_units(keys, SUBSAMPLE) <= side.keep[side.runs.run_of(piece.ids)]
        reach = np.where(kept, radius, 0)
    offsets = np.concatenate((np.arange(-window, 0), np.arange(1, window + 1)))
    at = pos[:, None] + offsets
    inside = (at >= 0) & (at < piece.lengths[owner][:, None]) & (np.abs(offsets) <= reach[:, None])
    context = piece.ids[(np.arange(n)[:, None] + offsets)[inside]]
    return Windows(piece.ids.astype(np.int64), radius, inside[:, :window].sum(axis=1), context, inside.sum(axis=1), keys)


def block_batch(kind: str, blocks: list[int], learner: int, ids: list[bytes], vectors: list[bytes]) -> pa.RecordBatch:
    n = len(blocks)
    empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.string()), pa.array(blocks, pa.int64()), pa.array([learner] * n, pa.int32()),
         pa.array(ids, pa.binary()), pa.array(vectors, pa.binary()), *empty], names=EPOCH_NAMES)


EPOCH_NAMES = [part.split()[0] for part in EPOCH_SCHEMA.split(", ")]


def changed_blocks(learner: Learner, kind: str, number: int) -> Iterator[pa.RecordBatch]:
    """The rows of one weight matrix that were touched."""
    matrix, touched = learner.weights[kind], learner.touched[kind]
    size = block_rows(matrix.shape[1])
    for block in range((len(matrix) + size - 1) // size):
        ids = np.flatnonzero(touched[block * size:(block + 1) * size]).astype(np.int32)
        if len(ids):
            yield block_batch(kind, [block], number, [ids.tobytes()], [matrix[block * size + ids].tobytes()])


def note_batch(number: int, notes: list[tuple]) -> pa.RecordBatch:
    """``step`` counts the pieces; the values are those after the piece."""
    n = len(notes)
    types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array([NOTE] * n, pa.string()), pa.array([number] * n, pa.int64()), pa.array([number] * n, pa.int32()),
         pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
         *(pa.array(list(c), t) for c, t in zip(zip(*notes), types))], names=EPOCH_NAMES)


def learner_task(settings: TrainSettings, total: int, learners: int, epoch: int, side: Broadcast, folder: str | None):
    """Function over the rows of one learner, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, words = time.time(), side.value.runs.words
        notes: list[tuple] = []
        learner: Learner | None = None
        number = 0

        def sentences() -> Iterator[pa.RecordBatch]:
            nonlocal learner, number
            last = (-2, -1)
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                if learner is None:
                    number = batch.column("learner")[0].as_py()
                    rng = np.random.default_rng([settings.seed & 0xFFFFFFFFFFFFFFFF, epoch, number])
                    learner = Learner(settings, words, side.value.line, side.value.tree, rng)
                    if folder is not None:
                        read_weights(learner, folder)
                if "kind" in batch.schema.names:
                    is_weight = pc.is_valid(batch.column("kind"))
                    some = batch.filter(is_weight).select(["kind", "sentence", "rows", "vectors"])
                    for kind, block, ids, vectors in zip(*(c.to_pylist() for c in some.columns)):
                        put_block(learner, kind, block, ids, vectors)
                    batch = batch.filter(pc.invert(is_weight))
                    if batch.num_rows == 0:
                        continue
                first = (batch.column("turn")[0].as_py(), batch.column("sentence")[0].as_py())
                if first < last:
                    raise ValueError("the sentences of a learner are out of order")
                last = (batch.column("turn")[-1].as_py(), batch.column("sentence")[-1].as_py())
                yield batch

        seen = 0
        for piece in pieces_of(sentences()):
            part = windows_of(piece, settings, epoch, side.value)
            rate = learning_rate(settings, learners, epoch, seen + np.arange(len(part.centers)), total)
            learner.train(part.centers, part.n_left, part.radius, part.context, part.sizes, rate.astype(np.float32), part.keys)
            seen += len(part.centers)
            notes.append((len(notes) + 1, seen, learner.examples, learner.loss / max(learner.examples, 1),
                          float(learning_rate(settings, learners, epoch, seen, total)), time.time() - started))
        if learner is None:
            return
        for kind in learner.weights:
            if kind == "in" or epoch < settings.max_iter:
                yield from changed_blocks(learner, kind, number)
        if notes:
            yield note_batch(number, notes)

    return run


def average_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block: each row's mean over the learners that changed it, else its earlier value. Notes go through."""
    total = count = base = None
    kind, block = "", 0
    for batch in batches:
        kinds = batch.column("kind")
        if batch.num_rows and kinds[0].as_py() == NOTE:
            yield batch.select(EPOCH_NAMES)
            continue
        for k in range(batch.num_rows):
            kind, block = kinds[k].as_py(), batch.column("block")[k].as_py()
            ids = np.frombuffer(batch.column("ids")[k].as_py(), np.int32)
            vectors = np.frombuffer(batch.column("vectors")[k].as_py(), np.float32).reshape(len(ids), -1)
            if total is None:
                size = block_rows(vectors.shape[1])
                total, count = np.zeros((size, vectors.shape[1])), np.zeros(size, np.int64)
                base = np.zeros(size, bool)
            if batch.column("learner")[k].as_py() == EARLIER:
                # The earlier block comes first; a learner's value takes its place.
                total[ids], base[ids] = vectors, True
            else:
                first = ids[base[ids] & (count[ids] == 0)]
                total[first] = 0
                total[ids] += vectors
                count[ids] += 1
    if total is not None:
        ids = np.flatnonzero(base | (count > 0)).astype(np.int32)
        mean = (total[ids] / np.maximum(count[ids], 1)[:, None]).astype(np.float32)
        yield block_batch(kind, [block], EARLIER, [ids.tobytes()], [mean.tobytes()])


def run_epoch(placed: DataFrame, weights: DataFrame | None, side: Broadcast, settings: TrainSettings, total: int,
              learners: int, epoch: int, direct: bool = True) -> DataFrame:
    """Trains every learner once; returns the written blocks and the learners' notes."""
    folder = weight_path(weights) if weights is not None and direct else None
    direct = weights is None or folder is not None
    rows = learner_rows(placed, weights, learners, direct)
    with unshuffled_buckets(placed.sparkSession):
        changed = rows.groupBy("place").applyInArrow(
            learner_task(settings, total, learners, epoch, side, folder), EPOCH_SCHEMA)
        if weights is not None:
            wanted = F.col("kind").isin(["in"] if epoch == settings.max_iter else ["in", "hs", "neg"])
            changed = changed.unionByName(weights.filter(wanted))
        # Sorted by learner, so that sums are taken in one order.
        dealt = changed.repartition("kind", "block").sortWithinPartitions("kind", "block", "learner", "step")
        return write_table(dealt.groupBy("kind", "block").applyInArrow(average_blocks, EPOCH_SCHEMA),
                           f"epoch-{epoch}", release=True)


def notes_table(blocks: DataFrame, epoch: int, settings: TrainSettings, total: int, learners: int) -> DataFrame:
    """Per learner and step: words and examples so far in the epoch, the share of the whole training done if all learners
    are as far, mean loss, rate, seconds and words a second."""
    done = (F.lit(learners) * F.col("words") + (epoch - 1) * total) / F.lit(settings.max_iter * total + 1)
    return blocks.filter(F.col("kind") == NOTE).select(
        F.lit(epoch).alias("epoch"), "learner", "step", F.least(done, F.lit(1.0)).alias("progress"), "words", "examples", "loss",
        "alpha", "seconds", (F.col("words") / F.greatest("seconds", F.lit(1e-9))).alias("words_per_second"))


def metrics_table(progress: DataFrame, epochs: int) -> DataFrame:
    """The last note of each learner and epoch; ``progress`` is the share of the epochs done."""
    last = progress.groupBy("epoch", "learner").agg(F.max_by(F.struct(
        "words", "examples", "loss", "alpha", "seconds", "words_per_second"), "step").alias("last"))
    return last.select("epoch", "learner", (F.col("epoch") / epochs).alias("progress"), "last.*")


def weight_rows(blocks: DataFrame, kind: str, width: int) -> DataFrame:
    """``row_id, vector`` of a kind of weights."""
    size = block_rows(width)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                numbers = block * size + np.frombuffer(ids, np.int32).astype(np.int64)
                offsets = pa.array(np.arange(len(numbers) + 1, dtype=np.int32) * width)
                column = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(vectors, np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array(numbers), column], names=["row_id", "vector"])

    rows = blocks.filter(F.col("kind") == kind).select("block", "ids", "vectors")
    return rows.mapInArrow(spread, "row_id bigint, vector array<float>")


def fill_initial(missing: DataFrame, settings: TrainSettings) -> DataFrame:
    """Adds the starting vector to words no learner touched."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["word_id"].to_numpy()
            vectors = np.empty((len(ids), settings.vector_size), np.float32)
            for block in np.unique(ids // INIT_BLOCK):
                rows = ids // INIT_BLOCK == block
                start = initial_block(settings.seed, int(block), settings.vector_size)
                vectors[rows] = start[ids[rows] % INIT_BLOCK]
            offsets = np.arange(len(ids) + 1, dtype=np.int32) * settings.vector_size
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch["word"], batch["cnt"], batch["word_id"], column],
                names=["word", "cnt", "word_id", "vector"])

    return missing.select("word", "cnt", "word_id").mapInArrow(
        fill, "word string, cnt bigint, word_id int, vector array<float>")


def init_vectors(spark: SparkSession, words: int, settings: TrainSettings) -> DataFrame:
    """``word_id, vector``: the starting input weights. Output weights start at zero."""
    ids = spark.range(words).select(
        F.lit("").alias("word"), F.lit(0).cast("bigint").alias("cnt"),
        F.col("id").cast("int").alias("word_id"))
    return fill_initial(ids, settings).select("word_id", "vector")


def model_table(vocab: DataFrame, weights: DataFrame | None, settings: TrainSettings) -> DataFrame:
    """``word, word_id, vector, count, norm``, written."""
    if weights is None:
        rows = fill_initial(vocab, settings)
    else:
        trained = weight_rows(weights, "in", settings.vector_size).select(
            F.col("row_id").cast("int").alias("word_id"), "vector")
        rows = vocab.join(trained, "word_id").select("word", "cnt", "word_id", "vector").unionByName(
            fill_initial(vocab.join(trained, "word_id", "left_anti"), settings))
    return write_table(rows.select(
        "word", "word_id", "vector", F.col("cnt").alias("count"),
        l2_norm(F.col("vector")).alias("norm")), "model")


def train(tokens: DataFrame, settings: TrainSettings) -> Trained:
    """Learns word vectors from the ``tokens`` column. The result depends on the rows, the settings
    and the seed only. Scratch tables go also when training fails."""
    scratch: list[DataFrame] = []
    try:
        return _train(tokens, settings, scratch)
    finally:
        for table in scratch:
            drop_table(table)


def _train(tokens: DataFrame, settings: TrainSettings, scratch: list[DataFrame]) -> Trained:
    spark, learners = tokens.sparkSession, settings.num_partitions
    vocab = learn_vocabulary(tokens, settings)
    scratch.append(vocab)
    side = spark.sparkContext.broadcast(side_tables(vocab, settings))
    check_weight_size(side.value.runs.words, settings)
    sentences = encoded_sentences(tokens, vocab, settings)
    scratch.append(sentences)
    if settings.custom_dic:
        total = sentences.agg(F.sum(F.size("ids")).alias("total")).first()["total"] or 0
    else:
        total = train_word_total(vocab).first()["total"]
    placed = placed_sentences(sentences, learners, settings.seed)
    scratch.append(placed)

    weights, progress = None, None
    for epoch in range(1, settings.max_iter + 1):
        blocks = run_epoch(placed, weights, side, settings, total, learners, epoch)
        scratch.append(blocks)
        noted = notes_table(blocks, epoch, settings, total, learners)
        progress = noted if progress is None else progress.unionByName(noted)
        weights = blocks.filter(F.col("kind") != NOTE)
    model = model_table(vocab, weights, settings)
    metrics = None
    if progress is not None:
        progress = write_table(progress, "progress")
        metrics = write_table(metrics_table(progress, settings.max_iter), "metrics")
    # The model, its metrics and its progress are tables of their own now.
    side.unpersist()
    return Trained(model, metrics, progress)
