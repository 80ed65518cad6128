import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_trainer
from lexivec.operators import encoding
from lexivec.operators.averaging import parameter_average
from lexivec.plans import kernel, training
from lexivec.settings import TrainSettings
from lexivec.sources import shared_tables

SMALL = TrainSettings(vector_size=12, window_size=3, hs=False, negative=3, sample=0.0, min_count=1,
                      num_partitions=2, seed=9)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        topic = rng.choice("ab")
        rows.append(([f"{topic}{rng.randrange(12)}" for _ in range(10)],))
    return spark.createDataFrame(rows + [([],), (None,), ([None],)], "tokens array<string>")


def vectors(model):
    return {r["word"]: np.array(r["vector"], np.float32) for r in model.collect()}


def test_epochs_learn_and_repeat(corpus):
    settings = TrainSettings(**{**SMALL.__dict__, "max_iter": 3, "step_size": 0.05, "hs": True})
    first = training.train(corpus, settings)
    again = training.train(corpus, settings)
    a, b = vectors(first.model), vectors(again.model)
    assert len(a) == 24 and all((a[w] == b[w]).all() for w in a)
    loss = {r["epoch"]: r["l"] for r in first.metrics.groupBy("epoch").agg(F.avg("loss").alias("l")).collect()}
    assert loss[3] < loss[1]
    words = first.metrics.groupBy("epoch").agg(F.sum("words").alias("n")).collect()
    assert {r["n"] for r in words} == {3000}
    assert first.metrics.count() == 6


def test_training_leaves_only_its_results(corpus, spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared_tables, "shared_dir", lambda spark: str(tmp_path))
    (tmp_path / "other-0123456789abcdef0123456789abcdef").mkdir()
    settings = TrainSettings(**{**SMALL.__dict__, "max_iter": 3, "sample": 1e-3})
    trained = training.train(corpus, settings)
    left = sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    assert left == ["metrics", "model", "other", "progress"]
    assert trained.model.count() == 24 and trained.metrics.count() == 6


def test_drop_table_spares_foreign_files(spark, tmp_path):
    path = str(tmp_path / "mine-0123456789abcdef0123456789abcdef")
    spark.range(3).write.parquet(path)
    shared_tables.drop_table(spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 3


def test_more_learners_than_sentences(corpus, spark):
    few = spark.createDataFrame([(["a", "b", "c"],)] * 3, "tokens array<string>")
    settings = TrainSettings(**{**SMALL.__dict__, "num_partitions": 8, "max_iter": 2})
    model = training.train(few, settings).model
    assert model.count() == 3 and all(np.isfinite(v).all() for v in vectors(model).values())


def test_no_epochs_gives_the_starting_vectors(corpus):
    trained = training.train(corpus, TrainSettings(**{**SMALL.__dict__, "max_iter": 0}))
    start = kernel.initial_vectors(SMALL.seed, 24, 12)
    for row in trained.model.collect():
        assert (np.array(row["vector"], np.float32) == start[row["word_id"]]).all()
    assert np.abs(start).max() <= 0.5 / 12


def test_dictionary_words_missing_from_the_corpus_keep_their_start(corpus, tmp_path):
    path = tmp_path / "dic.txt"
    path.write_text("a1 30\na2 20\nghost 10\nrare 0\n")
    settings = TrainSettings(**{**SMALL.__dict__, "custom_dic": str(path), "negative": 0, "hs": True})
    trained = training.train(corpus, settings)
    model = {r["word"]: r for r in trained.model.collect()}
    assert set(model) == {"a1", "a2", "ghost"}
    start = kernel.initial_vectors(SMALL.seed, 3, 12)
    moved = {w: not (np.array(r["vector"], np.float32) == start[r["word_id"]]).all()
             for w, r in model.items()}
    assert moved == {"a1": True, "a2": True, "ghost": False}
    assert model["a1"]["count"] == 30


def test_one_word_vocabulary(spark):
    rows = spark.createDataFrame([(["a", "a", "a"],)], "tokens array<string>")
    model = training.train(rows, TrainSettings(**{**SMALL.__dict__, "hs": True})).model
    assert model.count() == 1


def test_empty_vocabulary_raises(corpus):
    with pytest.raises(ValueError, match="vocabulary is empty"):
        training.train(corpus, TrainSettings(**{**SMALL.__dict__, "min_count": 10**6}))


def test_size_guard_is_memory_of_a_learner():
    training.check_weight_size(21_000_000, TrainSettings(vector_size=100))
    small = TrainSettings(vector_size=100, learner_memory_mb=1000)
    training.check_weight_size(500_000, small)
    with pytest.raises(ValueError, match="weights per learner"):
        training.check_weight_size(5_000_000, small)
    with pytest.raises(ValueError, match="weights per learner"):
        training.check_weight_size(500_000, TrainSettings(vector_size=100, cbow=2, learner_memory_mb=1000))


def test_same_rows_give_the_same_vectors_however_they_lie(corpus, spark, monkeypatch):
    """Files, partitions, Arrow batches and the encoder do not matter."""
    settings = TrainSettings(**{**SMALL.__dict__, "max_iter": 2, "sample": 1e-2, "hs": True})
    first = vectors(training.train(corpus.repartition(1), settings).model)
    spread = vectors(training.train(corpus.repartition(7).orderBy(F.rand(3)), settings).model)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        batched = vectors(training.train(corpus, settings).model)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(training, "encode_corpus", lambda t, v: encoding.encode_corpus(t, v, 0))
    joined = vectors(training.train(corpus, settings).model)
    for other in (spread, batched, joined):
        assert other.keys() == first.keys() and all((first[w] == other[w]).all() for w in first)


def test_failed_training_leaves_nothing(corpus, monkeypatch, tmp_path):
    monkeypatch.setattr(shared_tables, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(training, "model_table", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        training.train(corpus, TrainSettings(**{**SMALL.__dict__, "sample": 1e-3}))
    assert not list(tmp_path.iterdir())


def test_average_is_over_the_learners_that_changed_a_row(spark):
    rows = spark.createDataFrame(
        [("in", 1, [1.0, 2.0]), ("in", 1, [3.0, 6.0]), ("in", 2, [5.0, 5.0]), ("neg", 1, [7.0, 8.0])],
        "kind string, row_id bigint, vector array<float>")
    got = parameter_average(rows, ("kind", "row_id"), 2).collect()
    assert {(r["kind"], r["row_id"]): r["vector"] for r in got} == {
        ("in", 1): [2.0, 4.0], ("in", 2): [5.0, 5.0], ("neg", 1): [7.0, 8.0]}


def block(kind, number, learner, rows):
    ids = np.array(list(rows), np.int32)
    return training.block_batch(kind, [number], learner, [ids.tobytes()], [np.array(list(rows.values()), np.float32).tobytes()])


def test_blocks_average_the_changed_rows_and_keep_the_earlier_ones():
    got, = training.average_blocks(iter([
        block("in", 3, training.EARLIER, {0: [9, 9], 1: [1, 2], 5: [4, 4]}),
        block("in", 3, 0, {1: [1, 2], 7: [8, 0]}), block("in", 3, 2, {1: [3, 6]})]))
    ids = np.frombuffer(got.column("ids")[0].as_py(), np.int32)
    vectors = np.frombuffer(got.column("vectors")[0].as_py(), np.float32).reshape(-1, 2)
    assert {i: v.tolist() for i, v in zip(ids.tolist(), vectors)} == {0: [9, 9], 1: [2, 4], 5: [4, 4], 7: [8, 0]}


def prepared(corpus, spark, settings):
    vocab = training.learn_vocabulary(corpus, settings)
    placed = training.placed_sentences(training.encoded_sentences(corpus, vocab, settings), settings.num_partitions, settings.seed)
    return placed, spark.sparkContext.broadcast(training.side_tables(vocab, settings))


@pytest.mark.parametrize("cbow", [0, 1, 2])
def test_weights_travel_between_epochs(corpus, spark, cbow):
    """A second epoch starts from exactly the averaged weights of the first, read or sent."""
    settings = TrainSettings(**{**SMALL.__dict__, "cbow": cbow, "max_iter": 3, "num_partitions": 3})
    placed, side = prepared(corpus, spark, settings)
    first = training.run_epoch(placed, None, side, settings, 3000, 3, 1)
    weights = first.filter("kind != 'note'")
    found = kernel.Learner(settings, 24, side.value.line, side.value.tree, np.random.default_rng(0))
    training.read_weights(found, training.weight_path(weights))
    for kind, width in (("in", 12), ("neg", settings.output_size)):
        rows = {r["row_id"]: r["vector"] for r in training.weight_rows(weights, kind, width).collect()}
        assert len(rows) == 24 and all((found.weights[kind][i] == np.array(v, np.float32)).all() for i, v in rows.items())

    def after(direct):
        rows = training.run_epoch(placed, weights, side, settings, 3000, 3, 2, direct)
        return sorted(map(str, rows.drop("seconds").collect()))

    assert after(True) == after(False)


def test_later_epochs_do_not_shuffle_sentences(corpus, spark):
    settings = TrainSettings(**{**SMALL.__dict__, "num_partitions": 5, "max_iter": 2})
    placed, side = prepared(corpus, spark, settings)
    weights = training.run_epoch(placed, None, side, settings, 3000, 5, 1).filter("kind != 'note'")

    def plan(direct):
        with shared_tables.unshuffled_buckets(spark):
            rows = training.learner_rows(placed, weights, 5, direct).groupBy("place").applyInArrow(
                training.learner_task(settings, 3000, 5, 2, side, training.weight_path(weights)), training.EPOCH_SCHEMA)
            return rows._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" not in plan(True) and "Bucketed: true" in plan(True) and "Exchange" in plan(False)
    with shared_tables.unshuffled_buckets(spark):
        places = set(placed.select("place", "learner", F.spark_partition_id().alias("p")).collect())
    assert len(places) == len({r["p"] for r in places}) == len({r["learner"] for r in places}) == 5


def test_progress_is_noted_while_an_epoch_runs(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([([f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 900))],) for _ in range(150)],
                                 "tokens array<string>")
    settings = TrainSettings(**{**SMALL.__dict__, "max_iter": 2})
    trained = training.train(rows, settings)
    total = sum(len(r["tokens"]) for r in rows.collect())
    notes = trained.progress.orderBy("epoch", "learner", "step").collect()
    assert len(notes) > 8
    for before, note in zip([None, *notes], notes):
        start = 0 if note["step"] == 1 else before["words"]
        assert note["step"] == 1 or note["step"] == before["step"] + 1
        assert note["words"] - start <= training.PIECE_WORDS + settings.max_sentence_length
        rate = kernel.learning_rate(settings, 2, note["epoch"], note["words"], total)
        assert note["alpha"] == pytest.approx(float(rate)) and 0 < note["progress"] <= 1 and note["words_per_second"] > 0
    last = {(r["epoch"], r["learner"]): r for r in trained.metrics.collect()}
    assert sum(r["words"] for r in last.values()) == 2 * total


OBJECTIVES = [dict(hs=True, negative=0), dict(hs=False, negative=3), dict(hs=True, negative=2)]


@pytest.mark.parametrize("cbow, objective, learners, epochs, sample", [
    *[(cbow, objective, 3, 2, 0.02) for cbow in (0, 1, 2) for objective in OBJECTIVES], (0, OBJECTIVES[2], 1, 1, 0.0)])
def test_one_by_one_equals_the_plain_rule(spark, cbow, objective, learners, epochs, sample):
    """Steps of one example give the vectors of a sequential trainer written in plain Python."""
    rng = random.Random(3)
    words = [f"w{n}" for n in range(14)]
    texts = [[rng.choice(words[:rng.randrange(2, 15)]) for _ in range(rng.randrange(1, 13))] for _ in range(50)]
    settings = TrainSettings(**{**SMALL.__dict__, "vector_size": 5, "cbow": cbow, **objective, "sample": sample, "max_iter": epochs,
                                "num_partitions": learners, "step_examples": 1, "step_size": 0.3, "max_sentence_length": 9})
    rows = spark.createDataFrame([(t,) for t in texts], "tokens array<string>").repartition(3)
    got = vectors(training.train(rows, settings).model)
    want = plain_trainer.fit(texts, settings)
    start = kernel.initial_vectors(settings.seed, len(want), 5)
    assert got.keys() == want.keys()
    assert max(np.abs(got[w] - want[w]).max() for w in want) < 1e-5
    moved = max(np.abs(v - start[i]).max() for i, v in enumerate(want.values()))
    assert moved > 1e-2  # far above the tolerance
