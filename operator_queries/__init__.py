"""One query per operator over the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.estimator import WordVectors, WordVectorsModel
from lexivec.functions.draws import md5_draw, to_unit
from lexivec.functions.tokens import word_tokens
from lexivec.operators import contexts, documents, encoding, huffman, models, negatives, neighbours
from lexivec.operators import vocabulary as voc
from lexivec.operators.averaging import parameter_average
from lexivec.operators.count_runs import count_runs
from lexivec.operators.lookup import lookup_join
from lexivec.plans import training
from lexivec.plans.schedule import learning_rate_schedule
from lexivec.settings import TrainSettings
from lexivec.sources import model_store
from lexivec.sources.corpus import (
    check_token_column, corpus_tokens, enough_partitions, explode_tokens,
)
from lexivec.sources.dictionary import read_dictionary, write_dictionary
from lexivec.sources.shared_tables import new_path
from lexivec.streaming.documents import drain_transformed, table_stream

ENTRY_DATA = "/root/testdata/sf0.001"

MIN_COUNT = 5
SAMPLE = 1e-3
WINDOW = 5
NEGATIVE = 5
SEED = 42
EPOCH = 1
MAX_LENGTH = 1000
SHORT_LENGTH = 100
CAP = 1000
TOP = 5
SMALL_BUFFER = 16 << 10
KEYS = ("doc_id", "chunk")
SPOT = ("doc_id", "chunk", "pos")
PAIR = ("doc_id", "chunk", "pos", "off")
TRAINING = TrainSettings(vector_size=32, num_partitions=8, seed=SEED)
# At this rate an epoch is a sum over its examples, whatever their order: SQL can take it as well.
SLOW = replace(TRAINING, vector_size=4, step_size=2.0**-30, max_iter=2)
# The trainer adds in single precision.
DIGITS = 2
OBJECTIVES = {
    "skipgram_hs": dict(cbow=0, hs=True, negative=0),
    "skipgram_neg": dict(cbow=0, hs=False),
    "cbow_hs": dict(cbow=1, hs=True, negative=0),
    "cbow_neg": dict(cbow=1, hs=False),
    "concat_hs": dict(cbow=2, hs=True, negative=0, vector_size=2),
    "concat_neg": dict(cbow=2, hs=False, vector_size=2),
    "combined": dict(cbow=1, hs=True),
}


def r6(x: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.when(F.abs(x) < 5e-7, F.lit(0.0)).otherwise(F.round(x, 6))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokens_of(spark: SparkSession, sf: str) -> DataFrame:
    rows = enough_partitions(table(spark, sf, "documents").select("doc_id", "text"))
    return corpus_tokens(rows, "text", "doc_id")


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    counts = voc.word_counts(tokens_of(spark, sf))
    return voc.rank_vocabulary(voc.min_count_filter(counts, MIN_COUNT))


def encoded(spark: SparkSession, sf: str, vocab: DataFrame) -> DataFrame:
    return encoding.encode_keyed(tokens_of(spark, sf), "doc_id", vocab)


def sentences(spark: SparkSession, sf: str, vocab: DataFrame, length: int = MAX_LENGTH) -> DataFrame:
    return encoding.sentence_chunks(encoded(spark, sf, vocab), length, "doc_id")


def examples(spark: SparkSession, sf: str, vocab: DataFrame) -> DataFrame:
    return contexts.training_examples(
        sentences(spark, sf, vocab), WINDOW, SEED, EPOCH, KEYS, voc.keep_probability(vocab, SAMPLE))


def pairs(spark: SparkSession, sf: str, vocab: DataFrame) -> DataFrame:
    return contexts.context_pairs(examples(spark, sf, vocab), KEYS)


def stand_in(spark: SparkSession, sf: str) -> DataFrame:
    """A model without training: the n-th frequent word gets the n-th embedding."""
    vocab = vocabulary(spark, sf)
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("int").alias("word_id"), F.col("embedding").alias("vector"))
    return models.with_norms(vocab.join(vectors, "word_id").select(
        "word", "word_id", "vector", F.col("cnt").alias("count")))


def elements(rows: DataFrame, *keys: str, vector: str = "vector") -> DataFrame:
    """One row per element of a vector."""
    out = rows.select(*keys, F.posexplode(vector).alias("dim", "value"))
    return out.withColumn("value", r6(F.col("value").cast("double")))


def finite(vector: str) -> Column:
    """Whether all elements are numbers of a size that training can have reached."""
    return F.forall(vector, lambda x: F.abs(x) < 1e3)  # false or null for infinities and NaN


def most_frequent(model: DataFrame) -> str:
    return model.filter("word_id = 0").first()["word"]


# Sources and sinks


def q_corpus_tokens(spark, sf):
    return tokens_of(spark, sf).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", " ").alias("tokens"))


def q_dictionary_source(spark, sf):
    path = new_path(spark, "dictionary")
    write_dictionary(voc.word_counts(tokens_of(spark, sf)), f"{path}/documents")
    talk = corpus_tokens(table(spark, sf, "conversations"), "text")
    write_dictionary(voc.word_counts(talk), f"{path}/conversations")
    # Words of both files come twice and are added up.
    return voc.min_count_filter(read_dictionary(spark, f"{path}/*"), MIN_COUNT)


def saved(spark, sf) -> str:
    path = new_path(spark, "saved-model")
    model_store.save_model(stand_in(spark, sf), path)
    return path


def q_model_save(spark, sf):
    return elements(spark.read.parquet(f"{saved(spark, sf)}/data"), "word", "word_id", "count")


def q_model_load(spark, sf):
    loaded = model_store.load_model(spark, saved(spark, sf))
    return elements(loaded, "word", "word_id", "count", "norm").withColumn("norm", r6(F.col("norm")))


def q_model_metadata(spark, sf):
    return model_store.model_metadata(spark, saved(spark, sf))


def q_write_partition_plan(spark, sf):
    return model_store.write_partition_plan(stand_in(spark, sf), SMALL_BUFFER)


# Projections and filters


def q_explode_tokens(spark, sf):
    return explode_tokens(tokens_of(spark, sf), "doc_id")


def q_min_count_filter(spark, sf):
    return voc.min_count_filter(voc.word_counts(tokens_of(spark, sf)), MIN_COUNT)


def q_oov_filter_encode(spark, sf):
    rows = encoding.encode_by_join(tokens_of(spark, sf), "doc_id", vocabulary(spark, sf))
    return rows.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def q_sentence_chunks(spark, sf):
    rows = sentences(spark, sf, vocabulary(spark, sf), SHORT_LENGTH)
    return rows.select("doc_id", "chunk", F.size("ids").alias("n"),
                       F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def q_append_output_column(spark, sf):
    rows = table(spark, sf, "documents").withColumn(
        "tokens", word_tokens("text"))
    out = documents.transform_documents(rows, stand_in(spark, sf), "tokens", "features")
    return out.select("doc_id", "lang", "source", "n_chars", F.size("tokens").alias("n_tokens"),
                      F.size("features").alias("n_features"),
                      r6(F.col("features")[0]).alias("first_feature"))


def q_validate_input_schema(spark, sf):
    tokens = tokens_of(spark, sf)
    check_token_column(tokens.schema, "tokens", "features")
    return tokens.select("doc_id", F.size("tokens").alias("n_tokens"))


def q_word_lookup(spark, sf):
    model = stand_in(spark, sf)
    vector = neighbours.word_lookup(model, most_frequent(model))
    row = model.filter("word_id = 0").select("word", F.lit(vector).alias("vector"))
    return elements(row, "word")


# Aggregations


def q_word_count(spark, sf):
    return voc.word_counts(tokens_of(spark, sf))


def q_train_word_total(spark, sf):
    return voc.train_word_total(vocabulary(spark, sf))


def q_unigram_distribution(spark, sf):
    rows = voc.unigram_distribution(vocabulary(spark, sf))
    return rows.select("word_id", *[r6(F.col(c)).alias(c) for c in ("p", "lo", "hi")])


def q_parameter_average(spark, sf):
    rows = table(spark, sf, "embeddings")
    size = documents.model_size(rows.withColumnRenamed("embedding", "vector"))
    return elements(parameter_average(
        rows.select("label", F.col("embedding").alias("vector")), ["label"], size), "label")


def q_doc_mean_vector(spark, sf):
    model = stand_in(spark, sf)
    return elements(documents.mean_vectors_by_join(
        tokens_of(spark, sf), "doc_id", "tokens", model, documents.model_size(model)), "doc_id")


def q_vector_norms(spark, sf):
    return stand_in(spark, sf).select("word", r6(F.col("norm")).alias("norm"))


def first_epoch(spark, sf, settings: TrainSettings) -> DataFrame:
    """The blocks of weights that one epoch over all documents leaves."""
    tokens = tokens_of(spark, sf)
    vocab = training.learn_vocabulary(tokens, settings)
    side = spark.sparkContext.broadcast(training.side_tables(vocab, settings))
    placed = training.placed_sentences(
        training.encoded_sentences(tokens, vocab, settings), settings.num_partitions, settings.seed)
    total = voc.train_word_total(vocab).first()["total"]
    return training.run_epoch(placed, None, side, settings, total, settings.num_partitions, 1)


def q_modified_rows(spark, sf):
    settings = replace(TRAINING, cbow=1, hs=False, max_iter=2)
    blocks = first_epoch(spark, sf, settings)
    rows = [training.weight_rows(blocks, kind, settings.vector_size).select(F.lit(kind).alias("kind"), "row_id")
            for kind in ("in", "neg")]
    return rows[0].unionByName(rows[1])


# Ranking and limits


def q_vocab_rank(spark, sf):
    return vocabulary(spark, sf)


def q_vocab_cap(spark, sf):
    return voc.cap_vocabulary(vocabulary(spark, sf), CAP, MIN_COUNT)


def q_topk_bounded(spark, sf):
    model = stand_in(spark, sf)
    scores = neighbours.cosine_scores(model, neighbours.word_lookup(model, most_frequent(model)))
    return similarities(neighbours.top_scores(scores, 2 * TOP))


def similarities(rows: DataFrame) -> DataFrame:
    return rows.withColumn("similarity", r6(F.col("similarity")))


# Joins


def q_join_vectors_counts(spark, sf):
    model = stand_in(spark, sf)
    counts = vocabulary(spark, sf).select("word", F.col("cnt").alias("count"))
    rows = models.join_vectors_counts(models.get_vectors(model), counts)
    return rows.select("word", "count", r6(F.col("vector")[0].cast("double")).alias("first"))


def q_token_id_join(spark, sf):
    return encoding.token_ids(tokens_of(spark, sf), "doc_id", vocabulary(spark, sf))


def q_token_vector_join(spark, sf):
    words = explode_tokens(tokens_of(spark, sf), "doc_id")
    model = stand_in(spark, sf).select("word", "vector")
    joined = lookup_join(words, model, "word", ("doc_id", "pos"), "left")
    first = F.coalesce(F.get("vector", F.lit(0)).cast("double"), F.lit(0.0))
    return joined.groupBy("doc_id").agg(
        F.count("vector").alias("known"), F.count(F.lit(1)).alias("n"), r6(F.sum(first)).alias("first_sum"))


def q_context_pairs(spark, sf):
    rows = contexts.training_examples(
        sentences(spark, sf, vocabulary(spark, sf)), WINDOW, SEED, EPOCH, KEYS)
    found = contexts.context_pairs(rows, KEYS)
    product = F.col("center").cast("bigint") * F.col("context")
    return found.groupBy("doc_id", "chunk").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(product).alias("products"),
        F.sum(F.col("off") * F.col("context")).alias("weighted"))


def q_negative_interval_join(spark, sf):
    vocab = vocabulary(spark, sf)
    spots = contexts.center_rows(sentences(spark, sf, vocab), WINDOW, *KEYS).select(*SPOT)
    draws = spots.withColumn("u", to_unit(md5_draw(SEED, EPOCH, *SPOT, F.lit("u"))))
    found = negatives.interval_join(draws, voc.unigram_distribution(vocab))
    return found.groupBy("target").agg(
        F.count(F.lit(1)).alias("draws"), F.sum("pos").alias("positions"))


def q_cosine_scores(spark, sf):
    model = stand_in(spark, sf)
    vector = neighbours.word_lookup(model, most_frequent(model))
    return similarities(neighbours.cosine_scores(model, vector))


# Sampling and training tables


def q_keep_probability(spark, sf):
    rows = voc.keep_probability(vocabulary(spark, sf), SAMPLE)
    return rows.select("word_id", r6(F.col("keep")).alias("keep"))


def q_subsample_centers(spark, sf):
    vocab = vocabulary(spark, sf)
    rows = contexts.center_rows(sentences(spark, sf, vocab), WINDOW, *KEYS)
    kept = contexts.subsample_centers(rows, voc.keep_probability(vocab, SAMPLE), SEED, EPOCH, SPOT)
    return kept.select(*SPOT, "center")


def q_dynamic_radius(spark, sf):
    rows = contexts.center_rows(sentences(spark, sf, vocabulary(spark, sf)), WINDOW, *KEYS)
    return rows.select(*SPOT, contexts.dynamic_radius(WINDOW, SEED, EPOCH, SPOT).alias("radius"))


def q_negative_samples(spark, sf):
    vocab = vocabulary(spark, sf)
    drawn = negatives.negative_samples(
        examples(spark, sf, vocab).select(*SPOT, "center"), voc.unigram_distribution(vocab),
        NEGATIVE, SEED, EPOCH, SPOT)
    return drawn.groupBy("target").agg(
        F.count(F.lit(1)).alias("draws"), F.sum("center").alias("centers"), F.sum("draw").alias("numbers"))


def q_training_examples_cbow(spark, sf):
    rows = examples(spark, sf, vocabulary(spark, sf))
    return rows.select(*SPOT, "center", "radius",
                       F.array_join(F.col("ctx").cast("array<string>"), " ").alias("ctx"))


def q_training_examples_concat(spark, sf):
    rows = contexts.concat_slots(examples(spark, sf, vocabulary(spark, sf)), KEYS)
    return rows.groupBy("doc_id", "chunk", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.sum("context").alias("contexts"),
        F.sum(F.col("center").cast("bigint") * F.col("pos")).alias("spots"))


def q_init_vectors(spark, sf):
    words = vocabulary(spark, sf).count()
    return training.init_vectors(spark, words, TRAINING).select(
        "word_id", F.size("vector").alias("n"), *[F.round(f("vector").cast("double"), 8).alias(name) for f, name in
                                                  ((F.array_max, "high"), (F.array_min, "low"))])


def q_shuffle_sentences(spark, sf):
    rows = training.encoded_sentences(tokens_of(spark, sf), vocabulary(spark, sf), TRAINING)
    placed = training.placed_sentences(rows, TRAINING.num_partitions, SEED)
    return placed.select("sentence", "learner", "turn", F.size("ids").alias("n"), F.col("ids")[0].alias("first"))


# Training


def checked_model(model: DataFrame) -> DataFrame:
    """What is determined of a trained model, and whether its numbers are sound."""
    return model.select("word", "word_id", "count", F.size("vector").alias("n"), (
        finite("vector") & (F.col("norm") > 0)).alias("sound"))


def training_query(**changes):
    """Per output weight what an epoch has added to it, in units of the starting rate."""
    settings = replace(SLOW, **changes)

    def run(spark, sf):
        blocks = first_epoch(spark, sf, settings)
        kinds = ["hs"] * settings.hs + ["neg"] * (settings.negative > 0)
        rows = [training.weight_rows(blocks, k, settings.output_size).select(
            F.lit(k).alias("kind"), "row_id", F.posexplode("vector").alias("dim", "v")) for k in kinds]
        value = F.col("v").cast("double") / settings.step_size
        out = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        return out.select("kind", "row_id", "dim", F.when(
            F.abs(value) < 0.5 * 10**-DIGITS, F.lit(0.0)).otherwise(F.round(value, DIGITS)).alias("value"))

    return run


def q_hs_training_rows(spark, sf):
    vocab = vocabulary(spark, sf)
    codes = huffman.huffman_codes(vocab, huffman.huffman_tree(count_runs(vocab)))
    rows = huffman.hs_training_rows(pairs(spark, sf, vocab), codes, PAIR)
    return rows.groupBy("node", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("context").alias("contexts"))


def q_neg_training_rows(spark, sf):
    vocab = vocabulary(spark, sf)
    rows = negatives.neg_training_rows(
        pairs(spark, sf, vocab), voc.unigram_distribution(vocab), NEGATIVE, SEED, EPOCH, PAIR)
    return rows.groupBy("target", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("context").alias("contexts"),
        F.sum("center").alias("centers"))


def q_learning_rate_schedule(spark, sf):
    """The rate each sentence starts with in the second of two epochs."""
    vocab = vocabulary(spark, sf)
    placed = training.shuffle_sentences(
        training.encoded_sentences(tokens_of(spark, sf), vocab, TRAINING), TRAINING.num_partitions, SEED)
    total = voc.train_word_total(vocab).first()["total"]
    out = learning_rate_schedule(placed, ("turn", "sentence"), TRAINING.step_size, TRAINING.num_partitions, 2, 2, total)
    return out.select("learner", "sentence", "words_before", F.round("alpha", 9).alias("alpha"))


def q_fit_epochs(spark, sf):
    result = training.train(tokens_of(spark, sf), replace(TRAINING, hs=False, max_iter=2))
    losses = {r["epoch"]: r["loss"] for r in result.metrics.groupBy("epoch").agg(
        (F.sum(F.col("loss") * F.col("examples")) / F.sum("examples")).alias("loss")).collect()}
    return checked_model(result.model).withColumn("learned", F.lit(losses[2] < losses[1]))


def q_training_metrics(spark, sf):
    result = training.train(tokens_of(spark, sf), replace(TRAINING, cbow=1, hs=False, max_iter=2))
    notes = result.progress.groupBy("epoch", "learner").agg(
        F.max("words").alias("noted"), F.min((F.col("words_per_second") > 0) & (F.col("loss") > 0)).alias("sound"))
    # Seconds and losses differ from run to run or are not known in advance.
    return result.metrics.join(notes, ["epoch", "learner"]).select(
        "epoch", "learner", "progress", "words", "examples", "noted", F.round("alpha", 9).alias("alpha"), "sound")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Trains on the documents and lists the neighbours of every word."""
    estimator = WordVectors(inputCol="tokens", outputCol="features", vectorSize=32, hs=False,
                            maxIter=2, numPartitions=8, seed=SEED)
    model = estimator.fit(tokens_of(spark, sf))
    asked = model.table.select(
        F.col("word").alias("query"), "vector", F.col("word").alias("exclude"))
    return similarities(model.findSynonymsBatch(asked, TOP))


def q_flagship_counts(spark, sf):
    return flagship(spark, sf).groupBy("query").agg(
        F.count("word").alias("found"), F.max("rank").alias("last"),
        F.min(F.abs("similarity") <= 1.000001).alias("sound"),
        F.max((F.col("word") == F.col("query")).cast("int")).alias("itself"))


# Serving


def q_get_vectors(spark, sf):
    return elements(models.get_vectors(stand_in(spark, sf)), "word")


def q_get_vocab(spark, sf):
    return models.get_vocab(stand_in(spark, sf))


def q_find_synonyms_word(spark, sf):
    model = stand_in(spark, sf)
    return similarities(neighbours.find_synonyms(model, most_frequent(model), TOP))


def q_find_synonyms_vector(spark, sf):
    model = stand_in(spark, sf)
    vector = neighbours.word_lookup(model, most_frequent(model))
    return similarities(neighbours.find_synonyms_of_vector(model, vector, TOP))


def q_find_synonyms_batch(spark, sf):
    model = stand_in(spark, sf)
    asked = model.select(F.col("word").alias("query"), "vector", F.col("word").alias("exclude"))
    return similarities(neighbours.find_synonyms_batch(model, asked, TOP))


def q_transform_documents(spark, sf):
    out = documents.transform_documents(tokens_of(spark, sf), stand_in(spark, sf), "tokens", "vector")
    return elements(out, "doc_id")


def q_stream_transform_documents(spark, sf):
    tokens = corpus_tokens(table_stream(spark, f"{sf}/documents.parquet"), "text", "doc_id")
    out = drain_transformed(tokens, stand_in(spark, sf), "tokens", "vector", "stream")
    return elements(out.select("doc_id", "vector"), "doc_id")


def q_model_from_table(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vector"))
    counts = table(spark, sf, "documents").select(
        F.pmod("doc_id", F.lit(1000)).cast("string").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("count"))
    model = WordVectorsModel.fromTables(vectors, counts)
    return model.table.select("word", "word_id", "count", r6(F.col("norm")).alias("norm"))


QUERIES = {
    **{name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and name != "q_flagship_counts"},
    **{f"train_{name}": training_query(**changes) for name, changes in OBJECTIVES.items()},
    "flagship_fit": q_flagship_counts,
}
