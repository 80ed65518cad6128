import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Normalizer
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec import WordVectors, WordVectorsModel
from lexivec.operators import averaging, documents, models, neighbours
from lexivec.sources import model_store
from lexivec.sources.corpus import check_token_column
from lexivec.streaming.documents import drain, drain_transformed, stream_transform, table_stream

VECTORS = {"a": [1.0, 0.0], "b": [0.0, 2.0], "c": [1.0, 1.0], "d": [-1.0, 0.0], "zero": [0.0, 0.0]}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(w, i, v, 10 - i) for i, (w, v) in enumerate(VECTORS.items())]
    return models.with_norms(spark.createDataFrame(
        rows, "word string, word_id int, vector array<float>, count bigint")).cache()


def pairs(rows):
    return [(r["word"], round(r["similarity"], 6)) for r in rows.collect()]


def test_synonyms(model):
    half = round(math.sqrt(0.5), 6)
    assert pairs(neighbours.find_synonyms(model, "a", 2)) == [("c", half), ("b", 0.0)]
    assert pairs(neighbours.find_synonyms_of_vector(model, [3.0, 0.0], 2)) == [("a", 1.0), ("c", half)]
    assert pairs(neighbours.find_synonyms(model, "a", 99))[-1] == ("d", -1.0)
    assert len(pairs(neighbours.find_synonyms(model, "a", 99))) == 4
    assert pairs(neighbours.find_synonyms_of_vector(model, [0.0, 0.0], 3)) == [
        ("a", 0.0), ("b", 0.0), ("c", 0.0)]
    with pytest.raises(ValueError, match="not in vocabulary"):
        neighbours.find_synonyms(model, "nope", 2)
    with pytest.raises(ValueError, match="positive"):
        neighbours.find_synonyms(model, "a", 0)


@pytest.mark.parametrize("block", [1, 2, 100])
def test_batch_equals_single_queries(model, block):
    asked = model.select(F.col("word").alias("query"), "vector", F.col("word").alias("exclude"))
    got = neighbours.find_synonyms_batch(model, asked, 3, block, block).orderBy("query", "rank").collect()
    for word in VECTORS:
        mine = [(r["word"], round(r["similarity"], 6)) for r in got if r["query"] == word]
        assert mine == pairs(neighbours.find_synonyms(model, word, 3))


def test_document_vectors(spark, model):
    rows = spark.createDataFrame(
        [(1, ["a", "b", "oov"]), (2, []), (3, None), (4, ["oov"]), (5, ["a", None]), (6, ["a"] * 5)],
        "id bigint, tokens array<string>")
    want = {1: [1 / 3, 2 / 3], 2: [0, 0], 3: None, 4: [0, 0], 5: [0.5, 0], 6: [1, 0]}
    forms = [documents.transform_documents(rows, model, "tokens", "vector"),
             documents.transform_documents(rows, model, "tokens", "vector", limit=0),
             documents.mean_vectors_by_join(rows, "id", "tokens", model, 2)]
    for form in forms:
        got = {r["id"]: r["vector"] for r in form.collect()}
        assert got.keys() == want.keys() and got[3] is None
        assert all(got[k] == pytest.approx(want[k]) for k in want if k != 3)


def test_long_documents_are_summed_in_slices(spark, model, monkeypatch):
    rows = spark.createDataFrame([(1, ["a", "b"] * 700), (2, ["b"])], "id bigint, tokens array<string>")
    monkeypatch.setattr(documents, "SLICE_WORDS", 97)
    got = {r["id"]: r["v"] for r in documents.transform_documents(rows, model, "tokens", "v").collect()}
    assert got[1] == pytest.approx([0.5, 1.0]) and got[2] == pytest.approx([0, 2.0])


def test_stream(spark, model, tmp_path):
    rows = spark.createDataFrame([(i, ["a", "b"]) for i in range(20)], "id bigint, tokens array<string>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = drain(stream_transform(stream, model, "tokens", "v"), "stream").collect()
    assert len(got) == 20 and all(r["v"] == [0.5, 1.0] for r in got)
    with pytest.raises(ValueError):
        stream_transform(rows, model, "tokens", "v")


@pytest.mark.parametrize("files", [1, 5])
@pytest.mark.parametrize("limit", [documents.IN_PLACE_LIMIT_BYTES, 0])
def test_stream_of_any_table_and_model(spark, model, tmp_path, files, limit):
    rows = spark.createDataFrame([(i, ["a", "b"]) for i in range(40)], "id bigint, tokens array<string>")
    rows.repartition(files).write.parquet(str(tmp_path / "in.parquet"))
    path = str(tmp_path / "in.parquet")
    if files == 1:
        (part,) = (tmp_path / "in.parquet").glob("part-*")
        path = str(tmp_path / "one.parquet")
        (tmp_path / "one.parquet").write_bytes(part.read_bytes())
    got = drain_transformed(table_stream(spark, path), model, "tokens", "v", "stream", limit).collect()
    assert sorted(r["id"] for r in got) == list(range(40)) and all(r["v"] == [0.5, 1.0] for r in got)


def test_save_and_load(spark, model, tmp_path):
    path = str(tmp_path / "m")
    model_store.save_model(model, path)
    assert sorted(model_store.load_model(spark, path).collect()) == sorted(model.collect())
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        model_store.save_model(model, path)
    with pytest.raises(ValueError, match="expected 6"):
        model_store.load_data(spark, path, 2, 6)
    with pytest.raises(ValueError, match="expected 3"):
        model_store.load_data(spark, path, 3, 5)
    other = str(tmp_path / "other")
    spark.range(1).selectExpr("'x' as class", "'1.0' as version", "2 as vectorSize",
                              "5L as numWords").write.json(f"{other}/metadata")
    with pytest.raises(ValueError, match="not a saved"):
        model_store.load_model(spark, other)


def test_load_checks_the_schema(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([("a", [1.0], 3)], "word string, vector array<double>, count bigint").write.parquet(
        f"{path}/data")
    with pytest.raises(ValueError, match="column"):
        model_store.load_data(spark, path, 1, 1)


def test_file_count():
    assert model_store.file_count(1000, 100, 64 << 20) == 1
    assert model_store.file_count(1_000_000, 100, 64 << 20) == 7
    with pytest.raises(ValueError):
        model_store.file_count(10**12, 300, 1)


def test_model_from_tables(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("x", [1.0, 1.0])],
                                    "word string, vector array<float>")
    counts = spark.createDataFrame([("b", 7), ("a", 7), ("y", 1)], "word string, count bigint")
    got = {r["word"]: (r["word_id"], r["count"]) for r in models.model_from_tables(vectors, counts).collect()}
    assert got == {"a": (0, 7), "b": (1, 7)}
    with pytest.raises(ValueError, match="empty"):
        models.model_from_tables(vectors.filter("false"), counts)
    with pytest.raises(ValueError, match="length"):
        models.model_from_tables(vectors.union(spark.createDataFrame([("y", [1.0])], vectors.schema)), counts)


@pytest.mark.parametrize("kind, error", [("string", TypeError), ("array<int>", TypeError)])
def test_input_column_must_hold_words(spark, kind, error):
    schema = spark.createDataFrame([], f"tokens {kind}, taken array<string>").schema
    with pytest.raises(error):
        check_token_column(schema, "tokens")
    with pytest.raises(ValueError, match="already exists"):
        check_token_column(schema, "taken", "tokens")
    with pytest.raises(ValueError, match="does not exist"):
        check_token_column(schema, "missing")


def test_estimator_in_a_pipeline(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [([f"w{i}" for i in rng.integers(0, 15, 12)],) for _ in range(80)]
    df = spark.createDataFrame(rows + [([],)], "tokens array<string>")
    estimator = (WordVectors(inputCol="tokens", outputCol="features", minCount=1).setVectorSize(8)
                 .setHs(True).setNegative(2).setSeed(3).setNumPartitions(1).setCBOW(1))
    fitted = Pipeline(stages=[estimator, Normalizer(inputCol="features", outputCol="unit")]).fit(df)
    out = fitted.transform(df).select("features", "unit").collect()
    assert len(out) == 81 and len(out[0]["unit"]) == 8 and out[-1]["features"].norm(2) == 0
    path = str(tmp_path / "pipeline")
    fitted.write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert [r["features"] for r in again.transform(df).collect()] == [r["features"] for r in out]
    model, loaded = fitted.stages[0], again.stages[0]
    assert isinstance(loaded, WordVectorsModel) and loaded.uid == model.uid == estimator.uid
    assert loaded.getVectorSize() == 8 and loaded.getCBOW() == 1 and loaded.getNegative() == 2
    near, kept = model.findSynonymsArray("w1", 3), loaded.findSynonymsArray("w1", 3)
    assert [w for w, _ in kept] == [w for w, _ in near]
    assert [s for _, s in kept] == pytest.approx([s for _, s in near])
    assert model.findSynonyms(model.transformWord("w1"), 1).first()["word"] == "w1"
    assert model.getVocab().agg(F.sum("count")).first()[0] == 960
    assert len(model.getVectors().first()["vector"]) == 8
    copied = model.copy({model.outputCol: "other"})
    assert copied.getOutputCol() == "other" and "other" in copied.transform(df).columns
    stored = str(tmp_path / "estimator")
    estimator.save(stored)
    assert WordVectors.load(stored).getSeed() == 3
    with pytest.raises(ValueError):
        WordVectors(inputCol="tokens", outputCol="f", cbow=4).fit(df)
    with pytest.raises(ValueError, match="already exists"):
        WordVectors(inputCol="tokens", outputCol="tokens").fit(df)


def test_vector_sums(spark):
    rng = np.random.default_rng(7)
    rows = [(None if n % 11 == 0 else f"k{n % 9 if n % 3 else 0}", n % 2, None if n % 5 == 0 else rng.normal(size=4).tolist())
            for n in range(700)]
    table = spark.createDataFrame(rows + [("alone", 0, None)], "k string, j int, vector array<double>").repartition(6)
    want = {}
    for k, j, v in rows:
        want.setdefault((k, j), []).extend([] if v is None else [v])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {(r["k"], r["j"]): r["vector"] for r in averaging.parameter_average(table, ["k", "j"], 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.pop(("alone", 0)) is None and got.keys() == want.keys()
    assert all(np.allclose(got[k], np.mean(want[k], axis=0), atol=1e-6) for k in want)
    with pytest.raises(Exception, match="5 elements"):
        averaging.parameter_average(table, ["k", "j"], 5).collect()
    assert averaging.parameter_average(table.filter("false"), ["k", "j"], 4).count() == 0


def test_one_expression_whatever_the_vector_size(spark):
    wide = spark.range(5).select("id", F.array_repeat(F.lit(1.0).cast("float"), 300).alias("vector"))
    plan = averaging.parameter_average(wide, ["id"], 300)._jdf.queryExecution().toString()
    assert plan.count("avg(") == 0 and len(plan) < 20_000


@pytest.mark.parametrize("limit, cell", [(1 << 27, 1 << 22), (300, 40), (0, 7)])
def test_cells_of_counts_and_words(spark, limit, cell):
    rng = np.random.default_rng(3)
    words = [f"w{n}" for n in range(40)]
    vectors = rng.normal(size=(30, 6)).astype(np.float32)
    model = models.with_norms(spark.createDataFrame(
        [(w, n, v.tolist(), 1) for n, (w, v) in enumerate(zip(words, vectors))], "word string, word_id int, vector array<float>, count bigint"))
    texts = [[words[i] for i in rng.integers(0, 40, rng.integers(0, 60))] for _ in range(50)] + [None, [], [None, "w1"], ["x"] * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, tokens array<string>").repartition(3)
    got = {r["id"]: r["vector"] for r in documents.mean_vectors_by_join(rows, "id", "tokens", model, 6, limit, cell).collect()}
    assert len(got) == len(texts)
    for n, text in enumerate(texts):
        if text is None:
            assert got[n] is None
            continue
        known = [vectors[words.index(w)] for w in text if w in words[:30]]
        assert np.allclose(got[n], np.sum(known, axis=0) / max(1, len(text)) if known else np.zeros(6), atol=1e-6)


def blob_model(spark, blobs, per_blob, size, spread):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(blobs, size))
    rows = [(f"w{b}-{n}", b * per_blob + n, (centers[b] + spread * rng.normal(size=size)).astype(np.float32).tolist(), 1)
            for b in range(blobs) for n in range(per_blob)]
    rows += [("nil", len(rows), [0.0] * size, 1), ("zip", len(rows) + 1, [0.0] * size, 1)]
    return rows, models.with_norms(spark.createDataFrame(rows, "word string, word_id int, vector array<float>, count bigint"))


@pytest.mark.parametrize("spread", [0.05, 2.0])
@pytest.mark.parametrize("block, queries", [(40, 16), (7, 1000)])
def test_batch_equals_all_products(spark, spread, block, queries):
    rows, model = blob_model(spark, 12, 30, 8, spread)
    words = [r[0] for r in rows]
    unit = np.array([r[2] for r in rows], np.float64)
    unit /= np.maximum(np.linalg.norm(unit, axis=1), 1e-300)[:, None]
    picked = [0, 5, 100, 359, 360]
    asked = [("same label", rows[i][2], words[i]) for i in picked] + [("open", rows[3][2], None), ("odd", rows[4][2], "unknown")]
    table = spark.createDataFrame(asked, "query string, vector array<float>, exclude string").repartition(2)
    got = neighbours.find_synonyms_batch(model, table, 6, block, queries).collect()
    want = []
    for query, vector, drop in asked:
        v = np.array(vector, np.float32).astype(np.float64)
        scores = unit @ (v / max(np.linalg.norm(v), 1e-300))
        order = sorted((i for i in range(len(words)) if words[i] != drop), key=lambda i: (-round(scores[i], 9), words[i]))[:6]
        want += [(query, k + 1, round(float(scores[i]), 6)) for k, i in enumerate(order)]
    got = sorted((r["query"], r["rank"], round(r["similarity"], 6)) for r in got)
    assert [r[:2] for r in got] == [r[:2] for r in sorted(want)]
    assert np.allclose([r[2] for r in got], [r[2] for r in sorted(want)], atol=2e-6)


def test_bounds_rule_blocks_out(spark):
    rows, model = blob_model(spark, 12, 30, 8, 0.05)
    table, blocks = neighbours.word_blocks(model, 30)
    packed = table.collect()
    assert sorted(w for r in packed for w in r["words"]) == sorted(r[0] for r in rows)
    unit = {r["block"]: np.frombuffer(r["vectors"], np.float64).reshape(len(r["words"]), -1) for r in packed}
    asked = np.concatenate(list(unit.values()))
    bounds = blocks.bounds(asked)
    for block, vectors in unit.items():
        assert (bounds[:, block] >= (asked @ vectors.T).max(axis=1) - 1e-9).all()
    asked = spark.createDataFrame([(n, r[0], r[2], r[0], 0.9) for n, r in enumerate(rows[:-2])],
                                  "number long, query string, asked array<float>, exclude string, `limit` double")
    pairs = neighbours.query_pairs(asked, blocks, True).count()
    assert pairs < 0.4 * 360 * len(blocks.pivot)


def test_word_counts_are_made_in_slices(spark, monkeypatch):
    """A batch of long texts is cut between texts: counts stay whole, and no step holds the words of the whole batch."""
    sizes = []
    cut = documents.word_slices
    monkeypatch.setattr(documents, "word_slices", lambda lists: [sizes.append(len(x.flatten())) or x for x in cut(lists)])
    texts = [[f"w{(i * j) % 97}" for j in range(300)] for i in range(3000)] + [None, []]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.list_(pa.string()))], names=["id", "tokens"])
    count = []

    class Rows:
        schema = T.StructType([T.StructField("id", T.LongType())])

        def select(self, *names):
            return self

        def mapInArrow(self, work, schema):
            count.extend(work(iter([batch])))

    documents.word_counts_of(Rows(), "id", "tokens")
    got = {(k, w): n for b in count for k, w, n in zip(*(b.column(c).to_pylist() for c in range(3)))}
    want = Counter((i, w) for i, t in enumerate(texts) for w in t or [])
    assert got == want and sum(b.num_rows for b in count) == len(want)
    assert sum(sizes) == 900_000 and max(sizes) <= 1 << 18


def test_scores_below_the_limit_are_not_ranked(monkeypatch):
    """Only what reaches the score that a query has already is looked at; a full ranking is left to queries without one."""
    rng = np.random.default_rng(0)
    matrix = rng.normal(size=(4000, 8))
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    block = pa.table({"words": [[f"w{k:04d}" for k in range(4000)]], "vectors": [matrix.tobytes()]})
    asked = matrix[:50]
    true = np.sort(asked @ matrix.T, axis=1)[:, ::-1]
    ranked, partition = [], np.partition
    monkeypatch.setattr(neighbours.np, "partition", lambda x, *a, **k: ranked.append(len(x)) or partition(x, *a, **k))

    def score(limit):
        queries = pa.table({"number": range(50), "query": [str(k) for k in range(50)], "exclude": pa.nulls(50, pa.string()),
                            "asked": [x.tobytes() for x in asked], "limit": limit})
        return neighbours.best_of_block(5)(queries, block).to_pylist()

    every = score(np.full(50, -np.inf))
    assert len(every) == 250 and ranked == [50]
    some = score(true[:, 2])
    assert ranked == [50]
    assert some == [r for r in every if r["similarity"] >= true[r["number"], 2] - 1e-6]
