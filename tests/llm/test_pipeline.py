"""The stages do what they say on the way through, and the run's rows are those of the stages by hand."""

import corpus_pipeline
from lexivec.llm import site_quality, surrogates


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf)
        assert out.dtypes == docs.dtypes, name
        rows = out.collect()
        sizes.append(len(rows))
        seen = spark.createDataFrame(rows, docs.schema)
        if name == "quality classifier":
            kept = {r.doc_id for r in rows}
            good = [d for d, q in labels.items() if q == 1]
            assert sum(d in kept for d in good) >= 0.98 * len(good)
            assert sum(d in kept for d, q in labels.items() if q == 0) <= 0.1 * (len(labels) - len(good))
        if name == "n-gram Jaccard join":
            assert len({r.text for r in rows}) == len(rows)
        if name == "PII":
            assert all(r.n_chars == len(r.text) for r in rows)
            texts = {r.doc_id: r.text for r in docs.collect()}
            for r in rows:
                for m in surrogates.PATTERN.finditer(texts[r.doc_id]):
                    if m.lastgroup in ("email", "secret", "sep", "card"):
                        assert m[0] not in r.text
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, sf).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in rows}
    whole = corpus_pipeline.run(spark, sf).toPandas()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[names].values.tolist())) == sorted(map(tuple, packed[names].values.tolist()))


def test_empty_table(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_evidence_of_a_small_site_leans_on_its_host():
    assert site_quality.N_FEATURES == len(site_quality.text_features(""))
