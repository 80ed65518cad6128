"""One query per operator, and the SQL to check those that SQL can express."""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.llm import (bpe, centroid_search, class_lm, fill_middle, licenses, metric_search, packing, shingle_join,
                         site_quality, suffix_repeats, surrogates, url_filter, winnowing)
from lexivec.llm.common import read

LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    pages = read(spark, sf, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules).drop("url")


OP1_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS r
  FROM pages),
parts AS (
  SELECT row_number() OVER () AS n, page_id,
    coalesce(translate(regexp_extract(r, '^[^/?#]*', 0), {LOWER}), '') AS host,
    coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest),
rules(h, p, action) AS (VALUES {", ".join(map(str, URL_RULES))}),
fits AS (
  SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (n)
"""


def op10_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf, "documents"), *licenses.license_tables(spark))


def op2_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    rows = winnowing.edited_fingerprints(read(spark, sf, "documents"))
    rows = rows.withColumn("own", winnowing.hashes(F.col("fingerprint")))
    return rows.select(
        F.col("id").alias("doc_id"), F.col("chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), winnowing.written(F.col("fingerprint")).alias("fingerprint"),
        winnowing.written(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("own"), winnowing.hashes(F.col("edited_fingerprint"))).alias("near_edited"),
        winnowing.likeness(F.col("own"), F.col("next_hashes")).alias("near_next"))


def op3_class_lm(spark: SparkSession, sf: str) -> DataFrame:
    return class_lm.score_documents(read(spark, sf, "documents"))


def op4_shingle_join(spark: SparkSession, sf: str) -> DataFrame:
    return shingle_join.near_duplicates(read(spark, sf, "documents")).drop("node", "component")


def op5_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return metric_search.top_k(read(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _parts(column: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array(translate({column}, {LOWER}), {_quoted(licenses.BREAKS)}), "
            f"lambda x: trim(regexp_replace(x, {_quoted(licenses.SYMBOLS)}, ' ', 'g'))), lambda x: x <> '')")


OP10_SQL = f"""
WITH given(sentence_id, sentence) AS (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in licenses.SENTENCES.items())}),
known AS (SELECT sentence_id, {_parts("sentence")} AS k FROM given),
rules(license, ids) AS (VALUES {", ".join(f"({_quoted(n)}, {ids})" for n, ids in licenses.RULES)}),
docs AS (SELECT row_number() OVER () AS d, doc_id, {_parts("text")} AS p FROM (SELECT DISTINCT doc_id, text FROM documents)),
sentences AS (SELECT d, doc_id, p, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM docs),
spots AS (
  SELECT d, doc_id, sentence_id, i - 1 AS start, i - 1 + len(k) AS stop
  FROM sentences JOIN known ON s = k[1] AND p[i:i + len(k) - 1] = k),
chains AS (
  SELECT a.d, a.doc_id, license, ids, a.start AS f,
    CASE len(ids) WHEN 1 THEN a.stop WHEN 2 THEN b.stop WHEN 3 THEN c.stop END - 1 AS l
  FROM rules JOIN spots a ON a.sentence_id = ids[1]
  LEFT JOIN spots b ON b.d = a.d AND b.sentence_id = ids[2] AND b.start = a.stop
  LEFT JOIN spots c ON c.d = b.d AND c.sentence_id = ids[3] AND c.start = b.stop)
SELECT DISTINCT d, doc_id, license, array_to_string(ids, ' ') AS sentence_ids, f::INTEGER AS first_sentence,
  l::INTEGER AS last_sentence
FROM chains x
WHERE l IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM chains o WHERE o.d = x.d AND o.f <= x.f AND o.l >= x.l AND o.l - o.f > x.l - x.f)
"""
OP10_SQL = f"SELECT * EXCLUDE (d) FROM ({OP10_SQL})"  # rules have at most three sentences

OP5_SQL = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
  FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


BPE_DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                            T.StructField("decoded_sha256", T.StringType())])


def bpe_digests(ids, coder):
    values = ids.tolist()
    return (len(values), hashlib.sha256(",".join(map(str, values)).encode()).hexdigest(),
            hashlib.sha256(coder.decode(values).encode()).hexdigest())


def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return bpe.encode_texts(docs, tokenizer_path("byte_bpe_50k.json"), finish=bpe_digests, made=BPE_DIGESTS)


def op7_site_quality(spark: SparkSession, sf: str) -> DataFrame:
    judged = site_quality.judge_quality(read(spark, sf, "documents"), read(spark, sf, "labels"))
    return judged.select("doc_id", "evidence", "host_rate", "path_rate", "quality", "keep")


SURROGATE_KEY = "lexivec"


def op8_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return surrogates.replace_personal_data(docs, SURROGATE_KEY)


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return centroid_search.cluster_vectors(read(spark, sf, "embeddings"))


def _op11_sql(clusters: int = 8, rounds: int = 10, size: int = 64) -> str:
    parts = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS cluster, v AS c
  FROM kept ORDER BY cluster LIMIT {clusters})"""]
    for k in range(rounds + 1):
        parts.append(f"""
a{k} AS MATERIALIZED (
  SELECT n, vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d
  FROM (SELECT kept.*, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM kept, c{k})
  GROUP BY ALL)""")
        if k < rounds:
            parts.append(f"""
c{k + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, c{k}.c) AS c FROM c{k} LEFT JOIN (
    SELECT cluster, list(mean ORDER BY i) AS c FROM (
      SELECT cluster, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS mean
      FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY ALL)
    GROUP BY cluster) m USING (cluster))""")
    return f"""WITH {",".join(parts)}
SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


def op12_suffix_repeats(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffix_repeats.cut_texts(read(spark, sf, "documents")).select(
        "key", F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    docs = read(spark, sf, "documents").select("doc_id", "text")
    rows = suffix_repeats.per_document(docs, cut, other={
        "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.col("key")})
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP12_SQL = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT d, h, unnest(range(0, length(h) // 2 - {suffix_repeats.MIN_BYTES - 1})) AS i FROM docs),
named AS MATERIALIZED (SELECT d, i, md5_number(substr(h, 2 * i + 1, {2 * suffix_repeats.MIN_BYTES})) AS s FROM starts),
met AS (SELECT s FROM named GROUP BY s HAVING count(*) > 1),
found AS (SELECT d, i, lag(i) OVER w AS before FROM named JOIN met USING (s) WINDOW w AS (PARTITION BY d ORDER BY i)),
runs AS (
  SELECT d, i, sum(CASE WHEN before IS NULL OR i > before + {suffix_repeats.MIN_BYTES} THEN 1 ELSE 0 END)
    OVER (PARTITION BY d ORDER BY i) AS run
  FROM found),
spans AS (SELECT d, run, min(i) AS a, max(i) + {suffix_repeats.MIN_BYTES} AS b FROM runs GROUP BY ALL),
listed AS (
  SELECT d, list(b ORDER BY a) AS stops, list(a ORDER BY a) AS starts, sum(b - a)::BIGINT AS n_removed,
    count(*) AS n_spans
  FROM spans GROUP BY d)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN unhex(h) ELSE unhex(array_to_string(list_transform(
    list_zip([0] || stops, starts || [length(h) // 2]), lambda z: substr(h, 2 * z[1] + 1, 2 * (z[2] - z[1]))), '')) END)
    AS kept_sha256
FROM docs LEFT JOIN listed USING (d)
"""


def op13_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    rows = fill_middle.fill_in_middle(read(spark, sf, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS r1,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS r2,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>')
      OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM docs),
cut AS (
  SELECT *, array_to_string(u[1:least(r1, r2)], '') AS pre, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS mid,
    array_to_string(u[greatest(r1, r2) + 1:], '') AS suf
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM cut
"""


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:2] == "op" and callable(fn)}
ORACLE = {"op1_url_filter": OP1_SQL, "op5_top_k": OP5_SQL, "op10_license_scan": OP10_SQL,
          "op11_centroids": _op11_sql(), "op12_suffix_repeats": OP12_SQL, "op13_fill_middle": OP13_SQL}
