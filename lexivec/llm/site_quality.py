"""Document quality from text evidence and the standing of the document's site.

A logistic model reads the text; hosts and paths get beta posteriors from grouped sums of what it
found, shrunk towards the host's and the global rate as far as their size and spread warrant.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.llm.common import fresh, small
from lexivec.sources.shared_tables import write_table

LABELLED_ROWS = 20_000
BROADCAST_SITES = 1 << 18
SALTS = 16
THRESHOLD = 0.5

# Everything but ASCII signs that are neither letter, digit nor white space.
PLAIN = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or b <= 32)
NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)


def text_features(text: str) -> list[float]:
    """Shares of signs, digits, table bars, repeated neighbours, repeated words and repeated lines, and
    the log mean word length. Each share is drawn to a usual value by a few imaginary observations, so short
    texts stay near it. An empty text has the usual values."""
    data = text.encode()
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x]
    solid = sum(map(len, words))
    signs = len(data.translate(None, PLAIN))
    digits = len(data.translate(None, NOT_DIGIT))
    return [
        (signs + 1) / (solid + 40),
        (digits + 0.1) / (solid + 100),
        text.count("|") / (n + 10),
        sum(map(eq, words, words[1:])) / (n + 10),
        (n - len(set(words)) + 2) / (n + 10) / math.log(n + 10),
        (len(lines) - len(set(lines))) / (len(lines) + 3),
        math.log((solid + 50) / (n + 10)),
    ]


N_FEATURES = 7


@dataclass
class TextModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept
    base: float  # log odds of the labels it was fitted on

    def evidence(self, features: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad, bounded."""
        z = (features - self.mean) / self.scale
        # No feature may count beyond what the fit has seen much of.
        z = np.clip(z, -8, 8)
        return np.clip(z @ self.weights[:-1] + self.weights[-1] - self.base, -30, 30)


def fit_text_model(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 50) -> TextModel:
    """Ridge logistic regression by Newton steps. Without labels all evidence is 0."""
    width = features.shape[1]
    if not len(labels):
        return TextModel(np.zeros(width), np.ones(width), np.zeros(width + 1), 0.0)
    mean, scale = features.mean(axis=0), features.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = np.column_stack([np.clip((features - mean) / scale, -8, 8), np.ones(len(labels))])
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 1e-3
    w = np.zeros(width + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (labels - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    good = labels.sum()
    return TextModel(mean, scale, w, math.log((good + 0.5) / (len(labels) - good + 0.5)))


def with_features(docs: DataFrame, text: str, name: str, model: TextModel | None = None) -> DataFrame:
    """``docs`` plus the features of ``text`` (null: empty) or, with a model, their evidence."""
    kind = T.DoubleType() if model else T.ArrayType(T.DoubleType())
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(t or "") for t in batch.column(text).to_pylist()]
            if model:
                found = pa.array(model.evidence(np.array(rows).reshape(len(rows), N_FEATURES)))
            else:
                found = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=schema.names)

    return docs.mapInArrow(read, schema)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def bounded(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))


def strength(n: str, good: str, centre: Column, groups: DataFrame) -> float:
    """Imaginary documents behind the prior of a level, from the spread of its groups' rates around their
    centre beyond what chance gives (method of moments). Groups of one tell nothing of spread."""
    size, rate = F.col(n), F.col(good) / F.col(n)
    chance = centre * (1 - centre)
    row = groups.filter(size > 1).agg(
        F.sum(size * (rate - centre) ** 2), F.sum(chance), F.sum((size - 1) * chance)).first()
    spread, by_chance, scale = (float(v or 0.0) for v in row)
    excess = spread - by_chance  # estimates scale / (prior + 1)
    return float(np.clip(scale / excess - 1, 1.0, 1e6)) if excess > 0 and scale > 0 else 1e6


def site_table(evidence: DataFrame, base: float) -> tuple[DataFrame, float]:
    """Per (host, path) the sums behind its posterior, from rows (host, path, evidence).

    Partial sums are combined before the shuffle, so a host with a third of all rows is a few rows.
    Returns host, path, n, good, prior_n, prior_good, where the latter two are the path's prior as imaginary
    documents, and the global rate.
    """
    chance = F.lit(1.0) / (1 + F.exp(-(F.col("evidence") + base)))
    paths = write_table(evidence.groupBy("host", "path").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(chance).alias("good")), "paths")
    n, good = paths.agg(F.sum("n"), F.sum("good")).first()
    rate = ((good or 0.0) + 0.5) / ((n or 0.0) + 1.0)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    host_weight = strength("host_n", "host_good", F.lit(rate), hosts)
    hosts = hosts.select(F.col("host").alias("of_host"), "host_n", "host_good", (
        (F.col("host_good") + host_weight * rate) / (F.col("host_n") + host_weight)).alias("host_rate"))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
    path_weight = strength("n", "good", bounded(F.col("host_rate")), both)
    return both.select("host", "path", "n", "good", "host_n", "host_good").withColumns({
        "path_weight": F.lit(path_weight), "host_weight": F.lit(host_weight)}), rate


def judge_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: str = "text",
                  key: str = "doc_id", label: str = "quality", labelled_rows: int = LABELLED_ROWS,
                  threshold: float = THRESHOLD, broadcast_sites: int = BROADCAST_SITES) -> DataFrame:
    """``docs`` plus evidence, host_rate, path_rate, quality (probability of being good) and keep.

    The text model is fitted on at most ``labelled_rows`` labelled documents (those first by a hash of the
    id; several labels of one id are averaged, null ids and labels left out). Its evidence for every document
    feeds the posteriors of hosts and of paths below hosts. A document is judged by its own evidence and the rate
    of its path without itself, which falls back on the host and then on the global rate.
    Kept is what reaches ``threshold``.

    A null text counts as empty, null hosts and paths are groups like others, repeated rows are
    judged alike, and without labels everything is kept. Columns of ``docs`` with the name of a made
    column are replaced.

    Two reads of the documents, no shuffle of texts: the site table is broadcast when small, else
    joined with a salted copy per row.
    """
    made = ("evidence", "host_rate", "path_rate", "quality", "keep")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])
    taken = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("double").alias("label"))
    taken = taken.dropna().groupBy("key").agg(F.avg("label").alias("label"))
    taken = taken.orderBy(F.xxhash64("key"), "key").limit(labelled_rows)
    first = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{host}`").alias("host"),
                        F.col(f"`{path}`").alias("path"), F.col(f"`{text}`").alias("text"))
    features = write_table(with_features(first, "text", "features").drop("text"), "features")
    sample = features.join(F.broadcast(taken), "key").select("features", "label").limit(labelled_rows).toPandas()
    model = fit_text_model(np.array(sample["features"].tolist()).reshape(len(sample), N_FEATURES),
                           sample["label"].to_numpy(dtype=float))
    terms = [(F.col("features")[k], float(m), float(s), float(w)) for k, (m, s, w) in
             enumerate(zip(model.mean, model.scale, model.weights))]
    z = sum((F.least(F.greatest((f - m) / s, F.lit(-8.0)), F.lit(8.0)) * w for f, m, s, w in terms), F.lit(0.0))
    score = F.least(F.greatest(z + float(model.weights[-1] - model.base), F.lit(-30.0)), F.lit(30.0))
    sites, rate = site_table(features.select("host", "path", score.alias("evidence")), model.base)

    site = fresh(docs, "site_host", "site_path", "n", "good", "host_n", "host_good", "path_weight", "host_weight")
    sites = sites.toDF(*site)
    site_host, site_path, n, good, host_n, host_good, path_weight, host_weight = (F.col(c) for c in site)
    judged = with_features(docs, text, "evidence", model)
    same = F.col(f"`{host}`").eqNullSafe(site_host) & F.col(f"`{path}`").eqNullSafe(site_path)
    if small(sites, broadcast_sites, *[c for c, t in sites.dtypes if t == "string"]):
        joined = judged.join(F.broadcast(sites), same)
    else:
        salt, copy = fresh(docs, "salt", "copy")
        sites = sites.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = judged.withColumn(salt, F.pmod(F.xxhash64(f"`{key}`", f"`{text}`"), F.lit(SALTS)).cast("int"))
        joined = judged.join(sites, same & (F.col(salt) == F.col(copy))).drop(salt, copy)
    # The rate of the site's other documents.
    own = F.lit(1.0) / (1 + F.exp(-(F.col("evidence") + model.base)))
    host_rate = (host_good - own + host_weight * rate) / (host_n - 1 + host_weight)
    path_rate = (good - own + path_weight * bounded(host_rate)) / (n - 1 + path_weight)
    out = joined.withColumns({"host_rate": bounded(host_rate), "path_rate": bounded(path_rate)}).drop(*site)
    odds = F.col("evidence") + logit(F.col("path_rate"))
    out = out.withColumn("quality", F.lit(1.0) / (1 + F.exp(-odds)))
    keep = F.lit(True) if sample.empty else F.col("quality") >= threshold
    return out.withColumn("keep", keep)
