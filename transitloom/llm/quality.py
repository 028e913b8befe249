"""Operator 3: document quality by hierarchical empirical Bayes.

A logistic classifier on cheap text statistics, trained on a bounded sample of labelled
documents, gives each document's own evidence. Sites and their sections sum the evidence of
their documents in grouped aggregates. A section's mean is shrunk towards its site's and a
site's towards the global one, by prior strengths that the method of moments reads off the
spread between groups; so a sparse site says little and a large one speaks for itself. A
document's posterior adds what its section (without the document itself) tells beyond the
global mean to its own log odds.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, if_small, text_or_empty, written

FEATURES = ["bias", "words", "distinct", "repeats", "symbols", "shouts", "bars", "capitals", "digits", "word length", "lines", "distinct lines", "longest"]
CAPITALS = bytes(range(65, 91))
#: The prior strengths' bounds, in documents.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1e4


def statistics(text: str) -> list[float]:
    data = text.encode()
    found, size = data.split(), max(1, len(data))
    n, lines = max(1, len(found)), data.split(b"\n")
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    repeats = sum(map(operator.eq, found, found[1:])) / n
    return [
        1.0,
        np.log1p(len(found)) / 5,
        len(set(found)) / n,
        repeats**0.5,
        share(b"#$%&*") ** 0.5,
        share(b"!") ** 0.5,
        share(b"|") ** 0.5,
        share(CAPITALS) ** 0.5,
        share(b"0123456789") ** 0.5,
        size / n / 10,
        np.log1p(len(lines)) / 5,
        len(set(lines)) / len(lines),
        np.log1p(max(map(len, found), default=0)) / 5,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps on the penalised log loss; the bias alone where there is one label only."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = 0.0 if not len(y) else 3.0 if y[0] else -3.0
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class QualityModel:
    """The classifier's weights, the global mean, the prior strengths, and sums by section (host, path, n, total, host_n, host_total)."""

    weights: np.ndarray
    mean: float
    host_prior: float
    path_prior: float
    sections: DataFrame


def evidence(text: Column, weights: np.ndarray) -> Column:
    """Log odds of good quality from the text alone."""

    @F.pandas_udf("double")
    def own(texts: pd.Series) -> pd.Series:
        odds = np.array([statistics(t) for t in texts]).reshape(-1, len(weights)) @ weights
        give_back()
        return pd.Series(odds)

    return own(text)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> np.ndarray:
    """Weights from at most ``sample`` labelled documents, chosen by a hash of their ids."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = known.groupBy(id_col).agg(F.min(label_col).cast("double").alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["id", "label", "x"])

    # at most ``sample`` rows of an id and a label: a bounded broadcast; rows that repeat an id count as their mean
    joined = docs.select(id_col, text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), id_col).select(id_col, "label", "text")
    measured = joined.mapInArrow(measure, f"id {docs.schema[id_col].dataType.simpleString()}, label double, x array<double>")
    means = F.array(*[F.avg(F.col("x")[k]) for k in range(len(FEATURES))])
    rows = measured.groupBy("id", "label").agg(means.alias("x")).collect()
    rows.sort(key=lambda r: (r.label, r.x))
    return fit_logistic(np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.label for r in rows]))


def _strength(groups: DataFrame, mean: float, n: str, total: str, center: Column, center_n: Column, centers: int) -> float:
    """Prior strength in documents: what groups' means vary around those that they shrink to, beyond the sampling of their documents.

    ``center`` and ``center_n`` are the mean and the documents of a group's larger one, of
    which there are ``centers``: the corpus for sites, its site for a section.
    """
    size, share = F.col(n), F.col(total) / F.col(n)
    row = groups.filter(size > 0).agg(F.sum(size * (share - center) ** 2).alias("spread"), F.count("*").alias("groups"), F.sum(size - size * size / center_n).alias("even")).first()
    free, within = row.groups - centers, mean * (1 - mean)
    if free < 1 or row.even <= 0:
        return MOST_PRIOR
    between = (row.spread - free * within) / row.even
    return float(np.clip(within / between - 1, LEAST_PRIOR, MOST_PRIOR)) if between > 0 else MOST_PRIOR


def fit_quality(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8000) -> QualityModel:
    """The classifier, and the sums of all documents' evidence by section and site."""
    bounded_batches(docs.sparkSession)
    weights = train(docs, labels, id_col, text_col, label_col, sample)
    odds = docs.select(host.alias("host"), path.alias("path"), evidence(text_or_empty(text_col), weights).alias("odds"))
    good = 1 / (1 + F.exp(-F.col("odds")))
    paths = written(odds.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(good).alias("total")), "quality-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total")), "quality-hosts")
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_total").alias("total"), F.count("*").alias("sites")).first()
    mean = float(np.clip(whole.total / whole.n, 1e-6, 1 - 1e-6)) if whole.n else 0.5
    same = F.col("host").eqNullSafe(F.col("of_host"))
    sections = written(paths.join(hosts.withColumnRenamed("host", "of_host"), same).drop("of_host"), "quality-sections")
    host_prior = _strength(hosts, mean, "host_n", "host_total", F.lit(mean), F.lit(whole.n), 1)
    path_prior = _strength(sections, mean, "n", "total", F.col("host_total") / F.col("host_n"), F.col("host_n"), whole.sites)
    return QualityModel(weights, mean, host_prior, path_prior, sections)


def judge(rows: DataFrame, model: QualityModel, *, host: Column, path: Column, text: Column, least: float = 0.5) -> DataFrame:
    """(row, host, path, own_odds, host_mean, path_mean, score, good): ``row`` holds the input row as it was."""
    odds = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), host.alias("host"), path.alias("path"), evidence(text, model.weights).alias("own_odds"))
    sections = if_small(model.sections.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "total", "host_n", "host_total"), 128)
    found = odds.join(sections, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    own = 1 / (1 + F.exp(-F.col("own_odds")))
    # the document itself is taken out of what its section and site say
    host_mean = (F.col("host_total") - own + model.host_prior * model.mean) / (F.col("host_n") - 1 + model.host_prior)
    found = found.withColumn("host_mean", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), host_mean)))
    path_mean = (F.col("total") - own + model.path_prior * F.col("host_mean")) / (F.col("n") - 1 + model.path_prior)
    found = found.withColumn("path_mean", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path_mean)))
    logit = lambda p: F.log(p / (1 - p))
    told = F.col("own_odds") + logit(F.col("path_mean")) - logit(F.lit(model.mean))
    return found.withColumn("score", 1 / (1 + F.exp(-told))).withColumn("good", F.col("score") >= least).drop("h", "p", "n", "total", "host_n", "host_total")


def classify_quality(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8000, least: float = 0.5) -> DataFrame:
    """(id, host, path, own_odds, host_mean, path_mean, score, good), a row for each document.

    host and path: columns that name a document's site and its section; null is a name of its
    own. Null and empty texts are judged by the statistics of no words. Labels of unknown or
    null ids and null labels teach nothing; of repeated labels the smaller counts. Without
    labels of both kinds the classifier says the same of every text. Repeated rows count as
    often as they are there. An empty table gives none.
    """
    model = fit_quality(docs, labels, host=host, path=path, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    judged = judge(docs, model, host=host, path=path, text=text_or_empty(text_col), least=least)
    return judged.select(F.col("row").getField(id_col).alias(id_col), "host", "path", "own_odds", "host_mean", "path_mean", "score", "good")
