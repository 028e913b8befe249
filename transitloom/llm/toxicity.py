"""Operator 6: toxicity by a convolutional text classifier over hashed words.

Words are hashed to embeddings, filters of several widths run over them, and each filter's
largest output over the whole text feeds a logistic unit. The network is trained in numpy on
a bounded sample of labelled documents. A max-pooled output has one gradient, that of the
word window which won, so training is sparse. Buckets that too few training documents
use keep a zero vector: a word never seen can neither raise nor lower a score.

A threshold is calibrated for each language, which is read off the text's own function
words (never a language column). Labelled documents are dealt into parts, and those of each
part are scored for this by a network that only the others trained. The score is shifted so
that 0.5 is the threshold.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty, written

BUCKETS = 1 << 18
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 10
PADS = max(WIDTHS) - 1
#: Training documents that must use a bucket, for each thousand of them; three at least.
LEAST_DOCS = 1
#: Bytes of labelled documents that teach, at four a word.
SAMPLE_BYTES = 96 << 20
#: Parts of the labelled documents, each calibrated on by a network that the others trained.
PARTS = 3
#: Labels of the rarer kind below which balanced accuracy is too rough to go by alone.
FEW_LABELS = 50
#: Words that go through the network at once.
STEP_WORDS = 200_000
#: Function words by which a language is told.
FUNCTION_WORDS = {
    "en": "the and of to in that is was for with",
    "fr": "le la les des et un une dans pour que",
    "de": "der die das und ein nicht mit ist zu den",
    "es": "el los las y por para una con del que",
}
words = re.compile(r"\w+").findall


class _Hashed(dict):
    """A word's bucket, from 1 on (0 pads); emptied at a size that bounds its memory."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = bucket = 1 + zlib.crc32(word.encode()) % (BUCKETS - 1)
        return bucket


_BUCKET = _Hashed()
_LANGUAGE_BUCKETS = {lang: np.array(sorted({_BUCKET[w] for w in text.split()})) for lang, text in FUNCTION_WORDS.items()}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def word_buckets(text: str) -> np.ndarray:
    found = words(text.lower())
    return np.fromiter(map(_BUCKET.__getitem__, found), np.int32, len(found))


def told_language(buckets: np.ndarray) -> int:
    """Index in LANGUAGES of the language whose function words are most frequent; without any, other."""
    hits = [int(np.isin(buckets, own).sum()) for own in _LANGUAGE_BUCKETS.values()]
    return int(np.argmax(hits)) if max(hits) else len(LANGUAGES) - 1


@dataclass
class ConvolutionalClassifier:
    embeddings: np.ndarray
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    shifts: np.ndarray
    out: np.ndarray
    bias: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    @classmethod
    def fresh(cls, seed: int = 7) -> ConvolutionalClassifier:
        rng = np.random.default_rng(seed)
        total = FILTERS * len(WIDTHS)
        filters = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), filters, np.zeros(total, np.float32), rng.uniform(0.2, 0.6, total).astype(np.float32), -1.0)

    def forward(self, texts: list[np.ndarray]) -> tuple:
        """Logits of the texts, and what the gradient needs. A text's pads keep windows apart."""
        sizes = np.array([max(1, len(t)) for t in texts])
        starts = np.r_[0, np.cumsum(sizes[:-1] + PADS)]
        flat = np.zeros(int(sizes.sum()) + PADS * len(texts), np.int32)
        for at, text in zip(starts, texts, strict=True):
            flat[at : at + len(text)] = text
        vectors = self.embeddings[flat]
        pads = (starts + sizes)[:, None] + np.arange(PADS)
        padded = np.concatenate([vectors, np.zeros((PADS, DIM), np.float32)])
        maps = []
        for bank in self.filters:
            z = sum(padded[j : j + len(flat)] @ bank[j] for j in range(len(bank)))
            z[pads.ravel()] = -1e9
            maps.append(z)
        z = np.concatenate(maps, axis=1)
        pooled = np.maximum.reduceat(z, starts) + self.shifts
        hidden = np.maximum(pooled, 0)
        return hidden @ self.out + self.bias, hidden, z, starts, sizes, flat, padded

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        parts, waiting, size = [], [], 0
        for text in texts:
            waiting.append(text)
            size += len(text) + PADS
            if size >= STEP_WORDS:
                parts.append(self.forward(waiting)[0])
                waiting, size = [], 0
        if waiting:
            parts.append(self.forward(waiting)[0])
        return np.concatenate(parts) if parts else np.zeros(0)

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.05, seed: int = 7) -> None:
        """Adagrad on the log loss, positives weighted up to a third of the negatives at least."""
        rng = np.random.default_rng(seed)
        heavy = max(1.0, (labels == 0).sum() / max(1, 3 * (labels == 1).sum()))
        tracked = {"e": np.full(BUCKETS, 1e-2, np.float32), "s": np.full_like(self.shifts, 1e-2), "o": np.full_like(self.out, 1e-2), "b": 1e-2, **{k: np.full_like(w, 1e-2) for k, w in enumerate(self.filters)}}
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                logit, hidden, z, starts, sizes, flat, padded = self.forward([texts[k] for k in some])
                y = labels[some]
                error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * np.where(y == 1, heavy, 1) / len(some)).astype(np.float32)
                won = np.stack([z[a : a + n].argmax(axis=0) + a for a, n in zip(starts, sizes, strict=True)])
                back = error[:, None] * self.out * (hidden > 0)
                grads = {"s": back.sum(axis=0), "o": hidden.T @ error, "b": float(error.sum())}
                rows, pulls = [], []
                for k, bank in enumerate(self.filters):
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    grad = np.empty_like(bank)
                    for j in range(len(bank)):
                        at_word = np.minimum(won[:, cols] + j, len(padded) - 1)
                        grad[j] = np.einsum("bfd,bf->df", padded[at_word], back[:, cols])
                        rows.append(np.where(at_word < len(flat), flat[np.minimum(at_word, len(flat) - 1)], 0).ravel())
                        pulls.append((back[:, cols, None] * bank[j].T).reshape(-1, DIM))
                    grads[k] = grad
                for name, value in (("s", self.shifts), ("o", self.out), *enumerate(self.filters)):
                    tracked[name] += grads[name] ** 2
                    value -= rate * grads[name] / np.sqrt(tracked[name])
                tracked["b"] += grads["b"] ** 2
                self.bias -= rate * grads["b"] / np.sqrt(tracked["b"])
                used, inverse = np.unique(np.concatenate(rows), return_inverse=True)
                pull = np.zeros((len(used), DIM), np.float32)
                np.add.at(pull, inverse, np.concatenate(pulls))
                pull[~self.known[used]] = 0
                tracked["e"][used] += (pull**2).mean(axis=1)
                self.embeddings[used] -= rate * pull / np.sqrt(tracked["e"][used])[:, None]

    def keep_known(self, texts: list[np.ndarray]) -> None:
        """Zero vectors, for good, for the buckets that too few texts use."""
        used = np.zeros(BUCKETS, np.int32)
        for text in texts:
            used[np.unique(text)] += 1
        self.known = used >= max(3, LEAST_DOCS * len(texts) // 1000)
        self.known[0] = False
        self.embeddings[~self.known] = 0

    def calibrate(self, logits: np.ndarray, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """For each language the logit that best parts its labels (balanced accuracy; the middle of the best gap).

        The logits come from networks that did not see the texts. Where few labels are of the
        rarer kind and that cut is worse than one answer for all would be, the cut of the
        fewest wrong labels stands for every language.
        """
        langs = np.array([told_language(t) for t in texts])
        overall, sound = best_cut(logits, labels)
        for k in range(len(LANGUAGES)):
            own = langs == k
            enough = sound and min((labels[own] == 1).sum(), (labels[own] == 0).sum()) >= 8
            self.thresholds[k] = best_cut(logits[own], labels[own], few=0)[0] if enough else overall

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        shift = self.thresholds[[told_language(t) for t in texts]] if texts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.logits(texts) - shift, -30, 30)))


def best_cut(logits: np.ndarray, labels: np.ndarray, few: int = FEW_LABELS) -> tuple[float, bool]:
    """The cut of the best balanced accuracy, and true; on few labels that of the fewest wrong ones, and false, if the first is wrong on more than one answer for all."""
    positive, negative = np.sort(logits[labels == 1]), np.sort(logits[labels == 0])
    if not len(positive) or not len(negative):
        return 0.0, True
    cuts = np.unique(logits)
    middle = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
    caught, left = len(positive) - np.searchsorted(positive, middle), np.searchsorted(negative, middle)
    hit, right = caught / len(positive) + left / len(negative), caught + left
    best = np.flatnonzero(hit >= hit.max() - 1e-12)
    sound = min(len(positive), len(negative)) >= few or right[best[len(best) // 2]] >= max(len(positive), len(negative))
    if not sound:
        most = np.flatnonzero(right == right.max())
        best = most[hit[most] >= hit[most].max() - 1e-12]
    return float(middle[best[len(best) // 2]]), bool(sound)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; 1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(1))


def train_classifier(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, sample: int, sample_bytes: int = SAMPLE_BYTES) -> ConvolutionalClassifier:
    """Trained on at most ``sample`` labelled documents outside the held-out fold, chosen by a hash of their ids.

    Texts teach whole. They come to the driver as four bytes a word, ``sample_bytes`` in all
    at most: in the order of the hash, documents that no longer fit are passed over.
    """
    labelled = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0))
    chosen = labelled.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(sample)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [word_buckets(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(texts, pa.binary())], ["id", "label", "words"])

    # at most ``sample`` rows of an id and a label: a bounded broadcast; of a repeated id the text of the smallest hash teaches
    joined = docs.select(id_col, text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    one = joined.groupBy(id_col, "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    taught = written(one.select(id_col, "label", "text").mapInArrow(hashed, "id string, label int, words binary"), "toxicity-taught")
    fit, left = [], sample_bytes
    for r in taught.select("id", F.length("words").alias("size")).orderBy(F.xxhash64("id"), "id").collect():
        if r["size"] <= left:
            left -= r["size"]
            fit.append((r.id,))
    those = docs.sparkSession.createDataFrame(fit, "id string")
    rows = sorted(taught.join(F.broadcast(those), "id", "left_semi").collect(), key=lambda r: r.id)
    texts = [np.frombuffer(r.words, np.int32) for r in rows]
    y = np.array([r.label for r in rows], np.float32)
    model = trained(texts, y)
    if 0 < y.sum() < len(y):
        part = np.array([zlib.crc32(b"apart" + r.id.encode()) % PARTS for r in rows])
        logits = np.zeros(len(y))
        for k in range(PARTS):
            apart = part == k
            others = trained([t for t, own in zip(texts, apart, strict=True) if not own], y[~apart])
            logits[apart] = others.logits([t for t, own in zip(texts, apart, strict=True) if own])
        model.calibrate(logits, texts, y)
    return model


def trained(texts: list[np.ndarray], labels: np.ndarray) -> ConvolutionalClassifier:
    model = ConvolutionalClassifier.fresh()
    model.keep_known(texts)
    if 0 < labels.sum() < len(labels):
        model.train(texts, labels)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 8000, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(id, held_out, score, predicted, told_lang), a row for each document.

    ``labels`` (id, label 0 or 1) teaches on the ids whose crc32 modulo 5 is not 0; of
    repeated labels the larger counts, null ones and labels of unknown ids do not; of repeated
    ids one text teaches. Scores read the text alone. Null and empty texts get the score of no words. Without labels of
    both kinds the untrained network scores. At most ``sample`` labelled documents teach, of
    ``sample_bytes`` together, chosen by a hash and each as a whole. An empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    model = train_classifier(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample, sample_bytes=sample_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [word_buckets(t) for t in batch.column(2).to_pylist()]
            scores = shared.value.scores(texts)
            told = [LANGUAGES[told_language(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)), pa.array(told, pa.string())], ["id", "held_out", "score", "predicted", "told_lang"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), (fold(id_col) == 0).alias("held_out"), text_or_empty(text_col).alias("text"))
    return read.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int, told_lang string").withColumnRenamed("id", id_col)
