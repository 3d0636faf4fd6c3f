"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .sample import PER_CLASS, Adam, labelled_sample, score_documents, sigmoid, temperature
from .words import U64, Words, chunks, mix

VOCABULARY = 1 << 14
WIDTH = 32
THRESHOLD = 0.3


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashed vocabularies: the word itself, and its form (first and last bytes, capitals, length, repetition)."""
    raw, first, end = words.raw, words.first, words.end
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    capital = np.r_[0, np.cumsum((raw >= 65) & (raw <= 90))]
    n = end - first
    caps = capital[end] - capital[first]
    mark = lambda b: np.where((b >= 48) & (b <= 57), 1, np.where(((b | 32) >= 97) & ((b | 32) <= 122) | (b > 127), 0, b))  # noqa: E731  punctuation as it is
    last, before, head = mark(raw[end - 1].astype(np.int64)), mark(raw[np.maximum(end - 2, first)].astype(np.int64)), mark(raw[first].astype(np.int64))
    form = ((last * 256 + before) * 256 + head) * 8 + np.where(caps == 0, 0, np.where(caps == 1, 1, np.where(2 * caps >= n, 3, 2)))
    again = np.r_[False, words.hashes[1:] == words.hashes[:-1]]
    form = (form * 4 + np.minimum(n // 8, 3)) * 2 + again
    return (words.hashes % U64(VOCABULARY)).astype(np.int64), (mix(form.astype(U64)) % U64(VOCABULARY)).astype(np.int64)


def _index_vectors(seed: int) -> np.ndarray:
    """Sparse ternary vectors, four entries each, for every place of a hashed vocabulary."""
    h = mix(np.arange(VOCABULARY * 4, dtype=U64) + U64(seed * VOCABULARY * 4)).reshape(VOCABULARY, 4)
    out = np.zeros((VOCABULARY, WIDTH), np.float32)
    np.add.at(out, (np.arange(VOCABULARY)[:, None], (h >> U64(8)) % U64(WIDTH)), np.where(h & U64(1), 1.0, -1.0).astype(np.float32))
    return out


class QualityModel:
    """Word vectors (index vector plus normalised sum of the neighbours' index vectors) and the network's weights."""

    def __init__(self, texts: list[str], y: np.ndarray, behind: np.ndarray | None = None, hidden: int = 24, epochs: int = 60, seed: int = 7):
        self.tables = [self._context(texts, kind) for kind in (0, 1)]
        x = self.features(pa.array(texts, pa.string()))
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(2 * WIDTH), np.ones(2 * WIDTH))
        rng = np.random.default_rng(seed)
        d = 2 * WIDTH
        self.w1, self.b1 = rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden)
        self.w2, self.b2 = rng.normal(0, hidden**-0.5, hidden), np.zeros(1)
        self.t, self.prior = 1.0, 0.0
        if not len(y) or y.min() == y.max():
            return
        x = (x - self.mean) / self.scale
        fold = np.arange(len(y)) % 5 == 0  # kept for calibration
        xt, yt = x[~fold], y[~fold]
        adam = Adam([self.w1, self.b1, self.w2, self.b2], 0.01)
        for _ in range(epochs):
            order = rng.permutation(len(yt))
            for at in range(0, len(yt), 64):
                b = order[at : at + 64]
                h = np.tanh(xt[b] @ self.w1 + self.b1)
                g = (sigmoid(h @ self.w2 + self.b2) - yt[b]) / len(b)
                gh = np.outer(g, self.w2) * (1 - h * h)
                adam.step([xt[b].T @ gh + 1e-4 * self.w1, gh.sum(0), h.T @ g + 1e-4 * self.w2, np.array([g.sum()])])
        self.t = temperature(self._logits(x[fold]), y[fold])
        # Each class was sampled up to a bound: back to the odds at which the labels come.
        self.prior = float(np.log(behind[1] / behind[0])) if behind is not None else 0.0

    @staticmethod
    def _context(texts, kind: int) -> np.ndarray:
        index = _index_vectors(kind)
        total, seen = np.zeros_like(index), np.zeros(VOCABULARY, np.int64)
        for words in chunks(pa.array(texts, pa.string())):
            ids = _tokens(words)[kind]
            doc = np.repeat(np.arange(len(words)), np.diff(words.offsets))
            for step in (1, 2):
                a, b = ids[:-step], ids[step:]
                same = doc[:-step] == doc[step:]
                a, b = a[same], b[same]
                np.add.at(total, a, index[b])
                np.add.at(total, b, index[a])
            seen += np.bincount(ids, minlength=VOCABULARY)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        return index / 2 + np.where(seen[:, None] > 1, total / np.maximum(norm, 1e-6), 0).astype(np.float32)

    def features(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), 2 * WIDTH))
        for words in chunks(column):
            counts = np.diff(words.offsets)
            full = np.flatnonzero(counts)
            for kind, ids in enumerate(_tokens(words)):
                if len(full):
                    sums = np.add.reduceat(self.tables[kind][ids], words.offsets[full], axis=0)
                    out[words.row + full, kind * WIDTH : (kind + 1) * WIDTH] = sums / counts[full, None]
        return out

    def _logits(self, x):
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self._logits((self.features(column) - self.mean) / self.scale) / self.t + self.prior)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    return QualityModel(*labelled_sample(docs, labels, label, key, text, per_class))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """(key, held_out, score, predicted) for every row of `docs`, from its whole text alone.

    The model is fitted on the driver to at most `per_class` labelled documents of each class (sample.labelled_sample),
    and its scores are moved to the odds of all labels that are not held out, whatever the bound cuts;
    everything else runs where the rows are, with one broadcast of fixed size (about 4 MB), and nothing is shuffled.
    Null and empty texts: scored as a text without words. Null key: held_out is false, the score stands. Repeated rows:
    the same score. No usable labels: an untrained network's scores, near 0.5. Other columns are ignored.
    """
    return score_documents(docs, key, text, train(docs, labels, key, text, label, per_class), threshold)


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the classifier accepts, unchanged."""
    return score_documents(docs, "doc_id", text, train(docs, labels), threshold, carry=True)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
