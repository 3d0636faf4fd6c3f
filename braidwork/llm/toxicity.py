"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, thresholds by language.

Filters of several widths run over the words; of each filter the TOP largest outputs in the text are pooled, in order, so
that the network can tell one stray word from several.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .sample import PER_CLASS, labelled_sample, score_documents, sigmoid
from .words import NOT_ALPHANUMERIC, U64, Words, chunks, mix

VOCABULARY = 1 << 16
WIDTH = 12
FILTERS = 8
SIZES = (1, 2, 3)
TOP = 4
THRESHOLD = 0.5
#: Frequent words by which a text's language is told, for the thresholds alone.
LANGUAGES = {
    "en": "the of and to in that is was for with",
    "de": "der die und das den mit von nicht ist ein",
    "fr": "le les des et une dans est pour sur du",
    "es": "el los las y del por con una para su",
}
_PAD = max(SIZES) - 1


def _ids(words: Words) -> np.ndarray:
    """Three hashed places for each word: the whole word, its first four bytes, its first six."""
    raw, first, n = words.raw, words.first, words.end - words.first
    out = [words.hashes]
    for k in (4, 6):
        h = np.zeros(len(first), U64)
        for i in range(k):
            b = raw[np.minimum(first + i, max(len(raw) - 1, 0))].astype(U64) if len(first) else np.zeros(0, U64)
            b = np.where((b >= U64(65)) & (b <= U64(90)), b + U64(32), b)
            h = h * U64(257) + np.where(i < n, b + U64(1), U64(0))
        out.append(mix(h + U64(k << 60)))
    return (np.stack(out, 1) % U64(VOCABULARY)).astype(np.int64)


def _words(column: pa.Array):
    return chunks(column, lower=True, is_space=NOT_ALPHANUMERIC)


class ToxicityModel:
    def __init__(self, texts: list[str], y: np.ndarray, behind: np.ndarray | None = None, epochs: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (VOCABULARY, WIDTH)).astype(np.float32)
        self.kernels = [rng.normal(0, 0.3, (s, WIDTH, FILTERS)).astype(np.float32) for s in SIZES]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in SIZES]
        self.out, self.shift = rng.normal(0, 0.3 / TOP, (TOP, FILTERS * len(SIZES))).astype(np.float32), np.zeros(1, np.float32)
        self.cuts = np.zeros(len(LANGUAGES) + 1)
        self.tongue = np.zeros(VOCABULARY, np.int8)
        for i, listed in enumerate(LANGUAGES.values()):
            for w in _words(pa.array([listed])):
                self.tongue[_ids(w)[:, 0]] = i + 1
        if not len(y) or y.min() == y.max():
            return
        docs = [i for w in _words(pa.array(texts, pa.string())) for all_ids in [_ids(w)] for i in np.split(all_ids, w.offsets[1:-1])]
        fold = np.arange(len(y)) % 5 == 0  # kept for the thresholds
        self._start(docs, y, ~fold)
        self._train(docs, y, np.flatnonzero(~fold), epochs, rng)
        self._calibrate(texts, y, fold, np.ones(2) if behind is None else behind)

    def _start(self, docs, y, use):
        """One embedding coordinate begins as how much more often a word is met in the one class than in the other."""
        seen = [np.ones(VOCABULARY), np.ones(VOCABULARY)]
        for d in np.flatnonzero(use):
            seen[int(y[d])][np.unique(docs[d])] += 1
        n = [1 + np.sum(y[use] == v) for v in (0, 1)]
        odds = np.log(seen[1] / n[1]) - np.log(seen[0] / n[0])
        odds -= np.log(n[0] / n[1])  # a word not met at all has none
        self.table[:, 0] = np.clip(odds, -1.5, 3) / 2
        self.kernels[0][0, :, 0] = 0
        self.kernels[0][0, 0, 0], self.bias[0][0], self.out[:, 0] = 1.0, -1.0, 2.0 / TOP

    def _embed(self, ids):
        return self.table[ids].sum(1)

    def _layers(self, x):
        """Filter outputs at every position of a padded sequence."""
        n = len(x) - _PAD
        return [sum(x[j : j + n] @ k[j] for j in range(len(k))) + b for k, b in zip(self.kernels, self.bias, strict=True)]

    def _train(self, docs, y, use, epochs, rng):
        params = [*self.kernels, *self.bias, self.out, self.shift]
        square = [np.full_like(p, 0.1) for p in params]
        table_square = np.full(VOCABULARY, 0.1, np.float32)
        weight = np.where(y > 0, 0.5 / max(np.mean(y[use]), 1e-3), 0.5 / max(1 - np.mean(y[use]), 1e-3))
        for epoch in range(epochs):
            rate = 0.1 / (1 + 0.3 * epoch)
            for d in rng.permutation(use):
                ids = docs[d]
                if not len(ids):
                    continue
                x = np.zeros((len(ids) + _PAD, WIDTH), np.float32)
                x[: len(ids)] = self._embed(ids)
                z = np.concatenate(self._layers(x), 1)
                top = min(TOP, len(z))
                at = np.argsort(-z, axis=0, kind="stable")[:top]
                pooled = np.take_along_axis(z, at, 0)
                on = np.maximum(pooled, 0)
                g = float((sigmoid(np.sum(on * self.out[:top]) + self.shift[0]) - y[d]) * weight[d])
                if abs(g) < 1e-3:
                    continue
                gp = g * self.out[:top] * (pooled > 0)
                gx, gk, gb = np.zeros_like(x), [], []
                for i, k in enumerate(self.kernels):
                    own = slice(i * FILTERS, (i + 1) * FILTERS)
                    gi, place = gp[:, own], at[:, own]
                    gk.append(np.stack([np.einsum("tfw,tf->wf", x[place + j], gi) for j in range(len(k))]))
                    gb.append(gi.sum(0))
                    for j in range(len(k)):
                        np.add.at(gx, place + j, gi[:, :, None] * k[j].T)
                go = np.zeros_like(self.out)
                go[:top] = g * on
                for p, s, gr in zip(params, square, [*gk, *gb, go, np.array([g], np.float32)], strict=True):
                    s += gr * gr
                    p -= rate * gr / np.sqrt(s)
                moved = np.flatnonzero(np.any(gx[: len(ids)], axis=1))
                places, gr = ids[moved].ravel(), np.repeat(gx[moved], ids.shape[1], axis=0)
                np.add.at(table_square, places, np.sum(gr * gr, axis=1) / WIDTH)
                np.subtract.at(self.table, places, (rate / np.sqrt(table_square[places]))[:, None] * gr)

    def _calibrate(self, texts, y, fold, behind):
        logit, tongue = self.logits(pa.array(texts, pa.string()))
        for i in range(len(LANGUAGES) + 1):
            own = fold & (tongue == i)
            if min(np.sum(own & (y > 0)), np.sum(own & (y == 0))) < 5:
                own = fold  # too few of this language: all
            v, t = logit[own], y[own]
            order = np.argsort(v)
            # Errors if the cut lies before each place; a false alarm weighs as a miss, each for all the labels behind it.
            errors = behind[1] * np.r_[0, np.cumsum(t[order] > 0)] + behind[0] * np.r_[np.cumsum((t[order] == 0)[::-1])[::-1], 0]
            best = np.flatnonzero(errors == errors.min())
            edge = np.r_[v[order][0] - 2, v[order], v[order][-1] + 2] if len(v) else np.zeros(2)
            k = best[len(best) // 2]
            self.cuts[i] = (edge[k] + edge[k + 1]) / 2

    def logits(self, column: pa.Array):
        """Uncalibrated logit and language (0: none) of every text."""
        out, tongue = np.full(len(column), float(self.shift[0])), np.zeros(len(column), np.int64)
        for words in _words(column):
            counts, ids = np.diff(words.offsets), _ids(words)
            full = np.flatnonzero(counts)
            if not len(full):
                continue
            begin = words.offsets[full] + _PAD * np.arange(len(full))
            x = np.zeros((len(ids) + _PAD * len(full), WIDTH), np.float32)
            x[np.arange(len(ids)) + _PAD * np.repeat(np.arange(len(full)), counts[full])] = self._embed(ids)
            valid = np.repeat(np.arange(len(full)), counts[full])
            place = np.arange(len(ids)) + _PAD * valid
            starts = np.r_[0, np.cumsum(counts[full])[:-1]]
            z = np.ascontiguousarray(np.concatenate([z[place] for z in self._layers(x)], 1).T)
            pooled = np.zeros((len(full), TOP, len(z)), np.float32)
            for i, (lo, n) in enumerate(zip(starts, counts[full], strict=True)):
                top = min(TOP, n)
                pooled[i, :top] = -np.sort(-np.partition(z[:, lo : lo + n], n - top, axis=1)[:, n - top :], axis=1).T
            out[words.row + full] = np.tensordot(np.maximum(pooled, 0), self.out, 2) + self.shift[0]
            known = np.stack([np.add.reduceat(self.tongue[ids[:, 0]] == i, starts, dtype=np.int64) for i in range(1, len(LANGUAGES) + 1)], 1)
            tongue[words.row + full] = np.where(known.max(1) > 0, known.argmax(1) + 1, 0)
        return out, tongue

    def scores(self, column: pa.Array) -> np.ndarray:
        logit, tongue = self.logits(column)
        return sigmoid(logit - self.cuts[tongue])


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """(key, held_out, score, predicted) for every row of `docs`, from its whole text alone.

    Words are runs of ASCII letters and digits and bytes over 127, A-Z lower-cased; each is the sum of three hashed
    embeddings (the word, its first four and first six bytes). Filters over 1, 2 and 3 words are max-pooled over the
    text. The language is told from frequent words of the text itself and only moves the logit, so that the calibrated
    threshold of each language is at 0.5. The model is fitted on the driver to at most `per_class` labelled documents of
    each class; when thresholds are set each counts for the labels behind it (sample.labelled_sample). Scoring broadcasts
    the model (about 3 MB) and shuffles nothing.
    Null and empty texts: scored as a text without words. Null key: held_out is false, the score stands. Repeated rows:
    the same score. No usable labels: an untrained network's scores. Other columns are ignored.
    """
    return score_documents(docs, key, text, ToxicityModel(*labelled_sample(docs, labels, label, key, text, per_class)), threshold)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
