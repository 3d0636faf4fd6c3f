"""Bounded samples of labelled documents, and small numerical helpers, for the classifiers."""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import bound_batches, local_table
from .words import pieces, release

PER_CLASS = 3000
MOST_BYTES = 200_000


def held_out(key: str):
    """True for keys whose crc32 (of the key as text) is divisible by 5; their labels are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts and labels (0 or 1) of at most `per_class` documents of each class, chosen by a hash of the key; and for each
    of the two classes, how many labelled keys stand behind one chosen key (1 where `per_class` cuts nothing).

    Held-out keys, null keys, other labels, null texts and texts of over MOST_BYTES bytes are not chosen. A key with
    several labels counts with the largest. Only the chosen keys, at most twice `per_class`, are broadcast.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).cast("long").alias("k")).agg(F.max(label).cast("int").alias("y"))
    chosen = [r for v in (0, 1) for r in known.where(F.col("y") == v).orderBy(F.xxhash64("k"), "k").limit(per_class).collect()]
    if not chosen:
        return [], np.zeros(0), np.ones(2)
    every, taken = dict(known.groupBy("y").count().collect()), Counter(r.y for r in chosen)
    keys = local_table(docs.sparkSession, chosen, "k long, y int")
    rows = docs.where(F.octet_length(text) <= MOST_BYTES).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(F.broadcast(keys), "k").select("k", "t", "y").collect()
    rows.sort(key=lambda r: (hash_order(r.k), r.k, r.t))
    return [r.t for r in rows], np.array([r.y for r in rows], np.float64), np.array([every[v] / taken[v] if taken[v] else 1.0 for v in (0, 1)])


def hash_order(k: int) -> int:
    return (k * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64) >> 13


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes the labels of a calibration set most likely."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.2), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, -np.where(y > 0, 1, -1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.n = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads):
        self.n += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.999**self.n)) + 1e-8)


def score_documents(docs: DataFrame, key: str, text: str, model, threshold: float, carry: bool = False) -> DataFrame:
    """(key, held_out, score, predicted) of every row; or, carry=True, the rows of `docs` predicted 1, unchanged."""
    spark = docs.sparkSession
    release()  # what training held on the driver
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))  # by value: workers need no installation
    if carry:
        at, schema = docs.columns.index(text), docs.schema

        def keep(batches):
            held = pickle.loads(shared.value)
            for batch in pieces(batches, at):
                yield batch.filter(pa.array(held.scores(batch.column(at)) >= threshold))
                release()

        return docs.mapInArrow(keep, schema)

    def score(batches):
        held = pickle.loads(shared.value)
        for batch in pieces(batches, 2):
            s = held.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])
            release()

    return docs.select(F.col(key).cast("long").alias(key), held_out(key).alias("held_out"), F.col(text)).mapInArrow(score, f"{key} long, held_out boolean, score double, predicted int")
