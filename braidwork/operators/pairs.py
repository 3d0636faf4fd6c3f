"""All pairs of vectors within a group, tile by tile: a group is dealt into blocks by hash, and each pair of its blocks is a
task's group of rows, whatever the sizes of the groups. Tiles are one matrix product; what would lose digits in it is redone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1024
#: Squared distances under this share of the squared lengths are summed from differences, not from a product.
NEAR = 1e-4


def tiles(points: DataFrame, group: list[str], block: int = BLOCK) -> DataFrame:
    """`points` (group columns and others) with (lo, hi, own): each row once for each block of its group that its block `own`
    meets, lo <= hi. Rows of equal groups are those of equal, non-null group columns."""
    here = points
    for g in group:
        here = here.where(F.col(g).isNotNull())
    sizes = here.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("__k"))
    others = [c for c in here.columns if c not in group]
    dealt = here.join(F.broadcast(sizes), group).withColumn("own", F.pmod(F.xxhash64(*others), F.col("__k").cast("long")).cast("int"))
    met = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    return met.select(*here.columns, F.least("own", "__other").alias("lo"), F.greatest("own", "__other").alias("hi"), "own")


def rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of numbers, none of them null and all of one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, n = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64), len(column)
    if n and len(flat) % n or n and np.ptp(np.asarray(column.value_lengths())):
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def squares(x: np.ndarray, y: np.ndarray, xx: np.ndarray, yy: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x and y from their squared lengths and products."""
    both = xx[:, None] + yy
    d = np.maximum(both - 2 * product, 0)
    i, j = np.nonzero(d <= NEAR * both)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        d[p, q] = ((x[p] - y[q]) ** 2).sum(1)
    return d


def distances(points: DataFrame, group: str, key: str, coordinates: str, digits: int = 5, block: int = BLOCK) -> DataFrame:
    """(group, a, b, euclidean, cosine) of all pairs within a group, a < b, rounded half up. A vector of length 0 has no
    angle: its cosine distances are NaN. Null vectors have null distances."""
    kinds = {f.name: f.dataType for f in points.schema}
    schema = T.StructType().add(group, kinds[group]).add("a", kinds[key]).add("b", kinds[key]).add("euclidean", "double").add("cosine", "double")
    unit = 10.0**digits

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        label, own = t.column(0)[0], t.column("own").to_numpy()
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        ids, null = t.column(1).to_numpy(), t.column(2).is_null().to_numpy()
        x = np.zeros((len(ids), 1))
        if not null.all():
            held = rows_of(t.column(2).filter(pa.array(~null)))
            x = np.zeros((len(ids), held.shape[1]))
            x[~null] = held
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        xx = np.einsum("ij,ij->i", x, x)
        length, y, yy, other = np.sqrt(xx), x[right], xx[right], ids[right]
        for at in range(0, len(left), 64):
            rows = left[at : at + 64]
            product = x[rows] @ y.T
            d = np.sqrt(squares(x[rows], y, xx[rows], yy, product))
            with np.errstate(invalid="ignore", divide="ignore"):
                c = 1 - np.clip(product / (length[rows][:, None] * length[right]), -1, 1)
            mine = ids[rows][:, None]
            use = (mine < other) if lo == hi else (mine != other)
            i, j = np.nonzero(use)
            if not len(i):
                continue
            p, q = ids[rows][i], other[j]
            none = null[rows][i] | null[right][j]
            none = none if none.any() else None
            far, turn = (np.floor(v[use] * unit + 0.5) / unit + 0.0 for v in (d, c))
            yield pa.RecordBatch.from_arrays([pa.repeat(label, len(i)), pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(far, mask=none), pa.array(turn, mask=none)], names=schema.names)

    own = points.select(F.col(group), F.col(key), F.col(coordinates)).where(F.col(key).isNotNull())
    return tiles(own, [group], block).groupBy(group, "lo", "hi").applyInArrow(pair, schema)
