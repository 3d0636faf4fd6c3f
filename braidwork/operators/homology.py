"""Persistent homology of point clouds, one cloud to a group: distances, Vietoris-Rips bars, metrics, curves.

Dimension 0 is a minimum spanning tree. Dimension 1 takes edges by rising length and keeps, as bits of each edge, the living
loops that it is part of (annotations over Z/2); most edges start and end nothing, and what is longer than the last bar is
not looked at. It takes clouds of any size, and holds their distance matrix. Dimension 0 alone holds a cloud's points, some
neighbours of each and a block of distances; its time is the square of their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import matrix, pairs

FIRST_EDGES = 16
BLOCK_BYTES = 4 << 20
NEIGHBOURS = 24
METRICS = ["H0_count", "H1_count", "max_persistence", "mean_persistence", "total_persistence", "persistence_entropy", "topological_complexity"]


def distances(x: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric in ("cosine", "correlation"):
        x = x - x.mean(1, keepdims=True) if metric == "correlation" else x
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - (x / np.where(norm > 0, norm, 1)) @ (x / np.where(norm > 0, norm, 1)).T
    elif metric in ("manhattan", "cityblock"):
        d = np.stack([np.abs(x - r).sum(1) for r in x]) if len(x) else np.zeros((0, 0))
    elif metric == "euclidean":
        d = np.stack([np.sqrt(((x - r) ** 2).sum(1)) for r in x]) if len(x) else np.zeros((0, 0))
    else:
        raise ValueError(f"unknown metric {metric}")
    d = d + d.T
    d /= 2
    np.maximum(d, 0, out=d)
    np.fill_diagonal(d, 0)
    return d


def tree(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges of a minimum spanning tree."""
    n, out = len(d), []
    if n < 2:
        return out
    best, near = d[0].copy(), np.zeros(n, int)
    best[0] = np.inf
    inside = np.zeros(n, bool)
    inside[0] = True
    for _ in range(n - 1):
        j = int(np.argmin(np.where(inside, np.inf, best)))
        out.append((int(near[j]), j, float(best[j])))
        inside[j] = True
        closer = d[j] < best
        near[closer], best = np.where(closer, j, near)[closer], np.minimum(best, d[j])
    return out


def _far(x: np.ndarray, metric: str):
    """rows(p, q): an (p, q) matrix that orders pairs as their distances do, and exact(p, q): the distances of pairs."""
    if metric == "euclidean":
        xx = np.einsum("ij,ij->i", x, x)

        one = np.ones((len(x), 1))
        a, b = np.hstack([-2 * x, one, xx[:, None]]), np.hstack([x, xx[:, None], one])

        def rows(p, q):
            d = a[p] @ (b if len(q) == len(x) else b[q]).T
            i, j = np.divmod(np.flatnonzero(d <= pairs.NEAR * (xx[p] + xx.max())[:, None]), len(q))
            for at in range(0, len(i), 1 << 15):
                u, v = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                d[u, v] = ((x[p[u]] - x[q[v]]) ** 2).sum(1)
            return d

        return rows, lambda p, q: np.sqrt(((x[p] - x[q]) ** 2).sum(1))
    if metric in ("cosine", "correlation"):
        x = x - x.mean(1, keepdims=True) if metric == "correlation" else x
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        u = x / np.where(norm > 0, norm, 1)
        return lambda p, q: np.maximum(1 - u[p] @ u[q].T, 0), lambda p, q: np.maximum(1 - (u[p] * u[q]).sum(1), 0)
    if metric in ("manhattan", "cityblock"):
        return lambda p, q: np.stack([np.abs(x[q] - r).sum(1) for r in x[p]]), lambda p, q: np.abs(x[p] - x[q]).sum(1)
    raise ValueError(f"unknown metric {metric}")


def _neighbours(rows, n: int, k: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each point, in order of distance: others (at, far; inf where there are fewer), and a bound that no other is under."""
    every, bound = np.arange(n), np.full(n, np.inf)
    at, far = np.zeros((n, 2 * k), np.int32), np.full((n, 2 * k), np.inf)
    for begin in range(0, n, block):
        p = every[begin : begin + block]
        d = rows(p, every)
        d[p - begin, p] = np.inf
        fold = max(1, min(16, n // (4 * k)))  # the k-th of the least of each fold is no nearer than the k-th of all
        folds = d[:, : n // fold * fold].reshape(len(p), fold, -1).min(1) if fold > 1 else d
        kth = np.partition(folds, k - 1, axis=1)[:, k - 1]
        i, q = np.divmod(np.flatnonzero(d <= kth[:, None]), n)
        v = d[i, q]
        order = np.lexsort((v, i))
        i, q, v = i[order], q[order], v[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        use = place < 2 * k
        bound[p] = kth if k < n - 1 else np.inf
        bound[p[i[place == 2 * k]]] = v[place == 2 * k]
        at[p[i[use]], place[use]], far[p[i[use]], place[use]] = q[use], v[use]
    width = max(1, int(np.isfinite(far).sum(1).max()))
    return at[:, :width].copy(), far[:, :width].copy(), bound


def tree_lengths(x: np.ndarray, metric: str = "euclidean", k: int = NEIGHBOURS, block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """Lengths of the edges of a minimum spanning tree of finite points, without their distance matrix.

    Trees grow by their shortest edges outward. The edge is looked up in lists of near neighbours as long as it is no longer
    than the bounds of those points whose lists lie within their tree; where it is, these points' distances are made anew.
    """
    x = x[np.lexsort(x.T[::-1])] if x.size else x
    fresh = np.r_[True, (x[1:] != x[:-1]).any(1)] if len(x) else np.zeros(0, bool)
    if metric in ("cosine", "correlation"):  # vectors of length 0 are no copies of each other
        fresh[:] = True
    copies, x = int((~fresh).sum()), x[fresh]
    n = len(x)
    if n < 2:
        return np.zeros(copies)
    rows, exact = _far(x, metric)
    block, every = max(1, block_bytes // (8 * n)), np.arange(n)
    at, far, bound = _neighbours(rows, n, min(k, n - 1), block)
    seen, held = np.zeros(n, np.int64), np.full(n, np.inf)  # a point's nearest in another tree, where it was searched
    parent, ends = np.arange(n), []

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    own = every
    while True:
        trees = int(own.max()) + 1
        if trees == 1:
            break
        foreign = (own[at] != own[:, None]) & np.isfinite(far)
        first, has = foreign.argmax(1), foreign.any(1)
        w, to = np.where(has, far[every, first], np.inf), at[every, first].astype(np.int64)
        searched = ~has & np.isfinite(held)
        within = searched & (own[seen] == own)
        bound[within], held[within] = held[within], np.inf  # that one has joined; no other is nearer
        searched &= ~within
        w[searched], to[searched] = held[searched], seen[searched]
        open_ = ~np.isfinite(w)
        least, under = np.full(trees, np.inf), np.full(trees, np.inf)
        np.minimum.at(least, own, w)
        np.minimum.at(under, own[open_], bound[open_])
        sure = least <= under
        if not sure.any():
            sure = np.ones(trees, bool)
            sure[np.bincount(own).argmax()] = False
            need = np.flatnonzero(open_ & sure[own] & (bound < least[own]))
            for begin in range(0, len(need), block):
                p = need[begin : begin + block]
                d = rows(p, every)
                d[own[p][:, None] == own] = np.inf
                q = d.argmin(1)
                held[p] = w[p] = d[np.arange(len(p)), q]
                seen[p] = to[p] = q
        order = np.lexsort((w, own))
        pick = order[np.r_[True, own[order][1:] != own[order][:-1]]]
        pick = pick[sure[own[pick]]]
        for p in pick[np.argsort(w[pick], kind="stable")].tolist():
            a, b = root(p), root(int(to[p]))
            if a != b:
                parent[a] = b
                ends.append((p, int(to[p])))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        own = np.unique(parent, return_inverse=True)[1]
    ends = np.array(ends)
    return np.r_[np.zeros(copies), exact(ends[:, 0], ends[:, 1])]


def _open_beyond(d: np.ndarray, cut: float, limit: float) -> bool:
    """Might an edge over `cut` and up to `limit` start a bar? None does that has a third point nearer to both its ends."""
    n, links = len(d), (d <= cut).astype(np.float32)
    np.fill_diagonal(links, 0)
    for begin in range(0, n, 256):
        p = np.arange(begin, min(begin + 256, n))
        far = (d[p] > cut) & (d[p] <= limit) & (links[p] @ links == 0)
        a, b = np.nonzero(far)
        a, b = p[a[p[a] < b]], b[p[a] < b]
        for at in range(0, len(a), 256):
            u, v = a[at : at + 256], b[at : at + 256]
            if not (np.maximum(d[u], d[v]) < d[u, v][:, None]).any(1).all():
                return True
    return False


def _bars_up_to(d: np.ndarray, cut: float, limit: float) -> list[tuple[float, float]] | None:
    """bars_one() where none starts beyond `cut`, over the edges up to there; None if one of them ends later."""
    n = len(d)
    near = d <= cut
    np.fill_diagonal(near, False)
    i, j = np.nonzero(np.triu(near))
    order = np.lexsort((j, i, d[i, j]))
    i, j = i[order], j[order]
    w, most = d[i, j], len(i)
    rank = np.full((n, n), most, np.int32)
    rank[i, j] = rank[j, i] = np.arange(most)
    others = [np.flatnonzero(row) for row in near]
    first = np.full(most, -1)  # an edge's first third point of those nearer to both its ends: with it, it makes no bar
    for a, at in enumerate(others):
        at_later = at[at > a]
        for begin in range(0, len(at_later), 512):
            b = at_later[begin : begin + 512]
            own = rank[a, b][:, None]
            inside = (rank[np.ix_(b, at)] < own) & (rank[a, at] < own)
            has = inside.any(1)
            first[own[has, 0]] = at[inside[has].argmax(1)]

    parent = list(range(n))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    starts = set()
    for e in np.flatnonzero(first < 0).tolist():
        a, b = root(int(i[e])), root(int(j[e]))
        if a == b:
            starts.add(e)
        parent[a] = b

    # Each edge holds, as bits, the living loops that it is part of: an edge that starts one has a bit of its own, one of the
    # tree has none, any other has what its first triangle leaves it. A triangle whose edges do not add up to nothing ends
    # the youngest of the loops left over.
    bits, born, free, out = np.zeros((1, most), np.uint64), np.full(64, -1), list(range(64)), []
    alive, to_come = 0, len(starts)
    for e in range(most):
        if not alive and not to_come:
            return out
        if first[e] < 0:
            if e in starts:
                if not free:
                    free = list(range(len(born), 2 * len(born)))
                    bits, born = np.vstack([bits, np.zeros_like(bits)]), np.r_[born, np.full(len(born), -1)]
                slot = free.pop()
                born[slot], bits[slot >> 6, e] = e, np.uint64(1 << (slot & 63))
                alive, to_come = alive + 1, to_come - 1
            continue
        if not alive:
            continue
        a, b = i[e], j[e]
        k = others[a][near[b, others[a]]]
        u, v = rank[a, k], rank[b, k]
        use = (u < e) & (v < e)
        sums = bits[:, u[use]] ^ bits[:, v[use]]
        bits[:, e] = sums[:, 0]
        sums ^= sums[:, :1].copy()
        for t in np.flatnonzero(sums.any(0)).tolist():
            left = sums[:, t].copy()
            words = np.flatnonzero(left)
            if not len(words):
                continue
            slots = np.flatnonzero(np.unpackbits(left[words].astype("<u8").view(np.uint8), bitorder="little"))
            slots = words[slots >> 6] * 64 + (slots & 63)
            slot = int(slots[born[slots].argmax()])
            word, bit = slot >> 6, np.uint64(1 << (slot & 63))
            for table, within in ((bits, e + 1), (sums, sums.shape[1])):
                table[np.ix_(words, np.flatnonzero(table[word, :within] & bit))] ^= left[words][:, None]
            if w[e] > w[born[slot]]:
                out.append((float(w[born[slot]]), float(w[e])))
            free.append(slot)
            alive -= 1
    return out if cut >= limit or not alive else None


def bars_one(d: np.ndarray, threshold: float = np.inf) -> list[tuple[float, float]]:
    """Finite bars of dimension 1 of positive length. Only edges up to a length are looked at, as bars mostly end early; while
    one may start or end beyond, the length grows, at last to the enclosing radius, beyond which nothing lives."""
    n = len(d)
    if n < 3:
        return []
    limit = min(threshold, float(d.max(1).min()))
    w = np.concatenate([row[a + 1 :] for a, row in enumerate(d)])
    w = w[w <= limit]
    edges, margin = FIRST_EDGES * n, 1.0
    while edges * margin < len(w):
        cut = float(np.partition(w, int(edges * margin))[int(edges * margin)])
        if margin > 1 or not _open_beyond(d, cut, limit):
            margin *= 1.4  # the last bars end beyond the last start
            cut = float(np.partition(w, min(int(edges * margin), len(w) - 1))[min(int(edges * margin), len(w) - 1)])
            found = _bars_up_to(d, cut, limit)
            if found is not None:
                return found
        else:
            edges = edges * 5 // 4
    return _bars_up_to(d, limit, limit)


def bars(points: DataFrame, cloud: str, coordinates: str, max_dim: int = 1, metric: str = "euclidean", threshold: float | None = None) -> DataFrame:
    """(cloud, dim, birth, death) of every cloud; the one class that never dies is left out, as are bars without length."""
    top = np.inf if threshold is None else threshold

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        name, x = t.column("cloud")[0], pairs.rows_of(t.column("x"))
        del t
        x = x[np.lexsort(x.T[::-1])] if x.shape[1] else x
        if max_dim > 0 or not np.isfinite(x).all():
            d = distances(x, metric)
            lengths = np.array([w for _, _, w in tree(d)], float)
        else:
            lengths = tree_lengths(x, metric)
        rows = [(0, 0.0, w) for w in lengths[(lengths > 0) & (lengths <= top)].tolist()]
        if max_dim > 0:
            rows += [(1, b, e) for b, e in bars_one(d, top)]
        dims, births, deaths = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.repeat(name, len(rows)), pa.array(dims, pa.int32()), pa.array(births, pa.float64()), pa.array(deaths, pa.float64())], names=["cloud", "dim", "birth", "death"])

    kind = points.schema[coordinates].dataType
    x = F.col(coordinates) if kind in (T.ArrayType(T.FloatType()), T.ArrayType(T.FloatType(), False)) else F.col(coordinates).cast("array<double>")
    data = points.select(F.col(cloud).cast("string").alias("cloud"), x.alias("x")).where(F.col("cloud").isNotNull() & F.col("x").isNotNull())
    return data.groupBy("cloud").applyInArrow(one, "cloud string, dim int, birth double, death double")


def summary(diagram: DataFrame) -> DataFrame:
    """(cloud, dim, bars, max, mean, total persistence)."""
    p = F.col("death") - F.col("birth")
    finite = diagram.where("death < double('inf') AND NOT isnan(death)")
    return finite.groupBy("cloud", "dim").agg(F.count("*").alias("bars"), F.max(p).alias("max_persistence"), F.avg(p).alias("mean_persistence"), F.sum(p).alias("total_persistence"))


def metrics(diagram: DataFrame) -> DataFrame:
    """The seven scalar metrics of dimensions 0 and 1, one row for each cloud with bars."""
    finite = diagram.where("death < double('inf') AND NOT isnan(death) AND dim < 2").withColumn("p", F.col("death") - F.col("birth"))
    finite = finite.withColumn("all", F.sum("p").over(Window.partitionBy("cloud")))  # not a join, which would make the bars twice
    share = F.col("p") / F.col("all")
    one = F.when(F.col("dim") == 1, F.col("p"))
    rows = finite.groupBy("cloud").agg(
        F.count_if(F.col("dim") == 0).cast("double").alias("H0_count"), F.count_if(F.col("dim") == 1).cast("double").alias("H1_count"), F.max("p").alias("max_persistence"), F.avg("p").alias("mean_persistence"),
        F.sum("p").alias("total_persistence"), F.coalesce(-F.sum(F.when(F.col("all") > 0, share * F.log(share + 1e-12))), F.lit(0.0)).alias("persistence_entropy"),
        F.coalesce(F.sum(one), F.lit(0.0)).alias("s1"), F.coalesce(F.max(one), F.lit(0.0)).alias("m1"), F.coalesce(F.sum(F.when(F.col("dim") == 0, F.col("p"))), F.lit(0.0)).alias("s0"),
    )
    complexity = 0.35 * F.col("s1") + 0.20 * F.col("m1") + 0.20 * F.col("H1_count") + 0.15 * F.col("persistence_entropy") + 0.10 * F.col("s0")
    return rows.withColumn("topological_complexity", complexity).select("cloud", *METRICS)


def betti_curve(diagram: DataFrame, dim: int, resolution: int = 200) -> DataFrame:
    """(cloud, step, x, betti) on an even grid from the first birth to the last death; a flat range is widened by one. A cloud
    of the diagram without a finite bar of this dimension has zeros from 0 to 1."""
    last = resolution - 1
    finite = diagram.where(f"dim = {dim} AND death < double('inf')")
    of = lambda c: F.when(F.expr(f"dim = {dim} AND death < double('inf')"), F.col(c))
    ends = diagram.groupBy("cloud").agg(F.coalesce(F.min(of("birth")), F.lit(0.0)).alias("lo"), F.coalesce(F.max(of("death")), F.lit(1.0)).alias("hi"))
    ends = ends.withColumn("hi", F.when(F.abs(F.col("hi") - F.col("lo")) <= 1e-9 * F.greatest(F.abs("hi"), F.abs("lo")), F.col("lo") + 1).otherwise(F.col("hi")))
    at = lambda k: F.when(k >= last, F.col("hi")).otherwise(F.col("lo") + k * ((F.col("hi") - F.col("lo")) / last))

    def reached(v):
        """The first step whose x is not under the value; after the last step: none. Rounding is off by a step at most."""
        near = F.least(F.lit(resolution), F.greatest(F.lit(0), F.ceil((v - F.col("lo")) / ((F.col("hi") - F.col("lo")) / last)))).cast("int")
        near = F.when((near > 0) & (at(near - 1) >= v), near - 1).otherwise(near)
        return F.when((near < resolution) & (at(near) < v), near + 1).otherwise(near)

    turns = finite.select("cloud", F.inline(F.array(F.struct(F.col("birth").alias("v"), F.lit(1).alias("turn")), F.struct(F.col("death").alias("v"), F.lit(-1).alias("turn"))))).join(ends, "cloud")
    turns = turns.groupBy("cloud", reached(F.col("v")).alias("step")).agg(F.sum("turn").alias("turn"))
    grid = ends.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(last)))).withColumn("x", at(F.col("step")))
    running = F.sum(F.coalesce("turn", F.lit(0))).over(Window.partitionBy("cloud").orderBy("step"))
    return grid.join(turns, ["cloud", "step"], "left").select("cloud", "step", "x", running.alias("betti"))


def histogram(values: DataFrame, value: str = "value") -> DataFrame:
    """(bin, low, high, n): as many bins as min(20, max(8, n // 8)) over the range of the values."""
    ends = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("k"))
    ends = ends.select("lo", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1).alias("hi"), F.least(F.lit(20), F.greatest(F.lit(8), F.expr("k DIV 8"))).cast("int").alias("bins"))
    v = values.select(F.col(value).alias("v")).where("v IS NOT NULL").crossJoin(F.broadcast(ends))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins"))), F.col("bins") - 1)
    counted = v.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ends.withColumn("bin", F.explode(F.expr("sequence(0, bins - 1)"))).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    return every.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def pca(points: DataFrame, coordinates: str, k: int = 15) -> tuple[DataFrame, list[float]]:
    """`points` with a column e of principal components, and their shares of the variance. The products of
    coordinates are summed batch by batch, one matrix a task (its size is the square of the width, not of the rows), and
    decomposed on the driver; data are centred."""
    width = len(points.select(coordinates).first()[0])
    v = F.col(coordinates).cast("array<double>")

    def sums(batches):
        n, mean, second = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, width)
            n, mean, second = n + len(x), mean + x.sum(0), second + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([second.ravel().tolist()])], names=["n", "s", "c"])

    held = points.select(v.alias("v")).where("v IS NOT NULL").mapInArrow(sums, "n long, s array<double>, c array<double>")
    added = held.select("n", F.posexplode(F.concat("s", "c")).alias("at", "c")).groupBy("at").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).orderBy("at").collect()
    n, flat = added[0].n, np.array([r.c for r in added]) / max(added[0].n, 1)
    mean, second = flat[:width], flat[width:]
    cov = second.reshape(width, width) - np.outer(mean, mean)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    keep = min(max(2, min(k, n, width)), width)
    vectors, values = vectors[:, ::-1][:, :keep], np.maximum(values[::-1], 0)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(keep)] < 0, -1, 1)
    centre = F.array(*[F.lit(float(x)) for x in mean])
    parts = [F.aggregate(F.zip_with(F.zip_with(v, centre, lambda a, b: a - b), F.array(*[F.lit(float(x)) for x in vectors[:, c]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for c in range(keep)]
    return points.withColumn("e", F.array(*parts)), list(values[:keep] / max(values.sum(), 1e-300))


def label_permutation(points: DataFrame, key: str, label: str, coordinates: str, replicates: int = 32, seed: int = 42, least: int = 8, max_dim: int = 1, metric: str = "euclidean") -> DataFrame:
    """(metric, group_a, group_b, observed_difference, z_score, empirical_p): do two groups differ more in a metric than
    groups of the same sizes with permuted labels? p counts differences as large in absolute value, without centring, and
    is smoothed by one. Without exactly two groups of `least` rows or more: no rows. Groups of under three rows have zeros.
    """
    spark = points.sparkSession
    groups = [r["label"] for r in matrix.eligible_groups(points, label, least, 8).orderBy(F.desc("n"), "label").collect()]
    if len(groups) != 2:
        return spark.createDataFrame([], "metric string, group_a string, group_b string, observed_difference double, z_score double, empirical_p double")
    own = points.select(F.col(key).alias("key"), F.coalesce(F.col(label).cast("string"), F.lit("None")).alias("label"), F.col(coordinates).alias("x")).where(F.col("label").isin(groups))
    dealt = matrix.permuted(own, "key", "label", replicates, seed)
    shuffled = dealt.join(own.select("key", "x"), "key")
    every = own.select(F.lit(-1).alias("replicate"), "label", "x").unionByName(shuffled.select("replicate", "label", "x"))
    clouds = every.withColumn("cloud", F.concat_ws("/", "replicate", F.when(F.col("label") == groups[0], "a").otherwise("b")))
    sizes = clouds.groupBy("cloud").agg(F.count("*").alias("rows"))
    clouds = clouds.select("cloud", "x").repartition(16 * (replicates + 1), "cloud")  # else several clouds meet in a task while others wait
    found = sizes.join(metrics(bars(clouds, "cloud", "x", max_dim, metric)), "cloud", "left")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.when(F.col("rows") >= 3, F.coalesce(m, F.lit(0.0))).otherwise(0.0).alias("v")) for m in METRICS])).alias("m")
    sign = F.when(F.col("cloud").endswith("/a"), 1.0).otherwise(-1.0)
    long = found.select(F.split_part("cloud", F.lit("/"), F.lit(1)).cast("int").alias("replicate"), sign.alias("sign"), pairs)
    diff = long.groupBy("replicate", "m.metric").agg(F.sum(F.col("sign") * F.col("m.v")).alias("d"))
    told = diff.withColumn("o", F.max(F.when(F.col("replicate") < 0, F.col("d"))).over(Window.partitionBy("metric")))
    null = told.where("replicate >= 0").groupBy("metric", "o").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.count_if(F.abs("d") >= F.abs("o")).alias("far"), F.count("*").alias("n"))
    return null.select(
        "metric", F.lit(groups[0]).alias("group_a"), F.lit(groups[1]).alias("group_b"), F.col("o").alias("observed_difference"),
        F.when(F.col("std") > 0, (F.col("o") - F.col("mean")) / F.col("std")).otherwise(0.0).alias("z_score"), ((F.col("far") + 1) / (F.col("n") + 1)).alias("empirical_p"),
    )
