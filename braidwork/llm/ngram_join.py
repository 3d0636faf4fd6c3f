"""N-gram Jaccard join by PartEnum signatures.

Each document is its set of distinct 5-word shingles; documents with the same set are one node. Two sets of sizes a and
b have Jaccard similarity 3/4 or more exactly if they differ in at most (a+b)/7 elements, and then b <= 4a/3.

Sets are dealt into size bands (overlapping, so that any two linkable sizes share one). A band cuts the feature domain
into first-level partitions, each of these into SECOND second-level ones, and a set's signatures are the hashes of its
elements in every subset of SECOND - SPARED second-level partitions of a first-level one. Linked sets differ in k
elements at most, so at most k // 2 first-level partitions hold two differences or more; in any other, some subset is
free of differences and its signature is shared. First-level partitions are taken in one fixed order until k // 2 +
slack of them are full (whatever subset is left out, elements remain). Of two linked sets the one that stops first has
slack partitions where the other has the same signature, and the other has gone at least as far: they share `slack`
signatures or more. Sets under SMALL elements, and what the second exchange below takes, use the finest partition, where
every feature is its own and all are shipped: linked sets share n - n // 4 or more.

Signatures travel packed, bucket by bucket, 11 bytes each. A signature in at most GROUP nodes gives its pairs, counted.
Of pairs whose counts can reach the slack, those go whose outlines differ too much: an outline counts a set's elements in
each cell of the domain, about six to a cell, and the counts of two sets cannot differ by more than the sets do. The rest
are compared by their sets. A signature in more nodes gives no pairs: each of its
nodes loses one from its slack instead. Two nodes miss each other only if both have lost all of it. Such nodes (members
of large groups of near copies) are dealt out once more, by themselves and by the finest partition; nodes that stay used
up can now only be linked if the smaller number of their crowded elements reaches 3(a+b)/7. They go through pivots: each
crowded signature names its most crowded node, what can be linked to it is compared with it, and what is linked belongs
to it; what is left names four times as many, and so on. Two members of different pivots can only be linked if their
pivots are at Jaccard distance 3/4 or less (triangle inequality), and need to be compared only if their components are
still apart. Nothing is dropped.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import RowFilter, buckets, discard, materialize, spread_join
from .components import components
from .words import U64, chunks, mix, mix_one, pieces, release, shingles, signed

SHINGLE = 5
GROUP = 8
SMALL = 48
SECOND, SPARED = 3, 1
LOAD = 4
BANDS = 24
PART = 1 << 16
_SUBSETS = list(combinations(range(SECOND), SECOND - SPARED))
_INST = 31
_SIG = 40
_SHARED_BITS = U64((1 << 48) - 1)
_PACKED = "bucket int, kind int, x long, y long, z long, n int, payload binary"
_NAMES = ["bucket", "kind", "x", "y", "z", "n", "payload"]
_FOUND = "kind int, a long, b long, c long, n int, m int, outline binary"


def bands(size: int) -> list[int]:
    """The one or two instances in which a set of this size has signatures: 0 the finest partition, for sets of under
    SMALL elements; j >= 1 the band of sizes SMALL * 2**(j-1) up to twice that. A set that can be linked to one below
    its band takes part in the band below too. The last band is open."""
    if size < 3:
        return []
    j = 0 if size < SMALL else min((size // SMALL).bit_length(), BANDS)
    return [j, j - 1] if j and 3 * size < 4 * (SMALL << (j - 1)) else [j]


def slack_of(band: int, size: int) -> int:
    """How many signatures any two linked sets share in a band, the one of this size being either."""
    return size - size // 4 if band == 0 else 1 + (SMALL << (band - 1)) // 96


def signatures(sets: list[np.ndarray], band: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sorted sets, each in a band of 1 or more; the place of the set that each belongs to; and for each set
    whether it has too few full partitions for the guarantee (its own signatures then say nothing of whom it misses)."""
    size = np.array([len(s) for s in sets])
    band = np.array(band)
    parts = (SMALL << band) * 4 // 3 // LOAD
    k = (size + 4 * size // 3) // 7
    need = k // (SPARED + 1) + 1 + (SMALL << (band - 1)) // 96
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    part = ((elements >> U64(32)) * parts.astype(U64)[owner]) >> U64(32)
    second = (elements & U64(0xFFFFFFFF)) % U64(SECOND)
    first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])])
    hashed = mix(elements)
    sums = [np.add.reduceat(np.where(second == j, hashed, U64(0)), first) for j in range(SECOND)]
    held = [np.add.reduceat(second == j, first, dtype=np.int64) > 0 for j in range(SECOND)]
    part, owner = part[first], owner[first]
    full = np.sum(held, axis=0) > SPARED
    upto = np.cumsum(full)
    start = np.searchsorted(owner, np.arange(len(sets) + 1))
    before = np.r_[0, upto][start]
    use = upto - full - before[owner] < need[owner]
    poor = before[1:] - before[:-1] < need
    out, of = [], []
    for i, subset in enumerate(_SUBSETS):
        ok = use & np.any([held[j] for j in subset], axis=0)
        where = mix((part[ok] * U64(len(_SUBSETS)) + U64(i)) << U64(8) | band.astype(U64)[owner[ok]])
        total = sum((sums[j][ok] for j in subset[1:]), sums[subset[0]][ok])
        out.append(mix(total + where) & ~U64(_INST) | band.astype(U64)[owner[ok]])
        of.append(owner[ok])
    return np.concatenate(out), np.concatenate(of), poor


def node_of(elements: np.ndarray) -> int:
    return mix_one(int(np.bitwise_xor.reduce(mix(elements + U64(1)))) + len(elements) * 0x9E3779B97F4A7C15) if len(elements) else 0


def aliases(nodes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """48 bits for a node: its size on a scale of sixteenths of a power of two, and 40 bits of its hash. Several nodes may
    share one; joins back to nodes then meet them all."""
    scale = np.minimum(255, np.floor(16 * np.log2(np.maximum(sizes, 1)))).astype(U64)
    return scale << U64(40) | nodes >> U64(24)


def outline(elements: np.ndarray) -> bytes:
    """How many elements lie in each of 2**j equal cells of the domain, up to 255, a byte each."""
    bits = max(4, (len(elements) // 6).bit_length())
    return np.minimum(np.bincount((elements >> U64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def apart(x, y) -> int:
    """A lower bound of the number of elements that only one of two sets has, by their outlines."""
    x, y = sorted((np.frombuffer(v.as_buffer(), np.uint8).astype(np.int64) for v in (x, y)), key=len)
    return int(np.abs(x - np.minimum(y.reshape(len(x), -1).sum(1), 255)).sum())


def _shipped(sets, nodes, n_buckets: int, fine: bool):
    """(bucket, payload) rows of the signatures of these sets, and which sets are poor in bands (a bit for each)."""
    poor = np.zeros(len(sets), np.int64)
    sig, of, held, held_of, held_band = [], [], [], [], []
    for i, s in enumerate(sets):
        for band in [0] if fine else bands(len(s)):
            if band == 0:
                sig.append(mix(s + U64(1)) & ~U64(_INST))
                of.append(np.full(len(s), i))
            else:
                held.append(s)
                held_of.append(i)
                held_band.append(band)
    begin, upto = 0, np.cumsum([len(x) for x in held])
    while begin < len(held):  # a part at a time, so that little memory is held besides what is shipped
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PART)))
        more, at, bad = signatures(held[begin:end], held_band[begin:end])
        owner, band = np.array(held_of[begin:end]), np.array(held_band[begin:end])
        sig.append(more)
        of.append(owner[at])
        np.bitwise_or.at(poor, owner[bad], 1 << band[bad])
        begin = end
    if not sig:
        return [], poor
    sig, of = np.concatenate(sig), np.concatenate(of)
    alias = aliases(np.array(nodes, U64), np.array([len(s) for s in sets]))
    bucket = (sig >> U64(_SIG)) % U64(n_buckets)
    order = np.argsort(bucket << U64(_SIG) | sig & U64((1 << _SIG) - 1))
    sig, alias, bucket = sig[order], alias[of[order]], bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    low, high = sig.astype(np.uint32), (sig >> U64(32)).astype(np.uint8)
    a, b = alias.astype(np.uint32), (alias >> U64(32)).astype(np.uint16)
    return [(int(bucket[i]), b"".join(v[i:j].tobytes() for v in (low, a, b, high))) for i, j in zip(cuts, np.r_[cuts[1:], len(sig)], strict=True)], poor


def _packed_rows(rows) -> pa.RecordBatch:
    m = len(rows)
    none = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(np.zeros(m, np.int32)), *none, pa.array([r[1] for r in rows], pa.binary())], names=_NAMES)


def _pack(batches, n_buckets: int):
    """From (key, text) batches: a base row for each document (key, node, bands in which it is poor, size, and its alias),
    and packed signatures for each bucket."""
    for batch in pieces(batches, 1, 2 << 20):
        keys, nodes, sizes, place, sets, own = batch.column(0), [], [], {}, [], []
        for words in chunks(batch.column(1), lower=True):
            found, at = shingles(words, SHINGLE)
            for d in range(len(words)):
                s = np.unique(found[at[d] : at[d + 1]])
                node = node_of(s)
                if node not in place:
                    place[node] = len(sets)
                    sets.append(s)
                    own.append(node)
                nodes.append(node)
                sizes.append(len(s))
        rows, poor = _shipped(sets, own, n_buckets, False)
        nodes, sizes = np.array(nodes, U64), np.array(sizes, np.int32)
        m = batch.num_rows
        poor = poor[[place[int(x)] for x in nodes]] if m else poor
        alias = aliases(nodes, sizes)
        lines = [outline(x) for x in sets]
        payload = pa.array([int(a).to_bytes(8, "little") + lines[place[int(x)]] for a, x in zip(alias, nodes, strict=True)], pa.binary())
        bucket = (mix(keys.fill_null(0).to_numpy().view(U64)) % U64(n_buckets)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.ones(m, np.int32)), keys, pa.array(signed(nodes)), pa.array(poor), pa.array(sizes), payload], names=_NAMES)
        if rows:
            yield _packed_rows(rows)
        sets = rows = None
        release()


def _pack_sets(batches, n_buckets: int):
    """From (node, elements) batches: packed signatures by the finest partition."""
    for batch in pieces(batches, 1):
        sets = [unpacked(p) << U64(16) for p in batch.column(1)]
        rows, _ = _shipped(sets, batch.column(0).to_numpy().view(U64), n_buckets, True)
        if rows:
            yield _packed_rows(rows)
        sets = rows = None
        release()


def _unpack(payloads):
    sigs, owners = [], []
    for p in payloads:
        raw = p.as_buffer()
        m = len(raw) // 11
        sigs.append(np.frombuffer(raw, np.uint32, m) | np.frombuffer(raw, np.uint8, m, 10 * m).astype(U64) << U64(32))
        owners.append(np.frombuffer(raw, np.uint32, m, 4 * m) | np.frombuffer(raw, np.uint16, m, 8 * m).astype(U64) << U64(32))
    return np.concatenate(sigs), np.concatenate(owners)


def _pairs(sig, node, group: int):
    """Counted pairs of aliases within small groups of a signature, and the members of larger groups."""
    order = np.argsort(sig)
    sig, node = sig[order], node[order]
    same = sig[1:] == sig[:-1]
    keep = np.r_[False, same] | np.r_[same, False]  # all others are alone
    sig, node = sig[keep], node[keep]
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    keep = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])][: len(sig)]
    sig, node = sig[keep], node[keep]
    start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
    length = np.diff(np.r_[start, len(sig)])
    left, right = [], []
    for m in range(2, group + 1):
        s = start[length == m]
        if len(s):
            i, j = np.triu_indices(m, 1)
            left.append((s[:, None] + i).ravel())
            right.append((s[:, None] + j).ravel())
    big = np.repeat(length > group, length)
    crowd = (sig[big], node[big])
    if not left:
        return None, crowd
    left, right = np.concatenate(left), np.concatenate(right)
    a, b = ((node[x] >> U64(40)).astype(np.int64) for x in (left, right))
    ok = np.abs(a - b) <= 7  # sizes at most 4 to 3
    left, right = left[ok], right[ok]
    if not len(left):
        return None, crowd
    inst = (sig[left] & U64(_INST)).astype(np.int32)
    order = np.lexsort((inst, node[right], node[left]))
    a, b, inst = node[left[order]], node[right[order]], inst[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (inst[1:] != inst[:-1])])
    return (a[first], b[first], inst[first], np.diff(np.r_[first, len(a)]).astype(np.int32)), crowd


def _reduce(table: pa.Table, group: int) -> pa.Table:
    """One bucket: base rows go through (kind 1), counted pairs (kind 2: two aliases, instance, count), members of crowded
    signatures (kind 3: signature, alias, instance)."""
    kind = table.column("kind").to_numpy()
    base = table.filter(pa.array(kind == 1))
    carried = [p.as_py() for p in base.column("payload")]
    alias = np.frombuffer(b"".join(p[:8] for p in carried), np.int64)
    nulls, types = (lambda m, t: pa.nulls(m, t)), [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    poor = base.column("z").combine_chunks().cast(pa.int32())
    out = [[pa.array(np.full(base.num_rows, 1, np.int32)), base.column("x").combine_chunks(), base.column("y").combine_chunks(), pa.array(alias, pa.int64()), base.column("n").combine_chunks(), poor, pa.array([p[8:] for p in carried], pa.binary())]]
    packed = table.filter(pa.array(kind == 0))
    if packed.num_rows:
        bucket = packed.column("bucket")[0].as_py()
        pairs, (sig, node) = _pairs(*_unpack(packed.column("payload")), group)
        if pairs:
            a, b, inst, count = pairs
            out.append([pa.array(np.full(len(a), 2, np.int32)), pa.array(signed(a)), pa.array(signed(b)), nulls(len(a), types[3]), pa.array(count), pa.array(inst), nulls(len(a), pa.binary())])
        if len(sig):
            m = len(sig)
            out.append([pa.array(np.full(m, 3, np.int32)), pa.array(signed(sig | U64(bucket) << U64(_SIG))), pa.array(signed(node)), nulls(m, types[3]), nulls(m, types[4]), pa.array((sig & U64(_INST)).astype(np.int32)), nulls(m, pa.binary())])
    packed = table = None
    release()
    return pa.concat_tables(pa.Table.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks == 1 else c for c in part], names=["kind", "a", "b", "c", "n", "m", "outline"]) for part in out)


def _exchange(packed: DataFrame, n: int, group: int) -> DataFrame:
    return materialize(packed.repartition(n, "bucket").groupBy("bucket").applyInArrow(lambda table: _reduce(table, group), _FOUND), "signatures")


def _slack(inst, size):
    return F.when(inst == 0, size - F.floor(size / 4)).otherwise(1 + F.floor(F.lit(SMALL) * F.pow(F.lit(2.0), inst - 1) / 96)).cast("long")


def _candidates(found: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of nodes (a, b) to compare; and (node, n, lost) of nodes whose slack the crowded signatures have used up, or
    that are poor in full partitions."""
    crowd = found.where("kind = 3").select(F.col("b").alias("alias"), F.col("m").alias("inst"))
    lost = materialize(crowd.groupBy("alias", "inst").agg(F.count("*").alias("lost")), "lost")
    gone = lost.join(nodes, "alias").where(F.col("lost") >= _slack(F.col("inst"), F.col("n"))).select("node", "lost")
    used = gone.unionAll(nodes.where("poor <> 0").select("node", F.lit(0).cast("long").alias("lost"))).groupBy("node").agg(F.max("lost").alias("lost"))
    pairs = found.where("kind = 2").groupBy("a", "b", F.col("m").alias("inst")).agg(F.sum("n").alias("shared"))
    for s in "ab":
        pairs = pairs.join(nodes.select(F.col("alias").alias(s), F.col("node").alias(s + s), F.col("n").alias("n" + s)), s)
        pairs = pairs.join(lost.select(F.col("alias").alias(s), "inst", F.col("lost").alias("l" + s)), [s, "inst"], "left")
    slack = F.greatest(_slack(F.col("inst"), F.col("na")), _slack(F.col("inst"), F.col("nb")))
    enough = slack - F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    pairs = pairs.where((F.col("shared") >= enough) & F.expr("3 * na <= 4 * nb AND 3 * nb <= 4 * na"))
    pairs = materialize(pairs.select(F.least("aa", "bb").alias("a"), F.greatest("aa", "bb").alias("b")).distinct(), "pairs")
    for s in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(s), F.col("n").alias("n" + s), F.col("outline").alias("o" + s)), s)

    def sift(batches):
        for batch in batches:
            a, b, na, nb, oa, ob = (batch.column(i) for i in range(6))
            least = np.array([apart(x, y) for x, y in zip(oa, ob, strict=True)], np.int64)
            yield batch.select([0, 1]).filter(pa.array(7 * least <= na.to_numpy().astype(np.int64) + nb.to_numpy()))

    pairs = pairs.select("a", "b", "na", "nb", "oa", "ob").mapInArrow(sift, "a long, b long")
    # The few nodes of one alias have not been told apart.
    twins = nodes.groupBy("alias").agg(F.collect_list("node").alias("x")).where("size(x) > 1").select("x", F.explode("x").alias("a")).select("a", F.explode("x").alias("b")).where("a < b")
    used = materialize(used.join(nodes.select("node", "n", "alias", "outline"), "node"), "used")
    return materialize(pairs.unionAll(twins).distinct(), "candidates"), used


def packed(elements: np.ndarray) -> bytes:
    """A set by the upper 48 bits of its hashes, 6 bytes each."""
    top = elements >> U64(16)
    return top.astype(np.uint32).tobytes() + (top >> U64(32)).astype(np.uint16).tobytes()


def unpacked(p) -> np.ndarray:
    raw = p.as_buffer()
    m = len(raw) // 6
    return np.frombuffer(raw, np.uint32, m) | np.frombuffer(raw, np.uint16, m, 4 * m).astype(U64) << U64(32)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, elements): the packed set of each wanted (node, rep), found by one pass over the documents (k, t)."""
    sift = RowFilter(wanted.select(F.col("node").bitwiseXOR(F.col("rep")).alias("at")), "at", hashed=True)
    shared = docs.sparkSession.sparkContext.broadcast(sift.map)

    def find(batches):
        for batch in pieces(batches, 1, 2 << 20):
            keys = batch.column(0).fill_null(0).to_numpy().view(U64)
            out = [], [], []
            for words in chunks(batch.column(1), lower=True):
                found, at = shingles(words, SHINGLE)
                sets = [np.unique(found[at[d] : at[d + 1]]) for d in range(len(words))]
                nodes = np.array([node_of(s) for s in sets], U64)
                for d in np.flatnonzero(RowFilter.has(shared.value, nodes ^ keys[words.row : words.row + len(words)])):
                    for o, v in zip(out, (keys[words.row + d].view(np.int64), nodes[d].view(np.int64), packed(sets[d])), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["rep", "node", "elements"])
            out = None
            release()

    found = docs.mapInArrow(find, "rep long, node long, elements binary")
    return materialize(found.dropDuplicates(["node", "rep"]).join(wanted, ["node", "rep"]).select("node", "elements"), "sets")


def _jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) with shared and union sizes, from the sets of both nodes. Pairs must be written; a may be met often, b not.
    Only sets that some pair may need are shuffled."""
    left, right = (RowFilter(pairs, s, hashed=True).keep(sets, "node").select(F.col("node").alias(s), F.col("elements").alias("e" + s)) for s in "ab")
    both = spread_join(pairs.select("a", "b"), left, "a", "b").join(right, "b").select("a", "b", "ea", "eb")

    def compare(batches):
        for batch in batches:
            x, y, shared, total = batch.column(2), batch.column(3), [], []
            for i in range(batch.num_rows):
                s, t = unpacked(x[i]), unpacked(y[i])
                n = len(np.intersect1d(s, t, assume_unique=True))
                shared.append(n)
                total.append(len(s) + len(t) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "shared", "total"])

    return both.mapInArrow(compare, "a long, b long, shared long, total long")


LINKED = "100 * shared >= 75 * total"


def _leading(crowd: DataFrame) -> DataFrame:
    """For nodes dealt by the finest partition: as many of a node's crowded elements, least crowded first, as any linked
    node that shares only crowded elements must share one of: it has 3/4 of the node's elements, so all but 1/4 less
    the uncrowded ones can be passed over."""
    often = materialize(crowd.groupBy("sig").agg(F.count("*").alias("often")), "often")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "sig"))
    first = spread_join(crowd, often, "sig", "node").withColumn("rank", rank).where("rank <= lost - (n - n DIV 4) + 1")
    return materialize(first.select("sig", "node", "n", "lost"), "leading")


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for p in parts[1:]:
        result = result.unionAll(p)
    return result


def _to_pivots(crowd: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(node, pivot, shared, total) for every node that only crowded signatures bring together and each pivot that it is
    linked to; pivots have a row of their own. Most crowded nodes, which are central to their groups, go first."""
    found, width = [], 1
    active = materialize(crowd.select("node").distinct(), "active")
    while active.limit(1).count():
        here = materialize(crowd.join(active, "node", "left_semi"), "crowd")
        rank = F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("lost"), "node"))
        named = here.withColumn("rank", rank).where(F.col("rank") <= width).select("sig", F.col("node").alias("a"), F.col("n").alias("na"), F.col("lost").alias("la"))
        named = materialize(named, "named")
        asked = spread_join(here, named, "sig", "node").where("a <> node AND 7 * least(lost, la) >= 3 * (n + na)").select("a", F.col("node").alias("b")).distinct()
        asked = materialize(asked, "asked")
        pivots = named.select(F.col("a").alias("node")).distinct()
        linked = materialize(_jaccard(asked, sets).where(LINKED), "linked")
        found += [linked.select(F.col("b").alias("node"), F.col("a").alias("pivot"), "shared", "total"), pivots.selectExpr("node", "node AS pivot", "1L AS shared", "1L AS total")]
        active = materialize(active.join(linked.select(F.col("b").alias("node")).unionAll(pivots), "node", "left_anti"), "active")
        width *= 4
    return materialize(_union(found), "pivots") if found else None


def _across_pivots(crowd: DataFrame, to_pivots: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of different pivots whose components are still apart."""
    near = F.max(F.struct((F.col("shared") / F.col("total")).alias("j"), "pivot")).alias("m")
    held = to_pivots.groupBy("node").agg(near).select("node", F.col("m.pivot").alias("pivot"), (1 - F.col("m.j")).alias("far"))
    held = held.join(labels, "node", "left").select("node", "pivot", "far", F.coalesce("label", "node").alias("label"))
    held = held.join(crowd.groupBy("node").agg(F.max("n").alias("n"), F.max("lost").alias("lost")), "node")
    held = materialize(held, "held")
    # The largest partner that some member can have by its crowded elements, and the smallest member.
    cap = F.max(F.expr("7 * held.lost / 3 - held.n")).alias("cap")
    seats = crowd.select("sig", "node").join(held.alias("held"), "node").groupBy("sig", "pivot", "label").agg(cap, F.min("held.n").alias("least"))
    seats = materialize(seats, "seats")
    other = seats.select("sig", F.col("pivot").alias("other"), F.col("label").alias("apart"), F.col("cap").alias("cap2"), F.col("least").alias("least2"))
    meet = seats.join(other, "sig").where("label <> apart AND pivot < other AND least2 <= cap + 1e-9 AND least <= cap2 + 1e-9").select(F.col("pivot").alias("a"), F.col("other").alias("b")).distinct()
    close = _jaccard(materialize(meet, "meet"), sets).where("4 * shared >= total").select("a", "b", (1 - F.col("shared") / F.col("total")).alias("apart"))
    side = lambda n, p: held.select(F.col("node").alias("n" + n), F.col("pivot").alias(p), F.col("far").alias("f" + n), F.col("lost").alias("l" + n), F.col("n").alias("s" + n))
    cross = close.join(side("1", "a"), "a").join(side("2", "b"), "b").where("apart - f1 - f2 <= 0.25 + 1e-9 AND 7 * least(l1, l2) >= 3 * (s1 + s2)")
    return _jaccard(materialize(cross.select(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b")).distinct(), "cross"), sets).where(LINKED).select("a", "b")


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """One row for each row of `docs`: (key, n_shingles long, component_id long).

    A-Z are lower-cased; words are `[^\\x20\\x09-\\x0D]+`; the set of a document is its distinct 5-word shingles, with
    fewer words the whole sequence. Documents link when 100 * intersection >= 75 * union; component_id is the smallest
    key reachable by links, the document itself included. Null and empty texts: no shingles, linked with nothing.
    Repeated rows and ties: each gets the same component. Null keys: the row stays, links as any other, and gets the
    smallest key of its component, null if there is none. Other columns are ignored; an empty table gives no rows.
    Sets are compared by hashes of shingles, 64 bits in signatures and 48 bits where two sets are compared.
    """
    source = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    n = min(3 * buckets(source), 1 << 23)  # small enough to sort in little memory
    found = _exchange(source.mapInArrow(lambda batches: _pack(batches, n), _PACKED), n, group)
    base = found.where("kind = 1").select(F.col("a").alias(key), F.col("b").alias("node"), F.col("n").alias("n_shingles"), F.col("c").alias("alias"), F.col("m").alias("poor"), "outline")
    nodes = base.groupBy("node").agg(F.min(key).alias("rep"), F.max("n_shingles").alias("n"), F.max("alias").alias("alias"), F.max("poor").alias("poor"), F.first("outline").alias("outline"))
    nodes = materialize(nodes, "nodes")
    able = nodes.where("n >= 1")
    pairs, used = _candidates(found, able)
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).unionAll(used.select("node")).distinct()
    wanted = materialize(wanted.join(nodes, "node").select("node", F.coalesce("rep", F.lit(0).cast("long")).alias("rep")), "wanted")
    sets = _sets(source, wanted)
    discard(wanted)
    crowded = RowFilter(used, "node", hashed=True).keep(sets, "node").join(used.select("node"), "node", "left_semi")
    again = _exchange(crowded.mapInArrow(lambda batches: _pack_sets(batches, n), _PACKED), n, group)
    members = used.select("node", "n", "alias", F.lit(0).alias("poor"), "outline")
    more, used = _candidates(again, members)
    crowd = again.where("kind = 3").select(F.col("a").alias("sig"), F.col("b").alias("alias")).join(used, "alias").select("sig", "node", "n", "lost")
    crowd = _leading(materialize(crowd, "crowd"))
    pairs = materialize(pairs.unionAll(more).distinct(), "candidates")

    # One comparison a node first; pairs that these have joined already need none.
    near = materialize(pairs.groupBy("b").agg(F.min("a").alias("a")), "near")
    links = _jaccard(near, sets).where(LINKED).select("a", "b")
    to_pivots = _to_pivots(crowd, sets)
    if to_pivots is not None:
        links = links.unionAll(to_pivots.where("node <> pivot").select("node", "pivot"))
    links = materialize(links, "links")
    labels = components(links)
    side = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias("l" + s))
    rest = pairs.join(near, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left").where("NOT coalesce(la, a) <=> coalesce(lb, b)")
    more = _jaccard(materialize(rest.select("a", "b"), "rest"), sets).where(LINKED).select("a", "b")
    if to_pivots is not None:
        more = more.unionAll(_across_pivots(crowd, to_pivots, labels, sets))
    more = materialize(more, "links")
    if more.limit(1).count():
        labels = components(links.unionAll(more))
    label = F.coalesce("label", "node")
    placed = materialize(nodes.join(labels, "node", "left").select("node", "rep", label.alias("label")), "labelled")
    smallest = placed.groupBy("label").agg(F.min("rep").alias("component_id"))
    placed = materialize(spread_join(placed, smallest, "label", "node").select("node", "component_id"), "placed")
    base = materialize(base.select(key, "node", "n_shingles"), "base")
    discard(found, again, sets, pairs, near, crowd)
    own = F.when(F.col("n_shingles") == 0, F.col(key)).otherwise(F.col("component_id"))
    return spread_join(base, placed, "node", key).select(key, F.col("n_shingles").cast("long").alias("n_shingles"), own.alias("component_id"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
