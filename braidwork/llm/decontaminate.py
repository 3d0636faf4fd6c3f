"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import bound_batches
from .words import U64, chunks, mix, pieces, shingles

SHINGLE = 5
CONTAINMENT = 0.75
BLOCK_SHINGLES = 1 << 21
_MAP_BITS = 22


class ItemIndex:
    """Test items as shingle sets, partitioned by size, with a bottom MinHash sketch of each.

    Items of n shingles fall into the partition of sizes 2**p <= n < 2**(p+1). At containment c a document misses at
    most n - ceil(c*n) shingles of an item, so of any more than that many of its shingles it holds one: the sketch of
    an item is that many plus one of its smallest hashes, by the largest size of its partition, and at most n. A search
    by sketches therefore loses nothing; each candidate is then compared shingle by shingle.
    """

    def __init__(self, item_ids: np.ndarray, sets: list[np.ndarray], containment: float):
        self.ids = item_ids
        self.need = np.array([int(np.ceil(containment * len(s) - 1e-9)) for s in sets], np.int64)
        self.sets = sets
        keys, owners = [], []
        for i, s in enumerate(sets):
            if not len(s):
                continue
            top = (1 << len(s).bit_length()) - 1  # the largest size in this partition
            k = min(len(s), top - int(np.ceil(containment * top - 1e-9)) + 1)
            keys.append(s[np.argsort(mix(s), kind="stable")[:k]])
            owners.append(np.full(k, i))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, U64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owner = self.keys[order], owner[order]
        self.map = np.zeros(1 << _MAP_BITS, bool)
        self.map[(self.keys >> U64(64 - _MAP_BITS)).astype(np.int64)] = True

    def search(self, shingle: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(document's place, item's place, shingles of the item in the document) for each pair that reaches the containment."""
        at = np.flatnonzero(self.map[(shingle >> U64(64 - _MAP_BITS)).astype(np.int64)])
        if not len(at):
            return []
        low = np.searchsorted(self.keys, shingle[at])
        high = np.searchsorted(self.keys, shingle[at], "right")
        at, low, high = at[high > low], low[high > low], high[high > low]
        if not len(at):
            return []
        doc = np.searchsorted(offsets, at, "right") - 1
        pairs = {(int(d), int(o)) for d, a, b in zip(doc, low, high, strict=True) for o in self.owner[a:b]}
        out = []
        for d, o in sorted(pairs):
            n = int(np.isin(self.sets[o], shingle[offsets[d] : offsets[d + 1]]).sum())
            if n >= self.need[o]:
                out.append((d, o, n))
        return out


def _items(benchmark: DataFrame, item_key: str, text: str, shingle: int):
    """Blocks of items as (ids, shingle sets), each of at most about BLOCK_SHINGLES shingles (16 MB of hashes)."""
    rows = benchmark.select(F.col(item_key).cast("long").alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull() & F.col("i").isNotNull()).orderBy("i", "t")
    ids, sets, held = [], [], 0

    def out():
        return np.array(ids, np.int64), list(sets)

    for row in rows.toLocalIterator(prefetchPartitions=False):
        for w in chunks(pa.array([row.t], pa.large_string()), lower=True):
            found = np.unique(shingles(w, shingle)[0])
        ids.append(row.i)
        sets.append(found)
        held += len(found)
        if held >= BLOCK_SHINGLES:
            yield out()
            ids, sets, held = [], [], 0
    if ids:
        yield out()


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs (key, item_id, n_shared, n_item, containment) in which a document holds at least `containment` of the
    distinct `shingle`-word shingles of a test item. A-Z are lower-cased, words split at white space.

    The test items are a stated query set: they are searched against all documents in blocks of a fixed size, each
    block broadcast (at most about 2 million shingles) and matched in one pass over the documents; nothing is shuffled.
    Items shorter than a shingle count as one shingle, their whole sequence, and so match only documents that consist
    of the same words. Null or empty texts on either side match nothing; items with a null id are left out. Repeated
    documents each get their rows; an item id with several texts is matched by each of them.
    Other columns of either table are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    schema = f"{key} long, item_id long, n_shared long, n_item long, containment double"
    source = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    result = None
    for ids, sets in _items(benchmark, item_key, text, shingle):
        shared = spark.sparkContext.broadcast((ids, sets))

        def search(batches, shared=shared):
            index = ItemIndex(*shared.value, containment)
            size = np.array([len(s) for s in index.sets], np.int64)
            for batch in pieces(batches, 1):
                at, item, n = [], [], []
                for words in chunks(batch.column(1), lower=True):
                    for d, o, m in index.search(*shingles(words, shingle)):
                        at.append(words.row + d)
                        item.append(o)
                        n.append(m)
                if at:
                    item = np.array(item)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), pa.array(index.ids[item]), pa.array(n, pa.int64()), pa.array(size[item]), pa.array(np.array(n) / size[item])],
                        names=[key, "item_id", "n_shared", "n_item", "containment"],
                    )

        part = source.mapInArrow(search, schema)
        result = part if result is None else result.unionAll(part)
    return spark.createDataFrame([], schema) if result is None else result


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """`docs` without contaminated documents, other rows and columns unchanged. The test is made within each row's own
    scan, so rows with a null or repeated key are judged one by one by their own text."""
    spark = docs.sparkSession
    bound_batches(spark)
    schema = docs.schema
    column = docs.columns.index(text)
    result = docs
    for ids, sets in _items(benchmark, item_key, text, shingle):
        shared = spark.sparkContext.broadcast((ids, sets))

        def keep(batches, shared=shared):
            index = ItemIndex(*shared.value, containment)
            for batch in pieces(batches, column):
                ok = np.ones(batch.num_rows, bool)
                for words in chunks(batch.column(column), lower=True):
                    for d, _, _ in index.search(*shingles(words, shingle)):
                        ok[words.row + d] = False
                yield batch.filter(pa.array(ok))

        result = result.mapInArrow(keep, schema)
    return result


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = "list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def shingle_sql(key: str, text: str, table: str) -> str:
    """DuckDB: rows (key, g) of the distinct 5-word shingles of a table's texts."""
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' ')) END) AS g
      FROM (SELECT {key}, {_WORDS.format(text=text)} AS w FROM {table} WHERE {text} IS NOT NULL)"""


ORACLE_SQL = f"""
WITH d AS ({shingle_sql('doc_id', 'text', 'documents')}), b AS ({shingle_sql('item_id', 'text', 'benchmark')}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY 1)
SELECT d.doc_id, n.item_id, count(*) AS n_shared, n.n_item, count(*) / n.n_item::DOUBLE AS containment
FROM d JOIN b USING (g) JOIN n USING (item_id) GROUP BY d.doc_id, n.item_id, n.n_item
HAVING count(*) >= ceil({CONTAINMENT} * n.n_item - 1e-9)
"""
