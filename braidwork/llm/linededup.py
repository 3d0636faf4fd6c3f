"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Every document is an array of line hashes. Of every two consecutive lines the one with the smaller hash is a fingerprint
(winnowing with a window of two), so every run of two lines or more has one, and equal runs have the same. Positions of a
fingerprint are joined by what stands beside them: the match is extended to the left with the first position that has
the same line on its left, and to the right with the first that has the same line on its right. Whatever meets an
earlier position so is part of a run that was there before; such matches chain to whole runs, and go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import discard, materialize, spread_join

_NO_LINES = "CAST(array() AS array<int>)"


def _hashes(docs: DataFrame, key: str, text: str) -> DataFrame:
    lines = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.col(text), "\n"))
    hashed = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 15), 16, 10).cast("long"))
    return docs.select(F.col(key).cast("long").alias("d"), F.xxhash64(text).alias("m"), hashed.alias("h"))


def _fingerprints(base: DataFrame) -> DataFrame:
    """(d, m, p, f, beside, side, at): the fingerprint f at line p, extended by the line beside it: side -1 its left, 1 its
    right one; `at` is the first of the two lines. One row for each two consecutive lines."""
    pairs = base.where("size(h) > 1").select("d", "m", F.posexplode(F.expr("transform(sequence(0, size(h) - 2), i -> named_struct('x', h[i], 'y', h[i + 1]))")).alias("at", "w"))
    left = F.col("w.x") <= F.col("w.y")
    return pairs.select("d", "m", "at", F.when(left, F.col("w.x")).otherwise(F.col("w.y")).alias("f"), F.when(left, F.col("w.y")).otherwise(F.col("w.x")).alias("beside"), F.when(left, 1).otherwise(-1).alias("side"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: (key, n_lines, n_removed, removed): removed lists the deleted lines' places from 0.

    Lines are what newlines separate, unchanged. Documents count in the order of their keys (those of one key in the
    order of a hash of their text); identical rows of one key are one document, and each row gets its result. Deleted is
    every line in a run of two lines or more that stands, line by line, at an earlier place: in an earlier document or
    further up in the same one, piece by piece where it takes several earlier places to make it up. Every such run is
    met; a line that repeats by itself stays.
    Null or empty text: no lines. Null key: counts before all others. Empty table: no rows. Other columns are ignored.
    Work grows with the lines, also within one document: each two lines are one row, that is joined to one first position.
    Lines that a third of all documents share are spread over many tasks (cluster.spread_join).
    """
    base = materialize(_hashes(docs, key, text), "lines")
    seeds = _fingerprints(base.dropDuplicates(["d", "m"])).withColumn("g", F.xxhash64("f", "beside", "side"))
    seeds = materialize(seeds, "seeds")
    first = seeds.groupBy("g", "f", "beside", "side").agg(F.min(F.struct("d", "m", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select("g", F.col("f").alias("f0"), F.col("beside").alias("beside0"), F.col("side").alias("side0"), "first", "n"), "first")
    met = spread_join(seeds, first, "g", "d", counts=first.groupBy("g").agg(F.sum("n").alias("count"))).where("f = f0 AND beside = beside0 AND side = side0 AND NOT (d <=> first.d AND m = first.m AND at = first.at)")
    gone = met.select("d", "m", F.explode(F.array("at", F.col("at") + 1)).alias("line"))
    removed = materialize(gone.groupBy("d", "m").agg(F.sort_array(F.collect_set("line")).alias("removed")), "removed")
    discard(seeds, first)
    x, y = base.select("d", "m", F.size("h").cast("long").alias("n_lines")).alias("x"), removed.alias("y")
    out = x.join(y, F.col("x.d").eqNullSafe(F.col("y.d")) & (F.col("x.m") == F.col("y.m")), "left")
    places = F.coalesce("removed", F.expr(_NO_LINES))
    return out.select(F.col("x.d").alias(key), "n_lines", F.size(places).cast("long").alias("n_removed"), places.alias("removed"))


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the repeated lines taken out of the texts (keys must be unique here). What stands between two deleted
    lines is cut out whole, so that a document's lines are looked at once."""
    removed = repeated_lines(docs, key, text).where("n_removed > 0").select(F.col(key).alias("__k"), F.col("removed").alias("__gone"))
    out = docs.withColumn("__lines", F.split(F.col(text), "\n")).join(removed, F.col(key) == F.col("__k"), "left")
    kept = F.expr("array_join(flatten(transform(sequence(0, size(__gone)), i -> slice(__lines, IF(i = 0, 0, __gone[i - 1] + 1) + 1, IF(i = size(__gone), size(__lines), __gone[i]) - IF(i = 0, 0, __gone[i - 1] + 1)))), '\n')")
    return out.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("removed", F.array_join(F.transform("removed", lambda i: i.cast("string")), ","))


#: The same from its definition: each two lines are looked up whole, without fingerprints.
ORACLE_SQL = """
WITH base AS (SELECT doc_id AS d, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS h FROM documents),
pairs AS (SELECT d, i, h[i + 1] AS x, h[i + 2] AS y FROM (SELECT d, h, unnest(range(0, len(h) - 1)) AS i FROM base WHERE len(h) > 1)),
seen AS (SELECT d, i, row_number() OVER (PARTITION BY x, y ORDER BY d, i) AS nth FROM pairs),
gone AS (SELECT DISTINCT d, unnest([i, i + 1]) AS line FROM seen WHERE nth > 1),
removed AS (SELECT d, list_sort(list(line)) AS r FROM gone GROUP BY d)
SELECT base.d AS doc_id, len(h)::BIGINT AS n_lines, coalesce(len(r), 0)::BIGINT AS n_removed, coalesce(array_to_string(r, ','), '') AS removed
FROM base LEFT JOIN removed USING (d)
"""
