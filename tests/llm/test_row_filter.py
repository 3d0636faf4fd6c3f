"""Filters by rows and small tables of the driver need no Python on the executors, whose workers' memory comes on top."""

import corpus_pipeline as cp
from braidwork.llm import shard
from braidwork.llm.cluster import RowFilter, local_table
from braidwork.llm.words import _TABLES, CHUNK_BYTES, powers


def plan(df):
    return df._jdf.queryExecution().toString()


def test_row_filter_keeps_rows_without_python(spark):
    keys, rows = spark.range(0, 4000, 7), spark.range(-50, 4000).selectExpr("id", "nullif(id, 5) AS __page", "'t' AS t")
    want = {*range(0, 4000, 7)}
    for hashed in (False, True):
        sift = RowFilter(keys, "id", hashed=hashed)
        kept, rest = sift.keep(rows, "id"), sift.keep(rows, "id", present=False)
        assert kept.columns == rest.columns == rows.columns
        got, left = {r.id for r in kept.collect()}, {r.id for r in rest.collect()}
        assert want <= got and got | left == {*range(-50, 4000)} and not got & left and len(got) <= len(want) + 5
        assert "Python" not in plan(kept) and "InArrow" not in plan(rest)
        bits = sift.map
        assert len(bits) == sift.bits // 8 + 4096 and sum(int(b).bit_count() for b in bits[bits > 0]) == len({*want})
    none = RowFilter(keys.where("id < 0"), "id")
    assert none.keep(rows, "id").count() == 0 and none.keep(rows, "id", present=False).count() == 4050


def test_small_tables_run_no_python(spark):
    table = local_table(spark, [(1, [2, 3]), (None, None)], "a long, b array<long>")
    assert [tuple(r) for r in table.collect()] == [(1, [2, 3]), (None, None)]
    assert local_table(spark, [], "a long, b int").count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (table, shard.shard_rows(docs)):
        assert "ExistingRDD" not in plan(df) and "Python" not in plan(df)


def test_near_copies_stage_passes_texts_by_no_kernel(spark):
    d = "/root/testdata/sf0.001"
    assert "InArrow" not in plan(cp.near_copies_stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d))


def test_tables_of_powers_stay_small():
    powers(3, 1 << 20)
    assert 3 not in _TABLES and len(powers(3, CHUNK_BYTES)) == CHUNK_BYTES == len(_TABLES[3])
