"""Registered queries on tables that the driver's small ones do not hold, against their SQL."""

import tracemalloc

import duckdb
import numpy as np
import pytest

from braidwork.operators import homology
from braidwork.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture
def agrees(spark, tmp_path):
    """Runs a query and its SQL over the rows of one table; returns both results, sorted."""

    def run(name, table, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        return got, sorted(con.execute(ORACLE_SQL[name]).fetchall())

    return run


def test_thin_pages_has_one_row_for_each_page_of_an_address(agrees):
    page = "<html><title>A</title><body><p>%s</p><a href=\"/x\">x</a></body></html>"
    rows = [(1, "https://a.com/", page % "one two"), (2, "https://a.com/", page % "one two three"), (3, None, page % "one"), (4, "https://b.com/", page % "four")]
    got, want = agrees("thin_pages", "pages", rows, "page_id long, url string, html string")
    assert len(got) == 4 and got == want


def test_page_text_leaves_references_without_a_semicolon(agrees):
    cut = "<html><head><title>Rye &amp;&amp; oats &amp</title></head><body><h1>Rye &amp;&amp; oats &amp</h1><p>5 & 6 &copy; &quot &#3</p></body></html>"
    got, want = agrees("page_text", "pages", [(1, "https://a.com/", cut)], "page_id long, url string, html string")
    assert got == want and got[0][2] == "Rye && oats &amp"


@pytest.mark.parametrize("block", [1024, 7])
def test_pairwise_distances_with_zero_equal_and_near_vectors(spark, agrees, monkeypatch, block):
    from braidwork.plans import registry

    rng = np.random.default_rng(1)
    x = [[float(v) for v in rng.normal(1000, 1, 5)] for _ in range(60)]
    x[4], x[5], x[6] = [0.0] * 5, x[7], [v + 1e-4 for v in x[7]]
    rows = [(i * 37 % 61, v, None if i > 57 else i % 3) for i, v in enumerate(x)]
    every = registry.pairs.distances
    monkeypatch.setattr(registry.pairs, "distances", lambda *a: every(*a, block=block))
    got, want = agrees("pairwise_distances", "embeddings", rows, "vec_id long, embedding array<double>, label int")
    assert len(got) == len(want) and repr(got) == repr(want)


def test_pairwise_distances_are_not_joined_row_by_row(spark):
    plan = QUERIES["pairwise_distances"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "zip_with" not in plan


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "cityblock"])
@pytest.mark.parametrize("kind", ["even", "ties", "copies", "apart"])
def test_tree_lengths_are_those_of_the_whole_matrix(metric, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4))
    x = {"even": x, "ties": np.round(x), "copies": np.r_[x[:200], x[:100], x[:100] + 1e-7] + 100, "apart": np.r_[x[:130], x[130:] * 0.01 + 50]}[kind]
    want = np.sort([w for _, _, w in homology.tree(homology.distances(x, metric))])
    for k in (1, 5, 24):
        np.testing.assert_allclose(np.sort(homology.tree_lengths(x, metric, k, 1 << 14)), want, rtol=1e-9, atol=1e-11)


def test_tree_lengths_hold_no_matrix():
    x = np.random.default_rng(5).normal(size=(6000, 8))
    tracemalloc.start()
    assert len(homology.tree_lengths(x)) == 5999
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6000 * 6000 * 8 / 6


def test_label_permutation_makes_its_bars_once(spark):
    plan = QUERIES["label_permutation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1


def loops(d):
    """Bars of dimension 1 by reduction of all triangles."""
    n = len(d)
    edges = sorted((d[a, b], a, b) for a in range(n) for b in range(a + 1, n))
    rank = {(a, b): r for r, (_, a, b) in enumerate(edges)}
    triangles = sorted((max(r), r) for a in range(n) for b in range(a + 1, n) for c in range(b + 1, n) for r in [(rank[a, b], rank[a, c], rank[b, c])])
    ends, out = {}, []
    for longest, r in triangles:
        left = set(r)
        while left and max(left) in ends:
            left ^= ends[max(left)]
        if left:
            ends[max(left)] = left
            if edges[longest][0] > edges[max(left)][0]:
                out.append((edges[max(left)][0], edges[longest][0]))
    return sorted(out)


@pytest.mark.parametrize("kind", ["even", "ties", "copies", "apart"])
def test_bars_of_dimension_1_are_those_of_all_triangles(kind, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 3))
    x = {"even": x, "ties": np.round(x), "copies": np.r_[x[:20], x[:10], x[:10] + 1e-7], "apart": np.r_[x[:15], x[15:] * 0.01 + 50]}[kind]
    d = homology.distances(x)
    for first in (1, 4, 16):
        monkeypatch.setattr(homology, "FIRST_EDGES", first)
        np.testing.assert_allclose(sorted(homology.bars_one(d)), loops(d))
        half = float(np.median(d))
        np.testing.assert_allclose(np.reshape(sorted(homology.bars_one(d, half)), (-1, 2)), np.reshape([x for x in loops(d) if x[1] <= half], (-1, 2)))


def test_bars_of_dimension_1_of_over_256_points():
    t = np.linspace(0, 2 * np.pi, 600, endpoint=False)
    (birth, death), = homology.bars_one(homology.distances(np.c_[np.cos(t), np.sin(t)]))
    assert birth == pytest.approx(2 * np.sin(np.pi / 600)) and death == pytest.approx(np.sqrt(3))
    assert len(homology.bars_one(homology.distances(np.random.default_rng(7).normal(size=(400, 16))))) > 400


def test_label_permutation_takes_both_dimensions_of_whole_sides(spark):
    rows = {r["metric"]: r for r in QUERIES["label_permutation"](spark, "/root/testdata/sf0.001").collect()}
    assert {*rows} == {*homology.METRICS}
    v = duckdb.sql("SELECT embedding, abs(label % 2) FROM '/root/testdata/sf0.001/embeddings.parquet'").fetchall()
    sides = [homology.distances(np.array([e for e, s in v if s == side], float)) for side in (0, 1)]
    found = [homology.bars_one(d) for d in sides]
    sign = 1 if rows["H1_count"].group_a == "0" else -1
    assert rows["H1_count"].observed_difference == sign * (len(found[0]) - len(found[1])) != 0
    every = [[b - a for a, b in f] + [w for _, _, w in homology.tree(d)] for f, d in zip(found, sides, strict=True)]
    assert rows["total_persistence"].observed_difference == pytest.approx(sign * (sum(every[0]) - sum(every[1])), abs=1e-4)
