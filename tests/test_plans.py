"""Plans that share a sort or a median among tasks, against numpy and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.operators import carriers, discovery, homology, matrix, sites
from braidwork.sources import loaders, sinks

CASES = {
    "odd": [5.0, 1.0, 9.0, 2.0, 2.0], "even": [4.0, 1.0, 3.0, 10.0], "nulls": [None, 7.0, None, 8.0], "none": [None, None, None], "constant": [3.0] * 6, "one": [2.5],
    "heavy": [1.0] * 900 + [float(i) for i in range(100)], "far": [-1e9, 0.1, 0.2, 1e9], "many": [float((i * 7919) % 10007) for i in range(10007)],
}


@pytest.mark.parametrize("name", CASES)
def test_profile_is_exact(spark, name):
    values = CASES[name]
    df = spark.createDataFrame([(i, v, float(i % 3)) for i, v in enumerate(values)], "i int, v double, w double").repartition(5)
    row = matrix.profile(df, ["v", "w"]).where("column = 'v'").first()
    here = [v for v in values if v is not None]
    assert (row.rows, row.nulls, row.distinct_values) == (len(values), len(values) - len(here), len(set(values)))
    if not here:
        assert row["median"] is None and row["mean"] is None
        return
    assert row["median"] == np.median(here) and row.min_value == min(here) and row.max_value == max(here)
    assert row["std"] == pytest.approx(np.std(here)) and row["mean"] == pytest.approx(np.mean(here))


def test_profile_of_an_empty_table(spark):
    rows = matrix.profile(spark.createDataFrame([], "v double"), ["v"]).collect()
    assert [(r.rows, r.nulls, r.distinct_values, r["median"]) for r in rows] == [(0, 0, 0, None)]


def test_prepare_fills_and_scales_as_numpy_does(spark):
    rng = np.random.default_rng(3)
    v = [None if i % 5 == 0 else float(x) for i, x in enumerate(rng.normal(50, 7, 400))]
    df = spark.createDataFrame([(i, x, 5.0 if i % 2 else None) for i, x in enumerate(v)], "k int, v double, w double")
    got, told = matrix.prepare(df, "k")
    x = np.array([np.nan if y is None else y for y in v])
    x = np.where(np.isnan(x), np.nanmedian(x), x)
    rows = got.orderBy("k").collect()
    np.testing.assert_allclose([r.v for r in rows], (x - x.mean()) / x.std(), rtol=1e-9, atol=1e-12)
    assert {r.w for r in rows} == {0.0} and told["imputed"] == 280


@pytest.mark.parametrize("keys", [list(range(500)), [f"k{i:03d}é" for i in range(500)], [i * i * 1.5 for i in range(500)]], ids=["int", "text", "double"])
def test_numbers_follow_the_order_of_the_key(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys]).toDF("k").repartition(7)
    got = {r.k: r.n for r in matrix.numbered(df, "k", "n").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_permuted_keeps_the_values(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(300)], "k int, v double")
    rows = matrix.permuted(df, "k", "v", 3).collect()
    for r in range(3):
        own = sorted((x.k, x.v) for x in rows if x.replicate == r)
        assert [k for k, _ in own] == list(range(300)) and sorted(v for _, v in own) == [float(i * i) for i in range(300)] and own != [(i, float(i * i)) for i in range(300)]


def test_pruning_keeps_the_newest(spark):
    files = spark.createDataFrame([(f"p{i}", 10, f"2024-01-{1 + i:02d} 00:00:00") for i in range(20)], "path string, bytes long, modified string").withColumn("modified", F.to_timestamp("modified"))
    kept = loaders.prune_cache(files, "2024-01-21", 10 * 86400, 45)
    assert sorted((r.path, r.held) for r in kept.collect()) == [("p16", 40), ("p17", 30), ("p18", 20), ("p19", 10)]


def test_components_match_numpy(spark):
    x = np.random.default_rng(1).normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>").repartition(4)
    got, share = homology.pca(df, "x", 3)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    np.testing.assert_allclose(share, values[:3] / values.sum(), rtol=1e-9)
    e = np.array([r.e for r in got.orderBy("i").collect()])
    np.testing.assert_allclose(e.var(0), values[:3], rtol=1e-9)


def test_betti_curves_count_the_bars_at_each_step(spark):
    rng = np.random.default_rng(5)
    bars = [("a", 0, float(b), float(b + p)) for b, p in zip(rng.integers(0, 10, 60) / 4, rng.integers(1, 10, 60) / 4, strict=True)] + [("b", 0, 1.0, 1.0 + 1e-12)]
    got = homology.betti_curve(spark.createDataFrame(bars, "cloud string, dim int, birth double, death double"), 0, 41).collect()
    assert len(got) == 82
    for r in got:
        assert r.betti == sum(c == r.cloud and b <= r.x < d for c, _, b, d in bars), r


def test_guesses_stand_behind_links(spark):
    homes = spark.createDataFrame([("s.com", "https://s.com/", None)], "site string, url string, platforms array<string>")
    found = spark.createDataFrame([("s.com", "https://s.com/company", "")], "site string, url string, text string")
    rows = sites.candidates(found, guessed=discovery.guesses(homes)).where("role = 'about'").orderBy("rank").collect()
    assert [(r.url, r.linked) for r in rows] == [("https://s.com/company", True), ("https://s.com/about", False), ("https://s.com/about-us", False)]


def test_html_is_escaped(spark):
    assert spark.range(1).select(sinks.escaped(F.lit("<a href='x'>\"&\"</a>")).alias("t")).first().t == "&lt;a href=&#39;x&#39;&gt;&#34;&amp;&#34;&lt;/a&gt;"


def test_clouds_without_bars_have_flat_curves(spark):
    bars = [("a", 0, 0.0, 2.0), ("b", 1, 0.0, 2.0), ("c", 0, 0.0, float("inf"))]
    got = homology.betti_curve(spark.createDataFrame(bars, "cloud string, dim int, birth double, death double"), 0, 5).collect()
    assert sorted((r.cloud, r.x, r.betti) for r in got) == [("a", i / 2, int(i < 4)) for i in range(5)] + [(c, i / 4, 0) for c in "bc" for i in range(5)]


def test_a_carrier_in_the_same_city_is_surer(spark):
    companies = spark.createDataFrame([("x", "Longstride Hauling", "OH", "Dublin"), ("y", "Longstride Hauling", "OH", "Salem")], "company string, name string, state string, city string")
    found = spark.createDataFrame([(c, "1", "Longstride Freight Hauling", "", "OH", "1 Elm St, DUBLIN, OH") for c in "xy"], "company string, usdot string, legal_name string, dba_name string, state string, physical_address string")
    got = {r.company: r.score for r in carriers.match_carriers(companies, found).collect()}
    without = {r.company: r.score for r in carriers.match_carriers(companies.drop("city"), found).collect()}
    assert got["x"] == pytest.approx(min(1.0, got["y"] + 0.1)) and without["x"] == without["y"] == got["y"]


def test_replicates_are_listed_in_order(spark):
    rows = spark.createDataFrame([("m", 2, 0.2), ("m", 0, 0.5), ("m", 1, 0.1)], "metric string, replicate int, value double")
    assert matrix.replicate_lists(rows).first()["values"] == [0.5, 0.1, 0.2]
