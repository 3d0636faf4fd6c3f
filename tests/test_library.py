"""The library's queries against DuckDB, its kernels against brute force, and its rules against stated cases."""

import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from braidwork.functions import text as tx
from braidwork.functions import urls
from braidwork.functions.page import read_page
from braidwork.operators import carriers, homology, matrix, sites
from braidwork.plans.registry import ORACLE_SQL, QUERIES
from braidwork.sources import loaders
from braidwork.streaming import cadence

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(df):
    def cell(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        return round(v, 6) + 0.0 if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)

    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        expected = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert cells(got) == cells(expected)
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def brute_bars(d):
    """Bars of dimension 1 by reducing the whole boundary matrix."""
    n = len(d)
    simplices = sorted((max([d[a, b] for a, b in itertools.combinations(s, 2)] + [0.0]), len(s), s) for k in (1, 2, 3) for s in itertools.combinations(range(n), k))
    place = {s: i for i, (_, _, s) in enumerate(simplices)}
    low, out = {}, []
    for j, (length, k, s) in enumerate(simplices):
        column = {place[f] for f in itertools.combinations(s, k - 1)} if k > 1 else set()
        while column and max(column) in low:
            column ^= low[max(column)]
        if column:
            low[max(column)] = column
            birth = simplices[max(column)]
            if birth[1] == 2 and length > birth[0]:
                out.append((birth[0], length))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_bars_are_brute_force(seed):
    d = homology.distances(np.random.default_rng(seed).normal(size=(9, 2)))
    assert np.allclose(sorted(homology.bars_one(d)), brute_bars(d))


def test_bars_of_shapes():
    t = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    bars = homology.bars_one(homology.distances(np.c_[np.cos(t), np.sin(t)]))
    assert len(bars) == 1 and bars[0][1] > 1.5
    turn = np.array([[0.6, -0.8], [0.8, 0.6]])
    x = np.random.default_rng(1).normal(size=(30, 2))
    assert np.allclose(sorted(homology.bars_one(homology.distances(x))), sorted(homology.bars_one(homology.distances(x @ turn + 3))))
    assert homology.bars_one(np.zeros((2, 2))) == [] and homology.tree(np.zeros((1, 1))) == []


def test_prepare_refuses(spark):
    with pytest.raises(ValueError, match="no rows"):
        matrix.prepare(spark.createDataFrame([], "a int"))
    with pytest.raises(ValueError, match="no numeric"):
        matrix.prepare(spark.createDataFrame([("x",)], "a string"))
    with pytest.raises(ValueError, match="constant"):
        matrix.prepare(spark.createDataFrame([(1,), (1,)], "a int"))
    with pytest.raises(ValueError, match="not found"):
        matrix.prepare(spark.createDataFrame([(1,)], "a int"), label="b")
    rows, told = matrix.prepare(spark.createDataFrame([(1.0, 5), (2.0, 5), (3.0, None), (10.0, 5), (None, 5)], "a double, b int"))
    assert told["imputed"] == 2 and rows.columns == ["a", "b"] and any(abs(r.a - (2.5 - 3.7) / 3.2187) < 1e-4 for r in rows.collect())


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_url_rules(spark):
    host = lambda s: one(spark, urls.host_of(F.lit(s)))
    assert host("Example.com") == host("https://user@example.com:8080/x?y#z") == "example.com" and host("  ") is None
    clean = lambda s: one(spark, urls.clean_url(F.lit(s)))
    assert clean("https://A.com?utm_source=x&b=1#t") == "https://a.com/?b=1" and clean("mailto:a@b.c") is None
    site = lambda u, d: one(spark, urls.same_site(F.lit(u), F.lit(d)))
    assert site("https://blog.a.com/x", "www.a.com") and not site("https://nota.com", "a.com")
    assert one(spark, urls.refused_host(F.lit("192.168.0.1"))) and not one(spark, urls.refused_host(F.lit("8.8.8.8")))
    assert one(spark, urls.resolve(F.lit("https://a.com/b/c"), F.lit("../d"))) == "https://a.com/d"
    assert one(spark, urls.classify(F.lit("https://a.com/pricing"), F.lit("Learn more")))["role"] == "pricing"


def test_text_rules(spark):
    for shown, value in (("1,299.00", 1299.0), ("29,99", 29.99), ("1.299", 1299.0), ("12", 12.0), ("1 200,5", 1200.5), ("", None)):
        assert one(spark, tx.amount(F.lit(shown))) == value
    found = one(spark, tx.dates(F.lit("2024-03-02, Jan 5th? Jan 5, 2024 and 7 March 2023; 30 February 2024; 2031-01-01"), F.lit("2026-06-01").cast("date")))
    assert [str(d) for d in found] == ["2024-03-02", "2024-01-05", "2023-03-07"]
    assert one(spark, tx.keyword_count(F.lit("landscaping API api-first"), "api")) == 2
    wait = lambda h: one(spark, tx.retry_after(F.lit(h), F.lit(3), F.lit("2026-01-01 00:00:00").cast("timestamp")))
    assert (wait("5"), wait("900"), wait("-4"), wait("soon"), wait("Thu, 01 Jan 2026 00:00:10 GMT")) == (5, 30, 0, 8, 10)


def test_carrier_names(spark):
    assert one(spark, carriers.normalised_name(F.lit("The Marlowfen Transport, L.L.C."))) == "marlowfen transport"
    alike = lambda a, b: one(spark, carriers.name_similarity(carriers.normalised_name(F.lit(a)), carriers.normalised_name(F.lit(b))))
    assert alike("Q-7 Trucking", "Trucking Inc") == 0 and alike("Marlowfen", "MARLOWFEN TRANSPORT INC") == 0.85 and alike("Ace Movers", "Palace Movers") < 0.62
    companies = spark.createDataFrame([("c1", "Marlowfen", "TX"), ("c2", "Marlowfen", ""), ("c3", "Nobody", "")], "company string, name string, state string")
    found = spark.createDataFrame([("c1", 1, "MARLOWFEN TRANSPORT INC", "", "TX"), ("c2", 1, "MARLOWFEN TRANSPORT INC", "", "TX")], "company string, usdot long, legal_name string, dba_name string, state string")
    rows = {r.company: (r.usdot, r.refused) for r in carriers.match_carriers(companies, found).collect()}
    assert rows == {"c1": (1, None), "c2": (None, "not sure enough"), "c3": (None, "no record found")}


def test_page_kernel():
    text, title, links, meta, data, times, images = read_page('<title> A  b</title><script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"x",}]}</script><h1>H</h1><a href="/c">C <b>d</b></a><meta property="og:title" content="t"><time datetime="2024-01-01"></time><img alt="Logo"><style>p{}</style>')
    assert (text, title, links) == ("A b\nH\nC\nd", "A b", [("/c", "C d")]) and meta == {"og:title": "t"} and '"Organization"' in data[0] and times == ["2024-01-01"] and images == ["Logo"]
    assert read_page(None)[0] == ""


def test_loaders(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿x,y\n1,2\n".encode())
    assert loaders.load(spark, str(tmp_path / "a.csv")).columns == ["x", "y"]
    np.save(tmp_path / "a.npy", np.arange(20.0).reshape(10, 2))
    np.savez(tmp_path / "a.npz", np.ones((3, 4)))
    assert loaders.load(spark, str(tmp_path / "a.npy")).columns == ["feature_0", "feature_1"] and loaders.load(spark, str(tmp_path / "a.npz")).count() == 3
    with pytest.raises(ValueError, match="unsupported"):
        loaders.load(spark, "a.xls")
    with pytest.raises(TypeError):
        loaders.as_frame(spark, 3)


def test_streamed_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = cadence.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, cadence.windowed_counts(events).collect()))


def test_links_are_resolved(spark):
    page = spark.createDataFrame([("https://a.com/x", '<a href="/about">About</a><a href="mailto:x@y.z">m</a><a href="https://b.com/">b</a><a href="/login">in</a>')], "url string, html string")
    assert [tuple(r) for r in sites.links(sites.parsed(page)).collect()] == [("a.com", "https://a.com/about", "About")]
