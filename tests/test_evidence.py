"""Evidence operators against stated results: claims, states, accounts, areas, dates, plans and signals."""

import datetime

import pytest
from pyspark.sql import functions as F

from braidwork.functions import text as tx
from braidwork.operators import evidence, profiles, scoring, sites

SAID = [
    ("We are a team of 18, based by the sea", 18), ("a family of four restaurants", None), ("a family of 4 restaurants", None), ("we employ over 1,200 people", 1200), ("serving 4,500 people", None),
    ("our team of 30 designers", 30), ("staff of about 65", 65), ("a group of 12 hotels", None), (None, None),
]


def test_headcount_claims(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SAID)], "i int, t string").select("i", evidence.headcount(F.col("t")).alias("n")).collect()
    assert [r.n for r in sorted(rows)] == [n for _, n in SAID]


@pytest.mark.parametrize("address, state", [("1 Elm St, Salem, OR 97301", "OR"), ("1 Elm St, Salem OR 97301-1234", "OR"), ("1 Elm St, Salem, OR", "OR"), ("1 Elm St, Salem", None), ("OR 97301, somewhere", None)])
def test_states(spark, address, state):
    assert spark.range(1).select(evidence.state_of(F.lit(address)).alias("s")).first().s == state


def test_dates_come_in_the_order_of_the_patterns(spark):
    text = "3 May 2021, then June 4, 2020, then 2019-07-05, then 2019-07-05 and 31 June 2020"
    got = spark.range(1).select(tx.dates(F.lit(text), F.lit("2024-01-01").cast("date")).alias("d")).first().d
    assert got == [datetime.date(2019, 7, 5)] * 2 + [datetime.date(2020, 6, 4), datetime.date(2021, 5, 3)]


def test_plan_goes_by_role_and_leaves_room_for_home(spark):
    paths = ["/privacy", "/terms", "/legal", "/pricing", "/plans", "/about", "/blog", "/news", "/careers", "/jobs", "/customers", "/case-studies"]
    found = spark.createDataFrame([("s.com", "https://s.com" + p, "", i % 2 == 0) for i, p in enumerate(paths)], "site string, url string, text string, linked boolean")
    ranked = sites.candidates(found)
    chosen = sites.plan(ranked).orderBy("place").collect()
    from collections import Counter

    from braidwork.functions.urls import ROLE_RULES

    roles = [r.role for r in chosen]
    order = [r for r, _, _ in ROLE_RULES]
    assert roles == sorted(roles, key=order.index) and all(n <= (2 if r in sites.MULTI else 1) for r, n in Counter(roles).items())
    assert sites.plan(ranked, 4).count() == 3
    assert sites.candidates(found.drop("linked")).select("linked").distinct().collect()[0].linked is True


def test_linked_pages_come_before_guesses(spark):
    found = spark.createDataFrame([("s.com", "https://s.com/about", "", False), ("s.com", "https://s.com/about-us", "", True)], "site string, url string, text string, linked boolean")
    assert [r.url for r in sites.candidates(found).orderBy("rank").collect()] == ["https://s.com/about-us", "https://s.com/about"]


def test_quiet_trades_are_not_assessable_and_weights_grow(spark):
    facts = spark.createDataFrame([("a", "local_services", 3, "sales-led"), ("b", "saas", 9, "unknown")], "site string, model string, model_signals int, motion string")
    bands = {r.site: r.momentum_band for r in scoring.scores(facts).collect()}
    assert bands["a"] == "not assessable" and bands["b"] == "thin"
    told = {(r.site, r.signal): r.weight for r in scoring.signals(facts).collect()}
    assert told[("a", "revenue_model")] == 0.7 and told[("b", "revenue_model")] == 0.9 and told[("a", "sales_motion")] == 0.6 and ("b", "sales_motion") not in told


def test_pages_that_say_nothing(spark):
    page = profiles.with_role(sites.parsed(spark.createDataFrame([("https://x.com/", None), ("https://x.com/contact", ""), ("https://y.com/", "<p>12345</p>")], "url string, html string")))
    for f in (evidence.socials, evidence.emails, evidence.phones, evidence.addresses, evidence.founded, evidence.funding, evidence.legal_pages):
        assert f(page).count() == 0, f.__name__
        assert f(page.limit(0)).count() == 0
    assert evidence.thin(page).where("thin").count() == 3
    assert {r.site: (r.areas, r.hours) for r in evidence.locality(page).collect()} == {"x.com": ([], ""), "y.com": ([], "")}
    assert [r.tags for r in evidence.industries(page).collect()] in ([[], []], [])
