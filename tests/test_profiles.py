"""Technologies, revenue models, prices and open roles of small sites against stated results."""

from pyspark.sql import functions as F

from braidwork.operators import profiles, sites


def pages(spark, *rows):
    return profiles.with_role(sites.parsed(spark.createDataFrame(list(rows), "url string, html string")))


def test_prices(spark):
    page = pages(
        spark,
        ("https://a.com/pricing", "<p>Pro costs $1,200 in one payment, for all of our customers everywhere</p><p>29,99 €</p><p>€29,99 per month</p><p>$0</p><p>$250,000</p><p>$1,200 / year</p>"),
        ("https://b.com/", "<p>It saved us $30,000 in the first year of using it all</p><p>Only £29 per month when you pay us by the year in advance</p>"),
        ("https://c.com/", "<p>nothing</p>"),
        ("https://d.com/", None),
    )
    got = [tuple(r) for r in profiles.prices(page).orderBy("site", "place").collect()]
    assert got == [("a.com", "29,99 €", 29.99, 1, "USD"), ("a.com", "€29,99 per month", 29.99, 2, "USD"), ("a.com", "$1,200", 1200.0, 3, "USD"), ("a.com", "$1,200 / year", 1200.0, 4, "USD"), ("b.com", "£29 per month", 29.0, 1, "GBP")]
    assert [g[:4] for g in got if g[0] == "b.com"] == [("b.com", "£29 per month", 29.0, 1)]
    assert "d.com" not in {g[0] for g in got}


def test_revenue_models(spark):
    rows = [("s", "Per seat. Per user. Free trial. Subscription. Sign up, get started."), ("u", "per user per user per user"), ("n", None), ("w", "Our clients. Consulting. Case study. Retainer. Get started, sign up.")]
    got = {r.site: r for r in profiles.revenue_models(spark.createDataFrame(rows, "site string, text string")).collect()}
    assert (got["s"].model, got["s"].score, got["s"].signals, got["s"].sales_motion) == ("saas", 10.5, 3, "self-serve")
    assert (got["u"].model, got["u"].score, got["u"].signals) == ("unknown", 9.0, 0)
    assert (got["n"].model, got["n"].score, got["n"].sales_motion) == ("unknown", 0.0, "unknown")
    assert (got["w"].model, got["w"].sales_motion) == ("services", "sales-led")
    told = spark.createDataFrame([("h", "add to cart, checkout", ["Shopify"])], "site string, text string, hints array<string>")
    assert profiles.revenue_models(told, hints="hints").first().score == 14.0


def test_corpus_is_cut_at_the_limit(spark):
    page = spark.createDataFrame([("s", "1", "abcd"), ("s", "2", "efgh"), ("s", "3", "ijkl"), ("t", "1", None)], "site string, url string, text string")
    assert [tuple(r) for r in profiles.corpus(page, 6).collect()] == [("s", "abcd\nef")]


def test_technologies_and_integrations(spark):
    page = pages(spark, ("https://a.com/x", "<script src='https://cdn.shopify.com/a'></script>We integrate. Integrates with Slack, Zoom and Stripe today"), ("https://a.com/b", "<b>fbq('x') MyShopify.com</b>"))
    got = {r.name: (r.category, r.url, r.dependency) for r in profiles.technologies(page).collect()}
    assert got == {"Shopify": ("E-commerce platform", "https://a.com/b", True), "Facebook Pixel": ("Advertising", "https://a.com/b", False)}
    headed = page.withColumn("h", F.create_map(F.lit("server"), F.lit("nginx/1.2")))
    assert "Nginx" in {r.name for r in profiles.technologies(headed, headers="h").collect()}
    names = [r.name for r in profiles.integrations(page).orderBy("place").collect()]
    assert names[:2] == ["Slack", "Zoom"]


def test_open_roles(spark):
    page = pages(
        spark,
        ("https://a.com/careers", "<a href='/careers/backend-engineer'>Backend Engineer</a><a href='/careers/'>Careers page</a><a href='/jobs/all'>All jobs</a><a href='https://jobs.lever.co/a/2'>Sales Lead</a><a href='https://jobs.lever.co/a/2'>Apply now</a>"),
        ("https://b.com/careers", "<p>We have no open positions.</p><a href='/jobs/x'>Chief of nothing</a>"),
        ("https://c.com/careers", "<script type='application/ld+json'>{\"@type\": \"JobPosting\", \"title\": \"Recruiter\"}</script>"),
        ("https://d.com/careers", "<p>Hello</p>"),
        ("https://e.com/", "<a href='/jobs/x'>Plumber</a>"),
    )
    got = {r.site: tuple(r)[1:] for r in profiles.open_roles(page).collect()}
    assert got == {"a.com": (2, ["Backend Engineer", "Sales Lead"], ["Engineering", "Sales"]), "b.com": (0, [], []), "c.com": (1, ["Recruiter"], ["People"]), "d.com": (None, [], [])}
