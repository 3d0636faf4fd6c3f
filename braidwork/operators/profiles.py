"""What a site's pages tell of its business: technologies, revenue model, sales motion, prices, open roles.

Pages come as `sites.parsed` gives them; `order` is the column that says in which order a site's pages were read. Sites may be
of any size: everything is reduced a page at a time before pages of a site meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as pt
from ..functions import text as tx
from ..functions import urls


def with_role(page: DataFrame) -> DataFrame:
    return page.withColumn("role", F.when(urls.path_of(F.col("url")) == "/", "home").otherwise(urls.classify(F.col("url"), F.lit(""))["role"]))


def targets(page: DataFrame, roles=("home", "pricing", "product"), most: int = 3, order: str = "url") -> DataFrame:
    """A site's pages of the given roles; the first few of a site that has none."""
    w = Window.partitionBy("site")
    known = F.coalesce(F.col("role").isin(*roles), F.lit(False))
    marked = page.withColumn("_any", F.max(known).over(w)).withColumn("_n", F.row_number().over(w.orderBy(order)))
    return marked.where(F.when(F.col("_any"), known).otherwise(F.col("_n") <= most)).drop("_any", "_n")


def corpus(page: DataFrame, limit: int = 80_000, order: str = "url") -> DataFrame:
    """(site, text): texts of a site's pages in order, the last one cut where `limit` characters are reached."""
    w = Window.partitionBy("site").orderBy(order)
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = page.where(F.col("text").isNotNull()).select("site", order, "text", before.alias("_before")).where(F.col("_before") < limit)
    cut = kept.select("site", F.struct(F.col(order).alias("o"), F.expr(f"left(text, cast({limit} - _before as int))").alias("t")).alias("p"))
    return cut.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "\n").alias("text"))


def technologies(page: DataFrame, headers: str | None = None, order: str = "url") -> DataFrame:
    """(site, name, category, url, snippet, dependency): each technology once for a site, at its first page."""
    found = [F.when(F.col("html").rlike("(?i)" + p), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(0).alias("kind"), F.left(F.regexp_extract("html", "(?i)" + p, 0), F.lit(60)).alias("snippet"))) for n, c, p in pt.TECHNOLOGIES]
    if headers:
        said = lambda h: F.coalesce(F.col(headers)[h], F.lit(""))
        found += [F.when(said(h).rlike("(?i)" + p), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(1).alias("kind"), F.concat(F.lit(h + ": "), F.left(said(h), F.lit(60))).alias("snippet"))) for n, c, h, p in pt.HEADERS]
    each = page.select("site", F.col(order).alias("o"), "url", F.explode(F.array_compact(F.array(*found))).alias("f"))
    first = each.groupBy("site", F.col("f.name").alias("name")).agg(F.min_by(F.struct("f.category", "url", "f.snippet"), F.struct("o", "f.kind")).alias("x"))
    return first.select("site", "name", "x.category", "x.url", "x.snippet", F.col("name").isin(pt.DEPENDENCIES).alias("dependency"))


def integrations(page: DataFrame, most: int = 12, order: str = "url") -> DataFrame:
    """(site, name, place): products that pages say they integrate with, in order of first mention, `most` a site."""
    groups = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(pt.INTEGRATION), F.lit(2)), lambda g: F.split(g, r",|\band\b")))
    each = page.select("site", F.col(order).alias("o"), F.posexplode(F.transform(groups, lambda x: F.trim(x, F.lit(" .")))).alias("i", "name"))
    named = each.where(F.length("name").between(2, 30) & F.col("name").rlike("^[A-Z]")).groupBy("site", "name").agg(F.min(F.struct("o", "i")).alias("at"))
    return named.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("at"))).where(F.col("place") <= most).drop("at")


def _one_of(names: list[str]):
    return lambda h: h.isin(names)


def model_readings(text: Column, hints: Column | None = None, facts: dict[str, Column] | None = None) -> Column:
    """array<struct<score, place, model, hits>>, best first. Each pattern counts at most three times."""
    out = []
    for place, (model, signals) in enumerate(pt.MODELS.items()):
        score, hits = F.lit(0.0), []
        for p, weight in signals:
            score = score + F.least(F.regexp_count(text, F.lit("(?i)" + p)), F.lit(3)) * weight
            hits.append(F.nullif(F.trim(F.regexp_extract(text, "(?i)" + p, 0)), F.lit("")))
        names, weight = {"ecommerce": (pt.SHOP_PLATFORMS, pt.SHOP_WEIGHT), "saas": (pt.BILLING_PLATFORMS, pt.BILLING_WEIGHT)}.get(model, ([], 0.0))
        every = F.array(*hits)
        if hints is not None and names:
            told = F.filter(F.transform(hints, F.lower), _one_of(names))
            score, every = score + F.size(told) * weight, F.concat(every, told)
        for key, label, w in pt.LOCAL_FACTS if model == "local_services" and facts else []:
            if key in facts:
                held = F.coalesce(facts[key], F.lit(False))
                score, every = score + F.when(held, w).otherwise(0.0), F.concat(every, F.array(F.when(held, label)))
        out.append(F.struct((-score).alias("below"), F.lit(place).alias("place"), F.lit(model).alias("model"), F.array_distinct(F.array_compact(every)).alias("hits")))
    return F.array_sort(F.array(*out))


def revenue_models(texts: DataFrame, hints: str | None = None, facts: dict[str, Column] | None = None, priced: Column | None = None) -> DataFrame:
    """(site, model, score, signals, runners_up, sales_motion) of (site, text): a model needs a score of 5 and three different
    hits, otherwise it is 'unknown'. Runners-up reach three quarters of the best score. Without published prices (`priced`
    false or not given) services are sales-led whatever the calls to action say. No calls at all: 'unknown'."""
    text = F.coalesce(F.col("text"), F.lit(""))
    calls = lambda p: F.regexp_count(text, F.lit(p))
    rows = texts.withColumn("_r", model_readings(text, F.col(hints) if hints else None, facts)).withColumn("_self", calls(pt.SELF_SERVE)).withColumn("_sales", calls(pt.SALES_LED))
    best, score = F.col("_r")[0], -F.col("_r")[0]["below"]
    sure = (score >= pt.MODEL_SCORE) & (F.size(best["hits"]) >= pt.MODEL_HITS)
    near = F.transform(F.filter(F.slice("_r", 2, 2), lambda r: -r["below"] >= score * pt.CLOSE_SECOND), lambda r: r["model"])
    unpriced = F.lit(True) if priced is None else ~F.coalesce(priced, F.lit(False))
    motion = (
        F.when((F.col("_self") == 0) & (F.col("_sales") == 0), "unknown").when(sure & best["model"].isin("services", "local_services") & unpriced, "sales-led")
        .when((F.col("_self") >= 2) & (F.col("_sales") >= 2), "hybrid").when(F.col("_self") > F.col("_sales"), "self-serve").otherwise("sales-led")
    )
    return rows.select(
        "site", F.when(sure, best["model"]).otherwise("unknown").alias("model"), score.alias("score"), F.when(sure, F.size(best["hits"])).otherwise(0).alias("signals"),
        F.when(sure, near).otherwise(F.array().cast("array<string>")).alias("runners_up"), motion.alias("sales_motion"),
    )


_PRICE = rf"(?i)(({pt.SYMBOL})\s?({pt.AMOUNT})|({pt.AMOUNT})\s?({pt.SYMBOL})(?![A-Za-z]))(?=(.{{0,40}}))"


def prices(page: DataFrame, most: int = 8, order: str = "url") -> DataFrame:
    """(site, price, amount, place, currency): a site's lowest distinct prices, and its most frequent currency.

    Numbers on pricing pages count as they stand; elsewhere a billing period must follow within 40 characters, or the line
    be a table cell (40 characters and four words at most). Amounts lie over 0 and up to 100,000.
    """
    line = page.select("site", F.col(order).alias("o"), (F.col("role") == "pricing").alias("listed"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    cell = (F.length("line") <= 40) & (F.size(F.split("line", r"\s+")) <= 4)
    parts = [F.regexp_extract_all("line", F.lit(_PRICE), F.lit(i)).alias(c) for i, c in enumerate(("shown", "before", "x", "y", "after", "rest"), 1)]
    each = line.where(F.col("line").rlike(r"\d")).select("site", "o", "n", "listed", cell.alias("cell"), F.posexplode(F.arrays_zip(*parts)).alias("i", "m"))
    symbol = F.when(F.col("m.before") != "", F.col("m.before")).otherwise(F.col("m.after"))
    code = F.upper(symbol)
    for sign, name in pt.CODES.items():
        code = F.when(symbol == sign, name).otherwise(code)
    period = F.trim(F.regexp_extract("m.rest", pt.PERIOD, 0))
    shown = F.trim(F.regexp_replace(F.concat_ws(" ", F.trim("m.shown"), F.when(period != "", period)), r"\s+", " "))
    read = each.select("site", F.struct("o", "n", "i").alias("at"), tx.amount(F.when(F.col("m.x") != "", F.col("m.x")).otherwise(F.col("m.y"))).alias("amount"), code.alias("code"), shown.alias("price"), (F.coalesce(F.col("listed"), F.lit(False)) | F.col("cell") | (period != "")).alias("good"))
    good = read.where(F.col("good") & (F.col("amount") > 0) & (F.col("amount") <= 100_000))
    by_code = good.groupBy("site", "code").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    currency = by_code.groupBy("site").agg(F.min_by("code", F.struct(-F.col("n"), "at")).alias("currency"))
    distinct = good.groupBy("site", F.lower("price").alias("_k")).agg(F.min(F.struct("amount", "at", "price")).alias("p"))
    ranked = distinct.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("p"))).where(F.col("place") <= most)
    return ranked.select("site", "p.price", "p.amount", "place").join(currency, "site")


def open_roles(page: DataFrame, most: int = 15, order: str = "url") -> DataFrame:
    """(site, open_roles, titles, departments) of sites with careers pages.

    Postings are a page's structured data, else its links to job systems or job paths, without links to itself or to indexes.
    The page with most postings counts. A statement that nothing is open overrides fewer than two; null: nothing is known.
    """
    careers = page.where(F.col("role") == "careers").select("site", F.col(order).alias("o"), "url", "text", "links", "json_ld")
    kind = lambda x: F.lower(F.get_json_object(x, "$['@type']"))
    posted = F.filter("json_ld", lambda x: (kind(x) == "jobposting") | kind(x).contains('"jobposting"'))
    stated = careers.select("site", "o", "url", F.col("text").rlike(pt.NO_OPENINGS).alias("none"), F.size(posted).alias("n_posted"), F.filter(F.transform(posted, lambda x: F.get_json_object(x, "$.title")), lambda x: x != "").alias("posted"))
    link = careers.select("site", "o", "url", F.posexplode("links").alias("i", "l")).select("site", "o", "url", "i", F.col("l.href").alias("href"), F.trim("l.text").alias("label"))
    job = F.col("href").rlike(pt.JOB_HOSTS) | (F.col("href").rlike(pt.JOB_PATH) & (F.length("label") > 3))
    link = link.where(job & F.length("label").between(1, 90) & ~F.col("label").rlike(pt.APPLY_LINE) & ~F.col("label").rlike(pt.JOB_INDEX))
    path = lambda u: F.lower(F.rtrim(urls.path_of(u), F.lit("/")))
    link = link.withColumn("to", path(urls.resolve(F.col("url"), F.col("href")))).where((F.col("to") != "") & (F.col("to") != path(F.col("url"))))
    unique = link.groupBy("site", "o", F.lower("label").alias("k")).agg(F.min(F.struct("i", "label")).alias("x"))
    linked = unique.groupBy("site", "o").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["label"]).alias("linked"))
    both = stated.join(linked, ["site", "o"], "left").withColumn("titles", F.when(F.col("n_posted") > 0, F.col("posted")).otherwise(F.coalesce("linked", F.array().cast("array<string>"))))
    both = both.withColumn("n", F.when(F.col("n_posted") > 0, F.col("n_posted")).otherwise(F.size("titles")))
    # The most postings, and among equals the first page: pages are ranked, then only the best row's titles are kept.
    w = Window.partitionBy("site")
    best = both.withColumn("none", F.max(F.coalesce("none", F.lit(False))).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "o"))).where("rank = 1")
    n = F.when(F.col("none") & (F.col("n") < 2), 0).when(F.col("n") > 0, F.col("n")).when(F.col("none"), 0)
    some = F.coalesce(n > 0, F.lit(False))
    blob = F.lower(F.array_join("titles", " "))
    held = lambda words: F.array_contains(F.array(*[blob.contains(x) for x in words]), True)
    teams = F.array_compact(F.array(*[F.when(held(words), name) for name, words in pt.DEPARTMENTS.items()]))
    empty = F.array().cast("array<string>")
    return best.select("site", n.alias("open_roles"), F.when(some, F.slice("titles", 1, most)).otherwise(empty).alias("titles"), F.when(some, teams).otherwise(empty).alias("departments"))
