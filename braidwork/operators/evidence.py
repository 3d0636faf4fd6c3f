"""What a site's pages tell of its company: accounts, contact details, where and when it works, age, size, money.

Pages come as `profiles.with_role(sites.parsed(...))` gives them. Pages of a site are taken by role and then by `order`, the
column that says in which order they were read. Every page is reduced by itself before pages of a site meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as pt
from ..functions import text as tx
from . import profiles


def _by_role(page: DataFrame, *roles: str, order: str = "url") -> DataFrame:
    """Pages of these roles with `nth`, a site's order of roles and pages."""
    place = F.array_position(F.array(*[F.lit(r) for r in roles]), F.col("role"))
    return page.where(F.col("role").isin(*roles)).withColumn("nth", F.struct(place.alias("r"), F.col(order).alias("o")))


def _asked(page: DataFrame, order: str) -> DataFrame:
    """The contact, about and home pages of a site in this order; of a site without, its first three pages."""
    some = profiles.targets(page, ("contact", "about", "home"), order=order)
    place = F.array_position(F.array(F.lit("contact"), F.lit("about"), F.lit("home")), F.coalesce("role", F.lit("")))
    return some.withColumn("nth", F.struct(place.alias("r"), F.col(order).alias("o")))


def _hrefs() -> Column:
    return F.transform("links", lambda x: x["href"])


def _in_order(rows: DataFrame, found: str, most: int) -> DataFrame:
    """(site, found): arrays of a site's pages joined in order, each value once, at most so many."""
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(found).alias("x")))), lambda p: p["x"]))
    return rows.groupBy("site").agg(F.slice(F.array_distinct(listed), 1, most).alias(found)).where(F.size(found) > 0)


def socials(page: DataFrame) -> DataFrame:
    """(site, network, url, pages): of each network the account that most of a site's pages link to, of equals the shortest.
    Addresses that belong to the network itself are none."""
    seen = page.select("site", F.col("url").alias("page"), F.explode(F.array_distinct(_hrefs())).alias("href"))
    each = F.array(*[F.struct(F.lit(n).alias("network"), F.regexp_extract("href", "(?i)" + p, 0).alias("found")) for n, p in tx.SOCIALS])
    rows = seen.select("site", "page", F.explode(each).alias("x")).select("site", "page", "x.network", "x.found").where((F.col("found") != "") & ~F.col("found").rlike(pt.GENERIC_SOCIAL))
    rows = rows.withColumn("url", F.when(F.col("found").startswith("http"), F.col("found")).otherwise(F.concat(F.lit("https://"), F.col("found"))))
    tally = rows.groupBy("site", "network", "url").agg(F.countDistinct("page").alias("pages"))
    best = tally.groupBy("site", "network").agg(F.min(F.struct((-F.col("pages")).alias("n"), F.length("url").alias("l"), "url")).alias("b"))
    return best.select("site", "network", "b.url", (-F.col("b.n")).alias("pages"))


def emails(page: DataFrame, order: str = "url") -> DataFrame:
    """(site, emails): addresses of the contact, about and home pages, a page's mailto links before its text; six at most."""
    linked = F.transform(F.filter(_hrefs(), lambda h: F.lower(h).startswith("mailto:")), lambda h: F.split_part(F.substring(h, 8, 10000), F.lit("?"), F.lit(1)))
    found = F.transform(F.concat(linked, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(tx.EMAIL), F.lit(0))), lambda x: F.lower(F.trim(x)))
    good = F.filter(found, lambda x: (x != "") & ~x.rlike(tx.NO_EMAIL_HOST) & ~x.rlike(tx.NO_EMAIL_END) & (F.length(x) <= 80))
    return _in_order(_asked(page, order).withColumn("emails", good), "emails", 6)


def _phone(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\d+()\-.\s]", ""), r"\s+", " "))


def phones(page: DataFrame, order: str = "url") -> DataFrame:
    """(site, phones): numbers of tel links on the contact, about and home pages, four at most; a contact page without one
    gives the first number of nine digits or more in its text."""
    linked = F.filter(F.transform(F.filter(_hrefs(), lambda h: h.rlike(pt.TEL_LINK)), lambda h: _phone(F.substring(h, 5, 10000))), lambda x: x != "")
    said = _phone(F.regexp_extract(F.coalesce("text", F.lit("")), pt.PHONE_TEXT, 0))
    loose = F.when((F.col("role") == "contact") & (F.length(F.regexp_replace(said, r"\D", "")) >= 9), F.array(said)).otherwise(F.array().cast("array<string>"))
    return _in_order(_asked(page, order).withColumn("phones", F.when(F.size(linked) > 0, linked).otherwise(loose)), "phones", 4)


_ADDRESS = "address struct<streetAddress:string,addressLocality:string,addressRegion:string,postalCode:string,addressCountry:string>"


def addresses(page: DataFrame, order: str = "url") -> DataFrame:
    """(site, addresses): postal addresses of structured data, four at most; of a site without, the first street address in
    the text of its contact, about or home page."""
    parts = F.from_json(F.col("x"), _ADDRESS)["address"]
    told = page.withColumn("nth", F.col(order)).select("site", "nth", F.explode("json_ld").alias("x"))
    told = told.select("site", "nth", F.array_join(F.filter(F.array(*[F.trim(parts[k]) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")]), lambda v: v != ""), ", ").alias("a"))
    told = _in_order(told.where("a <> ''").withColumn("addresses", F.array("a")), "addresses", 4)
    line = F.trim(F.regexp_replace(F.regexp_extract(F.coalesce("text", F.lit("")), pt.US_ADDRESS, 0), r"\s+", " "))
    read = _in_order(_by_role(page, "contact", "about", "home", order=order).withColumn("addresses", F.filter(F.array(line), lambda x: x != "")), "addresses", 1)
    return told.unionAll(read.join(told.select("site"), "site", "left_anti"))


def state_of(address: Column) -> Column:
    """The two-letter state at the end of an address line, before a postal code and the country if there are; null without."""
    return F.nullif(F.regexp_extract(F.trim(address), pt.TRAILING_STATE, 1), F.lit(""))


def locality(page: DataFrame, order: str = "url") -> DataFrame:
    """(site, areas, hours, credentials): up to four service areas, opening hours (or that it is always open; empty if
    neither), and credentials claimed, from the texts of a site's pages in order."""
    text = profiles.corpus(page, 120_000, order)
    areas = F.transform(F.regexp_extract_all("text", F.lit(pt.SERVICE_AREA), F.lit(1)), lambda a: F.regexp_replace(F.regexp_replace(a, r"\s+", " "), "^[ ,&/]+|[ ,&/]+$", ""))
    areas = F.filter(areas, lambda a: (F.length(a) >= 3) & ~F.lower(a).isin("since", "you", "our", "the", "all", "we"))
    lows = F.transform(areas, lambda a: F.lower(a))
    first = F.filter(areas, lambda a, i: F.array_position(lows, F.lower(a)) == i + 1)
    hours = F.substring(F.trim(F.regexp_replace(F.regexp_extract("text", pt.HOURS, 0), r"\s+", " ")), 1, 120)
    hours = F.when(hours != "", hours).when(F.col("text").rlike(pt.ALWAYS_OPEN), "advertises 24/7 availability").otherwise("")
    return text.select("site", F.slice(first, 1, 4).alias("areas"), hours.alias("hours"), tx.matched_labels(F.col("text"), pt.CREDENTIALS + tx.COMPLIANCE).alias("credentials"))


def legal_pages(page: DataFrame, order: str = "url") -> DataFrame:
    """(site, label, url): legal and security pages by the first part of their title; of equal labels the last page."""
    label = F.trim(F.split_part(F.coalesce("title", F.lit("")), F.lit("|"), F.lit(1)))
    label = F.substring(F.when(label != "", label).otherwise(F.initcap("role")), 1, 60)
    return _by_role(page, "legal", "security", order=order).withColumn("label", label).groupBy("site", "label").agg(F.max_by("url", "nth").alias("url"))


def founded(page: DataFrame, order: str = "url") -> DataFrame:
    """(site, year, method): from structured data, else the first claim on an about page or the home page."""
    day = F.regexp_extract(F.get_json_object("x", "$.foundingDate"), r"(19\d{2}|20[0-2]\d)", 1)
    told = page.select("site", F.col(order).alias("o"), F.posexplode("json_ld").alias("i", "x")).withColumn("y", day).where("y <> ''").groupBy("site").agg(F.min_by("y", F.struct("o", "i")).alias("y"))
    said = _by_role(page, "about", "home", order=order).withColumn("y", F.regexp_extract(F.coalesce("text", F.lit("")), pt.FOUNDED, 1)).where("y <> ''").groupBy("site").agg(F.min_by("y", "nth").alias("y"))
    both = told.withColumn("method", F.lit("json-ld")).unionAll(said.join(told.select("site"), "site", "left_anti").withColumn("method", F.lit("regex")))
    return both.select("site", F.col("y").cast("int").alias("year"), "method")


def funding(page: DataFrame, order: str = "url") -> DataFrame:
    """(site, funding): phrases on the home and about pages that speak of money raised or owners changed, five at most."""
    said = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pt.FUNDING), F.lit(0)), lambda x: F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, 120))
    rows = _by_role(page, "home", "about", order=order).select("site", "nth", F.posexplode(said).alias("i", "x"))
    first = rows.groupBy("site", F.lower("x").alias("low")).agg(F.min(F.struct("nth", "i", "x")).alias("f"))
    return first.groupBy("site").agg(F.transform(F.slice(F.array_sort(F.collect_list("f")), 1, 5), lambda f: f["x"]).alias("funding"))


def headcount(text: Column) -> Column:
    """How many people a text says a company has; null without a claim. Things that are no people are not counted."""
    number = F.coalesce(F.nullif(F.regexp_extract(text, pt.HEADCOUNT, 1), F.lit("")), F.nullif(F.regexp_extract(text, pt.HEADCOUNT, 2), F.lit("")))
    n = F.replace(number, F.lit(","), F.lit("")).cast("int")
    return F.when((n > 0) & (n < 500_000), n)


def terms(texts: DataFrame) -> DataFrame:
    """texts (site, text) to (site, free_tier, trial, periods): whether a free plan is offered, the length of a trial in days
    (null without), and up to six billing periods as written, lower case, in order of the alphabet."""
    t = F.coalesce(F.col("text"), F.lit(""))
    periods = F.transform(F.regexp_extract_all(t, F.lit(pt.PERIOD), F.lit(0)), lambda x: F.lower(F.trim(x)))
    return texts.select("site", t.rlike(pt.FREE_TIER).alias("free_tier"), F.nullif(F.regexp_extract(t, pt.TRIAL, 1), F.lit("")).cast("int").alias("trial"), F.slice(F.array_sort(F.array_distinct(periods)), 1, 6).alias("periods"))


def industries(page: DataFrame, order: str = "url", most: int = 3) -> DataFrame:
    """(site, tags): industries whose keywords the home, about and product pages use twice or more, and at least 0.35 times
    as often as those of the strongest; most used first."""
    some = _by_role(page, "home", "about", "product", order=order)
    hits = F.filter(tx.industry_hits(F.lower("text")), lambda x: x["hits"] >= 2)
    top = F.coalesce(F.array_max(F.transform(hits, lambda x: x["hits"])), F.lit(0))
    listed = F.array_sort(F.transform(F.filter(hits, lambda x: x["hits"] >= 0.35 * top), lambda x, i: F.struct((-x["hits"]).alias("n"), i.alias("i"), x["label"].alias("label"))))
    return profiles.corpus(some, 40_000, "nth").select("site", F.transform(F.slice(listed, 1, most), lambda x: x["label"]).alias("tags"))


def thin(page: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(site, url, words, links, thin) after the columns in `keep`, one row for each page: whether it looks like a shell that
    scripts fill: few words or few links."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))
    return page.select(*keep, "site", "url", words.alias("words"), F.size("links").alias("links")).withColumn("thin", (F.col("words") < 250) | (F.col("links") < 15))
