"""Where else a site's pages may be: conventional and platform paths, indexes above linked pages, sitemaps; and what a host
allows. Inputs are tables of what was read; nothing here fetches."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import urls

# Paths tried for each role on any site, best first.
CONVENTIONAL = {
    "pricing": ["/pricing", "/plans", "/pricing/"],
    "about": ["/about", "/about-us", "/company"],
    "product": ["/product", "/features", "/services"],
    "team": ["/team", "/about/team", "/leadership"],
    "customers": ["/customers", "/case-studies", "/clients"],
    "careers": ["/careers", "/jobs", "/careers/"],
    "contact": ["/contact", "/contact-us"],
    "blog": ["/blog", "/news", "/blog/"],
    "security": ["/security", "/trust"],
    "legal": ["/privacy", "/terms", "/privacy-policy", "/terms-of-service", "/policies/privacy-policy", "/pages/privacy-policy", "/legal"],
}
# Paths that hosted platforms use.
PLATFORM = {
    "Shopify": {
        "legal": ["/pages/privacy-policy", "/pages/terms-of-service", "/pages/terms-of-use", "/policies/privacy-policy", "/policies/terms-of-service"],
        "about": ["/pages/about", "/pages/about-us", "/pages/our-story"],
        "contact": ["/pages/contact", "/pages/contact-us"],
        "careers": ["/pages/careers"],
        "blog": ["/blogs/news"],
    },
    "WordPress": {"legal": ["/privacy-policy", "/terms-of-service", "/terms-and-conditions"], "about": ["/about-us"], "contact": ["/contact-us"]},
    "WooCommerce": {"legal": ["/privacy-policy", "/terms-and-conditions"]},
    "Squarespace": {"legal": ["/privacy", "/terms"], "about": ["/about"]},
    "Webflow": {"legal": ["/privacy-policy", "/terms-of-service"]},
    "Ghost": {"legal": ["/privacy", "/terms"], "about": ["/about"]},
}
# Sitemaps followed from one site, pages taken from them, and sitemaps that robots.txt may name.
SITEMAPS, LISTED, ROOTS = 5, 600, 3


def _paths() -> Column:
    """array<struct<platform, role, path, score>>, platform null for paths tried anywhere: a bounded table in the plan."""
    rows = [(None, role, p, 0.2 - i * 0.01) for role, paths in CONVENTIONAL.items() for i, p in enumerate(paths)]
    rows += [(name, role, p, 1.0 - i * 0.01) for name, roles in PLATFORM.items() for role, paths in roles.items() for i, p in enumerate(paths)]
    return F.array(*[F.struct(F.lit(n).cast("string").alias("platform"), F.lit(r).alias("role"), F.lit(p).alias("path"), F.lit(round(s, 2)).alias("score")) for n, r, p, s in rows])


def guesses(homes: DataFrame) -> DataFrame:
    """homes (site, url, platforms array) to (site, role, url, score, linked): pages that may be there, none of them linked.
    Paths of a detected platform score about 1, conventional ones 0.2 at most; of one role and URL the best score stays."""
    offered = F.filter(_paths(), lambda p: p["platform"].isNull() | F.array_contains(F.coalesce("platforms", F.array().cast("array<string>")), p["platform"]))
    origin = F.regexp_extract("url", r"^(?i:https?)://[^/?#]*", 0)
    rows = homes.where(origin != "").select("site", F.col("url").alias("home"), origin.alias("origin"), F.inline(offered))
    rows = rows.withColumn("url", urls.clean_url(F.concat("origin", "path"))).where("url <> home")
    return rows.groupBy("site", "role", "url").agg(F.max("score").alias("score")).withColumn("linked", F.lit(False))


def index_guesses(found: DataFrame) -> DataFrame:
    """found (site, url, text) to (site, role, url, score, linked): folders above a link that are of its role by their own
    path, with and without the closing slash, at a tenth less than the folder's score."""
    best = urls.with_best_role(found.where(~urls.localised(F.col("url"))), F.col("url"), F.col("text")).select("site", "url", "role")
    steps = F.filter(F.split(urls.path_of(F.col("url")), "/"), lambda s: s != "")
    stems = best.withColumn("steps", steps).where(F.size("steps") > 1).select("site", F.col("role").alias("wanted"), F.regexp_extract("url", r"^[^/]*//[^/?#]*", 0).alias("origin"), F.explode(F.sequence(F.lit(1), F.size("steps") - 1)).alias("depth"), "steps")
    stems = stems.select("site", "wanted", F.concat("origin", F.lit("/"), F.array_join(F.slice("steps", 1, F.col("depth")), "/")).alias("stem")).distinct()
    own = urls.with_best_role(stems.withColumn("folder", F.concat("stem", F.lit("/"))), F.col("folder"), F.lit("")).where("role = wanted")
    rows = own.select("site", "role", F.explode(F.array("folder", "stem")).alias("url"), F.round(F.col("score") - 0.1, 2).alias("score"))
    return rows.groupBy("site", "role", "url").agg(F.max("score").alias("score")).withColumn("linked", F.lit(False))


def _locations(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))


def sitemap_pages(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files (site, url, body) that were read and roots (site, place, url) of sitemaps, named by robots.txt or at the usual
    place, to (site, place, url): pages they list, in order, at most LISTED of a site.

    Only the site's own sitemaps are followed, ROOTS of them and one level of those that an index names, SITEMAPS in all.
    Addresses of other hosts and of no pages are left out; a page that is listed twice is listed once, at its first place.
    """
    own = roots.where(urls.same_site(F.col("url"), F.col("site")))
    first = own.withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy("place"))).where(F.col("nth") <= ROOTS).select("site", "url", "nth")
    index = F.instr(F.lower(F.substring("body", 1, 2000)), "<sitemapindex") > 0
    body = files.select("site", "url", index.alias("index"), _locations(F.col("body")).alias("locs"))
    read = first.join(body, ["site", "url"])

    def listed(rows: DataFrame) -> DataFrame:
        every = rows.select("site", "nth", F.posexplode("locs").alias("i", "loc")).withColumn("url", urls.clean_url(F.col("loc")))
        return every.where(F.col("url").isNotNull() & urls.same_site(F.col("url"), F.col("site"))).select("site", "nth", "i", "url")

    heads = first.groupBy("site").agg(F.count("*").alias("heads"))
    named = listed(read.where("index")).groupBy("site", "url").agg(F.min(F.struct("nth", "i")).alias("at")).join(first.select("site", "url"), ["site", "url"], "left_anti")
    named = named.join(heads, "site").withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy("at")) + F.col("heads"))
    deeper = named.where(F.col("nth") <= SITEMAPS).select("site", "url", "nth").join(body, ["site", "url"]).where("NOT index")
    pages = listed(read.where("NOT index").unionByName(deeper)).where(~urls.skipped(F.col("url")))
    pages = pages.groupBy("site", "url").agg(F.min(F.struct("nth", "i")).alias("at"))
    return pages.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("at"))).where(F.col("place") <= LISTED).select("site", "place", "url")


def client_rendered(homes: DataFrame) -> DataFrame:
    """homes (site, n_links, words): adds `client_rendered`: few links in the markup under a long text."""
    return homes.withColumn("client_rendered", (F.col("n_links") < 12) & (F.col("words") > 400))


def robots(rules: DataFrame, agent: str, delay: float = 1.0, most: float = 15.0) -> DataFrame:
    """rules (robots, url) to the same with `allowed` and `delay`: whether the agent may read the URL, and the seconds to wait
    between two requests: the longest that the file asks for, up to `most`, but no less than the default. A null file allows
    everything. A file is parsed once for each batch that needs it."""

    @F.pandas_udf("allowed boolean, asked double")
    def judge(text: pd.Series, url: pd.Series) -> pd.DataFrame:
        held: dict = {}

        def one(t, u):
            if t is None:
                return True, None
            if t not in held:
                parser = RobotFileParser()
                parser.parse(t.splitlines())
                rate, wait = parser.request_rate(agent), parser.crawl_delay(agent)
                asked = [float(wait)] if wait else []
                asked += [rate.seconds / rate.requests] if rate and rate.requests else []
                held[t] = parser, max(asked, default=None)
            return held[t][0].can_fetch(agent, u or ""), held[t][1]

        return pd.DataFrame([one(t, u) for t, u in zip(text, url, strict=True)], columns=["allowed", "asked"])

    told = rules.withColumn("__j", judge("robots", "url"))
    asked = F.col("__j.asked")
    return told.withColumn("allowed", F.col("__j.allowed")).withColumn("delay", F.when(asked > delay, F.least(asked, F.lit(most))).otherwise(F.lit(delay))).drop("__j")


@F.pandas_udf(T.StringType())
def decode(raw: pd.Series, content_type: pd.Series) -> pd.Series:
    """Bytes of a page as text: a byte-order mark decides, then the header if it names a charset, then a declaration in the
    first 4096 bytes, else UTF-8; unknown charsets are read as UTF-8. Null bytes: null."""
    import re

    said = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([\w.:-]+)""", re.I)
    header = re.compile(r"""charset=\s*["']?([\w.:-]+)""", re.I)

    def one(b, kind):
        if b is None:
            return None
        b = bytes(b)
        if b[:3] == b"\xef\xbb\xbf":
            return b[3:].decode("utf-8", "replace")
        name = header.search(kind or "")
        inside = None if name else said.search(b[:4096])
        charset = name.group(1) if name else inside.group(1).decode("ascii", "ignore") if inside else "utf-8"
        try:
            return b.decode(charset, "replace")
        except LookupError:
            return b.decode("utf-8", "replace")

    return pd.Series([one(b, k) for b, k in zip(raw, content_type, strict=True)], dtype=object)
