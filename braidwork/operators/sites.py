"""Pages grouped by site: roles, link candidates, a plan of pages, and facts rolled up for scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import urls
from ..functions.page import parse_page

# Roles of which a second page adds something.
MULTI = ("legal", "product", "careers", "customers")


def parsed(pages: DataFrame, url: str = "url", markup: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """pages with site, url, the columns in `keep`, and what one pass over the markup gives; the kernel runs once for each page."""
    page = pages.select(*keep, urls.host_of(F.col(url)).alias("site"), F.col(url).alias("url"), F.col(markup).alias("html"), parse_page(F.col(markup)).alias("p"))
    return page.select(*keep, "site", "url", "html", "p.*").withColumn("words", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")))


def links(page: DataFrame) -> DataFrame:
    """(site, url, text): same-site links of pages, absolute and clean, each target once for a site with its first text."""
    raw = page.select("site", F.col("url").alias("source"), F.posexplode("links").alias("place", "l")).where(~F.col("l.href").rlike(r"(?i)^(#|mailto:|tel:|javascript:|$)"))
    target = urls.clean_url(urls.resolve(F.col("source"), F.col("l.href")))
    rows = raw.select("site", "source", "place", target.alias("url"), F.col("l.text").alias("text")).where(F.col("url").isNotNull() & urls.same_site(F.col("url"), F.col("site")) & ~urls.skipped(F.col("url")))
    return rows.groupBy("site", "url").agg(F.min_by("text", F.struct("source", "place")).alias("text"))


def candidates(found: DataFrame, read: DataFrame | None = None, keep: int = 4, keep_legal: int = 6, guessed: DataFrame | None = None) -> DataFrame:
    """(site, role, url, score, linked, rank): links by role, best first, then those the site itself has (`linked`; without
    that column all are) before guesses, then the shortest; without localised copies and pages already read. `guessed` holds rows as `discovery` gives them."""
    found = found if "linked" in found.columns else found.withColumn("linked", F.lit(True))
    scored = urls.with_best_role(found.where(~urls.localised(F.col("url"))), F.col("url"), F.col("text"))
    place = F.array_position(F.array(*[F.lit(r) for r, _, _ in urls.ROLE_RULES]), F.col("role"))
    best = scored.groupBy("site", "url").agg(F.max(F.struct("score", (-place).alias("p"), "role")).alias("r"), F.max("linked").alias("linked")).select("site", "url", "r.role", "r.score", "linked")
    if guessed is not None:
        every = best.unionByName(guessed.select("site", "url", "role", "score", "linked"))
        best = every.groupBy("site", "url", "role").agg(F.max("score").alias("score"), F.max("linked").alias("linked"))
    if read is not None:
        best = best.join(read.select("site", "url"), ["site", "url"], "left_anti")
    w = Window.partitionBy("site", "role").orderBy(F.desc("score"), F.desc("linked"), F.length("url"), "url")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.when(F.col("role") == "legal", keep_legal).otherwise(keep))


def plan(ranked: DataFrame, budget: int = 20) -> DataFrame:
    """The pages of a site to read, role by role in the order of the rules: one for each role, two for roles where a second
    adds something, all in all one less than the budget, as the home page takes one."""
    chosen = ranked.where(F.col("rank") <= F.when(F.col("role").isin(*MULTI), 2).otherwise(1))
    order = F.array_position(F.array(*[F.lit(r) for r, _, _ in urls.ROLE_RULES]), F.col("role"))
    w = Window.partitionBy("site").orderBy(order, "rank")
    return chosen.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(1, budget - 1))


def cadence(dated: DataFrame, today, window_days: int = 365) -> DataFrame:
    """dated (site, day): newest day, its age, and posts a month within the window (a single post counts over all of it)."""
    now = F.lit(today).cast("date")
    recent = F.datediff(now, F.col("day")) <= window_days
    rows = dated.where(F.col("day") <= now).groupBy("site").agg(F.max("day").alias("newest"), F.count_if(recent).alias("n"), F.min(F.when(recent, F.col("day"))).alias("first"))
    span = F.when(F.col("n") > 1, F.greatest(F.datediff("newest", "first"), F.lit(28))).otherwise(window_days)
    return rows.select("site", "newest", F.datediff(now, F.col("newest")).alias("age_days"), F.col("n").alias("recent"), F.when(F.col("n") > 0, F.round(F.col("n") / (span / 30.44), 1)).alias("posts_per_month"))


def facts(page: DataFrame, today) -> DataFrame:
    """What pages alone tell of a site, one row each, for scoring."""
    role = urls.classify(F.col("url"), F.lit(""))["role"]
    seen = page.withColumn("role", role).withColumn("days", tx.dates(F.col("text"), F.lit(today).cast("date"))).withColumn("mails", tx.emails(F.col("text"))).withColumn("claims", tx.matched_labels(F.col("text"), tx.COMPLIANCE))
    flat = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    now = F.lit(today).cast("date")
    return seen.groupBy("site").agg(
        flat("mails").alias("emails"), flat("claims").alias("compliance"), F.countDistinct("role").alias("key_roles"), F.count_if(F.col("role") == "legal").alias("legal_pages"), F.sum("words").cast("int").alias("words"),
        F.max(F.when(urls.path_of(F.col("url")) == "/", F.col("words")).otherwise(0)).alias("home_words"), F.datediff(now, F.max(F.array_max("days"))).alias("last_content_age"),
        (F.year(now) - F.max(tx.copyright_year(F.col("html")))).alias("copyright_age"),
    )
