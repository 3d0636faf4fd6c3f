"""URLs: hosts, cleaning, what to skip, page roles. Column expressions only, but for the resolution of relative links."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Page roles in order of priority, with the patterns of their paths and of the text of links to them.
ROLE_RULES = [
    ("pricing", r"/(pricing|plans?|price|packages|subscribe|buy|quote)(/|$|\.)", r"^\s*(pricing|plans|price|packages|buy now|get a quote)\s*$"),
    ("about", r"/(about|about-us|company|our-story|who-we-are|mission|overview)(/|$|\.)", r"^\s*(about|about us|our story|company|who we are|our mission)\s*$"),
    ("product", r"/(products?|features?|solutions?|platform|services?|what-we-do|how-it-works)(/|$|\.)", r"^\s*(product|products|features|solutions|platform|services|how it works)\s*$"),
    ("team", r"/(team|our-team|leadership|people|management|founders|staff|about/team)(/|$|\.)", r"^\s*(team|our team|leadership|meet the team|people|founders|management)\s*$"),
    ("customers", r"/(customers?|clients?|case-stud(y|ies)|testimonials?|success-stories|portfolio|work)(/|$|\.)", r"^\s*(customers|clients|case studies|testimonials|success stories|our work|portfolio)\s*$"),
    ("careers", r"/(careers?|jobs?|join-?us|work-with-us|hiring|open-positions|vacancies|opportunities)(/|$|\.)", r"^\s*(careers|jobs|join us|we're hiring|were hiring|work with us|open roles|open positions)\s*$"),
    ("contact", r"/(contact|contact-us|get-in-touch|reach-us|support|help)(/|$|\.)", r"^\s*(contact|contact us|get in touch|support|help)\s*$"),
    ("blog", r"/(blog|news|articles?|insights?|press|updates?|resources?|stories|changelog|newsroom)(/|$|\.)", r"^\s*(blog|news|articles|insights|press|resources|updates|newsroom|changelog)\s*$"),
    ("security", r"/(security|trust|compliance|soc-?2|gdpr|privacy-and-security)(/|$|\.)", r"^\s*(security|trust|trust center|compliance)\s*$"),
    ("legal", r"/(privacy|terms|legal|tos|eula|cookie|imprint|impressum|disclaimer)(/|$|\.|-)", r"^\s*(privacy|privacy policy|terms|terms of service|terms & conditions|legal|imprint|cookie policy)\s*$"),
]
# Paths that are no pages, and letters at a path's start that are no language.
SKIP_PATH = r"(?i)(/(login|log-in|signin|sign-in|signup|sign-up|register|cart|checkout|account|admin|search|feed|rss|sitemap|wp-admin|wp-login|api|cdn-cgi)(/|$|\?))|\.(pdf|jpe?g|png|gif|svg|webp|zip|gz|mp4|mp3|css|js|ico|woff2?|xml|json|dmg|exe|pkg)($|\?)"
NOT_LOCALES = ["js", "io", "co", "ai", "app", "dev", "me", "tv", "in", "it", "de", "us"]
TRACKING = r"(?i)^(utm_|gclid=|fbclid=|mc_cid=|mc_eid=)"

_URL = r"^(?i:(https?)://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, i)


def host_of(raw: Column) -> Column:
    """Lower-case host of a URL or bare domain, without user and port; null if there is none."""
    s = F.trim(raw)
    whole = F.when(F.instr(s, "://") > 0, s).otherwise(F.concat(F.lit("https://"), s))
    host = F.lower(F.regexp_extract(whole, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(F.length(host) > 0, F.regexp_replace(host, r"\.$", ""))


def path_of(url: Column) -> Column:
    p = _part(url, 3)
    return F.when(p == "", F.lit("/")).otherwise(p)


def same_site(url: Column, domain: Column) -> Column:
    host, bare = host_of(url), F.regexp_replace(F.lower(domain), r"^www\.", "")
    return (host == F.lower(domain)) | (host == bare) | F.endswith(host, F.concat(F.lit("."), bare))


def clean_url(url: Column) -> Column:
    """http(s) only; fragment and tracking parameters dropped; an empty path is a slash; null otherwise."""
    kept = F.array_join(F.filter(F.split(_part(url, 4), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    out = F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), path_of(url), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when((_part(url, 1) != "") & (_part(url, 2) != ""), out)


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link of a page as an absolute URL."""

    def one(b, x):
        try:
            return urljoin(b or "", x or "")
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def skipped(url: Column) -> Column:
    return path_of(url).rlike(SKIP_PATH)


def localised(url: Column) -> Column:
    code = F.lower(F.regexp_extract(path_of(url), r"^/([A-Za-z]{2}(?:-[A-Za-z]{2})?)/", 1))
    return (code != "") & ~code.isin(NOT_LOCALES)


def refused_host(host: Column) -> Column:
    """Hosts that are the machine itself or a private network, by their literal address."""
    return F.coalesce(host, F.lit("")).rlike(r"^(localhost|.*\.local|.*\.internal|127\..*|0\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\..*|\[.*|::1)$")


def role_scores(url: Column, anchor: Column) -> Column:
    """array<struct<score, rank, role>>: 3 for the path, less 0.4 for each level below the first, 2 for the link's text."""
    path, text = path_of(url), F.lower(F.trim(F.regexp_replace(F.coalesce(anchor, F.lit("")), r"\s+", " ")))
    depth = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    out = []
    for i, (role, url_pattern, text_pattern) in enumerate(ROLE_RULES):
        s = F.when(path.rlike("(?i)" + url_pattern), 3.0 - 0.4 * F.least(depth - 1, F.lit(3))).otherwise(0.0)
        s = s + F.when((text != "") & text.rlike("(?i)" + text_pattern), 2.0).when((text != "") & text.contains(role), 0.5).otherwise(0.0)
        out.append(F.struct(F.round(s, 2).alias("score"), F.lit(-i).alias("rank"), F.lit(role).alias("role")))
    return F.array(*out)


def _winner(url: Column, anchor: Column) -> Column:
    """The best role as an array of one, without any an empty array; the scores stand in the expression once."""
    return F.filter(F.array(F.array_max(role_scores(url, anchor))), lambda best: best["score"] > 0)


def classify(url: Column, anchor: Column) -> Column:
    """The best role and its score; the first in order of priority among equals; null without any."""
    return F.get(_winner(url, anchor), F.lit(0))


def with_best_role(df: DataFrame, url: Column, anchor: Column) -> DataFrame:
    """Rows that have a role, with `role` and `score`. A generator, so that neither the test for a role nor the reading of its
    two fields repeats the patterns."""
    return df.select("*", F.inline(_winner(url, anchor)).alias("score", "__rank", "role")).drop("__rank")
