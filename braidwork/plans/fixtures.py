"""Pages of two made-up companies, for queries whose matter the driver's tables do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import profiles, sites

_FOOT = '<footer><a href="https://linkedin.com/company/brightloom">LinkedIn</a> <a href="https://github.com/sponsors">Sponsors</a></footer>'
SITE_PAGES = [
    ("https://brightloom.com/", '<html><head><title>Brightloom | Looms you can program</title><script type="application/ld+json">{"@type": "Organization", "name": "Brightloom", "foundingDate": "2014-03-01", "address": {"@type": "PostalAddress", "streetAddress": "12 Spindle Row", "addressLocality": "Portland", "addressRegion": "OR", "postalCode": "97201"}}</script>'
     '<script src="https://plausible.io/js/script.js"></script></head><body><h1>Looms you can program</h1><p>Our team of 42 people builds looms. We are SOC 2 audited.</p>' + _FOOT + "</body></html>"),
    ("https://brightloom.com/pricing", "<html><title>Pricing</title><body><p>A free plan for makers, a 21-day free trial for mills.</p><p>$40 per month</p><p>$400 / year</p></body></html>"),
    ("https://brightloom.com/about", "<html><title>About</title><body><p>Started in 2012 in a shed. In spring we raised $4 million from people who weave. Before that there was a seed round.</p>" + _FOOT + "</body></html>"),
    ("https://brightloom.com/contact", '<html><title>Contact</title><body><a href="tel:+1 503 555 0100">Ring us</a> <a href="MAILTO:Hello@brightloom.com?subject=hi">Write</a><p>press@brightloom.com or logo@example.com or icon@2x.png</p><a href="https://github.com/brightloom">Code</a>' + _FOOT + "</body></html>"),
    ("https://brightloom.com/privacy", "<html><title>Privacy at Brightloom | Brightloom</title><body><p>What we keep.</p></body></html>"),
    ("https://brightloom.com/terms", "<html><title>Terms</title><body><p>What we agree.</p></body></html>"),
    ("https://oakpipe.com/", "<html><title>Oakpipe Plumbing</title><body><h1>Oakpipe Plumbing</h1><p>A family of four shops, family owned since 1987. Proudly serving Franklin and Delaware County.</p><p>Licensed and insured.</p><p>Mon - Sat 7 am to 6 pm</p></body></html>"),
    ("https://oakpipe.com/contact", "<html><title>Contact us</title><body><p>410 Miller Creek Road, Dublin, OH 43016</p><p>Call (614) 555-0177</p><p>office@oakpipe.com</p></body></html>"),
]


def site_pages(spark: SparkSession) -> DataFrame:
    return profiles.with_role(sites.parsed(spark.createDataFrame(SITE_PAGES, "url string, html string")))
