"""Features of text as column expressions: keywords, dates, amounts, addresses, and pattern dictionaries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an e-mail address is, whose addresses are no company's, how a copyright line reads.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]{2,}"
NO_EMAIL_HOST = r"(?i)@(example|sentry|wixpress|squarespace|godaddy|domain)\b"
NO_EMAIL_END = r"(?i)\.(png|jpe?g|gif|svg|webp|css|js)$"
COPYRIGHT = r"(?i)(?:©|&copy;|copyright)\s*(?:\d{4}\s*[–\-—]\s*)?(20\d{2})"
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"

# Words by which an industry is told.
INDUSTRIES = [
    ("SaaS / software", ["saas", "software platform", "cloud platform", "web app", "our software"]),
    ("Developer tools", ["api", "sdk", "developer", "open source", "ci/cd", "devops", "self-host"]),
    ("E-commerce / retail", ["free shipping", "add to cart", "shop now", "our store", "returns policy", "shop all", "your cart", "in stock", "sold out", "size guide", "checkout"]),
    ("Marketing / advertising", ["marketing", "advertising", "campaign", "seo", "brand strategy"]),
    ("Fintech / payments", ["payments", "fintech", "banking", "invoicing", "payouts", "lending"]),
    ("Healthcare", ["patient", "clinical", "healthcare", "hipaa", "telehealth", "medical"]),
    ("Education", ["students", "curriculum", "courses", "learning platform", "classroom"]),
    ("Professional services", ["consulting", "our clients", "engagement", "advisory", "we partner with"]),
    ("Agency", ["agency", "creative studio", "we design", "branding", "our portfolio"]),
    ("Real estate", ["property", "listings", "real estate", "tenants", "leasing"]),
    ("Logistics", ["shipping", "freight", "supply chain", "warehouse", "fulfilment", "fulfillment"]),
    ("Manufacturing", ["manufacturing", "factory", "production line", "oem", "industrial"]),
    ("Hospitality / food", ["restaurant", "menu", "reservations", "hotel", "guests", "catering"]),
    ("Analytics / data", ["analytics", "dashboards", "data warehouse", "business intelligence", "metrics"]),
    ("Security", ["cybersecurity", "threat", "vulnerability", "endpoint", "zero trust"]),
    ("AI / ML", ["machine learning", "artificial intelligence", " llm", "neural", "ai-powered"]),
    ("Nonprofit", ["donate", "nonprofit", "501(c)(3)", "our mission is to", "charity"]),
]
# Compliance claims.
COMPLIANCE = [
    ("SOC 2", r"\bsoc\s?-?\s?2\b"), ("ISO 27001", r"\biso[\s/-]?27001\b"), ("GDPR", r"\bgdpr\b"), ("HIPAA", r"\bhipaa\b"), ("PCI DSS", r"\bpci[\s-]?dss\b"),
    ("CCPA", r"\bccpa\b"), ("FedRAMP", r"\bfedramp\b"), ("Cyber Essentials", r"\bcyber essentials\b"), ("ISO 9001", r"\biso[\s/-]?9001\b"),
]
# Links to accounts.
SOCIALS = [
    ("LinkedIn", r"linkedin\.com/(company|in|school)/[\w\-%.]+"), ("X / Twitter", r"(?<![\w.])(?:twitter|x)\.com/[\w]{2,20}"), ("Facebook", r"facebook\.com/[\w\-.]{2,50}"),
    ("Instagram", r"instagram\.com/[\w\-.]{2,40}"), ("YouTube", r"youtube\.com/(@[\w\-.]+|c/[\w\-.]+|channel/[\w\-]+|user/[\w\-.]+)"), ("GitHub", r"github\.com/[\w\-.]{2,40}"),
    ("TikTok", r"tiktok\.com/@[\w\-.]{2,40}"), ("Crunchbase", r"crunchbase\.com/organization/[\w\-]+"), ("Discord", r"discord\.(gg|com/invite)/[\w\-]+"),
    ("Mastodon", r"[\w.]+/@[\w]+@[\w.]+"), ("Bluesky", r"bsky\.app/profile/[\w\-.]+"),
]


def keyword_pattern(word: str) -> str:
    """A whole-word, case-blind pattern; a border only where the keyword has a letter or digit."""
    special = re.sub(r"([^\w ])", r"\\\1", word)
    return "(?i)" + (r"\b" if word[:1].isalnum() else "") + special + (r"\b" if word[-1:].isalnum() else "")


def keyword_count(text: Column, word: str) -> Column:
    return F.regexp_count(text, F.lit(keyword_pattern(word)))


def industry_hits(text: Column) -> Column:
    """array<struct<label, hits>>; one alternation for each industry, so that a text is read once for each label."""
    return F.array(*[F.struct(F.lit(label).alias("label"), sum((keyword_count(text, w) for w in words[1:]), keyword_count(text, words[0])).alias("hits")) for label, words in INDUSTRIES])


def emails(text: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda x: F.lower(F.rtrim(x, F.lit("."))))), lambda x: ~x.rlike(NO_EMAIL_HOST) & ~x.rlike(NO_EMAIL_END) & (F.length(x) <= 80))


def copyright_year(text: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(F.right(text, F.lit(4000)), F.lit(COPYRIGHT), F.lit(1)), lambda x: x.cast("int")))


def dates(text: Column, today: Column) -> Column:
    """Valid dates from 2000 to today in the order of the patterns: all ISO ones, then month first, then day first."""
    iso = F.regexp_extract_all(text, F.lit(r"\b(20\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))\b"), F.lit(1))
    parts = lambda p, i: F.regexp_extract_all(text, F.lit(p), F.lit(i))
    first, day = rf"(?i)\b{_MONTH}[a-z]*\.?\s+(\d{{1,2}}),?\s+(20\d{{2}})\b", rf"(?i)\b(\d{{1,2}})\s+{_MONTH}[a-z]*\.?,?\s+(20\d{{2}})\b"
    months = F.lit("janfebmaraprmayjunjulaugsepoctnovdec")
    number = lambda m: F.lpad(((F.instr(months, F.lower(m)) + 2) / 3).cast("int").cast("string"), 2, "0")

    def joined(p, y, m, d):
        return F.transform(F.arrays_zip(parts(p, y).alias("y"), parts(p, m).alias("m"), parts(p, d).alias("d")), lambda x: F.concat_ws("-", x["y"], number(x["m"]), F.lpad(x["d"], 2, "0")))

    every = F.transform(F.concat(iso, joined(first, 3, 1, 2), joined(day, 3, 2, 1)), lambda x: F.try_to_date(x, "yyyy-MM-dd"))
    return F.filter(every, lambda x: x.isNotNull() & (x <= today) & (F.year(x) >= 2000))


def amount(text: Column) -> Column:
    """A price under either separator convention: one or two digits after a last comma or point are decimals."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), " ", "")
    decimals = F.regexp_extract(s, r"[.,](\d{1,2})$", 1)
    digits = F.regexp_replace(F.when(decimals != "", F.regexp_replace(s, r"[.,]\d{1,2}$", "")).otherwise(s), r"\D", "")
    return F.when(decimals != "", F.concat(F.when(digits == "", "0").otherwise(digits), F.lit("."), decimals).cast("double")).when(digits != "", digits.cast("double"))


def matched_labels(text: Column, table: list[tuple[str, str]]) -> Column:
    """Labels whose pattern the text matches, in the table's order."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), label) for label, p in table]))


def retry_after(header: Column, attempt: Column, now: Column, most: float = 30.0) -> Column:
    """Seconds to wait: a number or an HTTP date, between 0 and `most`; otherwise two to the power of the attempt."""
    seconds = F.trim(header).try_cast("double")
    when = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract(header, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))) - F.unix_timestamp(now)
    asked = F.coalesce(seconds, when.cast("double"))
    return F.when(asked.isNotNull(), F.greatest(F.lit(0.0), F.least(asked, F.lit(most)))).otherwise(F.pow(F.lit(2.0), attempt))
