"""Matching companies to public carrier records, conservatively."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Words that say nothing of which company it is.
NAME_NOISE = ["llc", "l l c", "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "lp", "llp", "pllc", "plc", "the", "and", "of", "a", "dba", "enterprises", "enterprise", "group", "holdings"]
# Words of a trade, which alone are no name.
GENERIC = ["trucking", "transport", "transportation", "logistics", "hauling", "moving", "movers", "freight", "express", "carrier", "carriers", "delivery", "courier", "services", "service", "solutions", "systems", "industries", "contracting", "construction", "plumbing", "heating", "cooling", "landscaping", "roofing", "electric", "electrical", "cleaning", "maintenance", "repair"]
MIN_NAME, MIN_TOTAL, MIN_MARGIN = 0.62, 0.70, 0.06


def normalised_name(name: Column) -> Column:
    """Lower case, dotted abbreviations closed up, no punctuation, legal forms or single letters."""
    s = F.lower(F.coalesce(name, F.lit("")))
    s = F.regexp_replace(s, r"(?<=\b[a-z])\.(?=[a-z]\.)", "")
    s = F.regexp_replace(s, r"(?<=\b[a-z]{2,9})\.(?=\W|$)", "")
    words = F.split(F.regexp_replace(s, r"[^a-z0-9 ]+", " "), " +")
    return F.array_join(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(NAME_NOISE)), " ")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def name_similarity(a: Column, b: Column, ratio: Column | None = None) -> Column:
    """0 for empty or generic names, 1 for equal ones; at least 0.85 if one's words hold the other's; else the smaller of
    the sequence ratio and the words' Jaccard similarity plus a quarter."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    lone = lambda t, s: (F.size(t) == 1) & s.isin(GENERIC)
    j = token_jaccard(a, b)
    inside = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    long = F.least(F.length(a), F.length(b)) >= 4
    return F.when((a == "") | (b == "") | lone(x, a) | lone(y, b), 0.0).when(a == b, 1.0).when(inside & long, F.greatest(F.lit(0.85), j)).otherwise(F.least(sequence_ratio(a, b) if ratio is None else ratio, j + 0.25))


def match_carriers(companies: DataFrame, candidates: DataFrame) -> DataFrame:
    """companies (company, name, state) and candidates (company, usdot, legal_name, dba_name, state) to one row for each
    company: the best candidate, its score, and why it is refused, if it is. If companies have a city and candidates a
    physical_address, an address that names the city adds a tenth."""
    c = candidates.withColumnRenamed("state", "carrier_state")
    both = companies.join(c, "company", "left").withColumns({k: normalised_name(F.col(v)) for k, v in (("n", "name"), ("l", "legal_name"), ("d", "dba_name"))})
    named = F.greatest(name_similarity(F.col("n"), F.col("l")), name_similarity(F.col("n"), F.col("d")))
    s, t = F.upper(F.coalesce("state", F.lit(""))), F.upper(F.coalesce("carrier_state", F.lit("")))
    town = F.lower(F.coalesce("city", F.lit(""))) if "city" in companies.columns else F.lit("")
    address = F.lower(F.coalesce("physical_address", F.lit(""))) if "physical_address" in candidates.columns else F.lit("")
    near = F.when((town != "") & F.contains(address, town), 0.1).otherwise(0.0)
    both = both.withColumn("named", named).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("named") * 0.8 + F.when((s == "") | (t == ""), 0.0).when(s == t, 0.15).otherwise(-0.25) + near)))
    w = Window.partitionBy("company").orderBy(F.desc("score"), "usdot")
    best = both.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("rank = 1")
    why = (
        F.when(F.col("usdot").isNull(), "no record found").when(F.col("named") < MIN_NAME, "name too different").when(F.col("score") < MIN_TOTAL, "not sure enough").when(F.col("score") - F.coalesce("second", F.lit(-1.0)) < MIN_MARGIN, "two candidates too close")
    )
    return best.select("company", F.when(why.isNull(), F.col("usdot")).alias("usdot"), F.round("score", 4).alias("score"), why.alias("refused"))


# Labels of a carrier's record, and the evidence fields made of it with how sure each is.
RECORD = {
    "usdot": "USDOT Number", "legal_name": "Legal Name", "dba_name": "DBA Name", "entity_type": "Entity Type", "operating_status": "USDOT Status",
    "operating_authority": "Operating Authority Status", "out_of_service_date": "Out of Service Date", "power_units": "Power Units", "drivers": "Drivers",
    "inspections": "Inspections", "crashes": "Crashes", "out_of_service_pct": "Out of Service %", "physical_address": "Physical Address", "phone": "Phone",
    "mcs150_date": "MCS-150 Form Date", "mcs150_mileage": "MCS-150 Mileage (Year)", "operation_classification": "Operation Classification", "cargo_carried": "Cargo Carried",
}
EVIDENCE = [
    ("power_units", 0.95), ("drivers", 0.95), ("operating_status", 0.95), ("operating_authority", 0.95), ("out_of_service_date", 0.95), ("inspections", 0.9), ("crashes", 0.9),
    ("out_of_service_pct", 0.9), ("entity_type", 0.95), ("physical_address", 0.9), ("phone", 0.9), ("mcs150_date", 0.9), ("cargo_carried", 0.85),
]


def _cell(x: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), "&nbsp;|&#160;", " ")
    return F.trim(F.regexp_replace(F.replace(plain, F.lit("&amp;"), F.lit("&")), r"[\s ]+", " "))


def records(pages: DataFrame) -> DataFrame:
    """pages (usdot, url, html) of carrier snapshots to typed records, one each: labelled cells of its tables, the first of
    equal labels; counts as digits, dates as month/day/year, "None" as empty. Pages with neither a name nor a number: none.
    A carrier is active if its status is just that and it is not out of service."""
    head, value = r"(?is)<th\b[^>]*>(.*?)</th>\s*<td\b[^>]*>(.*?)</td>", "html"
    labels = F.transform(F.regexp_extract_all(value, F.lit(head), F.lit(1)), lambda x: F.rtrim(F.regexp_replace(_cell(x), ":+$", "")))
    values = F.transform(F.regexp_extract_all(value, F.lit(head), F.lit(2)), _cell)
    read = pages.select("usdot", "url", labels.alias("labels"), values.alias("values"))
    field = lambda label: F.when(F.array_contains("labels", label), F.element_at("values", F.array_position("labels", label).cast("int"))).otherwise("")
    out = read.select("url", F.col("usdot").alias("asked"), *[field(label).alias(c) for c, label in RECORD.items()]).where("legal_name <> '' OR usdot <> ''")
    digits = lambda c: F.nullif(F.regexp_replace(F.col(c), r"\D", ""), F.lit("")).cast("int")
    out = out.withColumns({c: digits(c) for c in ("power_units", "drivers", "inspections", "crashes")})
    bare = F.trim(F.col("out_of_service_date"), F.lit(" -"))
    out = out.withColumns({
        "usdot": F.coalesce(F.nullif(F.col("usdot"), F.lit("")), F.col("asked")), "operating_authority": F.trim(F.split_part("operating_authority", F.lit("*"), F.lit(1))),
        "out_of_service_date": F.when(F.lower(bare) == "none", "").otherwise(bare), "mcs150_date": F.try_to_date(F.regexp_extract("mcs150_date", r"\d{1,2}/\d{1,2}/\d{4}", 0), "M/d/yyyy"),
    })
    return out.withColumn("active", (F.upper("operating_status") == "ACTIVE") & (F.col("out_of_service_date") == "")).drop("asked")


def evidence_rows(carriers: DataFrame) -> DataFrame:
    """records, with match_score, to (usdot, place, field, value, url, confidence): who it is, then each field that is known."""
    named = F.coalesce(F.nullif(F.col("dba_name"), F.lit("")), F.col("legal_name"))
    rows = [F.struct(F.lit("fleet.usdot").alias("field"), F.concat(F.lit("USDOT "), F.col("usdot"), F.lit(" — "), named).alias("value"), F.col("match_score").cast("double").alias("confidence"))]
    rows += [F.when(~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "--"), F.struct(F.lit("fleet." + c).alias("field"), F.col(c).cast("string").alias("value"), F.lit(sure).alias("confidence"))) for c, sure in EVIDENCE]
    return carriers.select("usdot", "url", F.posexplode(F.array_compact(F.array(*rows))).alias("place", "e")).select("usdot", "place", "e.field", "e.value", "url", "e.confidence")
