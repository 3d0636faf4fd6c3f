"""Scores, flags, signals and unknowns of a site, as expressions over one row of facts.

Facts (null where not known): site, model, people, leadership, founded_age, prices, plans, customers, legal_pages,
compliance, emails, phones, addresses, technologies, dependencies, service_area, hours, socials, open_roles, departments,
last_content_age (days), posts_per_month, copyright_age (years), funding, home_words, words, key_roles, power_units,
carrier_active (boolean), filing_age (days), carrier_refused, failures, model_signals, motion (how it sells). Counts count as 0 when null; open_roles does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = "people leadership prices plans customers legal_pages compliance emails phones addresses technologies dependencies service_area hours socials departments funding home_words words key_roles failures model_signals".split()
OTHERS = {"model": "string", "motion": "string", "founded_age": "int", "open_roles": "int", "last_content_age": "int", "posts_per_month": "double", "copyright_age": "int", "power_units": "int", "carrier_active": "boolean", "filing_age": "int", "carrier_refused": "string"}


def complete(facts: DataFrame) -> DataFrame:
    """Facts with every column there is, counts without nulls."""
    here = set(facts.columns)
    return facts.select("site", *[(F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in here else F.lit(0)).alias(c) for c in COUNTS], *[(F.col(c) if c in here else F.lit(None)).cast(t).alias(c) for c, t in OTHERS.items()])


# Fixed values in all rules below: thresholds, points, bands and weights.
def ladder(value: Column, *steps: tuple[float, float], otherwise: float = 0.0) -> Column:
    """Points of the first step (at least, points) that the value reaches."""
    out = F.when(value >= steps[0][0], float(steps[0][1]))
    for least, points in steps[1:]:
        out = out.when(value >= least, float(points))
    return out.otherwise(float(otherwise))


def falling(value: Column, *steps: tuple[float, float], otherwise: float = 0.0) -> Column:
    """Points of the first step (at most, points); null reaches none."""
    out = F.when(value <= steps[0][0], float(steps[0][1]))
    for most, points in steps[1:]:
        out = out.when(value <= most, float(points))
    return out.otherwise(float(otherwise))


def yes(condition: Column, points: float) -> Column:
    return F.when(condition, float(points)).otherwise(0.0)


def band(value: Column, names: tuple[str, str, str, str]) -> Column:
    return F.when(value >= 75, names[3]).when(value >= 50, names[2]).when(value >= 25, names[1]).otherwise(names[0])


BANDS, FOOTPRINT_BANDS = ("thin", "emerging", "established", "strong"), ("sparse", "partial", "substantial", "comprehensive")


def scores(facts: DataFrame) -> DataFrame:
    """(site, maturity, momentum, transparency, coverage, their bands, momentum_assessable)."""
    c, f = F.col, complete(facts)
    age = F.when(c("founded_age").isNull(), 0.0).otherwise(ladder(c("founded_age"), (10, 15), (5, 11), (2, 7), otherwise=3))
    units = F.coalesce(ladder(c("power_units"), (50, 25), (10, 18), (3, 12), (1, 5)), F.lit(0.0))
    maturity = (
        ladder(c("people"), (10, 22), (3, 16), (1, 8)) + age + yes(c("prices") > 0, 10) + yes(c("plans") > 0, 4) + ladder(c("customers"), (5, 12), (1, 7)) + ladder(c("legal_pages"), (2, 8), (1, 4))
        + yes(c("compliance") > 0, 8) + yes(c("emails") > 0, 3) + yes(c("phones") > 0, 3) + yes(c("addresses") > 0, 3) + yes(c("technologies") >= 6, 5) + units + yes(c("service_area") > 0, 8) + yes(c("hours") > 0, 4)
    )
    quiet = (F.coalesce(c("model"), F.lit("")) == "local_services") & c("last_content_age").isNull() & (F.coalesce(c("open_roles"), F.lit(0)) == 0) & (c("funding") == 0)
    roles = F.when(c("open_roles").isNull(), 0.0).otherwise(ladder(c("open_roles"), (10, 30), (3, 24), (1, 16), otherwise=4))
    moved = (
        roles + falling(c("last_content_age"), (60, 30), (180, 22), (365, 12), (730, 5)) + F.coalesce(F.when(c("posts_per_month") >= 4, 15.0).when(c("posts_per_month") >= 1, 10.0).when(c("posts_per_month") > 0, 5.0), F.lit(0.0))
        + falling(c("copyright_age"), (1, 12), (2, 5)) + yes(c("funding") > 0, 10) + yes(c("departments") >= 3, 5)
    )
    momentum = F.when(quiet, F.when(c("copyright_age") <= 1, 60.0).otherwise(30.0)).otherwise(moved)
    transparency = (
        F.when(c("leadership") > 0, 20.0).when(c("people") > 0, 10.0).otherwise(0.0) + yes(c("addresses") > 0, 15) + yes(c("phones") > 0, 10) + yes(c("emails") > 0, 10) + ladder(c("legal_pages"), (2, 15), (1, 8))
        + yes(c("compliance") > 0, 10) + yes(c("prices") > 0, 10) + yes(c("socials") >= 2, 10)
    )
    coverage = 75.0 * F.least(c("key_roles"), F.lit(7)) / 7 + ladder(c("words"), (6000, 25), (2500, 18), (800, 10), (200, 4))
    cap = lambda x: F.round(F.least(F.lit(100.0), x), 1)
    out = f.select("site", cap(maturity).alias("maturity"), cap(momentum).alias("momentum"), cap(transparency).alias("transparency"), cap(coverage).alias("coverage"), (~quiet).alias("momentum_assessable"))
    return out.withColumns({"maturity_band": band(c("maturity"), FOOTPRINT_BANDS), "momentum_band": F.when(~c("momentum_assessable"), "not assessable").otherwise(band(c("momentum"), BANDS)), "transparency_band": band(c("transparency"), BANDS), "coverage_band": band(c("coverage"), BANDS)})


def _local():
    return F.coalesce(F.col("model"), F.lit("")) == "local_services"


def flag_rules() -> list[tuple[str, str, Column]]:
    c = F.col
    serves = F.coalesce(c("model"), F.lit("")).isin("services", "local_services")
    return [
        ("thin_site", "high", c("home_words") < 120),
        ("stale_site", "high", (c("last_content_age") > 540) | (c("copyright_age") >= 3)),
        ("no_contact", "high", (c("emails") == 0) & (c("phones") == 0) & (c("addresses") == 0)),
        ("no_people", "medium", c("people") == 0),
        ("key_person", "medium", c("people") == 1),
        ("no_public_pricing", "medium", (c("prices") == 0) & ~serves),
        ("no_legal_pages", "medium", c("legal_pages") == 0),
        ("platform_dependency", "low", c("dependencies") > 0),
        ("unverified_credentials", "low", (c("compliance") > 0) & _local()),
        ("unverified_compliance", "low", (c("compliance") > 0) & ~_local()),
        ("carrier_inactive", "high", c("carrier_active") == F.lit(False)),
        ("stale_mcs150", "medium", c("filing_age") > 730),
        ("carrier_unmatched", "low", c("carrier_refused").isNotNull() & (c("carrier_refused") != "no record found")),
        ("fetch_failures", "low", c("failures") >= 3),
    ]


def flags(facts: DataFrame) -> DataFrame:
    """(site, place, severity, flag), by severity and then in the order of the rules."""
    rank = {"high": 0, "medium": 1, "low": 2}
    rules = sorted(enumerate(flag_rules()), key=lambda r: (rank[r[1][1]], r[0]))
    told = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(sev).alias("severity"), F.lit(name).alias("flag"))) for _, (name, sev, cond) in rules]))
    return complete(facts).select("site", F.posexplode(told).alias("place", "x")).select("site", "place", "x.severity", "x.flag")


def signals(facts: DataFrame) -> DataFrame:
    """(site, category, signal, weight) of what was observed."""
    c = F.col
    rules = [
        ("commercial", "revenue_model", F.coalesce(c("model"), F.lit("unknown")) != "unknown", F.round(F.least(F.lit(0.9), 0.4 + 0.1 * c("model_signals")), 1)),
        ("commercial", "public_pricing", c("prices") > 0, F.lit(0.8)), ("commercial", "sales_motion", F.coalesce(c("motion"), F.lit("unknown")) != "unknown", F.lit(0.6)), ("trust", "named_leadership", c("leadership") > 0, F.lit(0.7)),
        ("scale", "named_customers", c("customers") > 0, F.lit(0.6)), ("scale", "operating_history", c("founded_age").isNotNull(), F.lit(0.7)), ("momentum", "hiring", c("open_roles") > 0, F.lit(0.8)),
        ("momentum", "content_freshness", c("last_content_age").isNotNull(), F.when(c("last_content_age") <= 180, 0.8).otherwise(0.3)), ("operations", "platform_dependency", c("dependencies") > 0, F.lit(0.5)), ("trust", "compliance", c("compliance") > 0, F.lit(0.5)),
    ]
    told = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(cat).alias("category"), F.lit(name).alias("signal"), w.alias("weight"))) for cat, name, cond, w in rules]))
    return complete(facts).select("site", F.explode(told).alias("x")).select("site", "x.category", "x.signal", "x.weight")


def distinct_evidence(evidence: DataFrame) -> DataFrame:
    """evidence (site, ord, field, value, source_url, ...): the first row of each field, value and source of a site."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("site", "field", "value", "source_url").orderBy("ord")
    return evidence.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
