"""Mixing to target weights by iterative proportional fitting, in DataFrame functions only.

Every combination of source, language and topic gets a rate between 0 and 1, such that the tokens expected to be kept meet
a target for every source, every language and every topic. Weights are raked to the three marginals in turn, each time
with rates cut at 1, so that a combination that is taken whole passes what it lacks to others of its marginals.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import materialize

RATE = 0.8
#: Exponents that flatten each marginal: a value with share s gets a target in proportion to s ** exponent.
TEMPER = {"source": 0.5, "lang": 0.5, "topic": 0.5}
#: No value's target is more than this share of its own tokens.
MOST = 0.95
SWEEPS, TOLERANCE, ROUNDS = 10, 2e-3, 15
BROADCAST_CELLS = 100_000
DIMS = ("source", "lang", "topic")
def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+")


def _count(words: Column) -> Column:
    """Words of a split text: an empty piece can come at either end."""
    n = F.size(words)
    return n - (words[0] == "").cast("int") - ((n > 1) & (F.element_at(words, -1) == "")).cast("int")


def topic_of(words: Column) -> Column:
    """A stand-in for a topic: a hash deals the longest word of a text (of equals the first) to one of four clusters, a, b,
    c and d; texts without words go where the empty word goes. Near copies share it, and it cuts across sources and
    languages. Where documents carry real topics, pass those in place of it (`topic`)."""
    longest = F.aggregate(words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    return F.translate(F.substring(F.md5(longest.cast("binary")), 1, 1), "0123456789abcdef", "aaaabbbbccccdddd")


def _rows(docs: DataFrame, key: str, text: str, topic: Column | None = None) -> DataFrame:
    dims = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias("__" + c) for c in ("source", "lang")]
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = docs.withColumns({"__source": dims[0], "__lang": dims[1], "__u": draw, "__words": _words(F.col(text))})
    topic = topic_of(F.col("__words")) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))
    return rows.withColumns({"__topic": topic, "__n": _count(F.col("__words")).cast("double")}).drop("__words")


def targets_of(own: DataFrame, rate: float, exponent: float = 0.5, given: dict[str, float] | None = None, most: float = MOST) -> DataFrame:
    """own (value, s: share of all tokens) to (value, target): shares that add up to `rate`, in proportion to s ** exponent
    (or to given[value]; 0 for others), but at most `most` times s: what such a value cannot supply the others get. The
    factor is found by Newton's steps from below, each one aggregate over the values, until no more values are cut."""
    if given is None:
        wish = F.when(F.col("s") > 0, F.pow("s", F.lit(float(exponent)))).otherwise(0.0)
    else:
        wish = F.coalesce(F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, float(v))])[F.col("value")], F.lit(0.0)) if given else F.lit(0.0)
    own = own.select("value", "s", wish.alias("wish"))
    factor, full = 0.0, F.lit(False)
    while True:
        taken, free = own.agg(F.sum(F.when(full, most * F.col("s")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("wish")))).first()
        if not free:
            break
        step = (rate - taken) / free
        if step <= factor * (1 + 1e-12):
            break
        factor = step
        full = factor * F.col("wish") >= most * F.col("s")
    return own.select("value", F.least(F.lit(factor) * F.col("wish"), most * F.col("s")).alias("target"))


def cell_rates(rows: DataFrame, rate: float = RATE, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(source, lang, topic, n, target_source, target_lang, target_topic, rate) of every combination that occurs.

    Targets are shares of all tokens; each marginal's add up to `rate`. targets: wished shares by value in place of
    tempered ones; a value without one gets none. No value's target is over MOST of its own tokens. Sweeps over the
    combinations go on until every marginal is within TOLERANCE of its target; where that fails, as the three together
    ask for what the combinations cannot give, `rate` is lowered by a tenth and the targets are made anew, up to ROUNDS
    times; then a warning says how far off the result is. Combinations are few however many documents there are; they
    are written to the shared folder, and each step deals them by one marginal.
    """
    cells = rows.groupBy(*("__" + d for d in DIMS)).agg(F.sum("__n").alias("n")).select(*(F.col("__" + d).alias(d) for d in DIMS), "n")
    cells = materialize(cells, "cells")
    total = cells.agg(F.sum("n")).first()[0]
    if not total:
        return cells.select(*DIMS, "n", *(F.lit(0.0).alias("target_" + d) for d in DIMS), F.lit(float(rate)).alias("rate"))
    for _ in range(ROUNDS):
        state = cells.withColumn("w", F.lit(float(rate)))
        for d in DIMS:
            own = cells.groupBy(F.col(d).alias("value")).agg((F.sum("n") / total).alias("s"))
            own = materialize(own, "own")
            state = state.join(targets_of(own, rate, (temper or TEMPER)[d], (targets or {}).get(d)).select(F.col("value").alias(d), F.col("target").alias("target_" + d)), d)
        off, before = None, None
        while True:
            state = _swept(state, total)
            state = materialize(state, "sweeps")
            off = max(state.agg(*(F.max(F.abs(F.col("off_" + d))) for d in DIMS)).first())
            if off <= TOLERANCE or before is not None and off > 0.7 * before:
                break
            before = off
        if off <= TOLERANCE:
            break
        rate *= 0.9
    else:
        warnings.warn(f"targets cannot be met together; a marginal is off by {off:.1%}", stacklevel=2)
    return state.select(*DIMS, "n", *("target_" + d for d in DIMS), F.least(F.lit(1.0), F.col("w")).alias("rate"))


def _swept(state: DataFrame, total: float) -> DataFrame:
    """SWEEPS times through the marginals, and how far off each then is, relative to its target."""
    state = state.select(*DIMS, "n", *("target_" + d for d in DIMS), "w")
    now = lambda d: F.sum(F.col("n") * F.least(F.lit(1.0), F.col("w"))).over(Window.partitionBy(d))
    for _ in range(SWEEPS):
        for d in DIMS:
            state = state.withColumn("now", now(d)).withColumn("w", F.when(F.col("now") > 0, F.col("w") * F.col("target_" + d) * total / F.col("now")).otherwise(F.col("w")))
    return state.select("*", *(F.when(F.col("target_" + d) > 0, now(d) / (F.col("target_" + d) * total) - 1).otherwise(0.0).alias("off_" + d) for d in DIMS))


def _joined(rows: DataFrame, rates: DataFrame) -> DataFrame:
    rates = rates.select(*(F.col(d).alias("__" + d) for d in DIMS), F.col("rate").alias("__rate"))
    small = rates.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    return rows.join(F.broadcast(rates) if small else rates, ["__" + d for d in DIMS])


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", topic: Column | None = None, **options) -> DataFrame:
    """One row for each row of `docs`: (key, source, lang, topic, n_tokens, rate, kept).

    A row is kept if a number in [0, 1) made from its key's md5 is under its combination's rate: the same at every
    run, and the same for repeated rows. Null source, language or given topic: a value of their own (empty). Null or
    empty text: no tokens, the topic of the empty word. Null key: drawn as the empty key. Empty table: no rows. Other columns are
    ignored. The table of rates is broadcast if it has at most BROADCAST_CELLS rows, else joined by shuffle.
    """
    slim = _rows(docs, key, text, topic).select(F.col(key).alias("__key"), *("__" + d for d in DIMS), "__n", "__u")
    slim = materialize(slim, "slim")
    out = _joined(slim, cell_rates(slim, **options))
    return out.select(
        F.col("__key").alias(key), *(F.col("__" + d).alias(d) for d in DIMS), F.col("__n").cast("long").alias("n_tokens"), F.round("__rate", 6).alias("rate"), (F.col("__u") < F.col("__rate")).alias("kept")
    )


def sampled(docs: DataFrame, key: str = "doc_id", text: str = "text", topic: Column | None = None, **options) -> DataFrame:
    """The rows of `docs` that are kept, unchanged; nulls, repeated rows and empty tables as in mix()."""
    rows = _rows(docs, key, text, topic)
    return _joined(rows, cell_rates(rows, **options)).where("__u < __rate").select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql(table: str = "documents", rate: float = RATE, sweeps: int = SWEEPS, newton: int = 12) -> str:
    """DuckDB SQL of mix() where one block of sweeps meets the tolerance."""
    steps = [
        f"""texts AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
      list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM {table})""",
        """rows_ AS (SELECT * EXCLUDE (words), len(words) AS n, translate(substr(md5(CASE WHEN len(words) = 0 THEN '' ELSE list_reduce(words, lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END) END), 1, 1),
      '0123456789abcdef', 'aaaabbbbccccdddd') AS topic FROM texts)""",
        "cells AS (SELECT source, lang, topic, sum(n)::DOUBLE AS n, sum(sum(n)) OVER ()::DOUBLE AS total FROM rows_ GROUP BY ALL)",
    ]
    for d in DIMS:
        steps.append(f"f_{d}_0 AS (SELECT {d}, sum(n) / any_value(total) AS s, CASE WHEN sum(n) > 0 THEN pow(sum(n) / any_value(total), {TEMPER[d]}) ELSE 0 END AS wish, 0::DOUBLE AS f FROM cells GROUP BY {d})")
        for i in range(newton):
            full = "f > 0 AND f * wish >= " + f"{MOST} * s"
            step = f"({rate} - sum(CASE WHEN {full} THEN {MOST} * s ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN {full} THEN 0 ELSE wish END) OVER (), 0)"
            steps.append(f"f_{d}_{i + 1} AS (SELECT {d}, s, wish, greatest(f, coalesce({step}, f)) AS f FROM f_{d}_{i})")
        steps.append(f"t_{d} AS (SELECT {d}, least(f * wish, {MOST} * s) AS target_{d} FROM f_{d}_{newton})")
    steps.append(f"w0 AS (SELECT *, {rate}::DOUBLE AS w FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    at = "w0"
    for s in range(sweeps):
        for i, d in enumerate(DIMS):
            new = f"w{s}_{i}"
            steps.append(f"{new} AS (SELECT * REPLACE (CASE WHEN now > 0 THEN w * target_{d} * total / now ELSE w END AS w) FROM (SELECT * {'' if at == 'w0' else 'EXCLUDE (now)'}, sum(n * least(1.0::DOUBLE, w)) OVER (PARTITION BY {d}) AS now FROM {at}))")
            at = new
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, topic, n::BIGINT AS n_tokens, round(least(1.0::DOUBLE, w), 6) AS rate, u < least(1.0::DOUBLE, w) AS kept FROM rows_ JOIN (SELECT source, lang, topic, w FROM {at}) USING (source, lang, topic)"
