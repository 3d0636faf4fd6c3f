"""Matrix-shaped data: profile, cleaning, scaling, sampling, permutations and significance, as DataFrame operators.

Random choices are made by md5 of (seed, replicate, column, row key), so that they are the same on every cluster and can
be repeated in SQL. Only column profiles (one row) come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: rows, nulls, distinct values (null counts as one), mean, population deviation, median, range.

    One pass takes the moments and brackets each median by bounded quantile sketches; another counts each (column, value)
    once, with partial counts before its exchange. The exact median is looked up by cumulative counts within the part of
    the values (below, within or above the bracket) that holds it, so a reducer sorts about a five-hundredth of a column,
    and a bad bracket costs time, not exactness.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        near = F.percentile_approx(v, [0.499, 0.501], 10000)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_pop(v).alias(f"s{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), near.alias(f"q{i}")]
    cells = [
        F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                 F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"), F.col(f"q{i}")[0].alias("q0"), F.col(f"q{i}")[1].alias("q1"))
        for i, c in enumerate(columns)
    ]
    told = df.agg(*aggs).select(F.inline(F.array(*cells)))
    pairs = [F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]
    counts = df.select(F.inline(F.array(*pairs))).where("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("c"))
    part = F.when(F.col("v") < F.col("q0"), 0).when(F.col("v") <= F.col("q1"), 1).otherwise(2)
    parted = counts.join(F.broadcast(told.select("i", "q0", "q1")), "i").select("i", part.alias("part"), "v", "c")
    sums = parted.groupBy("i", "part").agg(F.sum("c").alias("held"), F.count("*").alias("values"))
    before = F.sum("held").over(Window.partitionBy("i").orderBy("part")) - F.col("held")
    sums = sums.withColumn("before", before).withColumn("n", F.sum("held").over(Window.partitionBy("i"))).withColumn("values", F.sum("values").over(Window.partitionBy("i")))
    low, high = F.expr("(n - 1) div 2"), F.expr("n div 2")  # the two middle places, from 0
    middle = sums.where((F.col("before") <= high) & (F.col("before") + F.col("held") > low))
    placed = parted.join(F.broadcast(middle), ["i", "part"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("i", "part").orderBy("v")))
    at = lambda place: F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col("v")))
    medians = placed.groupBy("i").agg(F.max("values").alias("values"), ((at(low) + at(high)) / 2).alias("median"))
    distinct = F.coalesce("values", F.lit(0).cast("long")) + (F.col("rows") > F.col("n")).cast("long")
    return told.join(F.broadcast(medians), "i", "left").select(
        "column", "rows", (F.col("rows") - F.col("n")).alias("nulls"), distinct.alias("distinct_values"), "mean", "std", "median", "min_value", "max_value"
    )


def order_key(seed: int, *parts: Column) -> Column:
    """A text whose order is a random permutation of its rows, equal in any SQL engine that has md5."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def sample_rows(df: DataFrame, key: str, n: int | None, seed: int = 42) -> DataFrame:
    """n rows without replacement, all if n is null or 0. A top-n by hash: no full sort, partial limits before the exchange."""
    if not n:
        return df
    return df.withColumn("__o", order_key(seed, F.col(key))).orderBy("__o", key).limit(n).drop("__o")


def _filled(told) -> tuple[float | None, float]:
    """Mean and population deviation of a profiled column once its nulls have become its median; no further pass."""
    if told["median"] is None or told.min_value == told.max_value:
        return told["median"], 0.0
    n, k, m = told.rows - told.nulls, told.nulls, told["median"]
    mean = (n * told["mean"] + k * m) / told.rows
    return mean, ((n * (told["std"] ** 2 + (told["mean"] - mean) ** 2) + k * (m - mean) ** 2) / told.rows) ** 0.5


def prepare(df: DataFrame, key: str | None = None, label: str | None = None, sample: int | None = None, seed: int = 42) -> tuple[DataFrame, dict]:
    """Constant columns out, rows sampled, medians for nulls, z-scores; the kept columns are replaced in place.

    Raises ValueError for an empty table, a missing key or label column, no numeric column, or constant ones only. The
    constant test comes before the sampling; a column constant within the sample scales to 0. Returns the rows (key,
    label and columns) and a summary.
    """
    meta = [c for c in (key, label) if c]
    if missing := [c for c in meta if c not in df.columns]:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    columns = numeric_columns(df, tuple(meta))
    if not columns:
        raise ValueError("no numeric columns")
    told = {r["column"]: r for r in profile(df, columns).collect()}
    kept = [c for c in columns if told[c].distinct_values > 1]
    if not kept:
        raise ValueError("all numeric columns are constant")
    rows, seen = df.select(*meta, *[F.col(c).cast("double").alias(c) for c in kept]), told
    if sample and key:
        rows = sample_rows(rows, key, sample, seed)
        seen = {r["column"]: r for r in profile(rows, kept).collect()}
    scaled = rows.select(*meta, *[((F.coalesce(c, F.lit(seen[c].median)) - F.lit(mean)) / F.lit(std or 1.0)).alias(c) for c, (mean, std) in ((c, _filled(seen[c])) for c in kept)])
    summary = {"rows": told[columns[0]].rows, "columns": len(df.columns), "numeric": len(columns), "kept": kept, "dropped_non_numeric": len(df.columns) - len(kept) - len(meta), "imputed": sum(told[c].nulls for c in kept)}
    return scaled, summary


def order_bucket(df: DataFrame, column: str, ranges: int = 256) -> tuple[DataFrame, Column]:
    """`df` and a bucket in the order of a column: by approximate quantiles of numbers, dates and times, by the first two
    bytes of texts; nulls come first. Buckets share the work of a sort; their sizes change no result."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        head = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 2)), 4, "0")
        return df, F.coalesce(F.conv(head, 16, 10).cast("int"), F.lit(-1))
    cuts = df.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 10000).alias("__cuts"))
    at = F.size(F.filter("__cuts", lambda c: c < F.col(column)))
    return df.crossJoin(F.broadcast(cuts)), F.when(F.col(column).isNull(), -1).otherwise(F.coalesce(at, F.lit(0)))


def running(df: DataFrame, bucket: Column, order: list[Column], value: Column, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """`df` with the running sum of `value` in an order that agrees with the buckets: summed within a bucket, plus what the
    buckets before it hold. Only one row for each bucket meets in a global window. Texts that share their first two bytes, and rows
    with equal keys, are sorted in one task."""
    rows = df.withColumns({"__b": bucket, "__v": value}).drop("__cuts")
    sums = rows.groupBy(*within, "__b").agg(F.sum("__v").alias("__all"))
    groups = [F.col(c) for c in within] or [F.lit(0)]
    sums = sums.select(*within, "__b", (F.sum("__all").over(Window.partitionBy(*groups).orderBy("__b")) - F.col("__all")).alias("__before"))
    own = F.sum("__v").over(Window.partitionBy(*within, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__own", own).join(F.broadcast(sums), [*within, "__b"]).withColumn(name, F.col("__own") + F.col("__before")).drop("__b", "__v", "__own", "__before")


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """`df` with the number of each row, from 1, in the order of its key."""
    rows, bucket = order_bucket(df, key)
    return running(rows, bucket, [F.col(key)], F.lit(1), name)


def permuted(df: DataFrame, key: str, column: str, replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, key, column): the column's values dealt out anew over the rows, once for each replicate. Places are
    numbered once; the deal of a replicate is numbered in 4,096 buckets of its hash."""
    reps = df.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    places = numbered(df.select(key, column), key, "i")
    wide = places.crossJoin(F.broadcast(reps)).withColumn("__o", order_key(seed, F.col("replicate"), F.lit(column), F.col(key)))
    bucket = F.conv(F.substring("__o", 1, 3), 16, 10).cast("int")
    values = running(wide.select("replicate", key, column, "__o"), bucket, [F.col("__o"), F.col(key)], F.lit(1), "i", ("replicate",)).select("replicate", "i", column)
    return wide.select("replicate", key, "i").join(values, ["replicate", "i"]).select("replicate", key, column)


def bootstrapped(df: DataFrame, key: str, replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, draw, and the columns of `df`): as many rows as there are, drawn with replacement, for each replicate."""
    spark, n = df.sparkSession, df.count()
    rows = numbered(df, key, "__i")
    draws = spark.range(replicates * n).select((F.col("id") / n).cast("int").alias("replicate"), (F.col("id") % n).cast("long").alias("draw"))
    pick = F.conv(F.substring(order_key(seed, F.col("replicate"), F.col("draw")), 1, 12), 16, 10).cast("long") % n
    return draws.withColumn("__i", pick + 1).join(rows, "__i").drop("__i")


def replicate_lists(replicates: DataFrame) -> DataFrame:
    """replicates (metric, replicate, value) to (metric, values): the values of each metric in the order of the replicates."""
    listed = F.sort_array(F.collect_list(F.struct("replicate", "value")))
    return replicates.groupBy("metric").agg(F.transform(listed, lambda r: r["value"]).alias("values"))


def null_summary(replicates: DataFrame) -> DataFrame:
    """(metric, n, mean, std, q025, q975) of replicate values (metric, value)."""
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), q.alias("q")).select("metric", "n", "mean", "std", F.col("q")[0].alias("q025"), F.col("q")[1].alias("q975"))


def significance(observed: DataFrame, replicates: DataFrame) -> DataFrame:
    """(metric, observed, z, p): two-sided about the null mean, plus one; z = 0 and p = 1 without replicates."""
    stats = replicates.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    base = observed.select("metric", F.col("value").alias("observed")).join(stats, "metric", "left")
    far = base.join(replicates, "metric", "left").groupBy("metric", "observed", "n", "mean", "std").agg(F.count_if(F.abs(F.col("value") - F.col("mean")) >= F.abs(F.col("observed") - F.col("mean"))).alias("beyond"))
    n = F.coalesce("n", F.lit(0))
    return far.select(
        "metric", "observed", F.when((n > 0) & (F.col("std") > 0), (F.col("observed") - F.col("mean")) / F.col("std")).otherwise(0.0).alias("z"), F.when(n > 0, (F.col("beyond") + 1) / (n + 1)).otherwise(1.0).alias("p")
    )


def eligible_groups(df: DataFrame, label: str, least: int = 8, most: int = 8) -> DataFrame:
    """(label, n): groups of at least `least` rows, the `most` largest; a null label is a group named None. At least two or none."""
    counts = df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("None")).alias("label")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "label").limit(most)
    return top.withColumn("__k", F.count("*").over(Window.partitionBy(F.lit(0)))).where("__k >= 2").drop("__k")


def group_difference(df: DataFrame, key: str, label: str, value: str, replicates: int = 32, seed: int = 42) -> DataFrame:
    """(low_label, high_label, difference, p): means of two groups against permuted labels, uncentred; empty unless the
    label has exactly two values."""
    data = df.select(F.col(key).alias("k"), F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("v")).where("label IS NOT NULL")
    ends = data.agg(F.min("label").alias("low_label"), F.max("label").alias("high_label"), F.countDistinct("label").alias("n")).where("n = 2").drop("n")
    shuffled = permuted(data, "k", "label", replicates, seed).join(data.select("k", "v"), "k")
    both = shuffled.select("replicate", "label", "v").unionAll(data.select(F.lit(-1).alias("replicate"), "label", "v")).crossJoin(F.broadcast(ends))
    mean = lambda side: F.avg(F.when(F.col("label") == F.col(side), F.col("v")))
    diffs = both.groupBy("replicate", "low_label", "high_label").agg((mean("low_label") - mean("high_label")).alias("d"))
    seen = F.max(F.when(F.col("replicate") == -1, F.col("d"))).over(Window.partitionBy(F.lit(0)))
    told = diffs.withColumn("difference", seen)
    return told.groupBy("low_label", "high_label", "difference").agg(((F.count_if((F.col("replicate") >= 0) & (F.abs("d") >= F.abs("difference") - 1e-12)) + 1) / (F.count_if(F.col("replicate") >= 0) + 1)).alias("p"))
