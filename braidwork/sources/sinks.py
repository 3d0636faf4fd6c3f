"""Writing results: tables as CSV, summaries as JSON, briefs as text."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def output_folders(root: str) -> dict[str, Path]:
    out = {"root": Path(root)} | {n: Path(root) / n for n in ("figures", "tables", "report")}
    for p in out.values():
        p.mkdir(parents=True, exist_ok=True)
    return out


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def write_summary(summary: dict, path: str) -> None:
    Path(path).write_text(json.dumps(summary, indent=2, default=str, sort_keys=True))


def score_bar(value: Column, cells: int = 20) -> Column:
    full = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), value)) / (100 / cells)).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(cells) - full))


def text_briefs(scores: DataFrame, flags: DataFrame) -> DataFrame:
    """(site, brief): four bars and the flags, as lines of text."""
    told = flags.groupBy("site").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "severity", "flag"))), lambda x: F.concat(F.lit("- ["), x["severity"], F.lit("] "), x["flag"])), "\n").alias("listed"))
    lines = [F.concat(F.rpad(F.lit(n), 14, " "), score_bar(F.col(n)), F.lit(" "), F.col(n).cast("string"), F.lit(" "), F.col(n + "_band")) for n in ("maturity", "momentum", "transparency", "coverage")]
    return scores.join(told, "site", "left").select("site", F.concat_ws("\n", F.col("site"), *lines, F.coalesce("listed", F.lit("- none"))).alias("brief"))


_MEASURES = ("maturity", "momentum", "transparency", "coverage")


def _listed(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(site, name): the values of a site's rows in the order of their places."""
    return rows.groupBy("site").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col(column).alias("x")))), lambda r: r["x"]).alias(name))


def briefs(scores: DataFrame, flags: DataFrame, unknowns: DataFrame, questions: DataFrame) -> DataFrame:
    """One row a site with its scores and the arrays flags, unknowns and questions: what the sinks below print."""
    said = flags.withColumn("said", F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("flag")))
    out = scores
    for rows, column, name in ((said, "said", "flags"), (unknowns, "unknown", "unknowns"), (questions, "question", "questions")):
        out = out.join(_listed(rows, column, name), "site", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def json_briefs(brief: DataFrame) -> DataFrame:
    """(site, brief): every field of a site as one JSON object."""
    return brief.select("site", F.to_json(F.struct(*[F.col(c) for c in brief.columns]), {"ignoreNullFields": "false"}).alias("brief"))


def _shown(name: str) -> Column:
    shown = F.concat(F.round(name).cast("int").cast("string"), F.lit("/100"))
    return F.when(~F.col("momentum_assessable"), "not measured").otherwise(shown) if name == "momentum" else shown


def markdown_briefs(brief: DataFrame) -> DataFrame:
    """(site, brief): a table of scores, then flags, unknowns and questions, as markdown."""
    rows = [F.concat(F.lit(f"| {n.capitalize()} | "), _shown(n), F.lit(" | "), F.col(n + "_band"), F.lit(" |")) for n in _MEASURES]
    parts = [F.concat(F.lit("# "), F.col("site")), F.lit(""), F.lit("| Measure | Score | Band |"), F.lit("|---|---:|---|"), *rows]
    for title, name in (("Risk flags", "flags"), ("Not established", "unknowns"), ("Questions", "questions")):
        items = F.array_join(F.transform(name, lambda x: F.concat(F.lit("- "), x)), "\n")
        parts += [F.lit(""), F.lit(f"## {title}"), F.lit(""), F.when(F.size(name) > 0, items).otherwise("- none")]
    return brief.select("site", F.concat_ws("\n", *parts).alias("brief"))


def escaped(text: Column) -> Column:
    out = text
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def html_briefs(brief: DataFrame) -> DataFrame:
    """(site, brief): the same as a page; every value is escaped."""
    rows = [F.concat(F.lit(f"<tr><th>{n.capitalize()}</th><td>"), _shown(n), F.lit("</td><td>"), escaped(F.col(n + "_band")), F.lit("</td></tr>")) for n in _MEASURES]
    parts = [F.lit("<!doctype html><html><head><meta charset=\"utf-8\"><title>"), escaped(F.col("site")), F.lit("</title></head><body><h1>"), escaped(F.col("site")), F.lit("</h1><table>"), *rows, F.lit("</table>")]
    for title, name in (("Risk flags", "flags"), ("Not established", "unknowns"), ("Questions", "questions")):
        items = F.array_join(F.transform(name, lambda x: F.concat(F.lit("<li>"), escaped(x), F.lit("</li>"))), "")
        parts += [F.lit(f"<h2>{title}</h2><ul>"), items, F.lit("</ul>")]
    return brief.select("site", F.concat(*parts, F.lit("</body></html>")).alias("brief"))


def write_briefs(printed: DataFrame, folder: str) -> None:
    """(site, brief) as text, one folder a site."""
    printed.repartition("site").write.mode("overwrite").partitionBy("site").text(folder)
