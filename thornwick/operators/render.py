"""Rendered outputs: badges, sitemap rows, reports, pull-request text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thornwick.functions import tables as t
from thornwick.operators.prompts import rank
from thornwick.operators.scoring import grade, severity_counts

_COLORS = {name: color for name, _, _, color in t.GRADES}


def badge_width(label: Column) -> Column:
    return F.greatest(F.lit(80), F.length(label) * 7 + 10)


def badge_svg(score: Column) -> Column:
    """A score's badge, or that of a package not scanned."""
    label = F.when(score.isNull(), F.lit("not scanned")).otherwise(F.concat(score.cast("string"), F.lit("/100 "), grade(score)))
    color = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _COLORS.items() for x in kv]), grade(score)), F.lit("#9e9e9e"))
    shown = F.when(score.isNull(), F.lit("#9e9e9e")).otherwise(color)
    return F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="20"><rect width="%d" height="20" fill="%s"/><text x="5" y="14">%s</text></svg>', badge_width(label), badge_width(label), shown, label)


def sitemap(static: DataFrame, scanned: DataFrame, indexed: DataFrame, base: str) -> DataFrame:
    """URL rows: static pages, scanned packages (0.8, weekly), and the indexed ones not scanned (0.4, monthly); slug keys."""

    def rows(df: DataFrame, path: str, priority: str, often: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{base}{path}"), F.replace(F.url_encode("slug"), F.lit("+"), F.lit("%20"))).alias("loc"), F.lit(priority).alias("priority"), F.lit(often).alias("changefreq"))

    rest = indexed.select("slug").distinct().join(scanned.select("slug").distinct(), "slug", "left_anti")
    return rows(static, "/", "1.0", "daily").unionByName(rows(scanned.select("slug").distinct(), "/scan/", "0.8", "weekly")).unionByName(rows(rest, "/scan/", "0.4", "monthly"))


def sitemap_xml(row_loc: Column, priority: Column, changefreq: Column) -> Column:
    return F.format_string("<url><loc>%s</loc><changefreq>%s</changefreq><priority>%s</priority></url>", row_loc, changefreq, priority)


def top_findings(findings: DataFrame, k: int = 10) -> DataFrame:
    """Each package's k severest findings, in order of finding where equal."""
    order = Window.partitionBy("pkg").orderBy(F.desc(rank(F.col("severity"))), "ord")
    return findings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


PARTICIPATION_COLOR = "#2196f3"


def participation_svg(name: str, value: str = "scanned") -> str:
    """A badge without a score."""
    left, right = len(name) * 7 + 10, len(value) * 7 + 16
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{left + right}" height="20" role="img" aria-label="{name}: {value}"><title>{name}: {value}</title><rect width="{left}" height="20" fill="#555"/>'
        f'<rect x="{left}" width="{right}" height="20" fill="{PARTICIPATION_COLOR}"/><text x="{left / 2:g}" y="14">{name}</text><text x="{left + right / 2:g}" y="14">{value}</text></svg>'
    )


def flow_lines(flows: DataFrame, k: int = 5) -> DataFrame:
    """Each package's first k flows as text (pkg, lines): source with its place, steps, sink with its place. flows: pkg, ord,
    source_description, source_file, source_line, steps (array<string>), sink_description, sink_file, sink_line."""
    first = flows.withColumn("rank", F.row_number().over(Window.partitionBy("pkg").orderBy("ord"))).filter(F.col("rank") <= k)
    steps = F.transform("steps", lambda x: F.concat(F.lit("  -> "), x))
    line = F.concat_ws("\n", F.format_string("! %s\n  %s:%d", "source_description", "source_file", "source_line"), F.when(F.size("steps") > 0, F.array_join(steps, "\n")), F.format_string("  -> %s\n  %s:%d", "sink_description", "sink_file", "sink_line"))
    return first.groupBy("pkg").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]).alias("lines"))


def json_report(scores: DataFrame, findings: DataFrame, prompt_findings: DataFrame, flows: DataFrame) -> DataFrame:
    """pkg and its whole result as JSON: score columns, then all findings and flows in their order."""
    listed = lambda df, name: df.groupBy("pkg").agg(F.sort_array(F.collect_list(F.struct("ord", *[c for c in df.columns if c not in ("pkg", "ord")]))).alias(name))
    rows = scores
    for name, df in (("code_findings", findings), ("prompt_findings", prompt_findings), ("taint_flows", flows)):
        rows = rows.join(listed(df, name), "pkg", "left")
    return rows.select("pkg", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("report"))


def report(scores: DataFrame, findings: DataFrame, k: int = 10) -> DataFrame:
    """A text report a package: score, grade, counts, and its severest findings."""
    lines = top_findings(findings, k).groupBy("pkg").agg(F.sort_array(F.collect_list(F.struct("rank", F.format_string("[%s] %s (%s:%d)", F.upper("severity"), "description", "file", "line").alias("t")))).alias("x"))
    both = scores.join(severity_counts(findings), "pkg", "left").join(lines, "pkg", "left").fillna(0, ["critical", "high", "medium"])
    head = F.format_string("%s\nScore %d/100 (%s)\ncritical %d, high %d, medium %d", "pkg", "overall_score", "grade", "critical", "high", "medium")
    return both.select("pkg", F.concat_ws("\n", head, F.array_join(F.transform("x", lambda r: r["t"]), "\n")).alias("report"), (F.col("overall_score") < 40).alias("fails"))


def gate(score_grade: Column, force: bool) -> Column:
    """What an install does: proceed, ask, or abort."""
    return F.when(score_grade == "blocked", F.lit("proceed" if force else "abort")).when(score_grade == "caution", "ask").otherwise("proceed")


def with_badge(readme: str, badge: str) -> str:
    """A readme with a badge line: after its run of badges, else after a block that opens it, else after the first heading's
    blank line, else at the end."""
    lines = readme.split("\n")
    runs = [i for i, x in enumerate(lines[:40]) if re.match(r"^\s*\[?!\[[^\]]*\]\([^)]*\)", x)]
    if runs:
        end = runs[0]
        while end + 1 < len(lines) and re.match(r"^\s*\[?!\[[^\]]*\]\([^)]*\)", lines[end + 1]):
            end += 1
        return "\n".join([*lines[: end + 1], badge, *lines[end + 1 :]])
    if lines and re.match(r"^\s*<div\b", lines[0]):
        depth = 0
        for i, x in enumerate(lines):
            depth += len(re.findall(r"<div\b", x)) - x.count("</div>")
            if depth <= 0:
                return "\n".join([*lines[: i + 1], "", badge, *lines[i + 1 :]])
    heading = next((i for i, x in enumerate(lines) if x.startswith("#")), None)
    if heading is not None:
        blank = next((i for i in range(heading + 1, len(lines)) if not lines[i].strip()), None)
        if blank is not None:
            return "\n".join([*lines[: blank + 1], badge, "", *lines[blank + 1 :]])
    return f"{readme}\n\n{badge}\n"
