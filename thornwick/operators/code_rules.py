"""Regular-expression rules over code files (pkg, path, content, is_fixture)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thornwick.functions import tables as t
from thornwick.functions.paths import is_output
from thornwick.functions.text import any_of, bind, contains_match, cut_at, indexed, line_span, matches, may_match, trim_js, truncate
from thornwick.plans.stages import kept

FS_CONTEXT = (r"""require\s*\(\s*['"](?:node:)?fs(?:\/promises)?['"]\s*\)""", r"""from\s+['"](?:node:)?fs(?:\/promises)?['"]""", r"\b(?:readFileSync|readFile|writeFileSync|writeFile|unlink|appendFile|createReadStream|createWriteStream)\s*\(")
UI_FILE = r"\.(tsx|jsx|vue|svelte)$"
_HEAD = 1024
SENSITIVE_RULE = "References sensitive system path"


def scanned_files(files: DataFrame) -> DataFrame:
    """A package's sources without build output; its build output where it has nothing else. Only build output is joined."""
    sources = files.filter(~is_output(F.col("path")))
    rest = files.filter(is_output(F.col("path"))).join(sources.select("pkg").distinct(), "pkg", "left_anti")
    return sources.unionByName(rest)


def capped(files: DataFrame, most: int = 5000) -> DataFrame:
    """The first `most` files of each package by path; only packages of more have their paths ranked."""
    large = files.groupBy("pkg").count().filter(F.col("count") > most).select("pkg")
    ranked = files.select("pkg", "path").join(large, "pkg", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("pkg").orderBy("path")))
    over = kept(ranked.filter(F.col("n") > most).select("pkg", "path"))
    return files if over.isEmpty() else files.join(over, ["pkg", "path"], "left_anti")


def detect(files: DataFrame) -> DataFrame:
    """One row a match: rule (from 1), category, severity, file, line, column (from 0), description, snippet, confidence.
    What a row needs of a text is taken before matches become rows."""
    text, path = F.col("content"), F.col("path")
    context = contains_match(text, any_of(FS_CONTEXT)) & ~path.rlike(UI_FILE)

    def hits(k: int, rule: tuple[str, str, float, str, str]) -> Column:
        found = matches(text, rule[4])
        found = F.when(may_match(text, rule[4]) & context, found).otherwise(F.array().cast("array<struct<at:int,text:string>>")) if rule[3] == SENSITIVE_RULE else found
        return F.transform(found, lambda m: F.struct(F.lit(k).alias("rule"), m["at"].alias("at")))

    def shown(m: Column, ix: Column) -> Column:
        def of(s: Column) -> Column:
            width = s["end"] - s["start"]
            # of a long line, its beginning is as good as all of it, unless that is all white space
            head = trim_js(cut_at(ix, s["start"], F.least(width, F.lit(_HEAD))))
            line = bind(head, lambda x: F.when((width <= _HEAD) | (F.length(x) > 120), x).otherwise(trim_js(cut_at(ix, s["start"], width))))
            return F.struct(m["rule"].alias("rule"), s["line"].alias("line"), (m["at"] - s["start"]).alias("column"), truncate(line, 120).alias("snippet"))

        return bind(line_span(ix, m["at"]), of)

    found = bind(F.concat(*[hits(k, r) for k, r in enumerate(t.CODE_RULES, 1)]), lambda ms: F.when(F.size(ms) > 0, bind(indexed(text), lambda ix: F.transform(ms, lambda m: shown(m, ix)))))
    # an outer explode: of an inner one Spark infers a filter on the array's size and computes the array twice
    rows = files.select("pkg", "path", "is_fixture", F.posexplode_outer(found).alias("ord", "m")).filter("m IS NOT NULL")
    of = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in t.CODE_RULES]), F.col("m.rule"))
    return rows.select(
        "pkg",
        F.col("m.rule").alias("rule"),
        of(0).alias("category"),
        of(1).alias("severity"),
        path.alias("file"),
        F.col("m.line").alias("line"),
        F.col("m.column").alias("column"),
        of(3).alias("description"),
        F.col("m.snippet").alias("snippet"),
        F.when(F.col("is_fixture"), of(2) * t.FIXTURE_FACTOR).otherwise(of(2)).alias("confidence"),
        F.col("is_fixture").alias("is_test_fixture"),
        F.col("ord").cast("long").alias("ord"),
    )


def flagged_first(files: DataFrame, findings: DataFrame) -> DataFrame:
    """files with `flagged`: whether a rule fired in it; flagged files sort first."""
    flags = findings.select("pkg", F.col("file").alias("path")).distinct().withColumn("flagged", F.lit(True))
    return files.join(flags, ["pkg", "path"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
