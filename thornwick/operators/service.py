"""What a scanning service asks of its tables: requests and their checks, listings, run counters, identifiers, typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thornwick.functions import tables as t
from thornwick.functions.text import slug
from thornwick.operators.prompts import rank
from thornwick.operators.scoring import grade

# Names of packages and repositories, bounds of submitted values.
PACKAGE_NAME = r"(?i)^(@[a-z0-9\-~][a-z0-9\-._~]*\/)?[a-z0-9\-~][a-z0-9\-._~]*\z"
REPOSITORY_NAME = r"^[a-zA-Z0-9_.-]+\/[a-zA-Z0-9_.-]+\z"
LONGEST_NAME, MOST_TAGS = 214, 10
SKILL_CATEGORIES = ("mcp-server", "claude-skill", "openclaw-tool", "cli-tool", "development", "devops", "data", "ai-ml", "other")
CODE_CATEGORIES = ("filesystem-access", "network-access", "env-access", "process-spawn", "crypto-usage", "obfuscation", "install-scripts", "dynamic-require")
PROMPT_CATEGORIES = ("instruction-override", "hidden-text", "data-exfiltration-prompt", "tool-abuse", "persona-hijack", "cot-manipulation", "delimiter-escape", "indirect-injection")


# --- checks ----------------------------------------------------------------------------------------------------------


def name_kind(name: Column) -> Column:
    """package, repository, or null for a name that is neither."""
    return F.when(name.rlike(PACKAGE_NAME), "package").when(name.rlike(REPOSITORY_NAME) & ~name.startswith("@"), "repository")


def _faults(checks: dict[str, Column]) -> Column:
    """The names of the checks that don't hold (a null doesn't)."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def finding_faults(prompt: bool = False) -> Column:
    """What of a finding (category, severity, file, line, column, description, snippet, confidence) is out of its range."""
    checks = {
        "category": F.col("category").isin(*(PROMPT_CATEGORIES if prompt else CODE_CATEGORIES)),
        "severity": F.col("severity").isin(*t.SEVERITIES),
        "file": F.col("file").isNotNull(),
        "line": F.col("line") >= 0,
        "column": F.col("column") >= 0,
        "description": F.col("description").isNotNull(),
        "snippet": F.col("snippet").isNotNull(),
        "confidence": F.col("confidence").between(0, 1),
    }
    return _faults(checks | ({"technique": F.col("technique").isNotNull()} if prompt else {}))


def submission_faults() -> Column:
    """What of a submission (package_name, category and tags, which may be null) is out of its range."""
    return _faults(
        {
            "package_name": F.length("package_name").between(1, LONGEST_NAME),
            "category": F.col("category").isNull() | F.col("category").isin(*SKILL_CATEGORIES),
            "tags": F.col("tags").isNull() | (F.size("tags") <= MOST_TAGS),
        }
    )


# --- requests, listings ----------------------------------------------------------------------------------------------


def identifier(*parts: Column, length: int = 21) -> Column:
    """An id of 21 characters that is the same for the same parts, so that a retry makes no second one."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat_ws("\x1f", *parts), 256))), "+/=", "-_"), 1, length)


def request_scan(requests: DataFrame, results: DataFrame, metas: DataFrame) -> DataFrame:
    """requests (request_id, package, rescan) with code (200, 202, 400), status, slug, served and, if queued, job_id: what has
    a result or else a scored meta (both by slug) is served, unless a rescan is asked for; the rest is queued once valid."""
    name = F.trim(F.coalesce("package", F.lit("")))
    asked = requests.withColumn("name", name).withColumn("slug", F.when(name_kind(name).isNotNull(), slug(name)))
    known = results.select("slug").distinct().withColumn("__r", F.lit("result"))
    scored = metas.filter("overall_score is not null").select("slug").distinct().withColumn("__m", F.lit("meta"))
    found = asked.join(known, "slug", "left").join(scored, "slug", "left")
    served = F.when(~F.coalesce("rescan", F.lit(False)), F.coalesce("__r", "__m"))
    status = F.when(F.col("name") == "", "missing").when(F.col("slug").isNull(), "invalid").when(served.isNotNull(), "completed").otherwise("queued")
    code = F.when(status.isin("missing", "invalid"), 400).when(status == "completed", 200).otherwise(202)
    job = F.when(status == "queued", identifier(F.col("request_id").cast("string"), F.col("slug")))
    return found.select("request_id", code.alias("code"), status.alias("status"), "slug", F.when(status == "completed", served).alias("served"), job.alias("job_id"))


def newest_badges(metas: DataFrame, most: int = 2000) -> DataFrame:
    """name, slug, score, grade, label, color of the newest `most` scans; of a name that comes twice the older one, as it is
    set last; scans without a name are skipped."""
    newest = metas.orderBy(F.desc("timestamp"), "slug").limit(most).filter("coalesce(package_name, '') <> ''")
    last = Window.partitionBy("package_name").orderBy("timestamp", F.desc("slug"))
    one = newest.withColumn("__n", F.row_number().over(last)).filter("__n = 1")
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for g in t.GRADES for x in (g[0], g[k])]), F.col("grade"))
    return one.select(F.col("package_name").alias("name"), "slug", F.col("overall_score").alias("score"), "grade", F.coalesce(of(2), "grade").alias("label"), F.coalesce(of(3), F.lit("#9ca3af")).alias("color"))


def with_total(page: DataFrame, rows: DataFrame) -> DataFrame:
    """A page's rows with how many rows there are in all."""
    return page.withColumn("total", rows.agg(F.count(F.lit(1))).scalar())


def category_counts(entries: DataFrame) -> DataFrame:
    """Entries by category, the most first."""
    return entries.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def union_distinct(first: DataFrame, *more: DataFrame, key: str = "name") -> DataFrame:
    """Distinct keys of all frames with the rank of the first frame that has them."""
    rows = None
    for k, df in enumerate((first, *more)):
        df = df.select(key).withColumn("source_rank", F.lit(k))
        rows = df if rows is None else rows.unionByName(df)
    return rows.groupBy(key).agg(F.min("source_rank").alias("source_rank"))


def combined(code: DataFrame, prompt: DataFrame, kind: str = "all") -> DataFrame:
    """Code and prompt findings in one list, by kind (all, code, prompt), with their place in it: severest first, code first
    where equal, then in order of finding."""
    rows = code.withColumn("kind", F.lit("code")).unionByName(prompt.withColumn("kind", F.lit("prompt")), allowMissingColumns=True)
    rows = rows if kind == "all" else rows.filter(F.col("kind") == kind)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("pkg").orderBy(F.desc(rank(F.col("severity"))), "kind", "ord")))


def slug_index(names: DataFrame, order: str) -> DataFrame:
    """slug and the name it stands for: the last by order of those that share it."""
    return names.groupBy(slug(F.col("name")).alias("slug")).agg(F.max_by("name", order).alias("name"))


# --- counters --------------------------------------------------------------------------------------------------------


def source_counts(found: DataFrame, known: DataFrame) -> DataFrame:
    """Per source: entries found, and those whose slug is not known yet."""
    rows = found.withColumn("slug", slug(F.col("name"))).join(known.select("slug").distinct().withColumn("__k", F.lit(True)), "slug", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("__k").isNull()).alias("new"))


def critical_findings(code: DataFrame, prompt: DataFrame) -> DataFrame:
    """pkg and description (else category) of every critical finding."""
    pick = lambda df: df.filter("severity = 'critical'").select("pkg", F.coalesce("description", "category").alias("description"))
    return pick(code).unionByName(pick(prompt))


def security_holders(code: DataFrame) -> DataFrame:
    """Packages that the registry removed for security reasons."""
    return code.filter(F.contains("description", F.lit("removed by npm for security reasons"))).select("pkg").distinct()


def run_counters(outcomes: DataFrame, known: int, limit: int) -> DataFrame:
    """One row of a run's counters. outcomes: a row a new package with place (what packages are ordered by, no two equal; a
    null comes last), success, requested (a pull request was made) and late (the time budget was over); packages after the
    first `limit` are deferred. Only these first ones are ordered, the rest is counted."""
    first = outcomes.orderBy(F.col("place").asc_nulls_last()).limit(limit)
    ran = ~F.col("late")
    run = first.agg(
        F.count_if(ran & F.col("success")).alias("scanned"),
        F.count_if(ran & ~F.col("success")).alias("failed"),
        F.count_if(ran & F.col("success") & F.col("requested")).alias("requests"),
        F.count_if(F.col("late")).alias("skipped"),
    )
    new = F.col("new")
    return outcomes.agg(F.count(F.lit(1)).alias("new")).crossJoin(run).select(new, "scanned", "failed", "requests", "skipped", (new - F.least(new, F.lit(limit))).alias("deferred"), (F.lit(known) + F.col("scanned")).alias("total"))


# --- typed values ----------------------------------------------------------------------------------------------------

VALUE = "struct<stringValue:string,integerValue:string,doubleValue:double,booleanValue:boolean,nullValue:string>"
FIELDS = f"map<string,{VALUE}>"


def encoded(df: DataFrame, columns: list[str]) -> Column:
    """A document of typed values (JSON): whole numbers as text, arrays and structs as JSON text, nulls named."""
    kinds = dict(df.dtypes)

    def of(name: str) -> Column:
        c, kind = F.col(name), kinds[name]
        whole = F.concat(F.lit('{"integerValue":"'), c.cast("decimal(38,0)").cast("string"), F.lit('"}'))
        if kind == "string":
            value = F.to_json(F.struct(c.alias("stringValue")))
        elif kind in ("tinyint", "smallint", "int", "bigint"):
            value = whole
        elif kind in ("float", "double") or kind.startswith("decimal"):
            value = F.when(c == F.floor(c), whole).otherwise(F.to_json(F.struct(c.cast("double").alias("doubleValue"))))
        elif kind == "boolean":
            value = F.to_json(F.struct(c.alias("booleanValue")))
        else:
            value = F.to_json(F.struct(F.to_json(c).alias("stringValue")))
        return F.concat(F.lit(f'"{name}":'), F.when(c.isNull(), '{"nullValue":null}').otherwise(value))

    return F.concat(F.lit("{"), F.concat_ws(",", *[of(c) for c in columns]), F.lit("}"))


def decoded(fields: Column, name: str) -> Column:
    """A field of such a document, as text (null if it is null, absent or of no known kind)."""
    v = F.from_json(fields, FIELDS)[name]
    return F.coalesce(v["stringValue"], v["integerValue"], v["doubleValue"].cast("string"), v["booleanValue"].cast("string"))


# --- texts of a result -----------------------------------------------------------------------------------------------


def label(score: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for g in t.GRADES for x in (g[0], g[2])]), grade(score))


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n != 1, "s").otherwise(""))


def page_description(name: Column, score: Column, findings: Column) -> Column:
    """The text that describes a result's page."""
    return F.concat(name, F.lit(" scored "), score.cast("string"), F.lit("/100 ("), label(score), F.lit("). "), counted(findings, "finding"), F.lit(" detected. Full security report: code analysis, prompt injection, taint tracking."))


def request_body(results: DataFrame, findings: DataFrame, url: str) -> DataFrame:
    """pkg and the Markdown body of a pull request: a table of the result and its five severest findings. results: pkg, slug,
    overall_score, code_score, content_score, taint_flows, files_scanned, duration (ms), package_type; findings: pkg,
    category, severity, description, file, line, is_test_fixture, ord."""
    counts = findings.groupBy("pkg").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    kinds = results.select("pkg", F.col("package_type").isin("cli-tool", "mcp-server").alias("tool"))
    shown = findings.join(kinds, "pkg").filter(~F.col("is_test_fixture") & ~(F.col("tool") & F.col("category").isin(*t.CLI_EXPECTED)))
    first = shown.withColumn("k", F.row_number().over(Window.partitionBy("pkg").orderBy(F.desc(rank(F.col("severity"))), "ord"))).filter("k <= 5")
    mark = F.element_at(F.create_map(*[F.lit(x) for kv in (("critical", "🔴"), ("high", "🟠"), ("medium", "🟡")) for x in kv]), F.col("severity"))
    line = F.format_string("- %s **%s**: %s (`%s:%d`)", F.coalesce(mark, F.lit("⚪")), "severity", "description", "file", "line")
    lines = first.groupBy("pkg").agg(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))).alias("x"))  # five at most
    rows = results.join(counts, "pkg", "left").join(lines, "pkg", "left").fillna(0, ["n", "critical", "high"])
    n = F.concat(counted(F.col("n"), "finding"), F.lit(" detected"), F.when(F.col("critical") > 0, F.format_string(" (%d critical)", "critical")).when(F.col("high") > 0, F.format_string(" (%d high)", "high")).otherwise(""))
    table = F.concat_ws(
        "\n",
        F.lit("## Security Scan Results\n\n| Metric | Value |\n|:-------|:------|"),
        F.format_string("| **Overall Score** | **%d/100** (%s) |\n| Code Score | %d/100 |\n| Content Score | %d/100 |", "overall_score", label(F.col("overall_score")), "code_score", "content_score"),
        F.format_string("| Findings | %s |\n| Taint Flows | %d |\n| Files Scanned | %d |\n| Scan Duration | %.1fs |", n, "taint_flows", "files_scanned", F.col("duration") / 1000),
    )
    kind = F.when(F.col("package_type") == "cli-tool", "a **CLI tool**").when(F.col("package_type") == "mcp-server", "an **MCP server**")
    note = F.concat(F.lit("> **Note:** This package is "), kind, F.lit(" — process, filesystem and environment access are expected and left out."))
    note = F.when(F.col("n") > 0, note)
    top = F.when(F.size("x") > 0, F.concat(F.lit("### Top Findings\n\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")))
    return rows.select("pkg", F.concat_ws("\n\n", table, note, top, F.concat(F.lit(f"[View full report]({url}/scan/"), "slug", F.lit(")"))).alias("body"))


def write_seed(entries: DataFrame, root: str, generated_at: str) -> None:
    """Writes a catalogue below root: sources/ (JSON lines by source), index/ (all entries), header/ (totals and counts by
    source, one row) and compact/ (n, d, c, s, t)."""
    rows = ["name", "description", "category", "source", "tags"]
    entries.select(*rows).write.partitionBy("source").json(f"{root}/sources")
    entries.select(*rows).write.json(f"{root}/index")
    counts = entries.groupBy("source").agg(F.count(F.lit(1)).alias("count"))
    header = counts.agg(F.lit(1).alias("version"), F.lit(generated_at).alias("generated_at"), F.sum("count").alias("total_entries"), F.sort_array(F.collect_list(F.struct(F.col("source").alias("name"), "count"))).alias("sources"))  # a row a source
    header.write.json(f"{root}/header")
    entries.select(F.col("name").alias("n"), F.substring("description", 1, 100).alias("d"), F.col("category").alias("c"), F.col("source").alias("s"), F.slice("tags", 1, 3).alias("t")).write.json(f"{root}/compact")
