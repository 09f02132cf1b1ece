"""Joins and rankings over findings: keep-first and keep-best, taint flows, claims, look-alike names, anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thornwick.functions import tables as t
from thornwick.functions.paths import dirname, resolve, without_extension
from thornwick.functions.text import contains_match, trim_js
from thornwick.operators.prompts import rank


def keep_first(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def severity_of(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in t.SEVERITIES]), n + 1)


def combined_severity(a: Column, b: Column) -> Column:
    """Critical if both are high at least, else the higher one."""
    x, y = rank(a), rank(b)
    return F.when((x >= 3) & (y >= 3), "critical").otherwise(severity_of(F.greatest(x, y).cast("int")))


def taint_flows(sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """sources and sinks: pkg, file, line, column, type, severity, description. A source reaches every sink of its file that
    stands on its line or below."""
    s = sources.select("pkg", "file", *[F.col(c).alias(f"source_{c}") for c in ("type", "line", "column", "severity", "description")])
    k = sinks.select("pkg", "file", *[F.col(c).alias(f"sink_{c}") for c in ("type", "line", "column", "severity", "description")])
    return s.join(k, ["pkg", "file"]).filter(F.col("source_line") <= F.col("sink_line")).withColumn("severity", combined_severity(F.col("source_severity"), F.col("sink_severity")))


def environment_flows(accesses: DataFrame, sinks: DataFrame) -> DataFrame:
    """accesses: pkg, file, line, column, variable, is_bulk. Sensitive variables, and bulk reads, reach sinks below."""
    sensitive = F.when(F.coalesce(F.col("variable"), F.lit("")) != "", F.col("variable").isin(*t.SENSITIVE_VARIABLES)).otherwise(F.col("is_bulk"))
    said = F.when(F.coalesce(F.col("variable"), F.lit("")) != "", F.concat(F.lit("Reads sensitive env var: "), "variable")).otherwise("Bulk access to process.env")
    sources = accesses.filter(sensitive).select("pkg", "file", "line", "column", F.lit("process.env").alias("type"), F.lit("critical").alias("severity"), said.alias("description"))
    return taint_flows(sources, sinks).withColumn("severity", F.lit("critical"))


def with_steps(flows: DataFrame, calls: DataFrame) -> DataFrame:
    """Adds steps: encoding calls of the file strictly between source and sink, in call order (calls: pkg, file, pos, line, expression)."""
    encoding = calls.filter(contains_match(F.col("expression"), t.ENCODING_CALL)).groupBy("pkg", "file").agg(F.sort_array(F.collect_list(F.struct("pos", "line", "expression"))).alias("__calls"))
    between = F.filter(F.col("__calls"), lambda c: (c["line"] > F.col("source_line")) & (c["line"] < F.col("sink_line")))
    steps = F.transform(between, lambda c: F.struct(F.concat(F.lit("Data transformation: "), c["expression"]).alias("description"), c["line"].alias("line")))
    return flows.join(encoding, ["pkg", "file"], "left").withColumn("steps", F.coalesce(steps, F.array().cast("array<struct<description:string,line:int>>"))).drop("__calls")


def cross_file_flows(sources: DataFrame, sinks: DataFrame, imports: DataFrame) -> DataFrame:
    """A file with sinks that imports, by relative path, a file with sources (imports: pkg, file, module, line); always critical."""
    target = without_extension(resolve(dirname(F.col("file")), F.col("module")))
    links = imports.filter(F.col("module").startswith(".")).select("pkg", F.col("file").alias("sink_file"), F.col("line").alias("import_line"), F.explode(F.array(target, F.concat(target, F.lit("/index")))).alias("key"))
    from_files = sources.select("pkg", F.col("file").alias("source_file"), without_extension(F.col("file")).alias("key"), F.col("type").alias("source_type"), F.col("line").alias("source_line"))
    to_files = sinks.select("pkg", F.col("file").alias("sink_file"), F.col("type").alias("sink_type"), F.col("line").alias("sink_line"))
    return links.join(from_files, ["pkg", "key"]).filter(F.col("source_file") != F.col("sink_file")).join(to_files, ["pkg", "sink_file"]).withColumn("severity", F.lit("critical")).drop("key")


def claims(files: DataFrame) -> DataFrame:
    """What content files say of themselves, line by line: pkg, file, line, capability, snippet."""
    lines = files.select("pkg", F.col("path").alias("file"), F.posexplode(F.split("content", "\n", -1)).alias("pos", "text"))
    found = F.array_compact(F.array(*[F.when(contains_match(F.col("text"), p, "i"), F.struct(F.lit(k).alias("k"), F.lit(c).alias("capability"))) for k, (c, p) in enumerate(t.CLAIMS)]))
    rows = lines.select("pkg", "file", (F.col("pos") + 1).alias("line"), "text", F.explode(found).alias("c"))
    return rows.select("pkg", "file", "line", F.col("c.k").alias("k"), F.col("c.capability").alias("capability"), F.substring(trim_js(F.col("text")), 1, 120).alias("snippet"))


def first_capabilities(findings: DataFrame) -> DataFrame:
    """The first finding of medium severity or more of each category and file."""
    return keep_first(findings.filter(rank(F.col("severity")) >= 2), [F.col("pkg"), F.col("category"), F.col("file")], [F.col("ord")])


def contradictions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(t.CONTRADICTIONS), "category string, capability string")


def mismatches(claimed: DataFrame, findings: DataFrame, prompt_findings: DataFrame) -> DataFrame:
    """Claims that code findings contradict, and safety claims beside severe prompt findings."""
    caps = first_capabilities(findings).select("pkg", "category", F.col("file").alias("code_file"), F.col("line").alias("code_line"), F.col("description").alias("does"))
    reads = findings.filter((F.col("category") == "filesystem-access") & F.col("severity").isin("high", "critical")).select("pkg").distinct().withColumn("reads", F.lit(True))
    both = claimed.join(F.broadcast(contradictions(claimed.sparkSession)), "capability").join(caps, ["pkg", "category"]).join(reads, "pkg", "left")  # six fixed rows
    severity = F.when((F.col("category") == "process-spawn") | (F.col("category") == "network-access") & F.coalesce("reads", F.lit(False)), "critical").otherwise("high")
    said = F.concat(F.lit('Content claims "'), "capability", F.lit('" but code contains '), "category", F.lit(" operations"))
    one = both.select("pkg", F.col("file").alias("content_file"), F.col("line").alias("content_line"), "code_file", "code_line", severity.alias("severity"), said.alias("description"))
    severe = prompt_findings.filter(F.col("severity").isin("high", "critical")).select("pkg").distinct()
    safe = claimed.filter(F.col("capability").isin("safe-claim", "privacy-claim")).join(severe, "pkg", "left_semi")
    told = F.concat(F.lit('Claims to be "'), "capability", F.lit('" but contains prompt injection patterns'))
    two = safe.select("pkg", F.col("file").alias("content_file"), F.col("line").alias("content_line"), F.col("file").alias("code_file"), F.col("line").alias("code_line"), F.lit("critical").alias("severity"), told.alias("description"))
    return one.unionByName(two)


def base_name(name: Column) -> Column:
    """A package's name without its scope."""
    return F.when(name.startswith("@"), F.coalesce(F.try_element_at(F.split(name, "/"), F.lit(2)), name)).otherwise(name)


def deletion_forms(name: Column) -> Column:
    """name and what is left of it when one character is left out, each once. Two names one edit apart share such a form:
    both without the character that differs, or the shorter name, which is the longer one without a character."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(name)), lambda k: F.concat(F.substring(name, 1, k - 1), F.substring(name, k + 1, F.length(name))))
    return F.when(F.length(name) > 0, F.array_distinct(F.concat(F.array(name), shorter))).otherwise(F.array(name))


def look_alike_candidates(bases: DataFrame, popular: DataFrame) -> DataFrame:
    """Pairs (base, popular), each once, that share a form: those one edit apart, equal ones, and some two apart. Forms are
    joined by their hash, so that a base meets only what is near it, not all names of its length."""
    form = lambda c: F.explode(F.transform(deletion_forms(F.col(c)), lambda x: F.xxhash64(x))).alias("form")
    left = bases.select("base").distinct().select("base", form("base"))
    right = popular.select("popular").distinct().select("popular", form("popular"))
    return left.join(right, "form").select("base", "popular").distinct()


def look_alikes(names: DataFrame, popular: DataFrame, least: int = 3) -> DataFrame:
    """Rows of names one edit from a popular one (scope left out): names' columns, base, popular. Each name is compared once,
    however many rows have it; rows that repeat all stay."""
    left = names.withColumn("base", base_name(F.col("name"))).filter(F.length("base") >= least)
    pairs = look_alike_candidates(left, popular).filter(F.levenshtein("base", "popular", 1) == 1)
    return left.join(pairs, "base").select(*names.columns, "base", "popular")


def ignored(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """findings without those that a rule (pkg, kind, category, pattern) drops: by category, by file glob, or by category and
    description glob. pattern is a regular expression (see glob_regex)."""
    f, r = findings.alias("f"), rules.alias("r")
    same = F.col("f.pkg") == F.col("r.pkg")
    drop = (
        (F.col("r.kind") == "category") & (F.col("f.category") == F.col("r.category"))
        | (F.col("r.kind") == "file") & F.rlike(F.col("f.file"), F.col("r.pattern"))
        | (F.col("r.kind") == "category_pattern") & (F.col("f.category") == F.col("r.category")) & F.rlike(F.col("f.description"), F.col("r.pattern"))
    )
    return f.join(r, same & drop, "left_anti")


def expected_filtered(findings: DataFrame, package_type: Column) -> DataFrame:
    """findings without the categories that a command-line tool or a tool server is expected to have."""
    drop = (package_type == "cli-tool") & F.col("category").isin(*t.CLI_EXPECTED) | (package_type == "mcp-server") & F.col("category").isin(*t.MCP_EXPECTED)
    return findings.filter(~F.coalesce(drop, F.lit(False)))


def tool_taint_filtered(flows: DataFrame, package_type: Column) -> DataFrame:
    """flows without a tool package's own reads of files (but keys) and of variables that it sends with requests."""
    own = F.contains(F.col("source_description"), F.lit("readFile"))
    for x in (".ssh", ".aws", ".gnupg"):
        own = own & ~F.contains(F.col("source_description"), F.lit(x))
    sent = (F.col("source_type") == "process.env") & ~F.contains(F.col("source_description"), F.lit("Bulk")) & F.col("sink_type").rlike("^(fetch|http|https|axios|got|request)")
    return flows.filter(~(package_type.isin("cli-tool", "mcp-server") & (own | sent)))
