"""Scores: diminishing deductions over distinct findings, caps, and the overall score.

A package's findings are in a total order (ord); the first of each key counts, the i-th of them by rate / (1 + i / 2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thornwick.functions import tables as t


def multiplier(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in t.MULTIPLIER.items() for x in kv]), severity)


def grade(score: Column) -> Column:
    out = F.lit("blocked")
    for name, least, _, _ in reversed(t.GRADES[:3]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def diminishing(findings: DataFrame, key: Column, maximum: float, rate: float, weight: Column, name: str, by: str = "pkg") -> DataFrame:
    """by, name: maximum less the diminishing deductions of the first finding of each key, at least 0."""
    kept = findings.withColumn("__k", key).withColumn("__w", weight)
    kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy(by, "__k").orderBy("ord"))).filter("__n = 1")
    place = F.row_number().over(Window.partitionBy(by).orderBy("ord")) - 1
    kept = kept.withColumn("__d", F.lit(maximum) * (F.lit(rate) / (1 + place * 0.5)) * F.col("__w"))
    return kept.groupBy(by).agg(F.greatest(F.lit(0.0), F.lit(maximum) - F.sum("__d")).alias(name))


def data_flow(flows: DataFrame) -> DataFrame:
    return diminishing(flows, F.concat_ws("→", "source_type", "sink_type"), t.WEIGHTS["data_flow"], 0.30, multiplier(F.col("severity")), "data_flow")


def prompt(findings: DataFrame) -> DataFrame:
    return diminishing(findings, F.concat_ws(":", "category", "file"), t.WEIGHTS["prompt"], 0.20, multiplier(F.col("severity")) * F.col("confidence"), "prompt")


def dangerous(findings: DataFrame) -> DataFrame:
    some = findings.filter(F.col("category").isin("process-spawn", "install-scripts", "obfuscation"))
    return diminishing(some, F.concat_ws(":", "category", "file"), t.WEIGHTS["dangerous"], 0.20, multiplier(F.col("severity")) * F.col("confidence"), "dangerous")


def mismatch(rows: DataFrame) -> DataFrame:
    return diminishing(rows, F.col("description"), t.WEIGHTS["mismatch"], 0.25, multiplier(F.col("severity")), "mismatch")


def network(findings: DataFrame) -> DataFrame:
    some = findings.filter(F.col("category") == "network-access")
    return diminishing(some, F.concat_ws(":", "description", "file"), t.WEIGHTS["network"], 0.15, multiplier(F.col("severity")) * F.col("confidence"), "network")


def dependency(findings: DataFrame, meta: DataFrame) -> DataFrame:
    """pkg, dependency: deductions of dependency findings, of many dependencies and of install scripts (meta)."""
    most = t.WEIGHTS["dependency"]
    some = findings.filter((F.col("category") == "dynamic-require") & F.contains(F.col("description"), F.lit("dependency")))
    place = F.row_number().over(Window.partitionBy("pkg").orderBy("ord")) - 1
    lost = some.withColumn("__d", F.lit(most * 0.15) / (1 + place * 0.5) * multiplier(F.col("severity"))).groupBy("pkg").agg(F.sum("__d").alias("__d"))
    many = F.when(F.col("dependency_count") > 100, most * 0.2).when(F.col("dependency_count") > 50, most * 0.1).otherwise(0.0)
    scripts = F.when(F.col("has_install_scripts"), most * 0.15).otherwise(0.0)
    return meta.join(lost, "pkg", "left").select("pkg", F.greatest(F.lit(0.0), F.lit(most) - F.coalesce("__d", F.lit(0.0)) - many - scripts).alias("dependency"))


def transparency(meta: DataFrame) -> DataFrame:
    flags = [F.col(c).cast("int") for c in ("has_manifest", "has_readme", "has_repository", "has_types")]
    n = flags[0] + flags[1] + flags[2] + flags[3]
    return meta.select("pkg", ((n + (n == 4).cast("int")) * (t.WEIGHTS["transparency"] / 5)).alias("transparency"))


def quality(findings: DataFrame) -> DataFrame:
    most = t.WEIGHTS["quality"]
    some = findings.filter(F.col("category").isin("obfuscation", "dynamic-require"))
    return some.groupBy("pkg").agg(F.greatest(F.lit(0.0), F.lit(most) - F.sum(F.lit(most * 0.25) * multiplier(F.col("severity")))).alias("quality"))


PARTS = tuple(t.WEIGHTS)


def overall(parts: DataFrame) -> DataFrame:
    """Adds overall_score, code_score, content_score and grade to rows that hold the eight parts and the facts for caps:
    critical_prompts, critical_taints, is_tool, critical_vulnerabilities, security_holder, files_scanned."""
    c, p, x = t.CAPS, F.col("critical_prompts"), F.col("critical_taints")
    total = F.col(PARTS[0])
    for part in PARTS[1:]:
        total = total + F.col(part)
    free = F.lit(100)
    score = F.least(
        half_up(total),
        F.when(p >= 2, c["prompts"]).when(p == 1, c["prompt"]).otherwise(free),
        F.when(~F.col("is_tool") & (x >= 1), c["taint"]).otherwise(free),
        F.when((p >= 1) & (x >= 1), c["both"]).otherwise(free),
        F.when(F.col("critical_vulnerabilities") >= 1, c["vulnerability"]).otherwise(free),
        F.when(F.col("security_holder"), c["holder"]).otherwise(free),
        F.when(F.col("files_scanned") == 0, c["no_files"]).otherwise(free),
    )
    of = lambda name, points: F.col(name) / t.WEIGHTS[name] * points
    code = half_up(of("dangerous", 25) + of("data_flow", 25) + of("network", 20) + of("dependency", 15) + of("quality", 15))
    content = half_up(of("prompt", 50) + of("mismatch", 30) + of("transparency", 20))
    clamp = lambda v: F.least(F.lit(100), F.greatest(F.lit(0), v))
    return (
        parts.withColumn("overall_score", clamp(score).cast("int"))
        .withColumn("code_score", F.least(clamp(code), F.when(F.col("files_scanned") == 0, c["no_files"]).otherwise(free)).cast("int"))
        .withColumn("content_score", clamp(content).cast("int"))
        .withColumn("grade", grade(F.col("overall_score")))
    )


def score(meta: DataFrame, findings: DataFrame, prompt_findings: DataFrame, flows: DataFrame, mismatch_rows: DataFrame) -> DataFrame:
    """One row a package of meta (pkg, package_type, files_scanned, dependency_count, has_*): the parts and the scores."""
    from thornwick.operators.relations import expected_filtered, tool_taint_filtered

    kinds = meta.select("pkg", "package_type")
    seen = expected_filtered(findings.join(kinds, "pkg", "left"), F.col("package_type")).drop("package_type")
    kept_flows = tool_taint_filtered(flows.join(kinds, "pkg", "left"), F.coalesce("package_type", F.lit("unknown"))).drop("package_type")
    rows = meta
    for part in (data_flow(kept_flows), prompt(prompt_findings), dangerous(seen), mismatch(mismatch_rows), network(seen), dependency(findings, meta), transparency(meta), quality(seen)):
        rows = rows.join(part, "pkg", "left")
    rows = rows.fillna({k: v for k, v in t.WEIGHTS.items()})
    severe = prompt_findings.filter((F.col("severity") == "critical") & (F.col("confidence") >= 0.8) & ~F.col("is_test_fixture")).groupBy("pkg").agg(F.count(F.lit(1)).alias("critical_prompts"))
    taints = kept_flows.filter(F.col("severity") == "critical").groupBy("pkg").agg(F.count(F.lit(1)).alias("critical_taints"))
    facts = findings.groupBy("pkg").agg(
        F.count_if((F.col("category") == "dynamic-require") & F.contains(F.col("description"), F.lit("vulnerability")) & F.col("severity").isin("critical", "high")).alias("critical_vulnerabilities"),
        F.max(F.contains(F.col("description"), F.lit("removed by npm for security reasons"))).alias("security_holder"),
    )
    for side in (severe, taints, facts):
        rows = rows.join(side, "pkg", "left")
    rows = rows.fillna({"critical_prompts": 0, "critical_taints": 0, "critical_vulnerabilities": 0, "security_holder": False})
    return overall(rows.withColumn("is_tool", F.col("package_type").isin("cli-tool", "mcp-server")))


def severity_counts(findings: DataFrame, severities: tuple[str, ...] = ("critical", "high", "medium")) -> DataFrame:
    """How many findings of each severity a package has."""
    return findings.groupBy("pkg").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in severities])
