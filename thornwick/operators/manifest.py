"""Package manifests (JSON): findings, facts for the score, package type, dependencies and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thornwick.functions import tables as t
from thornwick.functions.text import any_of, contains_match, java
from thornwick.operators.relations import look_alikes

FINDING = "struct<category:string,severity:string,description:string,snippet:string,confidence:double>"


def _get(path: str) -> Column:
    return F.get_json_object("content", path)


def _map(path: str) -> Column:
    return F.coalesce(F.from_json(_get(path), "map<string,string>"), F.create_map().cast("map<string,string>"))


def facts(manifests: DataFrame) -> DataFrame:
    """pkg and the manifest's fields (content is its JSON); valid is false where it is none."""
    repository = F.coalesce(_get("$.repository.url"), _get("$.repository"), F.lit(""))
    binary = F.coalesce(_get("$.bin"), F.lit(""))
    return manifests.select(
        "pkg",
        F.coalesce(_get("$").startswith("{"), F.lit(False)).alias("valid"),
        F.coalesce(_get("$.name"), F.lit("")).alias("name"),
        F.coalesce(_get("$.version"), F.lit("")).alias("version"),
        F.coalesce(_get("$.description"), F.lit("")).alias("description"),
        F.coalesce(F.from_json(_get("$.keywords"), "array<string>"), F.array().cast("array<string>")).alias("keywords"),
        repository.alias("repository"),
        (repository != "").alias("has_repository"),
        ((F.coalesce(_get("$.types"), F.lit("")) != "") | (F.coalesce(_get("$.typings"), F.lit("")) != "")).alias("has_types"),
        binary.alias("bin"),
        F.when(binary == "", 0).when(binary.startswith("{"), F.coalesce(F.size(F.json_object_keys(binary)), F.lit(0))).otherwise(1).alias("n_bin"),
        _map("$.scripts").alias("scripts"),
        _map("$.dependencies").alias("dependencies"),
        _map("$.devDependencies").alias("dev_dependencies"),
    )


def script_severity(script: Column) -> Column:
    return F.when(script.rlike("|".join(java(p) for p in t.DANGEROUS_SCRIPTS)), "critical").when(contains_match(script, any_of(t.BENIGN_SCRIPTS)), "info").otherwise("high")


def is_security_holder(description: Column, version: Column, repository: Column) -> Column:
    return F.contains(F.lower(description), F.lit("security holding package")) | version.endswith("-security") | (repository == "npm/security-holder")


def findings(found: DataFrame, readmes: DataFrame) -> DataFrame:
    """Findings of valid manifests (facts) in order: placeholder, scripts, many executables, no repository, no readme (readmes: pkg)."""

    def row(when: Column, category: str, severity: Column | str, description: Column, snippet: Column | str, confidence: float) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.when(when, F.struct(F.lit(category).alias("category"), lit(severity).alias("severity"), description.alias("description"), lit(snippet).alias("snippet"), F.lit(confidence).alias("confidence")))

    scripts = []
    for key in t.SCRIPT_KEYS:
        s = F.coalesce(F.element_at("scripts", key), F.lit(""))
        said = F.when(script_severity(s) == "critical", F.concat(F.lit(f'{key} script downloads/executes remote code: "'), s, F.lit('"'))).when(script_severity(s) == "info", F.concat(F.lit(f'Has {key} script (benign): "'), s, F.lit('"'))).otherwise(F.concat(F.lit(f'Has {key} script: "'), s, F.lit('"')))
        scripts.append(row(s != "", "install-scripts", script_severity(s), said, F.concat(F.lit(f'"{key}": "'), s, F.lit('"')), 1.0))
    rows = found.filter("valid").join(readmes.select("pkg").distinct().withColumn("has_readme", F.lit(True)), "pkg", "left")
    holder = is_security_holder(F.col("description"), F.col("version"), F.col("repository"))
    all_rows = F.array(
        row(holder, "install-scripts", "critical", F.concat(F.lit("This package was removed by npm for security reasons and replaced with a placeholder (version: "), "version", F.lit(")")), F.concat(F.lit('"description": "'), "description", F.lit('"')), 1.0),
        *scripts,
        row(F.col("n_bin") > 5, "install-scripts", "medium", F.concat(F.lit("Declares "), F.col("n_bin").cast("string"), F.lit(" binary executables (unusually high)")), F.substring("bin", 1, 120), 0.6),
        row(~F.col("has_repository"), "install-scripts", "low", F.lit("No repository URL in package.json (reduced transparency)"), "", 0.8),
        row(F.col("has_readme").isNull(), "install-scripts", "low", F.lit("No README file (reduced transparency)"), "", 0.8),
    )
    return rows.select("pkg", F.posexplode(F.array_compact(all_rows.cast(f"array<{FINDING}>"))).alias("ord", "f")).select("pkg", F.col("ord").cast("long").alias("ord"), "f.*")


def package_type(name: Column, description: Column, keywords: Column, has_bin: Column, dependencies: Column, valid: Column) -> Column:
    """mcp-server, cli-tool, skill or library by the first sign that holds; unknown without a manifest."""
    name, description = F.lower(name), F.lower(description)
    words = F.transform(keywords, F.lower)
    text = F.concat_ws(" ", name, description, F.array_join(words, " "))
    has = lambda names: F.exists(words, lambda k: k.isin(*names))
    depends = lambda names: F.greatest(*[(F.coalesce(F.element_at(dependencies, x), F.lit("")) != "") for x in names])
    says = lambda x: F.contains(text, F.lit(x))
    return (
        F.when(~valid, "unknown")
        .when(depends(t.MCP_DEPENDENCIES) | has(t.MCP_KEYWORDS) | contains_match(text, r"\bmcp\s+server\b") | name.rlike(r"-mcp(\z|-)|^mcp-"), "mcp-server")
        .when(has_bin | has(t.CLI_KEYWORDS) | (says("cli") & (says("tool") | says("command"))) | depends(t.CLI_DEPENDENCIES), "cli-tool")
        .when(has(t.SKILL_KEYWORDS) | (says("skill") & (says("claude") | says("ai"))), "skill")
        .otherwise("library")
    )


def dependency_count(dependencies: Column, dev_dependencies: Column) -> Column:
    return F.size(F.array_union(F.map_keys(dependencies), F.map_keys(dev_dependencies)))


def dependency_findings(found: DataFrame, spark: SparkSession) -> DataFrame:
    """Look-alike dependency names, then a warning of more than 50 dependencies: pkg, ord, and a finding's fields."""
    popular = spark.createDataFrame([(x,) for x in t.POPULAR_PACKAGES], "popular string")
    names = found.select("pkg", F.explode(F.array_union(F.map_keys("dependencies"), F.map_keys("dev_dependencies"))).alias("name"))
    alike = look_alikes(names, popular)
    said = F.concat(F.lit('Dependency "'), "name", F.lit('" is suspiciously similar to popular package "'), "popular", F.lit('" (possible typosquatting)'))
    one = alike.select("pkg", F.lit(0).cast("long").alias("ord"), F.lit("dynamic-require").alias("category"), F.lit("high").alias("severity"), said.alias("description"), F.lit("").alias("snippet"), F.lit(0.75).alias("confidence"))
    n = dependency_count(F.col("dependencies"), F.col("dev_dependencies"))
    many = F.concat(F.lit("High dependency count: "), n.cast("string"), F.lit(" (increases supply chain attack surface)"))
    two = found.filter(n > 50).select("pkg", F.lit(1).cast("long").alias("ord"), F.lit("dynamic-require").alias("category"), F.lit("medium").alias("severity"), many.alias("description"), F.lit("").alias("snippet"), F.lit(0.7).alias("confidence"))
    return one.unionByName(two)


def audit_findings(audits: DataFrame) -> DataFrame:
    """audits (pkg, content: an audit's JSON) as findings: pkg, name, severity."""
    vulnerable = F.from_json("content", "struct<vulnerabilities:map<string,struct<severity:string>>>")["vulnerabilities"]
    rows = audits.select("pkg", F.explode(vulnerable).alias("name", "v"))
    severity = F.when(F.col("v.severity") == "moderate", "medium").when(F.col("v.severity").isin("critical", "high", "low", "info"), F.col("v.severity")).otherwise("low")
    return rows.select("pkg", "name", severity.alias("severity"))
