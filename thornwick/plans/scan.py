"""The scan of many packages at once: files to findings, flows, mismatches, permissions and scores, one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thornwick.functions.tables import SCRIPT_KEYS
from thornwick.functions.paths import is_code, is_content
from thornwick.operators import code_facts, code_rules, manifest, permissions, prompts, relations, scoring
from thornwick.plans.stages import kept
from thornwick.sources.packages import flagged, has_readme, ignore_rules


@dataclass
class Scan:
    findings: DataFrame
    prompt_findings: DataFrame
    flows: DataFrame
    mismatches: DataFrame
    permissions: DataFrame
    scores: DataFrame


LAYERS = ("pattern", "manifest", "dependency", "ast")


def scan(files: DataFrame, manifest_name: str = "skill-manifest.json", ignore_name: str = ".scanignore") -> Scan:
    """files: pkg, path, content, of any number of packages."""
    spark = files.sparkSession
    files = flagged(files)
    code = code_rules.capped(code_rules.scanned_files(files.filter(is_code(F.col("path")))))
    content = files.filter(is_content(F.col("path"))).select("pkg", "path", "content", "is_priority", "is_fixture", F.lit("file").alias("source"))
    content = content.unionByName(prompts.embedded_prompts(files.filter(F.col("path").rlike(r"\.(ts|js|mjs|cjs)$") & ~F.col("path").rlike(r"\.d\.ts$"))))
    rules = ignore_rules(files, ignore_name)
    manifests = kept(manifest.facts(files.filter(F.col("path") == "package.json")))
    found = kept(code_facts.facts(code))

    shape = lambda df, layer: df.select("pkg", "category", "severity", F.coalesce("file", F.lit("package.json")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("column", F.lit(0)).alias("column"), "description", F.coalesce("snippet", F.lit("")).alias("snippet"), "confidence", F.coalesce("is_test_fixture", F.lit(False)).alias("is_test_fixture"), F.lit(LAYERS.index(layer)).alias("layer"), F.col("ord").cast("long").alias("ord"))
    blank = {"file": F.lit("package.json"), "line": F.lit(0), "column": F.lit(0), "is_test_fixture": F.lit(False)}
    audits = manifest.audit_findings(files.filter(F.col("path") == "audit.json"))
    vulnerable = audits.select("pkg", F.lit("dynamic-require").alias("category"), "severity", F.concat(F.lit("Known vulnerability in dependency: "), "name").alias("description"), F.lit("").alias("snippet"), F.lit(1.0).alias("confidence"), F.lit(2).cast("long").alias("ord"))
    layers = (
        shape(code_rules.detect(code), "pattern")
        .unionByName(shape(manifest.findings(manifests, has_readme(files)).withColumns(blank), "manifest"))
        .unionByName(shape(manifest.dependency_findings(manifests, spark).unionByName(vulnerable).withColumns(blank), "dependency"))
        .unionByName(shape(code_facts.detect(found), "ast"))
    )
    findings = relations.ignored(layers, rules)
    # a total order: layer, file, line, column, then the rule's own
    place = F.row_number().over(Window.partitionBy("pkg").orderBy("layer", "file", "line", "column", "ord", "description"))
    findings = kept(findings.withColumn("ord", place.cast("long")))
    told = relations.ignored(prompts.deduplicated(prompts.detect(content)), rules)
    told = kept(prompts.in_order(told))

    sources, sinks = code_facts.taint_sources(found), code_facts.taint_sinks(found)
    flows = relations.taint_flows(sources, sinks).unionByName(relations.environment_flows(code_facts.environment_accesses(found), sinks))
    flows = flows.select("pkg", F.col("file").alias("source_file"), F.col("file").alias("sink_file"), "source_type", "source_line", "source_description", "sink_type", "sink_line", "severity", F.lit(0).alias("layer"))
    across = relations.cross_file_flows(sources, sinks, code_facts.file_imports(found))
    flows = flows.unionByName(across.select("pkg", "source_file", "sink_file", "source_type", "source_line", F.concat("source_type", F.lit("() call (cross-file)")).alias("source_description"), "sink_type", "sink_line", "severity", F.lit(1).alias("layer")))
    drop = rules.filter("kind = 'taint'").alias("r")
    flows = flows.alias("f").join(drop, (F.col("f.pkg") == F.col("r.pkg")) & F.rlike(F.col("f.source_type"), F.col("r.source_pattern")) & F.rlike(F.col("f.sink_type"), F.col("r.sink_pattern")), "left_anti")
    left_out = rules.filter("kind = 'file'").alias("r")
    named = F.rlike(F.col("f.source_file"), F.col("r.pattern")) | F.rlike(F.col("f.sink_file"), F.col("r.pattern"))
    flows = flows.alias("f").join(left_out, (F.col("f.pkg") == F.col("r.pkg")) & named, "left_anti")
    turn = F.row_number().over(Window.partitionBy("pkg").orderBy("layer", "source_file", "sink_file", "source_line", "sink_line", "source_type", "sink_type"))
    flows = kept(flows.withColumn("ord", turn.cast("long")))

    wrong = relations.mismatches(relations.claims(content), findings, told)
    wrong = wrong.withColumn("ord", F.row_number().over(Window.partitionBy("pkg").orderBy("content_file", "content_line", "code_file", "code_line", "description")).cast("long"))

    counts = code.groupBy("pkg").agg(F.count(F.lit(1)).alias("files_scanned"))
    texts = content.groupBy("pkg").agg(F.count(F.lit(1)).alias("content_files_scanned"))
    own = files.filter(F.col("path") == manifest_name).select("pkg").distinct().withColumn("has_manifest", F.lit(True))
    kind = manifest.package_type(F.col("name"), F.col("description"), F.col("keywords"), F.col("bin") != "", F.col("dependencies"), F.col("valid"))
    about = manifests.select("pkg", "has_repository", "has_types", kind.alias("package_type"), manifest.dependency_count(F.col("dependencies"), F.col("dev_dependencies")).alias("dependency_count"), F.exists(F.map_keys("scripts"), lambda k: k.isin(*SCRIPT_KEYS)).alias("has_install_scripts"))
    meta = files.select("pkg").distinct().join(counts, "pkg", "left").join(texts, "pkg", "left").join(own, "pkg", "left").join(has_readme(files).withColumn("has_readme", F.lit(True)), "pkg", "left").join(about, "pkg", "left")
    meta = meta.fillna({"files_scanned": 0, "content_files_scanned": 0, "has_manifest": False, "has_readme": False, "has_repository": False, "has_types": False, "package_type": "unknown", "dependency_count": 0, "has_install_scripts": False})
    empty = meta.filter("files_scanned = 0").select("pkg", F.lit("obfuscation").alias("category"), F.lit("medium").alias("severity"), F.lit("package.json").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("column"), F.lit("No source files could be scanned (inconclusive)").alias("description"), F.lit("").alias("snippet"), F.lit(1.0).alias("confidence"), F.lit(False).alias("is_test_fixture"), F.lit(4).alias("layer"), F.lit(1 << 40).alias("ord"))
    scored = findings.unionByName(empty)
    return Scan(scored, told, flows, wrong, permissions.manifest(findings), scoring.score(meta, scored, told, flows, wrong))
