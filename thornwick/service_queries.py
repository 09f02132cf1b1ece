"""Registered queries of the service operators, discovery and the store, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thornwick.functions import tables as t
from thornwick.functions import text
from thornwick.operators import catalog, prompts, relations, service
from thornwick.queries import CODE_CATEGORIES, GRADE, MULT, PROMPT_CATEGORIES, RANK, SLUG, event_findings, findings_sql, pick, pick_sql, query, quoted, read, values  # noqa: F401
from thornwick.sources import packages

NAMES = ("left-pad", "@scope/pkg.x", "owner/Repo_1", "Bad Name!", "@x/y/z", "", "a/b.c", "UPPER~case")
REQUESTS_SQL = f"""q AS (SELECT o_orderkey AS request_id, {pick_sql(NAMES, 'o_orderkey')} || CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 50 AS VARCHAR) ELSE '' END AS package, o_orderkey % 7 = 0 AS rescan FROM orders),
 k AS (SELECT *, CASE WHEN regexp_matches(package, '(?i)^(@[a-z0-9~-][a-z0-9._~-]*/)?[a-z0-9~-][a-z0-9._~-]*$') THEN 'package' WHEN regexp_matches(package, '^[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+$') AND NOT starts_with(package, '@') THEN 'repository' END AS kind FROM q)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(pick(NAMES, k), F.when(k % 3 == 0, (k % 50).cast("string")).otherwise(""))
    return read(spark, sf_dir, "orders").select(k.alias("request_id"), name.alias("package"), (k % 7 == 0).alias("rescan"))


@query(f"WITH {REQUESTS_SQL} SELECT package, kind, count(*) AS n FROM k GROUP BY ALL")
def request_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).groupBy("package", service.name_kind(F.col("package")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


RESULTS_SQL = f"r AS (SELECT DISTINCT {SLUG % ('package', '')} AS slug FROM k WHERE kind IS NOT NULL AND request_id % 5 = 0), m AS (SELECT DISTINCT {SLUG % ('package', '')} AS slug FROM k WHERE kind IS NOT NULL AND request_id % 11 = 0)"


@query(
    f"""WITH {REQUESTS_SQL}, {RESULTS_SQL}, s AS (SELECT *, CASE WHEN kind IS NOT NULL THEN {SLUG % ('package', '')} END AS slug FROM k),
 u AS (SELECT *, CASE WHEN rescan THEN NULL WHEN slug IN (SELECT slug FROM r) THEN 'result' WHEN slug IN (SELECT slug FROM m) THEN 'meta' END AS served FROM s)
 SELECT request_id, CASE WHEN package = '' OR kind IS NULL THEN 400 WHEN served IS NULL THEN 202 ELSE 200 END AS code, CASE WHEN package = '' THEN 'missing' WHEN kind IS NULL THEN 'invalid' WHEN served IS NULL THEN 'queued' ELSE 'completed' END AS status, slug, served,
 CASE WHEN package <> '' AND kind IS NOT NULL AND served IS NULL THEN substr(replace(replace(replace(to_base64(unhex(sha256(CAST(request_id AS VARCHAR) || chr(31) || slug))), '+', '-'), '/', '_'), '=', ''), 1, 21) END AS job_id FROM u"""
)
def request_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir)
    named = r.filter(service.name_kind(F.col("package")).isNotNull()).withColumn("slug", text.slug(F.col("package")))
    metas = named.filter("request_id % 11 = 0").select("slug", F.lit(1).alias("overall_score"))
    return service.request_scan(r, named.filter("request_id % 5 = 0").select("slug"), metas)


METAS_SQL = f"""m AS (SELECT CAST(o_orderkey AS VARCHAR) AS slug, CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE 'p' || CAST(o_custkey AS VARCHAR) END AS package_name, o_orderkey * 7 % 101 AS score, o_orderdate AS ts FROM orders)"""


def metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    score = k * 7 % 101
    from thornwick.operators.scoring import grade

    return read(spark, sf_dir, "orders").select(k.cast("string").alias("slug"), F.when(k % 40 != 0, F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).alias("package_name"), score.alias("overall_score"), grade(score).alias("grade"), F.col("o_orderdate").alias("timestamp"))


@query(
    f"""WITH {METAS_SQL}, n AS (SELECT * FROM m ORDER BY ts DESC, slug LIMIT 2000), o AS (SELECT *, row_number() OVER (PARTITION BY package_name ORDER BY ts, slug DESC) AS rn FROM n WHERE package_name IS NOT NULL)
 SELECT package_name AS name, slug, score, {GRADE} AS grade, CASE WHEN score >= 90 THEN 'Verified Safe' WHEN score >= 70 THEN 'Passes with Notes' WHEN score >= 40 THEN 'Use with Caution' ELSE 'Blocked' END AS label,
 CASE WHEN score >= 90 THEN '#4caf50' WHEN score >= 70 THEN '#ffc107' WHEN score >= 40 THEN '#ff9800' ELSE '#f44336' END AS color FROM o WHERE rn = 1"""
)
def newest_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.newest_badges(metas(spark, sf_dir))


@query(f"WITH {METAS_SQL} SELECT slug, score AS overall_score, (SELECT count(*) FROM m) AS total FROM m ORDER BY score DESC, slug LIMIT 50 OFFSET 50")
def list_meta_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metas(spark, sf_dir)
    return service.with_total(catalog.page(rows, "overall_score", "slug", True, 50, 50), rows).select("slug", "overall_score", "total")


@query("SELECT p_brand AS category, count(*) AS n FROM part GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.category_counts(read(spark, sf_dir, "part").select(F.col("p_brand").alias("category")))


@query("SELECT name, min(k) AS source_rank FROM (SELECT lower(c_mktsegment) AS name, 0 AS k FROM customer UNION ALL SELECT lower(p_type), 1 FROM part UNION ALL SELECT lower(c_mktsegment) || 'x', 2 FROM customer) GROUP BY 1")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = read(spark, sf_dir, "customer"), read(spark, sf_dir, "part")
    segment = F.lower("c_mktsegment")
    return service.union_distinct(c.select(segment.alias("name")), p.select(F.lower("p_type").alias("name")), c.select(F.concat(segment, F.lit("x")).alias("name")))


@query(f"WITH {findings_sql()}, a AS (SELECT pkg, ord, severity, CASE WHEN ord % 3 = 0 THEN 'prompt' ELSE 'code' END AS kind FROM f) SELECT pkg, ord, kind, row_number() OVER (PARTITION BY pkg ORDER BY {RANK} DESC, kind, ord) AS place FROM a")
def combined_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_findings(spark, sf_dir)
    return service.combined(f.filter("ord % 3 <> 0"), f.filter("ord % 3 = 0")).select("pkg", "ord", "kind", F.col("place").cast("long").alias("place"))


@query(f"SELECT slug, arg_max(name, id) AS name FROM (SELECT p_partkey AS id, p_name AS name, {SLUG % ('p_name', '')} AS slug FROM part) GROUP BY 1")
def slug_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.slug_index(read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_partkey"), "p_partkey")


@query(f"WITH a AS (SELECT p_type AS source, p_partkey, {SLUG % ('p_name', '')} AS slug FROM part) SELECT source, count(*) AS found, count(*) FILTER (slug NOT IN (SELECT slug FROM a WHERE p_partkey % 3 = 0)) AS new FROM a GROUP BY 1")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    known = p.filter("p_partkey % 3 = 0").select(text.slug(F.col("p_name")).alias("slug"))
    return service.source_counts(p.select(F.col("p_name").alias("name"), F.col("p_type").alias("source")), known)


HOLDER = "Package removed by npm for security reasons"


@query(f"WITH {findings_sql()}, a AS (SELECT pkg, severity, CASE WHEN ord % 97 = 0 THEN '{HOLDER}' WHEN ord % 2 = 0 THEN description END AS d, category FROM f) SELECT pkg, coalesce(d, category) AS description, count(*) AS n FROM a WHERE severity = 'critical' GROUP BY ALL")
def critical_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _told(spark, sf_dir)
    return service.critical_findings(f.filter("ord % 3 <> 0"), f.filter("ord % 3 = 0")).groupBy("pkg", "description").agg(F.count(F.lit(1)).alias("n"))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_findings(spark, sf_dir).withColumn("description", F.when(F.col("ord") % 97 == 0, HOLDER).when(F.col("ord") % 2 == 0, F.col("description")))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS pkg FROM events WHERE event_id % 97 = 0")
def security_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.security_holders(_told(spark, sf_dir))


@query(
    """WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS place, o_orderstatus <> 'F' AS success, o_orderkey % 9 = 0 AS requested, o_orderkey % 4 = 3 AS late FROM orders), b AS (SELECT *, place <= 1000 AND NOT late AS ran FROM a)
 SELECT count(*) AS "new", count(*) FILTER (ran AND success) AS scanned, count(*) FILTER (ran AND NOT success) AS failed, count(*) FILTER (ran AND success AND requested) AS requests, count(*) FILTER (place <= 1000 AND late) AS skipped, count(*) FILTER (place > 1000) AS deferred, 77 + count(*) FILTER (ran AND success) AS total FROM b"""
)
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(k.alias("place"), (F.col("o_orderstatus") != "F").alias("success"), (k % 9 == 0).alias("requested"), (k % 4 == 3).alias("late"))
    return service.run_counters(rows, 77, 1000)


@query(
    """SELECT p_partkey, '{"name":' || '{"stringValue":"' || p_name || '"},"size":{"integerValue":"' || CAST(p_size AS VARCHAR) || '"},"even":{"booleanValue":' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || '},"half":' ||
 CASE WHEN p_partkey % 5 = 0 THEN '{"nullValue":null}' WHEN p_size % 2 = 0 THEN '{"integerValue":"' || CAST(p_size // 2 AS VARCHAR) || '"}' ELSE '{"doubleValue":' || CAST(p_size / 2 AS VARCHAR) || '}' END || ',"tags":{"stringValue":"[\\"' || p_brand || '\\"]"}}' AS document, p_name AS name, CASE WHEN p_partkey % 5 <> 0 THEN p_size / 2 END AS half FROM part"""
)
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(k, F.col("p_name").alias("name"), F.col("p_size").alias("size"), (k % 2 == 0).alias("even"), F.when(k % 5 != 0, F.col("p_size") / 2).alias("half"), F.array("p_brand").alias("tags"))
    rows = rows.select("p_partkey", service.encoded(rows, ["name", "size", "even", "half", "tags"]).alias("document"))
    return rows.select("p_partkey", "document", service.decoded(F.col("document"), "name").alias("name"), service.decoded(F.col("document"), "half").cast("double").alias("half"))


@query(
    f"""SELECT p_partkey, p_name || ' scored ' || CAST(score AS VARCHAR) || '/100 (' || CASE WHEN score >= 90 THEN 'Verified Safe' WHEN score >= 70 THEN 'Passes with Notes' WHEN score >= 40 THEN 'Use with Caution' ELSE 'Blocked' END || '). ' || CAST(p_size % 4 AS VARCHAR) || ' finding' || CASE WHEN p_size % 4 = 1 THEN '' ELSE 's' END
 || ' detected. Full security report: code analysis, prompt injection, taint tracking.' AS description FROM (SELECT *, p_partkey % 101 AS score FROM part)"""
)
def page_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", service.page_description(F.col("p_name"), F.col("p_partkey") % 101, F.col("p_size") % 4).alias("description"))


@query(
    f"""WITH {findings_sql()}, r AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS pkg, user_id % 101 AS score, ['cli-tool', 'mcp-server', 'library'][user_id % 3 + 1] AS kind FROM events),
 c AS (SELECT pkg, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM f GROUP BY 1),
 s AS (SELECT f.*, row_number() OVER (PARTITION BY pkg ORDER BY {RANK} DESC, ord) AS k FROM f JOIN r USING (pkg) WHERE NOT is_test_fixture AND NOT (kind <> 'library' AND category IN {t.CLI_EXPECTED})),
 x AS (SELECT pkg, string_agg('- ' || CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' ELSE '⚪' END || ' **' || severity || '**: ' || description || ' (`' || file || ':' || CAST(line AS VARCHAR) || '`)', chr(10) ORDER BY k) AS lines FROM s WHERE k <= 5 GROUP BY 1)
 SELECT pkg, '## Security Scan Results' || chr(10) || chr(10) || '| Metric | Value |' || chr(10) || '|:-------|:------|' || chr(10) || '| **Overall Score** | **' || CAST(score AS VARCHAR) || '/100** (' || CASE WHEN score >= 90 THEN 'Verified Safe' WHEN score >= 70 THEN 'Passes with Notes' WHEN score >= 40 THEN 'Use with Caution' ELSE 'Blocked' END || ') |' || chr(10)
 || '| Code Score | 80/100 |' || chr(10) || '| Content Score | 90/100 |' || chr(10) || '| Findings | ' || CAST(n AS VARCHAR) || ' finding' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' detected' || CASE WHEN critical > 0 THEN ' (' || CAST(critical AS VARCHAR) || ' critical)' WHEN high > 0 THEN ' (' || CAST(high AS VARCHAR) || ' high)' ELSE '' END || ' |' || chr(10)
 || '| Taint Flows | 2 |' || chr(10) || '| Files Scanned | 3 |' || chr(10) || '| Scan Duration | 1.5s |' || CASE kind WHEN 'cli-tool' THEN chr(10) || chr(10) || '> **Note:** This package is a **CLI tool** — process, filesystem and environment access are expected and left out.' WHEN 'mcp-server' THEN chr(10) || chr(10) || '> **Note:** This package is an **MCP server** — process, filesystem and environment access are expected and left out.' ELSE '' END
 || CASE WHEN lines IS NULL THEN '' ELSE chr(10) || chr(10) || '### Top Findings' || chr(10) || chr(10) || lines END || chr(10) || chr(10) || '[View full report](https://example.org/scan/s' || pkg || ')' AS body FROM r JOIN c USING (pkg) LEFT JOIN x USING (pkg)"""
)
def request_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_findings(spark, sf_dir)
    n = F.col("pkg").cast("long")
    results = f.select("pkg").distinct().select("pkg", F.concat(F.lit("s"), "pkg").alias("slug"), (n % 101).cast("int").alias("overall_score"), F.lit(80).alias("code_score"), F.lit(90).alias("content_score"), F.lit(2).alias("taint_flows"), F.lit(3).alias("files_scanned"), F.lit(1500).alias("duration"), pick(("cli-tool", "mcp-server", "library"), n).alias("package_type"))
    return service.request_body(results, f, "https://example.org")


TOPIC_NAMES = ("mcp-server", "claude-code", "unknown")


@query(
    f"""WITH d AS (SELECT p_partkey AS id, {pick_sql(TOPIC_NAMES, 'p_partkey')} AS topic, p_brand || '/' || p_name AS name, p_type AS said FROM part),
 s AS (SELECT s_suppkey AS id, upper(p_brand || '/' || p_name) AS name FROM supplier JOIN part ON p_partkey = s_suppkey * 2 UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier),
 a AS (SELECT 0 AS k, CASE topic WHEN 'mcp-server' THEN 1 WHEN 'claude-code' THEN 8 ELSE 0 END AS o1, id AS o2, name, 'github-topic:' || topic AS source, true AS is_repository, substr(said, 1, 200) AS description, CASE topic WHEN 'mcp-server' THEN 'mcp-server' WHEN 'claude-code' THEN 'claude-skill' ELSE 'other' END AS category FROM d
 UNION ALL SELECT 1, 0, id, name, 'servers', false, '', 'mcp-server' FROM s)
 SELECT name, source, is_repository, description, category FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY k, o1, o2) AS rn FROM a) WHERE rn = 1"""
)
def discovered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    repository = F.concat("p_brand", F.lit("/"), "p_name")
    items = F.to_json(F.struct(F.array(F.struct(repository.alias("full_name"), F.col("p_type").alias("description"))).alias("items")))
    topics = p.select(pick(TOPIC_NAMES, F.col("p_partkey")).alias("topic"), F.col("p_partkey").alias("page"), items.alias("content"))
    shared = s.join(p, F.col("p_partkey") == F.col("s_suppkey") * 2).select(F.col("s_suppkey").alias("page"), F.upper(repository).alias("n"))
    own = s.select((F.col("s_suppkey") + 1000000).alias("page"), F.col("s_name").alias("n"))
    servers = shared.unionByName(own).select("page", F.to_json(F.struct(F.array(F.struct(F.col("n").alias("qualifiedName"))).alias("servers"))).alias("content"))
    return packages.discovered(packages.discovered_topics(topics), packages.discovered_servers(servers, "servers"))


@query(
    f"""SELECT doc_id FROM (SELECT doc_id, {pick_sql(('tests/', 'src/', 'lib/sub/', 'docs/', 'scripts/'), 'doc_id')} || {pick_sql(('a.js', 'b.ts', 'README.md'), 'doc_id // 5')} AS path FROM documents) WHERE NOT regexp_matches(path, '(?i)^tests/.*$') AND NOT regexp_matches(path, '(?i)^[^/]*/[^/]*\\.md$')"""
)
def excluded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    path = F.concat(pick(("tests/", "src/", "lib/sub/", "docs/", "scripts/"), k), pick(("a.js", "b.ts", "README.md"), F.floor(k / 5)))
    return packages.excluded(read(spark, sf_dir, "documents").select("doc_id", path.alias("path")), ["tests/**", "*/*.md"]).select("doc_id")


@query("SELECT p_partkey, CASE WHEN contains(x, 'mcp-server') THEN 'mcp-server' WHEN contains(x, 'claude-code') THEN 'claude-skill' WHEN contains(x, 'openclaw') THEN 'openclaw-tool' WHEN contains(x, 'cli tool') THEN 'cli-tool' ELSE p_type END AS category FROM (SELECT p_partkey, p_type, lower(p_name || ' ' || ['An MCP-server', 'a claude-code add-on', 'OpenClaw part', 'CLI tool', 'none'][p_partkey % 5 + 1]) AS x FROM part)")
def refined_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = pick(("An MCP-server", "a claude-code add-on", "OpenClaw part", "CLI tool", "none"), F.col("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey", packages.refined_category(F.lower(F.concat("p_name", F.lit(" "), said)), F.col("p_type")).alias("category"))


@query(f"WITH {findings_sql()} SELECT pkg, ord, list_transform(list_filter([CASE WHEN confidence + (ord % 3) * 0.2 > 1 THEN 'confidence' END, CASE WHEN line - ord % 5 < 0 THEN 'line' END, CASE WHEN ord % 13 = 0 THEN 'severity' END], lambda x: x IS NOT NULL), lambda x: x).list_sort()::VARCHAR AS faults FROM f")
def finding_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_findings(spark, sf_dir).withColumns({"confidence": F.col("confidence") + (F.col("ord") % 3) * 0.2, "line": F.col("line") - F.col("ord") % 5, "severity": F.when(F.col("ord") % 13 != 0, F.col("severity")).otherwise("grave")})
    return f.select("pkg", "ord", F.concat(F.lit("["), F.array_join(F.sort_array(service.finding_faults()), ", "), F.lit("]")).alias("faults"))


_PAGE_TOPICS = tuple(x for x, _ in packages.PAGE_TOPICS) + ("unknown",)
_REPOSITORY_TOPICS = ("model-context-protocol", "claude-code", "tools", "openclaw", "cli-tool")


@query(
    f"""SELECT 'o/' || p_name AS name, CASE WHEN contains(x, 'mcp-server') OR contains(x, 'mcp server') OR contains(x, 'model-context-protocol') THEN 'mcp-server' WHEN contains(x, 'claude-skill') OR contains(x, 'claude skill') OR contains(x, 'claude-code') THEN 'claude-skill' WHEN contains(x, 'openclaw') THEN 'openclaw-tool'
 WHEN contains(x, 'cli-tool') OR contains(x, 'cli tool') THEN 'cli-tool' WHEN topic IN ('mcp-server', 'model-context-protocol') THEN 'mcp-server' WHEN topic = 'openclaw' THEN 'openclaw-tool' WHEN topic IN ('claude-skill', 'claude-code-skill') THEN 'claude-skill' ELSE 'other' END AS category,
 'github-topic:' || topic AS source, topic || ',go' || CASE WHEN t = topic THEN '' ELSE ',' || t END AS tags FROM (SELECT p_name, topic, t, lower(t || ' ' || p_name || ' ' || p_type) AS x FROM (SELECT *, {pick_sql(_PAGE_TOPICS, 'p_partkey')} AS topic, {pick_sql(_REPOSITORY_TOPICS, 'p_partkey // 2')} AS t FROM part))"""
)
def topic_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a repository on a search page of a topic."""
    k = F.col("p_partkey")
    item = F.struct(F.concat(F.lit("o/"), "p_name").alias("full_name"), F.col("p_type").alias("description"), F.lit("Go").alias("language"), F.array(pick(_REPOSITORY_TOPICS, F.floor(k / 2))).alias("topics"))
    pages = read(spark, sf_dir, "part").select(pick(_PAGE_TOPICS, k).alias("topic"), F.to_json(F.struct(F.array(item).alias("items"))).alias("content"))
    return packages.topic_pages(pages).select("name", "category", "source", F.array_join("tags", ",").alias("tags"))
