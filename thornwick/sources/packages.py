"""Packages as tables of files, catalogue pages as entries."""

from __future__ import annotations

import io
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thornwick.functions import tables as t
from thornwick.functions.paths import is_fixture, is_priority
from thornwick.functions.text import java

FILES = "pkg string, path string, content string"


def directories(spark: SparkSession, root: str) -> DataFrame:
    """Files below root/<package>/: pkg, path, content."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_extract("path", r"^(?:[a-z0-9]+:)?/*" + _quoted(root) + r"/+(.*)$", 1)
    rows = read.select(below.alias("below"), F.decode("content", "UTF-8").alias("content"))
    return rows.select(F.substring_index("below", "/", 1).alias("pkg"), F.regexp_replace("below", "^[^/]*/", "").alias("path"), "content")


def _quoted(root: str) -> str:
    import re

    return re.escape(re.sub(r"^[a-z0-9]+:/*", "/", root).strip("/"))


def tarballs(spark: SparkSession, pattern: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """Members of .tgz archives, without their first path segment: pkg (the archive's name), path, content. An archive that
    can't be read gives what was read of it and a row of null content with the reason as its path."""

    def members(path: str, content: bytes) -> Iterator[tuple[str, str, str | None]]:
        name = path.rsplit("/", 1)[-1].removesuffix(".tgz").removesuffix(".tar.gz")
        try:
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                for member in archive:
                    if member.isfile():
                        yield name, member.name.partition("/")[2] or member.name, archive.extractfile(member).read().decode("utf-8", "replace")
        except (tarfile.TarError, EOFError, OSError, zlib.error) as e:
            yield name, f"!{type(e).__name__}", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, str | None]] = []
        size = 0
        send = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], ["pkg", "path", "content"])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for row in members(path, content.as_py()):
                    rows.append(row)
                    size += len(row[2] or "")
                    if size >= batch_bytes or len(rows) >= 4096:
                        yield send()
                        rows, size = [], 0
        if rows:
            yield send()

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(run, FILES)


def excluded(files: DataFrame, globs: list[str]) -> DataFrame:
    """files without those whose path matches a glob."""
    from thornwick.functions.text import glob_regex

    for g in globs:
        files = files.filter(~F.rlike(F.col("path"), glob_regex(F.lit(g))))
    return files


def flagged(files: DataFrame) -> DataFrame:
    """files with is_priority and is_fixture by path."""
    return files.withColumns({"is_priority": is_priority(F.col("path")), "is_fixture": is_fixture(F.col("path"))})


def ignore_rules(files: DataFrame, name: str = ".scanignore") -> DataFrame:
    """Rules of each package's ignore file: pkg, kind, category, pattern, source_pattern, sink_pattern."""
    from thornwick.functions.text import glob_regex, trim_js

    rows = files.filter(F.col("path") == name).select("pkg", F.explode(F.split("content", "\n")).alias("line"))
    rows = rows.withColumn("line", trim_js(F.regexp_replace("line", "#.*$", ""))).filter("line <> ''")
    file_rule, taint = F.col("line").startswith("file:"), F.col("line").startswith("taint:")
    kind = F.when(file_rule, "file").when(taint, "taint").when(F.contains("line", F.lit(":")), "category_pattern").otherwise("category")
    after = trim_js(F.regexp_replace("line", "^[^:]*:", ""))
    before = trim_js(F.substring_index("line", ":", 1))
    glob = lambda c: glob_regex(c)
    return rows.select(
        "pkg",
        kind.alias("kind"),
        F.when(kind.isin("category", "category_pattern"), before).alias("category"),
        F.when(kind.isin("file", "category_pattern"), glob(after)).alias("pattern"),
        F.when(taint, glob(trim_js(F.substring_index(after, "->", 1)))).alias("source_pattern"),
        F.when(taint, glob(trim_js(F.substring_index(after, "->", -1)))).alias("sink_pattern"),
    )


# --- catalogue pages -----------------------------------------------------------------------------------------------

ENTRY = ("name", "description", "repository_url", "category", "source", "tags")


def npm_category(text: Column) -> Column:
    has = lambda *xs: F.greatest(*[F.contains(text, F.lit(x)) for x in xs], F.lit(False))
    return F.when(has("mcp", "modelcontextprotocol"), "mcp-server").when(has("openclaw"), "openclaw").when(has("skill"), "claude-skill").otherwise("other")


def registry_pages(pages: DataFrame) -> DataFrame:
    """Search pages of a package registry (content JSON: objects[].package) as entries."""
    schema = "struct<objects:array<struct<package:struct<name:string,description:string,keywords:array<string>,links:struct<repository:string>>>>>"
    rows = pages.select(F.explode(F.from_json("content", schema)["objects"]).alias("o")).select("o.package.*")
    tags = F.coalesce("keywords", F.array().cast("array<string>"))
    text = F.lower(F.concat_ws(" ", "name", F.array_join(tags, " "), F.coalesce("description", F.lit(""))))
    return rows.select("name", F.substring(F.coalesce("description", F.lit("")), 1, 500).alias("description"), F.col("links.repository").alias("repository_url"), npm_category(text).alias("category"), F.lit("npm").alias("source"), F.slice(tags, 1, 10).alias("tags"))


def server_pages(pages: DataFrame, source: str = "registry") -> DataFrame:
    """Pages of a server registry (content JSON: servers[]) as entries; tags are the source, `verified`, and five tool names."""
    schema = "struct<servers:array<struct<qualifiedName:string,displayName:string,description:string,homepage:string,verified:boolean,tools:array<struct<name:string>>>>>"
    rows = pages.select(F.explode(F.from_json("content", schema)["servers"]).alias("s")).select("s.*")
    tools = F.slice(F.transform(F.coalesce("tools", F.array().cast("array<struct<name:string>>")), lambda x: x["name"]), 1, 5)
    tags = F.concat(F.array(F.lit(source)), F.when(F.coalesce("verified", F.lit(False)), F.array(F.lit("verified"))).otherwise(F.array().cast("array<string>")), tools)
    return rows.select(F.col("qualifiedName").alias("name"), F.substring(F.coalesce("description", F.lit("")), 1, 500).alias("description"), F.col("homepage").alias("repository_url"), F.lit("mcp-server").alias("category"), F.lit(source).alias("source"), tags.alias("tags"))


def refined_category(text: Column, default: Column) -> Column:
    """A repository's category by its topics, name and description (lower case), else the one it came with."""
    has = lambda *xs: F.greatest(*[F.contains(text, F.lit(x)) for x in xs], F.lit(False))
    return F.when(has("mcp-server", "mcp server", "model-context-protocol"), "mcp-server").when(has("claude-skill", "claude skill", "claude-code"), "claude-skill").when(has("openclaw"), "openclaw-tool").when(has("cli-tool", "cli tool"), "cli-tool").otherwise(default)


def once(entries: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first entry of each key by the given columns."""
    from thornwick.operators.relations import keep_first

    return keep_first(entries, [key], [F.col(c) for c in order])


#: The category of each topic searched for.
PAGE_TOPICS = (
    ("mcp-server", "mcp-server"), ("agent-skills", "other"), ("openclaw", "openclaw-tool"), ("claude-skill", "claude-skill"), ("claude-code-skill", "claude-skill"), ("model-context-protocol", "mcp-server"),
)


def topic_pages(pages: DataFrame) -> DataFrame:
    """Repository search pages (topic, content JSON: items[]) as entries; a repository's topics, name and description refine its
    topic's category (other, of a topic not in PAGE_TOPICS)."""
    schema = "struct<items:array<struct<full_name:string,description:string,html_url:string,language:string,topics:array<string>>>>"
    rows = pages.select("topic", F.explode(F.from_json("content", schema)["items"]).alias("i")).select("topic", "i.*")
    others = F.slice(F.array_remove(F.coalesce("topics", F.array().cast("array<string>")), F.col("topic")), 1, 5)
    tags = F.concat(F.array("topic"), F.when(F.col("language").isNotNull(), F.array(F.lower("language"))).otherwise(F.array().cast("array<string>")), others)
    named = F.substring_index("full_name", "/", -1)
    text = F.lower(F.concat_ws(" ", F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " "), named, F.coalesce("description", F.lit(""))))
    default = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PAGE_TOPICS for x in kv]), F.col("topic")), F.lit("other"))
    return rows.select(F.col("full_name").alias("name"), F.substring(F.coalesce("description", F.lit("")), 1, 500).alias("description"), F.col("html_url").alias("repository_url"), refined_category(text, default).alias("category"), F.concat(F.lit("github-topic:"), "topic").alias("source"), tags.alias("tags"))


# References in curated lists.
LIST_LINK = r"\[([^\]]+)\]\(https?:\/\/github\.com\/([\w.-]+\/[\w.-]+)"
LIST_PACKAGE = r"https?:\/\/(?:www\.)?npmjs\.com\/package\/((?:@[\w.-]+\/)?[\w.-]+)"
LIST_RUN = r"npx\s+(?:-y\s+)?((?:@[\w.-]+\/)?[\w.-]+)"


def curated_lists(lists: DataFrame) -> DataFrame:
    """Entries that markdown lists (list_no, source, content) name: links to repositories, then packages, then run commands;
    a name's first mention counts."""
    from thornwick.operators.relations import keep_first

    parts = []
    for kind, pattern in enumerate((LIST_LINK, LIST_PACKAGE, LIST_RUN)):
        found = F.regexp_extract_all("content", F.lit(java(pattern)), F.lit(0))
        rows = lists.select("list_no", "source", F.lit(kind).alias("kind"), F.posexplode(found).alias("pos", "m"))
        group = lambda k, p=pattern: F.regexp_extract("m", java(p), k)
        if kind == 0:
            shown, repository = group(1), group(2)
            name = F.when(shown.rlike(r"^(@[a-z0-9-]+/)?[a-z0-9][a-z0-9._-]*$"), shown).otherwise(F.lower(F.element_at(F.split(repository, "/"), -1)))
            rows = rows.withColumns({"name": name, "repository_url": F.concat(F.lit("https://github.com/"), repository)})
        else:
            rows = rows.withColumns({"name": group(1), "repository_url": F.lit(None).cast("string")})
        parts.append(rows)
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return keep_first(rows, [F.col("name")], [F.col("list_no"), F.col("kind"), F.col("pos")]).select("name", "repository_url", "source", "list_no", "kind", "pos")


# --- discovery: all sources in one list -----------------------------------------------------------------------------

# Categories of topics, references in lists.
TOPICS = (
    ("mcp-server", "mcp-server"), ("claude-skill", "claude-skill"), ("claude-code-skill", "claude-skill"), ("openclaw", "openclaw-tool"), ("agent-skills", "other"), ("model-context-protocol", "mcp-server"),
    ("mcp-tools", "mcp-server"), ("claude-code", "claude-skill"),
)
FOUND_REPOSITORY = r"\[([^\]]+)\]\(https?:\/\/github\.com\/([a-zA-Z0-9_.-]+\/[a-zA-Z0-9_.-]+)\/?(?:[#?][^\)]*)?\)"
FOUND_PACKAGE = r"(?:npx|npm install|npm i)\s+(@?[a-z0-9\-._~]+(?:\/[a-z0-9\-._~]+)?)"
FOUND_CHARS = 200


def discovered_topics(pages: DataFrame) -> DataFrame:
    """Repositories of search pages (topic, page, content JSON: items[]), in order of topic and page."""
    items = pages.select("topic", "page", F.posexplode(F.from_json("content", "struct<items:array<struct<full_name:string,description:string>>>")["items"]).alias("pos", "i"))
    names = F.array(*[F.lit(x) for x, _ in TOPICS])
    category = F.element_at(F.create_map(*[F.lit(x) for kv in TOPICS for x in kv]), F.col("topic"))
    return _discovered(items, F.col("i.full_name"), F.concat(F.lit("github-topic:"), "topic"), True, F.col("i.description"), F.coalesce(category, F.lit("other")), F.array_position(names, F.col("topic")).cast("int"), F.col("page"), F.col("pos"))


def discovered_lists(lists: DataFrame) -> DataFrame:
    """Repositories, then packages, that markdown lists (list_no, source, content) name."""
    parts = []
    for kind, (pattern, flags) in enumerate(((FOUND_REPOSITORY, ""), (FOUND_PACKAGE, "i"))):
        found = F.regexp_extract_all("content", F.lit(java(pattern, flags)), F.lit(0))
        rows = lists.select("list_no", "source", F.posexplode(found).alias("pos", "m"))
        group = lambda k, p=java(pattern, flags): F.regexp_extract("m", p, k)
        name, said = (group(2), group(1)) if kind == 0 else (group(1), F.lit(""))
        parts.append(_discovered(rows, name, F.concat(F.lit("github-list:"), "source"), kind == 0, said, F.lit("mcp-server"), F.col("list_no"), F.lit(kind), F.col("pos")))
    return parts[0].unionByName(parts[1])


def discovered_packages(pages: DataFrame) -> DataFrame:
    """Packages of registry pages (keyword_no, keyword, page, content JSON: objects[].package)."""
    schema = "struct<objects:array<struct<package:struct<name:string,description:string,keywords:array<string>>>>>"
    rows = pages.select("keyword_no", "keyword", "page", F.posexplode(F.from_json("content", schema)["objects"]).alias("pos", "o"))
    text = F.lower(F.concat(F.col("o.package.name"), F.lit(" "), F.coalesce(F.array_join("o.package.keywords", " "), F.lit(""))))
    has = lambda *xs: F.greatest(*[F.contains(text, F.lit(x)) for x in xs], F.lit(False))
    category = F.when(has("mcp", "model-context-protocol"), "mcp-server").when(has("claude-skill", "claude-code"), "claude-skill").when(has("openclaw"), "openclaw-tool").otherwise("other")
    return _discovered(rows, F.col("o.package.name"), F.concat(F.lit("npm:"), "keyword"), False, F.col("o.package.description"), category, F.col("keyword_no"), F.col("page"), F.col("pos"))


def discovered_servers(pages: DataFrame, source: str) -> DataFrame:
    """Servers of a registry's pages (page, content JSON: servers[])."""
    rows = pages.select("page", F.posexplode(F.from_json("content", "struct<servers:array<struct<qualifiedName:string,description:string>>>")["servers"]).alias("pos", "s"))
    return _discovered(rows, F.col("s.qualifiedName"), F.lit(source), False, F.col("s.description"), F.lit("mcp-server"), F.lit(0), F.col("page"), F.col("pos"))


def _discovered(rows: DataFrame, name: Column, source: Column, is_repository: bool, said: Column, category: Column, *order: Column) -> DataFrame:
    described = F.substring(F.coalesce(said, F.lit("")), 1, FOUND_CHARS)
    return rows.select(name.alias("name"), source.alias("source"), F.lit(is_repository).alias("is_repository"), described.alias("description"), category.alias("category"), *[c.cast("int").alias(f"o{k}") for k, c in enumerate(order, 1)])


def discovered(*sources: DataFrame) -> DataFrame:
    """All sources' findings, the first of each name whatever its case; earlier sources first."""
    rows = None
    for k, df in enumerate(sources):
        df = df.withColumn("o0", F.lit(k))
        rows = df if rows is None else rows.unionByName(df)
    return once(rows, F.lower("name"), "o0", "o1", "o2", "o3").drop("o0", "o1", "o2", "o3")


def marketplace_index(spark: SparkSession, path: str, source: str | None = None, first: int | None = None) -> DataFrame:
    """A compact index (JSON array of n, d, c, s, t); the first rows of it, by name, if asked for."""
    rows = spark.read.schema("n string, d string, c string, s string, t array<string>").option("multiLine", True).json(path)
    rows = rows.toDF("name", "description", "category", "source", "tags")
    rows = rows.filter(F.col("source") == source) if source else rows
    return rows.orderBy("name").limit(first) if first is not None else rows


def has_readme(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path").isin(*t.README_NAMES)).select("pkg").distinct()
