"""Catalogue and result-store operations: priority union, filters, counts, pages, samples, badges, latest job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thornwick.functions import tables as t
from thornwick.functions.text import slug
from thornwick.operators.relations import keep_first
from thornwick.operators.scoring import grade

SORTS = {"score": "overall_score", "timestamp": "timestamp", "name": "package_name"}


def priority_union(sources: list[DataFrame], key: Column, order: list[Column]) -> DataFrame:
    """The union of sources, the first source's row of each key winning (then by order)."""
    rows = None
    for k, df in enumerate(sources):
        df = df.withColumn("source_rank", F.lit(k))
        rows = df if rows is None else rows.unionByName(df)
    return keep_first(rows, [key], [F.col("source_rank"), *order])


def browse(entries: DataFrame, category: str | None = None, source_prefix: str = "", needle: str = "") -> DataFrame:
    """Category equality, source prefix, and text in name, description or a tag, whatever the case."""
    out = entries
    if category and category != "all":
        out = out.filter(F.col("category") == category)
    if source_prefix:
        out = out.filter(F.col("source").startswith(source_prefix))
    if needle:
        has = lambda c: F.contains(F.lower(c), F.lit(needle.lower()))
        out = out.filter(has(F.col("name")) | has(F.coalesce("description", F.lit(""))) | F.exists("tags", has))
    return out


def page(rows: DataFrame, sort: str, key: str, descending: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of rows by a sort field, ties by key."""
    column = F.col(sort)
    return rows.orderBy(column.desc() if descending else column.asc(), key).offset(offset).limit(limit)


def clamped_page(number: int, limit: int) -> tuple[int, int]:
    return max(1, number), min(100, max(1, limit))


def counts_with_total(rows: DataFrame, by: str) -> DataFrame:
    """Counts by value, and of all."""
    counts = rows.groupBy(F.col(by).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(counts.agg(F.lit("all").alias("category"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def round_robin(results: DataFrame, key: str, limit: int = 8) -> DataFrame:
    """One of each grade in turn, newest first; the first `limit`. results: key, grade, timestamp."""
    turn = F.row_number().over(Window.partitionBy("grade").orderBy(F.desc("timestamp"), key))
    bucket = F.array_position(F.array(*[F.lit(g[0]) for g in t.GRADES]), F.col("grade"))
    return results.withColumn("turn", turn).filter(F.col("turn") <= limit).withColumn("bucket", bucket).orderBy("turn", "bucket").limit(limit)


def unscanned(found: DataFrame, done: DataFrame, name: str = "name", keep: str = "") -> DataFrame:
    """found without what done (name) has, by slug."""
    left = found.withColumn("__slug", slug(F.col(name), keep))
    right = done.select(slug(F.col(name), keep).alias("__slug")).distinct()
    return left.join(right, "__slug", "left_anti").drop("__slug")


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """rows whose key done has not: what an interrupted run has left to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def batch_request(requested: DataFrame, done: DataFrame, name: str = "name") -> DataFrame:
    """requested with its loose slug and whether it is queued (no result yet) or skipped."""
    left = requested.withColumn("slug", slug(F.col(name), "._"))
    right = done.select(slug(F.col(name), "._").alias("slug")).distinct().withColumn("__done", F.lit(True))
    return left.join(right, "slug", "left").withColumn("status", F.when(F.col("__done"), "skipped").otherwise("queued")).drop("__done")


def badges(entries: DataFrame, live: DataFrame, built: DataFrame, key: str) -> DataFrame:
    """entries with score: the live one, else the one of the last build."""
    return entries.join(live.select(key, F.col("score").alias("__live")), key, "left").join(built.select(key, F.col("score").alias("__built")), key, "left").withColumn("score", F.coalesce("__live", "__built")).drop("__live", "__built")


def read_through(keys: DataFrame, results: DataFrame, metas: DataFrame, key: str) -> DataFrame:
    """keys with the first of result, meta or not-found that there is."""
    found = keys.join(results.select(key).distinct().withColumn("__r", F.lit("result")), key, "left").join(metas.select(key).distinct().withColumn("__m", F.lit("meta")), key, "left")
    return found.withColumn("served", F.coalesce("__r", "__m", F.lit("not-found"))).drop("__r", "__m")


def latest(events: DataFrame, key: str, value: Column, order: Column) -> DataFrame:
    """Each key's value at its last event."""
    return events.groupBy(key).agg(F.max_by(value, order).alias("status"), F.max(order).alias("at"))


def seeded_sample(rows: DataFrame, key: str, day: str, n: int) -> DataFrame:
    """n rows by a multiplicative generator seeded with the day's characters, in key order: row i draws seed * 16807 ** (i + 1).

    The power is taken by squaring over the row number's bits, so every row's draw stands alone. The numbering needs the
    total order of keys; it runs over rows of a catalogue index, not over contents."""
    seed, modulus, factor = sum(map(ord, day)), 2147483647, 16807
    steps = F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(pow(factor, 1 << bit, modulus)).cast("long").alias("by")) for bit in range(40)])
    draw = F.aggregate(steps, F.lit(seed).cast("long"), lambda now, s: F.when(F.getbit(F.col("__i") + 1, s["bit"]) == 1, now * s["by"] % modulus).otherwise(now))
    numbered = rows.withColumn("__i", F.row_number().over(Window.orderBy(key)).cast("long") - 1)
    return numbered.withColumn("draw", draw).orderBy("draw", key).limit(n).drop("__i")


def meta(results: DataFrame) -> DataFrame:
    """A result's flat projection: findings and flows as counts, the grade from the score."""
    return results.select("slug", "package_name", "overall_score", grade(F.col("overall_score")).alias("grade"), (F.size("code_findings") + F.size("prompt_findings")).alias("findings_count"), F.size("taint_flows").alias("taint_flow_count"), "timestamp")


def compact(entries: DataFrame) -> DataFrame:
    return entries.select("name", F.substring("description", 1, 100).alias("description"), "category", "source", F.slice("tags", 1, 3).alias("tags"))


def slug_guesses(slug_column: Column) -> Column:
    """Package names that a slug may stand for: up to three scope and name cuts in two forms, then the slug itself."""
    parts = F.split(slug_column, "-")
    last = F.least(F.size(parts) - 1, F.lit(3))

    def cut(i: Column) -> Column:
        scope, rest = F.array_join(F.slice(parts, F.lit(1), i), "-"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "-")
        return F.array(F.concat(F.lit("@"), scope, F.lit("/"), rest), F.concat(scope, F.lit("/"), rest))

    cuts = F.when(last >= 1, F.flatten(F.transform(F.sequence(F.lit(1), last), cut))).otherwise(F.array().cast("array<string>"))
    return F.concat(cuts, F.array(slug_column))
