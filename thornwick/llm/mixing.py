"""Mixing sources to target weights by hash-threshold histograms.

Each source gets whole copies of all its documents (its target over its size, rounded down) and, for the rest of its
target, one more copy of those documents whose hash lies under a threshold. Words are summed by source and hash bucket;
the largest threshold within the budget is found on these sums, and only its boundary bucket is looked at again with the
next bits, so these thresholds are nested: a larger target's takes all that a smaller one's does. What is then left of the budget,
less than a document, is filled by thresholds of further hashes over the documents that still fit in it, which are not
nested. No documents are sorted.

Sources are numbered by code point, null last, on a table with one row a source.

Defined results: a null text has size 0; rows that repeat are each sized and taken alike; a null doc_id is hashed as null;
sources without words have target 0; an empty table gives no rows; other columns are kept where documents are returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thornwick.llm.common import WORD, materialize

WEIGHTS = (5, 2, 1)
BITS = 12
REFINE, FILL = 3, 4


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: weights repeat over the sources by code point, null last; targets over most times a
    source's size stop there, and the excess goes to the others by weight until none is above."""
    spark = sizes.sparkSession
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    position = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))  # one row a source
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (position + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", weight.cast("double")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, F.col("source_size") * F.lit(float(most))
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(full, cap)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        now = (share * total - (row["held"] or 0.0)) / row["open"]
        if now <= level:
            break
        level = now
    return sources.select("source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumns({"__size": word_count(F.col("text")), "__h": F.xxhash64(F.lit(seed), "doc_id", "text")})


def decide(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> Callable[[DataFrame], DataFrame]:
    """Finds the thresholds for docs; what it returns adds source_size, target, n_copies to rows with source, size and h,
    by joins with tables of a row a source and no shuffle of the rows."""
    sized = materialize(_sized(docs, seed).select("source", F.col("__size").alias("size"), F.col("__h").alias("h")), "sizes")
    targets = source_targets(sized, share, most, weights)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumn("base", F.least(base, F.lit(int(most))).cast("int"))
    state = materialize(state.withColumn("gap", F.col("target") - F.col("base") * F.col("source_size")), "state")
    same = F.col("source").eqNullSafe(F.col("s_source"))

    def with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
        return rows.join(rules.withColumnRenamed("source", "s_source"), same, "left").drop("s_source")

    def extra(kinds: list[tuple[int, int]]) -> F.Column:
        """Whether a threshold so far takes the row: its hash prefix lies in [low, high], and it is no larger than limit."""
        taken = F.lit(False)
        for k, kind in enumerate(kinds):
            taken = taken | _bits(F.col("h"), kind).between(F.col(f"low{k}"), F.col(f"high{k}")) & (F.col("size") <= F.col(f"limit{k}"))
        return F.coalesce(taken, F.lit(False))

    # One row a source holds its thresholds so far and what they leave of its target (gap), so a step joins it once.
    rules, kinds = state.select("source", "source_size", "target", "base", "gap"), []
    for step in range(REFINE + FILL):
        refine = step < REFINE
        kind = (0, (step + 1) * BITS) if refine else (step, BITS)
        rows = with_rules(sized, rules).filter(~extra(kinds))
        if refine and step:
            rows = rows.filter(_bits(F.col("h"), (0, step * BITS)) == F.col("edge"))
        if not refine:
            rows = rows.filter(F.col("size") <= F.col("gap"))
        sums = rows.groupBy("source", _bits(F.col("h"), kind).alias("bucket")).agg(F.sum("size").alias("words"), F.max("gap").alias("gap"))
        running = Window.partitionBy("source").orderBy("bucket")  # 2 ** BITS buckets a source at most
        sums = sums.withColumn("upto", F.sum("words").over(running))
        fits = F.col("upto") <= F.col("gap")
        limit = F.lit(float("inf")) if refine else F.max("gap").cast("double")
        found = sums.groupBy("source").agg(
            F.min("bucket").alias(f"low{step}"), F.coalesce(F.max(F.when(fits, F.col("bucket"))), F.lit(-1)).alias(f"high{step}"), limit.alias(f"limit{step}"), F.max(F.when(fits, F.col("upto"))).alias("took"), F.min(F.when(~fits, F.col("bucket"))).alias("edge")
        )
        rules = with_rules(rules.drop("edge"), found).withColumn("gap", F.col("gap") - F.coalesce("took", F.lit(0))).drop("took")
        rules = materialize(rules, f"step{step}")
        kinds.append(kind)

    def decided(rows: DataFrame) -> DataFrame:
        rows = with_rules(rows, rules)
        n = F.least(F.col("base") + extra(kinds).cast("int"), F.lit(int(most)))
        names = [c for c in rows.columns if c not in {*rules.columns} - {"source", "source_size", "target"}]
        return rows.withColumn("n_copies", n).select(*[F.col(f"`{c}`") for c in names], "n_copies")

    return decided


def copies(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, and how many times the mix takes it (n_copies)."""
    rows = _sized(docs, seed).select("doc_id", "source", F.col("__size").alias("size"), F.col("__h").alias("h"))
    return decide(docs, share, most, weights, seed)(rows).drop("h")


def _bits(h: F.Column, kind: tuple[int, int]) -> F.Column:
    """The first bits of a row's hash; of another hash of it for a salt other than 0."""
    salt, bits = kind
    return F.shiftrightunsigned(h if not salt else F.xxhash64(F.lit(salt), h), 64 - bits)


def mixed_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it, with the columns of docs."""
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")  # whatever other columns are called
    rows = _sized(docs, seed).select(kept, "source", F.col("__size").alias("size"), F.col("__h").alias("h"))
    taken = decide(docs, share, most, weights, seed)(rows).filter(F.col("n_copies") > 0)
    return taken.select("kept", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).select("kept.*")
