"""Audit of how filters interact: what each one removes at each place of every order, alone and in vain.

Every document gets its failure flags once. A cube over the flags and the part counts documents by any choice of flags;
its rows whose chosen flags are all false are what survives that choice of filters, in any order. A step of an order is
then a pair of those subsets, before and after its filter, and its figures are differences: orders are never run.

Copies are found without comparing rows: rows are counted by text (two 64-bit hashes), part and labels before they meet,
so the copies of a text are a few counts, however many they are, and the least doc_id of a text is found among those.

Defined results: a null text is empty, a null lang the part ''; a null doc_id is neither smaller nor greater than another and
has no labels; rows that repeat with the same doc_id are no copies of a smaller one and all count; of several labels of a
doc_id any 1 counts, a null label is none; very long texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thornwick.llm.common import materialize
from thornwick.llm.quality import SPACES, bind

FILTERS = "ABCDE"


def failures(text: Column) -> dict[str, Column]:
    """The failure conditions of one text by itself: too short, repetitive, shouting, with symbols."""
    words = bind(F.array_remove(F.split(text, SPACES), ""), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    return {"words": words, "C": upper.cast("long") * 100 > F.length(text).cast("long") * 10, "D": text.rlike(r"[#$%&*|]")}


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """n documents by part, failure flags A to E, and the labels good and toxic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    found = failures(F.col("text"))
    rows = rows.select("id", "part", F.xxhash64("text").alias("x1"), F.xxhash64(F.lit(1), "text").alias("x2"), found["words"].alias("w"), found["C"].alias("C"), found["D"].alias("D"))
    words = F.col("w.n").cast("long")
    rows = rows.select("id", "part", "x1", "x2", (words < 100).alias("A"), (F.col("w.distinct").cast("long") * 100 < words * 80).alias("B"), "C", "D")
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    # a null doc_id meets no label, and lies with those of its text
    key = lambda none, there: [none.alias("none"), F.coalesce(F.col("id"), there).alias("key")]
    known = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("id IS NOT NULL")
    known = known.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).select(*key(F.lit(False), F.lit(0)), "good", "toxic")
    joined = counted.select("*", *key(F.col("id").isNull(), F.col("x1"))).join(known, ["none", "key"], "left")
    joined = joined.select(*counted.columns, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    by_text = joined.groupBy("x1", "x2", "part", "A", "B", "C", "D", "good", "toxic").agg(
        F.min("id").alias("least"), F.expr("min_by(n, id) FILTER (WHERE id IS NOT NULL)").alias("n_least"), F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_none")
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("x1", "x2"))  # a row a part and label
    by_text = by_text.withColumn("n_first", F.col("n_none") + F.when(first, F.col("n_least")).otherwise(0))
    both = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("n_first").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("n_first")).alias("n"))))
    split = by_text.select("part", "A", "B", "C", "D", "good", "toxic", both.alias("x")).select("part", "A", "B", "C", "D", F.col("x.E").alias("E"), "good", "toxic", F.col("x.n").alias("n"))
    return split.groupBy("part", *FILTERS, "good", "toxic").agg(F.sum("n").alias("n")).filter("n > 0")


def survivors(cells: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """n, good and toxic documents by part and subset (a bit a filter) that fail no filter of the subset; zeros included."""
    n = F.col("n")
    cube = cells.cube("part", *filters).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"), F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"no_{f}") for f in filters]
    )
    passed = cube.filter("all_parts = 0")
    subset = F.lit(0)
    for i, f in enumerate(filters):
        passed = passed.filter((F.col(f"no_{f}") == 1) | ~F.col(f))
        subset = subset + (1 - F.col(f"no_{f}")) * (1 << i)
    passed = passed.select("part", subset.cast("int").alias("subset"), "n", "good", "toxic")
    grid = passed.filter("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "good", "toxic")]
    return grid.join(passed, ["part", "subset"], "left").select("part", "subset", *zero)


def orders(filters: Sequence[str] = FILTERS) -> list[dict]:
    """Every step of every order: its filter, and the subsets before and after it, of the filter alone, of all, and of the others."""
    full = (1 << len(filters)) - 1
    steps = []
    for order in permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << filters.index(f)
            steps.append({"filter_order": "".join(order), "step": step, "filter": f, "before": before, "after": before | bit, "none": 0, "alone": bit, "rest": full ^ bit, "full": full})
            before |= bit
    return steps


def interactions(cells: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row a part, order of the filters and step, by joining pairs of subsets."""
    subsets = materialize(survivors(cells, filters), "subsets")  # 2 ** filters rows a part
    kind = "array<struct<filter_order:string,step:int,filter:string,before:int,after:int,none:int,alone:int,rest:int,full:int>>"
    steps = subsets.filter("subset = 0").select("part", F.explode(F.from_json(F.lit(json.dumps(orders(filters))), kind)).alias("s")).select("part", "s.*")

    def pair(rows: DataFrame, before: str, after: str, as_: str) -> DataFrame:
        for at, side in ((before, "0"), (after, "1")):
            named = subsets.select("part", F.col("subset").alias(at), *[F.col(c).alias(f"{as_}_{c}{side}") for c in ("n", "good", "toxic")])
            rows = rows.join(named, ["part", at])
        return rows

    for before, after, as_ in (("before", "after", "step"), ("none", "alone", "alone"), ("rest", "full", "last")):
        steps = pair(steps, before, after, as_)
    lost = lambda as_, c: F.col(f"{as_}_{c}0") - F.col(f"{as_}_{c}1")
    removed = lost("step", "n")
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.col("step_n1").alias("kept"),
        removed.alias("removed"),
        (lost("alone", "n") - removed).alias("redundant"),
        lost("last", "n").alias("unique_fails"),
        lost("step", "good").alias("good_lost"),
        lost("step", "toxic").alias("toxic_lost"),
        F.sum(removed).over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(materialize(flagged(docs, labels), "cells"))  # a row a part, set of flags and labels
