"""Quality rules by weak supervision, in DataFrame functions alone.

Each rule votes good (1), bad (-1) or abstains (0) on measures of a text. Documents are counted by vote pattern (at most
3 ** rules patterns, whatever the corpus), expectation-maximisation on those counts estimates how often each rule votes
either way on good and on bad documents, and a document is kept if its posterior probability of being good reaches a half
and no base criterion fails.

Measures of one document are array functions over its own words; nothing is exploded or shuffled but the pattern counts.

Defined results: a null or empty text has no words, fails the base criterion, and has all measures 0; repeated rows are
each judged; a very long text is measured whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thornwick.llm.common import materialize

SPACES = r"[\x20\x09-\x0D]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, bound to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array."""

    def of_hashes(hashes: Column) -> Column:
        def of_sorted(ordered: Column) -> Column:
            last = F.size(ordered) - 1
            twice = F.filter(ordered, lambda x, i: ((i > 0) & (F.get(ordered, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])) | ((i < last) & (F.get(ordered, F.least(i + 1, last))["h"] == x["h"])))
            places = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
            return F.size(F.array_distinct(places))

        dealt = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(dealt, of_sorted))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(bind(windows, of_hashes)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), repeat_words(w).alias("n_repeat_words")
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return docs.select(
        F.col("doc_id"),
        bind(words, of_words).alias("w"),
        bind(lines, of_lines).alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[^\p{L}\x20\x09-\x0D]")).cast("long").alias("n_marks"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[!]")).cast("long").alias("n_shouts"),
        F.regexp_count(text, F.lit(r"[.?]")).cast("long").alias("n_stops"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_marks", "n_upper", "n_shouts", "n_stops")


def _vote(bad: Column, good: Column) -> Column:
    """-1 where bad, 1 where good, else abstains; short texts give no vote either way."""
    return F.when(F.col("n_words") < 10, 0).when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    n, c = F.col("n_words"), F.col("word_chars")
    return {
        "symbols": _vote(F.col("n_symbols") * 10 > n, F.col("n_symbols") * 50 < n),
        "marks": _vote(F.col("n_marks") * 100 > c * 13, F.col("n_marks") * 100 < c * 8),
        "shouting": _vote((F.col("n_upper") * 10 > c * 3) | (F.col("n_shouts") * 10 > n), (F.col("n_upper") * 8 < c) & (F.col("n_shouts") * 50 < n)),
        "repetition": _vote((F.col("n_repeat_words") * 10 > n * 3) | (F.col("n_distinct") < F.sqrt(n) * 2), F.col("n_repeat_words") * 10 < n),
        "lines": _vote(F.col("n_dup_lines") * 2 > F.col("n_lines"), F.col("n_dup_lines") == 0),
        "length": _vote((c < n * 2) | (c > n * 15), (c > n * 3) & (c < n * 11)),
        "stops": _vote(F.col("n_stops") * 200 < n, F.col("n_stops") * 60 > n),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], k: int, strength: float = 0.1, bad: float = 0.2, slip: float = 0.01, catch: float = 0.3, rounds: int = 300) -> tuple[float, list[dict[int, float]]]:
    """EM over (votes, count): the prior log-odds of good, and each rule's log-odds by vote (an abstention has none).

    A rule is taken to vote bad on slip of the good and catch of the bad documents before any are seen; that belief weighs
    as much as strength times the documents, so it holds at every size which of the two classes is the good one."""
    total = sum(n for _, n in patterns)
    prior = math.log((1 - bad) / bad)
    rates = [{1: {-1: slip, 1: 1 - slip}, 0: {-1: catch, 1: 1 - catch}} for _ in range(k)]
    weight = max(strength * total, 1.0)

    def log_odds() -> list[dict[int, float]]:
        return [{v: math.log(r[1][v] / r[0][v]) for v in (1, -1)} | {0: 0.0} for r in rates]

    for _ in range(rounds if total else 0):
        odds, good = log_odds(), 0.0
        tally = [{y: {-1: weight * w * x, 1: weight * w * (1 - x)} for y, w, x in ((1, 1.0, slip), (0, bad, catch))} for _ in range(k)]
        for votes, n in patterns:
            at = prior + sum(odds[j][v] for j, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, at))))
            good += p * n
            for j, v in enumerate(votes):
                if v:
                    tally[j][1][v] += p * n
                    tally[j][0][v] += (1 - p) * n
        share = min(max(good / total, 0.01), 0.99)
        was, prior = prior, math.log(share / (1 - share))
        rates = [{y: {v: t[y][v] / (t[y][1] + t[y][-1]) for v in (1, -1)} for y in (1, 0)} for t in tally]
        if abs(was - prior) < 1e-9:
            break
    return prior, log_odds()


def judge(docs: DataFrame, at_least: float = 0.5) -> DataFrame:
    """doc_id, measures, votes, posterior (probability of being good), base_failed and kept of every row of docs."""
    names = list(rules())
    seen = materialize(measure(docs), "measures").withColumns(rules())
    counts = seen.groupBy(*names).count().collect()  # 3 ** rules rows at most
    prior, odds = estimate([(tuple(r[x] for x in names), r["count"]) for r in counts], len(names))
    at = F.lit(prior)
    for name, o in zip(names, odds, strict=True):
        at = at + F.when(F.col(name) == 1, o[1]).when(F.col(name) == -1, o[-1]).otherwise(0.0)
    n = F.col("n_words")
    failed = (n < 50) | (F.col("n_repeat_words") * 100 > n * 50)
    seen = seen.withColumn("posterior", 1 / (1 + F.exp(-at))).withColumn("base_failed", failed)
    return seen.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= at_least))
