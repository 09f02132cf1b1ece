"""Chat rendering after cumulative-snapshot collapse, in DataFrame functions alone.

Logs often hold a conversation again each time it grew. Each conversation's turns get rolling prefix hashes (a sum of
hashes of position, role and text); a conversation whose whole hash is some longer one's prefix hash is a snapshot of
that and goes by an anti-join; of equal conversations the smallest id stays. The rest are rendered turn by turn.

Turns are ranked and summed within chunks of turn numbers, and chunks within conversations, so that a conversation that
holds a third of all rows is spread over tasks (its turns without a number, or of one and the same number, are one chunk); a
rendering is cut into parts of `part` turns.

Defined results: a null role or text is empty; turns are in order of turn (null last), then role, then text, and a turn
that repeats stays; rows with a null conv_id are one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thornwick.llm.common import materialize

CHUNK = 256


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n (of its conversation), role, text, and the two prefix hashes up to pos."""
    rows = turns.select("conv_id", F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(2**62))
    rows = rows.withColumn("chunk", chunk)
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    counts = rows.groupBy("conv_id", "chunk").count()
    counts = counts.select("conv_id", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"), F.sum("count").over(whole).alias("n"))
    rows = _attach(rows, counts)
    within = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumn("pos", F.col("skip") + F.row_number().over(within))
    rows = rows.withColumns({f"g{k}": F.xxhash64(F.lit(k), "pos", "role", "text").cast("decimal(38,0)") for k in (1, 2)})
    sums = rows.groupBy("conv_id", "chunk").agg(F.sum("g1").alias("s1"), F.sum("g2").alias("s2"))
    sums = sums.select("conv_id", "chunk", *[F.coalesce(F.sum(f"s{k}").over(before), F.lit(0)).cast("decimal(38,0)").alias(f"b{k}") for k in (1, 2)])
    rows = _attach(rows, sums)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    hashes = [(F.col(f"b{k}") + F.sum(f"g{k}").over(upto)).cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2)]
    return rows.select("conv_id", "pos", "n", "role", "text", *hashes)


def _attach(rows: DataFrame, side: DataFrame) -> DataFrame:
    side = side.withColumnsRenamed({"conv_id": "__c", "chunk": "__k"})
    return rows.join(side, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("chunk") == F.col("__k"))).drop("__c", "__k")


def maximal(prefixed: DataFrame) -> DataFrame:
    """conv_id and n_copies of the conversations that no other one extends."""
    finals = prefixed.filter(F.col("pos") == F.col("n")).groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    longer = prefixed.filter(F.col("pos") < F.col("n")).select("pos", "h1", "h2").distinct()
    return finals.join(longer, ["pos", "h1", "h2"], "left_anti").select("conv_id", "n_copies")


def render(turns: DataFrame, start: str = "<|{role}|>\n", end: str = "<|end|>\n", part: int = CHUNK) -> DataFrame:
    """conv_id, part (from 0), n_turns, n_copies, text of the maximal conversations; {role} in start is the turn's role."""
    prefixed = materialize(prefixes(turns), "prefixes")
    kept = maximal(prefixed).withColumnRenamed("conv_id", "__c")
    rows = prefixed.select("conv_id", "pos", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    left, _, right = start.partition("{role}")
    piece = F.concat(F.lit(left), F.col("role"), F.lit(right), F.col("text"), F.lit(end))
    rows = rows.select("conv_id", "n_copies", F.floor((F.col("pos") - 1) / part).cast("long").alias("part"), F.struct("pos", piece.alias("piece")).alias("x"))
    parts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n_turns"), F.max("n_copies").alias("n_copies"), F.sort_array(F.collect_list("x")).alias("xs"))
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.transform("xs", lambda x: x["piece"]), "").alias("text"))
