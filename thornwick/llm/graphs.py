"""Pairs of documents: texts for pairs around hubs, and connected components; all by joins, nothing collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thornwick.llm.common import materialize, words_of

KEY = "struct<none:boolean,id:long,h:long>"
FEW = 500_000


def row_key(docs: DataFrame) -> F.Column:
    """Orders rows by doc_id, null last, then by a hash of the text."""
    none = docs["doc_id"].isNull()
    return F.struct(none.alias("none"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("id"), F.coalesce(F.xxhash64(docs["text"].cast("string")), F.lit(0)).alias("h"))


def few(side: DataFrame, most: int = FEW) -> DataFrame:
    """A table's rows, to be broadcast in a join if they are at most `most` (of some tens of bytes each), else left to the planner."""
    return F.broadcast(side) if side.count() <= most else side


def zipped_texts(keyed: DataFrame) -> DataFrame:
    """keyed (key, text, and other columns) with its text as zstd bytes z (null where it is null): a third to a half of
    what shuffles would else write. Two joins on key in one query share one shuffle of it if they read all its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            names = batch.schema.names
            z = pa.array([None if x is None else pack(x.encode()) for x in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([z if n == "text" else batch.column(n) for n in names], ["z" if n == "text" else n for n in names])

    # a key that can't be null needs no filter, which would make the plans below two joins differ
    of = lambda f: T.StructField("z", T.BinaryType()) if f.name == "text" else T.StructField(f.name, f.dataType, f.nullable and f.name != "key")
    schema = T.StructType([of(f) for f in keyed.schema.fields])
    return keyed.mapInArrow(run, schema)


def unzipped(x: pa.BinaryScalar) -> bytes:
    """The text of zstd bytes; a null is an empty text."""
    return zstandard.ZstdDecompressor().decompress(x.as_buffer()) if x.is_valid else b""


def words_of_zipped(column: pa.Array, target: int = 1 << 18) -> Iterator[np.ndarray]:
    """The words of each of a column's zstd texts, about target bytes of text unpacked at once."""

    def words(parts: list[bytes]) -> Iterator[np.ndarray]:
        found, _, _, first = words_of(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
        for s, e in zip(first[:-1], first[1:], strict=True):
            yield found[s:e]

    parts: list[bytes] = []
    size = 0
    for x in column:
        parts.append(unzipped(x))
        size += len(parts[-1])
        if size >= target:
            yield from words(parts)
            parts, size = [], 0
    if parts:
        yield from words(parts)


def spread(pairs: DataFrame, texts: DataFrame, each: int = 200) -> DataFrame:
    """pairs (key, owner) with each owner's z. An owner of very many pairs is spread over salts, `each` pairs to one;
    its text goes to each of them."""
    load = pairs.groupBy("owner").count().select("owner", F.ceil(F.col("count") / each).cast("int").alias("salts"))
    hot = materialize(load.filter("salts > 1"), "hot")  # a row for `each` pairs at most
    # all columns of texts are read, so that another join on its key finds the same shuffle
    held = texts.join(load.withColumnRenamed("owner", "key"), "key").groupBy("key").agg(F.first(F.struct(*texts.columns)).alias("t"), F.first("salts").alias("salts"))
    held = held.select(F.col("key").alias("owner"), F.col("t.z").alias("owner_z"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = pairs.join(few(hot), "owner", "left")
    salted = salted.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("key"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    return salted.join(held, ["owner", "salt"]).drop("salt")


def paired_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """key, z, owner, owner_z for pairs (key, owner), a table, over texts (key, text); other texts are not shuffled where the
    keys of pairs are few."""
    keys = materialize(pairs.select("key").union(pairs.select("owner")).distinct(), "keys")
    zipped = zipped_texts(texts.join(few(keys), "key", "left_semi"))
    members = zipped.join(pairs.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("z").alias("z"))
    return spread(pairs, zipped).join(members, "key").select("key", "z", "owner", "owner_z")


def components(edges: DataFrame) -> DataFrame:
    """key, root (the least key of its component) of every key in edges (u, v), by alternating stars until nothing moves."""
    now = materialize(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        size = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(size) == before:
            return now.select(F.col("u").alias("key"), F.col("v").alias("root"))
        before = tuple(size)
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = materialize(small.distinct(), "small")
