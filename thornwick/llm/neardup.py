"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Exact copies (equal texts) are one node. A node's k-mers are its windows of five words, labelled by occurrence, so that a
repeated one counts as often as it comes. Each of SKETCHES sketches samples the SAMPLED k-mers of least hash and keeps
them in text order: two texts share a sketch if they agree on those k-mers and on their order, so it follows edit
similarity. In each bucket of a sketch, members are linked to the least one; candidate pairs are verified by alignment of
their words: the share of the longer text that is aligned, M / max(n, m), must reach `threshold`. A changed word changes
five k-mers, so near copies of that share have a Jaccard index of k-mers of 0.4 or more as a rule; one of 0.8 is always
similar enough. Bounds from the words in common decide most pairs, the rest is aligned in a band as wide as the
threshold leaves room for.

Classes are the connected components of verified pairs. Where a bucket's members are still in several components, those
outside of its largest one are compared with all its members of other components, in blocks, so a bucket's least member need
not be similar to all.

Defined results: a null text is empty; texts without words are copies if equal and else alike to none; texts under five
words have one k-mer of all their words; rows with a null doc_id take part, and a class of such rows alone has a null id;
rows that repeat get their class each; an empty table gives no rows; ties go to the least doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thornwick.llm.common import materialize, mix, run_hash, settled, text_chunks, words_of
from thornwick.llm.graphs import KEY, components, few, paired_texts, row_key, words_of_zipped, zipped_texts
from thornwick.llm.linededup import patience

_U = np.uint64
K, SAMPLED, SKETCHES, THRESHOLD = 5, 3, 40, 0.8
SHORT, SHORT_SAMPLED = 16, 2
BLOCK = 256


def shingles(words: np.ndarray, k: int = K) -> np.ndarray:
    n = len(words)
    if not n:
        return words
    at = np.arange(max(1, n - k + 1))
    return run_hash(words, at, np.minimum(at + k, n))


def labelled(kmers: np.ndarray) -> np.ndarray:
    """K-mers (or words) with their occurrence number: all distinct, in text order."""
    order = np.argsort(kmers, kind="stable")
    s = kmers[order]
    new = np.r_[True, s[1:] != s[:-1]]
    place = np.arange(len(s))
    occurrence = place - np.maximum.accumulate(np.where(new, place, 0))
    out = np.empty(len(s), _U)
    out[order] = mix(s + occurrence.astype(_U) * _U(0xD6E8FEB86659FD93))  # of every text alike, or one with a repeat would share nothing with one without
    return out


def sketch(kmers: np.ndarray, sampled: int, seeds: np.ndarray) -> np.ndarray:
    """One key a seed: the sampled k-mers of least hash, in text order, hashed."""
    n = len(kmers)
    if n <= sampled:
        return np.asarray([run_hash(kmers, np.asarray([0]), np.asarray([n]))[0] ^ seeds[0]])
    ranks = mix(kmers[None, :] ^ seeds[:, None])
    at = np.sort(np.argpartition(ranks, sampled - 1, axis=1)[:, :sampled], axis=1)
    key = seeds.copy()
    for c in range(sampled):
        key = mix(key * _U(0x9E3779B97F4A7C15) + kmers[at[:, c]])
    return key


def _words_by_row(column: pa.Array) -> Iterator[np.ndarray]:
    for i, j, data, offsets in text_chunks(column):
        words, _, _, first = words_of(data, offsets)
        for k in range(j - i):
            yield words[first[k] : first[k + 1]]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds, more = mix(np.arange(1, SKETCHES + 1, dtype=_U)), mix(np.arange(101, SKETCHES + 101, dtype=_U))
    for batch in batches:
        found = []
        for words in _words_by_row(batch.column("text")):
            if not len(words):
                found.append(words)
                continue
            kmers = labelled(shingles(words))
            keys = sketch(kmers, SAMPLED, seeds)
            if len(kmers) < SHORT:
                keys = np.r_[keys, sketch(kmers, SHORT_SAMPLED, more)]
            found.append(keys)
        counts = np.concatenate(([0], np.cumsum([len(x) for x in found])))
        keys = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("x1"), batch.column("x2"), keys], ["key", "x1", "x2", "keys"])


def banded_lcs(a: list[int], b: list[int], band: int) -> int:
    """Length of a longest common subsequence whose matches lie within band of the diagonal (bit-parallel)."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    n = len(b)
    full = (1 << n) - 1
    row = full
    for i, x in enumerate(a):
        match = where.get(x)
        if match:
            low = max(0, i - band)
            match = (match >> low << low) & ((1 << min(n, i + band + 1)) - 1)
            u = row & match
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def aligned_share(a: np.ndarray, b: np.ndarray, threshold: float, la: np.ndarray | None = None, lb: np.ndarray | None = None) -> float:
    """M / max(n, m) of two sequences of words if it reaches the threshold, else 0 (or a bound that shows it doesn't)."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return 0.0
    la, lb = labelled(a) if la is None else la, labelled(b) if lb is None else lb
    _, ia, ib = np.intersect1d(la, lb, assume_unique=True, return_indices=True)
    share = lambda x: x / max(n, m)
    if share(len(ia)) < threshold:
        return 0.0
    order = ib[np.argsort(ia)]
    if (np.diff(order) > 0).all():
        return share(len(ia))
    from bisect import bisect_left

    tails: list[int] = []
    for y in order.tolist():
        k = bisect_left(tails, y)
        tails[k : k + 1] = [y]
    if share(len(tails)) >= threshold:
        return share(len(tails))
    found = share(sum(run for _, _, run in patience(a, b)))
    if found >= threshold:
        return found
    band = int(n + m - 2 * threshold * max(n, m)) + 1  # as many words may be left out in all
    return share(banded_lcs(a.tolist(), b.tolist(), band))


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(words_of_zipped(batch.column(x)) for x in ("z", "owner_z")), strict=True)
            good = pa.array([aligned_share(a, b, threshold) >= threshold for a, b in rows], pa.bool_())
            yield batch.select(["key", "owner"]).filter(good)

    return run


def _search_block(threshold: float):
    """Verified pairs between a block's asked members and its others of other components; what a found pair joins isn't
    asked again."""

    def run(data: pa.Table) -> pa.Table:
        data = data.combine_chunks()
        kind = data.schema.field("key").type
        words = list(words_of_zipped(data.column("z").combine_chunks()))
        marks = [labelled(x) for x in words]
        keys, root, main = (data.column(x).to_pylist() for x in ("key", "root_hash", "in_main"))
        asked = np.asarray(data.column("asked").to_pylist(), bool)
        rows, others = np.flatnonzero(asked), np.flatnonzero(~asked)
        sizes = np.asarray([len(x) for x in marks])
        _, inverse, counts = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(marks)), sizes)
        shared = counts[inverse] > 1
        column, doc = np.cumsum(counts > 1)[inverse][shared] - 1, doc[shared]
        common = np.zeros((len(rows), len(others)), np.float32)
        order = np.argsort(column, kind="stable")
        column, doc = column[order], doc[order]
        width = 2048
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            s, e = np.searchsorted(column, (c, c + width))
            part = np.zeros((len(marks), width), np.float32)
            part[doc[s:e], column[s:e] - c] = 1
            common += part[rows] @ part[others].T
        alike = common >= threshold * np.maximum(sizes[rows][:, None], sizes[others][None, :]) - 1e-3
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        order_of = lambda k: tuple(k.values())
        pairs = []
        for i, j in zip(*np.nonzero(alike), strict=True):
            i, j = rows[i], others[j]
            if not main[j] and order_of(keys[i]) >= order_of(keys[j]):
                continue  # two asked members meet twice
            ri, rj = find(root[i]), find(root[j])
            if ri != rj and aligned_share(words[i], words[j], threshold, marks[i], marks[j]) >= threshold:
                parent[rj] = ri
                pairs.append((keys[i], keys[j]))
        return pa.table({"u": pa.array([x for x, _ in pairs], kind), "v": pa.array([y for _, y in pairs], kind)})

    return run


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key (see row_key), x1, x2 and root (the key of its class's first document) of every row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(row_key(docs).alias("key"), text.alias("text"))
    hashed = rows.select("key", "text", F.xxhash64("text").alias("x1"), F.xxhash64(F.lit(1), "text").alias("x2"))
    sketched = materialize(hashed.mapInArrow(_sketches, f"key {KEY}, x1 long, x2 long, keys array<long>"), "sketches")
    nodes = materialize(sketched.groupBy("x1", "x2").agg(F.min("key").alias("node"), F.first("keys").alias("keys")), "nodes")
    members = nodes.select(F.col("node").alias("key"), F.explode("keys").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min("key").alias("owner"), F.max("key").alias("last")).filter(F.col("owner") != F.col("last")).drop("last")
    shared = materialize(members.join(hubs, "bucket"), "shared")
    pairs = materialize(shared.filter(F.col("key") != F.col("owner")).select("key", "owner").distinct(), "pairs")
    verified = paired_texts(pairs, rows).mapInArrow(_verify(threshold), f"key {KEY}, owner {KEY}")
    edges = materialize(verified.select(F.col("key").alias("u"), F.col("owner").alias("v")), "verified")
    found = settled("components", lambda: components(edges))
    more = settled("across", lambda: _across(shared.select("key", "bucket"), found, rows, threshold))
    if not more.isEmpty():
        both = found.toDF("u", "v").union(more)
        found = settled("components", lambda: components(both))
    rooted = nodes.select("x1", "x2", "node").join(found.withColumnRenamed("key", "node"), "node", "left")
    rooted = rooted.select("x1", "x2", F.coalesce("root", "node").alias("root"))
    return sketched.select("key", "x1", "x2").join(rooted, ["x1", "x2"])


def _across(shared: DataFrame, found: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Verified pairs (u, v) within buckets, between members whose components differ: those outside of a bucket's largest
    component are asked of all its members, a block of each at a time."""
    placed = materialize(shared.join(found, "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
    parts = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("set"))
    mixed = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("size"), F.sum("set").alias("set"))
    mixed = mixed.filter("roots > 1").groupBy("set", "size").agg(F.min(F.struct("bucket", "most")).alias("b"))  # of buckets with the same members, one
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("b.bucket", F.col("b.most.root").alias("main"), blocks(F.col("size")).alias("n_others"), blocks(F.col("size") - F.col("b.most.n")).alias("n_asked"))
    rows = materialize(placed.join(mixed, "bucket").withColumn("in_main", F.col("root") == F.col("main")).drop("main"), "mixed")
    if rows.isEmpty():
        return rows.select(F.col("key").alias("u"), F.col("key").alias("v"))
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "key"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    others = rows.withColumns({"asked": F.lit(False), "j": deal(1, "n_others")}).withColumn("i", each("n_asked"))
    asked = rows.filter(~F.col("in_main")).withColumns({"asked": F.lit(True), "i": deal(2, "n_asked")}).withColumn("j", each("n_others"))
    dealt = others.unionByName(asked).select("bucket", "key", F.xxhash64("root").alias("root_hash"), "in_main", "asked", "i", "j")
    keys = materialize(rows.select("key").distinct(), "keys")
    once = zipped_texts(texts.join(few(keys), "key", "left_semi")).groupBy("key").agg(F.first("z").alias("z"))
    return dealt.join(once, "key").groupBy("bucket", "i", "j").applyInArrow(_search_block(threshold), f"u {KEY}, v {KEY}")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of every row of docs."""
    found = settled("classes", lambda: classes(docs, threshold))
    id_of = lambda c: F.when(~F.col(c)["none"], F.col(c)["id"])
    return found.select(id_of("key").alias("doc_id"), id_of("root").alias("class_id"))


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The first document of each class (one row of it, if it repeats), with the columns of docs."""
    found = settled("classes", lambda: classes(docs, threshold))
    first = found.filter(F.col("key") == F.col("root")).select("key").distinct()
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(kept, row_key(docs).alias("key")).join(first, "key")
    once = rows.groupBy("key").agg(F.first("row").alias("row")) if _repeats(found) else rows
    return once.select("row.*")


def _repeats(found: DataFrame) -> bool:
    return not found.filter(F.col("key") == F.col("root")).groupBy("key").count().filter(F.col("count") > 1).isEmpty()
