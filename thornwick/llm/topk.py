"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt to blocks. Within a block every dimension has a list of its vectors sorted by that component. A query
walks all lists in step, from the end that its own component's sign favours, scores the vectors it meets, and stops when
the bound (its inner product with the components at the lists' present depth) can't beat its kth score. Depth grows in
strides, so that scoring is by matrix products. A query's best of each block are merged by score.

Queries and candidates are paired in blocks, each pair a task; nothing is broadcast or collected.

Defined results: vectors that are null, or hold null or non-finite components, take no part; ties go to the smaller id;
vectors of another length than a query's are no candidates of it; rows that repeat an id are candidates each, and none is
a candidate of a query of its id; of a query's id that repeats the least vector is asked; a score among the k best that
64 bits don't hold raises an error; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thornwick.llm.common import materialize

CANDIDATES, QUERIES = 4096, 16384


def integer_vectors(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """vec_id and floor(scale * component) of each usable vector."""
    whole = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * F.lit(scale)))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def threshold_search(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int, stride: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best in the block, by id where scores tie; int64 arrays."""
    n, dims = block.shape
    order = np.argsort(block, axis=0, kind="stable")  # the sorted lists, ascending
    exact = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(block.astype(float)).max(initial=0)) * dims
    kind = np.float64 if exact < 2**53 else np.int64 if exact < 2**62 else object
    rows, cols = block.astype(kind), np.arange(dims)
    sorted_values = np.take_along_axis(rows, order, axis=0)
    out_q, out_id, out_s = [], [], []
    for qi, own in enumerate(query_ids.tolist()):
        q = queries[qi].astype(kind)
        down = q >= 0
        seen = np.zeros(n, bool)
        best_s, best_id = np.zeros(0, kind), np.zeros(0, np.int64)
        depth, step = 0, stride
        while depth < n:
            end = min(n, depth + step)
            at = np.where(down[None, :], n - 1 - np.arange(depth, end)[:, None], np.arange(depth, end)[:, None])
            met = np.zeros(n, bool)
            met[order[at, cols[None, :]].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            new = new[ids[new] != own]
            s, i = np.r_[best_s, rows[new] @ q], np.r_[best_id, ids[new]]
            if len(s) > k and kind is not object:
                cut = np.partition(s, len(s) - k)[len(s) - k]
                keep = s >= cut
                s, i = s[keep], i[keep]
            keep = np.lexsort((i, -s))[:k] if kind is not object else sorted(range(len(s)), key=lambda x: (-s[x], i[x]))[:k]
            best_s, best_id = s[keep], i[keep]
            depth, step = end, step * 4
            bound = sorted_values[np.where(down, n - end, end - 1), cols] @ q
            if len(best_s) == k and bound < best_s[-1] or seen.all():
                break
        out_q.append(np.full(len(best_id), qi))
        out_id.append(best_id)
        if kind is object and any(not -(2**63) <= x < 2**63 for x in best_s):
            raise ValueError("an inner product does not fit in 64 bits")
        out_s.append(best_s.astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; both sides have vec_id and v (array of long)."""
    spark = candidates.sparkSession
    candidates = materialize(candidates, "candidates")
    queries = materialize(queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "queries")
    n, m = candidates.count(), queries.count()
    blocks, groups = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    groups = max(groups, min(m // 64, -(-12 // blocks)) or 1)  # small inputs still give each core a task
    left = candidates.withColumn("b", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    right = queries.withColumn("g", F.pmod(F.xxhash64(F.lit(2), "query_id"), F.lit(groups))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

    def search(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(c) and len(q):
            lengths_c, lengths_q = c["v"].map(len).to_numpy(), q["v"].map(len).to_numpy()
            for dims in np.unique(lengths_q):
                x, y = c[lengths_c == dims], q[lengths_q == dims]
                if len(x):
                    qid = y["query_id"].to_numpy(np.int64)
                    a, i, s = threshold_search(np.stack(y["v"].to_list()), qid, np.stack(x["v"].to_list()), x["vec_id"].to_numpy(np.int64), k)
                    found.append(pd.DataFrame({"query_id": qid[a], "vec_id": i, "score": s}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})

    best = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a block
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    vectors = integer_vectors(embeddings)
    return top_k(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
