"""Best-fit packing of tokenized documents, after a Martello-Toth dominance reduction.

Documents of one length are alike, so the reduction and the best-fit run on the histogram of piece lengths, which has at
most `capacity` entries whatever the corpus; its result is a list of runs (a stretch of ranks within one length goes to a
stretch of sequences at one offset). Ranks are dealt by salted counts, so that a length that a third of all documents
share is numbered by many tasks.

Defined results: a null text is empty and has the end id alone; repeated rows are packed each; a null doc_id is packed as
any other; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thornwick.llm.common import materialize
from thornwick.llm.tokens import cached

CAPACITY = 1024
SALTS = 128
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def _cut(tokenizer: str, end_id: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cached(tokenizer, keeps_space=True)
        end = np.asarray([end_id], "<u4").tobytes()
        serial = 0
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i, _, ids, bounds in encoder.encode_column(batch.column(1)):
                rows: list[tuple] = []
                for k, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    raw = ids[s:e].astype("<u4").tobytes() + end
                    n, start, piece = e - s + 1, 0, 0
                    while start < n:
                        length = capacity if start or n <= capacity else n % capacity or capacity
                        length = min(length, n - start)
                        rows.append((docs[i + k], piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), serial % SALTS))
                        start, piece, serial = start + length, piece + 1, serial + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return run


def tokenized_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and the end id, cut where longer than capacity; only the first piece may be shorter."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut(tokenizer, end_id, capacity), PIECES)


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sequences on a histogram of lengths (counts is changed in place): [(lengths, times)].

    Taking the lengths from the longest, j: nothing fits beside it, then it stands alone; the longest that fits beside it
    fills the sequence exactly, then that pair dominates every set with j; or no two of the rest fit beside it together,
    then j with the longest that fits dominates, since any other set with j is j with one shorter or equal piece. Each is
    the criterion that a feasible set F dominates if any set with j can be replaced by F and the rest still be packed."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        present = np.flatnonzero(counts)
        if not len(present):
            break
        for j in present[::-1].tolist():
            while counts[j]:
                room = capacity - j
                counts[j] -= 1
                fits = np.flatnonzero(counts[: room + 1])
                counts[j] += 1
                if not len(fits):
                    times, group = int(counts[j]), (j,)
                else:
                    best = int(fits[-1])
                    small = int(fits[0])
                    second = small if counts[small] - (small == j) > 1 else (int(fits[1]) if len(fits) > 1 else capacity + 1)
                    if best == room or small + second > room:
                        times, group = int(counts[j]) // 2 if best == j else int(min(counts[j], counts[best])), (j, best)
                    else:
                        break
                for x in group:
                    counts[x] -= times
                fixed.append((group, times))
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int, first: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing over a histogram: runs (length, times, first sequence, offset), and the next free sequence."""
    runs: list[tuple[int, int, int, int]] = []
    open_runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        room = size
        while left:
            while room <= capacity and not open_runs[room]:
                room += 1
            if room > capacity:
                per = capacity // size
                whole, over = divmod(left, per)
                if whole:
                    for k in range(per):
                        runs.append((size, whole, first, k * size))
                    open_runs[capacity - per * size].append((first, whole))
                    first += whole
                if over:
                    for k in range(over):
                        runs.append((size, 1, first, k * size))
                    open_runs[capacity - over * size].append((first, 1))
                    first += 1
                left = 0
            else:
                start, many = open_runs[room].pop()
                take = min(left, many)
                runs.append((size, take, start, capacity - room))
                if many > take:
                    open_runs[room].append((start + take, many - take))
                open_runs[room - size].append((start, take))
                left -= take
                room = size
    return runs, first


def plan_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, times, first sequence, offset) that place every piece of the histogram."""
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    runs: list[tuple[int, int, int, int]] = []
    first = 0
    for group, times in reduce_by_dominance(counts, capacity):
        offset = 0
        for size in group:
            runs.append((size, times, first, offset))
            offset += size
        first += times
    runs += best_fit(counts, capacity, first)[0]
    ranks: dict[int, int] = {}
    out = []
    for size, times, start, offset in runs:
        rank = ranks.get(size, 0)
        out.append((size, rank, times, start, offset))
        ranks[size] = rank + times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places pieces (length and salt are read) and returns them with sequence_id and offset."""
    pieces = materialize(pieces, "pieces")
    dealt = pieces.groupBy("length", "salt").count().collect()  # capacity x SALTS rows at most
    histogram: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for row in sorted(dealt, key=lambda r: (r["length"], r["salt"])):
        base[row["length"], row["salt"]] = histogram.get(row["length"], 0)
        histogram[row["length"]] = histogram.get(row["length"], 0) + row["count"]
    by_size: dict[int, list[tuple[int, int, int, int]]] = {}
    for size, rank, times, start, offset in plan_runs(histogram, capacity):
        by_size.setdefault(size, []).append((rank, times, start, offset))
    tables = {size: np.asarray(x, np.int64) for size, x in by_size.items()}
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task holds whole (length, salt) groups, which it numbers in an order that another attempt finds again
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            sizes, salts = batch.column("length").to_numpy(), batch.column("salt").to_numpy().astype(np.int64)
            key = sizes * SALTS + salts
            order = np.argsort(key, kind="stable")
            run_starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, np.int64)
            sequence, offset = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
            for s, e in zip(run_starts, np.r_[run_starts[1:], len(key)], strict=True):
                rows = order[s:e]
                size, salt = int(sizes[rows[0]]), int(salts[rows[0]])
                rank = base[size, salt] + seen.get((size, salt), 0) + np.arange(e - s)
                seen[size, salt] = seen.get((size, salt), 0) + int(e - s)
                t = tables[size]
                k = np.searchsorted(t[:, 0], rank, "right") - 1
                sequence[rows], offset[rows] = t[k, 2] + rank - t[k, 0], t[k, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], schema=arrow)

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt_again = pieces.repartition(n, "length", "salt").sortWithinPartitions("length", "salt", "doc_id", "piece", "start", "ids_crc32")
    return dealt_again.mapInArrow(place, schema).drop("salt")


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    return pack(tokenized_pieces(docs, tokenizer, end_id, capacity), capacity)
