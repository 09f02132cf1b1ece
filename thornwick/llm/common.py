"""Shared pieces of the training-data operators: shared scratch tables and vectorised word hashing."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = tempfile.mkdtemp(prefix="thornwick-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/thornwick-{uuid.uuid4().hex}/{name}"


#: Rows of an Arrow batch while a table is written; Python workers and JVM hold some of both sides at once.
BATCH_ROWS = 1000

#: The lists of tables that the calls of `settled` around this point have to delete, one a call; each thread has its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())

_writing: dict[str, tuple[int, str]] = {}  # by session: how many tables are being written, and the rows of a batch before
_lock = threading.Lock()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS while a table of the session is written; the last of several writers at once restores the setting."""
    key, session = "spark.sql.execution.arrow.maxRecordsPerBatch", spark._jsparkSession.sessionUUID()
    with _lock:
        n, before = _writing.get(session, (0, spark.conf.get(key)))
        _writing[session] = n + 1, before
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(session)
            if n > 1:
                _writing[session] = n - 1, before
            else:
                spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df once to the shared folder and reads it back. Arrow batches hold BATCH_ROWS meanwhile."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for scope in _scopes.get():
        scope.append(path)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make's result as a table; the tables that make wrote on its way are deleted, also if it fails."""
    spark, scope = SparkSession.active(), []
    token = _scopes.set((*_scopes.get(), scope))
    try:
        df = make()
    except BaseException:
        drop_tables(spark, scope)
        raise
    finally:
        _scopes.reset(token)
    found = materialize(df, name)
    drop_tables(spark, scope)
    return found


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of the shared folder that nothing reads any more."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()  # each table has a folder of its own
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# --- words as arrays -------------------------------------------------------------------------------------------

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SAME = np.arange(256, dtype=np.uint8)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for n positions at least; the longest asked for so far are kept."""
    size = 1 << max(18, (int(n) - 1).bit_length())
    kept = max(_powers, default=0)
    if size <= kept <= 1 << 20 or size == kept:
        return _powers[kept]
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def run_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial hash of each run values[start:end], the same wherever the run stands."""
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _M2)


def text_chunks(column: pa.Array, target: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows with about target bytes; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words_of(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's words: hashes, byte starts, byte ends, and the index of each row's first word (one more at the end).

    breaks marks the bytes that separate words, fold maps bytes before hashing."""
    rows = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(_U), none, none, np.zeros(rows + 1, np.int64)
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = run_hash(fold[data].astype(_U) + _U(1), starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offsets)
