"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

Shard file: ids as little-endian unsigned 16-bit (vocabularies under 65,536) or 32-bit integers, documents in ascending
key order, one after another, no header. Shards are ranges of keys, so that their order is the order of keys.

Index bucket file (keys are dealt to buckets by hash): a header (magic, slots, displacement groups; three little-endian
unsigned 32-bit integers), one unsigned 32-bit displacement a group, then a record a slot: fingerprint u32, shard u32,
offset in ids u64, length u64. A key's group names a displacement, the displacement a slot: two places of the file,
whatever the number of keys, and slots are exactly as many as keys. (A bulk lookup reads a bucket's file once, whole.)

Every file is written under a name of its own for each attempt and named in the table of the attempt that counts, so a
retried or speculative task leaves no half-written file behind in use. Files go to a path that driver and executors share.

Defined results: a null text is empty (its end id alone); rows that repeat a doc_id are numbered by a serial, in the order
of a hash of their texts, and each has a record of its own under (doc_id, serial), also if the texts are equal; null
doc_ids come first and are a key of their own. A key that the index misses raises an error when payloads are read. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thornwick.llm.common import materialize, mix, scratch_path
from thornwick.llm.tokens import cached

MAGIC = 0x4D504831
RECORD = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])
_PER_GROUP = 4
_U = np.uint64


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    return fs, path


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


# --- minimal perfect hash --------------------------------------------------------------------------------------


def key_hash(keys: np.ndarray, serials: np.ndarray, none: np.ndarray | bool = False) -> np.ndarray:
    """Distinct for distinct keys but by chance; a key that is none hashes as no other."""
    h = mix(keys.astype(np.int64).view(_U) + _U(0x9E3779B97F4A7C15))
    return mix(np.where(none, _U(0x94D049BB133111EB), h) + serials.astype(_U))


def _hashes(data: pa.RecordBatch | pa.Table) -> np.ndarray:
    keys = data.column("doc_id")
    return key_hash(keys.fill_null(0).to_numpy(), data.column("serial").to_numpy(), np.asarray(keys.is_null()))


def build_mph(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by group, and the slot of each hash (distinct): groups are placed from the largest down."""
    n = len(hashes)
    if len(np.unique(hashes)) < n:
        raise ValueError("two keys have the same hash")
    groups = max(1, -(-n // _PER_GROUP))
    displacement = np.zeros(groups, np.uint32)
    slot = np.full(n, -1, np.int64)
    group = (hashes % _U(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    sizes = np.diff(bounds)
    taken = np.zeros(n, bool)
    for g in np.argsort(-sizes, kind="stable"):
        rows = order[bounds[g] : bounds[g + 1]]
        if not len(rows):
            break
        d = 0
        while True:
            # many displacements are tried at once
            tries = np.arange(d, d + 64, dtype=np.uint64)
            at = (mix(hashes[rows][None, :] ^ mix(tries + _U(1))[:, None]) % _U(n)).astype(np.int64)
            free = ~taken[at].any(axis=1)
            if len(rows) > 1:
                s = np.sort(at, axis=1)
                free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if free.any():
                k = int(np.argmax(free))
                displacement[g], slot[rows], taken[at[k]] = d + k, at[k], True
                break
            d += 64
    return displacement, slot


def find_slots(hashes: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    d = displacement[(hashes % _U(len(displacement))).astype(np.int64)].astype(_U)
    return (mix(hashes ^ mix(d + _U(1))) % _U(n)).astype(np.int64)


def write_bucket(fs: pafs.FileSystem, path: str, hashes: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> None:
    displacement, slot = build_mph(hashes)
    records = np.zeros(len(hashes), RECORD)
    records["fingerprint"][slot] = (hashes >> _U(32)).astype(np.uint32)
    records["shard"][slot], records["offset"][slot], records["length"][slot] = shard, offset, length
    with fs.open_output_stream(path) as out:
        out.write(np.asarray([MAGIC, len(hashes), len(displacement)], "<u4").tobytes() + displacement.astype("<u4").tobytes() + records.tobytes())


class Bucket:
    """One bucket of the index, read back from its file."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        with fs.open_input_stream(path) as f:
            raw = f.read()
        magic, n, groups = np.frombuffer(raw, "<u4", 3)
        if magic != MAGIC:
            raise ValueError(f"{path} is no index bucket")
        self.displacement = np.frombuffer(raw, "<u4", groups, 12)
        self.records = np.frombuffer(raw, RECORD, n, 12 + 4 * int(groups))

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The records of the hashes, and which of them the fingerprints confirm."""
        if not len(self.records):
            return np.zeros(len(hashes), RECORD), np.zeros(len(hashes), bool)
        found = self.records[find_slots(hashes, self.displacement, len(self.records))]
        return found, found["fingerprint"] == (hashes >> _U(32)).astype(np.uint32)


# --- writing ---------------------------------------------------------------------------------------------------

ENTRIES = "doc_id long, serial int, shard int, file string, offset long, n_tokens long"


def write_shards(docs: DataFrame, root: str, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """Encodes docs in key order into shard files under root; an entry a document: its shard, file, offset, length in ids."""
    root = _uri(root)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a doc_id that very many rows repeat is dealt to several shards
    ordered = ordered.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, base = _open(root)
        fs.create_dir(base, recursive=True)
        file = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin"
        encoder = cached(tokenizer, keeps_space=False, store=1_000_000)
        offset, last, serial = 0, object(), 0
        with fs.open_output_stream(f"{base}/{file}") as out:
            for batch in batches:
                docs = batch.column(0).to_pylist()
                for i, j, ids, bounds in encoder.encode_column(batch.column(1)):
                    ids = np.insert(ids, bounds[1:], end_id)
                    if int(ids.max()) >= 1 << 8 * width:
                        raise ValueError("the payload's width doesn't hold an id")
                    out.write(ids.astype(f"<u{width}").tobytes())
                    rows = []
                    for doc, n in zip(docs[i:j], (np.diff(bounds) + 1).tolist(), strict=True):
                        serial = serial + 1 if doc == last else 0
                        last = doc
                        rows.append((doc, serial, shard, file, offset, n))
                        offset += n
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "serial", "shard", "file", "offset", "n_tokens"])

    return _numbered(materialize(ordered.mapInArrow(run, ENTRIES), "entries"))


def _numbered(entries: DataFrame) -> DataFrame:
    """Goes on with the serials of a doc_id that began in an earlier shard."""
    shards = entries.groupBy("shard").agg(F.min(F.struct("doc_id")).alias("lo"), F.max(F.struct("doc_id")).alias("hi"))
    ends = shards.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("d"), "shard")
    spread = materialize(ends.groupBy("d").count().filter("count > 1").select(F.col("d.doc_id").alias("k")), "spread")  # a row for two shards
    if spread.isEmpty():
        return entries
    several = entries.join(F.broadcast(spread), F.col("doc_id").eqNullSafe(F.col("k")), "left_semi").groupBy("doc_id", "shard").count()
    earlier = F.sum("count").over(Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = several.select(F.col("doc_id").alias("k"), F.col("shard").alias("s"), F.coalesce(earlier, F.lit(0)).alias("base"))  # a row a shard and key that spans several
    found = entries.join(F.broadcast(base), F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("shard") == F.col("s")), "left")
    return materialize(found.withColumn("serial", (F.col("serial") + F.coalesce("base", F.lit(0))).cast("int")).select(*entries.columns), "numbered")


def write_index(entries: DataFrame, root: str, buckets: int) -> DataFrame:
    """An index bucket file for each bucket of keys under root: (bucket, file)."""
    root = _uri(root)
    keyed = _bucketed(entries.select("doc_id", "serial", "shard", "offset", "n_tokens"), buckets)

    def build(key: tuple, data: pa.Table) -> pa.Table:
        fs, base = _open(root)
        fs.create_dir(base, recursive=True)
        bucket, file = key[0].as_py(), f"index-{key[0].as_py():06d}-{uuid.uuid4().hex}.mph"
        hashes = _hashes(data)
        write_bucket(fs, f"{base}/{file}", hashes, data.column("shard").to_numpy(), data.column("offset").to_numpy(), data.column("n_tokens").to_numpy())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "index_file": pa.array([file])})

    return materialize(keyed.groupBy("bucket").applyInArrow(build, "bucket int, index_file string"), "index")


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "serial"), F.lit(buckets)).cast("int"))


# --- reading ---------------------------------------------------------------------------------------------------


def lookup(keys: DataFrame, index: DataFrame, root: str, buckets: int) -> DataFrame:
    """Finds keys (doc_id, serial) through the index files alone: doc_id, serial, shard, offset, n_tokens; absent keys give nulls."""
    root = _uri(root)
    with_file = _bucketed(keys.select("doc_id", "serial"), buckets).join(index, "bucket")  # a row for 50,000 keys
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        name, bucket = None, None
        for batch in batches:
            files = np.asarray(batch.column("index_file").to_pylist(), object)
            hashes = _hashes(batch)
            found, sure = np.zeros(len(files), RECORD), np.zeros(len(files), bool)
            for file in dict.fromkeys(files.tolist()):
                if file != name:
                    name, bucket = file, Bucket(fs, f"{base}/{file}")
                rows = np.flatnonzero(files == file)
                found[rows], sure[rows] = bucket.get(hashes[rows])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("serial"), *(pa.array(found[x].astype(t), mask=~sure) for x, t in (("shard", np.int32), ("offset", np.int64), ("length", np.int64)))], ["doc_id", "serial", "shard", "offset", "n_tokens"])

    return with_file.repartition(n, "index_file").sortWithinPartitions("index_file").mapInArrow(run, "doc_id long, serial int, shard int, offset long, n_tokens long")


def read_payloads(found: DataFrame, shards: DataFrame, root: str, width: int) -> DataFrame:
    """Reads each found document's ids from its shard file and returns their crc32 with them: adds ids_crc32, and raises an
    error for a key that was not found."""
    root = _uri(root)
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    sure = F.when(F.col("shard").isNull(), F.raise_error(F.lit("a key is not in the index"))).otherwise(F.col("shard"))
    placed = found.withColumn("shard", sure.cast("int")).join(shards.select("shard", "file"), "shard", "left").select("doc_id", "serial", "shard", "file", "offset", "n_tokens")  # a row a shard
    most = 1 << 22

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        name, source = None, None
        for batch in batches:
            files, offsets, lengths = batch.column("file").to_pylist(), batch.column("offset").to_pylist(), batch.column("n_tokens").to_pylist()
            crcs = []
            lo, window = 0, b""
            for file, offset, length in zip(files, offsets, lengths, strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source, lo, window = file, fs.open_input_file(f"{base}/{file}"), 0, b""
                start, size = offset * width, length * width
                if start < lo or start + size > lo + len(window):
                    lo, window = start, source.read_at(max(size, most), start)
                if len(window) < start - lo + size:
                    raise ValueError(f"{file} is shorter than its index says")
                ids = np.frombuffer(window, f"<u{width}", length, start - lo)
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("serial"), batch.column("shard"), batch.column("offset"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "serial", "shard", "offset", "n_tokens", "ids_crc32"])

    return placed.repartition(n, "shard").sortWithinPartitions("shard", "offset").mapInArrow(run, "doc_id long, serial int, shard int, offset long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, width: int = 2) -> DataFrame:
    """Writes shards and index, then reads every document back by key: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    root = scratch_path(spark, "token-shards")
    entries = write_shards(docs, root, tokenizer, end_id, width)
    shards = entries.groupBy("shard", "file").agg(F.sum("n_tokens").alias("ids"))
    # one row a shard, so its running sum is small whatever the documents
    shards = materialize(shards.withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "shards")
    buckets = max(1, -(-entries.count() // 50_000))
    index = write_index(entries, root, buckets)
    found = lookup(entries.select("doc_id", "serial"), index, root, buckets)
    read = read_payloads(found, shards, root, width)
    return read.join(shards.select("shard", "base"), "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
