"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes, and how often documents link them.

A text, with a space before it, is encoded by a byte-level vocabulary (A) and by a sentencepiece model (B), which adds that
space itself. Byte offsets where tokens of both end cut the tokens into groups, and all pairs of an A and a B token of a group are
links. The corpus-wide count of an id pair is the number of documents that link it.

Encoding cuts a text before each space that follows no white space: neither tokenizer has a token that crosses it (A's pattern
never does, B has no such piece, which is checked when the model is loaded), so tokens, groups and links of the stretch
are its own, whatever the text, and each distinct stretch is encoded and aligned once a worker. Texts with white space outside
ASCII, and all texts if B had such a piece, are encoded whole.

The counts come from a cogroup of postings. Each document's pairs with their multiplicities are dealt by the A id to buckets, so
that all counts of an A id lie in one, and by salts within a bucket, so that an id that every document holds is no one
task's. Counts of documents are summed by pair before they are dealt, once to each salt. Both streams are sorted by bucket, salt
and kind (Spark's sort, which spills): a task reads a bucket's counts first, finds each A id's highest, and then looks up
one block of postings after another. What they give to a document is summed by document.

Defined results: null and empty texts, and texts whose tokens' bytes differ from space and text (a literal U+2581), have no tokens: zeros and
groups of ''; repeated rows count as documents each; a null doc_id is kept; very long texts are read whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thornwick.llm.common import SPACE, materialize, run_hash, settled, text_chunks
from thornwick.llm.tokens import _wide_space, load

_U = np.uint64
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
STORE, CHUNK = 300_000, 1 << 19
PAIRS_A_BUCKET, BYTES_A_SALT = 1 << 20, 32 << 20


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_pieces(name: str):
    """A sentencepiece model of the public folder, by file name or path."""
    import os

    import sentencepiece

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return sentencepiece.SentencePieceProcessor(model_file=name)


class Lists:
    """Arrays of differing lengths, one after another."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values, self.sizes = values, np.asarray(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)

    def take(self, at: np.ndarray) -> np.ndarray:
        """The values of the lists at these places, one after another."""
        sizes = self.sizes[at]
        upto = np.cumsum(sizes)
        return self.values[np.repeat(self.ends[at] - upto, sizes) + np.arange(upto[-1] if len(upto) else 0)]

    def head(self, n: int) -> Lists:
        return Lists(self.values[: self.ends[n - 1] if n else 0], self.sizes[:n])

    def plus(self, more: Lists) -> Lists:
        return Lists(np.concatenate((self.values, more.values)), np.concatenate((self.sizes, more.sizes)))

    @staticmethod
    def of(values: list[bytes]) -> Lists:
        return Lists(np.frombuffer(b"".join(values), np.uint8), np.asarray([len(x) for x in values], np.int64))


class Aligned(NamedTuple):
    """What alignment gives for some stretches."""

    n: np.ndarray  # A tokens, B tokens, groups, links, and 1 where the tokens' bytes are the stretch's; else zeros
    strings: Lists  # groups as bytes, each with ; behind it
    pairs: Lists  # distinct links
    times: Lists  # how often each comes

    def plus(self, more: Aligned) -> Aligned:
        return Aligned(np.concatenate((self.n, more.n)), *[x.plus(y) for x, y in zip(self[1:], more[1:], strict=True)])

    def head(self, n: int) -> Aligned:
        return Aligned(self.n[:n], *[x.head(n) for x in self[1:]])


def _nothing() -> Aligned:
    none = lambda kind: Lists(np.zeros(0, kind), np.zeros(0, np.int64))
    return Aligned(np.zeros((0, 5), np.int64), none(np.uint8), none(np.int64), none(np.int64))


def _written(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of each id with its mark behind them, as bytes, and how many bytes each takes."""
    width = len(str(int(ids.max(initial=0))))
    digits = ids[:, None] // 10 ** np.arange(width - 1, -1, -1)
    size = np.maximum(1, (digits > 0).sum(axis=1))
    out = np.concatenate(((digits % 10 + 48).astype(np.uint8), marks[:, None]), axis=1)
    return out[np.arange(width + 1) >= width - size[:, None]], size + 1


def _sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by an index in order."""
    upto = np.concatenate(([0], np.cumsum(values)))
    edges = np.searchsorted(of, np.arange(n + 1))
    return upto[edges[1:]] - upto[edges[:-1]]


class Aligner:
    """Encodes and aligns columns of texts; holds the stretches that it has met."""

    def __init__(self, a: str = A, b: str = B, store: int = STORE) -> None:
        self.a, self.b, self.store = load(a), load_pieces(b), store
        values = byte_values()
        decode = lambda token: bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.bytes_a = Lists.of([decode(self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())])
        self.bytes_b = Lists.of([bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)])
        self.cuts = not any("▁" in x.lstrip("▁") for x in pieces)
        self.base, self.space = size, self.b.piece_to_id("▁")
        self.slot: dict[int, int] = {}
        self.held = _nothing()

    def _encode(self, texts: list[str]) -> tuple[Lists, Lists]:
        """The ids of both vocabularies for texts that begin with a space."""
        found = self.a.encode(texts, is_pretokenized=True, add_special_tokens=False)
        own = Lists(np.asarray(found.ids, np.int64), np.bincount(np.asarray(found.word_ids, np.int64), minlength=len(texts)))
        lists = [ids or [self.space] for ids in self.b.encode([x[1:] for x in texts], num_threads=1)]  # an empty text gets no space
        return own, Lists(np.fromiter(chain.from_iterable(lists), np.int64), np.asarray([len(x) for x in lists], np.int64))

    def _align(self, stretches: list[bytes]) -> Aligned:
        """Of stretches that begin with a space, each by itself."""
        total = len(stretches)
        raw, (a, b) = Lists.of(stretches), self._encode([x.decode() for x in stretches])
        # a stretch counts where the bytes of both are its own
        sizes = [_sums(t.sizes[x.values], np.repeat(np.arange(total), x.sizes), total) for t, x in ((self.bytes_a, a), (self.bytes_b, b))]
        good = np.flatnonzero((sizes[0] == raw.sizes) & (sizes[1] == raw.sizes))
        own, of = raw.take(good), np.repeat(good, raw.sizes[good])
        odd = np.zeros(total, bool)
        for t, x in ((self.bytes_a, a), (self.bytes_b, b)):
            odd[of[t.take(x.take(good)) != own]] = True
        good = good[~odd[good]]
        a, b = Lists(a.take(good), a.sizes[good]), Lists(b.take(good), b.sizes[good])
        # groups end where tokens of both end, stretches among them
        ends_a, ends_b = np.cumsum(self.bytes_a.sizes[a.values]), np.cumsum(self.bytes_b.sizes[b.values])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        na, nb = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        stretch = good[np.searchsorted(np.cumsum(raw.sizes[good]), both)] if len(good) else good
        n = np.zeros((total, 5), np.int64)
        n[good, 0], n[good, 1], n[good, 4] = a.sizes, b.sizes, 1
        n[:, 2], n[:, 3] = np.bincount(stretch, minlength=total), _sums(na * nb, stretch, total)
        return Aligned(n, self._strings(a.values, b.values, group_a, group_b, na, nb, stretch, total), *self._links(a.values, b.values, na, nb, stretch, total))

    @staticmethod
    def _strings(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, na: np.ndarray, nb: np.ndarray, stretch: np.ndarray, total: int) -> Lists:
        starts = np.cumsum(na + nb) - na - nb  # of each group's tokens, A's before B's
        place_a = starts[group_a] + np.arange(len(a)) - (np.cumsum(na) - na)[group_a]
        place_b = starts[group_b] + na[group_b] + np.arange(len(b)) - (np.cumsum(nb) - nb)[group_b]
        ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        marks[starts + na - 1], marks[starts + na + nb - 1] = ord("|"), ord(";")
        flat, sizes = _written(ids, marks)
        return Lists(flat, _sums(sizes, np.repeat(stretch, na + nb), total))

    def _links(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, stretch: np.ndarray, total: int) -> tuple[Lists, Lists]:
        """Distinct pairs and multiplicities by stretch. Pairs of large groups are made of their distinct ids."""
        first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        small = np.flatnonzero(na * nb <= 4096)
        links = (na * nb)[small]
        g = np.repeat(small, links)
        k = np.arange(len(g)) - np.repeat(np.cumsum(links) - links, links)
        pairs = [a[first_a[g] + k // nb[g]] * self.base + b[first_b[g] + k % nb[g]]]
        rows, times = [stretch[g]], [np.ones(len(g), np.int64)]
        for g in np.flatnonzero(na * nb > 4096).tolist():
            (x, c), (y, d) = (np.unique(v[f[g] : f[g] + m[g]], return_counts=True) for v, f, m in ((a, first_a, na), (b, first_b, nb)))
            pairs.append((x[:, None] * self.base + y[None, :]).ravel())
            times.append((c[:, None] * d[None, :]).ravel())
            rows.append(np.full(len(x) * len(y), stretch[g]))
        found, times, sizes = _merged(np.concatenate(rows), np.concatenate(pairs), np.concatenate(times), total)
        return Lists(found, sizes), Lists(times, sizes)

    def column(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """For rows i to j of a column: n (five numbers a row), group strings, and the pairs, multiplicities and number of pairs of each row."""
        for i, j, data, offsets in text_chunks(texts, CHUNK):
            rows = j - i
            full = np.diff(offsets) > 0
            data = np.insert(data, offsets[:-1], 0x20)
            offsets = offsets + np.arange(rows + 1)
            space = SPACE[data]
            cut = np.r_[False, (data[1:] == 0x20) & ~space[:-1]] if self.cuts else np.zeros(len(data), bool)
            for r in np.unique(np.searchsorted(offsets, _wide_space(data), "right") - 1).tolist():
                cut[offsets[r] : offsets[r + 1]] = False
            cut[offsets[:-1]] = True
            starts = np.flatnonzero(cut)
            ends = np.r_[starts[1:], len(data)]
            first = np.searchsorted(starts, offsets)
            slots = self._slots(data, starts, ends)
            n = np.add.reduceat(self.held.n[slots], first[:-1], axis=0)
            good = full & (n[:, 4] == np.diff(first))
            n[~good] = 0
            row = np.repeat(np.arange(rows), np.diff(first))
            slots, row = slots[good[row]], row[good[row]]
            flat = self.held.strings.take(slots).tobytes()
            upto = np.concatenate(([0], np.cumsum(_sums(self.held.strings.sizes[slots], row, rows)))).tolist()
            strings = [flat[s : e - 1] if e > s else b"" for s, e in zip(upto[:-1], upto[1:], strict=True)]
            pairs, times, sizes = _merged(np.repeat(row, self.held.pairs.sizes[slots]), self.held.pairs.take(slots), self.held.times.take(slots), rows)
            yield i, j, n, strings, pairs, times, sizes

    def _forget(self) -> None:
        """Keeps the earliest, most frequent half, or nothing where few stretches (whole texts) hold most links."""
        half = min(self.store // 2, len(self.held.n))
        if int(self.held.pairs.sizes[:half].sum()) > 4 * self.store:
            half = 0
        self.slot, self.held = {k: s for k, s in self.slot.items() if s < half}, self.held.head(half)

    def _slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys, at, inverse = np.unique(run_hash(data.astype(_U) + _U(1), starts, ends), return_index=True, return_inverse=True)
        if len(self.held.n) > self.store or len(self.held.pairs.values) > 8 * self.store:
            self._forget()
        names = keys.tolist()
        slots = list(map(self.slot.get, names))
        missing = [k for k, s in enumerate(slots) if s is None]
        if missing:
            raw, base = data.tobytes(), len(self.held.n)
            self.held = self.held.plus(self._align([raw[s:e] for s, e in zip(starts[at[missing]].tolist(), ends[at[missing]].tolist(), strict=True)]))
            for s, k in enumerate(missing, base):
                slots[k] = self.slot[names[k]] = s
        return np.asarray(slots, np.int64)[inverse]


def _merged(rows: np.ndarray, pairs: np.ndarray, times: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of each row in order, their summed multiplicities, and how many each row has."""
    order = np.lexsort((pairs, rows))
    rows, pairs, times = rows[order], pairs[order], times[order]
    new = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]) | (rows[1:] != rows[:-1])]) if len(pairs) else np.zeros(0, np.int64)
    return pairs[new], np.add.reduceat(times, new) if len(new) else times, np.bincount(rows[new], minlength=total)


@cache
def aligner(a: str, b: str) -> Aligner:
    """The worker's own, which later tasks of the worker find filled."""
    return Aligner(a, b)


def _packed(*arrays: np.ndarray) -> bytes:
    """Sorted pairs as differences, and other columns of the same length, as zstd bytes."""
    columns = [np.diff(arrays[0], prepend=0), *arrays[1:]]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.astype("<i8").tobytes() for x in columns))


def _unpacked(raw: bytes, columns: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i8").reshape(columns, -1)
    return [np.cumsum(flat[0]), *flat[1:]]


def _documents(a: str, b: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        for batch in batches:
            for i, j, n, strings, pairs, times, sizes in own.column(batch.column("text")):
                groups = [(hashlib.sha256(x).hexdigest() if x else "") if digest else x.decode() for x in strings]
                ends = np.cumsum(sizes)
                postings = [_packed(pairs[e - s : e], times[e - s : e]) if s else None for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                arrays = [batch.column("doc_id").slice(i, j - i), *[pa.array(n[:, k]) for k in range(4)], pa.array(groups, pa.string()), pa.array(postings, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "postings"])

    return run


def aligned_documents(docs: DataFrame, a: str = A, b: str = B, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`: ids of each group, or their sha256) and postings (the
    document's pairs, A id * size of B + B id, with multiplicities)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_documents(a, b, digest), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, postings binary")


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_unpacked(x.as_buffer(), 2)[0] for x in batch.column("postings")]
        pairs, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair and n, the number of documents that link it."""
    return aligned.filter("postings IS NOT NULL").select("postings").mapInArrow(_partial_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((ids.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(33)).astype(np.int64) % buckets


def _blocks(keys: np.ndarray, buckets: int, *columns: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A packed block of the columns for each bucket of the keys; columns[0] is sorted within it."""
    of = _bucket(keys, buckets)
    order = np.lexsort((columns[0], of))
    edges = np.searchsorted(of[order], np.arange(buckets + 1))
    held = np.flatnonzero(np.diff(edges))
    packed = [_packed(*[c[order[edges[k] : edges[k + 1]]] for c in columns]) for k in held.tolist()]
    return pa.array(held.astype(np.int32)), pa.array(packed, pa.binary())


def _deal_postings(base: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_unpacked(x.as_buffer(), 2) for x in batch.column("postings")]
            if not found:
                continue
            row = np.repeat(batch.column("row").to_numpy(), [len(x[0]) for x in found])
            pairs, times = (np.concatenate(x) for x in zip(*found, strict=True))
            bucket, block = _blocks(pairs // base, buckets, pairs, times, row)
            yield pa.RecordBatch.from_arrays([bucket, pa.array(np.repeat(batch.column("row").to_numpy()[:1], len(bucket))), block], ["bucket", "chunk", "block"])

    return run


def _deal_counts(base: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = batch.column("pair").to_numpy(), batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays(list(_blocks(pairs // base, buckets, pairs, n)), ["bucket", "block"])

    return run


def _contributions(base: int):
    """row, n_best and count_sum of each block of postings, looked up in the counts that stand before them in the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts, known = None, [], None
        for batch in batches:
            for bucket, salt, kind, block in zip(*(batch.column(c) for c in ("bucket", "salt", "kind", "block")), strict=True):
                here = bucket.as_py(), salt.as_py()
                if here != at:
                    at, counts, known = here, [], None
                if kind.as_py() == 0:
                    counts.append(_unpacked(block.as_buffer(), 2))
                    continue
                if known is None:
                    pairs, n = (np.concatenate(x) for x in zip(*counts, strict=True))
                    order = np.argsort(pairs)
                    pairs, n, counts = pairs[order], n[order], []
                    side = np.flatnonzero(np.r_[True, np.diff(pairs // base) > 0])
                    known = pairs, n, n == np.repeat(np.maximum.reduceat(n, side), np.diff(np.r_[side, len(n)]))
                pairs, times, row = _unpacked(block.as_buffer(), 3)
                place = np.searchsorted(known[0], pairs)
                rows, of = np.unique(row, return_inverse=True)
                best, total = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                np.add.at(best, of, times * known[2][place])
                np.add.at(total, of, times * known[1][place])
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(best), pa.array(total)], ["row", "n_best", "count_sum"])

    return run


def link_counts(aligned: DataFrame, base: int) -> DataFrame:
    """row, n_best and count_sum of each row of a table of aligned documents (row, postings) that has links."""
    held = aligned.filter("postings IS NOT NULL").select("row", "postings")
    counts = materialize(pair_counts(held), "counts")
    buckets = max(8, -(-counts.count() // PAIRS_A_BUCKET))
    size = held.agg(F.coalesce(F.sum(F.length("postings")), F.lit(0))).first()[0]
    tasks = 2 * int(aligned.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # so that none holds much more than another
    salts = max(-(-size // (buckets * BYTES_A_SALT)), -(-tasks // buckets))
    posted = held.mapInArrow(_deal_postings(base, buckets), "bucket int, chunk long, block binary")
    posted = posted.select("bucket", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "block")
    first = counts.mapInArrow(_deal_counts(base, buckets), "bucket int, block binary")
    first = first.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "block")
    dealt = posted.union(first).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind")
    found = dealt.mapInArrow(_contributions(base), "row long, n_best long, count_sum long")
    return found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, a: str = A, b: str = B, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A id's), count_sum (of counts over links) and
    groups of every row of docs."""
    aligned = materialize(aligned_documents(docs, a, b, digest).withColumn("row", F.monotonically_increasing_id()), "aligned")
    base = load_pieces(b).get_piece_size()
    counts = settled("links", lambda: link_counts(aligned, base))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("postings").join(counts, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups")
