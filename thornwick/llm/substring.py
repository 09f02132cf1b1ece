"""Substring dedup by seed and extend: repeated passages of whole texts, wherever they start.

Seeds are runs of `seed_words` words chosen by winnowing, one at least in every `min_words` words, so that a passage of that
length has the same seed wherever it stands. A seed with two places pairs them. A seed with more is lengthened to each
run of `min_words` words around it, and each place of such a run is paired with its first place, so pairs grow with the
places, not with their square, and no place of a run that repeats is without one.

Pairs are gathered by blocks of `block` words and by diagonal (how far the two places are apart). The words of both blocks
are compared along each diagonal, which extends all its seeds both ways at once; stretches of min_words equal words or
more are parts of maximal repeats and cover the words of both sides. A block comes with as many words around it as
a seed in it can need, so extension within blocks finds every run of min_words words that repeats. What is sent is
blocks that hold a paired seed, never whole texts; blocks with very many pairs are dealt over salts; covered words are bits,
joined by bitwise or before they are shuffled.

Equal texts are one text that is known to repeat: all of it is covered if it has min_words words, and one of them alone is
compared with the other texts.

Defined results: a null or empty text has no words; texts under min_words words keep all; repeated rows (of one doc_id or
not) are copies of each other; rows with a null doc_id take part; a text that is wholly covered keeps its row with an
empty text; very long texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thornwick.llm.common import materialize, mix, settled, text_chunks, words_of
from thornwick.llm.graphs import FEW, few, spread, unzipped, words_of_zipped, zipped_texts
from thornwick.llm.linededup import _chosen, _slide, grams, ordered_key

_U = np.uint64
MIN_WORDS, SEED_WORDS, BLOCK = 35, 16, 256
HOT = 1000


def seeds_of(words: np.ndarray, first: np.ndarray, min_words: int, seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places within the row and hashes of the chosen seeds of a chunk's texts, of which first marks the first words."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = grams(words, seed_words)
    whole = np.arange(len(found)) + min_words <= first[1:][row[: len(found)]]
    at = np.flatnonzero(_chosen(found, whole, min_words - seed_words + 1))
    return row[at], at - first[row[at]], found[at]


def _seeds(min_words: int, seed_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column("text")):
                words, _, _, first = words_of(data, offsets)
                row, at, seed = seeds_of(words, first, min_words, seed_words)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(seed.view(np.int64))], ["key", "at", "seed"])

    return run


def _row_words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """Hashes, bytes, byte starts and ends of the words of each row's text (or zstd text)."""
    zipped = "z" in batch.schema.names
    for x in batch.column("z" if zipped else "text"):
        raw = unzipped(x) if zipped else (x.as_py() or "").encode()
        data = np.frombuffer(raw, np.uint8)
        words, starts, ends, _ = words_of(data, np.asarray([0, len(data)]))
        yield words, raw, starts, ends


def _runs(min_words: int, seed_words: int):
    """Places and two hashes of the runs of min_words words whose least seed is among `seeds`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (words, *_) in enumerate(_row_words(batch)):
                least = _slide(grams(words, seed_words), min_words - seed_words + 1, np.minimum)
                at = np.flatnonzero(np.isin(least, batch.column("seeds")[k].values.to_numpy().view(_U)))
                one, two = grams(words, min_words)[at], grams(mix(words ^ _U(0x5BD1E995)), min_words)[at]
                for s in range(0, len(at), 1 << 16):  # what is sent at once
                    e = min(len(at), s + (1 << 16))
                    key = batch.column("key").slice(k, 1).take(pa.array(np.zeros(e - s, np.int64)))
                    yield pa.RecordBatch.from_arrays([key, pa.array(at[s:e].astype(np.int32)), pa.array(one[s:e].view(np.int64)), pa.array(two[s:e].view(np.int64))], ["key", "at", "r1", "r2"])

    return run


def with_owner(places: DataFrame, by: list[str]) -> DataFrame:
    """places with the owner, owner_at (of the place with the least key, one of its own if it has several) and n, the number of
    places, of what has several. What has more than HOT is joined where its places lie, not in one task."""
    found = places.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("owner"), F.min_by("at", "key").alias("owner_at"))
    found = materialize(found.filter("n > 1"), "owners")
    hot = few(found.filter(F.col("n") > HOT))  # a row for HOT places at most
    cold = places.join(hot.select(*by), by, "left_anti").join(found.filter(F.col("n") <= HOT), by)
    return places.join(hot, by).unionByName(cold)


def _joined(texts: DataFrame, asked: DataFrame, rows: int) -> DataFrame:
    """texts with the columns of asked (key and an array, `rows` elements of a few bytes in all)."""
    return texts.join(F.broadcast(asked), "key") if rows <= FEW else zipped_texts(texts).join(asked, "key")


def paired_blocks(texts: DataFrame, kind: str, min_words: int, seed_words: int, block: int) -> DataFrame:
    """key (of row and block), owner (of row and block) and the diagonals on which they share a seed."""
    seeds = materialize(texts.mapInArrow(_seeds(min_words, seed_words), f"key {kind}, at int, seed long"), "seeds")
    shared = materialize(with_owner(seeds, ["seed"]), "shared")
    common = shared.filter("n > 2")
    asked = common.groupBy("key").agg(F.collect_set("seed").alias("seeds"))
    runs = _joined(texts, asked, common.count()).mapInArrow(_runs(min_words, seed_words), f"key {kind}, at int, r1 long, r2 long")
    runs = materialize(runs, "runs")
    columns = ["key", "at", "owner", "owner_at"]
    found = shared.filter("n = 2").select(*columns).union(with_owner(runs, ["r1", "r2"]).select(*columns))
    found = found.filter((F.col("key") != F.col("owner")) | (F.col("at") != F.col("owner_at")))
    place = lambda key, at: F.struct(F.col(key).alias("row"), F.floor(F.col(at) / block).cast("int").alias("block"))
    found = found.select(place("key", "at").alias("key"), place("owner", "owner_at").alias("owner"), (F.col("owner_at") - F.col("at")).alias("diagonal"))
    return found.groupBy("key", "owner").agg(F.collect_set("diagonal").alias("diagonals"))  # fewer than 2 * block


def _blocks(block: int, before: int, after: int):
    """The words of the asked blocks, with `before` words before and `after` words after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for k, (words, raw, starts, ends) in enumerate(_row_words(batch)):
                asked = batch.column("blocks")[k].values.to_numpy()
                for s in range(0, len(asked), 1024):  # what is sent at once
                    some = asked[s : s + 1024]
                    z = [pack(raw[starts[max(0, b * block - before)] : ends[min(len(words), (b + 1) * block + after) - 1]]) for b in some.tolist()]
                    key = batch.column("key").slice(k, 1).take(pa.array(np.zeros(len(some), np.int64)))
                    yield pa.RecordBatch.from_arrays([key, pa.array(some), pa.array(z, pa.binary())], ["row", "block", "z"])

    return run


def equal_stretches(a: np.ndarray, b: np.ndarray, shift: int, least: int) -> list[tuple[int, int]]:
    """Stretches [start, end) of a of `least` or more values in which a[i] == b[i + shift]."""
    lo, hi = max(0, -shift), min(len(a), len(b) - shift)
    if hi - lo < least:
        return []
    edges = np.flatnonzero(np.diff(np.r_[False, a[lo:hi] == b[lo + shift : hi + shift], False]))
    return [(lo + s, lo + e) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if e - s >= least]


def _extended(block: int, before: int, min_words: int, width: int):
    """The covered words of each side of the pairs, as bits from `before` words ahead of the block; merged within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c) for c in ("key", "owner")]
            numbers = [x.field("block").to_numpy() for x in sides]
            # distinct blocks of the batch, each with one row of bits
            names = [x.as_py() for x in pa.concat_arrays(sides)]
            slot: dict = {}
            at = [slot.setdefault(repr(x), len(slot)) for x in names]
            bits = np.zeros((len(slot), width * 64), np.uint8)
            n = batch.num_rows
            texts = zip(words_of_zipped(batch.column("z")), words_of_zipped(batch.column("owner_z")), batch.column("diagonals"), strict=True)
            for k, (a, b, diagonals) in enumerate(texts):
                # of both slices, the row's word that is their first
                first, other = (max(0, int(x[k]) * block - before) for x in numbers)
                mine, theirs = (int(x[k]) * block - before for x in numbers)
                for d in diagonals.values.to_numpy().tolist():
                    for s, e in equal_stretches(a, b, d + first - other, min_words):
                        bits[at[k], s + first - mine : e + first - mine] = 1
                        bits[at[n + k], s + first + d - theirs : e + first + d - theirs] = 1
            one = np.zeros(len(slot), np.int64)
            one[np.asarray(at[::-1], np.int64)] = np.arange(2 * n)[::-1]  # a row that names each block
            held = np.flatnonzero(bits.any(axis=1)) if len(slot) else one
            packed = np.packbits(bits[held], axis=1, bitorder="little").view("<i8") if len(held) else np.zeros((0, width), np.int64)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(sides).take(pa.array(one[held])), *[pa.array(packed[:, w]) for w in range(width)]], ["key", *[f"b{w}" for w in range(width)]])

    return run


def covered_blocks(texts: DataFrame, kind: str, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS, block: int = BLOCK) -> DataFrame:
    """row, block and the bits of its covered words (b0, b1 ... from before(min_words, seed_words) words ahead of the block)."""
    before, after = min_words - seed_words, min_words
    width = -(-(before + block + after) // 64)
    pairs = settled("pairs", lambda: paired_blocks(texts, kind, min_words, seed_words, block))
    needed = materialize(pairs.select("key.*").union(pairs.select("owner.*")).distinct(), "needed")
    asked = needed.groupBy(F.col("row").alias("key")).agg(F.collect_list("block").alias("blocks"))
    cut = _joined(texts, asked, needed.count()).mapInArrow(_blocks(block, before, after), f"row {kind}, block int, z binary")
    blocks = materialize(cut.dropDuplicates(["row", "block"]), "blocks")  # rows of one key have one text
    blocks = blocks.select(F.struct("row", "block").alias("key"), "z")
    both = spread(pairs, blocks).join(blocks, "key").select("key", "owner", "diagonals", "z", "owner_z")
    named = ", ".join(f"b{w} long" for w in range(width))
    found = both.mapInArrow(_extended(block, before, min_words, width), f"key struct<row:{kind},block:int>, {named}")
    return found.groupBy("key").agg(*[F.bit_or(f"b{w}").alias(f"b{w}") for w in range(width)]).select("key.*", *[f"b{w}" for w in range(width)])


def _cut(block: int, before: int, min_words: int):
    """Kept text, number of words, of removed words and the covered spans of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covers = batch.column("covers")
            for i, j, data, offsets in text_chunks(batch.column("text")):
                words, starts, ends, first = words_of(data, offsets)
                gone = np.zeros(len(words) + 1, bool)
                whole = batch.column("copied").slice(i, j - i).to_numpy(zero_copy_only=False)
                for k in range(j - i):
                    s, e = int(first[k]), int(first[k + 1])
                    if e - s < min_words:
                        continue
                    if whole[k]:
                        gone[s:e] = True
                    elif (cover := covers[i + k]).is_valid:
                        numbers = cover.values.field("block").to_numpy()
                        bits = np.stack([cover.values.field(f).to_numpy() for f in range(1, cover.values.type.num_fields)], axis=1)
                        for b, on in zip(numbers.tolist(), np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little").view(bool), strict=True):
                            at = b * block - before
                            lo, hi = max(0, at), min(e - s, at + len(on))
                            gone[s + lo : s + hi] |= on[lo - at : hi - at]
                keep = ~gone[:-1]
                # a kept word and the byte after it, which becomes a space but for a text's last
                mark = np.zeros(len(data) + 2, np.int32)
                row = np.repeat(np.arange(j - i), np.diff(first))
                kept = np.flatnonzero(keep)
                last = np.r_[row[kept][1:] != row[kept][:-1], True] if len(kept) else np.zeros(0, bool)
                np.add.at(mark, starts[kept], 1)
                np.add.at(mark, ends[kept] + ~last, -1)
                out = np.r_[data, np.zeros(1, np.uint8)]
                out[ends[kept][~last]] = 0x20
                chosen = np.cumsum(mark[:-1]) > 0
                raw = out[chosen]
                sizes = np.concatenate(([0], np.cumsum(chosen)))[offsets]
                texts = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(raw)])
                n = np.diff(first)
                removed = n - np.diff(np.concatenate(([0], np.cumsum(keep)))[first])
                arrays = [batch.column("doc_id").slice(i, j - i), texts.cast(pa.string()), pa.array(n), pa.array(removed), _spans(gone[:-1], first)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_words", "n_removed", "spans"])

    return run


def _spans(gone: np.ndarray, first: np.ndarray) -> pa.Array:
    """Starts and ends, one after another, of each row's runs of covered words."""
    none = np.zeros(0, np.int32)
    rows = [np.flatnonzero(np.diff(np.r_[False, gone[s:e], False])).astype(np.int32) if gone[s:e].any() else none for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([none, *rows])))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, text (the words that no repeat covers, with a space between), n_words, n_removed and spans (start and end of each
    covered stretch of words, one after another) of every row of docs."""
    key, kind = ordered_key(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text.alias("text")).withColumns({"x1": F.xxhash64("text"), "x2": F.xxhash64(F.lit(1), "text")})
    copies = rows.groupBy("x1", "x2").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).filter("n > 1").drop("n")
    copies = materialize(copies, "copies")
    if copies.count() <= FEW:
        single = rows.join(F.broadcast(copies), ["x1", "x2"], "left").filter("first IS NULL OR key = first").select("key", "text")
    else:  # texts are shuffled by their own keys, not by those of copies
        others = rows.drop("text").join(copies, ["x1", "x2"]).filter("key <> first").select("key").distinct()
        single = rows.select("key", "text").join(others, "key", "left_anti")
    covers = settled("covers", lambda: covered_blocks(single, kind, min_words, seed_words, block))
    bits = [c for c in covers.columns if c not in ("row", "block")]
    by_row = covers.groupBy(F.col("row").alias("key")).agg(F.collect_list(F.struct("block", *bits)).alias("covers"))
    joined = rows.join(F.broadcast(by_row) if covers.count() <= FEW // 2 else by_row, "key", "left")
    marked = joined.join(few(copies.withColumn("copied", F.lit(True))), ["x1", "x2"], "left")
    marked = marked.select("doc_id", "text", "covers", F.coalesce("copied", F.lit(False)).alias("copied"))
    return marked.mapInArrow(_cut(block, min_words - seed_words, min_words), "doc_id long, text string, n_words long, n_removed long, spans array<int>")
