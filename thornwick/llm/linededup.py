"""Line dedup by pairwise alignment of documents that share rare lines.

Passages often lie inside longer physical lines, so the lines that are compared are content-defined: stretches of
`line_words` words chosen by winnowing, one at least in any `min_words` words. A line that two documents hold is rare: it
pairs them, the later with the first (smallest doc_id, then a hash of the text). One that more hold is too common to
pair by; each stretch of `min_words` words around it is taken instead, and each later document is paired with
the first that holds all of it. So a line that very many documents share makes one pair a document and stretch.

A pair is aligned by patience diff over the lines from each word (lines unique in both anchor the alignment, the stretches
between are aligned in turn), and what that leaves over, as it comes in another order or repeats, is aligned by itself, again
until no line of the later document that the first holds is left. Aligned runs of line_words are what the later document repeats; runs of
its owners that touch join, and where a joined run has min_words words it is deleted from the later document. Shorter
overlaps (a heading, a licence line, a short line that repeats) stay.

Any run of min_words words that documents have in common holds a line that all of them choose. If two share that line,
they are a pair; if more do, each is paired with the first that holds the whole run. So none is missed, however many share it.

Defined results: a null text stays null, an empty one empty; rows that repeat both doc_id and text are one document and are
not compared; rows of one doc_id with different texts are documents in the order of a hash of the text; a document that is
wholly repeated keeps its row with an empty text;
rows with a null doc_id come last, by the hash; all columns are kept, and n_chars, where there is one, is the new length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thornwick.llm.common import materialize, run_hash, settled, text_chunks, words_of
from thornwick.llm.graphs import FEW, KEY, few, paired_texts, row_key, words_of_zipped, zipped_texts

_U = np.uint64


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position."""
    n = len(words) - k + 1
    if n <= 0:
        return words[:0]
    at = np.arange(n)
    return run_hash(words, at, at + k)


def _slide(x: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """pick over each window of w values."""
    step = 1
    while 2 * step <= w:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[: len(x) - (w - step)], x[w - step :]) if w > step else x


def chosen_lines(hashes: np.ndarray, window: int) -> np.ndarray:
    """Those hashes that are the least of some window of them (none if there is no whole window)."""
    return hashes[_chosen(hashes, np.arange(len(hashes)) + window <= len(hashes), window)]


def _chosen(hashes: np.ndarray, whole: np.ndarray, window: int) -> np.ndarray:
    """Where a hash is the least of a window of them; whole marks where windows start that count."""
    if len(hashes) < window:
        return np.zeros(len(hashes), bool)
    least = np.where(whole[: len(hashes) - window + 1], _slide(hashes, window, np.minimum), _U(0))
    ends = np.zeros(window - 1, _U)
    at = _slide(np.r_[ends, least, ends], window, np.maximum)
    return (at == hashes) & (at > 0)


def _lines(min_words: int, line_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column("text")):
                words, _, _, first = words_of(data, offsets)
                row = np.repeat(np.arange(j - i), np.diff(first))
                found = grams(words, line_words)  # those across two texts are in no window that counts
                whole = np.arange(len(found)) + min_words <= first[1:][row[: len(found)]]
                at = np.flatnonzero(_chosen(found, whole, min_words - line_words + 1))
                order = at[np.lexsort((found[at], row[at]))]
                h, r = found[order], row[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i).take(pa.array(r[new])), pa.array(h[new].view(np.int64))], ["key", "line"])

    return run


def _stretches(min_words: int, line_words: int, zipped: bool):
    """The distinct stretches of min_words words whose chosen line is among `lines`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words_of_zipped(batch.column("z")) if zipped else _words(batch.column("text"))
            for i in range(0, batch.num_rows, 64):  # what is sent at once
                part = batch.slice(i, 64)
                found = []
                for asked in part.column("lines"):
                    words = next(texts)
                    least = _slide(grams(words, line_words), min_words - line_words + 1, np.minimum)
                    found.append(np.unique(grams(words, min_words)[np.isin(least, asked.values.to_numpy().view(_U))]))
                rows = np.repeat(np.arange(part.num_rows), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(rows)), pa.array(np.concatenate(found).view(np.int64))], ["key", "stretch"])

    return run


def _words(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_chunks(texts):
        words, _, _, first = words_of(data, offsets)
        for s, e in zip(first[:-1], first[1:], strict=True):
            yield words[s:e]


def patience(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Aligned common runs (start in a, start in b, length) of two arrays of hashes, in order."""
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    held = np.concatenate(([0], np.cumsum(np.isin(a, b))))  # how many of a, up to each, b has somewhere
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        n = min(ahi - alo, bhi - blo)
        if n <= 0 or held[ahi] == held[alo]:
            continue
        differ = np.flatnonzero(a[alo : alo + n] != b[blo : blo + n])
        head = int(differ[0]) if len(differ) else n
        if head:
            out.append((alo, blo, head))
            todo.append((alo + head, ahi, blo + head, bhi))
            continue
        differ = np.flatnonzero(a[ahi - n : ahi][::-1] != b[bhi - n : bhi][::-1])
        tail = int(differ[0]) if len(differ) else n
        if tail:
            out.append((ahi - tail, bhi - tail, tail))
            todo.append((alo, ahi - tail, blo, bhi - tail))
            continue
        ua, ia, ca = np.unique(a[alo:ahi], return_index=True, return_counts=True)
        ub, ib, cb = np.unique(b[blo:bhi], return_index=True, return_counts=True)
        ia, ua, ib, ub = ia[ca == 1], ua[ca == 1], ib[cb == 1], ub[cb == 1]
        _, pa_, pb_ = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
        if not len(pa_):
            continue
        order = np.argsort(ia[pa_])
        xs, ys = ia[pa_][order] + alo, ib[pb_][order] + blo
        keep = _increasing(ys)
        xs, ys = xs[keep], ys[keep]
        # a unique match splits the rest; matches next to each other make one run
        cuts = np.flatnonzero((np.diff(xs) != 1) | (np.diff(ys) != 1)) + 1
        px, py = alo, blo
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(xs)], strict=True):
            x, y = int(xs[s]), int(ys[s])
            out.append((x, y, int(e - s)))
            todo.append((px, x, py, y))
            px, py = x + int(e - s), y + int(e - s)
        todo.append((px, ahi, py, bhi))
    out.sort()
    joined: list[tuple[int, int, int]] = []
    for x, y, n in out:
        if joined and joined[-1][0] + joined[-1][2] == x and joined[-1][1] + joined[-1][2] == y:
            joined[-1] = (joined[-1][0], joined[-1][1], joined[-1][2] + n)
        else:
            joined.append((x, y, n))
    return joined


def _increasing(ys: np.ndarray) -> np.ndarray:
    """Indices of a longest increasing subsequence."""
    if len(ys) < 2 or (np.diff(ys) > 0).all():
        return np.arange(len(ys))
    from bisect import bisect_left

    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(ys)
    for i, y in enumerate(ys.tolist()):
        k = bisect_left(tails, y)
        back[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[k], at[k] = y, i
    out, i = [], at[-1]
    while i >= 0:
        out.append(i)
        i = back[i]
    return np.asarray(out[::-1])


def common_runs(a: np.ndarray, b: np.ndarray, line_words: int) -> list[tuple[int, int]]:
    """Runs [start, end) of line_words words or more of a that b holds: by patience diff of the lines from each word, then
    by alignments of the lines that are left over, the first of each with the first in b, until none is left."""
    ga, gb = grams(a, line_words), grams(b, line_words)
    runs = [(x, x + n + line_words - 1) for x, _, n in patience(ga, gb)]
    if not len(ga) or not len(gb) or len(runs) == 1 and runs[0] == (0, len(a)):
        return runs
    known, where = np.unique(gb, return_index=True)
    at = np.minimum(np.searchsorted(known, ga), len(known) - 1)
    left = known[at] == ga
    for s, e in runs:
        left[s : e - line_words + 1] = False
    while left.any():
        places = np.flatnonzero(left)
        _, first = np.unique(ga[places], return_index=True)
        xs = places[np.sort(first)]
        ys = where[at[xs]]
        keep = _increasing(ys)
        end = -1
        for x, y in zip(xs[keep].tolist(), ys[keep].tolist(), strict=True):
            if x < end:
                continue
            n = min(len(a) - x, len(b) - y)
            differ = np.flatnonzero(a[x : x + n] != b[y : y + n])
            right = int(differ[0]) if len(differ) else n
            n = min(x, y)
            differ = np.flatnonzero(a[x - n : x][::-1] != b[y - n : y][::-1])
            before = int(differ[0]) if len(differ) else n
            runs.append((x - before, x + right))
            end = x + right - line_words + 1
            left[x - before : end] = False
    return runs


def ordered_key(docs: DataFrame) -> tuple[F.Column, str]:
    """A key that orders rows by doc_id, then by a hash of the text, and its type. Those without a doc_id come last. Where
    no doc_id has several texts a long does, which aggregates by hash; the least struct is found by sorting."""
    h = F.xxhash64(docs["text"].cast("string"))
    texts = docs.filter(docs["doc_id"].isNotNull()).groupBy("doc_id").agg(F.min(h).alias("h0"), F.max(h).alias("h1"))
    if not texts.filter("h0 <> h1").isEmpty():
        return row_key(docs), KEY
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(1 << 62) + F.pmod(h, F.lit(1 << 61))), "long"


def first_holders(held: DataFrame, by: str) -> DataFrame:
    """by, owner (the first key that holds it) and rows (how many do) of what several keys of held (key, by) hold."""
    owners = held.groupBy(by).agg(F.min("key").alias("owner"), F.max("key").alias("last"), F.count(F.lit(1)).alias("rows"))
    return owners.filter(F.col("owner") != F.col("last")).drop("last")


def owned_lines(docs: DataFrame, key: F.Column, kind: str, min_words: int = 50, line_words: int = 16) -> DataFrame:
    """key, owner: for each row, the first rows (by ordered_key) that hold one of its lines that no third one holds, or one
    of its stretches of min_words words around a line that more hold; itself left out."""
    texts = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    lines = materialize(texts.mapInArrow(_lines(min_words, line_words), f"key {kind}, line long"), "lines")
    shared = materialize(lines.join(first_holders(lines, "line"), "line"), "shared")
    common = shared.filter("rows > 2")
    asked = common.groupBy("key").agg(F.collect_list("line").alias("lines"))
    if common.count() <= 4 * FEW:  # longs
        stretched = texts.join(F.broadcast(asked), "key").select("key", "text", "lines")
    else:
        stretched = zipped_texts(texts).join(asked, "key").select("key", "z", "lines")
    stretches = stretched.mapInArrow(_stretches(min_words, line_words, "z" in stretched.columns), f"key {kind}, stretch long")
    stretches = materialize(stretches, "stretches")
    rare = shared.filter("rows = 2").select("key", "owner")
    found = rare.union(stretches.join(first_holders(stretches, "stretch"), "stretch").select("key", "owner"))
    return found.filter(F.col("key") != F.col("owner")).distinct()


def _aligned(line_words: int, kind: str):
    """What owners repeat of a key's words, as runs [first, last] one after another in an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(words_of_zipped(batch.column("z")), words_of_zipped(batch.column("owner_z")), strict=True)
            runs = [[x for r in common_runs(own, theirs, line_words) for x in r] for own, theirs in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(runs, pa.list_(pa.int32()))], ["key", "runs"])

    return run


def cut_text(text: str, runs: list[tuple[int, int]], min_words: int) -> str:
    """The text without the joined word runs that have min_words words; lines that lose all their words go whole."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    words, starts, ends, _ = words_of(data, np.asarray([0, len(data)]))
    covered = np.zeros(len(words) + 1, np.int64)
    for s, e in runs:
        covered[s] += 1
        covered[e] -= 1
    edges = np.flatnonzero(np.diff(np.r_[False, np.cumsum(covered[:-1]) > 0, False]))
    gone = np.zeros(len(words), bool)
    for s, e in zip(edges[::2], edges[1::2], strict=True):
        gone[s:e] = e - s >= min_words
    if not gone.any():
        return text
    if gone.all():
        return ""
    out, at = [], 0
    for line in raw.split(b"\n"):
        end = at + len(line)
        i, j = np.searchsorted(starts, (at, end))
        lost = gone[i:j]
        if not lost.any():
            out.append(line)
        elif not lost.all():
            edges = np.flatnonzero(np.diff(np.r_[False, ~lost, False]))
            out.append(b" ".join(raw[starts[i + s] : ends[i + e - 1]] for s, e in zip(edges[::2], edges[1::2], strict=True)))
        at = end + 1
    return b"\n".join(out).decode()


def dedup_lines(docs: DataFrame, min_words: int = 50, line_words: int = 16) -> DataFrame:
    """docs with the text that earlier documents hold deleted from later ones; every row and column is kept."""
    key, kind = ordered_key(docs)
    pairs = settled("pairs", lambda: owned_lines(docs, key, kind, min_words, line_words))
    texts = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))

    def repeated() -> DataFrame:
        aligned = paired_texts(pairs, texts).mapInArrow(_aligned(line_words, kind), f"key {kind}, runs array<int>")
        runs = aligned.filter(F.size("runs") > 0).groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
        # only where owners' runs can join to min_words
        whole = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda n, x: n + x)
        return runs.filter(whole >= min_words)

    runs = settled("runs", repeated)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = docs.select(row, key.alias("key")).join(few(runs), "key", "left")
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # what is sent at once
                part = batch.slice(i, 256)
                texts = part.column("row").field("text").cast(pa.string())
                cut = [cut_text(text.as_py() or "", np.asarray(r.values).reshape(-1, 2).tolist(), min_words) for text, r in zip(texts, part.column("runs"), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(cut, pa.string())], ["row", "text"])

    cut = joined.filter("runs is not null").select("row", "runs").mapInArrow(run, schema)
    fields = [F.col("text").cast(docs.schema["text"].dataType).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        fields = [F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else f for c, f in zip(docs.columns, fields, strict=True)]
    left = joined.filter("runs is null").select("row", F.col("row").getField("text").cast("string").alias("text"))
    return left.union(cut).select(*fields)
