"""Operators on documents against brute force, on a small frame with nulls, empty and very long texts, ties, repeated rows
and extra columns with clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thornwick.llm import linededup, mixing, neardup, packing, quality, tokenbin, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, size string, score double, h long, bucket string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(["ra", "to", "mi", "len", "sor", "ve", "da", "ku"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return "".join(w + (".\n" if r.random() < 0.03 else ". " if r.random() < 0.08 else " ") for w in words).strip()


PASSAGE = prose(999, 60)


def texts() -> list[tuple[int | None, str | None, str | None]]:
    base = [prose(k, 60 + 13 * k) for k in range(12)]
    near = base[5].split(" ")
    near[20] = "changed"
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(base)]
    rows += [(20, base[3], "s1"), (21, base[3], "s9"), (22, " ".join(near), "s0"), (23, prose(70, 40) + " " + PASSAGE + " " + prose(71, 45), "s2"), (24, PASSAGE + "\n" + prose(72, 33), "s2"), (25, prose(73, 100) + "\n" + PASSAGE, None)]
    rows += [(30, None, "s0"), (31, "", "s1"), (32, "  \n\t ", None), (33, "one", "s2"), (34, "a a a a a a a a a", "Z"), (35, "é́ ß x y <|endoftext|> #$%&*|<>", "é"), (36, prose(80, 30000), "s0")]
    rows += [(None, base[1], None), (None, None, None), (7, base[7], "s1"), (7, base[7], "s1"), (8, prose(90, 70), "s2")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), "k", 1, "x", 0.5, 3, "b") for i, t, s in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_cached_encoding_equals_the_library():
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder = tokens.Cached(name, keeps)
        odd = ["", " a", "a ", "a  b", "a\n\nb", "a\r\nb", "x\x1cy z", "don't I'll", "a b　c", "<|endoftext|>x", "12 345", "\n", "a\n b", "Aß İ ΑΣ. é ́"] + [t or "" for _, t, _ in texts()]
        assert [x.tolist() for x in encoder.encode_many(odd)] == [encoder.tokenizer.encode(x, add_special_tokens=False).ids for x in odd]


def test_a_full_store_keeps_results(monkeypatch):
    monkeypatch.setattr(tokens, "STORE", 60)
    encoder = tokens.Cached("byte_bpe_50k.json", True)
    many = [prose(k, 80) for k in range(20)]
    for i in range(0, 20, 5):
        assert [x.tolist() for x in encoder.encode_many(many[i : i + 5])] == [encoder.whole(x).tolist() for x in many[i : i + 5]]


def test_packing_round_trip(docs):
    tokenizer = tokens.load("byte_bpe_50k.json")
    rows = packing.pack_documents(docs).collect()
    want = Counter()
    for i, t, _ in texts():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        at, k = 0, 0
        while at < len(ids):
            n = 1024 if at or len(ids) <= 1024 else len(ids) % 1024 or 1024
            n = min(n, len(ids) - at)
            want[i, k, at, n, zlib.crc32(np.asarray(ids[at : at + n], "<u4").tobytes())] += 1
            at, k = at + n, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for x in spans.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(spans) <= -(-sum(r.length for r in rows) // 1024) + 1


def test_packing_empty(empty):
    assert packing.pack_documents(empty).count() == 0


def test_dominance_reduction_is_optimal_on_small_instances():
    def optimum(items, capacity):
        best = [len(items)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for k in range(len(rooms)):
                if rooms[k] >= items[i]:
                    place(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1 :])
            place(i + 1, [*rooms, capacity - items[i]])

        place(0, [])
        return best[0]

    r = random.Random(5)
    for _ in range(150):
        items = sorted((r.randint(1, 20) for _ in range(8)), reverse=True)
        counts = np.zeros(21, np.int64)
        for x in items:
            counts[x] += 1
        fixed = packing.reduce_by_dominance(counts, 20)
        assert all(sum(g) <= 20 and t > 0 for g, t in fixed) and (counts >= 0).all()
        rest = [x for x in range(20, 0, -1) for _ in range(counts[x])]
        assert sum(t for _, t in fixed) + optimum(rest, 20) == optimum(items, 20)


def test_token_shards_round_trip(docs):
    tokenizer = tokens.load("word_bpe_49k.json")
    order = sorted(texts(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, start = Counter(), 0
    for i, t, _ in order:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want[i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert Counter(tuple(r) for r in tokenbin.round_trip(docs).collect()) == want


def test_token_shards_empty(empty):
    assert tokenbin.round_trip(empty).count() == 0


def test_minimal_perfect_hash():
    for n in (1, 2, 7, 1000, 20_000):
        keys = np.random.default_rng(n).permutation(n * 3)[:n]
        hashes = tokenbin.key_hash(keys, np.zeros(n, np.int64))
        displacement, slot = tokenbin.build_mph(hashes)
        assert sorted(slot.tolist()) == list(range(n))
        assert (tokenbin.find_slots(hashes, displacement, n) == slot).all()


def test_absent_keys_are_not_found(spark, docs):
    from thornwick.llm.common import scratch_path

    root = scratch_path(spark, "shards")
    entries = tokenbin.write_shards(docs.filter("doc_id is not null"), root, "word_bpe_49k.json", 1, 2)
    index = tokenbin.write_index(entries, root, 3)
    keys = spark.createDataFrame([(k, 0) for k in range(500, 900)] + [(5, 0)], "doc_id long, serial int")
    found = {r.doc_id: r.n_tokens for r in tokenbin.lookup(keys, index, root, 3).collect()}
    assert found[5] and sum(v is not None for v in found.values()) <= 2  # a fingerprint has 32 bits


def measures(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + d for k in range(len(w) - 2) if windows[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs):
    rows = quality.judge(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = Counter()
    for i, t, _ in texts():
        m = measures(t)
        want[(i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got == want
    assert not any(r.kept and r.base_failed for r in rows)


def test_quality_tells_junk(spark):
    good = [(k, prose(k, 120)) for k in range(200)]
    junk = [(1000 + k, " ".join(x + "###" for x in prose(k, 120).split())) for k in range(20)]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(good + junk, "doc_id long, text string")).filter("kept").collect()}
    assert kept == set(range(200))


def test_quality_empty(empty):
    assert quality.judge(empty).count() == 0


def test_mixing(spark, docs):
    rows = mixing.copies(docs).collect()
    sizes = Counter()
    for _, t, s in texts():
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    taken, most = Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert r.n_copies <= 2
        taken[r.source] += r["size"] * r.n_copies
        most[r.source] = max(most[r.source], r["size"])
    for s in sizes:
        assert taken[s] <= target[s] + 1e-6
    again = mixing.copies(docs.repartition(5)).collect()
    key = lambda x: Counter((r.doc_id, r["size"], r.n_copies) for r in x)
    assert key(rows) == key(again)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.n_copies for r in rows)


def test_mixing_comes_near_its_targets(spark):
    rows = [(k, prose(k, 20 + 7 * (k % 50)), f"s{k % 4}") for k in range(600)]
    found = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum(F.col("size") * F.col("n_copies")).alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.01 * r.target for r in found)


def test_mixing_empty(empty):
    assert mixing.copies(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_line_dedup(docs):
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(texts())
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[20].text == "" and by_id[21].text == "" and by_id[20].n_chars == 0
    assert PASSAGE.split()[5] in by_id[23].text and " ".join(WORD.findall(PASSAGE)) in " ".join(WORD.findall(by_id[23].text))
    assert WORD.findall(by_id[24].text) == WORD.findall(prose(72, 33))
    assert WORD.findall(by_id[25].text) == WORD.findall(prose(73, 100))
    assert by_id[30].text is None and by_id[31].text == "" and by_id[36].text == prose(80, 30000)
    for k in range(12):
        if k not in (7, 8):  # repeated rows of one doc_id
            assert by_id[k].text == prose(k, 60 + 13 * k)
    # no later text holds 50 words in a row that an earlier one had
    seen: dict = {}
    for i, t, _ in sorted((x for x in texts() if x[0] is not None and x[0] not in (7, 8)), key=lambda x: x[0]):
        w = WORD.findall(by_id[i].text or "")
        assert not any(tuple(w[k : k + 50]) in seen for k in range(len(w) - 49))
        w = WORD.findall(t or "")
        seen |= {tuple(w[k : k + 50]): i for k in range(len(w) - 49)}


def test_line_dedup_where_an_earlier_document_holds_an_excerpt(spark):
    rows = []
    for g, (whole, part, at) in enumerate([(50, 20, 15), (50, 40, 5), (50, 49, 1), (60, 30, 15), (60, 49, 6), (80, 49, 15), (80, 30, 0), (70, 25, 45)] * 3):
        passage = prose(2000 + g, whole).split()
        for k, words in enumerate((passage[at : at + part], passage[at : at + part], passage, passage, passage)):
            rows.append((10 * g + k, " ".join(prose(3000 + 20 * g + k, 40).split() + words + prose(5000 + 20 * g + k, 30).split())))
    out = {r.doc_id: WORD.findall(r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    seen: set = set()
    for i, t in rows:
        windows = lambda w: {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        assert not windows(out[i]) & seen
        if i % 10 < 3:
            assert out[i] == WORD.findall(t)  # excerpts of under 50 words, and the first whole passage, stay
        seen |= windows(WORD.findall(t))


def test_line_dedup_of_different_texts_under_one_id(spark):
    parts = [prose(7000 + k, 80) for k in range(8)]
    rows = [(1, p + " " + prose(7100 + k, 60)) for k, p in enumerate(parts[:4])] + [(1, parts[4])] * 2 + [(50 + k, prose(7200 + k, 30) + " " + p) for k, p in enumerate(parts)]
    out = {r.doc_id: WORD.findall(r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).filter("doc_id >= 50").collect()}
    assert out == {50 + k: WORD.findall(prose(7200 + k, 30) + (" " + p if k > 4 else "")) for k, p in enumerate(parts)}


def test_line_dedup_empty(empty):
    assert linededup.dedup_lines(empty).count() == 0


def test_patience_runs_are_common_and_ordered():
    r = random.Random(3)
    for _ in range(200):
        a = np.asarray([r.randint(0, 12) for _ in range(r.randint(0, 40))], np.uint64)
        b = np.asarray([r.randint(0, 12) for _ in range(r.randint(0, 40))], np.uint64)
        at = (0, 0)
        for x, y, n in linededup.patience(a, b):
            assert x >= at[0] and y >= at[1] and (a[x : x + n] == b[y : y + n]).all()
            at = (x + n, y + n)


def test_near_duplicates(docs):
    found = defaultdict(set)
    for r in neardup.near_duplicates(docs).collect():
        found[r.class_id].add(r.doc_id)
    by_id = {i: c for c, ids in found.items() for i in ids if i is not None}
    assert by_id[3] == by_id[20] == by_id[21] == 3 and by_id[22] == by_id[5] == 5 and by_id[30] == by_id[31] == 30
    assert None in found[1] and by_id[23] == 23 and by_id[24] == 24 and by_id[33] == 33
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(set(ids) - {None} | {8}) or sorted(x for x in ids if x not in (None, 8)) == sorted(set(ids) - {None, 8})
    assert not {20, 21, 22, 31} & set(ids) and {3, 5, 30, 36} <= set(ids)


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(11)
    rows = []
    for g in range(25):
        words = prose(g, r.randint(8, 160)).split()
        for _ in range(r.randint(1, 8)):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 1)] = [f"new{r.randint(0, 10**6)}"]
            rows.append((len(rows), " ".join(w)))
    words = [[zlib.crc32(x.encode()) for x in t.split()] for _, t in rows]
    kmers = [[zlib.crc32(" ".join(w[k : k + 5]).encode()) for k in range(max(1, len(w) - 4))] for w in (t.split() for _, t in rows)]

    def classes(alike):
        parent = list(range(len(rows)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(rows)):
            for j in range(i):
                if alike(i, j):
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
        return {i: find(i) for i in range(len(rows))}

    def aligned(x, i, j):
        return neardup.banded_lcs(x[i], x[j], 10**6) >= 0.8 * max(len(x[i]), len(x[j]))

    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # classes are made of pairs whose words align, and no such pair with enough k-mers in common is missing, so none whose k-mers align
    assert got == classes(lambda i, j: got[i] == got[j] and aligned(words, i, j))
    index = lambda i, j: len(set(kmers[i]) & set(kmers[j])) / len(set(kmers[i]) | set(kmers[j]))
    for need in (classes(lambda i, j: aligned(kmers, i, j)), classes(lambda i, j: index(i, j) >= 0.45 and aligned(words, i, j))):
        assert all(got[i] == got[need[i]] for i in need)


def test_near_duplicates_where_one_side_repeats(spark):
    rows = []
    for g in range(6):
        w = prose(300 + g, 200).split()
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w[:60] + w[40:]))][:: 1 if g % 2 else -1]  # a stretch of 20 words doubled
    for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True):
        x, y = neardup._words_by_row(pa.array([a, b]))
        assert neardup.banded_lcs(x.tolist(), y.tolist(), 10**6) >= 0.8 * max(len(x), len(y))
        assert neardup.aligned_share(x, y, 0.8) >= 0.8
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: k - k % 2 for k in range(12)}


def test_banded_lcs():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 30))] for _ in "ab")
        assert neardup.banded_lcs(a, b, 100) == plain(a, b)
        assert neardup.banded_lcs(a, b, 3) <= plain(a, b)


def test_near_duplicates_empty(empty):
    assert neardup.near_duplicates(empty).count() == 0 and neardup.without_near_duplicates(empty).count() == 0


def toxic_rows():
    bad = ["vilex", "dornak", "scrub"]
    r = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        w = prose(k, 80).split()
        toxic = k % 5 == 0
        for _ in range(4 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", ".", ","]))
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "vilex vilex dornak scrub")], "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.judged(docs, spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")).collect()}
    for k, _, y in labels:
        assert found[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert found[k].predicted == y
    assert found[900].score == found[901].score and found[900].predicted == 0 and found[None].predicted == 1
    assert found[0].passages


def test_toxicity_of_rare_words_and_compounds(spark):
    # 60 toxic of 600: half of them by a word in under 23 training documents, half by compounds of one stem, each in a few
    r = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        w = prose(9000 + k, 80).split()
        for _ in range(5 if k % 10 == 0 else 0):
            w.insert(r.randrange(len(w)), "vilex" if k % 20 else "grumfuß" + r.choice(["ra", "to", "mi", "len", "sor", "ve", "da", "ku"]) + r.choice(["ra", "to", "mi", "len", "sor", "ve"]))
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(k % 10 == 0)))
    found = toxicity.judged(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).filter("held_out").collect()
    assert {r.doc_id for r in found if r.predicted} == {r.doc_id for r in found if r.doc_id % 10 == 0}


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.judged(docs, none).collect()} == {toxicity.train(docs, none).probability(0.0)}
    assert toxicity.judged(empty, none).count() == 0
    kept = toxicity.without_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_segments_are_all_maximal():
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, 0.05)
    found = model.segments(np.asarray([0, 2, 10, 11]), np.asarray([3.0, 4.0, 2.0, -5.0]))
    assert [(a, b, round(s, 6)) for a, b, s in found] == [(0, 2, 6.0), (10, 10, 2.0)]


def all_maximal(scores):
    """By definition: the segment of greatest sum (the shortest, then first), then those left and right of it."""
    todo, out = [(0, len(scores))], []
    while todo:
        lo, hi = todo.pop()
        sums = [(round(sum(scores[a:b]), 9), a - b, -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
        best = max(sums, default=(0,))
        if best[0] > 0:
            a = -best[2]
            b = a - best[1]
            out.append((a, b - 1, best[0]))
            todo += [(lo, a), (b, hi)]
    return sorted(out)


def test_segments_against_brute_force():
    r = random.Random(3)
    for case in range(150):
        n = r.randint(1, 30)
        drift = r.choice([0.31, 1.07, 0.0123])
        hits = sorted(r.sample(range(n), r.randint(0, n)))
        values = [r.choice([-1, 1, 1, 1]) * r.uniform(0.1, 3) for _ in hits]
        model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), drift, 1.0, 0.05)
        found = sorted((a, b, round(s, 9)) for a, b, s in model.segments(np.asarray(hits, np.int64), np.asarray(values)))
        whole = [-drift] * n
        for h, v in zip(hits, values, strict=True):
            whole[h] = v
        expected = all_maximal(whole)
        assert [x[:2] for x in found] == [x[:2] for x in expected], case
        assert np.allclose([x[2] for x in found], [x[2] for x in expected])


@pytest.mark.parametrize("shape", ["rising", "falling", "mixed"])
def test_segments_take_linear_time(shape):
    import time

    n = 100_000
    at = np.arange(n) * 3
    drift = {"rising": 0.1, "falling": 1.0, "mixed": 0.3}[shape]
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), drift, 1.0, 0.05)
    scores = np.random.default_rng(0).uniform(0.1, 1.1, n)
    start = time.time()
    found = model.segments(at, scores)
    assert time.time() - start < 5 and found


def test_toxicity_of_long_repeated_and_clashing_rows(spark):
    rows, labels = toxic_rows()
    r = random.Random(8)
    calm = [w for w in " ".join(t for k, t in rows if k % 5).split() if "vile" not in w]
    long = " ".join(r.choice(calm) for _ in range(60_000))
    more = [(5000, long), (5001, long + " " + rows[0][1]), (5002, rows[0][1]), (5002, rows[0][1])]
    frame = spark.createDataFrame([(k, t, 9.0, 1, "x", 0) for k, t in rows + more], "doc_id long, text string, score double, label int, passages string, found int")
    found = toxicity.judged(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))).collect()
    assert len(found) == len(rows) + 4
    by = {r.doc_id: r for r in found}
    assert by[5000].predicted == 0 and by[5001].predicted == 1 and by[5002].score == by[0].score
    kept = toxicity.without_toxic(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == frame.columns and {5001, 5002}.isdisjoint(r.doc_id for r in kept.collect())


def test_token_shards_of_null_least_and_repeated_ids(spark):
    least = -(2**63)
    rows = [(None, "a b"), (None, "c"), (least, "d"), (least, "e f g"), *((7, prose(k % 40, 5)) for k in range(400)), (9, "z"), (None, "a b")]
    frame = spark.createDataFrame([(*r, 3, "s") for r in rows], "doc_id long, text string, serial int, shard string").repartition(3)
    found = tokenbin.round_trip(frame).collect()
    tokenizer = tokens.load("word_bpe_49k.json")
    ids = {t: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for _, t in rows}
    crc = lambda t: zlib.crc32(np.asarray(ids[t], "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((k, len(ids[t]), crc(t)) for k, t in rows)
    found.sort(key=lambda r: r.start)
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    order = [r.doc_id for r in found]
    assert order == [None] * 3 + [least] * 2 + [7] * 400 + [9]


def test_equal_hashes_and_missing_keys_are_errors(spark, docs, tmp_path):
    with pytest.raises(ValueError, match="same hash"):
        tokenbin.build_mph(np.asarray([5, 5], np.uint64))
    entries = tokenbin.write_shards(docs.filter("doc_id < 5"), str(tmp_path), "word_bpe_49k.json", 1, 2)
    index = tokenbin.write_index(entries, str(tmp_path), 1)
    found = tokenbin.lookup(spark.createDataFrame([(1, 0), (4242, 0)], "doc_id long, serial int"), index, str(tmp_path), 1)
    with pytest.raises(Exception, match="not in the index"):
        tokenbin.read_payloads(found, entries.select("shard", "file").distinct(), str(tmp_path), 2).collect()


def test_packing_places_alike_in_any_order(spark):
    rows = [(k, 0, 0, 300 + k % 7, k * 31, k % 4) for k in range(500)]
    placed = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame(rows, packing.PIECES).repartition(3)
        placed.append(sorted((r.doc_id, r.sequence_id, r.offset) for r in packing.pack(frame).collect()))
    assert placed[0] == placed[1]
