"""The audit of filters and the alignment of tokenizers and repeats, against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import accumulate

import duckdb
import pyarrow as pa
import pytest

from thornwick.llm import align, audit, html_text, queries, substring
from thornwick.llm.tokens import load

def audited(docs, labels):
    """The audit by running every order over the rows."""
    from itertools import permutations

    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in least and i > least[t]}
        rows.append((part or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, sums = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                there = [r for r in mine if not r[1] & set(order[:k])]
                gone = [r for r in there if f in r[1]]
                sums[part, f] += len(gone)
                out[part, "".join(order), k + 1] = (len(there) - len(gone), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f)
    return {k: (*v[:6], sums[k[0], v[6]]) for k, v in out.items()}


def test_audit_against_every_order_run(spark):
    r = random.Random(11)
    prose = lambda n, m=10**6: " ".join(r.choice(["w", "W", "Wör", "é"]) + str(r.randrange(m)) for _ in range(n))
    texts = [prose(120), prose(150, 60), prose(99), prose(100) + " $", "AB" * 60, "", None, "a\x0bb\x1cc d " * 40, prose(30_000), " " * 500]
    docs = [(k, r.choice(texts), r.choice(["en", "de", None, ""])) for k in range(150)]
    docs += [docs[3], docs[3], (3, texts[0], "fr"), (None, texts[0], "en"), (None, None, None), (None, texts[0], "en")]
    docs += [(1000 + k, "Copy " * 120, "en") for k in range(500)]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (99_999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, True, "k", 5) for d in docs], "doc_id long, text string, lang string, n int, A boolean, part string, subset int").repartition(7)
    marks = spark.createDataFrame([(*x, 3) for x in labels], "doc_id long, quality int, toxic int, n int")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = [((x.part, x.filter_order, x.step), tuple(x[c] for c in names)) for x in audit.audit(frame, marks).collect()]
    want = audited(docs, labels)
    assert len(found) == len(want) and dict(found) == want
    assert audit.audit(frame.limit(0), marks).count() == 0
    assert {x[3:6] for x in audited(docs, [])} and all(x.good_lost == x.toxic_lost == 0 for x in audit.audit(frame, marks.limit(0)).collect())


def removed_by_windows(texts, least):
    """Which words of each text a window of `least` words covers that starts anywhere else too."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    starts = Counter(tuple(w[i : i + least]) for w in words for i in range(len(w) - least + 1))
    gone = []
    for w in words:
        on = [False] * len(w)
        for i in range(len(w) - least + 1):
            if starts[tuple(w[i : i + least])] > 1:
                on[i : i + least] = [True] * least
        gone.append(on)
    return words, gone


def repeated_texts():
    r = random.Random(12)
    word = lambda: "".join(r.choice(["ra", "to", "mi", "é", "sor", "ve", "da", "ku"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    passages = [prose(n) for n in (34, 35, 36, 50, 90, 300, 700)]
    texts = []
    for k in range(160):
        w = prose(r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            s = r.randrange(len(p) - 20)
            at = r.randint(0, len(w))
            w[at:at] = p[s:] if k % 2 else p
        texts.append(r.choice([" ", "\n", "  ", "\t \x0b"]).join(w))
    far = prose(3000)
    texts += [" ".join(far), " ".join(far[:1400] + prose(3) + far[1400:]), " ".join(prose(20) + far[990:1030] + far[500:530] + far[2000:2034])]  # a long text, shifted by words, parts of it
    texts += ["a " * 900, "a b " * 200, " ".join((prose(7) * 40)[:270]), "x " * 34, "x " * 35, " ".join(prose(40) * 2)]  # periodic and repeated within
    texts += [None, "", " \n ", "one", texts[3], texts[3], texts[5] + " ", " lead  " + texts[5], " ".join(passages[3][:34])]
    common = prose(60)
    texts += [" ".join(prose(30) + common[r.randrange(10) :] + prose(30)) for _ in range(300)]  # a hot passage
    return texts


def kept(words, gone):
    return [(" ".join(x for x, g in zip(w, on, strict=True) if not g), len(w), sum(on)) for w, on in zip(words, gone, strict=True)]


def test_substring_against_all_windows(spark):
    texts = repeated_texts()
    ids = [k if k % 50 != 7 else None for k in range(len(texts))]
    frame = spark.createDataFrame([(i, t, 1, "k", 2, 3) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n int, key string, block int, row int").repartition(5)
    words, gone = removed_by_windows(texts, 35)
    want = Counter(zip(ids, kept(words, gone), strict=True))
    found = substring.without_repeats(frame).collect()
    assert Counter((x.doc_id, (x.text, x.n_words, x.n_removed)) for x in found) == want
    spans = {(x.doc_id, x.n_words, x.n_removed, tuple(x.spans)) for x in found}
    edges = lambda on: tuple(i for i, (a, b) in enumerate(zip([False, *on], [*on, False], strict=True)) if a != b)
    assert spans == {(i, len(w), sum(on), edges(on)) for i, w, on in zip(ids, words, gone, strict=True)}
    # rows that repeat an id and a text, and ids with several texts
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[161]), (2, texts[160]), (2, texts[160]), (3, "y " * 40), (None, None)]
    words, gone = removed_by_windows([t for _, t in rows], 20)
    found = substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), min_words=20, seed_words=8, block=64).collect()
    assert Counter((x.doc_id, (x.text, x.n_words, x.n_removed)) for x in found) == Counter(zip([i for i, _ in rows], kept(words, gone), strict=True))
    assert substring.without_repeats(frame.limit(0)).count() == 0


def test_substring_where_nothing_is_broadcast(spark, monkeypatch):
    texts = repeated_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(substring, "FEW", -1)
    monkeypatch.setattr(substring, "HOT", 5)
    words, gone = removed_by_windows(texts, 35)
    assert Counter((x.doc_id, (x.text, x.n_words, x.n_removed)) for x in substring.without_repeats(frame).collect()) == Counter(enumerate(kept(words, gone)))


def aligned_by_hand(texts):
    """Groups and links of each text from whole encodings, and the counts over all texts."""
    a, b = load(align.A), align.load_pieces(align.B)
    values = align.byte_values()
    rows = []
    for t in texts:
        t = t or ""
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        ba = [bytes(values[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not t or b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            rows.append(None)
            continue
        ends = [{sum(map(len, x[: k + 1])) for k in range(len(x))} if len(x) < 2000 else set(accumulate(map(len, x))) for x in (ba, bb)]
        both, groups, i, j, ea, eb = ends[0] & ends[1], [([], [])], 0, 0, 0, 0
        for e in sorted(both):
            while ea < e:
                groups[-1][0].append(ia[i])
                ea, i = ea + len(ba[i]), i + 1
            while eb < e:
                groups[-1][1].append(ib[j])
                eb, j = eb + len(bb[j]), j + 1
            groups.append(([], []))
        groups.pop()
        rows.append((groups, Counter((x, y) for g, h in groups for x in g for y in h)))
    count = Counter(p for r in rows if r for p in r[1])
    best = {}
    for (x, _), n in count.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        g, links = r
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), text))
    return out


def odd_texts():
    r = random.Random(13)
    pieces = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "　", "▁", "don't", "it's", "'s", "12345", "é", "é", "日本語", "\U0001f600", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "foo", "Bar", "_", "...", ";\r", "\x00", "\x85", "​", "﻿", "naïve", "ﬁ", "\x1c"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 30))) for _ in range(300)]
    words = ["alpha", "beta's", "Gamma-7", "delta,", "(eps)", "zeta.", "überall", "don't"]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(200)]
    texts += [None, "", " ", "   ", "\n", "a", "x" * 3000, "日本語" * 200, " ".join(r.choice(words) for _ in range(30_000)), texts[0], texts[0], "word " * 40]
    return texts


def test_alignment_against_whole_encodings(spark):
    texts = odd_texts()
    ids = [k if k % 40 != 3 else None for k in range(len(texts))]
    frame = spark.createDataFrame([(i, t, 7, "k", 1, "p") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, row int, groups string, n_a int, postings string").repartition(5)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    found = Counter((x.doc_id, *[x[c] for c in names]) for x in align.align(frame).collect())
    want = aligned_by_hand(texts)
    assert found == Counter((i, *w) for i, w in zip(ids, want, strict=True))
    assert sum(w[0] > 0 for w in want) > 300 and sum(w[0] == 0 for w in want) > 20
    digests = Counter((x.doc_id, x.groups) for x in align.align(frame, digest=True).collect())
    assert digests == Counter((i, hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for i, w in zip(ids, want, strict=True))
    assert align.align(frame.limit(0)).count() == 0
    none = align.align(spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")).collect()
    assert [tuple(x) for x in none] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_alignment_over_buckets_and_salts(spark, monkeypatch):
    texts = odd_texts()[300:]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    monkeypatch.setattr(align, "PAIRS_A_BUCKET", 5)
    monkeypatch.setattr(align, "BYTES_A_SALT", 10)
    found = {x.doc_id: (x.n_best, x.count_sum) for x in align.align(frame).collect()}
    assert found == {i: w[4:6] for i, w in enumerate(aligned_by_hand(texts))}


def test_aligner_forgets():
    texts = odd_texts()
    small, large = align.Aligner(store=40), align.Aligner()
    column = pa.array(texts[:480] * 2, pa.string())
    for own in (small, large):
        seen = [(n.tolist(), strings, pairs.tolist(), times.tolist()) for k in range(0, 960, 60) for _, _, n, strings, pairs, times, _ in own.column(column.slice(k, 60))]
        assert own is small or seen == first
        first = seen
    assert len(small.held.n) < len(large.held.n)


def test_html_parts_by_exact_names_and_the_only_article():
    text = "Words of the main text go on and on. " * 12
    long_comment = "I say that this is nonsense, and more of it. " * 40
    got = html_text.main_text(f"<body><article><h1>T</h1><p>{text}</p><div class='comments'>{long_comment}</div><section id='ad-slot'>{long_comment}</section></article></body>")
    assert got == f"T\n{text.strip()}"
    notice = "We use cookies. " + "There are really many of them here. " * 6
    assert html_text.main_text(f"<body><div class='x'>{notice}</div><article><h1>T</h1><p>{text[:200]}</p></article></body>") == f"T\n{text[:200].strip()}"
    assert html_text.main_text(f"<body><div class='comment-body'><p>{text}</p></div></body>") == text.strip()  # all that there is
    assert html_text.main_text(f"<body><div class='has-comments no-ads'><p>{text}</p></div></body>") == text.strip()
    two = html_text.main_text(f"<body><article><p>{text}</p></article><p>{text}</p><article><p>{text}</p></article></body>")
    assert two.count("\n") == 2


def test_html_nesting_takes_linear_time():
    import time

    t = time.perf_counter()
    for part in ("<div>text ", "<div><b>x ", "<p hidden><section>b ", "</i><table><tr><td>c "):
        html_text.main_text(part * 40_000)
    assert time.perf_counter() - t < 60


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(queries.ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
