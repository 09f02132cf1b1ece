"""Pages, vectors, conversations and the pipeline against brute force."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from thornwick.llm import chat, html_text, quality, topk
from thornwick.llm.common import materialize
from thornwick.llm.tokens import load

LONG = "Words of the main text go on and on. " * 12


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_article_only():
    html = page(f"<nav><a href=x>Home</a></nav><div class='ad'>Buy this thing now please</div><article><h1>Head &amp; line</h1><p>Short.</p><p>{LONG}</p><p>a<br>b\n\n c</p></article><footer>&copy; us</footer>")
    assert html_text.main_text(html) == f"Head & line\nShort.\n{LONG.strip()}\na b c"


def test_dropped_parts():
    parts = ["<aside>S {0}</aside>", "<form>F {0}<input value=x></form>", "<div class='cookie-notice'>N {0}</div>", "<section id='comments'><p>C {0}</p></section>", "<header>H {0}</header>", "<div role='navigation'>R {0}</div>", "<div style='display: none'>I {0}</div>", "<!-- c -->", "<noscript>J</noscript>"]
    html = page("".join(p.format(LONG) for p in parts) + f"<div class='story'><h2>Title</h2><p>{LONG}</p><ul><li>one<li>two</ul></div>")
    assert html_text.main_text(html) == f"Title\n{LONG.strip()}\none\ntwo"


def test_names_of_layouts_and_comments():
    html = page(f"<div class='page has-sidebar no-ads'><article class='post'><h1>T</h1><p>{LONG}</p><article class='comment'>{LONG}</article></article><div class='side-bar sidebar'>{LONG}</div></div>")
    assert html_text.main_text(html) == f"T\n{LONG.strip()}"


def test_names_that_only_hold_such_words_in_part():
    for name in ("related-work", "reply-text", "ad-hoc", "skip-list", "post-header", "entry-header", "article-header", "comments-off", "headline", "socialism"):
        html = page(f"<article><h1>T</h1><p>{LONG}</p><section class='{name}'><p>Inner words stay.</p></section><p>{LONG}</p></article>")
        assert html_text.main_text(html) == f"T\n{LONG.strip()}\nInner words stay.\n{LONG.strip()}", name
    for name in ("ad", "relatedPosts", "comment-list", "social-share", "newsletter_signup", "site-nav", "widget-1"):
        html = page(f"<article><h1>T</h1><p>{LONG}</p><div class='{name}'><p>Inner words go.</p></div><p>{LONG}</p></article>")
        assert html_text.main_text(html) == f"T\n{LONG.strip()}\n{LONG.strip()}", name
    # a name weighs, and the clusters decide: a dense part stays
    assert html_text.main_text(page(f"<h1>T</h1><div class='promo'><p>{LONG * 20}</p></div>")) == f"T\n{(LONG * 20).strip()}"
    assert html_text.main_text(page(f"<article><header><h1>T</h1></header><p>{LONG}</p></article>")) == f"T\n{LONG.strip()}"


def test_elements_that_close_themselves_and_inline_parts():
    html = page(f"<article><p>{LONG}</p><svg/><p>a</p><math/><p>b</p><iframe src=x /><script src=y /><div class='ad'/><p>c</p><svg><path d='x'/></svg><p>d</p><span class='share'><span>Tweet</span> or share</span><p>e</p></article>")
    assert html_text.main_text(html) == "\n".join([LONG.strip(), *"abcde"])


def test_ratios_and_clusters_against_brute_force():
    g = np.random.default_rng(5)
    for _ in range(200):
        n = int(g.integers(1, 25))
        parts = np.cumsum(g.random(n) < 0.3) * (g.random(n) < 0.5)
        lines = [html_text.Line("x" * int(g.integers(1, 300)), int(g.integers(1, 6)), (), bool(g.random() < 0.2), 0, False, int(parts[k])) for k in range(n)]
        weight = lambda d: np.exp(-(d**2) / 2) if abs(d) <= 2 else 0.0
        ratio = [0 if x.dropped else len(x.text) / x.tags * (0.1 if x.part else 1) for x in lines]
        smoothed = []
        for k, x in enumerate(lines):
            near = [j for j in range(n) if lines[j].part == x.part] if x.part else list(range(n))
            at = near.index(k)
            smoothed.append(sum(weight(i - at) * ratio[j] for i, j in enumerate(near)) / sum(weight(i - at) for i in range(len(near))))
        mean = sum(smoothed) / n
        spread = (sum((s - mean) ** 2 for s in smoothed) / n) ** 0.5
        found = [not x.dropped and s >= 0.5 * spread for x, s in zip(lines, smoothed, strict=True)]
        plain = [s for x, s, f in zip(lines, smoothed, found, strict=True) if f and not x.part]
        level = sum(plain) / len(plain) if plain else 0
        want = [f and (not x.part or s >= level) for x, s, f in zip(lines, smoothed, found, strict=True)]
        got = html_text.clusters(lines, 0.5, 0.1).tolist()
        assert all(a == b or min(abs(s - 0.5 * spread), abs(s - level)) < 1e-9 for a, b, s in zip(got, want, smoothed, strict=True))


def test_short_blocks_beside_the_body():
    links = "".join(f"<li><a href=x{k}>Link number {k}</a></li>" for k in range(6))
    body = f"<div id=content><h1>Title</h1><div class=intro><p>short lead</p></div><div class=body><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div><ul>{links}</ul></div><div class=end><p>last <a href=y>word</a> here</p></div></div>"
    want = "\n".join(["Title", "short lead", *[LONG.strip()] * 3, "last word here"])
    assert html_text.main_text(page(f"<div class=top><ul>{links}</ul></div><nav>Home</nav>{body}<footer>us</footer>")) == want
    assert html_text.main_text(page(f"<table><tr><td>{links}</td><td>{body}</td></tr></table>")) == want


def test_a_form_around_the_page():
    inner = f"<nav>Home</nav><input type=hidden><div><h1>Title</h1><p>{LONG}</p><select><option>o</option></select></div>"
    assert html_text.main_text(page(f"<form action=x method=post>{inner}</form>")) == f"Title\n{LONG.strip()}"
    assert html_text.main_text(page(f"<form action=x>Your mail<input></form><article><p>{LONG}</p></article>")) == LONG.strip()
    assert html_text.main_text(page(f"<form class=newsletter>{LONG}</form><p>rest</p>")) == "rest"


def test_broken_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<html><body></body>") == ""
    assert html_text.main_text(f"<article><p>{LONG}<p>cut &am") == f"{LONG.strip()}\ncut &am"
    assert html_text.main_text("plain") == "plain"
    assert html_text.main_text(page("<nav>only</nav>")) == ""


def test_pages_query(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>"), 1), (1, "u", None, 2), (None, None, "", 3), (4, "v", page("<p>" + "x " * 200_000 + "</p>"), 4)]
    rows += [rows[0]]
    pages = spark.createDataFrame([(*r, "w", 1) for r in rows], "page_id long, url string, html string, n_chars int, text string, l int")
    found = html_text.extract(pages).collect()
    assert len([r for r in found if r.page_id == 1 and r.text]) == 2
    assert len(found) == 5 and all(r.n_chars == len(r.text) for r in found)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_top(rows, k):
    good = [(i, np.floor(1024 * np.asarray(v, float)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in {i: v for i, v in good if i % 100 == 0}.items():
        scored = sorted((-int(x @ v), i) for i, v in good if i != q and len(v) == len(x))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def test_top_k(spark):
    g = np.random.default_rng(4)
    rows = [(k, [float(np.float32(x)) for x in g.normal(size=8)]) for k in range(900)]
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, None), (1003, [1.0, None]), (1004, [float("nan")] * 8), (1005, [float("inf")] * 8), (None, rows[1][1]), (1100, [0.0] * 8), (1200, [1.0, 2.0]), (1201, [2.0, 2.0]), (1300, [])]
    frame = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<float>, label int, v int")
    found = topk.search_embeddings(frame).collect()
    assert {tuple(r) for r in found} == brute_top(rows, 10) and len(found) == len({tuple(r) for r in found})
    assert topk.search_embeddings(frame.limit(0)).count() == 0


def test_top_k_of_repeated_and_large_vectors(spark):
    rows = [(100, [1.0, 2.0]), (100, [0.5, 9.0]), (1, [3.0, 1.0]), (2, [float(1 << 38), 0.0]), (3, [-float(1 << 38), 1.0]), (4, [3.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [(r["rank"], r.vec_id, r.score) for r in topk.search_embeddings(frame).collect()]
    one = lambda v: sum(int(1024 * x) * int(1024 * y) for x, y in zip((0.5, 9.0), v, strict=True))
    want = sorted(((one(v), k) for k, v in rows if k != 100), key=lambda x: (-x[0], x[1]))
    assert sorted(found) == [(r + 1, k, s) for r, (s, k) in enumerate(want)]
    far = spark.createDataFrame([(100, [float(1 << 52)]), (1, [float(1 << 52)])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="64 bits"):
        topk.search_embeddings(far).collect()


def test_threshold_stops_early():
    g = np.random.default_rng(1)
    block = g.integers(0, 10, (4000, 2)).astype(np.int64)
    block[7] = (500, 500)
    q, i, s = topk.threshold_search(np.asarray([[1, 1]]), np.asarray([-1]), block, np.arange(4000), 1, stride=16)
    assert (q.tolist(), i.tolist(), s.tolist()) == ([0], [7], [1000])


def conversation(conv, turns, start=0):
    return [(conv, start + k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(turns)]


def test_chat_collapse(spark):
    rows = conversation(1, ["a", "b"]) + conversation(2, ["a", "b", "c"]) + conversation(3, ["a", "b", "c"]) + conversation(4, ["a"]) + conversation(5, ["x"], 7) + conversation(6, ["a", "z"]) + conversation(None, ["q"])
    rows += [(7, None, None, None), (7, 0, "user", ""), (8, 0, "user", "dup"), (8, 0, "user", "dup")] + conversation(9, [f"t{k}" for k in range(600)])
    frame = spark.createDataFrame([(*r, 0, "p") for r in rows], "conv_id long, turn long, role string, text string, pos int, part string")
    found = {(r.conv_id, r.part): r for r in chat.render(frame).collect()}
    assert {c for c, _ in found} == {2, 5, 6, 7, 8, 9, None}
    assert found[2, 0].text == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n" and found[2, 0].n_copies == 2
    assert found[7, 0].text == "<|user|>\n<|end|>\n<||>\n<|end|>\n" and found[8, 0].n_turns == 2
    assert [found[9, k].n_turns for k in range(3)] == [256, 256, 88]
    assert found[9, 1].text.startswith("<|user|>\nt256<|end|>")
    assert chat.render(frame.limit(0)).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    toxic, lines, near, _ = sizes[1:]
    assert sizes[0] >= toxic == lines >= near > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    ends = packed.filter(F.col("piece") == 0).count()
    assert ends == sizes[-1]
    extra = spark.read.parquet(f"{sf}/documents.parquet").withColumn("row", F.lit(1)).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, extra, sf).count() == 0


def corpus(tmp_path):
    """A small corpus with toxic documents, copies, near copies, repeated passages, nulls and clashing columns, and labels."""
    r = random.Random(77)
    word = lambda: "".join(r.choice(["ra", "to", "mi", "len", "sor", "ve", "da", "ku"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    passage, rows, labels = prose(70), [], []
    for k in range(240):
        w = prose(r.randint(60, 160))
        toxic = k % 6 == 0
        for _ in range(5 if toxic else 0):
            w.insert(r.randrange(len(w)), "grumflax")
        if k % 10 == 3:
            w[20:20] = passage
        rows.append((k, " ".join(w), "en", f"s{k % 3}"))
        labels.append((k, 1, int(toxic)))
    for k in range(20):
        w = rows[6 * k + 1][1].split()
        if k % 2:
            w[30] = "changed"
        rows.append((1000 + k, " ".join(w), "en", f"s{k % 3}"))
    rows += [(2000, None, None, None), (2001, "", "en", "s0"), (None, " ".join(prose(80)), "de", None), (None, None, None, "s1"), rows[1], rows[1]]
    frame = pd.DataFrame([(*x, len(x[1] or ""), 0.5, "k") for x in rows], columns=["doc_id", "text", "lang", "source", "n_chars", "score", "bucket"])
    pa_table = pa.table({"doc_id": pa.array([x[0] for x in rows], pa.int64()), **{c: pa.Array.from_pandas(frame[c]) for c in frame.columns if c != "doc_id"}})
    pq.write_table(pa_table, tmp_path / "documents.parquet")
    pq.write_table(pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("doc_id", "quality", "toxic"), zip(*labels, strict=True), strict=True)}), tmp_path / "labels.parquet")
    return rows, labels, passage


def grams_of(text, k):
    w = (text or "").split()
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w and k == 5 else [])


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    rows, labels, passage = corpus(tmp_path)
    sf = str(tmp_path)
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
        seen.append(docs.collect())
    toxic, lines, near, mix, packed = seen
    # toxicity: exactly the documents that hold the toxic word go
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    calm = [x for x in rows if "grumflax" not in (x[1] or "")]
    assert sorted(map(key, toxic)) == sorted((x[0] is None, x[0] or 0, x[1] or "") for x in calm)
    # line dedup: a run of 50 words that an earlier document held is in no later one; the rest of a text stays, in order
    assert len(lines) == len(toxic) and {r.doc_id for r in lines} == {r.doc_id for r in toxic}
    before = {r.doc_id: r.text for r in toxic if r.doc_id is not None and r.doc_id not in (1,)}
    held: set[str] = set()
    for r in sorted((r for r in lines if r.doc_id is not None), key=lambda r: r.doc_id):
        if r.doc_id == 1:
            held |= set(grams_of(r.text, 50))
            continue
        assert held.isdisjoint(grams_of(r.text, 50)), r.doc_id
        held |= set(grams_of(before[r.doc_id], 50))
        left = iter((before[r.doc_id] or "").split())
        assert all(any(w == x for x in left) for w in (r.text or "").split())
        assert r.n_chars == len(r.text or "")
    assert sum(" ".join(passage) in (r.text or "") for r in lines) == 1
    # near duplicates: one of each class of all pairs
    texts = sorted({(r.doc_id is None, r.doc_id or 0, r.text or "") for r in lines})
    sets = [Counter(grams_of(t, 5)) for *_, t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common, most = sum((sets[i] & sets[j]).values()), max(sum(sets[i].values()), sum(sets[j].values()))
            if texts[i][2] == texts[j][2] or most and common >= 0.8 * most:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    roots = sorted(texts[i] for i in range(len(texts)) if find(i) == i)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in near) == roots
    # mixing: what each source gives is near its target, no document more than twice
    size = lambda t: len((t or "").split())
    of = Counter()
    for r in near:
        of[r.source] += size(r.text)
    names = sorted((s for s in of if s is not None)) + ([None] if None in of else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, total = {}, 1.5 * sum(of.values())
    while True:
        rest = [s for s in names if s not in target]
        share = (total - sum(target.values())) / max(sum(weight[s] for s in rest), 1)
        full = [s for s in rest if share * weight[s] >= 2 * of[s]]
        target |= {s: 2.0 * of[s] for s in full}
        if not full:
            target |= {s: share * weight[s] for s in rest}
            break
    got = Counter()
    for r in mix:
        got[r.source] += size(r.text)
    longest = max(size(r.text) for r in near)
    assert all(target[s] - longest <= got[s] <= target[s] + 1e-6 for s in names), (got, target)
    assert max(Counter(map(key, mix)).values()) <= 2
    assert Counter(map(key, mix)).keys() <= Counter(map(key, near)).keys()
    # packing: each row's pieces are its ids, sequences are gapless and hold 1024 at most
    ends = Counter((r.doc_id, r.start + r.length) for r in packed if r.start + r.length)
    tokenizer = load("byte_bpe_50k.json")
    want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in mix)
    assert all(ends[x] >= n for x, n in want.items())
    sequences: dict[int, list[tuple[int, int]]] = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [p for p, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(n for _, n in places) <= 1024


def test_quality_of_repeated_rows_and_clashing_columns(spark):
    text = "Good words of a plain text. " * 20
    frame = spark.createDataFrame([(1, text, 7, "x", 3.0, 0, 0), (1, text, 8, "y", 4.0, 0, 1), (2, None, 9, None, None, 0, 2)], "doc_id long, text string, w int, l string, posterior double, n_words int, kept int")
    found = quality.judge(frame).select("doc_id", "n_words", "base_failed", "kept").collect()
    assert sorted((r.doc_id, r.n_words) for r in found) == [(1, 120), (1, 120), (2, 0)]


def test_tables_on_the_way_are_deleted(spark):
    import os

    from thornwick.llm import common

    paths = []

    def make():
        # nested before anything is written here: both scopes hold the same then
        b = common.settled("b", lambda: common.materialize(spark.range(5).withColumn("x", F.lit(1)), "inner"))
        assert b.count() == 5
        a = common.materialize(spark.range(5), "a")
        paths.extend(common._scopes.get()[-1])
        return a.join(b, "id")

    found = common.settled("c", make)
    assert found.count() == 5 and len(paths) == 3
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths) and not common._scopes.get()


def test_tables_of_a_failed_call_and_of_other_threads(spark):
    import os
    from concurrent.futures import ThreadPoolExecutor

    from thornwick.llm import common

    paths = []

    def fails():
        common.materialize(spark.range(5), "a")
        paths.extend(common._scopes.get()[-1])
        raise KeyError("of make")

    with pytest.raises(KeyError, match="of make"):
        common.settled("c", fails)
    assert len(paths) == 1 and not os.path.exists(paths[0].removeprefix("file:")) and not common._scopes.get()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def job(k):
        def make():
            a = common.materialize(spark.range(100 * k), "a")
            b = common.settled("b", lambda: common.materialize(a.filter("id % 2 = 0"), "even"))
            return a.join(b, "id")

        return common.settled("c", make).count()

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(job, range(1, 9))) == [50 * k for k in range(1, 9)]
    assert spark.conf.get(key) == before


def test_pipeline_run(spark, tmp_path):
    corpus(tmp_path)
    sf = str(tmp_path)
    found = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
    assert found == {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in docs.collect()} and found
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
