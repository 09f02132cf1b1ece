"""Text functions against Python's re, slugs, globs, paths."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thornwick.functions import lexer, paths, text
from thornwick.functions import tables as t


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab \n<!->x\U0001f600é", max_size=60))
def test_offsets_equal_finditer(spark, content):
    want = [(m.start(), m[0]) for m in re.finditer(r"<!--[\s\S]*?-->|ab+", content)]
    got = one(spark, text.matches(F.col("c"), r"<!--[\s\S]*?-->|ab+"), c=content)
    assert [(r["at"], r["text"]) for r in got] == want


def test_line_and_column(spark):
    content = "ab\ncd\U0001f600e\nf"
    for at in range(len(content)):
        before = content[:at]
        assert one(spark, text.line_at(F.col("c"), F.lit(at)), c=content) == before.count("\n") + 1
        assert one(spark, text.column_at(F.col("c"), F.lit(at)), c=content) == len(before.split("\n")[-1]) + 1


@pytest.mark.parametrize(
    "pattern,flags,content,found",
    [(r"\bfetch\s*\(", "", "éfetch(", True), (r"\bfetch\s*\(", "", "xfetch(", False), (r"a\sb", "", "a b", True), (r"a\sb", "", "a﻿b", True), (r"\bSYSTEM\s*:\s*(?!$)", "i", "system:\n", True), (r"\bSYSTEM\s*:\s*(?!$)", "i", "system:", False), (r"^x$", "", "x\n", False), (r"[\s-]y", "", "-y", True)],
)
def test_dialect(spark, pattern, flags, content, found):
    assert one(spark, text.contains_match(F.col("c"), pattern, flags), c=content) is found


@pytest.mark.parametrize("name,strict,loose", [("@a/b.c", "a-b-c", "a-b.c"), ("Foo__Bar", "foo-bar", "foo__bar"), ("-x-", "x", "x"), ("ü/K", "k", "k")])
def test_slugs(spark, name, strict, loose):
    assert one(spark, text.slug(F.col("n")), n=name) == strict
    assert one(spark, text.slug(F.col("n"), "._"), n=name) == loose


@pytest.mark.parametrize("glob,path,found", [("src/*.js", "src/a.js", True), ("src/*.js", "src/b/a.js", False), ("src/**", "src/b/a.js", True), ("a.b", "aXb", False), ("A*", "abc", True), ("ab?c", "ac", True)])
def test_globs(spark, glob, path, found):
    assert one(spark, F.rlike(F.col("p"), text.glob_regex(F.col("g"))), g=glob, p=path) is found


@pytest.mark.parametrize("path,found", [("tests/a.md", True), ("a/fixtures/b.js", True), ("src/foo.test.ts", True), ("SECURITY.md", True), ("src/a.js", False), ("contests/a.js", False), ("a\\spec\\b.js", True)])
def test_fixture_paths(spark, path, found):
    assert one(spark, paths.is_fixture(F.col("p")), p=path) is found


@pytest.mark.parametrize("directory,module,want", [("src", "./a", "src/a"), ("src/x", "../a/./b", "src/a/b"), ("", "./a", "a"), ("a", "../../b", "../b")])
def test_resolve(spark, directory, module, want):
    assert one(spark, paths.resolve(F.col("d"), F.col("m")), d=directory, m=module) == want


def test_lexer():
    f = lexer.scan("import fs, {readFile as r} from 'fs';\nconst {A, B} = process.env; // fetch('no')\nconst u = `x ${fetch('https://e.com', {a: [1, 2]})}`;\nrequire('http'); new WebSocket(u); process.env[k]; process.env['X_TOKEN']; a.b.c(1, 'two', x + 'y'); /re\\/(x)/.test(s);\nfunction go(p, q) { return eval(`a${p}`) }\nObject.keys(process.env); ({...process.env})")
    assert [(m, d, r) for m, _, d, r, *_ in f.imports] == [("fs", "fs", False), ("http", None, True)]
    calls = {c.expression: (c.arguments, c.kinds, c.is_new) for c in f.calls}
    assert calls["WebSocket"][2] and calls["a.b.c"] == (["1", "'two'", "x + 'y'"], ["number", "string", "concat"], False) and calls["eval"][1] == ["template"]
    assert [(v, form) for v, form, *_ in f.env] == [(["A", "B"], "destructured"), ([], "computed"), (["X_TOKEN"], "literal"), ([], "Object.keys"), ([], "spread")]
    assert ("go", ["p", "q"]) in [(n, p) for n, p, *_ in f.functions]
    for broken in ("`${", "'abc", "/* x", "((((", "}}}", "import", "process.env", ""):
        lexer.scan(broken)


def test_rule_tables_compile():
    for *_, p in t.CODE_RULES:
        re.compile(p)
    assert len(t.CODE_RULES) == 31 and sum(map(len, t.PROMPT_RULES.values())) >= 110 and len(t.POPULAR_PACKAGES) == 76


def test_offsets_of_many_matches(spark):
    """Offsets equal Python's for counts around the block size, and the words that a pattern needs are in every match."""
    for n in (0, 1, 31, 32, 33, 63, 129, 511, 512, 513, 1025, 3000):
        content = "é" + "".join("ab" + "x" * (k % 5) for k in range(n)) + "z"
        got = one(spark, F.transform(text.matches(F.col("c"), "ab?"), lambda m: m["at"]), c=content)
        assert got == [m.start() for m in re.finditer("ab?", content)]


def test_needed_words():
    r = random.Random(2)
    patterns = [(p, "") for *_, p in t.CODE_RULES] + [(p, f) for rules in t.PROMPT_RULES.values() for _, f, p in rules] + [("a|b", ""), ("[ab]c", ""), ("(?:foo|ba+r)?x", ""), ("(?:foo|bar)+", "i")]
    checked = 0
    for p, flags in patterns:
        words = text.needed(p, flags)
        assert all(len(w) > 1 for w in words)
        try:
            found = re.compile(p, re.I if "i" in flags else 0)
        except re.error:
            continue
        for _ in range(200):
            parts = [*words, *re.findall(r"[\w./~-]{2,}", p), " ", "(", "'", "x"]
            s = "".join(r.choice(parts) for _ in range(6))
            if m := found.search(s):
                checked += 1
                assert not words or any(w in (m[0].lower() if "i" in flags else m[0]) for w in words), (p, m[0])
    assert checked > 500


def test_index_equals_looking_back(spark):
    r = random.Random(5)
    for n in (0, 1, 30, 5000, 9000):
        content = "".join(r.choice(["\n", "```", "# Usage é\n", "## x ", "word ", "é", "``", "#", " "]) for _ in range(n))
        rows = [(content, k) for k in sorted({0, len(content), *(r.randint(0, len(content)) for _ in range(40))})]
        frame = spark.createDataFrame(rows, "c string, at int")
        ix, at = F.col("ix"), F.col("at")
        cut = text.bind(text.line_span(ix, at), lambda s: text.cut_at(ix, s["start"], s["end"] - s["start"]))
        found = frame.select("c", "at", text.indexed(F.col("c"), headings=True).alias("ix")).select(
            "c", "at", text.line_of(ix, at).alias("line"), cut.alias("whole"), text.fenced_at(ix, at).alias("fenced"), text.heading_before(ix, at).alias("heading"), text.cut_at(ix, at, F.lit(300)).alias("part"),
            text.line_at(F.col("c"), at).alias("line0"), text.in_fence(F.col("c"), at).alias("fenced0"), text.last_heading(F.col("c"), at).alias("heading0"),
        )
        for x in found.collect():
            assert (x.line, x.fenced, x.heading) == (x.line0, x.fenced0, x.heading0), (n, x.at)
            assert x.part == content[x.at : x.at + 300] and x.whole == content[: x.at].split("\n")[-1] + content[x.at :].split("\n")[0]


def test_many_matches_take_time_in_proportion(spark):
    import time

    from thornwick.operators import code_rules, prompts

    took = []
    for n in (1_000, 8_000):
        content = "\n".join(f"line {k} eval(x) <!-- a note --> jailbreak" for k in range(n))
        files = spark.createDataFrame([("p", "a.md", content, False, False)], "pkg string, path string, content string, is_priority boolean, is_fixture boolean").cache()
        files.count()
        best = []
        for f in (lambda: prompts.detect(files, ("hidden-text", "persona-hijack")), lambda: code_rules.detect(files)):
            t = time.perf_counter()
            rows = f().select("line", "column").collect()
            best.append(time.perf_counter() - t)
            assert sorted({x.line for x in rows})[-1] == n and len({x.column for x in rows}) <= 30
        took.append(best)
    assert all(b < 8 * 3 * max(a, 1.0) for a, b in zip(*took, strict=True)), took


def test_plain_words_without_those_that_hold_another():
    assert text.needed(r"\b(?:execSync|exec|spawnSync|spawn)\s*\(") == ("exec", "spawn")


@pytest.mark.parametrize("pattern", [r"\bab", r"ab\b", r"\b(?:a|bc)", r"(a|bc)\b", r"\bab?\b", r"\b@a", r"\b(?:a?|b)", r"\b(a|b)*", r"(a|b?)\b", r"a\b|\bb", r"\b[ab]\b"])
def test_word_edges_as_before(spark, pattern):
    """An edge beside a word's character looks at one side only; results are those of both sides."""
    import itertools

    texts = ["".join(x) for n in range(1, 5) for x in itertools.product("ab @", repeat=n)]
    edge = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    rows = spark.createDataFrame([(x,) for x in texts], "t string").coalesce(1)
    assert rows.filter(F.regexp_extract_all("t", F.lit(text.java(pattern)), F.lit(0)) != F.regexp_extract_all("t", F.lit(pattern.replace(r"\b", edge)), F.lit(0))).count() == 0
    if pattern in (r"\bab", r"ab\b", r"\b(?:a|bc)", r"(a|bc)\b"):
        assert "|(?<!" not in text.java(pattern)


def test_votes_look_for_plain_words_first(spark):
    """Texts of other letters are searched too; a pattern whose words are not in a text is not run over it."""
    rows = spark.createDataFrame([("\u00c4 SYSTEM: \u00d6 Ignore it",), ("nothing \u212aelvin",), ("s\u00c4ystem: ignores",)], "t string").coalesce(1)
    votes = text.votes(F.col("t"), (r"\bsystem\s*:", r"\bignore\b", r"kelvin"))
    assert [r.v for r in rows.select(votes.alias("v")).collect()] == [2, 0, 0]
    assert "contains" in rows.select(votes)._jdf.queryExecution().analyzed().toString().lower()


def test_matches_by_line_are_matches(spark):
    rows = spark.createDataFrame([("a\n\n\u00e9b\u0430c x\n" * 300,), ("",), ("\n",), ("\u0430",), ("plain\ntext",)], "t string").coalesce(1)
    pattern = r"[a-z]*\u0430[a-z]*"
    assert rows.filter(~text.matches(F.col("t"), pattern).eqNullSafe(text.matches_by_line(F.col("t"), pattern, r"\x{430}"))).count() == 0
