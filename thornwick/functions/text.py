"""Regular expressions with offsets, and string helpers, as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript's \s has it, inside a class.
JS_SPACE = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
# Java's \w is ECMAScript's, and one look at a table where a class of ranges is a chain of calls for each character.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_OPENS = re.compile(r"\w(?![?*{])|\((?:\?:)?\w(?![?*{])[^()|\[\]\\]*(?:\|\w(?![?*{])[^()|\[\]\\]*)*\)(?![?*{])")
_CLOSES = re.compile(r"(?:^|[^\\])\w$|\((?:\?:)?(?:[^()|\[\]\\]*\w\|)*[^()|\[\]\\]*\w\)$")


def _edge(before: str, after: str) -> str:
    """A word edge between two parts of a pattern; only one side is looked at where the other is a word's character in any case."""
    return r"(?<!\w)" if _OPENS.match(after) else r"(?!\w)" if _CLOSES.search(before) else _EDGE


def java(pattern: str, flags: str = "") -> str:
    """An ECMAScript pattern in Java's dialect: ASCII word edges, ECMAScript's white space and end of input."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\u":
            m = re.match(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})", pattern[i:])
            out.append(rf"\x{{{m[1] or m[2]}}}")
            i += m.end()
            continue
        if pattern[i] == "\\":
            if two == r"\s":
                out.append(JS_SPACE if inside else f"[{JS_SPACE}]")
            elif two == r"\S":
                out.append(rf"[^{JS_SPACE}]" if not inside else rf"\x{{0}}-\x{{10FFFF}}&&[^{JS_SPACE}]")
            elif two == r"\b" and not inside:
                out.append(_edge(pattern[:i], pattern[i + 2 :]))
            else:
                out.append(two)
            i += 2
            continue
        c = pattern[i]
        if c == "[":
            if inside:
                c = r"\["
            elif pattern.startswith(r"[\s\S]", i):
                out.append(r"(?s:.)")
                i += 6
                continue
            inside = True
        elif c == "]":
            inside = False
        elif c == "$" and not inside and "m" not in flags:
            c = r"\z"
        out.append(c)
        i += 1
    on = flags.replace("g", "").replace("u", "")
    return (f"(?{on})" if on else "") + "".join(out)


def contains_match(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(java(pattern, flags))


@cache
def needed(pattern: str, flags: str = "") -> tuple[str, ...]:
    """Words of which every match of the pattern holds one (in lower case if case doesn't count); none if there are no such
    words of two characters or more."""

    def of(tree: list[tuple]) -> set[str] | None:
        found: list[set[str] | None] = []
        run = ""
        for kind, value in [*tree, (None, None)]:
            if kind is sre.LITERAL and ("i" not in flags or value < 128):
                run += chr(value).lower() if "i" in flags else chr(value)
                continue
            found.append({run})
            run = ""
            if kind is sre.BRANCH:
                parts = [of(x) for x in value[1]]
                found.append(None if None in parts else set().union(*parts))
            elif kind is sre.SUBPATTERN:
                found.append(of(value[-1]))
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0]:
                found.append(of(value[2]))
        good = [x for x in found if x and min(map(len, x)) > 1 and len(x) <= 24]
        return max(good, key=lambda x: (min(map(len, x)), -len(x)), default=None)

    try:
        words = of(list(parser.parse(pattern))) or ()
        return tuple(sorted(w for w in words if not any(x in w for x in words if x != w)))  # who holds a longer one holds the shorter
    except re.error:  # not in Python's dialect
        return ()


def folded(text: Column) -> Column:
    """A text as plain words are looked for where case doesn't count: ASCII in lower case, a space for each run of other characters
    (so that Spark's way for ASCII lowers it, some ten times as fast)."""
    return F.lower(F.regexp_replace(text, r"[^\x00-\x7f]+", " "))


def may_match(text: Column, pattern: str, flags: str = "", low: Column | None = None) -> Column:
    """False only where the pattern matches nowhere; found by plain words, which are much cheaper to look for. low is the
    folded text, for callers that look for several patterns."""
    words = needed(pattern, flags)
    if not words:
        return F.lit(True)
    some = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words])
    if "i" not in flags:
        return some(text)
    return bind(folded(text), some) if low is None else some(low)


def matches(text: Column, pattern: str, flags: str = "", low: Column | None = None) -> Column:
    """All matches as array<struct<at, text>>; `at` counts code points before the match. The pattern never matches empty."""
    p = java(pattern, flags)
    none = F.array().cast("array<struct<at:int,text:string>>")

    def place(ms: Column) -> Column:
        between = F.transform(F.split(text, p, -1), lambda x: F.length(x))  # bound, or it would be made for each match
        steps = bind(between, lambda b: F.transform(ms, lambda m, i: F.get(b, i) + F.when(i > 0, F.length(F.get(ms, i - 1))).otherwise(0)))
        sums = bind(steps, running_sums)
        return bind(sums, lambda at: F.transform(ms, lambda m, i: F.struct(F.get(at, i).alias("at"), m.alias("text"))))

    some = bind(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda ms: F.when(F.size(ms) > 0, place(ms)).otherwise(none))
    return F.when(may_match(text, pattern, flags, low), some).otherwise(none)


def matches_by_line(text: Column, pattern: str, may: str) -> Column:
    """As matches, for a pattern whose matches hold no line feed and all hold a character of the class `may`: only lines with
    such a character are looked through."""
    lines = F.split(text, "\n", -1)
    none = F.array().cast("array<struct<at:int,text:string>>")
    shifted = lambda line, start: F.transform(matches(line, pattern), lambda m: F.struct((m["at"] + start).alias("at"), m["text"].alias("text")))

    def of(rows: Column) -> Column:
        ends = bind(F.transform(rows, lambda r: F.length(r["line"]) + 1), running_sums)
        return bind(ends, lambda to: F.flatten(F.transform(rows, lambda r, i: F.when(r["odd"], shifted(r["line"], F.get(to, i) - F.length(r["line"]) - 1)).otherwise(none))))

    marked = F.transform(lines, lambda line: F.struct(line.alias("line"), line.rlike(may).alias("odd")))
    return bind(marked, lambda rows: F.when(F.exists(rows, lambda r: r["odd"]), of(rows)).otherwise(none))


_BLOCK = 128


def running_sums(values: Column) -> Column:
    """The sum of all values up to each, by blocks (a slice takes as long as its whole array). Few lambdas are nested, as each takes
    the analyzer a round."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    within = lambda block, base: F.transform(block, lambda _, i: base + _sum(F.slice(block, F.lit(1), i + 1)))
    summed = lambda parts, totals: F.flatten(F.transform(parts, lambda p, b: bind(_sum(F.slice(totals, F.lit(1), b)), lambda base: within(p, base))))
    return bind(blocks, lambda parts: bind(F.transform(parts, _sum), lambda totals: summed(parts, totals)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, bound to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_at(text: Column, at: Column) -> Column:
    """The 1-based line that offset `at` lies on."""
    return F.size(F.split(F.substring(text, F.lit(1), at), "\n", -1))


def column_at(text: Column, at: Column, base: int = 1) -> Column:
    return F.length(F.substring_index(F.substring(text, F.lit(1), at), "\n", -1)) + F.lit(base)


def in_fence(text: Column, at: Column) -> Column:
    """Whether an odd number of code fences stands before the offset."""
    return F.regexp_count(F.substring(text, F.lit(1), at), F.lit("```")) % 2 == 1


def last_heading(text: Column, at: Column) -> Column:
    """The last markdown heading of one to four marks before the offset, null without one."""
    return F.try_element_at(F.regexp_extract_all(F.substring(text, F.lit(1), at), F.lit(java(r"^#{1,4}\s+.+$", "m")), F.lit(0)), F.lit(-1))


_CHUNK = 4096
_POWERS = tuple(1 << k for k in range(30, -1, -1))
HEADING = r"^#{1,4}\s+.+$"


def indexed(text: Column, headings: bool = False) -> Column:
    """What lookups by offset need of a text, made once: its parts of _CHUNK code points, the offsets of its line feeds and
    code fences, and its headings. A lookup takes as long for a large text as for a small one, but for a binary search."""
    widths = F.transform(F.split(text, "\n", -1), lambda x: F.length(x) + 1)
    feeds = F.transform(bind(widths, running_sums), lambda x: x - 1)
    none = F.array().cast("array<struct<at:int,text:string>>")
    found = F.when(F.contains(text, F.lit("#")), matches(text, HEADING, "m")).otherwise(none) if headings else none
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    return F.struct(chunks.alias("chunks"), feeds.alias("feeds"), F.transform(matches(text, "```"), lambda m: m["at"]).alias("fences"), found.alias("headings"), F.transform(found, lambda h: h["at"]).alias("heads"))


def cut_at(ix: Column, at: Column, n: Column) -> Column:
    """n code points of an indexed text from the offset (as many as there are)."""
    first, inside = F.floor(at / _CHUNK).cast("int"), at % _CHUNK
    chunk = lambda k: F.coalesce(F.get(ix["chunks"], k), F.lit(""))
    parts = F.slice(ix["chunks"], first + 1, F.ceil((inside + n) / _CHUNK).cast("int"))
    held = F.when(inside + n <= _CHUNK, chunk(first)).when(inside + n <= 2 * _CHUNK, F.concat(chunk(first), chunk(first + 1))).otherwise(F.array_join(parts, ""))
    return F.substring(held, inside + 1, n)


def _below(places: Column, at: Column) -> Column:
    """How many of the places, in order, lie before the offset, by binary search."""
    return F.aggregate(F.array(*[F.lit(p) for p in _POWERS]), F.lit(0), lambda lo, p: F.when(F.get(places, lo + p - 1) < at, lo + p).otherwise(lo))


def line_of(ix: Column, at: Column) -> Column:
    """The 1-based line that the offset lies on."""
    return _below(ix["feeds"], at) + 1


def line_span(ix: Column, at: Column) -> Column:
    """start and end (its line feed, or the end) of the line that the offset lies on, and its number."""
    bounds = lambda n: F.struct(F.coalesce(F.get(ix["feeds"], n - 1) + 1, F.lit(0)).alias("start"), F.get(ix["feeds"], n).alias("end"), (n + 1).alias("line"))
    return bind(_below(ix["feeds"], at), bounds)


def fenced_at(ix: Column, at: Column) -> Column:
    """Whether an odd number of code fences ends before the offset."""
    return _below(ix["fences"], at - 2) % 2 == 1


def heading_before(ix: Column, at: Column) -> Column:
    """The last markdown heading before the offset, as much of it as stands there; null without one."""

    def of(n: Column) -> Column:
        last = F.get(ix["headings"], n - 1)
        shown = F.substring(last["text"], F.lit(1), at - last["at"])
        return F.when(contains_match(shown, HEADING, "m"), shown).otherwise(F.get(ix["headings"], n - 2)["text"])

    return bind(_below(ix["heads"], at), of)


def votes(text: Column, patterns: tuple[str, ...], flags: str = "i") -> Column:
    """How many of the patterns the text matches."""

    def of(low: Column) -> Column:
        total = F.lit(0)
        for p in patterns:
            total = total + (may_match(text, p, flags, low) & contains_match(text, p, flags)).cast("int")
        return total

    return bind(folded(text), of) if "i" in flags else of(text)


def any_of(patterns: tuple[str, ...], flags: str = "") -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def trim_js(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{JS_SPACE}]+|[{JS_SPACE}]+\\z", "")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def snippet(ix: Column, at: Column, n: Column) -> Column:
    """At most 120 characters of an indexed text from the offset, line feeds shown as two characters."""
    return F.replace(cut_at(ix, at, F.least(n, F.lit(120))), F.lit("\n"), F.lit("\\n"))


def slug(name: Column, keep: str = "") -> Column:
    """A package name as a key: strict, or with characters of `keep` kept ("._" is the loose form)."""
    x = F.regexp_replace(F.regexp_replace(name, "^@", ""), "/", "-")
    x = F.regexp_replace(x, f"[^A-Za-z0-9{re.escape(keep)}-]", "-")
    x = F.regexp_replace(x, "-+", "-")
    return F.lower(F.regexp_replace(x, r"^-|-\z", ""))


def glob_regex(glob: Column) -> Column:
    """An ignore glob as an anchored pattern: ** crosses slashes, * does not, ? stays a quantifier."""
    x = F.regexp_replace(glob, r"([.+^${}()|\[\]\\])", r"\\$1")
    x = F.replace(x, F.lit("**"), F.lit("\x01"))
    x = F.replace(x, F.lit("*"), F.lit("[^/]*"))
    return F.concat(F.lit("(?i)^"), F.replace(x, F.lit("\x01"), F.lit(".*")), F.lit(r"\z"))
