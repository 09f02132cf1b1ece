"""Prompt-injection detectors over content files (pkg, path, content, is_priority, is_fixture).

Each detector turns a file into an array of findings by regular expressions with offsets; context (fences, headings, words
nearby) is text around the offset. Plain words that a pattern's matches must hold let files without any pass without a scan.
Offsets, lines and columns count code points; columns start at 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thornwick.functions import tables as t
from thornwick.functions.text import any_of, bind, contains_match, cut_at, fenced_at, folded, heading_before, indexed, java, line_at, line_span, matches, matches_by_line, snippet, trim_js, votes

HIT = "array<struct<at:int,text:string,technique:string,severity:string,confidence:double,description:string>>"


def _hit(m: Column, technique: Column | str, severity: Column, confidence: Column, description: Column) -> Column:
    technique = F.lit(technique) if isinstance(technique, str) else technique
    return F.struct(m["at"].alias("at"), m["text"].alias("text"), technique.alias("technique"), severity.alias("severity"), confidence.cast("double").alias("confidence"), description.alias("description"))


def _levels(category: str, priority: Column) -> tuple[Column, Column]:
    s1, c1, s0, c0 = t.PROMPT_LEVELS[category]
    return F.when(priority, s1).otherwise(s0), F.when(priority, c1).otherwise(c0)


def _by_rules(category: str, text: Column, build: Callable[[Column, Column], Column], keep: Callable[[Column, Column], Column] | None = None, headings: bool = False) -> Column:
    """Hits of a category's rules, in order; build and keep, which may reject a match by its context, get a match (at, text,
    technique) and the text's index, which is made only where something matches."""
    named = lambda technique: lambda m: F.struct(m["at"].alias("at"), m["text"].alias("text"), F.lit(technique).alias("technique"))
    parts = lambda low: [F.transform(matches(text, pattern, flags, low), named(technique)) for technique, flags, pattern in t.PROMPT_RULES[category]]

    def hits(ms: Column) -> Column:
        made = lambda ix: F.transform(F.filter(ms, lambda m: keep(m, ix)) if keep else ms, lambda m: build(m, ix)).cast(HIT)
        return F.when(F.size(ms) > 0, bind(indexed(text, headings), made) if keep or headings else made(F.lit(None))).otherwise(F.array().cast(HIT))

    return bind(bind(folded(text), lambda low: F.concat(*parts(low))), hits)


def _quoted(prefix: str, technique: Column | None, m: Column, most: int | None = 80) -> Column:
    shown = trim_js(m["text"])
    shown = F.substring(shown, 1, most) if most else shown
    head = F.lit(f'{prefix}: "') if technique is None else F.concat(F.lit(f"{prefix} ("), technique, F.lit('): "'))
    return F.concat(head, shown, F.lit('"'))


def instruction_override(text: Column, path: Column, priority: Column) -> Column:
    severity, confidence = _levels("instruction-override", priority)

    def mid_sentence(m: Column, ix: Column) -> Column:
        before = bind(line_span(ix, m["at"]), lambda s: cut_at(ix, s["start"], m["at"] - s["start"]))
        return contains_match(m["text"], r"\bSYSTEM\s*:", "i") & (F.length(trim_js(before)) > 0)

    def benign(m: Column, ix: Column) -> Column:
        start = F.greatest(m["at"] - 200, F.lit(0))
        nearby = F.lower(cut_at(ix, start, m["at"] + 100 - start))
        heading = F.coalesce(contains_match(heading_before(ix, m["at"]), t.BENIGN_HEADING, "im"), F.lit(False))
        return fenced_at(ix, m["at"]) | bind(nearby, lambda x: votes(x, t.TECHNICAL_WORDS, "") >= 2) | heading

    def build(m: Column, ix: Column) -> Column:
        return bind(benign(m, ix), lambda b: _hit(m, m["technique"], F.when(b, "medium").otherwise(severity), F.when(b, 0.3).otherwise(confidence), _quoted("Detected instruction-override attempt", None, m, None)))

    return _by_rules("instruction-override", text, build, lambda m, ix: (m["technique"] != "instruction-pattern") | ~mid_sentence(m, ix), headings=True)


def has_instructions(text: Column) -> Column:
    return votes(text, t.INSTRUCTION_WORDS) >= 2


def code_points(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.concat(F.lit("U+"), F.lpad(F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0+", ""), 4, "0"))), " ")


#: Runs of each kind of odd characters, and words with a lookalike; no two kinds share a character, and a match that is no word
#: begins outside of ASCII, so one pass finds all of them.
_WORD = r"\p{Alpha}"
_SOME_ODD = "[[^\\x01-\\x7f]&&[\\x00" + "".join(java(x).rstrip("+") for x in (t.ZERO_WIDTH, t.BIDI, t.VARIATION, t.LOOKALIKE)) + "]]"
_ODD = f"(?=[^\\x01-\\x7f])(?:{t.ZERO_WIDTH}|{t.BIDI}|{t.VARIATION}|{t.NULLS}|{t.LOOKALIKE}{_WORD}+)|(?<!{_WORD}){_WORD}++{t.LOOKALIKE}{_WORD}*"


def hidden_text(text: Column, path: Column, priority: Column) -> Column:
    """Zero-width, bidirectional, variation-selector and lookalike characters, comments, null bytes."""
    body = lambda m: F.regexp_replace(m["text"], r"(?s)^<!--|-->\z", "")
    begins = lambda kind: lambda m: m["text"].rlike(f"^{java(kind)}")
    kinds: tuple[tuple[str, Callable[[Column], Column], Callable[[Column], Column]], ...] = (
        ("unicode-smuggling", begins(t.ZERO_WIDTH), lambda m: code_points(m["text"])),
        ("bidi-override", begins(t.BIDI), lambda m: code_points(m["text"])),
        ("variation-selector", begins(t.VARIATION), lambda m: code_points(m["text"])),
        ("homoglyph", lambda m: m["text"].rlike(_WORD), lambda m: F.concat(F.lit('Word "'), m["text"], F.lit('" contains non-ASCII lookalikes: '), F.regexp_replace(code_points(F.regexp_replace(m["text"], r"[\x00-\x7f]", "")), " ", ", "))),
        ("html-comment", lambda m: (m["at"] > 0) & ~contains_match(trim_js(body(m)), any_of(t.METADATA_COMMENTS), "i"), lambda m: trim_js(body(m))),
        ("null-byte", begins(t.NULLS), lambda m: F.concat(F.length(m["text"]).cast("string"), F.lit(" null byte(s)"))),
    )

    def build(m: Column, technique: str, decode: Callable[[Column], Column]) -> Column:
        comment = technique == "html-comment"

        def of(x: Column) -> Column:
            short = (F.length(x["d"]) < 40) & ~x["i"] if comment else F.lit(False)
            severity = F.when(x["i"], "critical").when(short, "low").when(priority, "high").otherwise("medium")
            confidence = F.when(x["i"], 0.95).when(short, 0.2).when(priority, 0.8).otherwise(0.6)
            shown = F.when(F.length(x["d"]) > 80, F.concat(F.substring(x["d"], 1, 80), F.lit("..."))).otherwise(x["d"])
            said = F.when(x["i"], F.concat(F.lit(f'Hidden text contains instruction-like payload ({technique}): "'), shown, F.lit('"'))).otherwise(
                F.concat(F.lit(f"Hidden/invisible text detected ({technique}) at byte offset "), m["at"].cast("string"), F.lit(': "'), shown, F.lit('"'))
            )
            return _hit(m, technique, severity, confidence, said)

        return bind(F.struct(decode(m).alias("d"), has_instructions(body(m) if comment else decode(m)).alias("i")), of)

    built = lambda technique, decode: lambda m: build(m, technique, decode)

    def of_kinds(x: Column) -> Column:
        found = lambda technique: x["comments" if technique == "html-comment" else "odd"]
        return F.concat(*[F.transform(F.filter(found(technique), is_kind), built(technique, decode)) for technique, is_kind, decode in kinds]).cast(HIT)

    odd = matches_by_line(text, _ODD, _SOME_ODD)
    return bind(F.struct(odd.alias("odd"), matches(text, t.HTML_COMMENT).alias("comments")), of_kinds)


DOC_FILES = ("security.md", "security.txt", "changelog.md", "changelog", "changes.md", "history.md", "contributing.md", "contributors.md", "code_of_conduct.md", "license.md", "license", "authors.md")
# Headings, warnings that mark descriptive context.
DOC_SECTIONS = (
    r"##?\s*(?:setup|install|configuration|config|usage|getting\s*started|prerequisites|requirements)", r"##?\s*(?:environment|env|variables|tokens?|api\s*keys?|authentication|auth)",
    r"##?\s*(?:how\s*to|quick\s*start|tutorial|guide|steps?|example)", r"##?\s*(?:security|threat|risk|warning|caution|note|about)",
    r"##?\s*(?:features?|description|overview|what|tools?|capabilities)", r"##?\s*(?:changelog|changes|history|release)",
)
WARNINGS = (r"(?:protect|prevent|guard|defend|mitigat|warn|risk|threat|vulnerab|attack|danger|avoid)\w*", r"(?:do\s+not|don'?t|never|should\s+not|must\s+not|be\s+careful)", r"(?:security\s+(?:policy|advisory|issue|concern|best\s+practice))")


def data_exfiltration(text: Column, path: Column, priority: Column) -> Column:
    category = "data-exfiltration-prompt"
    _, confidence = _levels(category, priority)
    readme = F.contains(F.lower(path), F.lit("readme"))

    def descriptive(m: Column, ix: Column) -> Column:
        start = F.greatest(m["at"] - 500, F.lit(0))
        around = F.struct(
            F.lower(cut_at(ix, start, m["at"] - start)).alias("before"),
            bind(line_span(ix, m["at"]), lambda s: F.lower(cut_at(ix, s["start"], s["end"] - s["start"]))).alias("line"),
        )
        warned = any_of(WARNINGS)

        def told(x: Column) -> Column:
            near = F.substring(x["before"], F.greatest(F.length(x["before"]) - 199, F.lit(1)), F.lit(200))
            return contains_match(x["before"], any_of(DOC_SECTIONS)) | contains_match(x["line"], r"^\s*[-*]\s*\[") | contains_match(x["line"], r"\[[^\]]+\]\([^)]+\)") | contains_match(near, warned) | contains_match(x["line"], warned)

        return fenced_at(ix, m["at"]) | bind(around, told)

    def build(m: Column, ix: Column) -> Column:
        strong = m["technique"].isin(*t.COMPOUND_TECHNIQUES)
        severity = F.when(~readme & strong, "critical").otherwise("high")
        sure = F.when(strong, F.when(priority, 0.95).otherwise(0.85)).otherwise(confidence)
        return _hit(m, m["technique"], severity, F.when(readme, sure * 0.7).otherwise(sure), _quoted("Data exfiltration pattern detected", m["technique"], m))

    skipped = F.lit(False)
    for name in DOC_FILES:
        skipped = skipped | F.lower(path).endswith(name)
    return F.when(skipped, F.array().cast(HIT)).otherwise(_by_rules(category, text, build, lambda m, ix: ~descriptive(m, ix)))


def tool_abuse(text: Column, path: Column, priority: Column) -> Column:
    severity, confidence = _levels("tool-abuse", priority)
    markdown = contains_match(path, r"\.(?:md|mdx|markdown)(?::\d+)?$", "i")

    def directed(m: Column, ix: Column) -> Column:
        start = F.greatest(m["at"] - 120, F.lit(0))
        around = cut_at(ix, start, m["at"] + F.length(m["text"]) + 120 - start)
        return ~markdown | fenced_at(ix, m["at"]) | contains_match(around, t.AI_DIRECTED, "i")

    build = lambda m, _: _hit(m, m["technique"], severity, confidence, _quoted("Tool/shell abuse instruction detected", m["technique"], m))
    return _by_rules("tool-abuse", text, build, lambda m, ix: (m["technique"] != "tool-abuse-pattern") | directed(m, ix))


def _plain(category: str, said: str) -> Callable[[Column, Column, Column], Column]:
    def detect(text: Column, path: Column, priority: Column) -> Column:
        severity, confidence = _levels(category, priority)
        return _by_rules(category, text, lambda m, _: _hit(m, m["technique"], severity, confidence, _quoted(said, m["technique"], m)))

    return detect


persona_hijack = _plain("persona-hijack", "Persona/safety hijack attempt detected")
cot_manipulation = _plain("cot-manipulation", "Reasoning manipulation detected")
delimiter_escape = _plain("delimiter-escape", "Delimiter/context escape detected")
_indirect = _plain("indirect-injection", "Indirect injection vector detected")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1))


def misleading_links(text: Column, path: Column, priority: Column) -> Column:
    severity, confidence = F.when(priority, "high").otherwise("medium"), F.when(priority, 0.75).otherwise(0.55)
    shown = lambda m: F.regexp_extract(m["text"], java(t.LINK), 1)
    target = lambda m: F.regexp_extract(m["text"], java(t.LINK), 2)

    def misleads(m: Column) -> Column:
        hosts = shown(m).rlike("^https?://") & (url_host(shown(m)) != "") & (url_host(target(m)) != "") & (url_host(shown(m)) != url_host(target(m)))
        return hosts | (contains_match(target(m), t.RISKY_EXTENSION, "i") & contains_match(trim_js(shown(m)), t.PLAIN_LINK_WORDS, "i"))

    said = lambda m: F.concat(F.lit('Misleading markdown link: display text "'), shown(m), F.lit('" points to "'), F.substring(target(m), 1, 60), F.lit('"'))
    return F.transform(F.filter(matches(text, t.LINK), misleads), lambda m: _hit(m, "misleading-link", severity, confidence, said(m))).cast(HIT)


def suspicious_images(text: Column, path: Column, priority: Column) -> Column:
    severity, confidence = F.when(priority, "high").otherwise("medium"), F.when(priority, 0.7).otherwise(0.5)
    alt = lambda m: F.regexp_extract(m["text"], java(t.IMAGE), 1)
    told = lambda m: contains_match(alt(m), t.ALT_WORDS, "i")
    coded = lambda m: contains_match(F.regexp_extract(m["text"], java(t.IMAGE), 2), t.ENCODED_IMAGE, "i")
    technique = lambda m: F.when(told(m), "instruction-in-alt-text").otherwise("encoded-image-url")
    said = lambda m: F.concat(F.lit("Suspicious image reference ("), technique(m), F.lit('): alt="'), F.substring(alt(m), 1, 40), F.lit('"'))
    return F.transform(F.filter(matches(text, t.IMAGE), lambda m: told(m) | coded(m)), lambda m: _hit(m, technique(m), severity, confidence, said(m))).cast(HIT)


def indirect_injection(text: Column, path: Column, priority: Column) -> Column:
    return F.concat(_indirect(text, path, priority), misleading_links(text, path, priority), suspicious_images(text, path, priority))


DETECTORS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "instruction-override": instruction_override,
    "hidden-text": hidden_text,
    "data-exfiltration-prompt": data_exfiltration,
    "tool-abuse": tool_abuse,
    "persona-hijack": persona_hijack,
    "cot-manipulation": cot_manipulation,
    "delimiter-escape": delimiter_escape,
    "indirect-injection": indirect_injection,
}


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in t.SEVERITIES]), severity) - 1


def detect(files: DataFrame, categories: tuple[str, ...] = tuple(DETECTORS)) -> DataFrame:
    """Findings of the given detectors in detector and match order (ord), reduced in fixtures, not yet deduplicated. Files are
    read once for all detectors, and what a finding needs of a text is taken before findings become rows."""
    text, path, priority = F.col("content"), F.col("path"), F.col("is_priority")

    def shown(category: str, m: Column, ix: Column) -> Column:
        size = F.length(m["text"])
        if category == "hidden-text":
            return snippet(ix, F.greatest(m["at"] - 10, F.lit(0)), size + 20)
        if category == "indirect-injection":
            return snippet(ix, m["at"], size + F.when(m["technique"].isin("misleading-link", "instruction-in-alt-text", "encoded-image-url"), 0).otherwise(40))
        return snippet(ix, m["at"], size + 40)

    def placed(k: int, category: str) -> Column:
        def of(m: Column, i: Column, ix: Column) -> Column:
            place = lambda s: F.struct(
                F.lit(category).alias("category"), s["line"].alias("line"), (m["at"] - s["start"] + 1).alias("column"), m["at"].alias("at"), m["technique"].alias("technique"), m["severity"].alias("severity"), m["confidence"].alias("confidence"), m["description"].alias("description"),
                shown(category, m, ix).alias("snippet"), (F.lit(k) * 1_000_000 + i).cast("long").alias("ord"),
            )
            return bind(line_span(ix, m["at"]), place)

        found = lambda ms: F.when(F.size(ms) > 0, bind(indexed(text), lambda ix: F.transform(ms, lambda m, i: of(m, i, ix))))
        return bind(DETECTORS[category](text, path, priority), found)

    # an outer explode: of an inner one Spark infers a filter on the array's size and computes the array twice
    hits = F.flatten(F.array_compact(F.array(*[placed(k, c) for k, c in enumerate(categories)])))
    found = files.select("pkg", "path", "is_fixture", F.explode_outer(hits).alias("m")).filter("m IS NOT NULL")
    lowered = F.element_at(F.create_map(*[F.lit(x) for kv in t.FIXTURE_DOWNGRADE.items() for x in kv]), F.col("m.severity"))
    return found.select(
        "pkg",
        "m.category",
        F.when(F.col("is_fixture"), lowered).otherwise(F.col("m.severity")).alias("severity"),
        F.col("path").alias("file"),
        "m.line",
        "m.column",
        "m.at",
        "m.description",
        "m.snippet",
        F.when(F.col("is_fixture"), F.col("m.confidence") * t.FIXTURE_FACTOR).otherwise(F.col("m.confidence")).alias("confidence"),
        "m.technique",
        F.col("is_fixture").alias("is_test_fixture"),
        "m.ord",
    )


def deduplicated(findings: DataFrame) -> DataFrame:
    """The severest, then surest, then first finding of each place, category and technique."""
    place = Window.partitionBy("pkg", "file", "line", "column", "category", "technique").orderBy(F.desc(rank(F.col("severity"))), F.desc("confidence"), "ord")
    return findings.withColumn("rn", F.row_number().over(place)).filter("rn = 1").drop("rn")


def by_locale(name: Column) -> list[Column]:
    """Order of names as a reader's locale has it (the Unicode root collation: a, B, c; accents and case decide ties), and by
    code point where that holds two names equal."""
    return [F.collate(name, "UNICODE"), name]


def in_order(findings: DataFrame) -> DataFrame:
    """findings with ord anew (from 1, long) by package: the severest first, then files by locale, then as they were found."""
    place = Window.partitionBy("pkg").orderBy(F.desc(rank(F.col("severity"))), *by_locale(F.col("file")), "ord", "line", "column")
    return findings.withColumn("ord", F.row_number().over(place).cast("long"))


def looks_like_prompt(text: Column) -> Column:
    return votes(text, t.PROMPT_INDICATORS) >= 2


def embedded_prompts(code_files: DataFrame) -> DataFrame:
    """Long literals of code files (pkg, path, content, is_fixture) that read like prompts, as content files of their own."""
    literal = F.transform(matches(F.col("content"), t.TEMPLATE_LITERAL), lambda m: F.struct(m["at"].alias("at"), F.regexp_extract(m["text"], f"(?s){java(t.TEMPLATE_LITERAL)}", 1).alias("text")))
    described = F.transform(matches(F.col("content"), t.DESCRIPTION_LITERAL), lambda m: F.struct(m["at"].alias("at"), F.regexp_extract(m["text"], java(t.DESCRIPTION_LITERAL), 1).alias("text")))
    found = code_files.select("pkg", "path", "content", "is_fixture", F.explode_outer(F.concat(literal, described)).alias("m")).filter(F.col("m").isNotNull()).filter(looks_like_prompt(F.col("m.text")))
    line = line_at(F.col("content"), F.col("m.at"))
    return found.select("pkg", F.concat(F.col("path"), F.lit(":"), line.cast("string")).alias("path"), F.col("m.text").alias("content"), (~F.col("is_fixture")).alias("is_priority"), "is_fixture", F.lit("code-string").alias("source"))
