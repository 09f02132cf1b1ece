"""Predicates and keys of file paths, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thornwick.functions import tables as t
from thornwick.functions.text import any_of, contains_match


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def is_fixture(path: Column) -> Column:
    """Whether a path lies in a test directory, or names a test or a security document."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    name = basename(path)
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in t.FIXTURE_DIRECTORIES])) | contains_match(name, any_of(t.FIXTURE_FILES)) | contains_match(name, any_of(t.SECURITY_FILES), "i")


def is_priority(path: Column) -> Column:
    return F.lower(basename(path)).isin(*t.PRIORITY_FILES) & ~is_fixture(path)


def is_code(path: Column) -> Column:
    return path.rlike(rf"\.({'|'.join(t.CODE_EXTENSIONS)})$") & ~path.rlike(r"\.d\.ts$|\.(test|spec)\.[^/]+$|(^|/)(node_modules|\.git|coverage|\.next|\.turbo|\.cache)/")


def is_output(path: Column) -> Column:
    return path.rlike(r"^(dist|build|out)/")


def is_content(path: Column) -> Column:
    return path.rlike(rf"\.({'|'.join(t.CONTENT_EXTENSIONS)})$") & ~path.rlike(r"(^|/)(node_modules|\.git|coverage|\.next|\.turbo|\.cache)/|^(dist|build|out)/|^CHANGELOG\.md$|(?i:(^|/)LICEN[SC]E[^/]*$)")


def without_extension(path: Column) -> Column:
    """A module path without its script extension; .tsx and .jsx stay."""
    return F.regexp_replace(path, r"\.(ts|js|mjs|cjs)$", "")


def resolve(directory: Column, module: Column) -> Column:
    """A relative import against a directory, with . and .. resolved; what climbs above the root keeps its .."""
    joined = F.when(directory.isin("", "."), module).otherwise(F.concat(directory, F.lit("/"), module))

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = (part == "..") & (F.size(done) > 0) & (last != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step), "/")
