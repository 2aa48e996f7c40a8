"""Scalar functions on paths, names, labels and measures, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, which is what trimming removes.
SPACE = r"[\s\u0085   -     　]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def basename(path: Column) -> Column:
    bare = F.regexp_replace(path, "/+$", "")
    return F.when(path == "", ".").when(bare == "", "/").otherwise(F.substring_index(bare, "/", -1))


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def segment(c: Column, separator: str, index: int) -> Column:
    """The part at a place from 0, or from the end if negative; out of range is an error."""
    parts = F.split(c, r"\Q" + separator + r"\E")
    at = index + 1 if index >= 0 else index
    return F.when(F.size(parts) < abs(at) if index < 0 else F.size(parts) < at, F.raise_error(F.concat(F.lit("no such segment in: "), c))).otherwise(F.element_at(parts, at))


def repo_id(path: Column) -> Column:
    """The first two segments."""
    return F.substring_index(F.regexp_replace(path, "^/+|/+$", ""), "/", 2)


def ancestors(path: Column) -> Column:
    """``.`` and every directory above the path."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    dirs = F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    return F.concat(F.array(F.lit(".")), dirs)


def terminal_symbol(name: Column) -> Column:
    """What follows the last of ``. : #``."""
    return F.element_at(F.filter(F.split(name, "[.:#]"), lambda x: x != ""), -1)


def terminal_type(name: Column) -> Column:
    """A type's own name: without pointers, qualifiers and type arguments."""
    plain = F.regexp_replace(F.regexp_replace(name, r"^[*&\s]+", ""), r"\[.*$", "")
    return F.element_at(F.split(plain, "[./:]"), -1)


def callable_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def package_or_directory(package: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(package, F.lit("")), dirname(path))


def label_key(label: Column) -> Column:
    return F.lower(F.regexp_replace(trimmed(label), f"{SPACE}+", "-"))


def language_family(language: Column) -> Column:
    return F.when(language == "tsx", "typescript").otherwise(language)


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def estimated_tokens(n_bytes: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((n_bytes + 3) / 4)


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.greatest(F.unix_millis(end) - F.unix_millis(start), F.lit(0))


def percent_change(before: Column, after: Column) -> Column:
    """Null when there is nothing to compare with."""
    return F.when(before != 0, (after - before) / before * 100)


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(tests?|__tests__|testdata|spec)(/|$)|(_test|\.test|\.spec|_spec)\.[^/]+$")


def sorted_distinct(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))
