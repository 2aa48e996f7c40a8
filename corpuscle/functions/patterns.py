"""Globs and regular expressions, compiled once on the driver to patterns that Spark runs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constructs of Java patterns that a linear-time engine refuses.
_REFUSED = (
    (re.compile(r"(?<!\\)(?:\\\\)*\\[1-9]"), "back-references"),
    (re.compile(r"\(\?(?:[=!]|<[=!])"), "look-around"),
    (re.compile(r"\(\?>"), "atomic groups"),
    (re.compile(r"(?<!\\)[*+?}]\+"), "possessive repetition"),
    (re.compile(r"\\k<"), "back-references"),
)


def checked_regex(pattern: str) -> str:
    """The pattern, if it is within the common subset of RE2 and Java; else a ValueError."""
    for refused, name in _REFUSED:
        if refused.search(pattern):
            raise ValueError(f"{name} aren't supported: {pattern}")
    return pattern


def line_predicate(text: Column, pattern: str, fixed: bool = False, ignore_case: bool = False, invert: bool = False) -> Column:
    """Whether a line matches: a regular expression anywhere in it, or a fixed string."""
    if fixed:
        found = F.lower(text).contains(pattern.lower()) if ignore_case else text.contains(pattern)
    else:
        found = text.rlike(("(?iu)" if ignore_case else "") + checked_regex(pattern))
    return ~found if invert else found


def glob_regex(glob: str) -> str:
    """An anchored pattern: ``**`` spans any number of segments, ``*``, ``?`` and ``[..]`` stay within one."""
    parts = glob.strip("/").split("/")
    out = []
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
            continue
        piece, j = "", 0
        while j < len(part):
            c = part[j]
            close = part.find("]", j + 2)
            if c == "*":
                piece += "[^/]*"
            elif c == "?":
                piece += "[^/]"
            elif c == "[" and close > 0:
                inside = part[j + 1 : close]
                negated = inside[:1] in "!^"
                piece += f"[{'^/' if negated else ''}{re.escape(inside[negated:]).replace('\\-', '-')}]"
                j = close
            else:
                piece += re.escape(c)
            j += 1
        out.append(piece + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def matches_globs(path: Column, globs: Sequence[str]) -> Column:
    """Any of the globs; no glob at all matches every path."""
    if not globs:
        return F.lit(True)
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))


def matches_policy_path(path: Column, pattern: str) -> Column:
    """A pattern with ``*?[`` is a glob, any other an exact path or a directory above it."""
    if re.search(r"[*?\[]", pattern):
        return path.rlike(glob_regex(pattern))
    plain = pattern.rstrip("/")
    return (path == plain) | path.startswith(plain + "/")


def repo_allowed(repo: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Included by any pattern (or none is given) and excluded by none; a pattern is a glob or an anchored regular expression."""

    def any_of(patterns: Sequence[str]) -> Column:
        found = F.lit(False)
        for p in patterns:
            found = found | repo.rlike(glob_regex(p))
            try:
                found = found | repo.rlike(f"^(?:{checked_regex(re.compile(p).pattern)})$")
            except (re.error, ValueError):
                continue  # a glob only
        return found

    return (any_of(include) if include else F.lit(True)) & ~any_of(exclude)
