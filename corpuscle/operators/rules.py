"""Saved rules over findings: assertions, suppressions, annotations, messages, tallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions.scalars import basename, dirname, segment, trimmed


def expression(spec: dict | str, bindings: str = "bindings", path: str = "path") -> Column:
    """A string expression: a literal, or one of literal, binding, path, concat, lower, upper, trim, basename, dirname, replace, segment."""
    if isinstance(spec, str):
        return F.lit(spec)
    (name, given), *rest = spec.items()
    if rest:
        raise ValueError(f"one function at a time: {sorted(spec)}")
    of = lambda x: expression(x, bindings, path)
    match name:
        case "literal":
            return F.lit(given)
        case "binding":
            return F.element_at(bindings, given)
        case "path":
            return F.col(path)
        case "concat":
            return F.concat(*map(of, given))
        case "lower":
            return F.lower(of(given))
        case "upper":
            return F.upper(of(given))
        case "trim":
            return trimmed(of(given))
        case "basename":
            return basename(of(given))
        case "dirname":
            return dirname(of(given))
        case "replace":
            return F.replace(of(given["value"]), F.lit(given["old"]), F.lit(given["new"]))
        case "segment":
            return segment(of(given["value"]), given["separator"], given["index"])
    raise ValueError(f"no such function: {name}")


def violations(findings: DataFrame, actual: dict | str, expected: dict | str, message: str) -> DataFrame:
    """Findings whose two sides differ, with the message filled in."""
    both = findings.withColumn("actual", expression(actual)).withColumn("expected", expression(expected)).where(~F.col("actual").eqNullSafe(F.col("expected")))
    return both.withColumn("message", filled(message, {"actual": F.col("actual"), "expected": F.col("expected"), "path": F.col("path")}))


def filled(message: str, values: dict[str, Column]) -> Column:
    """The message with each ``{{name}}`` replaced."""
    out = F.lit(message)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def suppressed_lines(lines: DataFrame, directive: str = r"lint:ignore\s+(\S+)\s+\S", comment: str = r"^\s*(//|#|--|\*|/\*)") -> DataFrame:
    """(path, line, rule): lines that a directive speaks for.

    That is its own line, and, in a block of comment lines, the first line after the block.  A
    directive names a rule and gives a reason.
    """
    by_line = Window.partitionBy("path").orderBy("line")
    marked = lines.withColumn("is_comment", F.col("text").rlike(comment)).withColumn("rule", F.nullif(F.regexp_extract("text", directive, 1), F.lit("")))
    # Each line that isn't a comment ends the block above it.
    block = marked.withColumn("code", F.when(~F.col("is_comment"), F.col("line"))).withColumn("next_code", F.min("code").over(by_line.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    found = block.where("rule is not null")
    own = found.select("path", "line", "rule")
    after = found.where("is_comment and next_code is not null").select("path", F.col("next_code").alias("line"), "rule")
    return own.unionAll(after).distinct()


def unsuppressed(findings: DataFrame, suppressions: DataFrame, always: Sequence[str] = ()) -> DataFrame:
    """Findings (path, line, rule) that nothing suppresses; rules in ``always`` can't be."""
    left = findings.join(suppressions, ["path", "line", "rule"], "left_anti")
    if not always:
        return left
    stays = F.col("rule").isin(*always)
    return findings.where(stays).unionByName(left.where(~stays))


def annotated_only(findings: DataFrame, lines: DataFrame, annotation: str) -> DataFrame:
    """Findings whose line above holds an allowed comment."""
    above = lines.where(F.col("text").rlike(annotation)).select("path", (F.col("line") + 1).alias("line")).distinct()
    return findings.join(above, ["path", "line"], "left_semi")


def changed_only(findings: DataFrame, changed: DataFrame) -> DataFrame:
    return findings.join(changed.select("path").distinct(), "path", "left_semi")


def tallies(findings: DataFrame) -> DataFrame:
    """rule, repo, files, matches: what a saved rule keeps."""
    by_file = findings.groupBy("rule", "repo", "path").agg(F.count("*").alias("n"))
    return by_file.groupBy("rule", "repo").agg(F.count("*").alias("files"), F.sum("n").alias("matches"))
