"""Search over lines: matches, counts, context, ranges, segments and paging.

Sort keys: matches by (path, line); counts by path; pages as their function says.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions.patterns import checked_regex, line_predicate


def matching_lines(lines: DataFrame, pattern: str, fixed: bool = False, ignore_case: bool = False, invert: bool = False) -> DataFrame:
    return lines.where(line_predicate(F.col("text"), pattern, fixed, ignore_case, invert))


def matches_by_file(matches: DataFrame) -> DataFrame:
    """One row a file: its matching lines in order."""
    return matches.groupBy("repo", "path").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("matches"))


def only_matching(lines: DataFrame, pattern: str) -> DataFrame:
    """Each matched part of a line, with its number in the line from 1."""
    found = F.regexp_extract_all("text", F.lit(checked_regex(pattern)), F.lit(0))
    return lines.select("repo", "path", "line", F.posexplode(found).alias("nth", "match")).withColumn("nth", F.col("nth") + 1)


def files_with_matches(matches: DataFrame) -> DataFrame:
    return matches.select("repo", "path").distinct()


def count_by_file(matches: DataFrame) -> DataFrame:
    return matches.groupBy("path").agg(F.count("*").alias("matches"))


def count_summary(matches: DataFrame) -> DataFrame:
    """One row: files and matches; counted by file first, so no task holds all paths."""
    return count_by_file(matches).agg(F.count("*").alias("files"), F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"))


def count_by_repo(matches: DataFrame) -> DataFrame:
    """repo, files, matches; sort key (matches desc, files desc, repo)."""
    by_file = matches.groupBy("repo", "path").agg(F.count("*").alias("n"))
    return by_file.groupBy("repo").agg(F.count("*").alias("files"), F.sum("n").alias("matches"))


def context_lines(lines: DataFrame, hit: object, before: int, after: int) -> DataFrame:
    """Lines within reach of a hit, each once, with ``is_match``."""
    marked = lines.withColumn("is_match", hit)
    around = Window.partitionBy("path").orderBy("line").rowsBetween(-after, before)
    return marked.withColumn("near", F.max("is_match").over(around)).where("near").drop("near")


def resolve_range(files: DataFrame, start: int, end: int) -> DataFrame:
    """path, start_line, end_line, outcome for files with ``n_lines``: exact, cut at the end of file, or missed."""
    outcome = F.when(F.col("n_lines") < start, "full-miss").when(F.col("n_lines") < end, "partial-miss").otherwise("exact")
    last = F.when(F.col("n_lines") >= start, F.least(F.col("n_lines"), F.lit(end)))
    return files.select("path", F.when(F.col("n_lines") >= start, F.lit(start)).alias("start_line"), last.alias("end_line"), outcome.alias("outcome"))


def parse_location(location: str) -> tuple[str, int, int | None]:
    """``PATH:LINE`` or ``PATH:FIRST-LAST``."""
    found = re.fullmatch(r"(.+):(\d+)(?:-(\d+))?", location)
    if not found or int(found[2]) < 1 or found[3] and int(found[3]) < int(found[2]):
        raise ValueError(f"not a location: {location}")
    return found[1], int(found[2]), int(found[3]) if found[3] else None


def read_range(lines: DataFrame, path: str, start: int, end: int) -> DataFrame:
    return lines.where((F.col("path") == path) & F.col("line").between(start, end))


def segments(matches: DataFrame, gap: int = 1) -> DataFrame:
    """Runs of matching lines at most ``gap`` apart: path, segment, start_line, end_line, hits."""
    by_line = Window.partitionBy("path").orderBy("line")
    fresh = F.coalesce(F.col("line") - F.lag("line").over(by_line) > gap, F.lit(True))
    numbered = matches.withColumn("segment", F.sum(fresh.cast("int")).over(by_line))
    return numbered.groupBy("path", "segment").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count("*").alias("hits"))


def spacing_segments(found: DataFrame, lines: DataFrame, most: int = 2) -> DataFrame:
    """Gaps of at most ``most`` blank lines between neighbouring segments (path, start_line, end_line)."""
    by_start = Window.partitionBy("path").orderBy("start_line")
    gaps = found.withColumn("next_start", F.lead("start_line").over(by_start)).select("path", (F.col("end_line") + 1).alias("gap_start"), (F.col("next_start") - 1).alias("gap_end"))
    gaps = gaps.where((F.col("gap_end") >= F.col("gap_start")) & (F.col("gap_end") - F.col("gap_start") < most))
    inside = gaps.withColumn("line", F.explode(F.sequence("gap_start", "gap_end"))).join(lines.select("path", "line", "text"), ["path", "line"])
    blank = inside.groupBy("path", "gap_start", "gap_end").agg(F.min(F.trim("text") == "").alias("blank"))
    return blank.where("blank").select("path", F.col("gap_start").alias("start_line"), F.col("gap_end").alias("end_line"))


def page(rows: DataFrame, order: list, limit: int = 0, skip: int = 0) -> DataFrame:
    """Rows skip to skip + limit of a total order; a limit of 0 is none."""
    ordered = rows.orderBy(*order).offset(skip) if skip else rows.orderBy(*order)
    return ordered.limit(limit) if limit > 0 else ordered


def page_size(asked: int | None) -> int:
    """Unset asks for 20; beyond 1 to 100 gives 100."""
    return 20 if asked is None else asked if 1 <= asked <= 100 else 100


def effective_limit(limit: int = 0, max_files: int = 0) -> int:
    return min([x for x in (limit, max_files) if x > 0], default=0)


def after_key(rows: DataFrame, key: str, last: str | None, limit: int) -> DataFrame:
    """Keyset paging: the rows after a key."""
    return (rows if last is None else rows.where(F.col(key) > last)).orderBy(key).limit(limit)


def first_eligible(files: DataFrame, most: int) -> DataFrame:
    """``files`` with ``analysed``: whether it is among the first by path; the others are reported as skipped.

    The cut is a path, found by a top-k, so no task ranks all files.
    """
    cut = files.select("path").orderBy("path").limit(most).agg(F.max("path")).first()[0]  # one value
    return files.withColumn("analysed", F.lit(False) if cut is None else F.col("path") <= cut)


def structure_summary(segments_: DataFrame) -> DataFrame:
    """Counts by structure status."""
    return segments_.groupBy("status").agg(F.count("*").alias("files"))
