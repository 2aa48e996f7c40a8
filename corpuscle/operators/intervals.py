"""Interval lookups: the narrowest interval of a file that holds a line or overlaps a range.

Intervals are dealt to stretches of lines, so a lookup is an equality join on (path, stretch)
with a residual range test; an interval is copied to each stretch it crosses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRETCH = 64  # lines


def _dealt(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("__at", F.explode(F.sequence(F.floor(F.col("start_line") / STRETCH), F.floor(F.col("end_line") / STRETCH))))


def containing(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each point (path, line, ...) with each interval (path, start_line, end_line, ...) that holds it."""
    at = points.withColumn("__at", F.floor(F.col("line") / STRETCH))
    joined = at.join(_dealt(intervals), ["path", "__at"])
    return joined.where(F.col("line").between(F.col("start_line"), F.col("end_line"))).drop("__at")


def narrowest(points: DataFrame, intervals: DataFrame, key: list[str]) -> DataFrame:
    """Each point with its narrowest intervals; several of one width are all kept, with ``ambiguous``."""
    held = containing(points, intervals).withColumn("width", F.col("end_line") - F.col("start_line"))
    least = held.groupBy(*key).agg(F.min(F.struct("width")).alias("__least"))
    tied = held.join(least, key).where(F.col("width") == F.col("__least.width")).drop("__least")
    return tied.withColumn("ambiguous", F.count("*").over(Window.partitionBy(*key)) > 1)


def narrowest_overlap(symbols: DataFrame, declarations: DataFrame) -> DataFrame:
    """Each symbol (path, name, start_line, end_line, symbol_id) with the narrowest declaration of its name that it overlaps; the first by id among equals."""
    d = declarations.select("path", "name", F.col("start_line").alias("d_start"), F.col("end_line").alias("d_end"), F.col("id").alias("declaration_id"))
    joined = symbols.join(d, ["path", "name"]).where((F.col("start_line") <= F.col("d_end")) & (F.col("d_start") <= F.col("end_line")))
    return joined.groupBy("symbol_id").agg(F.min_by("declaration_id", F.struct(F.col("d_end") - F.col("d_start"), "declaration_id")).alias("declaration_id"))


def starting_at(points: DataFrame, constructs: DataFrame) -> DataFrame:
    """Each point with the widest multi-line construct that starts on its line."""
    joined = points.join(constructs, (points["path"] == constructs["path"]) & (points["line"] == constructs["start_line"])).where(F.col("end_line") > F.col("start_line"))
    return joined.groupBy(points["path"], points["line"]).agg(F.max("end_line").alias("end_line"))


def enclosing_scopes(points: DataFrame, intervals: DataFrame, key: list[str]) -> DataFrame:
    """``nearest`` (the narrowest interval's name) and ``scope`` (the outermost one's) of each point."""
    held = containing(points, intervals).withColumn("w", F.col("end_line") - F.col("start_line"))
    return held.groupBy(*key).agg(F.min_by("name", F.struct("w", "name")).alias("nearest"), F.max_by("name", F.struct("w", "name")).alias("scope"))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of overlapping ranges in one path: a(path, start_line, end_line, ...), b(path, b_start, b_end, ...), each once."""
    left = _dealt(a)
    right = b.withColumn("__at", F.explode(F.sequence(F.floor(F.col("b_start") / STRETCH), F.floor(F.col("b_end") / STRETCH))))
    joined = left.join(right, ["path", "__at"]).where((F.col("start_line") <= F.col("b_end")) & (F.col("b_start") <= F.col("end_line")))
    # The pair meets first in the stretch of the later start.
    return joined.where(F.col("__at") == F.floor(F.greatest("start_line", "b_start") / STRETCH)).drop("__at")
