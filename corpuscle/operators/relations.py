"""Relations between findings of two queries, and set operations on findings.

Facts are rows (row_id, ord, path, grp, part, key, ...): ``grp`` is the directory or
repository that scopes a relation ('' for none), ``part`` a partition ('' for none), ``ord``
the order of findings.  Empty keys of scope are equal to one another, so '' is used, not null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["grp", "part", "key"]


def _side(facts: DataFrame, prefix: str) -> DataFrame:
    return facts.select(*[F.col(c).alias(c if c in KEYS else f"{prefix}_{c}") for c in facts.columns])


def pairs(left: DataFrame, right: DataFrame, unique_left: bool = False) -> DataFrame:
    """For each right fact, the first left fact of its keys in another file.

    ``unique_left`` asks that the keys have one left fact in all, whichever file it is in.
    The first left fact in another file is either the first of the keys, or the first that is
    in another file than that one: so two candidates a key are enough, and nothing is paired
    with all of a hot key.
    """
    lefts = left
    if unique_left:
        single = left.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n = 1").drop("n")
        lefts = left.join(single, KEYS, "left_semi")
    columns = [c for c in lefts.columns if c not in KEYS]
    by_path = lefts.groupBy(*KEYS, "path").agg(F.min(F.struct("ord", *[c for c in columns if c != "ord"])).alias("l"))
    ranked = by_path.withColumn("n", F.row_number().over(Window.partitionBy(*KEYS).orderBy("l.ord", "path"))).where("n <= 2")
    firsts = ranked.groupBy(*KEYS).agg(F.max(F.when(F.col("n") == 1, F.col("l"))).alias("l1"), F.max(F.when(F.col("n") == 2, F.col("l"))).alias("l2"))
    joined = _side(right, "right").join(firsts, KEYS)
    chosen = joined.withColumn("l", F.when(F.col("l1.path") != F.col("right_path"), F.col("l1")).otherwise(F.col("l2"))).where("l is not null")
    return chosen.select(*KEYS, *[F.col(f"l.{c}").alias(f"left_{c}") for c in columns], *[F.col(f"right_{c}") for c in right.columns if c not in KEYS])


def unmatched_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left facts whose keys no right fact has, not even in the same file."""
    return left.join(right.select(*KEYS).distinct(), KEYS, "left_anti")


def unmatched_left_any(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left facts (with ``keys``, an array, and ``satisfied``) none of whose keys a right fact has; without keys they are reported."""
    open_ = left.where(~F.col("satisfied"))
    matched = open_.select("row_id", "grp", "part", F.explode("keys").alias("key")).join(right.select(*KEYS).distinct(), KEYS, "left_semi").select("row_id").distinct()
    return open_.join(matched, "row_id", "left_anti")


def assign_partitions(facts: DataFrame, partitions: DataFrame) -> DataFrame:
    """``facts`` with ``part`` by path; a path with two values, or without one, is an error."""
    one = partitions.groupBy("path").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    one = one.select("path", F.when(F.col("low") != F.col("high"), F.raise_error(F.concat(F.lit("conflicting partitions for "), "path"))).otherwise(F.col("low")).alias("part"))
    joined = facts.drop("part").join(one, "path", "left")
    return joined.withColumn("part", F.when(F.col("part").isNull(), F.raise_error(F.concat(F.lit("no partition for "), "path"))).otherwise(F.col("part")))


def complete_only(facts: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """``facts``, or an error if the scan that made them left diagnostics: relations over incomplete facts mean nothing."""
    if diagnostics.limit(1).count():
        raise ValueError("the inputs of the relation are incomplete")
    return facts


def distinct_findings(*parts: DataFrame) -> DataFrame:
    """Findings of several sources, equal ones once."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct()


def capped(findings: DataFrame, by: list[str], order: list, most: int) -> tuple[DataFrame, DataFrame]:
    """The first findings of each pattern, and for patterns with more, how many there were."""
    ranked = findings.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    truncated = findings.groupBy(*by).agg(F.count("*").alias("found")).where(F.col("found") > most)
    return ranked.where(F.col("__n") <= most).drop("__n"), truncated


def first_of_each(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def natural_join(a: DataFrame, b: DataFrame, shared: list[str]) -> DataFrame:
    """Bindings of two queries over one candidate that agree on the shared variables; the range covers both."""
    right = b.withColumnsRenamed({"start_byte": "__s", "end_byte": "__e"})
    joined = a.join(right, ["candidate", *shared])
    return joined.withColumn("start_byte", F.least("start_byte", "__s")).withColumn("end_byte", F.greatest("end_byte", "__e")).drop("__s", "__e")


def longest_prefix(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Each name (path with slashes) with its longest prefix by whole segments; several modules of one prefix all stay, ``exact`` if one.

    A name's own prefixes are looked up by equality, so nothing is compared with all prefixes.
    """
    parts = F.split("name", "/")
    own = names.select("name").distinct().select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("prefix"))
    joined = own.join(prefixes, "prefix").withColumn("length", F.length("prefix"))
    best = joined.groupBy("name").agg(F.max("length").alias("length"))
    kept = joined.join(best, ["name", "length"]).distinct()
    return kept.groupBy("name", "prefix").agg(F.sort_array(F.collect_set("module")).alias("modules")).withColumn("exact", F.size("modules") == 1)
