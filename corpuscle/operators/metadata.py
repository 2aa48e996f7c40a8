"""Metadata of files: status, selectors, labels of directories, overviews, memories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions.scalars import ancestors, dirname, label_key

CATEGORIES = ("domain_areas", "functional_areas", "keywords")


def with_status(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Files (path, content) with metadata and ``status``: current, stale, missing or invalid."""
    known = meta.withColumnRenamed("path", "__path")
    joined = files.join(known, F.col("path") == F.col("__path"), "left")
    status = F.when(F.col("__path").isNull(), "missing").when(F.col("checksum").isNull(), "invalid").when(F.col("checksum") == F.sha2("content", 256), "current").otherwise("stale")
    return joined.withColumn("status", status).drop("__path")


def directory_status(files: DataFrame, meta: DataFrame) -> DataFrame:
    """dir, status: invalid before all; stale if a file is stale, lacks an entry, or an entry lacks its file."""
    own = with_status(files, meta).select(dirname(F.col("path")).alias("dir"), "status")
    gone = meta.join(files.select("path"), "path", "left_anti").select(dirname(F.col("path")).alias("dir"), F.lit("stale").alias("status"))
    bad = F.max((F.col("status") == "invalid").cast("int")) == 1
    old = F.max(F.col("status").isin("stale", "missing").cast("int")) == 1
    return own.unionAll(gone).groupBy("dir").agg(F.when(bad, "invalid").when(old, "stale").otherwise("current").alias("status"))


def selected(files: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """Current files with any wanted label of each category that is asked for."""
    keep = F.col("status") == "current"
    for category, labels in wanted.items():
        keys = F.transform(F.coalesce(F.col(category), F.array().cast("array<string>")), label_key)
        keep = keep & F.arrays_overlap(keys, F.array(*[label_key(F.lit(x)) for x in labels]))
    return files.where(keep)


def directory_labels(files: DataFrame, category: str) -> DataFrame:
    """dir, labels: the labels of current files below each directory."""
    own = files.where(F.col("status") == "current").select(dirname(F.col("path")).alias("d"), F.explode(category).alias("label")).distinct()
    above = F.when(F.col("d") == ".", F.array(F.lit("."))).otherwise(ancestors(F.concat("d", F.lit("/x"))))
    return own.select(F.explode(above).alias("dir"), "label").groupBy("dir").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def label_overview(files: DataFrame, category: str, most: int = 8, shown: int = 2) -> DataFrame:
    """label_key, label, files, examples, omitted: the most frequent labels of current files.

    A label shows the spelling of its first path; examples are its first paths.  Only the first
    ``shown`` paths of a label are gathered.
    """
    each = files.where(F.col("status") == "current").select("path", F.explode(category).alias("label")).select("path", "label", label_key(F.col("label")).alias("label_key"))
    by_path = each.groupBy("label_key", "path").agg(F.min("label").alias("label"))
    counted = by_path.groupBy("label_key").agg(F.count("*").alias("files"), F.min_by("label", F.struct("path", "label")).alias("label"))
    firsts = by_path.withColumn("n", F.row_number().over(Window.partitionBy("label_key").orderBy("path"))).where(F.col("n") <= shown)
    examples = firsts.groupBy("label_key").agg(F.array_sort(F.collect_list("path")).alias("examples"))
    top = counted.orderBy(F.desc("files"), "label_key").limit(most)
    return top.join(examples, "label_key").select("label_key", "label", "files", "examples", (F.col("files") - F.size("examples")).alias("omitted"))


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("files"))


def scope_holds(path: Column, scope: Column) -> Column:
    """``dir/`` holds all below it; ``**/name`` a basename at any depth below; ``dir/name`` a basename right in the directory."""
    deep = scope.contains("**/")
    base = F.when(deep, F.substring_index(scope, "**/", 1)).when(scope.contains("/"), F.concat(F.regexp_replace(scope, "/[^/]*$", ""), F.lit("/"))).otherwise("")
    name = F.substring_index(scope, "/", -1)
    glob = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"([.+^$(){}|\[\]\\])", r"\\$1"), r"\*", "[^/]*"), r"\?", "[^/]")
    inside = (base == "") | path.startswith(base)
    return F.when(scope.endswith("/"), path.startswith(scope)).otherwise(
        inside & F.regexp_like(F.substring_index(path, "/", -1), F.concat(F.lit("^"), glob, F.lit("$"))) & (deep | (F.concat(F.regexp_replace(F.concat(F.lit("/"), path), "/[^/]*$", ""), F.lit("/")) == F.concat(F.lit("/"), base)))
    )


def memories_for(hits: DataFrame, memories: DataFrame, most: int = 3) -> DataFrame:
    """Hits (path, line) with memories (memory_id, path, first_line, last_line, checksum) whose file is current and whose lines hold them; at most ``most`` a path."""
    joined = hits.join(memories, "path").where(F.col("line").between(F.col("first_line"), F.col("last_line")) & (F.col("checksum") == F.col("file_checksum")))
    each = joined.groupBy("path", "memory_id").agg(F.min("line").alias("line"))
    return each.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line", "memory_id"))).where(F.col("n") <= most)
