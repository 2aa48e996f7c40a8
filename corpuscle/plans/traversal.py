"""Bounded breadth-first traversal as one join a level, each level written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in ``spark.checkpoint.dir`` (a temporary folder only where it is unset)."""
    spark: SparkSession = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="corpuscle-plan-"))
    path = f"{folder.rstrip('/')}/level-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, roots: DataFrame, depth: int, skip_roots_first: bool) -> DataFrame:
    """Edges (edge_id, src, dst) that a traversal from the roots (node) takes, with ``level``.

    Each level follows the edges out of the nodes that the level before came to first.  With
    ``skip_roots_first`` the first level leaves out edges that lead to a root.
    """
    if depth > 1:  # each level reads the edges, however they were made
        edges = written(edges.select("edge_id", "src", "dst"))
    frontier = roots.select("node").distinct()
    visited = frontier
    taken: DataFrame | None = None
    for level in range(1, depth + 1):
        step = edges.join(frontier, edges["src"] == F.col("node"), "left_semi")
        if level == 1 and skip_roots_first:
            step = step.join(visited, step["dst"] == F.col("node"), "left_anti")
        step = written(step.select("edge_id", "src", "dst").withColumn("level", F.lit(level)))
        taken = step if taken is None else taken.unionAll(step)
        if level < depth:
            frontier = written(step.select(F.col("dst").alias("node")).distinct().join(visited, "node", "left_anti"))
            if not frontier.limit(1).count():
                break
            visited = visited.unionAll(frontier)
    return taken.groupBy("edge_id", "src", "dst").agg(F.min("level").alias("level"))
