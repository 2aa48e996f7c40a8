"""What the operators share: the shared folder, written tables, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: a batch of long texts stays within a worker's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: Rows that a Parquet reader decodes at once; their texts lie in one array of the JVM, which doubles as it grows.
READ_ROWS = 512

_own_folder: dict[str, str] = {}
_held: dict[tuple, object] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory until it is asked


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and all runs in one process, as in tests, a temporary
    folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        named = _own_folder.setdefault(app, "file://" + tempfile.mkdtemp(prefix="corpuscle-"))
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches and those of Parquet readers small; a smaller setting of the session stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind once its result is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: the lineage and its shuffle files end here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote for ``df``, which nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held[T](key: tuple, make: Callable[[], T]) -> T:
    """What an operator's tasks share in a worker; it takes the place of another operator's, so a worker holds one at a time."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Let go of what earlier tasks of other operators hold in this worker."""
    for kept in _held.values():
        if isinstance(kept, dict):
            kept.clear()  # others may hold the same table
    _held.clear()
    trim()


def trim() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, null texts as empty; other columns can't clash with later ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    return next(name for name in (f"{wanted}_{i}" if i else wanted for i in range(len(taken) + 1)) if name.lower() not in taken)


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


def local_forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a partition of edges (a, b): each node with the least node it reaches, in batches of bounded size."""

    def stars(parent: dict[int, int]) -> pa.RecordBatch:
        pairs = [(x, find(parent, x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.record_batch({"a": pa.array([r for _, r in pairs], pa.int64()), "b": pa.array([x for x, _ in pairs], pa.int64())})

    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            union(parent, a, b)
        if len(parent) > 1_000_000:
            yield stars(parent)
            parent = {}
    yield stars(parent)


def find(parent: dict[int, int], x: int) -> int:
    root = x
    while (up := parent.setdefault(root, root)) != root:
        root = up
    while parent[x] != root:
        parent[x], x = root, parent[x]
    return root


def union(parent: dict[int, int], a: int, b: int) -> None:
    a, b = find(parent, a), find(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the undirected edges (a, b), the least node it reaches.

    Partition-local forests first, then rounds that send every node's least neighbour to its
    other neighbours.  Each round halves the depth of chains and is written to the shared
    folder; the rounds end when every edge points at a root.  Nothing is collected but counts.
    """
    edges = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(local_forest, "a long, b long").distinct(), "edges")
    while True:
        # Large star: larger neighbours of a node go to the least of its neighbourhood.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # Small star: smaller neighbours of a node, and the node itself, go to the least of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("x"), F.col("a").alias("y")), F.struct(F.col("m").alias("x"), F.col("b").alias("y")))).alias("e")).where("e.x <> e.y")
        before, edges = edges, written(small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).distinct(), "edges")
        discard(before)
        # Done when every node hangs on one root and no root hangs on another node.
        ends = edges.select(F.col("a").alias("n"), F.lit(0).alias("hangs")).unionAll(edges.select(F.col("b").alias("n"), F.lit(1).alias("hangs")))
        open_ = ends.groupBy("n").agg(F.sum("hangs").alias("on"), F.min("hangs").alias("leaf")).where("on > 1 or (on > 0 and leaf = 0)")
        if not open_.limit(1).count():
            break
    out = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    out.scratch_path = edges.scratch_path
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a fixed bijection)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
