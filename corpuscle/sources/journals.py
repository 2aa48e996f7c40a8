"""Journals in JSON lines, report files, and stored graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "schema string, eventId string, time timestamp, runId string, event string, data string"
FIELDS = {"schema", "eventId", "time", "runId", "event", "data"}
EVENTS = ("run_start", "assistant", "command", "tool_call", "tool_result", "compaction", "run_end")
LONGEST_LINE = 1 << 20


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON-lines files: strict fields, known events, lines of at most 1 MiB; ids must be unique.

    A line that breaks a rule is an error when it is read; ``repeated_events`` finds repeated ids.
    """
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.withColumn("e", F.from_json("value", ENVELOPE)).withColumn("keys", F.json_object_keys("value"))
    bad = (
        F.when(F.octet_length("value") > LONGEST_LINE, "a line is too long").when(F.col("keys").isNull(), "a line isn't an object")
        .when(F.size(F.array_except("keys", F.array(*map(F.lit, sorted(FIELDS))))) > 0, "a line has an unknown field")
        .when(~F.coalesce(F.col("e.event").isin(*EVENTS), F.lit(False)), "an unknown event").when(F.col("e.eventId").isNull() | F.col("e.runId").isNull() | F.col("e.time").isNull(), "an event lacks its id, run or time")
    )
    checked = parsed.withColumn("eventId", F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(": "), F.substring("value", 1, 100)))).otherwise(F.col("e.eventId")))
    return checked.select(F.col("e.schema").alias("schema"), F.col("eventId").alias("event_id"), F.col("e.time").alias("time"), F.col("e.runId").alias("run_id"), F.col("e.event").alias("event"), F.col("e.data").alias("data"))


def repeated_events(events: DataFrame) -> DataFrame:
    return events.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1")


def payload(events: DataFrame, event: str, schema: str) -> DataFrame:
    """Events of one kind with their data as columns."""
    return events.where(F.col("event") == event).withColumn("d", F.from_json("data", schema)).select("event_id", "run_id", "time", "d.*")


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def save_graph(graph: dict[str, DataFrame], folder: str, key: str) -> None:
    """A graph's tables under a content key, calls by caller so that traversals read few files."""
    for name, df in graph.items():
        dealt = df.repartitionByRange("caller_id") if "caller_id" in df.columns else df
        dealt.write.mode("overwrite").parquet(f"{folder}/{key}/{name}")


def open_graph(spark: SparkSession, folder: str, key: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{key}/{name}") for name in names}


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def spill(df: DataFrame, path: str) -> DataFrame:
    """Write rows as JSON lines and describe the files: path, bytes, sha256."""
    write_json(df, path)
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
