"""Event journals of runs: folds, windows over a run's order, reports and comparisons.

events(run_id, ord, time, event, category, resource, ...): ``ord`` is a run's total order.
All windows are by run, so runs are spread over tasks; a report has a row a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions.scalars import elapsed_ms, percent_change


def lifecycle_errors(events: DataFrame) -> DataFrame:
    """Events before their run's start or after its end."""
    by_run = Window.partitionBy("run_id")
    start = F.min(F.when(F.col("event") == "run_start", F.col("ord"))).over(by_run)
    end = F.min(F.when(F.col("event") == "run_end", F.col("ord"))).over(by_run)
    marked = events.withColumn("problem", F.when(start.isNull() | (F.col("ord") < start), "before run_start").when(F.col("ord") > end, "after run_end"))
    return marked.where("problem is not null").select("run_id", "ord", "event", "problem")


def run_summary(events: DataFrame) -> DataFrame:
    """A row a run: counts by category, distinct resources inspected and edited, elapsed time."""
    count = lambda name: F.sum((F.col("category") == name).cast("long"))
    distinct = lambda name: F.countDistinct(F.when(F.col("category") == name, F.col("resource")))
    return events.groupBy("run_id").agg(
        F.count("*").alias("events"), count("navigation").alias("navigations"), count("read").alias("reads"), count("mutation").alias("mutations"), count("failure").alias("failures"),
        distinct("read").alias("inspected"), distinct("mutation").alias("edited"), elapsed_ms(F.min("time"), F.max("time")).alias("elapsed_ms"),
    )


def usage_sums(events: DataFrame, columns: list[str]) -> DataFrame:
    """Sums a run; null unless every event has the figure."""
    return events.groupBy("run_id").agg(*[F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c) for c in columns])


def repeated_calls(events: DataFrame) -> DataFrame:
    """run_id, repeated: calls of one category and resource beyond the first."""
    shapes = events.groupBy("run_id", "category", "resource").agg(F.count("*").alias("n"))
    return shapes.groupBy("run_id").agg(F.sum(F.col("n") - 1).alias("repeated"))


def redundant_reads(events: DataFrame) -> DataFrame:
    """Reads of a resource that came before since its last mutation."""
    by_resource = Window.partitionBy("run_id", "resource").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epoch = events.withColumn("epoch", F.sum((F.col("category") == "mutation").cast("int")).over(by_resource)).where(F.col("category") == "read")
    return epoch.withColumn("nth", F.row_number().over(Window.partitionBy("run_id", "resource", "epoch").orderBy("ord"))).where("nth > 1").select("run_id", "resource", "epoch", "ord", "nth")


def fix_cycles(events: DataFrame) -> DataFrame:
    """run_id, cycles: failures that a mutation follows, each once."""
    by_run = Window.partitionBy("run_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("category").isin("failure", "mutation"), F.col("category")), ignorenulls=True).over(by_run)
    return events.withColumn("last", last).groupBy("run_id").agg(F.sum(((F.col("category") == "mutation") & (F.col("last") == "failure")).cast("long")).alias("cycles"))


def revert_proxies(edits: DataFrame) -> DataFrame:
    """Edits (run_id, resource, ord, before_print, after_print) to a content that the resource had before."""
    seen = edits.select("run_id", "resource", F.explode(F.array(F.struct(F.col("ord"), F.lit(0).alias("side"), F.col("before_print").alias("print")), F.struct(F.col("ord"), F.lit(1).alias("side"), F.col("after_print").alias("print")))).alias("x"))
    flat = seen.select("run_id", "resource", "x.ord", "x.side", "x.print")
    ranked = flat.withColumn("nth", F.row_number().over(Window.partitionBy("run_id", "resource", "print").orderBy("ord", "side")))
    return ranked.where("side = 1 and nth > 1").select("run_id", "resource", "ord", "print")


def milestones(events: DataFrame, measure: str) -> DataFrame:
    """run_id, milestone, ord, before: the first event of each category, and what had been used before it."""
    by_run = Window.partitionBy("run_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    used = events.withColumn("before", F.coalesce(F.sum(measure).over(by_run), F.lit(0.0)))
    return used.groupBy("run_id", F.col("category").alias("milestone")).agg(F.min(F.struct("ord", "before")).alias("x")).select("run_id", "milestone", "x.ord", "x.before")


def conversions(events: DataFrame) -> DataFrame:
    """run_id, reads, edits: pairs of a navigation with each later read, and mutation, of its resource.

    Counted from running sums, so no pairs are formed.
    """
    by_resource = Window.partitionBy("run_id", "resource").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum((F.col("category") == "navigation").cast("long")).over(by_resource), F.lit(0))
    counted = events.where("resource is not null").withColumn("earlier", earlier)
    of = lambda name: F.coalesce(F.sum(F.when(F.col("category") == name, F.col("earlier"))), F.lit(0))
    return counted.groupBy("run_id").agg(of("read").alias("reads"), of("mutation").alias("edits"))


def call_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (run_id, call_id, ...) with their results; a result without a call, or a second one, is an error."""
    numbered = results.withColumn("__n", F.count("*").over(Window.partitionBy("run_id", "call_id")))
    once = numbered.withColumn("call_id", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("several results for "), "call_id"))).otherwise(F.col("call_id"))).drop("__n")
    if results.join(calls.select("run_id", "call_id"), ["run_id", "call_id"], "left_anti").limit(1).count():
        raise ValueError("a result has no call")
    return calls.join(once, ["run_id", "call_id"])


def distribution(rows: DataFrame, by: list, value: str) -> DataFrame:
    """samples, mean, median, p50, p90 with linear interpolation between ranks."""
    v = F.col(value)
    exact = lambda q: F.round(F.percentile(v, q), 6)
    return rows.groupBy(*by).agg(F.count(v).alias("samples"), F.round(F.avg(v), 6).alias("mean"), exact(0.5).alias("median"), exact(0.9).alias("p90"))


def group_summary(runs: DataFrame, by: str) -> DataFrame:
    """Per group: samples, success rate, and tokens and time for a success.

    Runs: success (boolean), tokens (nullable), elapsed_ms.  Tokens a success are known only if
    every run's tokens are; time a success doesn't need that.
    """
    successes = F.sum(F.col("success").cast("long"))
    per = lambda c: F.when(successes > 0, F.round(c / successes, 6))
    return runs.groupBy(by).agg(
        F.count("*").alias("samples"), F.round(successes / F.count("*"), 6).alias("success_rate"),
        F.when(F.count("tokens") == F.count("*"), per(F.sum("tokens"))).alias("tokens_per_success"), per(F.sum("elapsed_ms")).alias("ms_per_success"),
    )


def compare(before: DataFrame, after: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """key, measure, before, after, delta, percent of two reports."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode(F.create_map(*[x for m in measures for x in (F.lit(m), F.col(m).cast("double"))])).alias("measure", name))

    joined = long(before, "before").join(long(after, "after"), [key, "measure"], "full")
    return joined.select(key, "measure", "before", "after", F.round(F.col("after") - F.col("before"), 6).alias("delta"), F.round(percent_change(F.col("before"), F.col("after")), 6).alias("percent"))


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """A run's events cut where nothing happens for a while: run_id, session, events, start, end."""
    by_run = Window.partitionBy("run_id").orderBy("time", "ord")
    fresh: Column = F.coalesce(F.unix_micros("time") - F.unix_micros(F.lag("time").over(by_run)) > gap_seconds * 1_000_000, F.lit(True))
    numbered = events.withColumn("session", F.sum(fresh.cast("long")).over(by_run))
    return numbered.groupBy("run_id", "session").agg(F.count("*").alias("events"), F.min("time").alias("start"), F.max("time").alias("end"))
