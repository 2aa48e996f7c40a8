"""Journals on the table ``events``: a run is a user, a resource the property k, categories by event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import journal
from corpuscle.queries import query, table

J = """j AS (SELECT user_id AS run_id, event_id AS ord, ts AS time, event_type AS event, json_extract_string(props, '$.k') AS resource, value,
CASE event_type WHEN 'click' THEN 'navigation' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'mutation' WHEN 'error' THEN 'failure' ELSE 'other' END AS category FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    category = F.when(kind == "click", "navigation").when(kind == "view", "read").when(kind == "purchase", "mutation").when(kind == "error", "failure").otherwise("other")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), F.col("ts").cast("timestamp").alias("time"), kind.alias("event"), F.get_json_object("props", "$.k").alias("resource"), "value", category.alias("category"))


SUMMARY = f"""{J}, s AS (SELECT run_id, count(*) AS events, count(*) FILTER (WHERE category = 'navigation') AS navigations, count(*) FILTER (WHERE category = 'read') AS reads, count(*) FILTER (WHERE category = 'mutation') AS mutations,
count(*) FILTER (WHERE category = 'failure') AS failures, count(DISTINCT resource) FILTER (WHERE category = 'read') AS inspected, count(DISTINCT resource) FILTER (WHERE category = 'mutation') AS edited,
greatest(epoch_us(max(time)) // 1000 - epoch_us(min(time)) // 1000, 0) AS elapsed_ms FROM j GROUP BY run_id)"""


@query(f"WITH {SUMMARY} SELECT * FROM s")
def journal_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14, G16."""
    return journal.run_summary(events(spark, sf_dir))


@query(f"WITH {J} SELECT run_id, CASE WHEN count(value) = count(*) THEN round(sum(value), 4) END AS value FROM j GROUP BY run_id")
def journal_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that need every figure."""
    return journal.usage_sums(events(spark, sf_dir), ["value"]).withColumn("value", F.round("value", 4))


@query(f"WITH {J}, n AS (SELECT run_id, category, resource, count(*) AS n FROM j GROUP BY ALL) SELECT run_id, sum(n - 1)::BIGINT AS repeated FROM n GROUP BY run_id")
def journal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    return journal.repeated_calls(events(spark, sf_dir))


@query(f"""WITH {J}, e AS (SELECT *, sum((category = 'mutation')::INT) OVER (PARTITION BY run_id, resource ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM j),
r AS (SELECT run_id, resource, epoch, ord, row_number() OVER (PARTITION BY run_id, resource, epoch ORDER BY ord)::INT AS nth FROM e WHERE category = 'read') SELECT * FROM r WHERE nth > 1""")
def journal_redundant_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that came before since the last mutation."""
    return journal.redundant_reads(events(spark, sf_dir))


@query(f"""WITH {J}, l AS (SELECT *, last_value(CASE WHEN category IN ('failure', 'mutation') THEN category END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM j)
SELECT run_id, count(*) FILTER (WHERE category = 'mutation' AND last = 'failure') AS cycles FROM l GROUP BY run_id""")
def journal_fix_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7."""
    return journal.fix_cycles(events(spark, sf_dir))


@query(f"""WITH {J}, p AS (SELECT run_id, resource, ord, floor(value / 50)::BIGINT AS after_print, coalesce(lag(floor(value / 50)::BIGINT) OVER (PARTITION BY run_id, resource ORDER BY ord), -1) AS before_print FROM j WHERE category = 'mutation'),
s AS (SELECT run_id, resource, ord, 0 AS side, before_print AS print FROM p UNION ALL SELECT run_id, resource, ord, 1, after_print FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, resource, print ORDER BY ord, side) AS nth FROM s) SELECT run_id, resource, ord, print FROM r WHERE side = 1 AND nth > 1""")
def journal_reverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits back to an earlier content."""
    from pyspark.sql.window import Window

    m = events(spark, sf_dir).where("category = 'mutation'").withColumn("after_print", F.floor(F.col("value") / 50))
    before = F.coalesce(F.lag("after_print").over(Window.partitionBy("run_id", "resource").orderBy("ord")), F.lit(-1))
    return journal.revert_proxies(m.withColumn("before_print", before))


@query(f"""WITH {J}, u AS (SELECT *, coalesce(count(*) OVER (PARTITION BY run_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM j)
SELECT run_id, category AS milestone, min(ord) AS ord, arg_min(before, ord) AS before FROM u GROUP BY run_id, category""")
def journal_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each category, and how much came before it."""
    return journal.milestones(events(spark, sf_dir).withColumn("one", F.lit(1.0)), "one")


@query(f"""WITH {J}, a AS (SELECT l.run_id, r.category FROM j l JOIN j r ON l.run_id = r.run_id AND l.resource = r.resource AND r.ord > l.ord WHERE l.category = 'navigation' AND r.category IN ('read', 'mutation'))
SELECT runs.run_id, count(*) FILTER (WHERE category = 'read') AS reads, count(*) FILTER (WHERE category = 'mutation') AS edits FROM (SELECT DISTINCT run_id FROM j WHERE resource IS NOT NULL) runs LEFT JOIN a ON a.run_id = runs.run_id GROUP BY runs.run_id""")
def journal_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later reads and edits of what was navigated to."""
    return journal.conversions(events(spark, sf_dir))


@query(f"""WITH {J}, b AS (SELECT *, min(ord) FILTER (WHERE event = 'signup') OVER (PARTITION BY run_id) AS s FROM j)
SELECT run_id, ord, 'before run_start' AS problem FROM b WHERE s IS NULL OR ord < s""")
def journal_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events before their run's start (the first signup)."""
    e = events(spark, sf_dir).withColumn("event", F.when(F.col("event") == "signup", "run_start").otherwise(F.col("event")))
    return journal.lifecycle_errors(e).drop("event")


@query(f"""WITH {J}, g AS (SELECT *, CASE WHEN epoch_us(time) - epoch_us(lag(time) OVER (PARTITION BY run_id ORDER BY time, ord)) <= 21600000000 THEN 0 ELSE 1 END AS f FROM j),
n AS (SELECT *, sum(f) OVER (PARTITION BY run_id ORDER BY time, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT run_id, session, count(*) AS events, epoch_us(min(time)) AS start_us, epoch_us(max(time)) AS end_us FROM n GROUP BY run_id, session""")
def journal_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs cut after six quiet hours (a window demonstration beyond the inventory)."""
    found = journal.sessions(events(spark, sf_dir), 6 * 3600)
    return found.select("run_id", "session", "events", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


@query(f"""WITH {J} SELECT event, count(value) AS samples, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM j GROUP BY event""")
def report_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles."""
    return journal.distribution(events(spark, sf_dir), ["event"], "value")


@query(f"""WITH {SUMMARY}, r AS (SELECT (run_id % 7)::VARCHAR AS agent, mutations > failures AS success, CASE WHEN run_id % 7 <> 3 OR reads > 0 THEN events END AS tokens, elapsed_ms FROM s)
SELECT agent, count(*) AS samples, round(sum(success::INT) / count(*), 6) AS success_rate, CASE WHEN count(tokens) = count(*) AND sum(success::INT) > 0 THEN round(sum(tokens) / sum(success::INT), 6) END AS tokens_per_success,
CASE WHEN sum(success::INT) > 0 THEN round(sum(elapsed_ms) / sum(success::INT), 6) END AS ms_per_success FROM r GROUP BY agent""")
def report_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agents' samples, success rates and costs."""
    s = journal.run_summary(events(spark, sf_dir))
    runs = s.select((F.col("run_id") % 7).cast("string").alias("agent"), (F.col("mutations") > F.col("failures")).alias("success"), F.when((F.col("run_id") % 7 != 3) | (F.col("reads") > 0), F.col("events")).alias("tokens"), "elapsed_ms")
    return journal.group_summary(runs, "agent")


@query(f"""WITH {J}, b AS (SELECT event, count(*)::DOUBLE AS n, round(avg(value), 4) AS v FROM j WHERE time < TIMESTAMP '2024-01-15' GROUP BY event), a AS (SELECT event, count(*)::DOUBLE AS n, round(avg(value), 4) AS v FROM j WHERE time >= TIMESTAMP '2024-01-15' GROUP BY event),
l AS (SELECT event, 'n' AS measure, n AS x FROM b UNION ALL SELECT event, 'v', v FROM b), m AS (SELECT event, 'n' AS measure, n AS y FROM a UNION ALL SELECT event, 'v', v FROM a)
SELECT event, measure, x AS before, y AS after, round(y - x, 6) AS delta, CASE WHEN x <> 0 THEN round((y - x) / x * 100, 6) END AS percent FROM l FULL JOIN m USING (event, measure)""")
def report_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G17 compared: two reports' deltas and percents."""
    e = events(spark, sf_dir)
    cut = F.lit("2024-01-15").cast("timestamp")
    report = lambda rows: rows.groupBy("event").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("v"))
    return journal.compare(report(e.where(F.col("time") < cut)), report(e.where(F.col("time") >= cut)), "event", ["n", "v"])


@query("""WITH c AS (SELECT conv_id AS run_id, turn AS call_id, length(text) AS asked FROM conversations WHERE role = 'user'), r AS (SELECT conv_id AS run_id, turn - 1 AS call_id, length(text) AS answered FROM conversations WHERE role = 'assistant')
SELECT run_id, call_id, asked, answered FROM c JOIN r USING (run_id, call_id)""")
def call_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls (user turns) with their results (the assistant turns after them)."""
    t = table(spark, sf_dir, "conversations")
    c = t.where("role = 'user'").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("call_id"), F.length("text").cast("long").alias("asked"))
    r = t.where("role = 'assistant'").select(F.col("conv_id").alias("run_id"), (F.col("turn") - 1).alias("call_id"), F.length("text").cast("long").alias("answered"))
    return journal.call_results(c, r.join(c.select("run_id", "call_id"), ["run_id", "call_id"], "left_semi"))
