"""Graphs on the star schema: declarations are parts, a call leads from a part to the next one of its order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.operators import graph
from corpuscle.queries import query, table

DECLS = """decls AS (SELECT p_partkey::VARCHAR AS id, p_name AS name, p_brand AS language, p_brand || '/' || p_type AS path, p_brand AS package, CASE WHEN p_size > 25 THEN 'public' ELSE 'private' END AS visibility FROM part)"""
CALLS = """steps AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate, lead(l_partkey) OVER w AS next FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
calls AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_partkey::VARCHAR AS caller_id, CASE WHEN l_returnflag = 'R' THEN NULL ELSE next::VARCHAR END AS target_id,
CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN [next::VARCHAR] ELSE [] END AS candidate_target_ids,
CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'unique-terminal' ELSE 'candidate' END AS confidence, CASE WHEN l_returnflag = 'R' AND l_linenumber > 3 THEN 'ext' ELSE '' END AS import_path,
p_brand AS language, p_brand || '/' || p_type AS path, l_linenumber AS line, l_shipdate FROM steps JOIN part ON p_partkey = l_partkey WHERE next IS NOT NULL)"""
EDGES = """edges AS (SELECT DISTINCT id AS edge_id, caller_id AS src, dst FROM (SELECT id, caller_id, unnest(CASE WHEN target_id IS NOT NULL THEN [target_id] ELSE candidate_target_ids END) AS dst FROM calls))"""
ROOTS = "roots AS (SELECT p_partkey::VARCHAR AS node FROM part WHERE p_brand = 'Brand#11' AND p_size <= 3)"


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("language"), F.concat_ws("/", "p_brand", "p_type").alias("path"),
        F.col("p_brand").alias("package"), F.when(F.col("p_size") > 25, "public").otherwise("private").alias("visibility"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = table(spark, sf_dir, "lineitem").withColumn("next", F.lead("l_partkey").over(by_order).cast("string")).where("next is not null")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    joined = steps.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    returned = F.col("l_returnflag") == "R"
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_partkey").cast("string").alias("caller_id"), F.when(~returned, F.col("next")).alias("target_id"),
        F.when(returned & (F.col("l_linestatus") == "F"), F.array("next")).otherwise(F.array().cast("array<string>")).alias("candidate_target_ids"),
        F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "N", "unique-terminal").otherwise("candidate").alias("confidence"),
        F.when(returned & (F.col("l_linenumber") > 3), "ext").otherwise("").alias("import_path"), F.col("p_brand").alias("language"), F.concat_ws("/", "p_brand", "p_type").alias("path"), F.col("l_linenumber").alias("line"), "l_shipdate",
    )


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_brand = 'Brand#11' and p_size <= 3")
    return p.select(F.col("p_partkey").cast("string").alias("node"))


def _traversal_sql(direction: str, depth: int) -> str:
    """Levels one after the other: new nodes of a level are the next one's frontier."""
    down = direction in ("callees", "dependencies")
    src, dst = ("src", "dst") if down else ("dst", "src")
    skip = f" AND {dst} NOT IN (SELECT node FROM roots)" if direction in ("dependencies", "dependents", "impact") else ""
    parts = [f"WITH {DECLS}, {CALLS}, {EDGES}, {ROOTS}, f1 AS (SELECT node FROM roots)"]
    for level in range(1, depth + 1):
        parts.append(f"t{level} AS (SELECT edge_id, src, dst, {level} AS level FROM edges WHERE {src} IN (SELECT node FROM f{level}){skip if level == 1 else ''})")
        seen = " UNION ".join(f"SELECT node FROM f{i}" for i in range(1, level + 1))
        parts.append(f"f{level + 1} AS (SELECT DISTINCT {dst} AS node FROM t{level} WHERE {dst} NOT IN ({seen}))")
    every = " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(1, depth + 1))
    return ", ".join(parts) + f" SELECT edge_id, src, dst, min(level)::INT AS level FROM ({every}) GROUP BY edge_id, src, dst"


@query(_traversal_sql("callers", 2))
def graph_callers_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2, N9."""
    return graph.traverse(calls(spark, sf_dir), roots(spark, sf_dir), "callers", 2)


@query(_traversal_sql("callees", 2))
def graph_callees_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2."""
    return graph.traverse(calls(spark, sf_dir), roots(spark, sf_dir), "callees", 2)


@query(_traversal_sql("dependencies", 2))
def graph_dependencies_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2 with the first level's rule for roots."""
    return graph.traverse(calls(spark, sf_dir), roots(spark, sf_dir), "dependencies", 2)


@query(_traversal_sql("impact", 3))
def graph_impact_d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2, upwards over three levels."""
    return graph.traverse(calls(spark, sf_dir), roots(spark, sf_dir), "impact", 3)


@query(_traversal_sql("callees", 1).replace("SELECT edge_id, src, dst, min(level)::INT AS level FROM (SELECT * FROM t1) GROUP BY edge_id, src, dst", "SELECT id, path FROM decls WHERE id IN (SELECT src FROM t1 UNION SELECT dst FROM t1 UNION SELECT node FROM roots)"))
def graph_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declarations that a traversal includes."""
    start = roots(spark, sf_dir)
    all_calls = calls(spark, sf_dir)
    taken = graph.traverse(all_calls, start, "callees", 1)
    kept = graph.project({"declarations": declarations(spark, sf_dir), "calls": all_calls}, graph.included_nodes(taken, start), taken)
    return kept["declarations"].select("id", "path")


@query(f"""WITH {DECLS}, {CALLS}, kept AS (SELECT * FROM decls WHERE visibility = 'public')
SELECT id, caller_id, target_id, array_to_string(list_filter(candidate_target_ids, c -> c IN (SELECT id FROM kept)), ',') AS candidates FROM calls
WHERE confidence IN ('exact', 'candidate') AND caller_id IN (SELECT id FROM kept) AND (target_id IS NULL OR target_id IN (SELECT id FROM kept))""".replace("array_to_string(list_filter(candidate_target_ids, c -> c IN (SELECT id FROM kept)), ',')", "CASE WHEN len(candidate_target_ids) > 0 AND candidate_target_ids[1] IN (SELECT id FROM kept) THEN candidate_target_ids[1] ELSE '' END"))
def graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By visibility and confidence."""
    _, kept = graph.filter_graph(declarations(spark, sf_dir), calls(spark, sf_dir), confidences=("exact", "candidate"), visibilities=("public",))
    return kept.select("id", "caller_id", "target_id", F.array_join("candidate_target_ids", ",").alias("candidates"))


HALF = "1995-06-17"
_KEYED = f"""WITH {DECLS}, {CALLS}, b AS (SELECT *, row_number() OVER (PARTITION BY caller_id, language ORDER BY line, id) AS n FROM calls WHERE l_shipdate < TIMESTAMP '{HALF}'),
a AS (SELECT *, row_number() OVER (PARTITION BY caller_id, language ORDER BY line, id) AS n FROM calls WHERE l_shipdate >= TIMESTAMP '{HALF}')"""


@query(f"""{_KEYED}, j AS (SELECT coalesce(b.caller_id, a.caller_id) AS caller_id, coalesce(b.language, a.language) AS language, coalesce(b.n, a.n)::INT AS n, b.path AS before_path, a.path AS after_path,
CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN b.path <> a.path THEN 'moved' WHEN b.confidence <> a.confidence OR b.target_id IS DISTINCT FROM a.target_id THEN 'changed' END AS change
FROM b FULL JOIN a ON b.caller_id = a.caller_id AND b.language = a.language AND b.n = a.n) SELECT * FROM j WHERE change IS NOT NULL""")
def graph_diff_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls before and after a date, paired by caller."""
    all_ = calls(spark, sf_dir)
    half = F.lit(HALF).cast("timestamp")
    return graph.diff(all_.where(F.col("l_shipdate") < half), all_.where(F.col("l_shipdate") >= half), ["caller_id", "language"], ["line", "id"], ["confidence", "target_id"])


@query(f"""WITH {CALLS}, m AS (SELECT language, target_id IS NOT NULL AS t, len(candidate_target_ids) AS n, import_path <> '' AS i FROM calls),
g AS (SELECT language, count(*) AS calls, count(*) FILTER (t) AS resolved, count(*) FILTER (NOT t AND n > 1) AS ambiguous, count(*) FILTER (NOT t AND n = 1) AS candidate, count(*) FILTER (NOT t AND n = 0) AS unresolved,
count(*) FILTER (t) AS resolved_local, count(*) FILTER (NOT t AND n > 1) AS ambiguous_local, count(*) FILTER (NOT t AND n = 0 AND i) AS expected_external, count(*) FILTER (NOT t AND (n = 1 OR n = 0 AND NOT i)) AS unresolved_local
FROM m GROUP BY GROUPING SETS ((), (language)))
SELECT *, round(ambiguous / calls, 6) AS ambiguity_rate, round(resolved_local / calls, 6) AS resolution_rate, round(ambiguous_local / calls, 6) AS ambiguous_local_rate, round(unresolved_local / calls, 6) AS unresolved_local_rate,
round(expected_external / calls, 6) AS expected_external_rate FROM g""")
def resolution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, N8."""
    return graph.resolution_stats(calls(spark, sf_dir))


@query(f"WITH {CALLS} SELECT language, confidence, count(*) AS calls FROM calls GROUP BY language, confidence")
def confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by confidence."""
    return graph.confidence_counts(calls(spark, sf_dir))


@query(f"""WITH {CALLS}, {ROOTS}, near AS (SELECT node, target_id AS other, min(abs(line - 3)) AS distance, min(line) AS line FROM roots JOIN calls ON caller_id = node WHERE target_id IS NOT NULL GROUP BY node, target_id),
r AS (SELECT node, other, distance, row_number() OVER (PARTITION BY node ORDER BY distance, line, other) AS n, greatest(count(*) OVER (PARTITION BY node) - 5, 0) AS omitted FROM near)
SELECT node, other, distance, n::INT AS n, omitted FROM r WHERE n <= 5""")
def related_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest callees of declarations hit on line 3."""
    hits = roots(spark, sf_dir).withColumn("hit_line", F.lit(3))
    return graph.related_calls(hits, calls(spark, sf_dir), declarations(spark, sf_dir))[0]


@query(f"""WITH {CALLS}, {ROOTS}, c AS (SELECT node, caller_id AS other, min({{'path': path, 'line': line}}) AS p FROM roots JOIN calls ON target_id = node WHERE confidence IN ('exact', 'import-resolved', 'context-resolved', 'unique-terminal', 'unique') GROUP BY node, caller_id),
r AS (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY p.path, p.line, other) AS n, greatest(count(*) OVER (PARTITION BY node) - 5, 0) AS omitted FROM c)
SELECT node, other, n::INT AS n, omitted FROM r WHERE n <= 5""")
def related_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers in order, tests last."""
    hits = roots(spark, sf_dir).withColumn("hit_line", F.lit(3))
    return graph.related_calls(hits, calls(spark, sf_dir), declarations(spark, sf_dir))[1]


@query(f"""WITH {DECLS} SELECT path AS import_path, language, line, array_to_string(list_sort(targets), ',') AS targets FROM (
SELECT p AS path, 'x' AS language, 1 AS line FROM (SELECT DISTINCT p_brand AS p FROM part)) i JOIN (SELECT package, list(DISTINCT path) AS targets FROM decls GROUP BY package) d ON d.package = i.path""")
def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that an import of a package leads to."""
    imports = table(spark, sf_dir, "part").select(F.col("p_brand").alias("import_path"), F.lit("x").alias("language"), F.lit(1).alias("line")).distinct()
    return graph.resolve_imports(imports, declarations(spark, sf_dir)).withColumn("targets", F.array_join("target_paths", ",")).drop("target_paths")
