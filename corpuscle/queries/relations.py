"""Relations between documents as facts: scope source, partition lang, key a word of the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import relations, rules
from corpuscle.queries import query, table
from corpuscle.queries.search import FILES, LINES, PATTERN, lines
from corpuscle.operators import search

FACTS = """facts AS (SELECT d.doc_id AS row_id, d.doc_id AS ord, source || '/' || lang || '/' || d.doc_id || '.txt' AS path, source AS grp, lang AS part, lower(split_part(text, ' ', 1)) AS key,
l.quality, l.toxic, [lower(split_part(text, ' ', 1)), lower(split_part(text, ' ', 2))] AS keys FROM documents d LEFT JOIN labels l USING (doc_id)),
lefts AS (SELECT * FROM facts WHERE quality = 1), rights AS (SELECT * FROM facts WHERE quality IS NULL)"""
COLUMNS = ["row_id", "ord", "path", "grp", "part", "key"]


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    word = lambda n: F.lower(F.split_part("text", F.lit(" "), F.lit(n)))
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    all_ = docs.select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("ord"), path.alias("path"), F.col("source").alias("grp"), F.col("lang").alias("part"), word(1).alias("key"), "quality", "toxic", F.array(word(1), word(2)).alias("keys"))
    return all_.where("quality = 1"), all_.where("quality is null")


_PAIRS = """SELECT grp, part, key, left_row_id, right_row_id FROM (
SELECT r.grp, r.part, r.key, l.row_id AS left_row_id, r.row_id AS right_row_id, row_number() OVER (PARTITION BY r.row_id ORDER BY l.ord) AS n
FROM rights r JOIN {left} l ON l.grp = r.grp AND l.part = r.part AND l.key = r.key AND l.path <> r.path) WHERE n = 1"""


@query(f"WITH {FACTS} {_PAIRS.format(left='lefts')}")
def relation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each right fact the first left one of its keys."""
    left, right = facts(spark, sf_dir)
    return relations.pairs(left.select(*COLUMNS), right.select(*COLUMNS)).select("grp", "part", "key", "left_row_id", "right_row_id")


@query(f"WITH {FACTS}, single AS (SELECT * FROM lefts QUALIFY count(*) OVER (PARTITION BY grp, part, key) = 1) {_PAIRS.format(left='single')}")
def relation_unique_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 with one left fact for the keys."""
    left, right = facts(spark, sf_dir)
    return relations.pairs(left.select(*COLUMNS), right.select(*COLUMNS), unique_left=True).select("grp", "part", "key", "left_row_id", "right_row_id")


@query(f"WITH {FACTS} SELECT row_id, grp, part, key FROM lefts l WHERE NOT EXISTS (SELECT 1 FROM rights r WHERE l.grp = r.grp AND l.part = r.part AND l.key = r.key)")
def unmatched_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2."""
    left, right = facts(spark, sf_dir)
    return relations.unmatched_left(left, right).select("row_id", "grp", "part", "key")


@query(f"""WITH {FACTS}, each AS (SELECT row_id, grp, part, unnest(keys) AS key FROM lefts WHERE toxic = 0),
matched AS (SELECT DISTINCT e.row_id FROM each e JOIN rights r ON e.grp = r.grp AND e.part = r.part AND e.key = r.key)
SELECT row_id FROM lefts WHERE toxic = 0 AND row_id NOT IN (SELECT row_id FROM matched)""")
def unmatched_left_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None of several keys matches; toxic rows count as satisfied."""
    left, right = facts(spark, sf_dir)
    return relations.unmatched_left_any(left.withColumn("satisfied", F.col("toxic") == 1), right).select("row_id")


@query("""WITH p AS (SELECT source AS path, min(length(lang)) AS value FROM documents GROUP BY source)
SELECT doc_id AS row_id, source AS path, value AS part FROM documents JOIN p ON p.path = documents.source""")
def partition_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path has one partition."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("row_id"), F.col("source").alias("path"))
    parts = docs.select(F.col("source").alias("path"), F.length("lang").cast("long").alias("value")).distinct()
    return relations.assign_partitions(rows, parts)


@query(f"""WITH {LINES} SELECT path, line, text FROM lines WHERE regexp_matches(text, '{PATTERN}') UNION SELECT path, line, text FROM lines WHERE regexp_matches(text, '[0-9]{{3}}')""")
def finding_dedupe_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two queries, equal ones once."""
    all_ = lines(spark, sf_dir)
    parts = [search.matching_lines(all_, p).select("path", "line", "text") for p in (PATTERN, "[0-9]{3}")]
    return relations.distinct_findings(*parts)


@query(f"""WITH {LINES}, found AS (SELECT repo, path, line FROM lines WHERE regexp_matches(text, '{PATTERN}'))
SELECT repo, path, line FROM found QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line) <= 3""")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first findings of each group."""
    found = search.matching_lines(lines(spark, sf_dir), PATTERN).select("repo", "path", "line")
    return relations.capped(found, ["repo"], ["path", "line"], 3)[0]


@query(f"""WITH {LINES} SELECT repo, count(*) AS found FROM lines WHERE regexp_matches(text, '{PATTERN}') GROUP BY repo HAVING count(*) > 3""")
def truncated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with more findings than are kept."""
    found = search.matching_lines(lines(spark, sf_dir), PATTERN).select("repo", "path", "line")
    return relations.capped(found, ["repo"], ["path", "line"], 3)[1]


@query(f"""WITH {FILES}, modules AS (SELECT DISTINCT source AS prefix, 'm-' || source AS module FROM documents UNION SELECT DISTINCT source || '/' || lang, 'm-' || source || '-en' FROM documents WHERE lang = 'en'),
held AS (SELECT path AS name, prefix, module, rank() OVER (PARTITION BY path ORDER BY length(prefix) DESC) AS r FROM files JOIN modules ON path = prefix OR starts_with(path, prefix || '/'))
SELECT name, prefix, string_agg(module, ',' ORDER BY module) AS modules, count(*) = 1 AS exact FROM held WHERE r = 1 GROUP BY name, prefix""")
def longest_module_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path with the longest module prefix."""
    docs = table(spark, sf_dir, "documents")
    names = docs.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("name"))
    modules = docs.select(F.col("source").alias("prefix"), F.concat(F.lit("m-"), "source").alias("module")).unionAll(docs.where("lang = 'en'").select(F.concat_ws("/", "source", "lang"), F.concat(F.lit("m-"), "source", F.lit("-en")))).distinct()
    return relations.longest_prefix(names, modules).withColumn("modules", F.array_join("modules", ","))


@query(f"""WITH {FILES} SELECT path, upper(language) AS actual, split_part(path, '/', 2) AS expected, 'is ' || upper(language) || ', not ' || split_part(path, '/', 2) AS message FROM files
WHERE lower(split_part(path, '/', 1)) <> 'src0'""")
def assertion_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3, H8: a string assertion with its message."""
    docs = table(spark, sf_dir, "documents").where(F.lower("source") != "src0")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    findings = docs.select(path.alias("path"), F.create_map(F.lit("language"), F.col("lang")).alias("bindings"))
    found = rules.violations(findings, {"upper": {"binding": "language"}}, {"segment": {"value": {"path": None}, "separator": "/", "index": 1}}, "is {{actual}}, not {{expected}}")
    return found.select("path", "actual", "expected", "message")


@query(f"""WITH {LINES}, by_file AS (SELECT 'digits' AS rule, repo, path, count(*) AS n FROM lines WHERE regexp_matches(text, '[0-9]{{3}}') GROUP BY ALL)
SELECT rule, repo, count(*) AS files, sum(n)::BIGINT AS matches FROM by_file GROUP BY rule, repo""")
def rule_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: a saved rule's files and matches by repository."""
    found = search.matching_lines(lines(spark, sf_dir), "[0-9]{3}").select(F.lit("digits").alias("rule"), "repo", "path", "line")
    return rules.tallies(found)
