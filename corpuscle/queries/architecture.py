"""Directories, relations and boundaries on the star schema and on ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import architecture as arch
from corpuscle.queries import query, table
from corpuscle.queries.graph import CALLS, DECLS, calls, declarations
from corpuscle.queries.search import FILES, files
from corpuscle.sources.corpus import split_lines

USED = """used AS (SELECT p_brand AS owner, l_orderkey AS caller, o_custkey % 1000 || '/' || l_orderkey AS caller_path, p_type AS callable, l_linenumber, l_partkey, l_suppkey, p_brand AS language
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)"""


def used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner = brand, caller = order in the file of its customer's thousand, callable = type."""
    l, p, o = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    joined = l.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    path = F.concat_ws("/", (F.col("o_custkey") % 1000).cast("string"), F.col("l_orderkey").cast("string"))
    return joined.select(F.col("p_brand").alias("owner"), F.col("l_orderkey").alias("caller"), path.alias("caller_path"), F.col("p_type").alias("callable"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.col("p_brand").alias("language"))


@query(f"""WITH {FILES}, m AS (SELECT repo, len(string_split(content, chr(10))) AS lines, strlen(content) AS bytes FROM files),
up AS (SELECT unnest(['.', split_part(repo, '/', 1), repo]) AS dir, lines, bytes FROM m)
SELECT dir, count(*) AS files, sum(lines)::BIGINT AS lines, sum(bytes)::BIGINT AS bytes FROM up GROUP BY dir""")
def directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, lines and bytes of each directory and those above."""
    return arch.directory_rollup(files(spark, sf_dir), {"files": F.lit(1), "lines": F.size(split_lines(F.col("content"))), "bytes": F.octet_length("content")})


LINKS = f"""WITH {DECLS}, {CALLS}, links AS (SELECT c.id AS link_id, regexp_replace(c.path, '/[^/]*$', '') AS from_dir, regexp_replace(d.path, '/[^/]*$', '') AS to_dir, c.path AS from_path, c.line FROM calls c JOIN decls d ON d.id = c.target_id WHERE confidence = 'exact'),
kept AS (SELECT DISTINCT from_dir, to_dir, from_path, line FROM links WHERE from_dir <> to_dir), rel AS (SELECT from_dir, to_dir, 'call' AS kind, count(*) AS relations FROM kept GROUP BY from_dir, to_dir)"""


@query(f"{LINKS} SELECT * FROM rel")
def arch_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between directories by strong calls."""
    return arch.relations(arch.strong_call_links(calls(spark, sf_dir), declarations(spark, sf_dir))).drop("evidence")


@query(f"""{LINKS} SELECT dir, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM (SELECT from_dir AS dir, relations AS o, 0 AS i FROM rel UNION ALL SELECT to_dir, 0, relations FROM rel) GROUP BY dir""")
def arch_responsibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    return arch.responsibilities(arch.relations(arch.strong_call_links(calls(spark, sf_dir), declarations(spark, sf_dir))))


@query(f"""{LINKS} SELECT from_path, line::INT AS line FROM kept WHERE from_dir = 'Brand#11' AND to_dir = 'Brand#22'""")
def arch_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence that one directory relates to another."""
    found = arch.relations(arch.strong_call_links(calls(spark, sf_dir), declarations(spark, sf_dir)))
    return arch.narrow_evidence(found, "Brand#11", "Brand#22").drop("kind")


@query("""WITH t AS (SELECT l_orderkey, count(DISTINCT s_nationkey) FILTER (WHERE l_returnflag <> 'N') AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey)
SELECT count(*) FILTER (WHERE n = 0) AS unresolved, count(*) FILTER (WHERE n = 1) AS resolved, count(*) FILTER (WHERE n > 1) AS ambiguous FROM t""")
def import_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports (orders) by how many directories (nations) they lead to."""
    l, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    joined = l.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    target = F.when(F.col("l_returnflag") != "N", F.concat_ws("/", F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")))
    imports = joined.groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.collect_set(target).alias("target_paths")).withColumn("import_path", F.col("path")).withColumn("line", F.lit(1))
    return arch.import_coverage(imports)


@query(f"""WITH {USED}, sets AS (SELECT owner, caller, caller_path, string_agg(DISTINCT callable, '|' ORDER BY callable) AS pattern, count(DISTINCT callable) AS n FROM used GROUP BY ALL)
SELECT owner, pattern, count(*) AS occurrences, count(DISTINCT caller_path) AS files, count(DISTINCT regexp_replace(caller_path, '/[^/]*$', '')) AS packages FROM sets WHERE n > 1 GROUP BY owner, pattern HAVING count(*) >= 2 AND count(DISTINCT caller_path) >= 2""")
def boundary_cousage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callables of an owner that callers use together."""
    return arch.cousage(used(spark, sf_dir)).withColumn("pattern", F.array_join("pattern", "|"))


@query(f"""WITH {USED}, sets AS (SELECT owner, caller, caller_path, string_agg(callable, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, callable) AS pattern, count(*) AS n FROM used GROUP BY ALL)
SELECT owner, pattern, count(*) AS occurrences, count(DISTINCT caller_path) AS files, count(DISTINCT regexp_replace(caller_path, '/[^/]*$', '')) AS packages FROM sets WHERE n > 1 GROUP BY owner, pattern HAVING count(*) >= 2 AND count(DISTINCT caller_path) >= 2""")
def boundary_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which order they are used."""
    return arch.sequences(used(spark, sf_dir)).withColumn("pattern", F.array_join("pattern", "|"))


@query(f"""WITH {USED}, both_ AS (SELECT owner, caller, caller_path, 'call:' || callable AS label, 1 AS k FROM used UNION ALL SELECT owner, caller, caller_path, 'member:' || (l_linenumber % 3)::VARCHAR, 2 FROM used WHERE l_linenumber <= 2),
sets AS (SELECT owner, caller, caller_path, string_agg(DISTINCT label, '|' ORDER BY label) AS pattern, count(DISTINCT k) AS kinds FROM both_ GROUP BY ALL)
SELECT owner, pattern, count(*) AS occurrences, count(DISTINCT caller_path) AS files, count(DISTINCT regexp_replace(caller_path, '/[^/]*$', '')) AS packages FROM sets WHERE kinds = 2 GROUP BY owner, pattern HAVING count(*) >= 2 AND count(DISTINCT caller_path) >= 2""")
def boundary_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and member accesses together."""
    u = used(spark, sf_dir)
    return arch.combinations(u, member_accesses(u)).withColumn("pattern", F.array_join("pattern", "|"))


@query(f"WITH {USED} SELECT owner, count(DISTINCT caller) AS functions, count(DISTINCT caller_path) AS files, count(DISTINCT regexp_replace(caller_path, '/[^/]*$', '')) AS packages FROM used GROUP BY owner")
def boundary_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11."""
    return arch.breadth(used(spark, sf_dir))


def member_accesses(u: DataFrame) -> DataFrame:
    """The first two uses of each caller count as accesses of one of three members: the tables have no members."""
    return u.where("ord.l_linenumber <= 2").withColumn("member", (F.col("ord.l_linenumber") % 3).cast("string"))


@query(f"""WITH {USED}, both_ AS (SELECT owner, caller, caller_path, 'call:' || callable AS label, 1 AS k FROM used UNION ALL SELECT owner, caller, caller_path, 'member:' || (l_linenumber % 3)::VARCHAR, 2 FROM used WHERE l_linenumber <= 2),
sets AS (SELECT 1 AS list, owner, caller, caller_path, string_agg(DISTINCT callable, '|' ORDER BY callable) AS pattern, count(DISTINCT callable) > 1 AS good FROM used GROUP BY ALL
UNION ALL SELECT 2, owner, caller, caller_path, string_agg(callable, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, callable), count(*) > 1 FROM used GROUP BY ALL
UNION ALL SELECT 3, owner, caller, caller_path, string_agg(DISTINCT label, '|' ORDER BY label), count(DISTINCT k) = 2 FROM both_ GROUP BY ALL),
p AS (SELECT owner, count(*) AS occurrences, count(DISTINCT caller_path) AS files, min(regexp_replace(caller_path, '/[^/]*$', '')) AS p1, max(regexp_replace(caller_path, '/[^/]*$', '')) AS p2
FROM sets WHERE good GROUP BY list, owner, pattern HAVING count(*) >= 2 AND count(DISTINCT caller_path) >= 2),
o AS (SELECT owner, count(*) AS patterns, sum(files * 1000 + occurrences)::BIGINT AS score, min(p1) <> max(p2) AS wide FROM p GROUP BY owner)
SELECT owner, patterns, score, ['medium', 'low', 'informational'][least(3, if(wide, 1, 2) + (owner LIKE 'Brand#1_')::INT + (owner LIKE 'Brand#_1')::INT)] AS risk FROM o""")
def boundary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners with patterns, by risk."""
    u = used(spark, sf_dir)
    classes = (("utility-hub", "Brand#1?"), ("adapter-protocol", "Brand#?1"))
    return arch.by_risk(arch.boundary_candidates(u, member_accesses(u), classes=classes), "owner")


@query("""WITH offered AS (SELECT s_nationkey AS language, s_suppkey AS owner, string_agg(DISTINCT l_returnflag || l_linestatus, '|' ORDER BY l_returnflag || l_linestatus) AS callables, count(DISTINCT l_returnflag || l_linestatus) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
SELECT language, callables, string_agg(owner::VARCHAR, '|' ORDER BY owner) AS owners FROM offered WHERE n > 1 GROUP BY language, callables HAVING count(*) > 1""")
def parallel_abstractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners (suppliers) that offer the same callables."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    u = joined.select(F.col("s_nationkey").alias("language"), F.col("s_suppkey").alias("owner"), F.concat("l_returnflag", "l_linestatus").alias("callable"))
    return arch.parallel_abstractions(u).select("language", F.array_join("callables", "|").alias("callables"), F.array_join("owners", "|").alias("owners"))


@query("""WITH u AS (SELECT DISTINCT p_brand AS language, p_type AS type, l_orderkey AS function, o_custkey AS path, CASE l_returnflag WHEN 'A' THEN 'parameter' WHEN 'N' THEN 'result' ELSE 'local' END AS role, l_linestatus = 'O' AS is_test
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)
SELECT language, type, count(DISTINCT function) AS functions, count(DISTINCT path) AS files, count(DISTINCT path) FILTER (WHERE is_test) AS test_files, count(*) FILTER (WHERE role = 'parameter') AS parameter_uses,
count(*) FILTER (WHERE role = 'result') AS result_uses, count(*) FILTER (WHERE role = 'local') AS local_uses FROM u GROUP BY language, type HAVING count(DISTINCT function) >= 3 AND count(DISTINCT path) >= 2""")
def type_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far types spread, by role."""
    l, p, o = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    joined = l.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    role = F.when(F.col("l_returnflag") == "A", "parameter").when(F.col("l_returnflag") == "N", "result").otherwise("local")
    usages = joined.select(F.col("p_brand").alias("language"), F.col("p_type").alias("type"), F.lit("").alias("import_path"), F.col("l_orderkey").alias("function"), F.col("o_custkey").alias("path"), role.alias("role"), (F.col("l_linestatus") == "O").alias("is_test"))
    return arch.type_spread(usages, 3).drop("import_path", "field_uses")


BYPASS = (("eleven", "Brand#22", "Brand#11"), ("promo", "**/PROMO*", "Brand#3?/*"))


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arch.owner_calls(calls(spark, sf_dir), declarations(spark, sf_dir))


USES = f"""WITH {DECLS}, {CALLS}, each AS (SELECT c.id, c.caller_id, c.path AS caller_path, unnest(CASE WHEN target_id IS NOT NULL THEN [target_id] ELSE candidate_target_ids END) AS t FROM calls c),
uses AS (SELECT caller_id, caller_path, d.path AS owner_path, regexp_replace(d.name, '^.*\\.', '') AS callable FROM each JOIN decls d ON d.id = t WHERE d.path <> caller_path)"""


@query(f"""{USES} SELECT rule, owner_path, caller_path, callable, count(*) AS n FROM (
SELECT 'eleven' AS rule, * FROM uses WHERE starts_with(owner_path, 'Brand#11/') AND NOT starts_with(caller_path, 'Brand#11/') AND NOT starts_with(caller_path, 'Brand#22/')
UNION ALL SELECT 'promo', * FROM uses WHERE regexp_matches(owner_path, '^Brand#3[^/]/[^/]*$') AND NOT regexp_matches(caller_path, '^Brand#3[^/]/[^/]*$') AND NOT regexp_matches(caller_path, '^(?:[^/]+/)*PROMO[^/]*$')) GROUP BY ALL""")
def facade_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls past a facade."""
    return arch.facade_bypass(uses(spark, sf_dir), BYPASS).groupBy("rule", "owner_path", "caller_path", "callable").agg(F.count("*").alias("n"))


LAYERS = (("core", "Brand#1?/**"), ("edge", "Brand#2?/**"))


@query(f"""{USES}, l AS (SELECT *, CASE WHEN owner_path LIKE 'Brand#1_/%' THEN 'core' WHEN owner_path LIKE 'Brand#2_/%' THEN 'edge' END AS a, CASE WHEN caller_path LIKE 'Brand#1_/%' THEN 'core' WHEN caller_path LIKE 'Brand#2_/%' THEN 'edge' END AS b FROM uses)
SELECT owner_path, CASE WHEN least(min(a), min(b)) <> greatest(max(a), max(b)) THEN 'cross-layer' WHEN bool_or(regexp_replace(owner_path, '/[^/]*$', '') <> regexp_replace(caller_path, '/[^/]*$', '')) THEN 'cross-package' ELSE 'package-internal' END AS spread FROM l GROUP BY owner_path""")
def policy_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners by how far they and all their consumers reach over layers."""
    return arch.spread(uses(spark, sf_dir), LAYERS)


@query(f"""{USES}, j AS (SELECT owner_path, starts_with(owner_path, 'Brand#11/') AS ruled, regexp_matches(caller_path, '^Brand#[12][^/]/') AS inside, regexp_replace(owner_path, '/[^/]*$', '') = regexp_replace(caller_path, '/[^/]*$', '') AS near FROM uses)
SELECT owner_path, CASE WHEN bool_or(ruled) THEN CASE WHEN bool_and(inside) THEN 'contained' ELSE 'escaped' END WHEN bool_and(near) THEN 'approved' ELSE 'unknown' END AS containment FROM j GROUP BY owner_path""")
def policy_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners whose callers stay within a rule's paths."""
    return arch.containment(uses(spark, sf_dir), (("Brand#11", "Brand#[12]?/**"),))
