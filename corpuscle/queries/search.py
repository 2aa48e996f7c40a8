"""Search over the lines of ``documents`` as files of repositories source/lang."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.patterns import glob_regex
from corpuscle.operators import intervals, search
from corpuscle.queries import query, table
from corpuscle.sources import corpus

FILES = "files AS (SELECT source || '/' || lang AS repo, source || '/' || lang || '/' || doc_id || '.txt' AS path, lang AS language, text AS content FROM documents)"
LINES = f"""{FILES}, cut AS (SELECT repo, path, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM files),
whole AS (SELECT repo, path, CASE WHEN len(l) > 1 AND l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM cut),
lines AS (SELECT repo, path, unnest(range(1, len(l) + 1))::INT AS line, unnest(l) AS text FROM whole)"""
PATTERN = "the [a-z]+ing\\b"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_files(table(spark, sf_dir, "documents"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lines(files(spark, sf_dir))


@query(f"""WITH {LINES}, by_file AS (SELECT repo, path, count(*) AS n FROM lines WHERE regexp_matches(text, '{PATTERN}') GROUP BY ALL)
SELECT repo, count(*) AS files, sum(n)::BIGINT AS matches FROM by_file GROUP BY repo""")
def text_regex_repo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching lines by repository."""
    found = search.matching_lines(lines(spark, sf_dir), PATTERN)
    return search.count_by_repo(found).orderBy(F.desc("matches"), F.desc("files"), "repo")


@query(f"WITH {LINES} SELECT path, count(*) AS matches FROM lines WHERE contains(lower(text), 'licensed under') GROUP BY path")
def text_fixed_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A4, A10: a fixed string in any case, counted by file."""
    return search.count_by_file(search.matching_lines(lines(spark, sf_dir), "Licensed Under", fixed=True, ignore_case=True))


@query(f"WITH {LINES} SELECT path, count(*) AS matches FROM lines WHERE NOT regexp_matches(text, '(?i)[aeiou]{{2}}') GROUP BY path")
def text_invert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: lines that don't match."""
    return search.count_by_file(search.matching_lines(lines(spark, sf_dir), "[aeiou]{2}", ignore_case=True, invert=True))


@query(f"WITH {LINES} SELECT DISTINCT repo, path FROM lines WHERE regexp_matches(text, '[0-9]{{3}}')")
def files_with_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return search.files_with_matches(search.matching_lines(lines(spark, sf_dir), "[0-9]{3}"))


@query(f"WITH {LINES} SELECT count(DISTINCT path) AS files, count(*) AS matches FROM lines WHERE regexp_matches(text, '{PATTERN}')")
def count_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return search.count_summary(search.matching_lines(lines(spark, sf_dir), PATTERN))


@query(f"""WITH {LINES} SELECT repo, path, string_agg(line || ':' || length(text), ',' ORDER BY line) AS lines FROM lines
WHERE regexp_matches(text, '[0-9]{{3}}') GROUP BY repo, path""")
def matches_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's matches in order."""
    found = search.matches_by_file(search.matching_lines(lines(spark, sf_dir), "[0-9]{3}"))
    return found.select("repo", "path", F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["line"], F.length(m["text"]))), ",").alias("lines"))


@query(f"""WITH {LINES}, found AS (SELECT repo, path, line, regexp_extract_all(text, '[0-9]+') AS m FROM lines)
SELECT repo, path, line, unnest(range(1, len(m) + 1))::INT AS nth, unnest(m) AS match FROM found""")
def only_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each matched part."""
    return search.only_matching(lines(spark, sf_dir), "[0-9]+")


@query(f"""WITH {LINES}, marked AS (SELECT path, line, regexp_matches(text, '[0-9]{{3}}') AS is_match FROM lines),
near AS (SELECT *, max(is_match) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM marked)
SELECT path, line, is_match FROM near WHERE n""")
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line before and two after each hit."""
    return search.context_lines(lines(spark, sf_dir), F.col("text").rlike("[0-9]{3}"), 1, 2).select("path", "line", "is_match")


@query(f"""WITH {LINES}, n AS (SELECT path, count(*) AS n FROM lines GROUP BY path)
SELECT path, CASE WHEN n >= 5 THEN 5 END AS start_line, CASE WHEN n >= 5 THEN least(n, 12) END AS end_line,
CASE WHEN n < 5 THEN 'full-miss' WHEN n < 12 THEN 'partial-miss' ELSE 'exact' END AS outcome FROM n""")
def line_range_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    counted = files(spark, sf_dir).select("path", F.size(corpus.split_lines(F.col("content"))).cast("long").alias("n_lines"))
    return search.resolve_range(counted, 5, 12).withColumn("end_line", F.col("end_line").cast("long"))


@query(f"""WITH {LINES} SELECT path, count(*) AS matches FROM lines WHERE regexp_matches(text, '{PATTERN}') GROUP BY path
ORDER BY matches DESC, path LIMIT 50 OFFSET 20""")
def sort_matches_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2, L4: a page of files by matches; a top-k, which is the feature."""
    counts = search.count_by_file(search.matching_lines(lines(spark, sf_dir), PATTERN))
    return search.page(counts, [F.desc("matches"), "path"], limit=50, skip=20)


@query(f"WITH {FILES} SELECT path FROM files WHERE path > 'src3' ORDER BY path LIMIT 100")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a path."""
    return search.after_key(corpus.listing(files(spark, sf_dir)).select("path"), "path", "src3", search.page_size(500))


GLOBS = ("src1*/**/*.txt", "src2/en/*[57].txt")


@query(f"""WITH {FILES} SELECT repo, path FROM files WHERE ({' OR '.join(f"regexp_matches(path, '{glob_regex(g)}')" for g in GLOBS)})
AND NOT (regexp_matches(repo, '^[^/]*/de$') OR regexp_matches(repo, '^(?:src1[0-2]/f.)$'))""")
def glob_repo_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing by globs, without some repositories."""
    return corpus.listing(files(spark, sf_dir), GLOBS, under=("src1", "src2", *(f"src1{i}" for i in range(10))), exclude=("*/de", "src1[0-2]/f."))


RULES = ((".", "src1/"), (".", "*9.txt"), ("src2", "en"), ("src2", "!en/*1.txt"), ("src3/fr", "!*9.txt"))


@query(f"""WITH {FILES} SELECT path FROM files WHERE NOT coalesce(
CASE WHEN starts_with(path, 'src3/fr/') AND regexp_matches(path, '9\\.txt$') THEN false END,
CASE WHEN starts_with(path, 'src2/') AND regexp_matches(path, '^src2/en/[^/]*1\\.txt$') THEN false END,
CASE WHEN starts_with(path, 'src2/en/') THEN true END,
CASE WHEN regexp_matches(path, '9\\.txt$') THEN true END,
CASE WHEN starts_with(path, 'src1/') THEN true END, false)""")
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested ignore rules; the last match of the deepest directory decides."""
    return corpus.not_ignored(files(spark, sf_dir).select("path"), RULES)


@query(f"""WITH {LINES}, hits AS (SELECT path, line FROM lines WHERE regexp_matches(text, '[0-9]{{3}}')),
fresh AS (SELECT path, line, CASE WHEN line - lag(line) OVER (PARTITION BY path ORDER BY line) <= 1 THEN 0 ELSE 1 END AS f FROM hits),
runs AS (SELECT path, line, sum(f) OVER (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM fresh)
SELECT path, segment, min(line) AS start_line, max(line) AS end_line, count(*) AS hits FROM runs GROUP BY path, segment""")
def match_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring matches."""
    return search.segments(search.matching_lines(lines(spark, sf_dir), "[0-9]{3}"))


@query(f"""WITH {FILES} SELECT DISTINCT path, false AS is_file, depth::INT AS depth FROM (SELECT source AS path, 1 AS depth FROM documents UNION ALL SELECT source || '/' || lang, 2 FROM documents)
UNION ALL SELECT DISTINCT path, true, 3::INT FROM files""")
def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories and files to a depth of 3."""
    return corpus.tree(files(spark, sf_dir).select("path"), 3)


@query(f"WITH {FILES}, first AS (SELECT max(path) AS cut FROM (SELECT path FROM files ORDER BY path LIMIT 300)) SELECT path, path <= cut AS analysed FROM files, first")
def first_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first files are analysed, the others reported."""
    return search.first_eligible(files(spark, sf_dir).select("path"), 300)


def _intervals(found: DataFrame) -> DataFrame:
    """Nested ranges of each file: the whole, its halves, its quarters, named by size and place."""
    n = found.select("path", F.size(corpus.split_lines(F.col("content"))).alias("n"))
    parts = [F.struct(F.lit(f"{k}/{i}").alias("name"), (F.floor(F.col("n") * i / k) + 1).alias("start_line"), F.floor(F.col("n") * (i + 1) / k).alias("end_line")) for k in (1, 2, 4) for i in range(k)]
    return n.select("path", F.explode(F.array(*parts)).alias("p")).select("path", "p.*").where("start_line <= end_line")


_INTERVAL_SQL = " UNION ALL ".join(f"SELECT path, '{k}/{i}' AS name, floor(n * {i} / {k})::BIGINT + 1 AS start_line, floor(n * {i + 1} / {k})::BIGINT AS end_line FROM n" for k in (1, 2, 4) for i in range(k))


@query(f"""WITH {LINES}, n AS (SELECT path, count(*)::DOUBLE AS n FROM lines GROUP BY path), parts AS ({_INTERVAL_SQL}),
hits AS (SELECT path, line FROM lines WHERE regexp_matches(text, '[0-9]{{3}}')),
held AS (SELECT h.path, h.line, name, start_line, end_line, rank() OVER (PARTITION BY h.path, h.line ORDER BY end_line - start_line) AS r
FROM hits h JOIN parts p ON h.path = p.path AND h.line BETWEEN p.start_line AND p.end_line WHERE p.start_line <= p.end_line)
SELECT path, line, name, start_line, end_line, count(*) OVER (PARTITION BY path, line) > 1 AS ambiguous FROM held WHERE r = 1""")
def narrowest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest ranges that hold each hit."""
    found = files(spark, sf_dir)
    hits = search.matching_lines(corpus.lines(found), "[0-9]{3}").select("path", "line")
    return intervals.narrowest(hits, _intervals(found), ["path", "line"]).select("path", "line", "name", "start_line", "end_line", "ambiguous")


@query(f"""WITH {LINES}, n AS (SELECT path, count(*)::DOUBLE AS n FROM lines GROUP BY path), parts AS ({_INTERVAL_SQL}),
ok AS (SELECT * FROM parts WHERE start_line <= end_line)
SELECT a.path, a.name AS a_name, b.name AS b_name FROM ok a JOIN ok b ON a.path = b.path AND a.start_line <= b.end_line AND b.start_line <= a.end_line AND a.name <> b.name""")
def overlapping_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a file that overlap."""
    parts = _intervals(files(spark, sf_dir))
    a = parts.withColumnRenamed("name", "a_name")
    b = parts.select("path", F.col("name").alias("b_name"), F.col("start_line").alias("b_start"), F.col("end_line").alias("b_end"))
    return intervals.overlapping(a, b).where("a_name <> b_name").select("path", "a_name", "b_name")
