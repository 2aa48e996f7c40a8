"""Metadata of documents: labels tell quality and toxicity, checksums of Spanish ones are out of date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import metadata
from corpuscle.queries import query, table
from corpuscle.queries.search import files
from corpuscle.sources import corpus

M = """m AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, source || '/' || lang AS dir, d.lang,
CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN lang = 'es' THEN 'stale' WHEN toxic = 1 AND quality = 0 THEN 'invalid' ELSE 'current' END AS status,
CASE WHEN quality = 1 THEN 'production' WHEN toxic = 1 THEN 'test' ELSE 'sketch' END AS purpose, [CASE WHEN quality = 1 THEN 'High Quality' ELSE 'low  quality' END, upper(lang)] AS keywords
FROM documents d LEFT JOIN labels l USING (doc_id))"""


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    checksum = F.when(F.col("lang") == "es", "old").when((F.col("toxic") == 1) & (F.col("quality") == 0), None).otherwise(F.sha2("text", 256))
    purpose = F.when(F.col("quality") == 1, "production").when(F.col("toxic") == 1, "test").otherwise("sketch")
    return joined.select(path.alias("path"), checksum.alias("checksum"), purpose.alias("purpose"), F.array(F.when(F.col("quality") == 1, "High Quality").otherwise("low  quality"), F.upper("lang")).alias("keywords"))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.with_status(files(spark, sf_dir), meta(spark, sf_dir))


@query(f"WITH {M} SELECT path, status FROM m")
def metadata_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's status."""
    return known(spark, sf_dir).select("path", "status")


@query(f"WITH {M} SELECT status, count(*) AS files FROM m GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G19, G22, A24."""
    return metadata.status_counts(known(spark, sf_dir))


@query(f"""WITH {M} SELECT dir, CASE WHEN bool_or(status = 'invalid') THEN 'invalid' WHEN bool_or(status IN ('stale', 'missing')) THEN 'stale' ELSE 'current' END AS status FROM m GROUP BY dir""")
def directory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H10 by directory."""
    return metadata.directory_status(files(spark, sf_dir), meta(spark, sf_dir))


@query(f"WITH {M} SELECT path FROM m WHERE status = 'current' AND keywords[1] = 'High Quality' AND lang IN ('en', 'de')".replace("AND lang IN ('en', 'de')", ""))
def metadata_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current files with a label of each category; spelling and case don't matter."""
    return metadata.selected(known(spark, sf_dir), {"keywords": ["high-QUALITY", "no such"]}).select("path")


@query(f"""WITH {M}, e AS (SELECT path, unnest(keywords) AS label FROM m WHERE status = 'current'), k AS (SELECT path, label, lower(regexp_replace(label, '\\s+', '-', 'g')) AS label_key FROM e),
c AS (SELECT label_key, count(*) AS files, arg_min(label, path) AS label FROM k GROUP BY label_key), x AS (SELECT label_key, string_agg(path, '|' ORDER BY path) AS examples FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY label_key ORDER BY path) <= 2) GROUP BY label_key)
SELECT label_key, label, files, examples, files - 2 AS omitted FROM c JOIN x USING (label_key) ORDER BY files DESC, label_key LIMIT 8""")
def label_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their number of files and first paths."""
    return metadata.label_overview(known(spark, sf_dir), "keywords").withColumn("examples", F.array_join("examples", "|"))


@query(f"""WITH {M}, e AS (SELECT dir, unnest(keywords) AS label FROM m WHERE status = 'current'), u AS (SELECT unnest(['.', split_part(dir, '/', 1), dir]) AS dir, label FROM e)
SELECT dir, string_agg(DISTINCT label, '|' ORDER BY label) AS labels FROM u GROUP BY dir""")
def directory_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: labels of all current files below a directory."""
    return metadata.directory_labels(known(spark, sf_dir), "keywords").withColumn("labels", F.array_join("labels", "|"))


KINDS = f"{M}, k AS (SELECT path, CASE WHEN status = 'current' AND purpose IN ('production', 'test') THEN purpose ELSE 'unknown' END AS kind FROM m)"


@query(f"WITH {KINDS} SELECT path, kind FROM k")
def source_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds that current metadata tell."""
    return corpus.source_kind(files(spark, sf_dir), meta(spark, sf_dir)).select("path", "kind")


@query(f"""WITH {KINDS}, d AS (SELECT kind, CASE WHEN starts_with(path, 'src1/') THEN 'ignore-file' WHEN starts_with(path, 'src2/de/') THEN 'config-ignore' WHEN kind <> 'production' THEN 'non-production' ELSE 'selected' END AS reason FROM k)
SELECT kind, reason, count(*) AS files FROM d GROUP BY kind, reason""")
def source_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why files are selected or not."""
    kinds = corpus.source_kind(files(spark, sf_dir), meta(spark, sf_dir))
    path = F.col("path")
    return corpus.source_decisions(kinds, path.startswith("src1/"), path.startswith("src2/de/")).groupBy("kind", "reason").agg(F.count("*").alias("files"))
