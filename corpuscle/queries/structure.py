"""Structural queries on the markup of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import structure
from corpuscle.queries import query, table


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return structure.nodes(pages.select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("language"), F.col("html").alias("content")))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages FROM l GROUP BY target""")
def link_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 on markup: links by their target."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    by_page = found.groupBy("target", "page_id").agg(F.count("*").alias("n"))
    return by_page.groupBy("target").agg(F.sum("n").alias("links"), F.count("*").alias("pages"))


@query()
def markup_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of pages with their containers."""
    return structure.outline(nodes(spark, sf_dir), ["html", "body", "article", "section", "nav", "ul", "table", "h1", "h2", "h3"])


@query()
def nodes_with_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with an href whose parent is a list item."""
    n = nodes(spark, sf_dir)
    links = structure.with_child(structure.of_kind(n, "a"), structure.of_kind(n, "attribute"), "href")
    return structure.parent_of_kind(links, n, ["li"]).select("path", "node_id", "start_line", "start_byte")


@query()
def nodes_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with bold text that don't stand in a navigation."""
    n = nodes(spark, sf_dir)
    bold = structure.containing(structure.of_kind(n, "p"), structure.of_kind(n, "b"))
    return structure.without(bold, structure.within(bold, structure.of_kind(n, "nav"))).select("path", "node_id", "start_byte", "end_byte")


@query()
def tree_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nesting of lists and blocks of each body."""
    kind = F.col("kind")
    points = F.when(kind.isin("a", "p", "td"), 1).otherwise(0)
    return structure.metric(nodes(spark, sf_dir), kind.isin("body", "article"), points, kind.isin("ul", "div", "table", "tr"))
