"""Syntax nodes as a table, and structural patterns over them.

nodes(path, node_id, parent_id, pre, post, depth, kind, field, start_line, end_line, start_byte, end_byte, text)
come from language adapters (Python by its own parser; markup; JSON; Markdown outlines) that
run file by file.  Containment is an interval test on (pre, post) within a path: a descendant
has a larger ``pre`` and a smaller ``post``.  Everything after parsing is DataFrame work.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, node_id int, parent_id int, pre int, post int, depth int, kind string, field string, start_line int, end_line int, start_byte int, end_byte int, text string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_KINDS = [pa.string(), *[pa.int32()] * 5, pa.string(), pa.string(), *[pa.int32()] * 4, pa.string()]
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Builder:
    """Collects nodes with pre- and postorder numbers."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.open: list[int] = []
        self.posts = 0

    def start(self, kind: str, field: str, line: int, byte: int, text: str = "") -> int:
        n = len(self.rows)
        self.rows.append([n, self.open[-1] if self.open else None, n, -1, len(self.open), kind, field, line, line, byte, byte, text])
        self.open.append(n)
        return n

    def end(self, line: int, byte: int) -> None:
        row = self.rows[self.open.pop()]
        row[3], row[8], row[10] = self.posts, max(row[7], line), max(row[9], byte)
        self.posts += 1


def markup_nodes(content: str) -> list[list]:
    out, at = Builder(), [0]
    for line in content.split("\n"):
        at.append(at[-1] + len(line.encode()) + 1)
    rows = content.split("\n")

    class Parser(HTMLParser):
        def place(self) -> tuple[int, int]:
            line, column = self.getpos()
            return line, at[line - 1] + len(rows[line - 1][:column].encode())

        def handle_starttag(self, tag: str, attrs: list) -> None:
            line, byte = self.place()
            out.start(tag, "", line, byte)
            for name, value in attrs:
                out.start("attribute", name, line, byte, value or "")
                out.end(line, byte)
            if tag in VOID:
                out.end(line, byte)

        def handle_endtag(self, tag: str) -> None:
            open_ = [out.rows[i][5] for i in out.open]
            if tag in open_:
                line, byte = self.place()
                while out.rows[out.open[-1]][5] != tag:
                    out.end(line, byte)
                out.end(line, byte)

        def handle_data(self, data: str) -> None:
            if data.strip():
                line, byte = self.place()
                out.start("text", "", line, byte, data.strip())
                out.end(line + data.count("\n"), byte + len(data.encode()))

    parser = Parser(convert_charrefs=True)
    parser.feed(content)
    parser.close()
    while out.open:
        out.end(len(rows), at[-1] - 1)
    return out.rows


def python_nodes(content: str) -> list[list]:
    out, at = Builder(), [0]
    for line in content.split("\n"):
        at.append(at[-1] + len(line.encode()) + 1)

    def visit(node: ast.AST, field: str, line: int, byte: int) -> None:
        line, end = getattr(node, "lineno", line), getattr(node, "end_lineno", None) or line
        byte = at[line - 1] + node.col_offset if hasattr(node, "col_offset") else byte
        last = at[end - 1] + node.end_col_offset if getattr(node, "end_col_offset", None) is not None else byte
        name = next((str(getattr(node, a)) for a in ("name", "id", "attr", "arg", "value") if isinstance(getattr(node, a, None), (str, int, float))), "")
        out.start(type(node).__name__, field, line, byte, name)
        for name, value in ast.iter_fields(node):
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST) and not isinstance(child, (ast.Load, ast.Store, ast.Del)):
                    visit(child, name, line, byte)
        out.end(end, last)

    try:
        visit(ast.parse(content), "", 1, 0)
    except (SyntaxError, ValueError, RecursionError):
        return []
    return out.rows


def json_nodes(content: str) -> list[list]:
    out = Builder()

    def visit(value: object, field: str) -> None:
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number"}.get(type(value), "null")
        out.start(kind, field, 1, 0, "" if isinstance(value, (dict, list)) else str(value))
        for name, child in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
            visit(child, str(name))
        out.end(1, 0)

    try:
        visit(json.loads(content), "")
    except (ValueError, RecursionError):
        return []
    return out.rows


def markdown_nodes(content: str) -> list[list]:
    """Sections by their headings; code fences hide headings."""
    out, levels, byte, fenced = Builder(), [], 0, False
    lines = content.split("\n")
    for n, line in enumerate(lines, 1):
        fenced ^= line.lstrip().startswith("```")
        if not fenced and (found := re.match(r"(#{1,6})\s+(.*)", line)):
            while levels and levels[-1] >= len(found[1]):
                out.end(n - 1, byte - 1)
                levels.pop()
            out.start("section", f"h{len(found[1])}", n, byte, found[2].strip())
            levels.append(len(found[1]))
        byte += len(line.encode()) + 1
    while out.open:
        out.end(len(lines), byte - 1)
    return out.rows


ADAPTERS: dict[str, Callable[[str], list[list]]] = {"html": markup_nodes, "svelte": markup_nodes, "python": python_nodes, "json": json_nodes, "markdown": markdown_nodes}


def nodes(files: DataFrame) -> DataFrame:
    """The nodes of files (path, language, content) whose language has an adapter; others have none."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = [[path, *r] for r in ADAPTERS[language](content or "")]
                yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)], names=_NAMES)

    return files.where(F.col("language").isin(*ADAPTERS)).select("path", "language", "content").mapInArrow(parse, SCHEMA)


def _as(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select("path", *[F.col(c).alias(f"{prefix}_{c}") for c in _NAMES if c != "path"])


def of_kind(all_nodes: DataFrame, kind: str, text: str | None = None) -> DataFrame:
    """Nodes of a kind; ``text`` is a regular expression for their text."""
    found = all_nodes.where(F.col("kind") == kind)
    return found if text is None else found.where(F.col("text").rlike(text))


def with_child(candidates: DataFrame, children: DataFrame, field: str | None = None) -> DataFrame:
    """Candidates that have one of the children, in a field if given."""
    wanted = children if field is None else children.where(F.col("field") == field)
    return candidates.join(wanted.select("path", F.col("parent_id").alias("node_id")).distinct(), ["path", "node_id"], "left_semi")


def containing(candidates: DataFrame, inner: DataFrame) -> DataFrame:
    """Candidates that are, or contain, one of the inner nodes.

    Each inner node stands for its ancestors by climbing parents, level by level, would need the
    whole tree; the interval test by path needs only the two sets.
    """
    i = inner.select("path", F.col("pre").alias("__pre"), F.col("post").alias("__post"))
    joined = candidates.join(i, "path").where((F.col("__pre") >= F.col("pre")) & (F.col("__post") <= F.col("post")))
    return joined.select(*candidates.columns).distinct()


def within(candidates: DataFrame, outer: DataFrame) -> DataFrame:
    """Candidates that are, or stand in, one of the outer nodes."""
    o = outer.select("path", F.col("pre").alias("__pre"), F.col("post").alias("__post"))
    joined = candidates.join(o, "path").where((F.col("pre") >= F.col("__pre")) & (F.col("post") <= F.col("__post")))
    return joined.select(*candidates.columns).distinct()


def without(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates that a query doesn't find."""
    return candidates.join(found.select("path", "node_id").distinct(), ["path", "node_id"], "left_anti")


def maybe(candidates: DataFrame, bindings: DataFrame) -> DataFrame:
    """Candidates with their bindings, or without where there are none."""
    return candidates.join(bindings, ["path", "node_id"], "left")


def parent_of_kind(candidates: DataFrame, all_nodes: DataFrame, kinds: list[str]) -> DataFrame:
    parents = all_nodes.where(F.col("kind").isin(*kinds)).select("path", F.col("node_id").alias("parent_id"))
    return candidates.join(parents, ["path", "parent_id"], "left_semi")


def normal_form(all_nodes: DataFrame) -> DataFrame:
    """(path, node_id, canonical): a subtree's kinds, fields and texts in order; equal trees have equal forms."""
    n = all_nodes.select("path", F.col("node_id"), F.col("pre").alias("p"), F.col("post").alias("q"), F.col("depth").alias("d"))
    inside = n.join(all_nodes.select("path", "pre", "post", "depth", "kind", "field", "text"), "path").where((F.col("pre") >= F.col("p")) & (F.col("post") <= F.col("q")))
    part = F.struct(F.col("pre"), F.to_json(F.struct((F.col("depth") - F.col("d")).alias("d"), F.col("kind"), F.col("field"), F.col("text"))).alias("j"))
    return inside.groupBy("path", "node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["j"]), "").alias("canonical"))


def outline(all_nodes: DataFrame, kinds: list[str], depth: int | None = None) -> DataFrame:
    """Symbols of the wanted kinds with their nearest wanted ancestor; a depth counts wanted ancestors."""
    wanted = all_nodes.where(F.col("kind").isin(*kinds))
    up = wanted.select("path", F.col("pre").alias("a_pre"), F.col("post").alias("a_post"), F.col("node_id").alias("a_id"))
    joined = wanted.join(up, "path").where((F.col("a_pre") < F.col("pre")) & (F.col("a_post") > F.col("post")))
    above = joined.groupBy("path", "node_id").agg(F.max_by("a_id", "a_pre").alias("container"), F.count("*").cast("int").alias("level"))
    out = wanted.join(above, ["path", "node_id"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    symbols = out.select("path", "node_id", "container", "level", "kind", F.col("text").alias("name"), "start_line", "end_line")
    return symbols if depth is None else symbols.where(F.col("level") < depth)


def metric(all_nodes: DataFrame, scopes: Column, points: Column, opens: Column, weight: int = 1, base: int = 0) -> DataFrame:
    """Score of each scope: ``base`` and, for each node within it, points plus nesting times weight.

    ``scopes``, ``points`` (0 for none) and ``opens`` (adds a level of nesting) are conditions on
    nodes.  A node belongs to its nearest scope; nesting counts openers between the two.
    """
    marked = all_nodes.withColumn("is_scope", scopes).withColumn("points", points).withColumn("opens", opens)
    scope = marked.where("is_scope").select("path", F.col("pre").alias("s_pre"), F.col("post").alias("s_post"), F.col("node_id").alias("scope_id"), F.col("text").alias("scope_name"))
    scored = marked.where("points > 0").select("path", "node_id", "pre", "post", "points")
    own = scored.join(scope, "path").where((F.col("s_pre") < F.col("pre")) & (F.col("s_post") > F.col("post"))).groupBy("path", "node_id", "pre", "post", "points").agg(F.max(F.struct("s_pre", "scope_id")).alias("s"))
    openers = marked.where("opens").select("path", F.col("pre").alias("o_pre"), F.col("post").alias("o_post"))
    nested = own.join(openers, "path", "left").withColumn("in", F.coalesce((F.col("o_pre") < F.col("pre")) & (F.col("o_post") > F.col("post")) & (F.col("o_pre") > F.col("s.s_pre")), F.lit(False)))
    each = nested.groupBy("path", "node_id", "points", F.col("s.scope_id").alias("scope_id")).agg(F.sum(F.col("in").cast("int")).alias("nesting"))
    sums = each.groupBy("path", "scope_id").agg(F.sum(F.col("points") + F.col("nesting") * weight).alias("score"), F.count("*").alias("contributions"))
    return scope.join(sums, ["path", "scope_id"], "left").select("path", "scope_id", "scope_name", (F.coalesce("score", F.lit(0)) + base).alias("score"), F.coalesce("contributions", F.lit(0)).alias("contributions"))
