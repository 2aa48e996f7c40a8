"""Collections of text files as DataFrames: files, lines, listings, kinds and scopes.

files(repo, path, language, content) and lines(path, repo, language, line, text) are what
the search operators read.  Listings never read contents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.patterns import glob_regex, matches_globs, repo_allowed
from corpuscle.functions.scalars import ancestors, repo_id

#: Languages by file extension: fixed values.
LANGUAGES = {
    "go": "go", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "tsx", "java": "java", "kt": "kotlin", "kts": "kotlin", "php": "php", "lua": "lua",
    "css": "css", "svelte": "svelte", "rs": "rust", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp",
    "hpp": "cpp", "cs": "csharp", "sh": "bash", "bash": "bash", "sql": "sql", "json": "json", "yaml": "yaml",
    "yml": "yaml", "toml": "toml", "md": "markdown", "html": "html", "scala": "scala", "swift": "swift",
}
KINDS = ("production", "test", "fixture", "generated", "vendor")
#: Subtrees that are never read.
BUILT_IN_EXCLUDES = (".git", ".worktrees", ".corpuscle")


def language_of(path: Column) -> Column:
    """By the last extension; anything else is text."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension), F.lit("text"))


def read_files(spark: SparkSession, root: str, globs: Sequence[str] = ()) -> DataFrame:
    """Files under a root in any store that Spark reads; files with a NUL byte are left out, bytes that aren't UTF-8 become U+FFFD."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.substring_index(F.col("path"), root.rstrip("/").split("://")[-1].rstrip("/") + "/", -1), "^/+", "")
    files = raw.select(relative.alias("path"), "content").where(matches_globs(F.col("path"), globs))
    text = files.where(F.instr(F.col("content").cast("string"), "\x00") == 0).withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
    return text.select(repo_id(F.col("path")).alias("repo"), "path", language_of(F.col("path")).alias("language"), "content")


def in_memory(spark: SparkSession, content: str, name: str = "<stdin>") -> DataFrame:
    """One virtual file."""
    return spark.createDataFrame([("", name, "text", content)], "repo string, path string, language string, content string")


def document_files(documents: DataFrame) -> DataFrame:
    """The table ``documents`` as files of repositories source/lang."""
    repo = F.concat_ws("/", "source", "lang")
    return documents.select(repo.alias("repo"), F.concat(repo, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


def split_lines(content: Column) -> Column:
    """CRLF as LF; one empty line at the end goes; empty contents are one empty line."""
    parts = F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n")
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(files: DataFrame) -> DataFrame:
    """Numbered lines, from 1."""
    return files.select("repo", "path", "language", F.posexplode(split_lines(F.col("content"))).alias("n", "text")).select("repo", "path", "language", (F.col("n") + 1).alias("line"), "text")


def listing(files: DataFrame, globs: Sequence[str] = (), under: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Paths that match any glob, lie under any of the directories, in repositories that are allowed."""
    path = F.col("path")
    inside = F.lit(not under)
    for d in under:
        inside = inside | path.startswith(d.rstrip("/") + "/") | (path == d.rstrip("/"))
    return files.select("repo", "path").where(matches_globs(path, globs) & inside & repo_allowed(F.col("repo"), include, exclude))


def not_ignored(files: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Files that no ignore rule excludes.

    ``rules`` are (directory, pattern) in file order.  Within a directory's rules the last match
    wins and ``!`` negates; the deepest directory with a match decides.  A pattern without a
    slash matches any segment, one with a slash the path below its directory; one that ends in a
    slash matches directories only.
    """
    path = F.col("path")
    found = None
    for i, (directory, raw) in sorted(enumerate(rules), key=lambda r: (r[1][0].count("/") + bool(r[1][0].strip("./")), r[0])):
        negated, pattern = raw.startswith("!"), raw.removeprefix("!")
        only_directories, pattern = pattern.endswith("/"), pattern.rstrip("/")
        base = directory.strip("./")
        below = F.expr(f"substring(path, {len(base) + 2 if base else 1})")
        inside = path.startswith(base + "/") if base else F.lit(True)
        body = glob_regex(pattern)[1:-1]
        anchored = "^" if "/" in pattern else "(?:^|.*/)"
        tail = "/.*$" if only_directories else "(?:/.*)?$"
        hit = inside & below.rlike(f"{anchored}{body}{tail}")
        verdict = F.when(hit, F.lit(not negated))
        found = verdict if found is None else F.coalesce(verdict, found)
    ignored = F.coalesce(found, F.lit(False)) if found is not None else F.lit(False)
    return files.where(~ignored)


def source_kind(files: DataFrame, meta: DataFrame) -> DataFrame:
    """``files`` with ``kind``: what current metadata (path, checksum, purpose) say, else unknown."""
    known = meta.select(F.col("path").alias("__path"), "checksum", F.lower("purpose").alias("__purpose"))
    joined = files.join(known, F.col("path") == F.col("__path"), "left")
    current = F.col("checksum") == F.sha2("content", 256)
    return joined.withColumn("kind", F.when(current & F.col("__purpose").isin(*KINDS), F.col("__purpose")).otherwise("unknown")).drop("__path", "checksum", "__purpose")


def source_decisions(files: DataFrame, ignored: Column, config_ignored: Column, production_only: bool = True) -> DataFrame:
    """path, selected, reason, by precedence: built-in subtree, ignore file, configuration, kind."""
    built_in = F.lit(False)
    for name in BUILT_IN_EXCLUDES:
        built_in = built_in | F.concat(F.lit("/"), "path").contains(f"/{name}/")
    reason = F.when(built_in, "built-in-subtree").when(ignored, "ignore-file").when(config_ignored, "config-ignore")
    if production_only:
        reason = reason.when(F.col("kind") != "production", "non-production")
    return files.withColumn("reason", reason.otherwise("selected")).withColumn("selected", F.col("reason") == "selected")


def tree(files: DataFrame, depth: int) -> DataFrame:
    """path, is_file, depth: every directory and file down to a depth."""
    up = F.filter(ancestors(F.col("path")), lambda d: d != ".")
    every = F.concat(F.transform(up, lambda d: F.struct(d.alias("path"), F.lit(False).alias("is_file"))), F.array(F.struct(F.col("path").alias("path"), F.lit(True).alias("is_file"))))
    found = files.select(F.explode(every).alias("e")).select("e.path", "e.is_file").withColumn("depth", F.size(F.split("path", "/")))
    return found.where(F.col("depth") <= depth).distinct()


def refs(entries: DataFrame, repo: str = "", kind: str = "") -> DataFrame:
    """Repository references of a repository and a kind; empty asks for any."""
    return entries.where((F.lit(repo == "") | (F.col("repo") == repo)) & (F.lit(kind == "") | (F.col("kind") == kind)))
