from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import patterns, scalars
from corpuscle.sources import corpus


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("glob", "path", "hit"), [
    ("**/*.go", "a.go", True), ("**/*.go", "a/b/c.go", True), ("*.go", "a/b.go", False), ("a/**", "a/b/c", True), ("a/**", "b/a", False), ("a/**/c", "a/c", True),
    ("a/?.py", "a/b.py", True), ("a/?.py", "a/bc.py", False), ("[ab].c", "b.c", True), ("[!ab].c", "b.c", False), ("[a-c]x", "bx", True), ("a.b", "axb", False), ("[", "[", True),
])
def test_glob(spark, glob, path, hit):
    assert one(spark, patterns.matches_globs(F.col("p"), [glob]), p=path) is hit


def test_globs_are_alternatives_and_none_matches_all(spark):
    assert one(spark, patterns.matches_globs(F.col("p"), ["x", "a*"]), p="ab")
    assert one(spark, patterns.matches_globs(F.col("p"), []), p="ab")


@pytest.mark.parametrize("bad", [r"(a)\1", "(?=a)", "(?<!a)b", "a++", "(?>a)"])
def test_refused_patterns(bad):
    with pytest.raises(ValueError):
        patterns.checked_regex(bad)


def test_accepted_patterns():
    for good in ("a+?", r"\\1", "(?i)a", "[a-z]{2,3}", r"a\+\+"):
        assert patterns.checked_regex(good) == good


@pytest.mark.parametrize(("content", "lines"), [("", [""]), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\nb", ["a", "b"]), ("\n", [""]), ("\n\n", ["", ""])])
def test_split_lines(spark, content, lines):
    assert one(spark, corpus.split_lines(F.col("c")), c=content) == lines


def test_policy_paths(spark):
    assert one(spark, patterns.matches_policy_path(F.col("p"), "a/b"), p="a/b/c")
    assert not one(spark, patterns.matches_policy_path(F.col("p"), "a/b"), p="a/bc")
    assert one(spark, patterns.matches_policy_path(F.col("p"), "a/*"), p="a/b")


def test_scalars(spark):
    assert one(spark, scalars.basename(F.col("p")), p="a/b/") == "b"
    assert one(spark, scalars.dirname(F.col("p")), p="a") == "."
    assert one(spark, scalars.dirname(F.col("p")), p="a/b/c") == "a/b"
    assert one(spark, scalars.ancestors(F.col("p")), p="a/b/c.x") == [".", "a", "a/b"]
    assert one(spark, scalars.ancestors(F.col("p")), p="c.x") == ["."]
    assert one(spark, scalars.terminal_symbol(F.col("p")), p="a.b:C#d") == "d"
    assert one(spark, scalars.terminal_type(F.col("p")), p="*pkg/sub.Type[int]") == "Type"
    assert one(spark, scalars.label_key(F.col("p")), p="  Two  Words ") == "two-words"
    assert one(spark, scalars.trimmed(F.col("p")), p="  a b ") == "a b"
    assert one(spark, scalars.estimated_tokens(F.lit(5))) == 2
    assert one(spark, scalars.percent_change(F.lit(0.0), F.lit(1.0))) is None
    assert one(spark, scalars.segment(F.col("p"), ".", -1), p="a.b.c") == "c"
    assert one(spark, scalars.segment(F.col("p"), ".", 0), p="a.b.c") == "a"
    with pytest.raises(Exception, match="no such segment"):
        one(spark, scalars.segment(F.col("p"), ".", 3), p="a.b.c")
    assert one(spark, scalars.repo_id(F.col("p")), p="/a/b/c/d") == "a/b"
    assert one(spark, scalars.language_family(F.col("p")), p="tsx") == "typescript"


def test_languages(spark):
    for path, language in (("a/b.go", "go"), ("a.test.TSX", "tsx"), ("Makefile", "text"), ("a.b/c", "text")):
        assert one(spark, corpus.language_of(F.col("p")), p=path) == language


def test_repo_filter(spark):
    df = spark.createDataFrame([("a/b",), ("a/c",), ("x/b",)], ["repo"])
    keep = lambda **k: sorted(r[0] for r in df.where(patterns.repo_allowed(F.col("repo"), **k)).collect())
    assert keep() == ["a/b", "a/c", "x/b"]
    assert keep(include=["a/*"]) == ["a/b", "a/c"]
    assert keep(include=["a/*", "x/.*"], exclude=[".*/b"]) == ["a/c"]


def test_read_files(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.py").write_text("print(1)\n")
    (tmp_path / "a/b/y.bin").write_bytes(b"a\x00b")
    (tmp_path / "a/z.txt").write_bytes(b"caf\xe9")
    found = {r["path"]: r for r in corpus.read_files(spark, str(tmp_path)).collect()}
    assert set(found) == {"a/b/x.py", "a/z.txt"}
    assert found["a/b/x.py"]["language"] == "python" and found["a/b/x.py"]["repo"] == "a/b"
    assert found["a/z.txt"]["content"] == "caf�"
    assert [r["path"] for r in corpus.read_files(spark, str(tmp_path), ["**/*.py"]).collect()] == ["a/b/x.py"]
    assert corpus.in_memory(spark, "x").first()["path"] == "<stdin>"
