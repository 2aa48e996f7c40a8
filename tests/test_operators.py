from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import architecture, graph, intervals, journal, metadata, relations, rules, search, structure
from corpuscle.sources import journals, manifests
from corpuscle.streaming import journal_stream

FACT = "row_id long, ord long, path string, grp string, part string, key string"


def facts(spark, rows):
    return spark.createDataFrame([(i, i, *r) for i, r in enumerate(rows)], FACT)


@pytest.mark.parametrize("unique", [False, True])
def test_pairs_against_loops(spark, unique):
    rnd = random.Random(7)
    draw = lambda n: [(rnd.choice("pqr"), rnd.choice(["", "g"]), "", rnd.choice("ab")) for _ in range(n)]
    left, right = draw(25), draw(25)
    wanted = set()
    for j, (path, grp, part, key) in enumerate(right):
        same = [i for i, x in enumerate(left) if x[1:] == (grp, part, key)]
        if unique and len(same) != 1:
            continue
        first = next((i for i in same if left[i][0] != path), None)
        if first is not None:
            wanted.add((first, j))
    found = relations.pairs(facts(spark, left), facts(spark, right), unique).select("left_row_id", "right_row_id").collect()
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)


def test_golden_pair_of_one_name(spark):
    rows = facts(spark, [("pkg/a.go", "pkg", "", "thing"), ("pkg/b.go", "pkg", "", "thing")])
    assert {(r["left_path"], r["right_path"]) for r in relations.pairs(rows, rows).collect()} == {("pkg/a.go", "pkg/b.go"), ("pkg/b.go", "pkg/a.go")}


def test_unmatched(spark):
    left, right = facts(spark, [("a", "", "", "x"), ("a", "", "", "y")]), facts(spark, [("a", "", "", "x")])
    assert [r["key"] for r in relations.unmatched_left(left, right).collect()] == ["y"]
    many = spark.createDataFrame([(0, "", "", ["x", "z"], False), (1, "", "", ["z"], False), (2, "", "", [], False), (3, "", "", ["z"], True)], "row_id long, grp string, part string, keys array<string>, satisfied boolean")
    assert sorted(r["row_id"] for r in relations.unmatched_left_any(many, right).collect()) == [1, 2]


def test_partitions(spark):
    rows = spark.createDataFrame([("a",), ("b",)], ["path"])
    parts = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], ["path", "value"])
    assert sorted(tuple(r) for r in relations.assign_partitions(rows, parts).select("path", "part").collect()) == [("a", "1"), ("b", "2")]
    with pytest.raises(Exception, match="conflicting"):
        relations.assign_partitions(rows, parts.unionAll(spark.createDataFrame([("a", "9")], ["path", "value"]))).collect()
    with pytest.raises(Exception, match="no partition"):
        relations.assign_partitions(rows, parts.where("path = 'a'")).collect()
    with pytest.raises(ValueError):
        relations.complete_only(rows, rows)


def test_natural_join(spark):
    schema = "candidate long, start_byte int, end_byte int, v string"
    a, b = spark.createDataFrame([(1, 5, 9, "x"), (2, 0, 1, "y")], schema), spark.createDataFrame([(1, 2, 7, "x"), (2, 3, 4, "z")], schema)
    assert [tuple(r) for r in relations.natural_join(a, b, ["v"]).select("candidate", "start_byte", "end_byte").collect()] == [(1, 2, 9)]


def random_graph(seed):
    rnd = random.Random(seed)
    calls = []
    for i in range(18):
        names = [f"d{rnd.randrange(10)}" for _ in range(4)]
        calls.append((f"c{i}", names[0], "" if i % 3 == 0 else names[1], [names[2], names[3]] if i % 3 == 0 else [], "n", "exact", "", "go", "p", i))
    return calls


CALL = "id string, caller_id string, target_id string, candidate_target_ids array<string>, name string, confidence string, import_path string, language string, path string, line int"


@pytest.mark.parametrize("direction", graph.DIRECTIONS)
def test_traversal_against_loops(spark, direction):
    for seed in (1, 2):
        calls = random_graph(seed)
        roots = ["d0", "d1"]
        edges = {(c[0], c[1], t) for c in calls for t in ([c[2]] if c[2] else c[3])}
        down = direction in ("callees", "dependencies")
        frontier, visited, wanted = set(roots), set(roots), {}
        for level in (1, 2, 3):
            after = set()
            for e, s, d in edges:
                here, there = (s, d) if down else (d, s)
                if here in frontier and not (level == 1 and direction not in ("callers", "callees") and there in roots):
                    wanted.setdefault((e, s, d), level)
                    after.add(there)
            frontier = after - visited
            visited |= after
        found = graph.traverse(spark.createDataFrame(calls, CALL), spark.createDataFrame([(r,) for r in roots], ["node"]), direction, 3)
        assert {(r["edge_id"], r["src"], r["dst"]): r["level"] for r in found.collect()} == wanted
    with pytest.raises(ValueError):
        graph.traverse(None, None, direction, 11)


def test_filter_prunes(spark):
    decls = spark.createDataFrame([("d0", "go", "public"), ("d1", "go", "public"), ("d2", "go", "private")], "id string, language string, visibility string")
    calls = spark.createDataFrame([("c0", "d0", "d1", [], "n", "exact", "", "go", "p", 1), ("c1", "d0", "d2", [], "n", "exact", "", "go", "p", 1), ("c2", "d0", "", ["d2", "d1"], "n", "candidate", "", "go", "p", 1), ("c3", "d2", "d1", [], "n", "exact", "", "go", "p", 1)], CALL)
    kept, left = graph.filter_graph(decls, calls, visibilities=["public"])
    assert {r["id"] for r in kept.collect()} == {"d0", "d1"}
    assert {r["id"]: r["candidate_target_ids"] for r in left.collect()} == {"c0": [], "c2": ["d1"]}
    with pytest.raises(ValueError):
        graph.filter_graph(decls, calls, confidences=["sure"])


def test_resolution_cascade(spark):
    decls = spark.createDataFrame([
        ("a", "pkg.run", "function", "go", "", "pkg", "x.go"), ("b", "T.run", "method", "go", "T", "pkg", "y.go"), ("c", "other.run", "method", "go", "U", "other", "z.go"),
        ("d", "solo", "function", "go", "", "pkg", "x.go"), ("e", "m.dup", "method", "go", "", "pkg", "x.go"), ("f", "k.dup", "method", "go", "", "pkg", "y.go"), ("g", "run", "function", "python", "", "", "q.py"),
    ], "id string, name string, kind string, language string, container string, package string, path string")
    schema = "id string, name string, display string, import_path string, receiver_type string, language string, path string, target_id string, candidate_target_ids array<string>, confidence string"
    rows = [
        ("1", "run", "run", "other", "", "go", "w.go"), ("2", "run", "run", "", "T", "go", "w.go"), ("3", "run", "pkg.run", "", "", "go", "w.go"), ("4", "run", "run", "", "", "go", "w.go"),
        ("5", "solo", "solo", "", "", "go", "w.go"), ("6", "dup", "q.dup", "", "", "go", "w.go"), ("7", "dup", "q.dup", "", "", "go", "y.go"), ("8", "none", "none", "", "", "go", "w.go"),
    ]
    found = {r["id"]: (r["target_id"], r["confidence"], r["candidate_target_ids"]) for r in graph.resolve_calls(spark.createDataFrame([(*r, None, [], None) for r in rows], schema), decls).collect()}
    assert found["1"] == ("c", "import-resolved", [])
    assert found["2"][:2] == ("b", "context-resolved")
    assert found["3"][:2] == ("a", "exact")
    assert found["4"][:2] == ("a", "context-resolved")
    assert found["5"][:2] == ("d", "unique-terminal")
    assert found["6"] == (None, "candidate", ["e", "f"])
    assert found["7"][:2] == ("f", "context-resolved")
    assert found["8"] == (None, "candidate", [])


def test_long_texts_and_long_field_chains(spark):
    from corpuscle.operators import structure

    assert structure.json_nodes(f'["{"x" * 300}a"]') != structure.json_nodes(f'["{"x" * 300}b"]')
    fields = spark.createDataFrame([(f"T{i}", "m", f"T{i + 1}", "f", True) for i in range(12)], "owner_type string, name string, type string, path string, embedded boolean")
    calls = spark.createDataFrame([("1", "T0", ["m"] * 6), ("2", "T0", [])], "id string, receiver_type string, receiver_members array<string>")
    assert {r["id"]: r["receiver_type"] for r in graph.field_chain(calls, fields).collect()} == {"1": "T6", "2": "T0"}


def test_field_chains_and_promoted_types(spark):
    fields = spark.createDataFrame([("A", "b", "B", "p", False), ("B", "c", "C", "p", False), ("X", "Y", "Y", "p", True), ("Y", "Z", "Z", "p", True), ("Z", "X", "X", "p", True)], "owner_type string, name string, type string, path string, embedded boolean")
    calls = spark.createDataFrame([("1", "A", ["b", "c"]), ("2", "A", ["no"]), ("3", "A", [])], "id string, receiver_type string, receiver_members array<string>")
    assert {r["id"]: r["receiver_type"] for r in graph.field_chain(calls, fields).collect()} == {"1": "C", "2": None, "3": "A"}
    assert {(r["owner_type"], r["type"]) for r in graph.promoted_types(fields).collect()} == set(itertools.permutations("XYZ", 2))


def test_roots(spark):
    decls = spark.createDataFrame([("1", "a.f", "p", "a/x.go", 1, 9), ("2", "a.g", "p", "a/x.go", 3, 5), ("3", "b.f", "q", "b/y.go", 1, 2)], "id string, name string, package string, path string, start_line int, end_line int")
    of = lambda **k: sorted(r[0] for r in graph.select_roots(decls, **k).collect())
    assert of(symbol="g") == ["2"] and of(at=("a/x.go", 4)) == ["2"] and of(package="p") == ["1", "2"] and of(path_prefix="b") == ["3"]
    with pytest.raises(ValueError, match="2 declarations"):
        of(symbol="f")
    with pytest.raises(ValueError):
        of()
    assert graph.language_groups(spark.createDataFrame([("go", "c"), ("c", "asm"), ("py", "py")], ["a", "b"])) == {"go": "asm", "c": "asm", "asm": "asm", "py": "py"}


def test_narrowest_and_overlap(spark):
    points = spark.createDataFrame([("p", 70), ("p", 300), ("q", 1)], "path string, line int")
    ranges = spark.createDataFrame([("p", 1, 500, "all"), ("p", 60, 80, "in"), ("p", 65, 85, "tie")], "path string, start_line int, end_line int, name string")
    found = sorted((r["line"], r["name"], r["ambiguous"]) for r in intervals.narrowest(points, ranges, ["path", "line"]).collect())
    assert found == [(70, "in", True), (70, "tie", True), (300, "all", False)]
    scopes = {r["line"]: (r["nearest"], r["scope"]) for r in intervals.enclosing_scopes(points, ranges, ["path", "line"]).collect()}
    assert scopes == {70: ("in", "all"), 300: ("all", "all")}
    b = ranges.select("path", F.col("start_line").alias("b_start"), F.col("end_line").alias("b_end"), F.col("name").alias("b"))
    assert sum(1 for _ in intervals.overlapping(ranges, b).collect()) == 9
    symbols = spark.createDataFrame([("p", "f", 10, 12, "s")], "path string, name string, start_line int, end_line int, symbol_id string")
    decls = spark.createDataFrame([("p", "f", 1, 99, "wide"), ("p", "f", 9, 13, "narrow"), ("p", "f", 50, 60, "off")], "path string, name string, start_line int, end_line int, id string")
    assert intervals.narrowest_overlap(symbols, decls).first()["declaration_id"] == "narrow"
    assert [r["end_line"] for r in intervals.starting_at(points, spark.createDataFrame([("p", 70, 75), ("p", 70, 70)], "path string, start_line int, end_line int")).collect()] == [75]


def test_segments_and_spacing(spark):
    lines = spark.createDataFrame([("r", "p", "text", i, t) for i, t in enumerate(["x", "", "x", "y", "", "", "", "x"], 1)], "repo string, path string, language string, line int, text string")
    hits = lines.where("text = 'x'")
    assert sorted((r["start_line"], r["end_line"]) for r in search.spacing_segments(search.segments(hits), lines).collect()) == [(2, 2)]
    assert search.parse_location("a/b.go:3-5") == ("a/b.go", 3, 5)
    with pytest.raises(ValueError):
        search.parse_location("a/b.go:5-3")
    assert [search.page_size(n) for n in (None, 0, 7, 101)] == [20, 100, 7, 100] and search.effective_limit(0, 5) == 5
    assert search.read_range(lines, "p", 2, 3).count() == 2


def test_suppressions(spark):
    text = ["// lint:ignore r1 because", "// more", "x := 1", "y // lint:ignore r2 reason", "z", "// lint:ignore r3", "w"]
    lines = spark.createDataFrame([("p", i, t) for i, t in enumerate(text, 1)], "path string, line int, text string")
    found = rules.suppressed_lines(lines)
    assert {(r["line"], r["rule"]) for r in found.collect()} == {(1, "r1"), (3, "r1"), (4, "r2")}
    findings = spark.createDataFrame([("p", 3, "r1"), ("p", 3, "r2"), ("p", 7, "r3")], "path string, line int, rule string")
    assert rules.unsuppressed(findings, found).count() == 2 and rules.unsuppressed(findings, found, always=["r1"]).count() == 3
    assert rules.annotated_only(findings, lines, "// more").count() == 2
    assert rules.changed_only(findings, lines.where("path = 'q'")).count() == 0


def test_memories(spark):
    rows = spark.createDataFrame([("a/b/c.go", "a/"), ("a/c.go", "a/*.go"), ("a/b/c.go", "a/*.go"), ("a/b/c.go", "a/**/c.go"), ("c.go", "*.go"), ("b/c.go", "*.go")], ["path", "scope"])
    assert [r[0] for r in rows.select(metadata.scope_holds(F.col("path"), F.col("scope"))).collect()] == [True, True, False, True, True, False]


def test_journal_files(spark, tmp_path):
    event = lambda i, **k: json.dumps({"schema": "v1", "eventId": str(i), "time": "2024-01-01T00:00:00Z", "runId": "r", "event": "tool_call", "data": {"callId": "c"}} | k)
    (tmp_path / "good").mkdir()
    (tmp_path / "good/a.jsonl").write_text(event(1) + "\n\n" + event(2) + "\n")
    events = journals.read_journal(spark, str(tmp_path / "good"))
    assert journals.payload(events, "tool_call", "callId string").select("callId").distinct().collect() == [("c",)]
    assert journals.repeated_events(events).count() == 0
    for i, bad in enumerate((event(1, extra=1), event(1, event="no"), "[1]")):
        (tmp_path / f"bad{i}.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception, match="field|event|object"):
            journals.read_journal(spark, str(tmp_path / f"bad{i}.jsonl")).collect()
    described = journals.spill(events, str(tmp_path / "out")).collect()
    assert described and all(len(r["sha256"]) == 64 for r in described)


def test_graph_store(spark, tmp_path):
    calls = spark.createDataFrame(random_graph(3), CALL)
    journals.save_graph({"calls": calls}, str(tmp_path), "k")
    assert journals.open_graph(spark, str(tmp_path), "k", ["calls"])["calls"].count() == 18


def test_call_results(spark):
    calls = spark.createDataFrame([("r", 1), ("r", 2)], ["run_id", "call_id"])
    results = spark.createDataFrame([("r", 1, True)], ["run_id", "call_id", "ok"])
    assert journal.call_results(calls, results).count() == 1
    with pytest.raises(Exception, match="several"):
        journal.call_results(calls, results.unionAll(results)).collect()
    with pytest.raises(ValueError):
        journal.call_results(calls, spark.createDataFrame([("r", 9, True)], ["run_id", "call_id", "ok"]))


def test_distribution_interpolates(spark):
    r = journal.distribution(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], ["v"]), [], "v").first()
    assert (r["mean"], r["median"], r["p90"]) == (4.0, 2.5, 7.9)


def test_manifests(spark):
    files = spark.createDataFrame([
        ("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.0 // indirect\n)\nrequire c.d/e v0.1.0\n"), ("w/package-lock.json", json.dumps({"packages": {"": {}, "node_modules/@s/n": {"version": "1", "integrity": "i"}}})),
        ("Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0"\nchecksum = "c"\n'), ("pom.xml", "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>2</version></dependency></dependencies></project>"), ("b/Cargo.lock", "[[["), ("other.txt", ""),
    ], ["path", "content"])
    found = manifests.dependencies(files)
    assert {(r["module"], r["version"]) for r in found.collect()} == {("github.com/a/b", "v1.2.0"), ("c.d/e", "v0.1.0"), ("@s/n", "1"), ("serde", "1.0"), ("g:a", "2"), (None, None)}
    imports = spark.createDataFrame([("github.com/a/b/sub",), ("nope",)], ["name"])
    assert [tuple(r) for r in manifests.qualified_imports(imports, found).select("name", "modules", "exact").collect()] == [("github.com/a/b/sub", ["github.com/a/b@v1.2.0"], True)]


PYTHON = '''
def f(x):
    if x:
        for y in x:
            if y:
                pass

class C:
    def m(self):
        return 1
'''


def test_python_nodes(spark):
    files = spark.createDataFrame([("a.py", "python", PYTHON), ("b.py", "python", "def ("), ("c.md", "markdown", "# A\n## B\ntext\n# C"), ("d.json", "json", '{"a": [1, true]}'), ("e.go", "go", "x")], ["path", "language", "content"])
    n = structure.nodes(files).cache()
    outline = {r["name"]: (r["level"], r["start_line"]) for r in structure.outline(n.where("path = 'a.py'"), ["FunctionDef", "ClassDef"]).collect()}
    assert outline == {"f": (0, 2), "C": (0, 8), "m": (1, 9)}
    kind = F.col("kind")
    score = structure.metric(n.where("path = 'a.py'"), kind == "FunctionDef", F.when(kind.isin("If", "For"), 1).otherwise(0), kind.isin("If", "For"))
    assert {r["scope_name"]: r["score"] for r in score.collect()} == {"f": 1 + 2 + 3, "m": 0}
    assert [r["text"] for r in n.where("path = 'c.md'").orderBy("pre").collect()] == ["A", "B", "C"]
    assert n.where("path in ('b.py', 'e.go')").count() == 0 and n.where("path = 'd.json'").count() == 4
    assert structure.containing(structure.of_kind(n, "FunctionDef"), structure.of_kind(n, "Return")).first()["text"] == "m"
    forms = structure.normal_form(n.where("path = 'a.py' and kind = 'If' or kind = 'Name'"))
    assert forms.count() > 0


def test_markup_offsets_are_bytes(spark):
    n = structure.nodes(spark.createDataFrame([("p", "html", "<p>é</p><b>x</b><br>")], ["path", "language", "content"]))
    assert {r["kind"]: r["start_byte"] for r in n.where("kind <> 'text'").collect()} == {"p": 0, "b": 9, "br": 17}


def test_containment_and_risk(spark):
    uses = spark.createDataFrame([("a/x", "a/y"), ("b/x", "c/y"), ("r/x", "r/y"), ("r/x", "z/y")], ["owner_path", "caller_path"])
    assert {r[0]: r[1] for r in architecture.containment(uses, [("r", "r/**")]).collect()} == {"a/x": "approved", "b/x": "unknown", "r/x": "escaped"}
    with pytest.raises(ValueError):
        architecture.classified(F.col("p"), [("no-such", "a")])


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 7 as int), 0) AS time, cast(id % 3 as string) AS run_id, CASE WHEN id < 3 THEN 'run_start' ELSE 'tool_call' END AS event FROM range(60)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = journal_stream.running_summary(stream).writeStream.outputMode("complete").format("memory").queryName("summary").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("summary").collect())) == sorted(map(tuple, journal_stream.running_summary(rows).collect()))
    q = journal_stream.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, journal_stream.windowed_counts(rows).collect()))
