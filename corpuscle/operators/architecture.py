"""Directories, their relations, and boundaries between owners and their callers.

Sort keys: directories by path; relations by (from_dir, to_dir, kind); candidates by risk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions.patterns import matches_policy_path
from corpuscle.functions.scalars import ancestors, dirname
from corpuscle.operators.graph import STRONG

ALLOWED_CATEGORIES = ("utility-hub", "test-framework", "declarative-configuration", "lifecycle-cleanup", "adapter-protocol")
RISKS = ("critical", "high", "medium", "low", "informational", "none")
DOWNRANKING = ("utility-hub", "declarative-configuration", "lifecycle-cleanup", "adapter-protocol")


def directory_rollup(rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Measures of rows with a ``path``, summed over each directory above them and ``.``.

    Summed by own directory first: only directories are copied to what lies above them.
    """
    own = rows.groupBy(dirname(F.col("path")).alias("__d")).agg(*[F.sum(c.cast("long")).alias(n) for n, c in measures.items()])
    above = F.when(F.col("__d") == ".", F.array(F.lit("."))).otherwise(ancestors(F.concat("__d", F.lit("/x"))))
    return own.select(F.explode(above).alias("dir"), *measures).groupBy("dir").agg(*[F.sum(n).alias(n) for n in measures])


def relations(links: DataFrame) -> DataFrame:
    """(from_dir, to_dir, kind, relations, evidence) of links (from_path, to_path, kind, line).

    A link counts if its targets lie in one directory, which isn't the source's.
    """
    dirs = links.select(dirname(F.col("from_path")).alias("from_dir"), dirname(F.col("to_path")).alias("to_dir"), "kind", "from_path", "line", "link_id")
    one = dirs.groupBy("link_id", "from_dir", "kind", "from_path", "line").agg(F.min("to_dir").alias("to_dir"), F.max("to_dir").alias("other"))
    kept = one.where((F.col("to_dir") == F.col("other")) & (F.col("from_dir") != F.col("to_dir"))).select("from_dir", "to_dir", "kind", "from_path", "line").distinct()
    return kept.groupBy("from_dir", "to_dir", "kind").agg(F.count("*").alias("relations"), F.sort_array(F.collect_list(F.struct("from_path", "line"))).alias("evidence"))


def strong_call_links(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """Links of calls that resolved by more than a unique name."""
    target = declarations.select(F.col("id").alias("target_id"), F.col("path").alias("to_path"))
    strong = calls.where(F.col("confidence").isin(*STRONG))
    return strong.join(target, "target_id").select(F.col("id").alias("link_id"), F.col("path").alias("from_path"), "to_path", F.lit("call").alias("kind"), "line")


def responsibilities(found: DataFrame) -> DataFrame:
    """dir, outgoing, incoming."""
    both = found.select(F.explode(F.array(
        F.struct(F.col("from_dir").alias("dir"), F.col("relations").alias("outgoing"), F.lit(0).cast("long").alias("incoming")),
        F.struct(F.col("to_dir").alias("dir"), F.lit(0).cast("long").alias("outgoing"), F.col("relations").alias("incoming")),
    )).alias("x"))
    return both.groupBy("x.dir").agg(F.sum("x.outgoing").alias("outgoing"), F.sum("x.incoming").alias("incoming"))


def import_coverage(imports: DataFrame) -> DataFrame:
    """One row: distinct import statements by how many directories they lead to."""
    n = F.size(F.array_distinct(F.transform("target_paths", dirname)))
    each = imports.select("path", "import_path", "line", n.alias("n")).distinct()
    count = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    return each.agg(count(F.col("n") == 0).alias("unresolved"), count(F.col("n") == 1).alias("resolved"), count(F.col("n") > 1).alias("ambiguous"))


def owner_calls(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """(owner_path, caller_id, caller_path, callable, ord, language): calls into other files.

    A call with candidates counts if they agree on path, language and name.
    """
    targets = F.when(F.coalesce("target_id", F.lit("")) != "", F.array("target_id")).otherwise(F.col("candidate_target_ids"))
    each = calls.select("id", "caller_id", "line", F.explode(targets).alias("t"))
    d = declarations.select(F.col("id").alias("t"), F.col("path").alias("owner_path"), "language", F.substring_index("name", ".", -1).alias("callable"))
    agreed = each.join(d, "t").groupBy("id", "caller_id", "line").agg(F.min(F.struct("owner_path", "language", "callable")).alias("x"), F.max(F.struct("owner_path", "language", "callable")).alias("y")).where("x = y")
    caller = declarations.select(F.col("id").alias("caller_id"), F.col("path").alias("caller_path"))
    return agreed.join(caller, "caller_id").select("x.owner_path", "caller_id", "caller_path", "x.callable", F.struct("line", "id").alias("ord"), "x.language").where("owner_path <> caller_path")


def cousage(used: DataFrame, least: int = 2, least_files: int = 2) -> DataFrame:
    """Sets of callables of one owner that callers use together: owner, pattern, occurrences, files, packages.

    ``used``: owner, caller, caller_path, callable, ord.
    """
    return _patterns(_used_sets(used), least, least_files).drop("first_package", "last_package")


def _used_sets(used: DataFrame) -> DataFrame:
    return used.groupBy("owner", "caller", "caller_path").agg(F.array_sort(F.collect_set("callable")).alias("pattern")).where(F.size("pattern") > 1)


def sequences(used: DataFrame, least: int = 2, least_files: int = 2) -> DataFrame:
    """Orders in which callers use callables of one owner, with repeats."""
    return _patterns(_used_sequences(used), least, least_files).drop("first_package", "last_package")


def _used_sequences(used: DataFrame) -> DataFrame:
    return used.groupBy("owner", "caller", "caller_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "callable"))), lambda x: x["callable"]).alias("pattern")).where(F.size("pattern") > 1)


def combinations(calls: DataFrame, accesses: DataFrame, least: int = 2, least_files: int = 2) -> DataFrame:
    """Sets of calls and member accesses together; both kinds must be there."""
    return _patterns(_used_combinations(calls, accesses), least, least_files).drop("first_package", "last_package")


def _used_combinations(calls: DataFrame, accesses: DataFrame) -> DataFrame:
    label = lambda df, kind: df.select("owner", "caller", "caller_path", F.concat(F.lit(kind + ":"), F.col("callable" if kind == "call" else "member")).alias("label"), F.lit(kind).alias("kind"))
    sets = label(calls, "call").unionAll(label(accesses, "member")).groupBy("owner", "caller", "caller_path").agg(F.array_sort(F.collect_set("label")).alias("pattern"), F.min("kind").alias("k1"), F.max("kind").alias("k2"))
    return sets.where("k1 <> k2").drop("k1", "k2")


def _patterns(sets: DataFrame, least: int, least_files: int) -> DataFrame:
    package = dirname(F.col("caller_path"))
    by_file = sets.groupBy("owner", "pattern", "caller_path").agg(F.count("*").alias("n"))
    found = by_file.groupBy("owner", "pattern").agg(F.sum("n").alias("occurrences"), F.count("*").alias("files"), F.countDistinct(package).alias("packages"), F.min(package).alias("first_package"), F.max(package).alias("last_package"))
    return found.where((F.col("occurrences") >= least) & (F.col("files") >= least_files))


def unique_owner(types: DataFrame) -> DataFrame:
    """(name, language, owner_path) of type names that one file declares."""
    found = types.groupBy("name", "language").agg(F.min("path").alias("owner_path"), F.max("path").alias("other"))
    return found.where("owner_path = other").drop("other")


def breadth(used: DataFrame) -> DataFrame:
    """owner, functions, files, packages that use it."""
    return used.groupBy("owner").agg(F.countDistinct("caller").alias("functions"), F.countDistinct("caller_path").alias("files"), F.countDistinct(dirname(F.col("caller_path"))).alias("packages"))


def parallel_abstractions(used: DataFrame) -> DataFrame:
    """Owners of one language that offer the same callables, of which there are two or more: (language, callables, owners)."""
    offered = used.groupBy("language", "owner").agg(F.array_sort(F.collect_set("callable")).alias("callables")).where(F.size("callables") > 1)
    return offered.groupBy("language", "callables").agg(F.array_sort(F.collect_list("owner")).alias("owners")).where(F.size("owners") > 1)


def type_spread(usages: DataFrame, least_functions: int, least_files: int = 2) -> DataFrame:
    """(language, type, import_path, functions, files, test_files, roles...) of types that spread.

    ``usages``: language, type, import_path, function, path, role, is_test.
    """
    each = usages.select("language", "type", "import_path", "function", "path", "role", "is_test").distinct()
    role = lambda name: F.sum((F.col("role") == name).cast("long")).alias(f"{name}_uses")
    found = each.groupBy("language", "type", "import_path").agg(
        F.countDistinct("function").alias("functions"), F.countDistinct("path").alias("files"), F.countDistinct(F.when(F.col("is_test"), F.col("path"))).alias("test_files"),
        role("parameter"), role("result"), role("field"), role("local"),
    )
    return found.where((F.col("functions") >= least_functions) & (F.col("files") >= least_files))


def type_risk(origin: Column, exposed: Column) -> Column:
    """Risk by where a type comes from and whether it shows in public signatures."""
    return F.when((origin == "external") & exposed, "high").when(origin == "external", "medium").when((origin == "internal") & exposed, "medium").otherwise("low")


def by_risk(rows: DataFrame, *then: str) -> DataFrame:
    """Order by risk, score, and then the columns named."""
    rank = F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk"))
    return rows.orderBy(F.when(rank > 0, rank).otherwise(len(RISKS) + 1), F.desc("score"), *then)


def layer_of(path: Column, layers: Sequence[tuple[str, str]]) -> Column:
    """The first layer (name, path pattern) that holds a path."""
    out = F.when(F.lit(False), "")
    for name, pattern in layers:
        out = out.when(matches_policy_path(path, pattern), name)
    return out


def spread(uses: DataFrame, layers: Sequence[tuple[str, str]]) -> DataFrame:
    """owner_path, spread: over the layers, or else the packages, of an owner and all its consumers."""
    layer, package = layer_of(F.col("caller_path"), layers), dirname(F.col("caller_path"))
    by_owner = uses.groupBy("owner_path").agg(F.min(layer).alias("l1"), F.max(layer).alias("l2"), F.min(package).alias("p1"), F.max(package).alias("p2"))
    own, home = layer_of(F.col("owner_path"), layers), dirname(F.col("owner_path"))
    several = lambda low, high, x: F.least(low, x) != F.greatest(high, x)
    found = F.when(several(F.col("l1"), F.col("l2"), own), "cross-layer").when(several(F.col("p1"), F.col("p2"), home), "cross-package").otherwise("package-internal")
    return by_owner.select("owner_path", found.alias("spread"))


def containment(uses: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """owner_path, containment: the first rule (owner pattern, consumer pattern) of an owner decides.

    Escaped if any consumer is outside the rule's paths; without a rule, approved if all
    consumers are in the owner's directory, else unknown.
    """
    which, inside = F.when(F.lit(False), 0), F.when(F.lit(False), True)
    for i, (owner, consumer) in enumerate(rules):
        owned = matches_policy_path(F.col("owner_path"), owner)
        which, inside = which.when(owned, i), inside.when(owned, matches_policy_path(F.col("caller_path"), consumer))
    judged = uses.select("owner_path", which.alias("rule"), inside.alias("inside"), (dirname(F.col("owner_path")) == dirname(F.col("caller_path"))).alias("near"))
    by_owner = judged.groupBy("owner_path").agg(F.max("rule").alias("rule"), F.min("inside").alias("inside"), F.min("near").alias("near"))
    verdict = F.when(F.col("rule").isNotNull(), F.when(F.col("inside"), "contained").otherwise("escaped")).when(F.col("near"), "approved").otherwise("unknown")
    return by_owner.select("owner_path", verdict.alias("containment"))


def classified(path: Column, classes: Sequence[tuple[str, str]]) -> Column:
    """The first allowed category (name, path pattern) of a path."""
    unknown = {c for c, _ in classes} - set(ALLOWED_CATEGORIES)
    if unknown:
        raise ValueError(f"no such categories: {sorted(unknown)}")
    return layer_of(path, classes)


def facade_bypass(uses: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Calls that reach a facade's implementation from outside both: rule, owner_path, caller_path, callable.

    Rules are (name, facade pattern, implementation pattern); few, so they become conditions
    of the one scan, and nothing is joined.
    """
    hits = [
        F.when(matches_policy_path(F.col("owner_path"), inner) & ~matches_policy_path(F.col("caller_path"), inner) & ~matches_policy_path(F.col("caller_path"), facade), F.lit(name))
        for name, facade, inner in rules
    ]
    return uses.select(F.explode(F.array_compact(F.array(*hits))).alias("rule"), "owner_path", "caller_path", "callable")


def boundary_candidates(used: DataFrame, accesses: DataFrame | None = None, least: int = 2, classes: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Owners with patterns of use: owner, patterns, score, risk; sort key (risk, score desc, owner).

    The score sums a thousand for each file and one for each occurrence over all patterns: sets,
    orders, and with ``accesses`` combinations.  The risk is medium where the consumers in
    patterns lie in several packages, else low, and a step less for each category (name, path
    pattern) of ``classes`` that lowers it.
    """
    kinds = [_used_sets(used), _used_sequences(used), *([] if accesses is None else [_used_combinations(used, accesses)])]
    found = [_patterns(sets, least, 2).select("owner", "files", "occurrences", "first_package", "last_package") for sets in kinds]
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    by_owner = every.groupBy("owner").agg(
        F.count("*").alias("patterns"), F.sum(F.col("files") * 1000 + F.col("occurrences")).alias("score"), F.min("first_package").alias("p1"), F.max("last_package").alias("p2"),
    )
    lowering = {name: F.lit(False) for name, _ in classes if name in DOWNRANKING}
    for name, pattern in classes:
        if name in lowering:
            lowering[name] = lowering[name] | matches_policy_path(F.col("owner"), pattern)
    at = F.when(F.col("p1") != F.col("p2"), 1).otherwise(2)
    for hit in lowering.values():
        at = at + hit.cast("int")
    risk = F.get(F.array(*map(F.lit, ("medium", "low", "informational"))), F.least(at, F.lit(3)) - 1)
    return by_owner.select("owner", "patterns", "score", risk.alias("risk"))


def coverage_of(links: DataFrame, by: str) -> DataFrame:
    """Links by what they lead to, a row for each value of a column."""
    return links.groupBy(by).agg(F.count("*").alias("links"), F.countDistinct("to_path").alias("targets"))


def entrypoints(declarations: DataFrame) -> DataFrame:
    return declarations.where(F.coalesce(F.col("entrypoint"), F.lit("")) != "")


def narrow_evidence(found: DataFrame, from_dir: str, to_dir: str) -> DataFrame:
    """Why one directory relates to another."""
    return found.where((F.col("from_dir") == from_dir) & (F.col("to_dir") == to_dir)).select("kind", F.explode("evidence").alias("e")).select("kind", "e.from_path", "e.line")


def top_by(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
