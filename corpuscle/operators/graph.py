"""Code graphs: declarations, calls and their queries.

declarations(id, name, kind, language, path, package, visibility, entrypoint, start_line, end_line)
calls(id, caller_id, target_id, candidate_target_ids, name, confidence, import_path, language, path, line)

A call without a target leads to its candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions.scalars import is_test_path, language_family, terminal_symbol
from corpuscle.plans.traversal import reach

CONFIDENCES = ("exact", "import-resolved", "context-resolved", "unique-terminal", "candidate")
STRONG = CONFIDENCES[:3]
DIRECTIONS = ("callers", "callees", "dependencies", "dependents", "impact")
MOST_DEPTH = 10


def call_edges(calls: DataFrame) -> DataFrame:
    """(edge_id, src, dst): to the target, or else to each candidate."""
    targets = F.when(F.coalesce(F.col("target_id"), F.lit("")) != "", F.array("target_id")).otherwise(F.coalesce("candidate_target_ids", F.array().cast("array<string>")))
    return calls.select(F.col("id").alias("edge_id"), F.col("caller_id").alias("src"), F.explode(F.array_distinct(targets)).alias("dst"))


def traverse(calls: DataFrame, roots: DataFrame, direction: str, depth: int) -> DataFrame:
    """The calls that a traversal takes, with the level: callees and dependencies go down, the others up.

    For dependencies, dependents and impact, the first level leaves out calls between roots.
    """
    if direction not in DIRECTIONS or not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"no such traversal: {direction}, depth {depth}")
    edges = call_edges(calls)
    down = direction in ("callees", "dependencies")
    if not down:
        edges = edges.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    taken = reach(edges, roots, depth, direction in ("dependencies", "dependents", "impact"))
    return taken if down else taken.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "level")


def included_nodes(taken: DataFrame, roots: DataFrame) -> DataFrame:
    """All ends of the calls taken, and the roots."""
    ends = taken.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.unionAll(roots.select("node")).distinct()


def project(graph: dict[str, DataFrame], nodes: DataFrame, taken: DataFrame) -> dict[str, DataFrame]:
    """The part of a graph's tables that a traversal includes."""
    ids = nodes.select("node")
    declarations = graph["declarations"].join(ids, F.col("id") == F.col("node"), "left_semi")
    paths = declarations.select("path").distinct()
    out = {"declarations": declarations, "calls": graph["calls"].join(taken.select(F.col("edge_id").alias("id")).distinct(), "id", "left_semi")}
    owners = declarations.select(F.col("name").alias("owner_type"), "path").distinct()
    for name, df in graph.items():
        if name == "fields":
            out[name] = df.join(owners, ["owner_type", "path"], "left_semi")
        elif name in ("type_usages", "member_accesses"):
            out[name] = df.join(ids, F.col("caller_id") == F.col("node"), "left_semi")
        elif name in ("imports", "exports", "type_declarations"):
            out[name] = df.join(paths, "path", "left_semi")
    return out


def select_roots(declarations: DataFrame, symbol: str = "", package: str = "", module: str = "", path_prefix: str = "", at: tuple[str, int] | None = None) -> DataFrame:
    """Roots (node) by exactly one selector; a symbol or a place must be one declaration."""
    chosen = [x for x in (symbol, package, module, path_prefix, at) if x]
    if len(chosen) != 1:
        raise ValueError("exactly one selector is asked for")
    if symbol:
        found = declarations.where((F.col("name") == symbol) | (terminal_symbol(F.col("name")) == symbol))
    elif at:
        held = declarations.where((F.col("path") == at[0]) & F.lit(at[1]).between(F.col("start_line"), F.col("end_line"))).withColumn("__w", F.col("end_line") - F.col("start_line"))
        found = held.withColumn("__r", F.rank().over(Window.partitionBy("path").orderBy("__w"))).where("__r = 1")
    elif package:
        found = declarations.where((F.col("package") == package) | (F.col("package_id") == package) if "package_id" in declarations.columns else F.col("package") == package)
    elif module:
        found = declarations.where(F.col("module_id") == module)
    else:
        found = declarations.where((F.col("path") == path_prefix) | F.col("path").startswith(path_prefix.rstrip("/") + "/"))
    if symbol or at:
        choices = [r[0] for r in found.select("id").limit(11).collect()]
        if len(choices) != 1:
            raise ValueError(f"{symbol or at}: {len(choices)} declarations, of which {sorted(choices)[:10]}")
    return found.select(F.col("id").alias("node"))


def filter_graph(declarations: DataFrame, calls: DataFrame, languages: Sequence[str] = (), confidences: Sequence[str] = (), visibilities: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Declarations and calls of the domains; calls whose caller or target went go too, and candidates that went are taken out."""
    unknown = set(confidences) - set(CONFIDENCES)
    if unknown:
        raise ValueError(f"no such confidences: {sorted(unknown)}")

    def any_of(column: str, wanted: Sequence[str]) -> Column:
        return F.col(column).isin(*wanted) if wanted else F.lit(True)

    kept = declarations.where(any_of("language", languages) & any_of("visibility", visibilities))
    ids = kept.select(F.col("id").alias("__id"))
    left = calls.where(any_of("language", languages) & any_of("confidence", confidences)).join(ids, F.col("caller_id") == F.col("__id"), "left_semi")
    has_target = F.coalesce(F.col("target_id"), F.lit("")) != ""
    resolved = left.where(has_target).join(ids, F.col("target_id") == F.col("__id"), "left_semi")
    others = left.where(~has_target)
    still = others.select("id", F.posexplode("candidate_target_ids").alias("n", "__c")).join(ids, F.col("__c") == F.col("__id"), "left_semi")
    still = still.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "__c"))), lambda x: x["__c"]).alias("__kept"))
    pruned = others.join(still, "id", "left").withColumn("candidate_target_ids", F.coalesce("__kept", F.array().cast("array<string>"))).select(*calls.columns)
    return kept, resolved.select(*calls.columns).unionAll(pruned)


def diff(before: DataFrame, after: DataFrame, key: list[str], order: list[str], compared: list[str]) -> DataFrame:
    """Rows of two graphs paired by key, the k-th with the k-th: added, removed, moved (another path) or changed.

    Columns: the key, ``n``, ``change``, and ``before_``/``after_`` path.
    """
    by_key = Window.partitionBy(*key).orderBy(*order)

    def side(df: DataFrame, name: str) -> DataFrame:
        numbered = df.withColumn("n", F.row_number().over(by_key))
        return numbered.select(*key, "n", F.col("path").alias(f"{name}_path"), F.struct(*compared).alias(f"__{name}"), F.lit(True).alias(f"__in_{name}"))

    joined = side(before, "before").join(side(after, "after"), [*key, "n"], "full")
    change = (
        F.when(F.col("__in_before").isNull(), "added").when(F.col("__in_after").isNull(), "removed")
        .when(F.col("before_path") != F.col("after_path"), "moved").when(~F.col("__before").eqNullSafe(F.col("__after")), "changed")
    )
    return joined.withColumn("change", change).where("change is not null").select(*key, "n", "change", "before_path", "after_path")


def resolution_stats(calls: DataFrame) -> DataFrame:
    """Calls in all (language null) and by language family: by target and candidates, by outcome, and their rates.

    Without a target, several candidates are ambiguous; none, where the call names an import, is
    expected to be external; all else is unresolved, one candidate too.
    """
    has_target = F.coalesce(F.col("target_id"), F.lit("")) != ""
    n = F.size(F.coalesce("candidate_target_ids", F.array().cast("array<string>")))
    several, external = ~has_target & (n > 1), ~has_target & (n == 0) & (F.coalesce(F.col("import_path"), F.lit("")) != "")
    flags = {
        "resolved": has_target, "ambiguous": several, "candidate": ~has_target & (n == 1), "unresolved": ~has_target & (n == 0),
        "resolved_local": has_target, "ambiguous_local": several, "expected_external": external, "unresolved_local": ~has_target & (n < 2) & ~external,
    }
    marked = calls.select(language_family(F.col("language")).alias("language"), *[flag.alias(name) for name, flag in flags.items()])
    grouped = marked.groupingSets([[], [F.col("language")]], F.col("language")).agg(F.count("*").alias("calls"), *[F.sum(F.col(c).cast("long")).alias(c) for c in flags])
    rate = lambda c, name: F.round(F.when(F.col("calls") > 0, F.col(c) / F.col("calls")).otherwise(0.0), 6).alias(name)
    rates = [rate("ambiguous", "ambiguity_rate"), rate("resolved_local", "resolution_rate"), *[rate(c, f"{c}_rate") for c in ("ambiguous_local", "unresolved_local", "expected_external")]]
    return grouped.select("language", "calls", *flags, *rates)


def confidence_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy(language_family(F.col("language")).alias("language"), "confidence").agg(F.count("*").alias("calls"))


def resolve_calls(calls: DataFrame, declarations: DataFrame, imported_packages: DataFrame | None = None) -> DataFrame:
    """Calls with candidates, target and confidence, by stages that each narrow only where they leave something.

    Candidates are declarations of the same language family and terminal name.  Then, in order:
    those of the imported package; those whose container is the receiver's type; the one whose
    full name is what the call displays; functions, for a display without a dot; the caller's own
    file.  A call with one candidate left has that as its target and no candidates; any other
    has the confidence ``candidate``.
    """
    c = calls.select("id", language_family(F.col("language")).alias("__f"), terminal_symbol(F.col("name")).alias("__t"), "display", "import_path", "receiver_type", F.col("path").alias("__path"))
    d = declarations.select(F.col("id").alias("did"), language_family(F.col("language")).alias("__f"), terminal_symbol(F.col("name")).alias("__t"), F.col("name").alias("dname"), "kind", "container", "package", F.col("path").alias("dpath"))
    every = c.join(d, ["__f", "__t"])
    of_call = Window.partitionBy("id")

    def left() -> Column:
        return F.count("*").over(of_call)

    def narrow(rows: DataFrame, flag: Column, label: str | None, only_one: bool = False) -> DataFrame:
        """Keep flagged candidates where there are any (``only_one``: and label only if one is left of several)."""
        marked = rows.withColumn("__hit", F.coalesce(flag, F.lit(False))).withColumn("__n", left()).withColumn("__hits", F.sum(F.col("__hit").cast("int")).over(of_call))
        kept = marked.where((F.col("__hits") == 0) | F.col("__hit"))
        if label:
            decides = (F.col("__hits") > 0) if not only_one else (F.col("__hits") == 1) & (F.col("__n") > 1)
            kept = kept.withColumn("label", F.when(decides, F.coalesce("label", F.lit(label)) if only_one else F.lit(label)).otherwise(F.col("label")))
        return kept.drop("__hit", "__n", "__hits")

    rows = every.withColumn("label", F.lit(None).cast("string"))
    has = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    rows = narrow(rows, has("import_path") & (F.col("package") == F.col("import_path")), "import-resolved")
    rows = narrow(rows, has("receiver_type") & (F.col("container") == F.col("receiver_type")), "context-resolved")
    qualified = F.col("display").rlike("[.:#]")
    exact = qualified & (F.col("dname") == F.col("display"))
    rows = rows.withColumn("__e", F.sum(exact.cast("int")).over(of_call))
    rows = rows.where((F.col("__e") == 0) | exact).withColumn("label", F.when(F.col("__e") == 1, "exact").otherwise(F.col("label"))).drop("__e")
    rows = narrow(rows, ~F.col("display").contains(".") & F.col("kind").isin("func", "function"), "context-resolved", only_one=True)
    rows = narrow(rows, F.col("dpath") == F.col("__path"), "context-resolved", only_one=True)
    final = rows.groupBy("id").agg(F.sort_array(F.collect_set("did")).alias("found"), F.max("label").alias("label"))
    one = F.size("found") == 1
    joined = calls.drop("target_id", "candidate_target_ids", "confidence").join(final, "id", "left")
    confidence = F.when(one, F.coalesce("label", F.lit("unique-terminal"))).otherwise("candidate")
    return (
        joined.withColumn("confidence", confidence).withColumn("target_id", F.when(one, F.element_at("found", 1)))
        .withColumn("candidate_target_ids", F.when(one | F.col("found").isNull(), F.array().cast("array<string>")).otherwise(F.col("found"))).drop("found", "label")
    )


def resolve_imports(imports: DataFrame, declarations: DataFrame) -> DataFrame:
    """Imports with ``target_paths``: the files of the package that they name."""
    files = declarations.select(F.col("package").alias("import_path"), F.col("path").alias("__p")).where("import_path <> ''").distinct().groupBy("import_path").agg(F.sort_array(F.collect_set("__p")).alias("target_paths"))
    return imports.drop("target_paths").join(files, "import_path", "left").withColumn("target_paths", F.coalesce("target_paths", F.array().cast("array<string>")))


def promoted_types(fields: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """(owner_type, type, level): types that a type embeds, and what those embed."""
    own = fields.where("embedded").select(F.concat_ws("\x1f", "owner_type", "type").alias("edge_id"), F.col("owner_type").alias("src"), F.col("type").alias("dst")).distinct()
    out, step = own.select("src", "dst").withColumn("level", F.lit(1)), own.select("src", "dst")
    for level in range(2, depth + 1):
        step = step.alias("a").join(own.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")).where("src <> dst").distinct()
        step = step.join(out.select("src", "dst"), ["src", "dst"], "left_anti")
        if not step.limit(1).count():
            break
        out = out.unionAll(step.withColumn("level", F.lit(level)))
    return out.select(F.col("src").alias("owner_type"), F.col("dst").alias("type"), "level")


def field_chain(receivers: DataFrame, fields: DataFrame) -> DataFrame:
    """(id, receiver_type) after walking ``receiver_members`` one at a time; a step needs exactly one field."""
    only = fields.groupBy(F.col("owner_type").alias("__o"), F.col("name").alias("__n")).agg(F.min("type").alias("__t"), F.countDistinct("type", "path").alias("__c")).where("__c = 1").drop("__c")
    now = receivers.select("id", "receiver_type", "receiver_members")
    for i in range(receivers.agg(F.max(F.size("receiver_members"))).first()[0] or 0):
        member = F.get("receiver_members", i)
        stepped = now.withColumn("__m", member).join(only, (F.col("receiver_type") == F.col("__o")) & (F.col("__m") == F.col("__n")), "left")
        now = stepped.select("id", F.when(F.col("__m").isNull(), F.col("receiver_type")).otherwise(F.col("__t")).alias("receiver_type"), "receiver_members")
    return now.select("id", F.when(F.col("receiver_members").isNotNull(), F.col("receiver_type")).alias("receiver_type"))


def related_calls(hits: DataFrame, calls: DataFrame, declarations: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Of declarations hit (node, hit_line): callees by distance to a hit, and callers, tests last; at most ``most`` each, with the number left out."""
    near = hits.join(calls, F.col("caller_id") == F.col("node")).where("target_id is not null").groupBy("node", F.col("target_id").alias("other")).agg(F.min(F.abs(F.col("line") - F.col("hit_line"))).alias("distance"), F.min("line").alias("line"))
    accepted = calls.where(F.col("confidence").isin(*STRONG, "unique-terminal", "unique"))
    callers = hits.select("node").distinct().join(accepted, F.col("target_id") == F.col("node")).select("node", F.col("caller_id").alias("other"), "path", "line").groupBy("node", "other").agg(F.min(F.struct("path", "line")).alias("p"))

    def cut(rows: DataFrame, order: list) -> DataFrame:
        of_node = Window.partitionBy("node")
        ranked = rows.withColumn("n", F.row_number().over(of_node.orderBy(*order))).withColumn("omitted", F.greatest(F.count("*").over(of_node) - most, F.lit(0)))
        return ranked.where(F.col("n") <= most)

    return cut(near, ["distance", "line", "other"]).select("node", "other", "distance", "n", "omitted"), cut(callers, [is_test_path(F.col("p.path")), "p.path", "p.line", "other"]).select("node", "other", "n", "omitted")


def language_groups(links: DataFrame) -> dict[str, str]:
    """Languages (a, b) linked by any fact, each with the least name it is linked to; languages are few."""
    parent: dict[str, str] = {}

    def top(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links.select("a", "b").distinct().collect():
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    return {x: top(x) for x in parent}
