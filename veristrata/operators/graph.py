"""Reachability, shortest paths and components over edge tables, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from veristrata.session import cut, release

#: Levels between two anchors of a path.
STRIDE = 8
#: Nodes of a level that a broadcast takes to the edges.
FEW = 10_000


def reachable(edges: DataFrame, roots: DataFrame, by: list[str] | None = None, most_levels: int | None = None) -> DataFrame:
    """by, node, depth: all nodes that roots (by, node) reach over edges (by, src, dst), at their least depth. Cycles are fine.

    The search ends when nothing new is found. With most_levels it may end before, and then every row says so: the
    column `incomplete` is added, and nodes that are missing are not proven unreachable.
    """
    by = by or []
    keys = [*by, "node"]
    seen = cut(roots.select(*keys).distinct().withColumn("depth", F.lit(0)))
    frontier, depth, whole = seen, 0, False
    steps = edges.select(*by, F.col("src").alias("node"), F.col("dst").alias("to")).distinct()
    while most_levels is None or depth < most_levels:
        depth += 1
        step = frontier.join(steps, keys).select(*by, F.col("to").alias("node")).distinct()
        frontier = cut(step.join(seen.select(*keys), keys, "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            whole = True
            break
        seen = seen.union(frontier)
        if depth % 8 == 0:
            seen = cut(seen)
    if most_levels is None:
        return seen
    if not whole:
        left = frontier.join(steps, keys).select(*by, F.col("to").alias("node")).join(seen.select(*keys), keys, "left_anti")
        whole = left.isEmpty()
    return seen.withColumn("incomplete", F.lit(not whole))


def shortest_paths(edges: DataFrame, roots: DataFrame, targets: DataFrame) -> DataFrame:
    """graph, target, path (nodes from a root to the target), sites (of its edges): a row for each target that is reached.

    edges: graph, src, dst, sort_key, site; roots and targets: graph, node. Roots queue in order of their names, a node's
    edges in order of sort_key (then dst); the first to reach a node is its predecessor. So a node is ranked, in its
    level, by its predecessor's rank and the edge: this is the order in which a queue would take it.

    A node keeps the part of its path since its anchor, its ancestor at the last depth below its own that STRIDE divides (null:
    all of the path), so paths are put together anchor by anchor. Joins are merged, but for levels of few nodes: the sizes of
    edges that a query makes are guessed before they are made, and the driver would gather them for a broadcast.
    """
    none = F.array().cast(ArrayType(edges.schema["site"].dataType))
    start = Window.partitionBy("graph").orderBy("node")
    seen = roots.select("graph", "node").distinct().withColumns({"depth": F.lit(0), "rank": F.row_number().over(start).cast("long"), "anchor": F.lit(None).cast(roots.schema["node"].dataType), "path": F.array("node"), "sites": none})
    seen = frontier = cut(seen)
    edges = cut(edges.select("graph", "src", "dst", "sort_key", "site").repartition("graph", "src"))  # every level reads them, by many tasks
    parts, depth = [seen], 0
    while count := frontier.count():
        at_anchor = depth > 0 and depth % STRIDE == 0
        kept = {"anchor": F.col("node"), "path": F.slice("path", 1, 0), "sites": none} if at_anchor else {}
        depth += 1
        here = frontier.withColumns(kept).select("graph", F.col("node").alias("src"), "rank", "anchor", "path", "sites")
        here = here.hint("broadcast" if count <= FEW else "merge")
        first = F.min(F.struct("rank", "sort_key", F.col("src").alias("parent"), "site", "anchor", "path", "sites")).alias("first")
        reached = edges.join(here, ["graph", "src"]).groupBy("graph", F.col("dst").alias("node")).agg(first)
        # Not left_anti: the optimizer would push that below the grouping, to all edges.
        new = reached.join(seen.select("graph", "node", F.lit(True).alias("known")).hint("merge"), ["graph", "node"], "left").filter("known is null")
        order = Window.partitionBy("graph").orderBy("first.rank", "first.sort_key", "node")
        frontier = cut(new.select("graph", "node", F.lit(depth).alias("depth"), F.row_number().over(order).cast("long").alias("rank"), "first.anchor", F.concat("first.path", F.array("node")).alias("path"), F.concat("first.sites", F.array("first.site")).alias("sites")))
        seen = seen.union(frontier)
        parts.append(frontier)
        if depth % STRIDE == 0:
            seen = cut(seen)
            release(*parts[:-1])  # the last one is the frontier
            parts = [seen, frontier]
    release(edges)
    back = targets.select("graph", F.col("node").alias("target")).distinct()
    rows = back.withColumn("node", F.col("target")).join(seen.hint("merge"), ["graph", "node"])
    rows = cut(rows.select("graph", "target", F.col("anchor").alias("at"), "path", "sites"))
    out = rows.filter("at is null")
    anchors = seen.filter(F.col("depth") % STRIDE == 0).select("graph", F.col("node").alias("at"), "anchor", F.col("path").alias("before"), F.col("sites").alias("crossed"))
    for _ in range(STRIDE, depth - 1, STRIDE):  # the deepest nodes are at depth - 1
        rows = rows.filter("at is not null").join(anchors.hint("merge"), ["graph", "at"])
        rows = cut(rows.select("graph", "target", F.col("anchor").alias("at"), F.concat("before", "path").alias("path"), F.concat("crossed", "sites").alias("sites")))
        out = out.union(rows.filter("at is null"))
    return out.select("graph", "target", "path", "sites")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), by alternating large and small stars, until one aggregate over the edges does not change."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    links = cut(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a != b").distinct())
    before = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        # Large star: every larger neighbour of a node hangs on the least of the node and its neighbours.
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a != b").distinct()
        # Small star: a node and its smaller neighbours hang on the least of them.
        near = large.join(large.groupBy("b").agg(F.min("a").alias("m")), "b")
        links = cut(near.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").filter("a != b").distinct())
    roots = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def entry_points(functions: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """graph, node: main, init and tests of main packages; of a graph without any, init and exported functions of all packages. functions: graph, node, package, name.

    Explicit entry points (graph, node), where a graph has some, replace both.
    """
    main = F.col("package") == "main"
    test = F.col("name").rlike("^(Test|Benchmark|Example).")
    with_main = functions.groupBy("graph").agg(F.bool_or(main).alias("has_main"))
    rows = functions.join(with_main, "graph")
    chosen = F.when(F.col("has_main"), main & (F.col("name").isin("main", "init") | test)).otherwise((F.col("name") == "init") | F.col("name").rlike("^[A-Z]"))
    found = rows.filter(chosen).select("graph", "node")
    if explicit is None:
        return found
    given = explicit.select("graph").distinct()
    return found.join(given, "graph", "left_anti").union(explicit.select("graph", "node").distinct())


def resolve_symbols(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """symbols (graph, package, symbol) with `node`s: a function by its name, or a method by Type.Method, of a value or a pointer; null if there is none.

    nodes: graph, node, package, name, receiver (type name, with * for a pointer; null for functions).
    """
    named = nodes.select("graph", "node", "package", F.when(F.col("receiver").isNull(), F.col("name")).otherwise(F.concat(F.ltrim(F.col("receiver"), F.lit("*")), F.lit("."), "name")).alias("symbol"))
    return symbols.join(named, ["graph", "package", "symbol"], "left")


def guards(reached: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """graph, target, reflects (a reached function calls reflection), address_taken (the target is used as a value); what is not known counts as true.

    reached: graph, node; nodes: graph, node, calls_reflect, address_taken; targets: graph, target.
    """
    known = reached.select("graph", "node").join(nodes, ["graph", "node"], "left")
    reflect = known.groupBy("graph").agg(F.bool_or(F.coalesce("calls_reflect", F.lit(True))).alias("reflects"))
    own = nodes.select("graph", F.col("node").alias("target"), "address_taken")
    rows = targets.join(own, ["graph", "target"], "left").join(reflect, "graph", "left")
    return rows.select("graph", "target", F.coalesce("reflects", F.lit(False)).alias("reflects"), F.coalesce("address_taken", F.lit(True)).alias("address_taken"))


def module_search(imports: DataFrame, entries: DataFrame, fidelity: DataFrame, most_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Reached files (project, node, depth), and the frontiers (project, file, reason, could_reach) met there.

    imports: project, src, dst (null if unresolved), kind (static, dynamic, dispatch); entries: project, node; fidelity: project,
    node, fidelity (source, reduced, none). Imports of files that are not source are not followed; such a file, an unresolved
    import and a dynamic one are frontiers that may reach anything. With most_files, a project with more is a frontier too.
    """
    followed = imports.filter("dst is not null").join(fidelity.filter("fidelity != 'source'").select("project", F.col("node").alias("src")), ["project", "src"], "left_anti")
    seen = reachable(followed, entries, ["project"])
    blind = seen.join(fidelity.filter("fidelity != 'source'"), ["project", "node"]).select("project", F.col("node").alias("file"), F.concat(F.lit("fidelity-"), "fidelity").alias("reason"))
    odd = imports.filter("dst is null or kind != 'static'").withColumn("reason", F.when(F.col("kind") != "static", F.col("kind")).otherwise("unresolved"))
    odd = odd.join(seen.select("project", F.col("node").alias("src")), ["project", "src"], "left_semi").select("project", F.col("src").alias("file"), "reason")
    out = blind.union(odd)
    if most_files is not None:
        out = out.union(seen.groupBy("project").agg(F.count("*").alias("n"), F.min("node").alias("file")).filter(F.col("n") > most_files).select("project", "file", F.lit("truncated").alias("reason")))
    return seen, out.distinct().withColumn("could_reach", F.lit(None).cast("array<string>"))


def nearest(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths (project, path, ...) with `root`: the longest root (project, root) that is the path or a folder above it; null without one.

    A path's prefixes make this an equi-join. The empty root holds all.
    """
    parts = F.split("path", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    rows = paths.select("project", "path").distinct().select("project", "path", F.posexplode(above).alias("_depth", "root"))
    best = rows.join(roots.select("project", "root").distinct(), ["project", "root"]).groupBy("project", "path").agg(F.max_by("root", "_depth").alias("root"))
    return paths.join(best, ["project", "path"], "left")


def crate_flags(edges: DataFrame, members: DataFrame) -> DataFrame:
    """project, package, as_normal, as_dev, as_build: by which kinds of dependency a package is used; workspace members are normal.

    edges: project, src, dst, kind (null or 'normal', 'dev', 'build'); members: project, package.
    """
    kind = F.coalesce("kind", F.lit("normal"))
    used = edges.select("project", F.col("dst").alias("package"), kind.alias("kind")).union(members.select("project", "package", F.lit("normal").alias("kind")))
    return used.groupBy("project", "package").agg(*[F.bool_or(F.col("kind") == k).alias(f"as_{k}") for k in ("normal", "dev", "build")])
