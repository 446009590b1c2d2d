"""Queries of orders, decision tables, merging, searches and reports over the driver's tables, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veristrata.functions import decisions, risk, text, versions
from veristrata.operators import advisories as adv
from veristrata.operators import graph, parity, reach
from veristrata.plans.files import _text
from veristrata.policy import Policy
from veristrata.session import table
from veristrata.sinks import reports, statements

#: A way to write numbers a, b and a stage n (0 to 2 before the release, 3 the release, 4 after it) as a version of each ecosystem.
_FORMS = {"Go": ("{a}.{b}.0", ("-alpha.{n}", "-beta", "-rc.1", "", None)), "npm": ("{a}.{b}.0", ("-alpha.{n}", "-beta", "-rc.1", "", None)), "crates.io": ("{a}.{b}.0", ("-1", "-a", "-a.b", "", None)), "NuGet": ("{a}.{b}", ("-1", "-Alpha", "-beta", "", ".0.1")), "PyPI": ("{a}.{b}", (".dev1", "a1", "rc2", "", ".post1")), "Packagist": ("{a}.{b}", ("-dev", "-beta1", "-RC2", "", "-patch1")), "RubyGems": ("{a}.{b}", (".a.1", ".b", ".rc1", "", ".0.1")), "Pub": ("{a}.{b}.0", ("-a", "-a.b", "-b", "", "+1")), "Maven": ("{a}.{b}", ("-alpha-1", "-beta", "-SNAPSHOT", "", "-sp"))}


def _versions(spark, sf):
    """p_partkey, ecosystem, a, b, stage, version."""
    k, s = F.col("p_partkey"), F.col("p_size")
    names = list(_FORMS)
    rows = table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int")).alias("ecosystem"), (k % 13).alias("a"), (s % 7).alias("b"), (s % 5).alias("stage"))
    version = F.lit(None).cast("string")
    for name, (core, tails) in _FORMS.items():
        pieces = [F.lit(x) if x not in ("{a}", "{b}") else F.col(x[1]).cast("string") for x in core.replace("{", "|{").replace("}", "}|").split("|") if x]
        tail = F.element_at(F.array(*[F.lit(t.replace("{n}", "1")) if t is not None else F.lit("") for t in tails]), (F.col("stage") + 1).cast("int"))
        version = F.when(F.col("ecosystem") == name, F.concat(*pieces, tail)).otherwise(version)
    return rows.withColumn("version", version)


def version_orders(spark, sf):
    """The place of each version among its ecosystem's, by its key."""
    rows = _versions(spark, sf).filter("ecosystem != 'Maven'").withColumn("key", versions.version_key(F.col("ecosystem"), F.col("version")))
    return rows.select("p_partkey", "version", F.dense_rank().over(Window.partitionBy("ecosystem").orderBy("key")).alias("place"))


_STAGES = "CASE WHEN stage = 4 AND ecosystem IN ('Go', 'npm', 'crates.io') THEN 3 ELSE stage END"
_VERSIONS_SQL = "v AS (SELECT p_partkey, ['Go', 'npm', 'crates.io', 'NuGet', 'PyPI', 'Packagist', 'RubyGems', 'Pub', 'Maven'][p_partkey % 9 + 1] AS ecosystem, p_partkey % 13 AS a, p_size % 7 AS b, p_size % 5 AS stage FROM part)"


def _written(ecosystem, core, tails):
    tail = ", ".join("'" + (t or "").replace("{n}", "1") + "'" for t in tails)
    return f"WHEN '{ecosystem}' THEN " + core.replace("{a}", "' || a || '").replace("{b}", "' || b || '").join("''") + f" || [{tail}][stage + 1]"


_WRITTEN = "CASE ecosystem " + " ".join(_written(e, *f) for e, f in _FORMS.items()) + " END"


def maven_pairs(spark, sf):
    """Each version against its neighbour's, in pairs."""
    rows = _versions(spark, sf).filter("ecosystem = 'Maven'").select("a", "b", "stage", "version").distinct()
    other = rows.select(F.col("a"), F.col("b").alias("b2"), F.col("stage").alias("stage2"), F.col("version").alias("version2"))
    pairs = rows.join(other, "a").withColumn("sign", versions.maven_compare("version", "version2"))
    return pairs.select("version", "version2", "sign")


def platform_breadth(spark, sf):
    """Packages under a platform name's product: pinned, ranged, unbounded and undecidable."""
    k, s = F.col("p_partkey"), F.col("p_size")
    m = F.struct((s % 6 != 0).alias("vulnerable"), _text("cpe:2.3:a:v:lib_", k % 100, ":", F.when(s % 5 == 0, _text("1.", s % 9)).otherwise("*"), ":*").alias("criteria"), F.when(s % 5 == 1, "1.2").otherwise("").alias("start_inc"), F.when(s % 5 == 2, "1.3").otherwise("").alias("start_exc"), F.when(s % 5 == 1, "1.5").otherwise("").alias("end_inc"), F.when(s % 5 == 3, "1.x").when(s % 5 == 2, "1.8").otherwise("").alias("end_exc"))
    records = table(spark, sf, "part").select(_text("CVE-", k).alias("cve"), F.array(m).alias("cpe_matches"))
    deps = table(spark, sf, "customer").select(F.lit("npm").alias("ecosystem"), _text("@s/LIB-", F.col("c_custkey") % 100).alias("name"), _text("v1.", F.col("c_custkey") % 9).alias("version"))
    return adv.platform_matches(deps, records).select("cve", "name", "version", "provable")


def alias_greedy(spark, sf):
    """Groups by the first that shares a name, in order; a bridge joins only the first."""
    line = table(spark, sf, "lineitem")
    rows = line.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey").distinct()
    rows = rows.select("l_partkey", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey")).cast("bigint").alias("pos"), _text("I", F.col("l_suppkey") % 5).alias("id"), F.array(_text("I", (F.col("l_suppkey") % 5 + 1) % 5)).alias("aliases"))
    found = adv.greedy_groups(rows.filter("pos <= 3"), ["l_partkey"])
    return found.select("l_partkey", "pos", F.col("grp").cast("int").alias("grp"))


def layers_combined(spark, sf):
    """A feed's layers: the first fills, later ones fill what is empty."""
    k, s, none = F.col("p_partkey"), F.col("p_size"), F.array().cast("array<string>")
    rng = lambda when, x: F.when(when, F.array(F.struct(x.cast("string").alias("introduced"), F.lit("").alias("fixed"), F.lit("").alias("last_affected")))).otherwise(F.slice(F.array(F.struct(F.lit("").alias("introduced"), F.lit("").alias("fixed"), F.lit("").alias("last_affected"))), 1, 0))
    layer = lambda pos: table(spark, sf, "part").select("p_partkey", F.lit(pos).alias("pos"), _text(f"L{pos}-", k).alias("id"), F.array(_text("CVE-", k)).alias("aliases"), F.array(F.lit(f"layer{pos}")).alias("sources"), ((s + pos) % 5).alias("severity"), F.when((s + pos) % 3 == 0, F.array(F.lit(f"v{pos}"))).otherwise(none).alias("cvss"), none.alias("cwes"), none.alias("symbols"), F.when((s + pos) % 2 == 0, F.array(F.lit(f"u{pos}"))).otherwise(none).alias("fix_refs"), rng((s + pos) % 4 == 0, s + pos).alias("version_ranges"), none.alias("versions"), ((s + pos) % 4 != 0).alias("undecidable_ranges"), F.lit(False).alias("incomplete"))
    out = adv.fill_gaps(layer(0).union(layer(1)), ["p_partkey"])
    return out.select("p_partkey", "id", F.array_join("aliases", ",").alias("aliases"), F.array_join("sources", ",").alias("sources"), "severity", F.coalesce(F.array_join("cvss", ","), F.lit("")).alias("cvss"), F.coalesce(F.array_join("fix_refs", ","), F.lit("")).alias("fix_refs"), F.coalesce(F.get("version_ranges", F.lit(0))["introduced"], F.lit("")).alias("low"), "undecidable_ranges")


def epss_precedence(spark, sf):
    """A queried score comes before a listed one."""
    listed = table(spark, sf, "part").select(_text(" cve-", F.col("p_partkey")).alias("cve"), (F.col("p_size") / 100).alias("epss"), F.lit(0.5).alias("percentile"))
    queried = table(spark, sf, "customer").select(_text("CVE-", F.col("c_custkey") * 2).alias("cve"), (F.col("c_custkey") % 7 / 10).alias("epss"), F.lit(0.9).alias("percentile"))
    return adv.epss_entries(queried, listed)


def all_aliases(spark, sf):
    """Every alias's record counts: the greatest severity, all weaknesses."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(_text("A-", k).alias("advisory"), F.array(_text("CVE-", k % 90), _text("CVE-", k % 70)).alias("cves"))
    records = table(spark, sf, "supplier").select(_text("CVE-", F.col("s_suppkey")).alias("cve"), (F.col("s_suppkey") % 5).alias("severity"), F.array(_text("CWE-", F.col("s_suppkey") % 11)).alias("cwes"))
    return adv.all_by_alias(rows, records).select("advisory", "severity", F.array_join("cwes", ",").alias("cwes"))


def stamped_by_id(spark, sf):
    """Findings take the columns of the advisory with their id that was loaded last."""
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project"), _text("A-", F.col("l_partkey") % 50).alias("advisory")).distinct()
    own = table(spark, sf, "part").select(_text("A-", F.col("p_partkey") % 60).alias("advisory"), F.col("p_partkey").alias("pos"), F.col("p_size").alias("severity"), F.col("p_brand").alias("source"))
    return adv.stamp(line, own).groupBy("advisory", "severity", "source").agg(F.count("*").alias("n"))


def source_failures(spark, sf):
    """Sources with their errors and greatest age, and ecosystems that none serves."""
    ev = table(spark, sf, "events")
    failures = ev.filter("event_type = 'error'").select(_text("s", F.col("user_id") % 9).alias("source"), _text("e", F.col("user_id") % 4).alias("error"))
    fetched = ev.filter("event_type = 'view'").select(_text("s", F.col("user_id") % 12).alias("source"), (F.col("event_id") % 1000).alias("age"))
    rows = adv.source_status(failures, fetched).select("source", "failed", F.array_join("errors", ",").alias("errors"), "age")
    missing = adv.uncovered(table(spark, sf, "nation").select(_text("s", F.col("n_nationkey")).alias("ecosystem")), rows.select(F.lit("x").alias("src"), F.col("source").alias("ecosystem")))
    return rows.union(missing.select("ecosystem", F.lit(None).cast("boolean"), F.lit("not served"), F.lit(None).cast("bigint")))


def metric_choice(spark, sf):
    """Best score, severity by version and text, and validity of the newest vectors."""
    s = F.col("p_size")
    v4 = _text("CVSS:4.0/AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:", F.when(s % 7 == 0, "X").otherwise("H"), "/SC:N/SI:N/SA:N")
    v31 = _text("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:", F.when(s % 2 == 0, "H").otherwise("N"), "/I:H/A:H")
    v30 = F.lit("CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:L")
    every = F.filter(F.array(*[F.when(when, risk.parsed_cvss(v, F.lit(n))) for n, v, when in (("c", v30, s % 3 == 0), ("b", v31, s % 5 < 2), ("a", v4, s % 4 == 0))]), lambda m: m.isNotNull())
    rows = table(spark, sf, "part").select("p_partkey", every.alias("m"), F.when(s % 6 == 0, 5.5).otherwise(0.0).alias("bare"), F.when(s % 2 == 0, "critical").otherwise("n/a").alias("word"))
    return rows.select("p_partkey", risk.best_cvss(F.col("m"))["base_score"].alias("best"), risk.severity_of_metrics(F.col("m"), F.col("bare"), F.col("word")).alias("severity"), F.size("m").alias("n"))


def sources_text(spark, sf):
    """Provenance, conflict and stale texts of sources, and a score's rationale."""
    meta = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.collect_set(F.struct(_text("s", F.col("l_suppkey") % 3).alias("source"), (F.col("l_suppkey") % 3 + 1).cast("int").alias("severity"), F.when(F.col("l_suppkey") % 3 == 0, "V").otherwise("").alias("vector"))).alias("m"))
    why = text.rationale(F.col("l_partkey") % 4, (F.col("l_partkey") % 100) / 10, (F.col("l_partkey") % 25) / 100, F.col("l_partkey") % 2 == 0)
    return meta.select("l_partkey", text.provenance_text(F.col("m")).alias("provenance"), text.conflict_text(F.col("m")).alias("conflict"), text.stale_text(F.transform("m", lambda x: x["source"])).alias("stale"), why.alias("why"))


def names_of_cves(spark, sf):
    k = F.col("p_partkey")
    aliases = F.array(_text("cve-2024-", k + 1000), F.lit("GHSA-x"), _text("CVE-2024-", k + 1000), _text("CVE-2023-", k + 5000), F.lit("CVE-1-2"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.cve_ids(_text("CVE-2023-", k + 5000), aliases), ",").alias("signals"), F.array_join(text.cve_aliases(aliases), ",").alias("records"))


def place_names(spark, sf):
    """Addresses, slugs, products, segments, and codes of names."""
    k, s = F.col("p_partkey"), F.col("p_size")
    url = F.when(s % 3 == 0, _text("https://Host.x/O/r", k, ".git/")).when(s % 3 == 1, _text("git@Host.x:O/r", k, ".git")).otherwise(_text("http://host.x/o/r", k, "//"))
    return table(spark, sf, "part").select("p_partkey", text.swift_url(url).alias("address"), text.package_slug(F.when(s % 2 == 0, "PyPI").otherwise("Maven"), _text("A.b:c_", k)).alias("slug"), text.product_token(text.last_segment(_text("@s/My_Lib", k))).alias("product"), text.confidence_code(F.when(s % 4 == 0, "confidence_not_reachable ").when(s % 4 == 1, "CONFIDENCE_SYMBOL_REACHABLE").otherwise("odd")).alias("code"), text.confidence_name(s % 5).alias("name"))


def minified_files(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", text.minified(F.coalesce("text", F.lit("")), 2000, 300).alias("minified"))
    return rows.filter("doc_id is not null")


def import_confidences(spark, sf):
    bit = lambda k: (F.floor(F.col("l_orderkey") / k) % 2) == 1
    code = decisions.import_confidence(*(bit(k) for k in (1, 2, 4, 8, 16, 32, 64)))
    return table(spark, sf, "lineitem").groupBy(code.alias("confidence")).agg(F.count("*").alias("n"))


def distribution_confidences(spark, sf):
    bit = lambda k: (F.floor(F.col("l_orderkey") / k) % 2) == 1
    out = decisions.distribution_confidence(*(bit(k) for k in (1, 2, 4, 8, 16, 32, 64, 128)))
    return table(spark, sf, "lineitem").groupBy(out["confidence"].alias("confidence"), out["incomplete"].alias("incomplete")).agg(F.count("*").alias("n"))


def without_analysis(spark, sf):
    """Skipped and degraded analyses."""
    found = table(spark, sf, "part").select((F.col("p_size") % 4).cast("int").alias("confidence"), F.lit(False).alias("incomplete"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 3 == 1).alias("imported"))
    skip = decisions.skipped(found).select("confidence", "incomplete", decisions.degraded_confidence(F.col("imported")).alias("degraded"))
    return skip.groupBy("confidence", "incomplete", "degraded").agg(F.count("*").alias("n"))


def call_paths(spark, sf):
    """Shortest paths from the first part to every other, over edges to twice a key and one more."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("src"))
    edges = part.select(F.lit(1).alias("graph"), "src", F.explode(F.array(F.col("src") * 2, F.col("src") * 2 + 1, F.col("src") * 4)).alias("dst"))
    edges = edges.withColumns({"sort_key": F.lpad(F.col("dst").cast("string"), 12, "0"), "site": _text(F.col("src"), ">", F.col("dst"))})
    roots = part.filter("src = 1").select(F.lit(1).alias("graph"), F.col("src").alias("node"))
    targets = part.select(F.lit(1).alias("graph"), F.col("src").alias("node"))
    found = graph.shortest_paths(edges, roots, targets)
    return found.select("target", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.size("sites").alias("n_sites"))


def entries_and_symbols(spark, sf):
    """Entry points of programs and libraries, and advisories' symbols among their functions."""
    k, s = F.col("p_partkey"), F.col("p_size")
    nodes = table(spark, sf, "part").select(F.col("p_brand").alias("graph"), k.alias("node"), F.when(s % 9 == 0, "main").otherwise("lib").alias("package"), F.element_at(F.array(*map(F.lit, ("main", "init", "TestIt", "Run", "help"))), (k % 5 + 1).cast("int")).alias("name"), F.when(s % 4 == 0, "*T").when(s % 4 == 1, "T").alias("receiver"), (s % 10 == 0).alias("calls_reflect"), (s % 3 == 0).alias("address_taken"))
    found = graph.entry_points(nodes)
    wanted = nodes.select("graph").distinct().select("graph", F.lit("lib").alias("package"), F.explode(F.array(F.lit("T.Run"), F.lit("Run"), F.lit("No"))).alias("symbol"))
    named = graph.resolve_symbols(wanted, nodes).groupBy("graph", "symbol").agg(F.count("node").alias("n"))
    guarded = graph.guards(found, nodes, nodes.select("graph", F.col("node").alias("target"))).groupBy("graph", "reflects").agg(F.count(F.when(F.col("address_taken"), 1)).alias("taken"))
    out = named.groupBy("graph").agg(F.sum(F.when(F.col("symbol") == "T.Run", F.col("n"))).alias("methods"), F.sum(F.when(F.col("symbol") == "Run", F.col("n"))).alias("functions"), F.sum(F.when(F.col("symbol") == "No", F.col("n"))).alias("none"))
    return out.join(found.groupBy("graph").agg(F.count("*").alias("entries")), "graph", "left").join(guarded, "graph", "left").select("graph", "methods", "functions", "none", F.coalesce("entries", F.lit(0)).alias("entries"), "reflects", "taken")


def nearest_workspace(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    paths = table(spark, sf, "part").select(F.col("p_brand").alias("project"), _text("a/b", s % 5, "/c/f", k).alias("path"))
    roots = table(spark, sf, "part").select(F.col("p_brand").alias("project"), F.when(s % 7 == 0, "").when(s % 7 < 4, "a").otherwise(_text("a/b", s % 3)).alias("root"))
    return graph.nearest(paths, roots).select("project", "path", "root")


def import_targets(spark, sf):
    """Specifiers by their longest known prefix: own modules, locked packages, the standard library."""
    k, s = F.col("p_partkey"), F.col("p_size")
    spec = F.when(s % 5 == 0, _text("own.m", k % 9, ".x")).when(s % 5 == 1, _text("dist", k % 9, ".y")).when(s % 5 == 2, F.lit("os.path")).when(s % 5 == 3, F.lit(".near")).otherwise(_text("odd", k))
    imports = table(spark, sf, "part").select(F.col("p_brand").alias("project"), k.alias("file"), spec.alias("specifier"))
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("project"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).distinct()
    own = brands.select("project", F.explode(F.array(F.lit("own"), _text("own.m", F.col("i")))).alias("module")).distinct()
    pinned = brands.select("project", _text("dist", F.col("i")).alias("module"), _text("Dist-", F.col("i")).alias("dist"))
    library = table(spark, sf, "region").select(F.when(F.col("r_regionkey") == 0, "os").otherwise("sys").alias("module"))
    return reach.resolve_imports(imports, own, pinned, library).select("file", "kind", "target")


def symbol_sites(spark, sf):
    """The first import site that binds a symbol, or all of a package, in reached files."""
    k, s = F.col("p_partkey"), F.col("p_size")
    sites = table(spark, sf, "part").select(F.col("p_brand").alias("project"), _text("pk", s % 4).alias("package"), k.alias("file"), (s % 3).alias("line"), F.lit(1).alias("col"), F.when(s % 10 == 0, F.array(F.lit("*"))).otherwise(F.array(_text("f", s % 6), F.lit("g"))).alias("bindings"))
    reached = table(spark, sf, "customer").select(_text("Brand#", F.col("c_custkey") % 60).alias("project"), F.col("c_custkey").alias("node"))
    both = reach.live_sites(sites, table(spark, sf, "lineitem").select(F.col("l_partkey").alias("node")).distinct().join(sites.select("project", F.col("file").alias("node")), "node").union(reached.select("node", "project")).select("project", "node"))
    wanted = table(spark, sf, "part").select(F.col("p_brand").alias("project"), F.explode(F.array(*[F.lit(f"pk{i}") for i in range(4)])).alias("package")).distinct().withColumn("symbol", F.explode(F.array(F.lit("f1"), F.lit("g"), F.lit("none"))))
    found = reach.bound_symbols(wanted, both)
    return found.select("project", "package", "symbol", F.col("site.file").alias("file"))


def export_maps(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    one = lambda key, pos, target: F.struct(F.lit(key).alias("key"), F.lit(pos).alias("pos"), target.alias("target"))
    entries = F.array(one(".", 0, F.lit("./index.js")), one("./x", 1, _text("./x", s, ".js")), one("./f/*", 2, F.lit("./F/*.js")), one("./*", 3, F.when(s % 2 == 0, "./any/*")), one("./no", 4, F.lit(None).cast("string")))
    exports = table(spark, sf, "part").select(_text("p", k).alias("package"), F.explode(entries).alias("e")).select("package", "e.*")
    requests = table(spark, sf, "part").select(_text("p", k).alias("package"), F.explode(F.array(*map(F.lit, (".", "./x", "./f/a", "./f/../z", "./q", "./no", "odd")))).alias("subpath"))
    return reach.export_target(exports, requests)


def symbol_index(spark, sf):
    """Stored symbols by advisory and fix references; changed references miss."""
    k, s = F.col("p_partkey"), F.col("p_size")
    refs = lambda extra: F.array(F.lit("u1"), _text("u", s + extra))
    stored = reach.dist_symbols(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("dist"), _text("f", F.col("l_suppkey") % 3).alias("symbol")))
    index = table(spark, sf, "part").select(k.alias("id"), F.sha2(F.array_join(F.array_sort(refs(F.when(s % 4 == 0, 1).otherwise(0))), "\n").cast("binary"), 256).alias("refs_key")).join(stored, F.col("id") == F.col("dist")).select("id", "refs_key", "symbols")
    wanted = table(spark, sf, "part").select(k.alias("id"), F.array_sort(refs(F.lit(0)), lambda a, b: F.when(a < b, 1).when(a > b, -1).otherwise(0)).alias("fix_refs"))
    return reach.indexed_symbols(wanted, index).select("id", F.array_join("symbols", ",").alias("symbols"))


def _found(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    properties = F.when(s % 3 == 0, F.create_map(F.lit("risk_score"), _text(s, ".5"), F.lit("kev"), F.lit("true")))
    path = F.when(s % 4 == 3, F.array(F.struct(_text("f", k, ".go").alias("file"), s.cast("int").alias("line"), F.lit(1).alias("column"), F.lit("sym").alias("symbol"))))
    return table(spark, sf, "part").select(_text(F.when(s % 2 == 0, "CVE-").otherwise("A-"), k % 500).alias("advisory"), F.when(s % 5 == 0, F.array(F.lit("B"))).alias("aliases"), _text("m", k).alias("module"), (s % 4).cast("int").alias("confidence"), (s % 5).cast("int").alias("severity"), properties.alias("properties"), path.alias("path"), F.lit("npm").alias("ecosystem"), _text(s, ".0").alias("version"), (s % 6 == 0).alias("incomplete"), F.when(s % 7 == 0, _text(s, ".1")).otherwise("").alias("fixed"), k.alias("key"))


def _paths(column, **paths):
    """Values of JSON texts, as texts."""
    return [F.get_json_object(column, p).alias(n) for n, p in paths.items()]


def sarif_rows(spark, sf):
    rows = reports.sarif_results(_found(spark, sf))
    return rows.select("advisory", "module", *_paths("result", level="$.level", message="$.message.text", confidence="$.properties.confidence", kev="$.properties.kev", suppressed="$.suppressions[0].kind", file="$.codeFlows[0].threadFlows[0].locations[0].location.physicalLocation.artifactLocation.uri", alias="$.aliases[0]"), F.get_json_object("result", "$.rank").cast("double").alias("rank"))


def json_rows(spark, sf):
    rows = reports.json_findings(_found(spark, sf))
    return rows.select("module", *_paths("finding", id="$.advisory.id", severity="$.severity", confidence="$.confidence", symbol="$.path.steps[0].symbol", kev="$.risk.kev"), F.get_json_object("finding", "$.risk.score").cast("double").alias("score"))


def table_rows(spark, sf):
    return reports.table_lines(_found(spark, sf)).select("line")


def statement_rows(spark, sf):
    """Statements in the three formats' states."""
    rows = statements.statements(_found(spark, sf))
    vex = statements.openvex_statements(rows, "2024-01-01T00:00:00Z").select("id", "product", "status", *_paths("statement", justification="$.justification", action="$.action_statement"))
    cdx = statements.cyclonedx_vulnerabilities(rows).select("id", "product", *_paths("vulnerability", state="$.analysis.state"))
    return vex.join(cdx, ["id", "product"])


def csaf_rows(spark, sf):
    rows = statements.csaf_vulnerabilities(statements.statements(_found(spark, sf)))
    kinds = F.from_json("vulnerability", "struct<cve: string, product_status: struct<known_affected: array<string>, known_not_affected: array<string>, under_investigation: array<string>>, remediations: array<struct<category: string>>, flags: array<struct<label: string>>>")
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return rows.select("id", kinds.alias("v")).select("id", F.col("v.cve").isNotNull().alias("cve"), n("v.product_status.known_affected").alias("affected"), n("v.product_status.known_not_affected").alias("safe"), n("v.product_status.under_investigation").alias("open"), F.size(F.filter(F.coalesce("v.remediations", F.array().cast("array<struct<category:string>>")), lambda r: r["category"] == "vendor_fix")).alias("fixes"), n("v.flags").alias("flags"))


def documents_digest(spark, sf):
    """Whole documents: how many results, statements, vulnerabilities and products they hold."""
    found = _found(spark, sf)
    rows = statements.statements(found)
    when = "2024-01-01T00:00:00Z"
    n = lambda frame, path, name: frame.select(F.lit(name).alias("document"), F.size(F.from_json(F.get_json_object("document", path), "array<string>")).alias("n"))
    out = n(reports.render(found, "sarif"), "$.runs[0].results", "sarif").union(n(reports.render(found, "json").select(F.concat(F.lit('{"a":'), "document", F.lit("}")).alias("document")), "$.a", "json"))
    for name, path in (("openvex", "$.statements"), ("cyclonedx", "$.vulnerabilities"), ("csaf", "$.vulnerabilities")):
        out = out.union(n(statements.render_statements(rows, name, when), path, name))
    return out


def delta_table(spark, sf):
    """Lines of a comparison's report, and of a corpus's baseline."""
    deltas = table(spark, sf, "part").select(F.when(F.col("p_size") % 2 == 0, "miss").otherwise("shared").alias("kind"), _text("A-", F.col("p_partkey")).alias("id"), F.col("p_brand").alias("package"))
    lines = reports.delta_report(parity.delta_rows(deltas))
    cases = reports.baseline(table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("tp").alias("outcome")))
    return lines.union(cases.select("document"))


def policy_gate(spark, sf):
    """Projects' exit codes under a policy with signals, symbols, elevated and expired ignores."""
    line = table(spark, sf, "lineitem")
    k, p = F.col("l_partkey"), F.col("l_orderkey")
    found = line.select((p % 300).alias("project"), _text("A-", k % 40).alias("id"), F.lit("m").alias("module"), F.array(_text("s", k % 3)).alias("symbols"), (k % 4).cast("int").alias("confidence"), (k % 5).cast("int").alias("severity"), (p % 11 == 0).alias("dev_only"), F.when(k % 7 == 0, "test").otherwise("").alias("dep_type"), (k % 13 == 0).alias("kev"), (k % 10 / 10).alias("epss"), (k % 97).cast("double").alias("risk"), (p % 300 % 2 == 0).alias("incomplete"))
    ignores = [{"id": f"A-{i}", "module": "m", "reason": "r", "symbol": "s1" if i % 3 == 0 else "", "expires": "" if i % 5 == 0 else "2020-01-01" if i % 7 == 0 else "2030-01-01", "elevated": i % 2 == 0} for i in range(36)]
    return Policy("critical", "reachable, kev, risk>=96", ignores=ignores).evaluate(found, "2024-06-01", ["project"]).select("project", "gate_failed", "exit_code")


def freshness(spark, sf):
    """Sources beyond a soft age are stale; beyond a hard one, if that is on, the scan is incomplete."""
    ages = table(spark, sf, "events").groupBy(_text("s", F.col("user_id") % 40).alias("source")).agg(F.max("ts").alias("fetched"))
    return adv.freshness(ages, "2024-01-31 12:00:00", 50_000, 80_000).select("source", "stale", "incomplete")


QUERIES = {f.__name__: f for f in (version_orders, maven_pairs, platform_breadth, alias_greedy, layers_combined, epss_precedence, all_aliases, stamped_by_id, source_failures, metric_choice, sources_text, names_of_cves, place_names, minified_files, import_confidences, distribution_confidences, without_analysis, call_paths, entries_and_symbols, nearest_workspace, import_targets, symbol_sites, export_maps, symbol_index, sarif_rows, json_rows, table_rows, statement_rows, csaf_rows, documents_digest, delta_table, policy_gate, freshness)}

_F = """f AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'CVE-' ELSE 'A-' END || (p_partkey % 500) AS advisory, 'm' || p_partkey AS module, p_size AS s, ['CONFIDENCE_UNKNOWN', 'CONFIDENCE_NOT_REACHABLE', 'CONFIDENCE_PACKAGE_REACHABLE', 'CONFIDENCE_SYMBOL_REACHABLE'][p_size % 4 + 1] AS conf, ['UNSPECIFIED', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][p_size % 5 + 1] AS sev FROM part)"""
_ST = """st AS (SELECT advisory AS id, 'pkg:npm/' || module || '@' || s || '.0' AS product, CASE WHEN s % 4 >= 2 THEN 'affected' WHEN s % 4 = 1 AND s % 6 <> 0 THEN 'not_affected' ELSE 'under_investigation' END AS status, s FROM f)"""
_MESSAGES = "[" + ", ".join("'" + m.replace("%s", "' || conf || '") + "'" for m in text.MESSAGES) + "]"

ORACLES = {
    "version_orders": f"WITH {_VERSIONS_SQL} SELECT p_partkey, {_WRITTEN} AS version, CAST(dense_rank() OVER (PARTITION BY ecosystem ORDER BY a, b, {_STAGES}) AS INT) AS place FROM v WHERE ecosystem <> 'Maven'",
    "maven_pairs": f"WITH {_VERSIONS_SQL}, m AS (SELECT DISTINCT a, b, stage, {_WRITTEN} AS version FROM v WHERE ecosystem = 'Maven') SELECT x.version, y.version AS version2, CAST(CASE WHEN x.b <> y.b THEN sign(x.b - y.b) ELSE sign(x.stage - y.stage) END AS INT) AS sign FROM m x JOIN m y USING (a)",
    "platform_breadth": """WITH d AS (SELECT DISTINCT c_custkey % 100 AS p, c_custkey % 9 AS v FROM customer)
      SELECT 'CVE-' || p_partkey AS cve, '@s/LIB-' || p AS name, 'v1.' || v AS version, CASE p_size % 5 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE ELSE FALSE END AS provable FROM part JOIN d ON p = p_partkey % 100
      WHERE p_size % 6 <> 0 AND CASE p_size % 5 WHEN 0 THEN v = p_size % 9 WHEN 1 THEN v BETWEEN 2 AND 5 WHEN 2 THEN v > 3 AND v < 8 ELSE TRUE END""",
    "alias_greedy": """WITH r AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS pos, l_suppkey % 5 AS i FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem)),
      m AS (SELECT l_partkey, max(i) FILTER (pos = 1) AS a, max(i) FILTER (pos = 2) AS b, max(i) FILTER (pos = 3) AS c FROM r WHERE pos <= 3 GROUP BY l_partkey),
      g AS (SELECT *, CASE WHEN (b - a + 5) % 5 IN (0, 1, 4) THEN 0 ELSE 1 END AS gb FROM m),
      h AS (SELECT *, CASE WHEN (c - a + 5) % 5 IN (0, 1, 4) OR (gb = 0 AND (c - b + 5) % 5 IN (0, 1, 4)) THEN 0 WHEN gb = 1 AND (c - b + 5) % 5 IN (0, 1, 4) THEN 1 ELSE gb + 1 END AS gc FROM g)
      SELECT l_partkey, pos, CAST(CASE pos WHEN 1 THEN 0 WHEN 2 THEN gb ELSE gc END AS INT) AS grp FROM h JOIN r USING (l_partkey) WHERE pos <= 3""",
    "layers_combined": """SELECT p_partkey, 'L0-' || p_partkey AS id, 'CVE-' || p_partkey || ',L1-' || p_partkey AS aliases, 'layer0,layer1' AS sources, greatest(p_size % 5, (p_size + 1) % 5) AS severity, CASE WHEN p_size % 3 = 0 THEN 'v0' WHEN p_size % 3 = 2 THEN 'v1' ELSE '' END AS cvss,
      CASE WHEN p_size % 2 = 0 THEN 'u0' ELSE 'u1' END AS fix_refs, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_size % 4 = 3 THEN CAST(p_size + 1 AS VARCHAR) ELSE '' END AS low, p_size % 4 IN (1, 2) AS undecidable_ranges FROM part""",
    "epss_precedence": "SELECT cve, coalesce(q, l) AS epss, CASE WHEN q IS NULL THEN 0.5 ELSE 0.9 END::DOUBLE AS percentile FROM (SELECT 'CVE-' || c_custkey * 2 AS cve, (c_custkey % 7) / 10.0::DOUBLE AS q FROM customer) FULL JOIN (SELECT 'CVE-' || p_partkey AS cve, p_size / 100.0::DOUBLE AS l FROM part) USING (cve)",
    "all_aliases": """WITH c AS (SELECT p_partkey AS k, unnest([p_partkey % 90, p_partkey % 70]) AS c FROM part) SELECT 'A-' || k AS advisory, max(s_suppkey % 5) AS severity, string_agg(DISTINCT 'CWE-' || (s_suppkey % 11), ',' ORDER BY 'CWE-' || (s_suppkey % 11)) AS cwes FROM c LEFT JOIN supplier ON s_suppkey = c GROUP BY k""",
    "stamped_by_id": """WITH a AS (SELECT p_partkey % 60 AS i, arg_max({'s': p_size, 'b': p_brand}, p_partkey) AS x FROM part GROUP BY 1) SELECT 'A-' || f.i AS advisory, x.s AS severity, x.b AS source, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey % 50 AS i FROM lineitem) f LEFT JOIN a ON a.i = f.i GROUP BY ALL""",
    "source_failures": """WITH e AS (SELECT 's' || (user_id % 9) AS source, string_agg(DISTINCT 'e' || (user_id % 4), ',' ORDER BY 'e' || (user_id % 4)) AS errors FROM events WHERE event_type = 'error' GROUP BY 1), a AS (SELECT 's' || (user_id % 12) AS source, max(event_id % 1000) AS age FROM events WHERE event_type = 'view' GROUP BY 1),
      r AS (SELECT source, errors IS NOT NULL AS failed, coalesce(errors, '') AS errors, age FROM e FULL JOIN a USING (source)) SELECT * FROM r UNION ALL SELECT 's' || n_nationkey, NULL, 'not served', NULL FROM nation WHERE 's' || n_nationkey NOT IN (SELECT source FROM r)""",
    "metric_choice": """SELECT p_partkey, CASE WHEN n = 0 THEN NULL ELSE best END::DOUBLE AS best, CAST(CASE WHEN b > 0 THEN 4 WHEN c > 0 THEN 2 WHEN p_size % 6 = 0 THEN 2 WHEN p_size % 2 = 0 THEN 4 ELSE 0 END AS INT) AS severity, CAST(n AS INT) AS n
      FROM (SELECT *, greatest(b, c, 0) AS best FROM (SELECT *, CASE WHEN p_size % 5 < 2 THEN CASE WHEN p_size % 2 = 0 THEN 9.8 ELSE 9.1 END ELSE 0 END AS b, CASE WHEN p_size % 3 = 0 THEN 5.3 ELSE 0 END AS c, CAST(p_size % 3 = 0 AS INT) + CAST(p_size % 5 < 2 AS INT) + CAST(p_size % 4 = 0 AND p_size % 7 <> 0 AS INT) AS n FROM part))""",
    "sources_text": """WITH m AS (SELECT DISTINCT l_partkey, l_suppkey % 3 AS s FROM lineitem) SELECT l_partkey, string_agg('s' || s || ' ' || ['LOW', 'MEDIUM', 'HIGH'][s + 1] || CASE WHEN s = 0 THEN ' V' ELSE '' END, '; ' ORDER BY s) AS provenance, CASE WHEN count(*) > 1 THEN string_agg('s' || s || ':' || ['LOW', 'MEDIUM', 'HIGH'][s + 1], ',' ORDER BY s) ELSE '' END AS conflict, string_agg('s' || s, ',' ORDER BY s) AS stale,
      ['reachability-unknown', 'not-reachable', 'package-reachable', 'symbol-reachable'][l_partkey % 4 + 1] || CASE WHEN l_partkey % 2 = 0 THEN ' + KEV' ELSE '' END || CASE WHEN l_partkey % 100 > 0 THEN ' + CVSS ' || (l_partkey % 100 // 10) || '.' || (l_partkey % 10) ELSE '' END || CASE WHEN l_partkey % 25 > 0 THEN ' + EPSS 0.' || lpad(CAST(l_partkey % 25 AS VARCHAR), 2, '0') ELSE '' END AS why FROM m GROUP BY l_partkey""",
    "names_of_cves": "SELECT p_partkey, 'CVE-2023-' || (p_partkey + 5000) || ',CVE-2024-' || (p_partkey + 1000) AS signals, 'CVE-2023-' || (p_partkey + 5000) || ',CVE-2024-' || (p_partkey + 1000) AS records FROM part",
    "place_names": "SELECT p_partkey, 'host.x/o/r' || p_partkey AS address, CASE WHEN p_size % 2 = 0 THEN 'a-b:c-' ELSE 'A.b/c_' END || p_partkey AS slug, 'my-lib' || p_partkey AS product, [1, 3, 0, 0][p_size % 4 + 1] AS code, 'CONFIDENCE_' || ['UNKNOWN', 'NOT_REACHABLE', 'PACKAGE_REACHABLE', 'SYMBOL_REACHABLE', 'UNKNOWN'][p_size % 5 + 1] AS name FROM part",
    "minified_files": "SELECT doc_id, len(l) > 0 AND (len(l) = 1 AND list_sum(l) > 2000 OR list_sum(l) / greatest(len(l), 1) > 300) AS minified FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x)), lambda n: n > 0) AS l FROM documents WHERE doc_id IS NOT NULL)",
    "import_confidences": "SELECT CASE WHEN k % 2 = 1 THEN 0 WHEN k // 2 % 2 = 0 THEN CASE WHEN k // 4 % 2 = 1 THEN 0 ELSE 1 END WHEN k // 8 % 2 = 1 AND k // 16 % 2 = 1 AND k // 32 % 2 = 1 AND k // 64 % 2 = 1 THEN 3 WHEN k // 32 % 2 = 1 THEN 2 WHEN k // 4 % 2 = 1 THEN 0 ELSE 1 END AS confidence, count(*) AS n FROM (SELECT l_orderkey AS k FROM lineitem) GROUP BY 1",
    "distribution_confidences": """WITH b AS (SELECT k % 2 = 1 AS mapped, k // 2 % 2 = 1 AS imported, k // 4 % 2 = 1 AS whole, k // 8 % 2 = 1 AS symbols, k // 16 % 2 = 1 AS path, k // 32 % 2 = 1 AS dyn, k // 64 % 2 = 1 AS hit, k // 128 % 2 = 1 AS src FROM (SELECT l_orderkey AS k FROM lineitem))
      SELECT confidence, incomplete, count(*) AS n FROM (SELECT CASE WHEN NOT mapped THEN 0 WHEN NOT imported THEN CAST(whole AS INT) WHEN path AND symbols AND dyn THEN 0 WHEN path AND symbols AND hit THEN 3 WHEN NOT src THEN 2 WHEN NOT symbols THEN 2 ELSE 0 END AS confidence,
        CASE WHEN NOT mapped THEN TRUE WHEN NOT imported THEN NOT whole WHEN path AND symbols AND dyn THEN TRUE WHEN path AND symbols AND hit THEN NOT whole WHEN NOT src OR NOT symbols THEN NOT whole WHEN NOT path THEN TRUE ELSE NOT whole END AS incomplete FROM b) GROUP BY ALL""",
    "without_analysis": "SELECT 0 AS confidence, TRUE AS incomplete, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS degraded, count(*) AS n FROM part GROUP BY ALL",
    "call_paths": """WITH RECURSIVE r AS (SELECT CAST(1 AS BIGINT) AS node, '1' AS path, 0 AS n, [CAST(1 AS BIGINT)] AS trail UNION ALL SELECT d, r.path || '>' || d, r.n + 1, r.trail || [d] FROM r, (SELECT unnest([1, 2, 3]) AS i), LATERAL (SELECT [r.node * 2, r.node * 2 + 1, r.node * 4][i] AS d) WHERE r.node IN (SELECT p_partkey FROM part) AND d IN (SELECT p_partkey FROM part))
      SELECT node AS target, arg_min(path, {'n': n, 't': trail}) AS path, CAST(min(n) AS INT) AS n_sites FROM r GROUP BY node""",
    "entries_and_symbols": """WITH n AS (SELECT p_brand AS graph, p_partkey AS node, CASE WHEN p_size % 9 = 0 THEN 'main' ELSE 'lib' END AS package, ['main', 'init', 'TestIt', 'Run', 'help'][p_partkey % 5 + 1] AS name, p_size % 4 < 2 AS method, p_size % 10 = 0 AS reflect, p_size % 3 = 0 AS taken FROM part),
      m AS (SELECT graph, bool_or(package = 'main') AS has FROM n GROUP BY graph),
      e AS (SELECT n.* FROM n JOIN m USING (graph) WHERE CASE WHEN has THEN package = 'main' AND name IN ('main', 'init', 'TestIt') ELSE name IN ('init', 'TestIt', 'Run') END),
      g AS (SELECT graph, count(*) AS entries, bool_or(reflect) AS reflects FROM e GROUP BY graph)
      SELECT graph, count(*) FILTER (package = 'lib' AND name = 'Run' AND method) AS methods, count(*) FILTER (package = 'lib' AND name = 'Run' AND NOT method) AS functions, CAST(0 AS BIGINT) AS "none", coalesce(any_value(entries), 0) AS entries, coalesce(any_value(reflects), FALSE) AS reflects, count(*) FILTER (taken) AS taken FROM n LEFT JOIN g USING (graph) GROUP BY graph""",
    "nearest_workspace": """WITH r AS (SELECT DISTINCT p_brand AS project, CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 7 < 4 THEN 'a' ELSE 'a/b' || (p_size % 3) END AS root FROM part), p AS (SELECT p_brand AS project, 'a/b' || (p_size % 5) || '/c/f' || p_partkey AS path FROM part)
      SELECT project, path, (SELECT arg_max(root, length(root)) FROM r WHERE r.project = p.project AND (root = '' OR starts_with(p.path, root || '/'))) AS root FROM p""",
    "import_targets": "SELECT p_partkey AS file, CASE p_size % 5 WHEN 0 THEN 'own' WHEN 1 THEN CASE WHEN p_partkey % 9 < 6 THEN 'dist' ELSE 'unknown' END WHEN 2 THEN 'standard' WHEN 3 THEN 'own' ELSE 'unknown' END AS kind, CASE p_size % 5 WHEN 0 THEN CASE WHEN p_partkey % 9 < 6 THEN 'own.m' || (p_partkey % 9) ELSE 'own' END WHEN 1 THEN CASE WHEN p_partkey % 9 < 6 THEN 'Dist-' || (p_partkey % 9) END WHEN 2 THEN 'os' WHEN 3 THEN '.near' END AS target FROM part",
    "symbol_sites": """WITH live AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = p_partkey AND 'Brand#' || (c_custkey % 60) = p_brand)), w AS (SELECT DISTINCT p_brand AS project, i, symbol FROM part, (SELECT unnest([0, 1, 2, 3]) AS i), (SELECT unnest(['f1', 'g', 'none']) AS symbol))
      SELECT project, 'pk' || i AS package, symbol, (SELECT min(p_partkey) FROM live l WHERE l.p_brand = w.project AND l.p_size % 4 = i AND (l.p_size % 10 = 0 OR symbol = 'g' OR symbol = 'f1' AND l.p_size % 6 = 1)) AS file FROM w""",
    "export_maps": """SELECT 'p' || p_partkey AS package, s AS subpath, CASE s WHEN '.' THEN './index.js' WHEN './x' THEN './x' || p_size || '.js' WHEN './f/a' THEN './F/a.js' WHEN './q' THEN CASE WHEN p_size % 2 = 0 THEN './any/q' END END AS path FROM part, (SELECT unnest(['.', './x', './f/a', './f/../z', './q', './no', 'odd']) AS s)""",
    "symbol_index": "SELECT p_partkey AS id, CASE WHEN p_size % 4 <> 0 THEN (SELECT string_agg(DISTINCT 'f' || (l_suppkey % 3), ',' ORDER BY 'f' || (l_suppkey % 3)) FROM lineitem WHERE l_partkey = p_partkey) END AS symbols FROM part",
    "sarif_rows": f"""WITH {_F} SELECT advisory, module, CASE WHEN s % 4 = 1 THEN 'note' ELSE ['none', 'note', 'warning', 'error', 'error'][s % 5 + 1] END AS level, 'Vulnerability ' || advisory || ' in ' || module || ': ' || {_MESSAGES}[s % 4 + 1] AS message, conf AS confidence, CASE WHEN s % 3 = 0 THEN 'true' END AS kev, CASE WHEN s % 4 = 1 THEN 'external' END AS suppressed, CASE WHEN s % 4 = 3 THEN 'f' || k || '.go' END AS file, CASE WHEN s % 5 = 0 THEN 'B' END AS alias, CASE WHEN s % 3 = 0 THEN s + 0.5::DOUBLE END AS rank FROM f""",
    "json_rows": f"WITH {_F} SELECT module, advisory AS id, 'SEVERITY_' || sev AS severity, conf AS confidence, CASE WHEN s % 4 = 3 THEN 'sym' END AS symbol, CASE WHEN s % 3 = 0 THEN 'true' END AS kev, CASE WHEN s % 3 = 0 THEN s + 0.5::DOUBLE END AS score FROM f",
    "table_rows": f"WITH {_F} SELECT rtrim(rpad(CASE WHEN length(sev) > 8 THEN left(sev, 7) || '…' ELSE sev END, 8, ' ') || '  ' || rpad(advisory, 20, ' ') || '  ' || rpad(module, 32, ' ') || '  ' || replace(conf, 'CONFIDENCE_', '')) AS line FROM f",
    "statement_rows": f"""WITH {_F}, {_ST} SELECT DISTINCT id, product, status, CASE WHEN status = 'not_affected' THEN 'vulnerable_code_not_in_execute_path' END AS justification, CASE WHEN status = 'affected' THEN CASE WHEN s % 7 = 0 THEN 'Upgrade to ' || s || '.1 or later.' ELSE '{statements.GENERIC}' END END AS action, CASE status WHEN 'affected' THEN 'exploitable' WHEN 'not_affected' THEN 'not_affected' ELSE 'in_triage' END AS state FROM st""",
    "csaf_rows": f"""WITH {_F}, {_ST} SELECT id, starts_with(id, 'CVE-') AS cve, CAST(count(DISTINCT product) FILTER (status = 'affected') AS INT) AS affected, CAST(count(DISTINCT product) FILTER (status = 'not_affected') AS INT) AS safe, CAST(count(DISTINCT product) FILTER (status = 'under_investigation') AS INT) AS open, CAST(count(DISTINCT product) FILTER (status = 'affected' AND s % 7 = 0) AS INT) AS fixes, CAST(bool_or(status = 'not_affected') AS INT) AS flags FROM st GROUP BY id""",
    "documents_digest": f"WITH {_F}, {_ST} SELECT unnest(['sarif', 'json', 'openvex', 'cyclonedx', 'csaf']) AS document, CAST(unnest([count(*), count(*), count(*), count(*), count(DISTINCT id)]) AS INT) AS n FROM st",
    "delta_table": """SELECT '| kind | id | package |' AS line UNION ALL SELECT '| ' || CASE WHEN p_size % 2 = 0 THEN 'miss' ELSE 'shared' END || ' | A-' || p_partkey || ' | ' || p_brand || ' |' FROM part
      UNION ALL SELECT '{"cases":[' || string_agg('{"name":"' || r_name || '","outcome":"tp"}', ',' ORDER BY r_name) || ']}' FROM region""",
    "policy_gate": """WITH i AS (SELECT unnest(range(36)) AS i), live AS (SELECT i, i % 3 = 0 AS sym, i % 2 = 0 AS elevated FROM i WHERE i % 5 <> 0 AND i % 7 <> 0),
      f AS (SELECT l_orderkey % 300 AS project, l_orderkey AS p, l_partkey AS k FROM lineitem),
      g AS (SELECT project, k % 4 IN (2, 3) AND p % 11 <> 0 AND k % 7 <> 0 AND (k % 5 = 4 OR k % 13 = 0 OR k % 97 >= 96) AND NOT EXISTS (SELECT 1 FROM live WHERE i = k % 40 AND (NOT sym OR k % 3 = 1) AND (NOT (k % 4 = 3 AND k % 5 = 4) OR elevated)) AS gates FROM f)
      SELECT project, bool_or(gates) AS gate_failed, CASE WHEN bool_or(gates) THEN 1 WHEN project % 2 = 0 THEN 3 ELSE 0 END AS exit_code FROM g GROUP BY project""",
    "freshness": "SELECT source, age > 50000 AS stale, age > 80000 AS incomplete FROM (SELECT 's' || (user_id % 40) AS source, epoch(TIMESTAMP '2024-01-31 12:00:00') - epoch(max(ts)) AS age FROM events GROUP BY 1)",
}
