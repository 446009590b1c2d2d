"""Queries of the readers: texts of files and feeds are written from the driver's tables and read back; the oracles take the rows straight from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.functions import grammars
from veristrata.operators import graph, reach
from veristrata.session import table
from veristrata.sources import code, feeds, lockfiles, projects


def _lines(spark, sf, line, head="", tail="", joint="\n"):
    """path (brand), content: a line for each part, in order of its key."""
    rows = table(spark, sf, "part").groupBy(F.col("p_brand").alias("path")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("l"))
    return rows.select("path", F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), joint), F.lit(tail)).alias("content"))


KEY, SIZE = "p_partkey", "p_size"


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _key():
    return F.col(KEY), F.col(SIZE)


def _read(spark, sf, kind, *args, **more):
    rows = lockfiles.read(_lines(spark, sf, *args, **more), kind)
    return rows.select("path", "name", "version", "dep_type")


def read_gradle(spark, sf):
    k, s = _key()
    configs = F.when(s % 4 == 0, "testCompile,unitTest").when(s % 4 == 1, "compile,testX").when(s % 4 == 2, "latest").otherwise("")
    return _read(spark, sf, "gradle.lockfile", _text("g:a", k, ":", s, ".0=", configs), head="# c\n", tail="\nempty=\n")


def read_gems(spark, sf):
    k, s = _key()
    return _read(spark, sf, "Gemfile.lock", _text("    gem", k, " (1.", s, F.when(s % 2 == 0, "-x86_64-linux").otherwise(""), ")\n      dep (>= 1)"), head="PATH\n  specs:\n    own (0.1)\n\nGEM\n  specs:\n", tail="\n\nPLATFORMS\n    ruby (1)\n")


def read_hex(spark, sf):
    """Of both lockfiles of a project, each name and version once."""
    k, s = _key()
    mix = _read(spark, sf, "mix.lock", _text('  "m', k % 40, '": {:hex, :m', k % 40, ', "', s, '.0.0", "x"},'), head="%{\n", tail="\n}")
    rebar = _read(spark, sf, "rebar.lock", _text('{<<"m', k % 60, '">>,{pkg,<<"m', k % 60, '">>,<<"', s, '.0.0">>},0}'), head='{"1.2.0",\n[', tail="]}.", joint=",\n")
    return lockfiles.union_of(*[r.withColumnRenamed("path", "project") for r in (mix, rebar)]).select("project", "name", "version")


def read_pub(spark, sf):
    k, s = _key()
    kind = F.element_at(F.array(*map(F.lit, ("direct dev", "direct main", "transitive", "other"))), (s % 4 + 1).cast("int"))
    return _read(spark, sf, "pubspec.lock", _text("  pkg", k, ':\n    dependency: "', kind, '"\n    description:\n      name: x\n    source: ', F.when(s % 7 == 0, "git").otherwise("hosted"), '\n    version: "', s, '.0.1"'), head="packages:\n", tail='\nsdks:\n  dart: ">=2.0.0"\n')


def read_swift(spark, sf):
    k, s = _key()
    pin = _text('{"location":"', F.when(s % 2 == 0, "https://GitHub.com/o/r").otherwise("git@Host.x:o/r"), k, '.git","state":{', F.when(s % 5 == 0, '"branch":"main"').otherwise(_text('"version":"', s, '.0"')), "}}")
    files = _lines(spark, sf, pin, head='{"version":2,"pins":[', tail="]}", joint=",")
    return lockfiles.read(files, "Package.resolved").join(lockfiles.closure(files, "Package.resolved"), "path").select("path", "name", "version", "complete")


def read_nuget(spark, sf):
    """The first complete tier of each project; names without case."""
    k, s = _key()
    lock = _lines(spark, sf, _text('"net', s % 3, F.lit("_"), k, '":{"', F.when(s % 2 == 0, "Lib").otherwise("lib"), k % 50, '":{"type":"', F.when(s % 6 == 0, "Project").otherwise("Direct"), '","resolved":"', s, '.0"}}'), head='{"version":1,"dependencies":{', tail="}}", joint=",")
    config = _lines(spark, sf, _text('<package id="C', k, '" version="', s, '.1" />'), head="<packages>", tail="</packages>")
    broken = F.col("path").rlike("[13579]$")
    lock = lock.withColumn("content", F.when(broken, "{").otherwise(F.col("content")))
    rows, status = [], []
    for tier, (kind, files) in enumerate((("packages.lock.json", lock), ("packages.config", config))):
        rows.append(lockfiles.read(files, kind).select(F.col("path").alias("project"), F.lit(tier).alias("tier"), F.lower("name").alias("name"), "version"))
        status.append(lockfiles.closure(files, kind).select(F.col("path").alias("project"), F.lit(tier).alias("tier"), "complete"))
    return lockfiles.first_tier(rows[0].union(rows[1]), status[0].union(status[1])).select("project", "name", "version")


def read_pom(spark, sf):
    k, s = _key()
    version = F.when(s % 5 == 0, "").when(s % 5 == 1, "<version>${v}</version>").otherwise(_text("<version> ", s, ".0 </version>"))
    scope = F.when(s % 3 == 0, "<scope>test</scope>").when(s % 3 == 1, "<optional>true</optional>").otherwise("")
    dep = _text("<dependency><groupId>g</groupId><artifactId>a", k, "</artifactId>", version, scope, "</dependency>")
    return _read(spark, sf, "pom.xml", dep, head="<project><dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>a1</artifactId><version>7</version></dependency></dependencies></dependencyManagement><dependencies>", tail="</dependencies></project>")


def read_npm_family(spark, sf):
    """npm, yarn and pnpm locks of the same packages."""
    k, s = _key()
    name = _text(F.when(s % 3 == 0, "@s/").otherwise(""), "n", k)
    npm = _read(spark, sf, "package-lock.json", _text('"node_modules/x/node_modules/', name, '":{"version":"', s, '.0.0"', F.when(s % 2 == 0, ',"dev":true').otherwise(""), "}"), head='{"packages":{"":{"version":"1"},', tail="}}", joint=",").withColumn("tool", F.lit("npm"))
    yarn = _read(spark, sf, "yarn.lock", _text('"', name, '@^1", "', name, '@~1":\n  version "', s, '.0.0"\n  resolved "u"\n'), head="# yarn lockfile v1\n\n\n").withColumn("tool", F.lit("yarn"))
    pnpm = _read(spark, sf, "pnpm-lock.yaml", _text("  /", name, "@", s, ".0.0", F.when(s % 4 == 0, "(peer@1.0.0)").otherwise(""), ":\n    resolution: {integrity: x}\n    dev: ", F.when(s % 2 == 0, "true").otherwise("false"), "\n"), head="lockfileVersion: '6.0'\n\npackages:\n\n").withColumn("tool", F.lit("pnpm"))
    return npm.union(yarn).union(pnpm)


def read_python_family(spark, sf):
    """Poetry, Pipfile and requirements locks, classified by the project's groups."""
    k, s = _key()
    poetry = _read(spark, sf, "poetry.lock", _text('[[package]]\nname = "Py_', k, '"\nversion = "', s, '.0"\n\n[package.dependencies]\nname = "no"\n')).withColumn("tool", F.lit("poetry"))
    pipfile = _read(spark, sf, "Pipfile.lock", _text('"Py_', k, '":{"version":"==', s, '.0"}'), head='{"default":{', tail='},"develop":{}}', joint=",").withColumn("tool", F.lit("pipfile"))
    pinned = _read(spark, sf, "requirements.txt", _text("Py_", k, F.when(s % 3 == 0, "[x]==").when(s % 3 == 1, " == ").otherwise(">="), s, ".0 ; python_version > '3'"), head="# pinned\n-r other.txt\n").withColumn("tool", F.lit("requirements"))
    every = poetry.union(pipfile).union(pinned)
    groups = table(spark, sf, "part").select(F.col("p_brand").alias("project"), _text("py-", k).alias("name"), F.when(s % 5 == 0, "runtime").when(s % 5 == 1, "extra").otherwise("dev").alias("kind"), F.when(s % 5 == 2, "tests").when(s % 5 == 3, "docs").otherwise("x").alias("grp"))
    rows = every.select(F.concat_ws("|", "path", "tool").alias("project"), "name", "version")
    tools = F.explode(F.array(*map(F.lit, ("poetry", "pipfile", "requirements"))))
    groups = groups.withColumn("tool", tools).withColumn("project", F.concat_ws("|", "project", "tool")).drop("tool")
    return lockfiles.classify_by_project(rows, groups)


def cargo_closure(spark, sf):
    """Packages with the kinds of dependency that use them, and whether the closure is whole."""
    k, s = _key()
    rows = table(spark, sf, "part").groupBy(F.col("p_brand").alias("path")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), s.alias("s")))).alias("l"), F.max(k).alias("top"))
    id_ = lambda x: F.concat(F.lit("c"), x.cast("string"), F.lit(" 1.0 (r)"))
    packages = F.transform("l", lambda x: F.struct(id_(x["k"]).alias("id"), F.concat(F.lit("c"), x["k"].cast("string")).alias("name"), F.lit("1.0").alias("version")))
    kinds = lambda x: F.when(x["s"] % 3 == 0, F.array(F.struct(F.lit(None).cast("string").alias("kind")))).when(x["s"] % 3 == 1, F.array(F.struct(F.lit("dev").alias("kind")))).otherwise(F.array(F.struct(F.lit("build").alias("kind")), F.struct(F.lit("dev").alias("kind"))))
    deps = F.transform("l", lambda x: F.struct(F.lit("x").alias("name"), F.when((x["s"] == 50) & (x["k"] % 2 == 0), F.lit("gone")).otherwise(id_(x["k"])).alias("pkg"), kinds(x).alias("dep_kinds")))
    text = F.to_json(F.struct(packages.alias("packages"), F.array(id_(F.col("top"))).alias("workspace_members"), F.struct(F.array(F.struct(id_(F.col("top")).alias("id"), deps.alias("deps"))).alias("nodes")).alias("resolve")))
    packages, status = lockfiles.cargo(rows.select("path", text.alias("content")))
    return packages.join(status, "path").select("path", "name", "as_normal", "as_dev", "as_build", "complete")


def projects_found(spark, sf):
    """Folders with marker files, to five levels and outside pruned ones, by ecosystem."""
    k, s = _key()
    file = F.element_at(F.array(*map(F.lit, ("go.mod", "package.json", "App.csproj", "pom.xml", "README.md"))), (s % 5 + 1).cast("int"))
    folder = F.concat(F.when(s % 6 == 0, "node_modules/").otherwise(""), F.repeat(F.lit("d/"), (k % 8).cast("int")))
    paths = table(spark, sf, "part").select(F.col("p_brand").alias("project"), F.concat(folder, file).alias("path"))
    found = lockfiles.detect(paths)
    return found.groupBy("project", "ecosystem").agg(F.count("*").alias("n")).join(lockfiles.discovery_status(found, 12), "project").select("project", "ecosystem", "n", "capped")


def platforms(spark, sf):
    names = lambda c: F.when(c % 4 == 0, F.array(F.lit("linux"))).when(c % 4 == 1, F.array(F.lit("!linux"))).when(c % 4 == 2, F.array(F.lit("darwin"), F.lit("win32"))).otherwise(F.array().cast("array<string>"))
    k, s = _key()
    cpu = F.when(k % 3 == 0, F.array(F.lit("!x64"))).when(k % 3 == 1, F.array(F.lit("x64")))
    return table(spark, sf, "part").select(KEY, lockfiles.platform_excluded(names(s), cpu, "linux", "x64").alias("excluded"))


def osv_records(spark, sf):
    """Records with several packages and events out of every shape, as rows."""
    k, s = _key()
    event = lambda n, v: F.create_map(F.lit(n), v.cast("string"))
    events = F.array(event("introduced", F.when(s % 3 == 0, "0").otherwise(s)), event(("fixed"), s + 5), event("introduced", s + 9))
    git = F.struct(F.lit("GIT").alias("type"), F.array(event("introduced", F.lit("abc"))).alias("events"))
    ranges = F.when(s % 4 == 0, F.array(git)).otherwise(F.array(git, F.struct(F.lit("SEMVER").alias("type"), events.alias("events"))))
    package = lambda e, n: F.struct(F.struct(F.lit(e).alias("ecosystem"), n.alias("name")).alias("package"), ranges.alias("ranges"))
    affected = F.array(package("npm", _text("Pkg", k)), package("PyPI", _text("Pkg", k)))
    refs = F.array(F.struct(F.lit("FIX").alias("type"), _text("u", s % 2).alias("url")), F.struct(F.lit("FIX").alias("type"), F.lit("u0").alias("url")), F.struct(F.lit("WEB").alias("type"), F.lit("w").alias("url")))
    text = F.to_json(F.struct(_text("A-", k).alias("id"), F.when(s % 10 == 0, "2024").otherwise("").alias("withdrawn"), affected.alias("affected"), refs.alias("references"), F.struct(F.when(s % 2 == 0, "High").otherwise("low").alias("severity")).alias("database_specific")))
    rows = table(spark, sf, "part").select(F.when(s % 9 == 0, "{broken").otherwise(text).alias("content"))
    shown = F.array_join(F.transform("version_ranges", lambda r: F.concat_ws("/", r["introduced"], r["fixed"], r["last_affected"])), ";")
    return feeds.advisories(rows).select("id", "ecosystem", "name", shown.alias("ranges"), "undecidable_ranges", F.array_join("fix_refs", ",").alias("fix_refs"), "severity")


def module_records(spark, sf):
    """Records of a module database: one row each, the ranges of all packages, an open one if there is none."""
    k, s = _key()
    event = lambda n, v: F.create_map(F.lit(n), v.cast("string"))
    rng = F.struct(F.lit("SEMVER").alias("type"), F.array(event("introduced", F.lit("0")), event("fixed", s)).alias("events"))
    package = lambda e, n, r: F.struct(F.struct(F.lit(e).alias("ecosystem"), n.alias("name")).alias("package"), r.alias("ranges"))
    none = F.slice(F.array(rng), 1, 0)
    affected = F.array(package("npm", F.lit("x"), F.array(rng)), package("go", _text("m", k), F.when(s % 3 == 0, none).otherwise(F.array(rng))), package("Go", _text("m", k, "/v2"), F.when(s % 2 == 0, F.array(rng)).otherwise(none)))
    rows = table(spark, sf, "part").select(F.to_json(F.struct(_text("GO-", k).alias("id"), affected.alias("affected"))).alias("content"))
    return feeds.module_advisories(rows).select("id", "name", F.array_join(F.transform("version_ranges", lambda r: F.concat_ws("/", r["introduced"], r["fixed"], r["last_affected"])), ";").alias("ranges"))


def graph_records(spark, sf):
    """Pages of a graph service: ranges by the comma grammar; exclusive lower bounds are undecidable."""
    k, s = _key()
    rng = F.when(s % 5 == 0, _text(">= ", s, ", < ", s + 2)).when(s % 5 == 1, _text("<= ", s)).when(s % 5 == 2, _text("= ", s)).when(s % 5 == 3, _text("> ", s)).otherwise(_text("< ", s))
    advisory = F.struct(_text("G-", k).alias("ghsaId"), F.when(s % 11 == 0, "2024").alias("withdrawnAt"), F.array(F.struct(F.lit("CVE").alias("type"), _text("CVE-", k).alias("value"))).alias("identifiers"))
    node = F.struct(F.struct(_text("P", k).alias("name"), F.when(s % 2 == 0, "PIP").otherwise("NPM").alias("ecosystem")).alias("package"), rng.alias("vulnerableVersionRange"), F.lit("MODERATE").alias("severity"), advisory.alias("advisory"))
    pages = table(spark, sf, "part").groupBy(F.floor(k / 100)).agg(F.to_json(F.struct(F.struct(F.struct(F.collect_list(node).alias("nodes")).alias("securityVulnerabilities")).alias("data"))).alias("content"))
    one = lambda r: F.concat_ws("/", r["introduced"], r["fixed"], r["last_affected"])
    return feeds.graph_pages(pages).select("id", "ecosystem", "name", F.array_join(F.transform("version_ranges", one), ";").alias("ranges"), "undecidable_ranges", "severity")


def tree_records(spark, sf):
    """Files of an advisory tree: identifiers, ranges by the constraint grammar, closed by a single fixed version."""
    k, s = _key()
    rng = F.when(s % 6 == 0, _text(">=", s, ".0")).when(s % 6 == 1, _text("^1.", s)).when(s % 6 == 2, _text("[", s, ",", s + 1, ")")).when(s % 6 == 3, _text("~", s, " || =9")).when(s % 6 == 4, _text("<", s, " odd")).otherwise(_text("<=", s, ",>1"))
    text = _text("identifier: GMS-", k, "\nidentifiers:\n- GHSA-", k, "\n", F.when(s % 2 == 0, _text("- CVE-2024-", k, "\n")).otherwise(""), 'affected_range: "', rng, '"\nfixed_versions:\n- "', s, '.9"\ncwe_ids:\n- CWE-', s, "\n- 79\n")
    rows = table(spark, sf, "part").select(_text(F.when(s % 4 == 0, "maven/org/").when(s % 4 == 1, "odd/").otherwise("npm/@s/"), "p", k, "/a.yml").alias("path"), text.alias("content"))
    one = lambda r: F.concat_ws("/", r["introduced"], r["fixed"], r["last_affected"])
    return feeds.tree(rows).select("id", "ecosystem", "name", F.array_join(F.transform("version_ranges", one), ";").alias("ranges"), "undecidable_ranges", F.array_join("cwes", ",").alias("cwes"))


def tool_reports(spark, sf):
    """Reports of three tools and a message stream as common findings."""
    k, s = _key()
    part = table(spark, sf, "part")
    id_, alias, name, version = _text("A-", k), _text("B-", s), _text("p", k), _text(s, ".0")
    osv = F.struct(F.array(F.struct(F.array(F.struct(F.struct(name.alias("name"), version.alias("version"), F.lit("npm").alias("ecosystem")).alias("package"), F.array(F.struct(id_.alias("id"), F.array(alias).alias("aliases"))).alias("vulnerabilities"))).alias("packages"))).alias("results"))
    grype = F.struct(F.array(F.struct(F.struct(id_.alias("id")).alias("vulnerability"), F.array(F.struct(alias.alias("id"))).alias("relatedVulnerabilities"), F.struct(name.alias("name"), version.alias("version"), F.lit("npm").alias("type")).alias("artifact"))).alias("matches"))
    trivy = F.struct(F.array(F.struct(F.lit("npm").alias("Type"), F.array(F.struct(id_.alias("VulnerabilityID"), name.alias("PkgName"), version.alias("InstalledVersion"))).alias("Vulnerabilities"))).alias("Results"))
    go = F.when(s % 2 == 0, F.to_json(F.struct(F.struct(_text("A-", k + 1).alias("id"), F.array(_text("C-", k + 1)).alias("aliases")).alias("osv")))).otherwise(F.to_json(F.struct(F.struct(id_.alias("osv"), F.array(F.struct(name.alias("module"), version.alias("version"))).alias("trace")).alias("finding"))))
    out = feeds.tool_findings(part.select(go.alias("content")), "govulncheck")
    for tool, text in (("osv-scanner", osv), ("grype", grype), ("trivy", trivy)):
        out = out.union(feeds.tool_findings(part.select(F.to_json(text).alias("content")), tool))
    return out.select("tool", "id", F.array_join("ids", ",").alias("ids"), "package", "version")


def range_grammar(spark, sf):
    """Constraint texts as ranges; each distinct text is parsed once."""
    k, s = _key()
    text = F.element_at(F.array(*[_text(*x) for x in ((">=", s, " <", s + 1), ("^0.", s, ".1"), ("~", s, ".2"), ("(,", s, "]"), ("==", s), ("*",), (">", s, ",x y"))]), (k % 7 + 1).cast("int"))
    rows = table(spark, sf, "part").select(KEY, text.alias("text"))
    parsed = rows.select("text").distinct().withColumn("r", grammars.constraint_range("text", F.lit(None).cast("array<string>")))
    return rows.join(parsed, "text").select(KEY, F.array_join(F.transform("r", lambda r: F.concat_ws("/", r["introduced"], r["fixed"], r["last_affected"])), ";").alias("ranges"))


def patch_lines(spark, sf):
    """Lines that a diff adds, by their number in the new file, and the symbols that they touch."""
    k, s = _key()
    text = _text("--- a/f.py\n+++ b/f.py\n@@ -", s, ",2 +", s, ",3 @@\n a\n+b\n-c\n+d\n@@ -90 +", s + 100, " @@\n+e\n")
    patches = table(spark, sf, "part").select(_text("A-", k % 300).alias("advisory"), _text("p", k).alias("patch"), text.alias("content"))
    regions = table(spark, sf, "part").select(_text("p", k).alias("patch"), F.lit("f.py").alias("file"), F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(n).alias("symbol")) for a, b, n in ((1, 20, "f"), (21, 40, "g"), (41, 110, "h"), (140, 145, "i"))])).alias("r")).select("patch", "file", "r.*")
    return reach.fixed_symbols(patches, regions)


def python_sources(spark, sf):
    """Imports, definitions and marks of generated modules; some do not parse."""
    k, s = _key()
    text = F.when(s % 10 == 0, "def (").otherwise(_text("import m", s, "\nclass C", k % 7, ":\n    def f(self):\n        return ", F.when(s % 4 == 0, "eval('1')").otherwise("g(1)"), "\n"))
    files = table(spark, sf, "part").select(F.col("p_brand").alias("project"), _text("f", k, ".py").alias("file"), text.alias("content"))
    return code.python(files).groupBy("project", "kind", F.coalesce("target", "name").alias("what")).agg(F.count("*").alias("n"))


def script_frontiers(spark, sf):
    """Import search through generated scripts: files reached from an entry, and what cannot be followed there."""
    k, s = _key()
    text = _text("import x from 'f", k * 2, "';\nconst y = require('f", k * 2 + 1, "');\n", F.when(s % 9 == 0, "import(z);\n").otherwise(""), "// import 'no'\n")
    files = table(spark, sf, "part").select(F.lit("p").alias("project"), _text("f", k).alias("file"), text.alias("content"))
    known = files.select(F.col("file").alias("dst"))
    found = code.script(files).join(known, F.col("specifier") == F.col("dst"), "left")
    imports = found.select("project", F.col("file").alias("src"), "dst", F.when(F.col("kind") == "dynamic", "dynamic").otherwise("static").alias("kind"))
    entry = files.filter("file = 'f1'").select("project", F.col("file").alias("node"))
    fidelity = files.select("project", F.col("file").alias("node"), F.when(F.substring("file", 2, 20).cast("int") % 50 == 0, "reduced").otherwise("source").alias("fidelity"))
    seen, frontiers = graph.module_search(imports, entry, fidelity)
    return frontiers.groupBy("reason").agg(F.count("*").alias("n")).union(seen.agg(F.lit("reached").alias("reason"), F.count("*").alias("n")))


def read_go_list(spark, sf):
    k, s = _key()
    return _read(spark, sf, "go-list.json", _text('{\n\t"Path": "mod/m', k, '",\n', F.when(s % 8 == 0, '\t"Main": true').otherwise(_text('\t"Version": "v1.', s, '.0"')), "\n}"))


def workspace_folders(spark, sf):
    k, s = _key()
    part = table(spark, sf, "part")
    folder = F.when(s % 4 == 0, "").when(s % 4 == 1, _text("packages/w", k)).when(s % 4 == 2, _text("packages/w", k, "/deep")).otherwise(_text("apps/v", k))
    manifests = part.select(F.col("p_brand").alias("project"), folder.alias("folder"), F.when(k % 2 == 0, _text("n", k)).alias("name"))
    odd = F.col("p_brand").rlike("[13579]$")
    globs = part.filter(odd).select(F.col("p_brand").alias("project"), F.explode(F.array(F.lit("packages/*"), F.lit("./apps/**"), F.lit("!apps/v1*"), F.lit("gone"))).alias("glob")).distinct()
    found = projects.workspaces(manifests, globs).groupBy("project").agg(F.count("*").alias("n"), F.max("name").alias("last"))
    return found.join(projects.missing_workspaces(manifests, globs).withColumnRenamed("folder", "missing"), "project", "left")


def manifest_entries(spark, sf):
    k, s = _key()
    part = table(spark, sf, "part")
    content = F.when(s % 4 == 0, '{"bin":{"x":"./cli"},"main":"m.js"}').when(s % 4 == 1, '{"exports":{".":{"require":"./r.cjs"}},"main":"m.js"}').when(s % 4 == 2, '{"main":"lib"}').otherwise("{}")
    manifests = part.select(F.col("p_brand").alias("project"), _text("w", k).alias("folder"), content.alias("content"))
    files = part.select(F.col("p_brand").alias("project"), F.explode(F.array(_text("w", k, "/cli.mjs"), _text("w", k, "/lib.ts"), F.when(k % 2 == 0, _text("w", k, "/index.cjs")), _text("w", k, "/index.ts"))).alias("path")).filter("path is not null")
    return projects.entry_files(manifests, files)


def weakness_names(spark, sf):
    k, s = _key()
    rows = table(spark, sf, "part").select(k.alias("id"), F.array(_text("CWE-", s), _text("CWE-", s + 1)).alias("cwes"))
    names = table(spark, sf, "nation").select(_text("CWE-", F.col("n_nationkey")).alias("cwe"), F.col("n_name").alias("name"))
    return projects.named_weaknesses(rows, names)


def reduced_scopes(spark, sf):
    line = table(spark, sf, "lineitem")
    reached = table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("project"), F.col("p_size").cast("bigint").alias("package")).distinct()
    closures = line.select((F.col("l_partkey") % 50).alias("project"), (F.col("l_suppkey") % 90).alias("package"), _text("d", F.col("l_linenumber")).alias("dep"))
    return projects.reduced_scope(reached, closures).select("project", F.array_join("could_reach", ",").alias("could_reach"))


QUERIES = {f.__name__: f for f in (read_go_list, workspace_folders, manifest_entries, weakness_names, reduced_scopes, read_gradle, read_gems, read_hex, read_pub, read_swift, read_nuget, read_pom, read_npm_family, read_python_family, cargo_closure, projects_found, platforms, osv_records, module_records, graph_records, tree_records, tool_reports, range_grammar, patch_lines, python_sources, script_frontiers)}

ORACLES = {
    "read_go_list": "SELECT p_brand AS path, 'mod/m' || p_partkey AS name, 'v1.' || p_size || '.0' AS version, 'runtime' AS dep_type FROM part WHERE p_size % 8 <> 0",
    "workspace_folders": """WITH m AS (SELECT p_brand AS project, regexp_matches(p_brand, '[13579]$') AS globs, p_size % 4 AS c, p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'n' || p_partkey END AS name FROM part),
      w AS (SELECT DISTINCT project, globs, CASE WHEN globs THEN k END AS k, coalesce(name, CASE WHEN NOT globs THEN '' WHEN c = 1 THEN 'w' || k ELSE 'v' || k END) AS name FROM m WHERE CASE WHEN globs THEN c = 1 OR c = 3 AND NOT starts_with(CAST(k AS VARCHAR), '1') ELSE c = 0 END)
      SELECT project, count(*) AS n, max(name) AS last, CASE WHEN any_value(globs) THEN 'gone' END AS missing FROM w GROUP BY project""",
    "manifest_entries": """SELECT p_brand AS project, 'w' || p_partkey AS folder, 'w' || p_partkey || '/' || e.f AS file, e.k AS kind FROM (SELECT *, unnest(CASE p_size % 4 WHEN 0 THEN [{'f': 'cli.mjs', 'k': 'bin'}, {'f': 'm.js', 'k': 'main'}] WHEN 1 THEN [{'f': 'r.cjs', 'k': 'exports'}] WHEN 2 THEN [{'f': 'lib.ts', 'k': 'main'}] ELSE [{'f': CASE WHEN p_partkey % 2 = 0 THEN 'index.cjs' ELSE 'index.ts' END, 'k': 'main'}] END) AS e FROM part)""",
    "weakness_names": "SELECT p_partkey AS id, 'CWE-' || p_size || coalesce(': ' || a.n_name, '') || '; CWE-' || (p_size + 1) || coalesce(': ' || b.n_name, '') AS weaknesses FROM part LEFT JOIN nation a ON a.n_nationkey = p_size LEFT JOIN nation b ON b.n_nationkey = p_size + 1",
    "reduced_scopes": "SELECT l_partkey % 50 AS project, string_agg(DISTINCT 'd' || l_linenumber, ',' ORDER BY 'd' || l_linenumber) AS could_reach FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey % 50 = l_partkey % 50 AND p_size = l_suppkey % 90) GROUP BY 1",
    "read_gradle": "SELECT p_brand AS path, 'g:a' || p_partkey AS name, p_size || '.0' AS version, CASE WHEN p_size % 4 = 0 THEN 'test' ELSE 'runtime' END AS dep_type FROM part",
    "read_gems": "SELECT DISTINCT p_brand AS path, 'gem' || p_partkey AS name, '1.' || p_size AS version, 'runtime' AS dep_type FROM part",
    "read_hex": "SELECT DISTINCT p_brand AS project, 'm' || (p_partkey % m) AS name, p_size || '.0.0' AS version FROM part, (SELECT unnest([40, 60]) AS m)",
    "read_pub": "SELECT p_brand AS path, 'pkg' || p_partkey AS name, p_size || '.0.1' AS version, ['dev', 'runtime', 'runtime', ''][p_size % 4 + 1] AS dep_type FROM part WHERE p_size % 7 <> 0",
    "read_swift": "SELECT p_brand AS path, CASE WHEN p_size % 2 = 0 THEN 'github.com/o/r' ELSE 'host.x/o/r' END || p_partkey AS name, p_size || '.0' AS version, NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_size % 5 = 0) AS complete FROM part p WHERE p_size % 5 <> 0",
    "read_nuget": "SELECT DISTINCT p_brand AS project, CASE WHEN regexp_matches(p_brand, '[13579]$') THEN 'c' || p_partkey ELSE 'lib' || (p_partkey % 50) END AS name, p_size || CASE WHEN regexp_matches(p_brand, '[13579]$') THEN '.1' ELSE '.0' END AS version FROM part WHERE regexp_matches(p_brand, '[13579]$') OR p_size % 6 <> 0",
    "read_pom": "SELECT p_brand AS path, 'g:a' || p_partkey AS name, CASE WHEN p_size % 5 = 0 THEN '7' ELSE p_size || '.0' END AS version, CASE WHEN p_size % 3 = 2 THEN 'runtime' ELSE 'dev' END AS dep_type FROM part WHERE p_size % 5 > 1 OR p_size % 5 = 0 AND p_partkey = 1",
    "read_npm_family": "SELECT p_brand AS path, CASE WHEN p_size % 3 = 0 THEN '@s/' ELSE '' END || 'n' || p_partkey AS name, p_size || '.0.0' AS version, CASE WHEN p_size % 2 = 0 AND tool <> 'yarn' THEN 'dev' ELSE 'runtime' END AS dep_type, tool FROM part, (SELECT unnest(['npm', 'yarn', 'pnpm']) AS tool)",
    "read_python_family": "SELECT p_brand || '|' || tool AS project, 'Py_' || p_partkey AS name, p_size || '.0' AS version, ['runtime', 'optional-extra', 'test', 'docs', 'dev'][p_size % 5 + 1] AS dep_type FROM part, (SELECT unnest(['poetry', 'pipfile', 'requirements']) AS tool) WHERE tool <> 'requirements' OR p_size % 3 < 2",
    "cargo_closure": """WITH t AS (SELECT p_brand, max(p_partkey) AS top, bool_or(p_size = 50 AND p_partkey % 2 = 0) AS gone FROM part GROUP BY 1)
      SELECT p_brand AS path, 'c' || p_partkey AS name, p_partkey = top OR used AND p_size % 3 = 0 AS as_normal, used AND p_size % 3 <> 0 AS as_dev, used AND p_size % 3 = 2 AS as_build, NOT gone AS complete FROM (SELECT *, NOT (p_size = 50 AND p_partkey % 2 = 0) AS used FROM part) JOIN t USING (p_brand)""",
    "projects_found": """WITH f AS (SELECT DISTINCT p_brand AS project, p_partkey % 8 AS depth, ['Go', 'npm', 'NuGet', 'Maven'][p_size % 5 + 1] AS ecosystem FROM part WHERE p_size % 5 < 4 AND p_size % 6 <> 0 AND p_partkey % 8 <= 5)
      SELECT project, ecosystem, count(*) AS n, any_value(c) AS capped FROM f JOIN (SELECT project, count(DISTINCT depth) > 12 AS c FROM f GROUP BY project) USING (project) GROUP BY project, ecosystem""",
    "platforms": "SELECT p_partkey, p_size % 4 IN (1, 2) OR p_partkey % 3 = 0 AS excluded FROM part",
    "osv_records": """SELECT 'A-' || p_partkey AS id, e AS ecosystem, CASE WHEN e = 'npm' THEN 'pkg' ELSE 'Pkg' END || p_partkey AS name, CASE WHEN p_size % 4 = 0 THEN '' ELSE CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END || '/' || (p_size + 5) || '/;' || (p_size + 9) || '//' END AS ranges,
      p_size % 4 = 0 AS undecidable_ranges, CASE WHEN p_size % 2 = 0 THEN 'u0' ELSE 'u0,u1' END AS fix_refs, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 1 END AS severity FROM part, (SELECT unnest(['npm', 'PyPI']) AS e) WHERE p_size % 9 <> 0 AND p_size % 10 <> 0""",
    "module_records": "SELECT 'GO-' || p_partkey AS id, 'm' || p_partkey AS name, CASE WHEN p_size % 3 <> 0 AND p_size % 2 = 0 THEN '/' || p_size || '/;/' || p_size || '/' WHEN p_size % 3 <> 0 OR p_size % 2 = 0 THEN '/' || p_size || '/' ELSE '//' END AS ranges FROM part",
    "graph_records": "SELECT 'G-' || p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'PyPI' ELSE 'npm' END AS ecosystem, CASE WHEN p_size % 2 = 0 THEN 'P' ELSE 'p' END || p_partkey AS name, CASE p_size % 5 WHEN 0 THEN p_size || '/' || (p_size + 2) || '/' WHEN 1 THEN '//' || p_size WHEN 2 THEN p_size || '//' || p_size WHEN 3 THEN '' ELSE '/' || p_size || '/' END AS ranges, p_size % 5 = 3 AS undecidable_ranges, 2 AS severity FROM part WHERE p_size % 11 <> 0",
    "tree_records": """SELECT CASE WHEN p_size % 2 = 0 THEN 'CVE-2024-' ELSE 'GHSA-' END || p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'Maven' ELSE 'npm' END AS ecosystem, CASE WHEN p_size % 4 = 0 THEN 'org:p' ELSE '@s/p' END || p_partkey AS name,
      CASE p_size % 6 WHEN 0 THEN p_size || '.0/' || p_size || '.9/' WHEN 1 THEN '1.' || p_size || '/2.0.0/' WHEN 2 THEN p_size || '/' || (p_size + 1) || '/' WHEN 3 THEN p_size || '/' || (p_size + 1) || '.0.0/;9//9' WHEN 4 THEN '' ELSE '1//' || p_size END AS ranges, p_size % 6 = 4 AS undecidable_ranges, CASE WHEN p_size = 79 THEN 'CWE-79' ELSE 'CWE-' || least(p_size, 79) || ',CWE-' || greatest(p_size, 79) END AS cwes FROM part WHERE p_size % 4 <> 1""",
    "tool_reports": """SELECT tool, 'A-' || p_partkey AS id, 'A-' || p_partkey || CASE WHEN tool = 'trivy' THEN '' ELSE ',B-' || p_size END AS ids, 'p' || p_partkey AS package, p_size || '.0' AS version FROM part, (SELECT unnest(['osv-scanner', 'grype', 'trivy']) AS tool)
      UNION ALL SELECT 'govulncheck', 'A-' || p.p_partkey, 'A-' || p.p_partkey || CASE WHEN q.p_partkey IS NULL THEN '' ELSE ',C-' || p.p_partkey END, 'p' || p.p_partkey, p.p_size || '.0' FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey - 1 AND q.p_size % 2 = 0 WHERE p.p_size % 2 = 1""",
    "range_grammar": "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_size || '/' || (p_size + 1) || '/' WHEN 1 THEN '0.' || p_size || '.1/' || CASE WHEN p_size = 0 THEN '0.0.2' ELSE '0.' || (p_size + 1) || '.0' END || '/' WHEN 2 THEN p_size || '.2/' || p_size || '.3.0/' WHEN 3 THEN '//' || p_size WHEN 4 THEN p_size || '//' || p_size WHEN 5 THEN '//' END AS ranges FROM part",
    "patch_lines": """WITH l AS (SELECT p_partkey AS k, unnest([p_size + 1, p_size + 2, p_size + 100]) AS line FROM part)
      SELECT DISTINCT 'A-' || (k % 300) AS advisory, symbol FROM l JOIN (VALUES (1, 20, 'f'), (21, 40, 'g'), (41, 110, 'h'), (140, 145, 'i')) r(a, b, symbol) ON line BETWEEN a AND b""",
    "python_sources": """SELECT project, kind, what, count(*) AS n FROM (SELECT p_brand AS project, unnest(CASE WHEN p_size % 10 = 0 THEN [{'kind': 'error', 'what': 'SyntaxError'}] ELSE [{'kind': 'import', 'what': 'm' || p_size}, {'kind': 'def', 'what': 'C' || (p_partkey % 7)}, {'kind': 'def', 'what': 'C' || (p_partkey % 7) || '.f'},
      CASE WHEN p_size % 4 = 0 THEN {'kind': 'dynamic', 'what': 'eval'} ELSE {'kind': 'call', 'what': 'g'} END] END, recursive := true) FROM part) GROUP BY ALL""",
    "script_frontiers": """WITH RECURSIVE e AS (SELECT p.p_partkey AS a, q.p_partkey AS b FROM part p JOIN part q ON q.p_partkey IN (p.p_partkey * 2, p.p_partkey * 2 + 1) WHERE p.p_partkey % 50 <> 0),
      r AS (SELECT CAST(1 AS BIGINT) AS k UNION SELECT b FROM r JOIN e ON a = k), n AS (SELECT max(p_partkey) AS n FROM part)
      SELECT 'reached' AS reason, count(*) AS n FROM r UNION ALL SELECT 'fidelity-reduced', count(*) FROM r WHERE k % 50 = 0 HAVING count(*) > 0
      UNION ALL SELECT 'dynamic', count(*) FROM r JOIN part ON p_partkey = k WHERE p_size % 9 = 0 HAVING count(*) > 0 UNION ALL SELECT 'unresolved', count(*) FROM r, n WHERE k * 2 + 1 > n HAVING count(*) > 0""",
}
