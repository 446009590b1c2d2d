import json

import pytest
from pyspark.sql import functions as F

from veristrata.sources import feeds, lockfiles

FILES = {
    "go-list.json": ('{\n\t"Path": "main/m",\n\t"Main": true\n}\n{\n\t"Path": "a.b/c",\n\t"Version": "v1.2.3",\n\t"Replace": {\n\t\t"Dir": "x"\n\t}\n}\n', {("a.b/c", "v1.2.3", "runtime")}),
    "gradle.lockfile": ("# c\norg.a:b:1.0=compileClasspath,testX\norg.a:t:2.0=testRuntime,testCompile\nempty=\n", {("org.a:b", "1.0", "runtime"), ("org.a:t", "2.0", "test")}),
    "composer.lock": (json.dumps({"packages": [{"name": "A/b", "version": "v1.2"}], "packages-dev": [{"name": "c/d", "version": "3"}]}), {("a/b", "1.2", "runtime"), ("c/d", "3", "dev")}),
    "Gemfile.lock": ("﻿PATH\n  specs:\n    own (0.1)\n\nGEM\n  specs:\n    rack (2.0.1)\n      dep (>= 1)\n    noko (1.2-x86_64-linux)\n    noko (1.2)\n\nPLATFORMS\n    ruby (1)\n", {("rack", "2.0.1", "runtime"), ("noko", "1.2", "runtime")}),
    "mix.lock": ('%{\n  "jason": {:hex, :jason, "1.4.0", "x"},\n  "g": {:git, "u", "s"},\n}', {("jason", "1.4.0", "runtime")}),
    "pom.xml": ("<project><dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId><version>3</version></dependency></dependencies></dependencyManagement><dependencies><!-- <dependency><groupId>no</groupId></dependency> --><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1.0</version></dependency><dependency><groupId>g</groupId><artifactId>m</artifactId><scope>test</scope></dependency><dependency><groupId>g</groupId><artifactId>v</artifactId><version>${x}</version></dependency></dependencies></project>", {("g:a", "1.0", "runtime"), ("g:m", "3", "dev")}),
    "packages.lock.json": (json.dumps({"version": 1, "dependencies": {"net6.0": {"A": {"type": "Direct", "resolved": "1.0"}, "P": {"type": "Project", "resolved": "9"}}, "net7.0": {"a": {"type": "Transitive", "resolved": "1.0"}, "B": {"type": "Direct"}}}}), {("A", "1.0", "runtime")}),
    "project.assets.json": (json.dumps({"targets": {"net6.0": {"A/1.0": {"type": "package"}, "P/1": {"type": "project"}, "bad": {"type": "package"}}}}), {("A", "1.0", "runtime")}),
    "packages.config": ('<packages><package id="A" version="1.0" /><package id="D" version="2" developmentDependency="true"/></packages>', {("A", "1.0", "runtime"), ("D", "2", "dev")}),
    "csproj": ('<Project><PackageReference Include="A" Version="1.0" /><PackageReference Include="B"><Version>2.0</Version></PackageReference><PackageReference Include="C" Version="1.*" /></Project>', {("A", "1.0", "runtime"), ("B", "2.0", "runtime")}),
    "rebar.lock": ('{"1.2.0",\n[{<<"cow">>,{pkg,<<"cowlib">>,<<"2.1">>},1}]}.', {("cowlib", "2.1", "runtime")}),
    "pubspec.lock": ('packages:\n  a:\n    dependency: "direct dev"\n    description:\n      name: a\n    source: hosted\n    version: "1.0.0"\n  b:\n    dependency: transitive\n    source: hosted\n    version: "2.0.0"\n  s:\n    dependency: "direct main"\n    source: sdk\n    version: "0.0.0"\nsdks:\n  dart: ">=2"\n', {("a", "1.0.0", "dev"), ("b", "2.0.0", "runtime")}),
    "Package.resolved": (json.dumps({"version": 2, "pins": [{"location": "https://GitHub.com/a/B.git", "state": {"version": "1.0"}}, {"location": "git@h.x:a/c.git/", "state": {"version": "2.0"}}]}), {("github.com/a/b", "1.0", "runtime"), ("h.x/a/c", "2.0", "runtime")}),
    "yarn.lock": ('# yarn lockfile v1\n\n"@s/a@^1.0", "@s/a@~1":\n  version "1.2.0"\n  resolved "u"\n  dependencies:\n    b "^2"\n\nb@^2:\n  version "2.0.1"\n', {("@s/a", "1.2.0", "runtime"), ("b", "2.0.1", "runtime")}),
    "pnpm-lock.yaml": ("lockfileVersion: '6.0'\npackages:\n\n  /a@1.0.0:\n    dev: true\n\n  /@s/b@2.0.0(react@18):\n    dev: false\n\n  c@3.0.0: {}\n\nsnapshots:\n  d@1: {}\n", {("a", "1.0.0", "dev"), ("@s/b", "2.0.0", "runtime"), ("c", "3.0.0", "runtime")}),
    "poetry.lock": ('[[package]]\nname = "A.b"\nversion = "1.0"\ncategory = "dev"\n\n[package.dependencies]\nname = "x"\n\n[[package]]\nname = "c"\nversion = "2"\n\n[metadata]\nname = "no"\n', {("A.b", "1.0", "dev"), ("c", "2", "")}),
    "Pipfile.lock": (json.dumps({"default": {"a": {"version": "==1.0"}}, "develop": {"t": {"version": "==2"}}}), {("a", "1.0", ""), ("t", "2", "dev")}),
    "requirements.txt": ("# c\na==1.0\nB.c[x,y] == 2.0 ; python_version > '3' # y\nd>=1\ne==1.*\n-r other.txt\nf==3 --hash=sha256:00\n", {("a", "1.0", ""), ("B.c", "2.0", ""), ("f", "3", "")}),
    "package-lock.json": (json.dumps({"packages": {"": {"version": "1"}, "node_modules/a": {"version": "1.0"}, "node_modules/a/node_modules/@s/b": {"version": "2.0", "dev": True}, "node_modules/l": {"link": True}}}), {("a", "1.0", "runtime"), ("@s/b", "2.0", "dev")}),
}


@pytest.mark.parametrize("kind", sorted(FILES))
def test_lockfiles(spark, tmp_path, kind):
    content, want = FILES[kind]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / kind).write_text(content, encoding="utf-8")
    rows = lockfiles.files(spark, str(tmp_path), kind)
    assert {tuple(r)[1:] for r in lockfiles.READERS[kind](rows).collect()} == want
    assert [r["complete"] for r in lockfiles.closure(rows, kind).collect()] == [kind not in lockfiles.PARTIAL]
    broken = spark.createDataFrame([("x", ""), ("y", None)], "path string, content string")
    assert lockfiles.read(broken, kind).count() == 0
    assert [r["complete"] for r in lockfiles.closure(broken.filter("content is null"), kind).collect()] == [False]


def test_registry():
    with pytest.raises(ValueError):
        lockfiles.read(None, "unknown.lock")
    with pytest.raises(ValueError):
        lockfiles.register_reader("yarn.lock", None)


def test_cargo(spark):
    text = json.dumps({"packages": [{"id": "a 1.0 (r)", "name": "a", "version": "1.0"}, {"id": "r#b@2.0", "name": "b", "version": "2.0"}, {"id": "m", "name": "m", "version": "0.1"}], "workspace_members": ["m"], "resolve": {"root": "m", "nodes": [{"id": "m", "deps": [{"name": "a", "pkg": "a 1.0 (r)", "dep_kinds": [{"kind": None}, {"kind": "dev"}]}, {"name": "b", "pkg": "r#b@2.0", "dep_kinds": [{"kind": "dev"}]}]}, {"id": "a 1.0 (r)", "deps": []}]}})
    odd = json.loads(text)
    odd["resolve"]["nodes"][0]["deps"][0]["pkg"] = "gone"
    rows = spark.createDataFrame([("p", text), ("q", json.dumps(odd)), ("e", "{}")], "path string, content string")
    packages, status = lockfiles.cargo(rows)
    got = {r["name"]: (r["as_normal"], r["as_dev"], r["as_build"]) for r in packages.filter("path = 'p'").collect()}
    assert got == {"a": (True, True, False), "b": (False, True, False), "m": (True, False, False)}
    assert {r["path"]: r["complete"] for r in status.collect()} == {"p": True, "q": False, "e": False}
    names = spark.createDataFrame([("serde 1.0 (registry+u)",), ("registry+https://x/i#serde@1.0",), ("path+file:///w/serde#0.1",)], "i string").select(lockfiles.crate_name(F.col("i")).alias("n"))
    assert [r["n"] for r in names.collect()] == ["serde"] * 3


def test_projects(spark):
    paths = spark.createDataFrame([("p", x) for x in ("go.mod", "web/package.json", "node_modules/x/package.json", "a/b/c/d/e/pom.xml", "a/b/c/d/e/f/pom.xml", "App.csproj", "README.md")], "project string, path string")
    found = lockfiles.detect(paths)
    assert {(r["folder"], r["ecosystem"]) for r in found.collect()} == {("", "Go"), ("web", "npm"), ("a/b/c/d/e", "Maven"), ("", "NuGet")}
    assert [(r["n_folders"], r["capped"]) for r in lockfiles.discovery_status(found, 2).collect()] == [(3, True)]
    assert lockfiles.narrowed(found, ["Go"]).count() == 1
    with pytest.raises(ValueError):
        lockfiles.narrowed(found, ["Cobol"])
    hosts = spark.createDataFrame([(["linux"], None), (["!linux"], None), (["darwin"], None), (None, ["!arm64"]), ([], [])], "os array<string>, cpu array<string>")
    assert [r["x"] for r in hosts.select(lockfiles.platform_excluded(F.col("os"), F.col("cpu"), "linux", "x64").alias("x")).collect()] == [False, True, True, False, False]
    deps = spark.createDataFrame([("p", n, "1") for n in ("A_b", "c", "d", "e", "f")], "project string, name string, version string")
    groups = spark.createDataFrame([("p", "a.b", "dev", "dev"), ("p", "A-B", "runtime", ""), ("p", "c", "extra", "x"), ("p", "d", "dev", "unit-tests"), ("p", "e", "dev", "docs")], "project string, name string, kind string, grp string")
    assert {r["name"]: r["dep_type"] for r in lockfiles.classify_by_project(deps, groups).collect()} == {"A_b": "runtime", "c": "optional-extra", "d": "test", "e": "docs", "f": "runtime"}
    tiers = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b"), ("q", 0, "c"), ("q", 3, "d")], "project string, tier int, name string")
    status = spark.createDataFrame([("p", 0, False), ("p", 1, True), ("q", 0, False), ("q", 3, False)], "project string, tier int, complete boolean")
    assert {r["name"] for r in lockfiles.first_tier(tiers, status).collect()} == {"b", "d"}


def _record(**more):
    return json.dumps({"id": "X-1", "aliases": ["CVE-1"], **more})


def test_advisories(spark):
    events = [{"introduced": "0"}, {"fixed": "1.2"}, {"introduced": "2.0"}, {"last_affected": "2.5"}, {"introduced": "3"}]
    records = [
        _record(affected=[{"package": {"ecosystem": "npm", "name": "Left"}, "ranges": [{"type": "SEMVER", "events": events}]}, {"package": {"ecosystem": "Go", "name": "M"}, "ranges": [{"type": "GIT", "events": [{"introduced": "0"}]}]}], references=[{"type": "FIX", "url": "b"}, {"type": "FIX", "url": "a"}, {"type": "WEB", "url": "c"}]),
        _record(withdrawn="2024-01-01T00:00:00Z", affected=[{"package": {"ecosystem": "npm", "name": "w"}}]),
        "{broken",
        None,
    ]
    rows = {r["name"]: r for r in feeds.advisories(spark.createDataFrame([(x,) for x in records], "content string")).collect()}
    assert set(rows) == {"left", "M"}
    assert [tuple(x) for x in rows["left"]["version_ranges"]] == [("", "1.2", ""), ("2.0", "", "2.5"), ("3", "", "")]
    assert rows["left"]["fix_refs"] == ["a", "b"]
    assert not rows["left"]["undecidable_ranges"] and rows["M"]["undecidable_ranges"]


def test_signals(spark, tmp_path):
    (tmp_path / "e.csv").write_text("#model_version:v,score_date:d\ncve,epss,percentile\ncve-1,0.5,0.9\nCVE-2,x,0.1\n")
    assert [tuple(r) for r in feeds.epss(spark, str(tmp_path / "e.csv")).collect()] == [("CVE-1", 0.5, 0.9)]
    text = json.dumps({"vulnerabilities": [{"cveID": " cve-3 ", "dateAdded": "2024-01-01", "knownRansomwareCampaignUse": "KNOWN"}]})
    assert [(r["cve"], r["ransomware"]) for r in feeds.kev(spark.createDataFrame([(text,)], "content string")).collect()] == [("CVE-3", True)]


def _frame(spark, *texts):
    return spark.createDataFrame([(t if isinstance(t, str) or t is None else json.dumps(t),) for t in texts], "content string")


def test_module_advisories(spark):
    package = {"ecosystem": "go", "name": "m"}
    rows = _frame(
        spark,
        {"id": "A", "affected": [{"package": package, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.1"}]}], "ecosystem_specific": {"imports": [{"path": "m/p", "symbols": ["F", "T.M"]}]}}, {"package": {"ecosystem": "Go", "name": "m/v2"}, "ranges": [{"type": "semver", "events": [{"introduced": "2.0"}]}, {"type": "GIT"}]}, {"package": {"ecosystem": "npm", "name": "x"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "9"}]}]}]},
        {"id": "B", "affected": [{"package": package}]},
        {"id": "C", "withdrawn": "2024", "affected": [{"package": package}]},
        {"id": "D", "affected": [{"package": {"ecosystem": "npm", "name": "m"}}]},
        "{",
    )
    got = {r["id"]: r for r in feeds.module_advisories(rows).collect()}
    assert set(got) == {"A", "B"} and got["A"]["name"] == "m" and got["A"]["symbol_level"] and not got["B"]["symbol_level"]
    assert [tuple(x) for x in got["A"]["version_ranges"]] == [("", "1.1", ""), ("2.0", "", "")] and [tuple(x) for x in got["A"]["symbols"]] == [("m/p", "F"), ("m/p", "T.M")]
    assert [tuple(x) for x in got["B"]["version_ranges"]] == [("", "", "")]


def test_ends_without_beginning(spark):
    cases = [([{"fixed": "1"}], []), ([{"introduced": "0"}, {"introduced": "2"}, {"fixed": "3"}, {"fixed": "4"}], [("", "", ""), ("2", "3", "")]), ([{"introduced": "1", "fixed": "2"}], [("1", "2", "")]), ([{"introduced": ""}, {"last_affected": "3"}], [])]
    rows = spark.createDataFrame([(i, json.dumps(e)) for i, (e, _) in enumerate(cases)], "i int, e string").orderBy("i")
    got = rows.select(feeds.ranges_of(F.from_json("e", "array<struct<introduced:string,fixed:string,last_affected:string>>")).alias("r")).collect()
    assert [[tuple(x) for x in r["r"]] for r in got] == [w for _, w in cases]


def test_graph_pages(spark):
    node = lambda i, r, **a: {"package": {"name": "Pkg", "ecosystem": "NPM"}, "vulnerableVersionRange": r, "severity": "LOW", "advisory": {"ghsaId": i, "identifiers": [{"type": "GHSA", "value": i}, {"type": "CVE", "value": "CVE-2024-1"}], "cvss": {"score": 9.8, "vectorString": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}, "cwes": {"nodes": [{"cweId": "CWE-79"}]}, **a}}
    rows = _frame(spark, {"data": {"securityVulnerabilities": {"nodes": [node("G1", ">= 1.0, < 2.0"), node("G2", "= 1.5"), node("G3", "> 1.0"), node("G4", "< 1", withdrawnAt="2024"), node("G5", "<= 3")]}}}, None)
    got = {r["id"]: r for r in feeds.graph_pages(rows).collect()}
    assert {i: [tuple(x) for x in r["version_ranges"]] for i, r in got.items()} == {"G1": [("1.0", "2.0", "")], "G2": [("1.5", "", "1.5")], "G3": [], "G5": [("", "", "3")]}
    assert [i for i, r in got.items() if r["undecidable_ranges"]] == ["G3"] and got["G1"]["severity"] == 4 and got["G1"]["aliases"] == ["CVE-2024-1"] and got["G1"]["name"] == "pkg"


def test_tree(spark):
    text = "identifier: GMS-1\nidentifiers:\n- GHSA-x\n- CVE-2024-2\naffected_range: {}\nfixed_versions:\n- \"2.0\"\ncwe_ids: [cwe79, '20']\ncvss_v3: CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H\n"
    rows = spark.createDataFrame([("npm/@s/p/a.yml", text.format('">=1.0"')), ("maven/g.h/art/b.yml", text.format("'[1.0,1.5)'")), ("pypi/p/c.yml", "uuid: u-1\naffected_range: '<x y'\n"), ("npm/p/d.yml", "title: none\n"), ("odd/p/e.yml", text)], "path string, content string")
    got = {r["name"]: r for r in feeds.tree(rows).collect()}
    assert set(got) == {"@s/p", "g.h:art", "p"} and got["@s/p"]["id"] == "CVE-2024-2" and got["@s/p"]["aliases"] == ["GHSA-x", "GMS-1"]
    assert [tuple(x) for x in got["@s/p"]["version_ranges"]] == [("1.0", "2.0", "")] and [tuple(x) for x in got["g.h:art"]["version_ranges"]] == [("1.0", "1.5", "")]
    assert got["p"]["id"] == "u-1" and got["p"]["undecidable_ranges"] and got["@s/p"]["cwes"] == ["CWE-20", "CWE-79"] and got["@s/p"]["severity"] == 4


def test_nvd_and_platforms(spark):
    from veristrata.operators.advisories import platform_matches

    cpe = lambda v, **k: {"vulnerable": True, "criteria": f"cpe:2.3:a:vendor:my_lib:{v}:*:*", **k}
    one = lambda i, *m: {"cve": {"id": i, "metrics": {"cvssMetricV31": [{"cvssData": {"vectorString": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}}, {"cvssData": {"vectorString": "bad"}}]}, "weaknesses": [{"description": [{"value": "CWE-79"}, {"value": "NVD-CWE-noinfo"}]}], "configurations": [{"nodes": [{"cpeMatch": list(m)}]}]}}
    rows = _frame(spark, {"vulnerabilities": [one("cve-1", cpe("1.2.0")), one("CVE-2", cpe("*", versionStartIncluding="1.0", versionEndExcluding="1.2.0")), one("CVE-3", cpe("*", versionEndIncluding="1.2.0")), one("CVE-4", cpe("*")), one("CVE-5", cpe("*", versionEndExcluding="2.x")), one("CVE-6", {**cpe("1.2.0"), "vulnerable": False}), one("CVE-7", cpe("*", versionStartExcluding="1.2.0"))]})
    found = feeds.nvd(rows)
    assert {r["cve"]: (len(r["cvss"]), r["severity"], r["cwes"], len(r["cpe_matches"])) for r in found.collect()}["CVE-1"] == (1, 4, ["CWE-79"], 1)
    deps = spark.createDataFrame([("Maven", "g:my-lib", "v1.2.0"), ("npm", "other", "1.2.0")], "ecosystem string, name string, version string")
    assert {r["cve"]: r["provable"] for r in platform_matches(deps, found).collect()} == {"CVE-1": True, "CVE-3": True, "CVE-4": False, "CVE-5": True}


def test_tools(spark):
    reports = {
        "osv-scanner": [{"results": [{"packages": [{"package": {"name": "p", "version": "1", "ecosystem": "npm"}, "vulnerabilities": [{"id": "A", "aliases": ["B"]}]}]}]}],
        "grype": [{"matches": [{"vulnerability": {"id": "A"}, "relatedVulnerabilities": [{"id": "B"}], "artifact": {"name": "p", "version": "1", "type": "npm"}}]}],
        "trivy": [{"Results": [{"Type": "npm", "Vulnerabilities": [{"VulnerabilityID": "A", "PkgName": "p", "InstalledVersion": "1"}]}, {"Type": "x"}]}],
        "govulncheck": [{"osv": {"id": "A", "aliases": ["B"]}}, {"finding": {"osv": "A", "trace": [{"module": "p", "version": "1"}]}}, {"config": {}}],
    }
    for tool, report in reports.items():
        got = feeds.tool_findings(_frame(spark, *report), tool).collect()
        assert [tuple(r) for r in got] == [(tool, "A", ["A", "B"] if tool != "trivy" else ["A"], "Go" if tool == "govulncheck" else "npm", "p", "1")]


def test_constraints():
    from veristrata.functions.grammars import constraint_ranges

    r = lambda a="", b="", c="": {"introduced": a, "fixed": b, "last_affected": c}
    cases = {">=1.0 <2.0": [r("1.0", "2.0")], "^0.2.3": [r("0.2.3", "0.3.0")], "^1.2": [r("1.2", "2.0.0")], "^0.0.3": [r("0.0.3", "0.0.4")], "^0.0": [r("0.0", "0.1.0")], "^0": [r("0", "1.0.0")], "~1.2.3": [r("1.2.3", "1.3.0")], "~1": [r("1", "2.0.0")], "*": [r(b="9")], ">1 || ==3": [r("1"), r("3", c="3")], "[1,2)": [r("1", "2")], "(,2],[3]": [r(c="2"), r("3", c="3")], "1.2.3": [r("1.2.3", c="1.2.3")], "(1,)": [r("1")], "<=2,>=1": [r("1", c="2")], "": None, "<": None, "[1": None, "abc": None, "^x": None, "[]": None}
    assert {k: constraint_ranges(k, ["9"]) for k in cases} == cases
    assert constraint_ranges(">=1", ["2", "3"]) == [r("1")] and constraint_ranges(">=1", None) == [r("1")] and constraint_ranges(None) is None


def test_workspaces_and_entries(spark):
    from veristrata.policy import Policy
    from veristrata.sources import projects

    manifests = spark.createDataFrame([("p", "", "root"), ("p", "packages/a", None), ("p", "packages/b", "bee"), ("p", "packages/a/deep", "no"), ("p", "x", "ex"), ("q", "", None), ("q", "packages/a", "a")], "project string, folder string, name string")
    globs = spark.createDataFrame([("p", "packages/*"), ("p", "./x/"), ("p", "gone"), ("p", "!packages/b")], "project string, glob string")
    assert {(r["project"], r["folder"], r["name"]) for r in projects.workspaces(manifests, globs).collect()} == {("p", "packages/a", "a"), ("p", "x", "ex"), ("q", "", "")}
    assert [tuple(r) for r in projects.missing_workspaces(manifests, globs).collect()] == [("p", "gone")]
    texts = {"app": {"bin": {"b": "./cli"}, "main": "m.js"}, "lib": {"main": "src/m", "bin": ""}, "exp": {"exports": {".": {"import": "./e.mjs", "default": "./d.js"}}, "main": "m.js"}, "one": {"exports": "./o.js", "private": True}, "idx": {}, "none": {}}
    rows = spark.createDataFrame([("p", k, json.dumps(v)) for k, v in texts.items()], "project string, folder string, content string")
    files = spark.createDataFrame([("p", f) for f in ("app/cli.ts", "app/m.js", "lib/src/m.cjs", "idx/index.ts", "idx/index.mjs")], "project string, path string")
    got = {(r["folder"], r["file"], r["kind"]) for r in projects.entry_files(rows, files).collect()}
    assert got == {("app", "app/cli.ts", "bin"), ("app", "app/m.js", "main"), ("lib", "lib/src/m.cjs", "main"), ("exp", "exp/e.mjs", "exports"), ("one", "one/o.js", "exports"), ("idx", "idx/index.mjs", "main")}
    scope = projects.reduced_scope(spark.createDataFrame([("p", "a"), ("p", "b")], "project string, package string"), spark.createDataFrame([("p", "a", "x"), ("p", "b", "x"), ("p", "b", "y"), ("p", "c", "z")], "project string, package string, dep string"))
    assert [(r["project"], r["could_reach"]) for r in scope.collect()] == [("p", ["x", "y"])]
    named = projects.named_weaknesses(spark.createDataFrame([("A", ["CWE-79", "CWE-1"])], "id string, cwes array<string>"), spark.createDataFrame([("CWE-79", "XSS")], "cwe string, name string"))
    assert [tuple(r) for r in named.collect()] == [("A", "CWE-79: XSS; CWE-1")]
    policy = Policy.from_text("fail-on: critical\ngate-on: kev\nignores:\n- advisory-id: A\n  module: m\n  reason: r\n  expires-at: 2030-01-01\n  elevated-ignore: true\n")
    assert policy.on_kev and policy.tier == "reachable+unknown" and policy.ignores == [{"id": "A", "module": "m", "reason": "r", "expires": "2030-01-01", "elevated": True}]
    with pytest.raises(ValueError):
        Policy.from_text("fail_on: high")


def test_locks_of_many_packages(spark):
    """A repeated group in a pattern takes a stack frame a line, unless it is possessive."""
    n = 20_000
    pub = "packages:\n" + "".join(f'  p{i}:\n    source: hosted\n    version: "1.{i}"\n' for i in range(n)) + 'sdks:\n  dart: ">=2"\n'
    pnpm = "lockfileVersion: '6.0'\n\npackages:\n\n" + "".join(f"  /p{i}@1.{i}:\n    dev: true\n\n" for i in range(n))
    yarn = "".join(f'"p{i}@^1":\n  version "1.{i}"\n\n' for i in range(n)) + '"long@^1":\n' + "  x y\n" * n + '  version "2"\n'
    for kind, content, rows in (("pubspec.lock", pub, n), ("pnpm-lock.yaml", pnpm, n), ("yarn.lock", yarn, n + 1)):
        found = lockfiles.read(spark.createDataFrame([("a", content)], "path string, content string"), kind)
        assert found.select("name", "version").distinct().count() == rows
