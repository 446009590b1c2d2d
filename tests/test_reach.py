import json

import pytest
from pyspark.sql import functions as F

from veristrata.operators import advisories, graph, reach
from veristrata.policy import Policy
from veristrata.sinks import reports, statements
from veristrata.sources import code


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def bfs(edges, roots):
    """A queue: node -> path."""
    out, queue = {}, []
    for r in sorted(set(roots)):
        out[r] = [r]
        queue.append(r)
    while queue:
        at = queue.pop(0)
        for key, dst in sorted((k, d) for s, d, k in edges if s == at):
            if dst not in out:
                out[dst] = [*out[at], dst]
                queue.append(dst)
    return out


def test_shortest_paths(spark):
    import random

    rng, rows, roots, targets, want = random.Random(3), [], [], [], {}
    for g in range(12):
        nodes = [f"n{i}" for i in range(14)]
        edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(22)]
        edges = [(s, d, f"{rng.randint(0, 9)}|{d}") for s, d in set(edges)]
        own = rng.sample(nodes, rng.randint(1, 3))
        rows += [(g, s, d, k, f"{s}>{d}") for s, d, k in edges]
        roots += [(g, r) for r in own]
        targets += [(g, n) for n in nodes]
        want.update({(g, n): p for n, p in bfs(edges, own).items()})
    got = graph.shortest_paths(frame(spark, rows, "graph int, src string, dst string, sort_key string, site string"), frame(spark, roots, "graph int, node string"), frame(spark, targets, "graph int, node string")).collect()
    assert {(r.graph, r.target): r.path for r in got} == want
    assert all(r.sites == [f"{a}>{b}" for a, b in zip(r.path, r.path[1:])] for r in got)


def test_deep_chain_and_limits(spark):
    edges = frame(spark, [(i, i + 1) for i in range(12)] + [(3, 0)], "src int, dst int")
    roots = frame(spark, [(0,)], "node int")
    assert {r.node: r.depth for r in graph.reachable(edges, roots).collect()} == {i: i for i in range(13)}
    cut_off = graph.reachable(edges, roots, most_levels=5).collect()
    assert len(cut_off) == 6 and all(r.incomplete for r in cut_off)
    assert not any(r.incomplete for r in graph.reachable(edges, roots, most_levels=12).collect())


def test_components(spark):
    edges = frame(spark, [(1, 2), (2, 3), (9, 8), (8, 7), (3, 1), (20, 21), (5, 5), (30, 31), (31, 32), (32, 33), (33, 34), (34, 21)], "src int, dst int")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5, **{i: 20 for i in (20, 21, 30, 31, 32, 33, 34)}}


def test_entries_symbols_guards(spark):
    functions = frame(spark, [("a", 1, "main", "main", None), ("a", 2, "main", "TestX", None), ("a", 3, "main", "Test", None), ("a", 4, "lib", "Exported", None), ("b", 5, "lib", "Exported", None), ("b", 6, "lib", "hidden", None), ("b", 7, "lib", "init", None), ("b", 8, "lib", "M", "*T")], "graph string, node int, package string, name string, receiver string")
    assert {r.node for r in graph.entry_points(functions).collect()} == {1, 2, 5, 7, 8}
    assert {r.node for r in graph.entry_points(functions, frame(spark, [("b", 6)], "graph string, node int")).collect()} == {1, 2, 6}
    wanted = frame(spark, [("b", "lib", "T.M"), ("b", "lib", "Exported"), ("b", "lib", "M")], "graph string, package string, symbol string")
    assert {r.symbol: r.node for r in graph.resolve_symbols(wanted, functions).collect()} == {"T.M": 8, "Exported": 5, "M": None}
    nodes = frame(spark, [("a", 1, False, False), ("a", 2, True, True)], "graph string, node int, calls_reflect boolean, address_taken boolean")
    got = graph.guards(frame(spark, [("a", 1), ("a", 2)], "graph string, node int"), nodes, frame(spark, [("a", 1), ("a", 9), ("c", 1)], "graph string, target int"))
    assert {(r.graph, r.target): (r.reflects, r.address_taken) for r in got.collect()} == {("a", 1): (True, False), ("a", 9): (True, True), ("c", 1): (False, True)}


def test_modules(spark):
    imports = frame(spark, [("p", "a", "b", "static"), ("p", "b", "min", "static"), ("p", "min", "c", "static"), ("p", "b", None, "static"), ("p", "z", None, "dynamic")], "project string, src string, dst string, kind string")
    seen, frontiers = graph.module_search(imports, frame(spark, [("p", "a")], "project string, node string"), frame(spark, [("p", "min", "reduced"), ("p", "a", "source")], "project string, node string, fidelity string"), most_files=2)
    assert {r.node for r in seen.collect()} == {"a", "b", "min"}
    assert {(r.file, r.reason) for r in frontiers.collect()} == {("min", "fidelity-reduced"), ("b", "unresolved"), ("a", "truncated")}
    near = graph.nearest(frame(spark, [("p", "a/b/c.js"), ("p", "x.js"), ("q", "a/b")], "project string, path string"), frame(spark, [("p", "a"), ("p", "a/b"), ("p", "")], "project string, root string"))
    assert {(r.project, r.path): r.root for r in near.collect()} == {("p", "a/b/c.js"): "a/b", ("p", "x.js"): "", ("q", "a/b"): None}


def test_ignores(spark):
    findings = frame(spark, [("A", "m", ["f"], 3, 4), ("A", "m2", ["f"], 2, 4), ("B", "m", [], 2, 3), ("C", "m", ["g"], 3, 4), ("D", "m", [], 2, 2), ("E", "m", ["f"], 2, 1), ("F", "m", [], None, 4)], "id string, module string, symbols array<string>, confidence int, severity int")
    ignores = frame(spark, [("A", "m", "", "2030-01-01", False), ("A", "m2", "", "", True), ("B", "m", "", "2024-05-01", False), ("C", "m", "g", "2030-01-01", True), ("D", "m", "", "soon", False), ("E", "m", "other", "2030-01-01", False), ("F", "m", "", "2030-01-01", False)], "id string, module string, symbol string, expires string, elevated boolean")
    kept = lambda now: {r.id for r in advisories.drop_ignored(findings, ignores, now).collect()}
    assert kept("2024-05-01 12:00:00") == {"A", "D", "E", "F"}  # proven criticals need an elevated ignore; no expiry has expired
    assert kept("2024-05-02") == {"A", "B", "D", "E", "F"}
    assert advisories.drop_ignored(findings, ignores, "2024-05-01").filter("module = 'm2'").count() == 1


def test_match_every_ecosystem(spark):
    none, low = ("", "", ""), lambda f: [("1.0.0", f, "")]
    rows = [("Go", "p", "R", low("1.2.0"), [], False), ("Go", "p", "L", [], ["1.1.0"], True), ("Go", "p", "N", [], ["9"], True), ("Go", "p", "G", [], [], True), ("Go", "p", "E", [], [], False), ("Go", "p", "O", [none], [], False), ("Go", "p", "X", [("1.0.0", "bad", "")], [], False), ("Maven", "g:a", "M", [("1.0", "", "1.1-rc")], [], False), ("Maven", "g:a", "U", [("1.0", "9" * 30, "")], [], False), ("Odd", "p", "W", low("2"), [], False), ("npm", "q", "T", [("5.0.0", "6.0.0", ""), ("1.0.0", "1.2.0", "")], [], False)]
    own = frame(spark, rows, "ecosystem string, name string, advisory string, version_ranges array<struct<introduced:string,fixed:string,last_affected:string>>, versions array<string>, undecidable_ranges boolean")
    deps = frame(spark, [(k, *d) for k in (1, 2) for d in (("Go", "p", "v1.1.0"), ("Go", "p", "0.9.0"), ("Go", "p", "odd"), ("Maven", "g:a", "1.1-beta"), ("Maven", "g:a", "1.1"), ("Odd", "p", "1"), ("npm", "q", "1.1.0"))], "project int, ecosystem string, name string, version string")
    got = {(r.version, r.advisory): r.verdict for r in advisories.match(deps, own).collect()}
    want = {("v1.1.0", "R"): 1, ("v1.1.0", "L"): 1, ("v1.1.0", "G"): 2, ("0.9.0", "G"): 2, ("odd", "G"): 2, ("v1.1.0", "O"): 1, ("0.9.0", "O"): 1, ("odd", "O"): 2, ("odd", "R"): 2, ("v1.1.0", "X"): 2, ("odd", "X"): 2, ("1.1-beta", "M"): 1, ("1.1-beta", "U"): 2, ("1.1", "U"): 2, ("1", "W"): 2, ("1.1.0", "T"): 1}
    assert got == want


def test_greedy_groups(spark):
    rows = [("k", 0, "A", ["x"]), ("k", 1, "C", ["y"]), ("k", 2, "B", ["x", "y"]), ("k", 3, "D", ["y"]), ("q", 0, "A", None)]
    got = advisories.greedy_groups(frame(spark, rows, "key string, pos int, id string, aliases array<string>"), ["key"]).collect()
    assert {(r.key, r.id): r.grp for r in got} == {("k", "A"): 0, ("k", "C"): 1, ("k", "B"): 0, ("k", "D"): 0, ("q", "A"): 0}  # D joins the first group that has y by then


def test_merging(spark):
    r = "array<struct<introduced:string,fixed:string,last_affected:string>>"
    rows = [("k", "B", ["x"], True, "1", 1, 2, "s1", "2024", 0, [("1", "2", "")], False, "rep"), ("k", "A", ["y"], False, "0", 9, 4, "s2", "", 1, [("0", "3", ""), ("1", "2", "")], True, "other")]
    got = advisories.resolve_groups(frame(spark, rows, f"grp string, id string, aliases array<string>, symbol_level boolean, introduced string, trust int, severity int, source string, withdrawn string, pos int, version_ranges {r}, incomplete boolean, note string"), ["grp"]).first()
    assert (got.id, got.severity, got.sources, got.aliases, got.withdrawn, got.incomplete, got.note) == ("B", 4, ["s1", "s2"], ["A", "x", "y"], "", True, "rep") and [tuple(x) for x in got.version_ranges] == [("1", "2", ""), ("0", "3", "")]
    layer = f"grp string, pos int, id string, aliases array<string>, sources array<string>, severity int, cvss array<string>, cwes array<string>, symbols array<string>, fix_refs array<string>, version_ranges {r}, versions array<string>, undecidable_ranges boolean, incomplete boolean"
    rows = [("k", 0, "G", ["c"], ["graph"], 1, [], ["CWE-1"], [], None, [], [], True, True), ("k", 1, "H", ["d"], ["bundle"], 3, ["v"], ["CWE-2"], [], ["u"], [("1", "", "")], [], False, False)]
    got = advisories.fill_gaps(frame(spark, rows, layer), ["grp"]).first()
    assert (got.id, got.aliases, got.sources, got.severity, got.cvss, got.cwes, got.fix_refs, got.undecidable_ranges) == ("G", ["H", "c", "d"], ["bundle", "graph"], 3, ["v"], ["CWE-1"], ["u"], False) and len(got.version_ranges) == 1


def test_imports(spark):
    imports = frame(spark, [("p", "f", s) for s in ("os.path", "pkg.sub.x", "dist_a.y", "nope", ".rel", "pkg")], "project string, file string, specifier string")
    got = reach.resolve_imports(imports, frame(spark, [("p", "pkg"), ("p", "pkg.sub")], "project string, module string"), frame(spark, [("p", "dist_a", "dist-a")], "project string, module string, dist string"), frame(spark, [("os",)], "module string"))
    assert {r.specifier: (r.kind, r.target) for r in got.collect()} == {"os.path": ("standard", "os"), "pkg.sub.x": ("own", "pkg.sub"), "dist_a.y": ("dist", "dist-a"), "nope": ("unknown", None), ".rel": ("own", ".rel"), "pkg": ("own", "pkg")}
    sites = frame(spark, [("p", "a", "z.js", 1, 1, ["f"]), ("p", "a", "b.js", 9, 1, ["f", "g"]), ("p", "a", "c.js", 1, 1, ["*"])], "project string, package string, file string, line int, col int, bindings array<string>")
    got = reach.bound_symbols(frame(spark, [("p", "a", "f"), ("p", "a", "h"), ("p", "b", "f")], "project string, package string, symbol string"), sites)
    assert {(r.package, r.symbol): r.site and r.site.file for r in got.collect()} == {("a", "f"): "b.js", ("a", "h"): "c.js", ("b", "f"): None}
    exports = frame(spark, [("p", ".", 0, "./i.js"), ("p", "./a", 1, "./A.js"), ("p", "./f/*", 2, "./F/*.js"), ("p", "./f/x*", 3, "./X/*"), ("p", "./no", 4, None)], "package string, key string, pos int, target string")
    got = reach.export_target(exports, frame(spark, [("p", s) for s in (".", "./a", "./f/xy", "./f/../z", "./b", "./no")], "package string, subpath string"))
    assert {r.subpath: r.path for r in got.collect()} == {".": "./i.js", "./a": "./A.js", "./f/xy": "./F/xy.js", "./f/../z": None, "./b": None, "./no": None}


def test_patches(spark):
    text = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@\n a\n+b\n c\n@@ -10 +11,2 @@\n-d\n+e\n+++ f\n--- a/gone.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
    patches = frame(spark, [("A", "p1", text), ("B", "p2", None)], "advisory string, patch string, content string")
    assert sorted((r.file, r.line) for r in reach.changed_lines(patches).collect()) == [("x.py", 2), ("x.py", 11), ("x.py", 12)]
    regions = frame(spark, [("p1", "x.py", 1, 3, "f"), ("p1", "x.py", 4, 9, "g"), ("p1", "x.py", 2, 2, "f"), ("p1", "y.py", 2, 2, "h")], "patch string, file string, start int, end int, symbol string")
    assert [tuple(r) for r in reach.fixed_symbols(patches, regions).collect()] == [("A", "f")]


def test_code(spark):
    source = "import os.path as p\nfrom .a import b\nclass T:\n    def m(self):\n        return b(eval('x'))\n"
    rows = code.python(frame(spark, [("p", "a.py", source), ("p", "bad.py", "def"), ("p", "none.py", None), ("p", "empty.py", "")], "project string, file string, content string")).collect()
    got = {(r.file, r.kind, r.name, r.target) for r in rows}
    assert {("a.py", "import", "p", "os.path"), ("a.py", "import", "b", ".a:b"), ("a.py", "def", "T.m", None), ("a.py", "call", "T.m", "b"), ("a.py", "dynamic", "T.m", "eval"), ("bad.py", "error", "SyntaxError", None), ("none.py", "error", "no text", None)} <= got
    source = "import a from 'a';\nimport 'b'; // import 'no'\n/* require('no') */ const {x} = require(\"c\");\nexport * from './d';\nimport(`e${x}`); o[k](); new Function('s')\n"
    rows = code.script(frame(spark, [("p", "a.js", source), ("p", "long.js", "x" * 60000)], "project string, file string, content string")).collect()
    assert {(r.file, r.kind, r.specifier) for r in rows} == {("a.js", "import", "a"), ("a.js", "import", "b"), ("a.js", "require", "c"), ("a.js", "import", "./d"), ("a.js", "dynamic", None), ("a.js", "dispatch", None), ("long.js", "error", None)}


FINDINGS = "advisory string, url string, aliases array<string>, module string, confidence int, severity int, properties map<string,string>, path array<struct<file:string,line:int,column:int,symbol:string>>, ecosystem string, version string, incomplete boolean, fixed string"


def findings(spark):
    return frame(spark, [("CVE-2", "http://u", ["G"], "m", 3, 4, {"risk_score": "90.0", "module": "odd"}, [("f.go", 1, 2, "s")], "Go", "1.0", False, "1.1"), ("A-1", None, None, "n", 1, 3, None, None, "npm", "2", False, ""), ("A-1", None, [], "m", 0, 0, {}, [], "none", "2", True, ""), ("A-3", None, [], "k", 1, 2, {}, [], "npm", "", True, "")], FINDINGS)


def test_sarif_json_table(spark):
    doc = json.loads(reports.render(findings(spark), "sarif").first().document)
    results = doc["runs"][0]["results"]
    assert doc["version"] == "2.1.0" and [(r["ruleId"], r["level"]) for r in results] == [("A-1", "none"), ("A-1", "note"), ("A-3", "note"), ("CVE-2", "error")]
    assert "suppressions" in results[1] and "suppressions" not in results[3] and "codeFlows" not in results[0] and results[3]["rank"] == 90.0
    assert results[3]["properties"] == {"advisory_url": "http://u", "confidence": "CONFIDENCE_SYMBOL_REACHABLE", "module": "m", "risk_score": "90.0"}
    assert results[3]["codeFlows"][0]["threadFlows"][0]["locations"][0]["location"]["physicalLocation"]["region"] == {"startLine": 1, "startColumn": 2}
    rows = json.loads(reports.render(findings(spark), "json").first().document)
    assert rows[3]["advisory"] == {"id": "CVE-2", "url": "http://u", "aliases": ["G"]} and rows[3]["risk"] == {"score": 90.0} and "path" not in rows[0]
    lines = [r.line for r in reports.render(findings(spark), "table").collect()]
    assert lines[0].split() == ["CRITICAL", "CVE-2", "m", "SYMBOL_REACHABLE"] and len(lines) == 4
    with pytest.raises(ValueError):
        reports.render(findings(spark), "pdf")
    none = findings(spark).limit(0)
    assert json.loads(reports.sarif(none).first().document)["runs"][0]["results"] == [] and json.loads(reports.json_document(none).first().document) == []


def test_statements(spark):
    rows = statements.statements(findings(spark))
    assert {(r.id, r.product): r.status for r in rows.collect()} == {("CVE-2", "pkg:golang/m@1.0"): "affected", ("A-1", "pkg:npm/n@2"): "not_affected", ("A-1", "unknown-product"): "under_investigation", ("A-3", "pkg:npm/k"): "under_investigation"}
    when = "2024-01-01T00:00:00Z"
    vex = [json.loads(statements.render_statements(rows, "openvex", when).first().document) for _ in range(2)]
    assert vex[0] == vex[1] and len(vex[0]["statements"]) == 4 and vex[0]["statements"][0]["justification"] == "vulnerable_code_not_in_execute_path"
    cdx = json.loads(statements.render_statements(rows, "cyclonedx", when).first().document)
    assert {v["analysis"]["state"] for v in cdx["vulnerabilities"]} == {"exploitable", "not_affected", "in_triage"}
    csaf = json.loads(statements.render_statements(rows, "csaf", when).first().document)
    assert [v.get("cve") for v in csaf["vulnerabilities"]] == [None, None, "CVE-2"] and csaf["vulnerabilities"][2]["remediations"][0]["category"] == "vendor_fix"
    assert len(csaf["product_tree"]["full_product_names"]) == 4 and csaf["vulnerabilities"][0]["flags"][0]["product_ids"] == ["pkg:npm/n@2"]


def test_policy(spark):
    rows = [("p", "A", "m", ["s"], 2, 3, False, "runtime", False, 0.0, 10.0, False), ("q", "A", "m", [], 2, 1, False, "", True, 0.0, 0.0, False), ("r", "A", "m", [], 1, 4, False, "", True, 1.0, 99.0, False), ("s", "A", "m", [], 2, 4, False, "dev", False, 0.0, 0.0, True), ("t", "I", "m", [], 2, 4, False, "", False, 0.0, 0.0, False)]
    found = frame(spark, rows, "project string, id string, module string, symbols array<string>, confidence int, severity int, dev_only boolean, dep_type string, kev boolean, epss double, risk double, incomplete boolean")
    policy = Policy("high", "kev, epss>=0.5", ignores=[{"id": "I", "module": "m", "reason": "x", "expires": "2030-01-01"}])
    assert {r.project: r.exit_code for r in policy.evaluate(found, "2024-01-01", ["project"]).collect()} == {"p": 1, "q": 1, "r": 0, "s": 3, "t": 0}
    for bad in ({"gate_on": "all, reachable"}, {"gate_on": "epss>0.5"}, {"fail_on": "worst"}, {"ignores": [{"id": "A", "module": "m"}]}, {"ignores": [{"id": "A", "module": "m", "reason": "r", "expires": "soon"}]}):
        with pytest.raises(ValueError):
            Policy(**bad)


def test_small_functions(spark):
    from veristrata.functions import decisions, risk, text

    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert get(text.cwes(strings("79", " cwe-079", "CWE 20", "other", "cwe_9", ""))) == ["CWE-20", "CWE-79", "CWE_9", "OTHER"]
    assert get(text.swift_url(F.lit(" https://GitHub.com/A/b.git/ "))) == "github.com/a/b" and get(text.swift_url(F.lit("git@h:a/b.git"))) == "h/a/b"
    assert get(text.cve_ids(F.lit("GHSA-1"), strings("cve-2024-1234", "CVE-2024-1234", "CVE-1"))) == ["CVE-2024-1234"]
    assert get(text.rationale(F.lit(3), F.lit(9.85), F.lit(0.123), F.lit(True))) == "symbol-reachable + KEV + CVSS 9.9 + EPSS 0.12"
    assert get(text.minified(F.lit("x" * 50001))) and not get(text.minified(F.lit("a = 1\nb = 2\n"))) and get(text.minified(F.lit(("y" * 501 + "\n") * 3)))
    meta = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(v).alias("severity"), F.lit(w).alias("vector")) for s, v, w in (("b", 3, "V"), ("a", 2, ""))])
    assert get(text.conflict_text(meta)) == "a:MEDIUM,b:HIGH" and get(text.provenance_text(meta)) == "a MEDIUM; b HIGH V"
    v4 = "CVSS:4.0/AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N/SI:N/SA:N"
    assert get(risk.cvss4_valid(F.lit(v4))) and not get(risk.cvss4_valid(F.lit(v4.replace("/SA:N", "")))) and not get(risk.cvss4_valid(F.lit(v4.replace("AT:N", "AT:X"))))
    v3 = "CVSS:3.1/AV:P/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H/AV:N"
    assert get(risk.cvss3(F.lit(v3))) == 9.8 and get(risk.cvss3(F.lit(v3.replace("/S:U", "")))) is None  # the last of duplicates counts, in any session
    metrics = F.array(risk.parsed_cvss(F.lit(v4), F.lit("s")), risk.parsed_cvss(F.lit(v3), F.lit("t")))
    assert get(risk.best_cvss(metrics)) == (v3, 9.8) and get(risk.severity_of_metrics(metrics, F.lit(None).cast("double"), F.lit("LOW"))) == 4
    assert get(risk.severity_of_metrics(F.slice(metrics, 1, 1), F.lit(5.0), F.lit("LOW"))) == 2 and get(risk.severity_of_metrics(F.slice(metrics, 1, 1), F.lit(0.0), F.lit("moderate"))) == 2
    b = lambda x: F.lit(x).cast("boolean")
    assert [get(decisions.import_confidence(*map(b, x))) for x in ((False, True, False, True, True, True, True), (False, True, False, True, True, True, False), (False, False, False, True, True, True, True), (False, False, True, True, True, True, True), (True, False, False, None, None, None, None), (False, True, False, True, True, False, False), (False, None, False, True, True, True, True))] == [3, 2, 1, 0, 0, 1, 0]
    cases = {(True, True, True, True, True, False, True, True): (3, False), (True, True, False, False, False, False, False, True): (2, True), (True, False, True, True, True, False, True, True): (1, False), (True, False, False, True, True, False, True, True): (0, True), (False, True, True, True, True, False, True, True): (0, True), (True, True, True, True, True, True, True, True): (0, True), (True, True, True, True, False, False, False, False): (2, False), (True, True, True, True, False, False, False, True): (0, True), (True, True, True, True, True, False, False, True): (0, False)}
    assert {k: tuple(get(decisions.distribution_confidence(*map(b, k)))) for k in cases} == cases
    assert [tuple(get(decisions.crate_decision(*map(b, x)))) for x in ((True, False, False, True), (True, True, True, True), (False, None, None, None), (None, False, True, False))] == [(2, False, True), (0, True, False), (1, False, False), (0, True, False)]


def test_ignores_are_not_broadcast(spark):
    """Ignores from an explode look as small as before it."""
    found = spark.createDataFrame([("A-1", "m"), ("A-9", "m"), ("A-1", "n")], "id string, module string")
    ignores = spark.range(1).selectExpr("explode(sequence(0, 5)) as k").selectExpr("concat('A-', k) as id", "'m' as module", "'2030-01-01' as expires")
    left = advisories.drop_ignored(found, ignores, "2024-01-01")
    assert "Broadcast" not in left._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, left.collect())) == [("A-1", "n"), ("A-9", "m")]


def test_paths_without_broadcasts(spark, monkeypatch):
    """Edges from an explode look as small as before it. The paths go through several anchors; the deepest nodes are anchors too."""
    plans, write = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    monkeypatch.setattr(graph, "FEW", 0, raising=False)
    monkeypatch.setattr(graph, "STRIDE", 2, raising=False)
    edges = spark.range(1, 50).selectExpr("1 as graph", "id as src", "explode(array(id * 3, id * 2, id + 1)) as dst").selectExpr("*", "lpad(dst, 4, '0') as sort_key", "concat(src, '>', dst) as site")
    want = bfs([(n, d, f"{d:4}") for n in range(1, 50) for d in (n * 3, n * 2, n + 1)], [1])
    odd = frame(spark, [(1, n) for n in range(1, 150, 2)], "graph int, node long")
    got = graph.shortest_paths(edges, odd.filter("node = 1"), odd).collect()
    assert max(map(len, want.values())) == 9 and {r.target: r.path for r in got} == {n: p for n, p in want.items() if n % 2}
    assert all(r.sites == [f"{a}>{b}" for a, b in zip(r.path, r.path[1:])] for r in got)
    assert plans and not any("BroadcastExchange" in p for p in plans)
