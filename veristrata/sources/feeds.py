"""Advisory and signal feeds as rows, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions.grammars import comma_range, constraint_range
from veristrata.functions.risk import parsed_cvss, severity_of_metrics
from veristrata.functions.text import cwes

_RANGE = "struct<introduced: string, fixed: string, last_affected: string>"
#: The parts of an advisory record that queries read; others are left in the text.
RECORD = f"""struct<id: string, aliases: array<string>, withdrawn: string, modified: string,
 affected: array<struct<package: struct<ecosystem: string, name: string>, ranges: array<struct<type: string, events: array<{_RANGE}>>>, versions: array<string>, ecosystem_specific: struct<imports: array<struct<path: string, symbols: array<string>>>>>>,
 severity: array<struct<type: string, score: string>>, database_specific: struct<severity: string>, references: array<struct<type: string, url: string>>>"""


def ranges_of(events: Column) -> Column:
    """Events in order as ranges: an introduced one opens, a fixed or last affected one closes; the last may stay open. 0 is no bound."""
    bare = lambda x: F.when(F.coalesce(x, F.lit("0")) == "0", "").otherwise(x)
    made = lambda low, fixed, last: F.array(F.struct(low.alias("introduced"), fixed.alias("fixed"), last.alias("last_affected")))
    none = F.lit("")
    start = F.struct(F.array().cast(f"array<{_RANGE}>").alias("done"), F.lit(None).cast("string").alias("low"))
    some = lambda x: F.coalesce(x, F.lit("")) != ""

    def step(state: Column, e: Column) -> Column:
        opens, ends = some(e["introduced"]), some(e["fixed"]) | some(e["last_affected"])
        left = F.when(opens & state["low"].isNotNull(), F.concat(state["done"], made(state["low"], none, none))).otherwise(state["done"])
        low = F.when(opens, bare(e["introduced"])).otherwise(state["low"])
        closed = F.concat(left, made(low, F.when(some(e["fixed"]), e["fixed"]).otherwise(none), F.when(some(e["fixed"]), none).otherwise(F.coalesce(e["last_affected"], none))))
        shut = ends & low.isNotNull()  # an end without a beginning says nothing
        return F.struct(F.when(shut, closed).otherwise(left).alias("done"), F.when(~shut, low).alias("low"))

    end = lambda state: F.when(state["low"].isNotNull(), F.concat(state["done"], made(state["low"], none, none))).otherwise(state["done"])
    return F.aggregate(events, start, step, end)


def _parsed(rows: DataFrame) -> DataFrame:
    """Records that can be read and are not withdrawn."""
    return rows.select(F.from_json("content", RECORD).alias("r")).filter("r.id != '' and coalesce(r.withdrawn, '') = ''").select("r.*")


_NO_RANGES = f"cast(array() as array<struct<type: string, events: array<{_RANGE}>>>)"


def _fixes(references: Column) -> Column:
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(F.filter(references, lambda x: x["type"] == "FIX"), lambda x: x["url"]))), F.array().cast("array<string>"))


def _metrics(severity: Column, source: Column) -> Column:
    """Metrics of the severity entries that can be used."""
    return F.coalesce(F.filter(F.transform(severity, lambda x: parsed_cvss(x["score"], source)), lambda m: m.isNotNull()), F.array().cast("array<struct<version:string,vector:string,base_score:double,source:string>>"))


def advisories(rows: DataFrame, source: str = "osv") -> DataFrame:
    """content (one record a row) as rows for each package; withdrawn and unreadable records go.

    GIT ranges cannot be decided by version: with no others and no versions, undecidable_ranges is set. A package
    without ranges and versions is not affected by itself.
    """
    found = _parsed(rows).select("*", F.explode("affected").alias("a"))
    ranges = F.coalesce(F.col("a.ranges"), F.expr(_NO_RANGES))
    usable = F.filter(ranges, lambda x: F.coalesce(x["type"], F.lit("")) != "GIT")
    found = found.withColumn("version_ranges", F.flatten(F.transform(usable, lambda x: ranges_of(x["events"]))))
    name, eco = F.col("a.package.name"), F.col("a.package.ecosystem")
    git = (F.size("version_ranges") == 0) & (F.coalesce(F.size("a.versions"), F.lit(0)) <= 0) & F.exists(ranges, lambda x: x["type"] == "GIT")
    cvss = _metrics(F.col("severity"), F.lit(source))
    return found.select(
        "id", F.col("id").alias("advisory"), "aliases", eco.alias("ecosystem"), F.when(F.lower(eco) == "npm", F.lower(name)).otherwise(name).alias("name"), "version_ranges", F.col("a.versions").alias("versions"),
        git.alias("undecidable_ranges"), _fixes(F.col("references")).alias("fix_refs"), F.col("database_specific.severity").alias("severity_text"), cvss.alias("cvss"),
        severity_of_metrics(cvss, F.lit(None).cast("double"), F.col("database_specific.severity")).alias("severity"), F.lit(source).alias("source"),
    )


def module_advisories(rows: DataFrame, ecosystem: str = "Go", source: str = "go-vuln-db") -> DataFrame:
    """content (one record a row) as one row: the first package of the ecosystem names it, the ranges of all of its packages count.

    A range without events, or no range at all, is open: all versions are affected. This differs from advisories().
    """
    own = F.filter("affected", lambda a: F.lower(a["package"]["ecosystem"]) == ecosystem.lower())
    rows = _parsed(rows).withColumn("own", own).filter(F.size("own") > 0)
    open_ = F.array(F.struct(*[F.lit("").alias(k) for k in ("introduced", "fixed", "last_affected")])).cast(f"array<{_RANGE}>")
    usable = lambda a: F.filter(F.coalesce(a["ranges"], F.expr(_NO_RANGES)), lambda x: F.upper(x["type"]).isin("SEMVER", "ECOSYSTEM"))
    one = lambda x: F.when(F.size(ranges_of(x["events"])) > 0, ranges_of(x["events"])).otherwise(open_)
    ranges = F.flatten(F.flatten(F.transform("own", lambda a: F.transform(usable(a), one))))
    symbols = F.flatten(F.flatten(F.transform("own", lambda a: F.transform(F.coalesce(a["ecosystem_specific"]["imports"], F.array().cast("array<struct<path:string,symbols:array<string>>>")), lambda i: F.transform(F.coalesce(i["symbols"], F.array().cast("array<string>")), lambda s: F.struct(i["path"].alias("package"), s.alias("name")))))))
    cvss = _metrics(F.col("severity"), F.lit(source))
    return rows.select("id", F.col("id").alias("advisory"), "aliases", F.lit(ecosystem).alias("ecosystem"), F.get("own", F.lit(0))["package"]["name"].alias("name"), F.when(F.size(ranges) > 0, ranges).otherwise(open_).alias("version_ranges"), F.array().cast("array<string>").alias("versions"), F.lit(False).alias("undecidable_ranges"), symbols.alias("symbols"), (F.size(symbols) > 0).alias("symbol_level"), _fixes(F.col("references")).alias("fix_refs"), severity_of_metrics(cvss, F.lit(None).cast("double"), F.col("database_specific.severity")).alias("severity"), F.lit(source).alias("source"))


#: Ecosystems as the graph service names them.
GRAPH_ECOSYSTEMS = {"GO": "Go", "NPM": "npm", "RUST": "crates.io", "PIP": "PyPI", "MAVEN": "Maven", "NUGET": "NuGet", "COMPOSER": "Packagist", "RUBYGEMS": "RubyGems", "ERLANG": "Hex", "PUB": "Pub", "SWIFT": "SwiftURL"}
_PAGE = """struct<data: struct<securityVulnerabilities: struct<nodes: array<struct<package: struct<name: string, ecosystem: string>, vulnerableVersionRange: string, severity: string,
 advisory: struct<ghsaId: string, withdrawnAt: string, identifiers: array<struct<type: string, value: string>>, cvss: struct<score: double, vectorString: string>, cwes: struct<nodes: array<struct<cweId: string>>>>>>>>>"""


def graph_pages(rows: DataFrame, source: str = "ghsa") -> DataFrame:
    """content (one page of vulnerabilities a row) as a row for each vulnerable package; withdrawn ones go. A range that cannot be put exactly is undecidable."""
    nodes = rows.select(F.explode(F.from_json("content", _PAGE)["data"]["securityVulnerabilities"]["nodes"]).alias("n")).filter("coalesce(n.advisory.withdrawnAt, '') = ''").select("n.*").withColumnRenamed("advisory", "own")
    eco = F.element_at(F.create_map(*[F.lit(x) for pair in GRAPH_ECOSYSTEMS.items() for x in pair]), F.upper("package.ecosystem"))
    ranges = comma_range(F.col("vulnerableVersionRange"))
    names = F.array_sort(F.array_distinct(F.filter(F.transform("own.identifiers", lambda i: i["value"]), lambda x: x != F.col("own.ghsaId"))))
    vector = F.col("own.cvss.vectorString")
    cvss = F.filter(F.array(parsed_cvss(vector, F.lit(source))), lambda m: m.isNotNull())
    severity = severity_of_metrics(cvss, F.col("own.cvss.score"), F.col("severity"))
    return nodes.filter(eco.isNotNull()).select(F.col("own.ghsaId").alias("id"), F.col("own.ghsaId").alias("advisory"), names.alias("aliases"), eco.alias("ecosystem"), F.when(eco == "npm", F.lower("package.name")).otherwise(F.col("package.name")).alias("name"), F.coalesce(ranges, F.array().cast(f"array<{_RANGE}>")).alias("version_ranges"), F.array().cast("array<string>").alias("versions"), ranges.isNull().alias("undecidable_ranges"), cwes(F.coalesce(F.transform("own.cwes.nodes", lambda c: c["cweId"]), F.array().cast("array<string>"))).alias("cwes"), severity.alias("severity"), F.lit(source).alias("source"))


def _yaml_value(content: Column, key: str) -> Column:
    """A top-level scalar, without quotes."""
    return F.regexp_replace(F.trim(F.regexp_extract(content, rf"(?m)^{key}:[ \t]*(.*)$", 1)), "^[\"']|[\"']$", "")


def _yaml_list(content: Column, key: str) -> Column:
    """A top-level list, in lines or in brackets."""
    block = F.regexp_extract(content, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[^\n]*\n?)*)", 1)
    inline = F.regexp_extract(content, rf"(?m)^{key}:[ \t]*\[([^\]]*)\]", 1)
    clean = lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")
    items = F.when(inline != "", F.split(inline, ",")).otherwise(F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^[ \t]*-", "")))
    return F.filter(F.transform(items, clean), lambda x: x != "")


#: Folders of package types in the advisory tree.
TREE_TYPES = {"go": "Go", "npm": "npm", "cargo": "crates.io", "pypi": "PyPI", "maven": "Maven", "nuget": "NuGet", "packagist": "Packagist", "gem": "RubyGems", "hex": "Hex", "pub": "Pub", "swift": "SwiftURL"}


def tree(rows: DataFrame, source: str = "gitlab") -> DataFrame:
    """path (type/slug/file.yml), content as a row for each file: the first CVE of the identifiers is the id, else the first; a file without any has its uuid, or goes.

    Folder and slug name the package. A range that cannot be put exactly is undecidable. Distinct range texts are parsed once.
    """
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in TREE_TYPES.items() for x in pair]), F.regexp_extract("path", r"^([^/]+)/", 1))
    content = F.regexp_replace("content", r"\r\n?", "\n")
    rows = rows.select("path", content.alias("c"), kind.alias("ecosystem")).filter(F.col("ecosystem").isNotNull() & F.col("path").rlike(r"\.ya?ml$"))
    names = F.array_distinct(F.filter(F.concat(_yaml_list(F.col("c"), "identifiers"), F.array(_yaml_value(F.col("c"), "identifier"))), lambda x: x != ""))
    uuid = _yaml_value(F.col("c"), "uuid")
    rows = rows.withColumn("names", F.when(F.size(names) > 0, names).when(uuid != "", F.array(uuid))).filter("names is not null")
    chosen = F.coalesce(F.get(F.filter("names", lambda x: F.startswith(F.upper(x), F.lit("CVE-"))), F.lit(0)), F.get("names", F.lit(0)))
    slug = F.regexp_extract("path", r"^[^/]+/(.*)/[^/]*$", 1)
    name = F.when(F.col("ecosystem") == "Maven", F.regexp_replace(slug, "/(?=[^/]*$)", ":")).otherwise(slug)
    vectors = F.filter(F.array(_yaml_value(F.col("c"), "cvss_v3"), _yaml_value(F.col("c"), "cvss_v4")), lambda v: v != "")
    metrics = F.filter(F.transform(vectors, lambda v: parsed_cvss(v, F.lit(source))), lambda m: m.isNotNull())
    rows = rows.select(chosen.alias("id"), F.array_except("names", F.array(chosen)).alias("aliases"), "ecosystem", name.alias("name"), _yaml_value(F.col("c"), "affected_range").alias("range"), _yaml_list(F.col("c"), "fixed_versions").alias("fixed_in"), cwes(_yaml_list(F.col("c"), "cwe_ids")).alias("cwes"), metrics.alias("cvss"))
    parsed = rows.select("range", "fixed_in").distinct().withColumn("ranges", constraint_range("range", "fixed_in"))
    rows = rows.join(parsed, ["range", "fixed_in"])
    severity = F.when(F.size("cvss") > 0, severity_of_metrics(F.col("cvss"), F.lit(None).cast("double"), F.lit(""))).otherwise(0)
    return rows.select("id", F.col("id").alias("advisory"), "aliases", "ecosystem", "name", F.coalesce("ranges", F.array().cast(f"array<{_RANGE}>")).alias("version_ranges"), F.array().cast("array<string>").alias("versions"), F.col("ranges").isNull().alias("undecidable_ranges"), "cwes", "cvss", severity.alias("severity"), F.lit(source).alias("source"))


_NVD = """struct<vulnerabilities: array<struct<cve: struct<id: string,
 metrics: struct<cvssMetricV40: array<struct<cvssData: struct<vectorString: string>>>, cvssMetricV31: array<struct<cvssData: struct<vectorString: string>>>, cvssMetricV30: array<struct<cvssData: struct<vectorString: string>>>>,
 weaknesses: array<struct<description: array<struct<value: string>>>>, references: array<struct<url: string>>,
 configurations: array<struct<nodes: array<struct<cpeMatch: array<struct<vulnerable: boolean, criteria: string, versionStartIncluding: string, versionStartExcluding: string, versionEndIncluding: string, versionEndExcluding: string>>>>>>>>>>"""


def nvd(rows: DataFrame) -> DataFrame:
    """content (one page a row) as cve, cvss, severity, cwes, references, cpe_matches (vulnerable ones only); vectors that cannot be used go."""
    found = rows.select(F.explode(F.from_json("content", _NVD)["vulnerabilities"]).alias("v")).select("v.cve.*").filter("id != ''")
    vectors = lambda k: F.coalesce(F.transform(F.col("metrics")[k], lambda m: m["cvssData"]["vectorString"]), F.array().cast("array<string>"))
    metrics = F.filter(F.transform(F.concat(vectors("cvssMetricV40"), vectors("cvssMetricV31"), vectors("cvssMetricV30")), lambda v: parsed_cvss(v, F.lit("nvd"))), lambda m: m.isNotNull())
    names = F.coalesce(F.flatten(F.transform("weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"]))), F.array().cast("array<string>"))
    weak = cwes(F.filter(names, lambda x: F.upper(x).rlike("^CWE-?[0-9]+$")))
    matches = F.flatten(F.transform("configurations", lambda c: F.flatten(F.transform(c["nodes"], lambda n: n["cpeMatch"]))))
    flat = lambda m: F.struct(m["vulnerable"].alias("vulnerable"), m["criteria"].alias("criteria"), *[F.coalesce(m[a], F.lit("")).alias(b) for a, b in (("versionStartIncluding", "start_inc"), ("versionStartExcluding", "start_exc"), ("versionEndIncluding", "end_inc"), ("versionEndExcluding", "end_exc"))])
    refs = F.coalesce(F.transform("references", lambda r: r["url"]), F.array().cast("array<string>"))
    return found.select(F.upper("id").alias("cve"), metrics.alias("cvss"), severity_of_metrics(metrics, F.lit(None).cast("double"), F.lit("")).alias("severity"), weak.alias("cwes"), refs.alias("references"), F.coalesce(F.transform(F.filter(matches, lambda m: m["vulnerable"]), flat), F.array().cast("array<struct<vulnerable:boolean,criteria:string,start_inc:string,start_exc:string,end_inc:string,end_exc:string>>")).alias("cpe_matches"))


_TOOL = {
    "osv-scanner": "struct<results: array<struct<packages: array<struct<package: struct<name: string, version: string, ecosystem: string>, vulnerabilities: array<struct<id: string, aliases: array<string>>>>>>>>",
    "grype": "struct<matches: array<struct<vulnerability: struct<id: string>, relatedVulnerabilities: array<struct<id: string>>, artifact: struct<name: string, version: string, type: string>>>>",
    "trivy": "struct<Results: array<struct<Type: string, Vulnerabilities: array<struct<VulnerabilityID: string, PkgName: string, InstalledVersion: string>>>>>",
}


def tool_findings(rows: DataFrame, tool: str) -> DataFrame:
    """content (one report a row; for govulncheck one message a row) as findings of another tool: tool, id, ids (with aliases), ecosystem, package, version."""
    none = F.array().cast("array<string>")
    if tool == "govulncheck":
        j = rows.select(F.from_json("content", "struct<osv: struct<id: string, aliases: array<string>>, finding: struct<osv: string, trace: array<struct<module: string, version: string>>>>").alias("j"))
        known = j.filter("j.osv.id is not null").select(F.col("j.osv.id").alias("id"), F.coalesce("j.osv.aliases", none).alias("aliases")).dropDuplicates(["id"])
        found = j.filter("j.finding.osv is not null").select(F.col("j.finding.osv").alias("id"), F.get("j.finding.trace", F.lit(0)).alias("t"))
        return found.join(known, "id", "left").select(F.lit(tool).alias("tool"), "id", F.concat(F.array("id"), F.coalesce("aliases", none)).alias("ids"), F.lit("Go").alias("ecosystem"), F.col("t.module").alias("package"), F.col("t.version").alias("version")).distinct()
    j = rows.select(F.from_json("content", _TOOL[tool]).alias("j"))
    if tool == "osv-scanner":
        p = j.select(F.explode("j.results").alias("r")).select(F.explode("r.packages").alias("p")).select("p.package", F.explode("p.vulnerabilities").alias("v"))
        out = p.select(F.col("v.id").alias("id"), F.concat(F.array("v.id"), F.coalesce("v.aliases", none)).alias("ids"), "package.ecosystem", F.col("package.name").alias("package"), "package.version")
    elif tool == "grype":
        m = j.select(F.explode("j.matches").alias("m")).select("m.*")
        out = m.select(F.col("vulnerability.id").alias("id"), F.concat(F.array("vulnerability.id"), F.coalesce(F.transform("relatedVulnerabilities", lambda x: x["id"]), none)).alias("ids"), F.col("artifact.type").alias("ecosystem"), F.col("artifact.name").alias("package"), F.col("artifact.version").alias("version"))
    else:
        v = j.select(F.explode("j.Results").alias("r")).select("r.Type", F.explode("r.Vulnerabilities").alias("v"))
        out = v.select(F.col("v.VulnerabilityID").alias("id"), F.array("v.VulnerabilityID").alias("ids"), F.col("Type").alias("ecosystem"), F.col("v.PkgName").alias("package"), F.col("v.InstalledVersion").alias("version"))
    return out.select(F.lit(tool).alias("tool"), "id", "ids", "ecosystem", "package", "version").filter("id != ''")


def epss(spark: SparkSession, path: str) -> DataFrame:
    """cve, epss, percentile; rows without a readable probability go."""
    rows = spark.read.csv(path, header=True, comment="#", schema="cve string, epss string, percentile string")
    return rows.select(F.upper(F.trim("cve")).alias("cve"), F.expr("try_cast(epss as double)").alias("epss"), F.expr("try_cast(percentile as double)").alias("percentile")).filter("epss is not null and cve != ''")


def kev(rows: DataFrame) -> DataFrame:
    """content (a catalogue) as cve, date_added, due_date, ransomware."""
    entry = "struct<vulnerabilities: array<struct<cveID: string, dateAdded: string, dueDate: string, knownRansomwareCampaignUse: string>>>"
    found = rows.select(F.explode(F.from_json("content", entry)["vulnerabilities"]).alias("v"))
    return found.select(F.upper(F.trim("v.cveID")).alias("cve"), F.col("v.dateAdded").alias("date_added"), F.col("v.dueDate").alias("due_date"), F.coalesce(F.lower("v.knownRansomwareCampaignUse") == "known", F.lit(False)).alias("ransomware")).filter("cve != ''")
