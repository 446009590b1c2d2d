"""Queries of the scan path over the driver's tables: lockfile texts and advisory records are written from them, read, matched, scored and gated."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.functions import risk
from veristrata.operators import advisories as adv
from veristrata.operators import scan
from veristrata.policy import Policy
from veristrata.session import table
from veristrata.sources import feeds, lockfiles

_ECOSYSTEMS = ("Go", "npm", "PyPI", "crates.io", "Maven")


def _ecosystem(key):
    return F.element_at(F.array(*map(F.lit, _ECOSYSTEMS)), (key % 5 + 1).cast("int"))


def _name(key):
    """A package name; Maven's has two parts."""
    return F.concat(F.when(key % 5 == 4, "g:").otherwise(""), F.lit("p"), key.cast("string"))


def _deps(spark, sf):
    version = F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), (F.col("l_suppkey") % 10).cast("string"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project"), _ecosystem(F.col("l_partkey")).alias("ecosystem"), _name(F.col("l_partkey")).alias("name"), version.alias("version"))


def _advisories(spark, sf):
    """Of each part: one or two ranges, or a list of versions, or commits only; a fixed version that does not parse everywhere."""
    size, key = F.col("p_size"), F.col("p_partkey")
    one = lambda low, fixed, last: F.struct(low.alias("introduced"), fixed.alias("fixed"), last.alias("last_affected"))
    none = F.lit("")
    fixed = F.when(size % 11 == 0, "?x").otherwise(F.concat_ws(".", (size % 7 + 1).cast("string"), size.cast("string"), F.lit("0")))
    first = one(F.when(size % 3 == 0, "2.0.0").otherwise(""), fixed, none)
    ranges = F.when((size % 13 == 0) | (size % 17 == 0), F.array_except(F.array(first), F.array(first))).when(key % 3 == 0, F.array(first, one(F.lit("6.0.0"), none, F.lit("6.40.5")))).otherwise(F.array(first))
    listed = F.when(size % 13 == 0, F.array(F.lit("1.1.1"), F.concat(F.lit("3."), size.cast("string"), F.lit(".3")))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "part").select(_ecosystem(key).alias("ecosystem"), _name(key).alias("name"), F.concat(F.lit("ADV-"), key.cast("string")).alias("advisory"), ranges.alias("version_ranges"), listed.alias("versions"), (size % 17 == 0).alias("undecidable_ranges"), F.pmod(F.floor("p_retailprice"), F.lit(5)).cast("int").alias("severity"), F.array(F.concat(F.lit("CVE-2024-"), F.lpad(key.cast("string"), 8, "0"))).alias("aliases"), key.alias("key"))


_SQL = """deps AS (SELECT l_orderkey AS project, l_partkey AS k, l_linenumber || '.' || CAST(l_quantity AS INT) || '.' || (l_suppkey % 10) AS version, [CAST(l_linenumber AS BIGINT), CAST(l_quantity AS BIGINT), CAST(l_suppkey % 10 AS BIGINT)] AS v FROM lineitem),
versions AS (SELECT DISTINCT k, version, v FROM deps),
named AS (SELECT *, ['Go', 'npm', 'PyPI', 'crates.io', 'Maven'][p_partkey % 5 + 1] AS ecosystem, CASE WHEN p_partkey % 5 = 4 THEN 'g:' ELSE '' END || 'p' || p_partkey AS name, 'ADV-' || p_partkey AS advisory, CAST(floor(p_retailprice) AS BIGINT) % 5 AS severity FROM part),
judged AS (SELECT k, version, ecosystem, name, advisory, severity, p_partkey, p_size,
  CASE WHEN p_size % 3 = 0 AND v < [CAST(2 AS BIGINT), 0, 0] THEN 0 WHEN p_size % 11 = 0 THEN CASE WHEN p_partkey % 5 = 4 THEN 0 ELSE 2 END WHEN v < [CAST(p_size % 7 + 1 AS BIGINT), p_size, 0] THEN 1 ELSE 0 END AS one,
  CASE WHEN p_partkey % 3 = 0 AND v >= [CAST(6 AS BIGINT), 0, 0] AND v <= [CAST(6 AS BIGINT), 40, 5] THEN 1 ELSE 0 END AS two FROM versions JOIN named ON k = p_partkey),
matched AS (SELECT *, CASE WHEN p_size % 13 = 0 THEN CASE WHEN version IN ('1.1.1', '3.' || p_size || '.3') THEN 1 ELSE 0 END WHEN p_size % 17 = 0 THEN 2 WHEN one = 1 OR two = 1 THEN 1 WHEN one = 2 THEN 2 ELSE 0 END AS verdict FROM judged)"""


def matched_versions(spark, sf):
    return adv.match(_deps(spark, sf), _advisories(spark, sf))


def version_range_verdict(spark, sf):
    return matched_versions(spark, sf).groupBy("ecosystem", "verdict").agg(F.count("*").alias("n"))


def _signals(spark, sf):
    key = F.col("p_partkey")
    cve = F.concat(F.lit("CVE-2024-"), F.lpad(key.cast("string"), 8, "0"))
    part = table(spark, sf, "part")
    return scan.Feeds(part.select(F.when(F.col("p_size") % 4 == 0, cve).otherwise("").alias("cve"), (key % 100 / 100).alias("epss")), part.select(F.when(F.col("p_size") % 29 == 0, cve).otherwise("").alias("cve")))


def _findings(spark, sf):
    deps = _deps(spark, sf).withColumn("dep_type", F.when(F.col("project") % 9 == 0, "dev").otherwise("runtime"))
    own = _advisories(spark, sf)
    vector = F.concat(F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:"), F.when(F.col("key") % 2 == 0, "H").otherwise("N"), F.lit("/I:H/A:H"))
    own = own.withColumn("cvss", F.when(F.col("key") % 3 == 0, F.filter(F.array(risk.parsed_cvss(vector, F.lit("feed"))), lambda m: m.isNotNull())))
    return scan.findings(deps, own, _signals(spark, sf))


_SCORED = """found AS (SELECT d.project, d.version, m.*, d.project % 9 = 0 AS dev, p_size % 29 = 0 AS kev, CASE WHEN p_size % 4 = 0 THEN (p_partkey % 100) / 100.0::DOUBLE END AS epss, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 9.8 ELSE 9.1 END ELSE 0 END::DOUBLE AS cvss
  FROM (SELECT DISTINCT project, k, version FROM deps) d JOIN (SELECT * EXCLUDE (version), version AS mv FROM matched WHERE verdict <> 0) m ON m.k = d.k AND mv = d.version),
leveled AS (SELECT *, CASE WHEN severity > 0 THEN severity WHEN verdict = 1 THEN 3 ELSE 0 END AS sev, CASE WHEN verdict = 2 THEN 0.6 ELSE 0.9 END::DOUBLE AS mult, CASE WHEN verdict = 2 THEN 25.0 ELSE 40.0 END::DOUBLE AS low FROM found),
scored AS (SELECT *, least(100.0::DOUBLE, greatest(low, CASE WHEN kev THEN 90 + 10 * mult ELSE (CASE WHEN cvss > 0 THEN cvss ELSE CASE sev WHEN 4 THEN 9.0 WHEN 3 THEN 7.5 WHEN 2 THEN 5.0 WHEN 1 THEN 2.0 ELSE 0.0 END END)::DOUBLE * 10.0::DOUBLE * mult END + 10.0::DOUBLE * coalesce(epss, 0.0::DOUBLE))) AS score FROM leveled)"""


def risk_tiers(spark, sf):
    found = _findings(spark, sf)
    return found.groupBy("tier", "severity", "kev").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("risk"), 4)), 2).alias("total"))


def flagship_gate(spark, sf):
    """Which projects fail a gate on HIGH or a signal, at what greatest risk, and with which exit code."""
    found = _findings(spark, sf).withColumn("gates", Policy("high", "reachable, kev, epss>=0.9").gates())
    rows = found.groupBy("project").agg(F.count("*").alias("n_findings"), F.round(F.max("risk"), 4).alias("max_risk"), F.bool_or("gates").alias("failed"), F.bool_or("incomplete").alias("part"))
    return rows.select("project", "n_findings", "max_risk", risk.exit_code(F.col("failed"), F.col("part")).alias("exit_code"))


def project_scan(spark, sf):
    """From files to exit codes: each order's packages as a lockfile's text, each part's record as JSON; then read, match, score, ignore and gate."""
    line = table(spark, sf, "lineitem")
    version = F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), (F.col("l_suppkey") % 10).cast("string"))
    entry = F.to_json(F.struct(F.concat(F.lit("v/P"), F.col("l_partkey").cast("string")).alias("name"), F.concat(F.lit("v"), version).alias("version")))
    dev = F.col("l_returnflag") == "A"
    listed = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, entry))), ",")
    files = line.groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.concat(F.when(F.max("l_orderkey") % 10 == 0, "{").otherwise('{"packages":['), listed(~dev), F.lit('],"packages-dev":['), listed(dev), F.lit("]}")).alias("content"))
    deps = lockfiles.read(files, "composer.lock").select(F.col("path").alias("project"), F.lit("Packagist").alias("ecosystem"), "name", "version", "dep_type")
    closures = lockfiles.closure(files, "composer.lock").select(F.col("path").alias("project"), "complete")
    size, key = F.col("p_size"), F.col("p_partkey")
    event = lambda k, v: F.create_map(F.lit(k), v)
    fixed = F.concat_ws(".", (size % 7 + 1).cast("string"), size.cast("string"), F.lit("0"))
    events = F.array(event("introduced", F.when(size % 3 == 0, "2.0.0").otherwise("0")), event("fixed", F.when(size % 11 == 0, "dev-x").otherwise(fixed)))
    affected = F.struct(F.struct(F.lit("Packagist").alias("ecosystem"), F.concat(F.lit("v/p"), key.cast("string")).alias("name")).alias("package"), F.array(F.struct(F.lit("ECOSYSTEM").alias("type"), events.alias("events"))).alias("ranges"))
    text = F.element_at(F.array(*map(F.lit, ("", "LOW", "MODERATE", "HIGH", "CRITICAL"))), (F.pmod(F.floor("p_retailprice"), F.lit(5)) + 1).cast("int"))
    records = table(spark, sf, "part").select(F.to_json(F.struct(F.concat(F.lit("ADV-"), key.cast("string")).alias("id"), F.when(size % 19 == 0, "2024-01-01T00:00:00Z").otherwise("").alias("withdrawn"), F.array(affected).alias("affected"), F.struct(text.alias("severity")).alias("database_specific"))).alias("content"))
    policy = Policy("high", ignores=[{"id": f"ADV-{k}", "module": f"v/p{k}", "reason": "known", "expires": "2030-01-01" if k % 2 else ""} for k in range(1, 40)])
    _, gates = scan.scan(deps, closures, feeds.advisories(records), policy, "2024-06-01")
    return gates.select(F.col("project").cast("bigint").alias("project"), "gate_failed", "incomplete", "exit_code")


QUERIES = {f.__name__: f for f in (matched_versions, version_range_verdict, risk_tiers, flagship_gate, project_scan)}

ORACLES = {
    "matched_versions": f"WITH {_SQL} SELECT ecosystem, name, version, advisory, verdict FROM matched WHERE verdict <> 0",
    "version_range_verdict": f"WITH {_SQL} SELECT ecosystem, verdict, count(*) AS n FROM matched WHERE verdict <> 0 GROUP BY ALL",
    "risk_tiers": f"WITH {_SQL}, {_SCORED} SELECT CASE WHEN score >= 90 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS tier, CAST(sev AS INT) AS severity, kev, count(*) AS n, round(sum(round(score, 4)), 2) AS total FROM scored GROUP BY ALL",
    "flagship_gate": f"""WITH {_SQL}, {_SCORED} SELECT project, count(*) AS n_findings, round(max(score), 4) AS max_risk, CASE WHEN bool_or(NOT dev AND verdict = 1 AND (sev >= 3 OR kev OR coalesce(epss, 0) >= 0.9)) THEN 1 WHEN bool_or(verdict = 2) THEN 3 ELSE 0 END AS exit_code FROM scored GROUP BY project""",
    "project_scan": """WITH deps AS (SELECT l_orderkey AS project, l_partkey AS k, l_returnflag = 'A' AS dev, [CAST(l_linenumber AS BIGINT), CAST(l_quantity AS BIGINT), CAST(l_suppkey % 10 AS BIGINT)] AS v FROM lineitem),
      runtime AS (SELECT project, k, v, bool_and(dev) AS dev FROM deps WHERE project % 10 <> 0 GROUP BY ALL),
      found AS (SELECT project, k, dev, CAST(floor(p_retailprice) AS BIGINT) % 5 AS sev, CASE WHEN p_size % 3 = 0 AND v < [CAST(2 AS BIGINT), 0, 0] THEN 0 WHEN p_size % 11 = 0 THEN 2 WHEN v < [CAST(p_size % 7 + 1 AS BIGINT), p_size, 0] THEN 1 ELSE 0 END AS verdict FROM runtime JOIN part ON k = p_partkey WHERE p_size % 19 <> 0),
      g AS (SELECT project, bool_or(NOT dev AND NOT (k < 40 AND k % 2 = 1) AND (sev >= 3 OR sev = 0 AND verdict = 1)) AS failed, bool_or(verdict = 2) AS part FROM found WHERE verdict <> 0 GROUP BY project)
      SELECT project, coalesce(failed, FALSE) AS gate_failed, project % 10 = 0 OR coalesce(part, FALSE) AS incomplete, CASE WHEN failed THEN 1 WHEN project % 10 = 0 OR part THEN 3 ELSE 0 END AS exit_code FROM (SELECT DISTINCT project FROM deps) LEFT JOIN g USING (project)""",
}
