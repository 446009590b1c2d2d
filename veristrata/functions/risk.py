"""Scores and decision tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence codes and severity codes.
UNKNOWN, NOT_REACHABLE, PACKAGE_REACHABLE, SYMBOL_REACHABLE = 0, 1, 2, 3
SEVERITIES = ("UNSPECIFIED", "LOW", "MEDIUM", "HIGH", "CRITICAL")
#: Metric weights of the CVSS v3 specification.
AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
AC = {"L": 0.77, "H": 0.44}
UI = {"N": 0.85, "R": 0.62}
CIA = {"H": 0.56, "L": 0.22, "N": 0.0}
PR = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
#: Proxies for a missing base score, by severity code; and floors by severity code.
PROXY = {4: 9.0, 3: 7.5, 2: 5.0, 1: 2.0}


def _weight(value: Column, weights: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), value)


def _bind(value: Column, function) -> Column:
    """function(value), with the value computed once however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def metric(vector: Column, key: str) -> Column:
    """The value of a metric; the last of duplicates counts, and null if there is none."""
    found = F.regexp_extract(F.concat(F.lit("/"), vector), rf"^.*/{key}:([^/]+)", 1)
    return F.when(found != "", found)


def roundup(x: Column) -> Column:
    """Up to one decimal, over integers at 1e5."""
    i = F.round(x * 100000).cast("bigint")
    return F.when(i % 10000 == 0, i / F.lit(100000.0)).otherwise((F.floor(i / 10000) + 1) / F.lit(10.0))


def cvss3(vector: Column) -> Column:
    """Base score of a v3 vector; null if a metric is missing or invalid."""

    def score(m: Column) -> Column:
        iss = 1 - (1 - m["c"]) * (1 - m["i"]) * (1 - m["a"])
        impact = _bind(iss, lambda x: F.when(m["changed"], 7.52 * (x - 0.029) - 3.25 * F.pow(x - 0.02, 15.0)).otherwise(6.42 * x))
        both = F.struct(impact.alias("impact"), (8.22 * m["av"] * m["ac"] * m["pr"] * m["ui"]).alias("exploit"), m["changed"].alias("changed"))
        return _bind(both, total)

    def total(x: Column) -> Column:
        least = F.least(F.when(x["changed"], 1.08 * (x["impact"] + x["exploit"])).otherwise(x["impact"] + x["exploit"]), F.lit(10.0))
        return F.when(x["impact"].isNull() | x["exploit"].isNull(), None).when(x["impact"] <= 0, 0.0).otherwise(_bind(least, roundup))

    pr = metric(vector, "PR")
    values = F.struct(
        *[_weight(metric(vector, k.upper()), w).alias(k) for k, w in (("av", AV), ("ac", AC), ("ui", UI), ("c", CIA), ("i", CIA), ("a", CIA))],
        F.when(metric(vector, "S") == "C", True).when(metric(vector, "S") == "U", False).alias("changed"),
        F.when(metric(vector, "S") == "C", _weight(pr, PR["C"])).when(metric(vector, "S") == "U", _weight(pr, PR["U"])).alias("pr"),
    )
    return _bind(values, score)


def cvss3_scores(rows: DataFrame, column: str = "vector") -> DataFrame:
    """rows with `score`: each distinct vector is scored once."""
    scored = rows.select(F.col(column).alias("_v")).distinct().withColumn("score", cvss3(F.col("_v")))
    return rows.join(scored, F.col(column).eqNullSafe(F.col("_v")), "left").drop("_v")


#: Required metrics of CVSS v4.0 and their values.
V4 = {"AV": "NALP", "AC": "LH", "AT": "NP", "PR": "NLH", "UI": "NPA", "VC": "HLN", "VI": "HLN", "VA": "HLN", "SC": "HLN", "SI": "HLN", "SA": "HLN"}


def cvss4_valid(vector: Column) -> Column:
    """Whether all base metrics are there with allowed values. Such a vector is kept, with score 0."""
    out = F.startswith(vector, F.lit("CVSS:4.0/"))
    for key, values in V4.items():
        out = out & F.coalesce(metric(vector, key).isin(*values), F.lit(False))
    return F.coalesce(out, F.lit(False))


def parsed_cvss(vector: Column, source: Column) -> Column:
    """struct<version, vector, base_score, source>; null for a vector that cannot be used."""
    version = F.regexp_extract(vector, r"^CVSS:([0-9.]+)/", 1)
    score = F.when(version.isin("3.0", "3.1"), cvss3(vector)).when(version == "4.0", F.when(cvss4_valid(vector), 0.0))
    return _bind(score, lambda x: F.when(x.isNotNull(), F.struct(version.alias("version"), vector.alias("vector"), x.alias("base_score"), source.alias("source"))))


def best_cvss(metrics: Column) -> Column:
    """struct<vector, base_score>: the first of the greatest scores; the first vector, with 0, if none is scored; null without any."""
    start = F.struct(F.lit("").alias("vector"), F.lit(0.0).alias("base_score"))
    best = F.aggregate(metrics, start, lambda a, m: F.when(m["base_score"] > a["base_score"], F.struct(m["vector"].alias("vector"), m["base_score"].alias("base_score"))).otherwise(a))
    first = F.struct(F.get(metrics, F.lit(0))["vector"].alias("vector"), F.lit(0.0).alias("base_score"))
    return F.when(F.size(metrics) <= 0, None).when(best["base_score"] > 0, best).otherwise(first)


def severity_of_metrics(metrics: Column, bare: Column, text: Column) -> Column:
    """From the first scored metric of the newest version, else a bare score, else the text."""
    ranked = F.transform(F.filter(metrics, lambda m: (m["base_score"] > 0) & m["version"].isin("4.0", "3.1", "3.0")), lambda m, i: F.struct(F.array_position(F.array(F.lit("4.0"), F.lit("3.1"), F.lit("3.0")), m["version"]).alias("rank"), i.alias("i"), m["base_score"].alias("score")))
    score = F.coalesce(F.array_min(ranked)["score"], F.when(bare > 0, bare))
    return _bind(score, lambda x: F.when(x.isNotNull(), severity_band(x)).otherwise(severity_of_text(F.coalesce(text, F.lit("")))))


def severity_band(score: Column) -> Column:
    return F.when(score <= 0, 0).when(score < 4, 1).when(score < 7, 2).when(score < 9, 3).otherwise(4)


def severity_of_text(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.when(t == "CRITICAL", 4).when(t == "HIGH", 3).when(t.isin("MEDIUM", "MODERATE"), 2).when(t == "LOW", 1).otherwise(0)


def default_severity(plugin: Column, advisory: Column, confidence: Column) -> Column:
    """What the analyser says, else the advisory, else HIGH for anything reachable."""
    reachable = confidence.isin(PACKAGE_REACHABLE, SYMBOL_REACHABLE)
    return F.when(plugin > 0, plugin).when(advisory > 0, advisory).when(reachable, 3).otherwise(0)


def risk_score(confidence: Column, cvss: Column, severity: Column, epss: Column, kev: Column) -> Column:
    """0 to 100; 0 only for what is not reachable."""
    multiplier = F.when(confidence == SYMBOL_REACHABLE, 1.0).when(confidence == PACKAGE_REACHABLE, 0.9).otherwise(0.6)
    proxy = F.lit(0.0)
    for code, value in PROXY.items():
        proxy = F.when(severity == code, value).otherwise(proxy)
    base = F.when(cvss > 0, cvss).otherwise(proxy)
    score = F.when(kev, 90 + 10 * multiplier).otherwise(base * 10 * multiplier) + 10 * F.coalesce(epss, F.lit(0.0))
    floor = F.when(confidence == SYMBOL_REACHABLE, 50.0).when(confidence == PACKAGE_REACHABLE, 40.0).otherwise(25.0)
    return F.when(confidence == NOT_REACHABLE, 0.0).otherwise(F.least(F.greatest(score, floor), F.lit(100.0)))


def risk_tier(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 70, "high").when(score >= 40, "medium").when(score > 0, "low").otherwise("none")


def vex_status(confidence: Column, incomplete: Column) -> Column:
    return F.when((confidence == NOT_REACHABLE) & ~incomplete, "not_affected").when(confidence.isin(PACKAGE_REACHABLE, SYMBOL_REACHABLE), "affected").otherwise("under_investigation")


def exit_code(gate_failed: Column, incomplete: Column) -> Column:
    return F.when(gate_failed, 1).when(incomplete, 3).otherwise(0)
