"""A whole scan of many projects: dependencies and feeds in, findings, statements' inputs and exit codes out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.functions import risk
from veristrata.functions.decisions import listed_confidence
from veristrata.functions.text import cve_ids, lowest_fixed
from veristrata.operators import advisories as adv
from veristrata.session import cut


@dataclass
class Feeds:
    """Signals by CVE; any may be missing. epss: cve, epss; kev: cve."""

    epss: DataFrame | None = None
    kev: DataFrame | None = None
    enrichers: list = field(default_factory=list)


def findings(deps: DataFrame, advisories: DataFrame, feeds: Feeds | None = None, confidence: DataFrame | None = None) -> DataFrame:
    """project, id, ecosystem, module, version, dep_type, dev_only, confidence, severity, cvss, epss, kev, risk, tier, incomplete, fixed, aliases.

    deps: project, ecosystem, name, version, dep_type. advisories: as of the feeds, with severity and cvss (array of metrics). confidence, if an
    analysis gave one: project, id, module, confidence; without it a dependency that is listed is package-reachable, or unknown
    where its version cannot be decided.
    """
    feeds = feeds or Feeds()
    found = adv.match(deps, advisories)
    cves = F.array_sort(F.array_distinct(cve_ids(F.col("advisory"), F.col("aliases"))))
    best = risk.best_cvss(F.col("cvss"))["base_score"] if "cvss" in advisories.columns else F.lit(0.0)
    own = advisories.select(*adv.PACKAGE, "advisory", "severity", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce(best, F.lit(0.0)).alias("cvss_score"), lowest_fixed(F.col("version_ranges")).alias("fixed"), cves.alias("cves"))
    own = cut(own.dropDuplicates([*adv.PACKAGE, "advisory"]))
    signals = own.select("advisory", "cves").dropDuplicates(["advisory"])
    stamped = own.withColumn("epss", F.lit(None).cast("double")) if feeds.epss is None else own.join(adv.first_by_alias(signals, feeds.epss.select("cve", "epss"), "epss"), "advisory", "left")
    if feeds.kev is None:
        stamped = stamped.withColumn("kev", F.lit(False))
    else:
        hit = adv.first_by_alias(signals, feeds.kev.select("cve", F.lit(True).alias("kev")).distinct(), "kev")
        stamped = stamped.join(hit, "advisory", "left").withColumn("kev", F.coalesce("kev", F.lit(False)))
    for enrich in feeds.enrichers:
        stamped = stamped.transform(enrich)
    scored = found.join(stamped.drop("cves"), [*adv.PACKAGE, "advisory"])
    rows = adv.merge_dep_types(deps.withColumn("pos", F.lit(0)), ["project", *adv.PACKAGE, "version"]).join(scored, [*adv.PACKAGE, "version"])
    rows = rows.withColumnsRenamed({"advisory": "id", "name": "module"}).withColumn("listed", listed_confidence(F.col("verdict")))
    if confidence is not None:
        rows = rows.join(confidence.select("project", "id", "module", F.col("confidence").alias("analysed")), ["project", "id", "module"], "left")
        rows = rows.withColumn("confidence", F.when(F.col("verdict") == 2, risk.UNKNOWN).otherwise(F.coalesce("analysed", F.lit(risk.UNKNOWN)))).drop("analysed")
    else:
        rows = rows.withColumn("confidence", F.col("listed"))
    rows = rows.withColumn("severity", risk.default_severity(F.lit(0), F.col("severity"), F.col("confidence")))
    score = risk.risk_score(F.col("confidence"), F.col("cvss_score"), F.col("severity"), F.col("epss"), F.col("kev"))
    rows = rows.withColumns({"risk": score, "incomplete": F.col("verdict") == 2, "dev_only": F.col("dep_type") == "dev"}).withColumn("tier", risk.risk_tier(F.col("risk")))
    return rows.select("project", "id", "ecosystem", "module", "version", "dep_type", "dev_only", "confidence", "severity", F.col("cvss_score").alias("cvss"), "epss", "kev", "risk", "tier", "incomplete", "fixed", "aliases")


def scan(deps: DataFrame, closures: DataFrame, advisories: DataFrame, policy, now: str, feeds: Feeds | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings, and project, gate_failed, incomplete, exit_code. closures: project, complete; a project whose list is not whole is still searched, but incomplete."""
    found = cut(findings(deps, advisories, feeds))
    gates = policy.evaluate(found, now, ["project"])
    whole = closures.groupBy("project").agg(F.bool_and(F.coalesce("complete", F.lit(False))).alias("complete"))
    rows = whole.join(gates.drop("exit_code"), "project", "full")
    rows = rows.select("project", F.coalesce("gate_failed", F.lit(False)).alias("gate_failed"), (~F.coalesce("complete", F.lit(False)) | F.coalesce("incomplete", F.lit(False))).alias("incomplete"))
    return found, rows.withColumn("exit_code", risk.exit_code(F.col("gate_failed"), F.col("incomplete")))
