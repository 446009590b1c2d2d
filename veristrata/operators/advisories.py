"""Matching dependencies to advisories, merging advisories, and enriching them.

An advisory row has ecosystem, name, advisory, version_ranges (array of
introduced, fixed, last_affected; empty is no bound), versions and
undecidable_ranges, as the feeds give it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions.risk import SYMBOL_REACHABLE
from veristrata.functions.text import last_segment, product_token
from veristrata.functions.versions import any_range, compared_verdict, dotted_compare, listed_verdict, maven_orders, range_verdict, version_key

PACKAGE = ["ecosystem", "name"]
BOUNDS = ["introduced", "fixed", "last_affected"]


def match(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """One row for each distinct (ecosystem, name, version, advisory) with its verdict: 1 affected, 2 undecidable; rows that are not affected go.

    deps: ecosystem, name, version, and any others. Versions are made distinct before the join, so a package is matched
    once for all projects, and versions and bounds are parsed once each. An ecosystem without an order is undecidable.
    Advisories without ranges are matched by their list of versions; without either they affect nothing, unless their
    ranges cannot be decided.
    """
    versions = deps.select(*PACKAGE, "version").distinct().withColumn("key", version_key(F.col("ecosystem"), F.col("version")))
    own = advisories.select(*PACKAGE, "advisory", "version_ranges", "versions", "undecidable_ranges")
    ranged = F.coalesce(F.size("version_ranges"), F.lit(0)) > 0
    ranges = own.filter(ranged).select(*PACKAGE, "advisory", F.explode("version_ranges").alias("r")).select(*PACKAGE, "advisory", *[F.coalesce(F.col("r")[b], F.lit("")).alias(b) for b in BOUNDS])
    has = [F.col(b) != "" for b in BOUNDS]
    maven = F.col("ecosystem") == "Maven"
    keyed = ranges.filter(~maven).withColumns({f"{b}_key": F.when(h, version_key(F.col("ecosystem"), F.col(b), bound=True)) for b, h in zip(BOUNDS, has, strict=True)})
    flat = versions.filter(~maven).join(keyed, PACKAGE).withColumn("verdict", range_verdict(F.col("key"), *[F.col(f"{b}_key") for b in BOUNDS], *has))
    paired = versions.filter(maven).join(ranges.filter(maven), PACKAGE)
    compared = paired.withColumn("o", maven_orders("version", *BOUNDS))
    nested = compared.withColumn("verdict", compared_verdict(F.col("o.parses"), *[F.col("o")[b] for b in BOUNDS], *has))
    columns = [*PACKAGE, "version", "advisory", "verdict"]
    listed = versions.join(own.filter(~ranged), PACKAGE).withColumn("verdict", listed_verdict(F.col("version"), F.col("versions"), F.col("undecidable_ranges")))
    rows = flat.select(*columns).union(nested.select(*columns)).union(listed.select(*columns))
    out = rows.filter("verdict <> 0").groupBy(*PACKAGE, "version", "advisory").agg(any_range(F.col("verdict")).alias("verdict"))
    return out


def platform_matches(deps: DataFrame, records: DataFrame) -> DataFrame:
    """cve, ecosystem, name, version, provable: packages whose last name part is the product of a vulnerable platform name.

    records: cve, cpe_matches (array of vulnerable, criteria, start_inc, start_exc, end_inc, end_exc; empty is no bound).
    A pinned version must be equal; a range that cannot be decided, or none at all, matches without proof.
    """
    rows = records.select("cve", F.explode("cpe_matches").alias("m")).filter("m.vulnerable").select("cve", "m.*")
    part = lambda k: F.split_part(F.col("criteria"), F.lit(":"), F.lit(k))
    rows = rows.withColumns({"product": product_token(part(5)), "pinned": part(6)})
    own = deps.select(*PACKAGE, "version").distinct().withColumns({"product": product_token(last_segment(F.col("name"))), "bare": F.regexp_replace("version", "^v", "")}).filter("product != ''")
    low, high = F.coalesce(F.nullif("start_inc", F.lit("")), F.nullif("start_exc", F.lit(""))), F.coalesce(F.nullif("end_inc", F.lit("")), F.nullif("end_exc", F.lit("")))
    rows = own.join(rows.withColumns({"low": low, "high": high}), "product")
    below, above = dotted_compare(F.col("bare"), F.col("low")), dotted_compare(F.col("bare"), F.col("high"))
    out_low = F.coalesce(F.when(F.coalesce("start_inc", F.lit("")) != "", below < 0).otherwise(below <= 0), F.lit(False))
    out_high = F.coalesce(F.when(F.coalesce("end_inc", F.lit("")) != "", above > 0).otherwise(above >= 0), F.lit(False))
    is_pinned = ~F.coalesce("pinned", F.lit("")).isin("", "*", "-")
    bounded = F.col("low").isNotNull() | F.col("high").isNotNull()
    decided = (F.col("low").isNull() | below.isNotNull()) & (F.col("high").isNull() | above.isNotNull())
    matched = F.when(is_pinned, F.col("pinned") == F.col("bare")).otherwise(~out_low & ~out_high)
    rows = rows.withColumns({"matched": matched, "proof": is_pinned | (bounded & decided)}).filter("matched")
    return rows.groupBy("cve", *PACKAGE, "version").agg(F.bool_or("proof").alias("provable"))


def greedy_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, pos, id, aliases, ...) with `grp`: the first group, in order of pos, that shares a name with the row; groups do not fuse later.

    The order of rows matters, so a group of keys (one package) is folded as a whole, inside one row.
    """
    inner = F.array_sort(F.collect_list(F.struct("pos", F.array_union(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("ids"))))
    start = F.expr("cast(array() as array<struct<ids:array<string>,members:array<bigint>>>)")

    def step(groups: Column, row: Column) -> Column:
        hit = F.array_position(F.transform(groups, lambda g: F.arrays_overlap(g["ids"], row["ids"])), True)
        joined = F.transform(groups, lambda g, i: F.when(i == hit - 1, F.struct(F.array_union(g["ids"], row["ids"]).alias("ids"), F.concat(g["members"], F.array(row["pos"].cast("bigint"))).alias("members"))).otherwise(g))
        return F.when(hit > 0, joined).otherwise(F.concat(groups, F.array(F.struct(row["ids"].alias("ids"), F.array(row["pos"].cast("bigint")).alias("members")))))

    found = rows.groupBy(*keys).agg(F.aggregate(inner, start, step).alias("groups"))
    members = found.select(*keys, F.posexplode("groups").alias("grp", "g")).select(*keys, "grp", F.explode("g.members").alias("pos"))
    return rows.join(members, [*keys, "pos"])


def resolve_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One advisory for each group of aliases.

    rows: keys, id, aliases, symbol_level, introduced, trust, severity, source, withdrawn ('' if not), pos; and, if
    they are there, version_ranges, incomplete, undecidable_ranges, and any others. The representative is the first by
    symbol level, introduced bound, trust, id and position, and its other columns stay. Severity is the greatest, sources and
    aliases are united, ranges too (the representative's first, then the others sorted), flags hold if any does, and
    only a unanimous withdrawal holds, from its earliest time.
    """
    order = F.struct(~F.col("symbol_level"), "introduced", -F.col("trust"), "id", "pos")
    flags = [c for c in ("incomplete", "undecidable_ranges") if c in rows.columns]
    merged = {*keys, "id", "aliases", "symbol_level", "introduced", "trust", "severity", "source", "withdrawn", "pos", "version_ranges", *flags}
    kept = [c for c in rows.columns if c not in merged]
    more = [F.bool_or(F.coalesce(c, F.lit(True))).alias(c) for c in flags] + [F.min_by(c, order).alias(c) for c in kept]
    if "version_ranges" in rows.columns:
        more += [F.min_by("version_ranges", order).alias("own_ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("version_ranges")))).alias("all_ranges")]
    out = rows.groupBy(*keys).agg(
        F.min_by("id", order).alias("id"),
        F.max("severity").alias("severity"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.collect_set("id").alias("ids"),
        F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("alias_list"),
        F.when(F.bool_and(F.coalesce("withdrawn", F.lit("")) != ""), F.min("withdrawn")).otherwise("").alias("withdrawn"),
        *more,
    )
    aliases = F.array_sort(F.array_except(F.array_union("ids", "alias_list"), F.array("id")))
    out = out.withColumn("aliases", aliases).drop("ids", "alias_list")
    if "version_ranges" in rows.columns:
        own = F.coalesce("own_ranges", F.array_except("all_ranges", "all_ranges"))
        out = out.withColumn("version_ranges", F.concat(F.array_distinct(own), F.array_except("all_ranges", own))).drop("own_ranges", "all_ranges")
    return out


def fill_gaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One advisory for each group from layers of one feed (column pos, the first layer leads): id; aliases and sources united; cvss, cwes,
    symbols and fix_refs of the first layer that has any; ranges, versions and flags of the first layer with ranges or versions; greatest severity.
    """
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    first = lambda c, when: F.min_by(F.when(when, F.col(c)), F.when(when, F.col("pos")))
    placed = some("version_ranges") | some("versions")
    out = rows.groupBy(*keys).agg(
        F.min_by("id", "pos").alias("id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.array_distinct(F.concat(F.collect_list("id"), F.flatten(F.collect_list("aliases")))).alias("names"),
        F.max("severity").alias("severity"),
        *[first(c, some(c)).alias(c) for c in ("cvss", "cwes", "symbols", "fix_refs")],
        *[F.coalesce(first(c, placed), F.max_by(c, "pos")).alias(c) for c in ("version_ranges", "versions")],
        *[F.coalesce(first(c, placed), F.max_by(c, "pos")).alias(c) for c in ("undecidable_ranges", "incomplete")],
    )
    return out.withColumn("aliases", F.array_sort(F.array_except("names", F.array("id")))).drop("names")


def first_by_alias(advisories: DataFrame, entries: DataFrame, value: str) -> DataFrame:
    """advisory, value of the first of its CVEs (in order) that `entries` (cve, value) lists; advisories: advisory, cves."""
    exploded = advisories.select("advisory", F.posexplode("cves").alias("pos", "cve")).withColumn("cve", F.upper(F.trim("cve")))
    return exploded.join(entries, "cve").groupBy("advisory").agg(F.min_by(value, "pos").alias(value))


def all_by_alias(advisories: DataFrame, records: DataFrame) -> DataFrame:
    """advisory, severity (greatest), cwes (united): every alias that `records` (cve, severity, cwes) has."""
    exploded = advisories.select("advisory", F.explode("cves").alias("cve"))
    found = exploded.join(records, "cve").groupBy("advisory").agg(F.max("severity").alias("severity"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cwes")))).alias("cwes"))
    return advisories.select("advisory").join(found, "advisory", "left")


def merge_dep_types(rows: DataFrame, keys: list[str]) -> DataFrame:
    """dep_type by keys: runtime (or empty) wins, else the first by pos."""
    runtime = F.col("dep_type").isin("runtime", "") | F.col("dep_type").isNull()
    return rows.groupBy(*keys).agg(F.when(F.bool_or(runtime), "runtime").otherwise(F.min_by("dep_type", "pos")).alias("dep_type"))


def epss_entries(queried: DataFrame, listed: DataFrame) -> DataFrame:
    """cve, epss, percentile: what a query for a CVE gave comes before the list. Both: cve, epss, percentile."""
    both = queried.withColumn("rank", F.lit(0)).unionByName(listed.withColumn("rank", F.lit(1)))
    return both.groupBy(F.upper(F.trim("cve")).alias("cve")).agg(F.min_by(F.struct("epss", "percentile"), F.struct("rank", "epss", "percentile")).alias("e")).select("cve", "e.epss", "e.percentile")


def source_status(failures: DataFrame, fetched: DataFrame) -> DataFrame:
    """source, failed, errors (sorted), age (the greatest snapshot age): a failed source leaves the others in place.

    failures: source, error; fetched: source, age.
    """
    errors = failures.groupBy("source").agg(F.array_sort(F.collect_set("error")).alias("errors"))
    ages = fetched.groupBy("source").agg(F.max("age").alias("age"))
    rows = ages.join(errors, "source", "full")
    return rows.select("source", F.col("errors").isNotNull().alias("failed"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), "age")


def freshness(sources: DataFrame, now: str, soft: int, hard: int | None = None) -> DataFrame:
    """sources (source, fetched) with age in seconds, stale (beyond `soft`, or never fetched) and incomplete (beyond `hard`, if one is set)."""
    age = F.to_timestamp(F.lit(now)).cast("double") - F.col("fetched").cast("timestamp").cast("double")
    beyond = lambda most: F.coalesce(F.col("age") > most, F.lit(True))
    return sources.withColumn("age", age).withColumns({"stale": beyond(soft), "incomplete": beyond(hard) if hard is not None else F.lit(False)})


def uncovered(present: DataFrame, coverage: DataFrame) -> DataFrame:
    """ecosystems in scope (ecosystem) that no selected source (source, ecosystem) serves: the scan is incomplete there, not clean."""
    return present.select("ecosystem").distinct().join(coverage.select("ecosystem"), "ecosystem", "left_anti")


def stamp(findings: DataFrame, advisories: DataFrame) -> DataFrame:
    """findings (advisory, ...) with the columns of their advisory by its id alone; of rows with the same id the last by `pos` counts.

    advisories: advisory, pos, and the columns to stamp; the id is enough, whatever package the row came from.
    """
    columns = [c for c in advisories.columns if c not in ("advisory", "pos")]
    last = advisories.groupBy("advisory").agg(F.max_by(F.struct(*columns), "pos").alias("_a"))
    return findings.join(last, "advisory", "left").select(findings.columns + [F.col(f"_a.{c}").alias(c) for c in columns])


def drop_ignored(findings: DataFrame, ignores: DataFrame, now: str) -> DataFrame:
    """findings without an ignore that holds at the time `now` (YYYY-MM-DD HH:MM:SS, or a day, from its start).

    ignores: id, module, symbol ('' for any), expires (YYYY-MM-DD, to the end of that day), elevated. An ignore without
    an expiry, or with an unreadable one, has expired. findings: id, module, and if they are there, symbols (of the path), confidence and severity: a
    symbol-reachable critical finding needs an elevated ignore.
    """
    ends = F.try_to_timestamp(F.concat("expires", F.lit(" 23:59:59")), F.lit("yyyy-MM-dd HH:mm:ss"))
    at = F.to_timestamp(F.lit(now if len(now) > 10 else now + " 00:00:00"), "yyyy-MM-dd HH:mm:ss")
    live = ignores.filter(F.coalesce(ends >= at, F.lit(False)))
    live = live.select(F.col("id").alias("_id"), F.col("module").alias("_module"), *[(F.col(c) if c in ignores.columns else F.lit(d)).alias(f"_{c}") for c, d in (("symbol", ""), ("elevated", False))]).distinct()
    hit = (F.col("id") == F.col("_id")) & (F.col("module") == F.col("_module"))
    anywhere = F.coalesce("_symbol", F.lit("")) == ""
    hit &= anywhere | F.coalesce(F.array_contains("symbols", F.col("_symbol")), F.lit(False)) if "symbols" in findings.columns else anywhere
    if {"confidence", "severity"} <= set(findings.columns):
        proven = (F.col("confidence") == SYMBOL_REACHABLE) & (F.col("severity") == 4)
        hit &= ~F.coalesce(proven, F.lit(True)) | F.coalesce("_elevated", F.lit(False))
    # Merged: the size of ignores that a query makes is guessed before they are made, and the driver would gather them for a broadcast.
    return findings.join(live.hint("merge"), hit, "left_anti")


def classify(expected: Column, got: Column) -> Column:
    """Outcome of one labelled case; an unknown answer is neither right nor wrong, but a violation where reachability was expected."""
    return (
        F.when(got.isNull(), F.when(expected == 1, "unknown_violation").otherwise("unknown"))
        .when((expected == 1) & (got == 1), "tp").when((expected == 0) & (got == 1), "fp").when((expected == 1) & (got == 0), "fn").otherwise("tn")
    )


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of outcomes with precision, recall and the share of safe cases that were not reported; a ratio of nothing is 1."""
    n = {k: F.count(F.when(F.col("outcome") == k, 1)).alias(k) for k in ("tp", "fp", "fn", "tn", "unknown", "unknown_violation")}
    out = rows.agg(*n.values())
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    return out.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn"), "suppression": ratio("tn", "fp")})
