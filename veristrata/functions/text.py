"""Names, identifiers and renderings as column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Package URL types by ecosystem.
PURL_TYPES = {"Go": "golang", "npm": "npm", "crates.io": "cargo", "PyPI": "pypi", "Maven": "maven", "NuGet": "nuget", "Packagist": "composer", "RubyGems": "gem", "Hex": "hex", "Pub": "pub", "SwiftURL": "swift"}
#: Report levels by severity code.
LEVELS = {1: "note", 2: "warning", 3: "error", 4: "error"}

#: Names of severities and of reachability by code; the form of CVE names.
SEVERITIES = ("UNSPECIFIED", "LOW", "MEDIUM", "HIGH", "CRITICAL")
REACH_LABELS = ("reachability-unknown", "not-reachable", "package-reachable", "symbol-reachable")
CONFIDENCES = ("CONFIDENCE_UNKNOWN", "CONFIDENCE_NOT_REACHABLE", "CONFIDENCE_PACKAGE_REACHABLE", "CONFIDENCE_SYMBOL_REACHABLE")
#: Texts of findings by confidence code.
MESSAGES = (
    "reachability could not be determined (%s). Surfaced because unknown ≠ safe.",
    "no call path to the vulnerable symbol was found (%s). Suppressed but auditable.",
    "the vulnerable package is reachable but symbol-level confirmation is unavailable (%s).",
    "a concrete call path to the vulnerable symbol was found (%s).",
)
CVE = r"^CVE-[0-9]{4}-[0-9]{4,}$"


def canonical(version: Column) -> Column:
    return F.when(F.startswith(version, F.lit("v")), version).otherwise(F.concat(F.lit("v"), version))


def pypi_name(name: Column, joint: str = "-") -> Column:
    """Lower case, runs of -, _ and . as one joint."""
    return F.regexp_replace(F.lower(name), "[-_.]+", joint)


def cpe_product(cpe: Column) -> Column:
    """The product field of a 2.3 name, with - for _."""
    return F.replace(F.split_part(cpe, F.lit(":"), F.lit(5)), F.lit("_"), F.lit("-"))


def cwes(names: Column) -> Column:
    """Distinct CWE names: CWE-n by number first, then what is left, in upper case, by text."""

    def keyed(x: Column) -> Column:
        name = F.upper(F.trim(x))
        digits = F.regexp_extract(name, r"^(?:CWE-?)?\s*([0-9]{1,18})$", 1)
        number = F.when(digits != "", digits.cast("bigint"))
        return F.struct(number.isNull().alias("rest"), F.coalesce(number, F.lit(0)).alias("n"), F.when(number.isNull(), name).otherwise(F.concat(F.lit("CWE-"), number.cast("string"))).alias("name"))

    found = F.filter(F.transform(names, keyed), lambda s: s["name"] != "")
    return F.transform(F.array_sort(F.array_distinct(found)), lambda s: s["name"])


def npm_name(name: Column) -> Column:
    return F.lower(name)


def swift_url(url: Column) -> Column:
    """Lower case, host/path: no scheme, no git@host:, no / or .git at the end."""
    text = F.lower(F.trim(url))
    text = F.when(F.startswith(text, F.lit("git@")), F.regexp_replace(F.regexp_replace(text, "^git@", ""), "^([^:]*):", "$1/")).otherwise(F.regexp_replace(text, "^https?://", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "/+$", ""), r"\.git$", ""), "/+$", "")


def package_slug(ecosystem: Column, name: Column) -> Column:
    """Folder of a package in an advisory tree: a Python name in its normal form, Maven's colon as a slash."""
    return F.when(ecosystem == "PyPI", pypi_name(name)).when(ecosystem == "Maven", F.replace(name, F.lit(":"), F.lit("/"))).otherwise(name)


def last_segment(name: Column) -> Column:
    """What follows the last / or : of a package name."""
    return F.regexp_extract(name, "([^/:]*)$", 1)


def product_token(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit("-"))


def cpe_version(cpe: Column) -> Column:
    return F.split_part(cpe, F.lit(":"), F.lit(6))


def severity_label(severity: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, SEVERITIES)), severity.cast("int")), F.lit(SEVERITIES[0]))


def conflict_text(meta: Column) -> Column:
    """name:SEVERITY of each source (array<struct<source, severity, vector>>), sorted; empty unless they differ."""
    spread = F.size(F.array_distinct(F.transform(meta, lambda m: m["severity"])))
    return F.when(spread > 1, F.array_join(F.array_sort(F.transform(meta, lambda m: F.concat_ws(":", m["source"], severity_label(m["severity"])))), ",")).otherwise("")


def provenance_text(meta: Column) -> Column:
    """name SEVERITY vector of each source, sorted."""
    return F.array_join(F.array_sort(F.transform(meta, lambda m: F.concat_ws(" ", m["source"], severity_label(m["severity"]), F.when(m["vector"] != "", m["vector"])))), "; ")


def stale_text(sources: Column) -> Column:
    return F.array_join(F.array_sort(F.coalesce(sources, F.array().cast("array<string>"))), ",")


def rationale(confidence: Column, cvss: Column, epss: Column, kev: Column) -> Column:
    """What a risk score is made of."""
    label = F.element_at(F.array(*map(F.lit, REACH_LABELS)), (F.coalesce(confidence, F.lit(0)) + 1).cast("int"))
    # Zeros of fixed places, rounded as the shown number: through decimals, without grouping.
    shown = lambda x, n: F.round(x.cast("decimal(20,10)"), n).cast(f"decimal(20,{n})").cast("string")
    return F.concat_ws(" + ", label, F.when(kev, "KEV"), F.when(cvss > 0, F.concat(F.lit("CVSS "), shown(cvss, 1))), F.when(epss > 0, F.concat(F.lit("EPSS "), shown(epss, 2))))


def cve_ids(id_: Column, aliases: Column) -> Column:
    """CVE names among the id and then the aliases, in upper case, each once, in order."""
    every = F.transform(F.concat(F.array(id_), F.coalesce(aliases, F.array().cast("array<string>"))), lambda x: F.upper(F.trim(x)))
    return F.array_distinct(F.filter(every, lambda x: x.rlike(CVE)))


def cve_aliases(aliases: Column) -> Column:
    """CVE names among the aliases alone, as they are written, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda x: x.rlike(CVE))))


def minified(content: Column, long_line: int = 50_000, long_mean: int = 500) -> Column:
    """Whether a source's lines that are not empty are too long to be written by hand: a single long one, or long on average."""
    lengths = F.filter(F.transform(F.split(content, "\n"), lambda x: F.length(x)), lambda n: n > 0)
    total, n = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x), F.size(lengths)
    return F.coalesce((n > 0) & (((n == 1) & (total > long_line)) | (total / n > long_mean)), F.lit(False))


def ranges_text(ranges: Column) -> Column:
    """[a,b) for a fixed bound, [a,b] for a last affected one, else >=a; an empty lower bound is 0."""
    low = lambda r: F.when(r["introduced"] == "", "0").otherwise(r["introduced"])
    one = lambda r: F.when(r["fixed"] != "", F.concat(F.lit("["), low(r), F.lit(","), r["fixed"], F.lit(")"))).when(r["last_affected"] != "", F.concat(F.lit("["), low(r), F.lit(","), r["last_affected"], F.lit("]"))).otherwise(F.concat(F.lit(">="), low(r)))
    return F.array_join(F.transform(ranges, one), "; ")


def lowest_fixed(ranges: Column) -> Column:
    """The least fixed bound as text (not as a version); empty if there is none."""
    return F.coalesce(F.array_min(F.filter(F.transform(ranges, lambda r: r["fixed"]), lambda x: x != "")), F.lit(""))


def identities(id_: Column, aliases: Column) -> Column:
    return F.array_union(F.array(id_), F.coalesce(aliases, F.array().cast("array<string>")))


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """Package URL; empty for an unknown ecosystem or no name."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in PURL_TYPES.items() for x in pair]), ecosystem)
    part = F.when(kind == "maven", F.replace(name, F.lit(":"), F.lit("/"))).otherwise(name)
    tail = F.when(F.coalesce(version, F.lit("")) == "", "").otherwise(F.concat(F.lit("@"), version))
    return F.when(kind.isNull() | (F.coalesce(name, F.lit("")) == ""), "").otherwise(F.concat(F.lit("pkg:"), kind, F.lit("/"), part, tail))


def truncated(text: Column, most: int) -> Column:
    """At most so many code points, the last one an ellipsis if any are cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(max(most - 1, 0))), F.lit("…")))


def confidence_name(confidence: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, CONFIDENCES)), confidence.cast("int")), F.lit(CONFIDENCES[0]))


def confidence_code(name: Column) -> Column:
    """What is no known name is unknown."""
    names = F.array(*map(F.lit, CONFIDENCES))
    return F.greatest(F.array_position(names, F.upper(F.trim(F.coalesce(name, F.lit(""))))).cast("int") - 1, F.lit(0))


def report_message(confidence: Column, advisory: Column, module: Column) -> Column:
    """The text of a finding in a report."""
    what = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.coalesce(confidence, F.lit(0)) + 1).cast("int"))
    return F.replace(F.concat(F.lit("Vulnerability "), advisory, F.lit(" in "), module, F.lit(": "), what), F.lit("%s"), confidence_name(F.coalesce(confidence, F.lit(0))))


def report_level(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), severity.cast("int")), F.lit("none"))
