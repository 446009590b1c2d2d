"""Findings as reports: SARIF, JSON and a table. Rows become texts natively; a document is their ordered list.

Findings: advisory, url, aliases, module, confidence, severity, pillar, language, properties (map of strings), path
(array of file, line, column, symbol); missing columns are empty. Order: advisory, module, then the row's text, which
makes equal ids come out alike. A document holds what one reader opens, so its rows meet in one value by design; the
rows themselves are written in partitions with `lines`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions.risk import NOT_REACHABLE
from veristrata.functions.text import confidence_name, report_level, report_message, severity_label, truncated

#: Schema and version of the report format.
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
NAME = "veristrata"
JUSTIFICATION = "Analyzer determined no call path from any entry point reaches the vulnerable symbol/package."
_STEP = "array<struct<file:string,line:int,column:int,symbol:string>>"
_DEFAULTS = {"url": "string", "aliases": "array<string>", "pillar": "string", "language": "string", "properties": "map<string,string>", "path": _STEP}


def _full(findings: DataFrame) -> DataFrame:
    return findings.withColumns({c: F.lit(None).cast(t) for c, t in _DEFAULTS.items() if c not in findings.columns})


def _some(text: Column) -> Column:
    """The text, or null (left out of JSON) if it is empty."""
    return F.when(text != "", text)


def _list(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def _json(struct: Column) -> Column:
    return F.to_json(struct, {"ignoreNullFields": "true"})


def sarif_results(findings: DataFrame) -> DataFrame:
    """advisory, module, result: a report result for each finding. What is not reachable is a suppressed note; no path, no code flow."""
    f = _full(findings)
    safe = F.col("confidence") == NOT_REACHABLE
    own = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    rank = F.expr("try_cast(properties['risk_score'] as double)")
    location = lambda s: F.struct(F.struct(F.struct(F.struct(s["file"].alias("uri")).alias("artifactLocation"), F.struct(s["line"].alias("startLine"), s["column"].alias("startColumn")).alias("region")).alias("physicalLocation"), F.struct(s["symbol"].alias("text")).alias("message")).alias("location"))
    flows = F.when(F.size("path") > 0, F.array(F.struct(F.array(F.struct(F.transform("path", location).alias("locations"))).alias("threadFlows"))))
    # The finding's own properties are a map of texts; fixed ones come after it and win.
    fixed = {"confidence": confidence_name(F.col("confidence")), "module": F.col("module"), "advisory_url": _some(F.col("url")), "pillar": _some(F.col("pillar")), "language": _some(F.col("language"))}
    entries = F.concat(F.filter(F.map_entries(own), lambda e: ~e["key"].isin(*fixed, "aliases")), F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(v, F.element_at(own, k)).alias("value")) for k, v in fixed.items()]), lambda e: e["value"].isNotNull()))
    properties = F.map_from_entries(F.array_sort(entries))
    result = F.struct(
        F.col("advisory").alias("ruleId"),
        F.when(safe, "note").otherwise(report_level(F.col("severity"))).alias("level"),
        F.struct(report_message(F.col("confidence"), F.col("advisory"), F.col("module")).alias("text")).alias("message"),
        rank.alias("rank"),
        properties.alias("properties"),
        _list(F.col("aliases")).alias("aliases"),
        flows.alias("codeFlows"),
        F.when(safe, F.array(F.struct(F.lit("external").alias("kind"), F.lit("accepted").alias("status"), F.lit(JUSTIFICATION).alias("justification")))).alias("suppressions"),
    )
    return f.select("advisory", "module", _json(result).alias("result"))


def _document(rows: DataFrame, column: str, head: str, tail: str, keys: list[str]) -> DataFrame:
    """One row, `document`: the texts of a column in order of keys and then themselves."""
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, column))), lambda s: s[column]), ",")
    return rows.agg(F.concat(F.lit(head), inner, F.lit(tail)).alias("document"))


def sarif(findings: DataFrame) -> DataFrame:
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":{{"name":"{NAME}"}}}},"results":['
    return _document(sarif_results(findings), "result", head, "]}]}", ["advisory", "module"])


def json_findings(findings: DataFrame) -> DataFrame:
    """advisory, module, finding: risk and provenance come from properties, and are left out where there are none."""
    f = _full(findings)
    get = lambda k: F.try_element_at("properties", F.lit(k))
    risk = F.when(get("risk_score").isNotNull() | (F.coalesce(get("risk_tier"), F.lit("")) != ""), F.struct(F.expr("try_cast(properties['risk_score'] as double)").alias("score"), *[_some(get(k)).alias(a) for a, k in (("tier", "risk_tier"), ("rationale", "risk_rationale"), ("cvss", "cvss"), ("epss", "epss"), ("kev", "kev"), ("cwe", "cwe"))]))
    provenance = F.when(F.coalesce(get("provenance"), F.lit("")) != "", F.struct(get("provenance").alias("summary"), _some(get("severity_conflict")).alias("severity_conflict"), _some(get("stale_source")).alias("stale_sources")))
    steps = F.when(F.size("path") > 0, F.struct(F.transform("path", lambda s: F.struct(F.struct(s["file"].alias("file"), s["line"].alias("line"), s["column"].alias("column")).alias("location"), s["symbol"].alias("symbol"))).alias("steps")))
    out = F.struct(
        F.struct(F.col("advisory").alias("id"), _some(F.col("url")).alias("url"), _list(F.col("aliases")).alias("aliases")).alias("advisory"),
        "module",
        confidence_name(F.col("confidence")).alias("confidence"),
        F.concat(F.lit("SEVERITY_"), severity_label(F.col("severity"))).alias("severity"),
        _some(F.col("pillar")).alias("pillar"),
        _some(F.col("language")).alias("language"),
        steps.alias("path"),
        risk.alias("risk"),
        provenance.alias("provenance"),
        F.when(F.size("properties") > 0, F.map_from_entries(F.array_sort(F.map_entries("properties")))).alias("properties"),
    )
    return f.select("advisory", "module", _json(out).alias("finding"))


def json_document(findings: DataFrame) -> DataFrame:
    return _document(json_findings(findings), "finding", "[", "]", ["advisory", "module"])


#: Widths of a table's cells.
CELLS = {"severity": 8, "advisory": 20, "module": 32, "confidence": 18}


def table_lines(findings: DataFrame) -> DataFrame:
    """severity, advisory, module, line: cells of fixed widths, cut with an ellipsis. Order: severity from the greatest, advisory, module."""
    short = F.replace(confidence_name(F.col("confidence")), F.lit("CONFIDENCE_"), F.lit(""))
    cells = {"severity": severity_label(F.col("severity")), "advisory": F.col("advisory"), "module": F.col("module"), "confidence": short}
    line = F.rtrim(F.concat_ws("  ", *[F.rpad(truncated(cells[k], n), n, " ") for k, n in CELLS.items()]))
    return findings.select("severity", "advisory", "module", line.alias("line")).orderBy(F.desc("severity"), "advisory", "module", "line")


FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"sarif": sarif, "json": json_document, "table": table_lines}


def register_format(name: str, render: Callable[[DataFrame], DataFrame]) -> None:
    if name in FORMATS:
        raise ValueError(f"{name} is a format")
    FORMATS[name] = render


def render(findings: DataFrame, format: str) -> DataFrame:
    if format not in FORMATS:
        raise ValueError(f"unknown format {format}; known: {sorted(FORMATS)}")
    return FORMATS[format](findings)


def lines(rows: DataFrame, column: str, path: str) -> None:
    """Rows' texts as files of a folder, in partitions."""
    rows.select(column).write.mode("error").text(path)


def delta_report(deltas: DataFrame) -> DataFrame:
    """line: a table in Markdown of a comparison (kind, id, package), in this order; without any compared finding it says so, and claims nothing."""
    rows = deltas.select(F.lit(1).alias("k"), "kind", "id", "package", F.concat(F.lit("| "), F.concat_ws(" | ", "kind", "id", "package"), F.lit(" |")).alias("line"))
    spark = deltas.sparkSession
    none = F.lit("").alias("kind"), F.lit("").alias("id"), F.lit("").alias("package")
    head = spark.range(1).select(F.lit(0).alias("k"), *none, F.explode(F.array(F.lit("| kind | id | package |"))).alias("line"))
    empty = deltas.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(2).alias("k"), *none, F.lit("nothing was compared").alias("line"))
    return head.union(rows).union(empty).orderBy("k", "kind", "id", "package").select("line")


def baseline(outcomes: DataFrame) -> DataFrame:
    """One row, `document`: cases (name, outcome) of a labelled corpus, by name, as JSON."""
    rows = outcomes.select("name", F.to_json(F.struct("name", "outcome")).alias("case"))
    return _document(rows, "case", '{"cases":[', "]}", ["name"])
