"""Findings as statements of exploitability: OpenVEX, CycloneDX and CSAF.

Statements: id, aliases, product (package URL), status, justification, action. Order: id, product, status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions.risk import vex_status
from veristrata.functions.text import purl
from veristrata.sinks.reports import FORMATS, NAME, _document, _json, _list, _some

#: Contexts, states and texts of the formats.
CONTEXT = "https://openvex.dev/ns/v0.2.0"
NOT_IN_PATH = "vulnerable_code_not_in_execute_path"
STATES = {"not_affected": "not_affected", "affected": "exploitable", "fixed": "resolved"}
GENERIC = "Investigate and apply available mitigations; no fixed version is recorded."
NO_PRODUCT = "unknown-product"


def action_text(status: Column, fixed: Column) -> Column:
    """What to do about an affected product; empty for the others."""
    named = F.coalesce(fixed, F.lit("")) != ""
    return F.when(status == "affected", F.when(named, F.concat(F.lit("Upgrade to "), fixed, F.lit(" or later."))).otherwise(GENERIC)).otherwise("")


def statements(findings: DataFrame) -> DataFrame:
    """id, aliases, product, status, justification, action, each once. findings: advisory, aliases, ecosystem, module, version, confidence, incomplete, fixed.

    Only a complete proof that nothing reaches the code is `not_affected`.
    """
    status = vex_status(F.col("confidence"), F.coalesce("incomplete", F.lit(True)))
    product = purl(F.col("ecosystem"), F.col("module"), F.col("version"))
    rows = findings.select(F.col("advisory").alias("id"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.when(product == "", NO_PRODUCT).otherwise(product).alias("product"), status.alias("status"), "fixed")
    return rows.select("id", "aliases", "product", "status", F.when(F.col("status") == "not_affected", NOT_IN_PATH).otherwise("").alias("justification"), action_text(F.col("status"), F.col("fixed")).alias("action")).distinct()


def openvex_statements(rows: DataFrame, timestamp: str) -> DataFrame:
    """id, product, status, statement."""
    out = F.struct(F.struct(F.col("id").alias("name"), _list(F.col("aliases")).alias("aliases")).alias("vulnerability"), F.array(F.struct(F.col("product").alias("@id"))).alias("products"), "status", _some(F.col("justification")).alias("justification"), _some(F.col("action")).alias("action_statement"), F.lit(timestamp).alias("timestamp"))
    return rows.select("id", "product", "status", _json(out).alias("statement"))


def openvex(rows: DataFrame, timestamp: str, author: str = NAME) -> DataFrame:
    """One row, `document`; its @id is a hash of its content, so the same statements give the same document."""
    body = f'"@context":"{CONTEXT}","author":"{author}","timestamp":"{timestamp}","version":1,"statements":['
    made = _document(openvex_statements(rows, timestamp), "statement", body, "]", ["id", "product", "status"])
    return made.select(F.concat(F.lit('{"@id":"https://openvex.dev/docs/'), F.lit(f"{NAME}-"), F.substring(F.sha2(F.col("document").cast("binary"), 256), 1, 16), F.lit('",'), "document", F.lit("}")).alias("document"))


def cyclonedx_vulnerabilities(rows: DataFrame) -> DataFrame:
    """id, product, status, vulnerability: one for each statement."""
    state = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair]), F.col("status")), F.lit("in_triage"))
    analysis = F.struct(state.alias("state"), F.when(F.col("status") == "not_affected", "code_not_reachable").alias("justification"), _some(F.col("action")).alias("detail"))
    return rows.select("id", "product", "status", _json(F.struct("id", analysis.alias("analysis"), F.array(F.struct(F.col("product").alias("ref"))).alias("affects"))).alias("vulnerability"))


def cyclonedx(rows: DataFrame, timestamp: str, author: str = NAME) -> DataFrame:
    head = f'{{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"metadata":{{"timestamp":"{timestamp}","tools":[{{"name":"{author}"}}]}},"vulnerabilities":['
    return _document(cyclonedx_vulnerabilities(rows), "vulnerability", head, "]}", ["id", "product", "status"])


def csaf_vulnerabilities(rows: DataFrame) -> DataFrame:
    """id, vulnerability: products by status, remediations of affected ones, and flags of those that are not in an execute path."""
    of = lambda *s: _list(F.array_sort(F.collect_set(F.when(F.col("status").isin(*s), F.col("product")))))
    known = F.col("status").isin("affected", "not_affected", "fixed")
    investigated = _list(F.array_sort(F.collect_set(F.when(~known, F.col("product")))))
    category = F.when((F.col("action") != "") & (F.col("action") != GENERIC), "vendor_fix").otherwise("none_available")
    remedy = F.array_sort(F.collect_set(F.when(F.col("status") == "affected", F.struct("product", category.alias("category"), F.col("action").alias("details")))))
    flagged = _list(F.array_sort(F.collect_set(F.when(F.col("justification") == NOT_IN_PATH, F.col("product")))))
    grouped = rows.groupBy("id").agg(of("affected").alias("known_affected"), of("not_affected").alias("known_not_affected"), of("fixed").alias("fixed"), investigated.alias("under_investigation"), remedy.alias("remedy"), flagged.alias("flagged"))
    cve = F.startswith("id", F.lit("CVE-")) & (F.length("id") > 4)
    out = F.struct(
        F.when(cve, F.col("id")).alias("cve"),
        F.when(~cve, F.array(F.struct(F.lit(f"{NAME} advisory id").alias("system_name"), F.col("id").alias("text")))).alias("ids"),
        F.struct("fixed", "known_affected", "known_not_affected", "under_investigation").alias("product_status"),
        _list(F.transform("remedy", lambda r: F.struct(r["category"].alias("category"), r["details"].alias("details"), F.array(r["product"]).alias("product_ids")))).alias("remediations"),
        F.when(F.size("flagged") > 0, F.array(F.struct(F.lit(NOT_IN_PATH).alias("label"), F.col("flagged").alias("product_ids")))).alias("flags"),
    )
    return grouped.select("id", _json(out).alias("vulnerability"))


def csaf(rows: DataFrame, timestamp: str, author: str = NAME) -> DataFrame:
    """One row, `document`: products, and vulnerabilities by id."""
    products = rows.select("product").distinct().select(F.lit("p").alias("kind"), F.col("product").alias("k"), F.to_json(F.struct(F.col("product").alias("product_id"), F.col("product").alias("name"))).alias("text"))
    both = products.union(csaf_vulnerabilities(rows).select(F.lit("v").alias("kind"), F.col("id").alias("k"), F.col("vulnerability").alias("text")))
    joined = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("k", "text")))), lambda s: s["text"]), ",")
    made = both.agg(joined("p").alias("products"), joined("v").alias("vulnerabilities"))
    head = f'{{"document":{{"category":"csaf_vex","csaf_version":"2.0","title":"{NAME} reachability VEX","publisher":{{"category":"vendor","name":"{author}"}},"tracking":{{"status":"final","version":"1","initial_release_date":"{timestamp}","current_release_date":"{timestamp}","id":"{NAME}-vex-'
    tail = f'","revision_history":[{{"number":"1","date":"{timestamp}","summary":"Initial reachability assessment."}}]}}}},"product_tree":{{"full_product_names":['
    return made.select(F.concat(F.lit(head), F.substring(F.sha2(F.concat("vulnerabilities", F.lit(timestamp)).cast("binary"), 256), 1, 16), F.lit(tail), "products", F.lit(']},"vulnerabilities":['), "vulnerabilities", F.lit("]}")).alias("document"))


STATEMENT_FORMATS = {"openvex": openvex, "cyclonedx": cyclonedx, "csaf": csaf}


def render_statements(rows: DataFrame, format: str, timestamp: str) -> DataFrame:
    if format not in STATEMENT_FORMATS:
        raise ValueError(f"unknown format {format}; known: {sorted(STATEMENT_FORMATS)}")
    return STATEMENT_FORMATS[format](rows, timestamp)


__all__ = ["FORMATS", "STATEMENT_FORMATS", "render_statements", "statements"]
