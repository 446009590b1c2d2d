"""Policies: what fails a scan, and what is ignored."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions.decisions import gate_eligible, gate_predicate
from veristrata.operators.advisories import drop_ignored

TIERS = ("reachable", "reachable+unknown", "all")
SEVERITY_CODES = {"low": 1, "medium": 2, "high": 3, "critical": 4}
IGNORES = "id string, module string, symbol string, reason string, expires string, elevated boolean"


@dataclass
class Policy:
    fail_on: str = "high"
    gate_on: str = ""
    reachable_only: bool = False
    ignores: list[dict] = field(default_factory=list)
    tier: str = "reachable+unknown"
    on_kev: bool = False
    least_epss: float | None = None
    least_risk: float | None = None

    def __post_init__(self):
        if self.fail_on and self.fail_on.lower() not in SEVERITY_CODES:
            raise ValueError(f"fail-on {self.fail_on!r}: one of {sorted(SEVERITY_CODES)}, or empty")
        tiers = []
        for token in filter(None, (t.strip().lower() for t in self.gate_on.split(","))):
            bound = re.fullmatch(r"(epss|risk)>=\s*(.+)", token)
            if token in TIERS:
                tiers.append(token)
            elif token == "kev":
                self.on_kev = True
            elif bound:
                setattr(self, f"least_{bound[1]}", float(bound[2]))
            else:
                raise ValueError(f"gate-on {token!r}: reachable, reachable+unknown, all, kev, epss>=X or risk>=Y")
        if len(tiers) > 1:
            raise ValueError(f"gate-on {self.gate_on!r} names more than one tier")
        self.tier = (tiers or ["reachable+unknown"])[0]
        for i, ignore in enumerate(self.ignores):
            if not ignore.get("id") or not ignore.get("module") or not ignore.get("reason"):
                raise ValueError(f"ignore {i}: id, module and reason are needed")
            if ignore.get("expires"):
                datetime.date.fromisoformat(ignore["expires"])

    @classmethod
    def from_text(cls, text: str) -> Policy:
        """From YAML (JSON, where no reader of YAML is installed): fail-on, gate-on, reachable-only and ignores. Unknown keys are errors."""
        try:
            import yaml
        except ImportError:
            import json

            raw = json.loads(text or "{}")
        else:
            raw = yaml.safe_load(text) or {}
        known = {"fail-on": "fail_on", "gate-on": "gate_on", "reachable-only": "reachable_only", "ignores": "ignores"}
        odd = set(raw) - set(known)
        if odd:
            raise ValueError(f"unknown keys: {sorted(odd)}")
        names = {"advisory-id": "id", "module": "module", "symbol": "symbol", "reason": "reason", "expires-at": "expires", "elevated-ignore": "elevated"}
        ignores = [{names[k]: v.isoformat() if isinstance(v, datetime.date) else v for k, v in g.items() if k in names} for g in raw.get("ignores") or []]
        return cls(**{known[k]: v for k, v in raw.items() if k != "ignores" and v is not None}, ignores=ignores)

    def ignore_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(g["id"], g["module"], g.get("symbol", ""), g["reason"], g.get("expires", ""), bool(g.get("elevated"))) for g in self.ignores]
        return spark.createDataFrame(rows, IGNORES)

    def gates(self) -> Column:
        """Whether a finding (confidence, severity, dev_only, dep_type, kev, epss, risk) fails the scan: eligible, and at the severity or by a signal."""
        eligible = gate_eligible(F.col("confidence"), F.col("dev_only"), F.col("dep_type"), self.tier)
        severe = F.coalesce(F.col("severity") >= SEVERITY_CODES[self.fail_on.lower()], F.lit(False)) if self.fail_on else F.lit(False)
        return eligible & (severe | gate_predicate(F.col("kev"), F.col("epss"), F.col("risk"), self.on_kev, self.least_epss, self.least_risk))

    def evaluate(self, findings: DataFrame, now: str, by: list[str]) -> DataFrame:
        """by, gate_failed, incomplete, exit_code: findings that no ignore covers, by project. findings: by, id, module, and what gates() reads, incomplete."""
        from veristrata.functions.risk import exit_code

        left = drop_ignored(findings, self.ignore_rows(findings.sparkSession), now).withColumn("gates", self.gates())
        gates = left.groupBy(*by).agg(F.bool_or("gates").alias("gate_failed"))
        parts = findings.groupBy(*by).agg(F.bool_or(F.coalesce("incomplete", F.lit(True))).alias("incomplete"))
        rows = parts.join(gates, by, "left").withColumn("gate_failed", F.coalesce("gate_failed", F.lit(False)))
        return rows.withColumn("exit_code", exit_code(F.col("gate_failed"), F.col("incomplete")))
