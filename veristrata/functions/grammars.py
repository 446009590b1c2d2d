"""Range grammars of advisory feeds as arrays of ranges; null where a text cannot be put exactly (undecidable)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

RANGE = "struct<introduced:string,fixed:string,last_affected:string>"
RANGES = ArrayType(StructType().add("introduced", StringType()).add("fixed", StringType()).add("last_affected", StringType()))


def comma_range(text: Column) -> Column:
    """array of one range from `>= a, < b` and the like (>=, <=, <, =); null for an open lower bound or anything else."""
    parts = F.transform(F.split(F.trim(text), ","), lambda p: F.trim(p))
    op = lambda p: F.regexp_extract(p, r"^(>=|<=|<|=)\s*\S", 1)
    value = lambda p: F.trim(F.regexp_replace(p, "^(>=|<=|<|=)", ""))
    last = lambda *ops: F.coalesce(F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(parts, lambda p: op(p).isin(*ops)), value)), -1), F.lit(""))
    one = F.struct(last(">=", "=").alias("introduced"), last("<").alias("fixed"), last("<=", "=").alias("last_affected"))
    return F.when(F.forall(parts, lambda p: op(p) != ""), F.array(one))


#: Comparison marks, longest first, and the bounds that the version after them sets.
_MARKS = {">=": ("introduced",), "<=": ("last_affected",), "==": ("introduced", "last_affected"), ">": ("introduced",), "<": ("fixed",), "=": ("introduced", "last_affected")}
_CONSTRAINT = re.compile(r"(>=|<=|==|>|<|=|\^|~)?(.*)", re.S)
_CORE = re.compile(r"v?([^-+]*)")
_INTERVAL = re.compile(r"[\[(]([^\])]*)([\])])")


def _next(mark: str, version: str) -> str | None:
    """The first version beyond those that a caret or a tilde allows."""
    parts = _CORE.match(version)[1].split(".")[:3]
    if not all(re.fullmatch(r"\s*[+-]?[0-9]+\s*", p) for p in parts):
        return None
    n, (major, minor, patch) = len(parts), [*map(int, parts), 0, 0][:3]
    if mark == "~":
        return f"{major}.{minor + 1}.0" if n > 1 else f"{major + 1}.0.0"
    if major > 0 or n == 1:
        return f"{major + 1}.0.0"
    if minor > 0 or n == 2:
        return f"0.{minor + 1}.0"
    return f"0.0.{patch + 1}"


def _clause(text: str) -> dict | None:
    """All constraints of a clause hold; a later one of a kind replaces an earlier one."""
    out = dict.fromkeys(("introduced", "fixed", "last_affected"), "")
    tokens = [t for t in re.split(r"[ \t,]", text) if t]
    for token in tokens:
        mark, version = _CONSTRAINT.match(token).groups()
        version = version.strip()
        if token in ("*", "x", "X"):
            continue
        if mark in ("^", "~"):
            beyond = _next(mark, version)
            if beyond is None:
                return None
            out.update(introduced=version, fixed=beyond)
        elif mark is None:
            if not re.match(r"v?[0-9]", version):
                return None
            out.update(introduced=version, last_affected=version)
        elif not version:
            return None
        else:
            out.update(dict.fromkeys(_MARKS[mark], version))
    return out if tokens else None


def _intervals(text: str) -> list | None:
    out, at = [], 0
    while True:
        at += len(re.match(r"[, \t]*", text[at:])[0])
        if at == len(text):
            return out or None
        m = _INTERVAL.match(text, at)
        if not m:
            return None
        low, comma, high = (x.strip() for x in m[1].partition(","))
        if not comma and not low:
            return None
        upper = {"fixed": high} if comma and m[2] == ")" else {"last_affected": high if comma else low}
        out.append({"introduced": low, "fixed": "", "last_affected": "", **upper})
        at = m.end()


def constraint_ranges(text: str | None, fixed: list[str] | None = None) -> list | None:
    """Alternatives by ||, constraints by space or comma, ^, ~, ==, *, or intervals in brackets. A lower bound is taken as inclusive.
    A single range without an upper bound ends at the fixed version, if just one is named."""
    text = (text or "").strip()
    if not text:
        return None
    if re.search(r"[\[(]", text):
        return _intervals(text)
    out = []
    for clause in filter(None, (c.strip() for c in text.split("||"))):
        one = _clause(clause)
        if one is None:
            return None
        out.append(one)
    named = [f.strip() for f in fixed if f and f.strip()] if fixed is not None else []
    if len(out) == 1 and len(named) == 1 and not out[0]["fixed"] and not out[0]["last_affected"]:
        out[0]["fixed"] = named[0]
    return out or None


@F.pandas_udf(RANGES)
def constraint_range(text: pd.Series, fixed: pd.Series) -> pd.Series:
    """constraint_ranges() by Arrow batch; use it on distinct texts."""
    return pd.Series([constraint_ranges(t, list(f) if f is not None else None) for t, f in zip(text, fixed, strict=True)], dtype=object)
