"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, scheme marks,
plus signs, digits, and cues such as IBAN or street words. Deterministic local
parsers expand each anchor to the boundaries of an email, address or account
and validate it. The base kinds are email, ip, card and phone; added kinds are
iban (ISO 13616 check digits), login (a URL that carries user and password) and
street (house number, name and street word).

Positions are code points, ends exclusive. Null and empty texts have no spans.
Repeated rows get a row each; tied starts of different kinds are all kept, in
the order of kinds. Texts of any length are read whole. Empty tables give no
rows. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.common import pieces, text_of
from veristrata.session import table

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "login", "street")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
RUN = re.compile(r"[0-9]+")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[ :]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
LOGIN = re.compile(r"://[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+[^\s]*")
STREET = re.compile(r"([0-9]{1,5}[a-z]? (?:[^\W\d_][\w'-]* ){1,4})$")

#: Cue words of the added kinds.
CUES = {"IBAN": "iban", "Iban": "iban", "iban": "iban", " Street": "street", " Avenue": "street", " Boulevard": "street", " Road": "street"}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in (("@", "email"), ("://", "login"), ("+", "phone"), *((d, "digit") for d in "0123456789"), *CUES.items()):
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def find(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each kind in order and without overlap."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
    ends = dict.fromkeys(BASE + ADDED, 0)  # no anchor before these is looked at again
    for last, (kind, length) in anchors.iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= ends["card"]:
                m = CHAIN.match(text, at)
                ends["card"] = m.end() if m else at + 1
                if m:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
            if at >= ends["ip"]:
                m = QUAD.match(text, at)
                if m:
                    ends["ip"] = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                        out["ip"].append(m.span())
                else:
                    ends["ip"] = RUN.match(text, at).end()
        elif kind == "email":
            start = at
            while start > ends["email"] and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out["email"].append((start, m.end()))
                ends["email"] = m.end()
        elif kind == "phone":
            m = PHONE.match(text, at) if at >= ends["phone"] else None
            if m:
                ends["phone"] = m.end()
                if 8 <= sum(c in DIGITS for c in m.group()) <= 15:
                    out["phone"].append(m.span())
        elif kind == "iban":
            m = IBAN.match(text, last + 1) if at >= ends["iban"] else None
            while m:
                account = m.group(1).replace(" ", "")
                if mod97(account):
                    out["iban"].append(m.span(1))
                    ends["iban"] = m.end()
                    break
                m = IBAN.match(text, last + 1, m.end() - 1)
        elif kind == "login":
            m = LOGIN.match(text, at) if at >= ends["login"] else None
            if m:
                start = at
                while start > ends["login"] and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                if start < at:
                    out["login"].append((start, m.end()))
                    ends["login"] = m.end()
        else:
            low = max(ends["street"], at - 80)
            m = STREET.search(text[low : at + 1])
            if m and at >= ends["street"]:
                out["street"].append((low + m.start(), last + 1))
                ends["street"] = last + 1
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and, in order of kind and start, the spans (kind, start, end) of each row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for text in part.column(1).to_pylist():
                    found = find(text, anchors)
                    rows.append([{"kind": k, "start": s, "end": e} for k in BASE + ADDED for s, e in found[k]])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) as n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op10_pii_scan": op10}
ORACLE_SQL: dict[str, str] = {}
