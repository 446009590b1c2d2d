"""Secret scans with multipart credential linking; DataFrame functions only.

Base spans are assignments, access identifiers and hexadecimal runs. Weak
parts, which mean little alone, are 40-character secrets, endpoints (URLs, whose
scheme has 24 characters at most, or host names with a port), and client identifiers. Parts of one scope (a document
and a distance of SCOPE code points) are joined by interval: each part is keyed
by all bins of SCOPE code points that it covers, a weak one by the two beside
them as well, so that parts meet in an equi-join, once in the first bin that
they share, and bins hold a bounded number of parts because spans of one kind do
not overlap. A weak part is reported only where a complementary part lies
within SCOPE: a secret or client identifier beside an identifier or endpoint
that completes it, an endpoint beside a secret. Base spans are always reported.

Positions are code points, ends exclusive. Null and empty texts have no spans;
`redact` leaves them as they are. Texts of any length are read whole: patterns
look at a character a bounded number of times. Repeated rows get a row each, and
are linked once; equal spans of different kinds are all kept, by start, kind and
end. A null doc_id is told from others by its text. Empty tables give no rows.
`redact` keeps all other columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.common import IDENTITY, identity, packed, text_of, unpacked
from veristrata.session import cut, table

SCOPE = 400
#: Kinds in their order; patterns, least length, and the group that it holds for.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = {
    "assign": (ASSIGN, 6, 2),
    "access": (r"AKIA[A-Z0-9]{16,}", 20, 0),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 24, 0),
}
WEAK = {
    "secret40": (r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 40, 0),
    "endpoint": (r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,23}+://[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![A-Za-z0-9.@-])[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)++:[0-9]{2,5}(?![0-9])", 8, 0),
    "client": (r"(?i:client|account|user)_?(?i:id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.-]+)", 4, 1),
}
KINDS = {**BASE, **WEAK}
#: What completes a weak part.
COMPLEMENT = {"secret40": ("access", "client", "endpoint"), "endpoint": ("assign", "secret40"), "client": ("assign", "secret40")}


_SPANS = "array<struct<start:int,end:int>>"
#: Matches whose positions are summed in one go.
RUN = 64


def spans_of(text: Column, pattern: str, least: int, group: int) -> Column:
    """array<struct<start, end>> of the leftmost non-overlapping matches whose group has the least length.

    The pieces between matches and the matches alternate, so running sums of
    their lengths are the positions. They are summed in runs of RUN, whose spans
    are put together in the end, so that no growing array is copied for each match.
    """
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    sizes = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.char_length(x))
    kept = sizes if group == 0 else F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda x: F.char_length(x))
    parts = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), kept.alias("kept"))
    none = F.expr(f"cast(array() as {_SPANS})")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["size"]
        new = F.when(x["kept"] >= least, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(none)
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["size"].isNull(), state["found"]).otherwise(F.concat(state["found"], new)).alias("found"))

    def run(state: Column, some: Column) -> Column:
        inside = F.aggregate(some, F.struct(state["at"].alias("at"), none.alias("found")), step)
        return F.struct(inside["at"].alias("at"), F.concat(state["found"], F.array(inside["found"])).alias("found"))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int")), lambda i: F.slice(parts, i * RUN + 1, F.lit(RUN)))
    found = F.flatten(F.aggregate(runs, F.expr(f"cast(struct(0 as at, array() as found) as struct<at:int,found:array<{_SPANS}>>)"), run)["found"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def base_and_weak(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, and an array of spans for each kind; the texts stay behind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    spans = [spans_of(F.col("text"), *KINDS[k]).alias(k) for k in KINDS]
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), *spans)


def link(found: DataFrame) -> DataFrame:
    """doc (the id, or -1), no_id, of_text (the hash), linked: the weak parts with a complementary part within SCOPE."""
    some_weak = sum((F.size(k) for k in WEAK), F.lit(0)) > 0
    some_other = sum((F.least(F.size(k), F.lit(1)) for k in KINDS), F.lit(0)) > 1
    parts = F.concat(*[F.expr(f"transform({k}, s -> struct('{k}' as kind, s.start as start, s.end as end))") for k in KINDS])
    rows = found.filter(some_weak & some_other).select(F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.col("doc_id").isNull().alias("no_id"), "text_hash", F.explode(F.array_distinct(parts)).alias("p")).distinct()
    key = ["doc", "no_id", "text_hash"]
    first, last = F.expr(f"cast(p.start / {SCOPE} as int)"), F.expr(f"cast(p.end / {SCOPE} as int)")
    weak = rows.filter(F.col("p.kind").isin(*WEAK)).select(*key, F.col("p").alias("weak"), (first - 1).alias("weak_first"), F.explode(F.sequence(first - 1, last + 1)).alias("bin"))
    other = rows.select(*key, F.col("p").alias("other"), first.alias("other_first"), F.explode(F.sequence(first, last)).alias("bin"))
    completes = F.lit(False)
    for kind, kinds in COMPLEMENT.items():
        completes = completes | ((F.col("weak.kind") == kind) & F.col("other.kind").isin(*kinds))
    near = (F.col("other.start") - F.col("weak.end") <= SCOPE) & (F.col("weak.start") - F.col("other.end") <= SCOPE)
    once = F.col("bin") == F.greatest("weak_first", "other_first")
    joined = weak.join(other, [*key, "bin"]).filter(once & completes & near)
    linked = joined.groupBy(*key).agg(F.collect_set("weak").alias("linked"))  # of one text
    return linked.withColumnRenamed("text_hash", "of_text")


def all_spans(found: DataFrame) -> DataFrame:
    """found with `spans`: base and linked spans (start, rank of kind, end, kind), sorted."""
    linked = link(found)
    same = (F.coalesce("doc_id", F.lit(-1)) == F.col("doc")) & (F.col("doc_id").isNull() == F.col("no_id")) & (F.col("text_hash") == F.col("of_text"))
    joined = found.join(linked, same, "left").drop("doc", "no_id", "of_text")
    rank = "CASE s.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    base = F.concat(*[F.expr(f"transform({k}, s -> struct(s.start as start, {i} as rank, s.end as end, '{k}' as kind))") for i, k in enumerate(BASE)])
    added = F.coalesce(F.expr(f"transform(linked, s -> struct(s.start as start, {rank} as rank, s.end as end, s.kind as kind))"), F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)"))
    return joined.withColumn("base", F.array_sort(base)).withColumn("spans", F.array_sort(F.concat("base", added)))


def scan(docs: DataFrame) -> DataFrame:
    """Spans of each row of docs: doc_id, text_hash, base, spans and an array for each kind."""
    return all_spans(cut(base_and_weak(docs)))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of `scan` replaced by [SECRET], and n_chars set anew; all rows stay.

    Base spans and linked parts may overlap; the text is cut at their union.
    """
    found = scan(docs).filter(F.size("spans") > 0)
    found = found.select(F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.col("doc_id").isNull().alias("no_id"), "text_hash", "spans").dropDuplicates(IDENTITY)
    rows = packed(docs, **identity()).join(found, IDENTITY, "left")
    pieces = F.expr("""aggregate(spans, cast(named_struct('at', 0, 'out', array()) as struct<at:int,out:array<string>>), (a, s) -> struct(
        greatest(a.at, s.end) as at,
        if(s.start >= a.at, concat(a.out, array(substr(row.text, a.at + 1, s.start - a.at))), a.out) as out))""")
    rest = F.expr("substr(row.text, aggregate(spans, 0, (a, s) -> greatest(a, s.end)) + 1)")
    rows = rows.withColumn("clean", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(F.concat(pieces["out"], F.array(rest)), "[SECRET]")))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.char_length("clean")).cast(docs.schema["n_chars"].dataType)
    return unpacked(rows, docs.columns, **changed)


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


QUERIES = {"op2_secret_scan": op2}


def _duck_spans(kind: str, pattern: str, least: int, group: int, rank: int) -> str:
    """Positions in DuckDB: pieces and matches alternate, as above."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i-1], lambda g: length(g))), 0) AS BIGINT) AS s, length(found[i]) AS n
      FROM (SELECT doc_id, gaps, found, kept, unnest(range(1, len(found) + 1)) AS i FROM (
        SELECT doc_id, string_split_regex(coalesce(text, ''), '{quoted}') AS gaps, regexp_extract_all(coalesce(text, ''), '{quoted}', 0) AS found, regexp_extract_all(coalesce(text, ''), '{quoted}', {group}) AS kept FROM documents)) WHERE length(kept[i]) >= {least}"""


#: The base columns only, for tests: RE2 cannot look behind, as the weak parts need.
BASE_SQL = (
    "WITH spans AS ("
    + " UNION ALL ".join(_duck_spans(k, p, n, g, i) for i, (k, (p, n, g)) in enumerate({"assign": BASE["assign"], "access": BASE["access"], "hex": ("[0-9a-f]+", 24, 0)}.items()))
    + """), per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS joined FROM spans GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(joined, '')) AS base_sha256
    FROM documents d LEFT JOIN per USING (doc_id)"""
)
ORACLE_SQL: dict[str, str] = {}
