"""Queries over the driver's tables, one per operator, with DuckDB oracles.

The tables hold no advisories, so each query projects them, the same way in
both engines, and then applies the library's operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions import risk
from veristrata.operators import advisories as adv
from veristrata.operators import graph, parity
from veristrata.plans import files, more, reach, rules, scan
from veristrata.session import table

def _vectors(spark, sf):
    pick = lambda col, options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(col.cast("int"), F.lit(len(options))) + 1).cast("int"))
    q, s, p = F.col("l_quantity"), F.col("l_suppkey"), F.col("l_partkey")
    parts = [("AV", q, "NALP"), ("AC", s, "LH"), ("PR", p, "NLH"), ("UI", F.col("l_linenumber"), "NR"), ("S", s + p, "UC"), ("C", p, "HLN"), ("I", s, "HLN"), ("A", q, "HLN")]
    vector = F.concat(F.lit("CVSS:3.1"), *[F.concat(F.lit(f"/{k}:"), pick(c, o)) for k, c, o in parts])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", vector.alias("vector"))


def cvss_v3_score(spark, sf):
    rows = risk.cvss3_scores(_vectors(spark, sf))
    return rows.select("l_orderkey", "l_linenumber", "vector", F.round(F.col("score") * 10).cast("bigint").alias("score10"), risk.severity_band(F.col("score")).alias("band"))


def _pick_sql(col, options):
    return "[" + ",".join(f"'{o}'" for o in options) + f"][CAST({col} AS INT) % {len(options)} + 1]"


_CVSS_SQL = f"""WITH v AS (SELECT l_orderkey, l_linenumber, {_pick_sql('l_quantity', 'NALP')} AS av, {_pick_sql('l_suppkey', 'LH')} AS ac, {_pick_sql('l_partkey', 'NLH')} AS pr, {_pick_sql('l_linenumber', 'NR')} AS ui, {_pick_sql('l_suppkey + l_partkey', 'UC')} AS s, {_pick_sql('l_partkey', 'HLN')} AS c, {_pick_sql('l_suppkey', 'HLN')} AS i, {_pick_sql('l_quantity', 'HLN')} AS a FROM lineitem),
w AS (SELECT *, 'CVSS:3.1/AV:' || av || '/AC:' || ac || '/PR:' || pr || '/UI:' || ui || '/S:' || s || '/C:' || c || '/I:' || i || '/A:' || a AS vector,
  1 - (1 - CASE c WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END) * (1 - CASE i WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END) * (1 - CASE a WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END) AS iss,
  8.22::DOUBLE * (CASE av WHEN 'N' THEN 0.85 WHEN 'A' THEN 0.62 WHEN 'L' THEN 0.55 ELSE 0.2 END)::DOUBLE * (CASE ac WHEN 'L' THEN 0.77 ELSE 0.44 END)::DOUBLE * (CASE WHEN pr = 'N' THEN 0.85 WHEN pr = 'L' THEN CASE s WHEN 'C' THEN 0.68 ELSE 0.62 END ELSE CASE s WHEN 'C' THEN 0.5 ELSE 0.27 END END)::DOUBLE * (CASE ui WHEN 'N' THEN 0.85 ELSE 0.62 END)::DOUBLE AS ex FROM v),
x AS (SELECT *, CASE s WHEN 'C' THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS im FROM w),
y AS (SELECT *, CASE WHEN im <= 0 THEN 0 ELSE CAST(round(least(CASE s WHEN 'C' THEN 1.08::DOUBLE * (im + ex) ELSE im + ex END, 10) * 100000) AS BIGINT) END AS r FROM x),
z AS (SELECT *, CASE WHEN r % 10000 = 0 THEN r // 10000 ELSE r // 10000 + 1 END AS score10 FROM y)
SELECT l_orderkey, l_linenumber, vector, CAST(score10 AS BIGINT) AS score10, CASE WHEN score10 <= 0 THEN 0 WHEN score10 < 40 THEN 1 WHEN score10 < 70 THEN 2 WHEN score10 < 90 THEN 3 ELSE 4 END AS band FROM z"""


def _sources(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return rows.select(F.col("l_partkey").alias("grp"), F.concat(F.lit("ID-"), F.col("l_suppkey").cast("string")).alias("id"), F.array(F.concat(F.lit("CVE-"), (F.col("l_suppkey") % 3).cast("string"))).alias("aliases"), (F.col("l_suppkey") % 2 == 0).alias("symbol_level"), (F.col("l_suppkey") % 5).cast("string").alias("introduced"), (F.col("l_suppkey") % 3).cast("int").alias("trust"), (F.col("l_suppkey") % 5).cast("int").alias("severity"), F.concat(F.lit("src"), (F.col("l_suppkey") % 4).cast("string")).alias("source"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("2024-0"), (F.col("l_suppkey") % 9 + 1).cast("string"))).otherwise("").alias("withdrawn"), F.col("l_suppkey").alias("pos"))


def merge_resolve(spark, sf):
    rows = adv.resolve_groups(_sources(spark, sf), ["grp"])
    return rows.select("grp", "id", "severity", F.array_join("sources", ",").alias("sources"), F.array_join("aliases", ",").alias("aliases"), "withdrawn")


def dep_type_merge(spark, sf):
    kinds = F.when(F.col("l_returnflag") == "A", "dev").when(F.col("l_returnflag") == "R", "test").when(F.col("l_linestatus") == "O", "runtime").otherwise("docs")
    rows = table(spark, sf, "lineitem").select("l_partkey", kinds.alias("dep_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return adv.merge_dep_types(rows, ["l_partkey"])


def ignore_antijoin(spark, sf):
    """Some ignores have no expiry or an old one, some name a symbol, some are elevated; some findings are proven and critical."""
    line = table(spark, sf, "lineitem")
    found = line.select(F.concat(F.lit("ADV-"), (F.col("l_partkey") % 50).cast("string")).alias("id"), F.col("l_orderkey").cast("string").alias("module"), F.array(F.concat(F.lit("s"), (F.col("l_orderkey") % 3).cast("string"))).alias("symbols"), (F.col("l_orderkey") % 4).cast("int").alias("confidence"), (F.col("l_partkey") % 5).cast("int").alias("severity")).distinct()
    key = F.col("o_orderkey")
    expires = F.when(key % 5 == 0, "").when(key % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(24)))
    ignores = table(spark, sf, "orders").select(key.cast("string").alias("module"), F.when(key % 3 == 0, F.concat(F.lit("s"), (key % 6).cast("string"))).otherwise("").alias("symbol"), expires.alias("expires"), (key % 2 == 0).alias("elevated"), copies.alias("k")).select("module", "symbol", "expires", "elevated", F.concat(F.lit("ADV-"), (F.col("k") * 2).cast("string")).alias("id"))
    return adv.drop_ignored(found, ignores, "1996-01-01").groupBy("id").agg(F.count("*").alias("n"))


def kev_epss_enrich(spark, sf):
    part = table(spark, sf, "part")
    cves = F.array(*[F.concat(F.lit("cve-"), ((F.col("p_partkey") * k) % 300).cast("string")) for k in (1, 7, 13)])
    rows = part.select(F.concat(F.lit("ADV-"), F.col("p_partkey").cast("string")).alias("advisory"), cves.alias("cves"))
    epss = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("value")).select(F.concat(F.lit("CVE-"), F.col("user_id").cast("string")).alias("cve"), "value")
    return adv.first_by_alias(rows, epss, "value")


def confusion_matrix(spark, sf):
    labels = table(spark, sf, "labels").select(adv.classify(F.col("quality"), F.when(F.col("doc_id") % 7 != 0, F.col("toxic"))).alias("outcome"))
    return adv.confusion(labels)


def _edges(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("src"))
    n = part.agg(F.max("src").alias("n")).first()["n"] or 1  # one number
    return part.select("src", F.explode(F.array((F.col("src") * 7 + 3) % n + 1, (F.col("src") * 13 + 5) % n + 1)).alias("dst"))


def reachable_set(spark, sf):
    roots = table(spark, sf, "part").filter("p_partkey = 1").select(F.col("p_partkey").alias("node"))
    return graph.reachable(_edges(spark, sf), roots)


def alias_components(spark, sf):
    step = F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size") % 3 + 1)
    edges = table(spark, sf, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + step).alias("dst"))
    return graph.components(edges)


def vex_status(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 4).cast("int").alias("confidence"), (F.col("p_size") % 5 == 0).alias("incomplete"))
    return rows.select("p_partkey", risk.vex_status(F.col("confidence"), F.col("incomplete")).alias("status"))


def coverage_gain(spark, sf):
    """What our records cover and the baseline's do not, by brand: the sides are two different tables."""
    ours = table(spark, sf, "part").select("p_brand", F.col("p_size").cast("bigint").alias("size"))
    theirs = table(spark, sf, "customer").select(F.concat(F.lit("Brand#"), (F.col("c_custkey") % 60).cast("string")).alias("p_brand"), (F.col("c_custkey") % 50).alias("size"))
    return parity.gained(ours, theirs, ["p_brand"], "size").select("p_brand", F.array_join(F.transform("gained", lambda x: F.lpad(x.cast("string"), 3, "0")), ",").alias("sizes"))


def line_state_scan(spark, sf):
    """The section (last line with a marker) that each line of a text is in, within the text."""
    rows = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    count = F.expr("aggregate(lines, named_struct('at', 0, 'n', 0, 'most', 0), (a, l) -> named_struct('at', if(l like '%|%', a.at + 1, a.at), 'n', if(l like '%|%', 0, a.n + 1), 'most', greatest(a.most, if(l like '%|%', 0, a.n + 1))))")
    return rows.select("doc_id", count["at"].alias("sections"), count["most"].alias("longest"))


def json_explode(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("k").alias("n"))


def url_normalise(spark, sf):
    bare = F.regexp_replace(F.regexp_replace(F.lower("url"), "^[a-z]+://", ""), r"(\.git)?/*$", "")
    return table(spark, sf, "pages").select("page_id", bare.alias("module"), F.substring_index(bare, "/", -1).alias("last"))


def freshness_sla(spark, sf):
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.max("ts").alias("fetched"))
    age = F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp("fetched")
    return rows.select("event_type", age.alias("age"), (age > 172800).alias("stale"))


_QUERIES = {f.__name__: f for f in (cvss_v3_score, merge_resolve, dep_type_merge, ignore_antijoin, kev_epss_enrich, confusion_matrix, reachable_set, alias_components, vex_status, coverage_gain, line_state_scan, json_explode, url_normalise, freshness_sla)}

_ORACLES = {
    "cvss_v3_score": _CVSS_SQL,
    "merge_resolve": """WITH s AS (SELECT DISTINCT l_partkey AS grp, l_suppkey AS k FROM lineitem),
      g AS (SELECT grp, arg_min('ID-' || k, {'a': k % 2 <> 0, 'b': CAST(k % 5 AS VARCHAR), 'c': -(k % 3), 'd': 'ID-' || k, 'e': k}) AS id, CAST(max(k % 5) AS INT) AS severity, string_agg(DISTINCT 'src' || (k % 4), ',' ORDER BY 'src' || (k % 4)) AS sources,
            list_distinct(list('ID-' || k) || list('CVE-' || (k % 3))) AS names, CASE WHEN bool_and(k % 2 = 0) THEN min('2024-0' || (k % 9 + 1)) ELSE '' END AS withdrawn FROM s GROUP BY grp)
      SELECT grp, id, severity, sources, array_to_string(list_sort(list_filter(names, lambda x: x <> id)), ',') AS aliases, withdrawn FROM g""",
    "dep_type_merge": """WITH d AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_returnflag = 'A' THEN 'dev' WHEN l_returnflag = 'R' THEN 'test' WHEN l_linestatus = 'O' THEN 'runtime' ELSE 'docs' END AS t FROM lineitem)
      SELECT l_partkey, CASE WHEN bool_or(t = 'runtime') THEN 'runtime' ELSE arg_min(t, pos) END AS dep_type FROM d GROUP BY l_partkey""",
    "ignore_antijoin": """WITH f AS (SELECT DISTINCT l_partkey % 50 AS a, l_orderkey AS k, l_partkey % 5 AS sev FROM lineitem),
      i AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01')
      SELECT 'ADV-' || a AS id, count(*) AS n FROM f WHERE NOT (k IN (SELECT k FROM i) AND a % 2 = 0 AND (k % 3 <> 0 OR k % 6 = k % 3) AND (NOT (k % 4 = 3 AND sev = 4) OR k % 2 = 0)) GROUP BY a""",
    "kev_epss_enrich": """WITH a AS (SELECT 'ADV-' || p_partkey AS advisory, unnest([1, 2, 3]) AS pos, unnest(['CVE-' || (p_partkey % 300), 'CVE-' || (p_partkey * 7 % 300), 'CVE-' || (p_partkey * 13 % 300)]) AS cve FROM part), e AS (SELECT 'CVE-' || user_id AS cve, max(event_id) AS value FROM events GROUP BY user_id)
      SELECT advisory, arg_min(value, pos) AS value FROM a JOIN e USING (cve) GROUP BY advisory""",
    "confusion_matrix": """WITH o AS (SELECT quality AS e, CASE WHEN doc_id % 7 <> 0 THEN toxic END AS g FROM labels),
      c AS (SELECT count(*) FILTER (e = 1 AND g = 1) AS tp, count(*) FILTER (e = 0 AND g = 1) AS fp, count(*) FILTER (e = 1 AND g = 0) AS fn, count(*) FILTER (e = 0 AND g = 0) AS tn, count(*) FILTER (g IS NULL AND e = 0) AS unknown, count(*) FILTER (g IS NULL AND e = 1) AS unknown_violation FROM o)
      SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN tn + fp = 0 THEN 1.0::DOUBLE ELSE tn::DOUBLE / (tn + fp) END AS suppression FROM c""",
    "reachable_set": """WITH RECURSIVE n AS (SELECT max(p_partkey) AS n FROM part), e AS (SELECT p_partkey AS src, unnest([(p_partkey * 7 + 3) % n + 1, (p_partkey * 13 + 5) % n + 1]) AS dst FROM part, n),
      r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 40) SELECT node, min(depth) AS depth FROM r GROUP BY node""",
    "vex_status": "SELECT p_partkey, CASE WHEN p_size % 4 = 1 AND p_size % 5 <> 0 THEN 'not_affected' WHEN p_size % 4 IN (2, 3) THEN 'affected' ELSE 'under_investigation' END AS status FROM part",
    "coverage_gain": """SELECT p_brand, string_agg(DISTINCT lpad(CAST(p_size AS VARCHAR), 3, '0'), ',' ORDER BY lpad(CAST(p_size AS VARCHAR), 3, '0')) AS sizes FROM part p
      WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE 'Brand#' || (c_custkey % 60) = p.p_brand AND c_custkey % 50 = p.p_size) GROUP BY p_brand""",
    "line_state_scan": r"""WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
      m AS (SELECT *, sum(CAST(line LIKE '%|%' AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l),
      g AS (SELECT doc_id, section, count(*) FILTER (line NOT LIKE '%|%') AS n FROM m GROUP BY doc_id, section) SELECT doc_id, CAST(max(section) AS INT) AS sections, CAST(max(n) AS INT) AS longest FROM g GROUP BY doc_id""",
    "json_explode": "SELECT event_type, CAST(sum(k) AS BIGINT) AS total, count(k) AS n FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) GROUP BY event_type",
    "url_normalise": r"SELECT page_id, m AS module, split_part(m, '/', -1) AS last FROM (SELECT page_id, regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '(\.git)?/*$', '') AS m FROM pages)",
    "freshness_sla": "SELECT event_type, age, age > 172800 AS stale FROM (SELECT event_type, CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ts))) AS BIGINT) AS age FROM events GROUP BY event_type)",
    "alias_components": """WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey + CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size % 3 + 1 END AS dst FROM part), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
      r AS (SELECT src AS node, src AS seen FROM u UNION SELECT r.node, u.dst FROM r JOIN u ON r.seen = u.src) SELECT node, min(seen) AS component FROM r GROUP BY node""",
}


_PARTS = (scan, more, reach, rules, files)
flagship = scan.QUERIES["flagship_gate"]


def queries():
    out = dict(_QUERIES)
    for part in _PARTS:
        out.update(part.QUERIES)
    return out


def oracle_sql():
    out = dict(_ORACLES)
    for part in _PARTS:
        out.update(part.ORACLES)
    return out
