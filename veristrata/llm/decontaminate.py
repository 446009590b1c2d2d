"""Benchmark decontamination with spaced seeds; DataFrame functions only.

Texts become lower-case runs of letters and digits. A mask is laid over the
tokens at every position, of benchmark items and of documents alike, and hashes
those at its ones, so a substituted token at a zero does not matter. Equal hashes
give a document, an item and their offset. Each is verified in tokens: along the
offset, some stretch of REACH tokens (the whole item, if it is shorter) must
agree in SHARE of its positions. Items of fewer than TOLERANT tokens must agree
as a whole. Those too short for a mask of MASKS have one of ones of their own
length: they are found even if they are a single word.

Of all ways to substitute tokens of a stretch that the rule accepts, the masks
find 1.00 / 1.00 / 1.00 / 0.976 for 0 to 3 of 13 tokens, and 0.93 or more for the
2 or 3 of items of 10 to 12 tokens (tests enumerate them).

The join of hashes is by broadcast if the benchmark's are within BROADCAST_ROWS,
else by shuffle, with each benchmark hash sent to SALTS keys and each document to
one of them, so that a seed common to many documents is many tasks. Null and
empty texts match nothing, nor does an empty table. A repeated row is reported
once by `contaminated`; `remove` drops or keeps all its copies. A null doc_id is
reported as null. Texts of any length are read whole. Columns besides doc_id and
text, whatever their names, pass `remove` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.common import IDENTITY, identity, packed, text_of, unpacked
from veristrata.session import cut, table

MASKS = ("111011", "110100011")
#: Items of at least so many tokens may differ in some.
TOLERANT = 10
REACH = 13
SHARE = 0.75
BROADCAST_ROWS = 1_000_000
SALTS = 16
#: Runs of anything but letters and digits part the tokens.
GAP = r"[^\p{L}\p{N}]+"
LEAST_MASK = min(map(len, MASKS))


def tokens(text: Column) -> Column:
    """Without the empty pieces before a first and after a last gap."""
    return F.array_remove(F.split(F.lower(text), GAP), "")


def seeds(rows: DataFrame, masks: list[str], *keep: str) -> DataFrame:
    """keep, n (tokens), at, pos (the mask), h: hashes at every position of `words`, one for each mask that fits. Explodes and picks are generated code, higher-order functions are not."""
    picks = [", ".join(f"words[at + {k}]" for k, bit in enumerate(mask) if bit == "1") for mask in masks]
    hashes = F.array(*[F.expr(f"if(at + {len(mask)} <= size(words), xxhash64({i}, {p}), null)") for i, (mask, p) in enumerate(zip(masks, picks, strict=True))])
    least = min(map(len, masks))
    places = rows.filter(F.size("words") >= least).select(*keep, "words", F.explode(F.expr(f"sequence(0, size(words) - {least})")).alias("at"))
    return places.select(*keep, F.size("words").alias("n"), "at", F.posexplode(hashes).alias("pos", "h")).filter("h is not null")


def keyed(docs: DataFrame) -> DataFrame:
    """IDENTITY and text."""
    return docs.select(*[v.alias(k) for k, v in identity().items()], text_of().alias("text"))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """IDENTITY, item, offset of document positions to item positions: distinct."""
    short = sorted(r.n for r in items.select(F.size("words").alias("n")).filter(f"n < {LEAST_MASK}").distinct().collect())  # LEAST_MASK - 1 rows at most
    masks = [*MASKS, *("1" * n for n in short)]
    lengths = F.array(*[F.lit(len(m)) for m in masks])
    own = seeds(items, masks, "item").filter((F.col("pos") < len(MASKS)) | (lengths[F.col("pos")] == F.col("n")))
    own = cut(own.select("item", F.col("at").alias("item_at"), "h", "n"))
    # Hashes of the tokens first: the masks then read longs.
    rows = seeds(keyed(docs).withColumn("words", F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t))), masks, *IDENTITY).drop("n")
    rows = meet(rows, own).select(*IDENTITY, "item", "n", (F.col("at") - F.col("item_at")).alias("offset"))
    # Of an item that agrees as a whole at each offset, one is enough.
    rows = rows.groupBy(*IDENTITY, "item", F.when(F.col("n") >= LEAST_MASK, F.col("offset")).alias("at")).agg(F.min("offset").alias("offset"))
    return rows.drop("at")


def meet(rows: DataFrame, own: DataFrame) -> DataFrame:
    """The join on h of documents' seeds with the items', which are a written table."""
    if own.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(own), "h")
    spread = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*IDENTITY), F.lit(SALTS)).cast("int")).join(spread, ["h", "salt"]).drop("salt")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """IDENTITY, item_id, matches: verified overlaps, one row for a text and an item."""
    items = benchmark.select(F.col("item_id").alias("item"), tokens(text_of()).alias("item_words")).filter(F.size("item_words") > 0)
    items = cut(items.withColumn("words", F.transform("item_words", lambda t: F.xxhash64(t))))
    found = hits(docs, items).join(items.select("item", F.size("item_words").alias("n")), "item")
    per_text = cut(found.groupBy(*IDENTITY).agg(F.collect_list(F.struct("item", "offset", "n")).alias("found")))  # of one text
    rows = keyed(docs).join(per_text, IDENTITY).dropDuplicates(IDENTITY).withColumn("all", tokens(F.col("text")))
    cuts = "transform(found, f -> struct(f.item as item, greatest(-f.offset, 0) as skip, slice(all, greatest(f.offset, 0) + 1, f.n - greatest(-f.offset, 0)) as part))"
    rows = rows.select(*IDENTITY, F.explode(F.expr(cuts)).alias("f")).select(*IDENTITY, F.col("f.item").alias("item"), "f.skip", "f.part")
    rows = rows.join(items.select("item", "item_words"), "item")
    rows = rows.withColumn("same", F.expr("transform(sequence(0, size(part) - 1), i -> cast(part[i] = item_words[i + skip] as int))"))
    rows = rows.withColumn("reach", F.least(F.lit(REACH), F.size("item_words"))).filter(F.size("same") >= F.col("reach"))
    best = "array_max(transform(sequence(0, size(same) - reach), i -> aggregate(slice(same, i + 1, reach), 0, (a, x) -> a + x)))"
    share = F.when(F.size("item_words") < TOLERANT, 1.0).otherwise(SHARE)
    rows = rows.withColumn("best", F.expr(best)).filter(F.col("best") >= F.ceil(share * F.col("reach")))
    matches = F.expr("aggregate(same, 0, (a, x) -> a + x)").cast("long")
    return rows.select(*IDENTITY, "item", matches.alias("matches")).groupBy(*IDENTITY, "item").agg(F.max("matches").alias("matches"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matches (agreeing tokens along the best offset)."""
    found = overlaps(docs, benchmark)
    return found.select(F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), F.col("item").alias("item_id"), "matches")


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text overlaps with a benchmark item; columns and other rows as they are."""
    bad = overlaps(docs, benchmark).select(*IDENTITY).distinct()
    return unpacked(packed(docs, **identity()).join(bad, IDENTITY, "left_anti"), docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {"op9_decontaminate": op9}


def _picked(words: str, at: str, mask: str) -> str:
    return " || ' ' || ".join(f"{words}[{at} + {k + 1}]" for k, bit in enumerate(mask) if bit == "1")


def _words(rows: str) -> str:
    return rf"""SELECT *, list_filter(string_split_regex(lower(coalesce(text, '')), '{GAP}'), lambda x: x <> '') AS w FROM (SELECT DISTINCT * FROM {rows})"""


def _hashed(rows: str, key: str, at: str) -> str:
    """Hashes by each mask at each position, and of whole items of one token to LEAST_MASK - 1."""
    masks = [*MASKS, *("1" * n for n in range(1, LEAST_MASK))]
    return " UNION ALL ".join(f"SELECT {key}, {at}, {len(w_mask)} AS span, '{i}:' || {_picked('w', at, w_mask)} AS h FROM (SELECT *, unnest(range(0, len(w) - {len(w_mask)} + 1)) AS {at} FROM {rows} WHERE len(w) >= {len(w_mask)})" for i, w_mask in enumerate(masks))


ORACLE_SQL = {
    "op9_decontaminate": f"""
WITH d AS ({_words("(SELECT doc_id, text FROM documents)")}), b AS (SELECT * FROM ({_words("(SELECT item_id, text FROM benchmark)")}) WHERE len(w) > 0),
dh AS (SELECT * FROM ({_hashed("(SELECT doc_id, md5(coalesce(text, '')) AS th, w FROM d)", "doc_id, th", "p")}) WHERE span >= {LEAST_MASK} OR span IN (SELECT len(w) FROM b)),
bh AS (SELECT h.* FROM ({_hashed("b", "item_id", "q")}) h JOIN b USING (item_id) WHERE span >= {LEAST_MASK} OR span = len(b.w)),
hit AS (SELECT DISTINCT doc_id, th, item_id, p - q AS delta FROM dh JOIN bh USING (h)),
s AS (SELECT hit.doc_id, th, hit.item_id, least({REACH}, len(b.w)) AS reach, CASE WHEN len(b.w) < {TOLERANT} THEN 1 ELSE {SHARE} END AS share,
        list_transform(range(greatest(-delta, 0), least(len(b.w), len(d.w) - delta)), lambda j: CAST(b.w[j + 1] = d.w[j + delta + 1] AS INT)) AS same
      FROM hit JOIN d ON d.doc_id IS NOT DISTINCT FROM hit.doc_id AND md5(coalesce(d.text, '')) = th JOIN b ON b.item_id = hit.item_id)
SELECT doc_id, item_id, CAST(max(list_sum(same)) AS BIGINT) AS matches FROM s
WHERE len(same) >= reach AND list_max(list_transform(range(0, len(same) - reach + 1), lambda i: list_sum(same[i + 1:i + reach]))) >= ceil(share * reach)
GROUP BY doc_id, th, item_id
"""
}
