"""Mixing sources to target weights by temperature; DataFrame functions only.

Shares of the sources' tokens are raised to an exponent and normalised. The
exponent, between 0 (all sources alike) and 1 (as they are), is bisected: the
largest one whose entropy reaches `entropy` of the greatest possible, or the
smallest one at which no source repeats more than `max_repeats` times; if no
exponent meets the target, the bound nearest to it is taken. A weight times the
budget is the tokens that a source gives: whole epochs, and one that is cut.
Each epoch takes the blocks of a source in an order of its own (by hash), and
the documents of a block likewise; the cut epoch takes whole blocks as the
budget allows, and of the next block the documents that still fit.

A block has about BLOCK_TOKENS tokens, so their number grows with the source; the
cut is found by sums over prefixes of the blocks' keys, then among the blocks of
one prefix, then among the documents of one block: no source is sorted as a
whole. Sources are rows of a table at every step (of the bisection, DEPTH steps
are one aggregate over it), so there may be any number of them.

A null source is the source ''. A null doc_id is placed by its text. Sources
without words have weight 0 and give nothing; null and empty texts have no
words and are given with their block. Repeated rows are separate documents, of
one block, and ties among them do not change what is taken. Empty tables give
no rows. Texts of any length count whole. Columns of documents that clash with
those that `mixture` adds keep their names; the added ones get a `_` at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veristrata.llm.common import packed, text_of
from veristrata.session import cut, table

BLOCK_TOKENS = 50_000
ENTROPY = 0.95
ROUNDS = 40
#: Steps of the bisection that one aggregate answers, with all of their 2^DEPTH - 1 midpoints.
DEPTH = 6
#: Hexadecimal digits of a block's key by which blocks are summed first: 4,096 rows a source at most.
PREFIX = 3
SEED = "mix"
_TRIM = r"trim(BOTH ' \t\n\u000B\u000C\r' FROM text)"
#: What the plan needs of each document.
OWN = ["doc_id", "source", "n_tokens", "text_md5"]


def n_words(text: str = "text") -> Column:
    """Words of a text, split at \\x20 and \\x09-\\x0D."""
    trimmed = _TRIM.replace("text", text)
    return F.expr(f"if({trimmed} = '', 0, size(split({trimmed}, '[\\\\x20\\\\x09-\\\\x0D]+')))").cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """OWN."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text_of().alias("text"))
    return rows.select("doc_id", "source", n_words().alias("n_tokens"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def midpoints(lo: float, hi: float, depth: int) -> list[float]:
    """All that so many steps of a bisection may ask for, as a binary heap."""
    out = [(lo, hi)]
    for i in range(2 ** (depth - 1) - 1):
        a, b = out[i]
        out += [(a, (a + b) / 2), ((a + b) / 2, b)]
    return [(a + b) / 2 for a, b in out]


def exponent(totals: DataFrame, budget: int | None, entropy: float | None, max_repeats: float | None) -> tuple[float, int]:
    """By bisection over sums of the sources (source, tokens), and the tokens of all. A written table is best."""
    own = totals.agg(F.sum("tokens").alias("total"), F.count("*").alias("n"), F.min("tokens").alias("least")).first()
    if not own["n"]:
        return 0.0, 0
    share = F.log(F.col("tokens").cast("double") / own["total"])
    lo, hi, least = 0.0, 1.0, math.log(own["least"] / own["total"])

    def larger(mid: float, z: float, y: float) -> bool:
        """Whether the exponent may be larger (entropy) or must be (repeats of the smallest source, which repeats most)."""
        if max_repeats is not None:
            return math.exp((mid - 1) * least) / z * (own["total"] if budget is None else budget) / own["total"] > max_repeats
        return math.log(z) - mid * y / z >= entropy * math.log(own["n"])

    done = 0
    while done < ROUNDS:
        depth = min(DEPTH, ROUNDS - done)
        mids = midpoints(lo, hi, depth)
        rows = totals.select(share.alias("l"), F.posexplode(F.array(*map(F.lit, mids))).alias("i", "a"))
        sums = {r["i"]: (r["z"], r["y"]) for r in rows.groupBy("i").agg(F.sum(F.exp(F.col("a") * F.col("l"))).alias("z"), F.sum(F.col("l") * F.exp(F.col("a") * F.col("l"))).alias("y")).collect()}  # 2^DEPTH - 1 rows
        i = 0
        for _ in range(depth):
            up = larger(mids[i], *sums[i])
            lo, hi = (mids[i], hi) if up else (lo, mids[i])
            i = 2 * i + 1 + up
        done += depth
    return round(hi if max_repeats is not None else lo, 6), own["total"]


def weights(documents: DataFrame, budget: int | None = None, entropy: float | None = ENTROPY, max_repeats: float | None = None) -> DataFrame:
    """source, tokens, alpha, weight, target: a row for each source with words. documents is as from sizes()."""
    totals = cut(documents.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"))
    alpha, total = exponent(totals, budget, entropy, max_repeats)
    powers = totals.withColumn("alpha", F.lit(alpha)).withColumn("power", F.exp(F.col("alpha") * F.log(F.col("tokens").cast("double") / total)))
    z = powers.agg(F.sum("power").alias("z")).first()["z"]
    rows = powers.withColumn("weight", F.col("power") / F.lit(z))
    target = F.round(F.col("weight") * F.lit(total if budget is None else budget)).cast("long")
    return rows.select("source", "tokens", "alpha", "weight", target.alias("target"))


def _number(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def _ident() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null|"), F.col("text_md5")))


def _block_key(seed: str, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), "source", F.col("block").cast("string"), epoch.cast("string")).cast("binary"))


def place(documents: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """documents with their source's epochs and rest, block, and the block's key in the cut epoch."""
    plan = plan.select("source", F.expr("target div tokens").alias("epochs"), F.expr("target % tokens").alias("rest"), F.expr(f"(tokens + {BLOCK_TOKENS - 1}) div {BLOCK_TOKENS}").alias("n_blocks"))
    placed = documents.join(plan, "source").withColumn("block", F.pmod(_number(F.concat_ws("|", F.lit(seed), _ident())), F.col("n_blocks")))
    return placed.drop("n_blocks").withColumn("cut_key", _block_key(seed, F.col("epochs")))


def cuts(documents: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """source, at (key and number of the block that the cut epoch ends in), left (tokens that it may still give)."""
    blocks = place(documents, plan, seed).groupBy("source", "cut_key", "block").agg(F.sum("n_tokens").alias("block_tokens"), F.first("rest").alias("rest"))
    blocks = cut(blocks.withColumn("prefix", F.substring("cut_key", 1, PREFIX)))
    before = lambda *order: Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)
    prefixes = blocks.groupBy("source", "prefix").agg(F.sum("block_tokens").alias("all"), F.first("rest").alias("rest"))
    prefixes = prefixes.withColumn("before", F.coalesce(F.sum("all").over(before("source", "prefix")), F.lit(0)))
    first = prefixes.filter("before + all > rest").groupBy("source").agg(F.min(F.struct("prefix", "before")).alias("first"))
    rows = blocks.join(first.select("source", "first.prefix", "first.before"), ["source", "prefix"]).withColumn("at", F.struct("cut_key", "block"))
    rows = rows.withColumn("before", F.col("before") + F.coalesce(F.sum("block_tokens").over(before("source", "at")), F.lit(0)))
    end = rows.filter("before + block_tokens > rest").groupBy("source").agg(F.min(F.struct("at", (F.col("rest") - F.col("before")).alias("left"))).alias("end"))
    return end.select("source", "end.at", "end.left")


def mix(documents: DataFrame, plan: DataFrame, seed: str = SEED, own: DataFrame | None = None) -> DataFrame:
    """A row for each document and epoch that takes it, with the keys that order the epoch: block, epoch, block_key, doc_key.

    Order: epoch, block_key, doc_key. documents has OWN, as from sizes(), and may have more; plan is as from weights(); own, if
    given, is sizes() of the same documents, as a written table.
    """
    ends = cut(cuts((documents if own is None else own).select(*OWN), plan, seed))
    here = F.struct("cut_key", "block")
    placed = place(documents, plan, seed).join(ends, "source")
    key = lambda epoch: F.md5(F.concat_ws("|", F.lit(seed), _ident(), epoch.cast("string")).cast("binary"))
    inside = Window.partitionBy("source", "block").orderBy("cut_doc", "n_tokens", "text_md5").rowsBetween(Window.unboundedPreceding, 0)
    on_edge = (here == F.col("at")) & (F.col("left") > 0)
    edge = placed.filter(on_edge).withColumn("cut_doc", key(F.col("epochs")))
    edge = edge.withColumn("taken", F.sum("n_tokens").over(inside) <= F.col("left")).drop("cut_doc")
    rows = edge.unionByName(placed.filter(~on_edge).withColumn("taken", here < F.col("at")))
    rows = rows.withColumn("n", F.col("epochs") + F.col("taken").cast("long")).filter("n > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select(*documents.columns, "epoch", "block", _block_key(seed, F.col("epoch")).alias("block_key"), key(F.col("epoch")).alias("doc_key"))


ADDED = ["n_tokens", "epoch", "block", "block_key", "doc_key"]


def mixture(docs: DataFrame, budget: int | None = None, entropy: float | None = ENTROPY, max_repeats: float | None = None) -> DataFrame:
    """The columns of docs, texts included, and ADDED: a row for each document and epoch that takes it."""
    measured = cut(sizes(docs))
    plan = cut(weights(measured, budget, entropy, max_repeats))
    own = packed(docs, doc_id=F.col("doc_id").cast("long"), source=F.coalesce(F.col("source").cast("string"), F.lit("")), text=text_of())
    rows = own.select("row", "doc_id", "source", n_words().alias("n_tokens"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
    mixed, names = mix(rows, plan, own=measured), []
    for name in ADDED:
        while name.lower() in {c.lower() for c in [*docs.columns, *names]}:
            name += "_"
        names.append(name)
    return mixed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *[F.col(a).alias(b) for a, b in zip(ADDED, names, strict=True)])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = cut(sizes(table(spark, sf_dir, "documents")))
    return mix(documents, cut(weights(documents))).drop("text_md5")


QUERIES = {"op7_temperature_mix": op7}
ORACLE_SQL = {
    "op7_temperature_mix": rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(text, '')) AS text_md5,
         CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '[\x20\x09-\x0D]+')) END AS BIGINT) AS n_tokens
  FROM (SELECT *, regexp_replace(regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS t FROM documents)),
totals AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM docs GROUP BY source HAVING sum(n_tokens) > 0),
logs AS (SELECT list(ln(CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM totals)) ORDER BY source) AS ls FROM totals),
bis AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, ls FROM logs
  UNION ALL
  SELECT i + 1, CASE WHEN met THEN mid ELSE lo END, CASE WHEN met THEN hi ELSE mid END, ls FROM (
    SELECT *, ln(z) - mid * y / z >= {ENTROPY} * ln(CAST(len(ls) AS DOUBLE)) AS met FROM (
      SELECT i, lo, hi, ls, (lo + hi) / 2 AS mid, list_sum(list_transform(ls, lambda l: exp((lo + hi) / 2 * l))) AS z, list_sum(list_transform(ls, lambda l: l * exp((lo + hi) / 2 * l))) AS y FROM bis WHERE i < {ROUNDS}))),
alpha AS (SELECT round(lo, 6) AS a, ls FROM bis WHERE i = {ROUNDS}),
plan AS (
  SELECT source, tokens, CAST(round(w * total) AS BIGINT) // tokens AS epochs, CAST(round(w * total) AS BIGINT) % tokens AS rest, (tokens + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS} AS n_blocks
  FROM (SELECT source, tokens, total, exp(a * ln(CAST(tokens AS DOUBLE) / total)) / list_sum(list_transform(ls, lambda l: exp(a * l))) AS w
        FROM totals, alpha, (SELECT sum(tokens) AS total FROM totals))),
placed AS (
  SELECT d.*, p.epochs, p.rest, CAST(('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null|' || text_md5)), 1, 8)) AS BIGINT) % p.n_blocks AS block
  FROM docs d JOIN plan p USING (source)),
blocks AS (
  SELECT source, block, rest - prior AS room, prior + tok <= rest AS whole FROM (
    SELECT *, coalesce(sum(tok) OVER (PARTITION BY source ORDER BY md5('{SEED}|' || source || '|' || block || '|' || epochs), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
    FROM (SELECT source, block, sum(n_tokens) AS tok, any_value(epochs) AS epochs, any_value(rest) AS rest FROM placed GROUP BY source, block))),
taken AS (
  SELECT p.*, whole OR (room > 0 AND sum(n_tokens) OVER (PARTITION BY p.source, p.block ORDER BY md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null|' || text_md5) || '|' || epochs), n_tokens, text_md5 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= room) AS also
  FROM placed p JOIN blocks b ON p.source = b.source AND p.block = b.block)
SELECT doc_id, source, n_tokens, epoch, block, md5('{SEED}|' || source || '|' || block || '|' || epoch) AS block_key, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null|' || text_md5) || '|' || epoch) AS doc_key
FROM (SELECT *, unnest(range(0, epochs + CAST(also AS BIGINT))) AS epoch FROM taken)
"""
}
