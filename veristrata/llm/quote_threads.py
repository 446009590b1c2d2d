r"""Chat formatting by quotation linking; DataFrame functions only.

The lines of a message have quote levels, the number of `>` marks at their
start (`> >` and `>>` are level 2). Consecutive lines of one level are a
passage. Quoted passages and quoted lines are normalised (lower case, runs of
white space as one space) and hashed; so are the own text, paragraphs and
lines of every message. A quoted passage is joined to the latest earlier
message of its conversation with that hash, by an as-of scan in order of turns,
so that repeated lines make no pairs. A message replies to the latest message
that its level-1 passages link to.

Messages that quote nothing, or whose quotes have no source, stand on the main
line in order of turns; a reply stands below its parent. `path` holds the turns
from the main line down to the message; ordering by conv_id and path gives the
conversation in reply order, with quotes taken out of `body`. Paths double in
length each round, so rounds grow with the logarithm of the deepest chain.

Null texts have an empty body. Null conv_id or turn: the row stays on its own,
links with nothing. Repeated rows get a row each; rows of one conversation and
turn share their quotes' links. Of several sources the latest counts. Lines of
any length link, and texts of any length are read whole. Empty tables give no
rows. Columns beyond conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veristrata.llm.common import text_of
from veristrata.session import cut, table

MARKS = r"^((?:[ ]?>)+)[ ]?"


def parsed(messages: DataFrame) -> DataFrame:
    """messages with body, and passages: array<struct<level, text>> in order, own text as level 0."""
    rows = messages.withColumn("line", F.split(F.regexp_replace(text_of(), r"\r\n?", "\n"), "\n"))
    marks = F.expr("transform(line, l -> regexp_extract(l, '^((?:[ ]?>)+)', 1))")
    bare = F.expr("transform(line, l -> regexp_replace(l, '^(?:[ ]?>)+[ ]?', ''))")
    lines = F.arrays_zip(F.transform(marks, lambda m: F.char_length(F.regexp_replace(m, "[^>]", ""))).alias("level"), bare.alias("text"))
    rows = rows.withColumn("lines", lines)
    quoting = F.exists("lines", lambda x: x["level"] > 0)
    merged = """aggregate(lines, cast(array() as array<struct<level:int,text:string>>), (a, l) ->
        if(size(a) > 0 and a[size(a) - 1].level = l.level,
           concat(slice(a, 1, size(a) - 1), array(struct(l.level as level, concat(a[size(a) - 1].text, '\n', l.text) as text))),
           concat(a, array(struct(l.level as level, l.text as text)))))"""
    plain = F.expr("array(struct(0 as level, array_join(line, '\n') as text))")
    rows = rows.withColumn("passages", F.when(quoting, F.expr(merged)).otherwise(plain))
    body = F.expr("trim(BOTH '\n' FROM array_join(transform(filter(passages, p -> p.level = 0), p -> p.text), '\n'))")
    return rows.withColumn("body", body).drop("line", "lines")


def normal(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[\\\\s]+', ' '))"


def hashes(text: str, with_lines: bool) -> str:
    """SQL for the distinct hashes of a passage, and of its lines."""
    parts = f"array({normal(text)})"
    if with_lines:
        parts = f"concat({parts}, transform(split({text}, '\\n[ \\t]*\\n'), x -> {normal('x')}), transform(split({text}, '\\n'), x -> {normal('x')}))"
    return f"array_distinct(transform(filter({parts}, x -> x != ''), x -> sha2(x, 256)))"


def linked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, source: quoted passages with the latest earlier message that has their text."""
    whole = rows.filter("conv_id is not null and turn is not null")
    quotes = whole.withColumn("q", F.explode(F.expr("filter(passages, p -> p.level > 0)"))).select("conv_id", "turn", F.col("q.level").alias("level"), F.explode(F.expr(hashes("q.text", True))).alias("h")).distinct()
    quoted = quotes.select("conv_id", "h").distinct()  # own text counts only where its conversation quotes it
    own = whole.select("conv_id", "turn", F.explode(F.expr(hashes("body", True))).alias("h")).join(quoted, ["conv_id", "h"], "left_semi").distinct()
    both = own.withColumn("level", F.lit(0)).unionByName(quotes)
    before = Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("source", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(before))
    return found.filter("level > 0 and source is not null").groupBy("conv_id", "turn", "level").agg(F.max("source").alias("source"))


def paths(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, path (of turns, from the main line) of the messages that reply."""
    parents = links.filter("level = 1").select("conv_id", "turn", F.col("source").alias("parent_turn"))
    rows = cut(parents.select("*", F.array("turn").alias("path"), F.col("parent_turn").alias("top")))
    while True:  # top: the message above the path so far
        above = rows.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("path").alias("p"), F.col("top").alias("next"))
        joined = rows.join(above, (F.col("conv_id") == F.col("c")) & (F.col("top") == F.col("t")), "left")
        if joined.filter("t is not null").isEmpty():
            return rows.select("conv_id", "turn", "parent_turn", F.concat(F.array("top"), "path").alias("path"))
        rows = cut(joined.select("conv_id", "turn", "parent_turn", F.when(F.col("t").isNull(), F.col("path")).otherwise(F.concat("p", "path")).alias("path"), F.coalesce("next", "top").alias("top")))


def thread(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quotes, parent_turn, path: a row for each message."""
    rows = parsed(messages.select("conv_id", "turn", "role", "text"))
    found = paths(linked(rows))
    quotes = F.expr("cast(size(filter(passages, p -> p.level > 0)) as long)")
    out = rows.select("conv_id", "turn", "role", "body", quotes.alias("n_quotes")).join(found, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "body", "n_quotes", "parent_turn", F.coalesce("path", F.array("turn")).alias("path"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = thread(table(spark, sf_dir, "conversations"))
    return rows.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "."))


QUERIES = {"op3_quote_threads": op3}
_NORMAL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


def _duck_hashes(text: str) -> str:
    n = _NORMAL.format
    return f"list_distinct(list_transform(list_filter([{n(text)}] || list_transform(string_split_regex({text}, '\\n[ \\t]*\\n'), lambda x: {n('x')}) || list_transform(string_split({text}, chr(10)), lambda x: {n('x')}), lambda x: x != ''), lambda x: sha256(x)))"


ORACLE_SQL = {
    "op3_quote_threads": rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text FROM conversations),
l AS (SELECT id, conv_id, turn, i, length(regexp_replace(regexp_extract(ls[i], '^((?:[ ]?>)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(ls[i], '^(?:[ ]?>)+[ ]?', '') AS line
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS ls FROM m))),
g AS (SELECT *, i - row_number() OVER (PARTITION BY id, level ORDER BY i) AS run FROM l),
p AS (SELECT id, conv_id, turn, level, min(i) AS i, string_agg(line, chr(10) ORDER BY i) AS text FROM g GROUP BY id, conv_id, turn, level, run),
b AS (SELECT id, conv_id, turn, trim(coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (level = 0), ''), chr(10)) AS body, count(*) FILTER (level > 0) AS n_quotes FROM p GROUP BY id, conv_id, turn),
q AS (SELECT DISTINCT conv_id, turn, level, unnest({_duck_hashes("text")}) AS h FROM p WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT DISTINCT conv_id, turn, unnest({_duck_hashes("body")}) AS h FROM b),
k AS (SELECT q.conv_id, q.turn, max(o.turn) AS parent_turn FROM q JOIN o ON o.conv_id = q.conv_id AND o.h = q.h AND o.turn < q.turn WHERE q.level = 1 GROUP BY q.conv_id, q.turn),
r AS (SELECT conv_id, turn, parent_turn, CAST(turn AS VARCHAR) AS path, parent_turn AS top FROM k
      UNION ALL SELECT r.conv_id, r.turn, r.parent_turn, r.top || '.' || r.path, k.parent_turn FROM r JOIN k ON k.conv_id = r.conv_id AND k.turn = r.top),
f AS (SELECT conv_id, turn, parent_turn, top || '.' || path AS path FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = r.conv_id AND k.turn = r.top))
SELECT m.conv_id, m.turn, m.role, b.body, CAST(b.n_quotes AS BIGINT) AS n_quotes, f.parent_turn, coalesce(f.path, CAST(m.turn AS VARCHAR), '') AS path
FROM m JOIN b USING (id) LEFT JOIN f ON f.conv_id = m.conv_id AND f.turn = m.turn
"""
}
