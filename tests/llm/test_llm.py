import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from veristrata.llm import decontaminate, jaccard_join, language_cnn, lm_score, media_jpeg, pii_scan, quality_qda, quote_threads, secret_scan, temperature_mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, h long"


def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash with inner ones."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, long = say(60), say(4000)
    rows = [(1, a), (1, a), (2, a + " extra"), (3, None), (4, ""), (None, a), (None, None), (5, long), (6, long + " tail"), (7, "one"), (8, "one two"), (9, " \t\n "), (10, "ÀÉ Word WORD"), (11, "12 34"), *((i, say(50)) for i in range(20, 40))]
    return [(i, t, "en" if i else None, "s" if i and i % 2 else None, len(t or ""), "k", 1) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def text(t):
    return t or ""


# 1
def test_lm_base_and_mass(docs, none):
    model, counts = lm_score.train(docs)
    got = lm_score.score(docs, model, counts).collect()
    tokens = [(i, text(t).encode().lower().split() + [b"\n"]) for i, t, *_ in edge_rows()]
    c = {}
    for _, w in tokens:
        for x in w:
            c[x] = c.get(x, 0) + 1
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, len(w), round(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in tokens)
    assert sorted((r.doc_id or -1, r.n_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.n_known == r.n_tokens and r.score < 0 for r in got)
    assert sorted(r.n_once for r in got) == sorted(sum(c[x] == 1 for x in w) for _, w in tokens)
    inside = np.exp(model.inner[0, 0])
    for k in np.unique(model.word_class):  # each class sums to one
        assert abs(inside[model.word_class == k].sum() - 1) < 1e-4
    assert abs(sum(model.form_mass) - 0.5 * lm_score.FORMS) < 1e-9  # a small vocabulary is all in classes by frequency
    model, counts = lm_score.train(none)
    assert lm_score.score(none, model, counts).count() == 0 and lm_score.score(docs, model, counts).count() == len(tokens)



def plain_score(t, model, counts):
    """log10 probability of a text, token by token."""
    total, reader = 0.0, lm_score.Reader(model)
    h, ids, buckets, classes, c1, c2, _ = reader.contexts([t])
    for i in range(len(h)):
        logits = model.bias + sum(model.weights[f][buckets[f, i]] for f in range(lm_score.TEMPLATES))
        p = np.exp(logits - logits.max())
        total += np.log10(p[classes[i]] / p.sum())
        if ids[i] < reader.words:
            assert classes[i] == model.word_class[ids[i]]
            total += model.inner[c1[i], c2[i], ids[i]] / np.log(10)
        else:
            total += np.log10(counts.get(int(h[i].view(np.int64)), 0) + 0.5) - np.log10(model.form_mass[classes[i] - lm_score.FREQUENT])
    return total


def test_lm_score_is_a_probability(spark, monkeypatch):
    """Scores token by token, with words beyond the lookup; the masses of all words and one unknown of each form sum to one."""
    monkeypatch.setattr(lm_score, "LOOKUP", 600)
    monkeypatch.setattr(lm_score, "MODEL_WORDS", 150)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model, table_ = lm_score.train(docs)
    rows = table_.collect()
    counts = {r.h: r.c for r in rows}
    assert len(rows) > len(model.lookup) > len(model.word_class) == 150 and model.n == sum(counts.values())
    head = {int(h) for h in model.lookup[:150].view(np.int64)}
    for form in range(lm_score.FORMS):
        assert abs(model.form_mass[form] - 0.5 - sum(r.c + 0.5 for r in rows if r.form == form and r.h not in head)) < 1e-6
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = {r.doc_id: r.score for r in lm_score.score(docs, model, table_).collect()}
    of = {r.doc_id: (r.n_known, r.n_once) for r in lm_score.score(docs, model, table_).collect()}
    for i in sorted(texts):
        own = [counts[int(x)] for x in lm_score.read([texts[i]])[0].view(np.int64)]
        assert of[i] == (len(own), own.count(1))
    for i in sorted(texts)[:25]:
        assert abs(got[i] - plain_score(texts[i], model, counts)) < 1e-3 * (1 + abs(got[i]) / 100), i


def test_lm_is_the_same_for_any_partitioning(spark, monkeypatch):
    """Many shards; one partition and 64 give the same scores, and held-out text gains on the base either way."""
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 10_000)
    monkeypatch.setattr(lm_score, "BATCH", 1 << 12)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = []
    for n in (1, 64):
        frame = docs.repartition(n)
        model, counts = lm_score.train(frame.filter(lm_score.remainder("doc_id", 5) != 1))
        rows = lm_score.score(frame, model, counts).orderBy("doc_id").collect()
        out.append(np.array([(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in rows]))
    assert round(model.n / lm_score.SHARD_TOKENS) > 4
    assert np.array_equal(out[0][:, :3], out[1][:, :3]) and np.allclose(out[0], out[1], rtol=1e-5)
    held = np.array([zlib.crc32(str(int(i)).encode()) % 5 == 1 for i in out[0][:, 0]])
    assert (out[0][held, 4] - out[0][held, 3]).sum() > 0


# 2
SECRETS = [
    'password = "hunter22" and token:abc123 api-key=zzzzzz API_KEY=Abcdef/+=x',
    "AKIA" + "A" * 16 + " near https://db.example.com:5432 and " + "Ab1/" * 10,
    "far " + "Ab1/" * 10 + " " + "x " * 500 + "AKIA" + "B" * 16,
    "deadbeef" * 4 + " x" + "0123456789abcdef" * 2 + " AKIASHORT secret=abc token=\"\" passwd='ok1234'",
    "é token=日本 password:längere secret = 1234567",
]


def brute_secrets(t):
    found, patterns = [], {"assign": r"(?:(?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    for rank, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, t):
            if len(m.group(1 if kind == "assign" else 0)) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def test_secrets(spark, docs, none):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(SECRETS)] + [(None, None), (9, ""), (9, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.scan(rows).collect()}
    for i, t in enumerate(SECRETS):
        assert [tuple(s) for s in got[i].base] == brute_secrets(t)
    assert {s.kind for s in got[1].spans} == {"access", "secret40", "endpoint"}  # parts that complete each other
    assert {s.kind for s in got[2].spans} == {"access"}  # the weak part is too far away
    clean = {r.doc_id: r.text for r in secret_scan.redact(rows).collect()}
    assert clean[1].count("[SECRET]") == 3 and "AKIA" not in clean[2] and clean[None] is None and clean[9] == ""
    assert secret_scan.redact(docs).count() == docs.count() and secret_scan.scan(none).count() == 0


BRUTE_WEAK = {
    "secret40": r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
    "endpoint": r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,23}://[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![A-Za-z0-9.@-])[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+:[0-9]{2,5}(?![0-9])",
    "client": r"(?ai:client|account|user)_?(?ai:id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.-]+)",
}


def brute_linked(t):
    """All pairs of spans of a text."""
    base, weak = brute_secrets(t), []
    for rank, (kind, p) in enumerate(BRUTE_WEAK.items(), 3):
        for m in re.finditer(p, t):
            if len(m.group(1 if kind == "client" else 0)) >= secret_scan.WEAK[kind][1]:
                weak.append((m.start(), rank, m.end(), kind))
    near = lambda a, b: b[0] - a[2] <= secret_scan.SCOPE and a[0] - b[2] <= secret_scan.SCOPE
    return sorted(base + [w for w in weak if any(o[3] in secret_scan.COMPLEMENT[w[3]] and near(w, o) for o in base + weak)])


def test_linking_on_planted_texts(spark):
    """Random parts at random distances, against all pairs; many spans in one text, more than a run."""
    rng = random.Random(21)
    parts = [lambda: "password=" + "p" * rng.randint(4, 60), lambda: "AKIA" + "Q" * rng.randint(14, 20), lambda: "0123456789abcdef" * rng.randint(1, 3), lambda: "Ab1/" * 10, lambda: "https://h" + "x" * rng.randint(1, 30) + ".example:443", lambda: "db-1.example.com:5432", lambda: 'client_id: "abc' + "9" * rng.randint(0, 9), lambda: "USERID=zz"]
    texts = ["".join(rng.choice([" ", "é" * rng.randint(1, 90) + " ", "word " * rng.randint(1, 120)]) + rng.choice(parts)() for _ in range(rng.randint(1, 14))) for _ in range(150)]
    texts += [" ".join(rng.choice(parts)() for _ in range(400)), "a" * 300_000 + " https://x.example", "a." * 100_000 + " token=abcdef", "secret" + " " * 100_000]
    got = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()
    for r in got:
        assert [tuple(s) for s in r.spans] == brute_linked(texts[r.doc_id]), texts[r.doc_id][:300]
    assert sum(len(r.spans) > len(r.base) for r in got) > 50


def test_secret_base_against_sql(spark):
    rows = duckdb.connect()
    rows.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(rows.sql(secret_scan.BASE_SQL).fetchall())
    assert sorted(tuple(r)[:5] for r in secret_scan.op2(spark, "/root/testdata/sf0.001").collect()) == want


def test_redact_keeps_other_columns(spark, docs):
    clash = docs.withColumnsRenamed({"key": "spans", "h": "doc", "lang": "row", "source": "text_hash"})
    assert sorted(map(repr, secret_scan.redact(clash).collect())) == sorted(map(repr, clash.collect()))
    rows = spark.createDataFrame([(1, "a token=abcdef b", "mine"), (1, "a token=abcdef b", "mine too")], "doc_id long, text string, spans string")
    assert sorted(map(tuple, secret_scan.redact(rows).collect())) == [(1, "a [SECRET] b", "mine"), (1, "a [SECRET] b", "mine too")]


def test_long_parts_meet(spark):
    """An assignment of any length beside an endpoint, before or after it, up to SCOPE away."""
    rows, want = [], {}
    for size in (300, 500, 800, 1200, 3000):
        for lead in (0, 150, 399):
            for gap in (1, 400, 401):
                secret, host = "token=" + "x" * size, "https://h.example"
                for parts in ((secret, host), (host, secret)):
                    want[len(rows)] = gap <= secret_scan.SCOPE
                    rows.append((len(rows), "é" * lead + " " + (" " * gap).join(parts)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in secret_scan.scan(frame).collect()}
    assert {i: "endpoint" in kinds for i, kinds in got.items()} == want and all(len(k) <= 2 for k in got.values())
    clean = {r.doc_id: r.text for r in secret_scan.redact(frame).collect()}
    assert {i: "https" not in t for i, t in clean.items()} == want


# 3
def test_quotes(spark):
    first, second, third = "Let us meet at noon\nby the old bridge", "I cannot come at noon, sorry", "Then we meet at nine"
    rows = [(1, 0, "u", first), (1, 1, "a", f"> {first.splitlines()[0]}\n{second}"), (1, 2, "u", f">> let us  MEET at noon\n> {second}\n{third}"), (1, 3, "a", "nothing quoted here"), (1, 4, "u", "> never said by anyone\nhm"), (2, 0, "u", f"> {second}\nother"), (None, None, "u", None), (2, 1, "a", None)]
    got = {(r.conv_id, r.turn): r for r in quote_threads.thread(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 1].parent_turn == 0 and got[1, 1].path == [0, 1] and got[1, 1].body == second
    assert got[1, 2].parent_turn == 1 and got[1, 2].path == [0, 1, 2] and got[1, 2].n_quotes == 2 and got[1, 2].body == third
    assert got[1, 3].path == [3] and got[1, 4].path == [4] and got[2, 0].parent_turn is None and len(got) == 8
    assert quote_threads.thread(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quotes_against_sql(spark):
    """Random threads with nested quotes, repeated and null rows, short lines, long texts and clashing columns."""
    rng, rows = random.Random(13), []
    says = ["ok", "no", "Let us meet at noon", "by the old bridge", "I  cannot come", "then at nine\n\nor at ten", "long " * 3000, ""]
    for conv in range(40):
        sent = []
        for turn in range(rng.randint(1, 9)):
            lines = []
            for _ in range(rng.randint(0, 2)):
                if sent and rng.random() < 0.8:
                    old = rng.choice(sent).split("\n")
                    some = old[: rng.randint(1, len(old))] if rng.random() < 0.5 else [rng.choice(old)]
                    lines += [rng.choice(["> ", ">", " > "]) + x for x in some]
                lines.append(rng.choice(says) + rng.choice(["", f" {conv} {turn}"]))
            sent.append("\n".join(lines).upper() if rng.random() < 0.1 else "\n".join(lines))
            rows.append((conv if rng.random() > 0.03 else None, turn if rng.random() > 0.03 else None, rng.choice(["user", "assistant"]), sent[-1] if rng.random() > 0.05 else None, "x"))
        if rng.random() < 0.2:
            rows.append(rows[-1])
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string").repartition(3)
    con = duckdb.connect()
    con.register("conversations", frame.drop("path").toArrow())
    columns = ["conv_id", "turn", "role", "body", "n_quotes", "parent_turn", "path"]
    want = con.sql(quote_threads.ORACLE_SQL["op3_quote_threads"]).project(", ".join(columns)).fetchall()
    got = [(*r[:6], ".".join(map(str, r[6])) if r[1] is not None else "") for r in map(tuple, quote_threads.thread(frame).select(*columns).collect())]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == len(rows)
    assert sum(r[5] is not None for r in got) > 30 and any(r[6].count(".") > 2 for r in got)


# 4
def brute_components(sets, similarity):
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both and similarity.den * both >= similarity.num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed", range(12))
def test_trie_and_paths(seed):
    rng = np.random.default_rng(seed)
    similarity = jaccard_join.Similarity(4, *((85, 100), (80, 100), (70, 100))[seed % 3])
    sets = []
    for _ in range(12):
        base = rng.choice(5000, rng.integers(1, 60), replace=False)
        for _ in range(rng.integers(1, 7)):
            keep = base[rng.random(len(base)) > rng.choice([0, 0.05, 0.15])]
            own = np.union1d(keep, rng.integers(0, 5000, rng.integers(0, 5))).astype(np.uint64)
            if len(own):
                sets.append(own)
    assert jaccard_join.block_components(sets, similarity) == brute_components(sets, similarity)
    for i, a in enumerate(sets):  # any two different linked sets have a path in common
        for b in sets[:i]:
            both = len(np.intersect1d(a, b))
            if similarity.den * both >= similarity.num * (len(a) + len(b) - both) and not np.array_equal(a, b):
                x, y = (s[: similarity.prefix(len(s))].tolist() for s in (a, b))
                assert set(zip(x, x[1:], strict=False)) & set(zip(y, y[1:], strict=False))


def brute_join(rows, similarity):
    """doc_id, set size, component, class size, links of each row, by all pairs."""
    sets = [jaccard_join.shingle_set(text(t).encode(), similarity.shingle) for _, t, *_ in rows]
    root, n, same = brute_components(sets, similarity), len(rows), lambda a, b: len(sets[a]) and np.array_equal(sets[a], sets[b])

    def linked(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return a != b and both > 0 and similarity.den * both >= similarity.num * (len(sets[a]) + len(sets[b]) - both)

    out = []
    for k, (i, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root[j] == root[k] and rows[j][0] is not None]
        out.append((i, len(sets[k]), i if not len(sets[k]) else min(ids, default=None), sum(bool(same(k, j)) for j in range(n)) or 1, sum(linked(k, j) for j in range(n))))
    return sorted(out, key=repr)


def joined(frame, similarity):
    return sorted(map(tuple, jaccard_join.join(frame, similarity).select("doc_id", "n_shingles", "component_id", "class_size", "n_links").collect()), key=repr)


def test_join(docs, none):
    assert joined(docs, jaccard_join.OP4) == brute_join(edge_rows(), jaccard_join.OP4)
    assert jaccard_join.join(none, jaccard_join.OP4).count() == 0
    assert jaccard_join.keep_one(none).count() == 0


@pytest.mark.parametrize("num", [85, 70])
def test_join_by_every_route(spark, monkeypatch, num):
    """Dense groups, chains whose ends share nothing, copies; groups split into chunks, blocks by path, stars on tables."""
    rng, rows = random.Random(9), []
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    for _ in range(3):  # near copies of one text
        base = [word() for _ in range(60)]
        for _ in range(20):
            own = list(base)
            own[rng.randrange(60)] = word()
            rows += [" ".join(own)] * rng.choice([1, 1, 3])
    stream = [word() for _ in range(3500)]
    rows += [" ".join(stream[k : k + 100]) for k in range(0, 3400, 7)]  # a chain
    rows += [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(30)]
    rows = list(enumerate(rows))
    frame, similarity = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), jaccard_join.Similarity(4, num, 100)
    want, seen, real = brute_join(rows, similarity), [], jaccard_join.in_blocks
    monkeypatch.setattr(jaccard_join, "in_blocks", lambda texts, where, *a: seen.append(sorted({(r.whole, r.n > jaccard_join.CHUNK) for r in where.collect()})) or real(texts, where, *a))
    for chunk, small, few in ((4096, 10, 1 << 18), (8, 8, 0), (3, 2, 1 << 18)):
        monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
        monkeypatch.setattr(jaccard_join, "SMALL", small)
        monkeypatch.setattr(jaccard_join, "FEW_EDGES", few)
        assert joined(frame, similarity) == want
    assert seen[0] == [(True, False)] and (True, True) in seen[1] and {w for w, _ in seen[2]} == {False, True} and (False, True) in seen[2]


def test_near_copies_are_sent_to_few_blocks(spark):
    """Near copies share most of their paths; a block for each path sent each text as often as it has paths."""
    rng, rows = random.Random(4), []
    base = ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(300)]
    for k in range(60):
        own = list(base)
        own[rng.randrange(300)] = f"w{k}"
        rows.append((k, " ".join(own)))
    frame, none = spark.createDataFrame(rows, "doc_id long, text string"), np.zeros(0, dtype=np.uint64)
    paths = jaccard_join.prefixes(frame, jaccard_join.OP4, none)
    met = jaccard_join.blocks(paths, jaccard_join.OP4)
    assert met.select("key").distinct().count() == 60
    assert 8 * met.count() < paths.join(paths.groupBy("h").count().filter("count > 1"), "h").count()


def test_keep_one(spark, docs):
    """Of each component the smallest doc_id, of its equal rows the least; rows without words stay, repeated ones too."""
    clash = docs.withColumnsRenamed({"key": "text_hash", "h": "no_id", "lang": "doc", "source": "row"})
    kept = jaccard_join.keep_one(clash)
    found = brute_join(edge_rows(), jaccard_join.Similarity())
    assert kept.columns == clash.columns
    got = [r.doc_id for r in kept.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, sorted({c for i, n, c, *_ in found if n and c is not None}) + [i for i, n, *_ in found if not n]))
    rows = spark.createDataFrame([(1, "a b c", "z", 2), (1, "a b c", "y", 9), (None, "a b c", "a", 0), (2, "", "p", 0), (2, "", "p", 0)], "doc_id long, text string, doc string, n long")
    assert sorted(map(tuple, jaccard_join.keep_one(rows).collect())) == [(1, "a b c", "y", 9), (2, "", "p", 0), (2, "", "p", 0)]


# 5
def test_jpeg_round_trip():
    rng = np.random.default_rng(1)
    payloads = [bytes(rng.integers(0, 256, 192 * n, dtype=np.uint8)) for n in (1, 2, 40)] + [b" " * 192, b"\xff\x00" * 96, b"x" * (192 * 8200)]
    stored = media_jpeg.encode_many(payloads)
    for payload, images in zip(payloads, media_jpeg.decode_many(stored), strict=True):
        assert b"".join(i.tobytes() for i in images) == payload
    with pytest.raises(ValueError):
        media_jpeg.decode_many([stored[0][:-20]])
    with pytest.raises(ValueError):
        media_jpeg.decode_many([b"nothing"])


class Bits:
    """Entropy-coded data, stuffed, padded with ones."""

    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += f"{value:0{n}b}" if n else ""

    def coefficient(self, x):
        n = abs(x).bit_length()
        self.put(x if x > 0 else x + (1 << n) - 1, n)

    def data(self):
        whole = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(whole[i : i + 8], 2) for i in range(0, len(whole), 8)).replace(b"\xff", b"\xff\x00")


def foreign_jpeg(rng, width, height, samplings, interval, dc_length, ac_length, step):
    """A baseline JPEG with random DC and AC coefficients, and its luminance thumbnail; codes of one length each."""
    categories, symbols = list(range(12)), [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in (1, 2, 3, 7))]
    code = {"dc": {s: i for i, s in enumerate(categories)}, "ac": {s: i for i, s in enumerate(symbols)}}
    table_ = lambda kind, length, values: media_jpeg.segment(media_jpeg.DHT, bytes([kind]) + bytes(len(values) if i + 1 == length else 0 for i in range(16)) + bytes(values))
    single = len(samplings) == 1
    h, v = (1, 1) if single else (max(x for x, _ in samplings), max(y for _, y in samplings))
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    first = (1, 1) if single else samplings[0]
    luma, previous, parts, bits = np.zeros((down * first[1], across * first[0]), dtype=np.int64), [0] * len(samplings), [], Bits()
    for mcu in range(across * down):
        if interval and mcu and mcu % interval == 0:
            parts.append(bits.data())
            previous, bits = [0] * len(samplings), Bits()
        for c, (x, y) in enumerate([(1, 1)] if single else samplings):
            for block in range(x * y):
                dc = rng.choice([0, 1, -1, rng.randint(-1000, 1000), previous[c]])
                difference, previous[c] = dc - previous[c], dc
                bits.put(code["dc"][abs(difference).bit_length()], dc_length)
                bits.coefficient(difference)
                at = 1
                while at < 64:
                    run = rng.choice([0, 1, 5, 20, 80])
                    if at + run > 63:
                        bits.put(code["ac"][0x00], ac_length)
                        break
                    for _ in range(run // 16):
                        bits.put(code["ac"][0xF0], ac_length)
                    n = rng.choice([1, 2, 3, 7])
                    bits.put(code["ac"][run % 16 << 4 | n], ac_length)
                    bits.coefficient(rng.choice([1, -1]) * rng.randint(1 << (n - 1), (1 << n) - 1))
                    at += run + 1
                if c == 0:
                    luma[mcu // across * first[1] + block // first[0], mcu % across * first[0] + block % first[0]] = dc
    parts.append(bits.data())
    head = bytes((0xFF, media_jpeg.SOI)) + media_jpeg.segment(0xFE, b"a comment") + media_jpeg.segment(media_jpeg.DQT, bytes([0, step]) + bytes([3] * 63))
    head += media_jpeg.segment(media_jpeg.SOF0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(samplings)]) + b"".join(bytes([i + 1, x << 4 | y, 0]) for i, (x, y) in enumerate(samplings)))
    head += table_(0x00, dc_length, categories) + table_(0x10, ac_length, symbols)
    head += media_jpeg.segment(media_jpeg.DRI, interval.to_bytes(2, "big")) if interval else b""
    head += media_jpeg.segment(media_jpeg.SOS, bytes([len(samplings)]) + b"".join(bytes([i + 1, 0]) for i in range(len(samplings))) + bytes([0, 63, 0]))
    scan = b"".join(p + (bytes((0xFF, 0xD0 + i % 8)) if i < len(parts) - 1 else b"") for i, p in enumerate(parts))
    wide, high = -(-width * first[0] // (8 * h)), -(-height * first[1] // (8 * v))
    return head + scan + bytes((0xFF, media_jpeg.EOI)), np.clip((luma * step + 4) // 8 + 128, 0, 255)[:high, :wide]


def test_jpegs_of_other_encoders():
    """AC coefficients, long runs and codes, 4:2:0 and other samplings, odd sizes, with and without restart intervals."""
    rng, made = random.Random(14), []
    for samplings in ([(1, 1)], [(2, 2)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)], [(1, 1)] * 3):
        for interval, dc_length, ac_length, step in ((0, 4, 8, 1), (3, 12, 16, 8), (1, 16, 7, 3)):
            made.append(foreign_jpeg(rng, rng.randint(1, 70), rng.randint(1, 60), samplings, interval, dc_length, ac_length, step))
    for (data, _), images, (_, want) in zip(made, media_jpeg.decode_many([d for d, _ in made]), made, strict=True):
        assert len(images) == 1 and np.array_equal(images[0], want), data[:40]


def test_media(docs, none):
    got = media_jpeg.media_columns(docs).collect()
    for r in got:
        payload = b"".join(i.tobytes() for i in media_jpeg.decode_many([bytes(r.media)])[0])
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.payload_bytes == len(payload) and len(payload) % 192 == 0 and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
    assert sorted(r.n_bytes for r in got) == sorted(len(text(t).encode()) for _, t, *_ in edge_rows())
    assert media_jpeg.media_columns(none).count() == 0


# 6
def test_quality(spark, docs, none):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choice(["stone", "river", "walks", "green"]) for _ in range(rng.randint(20, 80))) + ".") for i in range(60)]
    bad = [(100 + i, " ".join(rng.choice(["ST###", "$$$", "!!", "A%%%"]) for _ in range(rng.randint(20, 80)))) for i in range(60)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    assert all(r.predicted == int(r.doc_id < 100) for r in quality_qda.classify(rows, labels).collect())
    assert quality_qda.classify(docs, labels.limit(0)).filter("score != 0.5").count() == 0
    assert quality_qda.classify(docs, labels).count() == docs.count() and quality_qda.classify(none, labels).count() == 0
    assert quality_qda.keep_good(rows, labels).count() == 60
    clash = docs.withColumnsRenamed({"key": "text_", "h": "_text", "lang": "x"})
    assert sorted(map(repr, quality_qda.keep_good(clash, labels).collect())) == sorted(map(repr, clash.collect()))  # without labels all stay


def test_quality_against_a_direct_fit(spark):
    """The densities of plainly estimated classes, with the same shrinkage, solved without factors."""
    table_ = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
    docs, labels = table_("documents").select("doc_id", "text"), table_("labels")
    texts, quality = {r.doc_id: (r.text or "").encode() for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    ids = sorted(i for i in quality if i in texts and zlib.crc32(str(i).encode()) % 5 != 0)
    x, y = quality_qda.statistics([texts[i] for i in ids]), np.array([quality[i] for i in ids])
    cov = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * cov[k] for k in (0, 1))
    logs = []
    every = sorted(texts)
    z = quality_qda.statistics([texts[i] for i in every])
    for k in (0, 1):
        own = (1 - quality_qda.DIAGONAL) * ((1 - quality_qda.POOL) * cov[k] + quality_qda.POOL * pooled) + quality_qda.DIAGONAL * np.diag(np.diag(pooled)) + quality_qda.RIDGE * np.eye(len(pooled))
        d = z - x[y == k].mean(axis=0)
        logs.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * np.einsum("ij,ji->i", d, np.linalg.solve(own, d.T)))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in quality_qda.op6(spark, "/root/testdata/sf0.001").collect()}
    assert np.allclose([got[i][1] for i in every], want, atol=1e-6)
    assert all(got[i][0] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i][2] == (got[i][1] >= 0.3) for i in every)
    held = [i for i in every if got[i][0] and i in quality]
    assert sum(got[i][2] == quality[i] for i in held) >= 0.85 * len(held)  # of a table of 200 rows


def test_quality_statistics():
    """Each statistic of a small text by hand."""
    row = dict(zip(quality_qda.FEATURES, quality_qda.statistics([b"Ab 1! ab ab\n|ab\n|ab"])[0], strict=True))
    n = 19
    want = {"log_bytes": np.log1p(n), "log_words": np.log1p(6), "word_bytes": np.log1p(14 / 6), "upper": np.sqrt(1 / n), "digit": np.sqrt(1 / n), "symbol": 0, "punctuation": 0, "marks": np.sqrt(1 / n), "pipes": np.sqrt(2 / n), "space": 5 / n}
    assert all(abs(row[k] - v) < 1e-9 for k, v in want.items())
    assert abs(row["line_repeats"] - np.sqrt(1 / 3)) < 1e-9 and abs(row["word_pair_repeats"] - np.sqrt(2 / 5)) < 1e-9 and not quality_qda.statistics([b""]).any()


# 7
def test_mixing(spark, docs, none):
    rows = spark.createDataFrame([(i, "w " * 10, "big" if i < 90 else "small") for i in range(100)] + [(None, None, None), (200, "a b", None)], "doc_id long, text string, source string")
    documents = temperature_mix.sizes(rows)
    plan = {r.source: r for r in temperature_mix.weights(documents).collect()}
    assert abs(sum(r.weight for r in plan.values()) - 1) < 1e-9 and plan["small"].weight > 0.1
    got = temperature_mix.mixture(rows)
    for r in got.groupBy("source").agg({"n_tokens": "sum"}).collect():
        assert 0 <= plan[r.source or ""].target - r[1] <= 10
    capped = {r.source: r.target / r.tokens for r in temperature_mix.weights(documents, max_repeats=1.5).collect()}
    assert max(capped.values()) <= 1.51
    assert temperature_mix.mixture(none).count() == 0


def mixed_by_sql(rows, block_tokens=None):
    con = duckdb.connect()
    con.register("documents", rows.toArrow())
    sql = temperature_mix.ORACLE_SQL["op7_temperature_mix"]
    if block_tokens:
        sql = sql.replace("49999", str(block_tokens - 1)).replace("50000", str(block_tokens))
    return sorted((repr(r[0]), *r[1:]) for r in con.sql(sql).project("doc_id, source, n_tokens, epoch, block, block_key, doc_key").fetchall())


def mixed(rows):
    plan = temperature_mix.weights(temperature_mix.sizes(rows))
    got = temperature_mix.mix(temperature_mix.sizes(rows), plan).select("doc_id", "source", "n_tokens", "epoch", "block", "block_key", "doc_key")
    return sorted((repr(r[0]), *r[1:]) for r in got.collect())


def test_mixing_edges_and_many_blocks(spark, docs, monkeypatch):
    """Against SQL: nulls, empty and long texts, repeated rows, one hot source; then many blocks, whose keys share prefixes."""
    assert mixed(docs) == mixed_by_sql(docs)
    rng = random.Random(11)
    rows = [(rng.randrange(500) if rng.random() > 0.3 else None, "w " * rng.choice([0, 1, 5, 9, 60]) + str(k), rng.choice([None, "hot", "hot", "hot", "b", "c"])) for k in range(900)]
    frame = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, source string").repartition(4)
    monkeypatch.setattr(temperature_mix, "BLOCK_TOKENS", 40)
    for prefix in (1, 3):
        monkeypatch.setattr(temperature_mix, "PREFIX", prefix)
        got = mixed(frame)
        assert got == mixed_by_sql(frame, 40)
    assert len({r[2] for r in got}) > 3 and len({(r[1], r[4]) for r in got}) > 200 and len({r[4] for r in got if r[0] == "None"}) > 50  # rows without an id are spread
    totals = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1)], "source string, tokens long")
    for target in (0.5, 0.8, 0.95):  # the bisection, step by step
        lo, hi, ls = 0.0, 1.0, [np.log(x / 111) for x in (100, 10, 1)]
        for _ in range(temperature_mix.ROUNDS):
            m = (lo + hi) / 2
            p = np.exp(m * np.array(ls)) / np.exp(m * np.array(ls)).sum()
            lo, hi = (m, hi) if -(p * np.log(p)).sum() >= target * np.log(3) else (lo, m)
        assert temperature_mix.exponent(totals, None, target, None) == (round(lo, 6), 111)


def test_mixture_keeps_columns(docs):
    clash = docs.withColumnsRenamed({"key": "epoch", "h": "block", "lang": "row"})
    got = temperature_mix.mixture(clash)
    assert got.columns == [*clash.columns, "n_tokens", "epoch_", "block_", "block_key", "doc_key"]
    texts = {r.doc_id: r.text for r in clash.collect()}
    assert all(r.text == texts[r.doc_id] or r.doc_id is None for r in got.collect()) and got.count() > 0


# 8
def test_language(spark, docs, none):
    rng = random.Random(3)
    sounds = {"aa": ["kla", "tro", "min"], "bb": ["zhu", "wei", "xiq"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[k]) for _ in range(3)) for _ in range(40)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_cnn.train(frame.filter("doc_id < 90"))
    held = {r.doc_id: r.lang_pred for r in language_cnn.predict(frame.filter("doc_id >= 90"), net).collect()}
    assert sum(held[i] == k for i, _, k in rows[90:]) >= 29
    und = {r.doc_id for r in language_cnn.predict(docs, net).filter("lang_pred = 'und'").collect()}
    assert und == {3, 4, None, 9, 11}
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ² ①", "½ x", "٣", "字", "_", "ª", "é"])], "doc_id long, text string")
    assert {r.doc_id for r in language_cnn.predict(odd, net).filter("lang_pred = 'und'").collect()} == {0, 2, 4}
    assert language_cnn.predict(none, net).count() == 0
    long = spark.createDataFrame([(1, rows[0][1] * 400), (1, rows[0][1] * 400)], "doc_id long, text string")  # more windows than are scored at a time
    assert [r.lang_pred for r in language_cnn.predict(long, net).collect()] == ["aa", "aa"]
    assert language_cnn.train(none) is None and language_cnn.predict(docs, None).filter("lang_pred != 'und'").count() == 0
    # The tables give what the convolutions give.
    x = np.frombuffer(rows[0][1].encode()[:256].ljust(256, b"\0"), dtype=np.uint8)[None]
    pooled = []
    for w, kernel, bias in zip(language_cnn.WIDTHS, net.filters, net.biases, strict=True):
        e = net.embedding[x[0]]
        pooled.append(np.max([e[i : i + w].ravel() @ kernel + bias for i in range(256 - w + 1)], axis=0))
    logits = np.maximum(np.concatenate(pooled), 0) @ net.head + net.head_bias
    assert np.allclose(language_cnn.Scorer(net).window_logs(x)[0], logits - np.log(np.exp(logits).sum()), atol=1e-3)


# 9
def test_decontaminate(spark, docs, none):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    item = [rng.choice(words) for _ in range(30)]
    clean = " ".join(rng.choice(words) for _ in range(500))
    changed = list(item)
    changed[7] = changed[19] = "other"
    rows = [(1, clean), (2, clean + " " + " ".join(item) + ". end"), (3, "Start " + ", ".join(changed).upper()), (4, " ".join(item[:9])), (None, " ".join(item)), (5, None), (2, clean + " " + " ".join(item) + ". end")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None)], "item_id long, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.matches for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == {(2, 7): 30, (3, 7): 28, (None, 7): 30}
    assert sorted(r.doc_id for r in decontaminate.remove(frame, bench).collect()) == [1, 4, 5]
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def accepted(doc, item):
    """The rule without masks: some stretch of REACH tokens (of the whole item) agrees in SHARE at some offset."""
    n, best = len(item), None
    reach, share = min(decontaminate.REACH, n), 1 if n < decontaminate.TOLERANT else decontaminate.SHARE
    for delta in range(reach - n, len(doc) - reach + 1):
        same = [doc[j + delta] == item[j] for j in range(max(-delta, 0), min(n, len(doc) - delta))]
        if any(sum(same[i : i + reach]) >= share * reach for i in range(len(same) - reach + 1)):
            best = max(best or 0, sum(same))
    return best


def test_masks_find_what_the_rule_accepts():
    """Over all placements of substitutions in a stretch: none lost for up to two of 13 tokens, a fortieth for three."""
    for n, changed, least in ((10, 1, 1), (10, 2, 0.93), (11, 2, 1), (12, 2, 1), (12, 3, 0.93), (13, 1, 1), (13, 2, 1), (13, 3, 0.97), (20, 3, 1), (20, 5, 0.99)):
        places = list(itertools.combinations(range(n), changed))
        hit = sum(any(all(a + k not in p for k, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS for a in range(n - len(m) + 1)) for p in places)
        assert hit >= least * len(places), (n, changed, hit / len(places))


def test_decontaminate_against_the_rule(spark, monkeypatch):
    """Items of 10 tokens and more, at even and odd places, with up to three tokens changed; by both joins."""
    rng, rows, want = random.Random(8), [], {}
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (10, 11, 12, 13, 16, 30)}
    for n, item in items.items():
        for _ in range(25):
            words = list(item)
            for k in rng.sample(range(n), rng.randint(0, 4)):
                words[k] = "other"
            doc = [f"a{k}" for k in range(rng.randint(0, 5))] + words + [f"z{k}" for k in range(rng.randint(0, 9))]
            best = accepted(doc, item)
            if best:
                want[len(rows), n] = best
            rows.append((len(rows), " ".join(doc)))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.matches for r in decontaminate.contaminated(frame, bench).collect()}
    assert got.items() <= want.items() and len(got) >= 0.97 * len(want)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert {(r.doc_id, r.item_id): r.matches for r in decontaminate.contaminated(frame, bench).collect()} == got


def test_decontaminate_edges(spark, docs, none):
    """Every kind of edge row against an item that some hold; clashing columns and repeated rows pass as they are."""
    long = edge_rows()[7][1]
    bench = spark.createDataFrame([(1, edge_rows()[0][1]), (2, " ".join(long.split()[-40:])), (3, "one two"), (4, None), (5, "")], "item_id long, text string")
    want = {(i, k): m for i, t, *_ in edge_rows() if t for k, item in ((1, edge_rows()[0][1]), (2, " ".join(long.split()[-40:])), (3, "one two")) if (m := accepted(re.findall(r"[^\W_]+", t.lower()), item.split()))}
    assert {(r.doc_id, r.item_id): r.matches for r in decontaminate.contaminated(docs, bench).collect()} == want and len(want) >= 5
    clash = docs.withColumnsRenamed({"key": "text_hash", "h": "no_id", "lang": "doc", "source": "row"})
    kept = decontaminate.remove(clash, bench)
    hit = {i for i, _ in want}
    assert kept.columns == clash.columns and sorted(map(repr, kept.collect())) == sorted(repr(r) for r in clash.collect() if not r.text or r.doc_id not in hit)
    assert decontaminate.remove(docs, bench.limit(0)).count() == docs.count() and decontaminate.remove(none, bench).count() == 0


def test_decontaminate_short_items(spark):
    """Items of fewer than TOLERANT tokens are found as a whole; punctuation at an end adds no token."""
    items = [(1, "Who wrote it?"), (2, "Paris"), (3, "p q r s t u v w x y."), (4, "..."), (5, " - a b c d e f g h i j k!"), (6, "no no")]
    rows = [(1, "x who, wrote it z"), (2, "who wrote that it paris."), (3, "z p q r s t u v w x y z"), (4, "p q r s t OTHER v w x y ..."), (5, "z a b c d e f g h i j k"), (6, "no " * 40), (7, "parisian no"), (8, "who wrote"), (9, "a b c d e f g h i j k."), (None, "z PARIS"), (10, None)]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 3), (2, 2, 1), (3, 3, 10), (4, 3, 9), (5, 5, 11), (6, 6, 2), (9, 5, 11), (None, 2, 1)], key=str)


# 10
def test_pii():
    p = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, s):
        digits = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(digits) <= 19 and pii_scan.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    anchors, rng = pii_scan.automaton(), random.Random(6)
    for _ in range(5000):
        t = "".join(rng.choice("0123456789 .-+@ab()%é") for _ in range(rng.randint(0, 70)))
        found = pii_scan.find(t, anchors)
        for kind, q in p.items():
            assert found[kind] == [m.span() for m in re.finditer(q, t) if valid(kind, m.group())], t
    t = "IBAN: DE89 3704 0044 0532 0130 00 at ftp://me:secret@host.example/x or 12 Long Hill Street"
    found = pii_scan.find(t, anchors)
    assert [t[a:b] for k in ("iban", "login", "street") for a, b in found[k]] == ["DE89 3704 0044 0532 0130 00", "ftp://me:secret@host.example/x", "12 Long Hill Street"]


def brute_added(t):
    """The added kinds at every place, without anchors."""
    out = {"iban": [], "login": [], "street": []}
    for m in re.finditer(r"(?:IBAN|Iban|iban)", t):
        a = re.compile(r"[ :]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})").match(t, m.end())
        if not a or out["iban"] and m.start() < out["iban"][-1][1]:
            continue
        for end in range(a.end(), a.start(1), -1):  # the longest valid account
            s = t[a.start(1) : end]
            if re.fullmatch(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", s) and pii_scan.mod97(s.replace(" ", "")):
                out["iban"].append((a.start(1), end))
                break
    out["login"] = [m.span() for m in re.finditer(r"[A-Za-z]+://[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+[^\s]*", t)]
    return out


def test_pii_added_kinds():
    rng, anchors = random.Random(12), pii_scan.automaton()

    def account(n):
        body, country = "".join(rng.choice("0123456789ABC") for _ in range(n)), "DE"
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{check:02d}{body}"

    parts = [lambda: "IBAN: " + account(rng.randint(11, 20)), lambda: "iban " + account(18)[:-1] + "9 ", lambda: "ftp://u:p@h.ex/x", lambda: "see http://host/a:b@c", lambda: "https://me:pw@", lambda: "IBAN DE00", lambda: "éé"]
    seen = 0
    for _ in range(400):
        t = " , ".join(rng.choice(parts)() for _ in range(rng.randint(1, 6)))
        found, want = pii_scan.find(t, anchors), brute_added(t)
        assert {k: found[k] for k in ("iban", "login")} == {k: want[k] for k in ("iban", "login")}, t
        seen += bool(want["iban"]) + bool(want["login"])
    assert seen > 200
    for t, want in (("12 Long Hill Street", ["12 Long Hill Street"]), ("at 7b Elm Road, or 9 Oak Avenue.", ["7b Elm Road", "9 Oak Avenue"]), ("Elm Street", []), ("1234567 x Street", ["34567 x Street"]), ("5 a b c d e Street", [])):
        assert [t[a:b] for a, b in pii_scan.find(t, anchors)["street"]] == want, t


def test_pii_query(spark):
    """The digest columns from plain patterns, over a whole table."""
    p = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii_scan.op10(spark, sf).collect():
        spans = []
        for kind, q in p.items():
            for m in re.finditer(q, texts[r.doc_id]):
                digits = re.sub("[^0-9]", "", m.group())
                if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and pii_scan.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                    spans.append(f"{kind}:{m.start()}:{m.end()}")
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and r.spans.startswith(",".join(spans))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in p] and r.n_spans == len([s for s in r.spans.split(",") if s])


def test_pii_edges(docs, none):
    assert pii_scan.scan(docs).count() == docs.count() and pii_scan.scan(none).count() == 0
