"""The corpus pipeline, stage by stage, each against a plain version over what the stage before kept."""

import re

import duckdb
import pytest

from veristrata.llm import decontaminate, quality_qda, temperature_mix
from veristrata.session import cut, table

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def one_of_each_group(rows):
    """doc_ids that stay: the smallest of each component, and those without words."""
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def oracle(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.sql(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    return con.sql(sql).df()


def test_stages(spark):
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]
    docs, ids = table(spark, SF, "documents"), lambda rows: {r["doc_id"] for r in rows.select("doc_id").collect()}

    model = quality_qda.fit(quality_qda.features(docs), table(spark, SF, "labels"))
    scores = {r["doc_id"]: model.score(quality_qda.statistics([(r["text"] or "").encode()]))[0] for r in docs.collect()}
    good = cut(stage["quality"](spark, docs, SF))
    assert good.columns == docs.columns
    assert ids(good) == {i for i, s in scores.items() if s >= quality_qda.THRESHOLD}

    once = cut(stage["near_duplicates"](spark, good, SF))
    assert once.columns == docs.columns
    assert ids(once) == one_of_each_group(good.collect()) and once.count() == len(ids(once))

    clean = cut(stage["decontamination"](spark, once, SF))
    bad = set(oracle(decontaminate.ORACLE_SQL["op9_decontaminate"], once)["doc_id"].tolist())
    assert ids(clean) == ids(once) - bad and clean.columns == docs.columns

    clean = cut(clean.union(spark.createDataFrame([(10**9, "a planted token = abcdefghi here", "en", "src0", 32)], docs.schema)))
    safe = cut(stage["secrets"](spark, clean, SF))
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in (clean, safe))
    assert before.keys() == after.keys() and safe.columns == docs.columns
    for i, r in after.items():
        text = r["text"] or ""
        assert not [m for m in re.findall(r"AKIA[A-Z0-9]+", text) if len(m) >= 20]
        assert not [m for m in re.findall(r"[0-9a-f]+", text) if len(m) >= 24]
        parts = [re.escape(p) for p in text.split("[SECRET]")]
        assert re.fullmatch(".+?".join(parts), before[i]["text"] or "", re.S)

    mixed = stage["mixing"](spark, safe, SF)
    want = oracle(temperature_mix.ORACLE_SQL["op7_temperature_mix"], safe)
    columns = sorted(set(mixed.columns) & set(want.columns))
    assert "doc_id" in columns and set(docs.columns) < set(mixed.columns)
    final = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert all(t == after[i]["text"] for i, t in final.items()) and any("[SECRET]" in (t or "") for t in final.values())
    key = lambda rows: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert key(tuple(r) for r in mixed.select(*columns).collect()) == key(want[columns].astype(object).values.tolist())


def test_run_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
