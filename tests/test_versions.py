import functools
import itertools

import pytest
from pyspark.sql import functions as F

from veristrata.functions import versions as v

#: Versions in their order; tuples hold equal ones.
ORDERS = {
    "Go": [("v1", "1.0.0", "v1.0"), "v1.0.1", "v1.2.0-alpha", "v1.2.0-alpha.1", "1.2.0-beta", ("1.2.0", "v1.2.0+b"), "1.10.0", "2.0.0+b"],
    "npm": ["1.0.0-1", "1.0.0-a", "1.0.0-a.1", ("1.0.0", "v1.0.0", "1.0.0+x", "1.0.0.9", "01.0.0"), "1.0.2", "1.0.10"],
    "crates.io": ["0.9.9", "1.0.0-rc.1", "1.0.0-rc.2", "1.0.0-rc.10", ("1.0.0", "1.0.0+1")],
    "NuGet": [("1", "1.0.0.0", "V1.0"), "1.0.0.1", "1.1-2", "1.1-Alpha", "1.1-beta", "1.1", "2.0"],
    "Pub": ["1.0.0-a", "1.0.0-a+1", "1.0.0-a.b", "1.0.0", "1.0.0+1", "1.0.0+2", "1.0.0+10", "1.0.0+a", "1.0.1"],
    "Packagist": ["1.0-dev", "1.0-alpha1", ("1.0-beta2", "1.0-b2", "1.0.0-BETA.2"), "1.0-RC1", ("1.0", "v1"), ("1.0-patch1", "1.0-p1"), "1.0.1"],
    "PyPI": ["1.0.dev1", "1.0.post1.dev2", ("1.0a1.dev1", "1.0a9.dev1"), "1.0rc1.dev0", "1.0a1", "1.0b1", ("1.0rc1", "1.0-rc.1", "1.0c1"), ("1.0", "1", "v1.0.0"), "1.0+10", "1.0+2", ("1.0.post1", "1.0-1"), "1.0.1", "1!0.1"],
    "RubyGems": ["1.0.RC1.2", ("3.0.0-alpha", "3.0.0.alpha", "3.alpha"), "3.0.0.beta", ("3.0.0-rc.1", "3.0.0.rc.1", "3.0.0.rc1"), "3.0.0.rc.1.0.1", ("3", "3.0.0", "v3.0"), "3.0.1", "3.1", "3.10"],
}
ORDERS["RubyGems"][0:1] = ["1.a.0.x.1", "1a", "1.b", "2.0.0.x"]
BAD = {
    "Go": ["v01.2.3", "v1.2-alpha", "v1.2.3-01", "vv1.0.0", "", "1.2.3.4"],
    "npm": ["1.2", "a.b.c", "1.2.3.4.5", ""],
    "crates.io": ["1.2", "V1.2.3", "1.2.3-", "x"],
    "NuGet": ["1.*", "1.0-01", "1.0-", "1..2", "1.2.3.4.5"],
    "Pub": ["1.0", "1.0.0.0"],
    "Packagist": ["1.0beta1", "1.0-pl2", "dev-main", "1.0.x-dev", "1.0-dev1", "1.2.3.4.5", "1.0-"],
    "PyPI": ["1.0a", "x", "1.0.post", ""],
    "RubyGems": ["x1", "1_0", "1" * 19],
    "none": ["1.0.0"],
}


@pytest.mark.parametrize("ecosystem", ORDERS)
def test_order(spark, ecosystem):
    rows = [(i, x) for i, group in enumerate(ORDERS[ecosystem]) for x in ((group,) if isinstance(group, str) else group)]
    frame = spark.createDataFrame(rows, "i int, v string").select("i", "v", v.version_key(F.lit(ecosystem), F.col("v")).alias("k"))
    keys = frame.collect()
    assert all(r.k is not None for r in keys), [r.v for r in keys if r.k is None]
    for a, b in itertools.product(keys, keys):
        assert (a.k < b.k, a.k == b.k) == (a.i < b.i, a.i == b.i), (a, b)


def test_unparsable(spark):
    rows = spark.createDataFrame([(e, x) for e, xs in BAD.items() for x in xs], "e string, v string")
    assert rows.select("e", "v", v.version_key(F.col("e"), F.col("v")).alias("k")).filter("k is not null").collect() == []
    bounds = spark.createDataFrame([("crates.io", "1.2"), ("Hex", "v1.2.3")], "e string, v string")
    assert [r.k is None for r in bounds.select(v.version_key(F.col("e"), F.col("v"), True).alias("k")).collect()] == [False, True]  # a bound may be short, without v
    with pytest.raises(ValueError):
        v.register_order("npm", v.key_npm)


def test_published_pypi_order(spark):
    order = ["1.0.dev1", "1.0a1.dev1", "1.0a1", "1.0b1", "1.0rc1.dev0", "1.0rc1", "1.0", "1.0.post1.dev0", "1.0.post1", "1.1"]
    keys = [r.k for r in spark.createDataFrame([(i, x) for i, x in enumerate(order)], "i int, v string").orderBy("i").select(v.key_pypi(F.col("v"), published=True).alias("k")).collect()]
    assert keys == sorted(keys)


def pairwise_gems(a, b):
    """The rule itself: missing parts are 0, words sort before numbers."""
    import re

    def parts(x):
        out = [int(t) if t.isdigit() else t for t in re.findall("[0-9]+|[a-z]+", x)]
        split = next((i for i, t in enumerate(out) if isinstance(t, str)), len(out))
        runs = [out[:split], out[split:]]
        for r in runs:
            while r and r[-1] == 0:
                r.pop()
        return runs[0] + runs[1]

    x, y = parts(a), parts(b)
    for i in range(max(len(x), len(y))):
        p, q = (s[i] if i < len(s) else 0 for s in (x, y))
        if p != q:
            if isinstance(p, str) == isinstance(q, str):
                return -1 if p < q else 1
            return -1 if isinstance(p, str) else 1
    return 0


def test_gems_against_pairs(spark):
    texts = sorted({"1" + "".join(t) for n in range(5) for t in itertools.product([".0", ".2", ".a", ".b", ".10"], repeat=n)})[:400]
    keys = {r.v: r.k for r in spark.createDataFrame([(t,) for t in texts], "v string").select("v", v.key_rubygems(F.col("v")).alias("k")).collect()}
    for a, b in itertools.combinations(texts, 2):
        assert (keys[a] > keys[b]) - (keys[a] < keys[b]) == pairwise_gems(a, b), (a, b)


#: Maven versions in their order.
MAVEN = [("1-alpha-1", "1-a1", "1.0-alpha1"), "1-beta", "1-m1", ("1-rc", "1-cr"), "1-snapshot", ("1", "1.0", "1-ga", "1.0.0-final", "v1", "1-0", "1-0.ga"), "1-sp", "1-xyz", "1-1", "1.1-alpha", ("1.1", "1.1.0"), "1.10", "2"]


def test_maven(spark):
    rows = [(i, x) for i, group in enumerate(MAVEN) for x in ((group,) if isinstance(group, str) else group)]
    for (i, a), (j, b) in itertools.product(rows, rows):
        assert v.maven_order(v.maven_items(a), v.maven_items(b)) == (i > j) - (i < j), (a, b)
    assert v.maven_items("") is None and v.maven_items("9" * 30) is None
    key = functools.cmp_to_key(lambda a, b: v.maven_order(v.maven_items(a), v.maven_items(b)))
    assert sorted(["2.0.1", "2.0", "2.0.1-xyz", "2.0-rc2", "2.0.1-123"], key=key) == ["2.0-rc2", "2.0", "2.0.1", "2.0.1-xyz", "2.0.1-123"]
    got = spark.createDataFrame([("1.0", "1.1"), ("1.0", None), ("1", "9" * 30)], "a string, b string").select(v.maven_compare("a", "b").alias("c")).collect()
    assert [r.c for r in got] == [-1, None, None]


def test_dotted_pairs(spark):
    cases = [("1.0", "1.0", 0), ("1.2", "1.10", -1), ("2", "1.9", 1), ("1.0", "1.0.1", None), ("1.a", "1.a", 0), ("1.a", "1.b", None), ("1.a.3", "1.a.2", 1), ("01", "1", 0)]
    got = spark.createDataFrame(cases, "a string, b string, want int").select(v.dotted_compare(F.col("a"), F.col("b")).alias("c"), "want").collect()
    assert [r.c for r in got] == [r.want for r in got]


def test_range_verdict(spark):
    rows = spark.createDataFrame([("1.5", "1.0", "2.0"), ("2.0", "1.0", "2.0"), ("0.9", "1.0", "x"), ("1.5", "1.0", "x"), ("y", "1.0", "2.0")], "v string, a string, b string")
    k = [v.dotted_key(F.col(c)) for c in "vab"]
    none, yes, no = F.lit(None).cast("array<bigint>"), F.lit(True), F.lit(False)
    got = rows.select(v.range_verdict(k[0], k[1], k[2], none, yes, yes, no).alias("x"), v.range_verdict(k[0], k[1], none, k[2], yes, no, yes).alias("y")).collect()
    assert [r.x for r in got] == [1, 0, 0, 2, 2] and [r.y for r in got] == [1, 1, 0, 2, 2]
    compared = spark.createDataFrame([(True, 1, -1), (True, 0, 0), (True, -1, None), (True, 1, None), (False, 1, -1)], "p boolean, a int, b int")
    none = F.lit(None).cast("int")
    got = compared.select(v.compared_verdict(F.col("p"), F.col("a"), F.col("b"), none, yes, yes, no).alias("x"), v.compared_verdict(F.col("p"), F.col("a"), none, F.col("b"), yes, no, yes).alias("y")).collect()
    assert [r.x for r in got] == [1, 0, 0, 2, 2] and [r.y for r in got] == [1, 1, 0, 2, 2]
