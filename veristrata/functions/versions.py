"""Version orders as array keys that Spark compares natively.

A key is array<string> of parts whose text order is the parts' order, so `<` on
arrays is the ecosystem's order: digits carry their length in front, and markers
say whether a part is a number, a word or an end. A version that does not parse
has a null key, and a range test that reaches it is undecidable (2): unknown is
never safe. Keys are expressions, without Python; only Maven's order, which no
flat key can give, compares pairs in an Arrow UDF (use it on distinct pairs).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

NOT_AFFECTED, AFFECTED, UNDECIDABLE = 0, 1, 2
STRINGS = "array<string>"

#: The syntax of semantic versions: a number without leading zeros, and the identifiers of a pre-release.
_N = r"(0|[1-9][0-9]*)"
_PRE = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
_SEMVER = rf"^{_N}(?:\.{_N}(?:\.{_N}(?:-({_PRE}(?:\.{_PRE})*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?)?)?$"
_STRICT = rf"^{_N}\.{_N}\.{_N}(?:-({_PRE}(?:\.{_PRE})*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?$"
#: Digits that fit the reference's integers; longer ones are undecidable.
_INT = "[0-9]{1,18}"


def _bind(value: Column, function) -> Column:
    """function(value), with the value computed once however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _number(digits: Column) -> Column:
    """Digits of any length, in order as strings: of one width, or after their count if they are longer than that; nothing is 0."""
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    long = _bind(bare, lambda b: F.when(F.length(b) <= 18, F.lpad(b, 18, "0")).otherwise(F.concat(F.lit(":"), F.lpad(F.length(b).cast("string"), 6, "0"), b)))
    return F.when(F.length(digits) <= 18, F.lpad(digits, 18, "0")).otherwise(long)


def _identifiers(text: Column) -> Column:
    """Dot-separated identifiers: numbers before words, and fewer before more."""
    return F.transform(F.split(text, r"\."), lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("1"), _number(p))).otherwise(F.concat(F.lit("2"), p)))


def _groups(pattern: str, n: int, text: Column, function) -> Column:
    """function(groups) of a text that matches from start to end, else null: all groups (empty ones too) by one match. groups[1] is the first."""
    mark = "\u0001"
    marked = F.regexp_replace(text, pattern, "".join(f"{mark}${k}" for k in range(1, n + 1)))
    return _bind(marked, lambda m: F.when(F.startswith(m, F.lit(mark)), _bind(F.split(m, mark), function)))


def _numbers(g: Column, n: int) -> Column:
    return F.array(*[_number(F.get(g, F.lit(k))) for k in range(1, n + 1)])


def _released(g: Column, n: int) -> Column:
    """n numbers, and the identifiers of a pre-release in the group after them."""
    pre = F.get(g, F.lit(n + 1))
    tail = F.when(pre != "", F.concat(F.array(F.lit("0")), _identifiers(pre))).otherwise(F.array(F.lit("9")))
    return F.concat(_numbers(g, n), tail)


def key_go(v: Column, bound: bool = False) -> Column:
    """v may be missing; short forms without pre-release; build metadata does not count."""
    return _groups(_SEMVER, 4, F.regexp_replace(v, "^v", ""), lambda g: _released(g, 3))


def key_cargo(v: Column, bound: bool = False) -> Column:
    """Three parts, after one v; a bound may be short and has no v."""
    return _groups(_SEMVER if bound else _STRICT, 4, v if bound else F.regexp_replace(v, "^v", ""), lambda g: _released(g, 3))


def key_npm(v: Column, bound: bool = False) -> Column:
    """Three parts, or four, of which the last does not count."""
    bare = F.substring_index(F.regexp_replace(v, "^v?V?", ""), "+", 1)
    return _groups(rf"^({_INT})\.({_INT})\.({_INT})(?:\.[^.-]*)?(?:-(.*))?$", 4, bare, lambda g: _released(g, 3))


def key_nuget(v: Column, bound: bool = False) -> Column:
    """One to four numbers; identifiers without case, and without leading zeros if they are numbers; floating versions are undecidable."""
    bare = F.lower(F.substring_index(F.regexp_replace(F.trim(v), "^[vV]", ""), "+", 1))
    pattern = rf"^({_INT})(?:\.({_INT}))?(?:\.({_INT}))?(?:\.({_INT}))?(?:-((?:0|[1-9][0-9]{{0,17}}|[^.]*[^.0-9][^.]*)(?:\.(?:0|[1-9][0-9]{{0,17}}|[^.]*[^.0-9][^.]*))*))?$"
    return F.when(~F.contains(v, F.lit("*")), _groups(pattern, 5, bare, lambda g: _released(g, 4)))


def key_pub(v: Column, bound: bool = False) -> Column:
    """Three numbers; build metadata sorts after the same version without it, and by its identifiers."""

    def key(g: Column) -> Column:
        pre, build = F.get(g, F.lit(4)), F.get(g, F.lit(5))
        # A closing 0 ends the identifiers of a pre-release, before any further one.
        tail = F.when(pre != "", F.concat(F.array(F.lit("0")), _identifiers(pre), F.array(F.lit("0")))).otherwise(F.array(F.lit("9")))
        more = F.when(build != "", F.concat(F.array(F.lit("1")), _identifiers(build))).otherwise(F.array(F.lit("0")))
        return F.concat(_numbers(g, 3), tail, more)

    return _groups(rf"^({_INT})\.({_INT})\.({_INT})(?:-([^+]*))?(?:\+(.*))?$", 5, F.regexp_replace(v, "^v", ""), key)


#: The stability tiers in their order.
TIERS = {"dev": "0", "alpha": "1", "a": "1", "beta": "2", "b": "2", "rc": "3", "": "4", "patch": "5", "p": "5"}


def _mapped(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def key_packagist(v: Column, bound: bool = False) -> Column:
    """One to four numbers, and a stability after a dash; branch aliases are undecidable."""
    pattern = rf"^({_INT})(?:\.({_INT}))?(?:\.({_INT}))?(?:\.({_INT}))?(?:-(dev|alpha|a|beta|b|rc|patch|p)\.?([0-9]{{0,18}}))?$"

    def key(g: Column) -> Column:
        tier, n = F.get(g, F.lit(5)), F.get(g, F.lit(6))
        return F.when(~((tier == "dev") & n.rlike("[1-9]")), F.concat(_numbers(g, 4), F.array(_mapped(TIERS, tier), _number(n))))

    return _bind(F.lower(F.trim(v)), lambda x: F.when(~x.rlike(r"^dev-|\.x-dev$"), _groups(pattern, 6, F.regexp_replace(x, "^v", ""), key)))


#: The places of the kinds of versions of one release: development, those of alpha, beta and rc, alpha, beta, rc, final, post.
_PEP = rf"^(?:({_INT})!)?({_INT}(?:\.{_INT})*)(?:\.?(a|alpha|b|beta|c|preview|rc)\.?({_INT}))?(?:\.post({_INT}))?(?:\.dev({_INT}))?$"
_KINDS = {"": 0, "a": 1, "alpha": 1, "b": 2, "beta": 2, "c": 3, "preview": 3, "rc": 3}


def key_pypi(v: Column, bound: bool = False, published: bool = False) -> Column:
    """Epoch, release, place, number, local. A development version of a pre-release sorts before all pre-releases, and its own number
    does not count; a post part counts only where no other is. With `published`, the published order of all parts."""

    def key(g: Column, local: Column) -> Column:
        part = lambda k: F.get(g, F.lit(k))
        kind = _mapped(_KINDS, part(3))
        release = F.transform(F.split(F.regexp_replace(part(2), r"(\.0+)+$", ""), r"\."), lambda p: F.concat(F.lit("1"), _number(p)))
        has_dev, has_pre, has_post = part(6) != "", part(3) != "", part(5) != ""
        if published:
            place = F.when(has_pre, kind.cast("string")).when(has_dev & ~has_post, "0").otherwise("4")
            slot = [place, _number(part(4)), F.when(has_post, F.concat(F.lit("1"), _number(part(5)))).otherwise("0"), F.when(has_dev, F.concat(F.lit("0"), _number(part(6)))).otherwise("1")]
        else:
            place = F.when(has_dev, kind).when(has_pre, kind + 3).when(has_post, 8).otherwise(7)
            slot = [place.cast("string"), _number(F.when(has_dev, part(6)).when(has_pre, part(4)).when(has_post, part(5)).otherwise(""))]
        own = F.when(local == "", "0").otherwise(F.concat(F.lit("1"), local))
        return F.concat(F.array(_number(part(1))), release, F.array(F.lit("0"), *slot, own))

    def parsed(whole: Column) -> Column:
        local, bare = F.regexp_extract(whole, r"^[^+]*\+(.*)$", 1), F.substring_index(whole, "+", 1)
        bare = F.translate(F.regexp_replace(bare, r"^([0-9]+(?:\.[0-9]+)*)-([0-9]+)$", "$1.post$2"), "-_", "..")
        return _groups(_PEP, 6, bare, lambda g: key(g, local))

    return _bind(F.lower(F.regexp_replace(F.trim(v), "^[vV]", "")), parsed)


def key_rubygems(v: Column, bound: bool = False) -> Column:
    """Runs of digits and letters, without case; what is missing is 0, and a word sorts before any number.

    A run of zeros is written at the part after it: a word after fewer zeros is less, a number after fewer is more,
    and the end, where all that is missing is 0, lies between. Zeros before the first word do not count.
    """
    zeros = lambda n: F.lpad(n.cast("string"), 6, "0")
    start = F.expr("cast(struct(array() as key, 0 as zeros, false as word) as struct<key:array<string>,zeros:int,word:boolean>)")

    def step(s: Column, run: Column) -> Column:
        word, none = run.rlike("^[a-z]"), run.rlike("^0+$")
        less = F.concat(F.lit("0"), zeros(F.when(s["word"], s["zeros"]).otherwise(0)), run)
        more = F.concat(F.lit("2"), zeros(999999 - s["zeros"]), _number(run))
        key = F.when(none, s["key"]).otherwise(F.concat(s["key"], F.array(F.when(word, less).otherwise(more))))
        return F.struct(key.alias("key"), F.when(none, s["zeros"] + 1).otherwise(0).alias("zeros"), (s["word"] | word).alias("word"))

    def parsed(x: Column) -> Column:
        bare = F.when(x == "", "0").otherwise(x)
        key = F.concat(F.aggregate(F.regexp_extract_all(bare, F.lit("([0-9]+|[a-z]+)"), F.lit(1)), start, step)["key"], F.array(F.lit("1")))
        return F.when(bare.rlike(r"^[0-9][0-9a-z.-]*$") & ~bare.rlike("[0-9]{19}"), key)

    return _bind(F.lower(F.regexp_replace(F.trim(v), "^[vV]", "")), parsed)


_REGISTRY: dict[str, Callable[..., Column]] = {}


def register_order(ecosystem: str, key: Callable[..., Column]) -> None:
    """key(version, bound=False) gives the sort key as an expression; a second order for an ecosystem is an error."""
    if ecosystem in _REGISTRY or ecosystem == "Maven":
        raise ValueError(f"{ecosystem} has an order")
    _REGISTRY[ecosystem] = key


for _name, _key in {"Go": key_go, "npm": key_npm, "crates.io": key_cargo, "PyPI": key_pypi, "NuGet": key_nuget, "Packagist": key_packagist, "RubyGems": key_rubygems, "Hex": key_cargo, "Pub": key_pub, "SwiftURL": key_cargo}.items():
    register_order(_name, _key)


def version_key(ecosystem: Column, version: Column, bound: bool = False) -> Column:
    """array<string> that sorts as the ecosystem's versions do; null if unparsable or without an order."""
    out = F.lit(None).cast(STRINGS)
    for name, key in _REGISTRY.items():
        out = F.when(ecosystem == name, key(version, bound)).otherwise(out)
    return out


def dotted_key(version: Column) -> Column:
    """Plain dotted integers: array<bigint>, null if any part is not one."""
    text = F.regexp_replace(version, "^v", "")
    return F.when(text.rlike(r"^[0-9]{1,18}(\.[0-9]{1,18})*$"), F.split(text, r"\.").cast("array<bigint>"))


# --- Maven: nested lists, compared in pairs ---------------------------------

#: Qualifiers in their order, and their other names.
QUALIFIERS = {"alpha": -5, "beta": -4, "milestone": -3, "rc": -2, "snapshot": -1, "": 0, "sp": 1}
SAME = {"ga": "", "final": "", "release": "", "cr": "rc"}
SHORT = {"a": "alpha", "b": "beta", "m": "milestone"}
_TOKEN = re.compile(r"([0-9]+)|([^0-9.-]+)|([.-])")


def maven_items(version: str) -> list | None:
    """The version as nested lists of numbers and qualifiers; null parts at the end of each list are dropped."""
    text = version.strip()
    text = (text[1:] if text[:1] == "v" else text).strip().lower()
    if not text:
        return None
    root: list = []
    here, after = root, "."  # what stands before the next token
    tokens = [m.groups() for m in _TOKEN.finditer(text)]

    def below(items: list) -> list:
        items.append([])
        return items[-1]

    for i, (digits, word, mark) in enumerate(tokens):
        if mark:
            if after in ".-":  # two marks in a row, or one in front: an empty token
                here.append(0)
            if mark == "-":
                here = below(here)
            after = mark
            continue
        if after not in ".-":  # a change between digits and letters opens a list
            here = below(here)
        if digits:
            if int(digits) >= 1 << 63:
                return None
            here.append(int(digits))
        else:
            if i + 1 < len(tokens) and tokens[i + 1][0]:
                word = SHORT.get(word, word)
            here.append(SAME.get(word, word))
        after = "x"
    _strip(root)
    return root


def _strip(items: list) -> None:
    for x in items:
        if isinstance(x, list):
            _strip(x)
    for i in range(len(items) - 1, -1, -1):
        if items[i] in (0, "", []):
            del items[i]
        elif not isinstance(items[i], list):
            return


def _rank(x) -> tuple:
    """Place among kinds: qualifiers, lists, numbers; and among the qualifiers."""
    if isinstance(x, str):
        return (0, QUALIFIERS.get(x, 2), x)
    return (1,) if isinstance(x, list) else (2, x)


def _against_nothing(x) -> int:
    if isinstance(x, list):
        return next((c for c in map(_against_nothing, x) if c), 0)
    n = QUALIFIERS.get(x, 2) if isinstance(x, str) else x
    return (n > 0) - (n < 0)


def maven_order(a: list, b: list) -> int:
    for i in range(max(len(a), len(b))):
        if i >= len(a) or i >= len(b):
            c = _against_nothing(a[i]) if i < len(a) else -_against_nothing(b[i])
        elif isinstance(a[i], list) and isinstance(b[i], list):
            c = maven_order(a[i], b[i])
        else:
            x, y = _rank(a[i]), _rank(b[i])
            c = (x > y) - (x < y)
        if c:
            return c
    return 0


@F.pandas_udf(IntegerType())
def maven_compare(a: pd.Series, b: pd.Series) -> pd.Series:
    """-1, 0 or 1; null where either does not parse, or is null."""
    items: dict = {}

    def parsed(v):
        if v not in items:
            items[v] = maven_items(v)
        return items[v]

    out = []
    for x, y in zip(a, b, strict=True):
        x, y = (parsed(v) if isinstance(v, str) else None for v in (x, y))
        out.append(None if x is None or y is None else maven_order(x, y))
    return pd.Series(out, dtype="Int32")


#: Whether a version parses, and its order against each bound of a range: -1, 0 or 1; null where the bound does not parse, or is empty.
MAVEN_ORDERS = StructType().add("parses", BooleanType()).add("introduced", IntegerType()).add("fixed", IntegerType()).add("last_affected", IntegerType())


@F.pandas_udf(MAVEN_ORDERS)
def maven_orders(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Of versions and their ranges' bounds (empty is none); a task parses each text, and compares each pair, once."""
    items: dict = {}
    orders: dict = {}

    def parsed(v):
        if v not in items:
            items[v] = maven_items(v)
        return items[v]

    def order(v, bound):
        if not isinstance(v, str) or not bound:
            return None
        if (v, bound) not in orders:
            x, y = parsed(v), parsed(bound)
            orders[v, bound] = None if x is None or y is None else maven_order(x, y)
        return orders[v, bound]

    for version, *bounds in batches:
        if len(orders) > 1_000_000:  # what is forgotten is computed anew
            items.clear()
            orders.clear()
        out = {"parses": [isinstance(v, str) and parsed(v) is not None for v in version]}
        for name, bound in zip(("introduced", "fixed", "last_affected"), bounds, strict=True):
            out[name] = pd.Series([order(v, b) for v, b in zip(version, bound, strict=True)], dtype="Int32")
        yield pd.DataFrame(out)


# So that a filter on the verdict does not run it twice.
maven_orders = maven_orders.asNondeterministic()


# --- Ranges ------------------------------------------------------------------


def range_verdict(version: Column, introduced: Column, fixed: Column, last: Column, has_introduced: Column, has_fixed: Column, has_last: Column) -> Column:
    """Verdict of one range over keys: lower bound inclusive, then `fixed` exclusive, else `last` inclusive.

    The lower bound is tested first and may decide before an unparsable upper bound is seen.
    """
    return (
        F.when(version.isNull(), UNDECIDABLE)
        .when(has_introduced & introduced.isNull(), UNDECIDABLE)
        .when(has_introduced & (version < introduced), NOT_AFFECTED)
        .when(has_fixed & fixed.isNull(), UNDECIDABLE)
        .when(has_fixed, F.when(version < fixed, AFFECTED).otherwise(NOT_AFFECTED))
        .when(has_last & last.isNull(), UNDECIDABLE)
        .when(has_last, F.when(version <= last, AFFECTED).otherwise(NOT_AFFECTED))
        .otherwise(AFFECTED)
    )


def compared_verdict(parses: Column, low: Column, fixed: Column, last: Column, has_introduced: Column, has_fixed: Column, has_last: Column) -> Column:
    """range_verdict() from comparisons (-1, 0, 1 or null) of the version with each bound."""
    one, zero = F.lit(1), F.lit(0)
    key = F.when(parses, zero)
    return range_verdict(key, -low, F.when(fixed < 0, one).when(fixed >= 0, zero), F.when(last <= 0, zero).when(last > 0, -one), has_introduced, has_fixed, has_last)


def any_range(verdicts: Column) -> Column:
    """Over a group's ranges: affected wins over undecidable, which wins over not affected."""
    rank = F.max(F.when(verdicts == AFFECTED, 2).when(verdicts == UNDECIDABLE, 1).otherwise(0))
    return F.when(rank == 2, AFFECTED).when(rank == 1, UNDECIDABLE).otherwise(NOT_AFFECTED)


def listed_verdict(version: Column, versions: Column, undecidable: Column) -> Column:
    """Of an advisory without ranges: whether the version, without a leading v, is listed; undecidable only where nothing is."""
    listed = F.coalesce(F.size(versions), F.lit(0)) > 0
    found = F.coalesce(F.array_contains(versions, F.regexp_replace(version, "^v", "")), F.lit(False))
    return F.when(listed, F.when(found, AFFECTED).otherwise(NOT_AFFECTED)).when(F.coalesce(undecidable, F.lit(False)), UNDECIDABLE).otherwise(NOT_AFFECTED)


# --- Names of platforms: dotted numbers, compared in pairs -------------------


def dotted_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the first differing segment, as numbers; null (undecidable) if that segment is not a number in both. A missing one is empty."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    number = lambda s: F.when(s.rlike(f"^[+-]?{_INT}$"), s.cast("bigint"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1), lambda i: F.struct(F.coalesce(F.get(x, i), F.lit("")).alias("x"), F.coalesce(F.get(y, i), F.lit("")).alias("y")))
    differ = F.filter(pairs, lambda p: ~F.coalesce(number(p["x"]) == number(p["y"]), p["x"] == p["y"]))
    first = F.get(differ, F.lit(0))
    return F.when(F.size(differ) == 0, 0).otherwise(F.signum((number(first["x"]) - number(first["y"])).cast("double")).cast("int"))
