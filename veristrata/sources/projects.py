"""Projects as rows: module lists, workspaces and entry points of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default files and endings of scripts, in their order.
INDEX = ("index.js", "index.cjs", "index.mjs", "index.ts", "index.tsx", "index.jsx")
ENDINGS = (".js", ".cjs", ".mjs", ".ts", ".tsx", ".jsx")


def go_list(rows: DataFrame) -> DataFrame:
    """path, name, version, dep_type of a module list: objects one after the other, each at the start of a line; a module without a version, as the main one, goes."""
    objects = F.split(F.regexp_replace("content", r"\r\n?", "\n"), r"(?m)^(?=\{)")
    found = rows.select("path", F.explode(objects).alias("o")).select("path", F.regexp_extract("o", r'(?m)^\s*"Path"\s*:\s*"([^"]*)"', 1).alias("name"), F.regexp_extract("o", r'(?m)^\s*"Version"\s*:\s*"([^"]*)"', 1).alias("version"))
    return found.filter("name != '' and version != ''").select("path", "name", "version", F.lit("runtime").alias("dep_type"))


def _pattern(glob: Column) -> Column:
    """A workspace glob as a regular expression of folders: * is one name, ** any number."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(glob, r"^\./|/+$", ""), r"([.+?^$(){}|\[\]\\])", r"\\$1"), r"\*\*", "\u0001")
    return F.concat(F.lit("^"), F.replace(F.replace(plain, F.lit("*"), F.lit("[^/]+")), F.lit("\u0001"), F.lit(".+")), F.lit("$"))


def workspaces(manifests: DataFrame, globs: DataFrame) -> DataFrame:
    """project, folder, name: workspaces of a project: folders with a manifest that a glob names, without those that a glob with ! excludes; without globs, the root.

    manifests: project, folder, name (null: the folder's last part); globs: project, glob. Plain folders without a manifest are in missing_workspaces().
    """
    rows = manifests.join(globs.filter("not startswith(glob, '!')").withColumn("p", _pattern(F.col("glob"))), "project").filter(F.rlike("folder", "p"))
    shut = globs.filter("startswith(glob, '!')").select(F.col("project").alias("q"), _pattern(F.substring("glob", 2, 1 << 20)).alias("x"))
    rows = rows.join(shut, (F.col("project") == F.col("q")) & F.rlike("folder", "x"), "left_anti")
    named = manifests.join(globs.select("project").distinct(), "project", "left_anti").filter("folder = ''")
    found = rows.select("project", "folder", "name").union(named.select("project", "folder", "name")).distinct()
    return found.withColumn("name", F.coalesce("name", F.substring_index("folder", "/", -1)))


def missing_workspaces(manifests: DataFrame, globs: DataFrame) -> DataFrame:
    """project, folder: workspaces named without a pattern whose manifest is not there; the project is incomplete."""
    plain = globs.filter("not contains(glob, '*') and not startswith(glob, '!')").select("project", F.regexp_replace("glob", r"^\./|/+$", "").alias("folder"))
    return plain.join(manifests.select("project", "folder"), ["project", "folder"], "left_anti")


def entry_files(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """project, folder, file, kind (bin, exports, main): where a workspace's code starts.

    manifests: project, folder, content; files: project, path. An application (private, or with bin) starts at its bins and its main entry, a library
    at its main entry: the root export, else main, else the first index file there is. A path without an ending takes the first that is there.
    """
    get = lambda p: F.get_json_object("content", p)
    root = F.coalesce(get("$.exports['.'].import"), get("$.exports['.'].require"), get("$.exports['.'].default"), F.when(~F.startswith(get("$.exports['.']"), F.lit("{")), get("$.exports['.']")), F.when(~F.startswith(get("$.exports"), F.lit("{")), get("$.exports")))
    bins = F.coalesce(F.map_values(F.from_json(F.when(F.startswith(get("$.bin"), F.lit("{")), get("$.bin")), "map<string,string>")), F.when(get("$.bin") != "", F.array(get("$.bin"))), F.array().cast("array<string>"))
    app = (F.coalesce(get("$.private"), F.lit("")) == "true") | (F.size(bins) > 0)
    entry = lambda path, kind, rank: F.struct(path.alias("path"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))
    main = F.when(root != "", F.array(entry(root, "exports", 1))).when(get("$.main") != "", F.array(entry(get("$.main"), "main", 1))).otherwise(F.array(*[entry(F.lit(x), "main", 2 + i) for i, x in enumerate(INDEX)]))
    every = F.concat(F.transform(F.when(app, bins).otherwise(F.array().cast("array<string>")), lambda b: entry(b, "bin", 0)), main)
    rows = manifests.select("project", "folder", F.explode(every).alias("e")).select("project", "folder", "e.*")
    at = F.concat(F.when(F.col("folder") == "", "").otherwise(F.concat("folder", F.lit("/"))), F.regexp_replace("path", r"^(\./)+", ""))
    rows = rows.withColumn("at", at).withColumn("n", F.xxhash64("project", "folder", "path", "kind"))
    bare = ~F.col("at").rlike(r"\.[^./]+$")
    tries = F.concat(F.array(F.col("at")), F.when(bare, F.array(*[F.concat("at", F.lit(x)) for x in ENDINGS])).otherwise(F.array().cast("array<string>")))
    known = files.select("project", F.col("path").alias("file")).distinct().withColumn("there", F.lit(True))
    found = rows.select("*", F.posexplode(tries).alias("k", "file")).join(known, ["project", "file"], "left")
    best = found.groupBy("project", "folder", "path", "kind", "rank", "at").agg(F.min_by("file", F.when(F.col("there"), F.col("k"))).alias("file"))
    best = best.filter((F.col("rank") < 2) | F.col("file").isNotNull()).withColumn("file", F.coalesce("file", "at"))
    index = best.filter("rank >= 2").groupBy("project", "folder").agg(F.min_by("file", "rank").alias("file")).select("project", "folder", "file", F.lit("main").alias("kind"))
    return best.filter("rank < 2").select("project", "folder", "file", "kind").union(index).distinct()


def reduced_scope(reached: DataFrame, closures: DataFrame) -> DataFrame:
    """project, could_reach: all that reached packages without readable sources depend on, as one scoped frontier. reached: project, package; closures: project, package, dep."""
    rows = reached.join(closures, ["project", "package"]).select("project", "dep").distinct()
    return rows.groupBy("project").agg(F.array_sort(F.collect_set("dep")).alias("could_reach"))


def named_weaknesses(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows (id, cwes) with their names where they are known, in order. names: cwe, name."""
    found = rows.select("id", F.posexplode("cwes").alias("pos", "cwe")).join(names, "cwe", "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(": ", "cwe", "name").alias("t")))), lambda x: x["t"]), "; ")
    return found.groupBy("id").agg(text.alias("weaknesses"))
