import datetime

from veristrata.streaming import watch


def test_watch(spark, tmp_path):
    schema = "project string, ecosystem string, name string, version string"
    own = spark.createDataFrame([("npm", "a", "X", [("1.0.0", "2.0.0", "")], [], False)], "ecosystem string, name string, advisory string, version_ranges array<struct<introduced:string,fixed:string,last_affected:string>>, versions array<string>, undecidable_ranges boolean")
    spark.createDataFrame([("p", "npm", "a", "1.5.0"), ("q", "npm", "a", "1.5.0"), ("q", "npm", "a", "2.0.0"), ("r", "npm", "a", "odd")], schema).write.parquet(f"{tmp_path}/in/one")
    deps = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    sink = lambda rows, k: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")
    for more in ((), ("s", "npm", "a", "1.0.0")):
        if more:
            spark.createDataFrame([more], schema).write.parquet(f"{tmp_path}/in/two")
        watch.watch(deps, lambda: own, sink, f"{tmp_path}/checkpoint").awaitTermination()
    got = {(r.project, r.verdict) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("p", 1), ("q", 1), ("r", 2), ("s", 1)}


def test_arrivals(spark, tmp_path):
    day = lambda d, h: datetime.datetime(2024, 1, d, h)
    schema = "source string, ts timestamp"
    for k, rows in enumerate(([("a", day(1, 1)), ("a", day(1, 5)), ("b", day(3, 0))], [("a", day(1, 2))], [("b", day(9, 0))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = watch.arrivals(events).writeStream.format("memory").queryName("arrived").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    out.awaitTermination()
    rows = {(r.window.start.day, r.source): r.n for r in spark.table("arrived").collect()}
    assert rows[1, "a"] >= 2 and rows[3, "b"] == 1
