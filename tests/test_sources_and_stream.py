from pyspark.sql import functions as F

from skarn.sources import classpath
from skarn.sources.files import from_uri, to_uri
from skarn.streaming import refresh


def test_eclipse_classpath(spark, tmp_path):
    f = tmp_path / ".classpath"
    f.write_text('<classpath><classpathentry kind="src" path="src"/><classpathentry kind="con" path="JRE"/><classpathentry kind="lib" path="/x/a.jar"/><classpathentry kind="output" path="bin"/></classpath>')
    files = classpath.read_hidden(spark, "p", str(tmp_path)).withColumn("project_path", F.lit("/w/p/"))
    got = classpath.eclipse(files).orderBy("ordinal").collect()
    assert [(r.type, r.path) for r in got] == [("SOURCE", "/w/p/src"), ("LIBRARY", "/x/a.jar"), ("SOURCE", "/w/p/bin")]
    there = spark.createDataFrame([("/x/a.jar",)], "path string")
    assert classpath.existing(classpath.eclipse(files), there).count() == 1


def test_build_output(spark):
    lines = spark.createDataFrame([("p", "[INFO] a: b"), ("p", "/a.jar:/b.jar: /a.jar "), ("p", "done")], "project string, line string")
    assert [r.path for r in classpath.build_output(lines).orderBy("ordinal").collect()] == ["/a.jar", "/b.jar"]


def test_discovery_and_caches(spark):
    acc = spark.createDataFrame([("p", "maven"), ("p", "eclipse"), ("q", "eclipse")], "project string, discoverer string")
    assert {r.project: r.discoverer for r in classpath.discover(acc).collect()} == {"p": "maven", "q": "eclipse"}
    caches = spark.createDataFrame([("p", 5), ("q", 5)], "project string, mtime_ms long")
    src = spark.createDataFrame([("p", 5), ("q", 6)], "project string, mtime_ms long")
    assert [r.project for r in classpath.valid_caches(caches, src).collect()] == ["p"]


def test_uris(spark):
    df = spark.createDataFrame([("/a b/C.java",)], "p string")
    r = df.select(to_uri(F.col("p")).alias("u"), from_uri(to_uri(F.col("p"))).alias("p")).first()
    assert r.u == "file:///a%20b/C.java" and r.p == "/a b/C.java"


def test_stream_merges_changes(spark, tmp_path):
    inbox, store = tmp_path / "in", str(tmp_path / "facts")
    schema = "path string, mtime_ms long, kind string, content string"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(inbox))
        q = refresh.follow(spark.readStream.schema(schema).json(str(inbox)), store, str(tmp_path / "cp"), once=True)
        q.awaitTermination()
        return {(r.path, r.name) for r in refresh.current(spark, store).where("rel = 'types'").collect()}

    assert put([("A", 1, "FILE_UPDATED", "class A {}"), ("B", 1, "FILE_UPDATED", "class B {}")]) == {("A", "A"), ("B", "B")}
    assert put([("A", 2, "FILE_UPDATED", "class Old {}"), ("A", 3, "FILE_UPDATED", "class A2 {}"), ("B", 4, "FILE_REMOVED", None)]) == {("A", "A2")}


def test_edits_are_counted_exactly(spark, tmp_path):
    from pyspark.sql import functions as F

    from skarn.streaming.refresh import edits_per_project

    n = {p: 19 + 40 * p for p in range(25)}
    rows = [(p, f"f{k}") for p in n for k in [*range(n[p]), 0, 1]]
    changes = spark.createDataFrame(rows, "project int, path string").withColumn("ts", F.lit("2026-01-01 00:00:01").cast("timestamp"))
    assert {r.project: r.edited for r in edits_per_project(changes).collect()} == n
    changes.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(changes.schema).parquet(f"{tmp_path}/in")
    q = edits_per_project(stream).writeStream.format("memory").queryName("edits").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.project: r.edited for r in spark.table("edits").collect()} == n
