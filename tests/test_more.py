from skarn.operators import diagnostics
from skarn.operators import index as ix
from skarn.operators.javaparse import comments
from skarn.sources import classpath
from skarn.sources.files import in_memory
from skarn.streaming.state import Lifecycle, State


def test_clients_are_isolated(spark):
    rows = spark.createDataFrame([("f", [1]), ("g", [2])], "file_path string, diagnostics array<int>")
    seen = []

    def broken(*_):
        raise ValueError

    assert diagnostics.send(rows, [broken, lambda p, d: seen.append((p, d))]) == 2
    assert sorted(seen) == [("f", [1]), ("g", [2])]


def test_projects_and_quality(spark):
    idx = ix.build(in_memory(spark, [("/p/A.java", "class A {}"), ("/q/B.java", "class B {"), ("/pq/C.java", "class C {}")]))
    assert {r.path for r in ix.remove_project(idx, "/p")["files"].collect()} == {"/q/B.java", "/pq/C.java"}
    q = ix.parse_quality(idx).first()
    assert (q.files, q.files_with_errors) == (3, 1) and q.errors >= 1


def test_comments(spark):
    got = comments(in_memory(spark, [("a", "/** d */ class A { // x\n /* y */ }"), ("b", None)])).orderBy("start").collect()
    assert [(r.start, r.end, r.javadoc) for r in got] == [(0, 8, True), (19, 23, False), (25, 32, False)]


def test_classpath_cache(spark, tmp_path):
    e = spark.createDataFrame([("p/1", "LIBRARY", "/a.jar", 0)], classpath.ENTRIES)
    assert classpath.read_cache(spark, str(tmp_path), "p/1").count() == 0
    classpath.write_cache(e, str(tmp_path), "p/1")
    assert classpath.read_cache(spark, str(tmp_path), "p/1").collect() == e.collect()
    projects = spark.createDataFrame([("p", "/w/p/")], "project string, project_path string")
    there = spark.createDataFrame([("/w/p/src/main/java",)], "path string")
    assert [r.path for r in classpath.conventional(projects, there).collect()] == ["/w/p/src/main/java"]


def test_lifecycle():
    life, heard = Lifecycle(), []
    life.listeners += [lambda *_: 1 / 0, lambda a, b: heard.append((a, b))]
    life.to(State.INDEXING)
    life.to(State.INDEXING)
    life.to(State.READY)
    assert heard == [(State.NOT_STARTED, State.INDEXING), (State.INDEXING, State.READY)]
