import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.operators import batching, diagnostics, hierarchy, maintain

TYPES = "qualified_name string, simple_name string, package_name string, kind string, superclass string, interfaces array<string>"


def types(spark, rows):
    return spark.createDataFrame([(q, q.split(".")[-1], ".".join(q.split(".")[:-1]), k, s, i) for q, k, s, i in rows], TYPES)


def names(df):
    return sorted(r[0] for r in df.collect())


def test_hierarchy(spark):
    t = types(spark, [("Animal", "CLASS", "Object", []), ("Dog", "CLASS", "Animal", ["Pet"]), ("Cat", "CLASS", "Animal", []), ("Pup", "CLASS", "Dog", [])])
    assert names(hierarchy.direct(hierarchy.subtype_edges(t), "Animal")) == ["Cat", "Dog"]
    assert names(hierarchy.all_subtypes(t, "Object")) == ["Animal", "Cat", "Dog", "Pup"]
    assert names(hierarchy.all_implementors(t, "Pet")) == ["Dog"]
    assert names(hierarchy.all_implementors(t, "Pet", compat=False)) == ["Dog", "Pup"]


def test_cycles_end_and_include_the_root(spark):
    t = types(spark, [("A", "CLASS", "C", []), ("B", "CLASS", "A", []), ("C", "CLASS", "B", [])])
    assert names(hierarchy.all_subtypes(t, "A")) == ["A", "B", "C"]


def test_unqualified_parents(spark):
    t = types(spark, [("p.Base", "CLASS", None, []), ("p.Mid", "CLASS", "Base", []), ("p.Leaf", "CLASS", "Mid", [])])
    assert names(hierarchy.all_subtypes(t, "Base")) == ["p.Mid"]
    assert names(hierarchy.all_subtypes(hierarchy.qualified_superclasses(t), "p.Base")) == ["p.Leaf", "p.Mid"]


def test_interfaces_that_extend_interfaces_end_the_walk(spark):
    t = types(spark, [("B", "INTERFACE", None, []), ("A", "INTERFACE", None, ["B"]), ("X", "CLASS", None, ["A"])])
    assert names(hierarchy.all_implementors(t, "B")) == ["A"]
    assert names(hierarchy.all_implementors(t, "B", compat=False)) == ["A", "X"]


@pytest.mark.parametrize(
    "sizes, expected",
    [
        ([("a", 160)], [160]), ([("a", 301)], [300, 1]), ([("a", 49), ("b", 300)], [349]), ([("a", 50), ("b", 300)], [50, 300]),
        ([("a", 100), ("b", 60)], [100, 60]), ([("a", 20), ("b", 350)], [20, 300, 50]), ([], []),
    ],
)
def test_batches(sizes, expected):
    assert [sum(n for _, _, n in b) for b in batching.pack(sizes)] == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=12))
def test_batches_hold_every_file_once(sizes):
    got = batching.pack([(str(i), n) for i, n in enumerate(sizes)])
    seen = sorted((p, f + k) for b in got for p, f, n in b for k in range(n))
    assert seen == sorted((str(i), k) for i, n in enumerate(sizes) for k in range(n))
    assert all(sum(n for _, _, n in b) < batching.LARGEST + batching.SMALLEST for b in got)


def test_split_renumbers_flagged_batches(spark):
    rows = [(1, f"a{i:03}", f"p{i // 90}") for i in range(270)] + [(2, f"b{i:03}", "p0") for i in range(250)] + [(5, f"c{i:03}", "q") for i in range(310)]
    b = spark.createDataFrame(rows, "batch_id int, file_id string, package string")
    out = batching.split(b)
    assert out.dtypes == b.dtypes
    got = {r.file_id: r.batch_id for r in out.collect()}
    want = {f: 2 if k == 2 else (6 + int(p[1]) if k == 1 else 9 + (int(f[1:]) >= 300)) for k, f, p in rows}
    assert got == want and out.count() == len(rows)
    few = b.where("batch_id = 2")
    assert sorted(batching.split(few).collect()) == sorted(few.collect())


def test_diagnostic_filters(spark):
    rows = [(1, 7, "Ignore", None, 3), (2, 7, "Optional", [], 3), (3, 96, "Warning", ["a.B", "java.io.Externalizable"], 3), (4, 96, "Warning", ["java.io.Serializable"], 3), (5, 7, "Error", ["java.io.Externalizable"], 0), (6, 7, "Error", None, None), (7, 96, "Warning", None, 1)]
    df = spark.createDataFrame(rows, "id int, problem_id int, severity string, interfaces array<string>, start int")
    assert sorted(r.id for r in diagnostics.filtered(df, serial_version=96).collect()) == [4, 5, 7]


def test_plan_and_chunks(spark):
    files = spark.createDataFrame([("p", pkg, i) for i, pkg in enumerate(["x"] * 100 + ["y"] * 60)], "project string, package string, pos long")
    plan = sorted((r.batch, r.package, r.files) for r in batching.plan_batches(files, ["project"]).collect())
    assert plan == [(0, "x", 100), (1, "y", 60)]
    got = {r.pos: r.chunk for r in batching.chunks(files, ["pos"]).collect()}
    assert got == {i: i // 100 for i in range(160)}


def test_batch_maintenance(spark):
    rows = [(1, f"a{i}", "p") for i in range(260)] + [(2, f"b{i}", "p") for i in range(90)] + [(3, f"c{i}", "p") for i in range(100)]
    b = spark.createDataFrame(rows, "batch_id int, file_id string, package string")
    s = {r.batch_id: (r.needs_split, r.may_merge) for r in batching.state(b).collect()}
    assert s == {1: (True, False), 2: (False, True), 3: (False, False)}
    assert [(r.batch_id, r.into) for r in batching.merge_targets(b).collect()] == [(2, 3)]
    new = spark.createDataFrame([("n", "p"), ("m", "q")], "file_id string, package string")
    assert {r.file_id: r.batch_id for r in batching.attach_new(b, new).collect()} == {"n": 2, "m": None}


def test_change_scan(spark):
    old = spark.createDataFrame([("a", 1), ("b", 5), ("c", 5), ("d", 5)], "path string, mtime_ms long")
    new = spark.createDataFrame([("a", 1), ("b", 6), ("c", 4), ("e", 1)], "path string, mtime_ms long")
    assert {r.path: r.status for r in maintain.change_scan(old, new).collect()} == {"b": "changed", "d": "deleted", "e": "new"}


def test_interning_keeps_known_ids(spark):
    first = maintain.intern(spark.createDataFrame([("b",), ("a",), ("b",)], "path string"))
    assert {r.path: r.file_id for r in first.collect()} == {"a": 0, "b": 1}
    more = maintain.intern(spark.createDataFrame([("c",), ("a",)], "path string"), first)
    assert {r.path: r.file_id for r in more.collect()} == {"a": 0, "b": 1, "c": 2}


def test_rebatch_after_twenty_files(spark):
    edits = spark.createDataFrame([("p", str(i % 19)) for i in range(40)] + [("q", str(i)) for i in range(20)], "project string, path string")
    assert {r.project: r.rebatch for r in maintain.needs_rebatch(edits).collect()} == {"p": False, "q": True}


def test_diagnostics(spark):
    d = spark.createDataFrame([("f", 1, "m", 3, 0, 5, 7, None), ("f", 2, "n", 0, 0, 1, 1, None)], "file_path string, severity int, message string, line int, col int, start int, end int, code string")
    p = {r.message: r for r in diagnostics.protocol(d).collect()}
    assert p["m"].start.line == 2 and p["m"].end.character == 1 and p["n"].start.line == 0
    assert len(diagnostics.publish(d).first().diagnostics) == 2
    j = diagnostics.to_json(d).union(spark.createDataFrame([("f", "{broken")], "file_path string, json string"))
    assert diagnostics.from_json(j).count() == 2
    rows = spark.createDataFrame([("compiler.err.x", "ERROR"), ("k2", "ERROR"), ("gone", "ERROR"), ("odd", "WARNING")], "code string, kind string")
    codes = spark.createDataFrame([("k2", [1, 2]), ("gone", [-1])], "code string, ids array<int>")
    assert sorted((r.code, r.problem_id) for r in diagnostics.mapped(rows, codes).collect()) == [("compiler.err.x", 0), ("k2", 1), ("k2", 2)]
