import time

from pyspark.sql import functions as F

from skarn.operators import diagnostics
from skarn.operators import index as ix
from skarn.operators.javadoc import doc_tags, tag_rows
from skarn.operators.javaparse import extract, node_rows, nodes, parse
from skarn.operators.navigation import covering_nodes, references
from skarn.sources.files import in_memory
from tests.test_java import CORPUS

DOC = '''package p;
/**
 * Finds a {@link User#name name}, or {@code {x} @param} none. 😀
 *
 * @param <T> the type
 * @param key the {@linkplain java.util.Map#get(Object, int) key of {@code k}} to
 *     look for
 * @throws java.io.IOException if it {@code fails}
 * @see #other(int, String)
 * @since 1.2
 * @custom.tag any {@unknown thing} at all
 * {@snippet lang=java :
 *   if (a) { @b(); }
 * }
 * @return nothing {@inheritDoc}
 */
class A { /** {@value} */ int x; /***/ int y; /** open {@code never ends */ int z; }
'''


def test_tags():
    rows = tag_rows(DOC)
    unit = DOC.encode("utf-16-le")
    cut = lambda s, e: unit[2 * s : 2 * e].decode("utf-16-le")
    first = [r for r in rows if r[0] == DOC.index("/**")]
    assert [(r[1], r[2], r[3]) for r in first] == [(0, None, None), (1, "@param", "<T>"), (2, "@param", "key"), (3, "@throws", "java.io.IOException"), (4, "@see", "#other(int, String)"), (5, "@since", None), (6, "@custom.tag", None), (7, "@return", None)]
    kinds = lambda r: [(f[0], f[1], f[2], f[6]) for f in r[7]]
    assert kinds(first[0]) == [("TEXT", None, None, 0), ("INLINE", "@link", "User#name", 0), ("TEXT", None, None, 0), ("INLINE", "@code", None, 0), ("TEXT", None, None, 0)]
    assert first[0][7][3][3] == "{x} @param" and first[0][7][4][3] == "none. 😀"
    assert kinds(first[2]) == [("TEXT", None, None, 0), ("INLINE", "@linkplain", "java.util.Map#get(Object, int)", 0), ("TEXT", None, None, 1), ("INLINE", "@code", None, 1), ("TEXT", None, None, 0)]
    assert first[2][4] == "the {@linkplain java.util.Map#get(Object, int) key of {@code k}} to look for"
    snippet = [f for f in first[6][7] if f[0] == "SNIPPET"][0]
    assert "if (a) { @b(); }" in snippet[3] and cut(snippet[4], snippet[5]).startswith("{@snippet") and cut(snippet[4], snippet[5]).endswith("}")
    for r in rows:
        assert r[2] is None or cut(r[5], r[6]).startswith(r[2])
        for f in r[7]:
            assert f[1] is None or cut(f[4], f[5]).startswith("{" + f[1])
    rest = [r for r in rows if r[0] != DOC.index("/**")]
    assert [(r[2], [(f[0], f[3]) for f in r[7]]) for r in rest] == [(None, [("INLINE", "")]), (None, [("TEXT", "open {@code never ends")])]


def test_tags_table(spark):
    far = "/* " + "x" * 70_000 + " */\n" + DOC
    out = doc_tags(in_memory(spark, [("/A.java", DOC), ("/Far.java", far), ("/N.java", None), ("/E.java", "class E {}")]))
    a, b = (sorted((r.ordinal, r.tag or "", r.start, r.end, len(r.fragments)) for r in out.where(F.col("path") == p).collect()) for p in ("/A.java", "/Far.java"))
    shift = len(far) - len(DOC)
    assert a and [(o, t, s + shift, e + shift, n) for o, t, s, e, n in a] == b
    assert out.where("tag = '@param'").select(F.expr("exists(fragments, f -> f.tag = '@linkplain')").alias("x")).where("x").count() == 2


def test_declarations_without_bodies():
    source = "package p; import a.B; class A<T> extends B { int x = f(() -> new C() { int no; }), y; A() { new D(); } static { g(); } @E(1) void m(B b) throws F { int local = 1; class L {} } enum G { ONE(1) { void q() {} }, TWO; int z; } }"
    early, whole = parse(source, bodies=False), parse(source)
    of = lambda facts, rel: {(f["name"], f["owner"]) for f in facts if f["rel"] == rel}
    assert of(early, "types") == {("p.A", "A"), ("p.A$G", "G")} and of(whole, "types") >= of(early, "types")
    assert of(early, "fields") == {("x", "p.A"), ("y", "p.A"), ("ONE", "p.A$G"), ("TWO", "p.A$G"), ("z", "p.A$G")}
    assert of(early, "methods") == {("A", "p.A"), ("m", "p.A"), ("q", "p.A$G")}
    assert not [f for f in early if f["rel"] == "diagnostics"] and not [f for f in parse("class A { void f() { int x = 1 } }", diagnose=False) if f["rel"] == "diagnostics"]


def test_phases_are_jobs_of_their_own(spark):
    body = " ".join(f"int v{k} = call{k}(a.b, c -> c + {k}); if (v{k} > 0) {{ run(new Foo(v{k})); }}" for k in range(60))
    files = in_memory(spark, [(f"/w/F{i}.java", f"package w; class F{i} {{ int f; void m() {{ {body} }} }}") for i in range(40)])
    seen = []

    def ready(index):
        seen.append((index["types"].count(), index["methods"].count(), index["diagnostics"].count()))

    whole = ix.build_in_phases(files, ["a.jar"], ready)
    assert seen == [(40, 80, 0)] and whole["types"].count() == 40 and whole["type_refs"].where("target = 'Foo'").count() > 0
    one = files.first().content
    took = []
    for bodies in (False, True):
        began = time.perf_counter()
        for _ in range(20):
            parse(one, bodies)
        took.append(time.perf_counter() - began)
    assert took[0] < 0.7 * took[1]
    assert extract(files, bodies=False).count() < extract(files).count() / 10


def test_nodes(spark):
    source = "package p; class A { int x; void m() { int y = x; } class B { String s; } } class C { void bad() { int q = 1 } }"
    rows = node_rows(source)
    assert [r[4] for r in rows] == list(range(len(rows)))
    for r in rows:
        if r[7] is not None:
            up = rows[r[7]]
            assert up[4] < r[4] <= up[5] and r[6] == up[6] + 1 and up[2] <= r[2]
    around = {r[1]: r[8] for r in rows if r[0] == "fields"}
    assert around == {"x": "p.A", "s": "p.A$B"}
    table = nodes(in_memory(spark, [("/A.java", source), ("/N.java", None)]))
    q = ix.node_quality(table).first()
    assert q.nodes == len(rows) and q.erroneous == 1 and q.error_types == 1 and q.percent == round(100 / len(rows), 4)
    at = source.index("s; }")
    ranges = spark.createDataFrame([("/A.java", at, at + 1), ("/A.java", 0, 5)], "path string, at int, upto int")
    inner = covering_nodes(ranges, table.where("kind in ('types', 'methods')"), ["path"]).collect()
    assert [(r.start, r.end) for r in inner] == [next((x[2], x[3]) for x in rows if x[1] == "p.A$B")]


def test_file_metadata_and_stored_diagnostics(spark):
    idx = ix.build(in_memory(spark, [*CORPUS, ("/p/Empty.java", "")], 7))
    asked = spark.createDataFrame([("/p/User.java",), ("/p/Empty.java",), ("/none",)], "path string")
    assert {r.path: (r.indexed, r.types, r.mtime_ms) for r in ix.file_metadata(idx, asked).collect()} == {"/p/User.java": (True, ["m.User"], 7), "/p/Empty.java": (True, [], 7), "/none": (False, None, 0)}
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "file_path string, line int")
    fresh = spark.createDataFrame([("b", 9)], "file_path string, line int")
    out = diagnostics.store(rows, fresh, spark.createDataFrame([("a",), ("b",)], "path string"))
    assert [tuple(r) for r in out.collect()] == [("b", 9)] and [r.path for r in diagnostics.files_with_diagnostics(out).collect()] == ["b"]


def test_removal_as_the_reference_does_it(spark):
    files = in_memory(spark, [("/a/A.java", "package p; class A { int x; void m() {} }"), ("/b/A.java", "package p; class A { int y; }"), ("/c/C.java", "package p; class C { int z; }")])
    idx = ix.build(files)
    gone = idx["files"].where("path = '/a/A.java'")
    left = lambda compat: ({r.field_name for r in ix.remove_files(idx, gone, compat)["fields"].collect()}, ix.remove_files(idx, gone, compat)["types"].count())
    assert left(False) == ({"y", "z"}, 2) and left(True) == ({"z"}, 1)


def test_references_of_one_kind(spark):
    files = in_memory(spark, CORPUS)
    idx = ix.build(files)
    line = CORPUS[2][1].split("\n")[1]
    at = ("/p/Main.java", 1, line.index("getName") + 2)
    assert references(idx, files, *at, include_declaration=True).count() == 3
    assert {r.kind for r in references(idx, files, *at, include_declaration=True, kind="DECLARATION").collect()} == {"METHOD_DECLARATION"}
