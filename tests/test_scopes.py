import pytest

from skarn.operators import scopes
from skarn.operators.javaparse import Parser
from skarn.operators.navigation import local_at
from skarn.operators.search import Pattern, locate, occurrences
from skarn.sources.files import in_memory


def kinds(source):
    """{(line, name): [kinds with the declaration's line]} of all simple names."""
    toks = Parser(source).toks
    s = scopes.Scoping(toks)
    bound, line, out = s.bound(), lambda k: source[: toks[k][2]].count("\n"), {}
    for k in s.uses():
        out.setdefault((line(k), toks[k][1]), []).append((bound[k].kind, line(bound[k].at)) if k in bound else None)
    return out


SOURCE = """class A { int f; static final Map<String, Integer> m = new HashMap<String, Integer>(), m2;
  A(int x) {
    f = 1;
    int f = 2; f++; this.f = x; m.get(f);
  }
  int g(Object o) {
    boolean c = o.x > f;
    if (o instanceof String s && s.length() > f) { return s.length(); }
    s.none();
    if (!(o instanceof Integer i)) { return 0; }
    int a = i, b = a + 1;
    for (int k = 0, z = 3; k < z; k++) { b += k; }
    for (String q : list) q.run(q);
    q.none();
    try (Reader r = open()) { r.read(); } catch (IOException | Foo e) { log(e); }
    switch (o) { case Foo y -> use(y); case Bar(int u, var v) when u > v -> { use(u, v); } default -> y.none(); }
    run(t -> t + f, t);
    go((p, q2) -> p + q2);
    Runnable rr = new Runnable() { int f; public void run() {
      f++; } };
    return f; }
  record P(int h, String j) { int sum() {
    return h + f; } }
  int last() { return f; }
}
"""


def test_innermost_scopes():
    got = kinds(SOURCE)
    assert got[2, "f"] == [("FIELD", 0)]  # before the local is declared
    assert got[3, "f"] == [("LOCAL", 3)] * 3 and got[3, "x"] == [("PARAMETER", 1)]
    assert got[6, "f"] == [("FIELD", 0)] and got[6, "o"] == [("PARAMETER", 5)]
    assert got[7, "s"] == [("PATTERN", 7)] * 3 and got[8, "s"] == [None]
    assert got[10, "i"] == [("PATTERN", 9)]  # where the test fails, the block is left
    assert got[10, "a"] == [("LOCAL", 10)] * 2 and got[11, "z"] == [("LOCAL", 11)] * 2 and got[11, "b"] == [("LOCAL", 10)]
    assert got[12, "q"] == [("LOCAL", 12)] * 3 and got[13, "q"] == [None]
    assert got[14, "r"] == [("LOCAL", 14)] * 2 and got[14, "e"] == [("PARAMETER", 14)] * 2
    assert got[15, "y"] == [("PATTERN", 15)] * 2 + [None] and set(got[15, "u"]) == set(got[15, "v"]) == {("PATTERN", 15)}
    assert got[16, "t"] == [("PARAMETER", 16)] * 2 + [None] and got[16, "f"] == [("FIELD", 0)]
    assert got[17, "p"] == got[17, "q2"] == [("PARAMETER", 17)] * 2
    assert got[19, "f"] == [("FIELD", 18)] and got[20, "f"] == [("FIELD", 0)]
    assert got[22, "h"] == [("FIELD", 21)] and got[22, "f"] == [("FIELD", 0)] and got[23, "f"] == [("FIELD", 0)]
    assert got[0, "m2"] == [("FIELD", 0)]


@pytest.mark.parametrize(
    "body, name, uses",
    [
        ("int a = 1; { int b = a; } int c = a;", "a", 2),
        ("for (int i : xs) { for (int j : ys) { i += j; } } int i = 3; i++;", "i", 1),
        ("boolean z = p > q; q = 2;", "q", None),
        ("while (!(o instanceof String s)) { o = next(); } s.length();", "s", 1),
        ("Object x = o instanceof String s ? s : null;", "s", 1),
        ("switch (o) { case String s: s.a(); break; case Integer s: s.b(); s.c(); }", "s", 1),
        ("if (o instanceof P(String s, Q(int n))) { s.a(n); }", "n", 1),
        ("int[] a[] = {}, b = a; b.c();", "b", 1),
        ("List<Map<String, ? extends T[]>> l = x; l.add(1);", "l", 1),
        ("F f = (int a, final String b) -> { return a + b; };", "b", 1),
        ("var v = 1; v = 2; o.v = 3; v();", "v", 1),
        ("@Some(1) final int v = 1; v = 2;", "v", 1),
    ],
)
def test_forms(body, name, uses):
    source = "class C { void m(Object o) {\n" + body + "\n} }"
    toks = Parser(source).toks
    s = scopes.Scoping(toks)
    bound = s.bound()
    mine = [k for k in s.uses() if toks[k][1] == name]
    if uses is None:
        assert not [k for k in mine if k in bound]
    else:
        assert sum(bound.get(k) == bound[mine[0]] for k in mine) - 1 == uses


def test_fields_that_locals_shadow(spark):
    source = "class A { int f; A(int x){ int f = 2; f++; } int g() { return f; } }"
    files = in_memory(spark, [("/A.java", source)])
    found = locate(files, Pattern("FIELD", "f")).collect()
    assert sorted((r.offset, r.kind) for r in found) == [(14, "FIELD_DECLARATION"), (source.rindex("f"), "FIELD_REFERENCE")]


def test_pattern_variables_are_locals():
    source = "class A { void m(Object o) { if (o instanceof String s) { s.length(); } } }"
    uses, declaration = local_at(source, 0, source.index("s.length"))
    assert uses == [(source.index("s.length"), 1)] and declaration == (source.index("s)"), 1)


def test_all_names_at_once(spark):
    """The join over tables gives what each file's own stack gives, whatever the offsets."""
    more = "/* 😀 */" + SOURCE.replace("class A", "class Z")
    files = in_memory(spark, [("/A.java", SOURCE), ("/Z.java", more), ("/E.java", ""), ("/N.java", None)])
    got = {(r.path, r.start): (r.name, r.kind, r.declared_start) for r in scopes.bound_names(files).collect()}
    for path, text in (("/A.java", SOURCE), ("/Z.java", more)):
        toks = Parser(text).toks
        s = scopes.Scoping(toks)
        bound, unit = s.bound(), lambda k: len(text[: toks[k][2]].encode("utf-16-le")) // 2
        want = {(path, unit(k)): (toks[k][1], bound[k].kind if k in bound else None, unit(bound[k].at) if k in bound else None) for k in s.uses() if k not in {d.at for d in s.scopes}}
        assert {k: v for k, v in got.items() if k[0] == path} == want
    assert len({p for p, _ in got}) == 2


def test_files_that_fail_are_named(spark):
    """A worker that is made to fail gives a row with the cause, and the other files' rows."""
    deep = "class A { int x = " + "new Object() { Object y = " * 900 + "0;" + "};" * 900 + "}"
    files = in_memory(spark, [("/deep.java", deep), ("/ok.java", "class B { int f; int g() { return f; } }")])
    rows = scopes.scopes(files).collect()
    assert {r.path for r in rows} == {"/deep.java", "/ok.java"}
    found = occurrences(files).collect()
    assert {r.path for r in found} == {"/deep.java", "/ok.java"}


def test_rubbish_is_survived():
    import random

    r = random.Random(7)
    parts = ["class", "A", "{", "}", "(", ")", "<", ">", "->", "instanceof", "case", "x", "=", ",", ";", "int", "for", "if", "!", "new", "record", "try", "catch", ".", "[", "]", ":", "@"]
    for _ in range(600):
        scopes.scope_rows(" ".join(r.choice(parts) for _ in range(r.randint(1, 50))))
