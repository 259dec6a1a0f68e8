import pytest

from skarn.operators.javaparse import parse
from skarn.operators.search import Pattern, locate, occurrences_of
from skarn.sources.files import in_memory


def refs(body, kind="TYPE_REFERENCE", head="import a.Far;\n"):
    source = f"{head}class C {{ Object m(Object o) {{ {body} }} }}"
    found = parse(source)
    assert not [f for f in found if f["rel"] == "diagnostics"], [f["message"] for f in found if f["rel"] == "diagnostics"]
    skip = ("Object", "a.Far")
    return sorted((f["name"], source[f["start"] : f["end"]]) for f in found if f["rel"] == "type_refs" and f["kind"] == kind and source[f["start"] : f["end"]] not in ("Object", "import a.Far;") and (f["name"] not in skip or f["name"] == "a.Far"))


@pytest.mark.parametrize(
    "body, want",
    [
        ("run(Foo.class);", [("Foo", "Foo")]),
        ("run(Far.class, p.q.Bar.class);", [("a.Far", "Far"), ("p.q.Bar", "p.q.Bar")]),
        ("run(Foo[][].class);", [("Foo", "Foo")]),
        ("try { x(); } catch (AEx | p.BEx e) { y(e); }", [("AEx", "AEx"), ("p.BEx", "p.BEx")]),
        ("try { x(); } catch (final AEx e) { y(e); }", [("AEx", "AEx")]),
        ("run(() -> { try { x(); } catch (AEx | BEx e) { y(e); } }, Foo.class);", [("AEx", "AEx"), ("BEx", "BEx"), ("Foo", "Foo")]),
        ("switch (o) { case Foo f -> x(f); case Bar b when b.ok() -> y(); case Baz z: w(); }", [("Bar", "Bar"), ("Baz", "Baz"), ("Foo", "Foo")]),
        ("switch (o) { case Point(int x, Bar y) -> x(); case RED -> y(); case BLUE, GREEN -> z(); }", [("Bar", "Bar"), ("Point", "Point")]),
        ("this.<Bar>m(o);", [("Bar", "Bar")]),
        ("Util.<Bar, List<Foo>>m(o);", [("Bar", "Bar"), ("Foo", "Foo"), ("List", "List")]),
        ("run((Foo & Bar) o);", [("Bar", "Bar"), ("Foo", "Foo")]),
        ("boolean x = (a & b) != c;", []),
        ("if ((flags & MASK) == 0) { x(); }", []),
    ],
)
def test_forms_that_name_a_type(body, want):
    assert refs(body) == want


def test_ranges():
    source = "import java.util.List;\nimport static a.B.c;\nenum E { ONE(1) { void m() {} }, TWO }"
    found = [(f["kind"], f["name"], source[f["start"] : f["end"]]) for f in parse(source) if f["rel"] == "type_refs"]
    assert ("TYPE_REFERENCE", "java.util.List", "import java.util.List;") in found and ("TYPE_REFERENCE", "a.B.c", "import static a.B.c;") in found
    assert [x for k, n, x in found if k == "CONSTRUCTOR_INVOCATION" and n == "E"] == ["ONE(1) { void m() {} }", "TWO"]


def test_deep_nesting_keeps_its_facts():
    deep = " ".join(f"class A{i} {{" for i in range(1500)) + " int x; " + "}" * 1500
    found = parse(deep)
    assert sum(f["rel"] == "types" for f in found) == 1500 and not [f for f in found if f["rel"] == "diagnostics"]
    parens = "class A { int x = " + "(" * 5000 + "1" + ")" * 5000 + "; }"
    assert sum(f["rel"] == "types" for f in parse(parens)) == 1


def test_what_is_too_deep_is_said(monkeypatch):
    from skarn.operators import javaparse

    monkeypatch.setattr(javaparse, "MOST_FRAMES", 1000)
    found = parse("class Top { int before; } " + " ".join(f"class A{i} {{" for i in range(2000)) + "}" * 2000)
    assert any(f.get("message") == "nested too deeply" for f in found) and any(f["rel"] == "types" and f["name"] == "Top" for f in found)


def test_this_and_super_calls(spark):
    source = "class A { A() { this(1); } A(int x) { } }\nclass B extends A { B() { super(2); } class In { In(int i) { } In() { this(3); } } void m() { this.m(); super.m(); } }"
    files = in_memory(spark, [("/A.java", source)])
    hits = lambda name: sorted(r.offset for r in locate(files, Pattern("CONSTRUCTOR", name, search_for="REFERENCES")).collect())
    assert hits("A") == [source.index("this(1)"), source.index("super(2)")] and hits("In") == [source.index("this(3)")] and hits("B") == []


def test_enum_constants_construct_their_enum():
    made = [o for o in occurrences_of("enum E { ONE(1), TWO; E(int i) {} E() {} }") if o[2] == "CONSTRUCTOR" and o[3] == "REFERENCE"]
    assert [(o[4], o[7]) for o in made] == [("E", "ONE(1)"), ("E", "TWO")]
