"""Java sources to index facts: a tokenizer, a declaration parser and a scanner of bodies.

parse(source) gives one file's facts; extract(files) does so for a DataFrame of files, one batch at a time.
The parser knows declarations and type positions.  Expression bodies are scanned for names, `new`, `::`,
annotations, `super`, lambdas and local declarations; there is no expression grammar and no type checking.
Anything unreadable is skipped and reported, never raised.

Offsets are UTF-16 units, ends are exclusive, lines count from 1 and columns from 0.
"""

from __future__ import annotations

import bisect
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from skarn.functions.predicates import MODIFIERS

_TOKEN = re.compile(
    r"""(?P<ws>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>\"{3}(?:\\.|(?!\"{3}).)*(?:\"{3}|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))"""
    r"""|(?P<num>(?:\d|\.\d)(?:[eEpP][+-]|[\w.])*)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>::|->|\.\.\.|&&|\|\||\+\+|--|[<>=!+\-*/&|^%]=|.)""",
    re.DOTALL,
)
_PRIMITIVE = frozenset("boolean byte char short int long float double void".split())
_KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
_DOC_NAME = re.compile(r"@(?:param|throws|exception|see|link|linkplain|value)\s+<?([A-Za-z_$][\w$.]*)?(?:#([A-Za-z_$][\w$]*))?")

#: Calls that one level of brackets takes at most, and those that a file may take; a deeper file keeps what was found above.
FRAMES, MOST_FRAMES = 8, 200_000

FACTS = (
    "path string, rel string, name string, owner string, package_name string, kind string, modifiers int, superclass string, items array<string>, "
    "type string, is_constructor boolean, start int, end int, line int, col int, message string"
)
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (c.strip().split(" ") for c in FACTS.split(","))])


class _Stop(Exception):
    pass


class Parser:
    """Facts of one source text, as dicts of FACTS columns without the path.

    Without bodies, only declarations outside of blocks and initialisers are read, and nothing is diagnosed.
    """

    def __init__(self, source: str, bodies: bool = True, diagnose: bool = True):
        self.source, self.bodies, self.diagnose = source, bodies, diagnose and bodies
        self.facts: list[dict] = []
        self.imports: dict[str, str] = {}
        self.package = ""
        self.toks: list[tuple[str, str, int, int]] = []
        self.docs: list[tuple[int, int]] = []
        self.comments: list[tuple[int, int]] = []
        for m in _TOKEN.finditer(source):
            kind = m.lastgroup
            if kind == "comment":
                self.comments.append(m.span())
                if m[0].startswith("/**") and len(m[0]) > 4:
                    self.docs.append(m.span())
                if m[0].startswith("/*") and not (m[0].endswith("*/") and len(m[0]) > 3):
                    self.problem("unterminated comment", *m.span())
            elif kind != "ws":
                self.toks.append((kind, m[0], m.start(), m.end()))
                if kind == "text" and not self._closed(m[0]):
                    self.problem("unterminated literal", *m.span())
        self.i = 0
        self.scope: list[str] = []

    @staticmethod
    def _closed(s: str) -> bool:
        q = '"""' if s.startswith('"""') else s[0]
        return len(s) >= 2 * len(q) and s.endswith(q)

    # tokens
    def at(self, k: int = 0) -> str:
        j = self.i + k
        return self.toks[j][1] if 0 <= j < len(self.toks) else ""

    def kind(self, k: int = 0) -> str:
        j = self.i + k
        return self.toks[j][0] if 0 <= j < len(self.toks) else ""

    def is_name(self, k: int = 0) -> bool:
        return self.kind(k) == "name" and self.at(k) not in _KEYWORDS

    def here(self) -> int:
        return self.toks[self.i][2] if self.i < len(self.toks) else len(self.source)

    def before(self) -> int:
        return self.toks[self.i - 1][3] if self.i else 0

    def take(self) -> tuple[str, str, int, int]:
        if self.i >= len(self.toks):
            raise _Stop
        self.i += 1
        return self.toks[self.i - 1]

    def accept(self, text: str) -> bool:
        if self.at() == text and self.kind() != "text":
            self.i += 1
            return True
        return False

    def skip_pair(self, opening: str, closing: str) -> None:
        depth = 0
        while self.i < len(self.toks):
            kind, t, *_ = self.take()
            depth += kind == "op" and (t == opening) - (t == closing)
            if depth == 0:
                return

    # facts
    def add(self, rel: str, start: int, end: int, **columns) -> None:
        self.facts.append({"rel": rel, "start": start, "end": end, **columns})

    def problem(self, message: str, start: int, end: int) -> None:
        self.add("diagnostics", start, max(end, start + 1), message=message, kind="ERROR")

    def name(self, tok: tuple[str, str, int, int]) -> str:
        self.add("name_refs", tok[2], tok[3], name=tok[1], kind="NAME_REFERENCE")
        return tok[1]

    def ref(self, target: str, kind: str, start: int, end: int) -> None:
        self.add("type_refs", start, end, name=target, kind=kind)

    def resolve(self, name: str) -> str:
        """By single-type imports only; other simple names stay simple."""
        return name if "." in name else self.imports.get(name, name)

    def qualified(self, simple: str) -> str:
        inner = "$".join([*self.scope, simple])
        return f"{self.package}.{inner}" if self.package else inner

    def owner(self) -> str:
        inner = "$".join(self.scope)
        return f"{self.package}.{inner}" if self.package else inner

    # unit
    def run(self) -> list[dict]:
        depth = deepest = 0
        for _, t, *_ in self.toks:
            depth += (t in ("(", "{", "[", "<")) - (t in (")", "}", "]", ">"))
            deepest = max(deepest, depth)
        held = sys.getrecursionlimit()
        sys.setrecursionlimit(max(held, min(1000 + FRAMES * deepest, MOST_FRAMES)))
        try:
            self.unit()
        except _Stop:
            self.problem("unexpected end of file", max(0, len(self.source) - 1), len(self.source))
        except RecursionError:  # what was found so far stays
            self.problem("nested too deeply", self.here(), self.here() + 1)
        finally:
            sys.setrecursionlimit(held)
        if self.bodies:
            for s, e in self.docs:
                self.doc_names(s, e)
        if self.diagnose:
            self.balance()
            self.statements()
        else:
            self.facts = [f for f in self.facts if f["rel"] != "diagnostics"]
        return self.located()

    def unit(self) -> None:
        while self.i < len(self.toks):
            start = self.i
            mods, notes, at = self.modifiers()
            t = self.at()
            if t == "package":
                self.take()
                parts = []
                while self.at() not in (";", "") and (self.kind() == "name" or self.at() == "."):
                    parts.append(self.take()[1])
                self.package = "".join(parts)
                self.semicolon()
            elif t == "import":
                self.import_()
            elif self.type_start():
                self.type_decl(mods, at)
            elif t == ";":
                self.take()
            else:
                self.problem(f"unexpected token {t}", self.here(), self.here() + len(t))
                self.take()
                while self.i < len(self.toks) and not self.type_start() and self.at() not in ("import", "@", "public", "final", "abstract"):
                    self.take()
            if self.i == start:
                self.take()

    def semicolon(self) -> None:
        if not self.accept(";"):
            self.problem("missing ;", max(0, self.before() - 1), self.before())

    def import_(self) -> None:
        start = self.here()
        self.take()
        self.accept("static")
        toks, star = [], False
        while self.i < len(self.toks) and self.at() != ";":
            if self.at() == "*":
                star = True
                self.take()
            elif self.at() == ".":
                self.take()
            elif self.kind() == "name" and not (toks and self.toks[self.i - 1][1] != "."):
                toks.append(self.take())
            else:
                break
        for t in toks:
            self.name(t)
        if toks and not star:
            full = ".".join(t[1] for t in toks)
            self.imports[toks[-1][1]] = full
        self.semicolon()
        if toks and not star:
            self.ref(full, "TYPE_REFERENCE", start, self.before())

    def modifiers(self) -> tuple[int, list[str], int]:
        """(bits, annotations, where they start)."""
        bits, notes, at = 0, [], self.here()
        while True:
            t = self.at()
            if t == "@" and self.at(1) != "interface":
                notes.append(self.annotation())
            elif t == "non" and self.at(1) == "-" and self.at(2) == "sealed":
                self.i += 3
                bits |= MODIFIERS["non-sealed"]
            elif t in MODIFIERS and not (t == "sealed" and self.at(1) not in ("class", "interface", "abstract", "public", "static")) and not (t == "default" and self.at(1) in (":", "->")) and t != "module":
                self.take()
                bits |= MODIFIERS[t]
            else:
                return bits, notes, at

    def annotation(self) -> str:
        start = self.here()
        self.take()
        parts = []
        while self.is_name():
            parts.append(self.take())
            if self.at() == "." and self.kind(1) == "name":
                self.take()
            else:
                break
        for p in parts:
            self.name(p)
        if self.at() == "(":
            self.scan_pair("(", ")")
        name = ".".join(p[1] for p in parts)
        if name:
            self.ref(self.resolve(name), "ANNOTATION_USE", start, self.before())
        return name

    def type_start(self) -> bool:
        t = self.at()
        return t in ("class", "interface", "enum") or t == "@" and self.at(1) == "interface" or t == "record" and self.is_name(1) and self.at(2) in ("(", "<")

    # types
    def type_(self, refs: bool = True) -> tuple[str, str, int, int] | None:
        """(erased or full name, full text, start, end) of a type; its parts are recorded."""
        while self.at() == "@":
            self.annotation()
        start = self.here()
        if self.at() in _PRIMITIVE:
            text = base = self.take()[1]
            plain = False
        elif self.at() == "?":
            self.take()
            text = base = "?"
            if self.at() in ("extends", "super"):
                how = self.take()[1]
                inner = self.type_()
                text = base = f"? {how} {inner[1] if inner else ''}"
            return base, text, start, self.before()
        elif self.is_name():
            parts = [self.take()]
            args = ""
            if self.at() == "<":
                args = self.arguments()
            while self.at() == "." and self.is_name(1):
                self.take()
                parts.append(self.take())
                if self.at() == "<":
                    args = self.arguments()
            for p in parts:
                self.name(p)
            base = ".".join(p[1] for p in parts)
            text = base + args
            if refs:
                self.ref(self.resolve(base), "TYPE_REFERENCE", start, parts[-1][3])
            plain = True
        else:
            return None
        array = False
        while self.at() == "[" and self.at(1) == "]":
            self.i += 2
            text += "[]"
            array = True
        if self.at() == "...":
            self.take()
        return (text if array or not plain else self.resolve(base)), text, start, self.before()

    def arguments(self) -> str:
        """< ... >, as text."""
        self.take()
        parts = []
        while self.i < len(self.toks) and self.at() != ">":
            t = self.type_()
            if t:
                parts.append(t[1])
            while self.accept("&"):
                self.type_()
            if not self.accept(",") and self.at() != ">":
                if self.at() in (">=", ">>"):
                    break
                if t is None:
                    break
        self.accept(">")
        return "<" + ",".join(parts) + ">"

    def type_parameters(self) -> None:
        if not self.accept("<"):
            return
        while self.i < len(self.toks) and self.at() != ">":
            while self.at() == "@":
                self.annotation()
            if self.is_name():
                self.name(self.take())
            if self.accept("extends"):
                self.type_()
                while self.accept("&"):
                    self.type_()
            if not self.accept(","):
                break
        self.accept(">")

    def type_list(self) -> list[tuple[str, str, int, int]]:
        out = []
        while (t := self.type_()) is not None:
            out.append(t)
            if not self.accept(","):
                break
        return out

    def type_decl(self, bits: int, start: int) -> None:
        word = self.take()[1]
        if word == "@":
            self.take()
            word = "annotation"
        if not self.is_name():
            self.problem("missing type name", self.here(), self.here() + 1)
            return
        simple = self.name(self.take())
        name = self.qualified(simple)
        self.type_parameters()
        super_, interfaces = None, []
        if word == "record" and self.at() == "(":
            self.parameters()
        while self.at() in ("extends", "implements", "permits"):
            how = self.take()[1]
            found = self.type_list()
            if how == "extends" and word == "class":
                super_ = found[0] if found else None
            elif how != "permits":
                interfaces += found
        kind = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD", "annotation": "ANNOTATION"}[word]
        fixed = {"enum": "java.lang.Enum", "record": "java.lang.Record"}.get(word)
        row = {"name": name, "owner": simple, "package_name": self.package, "kind": kind, "modifiers": bits, "superclass": super_[0] if super_ else fixed, "items": [] if word == "annotation" else [t[0] for t in interfaces]}
        if super_:
            self.ref(super_[0], "CONSTRUCTOR_INVOCATION", super_[2], super_[3])
        self.scope.append(simple)
        has_ctor = False
        if self.accept("{"):
            if word == "enum":
                self.constants(name)
            has_ctor = self.body(word, simple, super_[0] if super_ else None)
        else:
            self.problem("missing {", max(0, self.before() - 1), self.before())
        end = self.before()
        if word == "class" and not has_ctor:
            self.add("methods", start, end, name=simple, owner=name, modifiers=bits, items=[], is_constructor=True)
        self.scope.pop()
        self.add("types", start, end, **row)

    def constants(self, owner: str) -> None:
        while self.i < len(self.toks) and self.at() not in (";", "}"):
            while self.at() == "@":
                self.annotation()
            if not self.is_name():
                break
            start = self.here()
            tok = self.take()
            self.name(tok)
            if self.at() == "(":
                self.scan_pair("(", ")")
            if self.at() == "{":
                self.take()
                self.body("class", "", None)
            self.add("fields", start, self.before(), name=tok[1], owner=owner, type=owner, modifiers=0)
            self.ref(owner, "CONSTRUCTOR_INVOCATION", start, self.before())
            if not self.accept(","):
                break
        self.accept(";")

    def body(self, word: str, simple: str, super_: str | None) -> bool:
        """Members up to the closing brace; whether a constructor is among them."""
        has_ctor = False
        while True:
            if self.i >= len(self.toks):
                self.problem("missing }", max(0, len(self.source) - 1), len(self.source))
                return has_ctor
            if self.accept("}"):
                return has_ctor
            if self.accept(";"):
                continue
            start = self.i
            bits, _, at = self.modifiers()
            if self.type_start():
                self.type_decl(bits, at)
            elif self.at() == "{":
                self.block(super_)
            else:
                has_ctor |= self.member(word, simple, super_, bits, at)
            if self.i == start:
                self.problem(f"unexpected token {self.at()}", self.here(), self.here() + len(self.at()))
                self.take()

    def member(self, word: str, simple: str, super_: str | None, bits: int, at: int) -> bool:
        self.type_parameters()
        ctor = self.is_name() and self.at() == simple and self.at(1) in ("(", "{")
        type_ = None
        if not ctor:
            type_ = self.type_()
            if type_ is None or not self.is_name():
                return False
        tok = self.take()
        indexed = word != "annotation"
        if self.at() == "(" or ctor:
            self.name(tok)
            params = self.parameters() if self.at() == "(" else []
            while self.at() == "[" and self.at(1) == "]":
                self.i += 2
            if self.accept("throws"):
                self.type_list()
            if self.accept("default"):
                self.scan_until(";")
            if self.at() == "{":
                self.block(super_)
            else:
                self.semicolon()
            if indexed:
                self.add("methods", at, self.before(), name=tok[1], owner=self.owner(), modifiers=bits, items=params, type=None if ctor else type_[0], is_constructor=ctor)
            return ctor
        while True:
            start, text = tok[2], type_[0]
            self.name(tok)
            while self.at() == "[" and self.at(1) == "]":
                self.i += 2
            if self.accept("="):
                self.scan_until(",", ";", declarator=True)
            if indexed:
                self.add("fields", start, self.before(), name=tok[1], owner=self.owner(), type=text, modifiers=bits)
            self.add("name_refs", start, self.before(), name=tok[1], kind="NAME_REFERENCE")
            if self.at() == "," and self.is_name(1):
                self.take()
                tok = self.take()
                continue
            break
        self.semicolon()
        return False

    def parameters(self) -> list[str]:
        self.take()
        out = []
        while self.i < len(self.toks) and self.at() != ")":
            start = self.i
            self.modifiers()
            t = self.type_()
            if self.at() == "this" or self.at(1) == "." and self.at(2) == "this":
                while self.at() not in (",", ")", ""):
                    self.take()
            elif t is not None:
                out.append(t[0] + ("..." if self.toks[self.i - 1][1] == "..." else ""))
                if self.is_name():
                    self.name(self.take())
                while self.at() == "[" and self.at(1) == "]":
                    self.i += 2
            self.accept(",")
            if self.i == start:
                self.take()
        self.accept(")")
        return [p.removesuffix("...") for p in out]

    # bodies
    def block(self, super_: str | None) -> None:
        self.scan_pair("{", "}", super_)

    def scan_pair(self, opening: str, closing: str, super_: str | None = None) -> None:
        if not self.bodies:
            return self.skip_pair(opening, closing)
        depth = 0
        while self.i < len(self.toks):
            t = self.at()
            if t == opening and self.kind() == "op":
                depth += 1
                self.take()
            elif t == closing and self.kind() == "op":
                depth -= 1
                self.take()
                if depth == 0:
                    return
            else:
                self.step(super_)
        self.problem(f"missing {closing}", max(0, len(self.source) - 1), len(self.source))

    def scan_until(self, *ends: str, declarator: bool = False) -> None:
        while self.i < len(self.toks) and self.at() not in ends:
            t = self.at()
            if t == "}":
                return
            if t in "([{" and self.kind() == "op":
                self.scan_pair(t, {"(": ")", "[": "]", "{": "}"}[t])
            elif not self.bodies and t != "<":
                self.take()
            elif declarator and t == "<":
                mark, held = self.i, len(self.facts)
                self.arguments()
                if self.at(-1) != ">":
                    self.i = mark + 1
                    del self.facts[held:]
            else:
                self.step(None)

    def step(self, super_: str | None) -> None:
        """One construct of a body."""
        t, kind = self.at(), self.kind()
        if kind == "op":
            if t == "@" and self.kind(1) == "name":
                self.annotation()
                return
            if t == "(" and self.lambda_():
                return
            if t == "(" and self.cast():
                return
            self.take()
            if t == "." and self.at() == "<":  # explicit type arguments of a call
                self.arguments()
            return
        if kind != "name":
            self.take()
            return
        if t == "new":
            self.take()
            while self.at() == "@":
                self.annotation()
            made = self.type_()
            if made and self.at() != "[" and not made[1].endswith("]"):
                self.ref(made[0], "CONSTRUCTOR_INVOCATION", made[2], made[3])
                if self.at() == "(":
                    self.scan_pair("(", ")", super_)
                if self.at() == "{":
                    self.take()
                    self.body("class", "", None)
            return
        if t == "super":
            tok = self.take()
            if self.at() == "(":
                if super_:
                    self.ref(super_, "CONSTRUCTOR_INVOCATION", tok[2], tok[3])
            elif self.at() in (".", "::") and self.kind(1) == "name":
                how = "METHOD_REFERENCE" if self.take()[1] == "::" else None
                m = self.take()
                self.name(m)
                if how or self.at() == "(":
                    self.ref("super", how or "METHOD_INVOCATION", tok[2], m[3])
            return
        if t == "this" and self.at(1) == "::":
            self.take()
            self.reference(self.i - 1)
            return
        if t == "instanceof":
            self.take()
            self.accept("final")
            self.type_()
            return
        if t in ("class", "interface", "enum") and self.at(-1) != "." or t == "record" and self.type_start():
            start = self.here()
            self.type_decl(0, start)
            return
        if t == "catch" and self.caught():
            return
        if t == "case" and self.is_name(1):
            self.take()
            if self.at(1) == "(" or self.looks_like_type(0, after_name=True, pattern=True):
                self.type_()
            return
        if t == "::":
            self.take()
            return
        if t in _PRIMITIVE:
            mark = self.i
            self.type_()
            if self.at() == "::":
                self.reference(mark)
            return
        if self.is_name():
            if self.at(1) == "->":
                self.lambda_()
                return
            if self.declaration():
                return
            self.chain()
            return
        self.take()

    def caught(self) -> bool:
        """catch ( A | B e ): all types are recorded."""
        j, last = 1, ""
        if self.at(j) != "(":
            return False
        while self.kind(j + 1) == "name" or self.at(j + 1) in ("|", ".", "@"):
            j += 1
            last = self.kind(j)
        if self.at(j + 1) != ")" or last != "name":
            return False
        self.i += 2
        self.modifiers()
        self.type_()
        while self.accept("|"):
            self.type_()
        if self.is_name():
            self.name(self.take())
        self.accept(")")
        return True

    def declaration(self) -> bool:
        """A local declaration: a type followed by a name and one of = ; : , )."""
        if self.at(-1) in (".", "::", "->") and self.at(-1) != "->" or not self.looks_like_type(0, after_name=True):
            return False
        self.type_()
        return True

    def looks_like_type(self, k: int, after_name: bool, pattern: bool = False) -> bool:
        """Whether tokens from k on read as a type, followed by a declared name (or by the end, if not after_name)."""
        j = k
        if not self.is_name(j):
            return False
        depth = 0
        j += 1
        while True:
            t = self.at(j)
            if depth == 0 and t == "." and self.is_name(j + 1):
                j += 2
            elif t == "<":
                depth += 1
                j += 1
            elif t == ">" and depth:
                depth -= 1
                j += 1
            elif depth and (self.is_name(j) or t in (",", ".", "?", "extends", "super", "&", "[", "]", "@") or t in _PRIMITIVE):
                j += 1
            elif depth == 0 and t == "[" and self.at(j + 1) == "]":
                j += 2
            elif depth == 0 and t == "&" and not after_name and self.is_name(j + 1):
                j += 2  # an intersection
            else:
                break
        if depth:
            return False
        if pattern and self.is_name(j) and self.at(j + 1) in ("->", "when", "&&"):
            return True
        if not after_name:
            return self.at(j) == ")"
        return self.is_name(j) and self.at(j + 1) in ("=", ";", ":", ",", ")") or self.is_name(j) and self.at(j + 1) == "[" and self.at(j + 2) == "]"

    def cast(self) -> bool:
        """( Type ) before something that can be cast."""
        if not self.looks_like_type(1, after_name=False):
            return False
        j = self.i
        depth = 0
        while j < len(self.toks):
            depth += (self.toks[j][1] == "(") - (self.toks[j][1] == ")")
            j += 1
            if depth == 0:
                break
        if j >= len(self.toks):
            return False
        kind, text = self.toks[j][:2]
        if not (kind in ("text", "num") or text in ("(", "!", "~", "new", "this", "super", "true", "false", "null") or kind == "name" and text not in _KEYWORDS):
            return False
        if self.i and (self.kind(-1) == "name" and self.at(-1) not in ("return", "case", "throw", "else", "yield", "do", "assert") or self.at(-1) in (")", "]", ">")):
            return False  # arguments of a call, or a condition
        self.take()
        self.type_()
        while self.accept("&"):
            self.type_()
        self.accept(")")
        return True

    def lambda_(self) -> bool:
        """A lambda's parameters; its body is scanned on."""
        start = self.here()
        types: list[str] = []
        if self.at() == "(":
            j, depth = self.i, 0
            while j < len(self.toks):
                depth += (self.toks[j][1] == "(") - (self.toks[j][1] == ")")
                j += 1
                if depth == 0:
                    break
            if j >= len(self.toks) or self.toks[j][1] != "->":
                return False
            self.take()
            while self.i < j - 1:
                mark = self.i
                self.modifiers()
                if self.is_name() and self.at(1) in (",", ")"):
                    self.name(self.take())
                else:
                    t = self.type_()
                    if t:
                        types.append(t[0])
                    if self.is_name():
                        self.name(self.take())
                self.accept(",")
                if self.i == mark:
                    self.take()
            self.i = j
        else:
            self.name(self.take())
        self.accept("->")
        self.add("methods", start, self.lambda_end(), name="<lambda>", owner=self.owner(), modifiers=0, items=types, is_constructor=False)
        return True

    def lambda_end(self) -> int:
        depth, j = 0, self.i
        while j < len(self.toks):
            t = self.toks[j][1]
            if t in ("(", "[", "{"):
                depth += 1
            elif t in (")", "]", "}"):
                if depth == 0:
                    break
                depth -= 1
                if depth == 0 and t == "}" and j > self.i and self.toks[self.i][1] == "{":
                    return self.toks[j][3]
            elif t in (",", ";") and depth == 0:
                break
            j += 1
        return self.toks[j - 1][3] if j else 0

    def chain(self) -> None:
        """A dotted name, perhaps the left of a method reference."""
        mark = self.i
        generic = self.looks_generic()
        if generic:
            self.type_(refs=False)
        else:
            self.name(self.take())
            while self.at() == "." and self.is_name(1):
                self.take()
                self.name(self.take())
            k = 0
            while self.at(k) == "[" and self.at(k + 1) == "]":
                k += 2
            if self.at(k) == "." and self.at(k + 1) == "class":  # a class literal
                start, end = self.toks[mark][2], self.before()
                self.ref(self.resolve("".join(x[1] for x in self.toks[mark : self.i])), "TYPE_REFERENCE", start, end)
        if self.at() == "::":
            self.reference(mark)

    def looks_generic(self) -> bool:
        if self.at(1) not in ("<", "["):
            return False
        j, depth = 1, 0
        while True:
            t = self.at(j)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if depth == 0 and self.at(j + 1) not in ("[", "."):
                    return self.at(j + 1) == "::"
            elif not (self.is_name(j) or t in (",", ".", "?", "[", "]", "extends", "super") or t in _PRIMITIVE):
                return depth == 0 and t == "::"
            j += 1

    def reference(self, mark: int) -> None:
        """`x::m`, `T::m`, `T::new` with the tokens from mark on at its left."""
        start = self.toks[mark][2]
        left = self.source[start : self.before()]
        self.take()
        if self.at() == "<":
            self.arguments()
        base = re.sub(r"<.*>|\s|\[\]", "", left)
        looks_type = base.split(".")[-1][:1].isupper()
        if self.accept("new"):
            self.ref(self.resolve(base), "CONSTRUCTOR_INVOCATION", start, self.before())
        elif self.kind() == "name":
            self.name(self.take())
            whole = self.source[start : self.before()]
            self.ref(self.resolve(base) if looks_type else whole, "METHOD_REFERENCE", start, self.before())

    def doc_names(self, start: int, end: int) -> None:
        for m in _DOC_NAME.finditer(self.source, start, end):
            for g in (1, 2):
                if m[g]:
                    at = m.start(g)
                    for part in m[g].split("."):
                        if part:
                            self.add("name_refs", at, at + len(part), name=part, kind="NAME_REFERENCE")
                        at += len(part) + 1

    def balance(self) -> None:
        """Brackets that do not pair."""
        if any(f["rel"] == "diagnostics" for f in self.facts):
            return
        pairs, stack = {")": "(", "]": "[", "}": "{"}, []
        for kind, t, s, e in self.toks:
            if kind == "op" and t in "([{":
                stack.append((t, s, e))
            elif kind == "op" and t in pairs:
                if not stack or stack.pop()[0] != pairs[t]:
                    self.problem(f"unbalanced {t}", s, e)
                    return
        if stack:
            self.problem(f"unbalanced {stack[-1][0]}", stack[-1][1], stack[-1][2])

    def located(self) -> list[dict]:
        """Facts with UTF-16 offsets, lines and columns."""
        src = self.source
        ends = [i for i, c in enumerate(src) if c == "\n"]
        wide = [i for i, c in enumerate(src) if c > "￿"]
        u = (lambda p: p + bisect.bisect_left(wide, p)) if wide else (lambda p: p)
        for f in self.facts:
            line = bisect.bisect_left(ends, f["start"])
            begin = ends[line - 1] + 1 if line else 0
            f["line"], f["col"] = line + 1, u(f["start"]) - u(begin)
            f["start"], f["end"] = u(f["start"]), u(f["end"])
        return self.facts

    def statements(self) -> None:
        """A statement's last token followed, on another line, by what cannot continue it."""
        if any(f["rel"] == "diagnostics" for f in self.facts):
            return
        depth, since = 0, 0  # since: the first token behind the last ; { } or bracket
        braces: list[bool] = []  # whether each open brace holds a list: enum constants, an array or annotation values
        for k, ((kind, t, s, e), (k2, t2, s2, _)) in enumerate(zip(self.toks, self.toks[1:])):
            if kind == "op":
                depth += (t in ("(", "[")) - (t in (")", "]"))
                if t == "{":
                    head = [x[1] for x in self.toks[since:k]]
                    braces.append(k > 0 and self.toks[k - 1][1] in ("=", "]", "{", ",", "(") or "enum" in head)
                elif t == "}" and braces:
                    braces.pop()
                elif t == ";" and braces:
                    braces[-1] = False  # the constants are over
                if t in (";", "{", "}"):
                    since = k + 1
            ends = kind in ("num", "text") or t in ("]",) or kind == "name" and t not in _KEYWORDS
            starts = t2 in ("return", "}", "if", "for", "while", "try", "throw", "break", "continue", "public", "private", "protected") or k2 == "name" and t2 in _PRIMITIVE
            if depth == 0 and ends and starts and (t2 == "}" or "\n" in self.source[e:s2]) and not (t2 == "}" and braces and braces[-1]):
                self.problem("missing ;", e - 1, e)
                return


def parse(source: str | None, bodies: bool = True, diagnose: bool = True) -> list[dict]:
    """Facts of one source text; null has none."""
    return [] if source is None else Parser(source, bodies, diagnose).run()


def extract(files: DataFrame, bodies: bool = True, diagnose: bool = True) -> DataFrame:
    """FACTS of files(path, content), one row per fact; without bodies, of declarations only."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: list[dict] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    found = parse(content.as_py(), bodies, diagnose)
                except Exception as e:  # one unreadable file must not end the task
                    found = [{"rel": "diagnostics", "start": 0, "end": 1, "line": 1, "col": 0, "kind": "ERROR", "message": f"not parsed: {type(e).__name__}"}]
                rows += [{**f, "path": path} for f in found]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return files.select("path", "content").mapInArrow(run, FACTS)


def comments(files: DataFrame) -> DataFrame:
    """(path, start, end, javadoc) of every comment, in order; offsets count characters."""
    schema = pa.schema([("path", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("javadoc", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = Parser(content or "")
                rows += [{"path": path, "start": s, "end": e, "javadoc": (s, e) in p.docs} for s, e in p.comments]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(run, "path string, start int, end int, javadoc boolean")


_NODES = "path string, kind string, name string, start int, end int, number int, last int, depth int, parent int, enclosing_type string"
_NODE_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (c.split(" ") for c in _NODES.split(", "))])


def node_rows(source: str | None) -> list[tuple]:
    """The ranges that the parser sees, nested: (kind, name, start, end, number, last, depth, parent, enclosing_type).

    Numbers are in pre-order from 0; a node holds the nodes from its number to last.  Ranges that cross, as
    those of faulty sources may, nest by where they start.
    """
    facts = sorted(parse(source), key=lambda f: (f["start"], -f["end"], f["rel"] != "types", f["rel"]))
    out: list[list] = []
    open_: list[int] = []
    for f in facts:
        while open_ and out[open_[-1]][3] <= f["start"] and not (out[open_[-1]][2] == f["start"] and out[open_[-1]][3] == f["end"]):
            out[open_.pop()][5] = len(out) - 1
        around = next((out[k] for k in reversed(open_) if out[k][0] == "types"), None)
        out.append([f["rel"], f.get("name") or f.get("message"), f["start"], f["end"], len(out), len(out), len(open_), open_[-1] if open_ else None, around[1] if around else None])
        open_.append(len(out) - 1)
    for k in open_:
        out[k][5] = len(out) - 1
    return [tuple(r) for r in out]


def nodes(files: DataFrame) -> DataFrame:
    """node_rows() of files(path, content)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(path, *r) for r in node_rows(content.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _NODE_SCHEMA)], schema=_NODE_SCHEMA)

    return files.select("path", "content").mapInArrow(run, _NODES)
