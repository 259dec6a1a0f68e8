"""Lexical scopes of Java files as intervals, and the names that they bind.

A file gives two tables: declarations with the interval in which they hold (fields: their class's body; locals,
parameters and pattern variables: from the declaration on), and simple names.  Intervals of one name in one file
nest, so the innermost that holds a use is the one that begins last: an equi-join on file and name with a range, for
all names of a corpus at once.  Names behind a dot are members, names before a parenthesis are methods; neither is
a use here.  Inherited fields have no interval, so their uses stay unbound.

Offsets are UTF-16 units, ends are exclusive.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.javaparse import _KEYWORDS, _PRIMITIVE, Parser

FIELD, LOCAL, PARAMETER, PATTERN = "FIELD", "LOCAL", "PARAMETER", "PATTERN"
#: Words before a name that are no type.
_NO_TYPE = (_KEYWORDS - _PRIMITIVE) | frozenset("record yield permits sealed non when".split())
_IN_TYPE_ARGUMENTS = frozenset(", . ? & [ ] < > @ extends super".split())


class Scope(NamedTuple):
    """A declared name: its token, and the first and last token of its scope."""

    name: str
    at: int
    first: int
    last: int
    kind: str


class Scoping:
    """The scopes of one file's tokens."""

    def __init__(self, toks: list[tuple[str, str, int, int]]):
        self.toks, self.n = toks, len(toks)
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        self.inside: list[int | None] = []  # the innermost bracket that holds a token
        stack: list[int] = []
        for k, (kind, t, *_) in enumerate(toks):
            if kind == "op" and t in ")}" and stack:
                self.open[k] = stack.pop()
                self.close[self.open[k]] = k
            self.inside.append(stack[-1] if stack else None)
            if kind == "op" and t in "({":
                stack.append(k)
        self._members: dict[int, bool] = {}
        self.scopes: list[Scope] = []
        for k in range(self.n):
            if self.is_name(k) and self.word(k - 1) != "." and self.word(k - 1) != "::":
                self._declared(k)

    def word(self, k: int) -> str:
        return self.toks[k][1] if 0 <= k < self.n and self.toks[k][0] != "text" else ""

    def is_name(self, k: int) -> bool:
        return 0 <= k < self.n and self.toks[k][0] == "name" and self.toks[k][1] not in _KEYWORDS

    def type_before(self, k: int) -> int | None:
        """The first token of the type that ends before token k, or None."""
        j = k - 1
        if self.word(j) == "...":
            j -= 1
        while self.word(j) == "]" and self.word(j - 1) == "[":
            j -= 2
        if self.word(j) == ">":
            depth = 0
            while j >= 0:
                depth += (self.word(j) == ">") - (self.word(j) == "<")
                if depth == 0:
                    break
                if self.toks[j][0] != "name" and self.word(j) not in _IN_TYPE_ARGUMENTS:
                    return None
                j -= 1
            j -= 1
        if j < 0 or self.toks[j][0] != "name" or self.word(j) in _NO_TYPE:
            return None
        while self.word(j - 1) == "." and j >= 2 and self.toks[j - 2][0] == "name":
            j -= 2
        return None if self.word(j - 1) == "." else j

    def holds_members(self, brace: int) -> bool:
        """Whether a brace opens the body of a type."""
        if brace not in self._members:
            k, found = brace - 1, False
            while k >= 0 and self.word(k) not in (";", "{", "}", ")", "->"):
                if self.word(k) in ("class", "interface", "enum", "record") and self.word(k - 1) != ".":
                    found = True
                    break
                k -= 1
            if not found and self.word(k) == ")" and k in self.open:
                head = self.open[k] - 1  # a record's header, or the arguments of an anonymous class
                steps = 0
                while head >= 0 and steps < 64 and (self.toks[head][0] == "name" or self.word(head) in (".", "<", ">", ",", "?")):
                    if self.word(head) in ("new", "record"):
                        found = True
                        break
                    head, steps = head - 1, steps + 1
            self._members[brace] = found
        return self._members[brace]

    def _end(self, k: int, stops: str) -> int:
        """The last token before one of stops at this depth, or before the bracket around closes."""
        while k < self.n:
            if k in self.close:
                k = self.close[k]
            elif k in self.open or self.word(k) and self.word(k) in stops:
                return k - 1
            k += 1
        return self.n - 1

    def _body(self, k: int) -> int:
        """The last token of the statement that begins at k."""
        return self.close[k] if k in self.close and self.word(k) == "{" else self._end(k, ";")

    def _add(self, k: int, first: int, last: int, kind: str) -> None:
        self.scopes.append(Scope(self.toks[k][1], k, first, last, kind))

    def _case(self, k: int) -> bool:
        """Whether token k stands in the label of a case."""
        while k >= 0 and (self.toks[k][0] in ("name", "num", "text") or self.word(k) in (",", ".")):
            if self.word(k) in ("case", "default"):
                return True
            k -= 1
        return False

    def _declared(self, k: int) -> None:
        around, after = self.inside[k], self.word(k + 1)
        if after == "->" and self.word(k - 1) in ("(", ")", ",", "=", "?", ":", "->", "return", "yield") and not self._case(k - 1):
            self._add(k, k, self._body(k + 2) if self.word(k + 2) == "{" else self._end(k + 2, ",;"), PARAMETER)
            return
        first = self.type_before(k)
        if first is None:
            if around is not None and self.word(around) == "(" and self.word(self.close.get(around, self.n) + 1) == "->" and after in (",", ")") and self.word(k - 1) in (",", "(") and not self._case(around - 1):
                self._lambda(k, around)
            return
        before = first - 1
        while self.word(before) == "final" or self.is_name(before) and self.word(before - 1) == "@":
            before -= 1 if self.word(before) == "final" else 2
        pattern = self._pattern(k, before, around)
        if pattern is not None:
            self._add(k, k, pattern, PATTERN)
        elif around is None:
            return
        elif self.word(around) == "(":
            end = self.close.get(around, self.n - 1)
            head = self.word(around - 1)
            if head in ("for", "try") and after in ("=", ":", ",", ";", ")"):
                last = self._body(end + 1)
                if head == "try":  # the block, not the handlers behind it
                    last = self.close.get(end + 1, last)
                self._add(k, k, last, LOCAL)
                self._also(k, last, LOCAL)
            elif head == "catch" and after == ")":
                self._add(k, k, self.close.get(end + 1, end), PARAMETER)
            elif after in (",", ")", "["):
                if self.word(end + 1) == "->":
                    self._lambda(k, around)
                    return
                body = end + 1
                while body < self.n and self.word(body) not in ("{", ";", "}", "=") and (self.toks[body][0] == "name" or self.word(body) in (",", ".", "<", ">", "[", "]", "@")):
                    body += 1
                if self.word(body) == "{" and body in self.close:
                    record = self.holds_members(body)
                    self._add(k, body if record else k, self.close[body], FIELD if record else PARAMETER)
        elif self.word(around) == "{" and after in ("=", ";", ",", ":", "["):
            end = self.close.get(around, self.n - 1)
            kind, start = (FIELD, around) if self.holds_members(around) else (LOCAL, k)
            self._add(k, start, end, kind)
            self._also(k, end, kind, around if kind == FIELD else None)

    def _also(self, k: int, last: int, kind: str, first: int | None = None) -> None:
        """Further names of the same declaration: int a = 1, b."""
        j = k + 1
        while j < self.n:
            if j in self.close:
                j = self.close[j]
            elif j in self.open or self.word(j) in (";", ":"):
                return
            elif self.word(j) == "," and self.is_name(j + 1) and self.word(j + 2) in ("=", ",", ";", "["):
                self._add(j + 1, j + 1 if first is None else first, last, kind)
            j += 1

    def _lambda(self, k: int, around: int) -> None:
        body = self.close[around] + 2
        self._add(k, k, self._body(body) if self.word(body) == "{" else self._end(body, ",;"), PARAMETER)

    def _pattern(self, k: int, before: int, around: int | None) -> int | None:
        """The last token at which a pattern variable holds, or None where token k is none.

        In a condition: that and the statement behind it; where it is negated, the rest of the block.
        """
        hold = around
        while self.word(before) in ("(", ",") and hold is not None and self.word(hold) == "(":  # inside a record pattern
            before, hold = self.type_before(hold), self.inside[hold]
            if before is None:
                return None
            before -= 1
            while self.word(before) == "final":
                before -= 1
        if self.word(before) == "case":
            j = k + 1
            while j < self.n and self.word(j) not in ("->", ":"):
                if j in self.open and self.word(j) == "}":
                    return j
                j = self.close.get(j, j) + 1 if self.word(j) == "{" else j + 1
            if self.word(j) == "->":
                return self._body(j + 1)
            j += 1
            while j < self.n and j not in self.open:
                if self.word(j) in ("case", "default") and self.word(j + 1) != "->":
                    return j - 1
                j = self.close.get(j, j) + 1
            return j
        if self.word(before) != "instanceof":
            return None
        negated = False
        while hold is not None and self.word(hold) == "(":
            head = self.word(hold - 1)
            if head == "!":
                negated = not negated
            if head in ("if", "while"):
                end = self.close.get(hold, self.n - 1)
                block = self.inside[hold]
                if negated and block is not None:
                    return self.close.get(block, self.n - 1)
                return self._body(end + 1)
            hold = self.inside[hold]
        return self._end(k, ";") if hold is None or self.word(hold) == "{" else self._end(k, ",;")

    def uses(self) -> Iterator[int]:
        """Tokens that are simple names of variables, declarations included."""
        for k in range(self.n):
            if self.is_name(k) and self.word(k - 1) not in (".", "::", "@") and self.word(k + 1) != "(":
                yield k

    def bound(self) -> dict[int, Scope]:
        """Simple names' tokens -> the innermost scope of that name around them."""
        by_name: dict[str, list[Scope]] = defaultdict(list)
        for s in self.scopes:
            by_name[s.name].append(s)
        for v in by_name.values():
            v.sort(key=lambda s: (s.first, -s.last))
        next_: dict[str, int] = defaultdict(int)
        stacks: dict[str, list[Scope]] = defaultdict(list)
        out = {}
        for k in self.uses():
            name = self.toks[k][1]
            if name not in by_name:
                continue
            mine, stack = by_name[name], stacks[name]
            while next_[name] < len(mine) and mine[next_[name]].first <= k:
                stack.append(mine[next_[name]])
                next_[name] += 1
            while stack and stack[-1].last < k:
                stack.pop()
            if stack:
                out[k] = stack[-1]
        for s in self.scopes:
            out[s.at] = s
        return out


_ROWS = "path string, row string, name string, kind string, start int, end int, first int, last int"
_KINDS = {"string": pa.string(), "int": pa.int32()}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (c.split(" ") for c in _ROWS.split(", "))])


def scope_rows(source: str) -> list[tuple]:
    """(row, name, kind, start, end, first, last): scopes (row DECLARATION) and names (row USE) of one file."""
    toks = Parser(source).toks
    scoping = Scoping(toks)
    wide = [k for k, c in enumerate(source) if ord(c) > 0xFFFF]
    unit = lambda p: p + bisect.bisect_left(wide, p)
    span = lambda k: (unit(toks[k][2]), unit(toks[k][3]))
    out = [("DECLARATION", s.name, s.kind, *span(s.at), span(s.first)[0], span(min(s.last, len(toks) - 1))[1]) for s in scoping.scopes]
    declared = {s.at for s in scoping.scopes}
    return out + [("USE", toks[k][1], None, *span(k), None, None) for k in scoping.uses() if k not in declared]


def scopes(files: DataFrame) -> DataFrame:
    """Rows DECLARATION and USE of files(path, content); a file that cannot be read gives one row ERROR with the cause as its name."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows += [(path, *r) for r in scope_rows(content.as_py() or "")]
                except Exception as e:  # one file must not end the task, but must be seen
                    rows.append((path, "ERROR", type(e).__name__, None, 0, 0, None, None))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in rows], _SCHEMA)
                    rows = []
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in rows], _SCHEMA)

    return files.select("path", "content").mapInArrow(run, _ROWS)


def bind(uses: DataFrame, declarations: DataFrame, key: list[str]) -> DataFrame:
    """Uses (key..., start, end) with the innermost of the declarations (key..., kind, start, end, first, last) around them.

    Columns kind, declared_start and declared_end are added, null where nothing holds the use.  One declaration for
    each use: that whose interval begins last, then ends first.
    """
    d = declarations.select(*key, "first", "last", F.struct("first", (-F.col("last")).alias("shorter"), "kind", F.col("start").alias("declared_start"), F.col("end").alias("declared_end")).alias("_d"))
    held = uses.join(d, key).where((F.col("first") <= F.col("start")) & (F.col("start") < F.col("last")))
    best = held.groupBy(*key, "start", "end").agg(F.max("_d").alias("_d"))
    out = uses.join(best, [*key, "start", "end"], "left")
    return out.select(*uses.columns, "_d.kind", "_d.declared_start", "_d.declared_end")


def bound_names(files: DataFrame) -> DataFrame:
    """(path, name, start, end, kind, declared_start, declared_end) of every simple name that is used in files."""
    rows = scopes(files)
    declared = rows.where("row = 'DECLARATION'").select("path", "name", "kind", "start", "end", "first", "last")
    return bind(rows.where("row = 'USE'").select("path", "name", "start", "end"), declared, ["path", "name"])
