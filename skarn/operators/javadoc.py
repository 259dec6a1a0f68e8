"""Tags of documentation comments: block tags with their argument and fragments, inline tags nested in them.

A block tag stands first in its line, outside of braces; what precedes all block tags is the description, a tag
without a name.  An inline tag is {@name ...} up to its own closing brace.  Its text may hold further inline tags, but for
@code, @literal and @snippet, whose text is taken as it stands, with balanced braces.  An inline tag without an end is
text.  Stars that lead a line are no text.  Offsets are UTF-16 units of the file, ends are exclusive.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from skarn.operators.javaparse import Parser

# Inline tags, those whose text is raw, and block and inline tags whose first word is an argument.
INLINE = frozenset("code docRoot index inheritDoc link linkplain literal return snippet summary systemProperty value".split())
RAW = frozenset("code literal snippet".split())
ARGUMENT = frozenset("param throws exception see provides uses link linkplain value serialField".split())

_BLOCK = re.compile(r"@([A-Za-z][\w.:-]*)")
_OPEN = re.compile(r"\{@([A-Za-z][\w.:-]*)")

FRAGMENT = "kind string, tag string, argument string, text string, start int, end int, level int"
TAGS = f"path string, comment int, ordinal int, tag string, argument string, text string, start int, end int, fragments array<struct<{', '.join(f.replace(' ', ': ', 1) for f in FRAGMENT.split(', '))}>>"
_TYPES = {"string": pa.string(), "int": pa.int32()}
_FRAGMENT = pa.struct([(n, _TYPES[k]) for n, k in (f.split(" ") for f in FRAGMENT.split(", "))])
_SCHEMA = pa.schema([(n, _TYPES[k]) for n, k in (f.split(" ") for f in TAGS.split(", fragments")[0].split(", "))] + [("fragments", pa.list_(_FRAGMENT))])


def _blank_margins(source: str, start: int, end: int) -> str:
    """The inside of a comment at its own offsets, with blanks for what leads its lines."""
    inside = "   " + source[start + 3 : max(start + 3, end - 2)]
    lines = inside.split("\n")
    return "\n".join([lines[0], *(re.sub(r"^[ \t]*\*+", lambda m: " " * len(m[0]), line) for line in lines[1:])])


def _closing(text: str, at: int, end: int) -> int:
    """Where the brace that opens at ``at`` closes, or -1."""
    depth = 0
    for k in range(at, end):
        if text[k] == "{":
            depth += 1
        elif text[k] == "}":
            depth -= 1
            if depth == 0:
                return k
    return -1


def _argument(name: str, text: str, start: int, end: int) -> tuple[str | None, int]:
    """The argument of a tag, and where its text goes on."""
    if name not in ARGUMENT:
        return None, start
    m = re.compile(r"\s*((?:[^\s(<{]|<[^>]*>|\([^)]*\))+)").match(text, start, end)
    return (m[1], m.end()) if m else (None, start)


def _plain(text: str) -> str:
    return " ".join(text.split())


def fragments(text: str, start: int, end: int, level: int = 0) -> Iterator[tuple]:
    """(kind, tag, argument, text, start, end, level) of text and inline tags, a tag before what is nested in it."""
    at = start
    while at < end:
        m = _OPEN.search(text, at, end)
        close = _closing(text, m.start(), end) if m else -1
        stop = m.start() if m and close >= 0 else end
        if text[at:stop].strip():
            lead = len(text[at:stop]) - len(text[at:stop].lstrip())
            yield "TEXT", None, None, _plain(text[at:stop]), at + lead, at + len(text[at:stop].rstrip()), level
        if close < 0:
            return
        name = m[1]
        argument, body = _argument(name, text, m.end(), close)
        inner = text[body:close].strip() if name in RAW else _plain(text[body:close])
        yield "SNIPPET" if name == "snippet" else "INLINE", "@" + name, argument, inner, m.start(), close + 1, level
        if name not in RAW:
            yield from (f for f in fragments(text, body, close, level + 1) if f[0] != "TEXT" or _OPEN.search(text, body, close))
        at = close + 1


def tag_rows(source: str) -> list[tuple]:
    """(comment, ordinal, tag, argument, text, start, end, fragments) of every documentation comment of a file."""
    wide = [k for k, c in enumerate(source) if ord(c) > 0xFFFF]
    unit = lambda p: p + bisect.bisect_left(wide, p)
    out = []
    for start, end in Parser(source).docs:
        text = " " * start + _blank_margins(source, start, end) if start < 1 << 16 else None
        base = 0
        if text is None:  # far into a file, offsets are moved instead of blanks made
            text, base = _blank_margins(source, start, end), start
        first, stop = start - base + 3, len(text)
        marks, depth, fresh = [], 0, True
        for k in range(first, stop):
            c = text[k]
            if c == "{" and (depth or text.startswith("{@", k)):
                depth += 1
            elif c == "}" and depth:
                depth -= 1
            elif c == "@" and fresh and not depth and (m := _BLOCK.match(text, k)):
                marks.append((k, m))
            fresh = c == "\n" or fresh and c.isspace()
            if depth and c == "\n" and _closing(text, text.rfind("{@", 0, k), stop) < 0:
                depth = 0  # never closed: text
        edges = [(first, None), *marks, (stop, None)]
        for n, ((at, m), (to, _)) in enumerate(zip(edges, edges[1:])):
            body = m.end() if m else at
            argument, body = _argument(m[1], text, body, to) if m else (None, body)
            if m is None and not text[at:to].strip():
                continue
            if m is None:
                at += len(text[at:to]) - len(text[at:to].lstrip())
            last = at + len(text[at:to].rstrip())
            place = lambda p: unit(p + base)
            found = [(*f[:4], place(f[4]), place(f[5]), f[6]) for f in fragments(text, body, to)]
            out.append((unit(start), n, "@" + m[1] if m else None, argument, _plain(text[body:to]), place(at), place(last), found))
    return out


def doc_tags(files: DataFrame) -> DataFrame:
    """TAGS of files(path, content); ``comment`` is where the comment starts, ordinal 0 its description."""
    names = [f.name for f in _FRAGMENT]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(path, *r[:-1], [dict(zip(names, f)) for f in r[-1]]) for r in tag_rows(content.as_py() or "")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return files.select("path", "content").mapInArrow(run, TAGS)
