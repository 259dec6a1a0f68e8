"""Go to definition and find references at a position of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.hierarchy import super_edges
from skarn.operators.javaparse import Parser
from skarn.operators.reach import members_of
from skarn.operators.scopes import FIELD, Scoping
from skarn.operators.search import ALL, DECLARATIONS, REFERENCES, Pattern, occurrences_of, search


def offset_of(text: str, line: int, char: int) -> int:
    """Offset of a 0-based position, or -1 beyond the text."""
    lines = text.split("\n")
    if not 0 <= line < len(lines) or not 0 <= char <= len(lines[line]):
        return -1
    return sum(len(s) + 1 for s in lines[:line]) + char


def position_of(text: str, offset: int) -> tuple[int, int]:
    """0-based position of an offset; past the end, the last position."""
    lines = text.split("\n")
    at = 0
    for i, s in enumerate(lines):
        if offset <= at + len(s):
            return i, offset - at
        at += len(s) + 1
    return len(lines) - 1, len(lines[-1])


def symbol_at(text: str, line: int, char: int) -> Pattern | None:
    """The pattern of the innermost occurrence that covers a position, or None."""
    at = offset_of(text, line, char)
    if at < 0:
        return None
    found = occurrences_of(text)
    named = [o for o in found if o[2] != "TYPE" or o[3] != "DECLARATION"]
    named += [(o[0] + len(o[7].split(o[4], 1)[0]), len(o[4]), *o[2:]) for o in found if o[2] == "TYPE" and o[3] == "DECLARATION"]
    covering = sorted((o for o in named if o[0] <= at <= o[0] + o[1]), key=lambda o: (o[1], o[2] != "TYPE"))
    if not covering:
        return None
    o = covering[0]
    return Pattern("TYPE" if o[2] in ("TYPE", "CONSTRUCTOR") else o[2], (o[5] or o[4]) if o[2] == "TYPE" and o[3] == "REFERENCE" else o[4])


def local_at(text: str, line: int, char: int) -> tuple[list[tuple[int, int]], tuple[int, int]] | None:
    """(uses, declaration) of the local, parameter or pattern variable at a position, as (offset, length), or None."""
    at = offset_of(text, line, char)
    toks = Parser(text).toks
    k0 = next((k for k, t in enumerate(toks) if t[0] == "name" and t[2] <= at <= t[3]), None)
    if at < 0 or k0 is None:
        return None
    bound = Scoping(toks).bound()
    mine = bound.get(k0)
    if mine is None or mine.kind == FIELD:
        return None
    span = lambda k: (toks[k][2], toks[k][3] - toks[k][2])
    return [span(k) for k, s in sorted(bound.items()) if s == mine and k != s.at], span(mine.at)


def _local(files: DataFrame, path: str, line: int, char: int, declaration: bool, uses: bool) -> DataFrame | None:
    text = _file(files, path)
    found = local_at(text, line, char) if text is not None else None
    if found is None:
        return None
    utf16 = lambda p: len(text[:p].encode("utf-16-le", "surrogatepass")) // 2
    rows = [(found[1], "LOCAL_DECLARATION")] * declaration + [(u, "LOCAL_REFERENCE") for u in found[0]] * uses
    return files.sparkSession.createDataFrame([(path, utf16(s), n, kind, text[s : s + n]) for (s, n), kind in rows], "path string, offset int, length int, kind string, element_name string")


def _file(files: DataFrame, path: str) -> str | None:
    row = files.where(F.col("path") == path).select("content").first()  # one file
    return row[0] if row else None


def definition(index: dict[str, DataFrame], files: DataFrame, path: str, line: int, char: int) -> DataFrame:
    """Declarations of the symbol at a position, local variables and parameters first; none where nothing is found."""
    local = _local(files, path, line, char, True, False)
    return local if local is not None else _find(index, files, path, line, char, DECLARATIONS)


def references(index: dict[str, DataFrame], files: DataFrame, path: str, line: int, char: int, include_declaration: bool = False, kind: str | None = None) -> DataFrame:
    """Uses of the symbol at a position; a local's are looked for in its file only.

    kind: only matches whose kind's name holds it, such as FIELD or REFERENCE.
    """
    local = _local(files, path, line, char, include_declaration, True)
    found = local if local is not None else _find(index, files, path, line, char, ALL if include_declaration else REFERENCES)
    return found if kind is None else found.where(F.col("kind").contains(kind))


def _find(index, files, path, line, char, search_for) -> DataFrame:
    text = _file(files, path)
    p = symbol_at(text, line, char) if text is not None else None
    p = p or Pattern("TYPE", None)
    return search(index, files, Pattern(p.what, p.name.split(".")[-1] if p.name else None, search_for=search_for))


def covering_node(nodes: DataFrame, start: int, length: int) -> DataFrame:
    """The innermost of nodes(start, end, ...) that covers a range."""
    hit = nodes.where((F.col("start") <= start) & (F.col("end") >= start + length))
    return hit.orderBy(F.col("end") - F.col("start"), F.col("start").desc()).limit(1)


def covering_nodes(ranges: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """Ranges(key..., at, upto) with start and end of the innermost of nodes(key..., start, end) that covers each.

    A node of up to 2 ** k units is listed once, at level k in the bin of that width in which it starts; a range looks
    into two bins of every level.  So the join is on key, level and bin, however long the nodes are.  Of equally long
    nodes the later one is taken; ranges that nothing covers have no row.
    """
    size = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    placed = nodes.select(*key, "start", "end").withColumn("_level", F.ceil(F.log2(size)).cast("int")).withColumn("_bin", at("start"))
    top = placed.agg(F.max("_level")).first()[0]
    levels = F.sequence(F.lit(0), F.lit(0 if top is None else top))
    asked = ranges.select(*key, "at", "upto").distinct().withColumn("_level", F.explode(levels)).withColumn("_bin", F.explode(F.array(at("at"), at("at") - 1)))
    hit = asked.join(placed, [*key, "_level", "_bin"]).where("start <= at and end >= upto")
    best = hit.groupBy(*key, "at", "upto").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("later"), "start", "end")).alias("_x"))
    return ranges.join(best.select(*key, "at", "upto", "_x.start", "_x.end"), [*key, "at", "upto"])


def resolved_members(index: dict[str, DataFrame], found: DataFrame) -> DataFrame:
    """(path, offset, what, simple, owner, distance): the declarations that field and method references mean.

    found: occurrences; those whose receiver's type the file tells are looked up in that type and all above it, by
    name, as their number of arguments is not known.  Several rows where several types or unrelated declarations fit.
    """
    refs = found.where("role = 'REFERENCE' AND what IN ('METHOD', 'FIELD') AND declaring IS NOT NULL").select("path", "offset", "what", "simple", "declaring")
    types = index["types"].select(F.col("simple_name").alias("declaring"), F.col("qualified_name").alias("type")).distinct()
    key = lambda what, name: F.concat(F.lit(f"{what} "), F.col(name)).alias("name")
    asked = refs.join(types, "declaring").select("path", "offset", "what", "simple", "type", F.concat("what", F.lit(" "), "simple").alias("name"), F.lit(None).cast("int").alias("arity"))
    fields = index["fields"].select(F.col("declaring_type").alias("owner"), key("FIELD", "field_name"), F.lit(None).cast("int").alias("arity"))
    methods = index["methods"].select(F.col("declaring_type").alias("owner"), key("METHOD", "method_name"), F.size("param_types").alias("arity"))
    members = members_of(asked, fields.union(methods), super_edges(index["types"]))
    return members.select("path", "offset", "what", "simple", "owner", "distance").distinct()
