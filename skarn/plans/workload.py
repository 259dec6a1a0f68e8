"""Operator-equivalent queries over the driver's tables, each with its DuckDB equivalent.

Files are `documents` (source = project, lang = package), name references are identifier tokens of their
text, declarations are `part`, the hierarchy is region - nation - customer and supplier - orders, and the
change feed and diagnostics are `events`.  Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import positions
from skarn.functions.predicates import CAMELCASE, EXACT, PATTERN, PREFIX, ellipsis, has_modifier, matches_name, package_of
from skarn.operators import batching, diagnostics, hierarchy, index, lineage, maintain, navigation, search
from skarn.sources import store
from skarn.sources.buckets import BUCKET

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

IDENT = "([A-Za-z_][A-Za-z0-9_]*)"
SQL_TOKENS = f"""tok AS (
  SELECT doc_id, source, lang, unnest(l) AS name, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT doc_id, source, lang, regexp_extract_all(text, '{IDENT}', 1) AS l FROM documents))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(docs: DataFrame) -> DataFrame:
    """name references of a corpus: one row per identifier token."""
    keep = [c for c in ("doc_id", "source", "lang", BUCKET) if c in docs.columns]
    return docs.select(*keep, F.posexplode(F.regexp_extract_all("text", F.lit(IDENT), F.lit(1))).alias("pos", "name"))


def micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


@query(f"WITH {SQL_TOKENS} SELECT doc_id, pos, name FROM tok WHERE name = 'the'")
def find_usages(spark, sf_dir):
    """Every occurrence of one name; documents without it are skipped before tokenising."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").contains("the"))
    return index.lookup(tokens(docs), "name", "the").select("doc_id", F.col("pos").cast("long").alias("pos"), "name")


@query(f"WITH {SQL_TOKENS} SELECT name, count(*) AS usages, count(DISTINCT doc_id) AS files FROM tok GROUP BY name")
def usage_counts(spark, sf_dir):
    """Usages of every name, in one shuffle: a document's names are sorted within its row, so that each one's first is known."""
    names = t(spark, sf_dir, "documents").select(F.sort_array(F.regexp_extract_all("text", F.lit(IDENT), F.lit(1))).alias("names"))
    beside = F.arrays_zip(F.col("names").alias("name"), F.slice(F.concat(F.array(F.lit("")), "names"), F.lit(1), F.size("names")).alias("before"))
    one = names.select(F.inline(beside)).select("name", (F.col("name") != F.col("before")).cast("long").alias("first"))
    return one.groupBy("name").agg(F.count("*").alias("usages"), F.sum("first").alias("files"))


@query("SELECT p_partkey, p_name, p_brand, p_size::BIGINT AS p_size FROM part WHERE p_partkey = 77")
def point_lookup(spark, sf_dir):
    """L1: one declaration by key; the filter reaches the scan."""
    return index.lookup(t(spark, sf_dir, "part"), "p_partkey", 77).select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("long").alias("p_size"))


@query("SELECT c_custkey, o_orderkey, o_orderstatus FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT'")
def members_of(spark, sf_dir):
    """L2/L3: members of the types that a filter selects."""
    types = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("declaring_type"))
    o = t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("declaring_type"), "o_orderkey", "o_orderstatus")
    return index.members(o, types).withColumnRenamed("declaring_type", "c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name = 'red widget'")
def match_exact(spark, sf_dir):
    return t(spark, sf_dir, "part").where(matches_name(F.col("p_name"), "red widget", EXACT)).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'blue')")
def match_prefix(spark, sf_dir):
    return t(spark, sf_dir, "part").where(matches_name(F.col("p_name"), "blue", PREFIX)).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '.*e. .*t')")
def match_glob(spark, sf_dir):
    return t(spark, sf_dir, "part").where(matches_name(F.col("p_name"), "*e? *t", PATTERN)).select("p_partkey", "p_name")


@query("""
WITH n AS (SELECT p_partkey, concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2), upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2)) AS name FROM part)
SELECT p_partkey, name FROM n WHERE regexp_matches(lower(regexp_replace(name, '[^A-Z]', '', 'g')), 's.*r')
""")
def match_camel(spark, sf_dir):
    part = t(spark, sf_dir, "part").select("p_partkey", F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")).alias("name"))
    return part.where(matches_name(F.col("name"), "SR", CAMELCASE))


@query(f"""
WITH {SQL_TOKENS} SELECT DISTINCT doc_id FROM tok WHERE name = 'with'
UNION SELECT doc_id FROM documents WHERE source = 'src1'
""")
def candidates_type(spark, sf_dir):
    """Q2: files that use a name, or declare in a project; distinct over both."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    loc = F.struct(F.col("doc_id").alias("file_id")).alias("loc")
    uses = tokens(docs.where(F.col("text").contains("with"))).select("name", loc)
    declared = docs.where("source = 'src1'").select(F.lit("with").alias("target"), loc)
    return search.candidates({"name_refs": uses, "type_refs": declared}, search.Pattern("TYPE", "with")).select(F.col("file_id").alias("doc_id"))


@query(f"""
WITH {SQL_TOKENS}, c AS (SELECT DISTINCT doc_id FROM tok WHERE name = 'from')
SELECT doc_id, strpos(text, 'the ')::BIGINT AS at FROM documents SEMI JOIN c USING (doc_id) WHERE strpos(text, 'the ') > 0
""")
def two_phase_search(spark, sf_dir):
    """Q1: candidates by the reference index, then the exact check on candidate files only."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "text")
    uses = tokens(docs.where(F.col("text").contains("from"))).select("name", F.struct(F.col("doc_id").alias("file_id")).alias("loc"))
    candidates = search.candidates({"name_refs": uses}, search.Pattern("METHOD", "from")).select(F.col("file_id").alias("doc_id"))
    at = F.instr("text", "the ").cast("long")
    return docs.where(F.col("text").contains("the ")).join(candidates, "doc_id", "left_semi").select("doc_id", at.alias("at"))


@query("SELECT doc_id, CASE WHEN length(split_part(text, chr(10), 1)) > 50 THEN substr(split_part(text, chr(10), 1), 1, 47) || '...' ELSE split_part(text, chr(10), 1) END AS element FROM documents")
def element_ellipsis(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", ellipsis(F.substring_index("text", "\n", 1)).alias("element"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def direct_children(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", "n_regionkey")
    edges = n.join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_nationkey").alias("child"))
    return n.join(hierarchy.direct(edges, "ASIA"), F.col("n_nationkey") == F.col("child"), "left_semi").select("n_nationkey", "n_name")


def _tree(spark, sf_dir) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, customer = t(spark, sf_dir, "nation"), t(spark, sf_dir, "customer")
    parts = [
        nation.select(key("R", "n_regionkey").alias("parent"), key("N", "n_nationkey").alias("child")),
        customer.select(key("N", "c_nationkey").alias("parent"), key("C", "c_custkey").alias("child")),
        t(spark, sf_dir, "supplier").select(key("N", "s_nationkey").alias("parent"), key("S", "s_suppkey").alias("child")),
        t(spark, sf_dir, "orders").select(key("C", "o_custkey").alias("parent"), key("O", "o_orderkey").alias("child")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


SQL_TREE = """tree(parent, child) AS (
  SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders)"""


@query(f"""
WITH RECURSIVE {SQL_TREE}, reach(root, node) AS (
  SELECT parent, child FROM tree WHERE parent IN ('R1', 'N3') UNION SELECT root, child FROM reach JOIN tree ON node = parent)
SELECT root, node FROM reach
""")
def closure(spark, sf_dir):
    """All descendants of two roots."""
    return hierarchy.closure(_tree(spark, sf_dir), spark.createDataFrame([("R1",), ("N3",)], "root string"))


@query(f"""
WITH RECURSIVE {SQL_TREE}, reach(root, node) AS (
  SELECT parent, child FROM tree WHERE starts_with(parent, 'R') UNION SELECT root, child FROM reach JOIN tree ON node = parent)
SELECT root, substr(node, 1, 1) AS kind, count(*) AS members FROM reach WHERE substr(node, 1, 1) IN ('C', 'S') GROUP BY root, kind
""")
def closure_by_kind(spark, sf_dir):
    """The closure of every root, by kind of the members; edges of other kinds never enter the loop."""
    edges = _tree(spark, sf_dir).where("child not like 'O%'")
    roots = t(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("root"))
    reach = hierarchy.closure(edges, roots).withColumn("kind", F.substring("node", 1, 1))
    return reach.where("kind in ('C', 'S')").groupBy("root", "kind").agg(F.count("*").alias("members"))


@query("SELECT o_orderkey, coalesce(c_name, 'unresolved#' || o_custkey) AS resolved FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def import_resolution(spark, sf_dir):
    """A name is resolved by a left join, and keeps its simple form where that finds nothing."""
    simple = lambda c: F.concat(F.lit("unresolved#"), F.col(c).cast("string"))
    file = lambda c: F.pmod(F.col(c), F.lit(25))  # noqa: E731 - customers lie in 25 files, each a package
    customers = t(spark, sf_dir, "customer")
    types = customers.where("c_acctbal > 0").select(simple("c_custkey").alias("simple_name"), F.col("c_name").alias("qualified_name"), file("c_custkey").cast("string").alias("package_name"), F.struct(file("c_custkey").alias("file_id")).alias("loc"))
    refs = t(spark, sf_dir, "orders").select(simple("o_custkey").alias("target"), F.lit("TYPE_REFERENCE").alias("kind"), F.struct(file("o_custkey").alias("file_id"), "o_orderkey").alias("loc"))
    return index.resolved_refs({"types": types, "type_refs": refs}).select("loc.o_orderkey", F.col("target").alias("resolved"))


@query("SELECT p_brand, count(*) AS refs, count(DISTINCT l_orderkey) AS files, sum(l_linenumber)::BIGINT AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def rehydrate(spark, sf_dir):
    """Locations regain their path by an equi-join with the registry."""
    refs = t(spark, sf_dir, "lineitem").select(F.struct(F.col("l_partkey").alias("file_id")).alias("loc"), "l_orderkey", "l_linenumber")
    files = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_brand").alias("path"))
    return index.with_path(refs, files).groupBy(F.col("path").alias("p_brand")).agg(F.count("*").alias("refs"), F.countDistinct("l_orderkey").alias("files"), F.sum("l_linenumber").cast("long").alias("lines"))


@query("SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def deleted_files(spark, sf_dir):
    """What is tracked but no longer there."""
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return maintain.deleted(c, t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key")), "key").select(F.col("key").alias("c_custkey"), "c_name")


_SITES = ["http://", "http://m.", "https://", "https://m.", "https://www."]


@query("""
WITH p(project) AS (VALUES ('http://'), ('http://m.'), ('https://'), ('https://m.'), ('https://www.')),
m AS (SELECT page_id, project, row_number() OVER (PARTITION BY page_id ORDER BY length(project) DESC, project) AS r FROM pages JOIN p ON starts_with(url, project))
SELECT page_id, project FROM m WHERE r = 1
""")
def project_prefix_join(spark, sf_dir):
    """The innermost project that contains a file.

    Project paths are looked up as prefixes of each length that occurs, an equi-join instead of a range join.
    """
    projects = spark.createDataFrame([(p,) for p in _SITES], "project string").withColumn("n", F.length("project"))
    sizes = F.array(*(F.lit(n) for n in sorted({len(p) for p in _SITES})))
    pages = t(spark, sf_dir, "pages").select("page_id", "url").withColumn("n", F.explode(sizes)).withColumn("project", F.expr("left(url, n)"))
    return pages.join(projects, ["n", "project"]).groupBy("page_id").agg(F.max_by("project", "n").alias("project"))


@query("""
WITH i AS (SELECT user_id, event_id AS s, event_id + 40 + (event_id % 7) * 10 AS e FROM events),
p AS (SELECT user_id, event_id AS "at", event_id + 5 AS upto FROM events WHERE event_type = 'click'),
m AS (SELECT p.user_id, "at", s, e, row_number() OVER (PARTITION BY p.user_id, "at" ORDER BY e - s, s DESC) AS r FROM p JOIN i ON p.user_id = i.user_id AND s <= "at" AND e >= upto)
SELECT user_id, "at", s, e FROM m WHERE r = 1
""")
def covering_interval(spark, sf_dir):
    """NodeFinder: the innermost node that covers a range, for all ranges at once."""
    ev = t(spark, sf_dir, "events")
    nodes = ev.select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 40 + (F.col("event_id") % 7) * 10).alias("end"))
    ranges = ev.where("event_type = 'click'").select("user_id", F.col("event_id").alias("at"), (F.col("event_id") + 5).alias("upto"))
    found = navigation.covering_nodes(ranges, nodes, ["user_id"])
    return found.select("user_id", "at", F.col("start").alias("s"), F.col("end").alias("e"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_writer_wins(spark, sf_dir):
    """The last state of every key, by aggregation with map-side combining."""
    ev = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return maintain.last_writer(ev, ["user_id"], ["ts", "event_id"]).drop("ts")


SQL_SNAPSHOTS = """
old AS (SELECT user_id AS path, max(epoch_us(ts)) AS m FROM events WHERE event_id % 2 = 0 GROUP BY 1),
new AS (SELECT user_id AS path, max(epoch_us(ts)) AS m FROM events WHERE event_id % 3 <> 0 GROUP BY 1)"""


@query(f"""
WITH {SQL_SNAPSHOTS}
SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'new' WHEN new.path IS NULL THEN 'deleted' ELSE 'changed' END AS status
FROM old FULL JOIN new ON old.path = new.path WHERE old.path IS NULL OR new.path IS NULL OR new.m > old.m
""")
def change_scan(spark, sf_dir):
    """New, changed and deleted files between two snapshots."""
    ev = t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("path"), micros("ts").alias("mtime_ms"))
    snap = lambda cond: ev.where(cond).groupBy("path").agg(F.max("mtime_ms").alias("mtime_ms"))
    return maintain.change_scan(snap("event_id % 2 = 0"), snap("event_id % 3 <> 0"))


@query(f"WITH {SQL_TOKENS} SELECT name, count(*) AS usages FROM tok WHERE source <> 'src3' GROUP BY name")
def remove_file(spark, sf_dir):
    """Facts of removed files go, by an anti join on the file key."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    gone = docs.where("source = 'src3'").select("doc_id")
    return tokens(maintain.without(docs, gone, "doc_id")).groupBy("name").agg(F.count("*").alias("usages"))


@query(f"WITH {SQL_TOKENS} SELECT lang, count(*) AS facts, count(DISTINCT name) AS names FROM tok GROUP BY lang")
def reindex_idempotent(spark, sf_dir):
    """Deleting and inserting a project's facts again leaves the index as it was."""
    facts = lineage.cut(tokens(t(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).groupBy("doc_id", "source", "lang", "name").agg(F.count("*").alias("n")))
    touched = facts.where("source = 'src2'")
    again = maintain.replace(facts, touched, touched, "doc_id")
    return again.groupBy("lang", "name").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("facts"), F.count("*").alias("names"))


@query("""
WITH n AS (SELECT n_nationkey::BIGINT AS k, n_name FROM nation), x AS (SELECT k + 20 AS k, 'new ' || n_name AS n_name FROM n)
SELECT k, n_name FROM n UNION ALL SELECT k, n_name FROM x ANTI JOIN n USING (k)
""")
def upsert_project(spark, sf_dir):
    """A row is inserted only if its key is absent."""
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    return maintain.insert_absent(n, n.select((F.col("k") + 20).alias("k"), F.concat(F.lit("new "), "n_name").alias("n_name")), "k")


@query("SELECT doc_id, (row_number() OVER (ORDER BY source, doc_id) - 1) // 100 AS chunk FROM documents")
def chunk_100(spark, sf_dir):
    """A4: chunks of a hundred files in path order, ranked by range partitions."""
    return batching.chunks(t(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"]).select("doc_id", "chunk")


@query()
def pack_batches(spark, sf_dir):
    """A3: package-aware batches per project; tests hold the plan to its rules."""
    files = t(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("lang").alias("package"), F.col("doc_id").alias("pos"))
    return batching.plan_batches(files, ["project"])


SQL_DIAGNOSTICS = """
d AS (SELECT event_id, user_id AS file_path, event_id % 50 AS line, user_id % 80 AS col, event_type AS message,
      CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 1 END AS severity FROM events)"""


def _diagnostics(spark, sf_dir):
    """Events as diagnostics of users' files; their kinds are the compiler's."""
    kind = F.create_map(*(F.lit(x) for kv in (("error", "ERROR"), ("click", "WARNING"), ("view", "MANDATORY_WARNING"), ("signup", "NOTE")) for x in kv))[F.col("event_type")]
    e = t(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("file_path"), (F.col("event_id") % 50).cast("long").alias("line"), (F.col("user_id") % 80).cast("long").alias("col"), F.col("event_type").alias("message"), diagnostics.severity(kind).alias("severity"))


@query(f"""
WITH {SQL_DIAGNOSTICS}, r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line, col, severity, message) AS k FROM d)
SELECT file_path AS user_id, count(*) AS n, max(line) FILTER (k = 1)::BIGINT AS line, max(severity) FILTER (k = 1)::BIGINT AS severity, max(message) FILTER (k = 1) AS message,
       string_agg(line || ':' || severity, ' ' ORDER BY k) AS marks FROM r GROUP BY file_path
""")
def group_publish(spark, sf_dir):
    """A1: diagnostics grouped by file for publication, in order of position."""
    x = F.col("diagnostics")[0]
    marks = F.array_join(F.transform("diagnostics", lambda d: F.concat(d["line"].cast("string"), F.lit(":"), d["severity"].cast("string"))), " ")
    out = diagnostics.publish(_diagnostics(spark, sf_dir))
    return out.select(F.col("file_path").alias("user_id"), F.size("diagnostics").cast("long").alias("n"), x["line"].alias("line"), x["severity"].cast("long").alias("severity"), x["message"].alias("message"), marks.alias("marks"))


@query(f"WITH {SQL_DIAGNOSTICS} SELECT event_id, severity::BIGINT AS severity FROM d")
def severity_map(spark, sf_dir):
    """Kinds map to severities; unknown kinds are errors."""
    return _diagnostics(spark, sf_dir).select("event_id", F.col("severity").cast("long").alias("severity"))


@query(f"""
WITH {SQL_DIAGNOSTICS}
SELECT file_path, greatest(line - 1, 0)::BIGINT AS line, col::BIGINT AS c0, (col + 1)::BIGINT AS c1, severity::BIGINT AS severity, message, 'java' AS source, count(*) AS n FROM d GROUP BY ALL
""")
def protocol_form(spark, sf_dir):
    """0-based lines and one-character ranges."""
    p = diagnostics.protocol(_diagnostics(spark, sf_dir))
    p = p.select("file_path", F.col("start.line").alias("line"), F.col("start.character").alias("c0"), F.col("end.character").alias("c1"), F.col("severity").cast("long").alias("severity"), "message", "source")
    return p.groupBy(*p.columns).agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT event_id, event_id % 50 AS p, user_id % 9 AS n, 45 AS size FROM events)
SELECT event_id, (CASE WHEN n <= 0 AND p >= size AND p > 0 THEN p - 1 ELSE p END)::BIGINT AS s,
       (CASE WHEN n <= 0 AND p >= size AND p > 0 THEN p - 1 ELSE p END + greatest(n - 1, 0))::BIGINT AS e FROM x
""")
def lsp_range(spark, sf_dir):
    """Inclusive ends; an empty range at the end of the text moves one to the left."""
    start, end = diagnostics.inclusive_range((F.col("event_id") % 50).cast("long"), (F.col("user_id") % 9).cast("long"), F.lit(45))
    return t(spark, sf_dir, "events").select("event_id", start.alias("s"), end.alias("e"))


@query(f"""
WITH {SQL_DIAGNOSTICS}
SELECT file_path::VARCHAR AS "filePath", severity::INT AS severity, message, line::INT AS "lineNumber", col::INT AS "columnNumber", event_id::INT AS "startPosition",
       (event_id + 3)::INT AS "endPosition", 'c' || event_id % 5 AS code FROM d WHERE event_id % 7 <> 0
""")
def diagnostics_json(spark, sf_dir):
    """Diagnostics to JSON and back; rows cut short (every seventh) are skipped."""
    d = _diagnostics(spark, sf_dir)
    d = d.select(F.col("file_path").cast("string").alias("file_path"), "severity", "message", F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), F.col("event_id").cast("int").alias("start"), (F.col("event_id") + 3).cast("int").alias("end"), F.concat(F.lit("c"), F.col("event_id") % 5).alias("code"))
    j = diagnostics.to_json(d).withColumn("id", F.get_json_object("json", "$.startPosition").cast("int"))
    return diagnostics.from_json(j.withColumn("json", F.when(F.col("id") % 7 == 0, F.expr("left(json, length(json) - 1)")).otherwise(F.col("json"))))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, '{\"k\":' || json_extract(props, '$.k')::BIGINT || '}' AS j FROM events WHERE json_valid(props)")
def json_round_trip(spark, sf_dir):
    """Rows that parse, read and written again; malformed ones are skipped."""
    x = F.from_json("props", "k bigint, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = t(spark, sf_dir, "events").select("event_id", x.alias("x")).where("x._bad is null and x is not null")
    return rows.select("event_id", "x.k", F.to_json(F.struct("x.k")).alias("j"))


@query("SELECT event_type AS kind, count(*) AS n, sum(event_id)::BIGINT AS ids, (SELECT count(*) FROM part) AS types, (SELECT count(*) FROM orders) AS methods FROM events GROUP BY 1")
def split_by_kind(spark, sf_dir):
    """K1/K2: an index is stored, with references split by kind, and loaded again; twice, to the same path."""
    refs = t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"))
    idx = {"types": t(spark, sf_dir, "part").select("p_partkey"), "methods": t(spark, sf_dir, "orders").select("o_orderkey"), "fields": t(spark, sf_dir, "region"), "files": t(spark, sf_dir, "nation"), "type_refs": refs, "name_refs": refs.limit(0)}
    path = f"{lineage.Scratch(spark).at}/index"
    store.save(idx, path)
    store.save(store.load(spark, path), path)
    back = store.load(spark, path)
    n = back["types"].agg(F.count("*").alias("types")).withColumn("k", F.lit(1)).join(F.broadcast(back["methods"].agg(F.count("*").alias("methods")).withColumn("k", F.lit(1))), "k")  # one row each
    return back["type_refs"].groupBy("kind").agg(F.count("*").alias("n"), F.sum("event_id").cast("long").alias("ids")).withColumn("k", F.lit(1)).join(F.broadcast(n), "k").drop("k")


@query("SELECT (row_number() OVER (ORDER BY path) - 1)::BIGINT AS file_id, path FROM (SELECT DISTINCT source || '/' || lang || '/' || doc_id AS path FROM documents)")
def intern_paths(spark, sf_dir):
    """K8: dense ids for paths, by range partitions."""
    d = t(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return maintain.intern(d).select(F.col("file_id").cast("long").alias("file_id"), "path")


@query("""
SELECT doc_id, (length(h) - length(replace(h, chr(10), '')))::BIGINT AS line, length(split_part(h, chr(10), -1))::BIGINT AS ch
FROM (SELECT doc_id, substr(text, 1, least(200, length(text))) AS h FROM documents)
""")
def offset_to_position(spark, sf_dir):
    """Line and character of an offset."""
    at = F.lit(200)
    return t(spark, sf_dir, "documents").select("doc_id", positions.line_of(F.col("text"), at).cast("long").alias("line"), positions.char_of(F.col("text"), at).cast("long").alias("ch"))


@query("""
SELECT doc_id, CASE WHEN len(l) > 1 AND length(l[2]) >= 5 THEN length(l[1]) + 6 ELSE -1 END::BIGINT AS at
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
""")
def position_to_offset(spark, sf_dir):
    """Offset of line 1, character 5, or -1."""
    return t(spark, sf_dir, "documents").select("doc_id", positions.position_to_offset(F.col("text"), F.lit(1), F.lit(5)).cast("long").alias("at"))


@query("SELECT event_id, user_id FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 20) WHERE event_id % 3 <> 0")
def top_oldest(spark, sf_dir):
    """The limit comes before the filter."""
    return t(spark, sf_dir, "events").orderBy("ts", "event_id").limit(20).where("event_id % 3 <> 0").select("event_id", "user_id")


@query("SELECT (SELECT count(*) FROM part) AS types, (SELECT count(*) FROM orders) AS methods, (SELECT count(*) FROM lineitem) AS fields, (SELECT count(*) FROM documents) AS files")
def index_stats(spark, sf_dir):
    """K7: sizes of the index."""
    return index.stats({"types": t(spark, sf_dir, "part"), "methods": t(spark, sf_dir, "orders"), "fields": t(spark, sf_dir, "lineitem"), "files": t(spark, sf_dir, "documents")})


@query("""
SELECT (SELECT count(*) FROM customer) AS files, count(*) AS errors, count(DISTINCT user_id) AS files_with_errors,
       round(100.0 * count(DISTINCT user_id) / (SELECT count(*) FROM customer), 4) AS percent FROM events WHERE event_type = 'error'
""")
def parse_quality(spark, sf_dir):
    """Parse-quality totals of a batch."""
    errors = t(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("file_path"))
    return index.parse_quality({"files": t(spark, sf_dir, "customer"), "diagnostics": errors})


@query("SELECT doc_id, sha1(text) AS digest FROM documents")
def sha1_fingerprint(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("digest"))


@query("SELECT p_partkey, (p_size & 9)::BIGINT AS bits, (p_size & 9) = 9 AS public_static FROM part WHERE (p_size & 1) = 1")
def modifier_mask(spark, sf_dir):
    size = F.col("p_size")
    return t(spark, sf_dir, "part").where(has_modifier(size, "public")).select("p_partkey", size.bitwiseAND(F.lit(9)).cast("long").alias("bits"), has_modifier(size, "public", "static").alias("public_static"))


@query("SELECT event_type AS project, count(DISTINCT user_id) AS edited, count(DISTINCT user_id) >= 20 AS rebatch FROM events GROUP BY 1")
def rebatch_threshold(spark, sf_dir):
    """Projects that enough distinct files were edited in."""
    return maintain.needs_rebatch(t(spark, sf_dir, "events").select(F.col("event_type").alias("project"), F.col("user_id").alias("path")))


@query("""
WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '/src/main/java/' WHEN page_id % 4 = 1 THEN '/src/' WHEN page_id % 4 = 2 THEN '/a/b/c/' ELSE '/source/' END || lower(regexp_replace(url, '^https?://', '')) AS path FROM pages),
d AS (SELECT page_id, path, left(path, length(path) - length(split_part(path, '/', -1)) - 1) AS dir FROM p)
SELECT page_id, replace(CASE WHEN page_id % 4 = 0 THEN substr(dir, 16) WHEN page_id % 4 = 1 THEN substr(dir, 6) WHEN page_id % 4 = 3 THEN substr(dir, 9)
  ELSE array_to_string(list_filter(string_split(dir, '/'), lambda x: x <> '')[-3:], '/') END, '/', '.') AS package FROM d
""")
def package_from_path(spark, sf_dir):
    """The package by the first source root in the path, else by the last folders."""
    root = F.element_at(F.array(F.lit("/src/main/java/"), F.lit("/src/"), F.lit("/a/b/c/"), F.lit("/source/")), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(root, F.lower(F.regexp_replace("url", "^https?://", "")))
    return t(spark, sf_dir, "pages").select("page_id", package_of(path).alias("package"))
