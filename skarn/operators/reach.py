"""Many subtype tests at once, and inherited members: a labelled hierarchy instead of a closure for each root.

label() lays a spanning forest over the edges (parent, child) and numbers its nodes in pre-order, so that a node's
descendants in the forest are one interval.  Edges outside the forest lead to further intervals, the node's exceptions.
A pair (a, b) is then answered by looking whether b's number lies in one of a's intervals: one join with the labels
for each side, however many pairs there are and whatever cycles the hierarchy holds.

The forest is found in as many rounds as it is deep, and a node carries its path: hierarchies of types are shallow.
Numbers are ranks of paths, given by range partitions; sizes are counts of path members.  No step orders or collects
the children of one node in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.lineage import cut


def forest(edges: DataFrame) -> DataFrame:
    """(node, path): a spanning forest of edges(parent, child); path holds the nodes from a root to the node itself.

    Roots are nodes without parents; where all that is left lies on or below cycles, those that no smaller unplaced
    node leads to.
    """
    edges = cut(edges.select(F.col("parent").cast("string"), F.col("child").cast("string")).where("parent IS NOT NULL AND child IS NOT NULL AND parent <> child").distinct())
    nodes = cut(edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct())
    placed = nodes.limit(0).withColumn("path", F.array("node"))
    while True:
        left = cut(nodes.join(placed, "node", "left_anti"))
        inner = edges.join(left.select(F.col("node").alias("parent")), "parent", "left_semi").join(left.select(F.col("node").alias("child")), "child", "left_semi")
        first = lambda held: cut(left.join(held.select(F.col("child").alias("node")).distinct(), "node", "left_anti"))
        front = first(inner)
        if front.isEmpty():
            front = first(inner.where("parent < child"))  # the smallest node at least
        if front.isEmpty():
            return placed
        front = front.withColumn("path", F.array("node"))
        while not front.isEmpty():
            placed = cut(placed.unionByName(front))
            step = front.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), "path").join(placed, "node", "left_anti")
            front = cut(step.groupBy("node").agg(F.min("path").alias("path")).withColumn("path", F.concat("path", F.array("node"))))


def label(edges: DataFrame) -> DataFrame:
    """(node, number, intervals): pre-order numbers, and the intervals of all numbers that a node reaches in one step or more."""
    tree = forest(edges)
    spread = cut(tree.repartitionByRange("path").withColumn("_part", F.spark_partition_id()))
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row per partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("path"))
    sizes = tree.select(F.explode("path").alias("node")).groupBy("node").agg(F.count("*").alias("size"))
    numbered = spread.join(F.broadcast(before), "_part").withColumn("number", F.col("_before") + rank - 1)
    at = cut(numbered.join(sizes, "node").select("node", "path", "number", (F.col("number") + F.col("size") - 1).alias("high")))

    plain = edges.select(F.col("parent").cast("string"), F.col("child").cast("string")).where("parent IS NOT NULL AND child IS NOT NULL").distinct()
    a = at.select(F.col("node").alias("parent"), "path", F.col("number").alias("low"), "high")
    b = at.select(F.col("node").alias("child"), F.col("number").alias("to_low"), F.col("high").alias("to_high"))
    beyond = plain.join(a, "parent").join(b, "child").where(~((F.col("to_low") > F.col("low")) & (F.col("to_low") <= F.col("high"))))
    own = at.select("node", F.col("number").alias("low"), "high")
    new = lambda rows: rows.join(own, "node").where(~((F.col("to_low") > F.col("low")) & (F.col("to_low") <= F.col("high")))).select("node", "child", "to_low", "to_high").distinct()
    first = cut(new(beyond.select(F.explode("path").alias("node"), "child", "to_low", "to_high")))
    found = front = first
    onward = first.select(F.col("node").alias("_from"), F.col("child").alias("_child"), F.col("to_low").alias("_low"), F.col("to_high").alias("_high"))
    while not front.isEmpty():
        step = front.join(onward, F.col("child") == F.col("_from")).select("node", F.col("_child").alias("child"), F.col("_low").alias("to_low"), F.col("_high").alias("to_high"))
        front = cut(new(step).join(found.select("node", "child"), ["node", "child"], "left_anti"))
        found = cut(found.unionByName(front))
    every = found.select("node", F.col("to_low").alias("low"), F.col("to_high").alias("high")).unionByName(own.where("high > low").withColumn("low", F.col("low") + 1))
    # of intervals that lie in one another, which all do or are apart, the outermost say the same
    outer = every.groupBy("node", "low").agg(F.max("high").alias("high"))
    w = Window.partitionBy("node").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    outer = outer.withColumn("_reached", F.max("high").over(w)).where("_reached IS NULL OR high > _reached")
    intervals = outer.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("intervals"))
    none = F.array().cast("array<struct<low: bigint, high: bigint>>")
    return at.select("node", "number").join(intervals, "node", "left").withColumn("intervals", F.coalesce("intervals", none))


def tests(pairs: DataFrame, labels: DataFrame, above: str = "above", below: str = "below", result: str = "reaches") -> DataFrame:
    """Pairs with whether ``below`` is reached from ``above`` in one step or more; nodes without a label reach nothing."""
    a = labels.select(F.col("node").alias("_a"), F.col("intervals").alias("_intervals"))
    b = labels.select(F.col("node").alias("_b"), F.col("number").alias("_number"))
    both = pairs.join(a, F.col(above).cast("string") == F.col("_a"), "left").join(b, F.col(below).cast("string") == F.col("_b"), "left")
    hit = F.exists("_intervals", lambda i: (F.col("_number") >= i["low"]) & (F.col("_number") <= i["high"]))
    return both.withColumn(result, F.coalesce(hit, F.lit(False))).select(*pairs.columns, result)


def ancestors(edges: DataFrame, types: DataFrame) -> DataFrame:
    """(type, ancestor, distance): what types(type) reach upward along edges(parent, child), themselves at 0, by the shortest way."""
    reach = front = cut(types.select("type").distinct().select("type", F.col("type").alias("ancestor"), F.lit(0).alias("distance")))
    up = cut(edges.select("parent", "child").distinct())
    while not front.isEmpty():
        step = front.join(up, F.col("ancestor") == F.col("child")).select("type", F.col("parent").alias("ancestor"), (F.col("distance") + 1).alias("distance")).distinct()
        front = cut(step.join(reach.select("type", "ancestor"), ["type", "ancestor"], "left_anti"))
        reach = reach.unionByName(front)
    return reach


def members_of(refs: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """The declarations that refs(type, name, arity) mean: refs' rows with owner and distance.

    members(owner, name, arity) are looked up in the type and all above it.  A declaration goes where one of the same
    name and arity is found in a type below its owner, which is not above it as well; what is left unrelated, such
    as those of two interfaces, gives several rows.  A null arity asks for any; null types and names find nothing.
    """
    asked = refs.select("type", "name", "arity").distinct()
    above = cut(ancestors(edges, asked.where("type IS NOT NULL").select("type")))
    m = members.select(F.col("owner").alias("ancestor"), F.col("name").alias("_name"), F.col("arity").alias("_arity")).distinct()
    fits = (F.col("name") == F.col("_name")) & (F.col("arity").isNull() | F.col("arity").eqNullSafe(F.col("_arity")))
    found = cut(asked.join(above, "type").join(m, "ancestor").where(fits).select("type", "name", "arity", "_arity", F.col("ancestor").alias("owner"), "distance"))
    over = cut(ancestors(edges, found.select(F.col("owner").alias("type"))).where("distance > 0").select(F.col("type").alias("lower"), F.col("ancestor").alias("upper")))
    strict = over.join(over.select(F.col("lower").alias("upper"), F.col("upper").alias("lower")), ["lower", "upper"], "left_anti")
    key = ["type", "name"]
    pairs = found.join(found.select(*key, F.col("arity").alias("_a"), F.col("_arity").alias("_b"), F.col("owner").alias("lower")), key)
    pairs = pairs.where(F.col("arity").eqNullSafe(F.col("_a")) & F.col("_arity").eqNullSafe(F.col("_b")) & (F.col("owner") != F.col("lower")))
    dominated = pairs.join(strict.withColumnRenamed("upper", "owner"), ["lower", "owner"], "left_semi")
    dominated = dominated.select(*key, "arity", "_arity", "owner").distinct().alias("d")
    f = found.alias("f")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"d.{c}")) for c in (*key, "arity", "_arity", "owner")]
    left = f.join(dominated, same, "left_anti").select(F.col("type").alias("_t"), F.col("name").alias("_n"), F.col("arity").alias("_asked"), "owner", "distance").distinct()
    return refs.join(left, (F.col("type") == F.col("_t")) & (F.col("name") == F.col("_n")) & F.col("arity").eqNullSafe(F.col("_asked"))).select(*refs.columns, "owner", "distance")
