"""Type hierarchy: edges, direct members and transitive closures.

Closures run a frontier loop: each round joins only the nodes found in the last one, keeps what is new, and
cuts lineage in the shared folder.  A node that reaches itself is part of its closure; cycles end the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.lineage import cut


def subtype_edges(types: DataFrame) -> DataFrame:
    """(parent, child) by superclass."""
    return types.where("superclass is not null and superclass != ''").select(F.col("superclass").alias("parent"), F.col("qualified_name").alias("child")).distinct()


def implementor_edges(types: DataFrame) -> DataFrame:
    """(parent, child) by implemented or extended interface."""
    return types.select(F.explode("interfaces").alias("parent"), F.col("qualified_name").alias("child")).distinct()


def direct(edges: DataFrame, parent: str) -> DataFrame:
    return edges.where(F.col("parent") == parent).select("child")


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) for every node that a root reaches in at least one step."""
    edges = cut(edges.select("parent", "child"))  # read once, not once a round
    new = cut(roots.select("root").distinct().join(edges, F.col("root") == F.col("parent")).select("root", F.col("child").alias("node")).distinct())
    reach = new
    while not new.isEmpty():
        step = new.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        new = cut(step.join(reach, ["root", "node"], "left_anti"))
        reach = reach.union(new)
    return reach


def all_subtypes(types: DataFrame, root: str) -> DataFrame:
    spark = types.sparkSession
    return closure(subtype_edges(types), spark.createDataFrame([(root,)], "root string")).select("node")


def all_implementors(types: DataFrame, root: str, compat: bool = True) -> DataFrame:
    """Implementors of an interface, and of the interfaces found by walking on.

    compat: the walk goes from interface to interface along subtype edges only, so interfaces that extend the
    root end it.  Otherwise sub-interfaces are followed and subclasses of implementing classes are members.
    """
    spark = types.sparkSession
    start = spark.createDataFrame([(root,)], "root string")
    implements, extends = implementor_edges(types), subtype_edges(types)
    if not compat:
        return closure(implements.union(extends).distinct(), start).select("node").distinct()
    faces = types.where("kind = 'INTERFACE'").select(F.col("qualified_name").alias("child"))
    between = closure(extends.join(faces, "child", "left_semi"), start).select(F.col("node").alias("face")).union(start.select(F.col("root").alias("face"))).distinct()
    return implements.join(between, F.col("parent") == F.col("face")).select(F.col("child").alias("node")).distinct()


def qualified_superclasses(types: DataFrame) -> DataFrame:
    """Types whose superclass, where it is a simple name of the same package, is qualified by a join."""
    own = types.select(F.col("package_name").alias("_p"), F.col("simple_name").alias("_s"), F.col("qualified_name").alias("_q"))
    hit = (F.col("package_name") == F.col("_p")) & (F.col("superclass") == F.col("_s"))
    return types.join(own, hit, "left").withColumn("superclass", F.coalesce("_q", "superclass")).drop("_p", "_s", "_q")


def super_edges(types: DataFrame) -> DataFrame:
    """(parent, child) by superclass and interfaces; simple names of the same package are qualified by a join."""
    above = F.array_compact(F.concat(F.coalesce("interfaces", F.array().cast("array<string>")), F.array("superclass")))
    named = types.select("package_name", F.col("qualified_name").alias("child"), F.explode(above).alias("parent")).where("parent != ''")
    own = types.select(F.col("package_name").alias("_p"), F.col("simple_name").alias("parent"), F.col("qualified_name").alias("_q")).distinct()
    both = named.join(own, (named["package_name"].eqNullSafe(own["_p"])) & (named["parent"] == own["parent"]), "left")
    return both.select(F.coalesce("_q", named["parent"]).alias("parent"), "child").distinct()
