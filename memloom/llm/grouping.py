"""Problem 5: pairwise matches consolidated into groups by deterministic Borůvka hooking.

In a round every component picks its smallest outgoing edge and hooks onto the component at its other end. Edges are ordered by their
two ends, so the picks form trees (the only cycles are two components that picked the same edge; the smaller becomes the root).
Pointer doubling collapses the trees, edges are relabelled and deduplicated, and the number of components that still have an edge at
least halves: rounds grow with the logarithm of the vertices, however long the chains or large the hubs are.

Defined results: pairs with a null end or two equal ends link nothing; repeated pairs change nothing; vertices that appear in no pair
are not in the result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.session import cut, forget


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).dropDuplicates()


def _collapse(parents: DataFrame) -> DataFrame:
    """Every vertex x directly under the root of its tree; parents has (x, p), roots with p = x, and is used up."""
    while True:
        up = parents.select(F.col("x").alias("p"), F.col("p").alias("q"))
        doubled = cut(parents.join(up, "p").select("x", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
        forget(parents)
        parents = doubled
        if doubled.where("moved").isEmpty():
            return parents


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (vertex, component) of every vertex in a pair; component is a vertex of the group, the same for all in it."""
    edges = cut(_ordered(pairs, a, b))
    members = cut(edges.select(F.explode(F.array("a", "b")).alias("vertex")).dropDuplicates().withColumn("component", F.col("vertex")))
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"), "a", "b")
        pick = ends.groupBy(F.col("e.x").alias("x")).agg(F.min(F.struct("a", "b", F.col("e.y").alias("y"))).alias("m")).select("x", F.col("m.y").alias("p"))  # both sides of the join share its shuffle
        back = pick.select(F.col("x").alias("p"), F.col("p").alias("back"))
        rooted = cut(pick.join(back, "p").select("x", F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("p")), F.col("x")).otherwise(F.col("p")).alias("p")))
        roots = _collapse(rooted)
        to = roots.select(F.col("x").alias("component"), F.col("p").alias("_to"))
        moved = cut(members.join(to, "component", "left").select("vertex", F.coalesce("_to", "component").alias("component")))
        left, right = roots.select(F.col("x").alias("a"), F.col("p").alias("_a")), roots.select(F.col("x").alias("b"), F.col("p").alias("_b"))
        fewer = cut(_ordered(edges.join(left, "a").join(right, "b"), "_a", "_b"))
        forget(roots, members, edges)
        members, edges = moved, fewer
    forget(edges)
    return members


def relation_pairs(relations: DataFrame, facts: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Rows (a, b) that link the facts of each relation of the given types in a star; ids as written in facts.

    Types and ids compare without case and surrounding white space; null and unknown ids are ignored. relations: relation_id, type,
    source_fact_ids; facts: fact_id.
    """
    bare = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    known = facts.where("fact_id IS NOT NULL").groupBy(bare(F.col("fact_id")).alias("_k")).agg(F.min("fact_id").alias("fact"))
    named = relations.where(bare(F.col("type")).isin(*types)).select("relation_id", F.explode(F.array_distinct(F.transform("source_fact_ids", bare))).alias("_k"))
    named = named.join(known, "_k").select("relation_id", "fact")
    hub = named.groupBy("relation_id").agg(F.min("fact").alias("hub"))
    return named.join(hub, "relation_id").where("fact != hub").select(F.col("hub").alias("a"), F.col("fact").alias("b")).dropDuplicates()


def groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (vertex, group_id) with the smallest vertex of the group as its identifier."""
    members = components(pairs, a, b)
    smallest = members.groupBy("component").agg(F.min("vertex").alias("group_id"))
    return members.join(smallest, "component").select("vertex", "group_id")
