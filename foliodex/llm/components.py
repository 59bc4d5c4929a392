"""Connected components of an edge table, without collecting links or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges (a, b) between the names (id, name) of their ends, each once and none from a name to itself."""
    for end in ("a", "b"):
        known = names.select(F.col("id").alias(end), F.col("name").alias("known"))
        edges = edges.join(known, end, "left").withColumn(end, F.coalesce("known", end)).drop("known")
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", known: DataFrame | None = None) -> DataFrame:
    """id, component (smallest id reachable) for every id that an edge names.

    By randomised contraction: each round gives a vertex the least of itself and its neighbours, in an order by
    hash that is new every other round (the second round ends stars), as its name, and goes on with the edges between different
    names. What is left out had both ends in one component, or repeats an edge, so no connection is lost, while under a new
    order a quarter of the vertices goes in expectation, whatever the graph (long paths too), and a group's many
    links fall together in the first rounds instead of being joined again in all. The names are then followed back from
    the last round to the first. Tables between rounds are written, so a vertex with very many edges is only ever the key of joins
    of plain exchanges, which adaptive execution splits.

    With `known`, what this function returned for other edges, the result is that of all edges together; only the components meet.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    if known is not None:
        left = _renamed(left, known.withColumnRenamed("component", "name"))
    left = stored(left, "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        rank = lambda v: F.struct(F.xxhash64(v, F.lit(len(rounds) // 2)).alias("h"), F.col(v).alias("id"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        rounds.append(stored(least.select(F.col("a").alias("id"), F.least(rank("a"), F.col("near"))["id"].alias("name")), "names"))
        left = stored(_renamed(left, rounds[-1]), "edges")
    if not rounds:
        return known if known is not None else left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    named = rounds.pop()
    while rounds:
        further = named.select(F.col("id").alias("name"), F.col("name").alias("further"))
        named = stored(rounds.pop().join(further, "name", "left").select("id", F.coalesce("further", "name").alias("name")), "names")
    smallest = named.groupBy("name").agg(F.min("id").alias("component"))
    found = stored(named.join(smallest, "name").select("id", "component"), "components")
    if known is None:
        return found
    further = found.select(F.col("id").alias("component"), F.col("component").alias("further"))
    old = known.join(further, "component", "left").select("id", F.coalesce("further", "component").alias("component"))
    return stored(old.unionByName(found.join(known, "id", "left_anti")), "components")
