"""References to records that do not exist (orphan references)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import clean_id, digest

#: Open end of a lifetime.
NEVER = 2**31 - 1


def latest_edges(edges: DataFrame, *columns: str) -> DataFrame:
    """One row per edge_id: of its rows the one with the highest generation_verified (null is lowest).

    Rows that tie are copies by contract; the greatest by the given columns is
    taken, so that the result is defined even where they differ. A null edge_id is
    an id like any other.
    """
    best = F.max(F.struct(F.coalesce("generation_verified", F.lit(-(2**31))).alias("g"), *columns)).alias("best")
    return edges.groupBy("edge_id").agg(best).select("edge_id", F.nullif("best.g", F.lit(-(2**31))).alias("generation_verified"), *(f"best.{c}" for c in columns))


def edge_endpoints(edges: DataFrame) -> DataFrame:
    """Long form of the latest edges: edge_id, endpoint, k (key of the cleaned id), is_package, g. Blank or null end points are no references."""
    keyed = edges.select("edge_id", "generation_verified", *(F.struct(digest(clean_id(c)).alias("k"), clean_id(c).startswith("ext:").alias("is_package")).alias(c) for c in ("source", "target")))
    ends = F.explode(F.array(*(F.struct(F.lit(c).alias("endpoint"), F.col(f"{c}.k").alias("k"), F.col(f"{c}.is_package").alias("is_package")) for c in ("source", "target")))).alias("e")
    return latest_edges(keyed, "source", "target").select("edge_id", F.col("generation_verified").alias("g"), ends).select("edge_id", "g", "e.*").filter("k IS NOT NULL")


def lifetimes(*parents: DataFrame) -> DataFrame:
    """k, born, gone of every distinct lifetime in the parent tables. A null generation_created is a life from the start."""
    one = None
    for p in parents:
        t = p.select(
            digest(clean_id("id")).alias("k"),
            F.coalesce("generation_created", F.lit(-(2**31))).alias("born"),
            F.coalesce("generation_removed", F.lit(NEVER)).alias("gone"),
        ).filter("k IS NOT NULL")
        one = t if one is None else one.unionByName(t)
    return one.distinct()


def orphan_keys(ends: DataFrame, lives: DataFrame) -> DataFrame:
    """k, is_package, g, reason, and n references by endpoint of every key without a living parent at g.

    Tagged parent and child keys are united in long form and grouped by key. The
    child side is counted by (key, period) on the map side first, so a key that
    holds a third of all references reaches its group as one row per period.
    """
    children = ends.groupBy("k", "is_package", "g").agg(
        F.count_if(F.col("endpoint") == "source").alias("n_source"), F.count_if(F.col("endpoint") == "target").alias("n_target")
    )
    life = F.struct("born", "gone")
    child = F.struct("g", "is_package", "n_source", "n_target")
    tagged = lives.select("k", life.alias("life"), F.lit(None).cast(children.select(child.alias("c")).schema["c"].dataType).alias("child")).unionByName(
        children.select("k", F.lit(None).cast(lives.select(life.alias("l")).schema["l"].dataType).alias("life"), child.alias("child"))
    )
    grouped = tagged.groupBy("k").agg(F.collect_list("life").alias("lives"), F.collect_list("child").alias("children")).filter(F.size("children") > 0)
    one = grouped.select("k", "lives", F.explode("children").alias("c"))
    g = F.col("c.g")
    reason = (
        F.when(F.size("lives") == 0, "missing")
        .when(g.isNull() | F.exists("lives", lambda x: (x.born <= g) & (x.gone > g)), None)
        .when(F.exists("lives", lambda x: x.born <= g), "deleted")
        .otherwise("late")
    )
    return one.select("k", "c.*", reason.alias("reason")).filter("reason IS NOT NULL")


def orphan_references(edges: DataFrame, *parents: DataFrame) -> DataFrame:
    """edge_id, endpoint, reason of every end point that had no living parent row when its edge was last verified.

    reason: 'missing' no parent row has the id; 'late' all begin after the edge's
    generation; 'deleted' some began, none lives. An edge never verified (null
    generation) is only a case if the id is missing. Empty tables give an empty or
    all-missing result. Columns beyond those named are ignored.
    """
    ends = edge_endpoints(edges)
    orphans = orphan_keys(ends, lifetimes(*parents)).select("k", "g", "reason")
    found = ends.join(orphans.withColumnRenamed("k", "ok").withColumnRenamed("g", "og"), (F.col("k") == F.col("ok")) & F.col("g").eqNullSafe(F.col("og")))
    return found.select("edge_id", "endpoint", "reason")


def orphan_report(edges: DataFrame, nodes: DataFrame, packages: DataFrame) -> DataFrame:
    """References without a living parent, counted per node table, generation, reason."""
    found = orphan_keys(edge_endpoints(edges), lifetimes(nodes, packages))
    return found.groupBy(F.when(F.col("is_package"), "package_nodes").otherwise("graph_nodes").alias("node_table"), F.col("g").alias("generation"), "reason").agg(
        F.count("*").alias("n_ids"), F.sum("n_source").alias("n_sources"), F.sum("n_target").alias("n_targets")
    )
