"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.runtime import cut, small

#: Fields whose change makes a node modified, in the order they are reported.
FIELDS = ("name", "description", "type", "content", "size")


def snapshot_index(snapshots: DataFrame) -> DataFrame:
    """repo, generation, idx, before, after: the consecutive generations of each repo that have rows."""
    w = Window.partitionBy("repo").orderBy("generation")
    one = snapshots.select("repo", "generation").distinct()
    return one.select("repo", "generation", F.row_number().over(w).alias("idx"), F.lag("generation").over(w).alias("before"), F.lead("generation").over(w).alias("after"))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """repo, from_generation, to_generation, id, change_type, changed_fields of every change.

    Each id's delivered rows are windowed by the index of their snapshot: fields
    that differ from the row of the index before are changes, gaps in the index
    are removals and later additions. Of rows with one (repo, generation, id) the
    one loaded last counts (null is first; ties are copies, the greatest row is
    taken). A null id or repo is a value like any other; rows without a generation
    belong to no snapshot and are left out. An empty table has no changes.

    One exchange, by (repo, id), serves reduction and window: no id has more than
    one row per generation after the reduction, so a repo that holds a third of
    the rows is spread over all tasks.
    """
    index = small(cut(snapshot_index(snapshots.filter("generation IS NOT NULL"))))
    # texts are compared by a 128-bit digest, so the shuffle does not carry them
    fields = ("name", "description", "type", "hash", "size")
    md = {c: F.unhex(F.md5(c)) if c in ("name", "description") else F.col(c) for c in fields}
    rows = snapshots.filter("generation IS NOT NULL").select("repo", "generation", "id", "loaded_at", *(v.alias(c) for c, v in md.items()))
    rows = rows.repartition("repo", "id")
    newest = Window.partitionBy("repo", "id", "generation").orderBy(F.desc_nulls_last("loaded_at"), *(F.desc_nulls_last(c) for c in fields))
    rows = rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "loaded_at")
    keyed = rows.join(index.select(F.col("repo").alias("_r"), F.col("generation").alias("_g"), "idx", "before", "after"), F.col("repo").eqNullSafe(F.col("_r")) & (F.col("generation") == F.col("_g")))
    w = Window.partitionBy("repo", "id").orderBy("idx")
    now = keyed.withColumns({"prev": F.lag(F.struct("idx", *fields)).over(w), "next_idx": F.lead("idx").over(w)})
    differs = {c: ~F.col(c).eqNullSafe(F.col(f"prev.{c}")) for c in ("name", "description", "type", "size")}
    differs["content"] = (F.col("hash") != F.col("prev.hash")) & (F.col("hash") != "") & (F.col("prev.hash") != "")
    changed = F.concat_ws(",", *(F.when(differs[c], c) for c in FIELDS))
    follows = F.coalesce(F.col("prev.idx") == F.col("idx") - 1, F.lit(False))
    event = lambda a, b, kind, what: F.struct(F.col(a).alias("from_generation"), F.col(b).alias("to_generation"), F.lit(kind).alias("change_type"), what.alias("changed_fields"))
    events = F.array(
        F.when(follows & (changed != ""), event("before", "generation", "modified", changed)),
        F.when(~follows & F.col("before").isNotNull(), event("before", "generation", "added", F.lit(""))),
        F.when(F.col("after").isNotNull() & ~F.coalesce(F.col("next_idx") == F.col("idx") + 1, F.lit(False)), event("generation", "after", "removed", F.lit(""))),
    )
    return now.select("repo", "id", F.explode(F.array_compact(events)).alias("e")).select("repo", "e.from_generation", "e.to_generation", "id", "e.change_type", "e.changed_fields")


def diff_summary(snapshots: DataFrame) -> DataFrame:
    """Added, removed and modified nodes per repo and pair of generations."""
    return (
        snapshot_changes(snapshots)
        .groupBy("repo", "from_generation", "to_generation")
        .agg(*(F.count_if(F.col("change_type") == k).alias(f"n_{k}") for k in ("added", "removed", "modified")))
    )
