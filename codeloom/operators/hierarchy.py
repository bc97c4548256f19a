"""Parent-child links to full hierarchies: loops, depth, root, descendants, paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.keys import clean_id, digest
from codeloom.operators.references import latest_edges
from codeloom.runtime import cut, release, small

#: Sub-chains into which the children of one parent are split, so that no parent's children meet in one task.
CHAINS = 256


def parent_of(edges: DataFrame, kind: str = "contains") -> DataFrame:
    """id, parent: every id on an edge of the kind, with the parent that counts (null: none).

    Of several parents the one of the highest confidence counts (null as 0), then
    the smallest id. Edges with a null or blank end point are left out.
    """
    is_kind = F.col("type") == kind
    slim = edges.select(
        "edge_id",
        "generation_verified",
        F.coalesce(is_kind, F.lit(False)).alias("is_kind"),
        *(F.when(is_kind, clean_id(c)).alias(c) for c in ("source", "target")),
        F.when(is_kind, F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
    )
    one = latest_edges(slim, "is_kind", "source", "target", "confidence").filter("is_kind AND source IS NOT NULL AND target IS NOT NULL")
    both = F.explode(
        F.array(
            F.struct(F.col("target").alias("id"), F.struct((-F.col("confidence")).alias("c"), F.col("source").alias("parent")).alias("up")),
            F.struct(F.col("source").alias("id"), F.lit(None).cast("struct<c:double,parent:string>").alias("up")),
        )
    )
    return one.select(both.alias("r")).select("r.*").groupBy("id").agg(F.min("up").alias("up")).select("id", F.col("up.parent").alias("parent"))


def loops(links: DataFrame) -> DataFrame:
    """v: the nodes on loops of `links` (v, p), every v having one p.

    Leaves are peeled in strides that double: what has no descendant, or no
    ancestor, 2^k links away lies on no loop. When a stride removes nothing,
    following it is a permutation of what is left, which is therefore all loops.
    Takes log2(height) rounds, a chain of any length included.
    """
    step = cut(links.filter("p IS NOT NULL").select("v", "p"))
    n = step.count()
    while n:
        # keep what is reached from below, then take two strides as one, which drops what leaves at a root
        reached = step.join(step.select(F.col("p").alias("v")).distinct(), "v", "left_semi")
        ahead = step.select(F.col("v").alias("p"), F.col("p").alias("p2"))
        nxt = cut(reached.join(ahead, "p").select("v", F.col("p2").alias("p")))
        m = nxt.count()
        release(step)
        step, before, n = nxt, n, m
        if m == before:
            break
    return step.select("v")


def euler_successors(nodes: DataFrame) -> DataFrame:
    """e, nxt, depth, size: the Euler tours of the forest `nodes` (v, p, w).

    Node v is entered at e = 2v and left at 2v + 1. Siblings are chained in CHAINS
    sub-chains by a hash of v and the sub-chains are then linked, so a parent of
    any number of children is spread over tasks.
    """
    kids = nodes.filter("p IS NOT NULL").select("v", "p", (F.pmod(F.xxhash64("v"), F.lit(CHAINS))).alias("chain"))
    linked = kids.withColumn("sib", F.lead("v").over(Window.partitionBy("p", "chain").orderBy("v")))
    heads = linked.groupBy("p", "chain").agg(F.min("v").alias("first"), F.max("v").alias("last"))
    heads = heads.withColumns({"then": F.lead("first").over(Window.partitionBy("p").orderBy("chain")), "n": F.row_number().over(Window.partitionBy("p").orderBy("chain"))})
    jumps = heads.filter("then IS NOT NULL").select(F.col("last").alias("v"), F.col("then"))
    firsts = heads.filter("n = 1").select(F.col("p").alias("v"), F.col("first"))
    sibs = linked.filter("sib IS NOT NULL").select("v", F.col("sib").alias("then")).unionByName(jumps)
    all_ = nodes.join(sibs, "v", "left").join(firsts, "v", "left")
    enter = F.struct((F.col("v") * 2).alias("e"), F.coalesce(F.col("first") * 2, F.col("v") * 2 + 1).alias("nxt"), F.lit(1).alias("depth"), F.col("w").alias("size"))
    leave = F.struct((F.col("v") * 2 + 1).alias("e"), F.coalesce(F.col("then") * 2, F.col("p") * 2 + 1).alias("nxt"), F.lit(-1).alias("depth"), F.lit(0).cast("long").alias("size"))
    return all_.select(F.explode(F.array(enter, leave)).alias("x")).select("x.*")


def rank_lists(lists: DataFrame) -> DataFrame:
    """e, depth, size, tail: sums from each element to the end of its list, and the list's last element.

    Parallel list ranking by pointer doubling: every round replaces an element's
    successor by its successor's successor; elements that have reached the end
    leave the active side. log2(longest list) rounds.
    """
    rank = cut(lists.withColumn("tail", F.when(F.col("nxt").isNull(), F.col("e"))))
    while rank.filter("nxt IS NOT NULL").limit(1).count():
        ahead = rank.select(F.col("e").alias("nxt"), F.col("nxt").alias("_nxt"), F.col("depth").alias("_depth"), F.col("size").alias("_size"), F.col("tail").alias("_tail"))
        moved = rank.filter("nxt IS NOT NULL").drop("tail").join(ahead, "nxt")
        moved = moved.select("e", F.col("_nxt").alias("nxt"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("size") + F.col("_size")).alias("size"), F.col("_tail").alias("tail"))
        new = cut(rank.filter("nxt IS NULL").unionByName(moved))
        release(rank)
        rank = new
    out = rank.drop("nxt")
    out._codeloom_path = rank._codeloom_path
    return out


@dataclass
class Forest:
    """ids: k, id, pk, pid of all ids. inner: k, v, root (id), looped, on_loop, depth, below, entry, leave of the ids with children."""

    ids: DataFrame
    inner: DataFrame


def build_forest(edges: DataFrame, kind: str = "contains") -> Forest:
    """Loops and Euler tours of the hierarchy.

    Ids without children are peeled first: they weigh on their parent and need no
    place in the tours, which are built over the ids with children only. Loops are
    cut open at each of their ids, whose hanging trees are toured like any other.
    """
    ids = cut(parent_of(edges, kind).select(digest("id").alias("k"), "id", digest("parent").alias("pk"), F.col("parent").alias("pid")))
    inner_keys = ids.filter("pk IS NOT NULL").groupBy("pk").agg(F.count("*").alias("n_kids"))
    inner = cut(ids.join(inner_keys.withColumnRenamed("pk", "k"), "k").select("k", "id", "pk", "n_kids", F.monotonically_increasing_id().alias("v")))
    up = inner.select(F.col("k").alias("pk"), F.col("v").alias("p"))
    inner_kids = inner.filter("pk IS NOT NULL").groupBy(F.col("pk").alias("k")).agg(F.count("*").alias("n_inner"))
    links = inner.join(up, "pk", "left").join(inner_kids, "k", "left")
    # an id weighs one and its childless children
    links = cut(links.select("v", "p", (F.col("n_kids") - F.coalesce("n_inner", F.lit(0)) + 1).alias("w")))
    on_loop = small(loops(links))
    nodes = links.join(on_loop.withColumn("on_loop", F.lit(True)), "v", "left").select("v", F.when(F.col("on_loop").isNull(), F.col("p")).alias("p"), "w")
    nodes = cut(nodes)
    ranked = rank_lists(euler_successors(nodes))
    at = (F.col("e") % 2) == 0
    toured = ranked.groupBy(F.shiftright("e", 1).alias("v")).agg(
        F.max(F.when(at, -F.col("depth"))).cast("int").alias("depth"),
        F.max(F.when(at, F.col("size"))).alias("entry"),
        F.max(F.when(~at, F.col("size"))).alias("leave"),
        F.max(F.shiftright("tail", 1)).alias("root_v"),
    )
    loop_root = on_loop.select(F.col("v").alias("root_v"), F.lit(True).alias("looped"))
    roots = inner.select(F.col("v").alias("root_v"), F.col("id").alias("root_id"))
    used = cut(roots.join(toured.select("root_v").distinct(), "root_v"))
    out = toured.join(loop_root, "root_v", "left").join(small(used), "root_v")
    out = out.join(inner.select("v", "k"), "v").select(
        "k", "v", "root_v", "root_id", F.coalesce("looped", F.lit(False)).alias("looped"), (F.coalesce("looped", F.lit(False)) & (F.col("v") == F.col("root_v"))).alias("on_loop"), "depth", "entry", "leave"
    )
    forest = Forest(ids, cut(out))
    release(inner, links, nodes, ranked, used)
    return forest


def hierarchy(edges: DataFrame, nodes: DataFrame, packages: DataFrame, kind: str = "contains") -> DataFrame:
    """id, status, root_id, root_type, depth, n_descendants of every id on an edge of the kind.

    status is 'cycle' on a loop (an id that is its own parent too), 'below' under a
    loop, else 'tree'. Outside trees root_id and root_type are '' and the numbers
    -1. Null or blank end points, nulls in any other column, repeated rows and
    empty tables are allowed; an empty table gives an empty result.
    """
    f = build_forest(edges, kind)
    own = f.inner.select("k", "looped", "on_loop", "root_id", "depth", (F.col("entry") - F.col("leave") - 1).alias("n"))
    rows = f.ids.join(own, "k", "left")
    inner = rows.filter("root_id IS NOT NULL").select("id", "looped", "on_loop", "root_id", "depth", "n")
    over = own.select(F.col("k").alias("pk"), "looped", F.lit(False).alias("on_loop"), "root_id", (F.col("depth") + 1).alias("depth"), F.lit(0).cast("long").alias("n"))
    leaves = rows.filter("root_id IS NULL").select("id", "pk").join(over, "pk", "left")
    # an id whose edges were all ignored has neither parent nor children: a tree of its own
    leaves = leaves.select("id", F.coalesce("looped", F.lit(False)).alias("looped"), F.lit(False).alias("on_loop"), F.coalesce("root_id", "id").alias("root_id"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n", F.lit(0)).alias("n"))
    rows = cut(inner.unionByName(leaves))
    release(f.ids, f.inner)
    roots = small(cut(rows.filter("NOT looped").select("root_id").distinct()))
    types = nodes.select(clean_id("id").alias("root_id"), "type", F.coalesce("generation_created", F.lit(-1)).alias("g")).unionByName(packages.select(clean_id("id").alias("root_id"), F.lit("ext").alias("type"), F.lit(-2).alias("g")))
    types = types.join(roots, "root_id", "left_semi").groupBy("root_id").agg(F.max_by(F.coalesce("type", F.lit("")), F.struct("g", "type")).alias("root_type"))
    types = small(cut(types))
    tree = ~F.col("looped")
    return rows.join(types, "root_id", "left").select(
        "id",
        F.when(F.col("on_loop"), "cycle").when(F.col("looped"), "below").otherwise("tree").alias("status"),
        F.when(tree, F.col("root_id")).otherwise("").alias("root_id"),
        F.when(tree, F.coalesce("root_type", F.lit(""))).otherwise("").alias("root_type"),
        F.when(tree, F.col("depth")).otherwise(-1).cast("int").alias("depth"),
        F.when(tree, F.col("n")).otherwise(-1).cast("int").alias("n_descendants"),
    )


def paths(edges: DataFrame, kind: str = "contains", sep: str = " > ") -> DataFrame:
    """id, depth, path (ids from the root down) of every id in a tree, by doubling along parents."""
    step = cut(parent_of(edges, kind).select("id", F.col("parent").alias("up"), F.col("id").alias("path"), F.lit(0).alias("depth"), F.lit(0).alias("round")))
    # an id on or below a loop never runs out of parents: leave those out first
    f = build_forest(edges, kind)
    loop_k = f.inner.filter("looped").select("k")
    bad = f.ids.join(loop_k, "k", "left_semi").select("id").unionByName(f.ids.join(loop_k.withColumnRenamed("k", "pk"), "pk", "left_semi").select("id")).distinct()
    step = cut(step.join(bad, "id", "left_anti").withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1)).drop("round"))
    while step.filter("up IS NOT NULL").limit(1).count():
        ahead = step.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        moved = step.filter("up IS NOT NULL").join(ahead, "up").select("id", F.col("_up").alias("up"), F.concat("_path", F.lit(sep), "path").alias("path"), (F.col("depth") + F.col("_depth")).alias("depth"))
        new = cut(step.filter("up IS NULL").unionByName(moved))
        release(step)
        step = new
    return step.select("id", "depth", "path")


def descendants(edges: DataFrame, kind: str = "contains") -> DataFrame:
    """id, root_id, entry, leave: y lies below x exactly if both have one root_id and x.leave <= y.leave, y.entry < x.entry.

    All ids outside loops have a row. Positions count the ids from an entry or exit to
    the end of the tour, so they fall along it; ids without children share the first
    place after their parent's entry, where no other id is.
    """
    f = build_forest(edges, kind)
    own = f.inner.select("k", "looped", "root_id", "depth", "entry", "leave")
    rows = f.ids.select("k", "pk", "id").join(own, "k", "left")
    inner = rows.filter("root_id IS NOT NULL AND NOT looped").select("id", "root_id", "depth", "entry", "leave")
    over = own.select(F.col("k").alias("pk"), "looped", "root_id", (F.col("depth") + 1).alias("depth"), (F.col("entry") - 1).alias("entry"), (F.col("entry") - 2).alias("leave"))
    leaves = rows.filter("root_id IS NULL").select("id", "pk").join(over, "pk", "left").filter("looped IS NULL OR NOT looped")
    # an id whose edges were all ignored is a tree of its own
    alone = lambda c, v: F.coalesce(c, v).alias(c)
    leaves = leaves.select("id", alone("root_id", F.col("id")), alone("depth", F.lit(0)), alone("entry", F.lit(1).cast("long")), alone("leave", F.lit(0).cast("long")))
    return inner.unionByName(leaves)
