"""Reports over graph and files: architecture, quality, documentation, changes, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators.graph import strongly_connected
from codeloom.runtime import cut, small


def beside(*rows: DataFrame) -> DataFrame:
    """Tables of one row each side by side, by an equi-join on a constant."""
    out = rows[0].withColumn("_one", F.lit(1))
    for r in rows[1:]:
        out = out.join(r.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def one_per_file(files: DataFrame, *columns: str) -> DataFrame:
    """One row per file_id of repeated deliveries."""
    return files.select("file_id", *columns).dropDuplicates(["file_id"])


def language_distribution(nodes: DataFrame) -> DataFrame:
    """language, files, symbols, percent of the files."""
    g = nodes.filter("type IN ('file', 'symbol') AND language IS NOT NULL").groupBy("language").agg(F.count_if(F.col("type") == "file").alias("files"), F.count_if(F.col("type") == "symbol").alias("symbols"))
    return g.withColumn("percent", C.floor_round(F.col("files") * 100.0 / F.greatest(F.sum("files").over(Window.partitionBy()), F.lit(1))))


def layer_distribution(files: DataFrame) -> DataFrame:
    return one_per_file(files, "file_path").groupBy(C.layer_of("file_path").alias("layer")).agg(F.count("*").alias("n"))


def test_ratio(files: DataFrame) -> DataFrame:
    f = one_per_file(files, "file_path")
    is_test = C.layer_of("file_path") == "test"
    return f.agg(F.count("*").alias("n_files"), F.count_if(is_test).alias("n_tests"), C.floor_round(F.count_if(is_test) * 100.0 / F.greatest(F.count("*"), F.lit(1)), 1).alias("percent"))


def patterns(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """pattern: architectural patterns that names and counts show; 'unknown' if none does."""
    low = F.lower("file_path")
    names = F.transform(F.coalesce("symbols", F.array()), lambda s: F.lower(F.coalesce(s["name"], F.lit(""))))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    seen = files.agg(
        some(low.contains("controller")).alias("controllers"),
        some(low.contains("model")).alias("models"),
        some(low.contains("view") | F.col("file_path").endswith(".tsx") | F.col("file_path").endswith(".jsx")).alias("views"),
        some(low.contains("service")).alias("services"),
        some(low.contains("repository") | low.contains("dao")).alias("repositories"),
        some(F.exists(names, lambda n: n.contains("queue") | n.contains("event") | n.contains("subscriber") | n.contains("publisher"))).alias("queues"),
    )
    many = nodes.agg((F.count_if(F.col("type") == "project") > 3).alias("a"), (F.count_if(F.col("type") == "service") > 2).alias("b"))
    row = beside(seen, many)
    found = F.array_compact(F.array(F.when(F.expr("controllers AND models AND views"), "mvc"), F.when(F.expr("controllers AND services AND repositories"), "layered"), F.when(F.expr("a OR b"), "microservices"), F.when(F.col("queues"), "event-driven")))
    return row.select(F.explode(F.when(F.size(found) == 0, F.array(F.lit("unknown"))).otherwise(found)).alias("pattern"))


def module_coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out, instability, rating of every module."""
    out = edges.filter("type IN ('imports', 'depends-on', 'uses-package')").select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    into = edges.filter("type IN ('imports', 'depends-on')").select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    n = out.unionByName(into).groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    m = nodes.filter("type = 'module'").select("id").join(n, "id", "left").fillna(0, ["fan_in", "fan_out"])
    raw = F.when(F.col("fan_in") + F.col("fan_out") > 0, F.col("fan_out") / (F.col("fan_in") + F.col("fan_out"))).otherwise(0.0)
    return m.select("id", "fan_in", "fan_out", C.floor_round(raw, 2).alias("instability"), C.instability_rating(raw).alias("rating"))


def file_complexity(files: DataFrame) -> DataFrame:
    """id, cc, rating: cyclomatic estimate of every file with a text."""
    # the highest of a path's deliveries counts, so no text is shuffled to drop copies
    f = files.select("file_path", "content").filter("content IS NOT NULL")
    return f.groupBy(F.concat(F.lit("file:"), "file_path").alias("id")).agg(F.max(C.complexity("content")).alias("cc")).withColumn("rating", C.complexity_rating(F.col("cc")))


def complexity_summary(cc: DataFrame) -> DataFrame:
    """n, avg_cc, p90_desc_index (the value at nine tenths of the list from the highest on), p90."""
    # a histogram has few rows, however many values there are
    h = cc.groupBy("cc").agg(F.count("*").alias("k"))
    down, up = Window.orderBy(F.desc("cc")), Window.orderBy("cc")
    h = h.select("cc", "k", F.sum("k").over(down).alias("above"), F.sum("k").over(up).alias("below"), F.sum("k").over(Window.partitionBy()).alias("n"))
    nth = lambda upto, place: F.max(F.when((F.col(upto) >= place) & (F.col(upto) - F.col("k") < place), F.col("cc")))
    return h.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n"),
        C.floor_round(F.sum(F.col("cc") * F.col("k")) / F.sum("k"), 2).alias("avg_cc"),
        nth("above", F.floor(F.col("n") * 0.9) + 1).alias("p90_desc_index"),
        nth("below", F.ceil(F.col("n") * 0.9)).alias("p90"),
    )


def hotspots(cc: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """id, cc, coupling, score of the riskiest files."""
    touch = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("coupling"))
    top = cc.agg(F.max("cc")).first()[0] or 1
    j = cc.select("id", "cc").filter("cc >= 5").join(touch, "id", "left").fillna(0, ["coupling"])
    score = C.floor_round(F.least(F.lit(100.0), F.col("cc") * 100.0 / max(top, 1)) * 0.6 + F.least(F.lit(100.0), F.col("coupling") * 5.0) * 0.4)
    return j.withColumn("score", score).filter("score >= 30").orderBy(F.desc("score"), "id").limit(limit).select("id", "cc", "coupling", "score")


def maintainability(nodes: DataFrame, files: DataFrame, edges: DataFrame, cycle_types: list[str], cycle_edges: DataFrame | None = None) -> DataFrame:
    """One row: averages, cycles (of cycle_edges if given), hot spots, score and grade."""
    cc = cut(file_complexity(files))
    parts = beside(
        cc.agg(F.coalesce(F.avg("cc"), F.lit(1.0)).alias("avg_cc")),
        module_coupling(nodes, edges).agg(F.coalesce(F.avg("instability"), F.lit(0.0)).alias("avg_instability")),
        strongly_connected(edges if cycle_edges is None else cycle_edges, cycle_types).agg(F.countDistinct("component").alias("n_cycles")),
        hotspots(cc, edges).agg(F.count("*").alias("n_hot")),
    )
    score = C.maintainability(F.col("avg_cc"), F.col("avg_instability"), F.col("n_cycles"), F.col("n_hot"))
    return parts.select("n_cycles", "n_hot", score.cast("int").alias("score"), C.maintainability_grade(score).alias("grade"))


def doc_gaps(nodes: DataFrame) -> DataFrame:
    """id, kind, severity of what lacks documentation: symbols, components, endpoints, tables, modules without README."""
    text = F.length(F.trim(F.coalesce("description", F.lit(""))))
    skip = (C.layer_of(F.coalesce("file_path", F.lit(""))) == "test") | F.coalesce(F.col("name").startswith("_"), F.lit(False))
    public = ~F.coalesce(F.lower("file_path").contains("/internal/"), F.lit(False))
    symbols = nodes.filter(F.col("type").isin("symbol", "component") & ~skip & (text <= 10)).select("id", F.lit("symbol").alias("kind"), F.when(public, "critical").otherwise("warning").alias("severity"))
    endpoints = nodes.filter("type = 'api-endpoint' AND description IS NULL").select("id", F.lit("endpoint").alias("kind"), F.lit("warning").alias("severity"))
    tables = nodes.filter((F.col("type") == "database-table") & (F.length(F.coalesce("description", F.lit(""))) <= 5)).select("id", F.lit("table").alias("kind"), F.lit("info").alias("severity"))
    readme = nodes.filter("type = 'file'").select(F.regexp_extract(F.lower("file_path"), r"^(.*)/readme(?:\.[a-z]+)?$", 1).alias("path")).filter("path <> ''").distinct()
    modules = nodes.filter("type = 'module'").select("id", F.col("file_path").alias("path")).join(readme, "path", "left_anti").select("id", F.lit("module").alias("kind"), F.lit("info").alias("severity"))
    return symbols.unionByName(endpoints).unionByName(tables).unionByName(modules)


def doc_health(nodes: DataFrame) -> DataFrame:
    """One row: symbols audited and documented, coverage, grade, gaps."""
    skip = (C.layer_of(F.coalesce("file_path", F.lit(""))) == "test") | F.coalesce(F.col("name").startswith("_"), F.lit(False))
    audited = nodes.filter(F.col("type").isin("symbol", "component") & ~skip)
    a = audited.agg(F.count("*").alias("audited"), F.count_if(F.length(F.trim(F.coalesce("description", F.lit("")))) > 10).alias("documented"))
    percent = F.when(F.col("audited") == 0, F.lit(100)).otherwise(C.floor_round(F.col("documented") * 100.0 / F.col("audited"))).cast("int")
    return beside(a, doc_gaps(nodes).agg(F.count("*").alias("n_gaps"))).withColumn("coverage", percent).withColumn("grade", C.coverage_grade(percent))


def confidence_summary(edges: DataFrame) -> DataFrame:
    """One row: average confidence and edges of each resolution; zeros for none."""
    return edges.agg(F.count("*").alias("n"), C.floor_round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("avg_confidence"), *(F.count_if(F.col("resolution") == r).alias(f"n_{r}") for r in ("confirmed", "resolved", "heuristic", "unresolved")))


def evidence_merged(rows: DataFrame) -> DataFrame:
    """target, type, description, n: the evidence of all edges into each target, once per (type, description), and how often it was given."""
    e = rows.select(F.col("target"), F.explode("evidence").alias("e"))
    return e.groupBy("target", F.col("e.type").alias("type"), F.col("e.description").alias("description")).agg(F.count("*").alias("n"))


def edge_changes(edges: DataFrame) -> DataFrame:
    """generation, n_added, n_removed: edges by natural key that begin, or were last verified one generation before."""
    g = F.explode(F.array(F.struct(F.col("generation_created").alias("generation"), F.lit(1).alias("a"), F.lit(0).alias("r")), F.struct((F.col("generation_verified") + 1).alias("generation"), F.lit(0).alias("a"), F.lit(1).alias("r"))))
    return edges.select(g.alias("x")).select("x.*").filter("generation IS NOT NULL").groupBy("generation").agg(F.sum("a").alias("n_added"), F.sum("r").alias("n_removed"))


def changes_by_type(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """type, added, removed, modified over all pairs of generations; the type a node last had."""
    kinds = snapshots.filter("generation IS NOT NULL").groupBy("repo", "id").agg(F.max_by("type", F.struct("generation", "loaded_at", "type")).alias("type"))
    return changes.join(kinds, ["repo", "id"]).groupBy("type").pivot("change_type", ["added", "removed", "modified"]).count().fillna(0)


def churn(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """repo, from_generation, to_generation, churn: nodes added and removed against the larger snapshot."""
    size = snapshots.groupBy("repo", "generation").agg(F.countDistinct("id").alias("n"))
    c = changes.groupBy("repo", "from_generation", "to_generation").agg(F.count_if(F.col("change_type") != "modified").alias("moved"))
    c = c.join(size.select("repo", F.col("generation").alias("from_generation"), F.col("n").alias("n1")), ["repo", "from_generation"]).join(size.select("repo", F.col("generation").alias("to_generation"), F.col("n").alias("n2")), ["repo", "to_generation"])
    return c.select("repo", "from_generation", "to_generation", C.floor_round(F.col("moved") / F.greatest("n1", "n2", F.lit(1)), 2).alias("churn"))


def significant_changes(changes: DataFrame) -> DataFrame:
    """The first eight added, six removed and six modified nodes of each repo's latest pair of generations, by id."""
    last = changes.groupBy("repo").agg(F.max("to_generation").alias("to_generation"))
    c = changes.join(last, ["repo", "to_generation"], "left_semi")
    r = F.row_number().over(Window.partitionBy("repo", "change_type").orderBy("id"))
    return c.withColumn("r", r).filter(F.col("r") <= F.when(F.col("change_type") == "added", 8).otherwise(6)).select("repo", "change_type", "id")


#: Characters at the end that paths of this length or more must share for one to end with the other.
TAIL = 12


def stale_stories(stories: DataFrame, changed: DataFrame) -> DataFrame:
    """story_id, affected: the first affected path (story_id, place, path) that a changed path ends with, or that ends with one.

    Paths are matched by their last TAIL characters, shorter ones by every shorter
    end of the others, and then in full: an equi-join in place of a comparison of
    all pairs.
    """
    tail = lambda c: F.substring(c, F.greatest(F.length(c) - TAIL + 1, F.lit(1)), F.lit(TAIL))
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.least(F.length(c), F.lit(TAIL - 1))), lambda i: F.substring(c, F.length(c) - i + 1, i))
    s = stories.select("story_id", "place", "path", C.normal_path("path").alias("p")).filter(F.length("p") > 0)
    f = changed.select(C.normal_path("path").alias("f")).filter(F.length("f") > 0).distinct()
    long_s, long_f = s.filter(F.length("p") >= TAIL), f.filter(F.length("f") >= TAIL)
    short_s, short_f = s.filter(F.length("p") < TAIL), f.filter(F.length("f") < TAIL)
    both = long_s.withColumn("k", tail("p")).join(long_f.withColumn("k", tail("f")), "k").filter(F.col("f").endswith(F.col("p")) | F.col("p").endswith(F.col("f")))
    hit = both.select("story_id", "place", "path")
    hit = hit.unionByName(s.withColumn("k", F.explode(ends("p"))).join(short_f.withColumnRenamed("f", "k"), "k").select("story_id", "place", "path"))
    hit = hit.unionByName(short_s.join(f.withColumn("k", F.explode(ends("f"))), F.col("p") == F.col("k")).select("story_id", "place", "path"))
    return hit.groupBy("story_id").agg(F.min(F.struct("place", "path")).alias("m")).select("story_id", F.col("m.path").alias("affected"))


def stale_tests(tests: DataFrame, stale: DataFrame) -> DataFrame:
    """Test stories (test_id, story_id) of stale stories."""
    return tests.join(small(cut(stale.select("story_id").distinct())), "story_id", "left_semi")
