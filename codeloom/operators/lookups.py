"""Look-ups in graph and indexes, changes of edges, and edges that parsed files give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.columns import base_name, clamp01, folded_path, role_of
from codeloom.functions.frameworks import TEST_FRAMEWORKS, framework_category, npm_framework
from codeloom.functions.keys import clean_id
from codeloom.operators.graph import search_nodes


def find_edge(edges: DataFrame, source: str, target: str, type_: str) -> DataFrame:
    """The edge between two ids of one type, or none."""
    return edges.filter((F.col("source") == source) & (F.col("target") == target) & (F.col("type") == type_))


def nodes_by_role(nodes: DataFrame, role: str) -> DataFrame:
    """Components whose path shows the architectural role."""
    return nodes.filter("type = 'component'").filter(role_of(F.coalesce("file_path", F.lit("")), "language") == role)


def search_concepts(nodes: DataFrame, text: str) -> DataFrame:
    return search_nodes(nodes, text, ["concept"])


def merged_nodes(rows: DataFrame) -> DataFrame:
    """One row per id of the deliveries: of each field the last value that is not null, and the first generation of all.

    Order is (generation_created, generation_updated, loaded_at); of rows alike in it the
    greatest value counts. Null ids are no nodes. Aggregates on the map side first.
    """
    at = F.struct("generation_created", F.coalesce("generation_updated", F.lit(-1)).alias("u"), F.coalesce("loaded_at", F.lit("1900-01-01").cast("timestamp")).alias("l"))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v")))).getField("v").alias(c)
    fields = ("type", "name", "qualified_name", "description", "file_path", "language")
    return rows.filter("id IS NOT NULL").groupBy("id").agg(*(last(c) for c in fields), F.min("generation_created").alias("generation_created"), F.max("generation_updated").alias("generation_updated"))


def merged_evidence(rows: DataFrame) -> DataFrame:
    """source, target, type, evidence: all evidence of the edges merged, each entry once, surest first.

    Of an edge_id all deliveries of its highest generation_verified count. Entries are
    made distinct before they are gathered, so a pair delivered under many edge_ids
    brings each entry once.
    """
    w = Window.partitionBy("edge_id").orderBy(F.desc_nulls_last("generation_verified"))
    one = rows.select("edge_id", "generation_verified", clean_id("source").alias("source"), clean_id("target").alias("target"), "type", "evidence").withColumn("_r", F.rank().over(w)).filter("_r = 1")
    entries = one.filter("source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL").select("source", "target", "type", F.explode("evidence").alias("e")).distinct()
    ordered = F.sort_array(F.collect_list(F.struct((-F.coalesce("e.confidence", F.lit(0.0))).alias("k"), F.col("e").alias("e"))))
    return entries.groupBy("source", "target", "type").agg(F.transform(ordered, lambda x: x["e"]).alias("evidence"))


def evidence_rows(rows: DataFrame, least: float = 0.0, resolutions: list[str] | None = None) -> DataFrame:
    """edge_id, place (from 1), kind, resolution, confidence of the evidence entries of the confidence and resolutions asked for, surest first; ties as delivered.

    A null confidence is 0. Repeated rows of an edge give their entries once.
    """
    e = rows.select("edge_id", F.posexplode("evidence").alias("at", "e")).select("edge_id", "at", F.col("e.type").alias("kind"), F.col("e.resolution").alias("resolution"), F.coalesce("e.confidence", F.lit(0.0)).alias("confidence")).distinct().filter(F.col("confidence") >= least)
    if resolutions is not None:
        e = e.filter(F.col("resolution").isin(resolutions))
    w = Window.partitionBy("edge_id").orderBy(F.desc("confidence"), "at", F.asc_nulls_first("kind"), F.asc_nulls_first("resolution"))
    return e.withColumn("place", F.row_number().over(w)).select("edge_id", "place", "kind", "resolution", "confidence")


def file_index(files: DataFrame) -> DataFrame:
    """file_path, language (lower case), generation, byte_count: the latest entry of each path."""
    f = files.filter("file_path IS NOT NULL").select("file_path", F.lower("language").alias("language"), "generation", "byte_count", "file_id")
    return f.groupBy("file_path").agg(F.max(F.struct("generation", "file_id", "language", "byte_count")).alias("f")).select("file_path", "f.language", "f.generation", "f.byte_count")


def symbol_index(files: DataFrame) -> DataFrame:
    """file_path, name, kind: the symbols of all files, once each."""
    s = files.filter("file_path IS NOT NULL").select("file_path", F.explode("symbols").alias("s")).select("file_path", "s.name", "s.kind")
    return s.filter("name IS NOT NULL").distinct()


def add_symbols(index: DataFrame, more: DataFrame) -> DataFrame:
    """The index with further entries, once each."""
    return index.unionByName(more.select(*index.columns)).distinct()


def remove_files(index: DataFrame, paths: DataFrame) -> DataFrame:
    """The index without the entries of the paths (file_path)."""
    return index.join(paths.select("file_path").distinct(), "file_path", "left_anti")


def search_symbols(index: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """Entries whose name holds the text, in any case."""
    hit = index.filter(F.lower("name").contains(text.lower()))
    return hit if kind is None else hit.filter(F.col("kind") == kind)


def symbols_without_node(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries that no node of their file stands for by name."""
    known = nodes.filter("type IN ('symbol', 'component', 'database-table') AND file_path IS NOT NULL AND name IS NOT NULL").select("file_path", "name").distinct()
    return index.join(known, ["file_path", "name"], "left_anti")


def edges_at(rows: DataFrame, generation: int) -> DataFrame:
    """source, target, type, confidence, resolution of the edges as they were delivered up to a generation, one a natural key: the last delivery counts."""
    r = rows.filter(F.col("generation_verified") <= generation).select(clean_id("source").alias("source"), clean_id("target").alias("target"), "type", clamp01(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), "resolution", "generation_verified")
    r = r.filter("source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL")
    return r.groupBy("source", "target", "type").agg(F.max(F.struct("generation_verified", "confidence", "resolution")).alias("e")).select("source", "target", "type", "e.confidence", "e.resolution")


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """source, target, type, change_type, changed_fields between two snapshots of edges: confidence counts beyond 0.05."""
    key = ["source", "target", "type"]
    a = before.select(*key, F.struct("confidence", "resolution").alias("a"))
    b = after.select(*key, F.struct("confidence", "resolution").alias("b"))
    # one exchange: both sides in one table, a key's two rows side by side
    none = lambda x: F.lit(None).cast(x)
    kind = "struct<confidence:double,resolution:string>"
    both = a.withColumn("b", none(kind)).unionByName(b.withColumn("a", none(kind)).select(*key, "a", "b")).groupBy(*key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    moved = F.when(F.abs(F.col("a.confidence") - F.col("b.confidence")) > 0.05, "confidence")
    other = F.when(~F.col("a.resolution").eqNullSafe(F.col("b.resolution")), "resolution")
    fields = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.concat_ws(",", moved, other)).otherwise("")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(fields != "", "modified")
    return both.select(*key, change.alias("change_type"), fields.alias("changed_fields")).filter("change_type IS NOT NULL")


def frameworks_of_tests(imports: DataFrame) -> DataFrame:
    """name, category of the test frameworks that imports (source) show by a part of their name."""
    hit = F.array_compact(F.array(*(F.when(F.col("source").contains(p), n) for p, n in TEST_FRAMEWORKS)))
    return imports.select(F.explode(hit).alias("name")).distinct().withColumn("category", F.lit("testing"))


def project_frameworks(manifests: DataFrame) -> DataFrame:
    """file_path, framework, version, category of package.json files (file_path, content) that name a known framework."""
    m = manifests.filter(base_name("file_path") == "package.json").select("file_path", npm_framework("content").alias("f")).filter("f IS NOT NULL")
    return m.select("file_path", "f.framework", "f.version", framework_category("f.framework").alias("category"))


def sql_symbols(columns: DataFrame) -> DataFrame:
    """file_id, name, qualified_name, kind: a symbol for each table and each column of table definitions (file_id, table_name, column_name)."""
    t = columns.select("file_id", F.col("table_name").alias("name"), F.concat(F.lit("table:"), "table_name").alias("qualified_name"), F.lit("table").alias("kind")).distinct()
    name = F.concat_ws(".", "table_name", "column_name")
    return t.unionByName(columns.select("file_id", name.alias("name"), F.concat(F.lit("column:"), name).alias("qualified_name"), F.lit("column").alias("kind")).distinct())


def module_projects(modules: DataFrame, projects: DataFrame) -> DataFrame:
    """source, target: each module (path) is contained in the first project (path, seq) whose path begins its own, or is '.'.

    Only prefixes of module paths matter, so an equi-join on them takes the place of a
    comparison of all modules with all projects.
    """
    p = projects.groupBy("path").agg(F.min("seq").alias("seq"))
    heads = modules.select(F.col("path").alias("module"), F.explode(F.array_union(F.transform(F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1))), lambda i: F.substring(F.col("path"), F.lit(1), i)), F.array(F.lit(".")))).alias("path"))
    first = heads.join(p, "path").groupBy("module").agg(F.min_by("path", F.struct("seq", "path")).alias("path"))
    return first.select(F.concat(F.lit("project:"), "path").alias("source"), F.concat(F.lit("module:"), "module").alias("target"))


def _edge(source, target, type_: str, confidence: float = 0.9):
    return source.alias("source"), target.alias("target"), F.lit(type_).alias("type"), F.lit(confidence).alias("confidence")


def specifier_edges(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from a file to the symbols that it imports by name: resolved (file, target, specifiers), symbols (file, name, id, seq); the first of a name counts."""
    named = resolved.select("file", F.col("target").alias("of"), F.explode("specifiers").alias("name")).distinct()
    first = symbols.groupBy(F.col("file").alias("of"), "name").agg(F.min_by("id", F.struct("seq", "id")).alias("id"))
    return named.join(first, ["of", "name"]).select(*_edge(F.col("file"), F.col("id"), "depends-on")).distinct()


def package_edges(imports: DataFrame) -> DataFrame:
    """Edges from a file to the external package of each import that is no path (file, source)."""
    return imports.filter("NOT (source LIKE '.%' OR source LIKE '/%')").select(*_edge(F.col("file"), F.concat(F.lit("ext:"), "source"), "uses-package")).distinct()


def key_edges(keys: DataFrame) -> DataFrame:
    """Edges from a table to the tables that its foreign keys name, where those are known: keys (table_name, references_table), all tables among table_name of `keys` or references."""
    tables = keys.select(F.col("table_name").alias("references_table")).distinct()
    return keys.filter("references_table IS NOT NULL").join(tables, "references_table", "left_semi").select(*_edge(F.concat(F.lit("table:"), "table_name"), F.concat(F.lit("table:"), "references_table"), "depends-on")).distinct()


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file, target, source, specifiers of relative imports (file_path, source, specifiers) whose file is known: the first of the candidate paths that exists."""
    from codeloom.operators.build import CANDIDATES

    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    stem = F.concat(folder, F.lit("/"), "source")
    raw = [F.concat(stem, F.lit(c)) for c in CANDIDATES] + [F.regexp_replace(stem, r"\.js$", ".ts")]
    tried = imports.filter("source LIKE '.%' OR source LIKE '/%'").select("file_path", "source", "specifiers", F.posexplode(F.array(*raw)).alias("place", "raw")).withColumn("path", folded_path("raw"))
    known = files.select(folded_path("file_path").alias("path"), F.col("file_path").alias("target")).groupBy("path").agg(F.min("target").alias("target"))
    return tried.join(known, "path").groupBy(F.col("file_path").alias("file"), "source", "specifiers").agg(F.min_by("target", "place").alias("target")).select("file", "target", "source", "specifiers")


# What types are said to derive from, by language: (pattern, group of the name, groups of bases to extend, group of a list to implement).
_BASES = {
    "typescript": (r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)(?:<[^>{]*>)?(?:\s+extends\s+([\w.]+)(?:<[^>{]*>)?)?(?:\s+implements\s+([^{]+))?\s*\{", 1, 2, 3),
    "java": (r"(?m)^[ \t]*(?:(?:public|private|protected|abstract|final|static|sealed)\s+)*(?:class|record|enum)\s+(\w+)(?:<[^>{]*>)?(?:\([^)]*\))?(?:\s+extends\s+([\w.]+)(?:<[^>{]*>)?)?(?:\s+implements\s+([^{]+))?\s*\{", 1, 2, 3),
    "csharp": (r"(?m)^[ \t]*(?:(?:public|private|protected|internal|abstract|sealed|static|partial)\s+)*(?:class|record|struct)\s+(\w+)(?:<[^>{]*>)?\s*:\s*([\w.]+)(?:<[^>{]*>)?(?:\s*,\s*([^{]+?))?\s*(?:\{|\r?$)", 1, 2, 3),
    "python": (r"(?m)^[ \t]*class\s+(\w+)\(\s*([\w.]+)(?:\s*,\s*([^)]*))?\)\s*:", 1, 2, 3),
}
_BASES["javascript"] = _BASES["typescript"]


def base_types(files: DataFrame) -> DataFrame:
    """file_id, name, relation, base: what the classes of each file extend or implement, by the rules of its language.

    In C# and Python the first base is extended and the others are implemented. Type
    arguments are left off. Texts are read once and not shuffled; repeated rows give one.
    """
    found = None
    for language, (pattern, name, one, many) in _BASES.items():
        zipped = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), name).alias("name"), F.regexp_extract_all("content", F.lit(pattern), one).alias("one"), F.regexp_extract_all("content", F.lit(pattern), many).alias("many"))
        found = F.when(F.col("language") == language, zipped) if found is None else found.when(F.col("language") == language, zipped)
    t = files.filter("content IS NOT NULL").select("file_id", F.explode(found).alias("t")).select("file_id", "t.name", "t.one", F.split(F.regexp_replace("t.many", "<[^<>]*>", ""), ",").alias("many"))
    bare = lambda c: F.regexp_extract(c, r"([\w.]+)", 1)
    bases = F.concat(F.array(F.struct(F.lit("extends").alias("relation"), bare(F.col("one")).alias("base"))), F.transform("many", lambda b: F.struct(F.lit("implements").alias("relation"), F.when(b.contains("="), "").otherwise(bare(b)).alias("base"))))
    return t.select("file_id", "name", F.explode(bases).alias("b")).select("file_id", "name", "b.relation", "b.base").filter("base <> ''").distinct()


def imports_with_names(files: DataFrame) -> DataFrame:
    """file_id, file_path, line_no, source, specifiers of the imports of TypeScript, JavaScript and Go, which may run over lines.

    A statement is cut out of its text whole, so nothing is exploded but imports.
    Specifiers are the default, the namespace and the named parts by their own names;
    of Go the last part of each path. Of Go the first block counts, else all single
    imports, all told of line 1. Repeated rows give one.
    """
    f = files.filter("content IS NOT NULL").select("file_id", "file_path", "language", F.regexp_replace("content", "\r\n", "\n").alias("t"))
    start = r"(?m)(^|;)([ \t]*import\b[^'\"();]*['\"][^'\"\n]+['\"])"
    marked = F.split(F.regexp_replace("t", start, "$1\u0001$2"), "\u0001")
    before = lambda i: F.array_join(F.slice(F.col("parts"), 1, i), "")
    ts = f.filter("language IN ('typescript', 'javascript')").select("file_id", "file_path", marked.alias("parts")).filter(F.size("parts") > 1)
    ts = ts.select("file_id", "file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.struct((1 + F.length(before(i)) - F.length(F.replace(before(i), F.lit("\n"), F.lit("")))).alias("line_no"), F.get(F.col("parts"), i).alias("s")))).alias("x")).select("file_id", "file_path", "x.line_no", F.regexp_extract("x.s", r"^\s*(import\b[^'\"]*['\"][^'\"\n]+['\"])", 1).alias("s"))
    clause = F.regexp_extract("s", r"^import\s*(?:type\s+)?([^'\"]*?)\s*(?:from\s*)?['\"]", 1)
    named = F.transform(F.split(F.regexp_extract(clause, r"\{([^}]*)\}", 1), ","), lambda p: F.regexp_extract(p, r"^\s*(?:type\s+)?([\w$*]+)", 1))
    parts = F.concat(F.array(F.regexp_extract(clause, r"^([\w$]+)", 1), F.regexp_extract(clause, r"\*\s*as\s+([\w$]+)", 1)), named)
    ts = ts.select("file_id", "file_path", "line_no", F.regexp_extract("s", r"['\"]([^'\"\n]+)['\"]$", 1).alias("source"), F.filter(parts, lambda p: p != "").alias("specifiers"))
    block = F.regexp_extract("t", r"import\s*\(([\s\S]*?)\)", 1)
    quoted = F.when(F.col("t").rlike(r"import\s*\("), F.regexp_extract_all(block, F.lit('"([^"]+)"'), 1)).otherwise(F.regexp_extract_all("t", F.lit('(?m)^\\s*import\\s+"([^"]+)"'), 1))
    go = f.filter("language = 'go'").select("file_id", "file_path", F.lit(1).alias("line_no"), F.explode(quoted).alias("source")).withColumn("specifiers", F.array(F.element_at(F.split("source", "/"), -1)))
    return ts.unionByName(go).filter("source <> ''").distinct()
