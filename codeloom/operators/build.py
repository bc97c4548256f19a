"""Nodes and edges built from parsed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.columns import base_name, folded_path, module_of
from codeloom.functions.rules import MANIFESTS
from codeloom.runtime import cut, small

# What an import's path may stand for, in the order in which it is tried.
CANDIDATES = ["", ".ts", ".tsx", ".js", ".jsx", ".rs", ".go", "/index.ts", "/index.js", "/mod.rs"]


def latest_files(parse_results: DataFrame) -> DataFrame:
    """One row per file_id: repeated deliveries are copies; language in lower case."""
    return parse_results.dropDuplicates(["file_id"]).withColumn("language", F.lower("language"))


def projects(paths: DataFrame) -> DataFrame:
    """path ('.' for the top), kind of every directory that holds a manifest (file_path)."""
    name = base_name("file_path")
    kind = None
    for mark, k in MANIFESTS:
        ok = name.endswith(mark[1:]) if mark[0] == "*" else name == mark
        kind = F.when(ok, k) if kind is None else kind.when(ok, k)
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    return paths.select(F.when(folder == "", ".").otherwise(folder).alias("path"), kind.alias("kind")).filter("kind IS NOT NULL").distinct()


def modules(files: DataFrame) -> DataFrame:
    """path, n_files, first_file of the modules; their order is that of their first file."""
    return files.select(module_of("file_path").alias("path"), "file_id").filter("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("n_files"), F.min("file_id").alias("first_file"))


def file_modules(files: DataFrame, mods: DataFrame) -> DataFrame:
    """file_id, module: the first module whose path begins the file's, with or without a slash after it.

    A module has three parts at most, so only the first three parts of paths matter:
    each distinct head is matched by its prefixes, an equi-join instead of a
    comparison of all files with all modules.
    """
    head = F.array_join(F.slice(F.split("file_path", "/"), 1, 3), "/")
    heads = files.select(head.alias("head")).distinct()
    prefixes = heads.select("head", F.explode(F.transform(F.sequence(F.lit(1), F.length("head")), lambda i: F.substring(F.col("head"), F.lit(1), i))).alias("path"))
    first = prefixes.join(mods, "path").groupBy("head").agg(F.min_by("path", F.struct("first_file", "path")).alias("module"))
    return files.select("file_id", head.alias("head")).join(first, "head").select("file_id", "module")


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, line_no, source, target_id of relative imports whose file is known: the first candidate path that exists."""
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    raw = [F.concat(folder, F.lit("/"), "source", F.lit(c)) for c in CANDIDATES] + [F.concat(folder, F.lit("/"), F.regexp_replace("source", r"\.js$", ".ts"))]
    tried = imports.filter("source LIKE '.%' OR source LIKE '/%'").select("file_id", "line_no", "source", F.posexplode(F.array(*raw)).alias("place", "raw")).withColumn("path", folded_path("raw"))
    known = files.select(folded_path("file_path").alias("path"), F.col("file_id").alias("target_id")).groupBy("path").agg(F.min("target_id").alias("target_id"))
    return tried.join(known, "path").groupBy("file_id", "line_no", "source").agg(F.min_by("target_id", "place").alias("target_id"))


def external_packages(imports: DataFrame) -> DataFrame:
    """id, n_files: an external dependency for each import that is no path."""
    return imports.filter("NOT (source LIKE '.%' OR source LIKE '/%')").groupBy(F.concat(F.lit("ext:"), "source").alias("id")).agg(F.countDistinct("file_id").alias("n_files"))


def structure(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type) and containing edges (source, target, type, confidence) of repositories, modules, files and symbols."""
    comp = F.col("kind").isin("class", "interface", "struct", "trait", "enum", "impl")
    f = files.select("file_id", "repo", F.concat(F.lit("file:"), "file_path").alias("id"), "file_path")
    mods = cut(modules(files))
    m = F.concat(F.lit("module:"), "module")
    in_module = file_modules(files, mods)
    s = symbols.join(f.select("file_id", "file_path", F.col("id").alias("file")), "file_id").select("file", F.concat(F.when(comp, "component:").otherwise("symbol:"), "file_path", F.lit(":"), "name").alias("id"), F.when(comp, "component").otherwise("symbol").alias("type")).distinct()
    repos = f.filter("repo IS NOT NULL").select(F.concat(F.lit("repo:"), "repo").alias("id"), F.lit("repository").alias("type")).distinct()
    nodes = repos.unionByName(mods.select(F.concat(F.lit("module:"), "path").alias("id"), F.lit("module").alias("type"))).unionByName(f.select("id", F.lit("file").alias("type")).distinct()).unionByName(s.select("id", "type").distinct())
    edge = lambda a, b, t, c: (F.col(a).alias("source") if isinstance(a, str) else a.alias("source"), F.col(b).alias("target") if isinstance(b, str) else b.alias("target"), F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    contain = f.join(in_module, "file_id").select(*edge(m, "id", "contains", 1.0)).unionByName(s.filter("type = 'component'").select(*edge("file", "id", "contains", 1.0))).unionByName(s.filter("type = 'symbol'").select(*edge("id", "file", "defined-in", 1.0)))
    return nodes, contain.distinct()


def models_to_tables(components: DataFrame, tables: DataFrame) -> DataFrame:
    """source, target: components named like a table, or like one without its plural s; the exact name comes first."""
    c = components.select(F.col("id").alias("source"), F.lower("name").alias("name"))
    t = small(cut(tables.groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("target"))))
    exact = c.join(t, "name")
    plural = c.join(exact.select("source"), "source", "left_anti").withColumn("name", F.concat("name", F.lit("s"))).join(t, "name")
    return exact.unionByName(plural.select(*exact.columns)).select("source", "target")


def call_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """source, target: calls (caller, caller_file, callee) resolved by qualified name, then name (the same file first), then last dotted part; none to itself.

    `symbols` has id, name, qualified_name, file_path, seq.
    """
    c = calls.select("caller", "caller_file", "callee", F.element_at(F.split("callee", r"\."), -1).alias("part")).distinct()
    by_qn = c.join(symbols.select(F.col("qualified_name").alias("callee"), "id", "seq", F.col("file_path").alias("f")), "callee").withColumn("rank", F.lit(0))
    by_name = c.join(symbols.select(F.col("name").alias("callee"), "id", "seq", F.col("file_path").alias("f")), "callee").withColumn("rank", F.when(F.col("f") == F.col("caller_file"), 1).otherwise(2))
    by_part = c.filter("part <> callee").join(symbols.select(F.col("name").alias("part"), "id", "seq", F.col("file_path").alias("f")), "part").withColumn("rank", F.lit(3))
    every = by_qn.select("caller", "callee", "id", "rank", "seq").unionByName(by_name.select("caller", "callee", "id", "rank", "seq")).unionByName(by_part.select("caller", "callee", "id", "rank", "seq"))
    return every.groupBy("caller", "callee").agg(F.min_by("id", F.struct("rank", "seq")).alias("target")).filter("caller <> target").select(F.col("caller").alias("source"), "target").distinct()


def inheritance(types: DataFrame, symbols: DataFrame) -> DataFrame:
    """source, target of types (id, base) whose base is known by qualified name, else the first by name; `symbols` as in call_edges."""
    t = types.select("id", "base").distinct()
    qn = t.join(symbols.select(F.col("qualified_name").alias("base"), F.col("id").alias("target"), "seq"), "base").withColumn("rank", F.lit(0))
    name = t.join(symbols.select(F.col("name").alias("base"), F.col("id").alias("target"), "seq"), "base").withColumn("rank", F.lit(1))
    return qn.unionByName(name).groupBy("id", "base").agg(F.min_by("target", F.struct("rank", "seq")).alias("target")).select(F.col("id").alias("source"), "target")


def endpoint_handlers(endpoints: DataFrame, symbols: DataFrame) -> DataFrame:
    """source, target: each endpoint (id, file_path) flows to the first function or method of its file."""
    first = symbols.filter(F.col("kind").isin("function", "method")).groupBy("file_path").agg(F.min_by("id", "seq").alias("target"))
    return endpoints.join(first, "file_path").select(F.col("id").alias("source"), "target")
