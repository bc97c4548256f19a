"""A whole graph out of parsed files: every extractor, then nodes and edges of all kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.columns import base_name
from codeloom.operators import build as B
from codeloom.operators import extract as E
from codeloom.operators import lookups as L
from codeloom.runtime import cut

EDGE = ("source", "target", "type", "confidence")


def parsed(files: DataFrame) -> dict[str, DataFrame]:
    """What each extractor finds in files (file_id, repo, file_path, language, content), by name; repeated rows of a file count once.

    `files` has the files without their texts. No text is shuffled: each extractor reads
    the texts, and only what it finds is made distinct.
    """
    f = files.select("file_id", "repo", "file_path", F.lower("language").alias("language"), "content").filter("file_path IS NOT NULL")
    lines = E.lines_of(f)
    docker = f.filter(F.lower(base_name("file_path")).startswith("dockerfile"))
    return {
        "files": f.drop("content").dropDuplicates(["file_id"]),
        "symbols": E.symbols(lines).distinct(),
        "imports": L.imports_with_names(f).unionByName(E.imports(E.lines_of(f.filter("language NOT IN ('typescript', 'javascript')"))).withColumn("specifiers", F.array().cast("array<string>"))).distinct(),
        "routes": E.routes(lines).distinct(),
        "columns": E.table_columns(f).distinct(),
        "keys": E.foreign_keys(f).distinct(),
        "bases": L.base_types(f),
        "docker": docker.select("file_id").distinct(),
        "docs": f.filter("language = 'markdown'").select("file_id").distinct(),
    }


def graph_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type) and edges (source, target, type, confidence): repositories, projects, modules, files, symbols, endpoints, tables, Docker files and documents, and how they are connected."""
    p = parsed(files)
    f, symbols = cut(p["files"]), cut(p["symbols"])
    nodes, edges = B.structure(f, symbols)
    path = f.select("file_id", "file_path")
    at = lambda t: t.join(path, "file_id")
    file = F.concat(F.lit("file:"), "file_path")
    edge = lambda a, b, t, c=0.9: (a.alias("source"), b.alias("target"), F.lit(t).alias("type"), F.lit(c).alias("confidence"))

    component = F.col("kind").isin("class", "interface", "struct", "trait", "enum", "impl")
    named = cut(at(symbols).select(F.concat(F.when(component, "component:").otherwise("symbol:"), "file_path", F.lit(":"), "name").alias("id"), "name", F.concat_ws(":", "file_path", "name").alias("qualified_name"), "file_path", "kind", F.col("line_no").alias("seq")))
    projects = B.projects(f)
    modules = B.modules(f)
    project_edges = L.module_projects(modules.select("path"), projects.groupBy("path").agg(F.lit(0).alias("seq"))).select("source", "target", F.lit("contains").alias("type"), F.lit(1.0).alias("confidence"))

    imports = p["imports"].select("file_path", "source", "specifiers")
    resolved = cut(L.import_edges(imports, f.select("file_path")))
    external = L.package_edges(imports.select(file.alias("file"), "source"))
    by_name = L.specifier_edges(resolved.select(F.concat(F.lit("file:"), "file").alias("file"), F.concat(F.lit("file:"), "target").alias("target"), "specifiers"), named.select(file.alias("file"), "name", "id", "seq"))

    routes = at(p["routes"]).select(F.concat_ws(":", F.lit("api"), "method", "path").alias("id"), "file_path").distinct()
    tables = p["columns"].select(F.concat(F.lit("table:"), "table_name").alias("id"), "file_id").distinct()
    keys = p["keys"].unionByName(p["columns"].select("file_id", "table_name").distinct(), allowMissingColumns=True)
    derived = at(p["bases"]).select(F.concat(F.lit("component:"), "file_path", F.lit(":"), "name").alias("id"), "base", "relation")
    parents = lambda r: B.inheritance(derived.filter(F.col("relation") == r), named).select(*edge(F.col("source"), F.col("target"), r))

    node = lambda df, t: df.select("id", F.lit(t).alias("type"))
    more = (
        node(projects.select(F.concat(F.lit("project:"), "path").alias("id")), "project")
        .unionByName(node(external.select(F.col("target").alias("id")), "external-dependency")).unionByName(node(routes, "api-endpoint")).unionByName(node(tables, "database-table"))
        .unionByName(node(at(p["docker"]).select(F.concat(F.lit("docker:"), "file_path").alias("id")), "docker-service")).unionByName(node(at(p["docs"]).select(F.concat(F.lit("doc:"), "file_path").alias("id")), "documentation"))
    )
    links = [
        project_edges, resolved.select(*edge(F.concat(F.lit("file:"), "file"), F.concat(F.lit("file:"), "target"), "imports")), external, by_name, L.key_edges(keys), parents("extends"), parents("implements"),
        B.endpoint_handlers(routes, named).select(*edge(F.col("source"), F.col("target"), "api-flow", 0.7)),
        routes.select(*edge(file, F.col("id"), "contains", 1.0)), at(tables).select(*edge(file, F.col("id"), "contains", 1.0)),
    ]
    for link in links:
        edges = edges.unionByName(link.select(*EDGE))
    return nodes.unionByName(more).distinct(), edges.distinct()
