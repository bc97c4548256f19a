"""Queries over the graph tables: orphan references, snapshot changes, hierarchies."""

from __future__ import annotations

from codeloom.operators import hierarchy as H
from codeloom.operators import references as R
from codeloom.operators import snapshots as S
from codeloom.runtime import load


def p1_found(spark, d):
    return R.orphan_references(load(spark, d, "graph_edges"), load(spark, d, "graph_nodes"), load(spark, d, "package_nodes"))


def p1_report(spark, d):
    return R.orphan_report(load(spark, d, "graph_edges"), load(spark, d, "graph_nodes"), load(spark, d, "package_nodes"))


def p2_found(spark, d):
    return S.snapshot_changes(load(spark, d, "node_snapshots"))


def p2_summary(spark, d):
    return S.diff_summary(load(spark, d, "node_snapshots"))


def p6_found(spark, d):
    return H.hierarchy(load(spark, d, "graph_edges"), load(spark, d, "graph_nodes"), load(spark, d, "package_nodes"))


def p6_paths(spark, d):
    return H.paths(load(spark, d, "graph_edges"))


def p6_intervals(spark, d):
    """The ids with children only, as its SQL has it; p6_descendants has all ids with their positions."""
    return H.descendants(load(spark, d, "graph_edges")).select("id", "root_id", "depth", (H.F.col("entry") - H.F.col("leave") - 1).alias("n_descendants")).filter("n_descendants > 0")


def p6_descendants(spark, d):
    """All ids outside loops, with the positions from which the descendants of each can be read."""
    return H.descendants(load(spark, d, "graph_edges"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_summary, p6_found, p6_paths, p6_intervals, p6_descendants)}

# A white-space class that both engines read alike is spelled out here.
_CLEAN = r"nullif(replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '\', '/'), '')"
_EDGES = f"""latest AS (SELECT * FROM (SELECT edge_id, generation_verified AS g, type, coalesce(confidence, 0) AS confidence, {_CLEAN.format(c="source")} AS source, {_CLEAN.format(c="target")} AS target,
    row_number() OVER (PARTITION BY edge_id ORDER BY generation_verified DESC NULLS LAST) AS n FROM graph_edges) WHERE n = 1)"""
_ENDS = f"""{_EDGES}, ends AS (SELECT edge_id, 'source' AS endpoint, source AS k, g FROM latest WHERE source IS NOT NULL UNION ALL SELECT edge_id, 'target', target, g FROM latest WHERE target IS NOT NULL),
lives AS (SELECT DISTINCT {_CLEAN.format(c="id")} AS k, generation_created AS born, coalesce(generation_removed, 2147483647) AS gone FROM (SELECT id, generation_created, generation_removed FROM graph_nodes UNION ALL SELECT id, generation_created, generation_removed FROM package_nodes)),
judged AS (SELECT e.k, e.g, count(l.k) AS n_lives, count(CASE WHEN l.born <= e.g THEN 1 END) AS n_born, count(CASE WHEN l.born <= e.g AND l.gone > e.g THEN 1 END) AS n_alive FROM (SELECT DISTINCT k, g FROM ends) e LEFT JOIN lives l ON l.k = e.k GROUP BY e.k, e.g),
found AS (SELECT e.edge_id, e.endpoint, e.k, e.g, CASE WHEN n_lives = 0 THEN 'missing' WHEN n_alive > 0 THEN NULL WHEN n_born > 0 THEN 'deleted' ELSE 'late' END AS reason FROM ends e JOIN judged j ON j.k = e.k AND j.g = e.g)"""

_P2 = """WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, generation, id ORDER BY loaded_at DESC NULLS LAST) AS n FROM node_snapshots) WHERE n = 1),
gens AS (SELECT repo, generation, lead(generation) OVER (PARTITION BY repo ORDER BY generation) AS after FROM (SELECT DISTINCT repo, generation FROM node_snapshots)),
a AS (SELECT o.*, g.after FROM one o JOIN gens g ON o.repo = g.repo AND o.generation = g.generation WHERE g.after IS NOT NULL),
b AS (SELECT o.*, g.generation AS before FROM one o JOIN gens g ON o.repo = g.repo AND o.generation = g.after),
j AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.generation, b.before) AS from_generation, coalesce(a.after, b.generation) AS to_generation, coalesce(a.id, b.id) AS id,
CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change_type,
CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.name IS DISTINCT FROM b.name THEN 'name' END, CASE WHEN a.description IS DISTINCT FROM b.description THEN 'description' END,
CASE WHEN a.type IS DISTINCT FROM b.type THEN 'type' END, CASE WHEN a.hash <> b.hash AND a.hash <> '' AND b.hash <> '' THEN 'content' END, CASE WHEN a.size IS DISTINCT FROM b.size THEN 'size' END) END AS changed_fields
FROM a FULL OUTER JOIN b ON a.repo = b.repo AND a.after = b.generation AND a.id = b.id),
ch AS (SELECT * FROM j WHERE change_type <> 'modified' OR changed_fields <> '')"""

_P6 = f"""WITH RECURSIVE {_EDGES}, links AS (SELECT target AS id, source AS parent, confidence FROM latest WHERE type = 'contains' AND source IS NOT NULL AND target IS NOT NULL),
up AS (SELECT id, parent FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, parent) AS n FROM links) WHERE n = 1),
ids AS (SELECT id FROM links UNION SELECT parent FROM links),
walk AS (SELECT i.id, i.id AS root_id, 0 AS depth, i.id AS path FROM ids i LEFT JOIN up u ON u.id = i.id WHERE u.id IS NULL
UNION ALL SELECT u.id, w.root_id, w.depth + 1, w.path || ' > ' || u.id FROM walk w JOIN up u ON u.parent = w.id)"""
_P6_FOUND = _P6 + """, above AS (SELECT id, parent AS a FROM up WHERE id IN (SELECT id FROM walk) UNION ALL SELECT x.id, u.parent FROM above x JOIN up u ON u.id = x.a),
n AS (SELECT a AS id, count(*) AS n FROM above GROUP BY a),
lost AS (SELECT u.* FROM up u WHERE u.id NOT IN (SELECT id FROM walk)),
reach AS (SELECT id, parent AS a FROM lost UNION SELECT r.id, l.parent FROM reach r JOIN lost l ON l.id = r.a),
cyc AS (SELECT DISTINCT id FROM reach WHERE id = a)"""
_TYPES = f"""types AS (SELECT id, max_by(type, g) AS type FROM (SELECT {_CLEAN.format(c="id")} AS id, coalesce(type, '') AS type, coalesce(generation_created, -1) AS g FROM graph_nodes UNION ALL SELECT id, 'ext', -2 FROM package_nodes) GROUP BY id)"""

ORACLE = {
    "p1_found": f"WITH {_ENDS} SELECT edge_id, endpoint, reason FROM found WHERE reason IS NOT NULL",
    "p1_report": f"""WITH {_ENDS} SELECT CASE WHEN k LIKE 'ext:%' THEN 'package_nodes' ELSE 'graph_nodes' END AS node_table, g AS generation, reason, count(DISTINCT k) AS n_ids,
        count(CASE WHEN endpoint = 'source' THEN 1 END) AS n_sources, count(CASE WHEN endpoint = 'target' THEN 1 END) AS n_targets FROM found WHERE reason IS NOT NULL GROUP BY 1, 2, 3""",
    "p2_found": _P2 + " SELECT repo, from_generation, to_generation, id, change_type, changed_fields FROM ch",
    "p2_summary": _P2 + """ SELECT repo, from_generation, to_generation, count(CASE WHEN change_type = 'added' THEN 1 END) AS n_added, count(CASE WHEN change_type = 'removed' THEN 1 END) AS n_removed,
        count(CASE WHEN change_type = 'modified' THEN 1 END) AS n_modified FROM ch GROUP BY 1, 2, 3""",
    "p6_found": f"""{_P6_FOUND}, {_TYPES} SELECT w.id, 'tree' AS status, w.root_id, coalesce(t.type, '') AS root_type, CAST(w.depth AS INT) AS depth, CAST(coalesce(n.n, 0) AS INT) AS n_descendants
        FROM walk w LEFT JOIN n ON n.id = w.id LEFT JOIN types t ON t.id = w.root_id
        UNION ALL SELECT l.id, CASE WHEN c.id IS NOT NULL THEN 'cycle' ELSE 'below' END, '', '', -1, -1 FROM lost l LEFT JOIN cyc c ON c.id = l.id""",
    "p6_paths": f"{_P6} SELECT id, CAST(depth AS INT) AS depth, path FROM walk",
    "p6_intervals": f"""{_P6_FOUND} SELECT w.id, w.root_id, CAST(w.depth AS INT) AS depth, CAST(n.n AS BIGINT) AS n_descendants FROM walk w JOIN n ON n.id = w.id""",
}
