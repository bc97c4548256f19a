"""Queries over files, texts and reports, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.functions import rules
from codeloom.operators import build as B
from codeloom.operators import context as X
from codeloom.operators import extract as E
from codeloom.operators import graph as G
from codeloom.operators import reports as R
from codeloom.operators import search as S
from codeloom.operators import snapshots as SN
from codeloom.plans.data_queries import _P2
from codeloom.plans.graph_queries import BASE, CYCLE_TYPES, EDGES, LAYER, NODES, bfs_sql, edges, hub, hub_cte, nodes, sql_list, sql_rule, sql_values, written
from codeloom.runtime import load, small

QUERY = "ledger invoice controller payment"


def files(s, d):
    return B.latest_files(load(s, d, "parse_results"))


def texts(s, d):
    """All deliveries with their texts: what is extracted from them is made distinct afterwards, so that no text is shuffled."""
    return load(s, d, "parse_results").withColumn("language", F.lower("language"))


def language_distribution(s, d):
    return R.language_distribution(nodes(s, d))


def layer_distribution(s, d):
    return R.layer_distribution(load(s, d, "parse_results"))


def test_ratio(s, d):
    return R.test_ratio(load(s, d, "parse_results"))


def patterns(s, d):
    return R.patterns(nodes(s, d), load(s, d, "parse_results"))


def module_coupling(s, d):
    return R.module_coupling(nodes(s, d), edges(s, d))


def complexity(s, d):
    return R.file_complexity(load(s, d, "parse_results"))


def complexity_summary(s, d):
    return R.complexity_summary(complexity(s, d))


def hotspots(s, d):
    return R.hotspots(complexity(s, d), edges(s, d))


def maintainability(s, d):
    return R.maintainability(nodes(s, d), load(s, d, "parse_results"), edges(s, d), CYCLE_TYPES)


def doc_gaps(s, d):
    return R.doc_gaps(nodes(s, d))


def doc_health(s, d):
    return R.doc_health(nodes(s, d))


def confidence_summary(s, d):
    return R.confidence_summary(edges(s, d))


def evidence_merge(s, d):
    return R.evidence_merged(load(s, d, "graph_edges"))


def diff_edges(s, d):
    return R.edge_changes(edges(s, d))


def diff_by_type(s, d):
    t = load(s, d, "node_snapshots")
    return R.changes_by_type(SN.snapshot_changes(t), t)


def diff_churn(s, d):
    t = load(s, d, "node_snapshots")
    return R.churn(SN.snapshot_changes(t), t)


def top_k_per_change(s, d):
    return R.significant_changes(SN.snapshot_changes(load(s, d, "node_snapshots")))


def staleness(s, d):
    """Stories are the components, each affected by the files its evidence names; changed are the files parsed in the latest generation."""
    e = load(s, d, "graph_edges").select(F.col("source").alias("story_id"), F.posexplode("evidence").alias("place", "e")).select("story_id", "place", F.col("e.source").alias("path")).filter("story_id IS NOT NULL AND path IS NOT NULL")
    p = load(s, d, "parse_results")
    last = p.agg(F.max("generation").alias("generation"))
    return R.stale_stories(e, p.join(F.broadcast(last), "generation", "left_semi").select(F.col("file_path").alias("path")))


def latest_per_key(s, d):
    """The latest hash of every node that ever had one, and in how many generations it was delivered."""
    t = load(s, d, "node_snapshots").filter("hash <> ''")
    return t.groupBy("repo", "id").agg(F.max_by("hash", F.struct("generation", "loaded_at", "hash")).alias("hash"), F.countDistinct("generation").alias("n"))


def changed_keys(s, d):
    """Files of the last generation whose hash is new or differs from the generation before, null and empty hashes included."""
    t = load(s, d, "node_snapshots")
    h = t.groupBy("repo", "id", "generation").agg(F.max_by("hash", F.struct("loaded_at", "hash")).alias("hash"))
    w = Window.partitionBy("repo", "id").orderBy("generation")
    return h.withColumns({"old": F.lag("hash").over(w), "n": F.row_number().over(w)}).filter((F.col("n") == 1) | ~F.col("hash").eqNullSafe(F.col("old"))).groupBy("repo", "generation").agg(F.count("*").alias("n_changed"))


def generation_summary(s, d):
    """Errors and failed files of each generation, the latest fifty."""
    g = load(s, d, "scan_errors").distinct().groupBy("generation").agg(F.count("*").alias("n_errors"), F.countDistinct("file_path").alias("n_files"), F.max_by("error", F.struct("reported_at", "error_id")).alias("last_error"))
    return g.orderBy(F.desc("generation")).limit(50)


def stream_activity(s, d):
    """Changes by day and kind: the events as a change stream, each user's last of a day counted."""
    e = load(s, d, "events")
    last = e.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return last.groupBy("day", "event_type").agg(F.count("*").alias("n"))


def tokenize_counts(s, d):
    return load(s, d, "documents").filter("text IS NOT NULL").select(F.explode(C.tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def fnv_hash(s, d):
    return nodes(s, d).filter("name IS NOT NULL").select(F.explode(C.tokens("name")).alias("term")).distinct().select("term", C.fnv1a("term").alias("h0"), C.fnv1a("term", 42).alias("h42"))


def embedding_dims(s, d):
    """Vectors of the names of modules, projects and repositories only, as its SQL has it; embedding_all has those of all node texts."""
    v = S.vectors(nodes(s, d).filter("type IN ('module', 'project', 'repository')").select("id", F.col("name").alias("text")).filter("text IS NOT NULL"))
    return v.select("id", "dim", F.round("w", 6).alias("w"))


def embedding_all(s, d):
    """The vectors of the texts of all nodes, whatever their type."""
    return S.vectors(S.node_texts(nodes(s, d))).select("id", "dim", F.round("w", 6).alias("w"))


def synonym_expand(s, d):
    return S.expand_terms(s, QUERY)


def bm25(s, d):
    t = S.node_texts(nodes(s, d))
    return S.bm25(S.postings(t), t, S.expand_terms(s, QUERY)).select("id", F.round("score", 6).alias("score"), "n_terms")


def dense_topk(s, d):
    """Cosines of the nodes that have a type other than symbol only, as its SQL has it; dense_all has those of all nodes."""
    return S.cosine(S.vectors(S.node_texts(nodes(s, d)).filter("type <> 'symbol'")), QUERY).select("id", F.round("sim", 6).alias("sim")).filter("sim > 0.05")


def dense_all(s, d):
    """Cosines over 0.05 of the query with the texts of all nodes, whatever their type."""
    return S.cosine(S.vectors(S.node_texts(nodes(s, d))), QUERY).select("id", F.round("sim", 6).alias("sim")).filter("sim > 0.05")


def hybrid_rrf(s, d):
    return S.hybrid_search(nodes(s, d), QUERY).select("id", F.round("bm25", 6).alias("bm25"), F.round("dense", 6).alias("dense"), F.round("score", 6).alias("score"))


def vector_topk(s, d):
    """The five nearest vectors of every vector whose id is divisible by 50, by cosine, against all rows."""
    e = load(s, d, "embeddings")
    return S.nearest(e, e.filter("vec_id % 50 = 0"), 5)


def module_of_path(s, d):
    return files(s, d).select(C.module_of("file_path").alias("module")).groupBy("module").agg(F.count("*").alias("n"))


def language_of_path(s, d):
    return files(s, d).select("file_id", C.language_of("file_path").alias("detected"))


def role_of_path(s, d):
    return files(s, d).select("file_id", C.role_of("file_path", C.language_of("file_path")).alias("role"))


def excluded_files(s, d):
    """Files that an exclude pattern of their workspace names."""
    p = load(s, d, "engine_configs").select("workspace", F.explode("exclude_patterns").alias("pattern"))
    f = files(s, d).join(small(p), "workspace")  # one row a pattern of a workspace's settings
    return f.filter(C.excluded_by("file_path", "pattern")).select("file_id").distinct()


def oversized_files(s, d):
    """Files beyond the size limit of their workspace; no limit or 0 is 3 MB."""
    c = load(s, d, "engine_configs").select("workspace", F.coalesce(F.nullif("max_file_size", F.lit(0)), F.lit(3 * 1024 * 1024)).alias("most"))
    return files(s, d).join(small(c), "workspace").filter("byte_count > most").select("file_id", "most")


def content_hash(s, d):
    return texts(s, d).select("file_id", F.substring(F.sha2("content", 256), 1, 16).alias("hash")).distinct()


def _lines(s, d):
    return E.lines_of(texts(s, d))


def symbols(s, d):
    return E.symbols(_lines(s, d)).distinct()


def imports(s, d):
    return E.imports(_lines(s, d)).select("file_id", "line_no", "source").distinct()


def ddl_columns(s, d):
    return E.table_columns(texts(s, d)).distinct()


def ddl_foreign_keys(s, d):
    return E.foreign_keys(texts(s, d)).distinct()


def _docker_lines(s, d):
    """The few lines of Docker files; only they are made distinct."""
    t = texts(s, d).filter(F.lower(C.base_name("file_path")).startswith("dockerfile"))
    return E.lines_of(t).distinct()


def dockerfiles(s, d):
    return E.dockerfiles(_docker_lines(s, d)).select("file_id", "image", F.array_join("ports", ",").alias("ports"))


def yaml_keys(s, d):
    return E.yaml_keys(_lines(s, d)).distinct()


def json_keys(s, d):
    return E.json_keys(texts(s, d)).distinct()


def markdown_headings(s, d):
    return E.headings(load(s, d, "documents").select("doc_id", "text"))


def keyword_extract(s, d):
    return load(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(C.keywords("text", 6), " ").alias("words"))


def structure_counts(s, d):
    n, e = B.structure(files(s, d), symbols(s, d))
    return n.groupBy("type").agg(F.count("*").alias("n")).unionByName(e.groupBy("type").agg(F.count("*").alias("n")))


def file_modules(s, d):
    f = files(s, d)
    return B.file_modules(f, B.modules(f))


def import_resolution(s, d):
    return B.resolved_imports(E.imports(_lines(s, d)).distinct(), files(s, d))


def external_packages(s, d):
    return B.external_packages(E.imports(_lines(s, d)))


def model_tables(s, d):
    n = nodes(s, d)
    return B.models_to_tables(n.filter("type = 'component' AND name IS NOT NULL"), n.filter("type = 'database-table' AND name IS NOT NULL"))


def call_resolution(s, d):
    """Calls of symbols, by the names of what they call: the edges of type calls told again by name."""
    n = nodes(s, d)
    by_id = n.filter("type IN ('symbol', 'component')").select("id", "name", "qualified_name", "file_path", F.col("id").alias("seq"))
    e = edges(s, d).filter("type = 'calls'").select("source", "target").join(by_id.select(F.col("id").alias("source"), F.col("file_path").alias("caller_file")), "source").join(by_id.select(F.col("id").alias("target"), F.col("name").alias("callee")), "target")
    return B.call_edges(e.select(F.col("source").alias("caller"), "caller_file", "callee").filter("callee IS NOT NULL"), by_id)


def capability_chain(s, d):
    n, e = written(s, d)
    return X.capability_chain(n, e, hub(n, e, "component")[0])


def layer_groups(s, d):
    return X.layer_groups(nodes(s, d))


def dependency_summary(s, d):
    return X.dependency_summary(nodes(s, d), edges(s, d), nodes(s, d).filter("type = 'module'"))


def seed_relevance(s, d):
    return X.seeds(nodes(s, d), ["ledger", "invoice"])


def prompt_quality(s, d):
    return X.prompt_quality(load(s, d, "documents").filter("text IS NOT NULL").select("doc_id", "text"))


def schema_projection(s, d):
    """Tables and the components mapped to them."""
    n = nodes(s, d)
    m = model_tables(s, d).groupBy("target").agg(F.count("*").alias("n_models"))
    return n.filter("type = 'database-table'").select("id", "name").join(m.withColumnRenamed("target", "id"), "id", "left").fillna(0, ["n_models"])


def service_dependencies(s, d):
    """Services each service names in depends_on, once each, and whether its repository declares them."""
    t = load(s, d, "docker_services").filter("service_name IS NOT NULL").select("repo", "service_name", F.explode("depends_on").alias("dep")).distinct()
    known = load(s, d, "docker_services").select("repo", F.col("service_name").alias("dep")).filter("dep IS NOT NULL").distinct().withColumn("known", F.lit(True))
    return t.join(known, ["repo", "dep"], "left").groupBy("repo", "service_name").agg(F.count("*").alias("n_deps"), F.count("known").alias("n_known"))


PROMPT = "Add a ledger export to the invoice panel and check the warehouse"


def prompt_evidence(s, d):
    return X.prompt_evidence(nodes(s, d), PROMPT)


def context_seeds(s, d):
    """Semantic hits, word hits and the nodes of the first file."""
    n, _ = written(s, d)
    active = n.filter("type IN ('symbol', 'component')").select("id", "file_path").filter("file_path IS NOT NULL")
    first = active.agg(F.min("file_path").alias("file_path"))
    out = X.context_seeds(S.hybrid_search(n, QUERY, 25, min_score=0.1), X.seeds(n, ["ledger", "invoice"]), active.join(F.broadcast(first), "file_path", "left_semi"))  # one path
    return out.select("id", F.round("relevance", 6).alias("relevance"))


def feature_context(s, d):
    n, e = written(s, d)
    return X.feature_context(n, G.feature_subgraph(n, e, hub(n, e, "component")[0], 2))


def feature_gaps(s, d):
    return X.gaps(capability_chain(s, d))


def top_languages(s, d):
    return nodes(s, d).filter("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(3)


def status_metrics(s, d):
    k = lambda *t: F.count_if(F.col("type").isin(*t))
    n = nodes(s, d).agg(k("symbol").alias("symbols"), k("api-endpoint", "component").alias("entry_points"), k("test-suite").alias("tests"), k("external-dependency").alias("dependencies"))
    return R.beside(n, edges(s, d).agg(F.count("*").alias("relationships")))


def tree_view(s, d):
    """The first fifty nodes of each type, and how many there are."""
    n = nodes(s, d).select("id", "type", "generation_created")
    # the window's limit is taken in each task first; the counts are one row a type
    first = n.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy("generation_created", "id"))).filter("place <= 50")
    counts = n.groupBy(F.col("type").alias("_t")).agg(F.count("*").alias("n"))
    return first.join(counts, F.col("type").eqNullSafe(F.col("_t"))).select("id", "type", "place", "n")


def search_listing(s, d):
    """The first twenty hits of a word, five of each type at most."""
    hits = G.search_nodes(nodes(s, d), "warehouse").orderBy("generation_created", "id").limit(20)
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy("generation_created", "id"))).filter("r <= 5").select("type", "id")


def file_stats(s, d):
    return files(s, d).groupBy("language").agg(F.count("*").alias("n_files"), F.sum("byte_count").alias("bytes"), F.sum(F.size(F.coalesce("symbols", F.array()))).alias("n_symbols"))


def routes(s, d):
    return E.routes(_lines(s, d)).distinct()


def project_directories(s, d):
    return B.projects(files(s, d).select("file_path"))


QUERIES = {
    f.__name__: f
    for f in (
        language_distribution, layer_distribution, test_ratio, patterns, module_coupling, complexity, complexity_summary, hotspots, maintainability, doc_gaps, doc_health, confidence_summary, evidence_merge, diff_edges, diff_by_type, diff_churn,
        top_k_per_change, staleness, latest_per_key, changed_keys, generation_summary, stream_activity, tokenize_counts, fnv_hash, embedding_dims, embedding_all, synonym_expand, bm25, dense_topk, dense_all, hybrid_rrf, vector_topk, module_of_path, language_of_path,
        role_of_path, excluded_files, oversized_files, content_hash, symbols, imports, ddl_columns, ddl_foreign_keys, dockerfiles, yaml_keys, json_keys, markdown_headings, keyword_extract, structure_counts, file_modules, import_resolution,
        external_packages, model_tables, call_resolution, capability_chain, layer_groups, dependency_summary, seed_relevance, prompt_quality, schema_projection, service_dependencies,
        prompt_evidence, context_seeds, feature_context, feature_gaps, top_languages, status_metrics, tree_view, search_listing, file_stats, routes, project_directories,
    )
}


def _q(x):
    return x.replace("'", "''")


FILES = "files AS (SELECT * EXCLUDE (language, rn), lower(language) AS language FROM (SELECT *, row_number() OVER (PARTITION BY file_id) AS rn FROM parse_results) WHERE rn = 1)"
LINES = f"""{FILES}, split AS (SELECT file_id, file_path, language, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM files WHERE content IS NOT NULL),
lines AS (SELECT file_id, file_path, language, CAST(unnest(generate_series(1, len(ls))) AS INT) AS line_no, unnest(ls) AS line FROM split)"""
_SPACED = r"regexp_replace({t}, '[._\-/:\\$#@()\[\]{{}}<>,\"''`=;]', ' ', 'g')"
TOKENS = (
    "list_filter(list_transform(string_split_regex(lower(regexp_replace(regexp_replace(" + _SPACED + r", '([a-z\d])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z\d]+)', '\1 \2', 'g')), '\s+'), lambda t: regexp_replace(t, '[^a-z0-9]', '', 'g')), lambda t: length(t) >= 2 AND NOT list_contains({stop}, t))"
)


def toks(column):
    return TOKENS.format(t=column, stop="[" + ", ".join(f"'{w}'" for w in rules.STOP_WORDS) + "]")


def fnv(column, seed=0):
    start = (2166136261 ^ seed) & 0xFFFFFFFF
    return f"list_reduce(list_prepend({start}::BIGINT, list_transform(generate_series(1, length({column})), lambda i: ascii(substring({column}, CAST(i AS INT), 1))::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


_CC = "1 + " + " + ".join(f"len(regexp_extract_all(content, '{_q(p)}'))" for p in rules.BRANCHES)
CC = f"cc AS (SELECT 'file:' || file_path AS id, max({_CC}) AS cc FROM files WHERE content IS NOT NULL GROUP BY 1)"
_RATED = "CASE WHEN cc <= 5 THEN 'low' WHEN cc <= 10 THEN 'medium' WHEN cc <= 20 THEN 'high' ELSE 'very-high' END"
_LAYER0 = sql_rule(rules.LAYERS, "lower(coalesce(file_path, ''))", "unknown")
_SKIP = f"({_LAYER0} = 'test' OR coalesce(starts_with(name, '_'), false))"
_TEXT = "length(trim(coalesce(description, '')))"
GAPS = f"""gaps AS (SELECT id, 'symbol' AS kind, CASE WHEN contains(lower(coalesce(file_path, '')), '/internal/') THEN 'warning' ELSE 'critical' END AS severity FROM nodes WHERE type IN ('symbol', 'component') AND NOT {_SKIP} AND {_TEXT} <= 10
UNION ALL SELECT id, 'endpoint', 'warning' FROM nodes WHERE type = 'api-endpoint' AND description IS NULL UNION ALL SELECT id, 'table', 'info' FROM nodes WHERE type = 'database-table' AND length(coalesce(description, '')) <= 5
UNION ALL SELECT id, 'module', 'info' FROM nodes n WHERE type = 'module' AND NOT EXISTS (SELECT 1 FROM nodes r WHERE r.type = 'file' AND regexp_matches(lower(r.file_path), '^.*/readme(\\.[a-z]+)?$') AND regexp_extract(lower(r.file_path), '^(.*)/readme(\\.[a-z]+)?$', 1) = n.file_path))"""
COUPLING = """coupling AS (SELECT n.id, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM nodes n LEFT JOIN (SELECT target AS id, count(*) AS n FROM edges WHERE type IN ('imports', 'depends-on') GROUP BY 1) i ON i.id = n.id
    LEFT JOIN (SELECT source AS id, count(*) AS n FROM edges WHERE type IN ('imports', 'depends-on', 'uses-package') GROUP BY 1) o ON o.id = n.id WHERE n.type = 'module'),
rated AS (SELECT *, CASE WHEN fan_in + fan_out > 0 THEN fan_out / CAST(fan_in + fan_out AS DOUBLE) ELSE 0.0 END AS raw FROM coupling)"""
HOT = """touch AS (SELECT id, count(*) AS coupling FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id),
hot AS (SELECT id, cc, coupling, score FROM (SELECT c.id, c.cc, coalesce(t.coupling, 0) AS coupling, CAST(floor(least(100.0, c.cc * 100.0 / greatest(max(c.cc) OVER (), 1)) * 0.6::DOUBLE + least(100.0, coalesce(t.coupling, 0) * 5.0) * 0.4::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS score FROM cc c LEFT JOIN touch t ON t.id = c.id) WHERE cc >= 5 AND score >= 30 ORDER BY score DESC, id LIMIT 20)"""
TERMS = f"""q AS (SELECT DISTINCT unnest({toks("'" + QUERY + "'")}) AS term), words(concept, word, place) AS {sql_values([(c, w, i) for c, ws in rules.CONCEPTS.items() for i, w in enumerate([c, *ws])])},
terms AS (SELECT term FROM q UNION SELECT w.word FROM words w WHERE CAST(w.place AS INT) <= 4 AND w.concept IN (SELECT concept FROM words x JOIN q ON q.term = x.word))"""
TEXTS = "texts AS (SELECT id, type, name, concat_ws(' ', name, qualified_name, description, type, file_path) AS text FROM nodes)"
BM25 = f"""tk AS (SELECT id, {toks("text")} AS ts FROM texts), posts AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(ts) AS len, unnest(ts) AS term FROM tk) WHERE term IN (SELECT term FROM terms) GROUP BY id, len, term),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM tk), dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
bm AS (SELECT p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.len / a))) AS score, count(*) AS n_terms FROM posts p JOIN dfs f ON f.term = p.term CROSS JOIN stats GROUP BY p.id)"""


def vec_cte(source, name):
    """Unit vectors of (id, text) rows."""
    sign = lambda h: f"CASE WHEN {h} % 2 = 0 THEN 1.0 ELSE -1.0 END"
    return f"""{name}_t AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest({toks("text")}) AS t FROM {source}) GROUP BY id, t),
{name}_u AS (SELECT t, {fnv("t")} % 256 AS d, ({sign(fnv("t", 1))}) * 1.5 AS w FROM (SELECT DISTINCT t FROM {name}_t)),
{name}_g AS (SELECT t, g, count(*) AS m FROM (SELECT t, substring(t, CAST(unnest(generate_series(1, length(t) - 2)) AS INT), 3) AS g FROM (SELECT DISTINCT t FROM {name}_t) WHERE length(t) >= 3) GROUP BY t, g),
{name}_h AS (SELECT g, {fnv("g", 42)} % 256 AS d, ({sign(fnv("g", 99))}) * 0.5 AS w FROM (SELECT DISTINCT g FROM {name}_g)),
{name}_s AS (SELECT id, d, sum(w) AS w FROM (SELECT x.id, u.d, CAST(u.w * x.n AS DOUBLE) AS w FROM {name}_t x JOIN {name}_u u ON u.t = x.t UNION ALL SELECT x.id, h.d, CAST(h.w * x.n * g.m AS DOUBLE) FROM {name}_t x JOIN {name}_g g ON g.t = x.t JOIN {name}_h h ON h.g = g.g) GROUP BY id, d HAVING sum(w) <> 0),
{name} AS (SELECT id, CAST(d AS INT) AS dim, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {name}_s)"""


def _symbol_sql():
    parts = []
    for language, table in E.SYMBOLS.items():
        for k, (kind, pattern, group) in enumerate(table):
            skip = "".join(f" AND NOT contains(line, '{w}')" for w in E.NOT_ON.get(language, [])) if kind in ("method", "function") else ""
            parts.append(f"SELECT file_id, line_no, {k} AS rule, '{kind}' AS kind, regexp_extract(line, '{_q(pattern)}', {group}) AS name FROM lines WHERE language = '{language}' AND regexp_matches(line, '{_q(pattern)}'){skip}")
    return " UNION ALL ".join(parts)


def _import_sql():
    cases = []
    for language, table in E.IMPORTS.items():
        cases.append(f"WHEN language = '{language}' THEN CASE " + " ".join(f"WHEN regexp_matches(line, '{_q(p)}') THEN regexp_extract(line, '{_q(p)}', {g})" for p, g in table) + " END")
    return f"SELECT file_id, file_path, line_no, source FROM (SELECT file_id, file_path, line_no, CASE {' '.join(cases)} END AS source FROM lines) WHERE source IS NOT NULL"


IMPORTS = f"{LINES}, imported AS ({_import_sql()})"
MODULE = f"CASE WHEN len(string_split(file_path, '/')) >= 2 THEN CASE WHEN lower(split_part(file_path, '/', 1)) IN {sql_list(rules.MODULE_TOPS)} AND len(string_split(file_path, '/')) >= 3 THEN array_to_string(string_split(file_path, '/')[1:3], '/') ELSE array_to_string(string_split(file_path, '/')[1:2], '/') END END"
MODULES = f"mods AS (SELECT path, count(*) AS n_files, min(file_id) AS first_file FROM (SELECT {MODULE} AS path, file_id FROM files) WHERE path IS NOT NULL GROUP BY path)"
FILE_MODULES = "in_module AS (SELECT file_id, module FROM (SELECT f.file_id, m.path AS module, row_number() OVER (PARTITION BY f.file_id ORDER BY m.first_file, m.path) AS rn FROM files f JOIN mods m ON starts_with(f.file_path, m.path)) WHERE rn = 1)"
_EXT = "regexp_extract(lower(split_part(file_path, '/', -1)), '([^.]*)$', 1)"
_BASE = "lower(split_part(file_path, '/', -1))"
LANG = f"CASE WHEN {_BASE} = 'dockerfile' OR starts_with({_BASE}, 'dockerfile.') OR contains({_BASE}, 'docker-compose') THEN 'docker' " + " ".join(f"WHEN {_EXT} IN {sql_list(x)} THEN '{k}'" for k, x in rules.LANGUAGES.items()) + f" WHEN {_EXT} = 'dockerfile' THEN 'docker' END"
ROLE = "CASE language " + " ".join(f"WHEN '{k}' THEN {sql_rule(t, 'lower(file_path)', 'unknown')}" for k, t in rules.ROLES.items()) + " ELSE 'unknown' END"
_CT = _q(E.CREATE_TABLE)
PARTS = f"""{FILES}, tabs AS (SELECT file_id, unnest(regexp_extract_all(content, '{_CT}', 1)) AS table_name, unnest(regexp_extract_all(content, '{_CT}', 2)) AS body FROM files WHERE language = 'sql' AND content IS NOT NULL),
parts AS (SELECT file_id, table_name, CAST(unnest(generate_series(0, len(string_split(body, ',')) - 1)) AS INT) AS place, regexp_replace(unnest(string_split(body, ',')), '^\\s+|\\s+$', '', 'g') AS part FROM tabs)"""
_COL, _FK, _IK = _q(E.COLUMN), _q(E.FOREIGN_KEY), _q(E.INLINE_KEY)
_REST = f"upper(regexp_extract(part, '{_COL}', 3))"
_KEYW = r"list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda w: regexp_replace(w, '[^a-z0-9_-]', '', 'g')), lambda w: length(w) > 2)[1:6]"
_EST = "greatest(1, CAST(ceil(length(text) / 4.0) AS INT))"

ORACLE = {
    "language_distribution": f"WITH {NODES} SELECT language, files, symbols, CAST(floor(files * 100.0 / greatest(sum(files) OVER (), 1) + 0.5) AS BIGINT) AS percent FROM (SELECT language, count(CASE WHEN type = 'file' THEN 1 END) AS files, count(CASE WHEN type = 'symbol' THEN 1 END) AS symbols FROM nodes WHERE type IN ('file', 'symbol') AND language IS NOT NULL GROUP BY language)",
    "layer_distribution": f"WITH {FILES} SELECT {LAYER} AS layer, count(*) AS n FROM files GROUP BY 1",
    "test_ratio": f"WITH {FILES}, l AS (SELECT {LAYER} AS layer FROM files) SELECT count(*) AS n_files, count(CASE WHEN layer = 'test' THEN 1 END) AS n_tests, floor(count(CASE WHEN layer = 'test' THEN 1 END) * 100.0 / greatest(count(*), 1) * 10 + 0.5) / 10 AS percent FROM l",
    "patterns": f"""WITH {NODES}, s AS (SELECT bool_or(contains(lower(file_path), 'controller')) AS c, bool_or(contains(lower(file_path), 'model')) AS m, bool_or(contains(lower(file_path), 'view') OR ends_with(file_path, '.tsx') OR ends_with(file_path, '.jsx')) AS v,
        bool_or(contains(lower(file_path), 'service')) AS s, bool_or(contains(lower(file_path), 'repository') OR contains(lower(file_path), 'dao')) AS r FROM parse_results),
        e AS (SELECT count(*) > 0 AS q FROM (SELECT unnest(symbols) AS x FROM parse_results) WHERE regexp_matches(lower(x.name), 'queue|event|subscriber|publisher')), p AS (SELECT count(CASE WHEN type = 'project' THEN 1 END) > 3 OR count(CASE WHEN type = 'service' THEN 1 END) > 2 AS many FROM nodes),
        f AS (SELECT 'mvc' AS pattern FROM s WHERE c AND m AND v UNION ALL SELECT 'layered' FROM s WHERE c AND s AND r UNION ALL SELECT 'microservices' FROM p WHERE many UNION ALL SELECT 'event-driven' FROM e WHERE q)
        SELECT pattern FROM f UNION ALL SELECT 'unknown' WHERE NOT EXISTS (SELECT 1 FROM f)""",
    "module_coupling": f"WITH {BASE}, {COUPLING} SELECT id, fan_in, fan_out, floor(raw * 100 + 0.5) / 100 AS instability, CASE WHEN raw <= 0.25 THEN 'stable' WHEN raw <= 0.5 THEN 'balanced' WHEN raw <= 0.75 THEN 'unstable' ELSE 'highly-unstable' END AS rating FROM rated",
    "complexity": f"WITH {FILES}, {CC} SELECT id, cc, {_RATED} AS rating FROM cc",
    "complexity_summary": f"WITH {FILES}, {CC}, r AS (SELECT cc, row_number() OVER (ORDER BY cc DESC) AS r, count(*) OVER () AS n FROM cc) SELECT count(*) AS n, floor(avg(cc) * 100 + 0.5) / 100 AS avg_cc, max(CASE WHEN r = floor(n * 0.9) + 1 THEN cc END) AS p90_desc_index, max(CASE WHEN r = n - ceil(n * 0.9) + 1 THEN cc END) AS p90 FROM r",
    "hotspots": f"WITH {FILES}, {EDGES}, {CC}, {HOT} SELECT * FROM hot",
    "doc_gaps": f"WITH {NODES}, {GAPS} SELECT * FROM gaps",
    "doc_health": f"WITH {NODES}, {GAPS}, a AS (SELECT count(*) AS audited, count(CASE WHEN {_TEXT} > 10 THEN 1 END) AS documented FROM nodes WHERE type IN ('symbol', 'component') AND NOT {_SKIP}), p AS (SELECT *, (SELECT count(*) FROM gaps) AS n_gaps, CASE WHEN audited = 0 THEN 100 ELSE CAST(floor(documented * 100.0 / audited + 0.5) AS INT) END AS coverage FROM a) SELECT *, CASE WHEN coverage >= 90 THEN 'A' WHEN coverage >= 75 THEN 'B' WHEN coverage >= 60 THEN 'C' WHEN coverage >= 40 THEN 'D' ELSE 'F' END AS grade FROM p",
    "confidence_summary": f"WITH {EDGES} SELECT count(*) AS n, floor(coalesce(avg(confidence), 0) * 10000 + 0.5) / 10000 AS avg_confidence, " + ", ".join(f"count(CASE WHEN resolution = '{r}' THEN 1 END) AS n_{r}" for r in ("confirmed", "resolved", "heuristic", "unresolved")) + " FROM edges",
    "evidence_merge": "SELECT target, e.type AS type, e.description AS description, count(*) AS n FROM (SELECT target, unnest(evidence) AS e FROM graph_edges) GROUP BY 1, 2, 3",
    "diff_edges": f"WITH {EDGES} SELECT generation, CAST(sum(a) AS BIGINT) AS n_added, CAST(sum(r) AS BIGINT) AS n_removed FROM (SELECT generation_created AS generation, 1 AS a, 0 AS r FROM edges UNION ALL SELECT generation_verified + 1, 0, 1 FROM edges) WHERE generation IS NOT NULL GROUP BY generation",
    "diff_by_type": _P2 + ", k AS (SELECT repo, id, type FROM (SELECT repo, id, type, row_number() OVER (PARTITION BY repo, id ORDER BY generation DESC, loaded_at DESC NULLS LAST, type DESC NULLS LAST) AS rn FROM node_snapshots WHERE generation IS NOT NULL) WHERE rn = 1) SELECT k.type, " + ", ".join(f"count(CASE WHEN change_type = '{c}' THEN 1 END) AS {c}" for c in ("added", "removed", "modified")) + " FROM ch JOIN k ON k.repo = ch.repo AND k.id = ch.id GROUP BY k.type",
    "diff_churn": _P2 + ", z AS (SELECT repo, generation, count(DISTINCT id) AS n FROM node_snapshots GROUP BY 1, 2), c AS (SELECT repo, from_generation, to_generation, count(CASE WHEN change_type <> 'modified' THEN 1 END) AS moved FROM ch GROUP BY 1, 2, 3) SELECT c.repo, from_generation, to_generation, floor(moved / CAST(greatest(a.n, b.n, 1) AS DOUBLE) * 100 + 0.5) / 100 AS churn FROM c JOIN z a ON a.repo = c.repo AND a.generation = from_generation JOIN z b ON b.repo = c.repo AND b.generation = to_generation",
    "top_k_per_change": _P2 + " SELECT repo, change_type, id FROM (SELECT *, row_number() OVER (PARTITION BY repo, change_type ORDER BY id) AS r FROM ch WHERE to_generation = (SELECT max(to_generation) FROM ch x WHERE x.repo = ch.repo)) WHERE r <= CASE change_type WHEN 'added' THEN 8 ELSE 6 END",
    "staleness": r"""WITH s AS (SELECT source AS story_id, unnest(generate_series(0, len(evidence) - 1)) AS place, unnest(evidence).source AS path FROM graph_edges WHERE source IS NOT NULL AND len(evidence) > 0), f AS (SELECT DISTINCT replace(file_path, '\', '/') AS f FROM parse_results WHERE generation = (SELECT max(generation) FROM parse_results)),
        u AS (SELECT DISTINCT path FROM s WHERE path IS NOT NULL AND path <> ''), hit AS (SELECT DISTINCT path FROM u JOIN f ON ends_with(f.f, replace(u.path, '\', '/')) OR ends_with(replace(u.path, '\', '/'), f.f))
        SELECT story_id, path AS affected FROM (SELECT story_id, path, row_number() OVER (PARTITION BY story_id ORDER BY place, path) AS rn FROM s WHERE path IN (SELECT path FROM hit)) WHERE rn = 1""",
    "latest_per_key": "SELECT a.repo, a.id, hash, n FROM (SELECT repo, id, hash, row_number() OVER (PARTITION BY repo, id ORDER BY generation DESC, loaded_at DESC, hash DESC) AS rn FROM node_snapshots WHERE hash <> '') a JOIN (SELECT repo, id, count(DISTINCT generation) AS n FROM node_snapshots WHERE hash <> '' GROUP BY 1, 2) b ON a.repo = b.repo AND a.id = b.id WHERE rn = 1",
    "changed_keys": "WITH h AS (SELECT repo, id, generation, hash FROM (SELECT *, row_number() OVER (PARTITION BY repo, id, generation ORDER BY loaded_at DESC, hash DESC NULLS LAST) AS rn FROM node_snapshots) WHERE rn = 1) SELECT repo, generation, count(*) AS n_changed FROM (SELECT *, lag(hash) OVER (PARTITION BY repo, id ORDER BY generation) AS old, row_number() OVER (PARTITION BY repo, id ORDER BY generation) AS n FROM h) WHERE n = 1 OR hash IS DISTINCT FROM old GROUP BY 1, 2",
    "generation_summary": "SELECT g.generation, n_errors, n_files, l.error AS last_error FROM (SELECT generation, count(*) AS n_errors, count(DISTINCT file_path) AS n_files FROM (SELECT DISTINCT * FROM scan_errors) GROUP BY generation) g JOIN (SELECT generation, error, row_number() OVER (PARTITION BY generation ORDER BY reported_at DESC, error_id DESC) AS rn FROM scan_errors) l ON l.generation = g.generation WHERE l.rn = 1",
    "stream_activity": "SELECT day, event_type, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS day, event_type, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 GROUP BY 1, 2",
    "tokenize_counts": f"SELECT term, count(*) AS n FROM (SELECT unnest({toks('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term",
    "fnv_hash": f"WITH {NODES} SELECT term, {fnv('term')} AS h0, {fnv('term', 42)} AS h42 FROM (SELECT DISTINCT unnest({toks('name')}) AS term FROM nodes WHERE name IS NOT NULL)",
    "embedding_dims": f"WITH {NODES}, src AS (SELECT id, name AS text FROM nodes WHERE type IN ('module', 'project', 'repository') AND name IS NOT NULL), {vec_cte('src', 'v')} SELECT id, dim, round(w, 6) AS w FROM v",
    "embedding_all": f"WITH {NODES}, {TEXTS}, {vec_cte('texts', 'v')} SELECT id, dim, round(w, 6) AS w FROM v",
    "synonym_expand": f"WITH {TERMS} SELECT term FROM terms",
    "bm25": f"WITH {NODES}, {TEXTS}, {TERMS}, {BM25} SELECT id, round(score, 6) AS score, n_terms FROM bm",
    "dense_topk": f"WITH {NODES}, {TEXTS}, src AS (SELECT id, text FROM texts WHERE type <> 'symbol'), {vec_cte('src', 'v')}, one AS (SELECT 'q' AS id, '{QUERY}' AS text), {vec_cte('one', 'k')} SELECT id, round(sim, 6) AS sim FROM (SELECT v.id, greatest(0, sum(v.w * k.w)) AS sim FROM v JOIN k ON k.dim = v.dim GROUP BY v.id) WHERE round(sim, 6) > 0.05",
    "dense_all": f"WITH {NODES}, {TEXTS}, {vec_cte('texts', 'v')}, one AS (SELECT 'q' AS id, '{QUERY}' AS text), {vec_cte('one', 'k')} SELECT id, round(sim, 6) AS sim FROM (SELECT v.id, greatest(0, sum(v.w * k.w)) AS sim FROM v JOIN k ON k.dim = v.dim GROUP BY v.id) WHERE round(sim, 6) > 0.05",
    "hybrid_rrf": f"""WITH {NODES}, {TEXTS}, {TERMS}, {BM25}, src AS (SELECT id, text FROM texts WHERE id IN (SELECT id FROM bm) OR (SELECT count(*) FROM texts) < 500), {vec_cte('src', 'v')}, one AS (SELECT 'q' AS id, '{QUERY}' AS text), {vec_cte('one', 'k')},
        dn AS (SELECT v.id, greatest(0, sum(v.w * k.w)) AS sim FROM v JOIN k ON k.dim = v.dim GROUP BY v.id HAVING sum(v.w * k.w) > 0.05), a AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm WHERE score > 0), b AS (SELECT id, sim, row_number() OVER (ORDER BY sim DESC, id) AS r FROM dn),
        j AS (SELECT coalesce(a.id, b.id) AS id, coalesce(score, 0) AS bm25, coalesce(sim, 0) AS dense, 0.6 / (60 + coalesce(a.r, 1000)) + 0.4 / (60 + coalesce(b.r, 1000)) AS f FROM a FULL OUTER JOIN b ON a.id = b.id)
        SELECT j.id, round(bm25, 6) AS bm25, round(dense, 6) AS dense, round(f * (1 + CASE WHEN lower(name) = '{QUERY}' THEN 2.5 WHEN contains(lower(name), '{QUERY}') OR contains('{QUERY}', lower(name)) THEN 1.2 ELSE 0 END + CASE WHEN type IN {sql_list(S.FAVOURED)} THEN 0.3 ELSE 0 END) * 100, 6) AS score
        FROM j JOIN texts t ON t.id = j.id ORDER BY f * (1 + CASE WHEN lower(name) = '{QUERY}' THEN 2.5 WHEN contains(lower(name), '{QUERY}') OR contains('{QUERY}', lower(name)) THEN 1.2 ELSE 0 END + CASE WHEN type IN {sql_list(S.FAVOURED)} THEN 0.3 ELSE 0 END) DESC, j.id LIMIT 20""",
    "module_of_path": f"WITH {FILES} SELECT {MODULE} AS module, count(*) AS n FROM files GROUP BY 1",
    "language_of_path": f"WITH {FILES} SELECT file_id, {LANG} AS detected FROM files",
    "role_of_path": f"WITH {FILES} SELECT file_id, {ROLE} AS role FROM (SELECT file_id, file_path, {LANG} AS language FROM files)",
    "oversized_files": f"WITH {FILES} SELECT file_id, most FROM files f JOIN (SELECT workspace, coalesce(nullif(max_file_size, 0), 3145728) AS most FROM engine_configs) c ON c.workspace = f.workspace WHERE byte_count > most",
    "content_hash": f"WITH {FILES} SELECT file_id, substring(sha256(content), 1, 16) AS hash FROM files",
    "symbols": f"WITH {LINES} {_symbol_sql()}",
    "imports": f"WITH {IMPORTS} SELECT file_id, line_no, source FROM imported",
    "ddl_columns": f"WITH {PARTS} SELECT file_id, table_name, place, regexp_extract(part, '{_COL}', 1) AS column_name, regexp_extract(part, '{_COL}', 2) AS column_type, contains({_REST}, 'PRIMARY KEY') AS is_primary, NOT contains({_REST}, 'NOT NULL') AS is_nullable FROM parts WHERE NOT regexp_matches(part, '{_FK}') AND NOT regexp_matches(part, '(?i)^PRIMARY\\s+KEY') AND regexp_matches(part, '{_COL}')",
    "yaml_keys": f"WITH {LINES} SELECT file_id, line_no, regexp_extract(line, '^(\\w[\\w.-]*):', 1) AS key FROM lines WHERE language = 'yaml' AND line_no <= 200 AND regexp_matches(line, '^(\\w[\\w.-]*):')",
    "json_keys": f"WITH {FILES} SELECT file_id, unnest(json_keys(content)) AS key FROM files WHERE language = 'json' AND content IS NOT NULL AND json_valid(content)",
    "markdown_headings": r"""WITH split AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, CAST(unnest(generate_series(1, len(ls))) AS INT) AS line_no, unnest(ls) AS line FROM split)
        SELECT doc_id, line_no, CAST(length(regexp_extract(line, '^(#{1,6})\s+(.+)', 1)) AS INT) AS level, trim(regexp_extract(line, '^(#{1,6})\s+(.+)', 2)) AS title, regexp_replace(lower(trim(regexp_extract(line, '^(#{1,6})\s+(.+)', 2))), '\s+', '-', 'g') AS slug FROM l WHERE regexp_matches(line, '^(#{1,6})\s+(.+)')""",
    "keyword_extract": f"SELECT doc_id, array_to_string({_KEYW}, ' ') AS words FROM documents WHERE text IS NOT NULL",
    "file_modules": f"WITH {FILES}, {MODULES}, {FILE_MODULES} SELECT file_id, module FROM in_module",
    "external_packages": f"WITH {IMPORTS} SELECT 'ext:' || source AS id, count(DISTINCT file_id) AS n_files FROM imported WHERE NOT (source LIKE '.%' OR source LIKE '/%') GROUP BY 1",
    "model_tables": f"WITH {NODES}, t AS (SELECT lower(name) AS name, min(id) AS target FROM nodes WHERE type = 'database-table' AND name IS NOT NULL GROUP BY 1), c AS (SELECT id AS source, lower(name) AS name FROM nodes WHERE type = 'component' AND name IS NOT NULL) SELECT c.source, coalesce(a.target, b.target) AS target FROM c LEFT JOIN t a ON a.name = c.name LEFT JOIN t b ON b.name = c.name || 's' WHERE coalesce(a.target, b.target) IS NOT NULL",
    "layer_groups": f"WITH {NODES}, l AS (SELECT {_LAYER0} AS layer, id, generation_created FROM nodes), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY generation_created, id) AS r, count(*) OVER (PARTITION BY layer) AS n FROM l) SELECT layer, max(n) AS n, string_agg(id, ',' ORDER BY r) AS first FROM r WHERE r <= 8 GROUP BY layer",
    "dependency_summary": f"WITH {BASE} SELECT DISTINCT n.id AS neighbor, CASE WHEN n.type = 'external-dependency' THEN 'external' ELSE 'internal' END AS kind FROM edges e JOIN nodes n ON n.id = e.target WHERE e.type IN {sql_list(G.DEPENDENCIES)} AND e.source IN (SELECT id FROM nodes WHERE type = 'module')",
    "seed_relevance": f"WITH {NODES}, w(w) AS (VALUES ('ledger'), ('invoice')) SELECT id, max(CASE WHEN lower(name) = w THEN 1.0 WHEN contains(lower(name), w) THEN 0.8 ELSE 0.5 END) AS relevance FROM nodes, w WHERE contains(lower(coalesce(name, '')), w) OR contains(lower(coalesce(qualified_name, '')), w) OR contains(lower(coalesce(description, '')), w) GROUP BY id",
    "prompt_quality": f"SELECT doc_id, CAST(len({_KEYW}) AS INT) AS n_keywords, {_EST} AS tokens, least(greatest({_EST} * 4, 768), 12000) AS budget, floor(greatest(0.7, 1 - {_EST} / CAST(greatest({_EST} * 25, 45000) AS DOUBLE)) * 10000 + 0.5) / 10000 AS reduction FROM documents WHERE text IS NOT NULL",
    "service_dependencies": "WITH t AS (SELECT DISTINCT repo, service_name, unnest(depends_on) AS dep FROM docker_services WHERE service_name IS NOT NULL) SELECT repo, service_name, count(*) AS n_deps, count(CASE WHEN EXISTS (SELECT 1 FROM docker_services k WHERE k.repo = t.repo AND k.service_name = t.dep) THEN 1 END) AS n_known FROM t GROUP BY 1, 2",
    "vector_topk": "WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) AS sim FROM u q JOIN u e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 5",
    "excluded_files": rf"""WITH {FILES}, p AS (SELECT workspace, unnest(exclude_patterns) AS x FROM engine_configs), q AS (SELECT f.file_id, f.file_path AS p, split_part(f.file_path, '/', -1) AS name, x, regexp_replace(x, '^(.*?)\*\*/', '\1') AS tail FROM files f JOIN p ON p.workspace = f.workspace),
        r AS (SELECT *, replace(tail, '/**', '') AS folder, regexp_replace(tail, '^([^*]*)\*', '\1') AS part, regexp_replace(x, '^([^*]*)\*', '\1') AS plain FROM q)
        SELECT DISTINCT file_id FROM r WHERE (contains(x, '**/') AND ends_with(tail, '/**') AND (name = folder OR contains(p, '/' || folder || '/') OR starts_with(p, folder || '/'))) OR (contains(x, '**/') AND NOT ends_with(tail, '/**') AND (name = part OR contains(p, part))) OR name = x OR name = plain OR starts_with(name, '.')""",
    "dockerfiles": rf"""WITH {LINES}, d AS (SELECT * FROM lines WHERE starts_with(lower(split_part(file_path, '/', -1)), 'dockerfile')), i AS (SELECT file_id, regexp_extract(line, '(?i)^\s*FROM\s+(\S+)', 1) AS image, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS rn FROM d WHERE regexp_matches(line, '(?i)^\s*FROM\s+')),
        e AS (SELECT file_id, unnest(string_split_regex(trim(regexp_extract(line, '(?i)^\s*EXPOSE\s+([0-9\s]+)', 1)), '\s+')) AS port FROM d WHERE regexp_matches(line, '(?i)^\s*EXPOSE\s+[0-9]')), g AS (SELECT file_id, string_agg(port, ',' ORDER BY port) AS ports FROM e GROUP BY file_id)
        SELECT x.file_id, i.image, coalesce(g.ports, '') AS ports FROM (SELECT DISTINCT file_id FROM d) x LEFT JOIN i ON i.file_id = x.file_id AND i.rn = 1 LEFT JOIN g ON g.file_id = x.file_id""",
    "structure_counts": f"""WITH {LINES}, sy AS ({_symbol_sql()}), {MODULES}, {FILE_MODULES}, s AS (SELECT DISTINCT 'file:' || f.file_path AS file, CASE WHEN kind IN ('class', 'interface', 'struct', 'trait', 'enum', 'impl') THEN 'component' ELSE 'symbol' END AS type, f.file_path || ':' || y.name AS qn FROM sy y JOIN files f ON f.file_id = y.file_id)
        SELECT 'repository' AS type, count(DISTINCT repo) AS n FROM files WHERE repo IS NOT NULL UNION ALL SELECT 'module', count(*) FROM mods UNION ALL SELECT 'file', count(DISTINCT file_path) FROM files UNION ALL SELECT type, count(DISTINCT qn) FROM s GROUP BY type
        UNION ALL SELECT 'contains', (SELECT count(*) FROM (SELECT DISTINCT m.module, f.file_path FROM in_module m JOIN files f ON f.file_id = m.file_id)) + (SELECT count(*) FROM s WHERE type = 'component') UNION ALL SELECT 'defined-in', count(*) FROM s WHERE type = 'symbol'""",
    "call_resolution": f"""WITH {BASE}, y AS (SELECT id, name, qualified_name, file_path FROM nodes WHERE type IN ('symbol', 'component')), c AS (SELECT DISTINCT e.source AS caller, a.file_path AS caller_file, b.name AS callee, split_part(b.name, '.', -1) AS part FROM edges e JOIN y a ON a.id = e.source JOIN y b ON b.id = e.target WHERE e.type = 'calls' AND b.name IS NOT NULL),
        h AS (SELECT caller, callee, y.id, 0 AS r FROM c JOIN y ON y.qualified_name = c.callee UNION ALL SELECT caller, callee, y.id, CASE WHEN y.file_path = caller_file THEN 1 ELSE 2 END FROM c JOIN y ON y.name = c.callee UNION ALL SELECT caller, callee, y.id, 3 FROM c JOIN y ON y.name = c.part WHERE part <> callee)
        SELECT DISTINCT caller AS source, id AS target FROM (SELECT *, row_number() OVER (PARTITION BY caller, callee ORDER BY r, id) AS rn FROM h) WHERE rn = 1 AND caller <> id""",
    "schema_projection": f"""WITH {NODES}, t AS (SELECT lower(name) AS name, min(id) AS target FROM nodes WHERE type = 'database-table' AND name IS NOT NULL GROUP BY 1), c AS (SELECT id, lower(name) AS name FROM nodes WHERE type = 'component' AND name IS NOT NULL),
        m AS (SELECT coalesce(a.target, b.target) AS target, count(*) AS n FROM c LEFT JOIN t a ON a.name = c.name LEFT JOIN t b ON b.name = c.name || 's' GROUP BY 1) SELECT n.id, n.name, coalesce(m.n, 0) AS n_models FROM nodes n LEFT JOIN m ON m.target = n.id WHERE n.type = 'database-table'""",
    "ddl_foreign_keys": rf"""WITH {PARTS} SELECT file_id, table_name, column_name, references_table, CASE WHEN references_column = '' THEN 'id' ELSE references_column END AS references_column FROM (SELECT file_id, table_name,
        CASE WHEN regexp_matches(part, '{_FK}') THEN regexp_extract(part, '{_FK}', 1) ELSE regexp_extract(part, '{_IK}', 1) END AS column_name, CASE WHEN regexp_matches(part, '{_FK}') THEN regexp_extract(part, '{_FK}', 2) ELSE regexp_extract(part, '{_IK}', 2) END AS references_table,
        CASE WHEN regexp_matches(part, '{_FK}') THEN regexp_extract(part, '{_FK}', 3) ELSE regexp_extract(part, '{_IK}', 3) END AS references_column FROM parts WHERE regexp_matches(part, '{_FK}') OR regexp_matches(part, '{_IK}'))""",
    "capability_chain": bfs_sql(2, least=0.3, starts=hub_cte(type_="component"), select=f"""SELECT t.place, t.stage, t.id, t.confidence FROM (WITH near AS (SELECT id FROM reached UNION SELECT source FROM edges WHERE type = 'tests' AND target IN (SELECT id FROM reached)
        UNION SELECT source FROM edges WHERE type IN ('handles-route', 'api-flow') AND target IN (SELECT r.id FROM reached r JOIN nodes n ON n.id = r.id WHERE n.type = 'component')
        UNION SELECT target FROM edges WHERE type IN ('configures', 'feature-flag') AND source IN (SELECT id FROM reached) UNION SELECT source FROM edges WHERE type IN ('configures', 'feature-flag') AND target IN (SELECT id FROM reached)),
        d AS (SELECT id, type, {_LAYER0} AS layer, {ROLE.replace("lower(file_path)", "lower(coalesce(file_path, ''))")} AS role, file_path, generation_created FROM nodes WHERE id IN (SELECT id FROM near)) """
        + " UNION ALL ".join(f"SELECT {p} AS place, '{n}' AS stage, (SELECT id FROM d WHERE {c} ORDER BY generation_created, id LIMIT 1) AS id, CASE WHEN EXISTS (SELECT 1 FROM d WHERE {c}) THEN {sure} ELSE 0.5 END AS confidence" for p, n, c, sure in X.STAGES)
        + " UNION ALL SELECT 1, 'feature-request', NULL, 1.0 UNION ALL SELECT 11, 'related-workflows', NULL, 0.7) t"),
    "maintainability": f"""WITH RECURSIVE {FILES}, {BASE}, {CC}, {HOT}, {COUPLING}, e AS (SELECT DISTINCT source AS s, target AS t FROM edges WHERE type IN {sql_list(CYCLE_TYPES)} AND source <> target),
        reach AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM reach r JOIN e ON e.s = r.t), least_of AS (SELECT a.s AS id, min(a.t) AS component FROM reach a JOIN reach b ON b.s = a.t AND b.t = a.s GROUP BY a.s),
        m AS (SELECT (SELECT count(DISTINCT component) FROM least_of) AS n_cycles, (SELECT count(*) FROM hot) AS n_hot, (SELECT coalesce(avg(cc), 1) FROM cc) AS c, (SELECT coalesce(avg(floor(raw * 100 + 0.5) / 100), 0) FROM rated) AS i),
        z AS (SELECT n_cycles, n_hot, CAST(greatest(0, least(100, floor(100 - (greatest(0, c - 5) * 2 + i * 30 + least(25, n_cycles * 5) + least(20, n_hot * 2)) + 0.5))) AS INT) AS score FROM m)
        SELECT *, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM z""",
    "prompt_evidence": f"WITH {NODES} SELECT id, type, name FROM nodes WHERE " + " OR ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for w in ("add", "ledger", "export", "the", "invoice", "panel") for c in ("name", "qualified_name", "description")) + " ORDER BY type IN ('component', 'api-endpoint', 'service') DESC, name NULLS FIRST, id LIMIT 10",
    "feature_context": bfs_sql(2, least=0.3, starts=hub_cte(type_="component"), select=f"""SELECT * FROM (WITH near AS (SELECT id FROM reached UNION SELECT source FROM edges WHERE type = 'tests' AND target IN (SELECT id FROM reached)
        UNION SELECT source FROM edges WHERE type IN ('handles-route', 'api-flow') AND target IN (SELECT r.id FROM reached r JOIN nodes n ON n.id = r.id WHERE n.type = 'component')
        UNION SELECT target FROM edges WHERE type IN ('configures', 'feature-flag') AND source IN (SELECT id FROM reached) UNION SELECT source FROM edges WHERE type IN ('configures', 'feature-flag') AND target IN (SELECT id FROM reached)), d AS (SELECT CASE WHEN type IN ('component', 'api-endpoint', 'test-suite', 'module') THEN type ELSE 'other' END AS kind, {_LAYER0} AS layer, id, generation_created FROM nodes WHERE id IN (SELECT id FROM near)),
        r AS (SELECT *, row_number() OVER (PARTITION BY kind, layer ORDER BY generation_created, id) AS rn, count(*) OVER (PARTITION BY kind, layer) AS n FROM d) SELECT kind, layer, n, id AS first FROM r WHERE rn = 1) x"""),
    "top_languages": f"WITH {NODES} SELECT language, count(*) AS n FROM nodes WHERE language IS NOT NULL GROUP BY language ORDER BY n DESC, language LIMIT 3",
    "status_metrics": f"WITH {BASE} SELECT count(CASE WHEN type = 'symbol' THEN 1 END) AS symbols, count(CASE WHEN type IN ('api-endpoint', 'component') THEN 1 END) AS entry_points, count(CASE WHEN type = 'test-suite' THEN 1 END) AS tests, count(CASE WHEN type = 'external-dependency' THEN 1 END) AS dependencies, (SELECT count(*) FROM edges) AS relationships FROM nodes",
    "tree_view": f"WITH {NODES} SELECT * FROM (SELECT id, type, CAST(row_number() OVER (PARTITION BY type ORDER BY generation_created, id) AS INT) AS place, count(*) OVER (PARTITION BY type) AS n FROM nodes) WHERE place <= 50",
    "search_listing": f"WITH {NODES}, h AS (SELECT * FROM nodes WHERE contains(lower(coalesce(name, '')), 'warehouse') OR contains(lower(coalesce(qualified_name, '')), 'warehouse') OR contains(lower(coalesce(description, '')), 'warehouse') ORDER BY generation_created, id LIMIT 20) SELECT type, id FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY generation_created, id) AS r FROM h) WHERE r <= 5",
    "file_stats": f"WITH {FILES} SELECT language, count(*) AS n_files, CAST(sum(byte_count) AS BIGINT) AS bytes, CAST(sum(coalesce(len(symbols), 0)) AS BIGINT) AS n_symbols FROM files GROUP BY language",
}
