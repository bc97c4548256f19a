"""What source texts declare: symbols, imports, endpoints, tables, services, headings, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.columns import slug

# Line patterns of declarations by language: (kind, pattern, group of the name).
SYMBOLS = {
    "typescript": [
        ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", 1),
        ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)", 1),
        ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)", 1),
        ("arrow", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[a-zA-Z0-9_]+)\s*=>", 1),
        ("type-alias", r"^\s*(?:export\s+)?type\s+(\w+)", 1),
        ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)", 1),
    ],
    "java": [
        ("package", r"^\s*package\s+([\w.]+)", 1),
        ("class", r"^\s*(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+)?(?:class|record)\s+(\w+)", 1),
        ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)", 1),
        ("method", r"^\s*(?:public|private|protected)\s+(?:static\s+)?(?:abstract\s+|final\s+)?(?:synchronized\s+)?(?:<[\w,\s]+>\s+)?([\w<>\[\]]+)\s+(\w+)\s*\(", 2),
    ],
    "csharp": [
        ("namespace", r"^\s*namespace\s+([\w.]+)", 1),
        ("class", r"^\s*(?:public|private|protected|internal)?\s*(?:abstract|sealed|static|partial)?\s*(?:class|record|struct)\s+(\w+)", 1),
        ("interface", r"^\s*(?:public|internal)?\s*interface\s+(\w+)", 1),
        ("method", r"^\s*(?:public|private|protected|internal)\s+(?:static\s+|async\s+|virtual\s+|override\s+|abstract\s+)*([\w<>\[\]]+)\s+(\w+)\s*\(", 2),
    ],
    "python": [("class", r"^class\s+(\w+)(?:\(([^)]+)\))?:", 1), ("method", r"^\s+(?:async\s+)?def\s+(\w+)\s*\(", 1), ("function", r"^(?:async\s+)?def\s+(\w+)\s*\(", 1)],
    "go": [("package", r"^package\s+(\w+)", 1), ("function", r"^func\s+(\w+)\s*\(", 1), ("method", r"^func\s+\(\w+\s+\*?(\w+)\)\s+(\w+)\s*\(", 2), ("struct", r"^type\s+(\w+)\s+struct", 1), ("interface", r"^type\s+(\w+)\s+interface", 1)],
    "rust": [
        ("struct", r"^\s*(?:pub(?:\([^)]+\))?\s+)?struct\s+(\w+)", 1),
        ("enum", r"^\s*(?:pub(?:\([^)]+\))?\s+)?enum\s+(\w+)", 1),
        ("trait", r"^\s*(?:pub(?:\([^)]+\))?\s+)?trait\s+(\w+)", 1),
        ("function", r"^\s*(?:pub(?:\([^)]+\))?\s+)?(?:async\s+)?fn\s+(\w+)", 1),
    ],
    "cpp": [
        ("namespace", r"^\s*namespace\s+(\w+)", 1),
        ("class", r"^\s*(?:template\s*<[^>]+>\s*)?(?:class|struct)\s+(\w+)", 1),
        ("function", r"^\s*(?:virtual\s+|static\s+|inline\s+)*[\w:*&<>]+\s+(\w+::)?(\w+)\s*\([^)]*\)\s*(?:const)?\s*(?:override|final)?\s*[{;]", 2),
    ],
}
SYMBOLS["javascript"] = SYMBOLS["typescript"]
# Methods and functions are none on lines that hold these.
NOT_ON = {"java": ["class ", "interface "], "csharp": ["class ", "interface "], "cpp": ["class ", "struct "]}
# Line patterns of imports by language: (pattern, group of what is imported).
IMPORTS = {
    "typescript": [(r"^\s*import\s.*from\s+['\"]([^'\"]+)['\"]", 1), (r"^\s*import\s+['\"]([^'\"]+)['\"]", 1)],
    "java": [(r"^\s*import\s+(?:static\s+)?([\w.*]+);", 1)],
    "csharp": [(r"^\s*using\s+(?:static\s+)?([\w.]+);", 1)],
    "python": [(r"^\s*from\s+([\w.]+)\s+import\s+(.+)", 1), (r"^\s*import\s+([\w.]+)", 1)],
    "rust": [(r"^\s*use\s+([\w:]+(?:\{[^}]+\})?);", 1)],
    "cpp": [(r"^\s*#include\s+[\"<]([^\">]+)[\">]", 1)],
    "docker": [(r"(?i)^\s*FROM\s+([^\s]+)", 1)],
}
IMPORTS["javascript"] = IMPORTS["typescript"]
# Line patterns of routes by language: (pattern, group of the method, group of the path).
ROUTES = {
    "typescript": [(r"(?i)\.(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, 2), (r"@(Get|Post|Put|Delete|Patch)\s*\(\s*['\"`]?([^'\"`)]*)['\"`]?\s*\)", 1, 2)],
    "go": [(r"(?i)\.(GET|POST|PUT|DELETE|PATCH)\s*\(\s*['\"]([^'\"]+)['\"]", 1, 2)],
    "rust": [(r"(?i)#\[(get|post|put|delete|patch)\s*\(\s*[\"']([^\"']+)[\"']", 1, 2)],
    "java": [(r"@(Get|Post|Put|Delete|Patch)Mapping\s*\(\s*(?:value\s*=\s*)?[\"']([^\"']+)[\"']", 1, 2)],
    "csharp": [(r"\[Http(Get|Post|Put|Delete|Patch)\s*\(\s*\"([^\"]+)\"", 1, 2)],
    "python": [(r"@\w+\.(get|post|put|delete|patch|route)\s*\(\s*['\"]([^'\"]+)['\"]", 1, 2)],
}


def lines_of(files: DataFrame) -> DataFrame:
    """file_id, file_path, language, line_no from 1, line: every line of every text, line ends read alike.

    `files` has one row a file; a null text has no lines.
    """
    split = F.posexplode(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")).alias("i", "line")
    return files.filter("content IS NOT NULL").select("file_id", "file_path", "language", split).select("file_id", "file_path", "language", (F.col("i") + 1).alias("line_no"), "line")


def _matches(line: Column, pattern: str) -> Column:
    return line.rlike(pattern)


def symbols(lines: DataFrame) -> DataFrame:
    """file_id, line_no, rule, kind, name of the declarations, by the rules of each file's language in one pass over the lines."""
    line, per_language = F.col("line"), []
    for language, table in SYMBOLS.items():
        hits = []
        for k, (kind, pattern, group) in enumerate(table):
            ok = _matches(line, pattern)
            if kind in ("method", "function"):
                for word in NOT_ON.get(language, []):
                    ok &= ~line.contains(word)
            hits.append(F.when(ok, F.struct(F.lit(k).alias("rule"), F.lit(kind).alias("kind"), F.regexp_extract(line, pattern, group).alias("name"))))
        per_language.append((language, F.array_compact(F.array(*hits))))
    found = None
    for language, hits in per_language:
        found = F.when(F.col("language") == language, hits) if found is None else found.when(F.col("language") == language, hits)
    return lines.select("file_id", "line_no", F.explode(found).alias("s")).select("file_id", "line_no", "s.rule", "s.kind", "s.name")


def imports(lines: DataFrame) -> DataFrame:
    """file_id, file_path, line_no, source of the imports, the first rule of the language that holds."""
    line, found = F.col("line"), None
    for language, table in IMPORTS.items():
        one = F.coalesce(*(F.when(_matches(line, p), F.regexp_extract(line, p, g)) for p, g in table))
        found = F.when(F.col("language") == language, one) if found is None else found.when(F.col("language") == language, one)
    return lines.select("file_id", "file_path", "line_no", found.alias("source")).filter("source IS NOT NULL")


def routes(lines: DataFrame) -> DataFrame:
    """file_id, line_no, method, path of the endpoints; a .route is a GET, a path begins with /."""
    line, found = F.col("line"), None
    for language, table in ROUTES.items():
        one = F.coalesce(*(F.when(_matches(line, p), F.struct(F.upper(F.regexp_extract(line, p, m)).alias("method"), F.regexp_extract(line, p, g).alias("path"))) for p, m, g in table))
        test = F.col("language").isin(language, "javascript") if language == "typescript" else F.col("language") == language
        found = F.when(test, one) if found is None else found.when(test, one)
    r = lines.select("file_id", "line_no", found.alias("r")).filter("r IS NOT NULL")
    path = F.when(F.col("r.path").startswith("/"), F.col("r.path")).otherwise(F.concat(F.lit("/"), "r.path"))
    return r.select("file_id", "line_no", F.when(F.col("r.method") == "ROUTE", "GET").otherwise(F.col("r.method")).alias("method"), path.alias("path"))


# Patterns of table definitions.
CREATE_TABLE = r"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:[`\"']?\w+[`\"']?\.)?[`\"']?(\w+)[`\"']?\s*\((.*?)\);"
FOREIGN_KEY = r"(?i)FOREIGN\s+KEY\s*\([`\"']?(\w+)[`\"']?\)\s*REFERENCES\s+[`\"']?(\w+)[`\"']?\s*(?:\([`\"']?(\w+)[`\"']?\))?"
INLINE_KEY = r"(?i)^[`\"']?(\w+)[`\"']?\s+[A-Za-z0-9_()]+.*?REFERENCES\s+[`\"']?(\w+)[`\"']?\s*(?:\([`\"']?(\w+)[`\"']?\))?"
COLUMN = r"^[`\"']?(\w+)[`\"']?\s+([A-Za-z0-9_()]+)(.*)"


def table_columns(files: DataFrame) -> DataFrame:
    """file_id, table_name, place, column_name, column_type, is_primary, is_nullable of SQL files. Definitions are split at commas, whatever stands in parentheses."""
    tables = files.filter("language = 'sql' AND content IS NOT NULL").select("file_id", F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(CREATE_TABLE), 1).alias("name"), F.regexp_extract_all("content", F.lit(CREATE_TABLE), 2).alias("body"))).alias("t"))
    parts = tables.select("file_id", F.col("t.name").alias("table_name"), F.posexplode(F.transform(F.split("t.body", ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))).alias("place", "part"))
    part = F.col("part")
    plain = ~part.rlike(FOREIGN_KEY) & ~part.rlike(r"(?i)^PRIMARY\s+KEY") & part.rlike(COLUMN)
    rest = F.upper(F.regexp_extract(part, COLUMN, 3))
    return parts.filter(plain).select(
        "file_id", "table_name", "place", F.regexp_extract(part, COLUMN, 1).alias("column_name"), F.regexp_extract(part, COLUMN, 2).alias("column_type"), rest.contains("PRIMARY KEY").alias("is_primary"), (~rest.contains("NOT NULL")).alias("is_nullable")
    )


def foreign_keys(files: DataFrame) -> DataFrame:
    """file_id, table_name, column_name, references_table, references_column ('id' if none is named)."""
    tables = files.filter("language = 'sql' AND content IS NOT NULL").select("file_id", F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(CREATE_TABLE), 1).alias("name"), F.regexp_extract_all("content", F.lit(CREATE_TABLE), 2).alias("body"))).alias("t"))
    parts = tables.select("file_id", F.col("t.name").alias("table_name"), F.explode(F.transform(F.split("t.body", ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))).alias("part"))
    key = lambda p: F.when(F.col("part").rlike(p), F.struct(*(F.regexp_extract("part", p, g).alias(n) for g, n in ((1, "column_name"), (2, "references_table"), (3, "references_column")))))
    found = parts.select("file_id", "table_name", F.coalesce(key(FOREIGN_KEY), key(INLINE_KEY)).alias("k")).filter("k IS NOT NULL")
    return found.select("file_id", "table_name", "k.column_name", "k.references_table", F.when(F.col("k.references_column") == "", "id").otherwise(F.col("k.references_column")).alias("references_column"))


def dockerfiles(lines: DataFrame) -> DataFrame:
    """file_id, image, ports: the first FROM and all exposed ports of Docker files."""
    image = F.when(F.col("line").rlike(r"(?i)^\s*FROM\s+"), F.regexp_extract("line", r"(?i)^\s*FROM\s+(\S+)", 1))
    ports = F.when(F.col("line").rlike(r"(?i)^\s*EXPOSE\s+[0-9]"), F.split(F.trim(F.regexp_extract("line", r"(?i)^\s*EXPOSE\s+([0-9\s]+)", 1)), r"\s+"))
    d = lines.filter(F.lower(F.element_at(F.split("file_path", "/"), -1)).startswith("dockerfile")).select("file_id", "line_no", image.alias("image"), ports.alias("ports"))
    return d.groupBy("file_id").agg(F.min(F.when(F.col("image").isNotNull(), F.struct("line_no", "image"))).alias("i"), F.sort_array(F.flatten(F.collect_list("ports"))).alias("ports")).select("file_id", F.col("i.image").alias("image"), "ports")


# Keys of a compose file that name no service.
NO_SERVICE = ["version", "services", "networks", "volumes", "configs", "secrets", "x-common"]


def compose_services(lines: DataFrame) -> DataFrame:
    """file_id, service, image, ports, depends_on of compose files, whose lines go to the last service and the last list named before them."""
    t, line = F.trim(F.col("line")), F.col("line")
    c = lines.filter(F.lower("file_path").contains("docker-compose"))
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    top = F.when(line.rlike(r"^[a-zA-Z0-9_-]+:"), F.lower(F.regexp_extract(line, r"^([a-zA-Z0-9_-]+):", 1)))
    c = c.select("file_id", "line_no", line.alias("line"), t.alias("t"), F.last(top, ignorenulls=True).over(w).alias("top"))
    name = F.when((F.col("top") == "services") & F.col("line").rlike(r"^ {2}([a-zA-Z0-9_-]+):\s*$"), F.regexp_extract("line", r"^ {2}([a-zA-Z0-9_-]+):", 1))
    name = F.when(~name.isin(NO_SERVICE), name)
    block = F.when(F.col("t").rlike(r"(?i)^(depends_on|ports):\s*$"), F.lower(F.regexp_extract("t", r"^(\w+):", 1))).when(F.col("t").rlike(r"^[\w-]+:"), F.lit(""))
    c = c.filter("top = 'services'").withColumns({"service": F.last(name, ignorenulls=True).over(w), "block": F.last(block, ignorenulls=True).over(w)}).filter("service IS NOT NULL")
    item = F.col("t").rlike(r"^-\s*")
    image = F.when(F.col("t").rlike(r"(?i)^image:"), F.regexp_extract("t", r"(?i)^image:\s*['\"]?([^'\"]+)['\"]?", 1))
    port = F.when(item & (F.col("block") == "ports"), F.regexp_extract("t", r"^-\s*['\"]?([0-9:]+)['\"]?", 1))
    dep = F.when(item & (F.col("block") == "depends_on"), F.regexp_extract("t", r"^-\s*([a-zA-Z0-9_-]+)", 1))
    return c.groupBy("file_id", "service").agg(F.max(image).alias("image"), F.sort_array(F.collect_list(port)).alias("ports"), F.sort_array(F.collect_list(dep)).alias("depends_on"))


def yaml_keys(lines: DataFrame) -> DataFrame:
    """file_id, line_no, key of the top-level keys in the first 200 lines of YAML files."""
    p = r"^(\w[\w.-]*):"
    return lines.filter((F.col("language") == "yaml") & (F.col("line_no") <= 200) & F.col("line").rlike(p)).select("file_id", "line_no", F.regexp_extract("line", p, 1).alias("key"))


def json_keys(files: DataFrame) -> DataFrame:
    """file_id, key of the top-level keys of valid JSON objects."""
    return files.filter("language = 'json' AND content IS NOT NULL").select("file_id", F.explode(F.json_object_keys("content")).alias("key"))


def headings(texts: DataFrame) -> DataFrame:
    """doc_id, line_no, level, title, slug of the headings in `texts` (doc_id, text)."""
    p = r"^(#{1,6})\s+(.+)"
    lines = texts.filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("i", "line")).filter(F.col("line").rlike(p))
    title = F.trim(F.regexp_extract("line", p, 2))
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"), F.length(F.regexp_extract("line", p, 1)).alias("level"), title.alias("title"), slug(title).alias("slug"))
