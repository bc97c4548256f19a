"""Column expressions: paths, words, scores, grades. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import rules


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_round(x: Column, digits: int = 0) -> Column:
    """Half up at the given digits, as floor(x * 10^digits + 0.5) / 10^digits."""
    k = 10.0**digits
    return F.floor(x * k + 0.5) / k if digits else F.floor(x + 0.5)


def _path_rule(low: Column, marks: list[str]) -> Column:
    have = None
    for m in marks:
        if m[0] == "-":
            continue
        one = low.endswith(m[1:]) if m[0] == "$" else low.rlike(m[1:]) if m[0] == "~" else low.contains(m)
        have = one if have is None else have | one
    for m in marks:
        if m[0] == "-":
            have &= ~low.contains(m[1:])
    return have


def _first_rule(low: Column, table: list[tuple[str, list[str]]], otherwise: str) -> Column:
    out = None
    for name, marks in table:
        out = F.when(_path_rule(low, marks), name) if out is None else out.when(_path_rule(low, marks), name)
    return out.otherwise(otherwise)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def language_of(path: Column | str) -> Column:
    """Language of a file name; null if none is known. Docker names come first."""
    name = F.lower(base_name(path))
    extension = F.element_at(F.split(name, r"\."), -1)
    out = F.when((name == "dockerfile") | name.startswith("dockerfile.") | name.contains("docker-compose"), "docker")
    for language, extensions in rules.LANGUAGES.items():
        out = out.when(extension.isin(extensions), language)
    return out.when(extension == "dockerfile", "docker")


def layer_of(path: Column | str) -> Column:
    return _first_rule(F.lower(col(path)), rules.LAYERS, "unknown")


def role_of(path: Column | str, language: Column | str) -> Column:
    """Architectural role by the rules of the language; 'unknown' where there are none."""
    low, out = F.lower(col(path)), None
    for name, table in rules.ROLES.items():
        rule = _first_rule(low, table, "unknown")
        out = F.when(col(language) == name, rule) if out is None else out.when(col(language) == name, rule)
    return out.otherwise("unknown")


def module_of(path: Column | str) -> Column:
    """The first three directories under a source directory, else the first two parts; null for one part."""
    parts = F.split(col(path), "/")
    three = F.lower(parts[0]).isin(rules.MODULE_TOPS) & (F.size(parts) >= 3)
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, F.when(three, 3).otherwise(2)), "/"))


def tokens(text: Column | str) -> Column:
    """Search terms of code and prose: split at marks and camel case, lower case, two characters at least, no stop words."""
    spaced = F.regexp_replace(col(text), r"[._\-/:\\$#@()\[\]{}<>,\"'`=;]", " ")
    split = F.regexp_replace(F.regexp_replace(spaced, r"([a-z\d])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z\d]+)", "$1 $2")
    clean = F.transform(F.split(F.lower(split), r"\s+"), lambda t: F.regexp_replace(t, "[^a-z0-9]", ""))
    return F.filter(clean, lambda t: (F.length(t) >= 2) & ~t.isin(rules.STOP_WORDS))


def fnv1a(text: Column | str, seed: int = 0) -> Column:
    """FNV-1a hash of 32 bits of an ASCII text, its start mixed with a seed."""
    t = col(text)
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.ascii(F.substring(t, i, F.lit(1))).cast("long"))
    start = F.lit((2166136261 ^ seed) & 0xFFFFFFFF).cast("long")
    return F.when(F.length(t) == 0, start).otherwise(F.aggregate(codes, start, lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))


def resolution_of(confidence: Column | str) -> Column:
    c = col(confidence)
    out = None
    for name, least in rules.RESOLUTIONS[:-1]:
        out = F.when(c >= least, name) if out is None else out.when(c >= least, name)
    return out.otherwise(rules.RESOLUTIONS[-1][0])


def resolution_rank(resolution: Column | str) -> Column:
    """0 for the surest; what is not known comes last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(n) for n, _ in rules.RESOLUTIONS)), col(resolution)), F.lit(0)), F.lit(9)).cast("int")


def clamp01(c: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(c)))


def complexity(text: Column | str, parameters: Column | None = None) -> Column:
    """One, a point for each branch in the text and for each parameter beyond three."""
    points = F.lit(1)
    for pattern in rules.BRANCHES:
        points = points + F.regexp_count(col(text), F.lit(pattern))
    return points + (F.greatest(parameters - 3, F.lit(0)) if parameters is not None else 0)


def graded(x: Column, *steps: tuple[float, str], otherwise: str, at_least: bool = False) -> Column:
    """The name of the first step that x does not exceed (or reaches, with at_least)."""
    out = None
    for limit, name in steps:
        holds = x >= limit if at_least else x <= limit
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise(otherwise)


def complexity_rating(cc: Column) -> Column:
    return graded(cc, (5, "low"), (10, "medium"), (20, "high"), otherwise="very-high")


def instability_rating(x: Column) -> Column:
    return graded(x, (0.25, "stable"), (0.5, "balanced"), (0.75, "unstable"), otherwise="highly-unstable")


def risk_of(total: Column) -> Column:
    return graded(total, (20, "critical"), (10, "high"), (4, "medium"), otherwise="low", at_least=True)


def coverage_grade(percent: Column) -> Column:
    return graded(percent, (90, "A"), (75, "B"), (60, "C"), (40, "D"), otherwise="F", at_least=True)


def maintainability(avg_complexity: Column, avg_instability: Column, cycles: Column, hot: Column) -> Column:
    """0 to 100: what complexity, instability, cycles and hot spots leave of 100."""
    lost = F.greatest(F.lit(0.0), avg_complexity - 5) * 2 + avg_instability * 30 + F.least(F.lit(25), cycles * 5) + F.least(F.lit(20), hot * 2)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), floor_round(100 - lost)))


def maintainability_grade(score: Column) -> Column:
    return graded(score, (85, "A"), (70, "B"), (55, "C"), (40, "D"), otherwise="F", at_least=True)


def token_estimate(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(col(text)) / 4)).cast("int")


def token_reduction(estimate: Column) -> Column:
    return F.greatest(F.lit(0.7), 1 - estimate / F.greatest(estimate * 25, F.lit(45000)))


def slug(title: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(title)), r"\s+", "-")


def keywords(text: Column | str, limit: int | None = None) -> Column:
    """Words of a prompt: lower case, letters, digits, - and _, more than two characters; the first `limit`."""
    words = F.filter(F.transform(F.split(F.lower(col(text)), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9_-]", "")), lambda w: F.length(w) > 2)
    return F.slice(words, 1, limit) if limit else words


def relevance(name: Column | str, word: Column | str) -> Column:
    n, w = F.lower(col(name)), F.lower(col(word))
    return F.when(n == w, 1.0).when(n.contains(w), 0.8).otherwise(0.5)


def normal_path(path: Column | str) -> Column:
    return F.translate(col(path), "\\", "/")


def excluded_by(path: Column | str, pattern: Column | str) -> Column:
    """Whether an exclude pattern holds for a path: a directory anywhere, a file anywhere, a name; hidden files always."""
    p, x = col(path), col(pattern)
    name = base_name(p)
    tail = F.regexp_replace(x, r"^(.*?)\*\*/", "$1")
    folder = F.regexp_replace(tail, r"/\*\*", "")
    any_ = x.contains("**/")
    part = F.regexp_replace(tail, r"^([^*]*)\*", "$1")
    plain = F.regexp_replace(x, r"^([^*]*)\*", "$1")
    in_folder = (name == folder) | p.contains(F.concat(F.lit("/"), folder, F.lit("/"))) | p.startswith(F.concat(folder, F.lit("/")))
    return (any_ & tail.endswith("/**") & in_folder) | (any_ & ~tail.endswith("/**") & ((name == part) | p.contains(part))) | (name == x) | (name == plain) | name.startswith(".")


def folded_path(path: Column | str) -> Column:
    """A path without . and .. parts; .. beyond the root is dropped."""
    return F.array_join(
        F.aggregate(
            F.split(col(path), "/"),
            F.array().cast("array<string>"),
            lambda done, p: F.when(p.isin("", "."), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))),
        ),
        "/",
    )
