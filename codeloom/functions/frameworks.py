"""Frameworks and words of requests: fixed tables and the columns that read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.columns import col

# Packages of a manifest, the first of which names the framework.
NPM_FRAMEWORKS = [("next", "Next.js"), ("nuxt", "Nuxt"), ("@angular/core", "Angular"), ("react", "React"), ("vue", "Vue"), ("express", "Express"), ("@nestjs/core", "NestJS"), ("fastify", "Fastify")]
# Parts of imports that show a test framework, in the order they are looked for.
TEST_FRAMEWORKS = [("jest", "Jest"), ("vitest", "Vitest"), ("mocha", "Mocha"), ("pytest", "pytest"), ("junit", "JUnit"), ("xunit", "xUnit"), ("nunit", "NUnit"), ("testing", "Go testing")]
# What frameworks are for.
FRONTEND = ["React", "Angular", "Vue", "Nuxt", "Next.js", "Svelte"]
BACKEND = ["Express", "NestJS", "Fastify", "Spring", "ASP.NET", "Django", "Flask", "Gin"]
# Words of a chat request that say nothing of its subject.
CHAT_STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into through during before after above below between and but or not no nor so yet both either neither "
    "each every all any few more most other some such than too very just also add new feature request want need like please i we you it this that these those"
).split()


def npm_framework(manifest: Column | str) -> Column:
    """(framework, version) of a package.json; development packages count too and win over others of one name. Null for no JSON or no known package."""
    found = []
    for package, name in NPM_FRAMEWORKS:
        at = lambda part: F.get_json_object(col(manifest), f"$.{part}['{package}']")  # noqa: B023, E731
        version = F.coalesce(at("devDependencies"), at("dependencies"))
        found.append(F.when(F.coalesce(version, F.lit("")) != "", F.struct(F.lit(name).alias("framework"), version.alias("version"))))
    return F.coalesce(*found)


def framework_category(name: Column | str) -> Column:
    return F.when(col(name).isin(FRONTEND), "frontend").when(col(name).isin(BACKEND), "backend").otherwise("other")


def chat_keywords(text: Column | str) -> Column:
    """The words of a request in order: three letters and more, none of the stop words."""
    words = F.transform(F.split(col(text), r"\s+"), lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z0-9_-]", "")))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(CHAT_STOP_WORDS))


def report_risk(direct: Column, transitive: Column, tests: Column, apis: Column, services: Column) -> Column:
    """Risk of a change by the scale of the impact report; columns.risk_of is the shorter scale."""
    total = direct + transitive
    return F.when((services > 2) | (apis > 5) | (total > 50), "critical").when((services > 0) | (apis > 2) | (total > 20), "high").when((apis > 0) | (total > 5) | (tests > 3), "medium").otherwise("low")


def _is(resolution: str):
    return lambda x: x["resolution"] == resolution


def evidence_counts(evidence: Column | str) -> dict[str, Column]:
    """How many entries of an evidence array are of each resolution."""
    e = F.coalesce(col(evidence), F.array().cast("array<struct<type:string,source:string,description:string,resolution:string,confidence:double>>"))
    return {r: F.size(F.filter(e, _is(r))) for r in ("confirmed", "resolved", "heuristic", "unresolved")}


def evidence_sentence(evidence: Column | str) -> Column:
    """One sentence on an evidence array: how many entries, of which resolution, and their mean confidence in percent (0 without any)."""
    n = F.size(F.coalesce(col(evidence), F.array()))
    parts = F.concat_ws(", ", *(F.when(c > 0, F.concat(c.cast("string"), F.lit(f" {r}"))) for r, c in evidence_counts(evidence).items()))
    total = F.aggregate(F.coalesce(F.transform(col(evidence), lambda x: F.coalesce(x["confidence"], F.lit(0.0))), F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    percent = F.floor(F.when(n > 0, total / n).otherwise(0.0) * 100 + 0.5).cast("string")
    return F.concat(n.cast("string"), F.lit(" evidence items ("), parts, F.lit("). Overall confidence: "), percent, F.lit("%."))


def prompt_scores(n_evidence: Column, n_tests: Column) -> dict[str, Column]:
    """Scores from 0 to 5 of a prompt, by the evidence found for it."""
    some = n_evidence > 0
    return {
        "intent_preservation": F.lit(5), "clarity": F.lit(4), "specificity": F.when(some, 5).otherwise(3), "repository_fit": F.when(some, 5).otherwise(2), "testability": F.when(n_tests > 0, 5).otherwise(3), "token_efficiency": F.lit(5),
    }
