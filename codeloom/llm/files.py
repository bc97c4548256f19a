"""Operators over source files: origin, syntax, credentials.

Each reads the files once, in Arrow batches; texts are never shuffled. All take
extra columns as they come: only those named are read. Null paths and texts are
allowed; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import origin, secrets, syntax
from codeloom.llm.bpe import load_ranks, tokenizer_path
from codeloom.runtime import cut, small


def _map(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Rows out of Arrow batches: `make` is called once a task, its result for each row's values in turn."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            rows = [r for values in zip(*(b.column(i).to_pylist() for i in range(len(columns)))) for r in f(*values)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names, types = arrow.names, arrow.types
    return df.mapInArrow(run, schema)


def file_origins(files: DataFrame) -> DataFrame:
    """file_id, kind of every file that nobody wrote by hand here: generated, minified, vendored or data.

    Notices are matched in the files' headers (the comments before and after the code)
    by one automaton over all phrases; path rules and the shape of the text add what
    says nothing of itself. A copy of a library without notice is found by the digest
    of its body, which some marked copy shares, or by a directory of its repository
    that bears the library's name. What a workspace excludes proves nothing, not even with
    a licence in the file: own code bears one too. A null text is judged by its path.
    Repeated rows give one row.
    """

    def make():
        parts = origin.automaton()

        def one(file_id, path, text):
            kind, library = origin.judge(text, path, parts)
            path = (path or "").replace("\\", "/")
            own = None if kind else origin.LIBRARY_DIRS.search(path)
            return [(file_id, kind, library.lower().replace("_", "-") if library else None, origin.body_key(text) if text and kind in (None, "vendored") else None, own[1].lower().replace("_", "-") if own else None, path.split("/", 1)[0])]

        return one

    judged = cut(_map(files.select("file_id", "file_path", "content"), make, "file_id long, kind string, library string, body binary, dir string, repo string").distinct())
    known = judged.filter("kind IS NOT NULL").select("file_id", "kind")
    rest = judged.filter("kind IS NULL")
    bodies = judged.filter("kind = 'vendored' AND body IS NOT NULL").select("body").distinct()
    libraries = judged.filter("kind = 'vendored' AND library IS NOT NULL").select("repo", F.col("library").alias("dir")).distinct()
    copies = rest.join(small(cut(bodies)), "body", "left_semi").select("file_id").unionByName(rest.join(small(cut(libraries)), ["repo", "dir"], "left_semi").select("file_id"))
    return known.unionByName(copies.distinct().withColumn("kind", F.lit("vendored"))).distinct()


def broken_files(files: DataFrame) -> DataFrame:
    """file_id, reason of every file whose text is no valid text of its extension's language.

    Null or empty texts, Markdown, Docker files and unknown extensions are never
    cases. Repeated rows give one row.
    """

    def make():
        def one(file_id, path, text):
            why = syntax.diagnose(text, path)
            return [(file_id, why)] if why else []

        return one

    return _map(files.select("file_id", "file_path", "content"), make, "file_id long, reason string").distinct()


def broken_rates(files: DataFrame) -> DataFrame:
    """repo, language, n_files, n_broken, rate: broken files per repository and language (lower case, '' if null)."""
    broken = small(cut(broken_files(files).select("file_id").distinct()))
    one = files.groupBy("file_id").agg(F.max(F.struct("repo", F.lower(F.coalesce("language", F.lit(""))).alias("language"))).alias("f"))
    marked = one.join(broken.withColumn("broken", F.lit(1)), "file_id", "left")
    return marked.groupBy(F.col("f.repo").alias("repo"), F.col("f.language").alias("language")).agg(F.count("*").alias("n_files"), F.count("broken").alias("n_broken")).withColumn("rate", F.col("n_broken") / F.col("n_files"))


def dictionary(tokenizer: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> frozenset[str]:
    """The words of four letters and more of a public vocabulary, a list of fixed size whatever the corpus; none if the file is not there."""
    path = tokenizer_path(tokenizer, folder)
    if not os.path.exists(path):
        return frozenset()
    return frozenset(b[1:].decode("ascii").lower() for b in load_ranks(path) if len(b) > 4 and b[:1] == b" " and b[1:].isalpha() and b.isascii())


def file_secrets(files: DataFrame, words: frozenset[str]) -> DataFrame:
    """origin, record_id, place of the credentials in the files' texts; place is the line from 1."""
    known = files.sparkSession.sparkContext.broadcast(words)

    def make():
        w, triggers = known.value, secrets.automaton()

        def one(file_id, path, text):
            return [("file", file_id, p) for p in {p for p, _, _ in secrets.find_secrets(text, secrets.is_plain(path), w, triggers)}]

        return one

    return _map(files.select("file_id", "file_path", "content"), make, "origin string, record_id long, place int").distinct()


def service_secrets(services: DataFrame, words: frozenset[str]) -> DataFrame:
    """origin, record_id, place of the credentials in the services' environment; place is the position from 1."""
    known = services.sparkSession.sparkContext.broadcast(words)

    def make():
        w, triggers = known.value, secrets.automaton()

        def one(service_id, environment):
            return [("docker", service_id, i) for i, e in enumerate(environment or [], 1) if secrets.find_secrets(e, True, w, triggers)]

        return one

    return _map(services.select("service_id", "environment"), make, "origin string, record_id long, place int").distinct()


def credentials(files: DataFrame, services: DataFrame) -> DataFrame:
    """Credentials of files and services. Values are read by Viterbi over the words of a public vocabulary."""
    words = dictionary()
    return file_secrets(files, words).unionByName(service_secrets(services, words))


def redacted_files(files: DataFrame) -> DataFrame:
    """file_id, content of the files that hold credentials, each replaced by the word REDACTED and all else unchanged."""
    known = files.sparkSession.sparkContext.broadcast(dictionary())

    def make():
        w, triggers = known.value, secrets.automaton()

        def one(file_id, path, text):
            found = secrets.find_secrets(text, secrets.is_plain(path), w, triggers)
            return [(file_id, secrets.redact(text, found))] if found else []

        return one

    return _map(files.select("file_id", "file_path", "content"), make, "file_id long, content string").distinct()


def redacted_services(services: DataFrame) -> DataFrame:
    """service_id, environment of the services that hold credentials, each replaced by the word REDACTED."""
    known = services.sparkSession.sparkContext.broadcast(dictionary())

    def make():
        w, triggers = known.value, secrets.automaton()

        def one(service_id, environment):
            found = [secrets.find_secrets(e, True, w, triggers) for e in environment or []]
            return [(service_id, [secrets.redact(e, f) for e, f in zip(environment, found)])] if any(found) else []

        return one

    return _map(services.select("service_id", "environment"), make, "service_id long, environment array<string>").distinct()
