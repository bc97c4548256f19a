"""Queries over source files and texts."""

from __future__ import annotations

from codeloom.llm import files as FI
from codeloom.llm import texts as TX
from codeloom.runtime import load


def p3_found(spark, d):
    return FI.file_origins(load(spark, d, "parse_results")).select("file_id").distinct()


def p3_kinds(spark, d):
    return FI.file_origins(load(spark, d, "parse_results"))


def p4_found(spark, d):
    return FI.broken_files(load(spark, d, "parse_results")).select("file_id").distinct()


def p4_rates(spark, d):
    return FI.broken_rates(load(spark, d, "parse_results"))


def p5_found(spark, d):
    return FI.credentials(load(spark, d, "parse_results"), load(spark, d, "docker_services"))


def p5_redacted_files(spark, d):
    return FI.redacted_files(load(spark, d, "parse_results"))


def p5_redacted_services(spark, d):
    return FI.redacted_services(load(spark, d, "docker_services"))


def p7_ids(spark, d):
    return TX.token_ids(load(spark, d, "documents"))


def p8_found(spark, d):
    return TX.leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p8_report(spark, d):
    return TX.leak_report(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p9_pieces(spark, d):
    return TX.split_texts(load(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_kinds, p4_found, p4_rates, p5_found, p5_redacted_files, p5_redacted_services, p7_ids, p8_found, p8_report, p9_pieces)}
ORACLE: dict[str, str] = {}
