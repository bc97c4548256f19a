"""Generated, minified and vendored source files, and data saved as code."""

from __future__ import annotations

import hashlib
import re

import ahocorasick

# Phrases of a header that say how the file came to be; each with what it shows.
# A phrase with "+" needs all of its parts in one notice.
NOTICES = {
    "@generated": "generated",
    "<auto-generated": "generated",
    "<autogenerated": "generated",
    "auto-generated file": "generated",
    "autogenerated file": "generated",
    "file is auto-generated": "generated",
    "file is autogenerated": "generated",
    "file was auto-generated": "generated",
    "file is automatically generated": "generated",
    "file was automatically generated": "generated",
    "file was automatically produced": "generated",
    "file is automatically produced": "generated",
    "automatically generated by": "generated",
    "file was generated by": "generated",
    "file is generated by": "generated",
    "code generated by+do not edit": "generated",
    "generated by+do not edit this file": "generated",
    "generated from+do not edit": "generated",
    "generated by the protocol buffer compiler": "generated",
    "machine-made by": "generated",
    "machine-generated by": "generated",
    "machine generated file": "generated",
    "bison implementation for": "generated",
    "a lexical scanner generated by flex": "generated",
    "this file is a lockfile": "generated",
    "changes to this file will be lost": "generated",
    "manual changes will be overwritten": "generated",
    "generated code - do not": "generated",
    "generated code -- do not": "generated",
    "generated code. do not": "generated",
    "generated file - do not": "generated",
    "generated file. do not": "generated",
    "generated file, do not": "generated",
    "has been automatically generated": "generated",
    "has been auto-generated": "generated",
    "has been autogenerated": "generated",
    "automatically generated, do not": "generated",
    "automatically generated. do not": "generated",
    "automatically generated; do not": "generated",
    "automatically generated - do not": "generated",
    "automatically-generated file": "generated",
    "automatically generated file": "generated",
    "automatically generated code": "generated",
    "generated automatically by": "generated",
    "autogenerated by": "generated",
    "auto-generated by": "generated",
    "auto generated by": "generated",
    "auto-generated. do not": "generated",
    "autogenerated. do not": "generated",
    "auto-generated, do not": "generated",
    "autogenerated, do not": "generated",
    "code was generated by a tool": "generated",
    "code is generated by": "generated",
    "code was auto-generated": "generated",
    "class was generated by": "generated",
    "class is generated by": "generated",
    "generated by cython": "generated",
    "generated by swig": "generated",
    "generated by antlr": "generated",
    "generated by openapi generator": "generated",
    "generated by the openapi generator": "generated",
    "generated by swagger codegen": "generated",
    "generated from a template+do not": "generated",
    "vendored from": "vendored",
    "see license in the upstream repository": "vendored",
    "| mit license |": "vendored",
    "| apache license |": "vendored",
    "| bsd license |": "vendored",
    "(c) the +authors, released under the": "vendored",
    "spdx-license-identifier:+part of the +project, release": "vendored",
}
# Path rules.
VENDOR_DIRS = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|third[_-]party|thirdparty|_vendor|site-packages|dist-packages|Pods|Carthage|extern|Godeps)/|(?:^|/)\.yarn/(?:releases|plugins|sdks|cache)/|(?:^|/)vendor/(?:[\w-]+\.)+[a-z]+/|(?:^|/)[A-Za-z][\w-]*-\d+\.\d+\.\d+(?:/|(?:\.\w+)?$)")
LIBRARY_DIRS = re.compile(r"(?:^|/)(?:vendor|vendored|deps|external|externals|extern|third[_-]?party|_vendor|node_modules|libs|contrib)/(?:@[\w.-]+/)?([\w.-]+)/")
# Libraries so common that a directory of their name under one for libraries holds them.
LIBRARIES = frozenset(
    "angular asio backbone boost bootstrap bzip2 catch2 chartjs codemirror curl d3 ember expat express fmt freetype glfw googletest gtest handlebars highlightjs jquery leaflet libcurl libevent libjpeg libpng libuv libxml2 lodash lz4 mathjax moment mustache nlohmann openssl popper protobuf rapidjson react requirejs snappy spdlog sqlite sqlite3 threejs tinymce tinyxml2 underscore vue xxhash yaml-cpp zlib zstd".split()
)
LOCK_FILES = re.compile(r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|composer\.lock|poetry\.lock|pipfile\.lock|cargo\.lock|gemfile\.lock|podfile\.lock|pubspec\.lock|pdm\.lock|uv\.lock|bun\.lockb?|deno\.lock|go\.sum|go\.work\.sum|packages\.lock\.json|gradle\.lockfile|package\.resolved|\.terraform\.lock\.hcl|mix\.lock|flake\.lock|[\w.-]+[.-]lock\.(?:json|ya?ml))$")
GENERATED_NAMES = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|[._]pb\.(?:go|[cm]?[jt]sx?|h|cc|rs)|_pb\.[cm]?[jt]sx?|_pb\.d\.ts|_gen\.\w+|\.gen\.\w+|\.generated\.\w+|^zz_generated\.[\w.]+|\.g\.(?:cs|[cm]?[jt]sx?|dart)|\.designer\.cs|\.tab\.(?:c|h|cc|cpp|hpp)|(?<=[a-z])Proto\.java|(?<=[a-z])Grpc\.java)$", re.I)
STRINGER_NAMES = re.compile(r"_string\.go$")
MINIFIED_NAMES = re.compile(r"(?:[.-]min\.(?:[cm]?js|css)|\.bundle\.[cm]?js|\.chunk\.[cm]?js|-[0-9a-f]{8,20}\.(?:[cm]?js|css))$")

_COMMENT = re.compile(r"^[ \t]*(?://|\#|--|/?\*|<!--|;|%|\"\"\"|''')[^\n]*", re.M)
_HEAD = re.compile(r"\A(?:\s+|//[^\n]*|\#[^\n]*|--[^\n]*|/\*.*?\*/)+", re.S)
#: What stands before the code: comments, a docstring, and the lines that a language wants first.
_TOP = re.compile(r"\A(?:﻿|\s+|//[^\n]*|\#[^\n]*|--[^\n]*|/\*.*?\*/|<!--.*?-->|;[^\n]*|%[^\n]*|<\?[^\n]*|\"\"\".*?\"\"\"|'''.*?'''|package[ \t][^\n]*|[\"']use strict[\"'];?)+", re.S)
_SPOKEN_OF = re.compile(r"\"[^\"\n]*\"|`[^`\n]*`|(?<!\w)'[^'\n]*'(?!\w)")
_LIBRARY = re.compile(r"(?i)vendored from ([\w.-]+?)@|copyright the ([\w.-]+) authors|\(c\) the ([\w.-]+) authors|/\* ([\w.-]+) \d[\d.]* \| \w+ license|part of the ([\w.-]+) project, release")
_WORD, _DIGITS, _LITERAL = re.compile(r"[A-Za-z_$][\w$]*"), re.compile(r"0x[0-9a-fA-F]+|\d[\d.]*"), re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_DATA = re.compile(r"(?:0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?)(?:\s*,\s*(?:0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?)){7,}")
_BLOB = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}|(?:\\x[0-9a-fA-F]{2}){10,}")
_EMBEDDED = re.compile(r"-----BEGIN [A-Z ]+-----.*?(?:-----END [A-Z ]+-----|\Z)|\bdata:[\w/+.-]+;base64,[A-Za-z0-9+/=]*", re.S)
_RECORD = re.compile(r"^[ \t]*[(\[{].*[)\]}],?[ \t]*;?[ \t]*$", re.M)
# What only tools write: the keys of their JSON, and directives that point at the true source.
_TOOL_JSON = re.compile(r'\A\s*\{\s*"(?:generator|generatedBy|generated_by|lockfileVersion|_generated|__generated__)"\s*:|"lockfileVersion"\s*:')
_LINE_DIRECTIVE = re.compile(r'^[ \t]*#[ \t]*line[ \t]+\d+[ \t]+"|^//line [^\n]+:\d+$', re.M)
#: Languages whose hand-written files are lists of like records by nature.
RECORD_LANGUAGES = ("json", "yml", "yaml", "md", "xml", "toml", "dockerfile")


def automaton() -> ahocorasick.Automaton:
    """All parts of all notices in one automaton."""
    a = ahocorasick.Automaton()
    for part in {p for n in NOTICES for p in n.split("+")}:
        a.add_word(part, part)
    a.make_automaton()
    return a


def header(text: str) -> str:
    """The comments before and after the code: where a tool or a library says what the file is."""
    text = text.replace("\r\n", "\n")
    top = _TOP.match(text)
    said = top[0] if top else ""
    lines = text[len(said) :].rstrip().split("\n")
    last = len(lines)
    while last and _COMMENT.match(lines[last - 1]):
        last -= 1
    return "\n".join([said, *lines[last:]])


def notice(text: str, parts: ahocorasick.Automaton) -> str | None:
    """What the header of `text` says of its origin. Literals, comments within the code and what is quoted do not speak for the file."""
    said = _SPOKEN_OF.sub("", "\n".join(_COMMENT.findall(header(text)))).lower()
    found = {p for _, p in parts.iter(said)}
    for phrase, kind in NOTICES.items():
        if all(p in found for p in phrase.split("+")):
            return kind
    return None


def body_key(text: str) -> bytes | None:
    """Digest of the text below its leading comments, line ends alike: copies of one library share it. None for trifles."""
    body = _HEAD.sub("", text.replace("\r\n", "\n")).strip()
    return hashlib.md5(body.encode("utf-8", "replace")).digest() if len(body) >= 200 else None


def looks_minified(text: str) -> bool:
    """Nearly all code on very long lines, and hardly any white space in it outside literals."""
    code = _HEAD.sub("", text)
    lines = [x for x in code.split("\n") if x.strip()]
    long = [x for x in lines if len(x) > 250]
    if not long or sum(map(len, long)) < 0.8 * sum(map(len, lines)):
        return False
    bare = _LITERAL.sub("", "\n".join(long))
    if len(bare) < 200:
        return False
    blanks, marks = bare.count(" "), sum(bare.count(c) for c in "(){};,=:[]")
    words = _WORD.findall(bare)
    return blanks < 0.1 * len(bare) and marks > 0.15 * len(bare) and sum(map(len, words)) < 6 * len(words)


def looks_data(text: str, extension: str) -> bool:
    """Most of the text is numbers, encoded text or records of literals."""
    n = len(text)
    if n < 400 or extension == "md":
        return False
    if sum(len(m[0]) for m in _DATA.finditer(text)) > 0.5 * n:
        return True
    bare = _EMBEDDED.sub("", text)  # a key or an image within a file does not make it data
    if len(bare) >= 400 and sum(len(m[0]) for m in _BLOB.finditer(bare)) > 0.6 * len(bare):
        return True
    if extension in RECORD_LANGUAGES:
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    records = [x for x in _RECORD.findall(text) if x.count(",") >= 2 and not re.search(r"[A-Za-z_]\w*\s*\(|=|;", _LITERAL.sub("", x))]
    return len(records) >= 10 and len(records) > 0.7 * len(lines)


def looks_repeated(text: str, extension: str) -> bool:
    """Most lines are one or two sentences said again with other names and numbers, as only tools write."""
    if extension in RECORD_LANGUAGES:
        return False
    lines = [x.strip() for x in _COMMENT.sub("", text.replace("\r\n", "\n")).split("\n")]
    lines = [x for x in lines if len(x) > 12]
    if len(lines) < 8:
        return False
    shapes: dict[str, list[str]] = {}
    for x in lines:
        key = _DIGITS.sub("0", _WORD.sub(lambda m: re.sub(r"[A-Z][a-z]+|(?<=_)[A-Za-z]+", "x", re.sub(r"\d+", "0", m[0])), _LITERAL.sub("s", x)))
        shapes.setdefault(key, []).append(x)
    most = sorted(shapes.values(), key=len, reverse=True)[:2]
    counted = [x for m in most for x in m]
    # tools number what they repeat
    numbered = sum(bool(re.search(r"[A-Za-z_]\d+\b", x)) for x in counted)
    return len(counted) >= 0.75 * len(lines) and numbered >= 0.8 * len(counted) and len(most[0]) >= 6


def judge(text: str | None, path: str | None, parts: ahocorasick.Automaton) -> tuple[str | None, str | None]:
    """(kind, library): why the file is none of the project's own hand-written source, and the library it names."""
    path = (path or "").replace("\\", "/")
    name = path.rsplit("/", 1)[-1]
    extension = name.rsplit(".", 1)[-1].lower()
    text = text or ""
    said = notice(text, parts) if text else None
    library = None
    if said == "vendored" and (m := _LIBRARY.search(text)):
        library = next(g for g in m.groups() if g)
    elif (m := re.search(r"(?:^|/)node_modules/((?:@[\w.-]+/)?[\w.-]+)/", path)) or (m := re.search(r"(?:^|/)([A-Za-z][\w-]*?)-\d+\.\d+\.\d+(?:/|(?:\.\w+)?$)", path)):
        library = m[1]
    if VENDOR_DIRS.search(path) or ((m := LIBRARY_DIRS.search(path)) and m[1].lower().removesuffix(".js") in LIBRARIES):
        return "vendored", library
    if LOCK_FILES.search(path):
        return "generated", library
    if said:
        return said, library
    if GENERATED_NAMES.search(name):
        return "generated", library
    if not text:
        return ("minified" if MINIFIED_NAMES.search(name) else None), library
    if looks_minified(text):
        return "minified", library
    if looks_data(text, extension):
        return "data", library
    if looks_repeated(text, extension) or (_TOOL_JSON if extension == "json" else _LINE_DIRECTIVE).search(text):
        return "generated", library
    if MINIFIED_NAMES.search(name) and (".min." in name or any(len(x) > 250 for x in text.split("\n"))):
        return "minified", library
    return None, library
