"""JSON as models write it: fenced, quoted, cut off. Repaired where Spark's own parser gives up."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json5?|javascript|js)?\s*\n?(.*?)(?:```|\Z)", re.S | re.I)


def _scan(text: str) -> tuple[list[str], bool, int]:
    """Open brackets, whether a string is open, and where the first value ends (-1 if it does not)."""
    stack, quoted, i = [], False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            if not stack:
                return stack, False, i + 1
        i += 1
    return stack, quoted, -1


def _tidy(text: str) -> str:
    """Escapes control marks within strings and drops commas before a closing bracket outside them."""
    out, quoted, i = [], False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\" and i + 1 < len(text):
                out.append(text[i : i + 2])
                i += 2
                continue
            if c == '"':
                quoted = False
            out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, "" if ord(c) < 32 else c))
        elif c == "," and re.match(r"\s*[}\]]|\s*\Z", text[i + 1 :]):
            pass
        else:
            quoted = c == '"'
            out.append(c)
        i += 1
    return "".join(out)


def repair_json(text: str | None) -> str | None:
    """The first JSON object or array in a text as valid JSON, or None.

    Fences and talk around it go; single quotes, bare keys, commas at the end, control
    marks in strings and missing closing brackets are put right.
    """
    if not text:
        return None
    if m := _FENCE.search(text):
        text = m[1]
    start = min((p for p in (text.find("{"), text.find("[")) if p >= 0), default=-1)
    if start < 0:
        return None
    body = text[start:]
    for attempt in (lambda t: t, _tidy, lambda t: _tidy(_double(t))):
        t = attempt(body)
        stack, quoted, end = _scan(t)
        t = t[:end] if end > 0 else _tidy(t + ('"' if quoted else "")) + "".join(reversed(stack))
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            continue
    return None


def _double(text: str) -> str:
    """Single-quoted strings and bare keys in double quotes."""
    t = re.sub(r"(?<=[{\[,:\s])'((?:[^'\\]|\\.)*)'(?=\s*[:,}\]])", lambda m: json.dumps(m[1].replace("\\'", "'"), ensure_ascii=False), text)
    return re.sub(r"(?<=[{,])(\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', t)


def all_json(text: str | None) -> list[str]:
    """Every complete JSON object or array in a text."""
    out, rest = [], text or ""
    while rest:
        start = min((p for p in (rest.find("{"), rest.find("[")) if p >= 0), default=-1)
        if start < 0:
            break
        rest = rest[start:]
        end = _scan(rest)[2]
        if end < 0:
            break
        if (fixed := repair_json(rest[:end])) is not None:
            out.append(fixed)
        rest = rest[end:]
    return out


@F.pandas_udf(StringType())
def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: repair_json(t) if isinstance(t, str) else None)


def repaired(text: Column | str) -> Column:
    """Valid JSON as it is, by Spark's parser; only what that rejects goes to Python."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(_repair(F.when(F.try_parse_json(c).isNull(), c)))
