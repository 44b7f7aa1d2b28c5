"""JSON texts: canonical form and hashes, comments and trailing commas, commas at the top level. Arrow batches, no rows one by one from the JVM."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE = 2**53 - 1
ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
STRING = r'"(?:\\.|[^"\\])*"'


def _text(s: str) -> str:
    return '"' + "".join(ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in s) + '"'


def _write(v: object) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{_text(k)}:{_write(v[k])}" for k in sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_write, v)) + "]"
    if isinstance(v, str):
        return _text(v)
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, int) and abs(v) <= SAFE:
        return str(v)
    raise ValueError("number out of range")


def canonical(text: str | None) -> str | None:
    """Keys in UTF-16 order, shortest escapes, whole numbers up to 2^53 - 1 only; null if it isn't such JSON."""
    try:
        return None if text is None else _write(json.loads(text))
    except (ValueError, RecursionError):
        return None


def canonical_json(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(canonical, na_action="ignore"), "string")(c)


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:canonical-json-v1:"), F.sha2(canonical_json(c), 256))


def _semantic(text: str | None) -> str | None:
    try:
        return None if text is None else hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, allow_nan=False, separators=(",", ":")).encode()).hexdigest()
    except ValueError:
        return None


def semantic_hash(c: Column) -> Column:
    """SHA-256 of a JSON text with sorted keys, in ASCII, without white space."""
    return F.pandas_udf(lambda s: s.map(_semantic, na_action="ignore"), "string")(c)


def _state(text: str | None) -> str | None:
    """The semantic hash of a packet's goal, question, evidence and lookups, those in any order."""
    try:
        p = json.loads(text) if text is not None else None
        lookups = sorted(({k: x[k] for k in ("tool", "target", "reason")} for x in p["lookups"]), key=lambda x: json.dumps(x, sort_keys=True, separators=(",", ":")))
        return _semantic(json.dumps({k: p[k] for k in ("goal", "question", "evidence")} | {"lookups": lookups}))
    except (ValueError, KeyError, TypeError):
        return None


def state_hash(c: Column) -> Column:
    """SHA-256 of what a packet means: ids and the order of its lookups don't matter. Null for no such packet."""
    return F.pandas_udf(lambda s: s.map(_state, na_action="ignore"), "string")(c)


def stripped(text: str) -> str:
    """Without comments outside strings, then without commas before a closing bracket."""
    plain = re.sub(STRING + r"|//[^\n]*|/\*.*?(?:\*/|\Z)", lambda m: m[0] if m[0][0] == '"' else "", text, flags=re.S)
    return re.sub(STRING + r"|,(?=\s*[\]}])", lambda m: m[0] if m[0][0] == '"' else "", plain, flags=re.S)


def strip_jsonc(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(stripped, na_action="ignore"), "string")(c)


def top_level(text: str) -> list[str]:
    """The parts between commas outside brackets and quotes, trimmed; an empty last part is none."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?|[(\[{]|[)\]}]|,", text, re.S):
        if m[0] in "([{":
            depth += 1
        elif m[0] in ")]}":
            depth -= 1
        elif m[0] == "," and depth == 0:
            out.append(text[start : m.start()].strip())
            start = m.end()
    rest = text[start:].strip()
    return out + [rest] * bool(rest)


def split_top_level(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(top_level, na_action="ignore")

    return F.pandas_udf(run, "array<string>")(c)
