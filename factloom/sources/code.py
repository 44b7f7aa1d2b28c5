"""Source files as events: what they declare, import, export, call and return. A documented subset of each language.

TypeScript and JavaScript: imports (also dynamic), exports, functions, classes with what they extend and implement,
interfaces, type aliases, top-level variables, calls, members that are called and literal returns. Rust: items, uses with
each name that they bind, and calls. What is beyond the subset is a ``gap`` event (an
unclosed string, comment or bracket), after which nothing of the file is taken as complete.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.codes import fnv1a
from factloom.plans.stages import spread, written

EVENTS = "seq int, kind string, name string, owner string, start bigint, stop bigint, detail string"
TS = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*[\s\S]*?\*/|\A\#![^\n]*)|(?P<string>"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*')|(?P<word>\#?[A-Za-z_$\u0080-\U0010ffff][\w$]*)|(?P<number>\.?\d[\w.]*)|(?P<bad>/\*|["'])|(?P<template>`)|(?P<slash>/)|(?P<sign>=>|\.\.\.|.)""", re.S
)
REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
#: Words after which a slash begins a regular expression, as it does after most signs.
BEFORE_REGEX = ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await")
RUST = re.compile(
    r"""(?P<space>\s+|//[^\n]*)|(?P<comment>/\*)|(?P<string>[bc]?r(?P<hash>\#*)"[\s\S]*?"(?P=hash)|[bc]?"(?:\\[\s\S]|[^"\\])*"|b?'(?:\\[^']*|\\'|[^'\\])')|(?P<word>r\#[A-Za-z_]\w*|[A-Za-z_\u0080-\U0010ffff]\w*|'[A-Za-z_]\w*)|(?P<number>\d(?:[\w]|\.(?=\d))*)|(?P<bad>")|(?P<sign>::|->|=>|.)""", re.S
)


def _template(text: str, at: int) -> int | None:
    """The end of a template that begins at ``at``, with those inside of its holes; None if it has none."""
    i, holes = at + 1, []
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if not holes or holes[-1] == 0:  # in the template's text
            if c == "`":
                if not holes:
                    return i + 1
                holes.pop()
            elif text.startswith("${", i):
                holes.append(1)
                i += 1
        elif c == "`":
            holes.append(0)
        elif c in "\"'":
            end = re.compile(r"(?:\\.|[^\n%s\\])*%s" % (c, c)).match(text, i + 1)
            i = end.end() - 1 if end else i
        elif c in "{}":
            holes[-1] += 1 if c == "{" else -1
            if holes[-1] == 0:
                holes.pop()
        i += 1
    return None


def _comment(text: str, at: int) -> int | None:
    """The end of a block comment of Rust, which may hold others."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if depth == 0:
            return m.end()
    return None


def _scan(text: str, pattern: re.Pattern) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, start, stop) of all tokens but spaces and comments."""
    at, last = 0, ("sign", "")
    while at < len(text):
        m = pattern.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "slash":
            ends_value = last[0] in ("number", "string") or last[0] == "word" and last[1] not in BEFORE_REGEX or last[1] in (")", "]", "}")
            regex = None if ends_value else REGEX.match(text, at)
            kind, end = ("string", regex.end()) if regex else ("sign", end)
        elif kind in ("template", "comment"):
            found = (_template if kind == "template" else _comment)(text, at)
            kind, end = ("bad", end) if found is None else ("string" if kind == "template" else "space", found)
        elif kind == "hash":
            kind = "string"
        if kind != "space":
            last = kind, text[at:end]
            yield kind, text[at:end], at, end
        at = end


CONSTANTS = ("true", "false", "null", "undefined")
NOT_CALLS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "match", "loop", "fn", "in", "as", "await", "super", "import", "constructor", "Some", "Ok", "Err", "None")
PAIRS = {")": "(", "]": "[", "}": "{"}


class Tokens:
    """A file's tokens without spaces and comments; ``match`` has the place of each bracket's partner."""

    def __init__(self, text: str, pattern: re.Pattern):
        self.text = text
        self.all = list(_scan(text, pattern))
        self.match: dict[int, int] = {}
        self.gap = next((t[2] for t in self.all if t[0] == "bad"), None)
        open_: list[int] = []
        for i, (kind, t, at, _) in enumerate(self.all):
            if kind == "sign" and t in "([{":
                open_.append(i)
            elif kind == "sign" and t in PAIRS:
                if not open_ or self.all[open_[-1]][1] != PAIRS[t]:
                    self.gap = at if self.gap is None else self.gap
                    break
                self.match[open_[-1]] = i
                self.match[i] = open_.pop()
        if open_ and self.gap is None:
            self.gap = self.all[open_[-1]][2]

    def get(self, i: int) -> str:
        return self.all[i][1] if 0 <= i < len(self.all) else ""

    def kind(self, i: int) -> str:
        return self.all[i][0] if 0 <= i < len(self.all) else ""

    def body(self, i: int, stops: str = ";") -> int | None:
        """The next ``{`` at this depth before a stop."""
        while i < len(self.all) and self.get(i) not in stops:
            if self.get(i) == "{" and self.kind(i) == "sign":
                return i if i in self.match else None
            i = self.match.get(i, i) + 1 if self.get(i) in ("(", "[") else i + 1
        return None


def _returns(t: Tokens, name: str, low: int, high: int) -> Iterator[tuple]:
    """The first literal that a body returns at its own depth."""
    i = low + 1
    while i < high:
        if t.get(i) == "{" and t.kind(i) == "sign":
            i = t.match.get(i, i)
        elif t.get(i) == "return" and "\n" not in t.text[t.all[i][3] : t.all[i + 1][2]]:
            minus = t.get(i + 1) == "-"
            j = i + 1 + minus
            literal = t.kind(j) == "number" or not minus and ((t.kind(j) == "string" and t.get(j)[0] != "`") or t.get(j) in CONSTANTS)
            if literal and (t.get(j + 1) in (";", "}") or j + 1 < len(t.all) and "\n" in t.text[t.all[j][3] : t.all[j + 1][2]]):
                yield "return_literal", name, name, t.all[i][2], t.all[j][3], "-" * minus + t.get(j)
                return
        i += 1


def _heritage(t: Tokens, name: str, low: int, high: int) -> Iterator[tuple]:
    """What a class or interface extends and implements: dotted names, without arguments of types."""
    kind, depth, i = None, 0, low
    while i < high:
        w = t.get(i)
        depth += (w == "<") - (w == ">")
        if depth == 0 and w in ("extends", "implements"):
            kind = w
        elif depth == 0 and kind and t.kind(i) == "word" and t.get(i - 1) != ".":
            j, path = i, w
            while t.get(j + 1) == "." and t.kind(j + 2) == "word":
                j += 2
                path += "." + t.get(j)
            yield kind, path, name, t.all[i][2], t.all[j][3], None
            i = j
        i = t.match.get(i, i) + 1 if w in ("(", "[", "{") else i + 1


#: What may stand before the brace of an object.
BEFORE_OBJECT = ("=", "(", "[", ",", ":", "return")


def _registries(t: Tokens) -> Iterator[tuple]:
    """Entries of object literals whose values load a module: the key, and ``loader:specifier`` (for a template its text)."""
    i = 0
    while i < len(t.all):
        if t.get(i) != "{" or t.kind(i) != "sign" or t.get(i - 1) not in BEFORE_OBJECT or i not in t.match:
            i += 1
            continue
        end, j = t.match[i], i + 1
        while j < end:
            key, k = None, j
            if t.get(j + 1) == ":" and t.kind(j) in ("word", "string", "number"):
                key = t.get(j)[1:-1] if t.kind(j) == "string" else t.get(j)
                k = j + 2
            # The value reaches to the next comma that no bracket holds.
            stop = k
            while stop < end and t.get(stop) != ",":
                stop = t.match.get(stop, stop) + 1 if t.kind(stop) == "sign" and t.get(stop) in ("(", "[", "{") else stop + 1
            for x in range(k, stop) if key is not None else ():
                if t.get(x) in ("import", "require") and t.get(x - 1) != "." and t.get(x + 1) == "(" and t.kind(x + 2) == "string":
                    template = t.get(x + 2)[0] == "`"
                    if not template or t.get(x) == "import":
                        yield "registry", key, None, t.all[j][2], t.all[j][3], ("template" if template else t.get(x)) + ":" + t.get(x + 2)[1:-1]
            j = stop + 1
        i = end + 1


def _after_types(t: Tokens, i: int) -> int:
    """The place after arguments of types, if some begin here."""
    depth = 0
    while t.get(i) == "<" or depth:
        depth += {"<": 1, ">": -1, "": -depth}.get(t.get(i), 0)
        i += 1
    return i


def _providers(t: Tokens) -> Iterator[tuple]:
    """Definitions ``const name = Layer.effect(token, ...)`` and what ``Layer.provide(...)`` or ``Effect.provide(...)`` composes."""
    for i, (_, w, start, stop) in enumerate(t.all):
        if w in ("const", "let", "var") and t.kind(i + 1) == "word" and [t.get(i + k) for k in (2, 3, 4)] == ["=", "Layer", "."] and t.get(i + 5) in ("effect", "succeed"):
            at = _after_types(t, i + 6)
            if t.get(at) == "(" and t.kind(at + 1) == "word":
                yield "provider", t.get(i + 1), None, start, stop, t.get(at + 1)
        elif w in ("Effect", "Layer") and t.get(i + 1) == "." and t.get(i + 2) == "provide":
            at = _after_types(t, i + 3)
            for x in range(at + 1, t.match.get(at, at)) if t.get(at) == "(" else ():
                if t.kind(x) == "word" and t.get(x) not in NOT_CALLS + CONSTANTS + BEFORE_REGEX:
                    yield "composition", t.get(x), None, start, stop, None


def typescript(text: str) -> Iterator[tuple]:
    """(kind, name, owner, start, stop, detail) by code point."""
    t = Tokens(text, TS)
    if t.gap is not None:
        yield "gap", None, None, t.gap, t.gap, "unclosed"
    yield from _registries(t)
    yield from _providers(t)
    owners: list[tuple[int, str]] = []
    for i, (kind, w, start, stop) in enumerate(t.all):
        while owners and i > owners[-1][0]:
            owners.pop()
        owner = ".".join(o for _, o in owners) or None
        before, after = t.get(i - 1), t.get(i + 1)
        if kind != "word" or before == ".":
            if kind == "word" and after == "(":
                yield "call", w, owner, start, stop, "member"
                if t.kind(i - 2) == "word" and t.get(i - 3) not in (".", "?"):
                    yield "member_call", w, owner, start, stop, t.get(i - 2)
            continue
        exported = before in ("export", "default") or t.get(i - 2) == "export"
        if w == "import" and not owners and before != ".":
            if after == "(" and t.kind(i + 2) == "string":
                yield "dynamic_import", t.get(i + 2)[1:-1], owner, start, t.all[i + 2][3], "template" if t.get(i + 2)[0] == "`" else None
            elif after != "(":
                j = i + 1
                while j < len(t.all) and t.kind(j) != "string" and t.get(j) != ";":
                    j += 1
                if t.kind(j) == "string":
                    label = text[stop : t.all[j][2]].strip().removesuffix("from").strip()
                    yield "import", t.get(j)[1:-1], None, start, t.all[j][3], " ".join(label.removeprefix("type ").split())
        elif w == "export" and after in ("{", "*"):
            j = t.match.get(i + 1, i + 1) if after == "{" else i + 3 if t.get(i + 2) == "as" else i + 1
            k = next((x for x in range(j + 1, min(j + 5, len(t.all))) if t.kind(x) == "string"), None) if t.get(j + 1) == "from" else None
            yield "export", t.get(k)[1:-1] if k else None, None, start, t.all[k or j][3], " ".join(text[t.all[i + 1][2] : t.all[j][3]].split())
        elif w in ("function", "class", "interface", "enum", "namespace") or w == "type" and t.get(i + 2) in ("=", "<"):
            at = i + 2 if w == "function" and after == "*" else i + 1
            if t.kind(at) != "word":
                continue
            if t.get(at) in ("extends", "implements"):
                continue
            name, body = t.get(at), t.body(at + 1, ";=" if w == "type" else ";")
            end = t.match[body] if body is not None else at
            yield {"type": "type_alias"}.get(w, w), name, owner, start, t.all[end][3], "export" if exported else None
            if before == "default" or before == "async" and t.get(i - 2) == "default":
                yield "export_default", name, owner, start, stop, None
            if w in ("class", "interface") and body is not None:
                yield from _heritage(t, name, at + 1, body)
            if w == "function" and body is not None:
                yield from _returns(t, name, body, end)
            if body is not None:
                owners.append((end, name))
        elif w == "default" and before == "export" and t.kind(i + 1) == "word" and t.get(i + 2) in (";", "") or w == "default" and before == "export" and t.kind(i + 1) == "word" and "\n" in text[t.all[i + 1][3] : t.all[i + 2][2]]:
            yield "export_default", after, None, start, t.all[i + 1][3], None
        elif w in ("const", "let", "var") and not owners and t.kind(i + 1) == "word":
            yield "variable", after, None, start, t.all[i + 1][3], "export" if exported else None
        elif after == "(" and w not in NOT_CALLS and before != "function" and not (before == "*" and t.get(i - 2) == "function"):
            body = t.match.get(i + 1)
            k = t.body(body + 1, ";,)=") if body is not None else None
            if owners and k is not None and t.get(body + 1) in ("{", ":") and before in ("{", "}", ";", "async", "static", "public", "private", "protected", "readonly", "get", "set", ""):
                yield "method", w, owner, start, t.all[t.match[k]][3], None
                yield from _returns(t, w, k, t.match[k])
                owners.append((t.match[k], w))
            else:
                yield "call", w, owner, start, stop, "new" if before == "new" else None


def _leaves(tree: str, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(path, local name) of each name that a use binds; ``*`` for all of a module, nothing for ``_``."""
    if "{" not in tree:
        path, _, local = tree.partition(" as ")
        path = prefix + path.strip().removeprefix("::")
        path = path.removesuffix("::self")
        local = local.strip() or path.rsplit("::", 1)[-1]
        if path and local != "_":
            yield path, local
        return
    head, _, rest = tree.partition("{")
    depth, start = 0, 0
    body = rest[: rest.rindex("}")] if "}" in rest else rest
    for i, c in enumerate(body + ","):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            if body[start:i].strip():
                yield from _leaves(body[start:i].strip(), prefix + head.strip().removeprefix("::"))
            start = i + 1


def rust(text: str) -> Iterator[tuple]:
    t = Tokens(text, RUST)
    if t.gap is not None:
        yield "gap", None, None, t.gap, t.gap, "unclosed"
    owners: list[tuple[int, str]] = []
    for i, (kind, w, start, stop) in enumerate(t.all):
        while owners and i > owners[-1][0]:
            owners.pop()
        owner = "::".join(o for _, o in owners) or None
        if kind != "word":
            continue
        public = "pub" if t.get(i - 1) == "pub" or t.get(i - 1) == ")" and t.get(t.match.get(i - 1, 0) - 1) == "pub" else None
        if w in ("fn", "struct", "enum", "trait", "mod", "union", "type", "const", "static", "macro_rules") and (t.kind(i + 1) == "word" or t.get(i + 1) == "!"):
            at = i + 2 if w == "macro_rules" else i + 1
            if t.kind(at) != "word" or w == "const" and t.get(at) == "fn":
                continue
            body = t.body(at + 1, ";=" if w in ("const", "static", "type") else ";")
            end = t.match[body] if body is not None else at
            yield {"fn": "function", "mod": "module", "type": "type_alias", "macro_rules": "macro"}.get(w, w), t.get(at), owner, start, t.all[end][3], public
            if body is not None:
                owners.append((end, t.get(at)))
        elif w == "impl" and t.get(i - 1) not in ("->", ":", "<", ",", "(", "&", "="):
            body = t.body(i + 1)
            if body is not None:
                head = " ".join(text[stop : t.all[body][2]].split())
                trait, _, of = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", head)).partition(" for ")
                name = (of or trait).split(" where ")[0].strip()
                yield "impl", name, owner, start, t.all[t.match[body]][3], trait.strip() if of else None
                owners.append((t.match[body], name))
        elif w == "use":
            j = i + 1
            while j < len(t.all) and t.get(j) != ";":
                j += 1
            tree = "".join(x[1] if x[1] != "as" else " as " for x in t.all[i + 1 : j])
            yield "use", tree, owner, start, t.all[min(j, len(t.all) - 1)][3], public
            for path, local in _leaves(tree):
                yield "binding", local, owner, start, stop, path
        elif t.get(i + 1) == "(" and w not in NOT_CALLS and t.get(i - 1) not in ("fn", "macro_rules"):
            j, path = i, w
            while t.get(j - 1) == "::" and t.kind(j - 2) == "word":
                j -= 2
                path = t.get(j) + "::" + path
            yield "call", path, owner, start, stop, "member" if t.get(j - 1) == "." else None


PARSERS = {"typescript": typescript, "rust": rust}
PATTERNS = {"typescript": TS, "rust": RUST}


def normalized(text: str | None, language: str | None) -> str | None:
    """A declaration's surface without comments and with one space for each gap between its tokens.

    Where tokens alone don't tell (``<`` and ``/`` of TypeScript, what is unclosed, other languages) it stays as it is.
    """
    if text is None or language not in PATTERNS:
        return text
    out, last = [], 0
    for kind, token, start, stop in _scan(text, PATTERNS[language]):
        if kind == "bad" or language == "typescript" and (token in ("<", "/") or kind == "string" and token[0] == "/"):
            return text
        out += [" "] * (bool(out) and last < start) + [token]
        last = stop
    return "".join(out)


def normalized_signature(surface: Column, language: Column) -> Column:
    return F.pandas_udf(lambda s, k: pd.Series([normalized(a, b) for a, b in zip(s, k, strict=True)], dtype=object), "string")(surface, language)


def signature_hash(surface: Column, language: Column) -> Column:
    """FNV-1a (64 bits) of the normalised surface, as 16 hex digits; of none, zeros."""
    return F.coalesce(fnv1a(normalized_signature(surface, language)), F.lit("0" * 16))


def events(files: DataFrame, key: str = "path", source: str = "source") -> DataFrame:
    """(key, seq, kind, name, owner, start, stop, detail) of ``files(key, source, language)``; other languages give a gap.

    Offsets are UTF-8 bytes. A file is scanned whole, in one task, and files are dealt over all cores first; null sources
    have no events. Each use of the events scans all files again: who uses them more than once writes them.
    """
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for b in batches:
            keys: list = []
            rows: list[tuple] = []
            for i, (k, text, language) in enumerate(zip(*[c.to_pylist() for c in b.columns], strict=True)):
                if text is not None:
                    found = [(n, *e) for n, e in enumerate(PARSERS[language](text) if language in PARSERS else [("gap", None, None, 0, 0, "language")])]
                    if not text.isascii():
                        size, last, of = 0, 0, {}
                        for p in sorted({p for e in found for p in (e[4], e[5])}):
                            size, last = size + len(text[last:p].encode()), p
                            of[p] = size
                        found = [(*e[:4], of[e[4]], of[e[5]], e[6]) for e in found]
                    keys += [k] * len(found)
                    rows += found
                if len(rows) > 20_000 or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), *[pa.array([e[i] for e in rows], t) for i, t in enumerate(types)]], [key, "seq", "kind", "name", "owner", "start", "stop", "detail"])
                    keys, rows = [], []

    return spread(files.select(key, F.col(source).cast("string"), "language")).mapInArrow(run, f"{key} {kind}, {EVENTS}")


DECLARED = ("function", "class", "interface", "enum", "namespace", "type_alias", "variable", "method", "struct", "trait", "module", "union", "const", "static", "macro", "impl")


def declaration_counts(found: DataFrame, key: str = "path") -> DataFrame:
    """(key, declarations): how many events of a file declare something; a file of gaps alone has 0."""
    return found.groupBy(key).agg(F.count_if(F.col("kind").isin(*DECLARED)).alias("declarations"))


def literal_returns(found: DataFrame, key: str = "path") -> DataFrame:
    """(key, symbol, literal, n) for contract checks: functions with their literal; a name that is declared again counts in n.

    Files with a gap before the function's end give no literal: what is there may be read wrongly.
    """
    found = written(found.where(F.col("kind").isin("function", "method", "return_literal", "gap")).select(key, "kind", "name", "start", "stop", "detail"))
    f = found.where(F.col("kind").isin("function", "method")).select(key, F.col("name").alias("symbol"), "start", "stop")
    r = found.where("kind = 'return_literal'").select(key, F.col("name").alias("symbol"), F.col("start").alias("at"), F.col("detail").alias("literal"))
    g = found.where("kind = 'gap'").groupBy(key).agg(F.min("start").alias("gap"))
    d = f.join(r, [key, "symbol"], "left").where("at is null or (at >= start and at < stop)").join(g, key, "left")
    n = d.withColumn("literal", F.when(F.col("gap").isNull() | (F.col("gap") >= F.col("stop")), F.col("literal")))
    return n.groupBy(key, "symbol").agg(F.min("literal").alias("literal"), F.count_distinct("start").alias("n"))


def ordered_events(found: DataFrame, key: str = "path") -> DataFrame:
    """Events with ``place``, their number among those of one kind in a file."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(key, "kind").orderBy("seq")))


def directives(files: DataFrame, key: str = "path", source: str = "source") -> DataFrame:
    """(key, place, attribute, target): ``<reference path|types="..." />`` in comments of three slashes before a file's first token."""
    lead = F.regexp_extract(source, r"^\uFEFF?(?:#![^\r\n]*)?((?:\s|//[^\r\n]*|/\*(?s:.*?)(?:\*/|\z))*)", 1)
    comments = F.regexp_extract_all(lead, F.lit(r"(/\*(?s:.*?)(?:\*/|\z)|//[^\r\n]*)"), F.lit(1))
    shape = r"^///\s*<reference\s+(path|types)\s*=\s*([\"'])(.*?)\2\s*/>"
    told = F.filter(comments, lambda c: c.rlike(shape))
    d = files.select(key, F.posexplode(told).alias("place", "c"))
    return d.select(key, "place", F.regexp_extract("c", shape, 1).alias("attribute"), F.regexp_extract("c", shape, 3).alias("target"))
