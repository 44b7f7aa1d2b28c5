"""Markdown line rules as column expressions. All take a string column; null in, null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First words of commands, and extensions of file references.
COMMANDS = ("cargo", "npm", "pnpm", "yarn", "git", "python", "pytest", "bash")
EXTENSIONS = ("rs", "ts", "tsx", "js", "jsx", "py", "md", "json", "toml")
# End of fixed values.


def heading_level(t: Column) -> Column:
    """1 to 6 for ``#`` marks followed by a space, else null."""
    return F.nullif(F.length(F.regexp_extract(t, r"^(#{1,6}) ", 1)), F.lit(0))


def heading_text(t: Column) -> Column:
    return F.when(heading_level(t).isNotNull(), F.trim(F.regexp_extract(t, r"^#{1,6} (.*)$", 1)))


def task_checked(t: Column) -> Column:
    """true or false for a task list item, null for any other line."""
    return F.when(t.rlike(r"^[-*] \[ \] "), False).when(t.rlike(r"^[-*] \[[xX]\] "), True)


def is_requirement(t: Column) -> Column:
    return t.rlike(r"^([-*] )?(MUST |SHOULD |MAY |Requirement:)")


def is_ordered_item(t: Column) -> Column:
    return t.rlike(r"^[0-9]+\. ")


def looks_like_claim(t: Column) -> Column:
    """Ends with a full stop and has four words or more."""
    return t.endswith(".") & (F.size(F.array_remove(F.split(t, r"\s+"), "")) >= 4)


def opening_fence(t: Column) -> Column:
    """struct(mark, width) of a fence of three or more; a fence of backticks has none after them. Else null."""
    run = F.regexp_extract(t, r"^(`{3,}|~{3,})", 1)
    ok = (run != "") & ~(t.startswith("`") & F.substring(t, F.length(run) + 1, F.length(t)).contains("`"))
    return F.when(ok, F.struct(F.substring(t, 1, 1).alias("mark"), F.length(run).alias("width")))


def is_closing_fence(t: Column, mark: Column, width: Column) -> Column:
    run = F.regexp_extract(t, r"^(`+|~+)\s*$", 1)
    return (run != "") & (F.substring(run, 1, 1) == mark) & (F.length(run) >= width)


def is_autolink(inside: Column) -> Column:
    """What may stand between angle brackets as a link: ``scheme:rest`` or ``local@domain``."""
    uri = inside.rlike(r"^[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*$")
    mail = inside.rlike(r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$")
    return uri | mail


def file_part(code: Column) -> Column:
    return F.split_part(code, F.lit("#"), F.lit(1))


def is_file_ref(code: Column) -> Column:
    p = file_part(code)
    shape = (p != "") & ~p.startswith("/") & ~p.contains("..") & ~p.contains("\\") & ~p.contains(" ")
    return shape & (p.contains("/") | F.substring_index(p, ".", -1).isin(*EXTENSIONS))


def is_identifier_path(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z0-9_$]+(\.[A-Za-z0-9_$]+)*$")


def is_command(code: Column, commands: tuple[str, ...] = COMMANDS) -> Column:
    return F.coalesce(F.get(F.array_remove(F.split(code, r"\s+"), ""), F.lit(0)).isin(*commands), F.lit(False))


def code_reference(code: Column) -> Column:
    """struct(target, symbol) of ``file#symbol`` or ``file``; null if it is neither."""
    at = F.instr(code, "#")
    symbol = F.substring(code, at + 1, F.length(code))
    whole = F.when(is_file_ref(code), F.struct(code.alias("target"), F.lit(None).cast("string").alias("symbol")))
    parts = F.when(is_file_ref(code) & is_identifier_path(symbol), F.struct(file_part(code).alias("target"), symbol.alias("symbol")))
    return F.when(at > 0, parts).otherwise(whole)


def inline_code_spans(line: Column) -> Column:
    """array of struct(code, col) between pairs of backticks, left to right; col is the 1-based byte column."""
    parts = F.split(line, "`")
    ends = F.transform(parts, lambda x: F.octet_length(x) + 1)
    spans = F.transform(parts, lambda x, i: F.struct(x.alias("code"), (F.aggregate(F.slice(ends, 1, i), F.lit(0), lambda a, b: a + b) + 1).alias("col")))
    return F.filter(spans, lambda x, i: (i % 2 == 1) & (i < F.size(parts) - 1))


def return_contract(line: Column, label: str = "Contract") -> Column:
    """struct(target, symbol, expected, col) of ``<label>: `file#symbol` returns `literal```; null if malformed.

    ``label`` introduces the contract (before the colon).
    """
    pattern = rf"{label}: `([^`]*)`\s*returns `([^`]*)`"
    subject, expected = F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
    ref = code_reference(subject)
    col = F.octet_length(F.split_part(line, F.lit(f"{label}: `"), F.lit(1))) + 1
    return F.when(line.rlike(pattern) & ref["symbol"].isNotNull(), F.struct(ref["target"].alias("target"), ref["symbol"].alias("symbol"), expected.alias("expected"), col.alias("col")))


def section_words(title: Column) -> Column:
    return F.transform(F.array_remove(F.split(title, "[^A-Za-z0-9]+"), ""), lambda w: F.lower(w))


def section_role(title: Column) -> Column:
    w = section_words(title)
    has = lambda *names: F.arrays_overlap(w, F.array(*map(F.lit, names)))
    record = has("architecture") & has("decision") & has("record", "records")
    return (
        F.when(has("requirement", "requirements"), "requirements").when(has("adr", "adrs") | record, "adr")
        .when(has("api") & has("contract", "contracts"), "api_contract").when(has("runbook", "runbooks"), "runbook").when(has("architecture"), "architecture")
    )


def sanitize_id(v: Column) -> Column:
    return F.regexp_replace(v, "[^A-Za-z0-9_-]", "_")


def id_fragment(v: Column) -> Column:
    return F.btrim(F.regexp_replace(v, "[^A-Za-z0-9]", "-"), F.lit("-"))


def is_escaped(before: Column) -> Column:
    """Whether an odd run of backslashes ends the text before a character."""
    return F.length(F.regexp_extract(before, r"(\\*)$", 1)) % 2 == 1


def identifier_tokens(text: Column) -> Column:
    """Identifiers of at most 128 bytes, in order."""
    found = F.split(text, r"[^\p{L}\p{N}_$]+")
    return F.filter(found, lambda x: (F.octet_length(x) <= 128) & x.rlike(r"^[\p{L}_$]"))


def mentions_identifier(line: Column, name: Column) -> Column:
    """Whether ``name`` stands in the line as a whole identifier."""
    padded = F.regexp_replace(line, "[^A-Za-z0-9_$]+", " ")
    return F.concat(F.lit(" "), padded, F.lit(" ")).contains(F.concat(F.lit(" "), name, F.lit(" ")))


def symbol_query(arg: Column) -> Column:
    """struct(name, file, line) of ``name:file:line``; file and line are null for a bare name."""
    full = arg.rlike(r"^.*:[^:]*:[0-9]+$")
    part = lambda i: F.regexp_extract(arg, r"^(.*):([^:]*):([0-9]+)$", i)
    return F.struct(F.when(full, part(1)).otherwise(arg).alias("name"), F.when(full, part(2)).alias("file"), F.when(full, part(3).try_cast("bigint")).alias("line"))
