"""Markdown documents: which lines are text, the facts on them, and the claims of their sections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as tx

STATES = "line_no int, start bigint, text string, state string"
FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
#: An escaped character, a whole code span, or a run of backticks that closes nothing.
HIDDEN = re.compile(r"\\.|(`+)(?!`)(?:.*?[^`])\1(?!`)|`+")
SHOWN = re.compile(HIDDEN.pattern + "|<")
INDENT = re.compile(r"\s*")
TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9-]*)(?=[\s>/]|$)")
RAW = re.compile(r"</(?:pre|script|style|textarea)>", re.I)
AUTOLINK = re.compile(
    r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>"
)
BLANK = "a blank line"  # ends the block; other ends are texts or RAW


def html_opens(line: str, offset: int) -> tuple[int, str | re.Pattern] | None:
    """Where raw HTML starts at or after ``offset``, and what ends it. Looks no further than there: a line may hold many tags."""
    indent = INDENT.match(line).end()
    for m in SHOWN.finditer(line, offset):
        if m[0] != "<":
            continue
        at = m.start()
        for opener, end in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"), ("<!", ">")):
            if line.startswith(opener, at):
                return at, end
        if AUTOLINK.match(line, at):
            continue
        first = at <= indent
        if tag := TAG.match(line, at):
            if first and line[at + 1] != "/" and tag[1].lower() in ("pre", "script", "style", "textarea"):
                return at, RAW
            return at, BLANK if first else ">"
        if first:
            return at, ">"
    return None


def closes(line: str, at: int, end: str | re.Pattern) -> int | None:
    """The place behind the end of HTML that is open at ``at``, if it is on the line."""
    if end is BLANK:
        return None
    if isinstance(end, re.Pattern):
        return m.end() if (m := end.search(line, at)) else None
    found = line.find(end, at)
    return None if found < 0 else found + len(end)


def states(source: str) -> Iterator[tuple[int, int, str, str]]:
    """(line_no, start, text, state) of each line; the state is text, fence or html. HTML hides fences and fences hide HTML."""
    at, fence, html = 0, "", None
    lines = source.split("\n")
    if lines[-1] == "":
        lines.pop()
    for n, raw in enumerate(lines, 1):
        line, start = raw.removesuffix("\r"), at
        at += len(raw.encode()) + 1
        bare, scan = line.strip(), 0
        if html is BLANK:
            html = None if not bare else html
            yield n, start, line, "html" if bare else "text"
            continue
        inside = html is not None
        if inside:
            scan = closes(line, 0, html)
            if scan is None:
                yield n, start, line, "html"
                continue
            html = None
        elif fence:
            run = re.match(re.escape(fence[0]) + "*", line.lstrip())[0]
            if len(run) >= len(fence) and bare == run:
                fence = ""
            yield n, start, line, "fence"
            continue
        elif m := FENCE.match(line.lstrip()):
            fence = m[1] or m[2]
            yield n, start, line, "fence"
            continue
        while opened := html_opens(line, scan):
            inside, html = True, opened[1]
            after = closes(line, *opened)
            if after is None:
                break
            scan, html = after, None
        yield n, start, line, "html" if inside else "text"


def line_states(docs: DataFrame, key: str = "file", source: str = "source") -> DataFrame:
    """(key, line_no, start, text, state) of all documents. The state crosses lines, so a document is scanned in order.

    The scan is the only part in Python: documents stay in their partitions, in small Arrow batches. Null sources have
    no lines.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int64(), pa.string(), pa.string())
        for b in batches:
            keys: list = []
            rows: list[tuple] = []
            for i in range(b.num_rows):
                found = list(states(b.column(1)[i].as_py() or ""))
                keys += [b.column(0)[i].as_py()] * len(found)
                rows += found
                if len(rows) > 20_000 or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), *[pa.array([x[k] for x in rows], t) for k, t in enumerate(types)]], [key, "line_no", "start", "text", "state"])
                    keys, rows = [], []

    return docs.select(key, F.col(source).cast("string")).mapInArrow(run, f"{key} {kind}, {STATES}")


def facts(lines: DataFrame, key: str = "file", label: str = "Contract") -> DataFrame:
    """(key, kind, text, line_no, col, level, checked, target, symbol, expected): facts of the lines that are text."""
    t, none = F.ltrim("text"), F.lit(None)
    col = F.octet_length("text") - F.octet_length(t) + 1

    def fact(kind: str, text: Column, at: Column, level: Column = none, checked: Column = none, target: Column = none, symbol: Column = none, expected: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), at.cast("int").alias("col"), level.cast("int").alias("level"), checked.cast("boolean").alias("checked"), target.cast("string").alias("target"), symbol.cast("string").alias("symbol"), expected.cast("string").alias("expected"))

    contract = tx.return_contract(F.col("text"), label)
    own = F.array(
        F.when(tx.heading_level(t).isNotNull(), fact("heading", tx.heading_text(t), col, level=tx.heading_level(t))),
        F.when(tx.task_checked(t).isNotNull(), fact("task", F.trim(F.substring(t, 7, 1 << 30)), col, checked=tx.task_checked(t))),
        F.when(contract.isNotNull(), fact("return_contract", F.concat(contract["target"], F.lit("#"), contract["symbol"]), contract["col"], target=contract["target"], symbol=contract["symbol"], expected=contract["expected"])),
    )

    def of_span(x: Column) -> Column:
        code = x["code"]
        symbol = F.substring(code, F.instr(code, "#") + 1, 1 << 30)
        return F.array(
            F.when(tx.is_command(code), fact("command", code, x["col"])), F.when((F.instr(code, "#") > 0) & tx.is_file_ref(code) & tx.is_identifier_path(symbol), fact("symbol_ref", code, x["col"], target=tx.file_part(code), symbol=symbol)),
            F.when(tx.is_file_ref(code), fact("file_ref", code, x["col"], target=tx.file_part(code))),
        )

    spans = F.flatten(F.transform(tx.inline_code_spans(F.col("text")), of_span))
    d = lines.where("state = 'text'").select(key, "line_no", F.explode(F.array_compact(F.concat(own, spans))).alias("f"))
    return d.select(key, "f.kind", "f.text", "line_no", *[f"f.{c}" for c in ("col", "level", "checked", "target", "symbol", "expected")])


def diagnostics(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, line_no, col): lines of raw HTML, from which nothing is inferred."""
    return lines.where("state = 'html'").select(key, "line_no", (F.octet_length("text") - F.octet_length(F.ltrim("text")) + 1).alias("col"))


def snippets(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, line_no, language, title): fenced blocks with some content: the opening line, its language, the first line that isn't blank.

    A block starts where the line before isn't fenced or closes one; fences inside alternate between opening and closing.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    t = F.ltrim("text")
    d = lines.where("state = 'fence'").withColumn("mark", F.regexp_extract(t, r"^(`{3,}|~{3,})", 1))
    d = d.withColumn("gap", (F.col("line_no") - F.lag("line_no", 1, -1).over(w) > 1).cast("int")).withColumn("run", F.sum("gap").over(w))
    listed = d.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("line_no", "mark", "text"))).alias("all"))
    zero = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<struct<line_no:int,language:string,title:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        tail = F.trim(F.substring(F.ltrim(x["text"]), F.length(x["mark"]) + 1, 1 << 30))
        begin = F.struct(x["line_no"].alias("line_no"), tail.alias("language"), F.lit(None).cast("string").alias("title"))
        same = (F.substring(x["mark"], 1, 1) == F.substring(a["open"], 1, 1)) & (F.length(x["mark"]) >= F.length(a["open"])) & (tail == "")
        last = F.element_at(a["out"], -1)
        titled = F.struct(last["line_no"].alias("line_no"), last["language"].alias("language"), F.coalesce(last["title"], F.nullif(F.trim(x["text"]), F.lit(""))).alias("title"))
        state = lambda o, out: F.struct(o.alias("open"), out.alias("out"))
        return (
            F.when(a["open"].isNull(), state(x["mark"], F.concat(a["out"], F.array(begin)))).when(same, state(F.lit(None).cast("string"), a["out"]))
            .otherwise(state(a["open"], F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(titled))))
        )

    out = listed.select(key, F.explode(F.aggregate("all", zero, step)["out"]).alias("s")).select(key, "s.*")
    return out.where("title is not null")


def roles(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, line_no, level, title, role): headings, each with its own role or that of the nearest heading around it.

    Folded over a document's headings with a stack of those that are open.
    """
    t = F.ltrim("text")
    h = lines.where("state = 'text'").withColumn("level", tx.heading_level(t)).where("level is not null").select(key, "line_no", "level", tx.heading_text(t).alias("title")).withColumn("own", tx.section_role(F.col("title")))
    each = h.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "level", "title", "own"))).alias("all"))
    zero = F.struct(F.array().cast("array<struct<level:int,role:string>>").alias("stack"), F.array().cast("array<string>").alias("roles"))

    def step(a: Column, x: Column) -> Column:
        above = F.filter(a["stack"], lambda s: s["level"] < x["level"])
        role = F.coalesce(x["own"], F.when(F.size(above) > 0, F.element_at(above, -1)["role"]))
        return F.struct(F.concat(above, F.array(F.struct(x["level"].alias("level"), role.alias("role")))).alias("stack"), F.concat(a["roles"], F.array(role)).alias("roles"))

    d = each.select(key, F.explode(F.arrays_zip("all", F.aggregate("all", zero, step)["roles"].alias("roles"))).alias("z"))
    return d.select(key, "z.all.line_no", "z.all.level", "z.all.title", F.col("z.roles").alias("role"))


def claims(lines: DataFrame, key: str = "file", label: str = "Contract") -> DataFrame:
    """(key, line_no, kind, title, section_line): what each line of text claims, by the role of its section.

    Kinds are requirement, adr_decision, api_contract, runbook_step, architecture_claim and return_contract, or
    ambiguous_claim (an architecture sentence without a reference) and unclassified (prose that no rule fits).
    Headings and blank lines are none.
    """
    heads = roles(lines, key)
    joined = lines.where("state = 'text'").join(heads.select(key, "line_no", "role", F.lit(True).alias("is_head")), [key, "line_no"], "left")
    last = F.last(F.when(F.col("is_head"), F.struct("line_no", "role")), ignorenulls=True).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    t, role = F.trim("text"), F.col("s.role")
    spans = tx.inline_code_spans(F.col("text"))
    cites = F.exists(spans, lambda x: tx.code_reference(x["code"]).isNotNull())
    kind = (
        F.when((role == "requirements") & tx.is_requirement(t), "requirement").when((role == "adr") & t.startswith("Decision:"), "adr_decision").when((role == "api_contract") & (F.size(spans) > 0), "api_contract")
        .when((role == "runbook") & tx.is_ordered_item(t), "runbook_step").when((role == "architecture") & cites, "architecture_claim").when((role == "architecture") & tx.looks_like_claim(t), "ambiguous_claim")
        .when(tx.return_contract(F.col("text"), label).isNotNull(), "return_contract").otherwise("unclassified")
    )
    title = F.when(F.col("kind") == "adr_decision", F.trim(F.substring(t, 10, 1 << 30))).otherwise(t)
    d = joined.withColumn("s", last).where(F.col("is_head").isNull() & (t != ""))
    return d.withColumn("kind", kind).select(key, "line_no", "kind", title.alias("title"), F.col("s.line_no").alias("section_line"))


def anchors(heads: DataFrame, key: str = "file") -> DataFrame:
    """(key, line_no, anchor): heading slugs; repeats get ``-1``, ``-2`` and so on in order."""
    slug = F.replace(F.regexp_replace(F.lower(F.trim("title")), r"[^\w\s-]", ""), F.lit(" "), F.lit("-"))
    n = F.row_number().over(Window.partitionBy(key, "slug").orderBy("line_no")) - 1
    return heads.withColumn("slug", slug).withColumn("n", n).select(key, "line_no", F.when(F.col("n") == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("n").cast("string"))).alias("anchor"))


def broken_links(links: DataFrame, files: DataFrame, anchor_table: DataFrame) -> DataFrame:
    """(file, target, problem) of ``links(file, target)``: relative targets whose file or anchor isn't there."""
    from factloom.functions.paths import normalize

    t = links.where(~F.col("target").rlike("^[a-z][a-z0-9+.-]*:")).withColumn("fragment", F.nullif(F.split_part("target", F.lit("#"), F.lit(2)), F.lit("")))
    place = F.split_part("target", F.lit("#"), F.lit(1))
    parent = F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).otherwise(".")
    t = t.withColumn("to", F.when(place == "", normalize(F.col("file"))).otherwise(normalize(F.concat(parent, F.lit("/"), place))))
    f = files.select(normalize(F.col("file")).alias("to"), F.lit(True).alias("there")).distinct()
    a = anchor_table.select(normalize(F.col("file")).alias("to"), F.col("anchor").alias("fragment"), F.lit(True).alias("anchored")).distinct()
    d = t.join(f, "to", "left").join(a, ["to", "fragment"], "left")
    problem = F.when(F.col("there").isNull(), "no_file").when(F.col("fragment").isNotNull() & F.col("anchored").isNull(), "no_anchor")
    return d.select("file", "target", problem.alias("problem")).where("problem is not null")
