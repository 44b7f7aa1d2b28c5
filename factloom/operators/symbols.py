"""Symbols: what documents and sources say about a name, where, and through which dynamic ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.plans.stages import written

# Names that the language or the host gives, and words that the small tokenizer knows.
KEYWORDS = ("as", "const", "export", "from", "function", "import", "let", "return", "type")
LANGUAGE_VALUES = """true false null this super globalThis arguments undefined NaN Infinity Error EvalError RangeError ReferenceError SyntaxError TypeError URIError AggregateError Array ArrayBuffer BigInt
BigInt64Array BigUint64Array Boolean DataView Date Float32Array Float64Array Function Int8Array Int16Array Int32Array Map Number Object Promise RegExp Set String Symbol Uint8Array Uint8ClampedArray
Uint16Array Uint32Array WeakMap WeakSet FinalizationRegistry WeakRef Proxy Math JSON Reflect Intl parseInt parseFloat isNaN isFinite encodeURI encodeURIComponent decodeURI decodeURIComponent console
jest vi describe xdescribe fdescribe it xit fit test xtest expect expectTypeOf before beforeAll beforeEach after afterAll afterEach assert""".split()
PLATFORM_TYPES = "Document Element History JsonWebKey Location Navigator RequestInit Storage StorageEvent Window".split()
PLATFORM_VALUES = """indexedDB document window self navigator location history global crypto Bun Deno WebSocketPair awslambda localStorage sessionStorage fetch process Buffer require module __dirname
__filename setTimeout setInterval setImmediate clearTimeout clearInterval cancelAnimationFrame addEventListener requestAnimationFrame queueMicrotask btoa atob caches eval performance structuredClone""".split()
# End of fixed values.

#: Targets in a list and shares of a shape's files: they cut the work of a join, not its result.
LISTED, SALTS = 4096, 16


def name_class(name: Column) -> Column:
    """language, platform or keyword for a name that isn't declared by the project; else null."""
    return F.when(name.isin(*KEYWORDS), "keyword").when(name.isin(*LANGUAGE_VALUES), "language").when(name.isin(*PLATFORM_TYPES, *PLATFORM_VALUES), "platform")


def reference_edge(target_kind: Column, is_call: Column) -> Column:
    """calls for a called function or macro, type_ref for a type, else value_ref."""
    return F.when(is_call & target_kind.isin("function", "macro", "method"), "calls").when(target_kind.isin("struct", "enum", "trait", "type_alias", "union", "class", "interface"), "type_ref").otherwise("value_ref")


def is_container(kind: Column) -> Column:
    return kind.isin("class", "interface", "type_alias")


def is_callable(kind: Column) -> Column:
    return kind.isin("function", "class", "variable", "property")


def property_key(prefix: Column) -> Column:
    """The identifier before a ``:`` or ``?:`` that ends a line's beginning; null if there is none."""
    return F.nullif(F.regexp_extract(prefix, r"([A-Za-z0-9_$]+)\s*\??\s*:\s*$", 1), F.lit(""))


def within(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """Whether the first span lies in the second."""
    return (a_start >= b_start) & (a_stop <= b_stop)


def exports_symbol(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_id, name): names that a file exports: the label if there is one, else the declaration's name."""
    e = edges.where("kind = 'exports'").select(F.col("src").alias("file_id"), F.col("dst").alias("node_id"), "label")
    return e.join(nodes.select("node_id", "name"), "node_id").select("file_id", F.coalesce("label", "name").alias("name")).distinct()


def type_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id): properties that an interface or type alias contains."""
    types = nodes.where(F.col("kind").isin("interface", "type_alias")).select(F.col("node_id").alias("src"))
    inside = edges.where("kind = 'contains'").join(types, "src", "left_semi").select(F.col("dst").alias("node_id"))
    return nodes.where("kind = 'property'").join(inside, "node_id", "left_semi").select("node_id")


def propose_support(subjects: DataFrame, declarations: DataFrame, tokens: int = 32, citations: int = 8) -> DataFrame:
    """(subject_id, token, outcome, places, omitted): what the tokens of unlinked statements may refer to.

    ``subjects(subject_id, text)``; of each the first ``tokens`` identifiers are looked up in ``declarations(name, file,
    line_no)``: unique, ambiguous (with ``citations`` places at most, and how many more there are), or missing. Names only
    suggest: nothing is verified by them.
    """
    t = subjects.select("subject_id", F.posexplode(F.slice(tx.identifier_tokens(F.col("text")), 1, tokens)).alias("pos", "token")).groupBy("subject_id", "token").agg(F.min("pos").alias("pos"))
    names = t.select(F.col("token").alias("name")).distinct()
    d = declarations.join(names, "name", "left_semi").select("name", "file", "line_no").distinct()
    ranked = d.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("file", "line_no")))
    g = ranked.groupBy("name").agg(F.count(F.lit(1)).alias("found"), F.array_sort(F.collect_list(F.when(F.col("n") <= citations, F.struct("n", F.concat_ws(":", "file", F.col("line_no").cast("string")).alias("place"))))).alias("p"))
    j = t.join(g, t.token == g.name, "left")
    outcome = F.when(F.col("found").isNull(), "missing").when(F.col("found") == 1, "unique").otherwise("ambiguous")
    places = F.coalesce(F.array_join(F.transform("p", lambda x: x["place"]), ", "), F.lit(""))
    return j.select("subject_id", "token", outcome.alias("outcome"), places.alias("places"), F.greatest(F.coalesce("found", F.lit(0)) - citations, F.lit(0)).alias("omitted"))


def import_lines(edges: DataFrame, lines: DataFrame, reach: int = 1024) -> DataFrame:
    """(edge_id, line_no): the line on which an import's statement names ``name``.

    ``edges(edge_id, file, name, first, last)`` gives the lines of the edge's span. Looked at are the span's lines, else
    those from the statement's start (the last line with ``import`` or ``export`` at its beginning, at most ``reach`` before).
    """
    starts = lines.where(F.col("text").rlike(r"^\s*(import|export)\b")).select("file", F.col("line_no").alias("at"))
    near = edges.join(starts, "file").where((F.col("at") <= F.col("first")) & (F.col("at") > F.col("first") - reach)).groupBy("edge_id").agg(F.max("at").alias("at"))
    e = edges.join(near, "edge_id", "left").select("edge_id", "file", "name", "first", "last", F.explode(F.sequence(F.coalesce("at", "first"), "last")).alias("line_no"))
    hit = e.join(lines.select("file", "line_no", "text"), ["file", "line_no"]).where(tx.mentions_identifier(F.col("text"), F.col("name")))
    return hit.groupBy("edge_id").agg(F.coalesce(F.min(F.when(F.col("line_no") >= F.col("first"), F.col("line_no"))), F.min("line_no")).alias("line_no"))


def awaited_bindings(lines: DataFrame) -> DataFrame:
    """(file, line_no, start_line): for each line with ``import(`` the nearest line at or above it with ``=``, ``Promise.all`` and ``[`` in this order."""
    opens = F.col("text").rlike(r"=.*Promise\.all.*\[")
    start = F.last(F.when(opens, F.col("line_no")), ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("start_line", start).where(F.col("text").contains("import(") & F.col("start_line").isNotNull()).select("file", "line_no", "start_line")


def template_parts(specifier: Column) -> Column:
    """struct(prefix, suffix) of a template import with exactly one hole; else null."""
    part = lambda i: F.regexp_extract(specifier, r"^([^$`]*)\$\{[^{}]*\}([^$`]*)$", i)
    return F.when(specifier.rlike(r"^[^$`]*\$\{[^{}]*\}[^$`]*$"), F.struct(part(1).alias("prefix"), part(2).alias("suffix")))


def possible_loads(templates: DataFrame, targets: DataFrame) -> DataFrame:
    """(file, target): files whose template import may load a target.

    ``templates(file, specifier)``, ``targets(target, variant)`` (how the target may be written). The prefix up to its last
    slash is a directory that the variant must start with, so both meet in an equi join on it.

    The result may have far more rows than both tables (files times targets of one shape), so it isn't shuffled: the distinct
    shapes of templates meet the targets first, what they load goes on as lists of about ``LISTED``, and only files with
    several shapes, which may load a target twice, are made distinct in the end.
    """
    from factloom.operators.imports import template_fits

    d = templates.withColumn("p", template_parts(F.col("specifier"))).where("p is not null").select("file", "p.*").distinct()
    d = d.withColumn("shapes", F.count(F.lit(1)).over(Window.partitionBy("file"))).withColumn("salt", F.pmod(F.xxhash64("file"), F.lit(SALTS)))
    t = d.select("prefix", "suffix").distinct().withColumn("folder", F.regexp_extract("prefix", "^(.*/)?", 0))
    parts = F.split("variant", "/")
    v = targets.select("target", "variant", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))).alias("folder"))
    loads = written(t.join(v, "folder").where(template_fits(F.col("prefix"), F.col("suffix"), F.col("variant"))).select("prefix", "suffix", "target").distinct())
    sizes = loads.groupBy("prefix", "suffix").agg(F.ceil(F.count(F.lit(1)) / LISTED).alias("lists"))
    lists = loads.join(sizes, ["prefix", "suffix"]).groupBy("prefix", "suffix", F.pmod(F.xxhash64("target"), "lists").alias("list")).agg(F.collect_list("target").alias("targets"))
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    met = lambda files: files.join(lists, ["prefix", "suffix", "salt"]).select("file", F.explode("targets").alias("target")).where("file <> target")
    return met(d.where("shapes = 1")).unionByName(met(d.where("shapes > 1")).distinct())


def dynamic_reachability(loads: DataFrame, uses: DataFrame, contains: DataFrame) -> DataFrame:
    """(file, source): files that load a file dynamically and don't use one of its members statically.

    ``loads(source, file)``, ``uses(source, node_id)`` (static calls and value references, by file), ``contains(file, node_id)``.
    """
    resolved = uses.join(contains, "node_id").where("source <> file").select("source", "file").distinct()
    return loads.select("source", "file").distinct().join(resolved, ["source", "file"], "left_anti").select("file", "source")


def task_view(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, outcome, node_id, candidates) of ``queries(query, name, file, line_no)``: found, ambiguous or not_found.

    A query's file and line narrow its candidates where they are given.
    """
    # Nodes are counted for each choice of what a query may leave open, so that a query meets one row at most.
    choices = [(f, n) for f in (True, False) for n in (True, False)]
    given = lambda f, n: F.struct(F.lit(f).alias("by_file"), F.lit(n).alias("by_line"), F.when(F.lit(f), F.col("file")).alias("n_file"), F.when(F.lit(n), F.col("line_no")).alias("n_line"))
    each = nodes.select(F.col("name").alias("n_name"), "node_id", F.explode(F.array(*[given(*x) for x in choices])).alias("x")).select("n_name", "x.*", "node_id")
    each = each.where("(not by_file or n_file is not null) and (not by_line or n_line is not null)")
    counts = each.groupBy("n_name", "by_file", "by_line", "n_file", "n_line").agg(F.count("node_id").alias("fits"), F.min("node_id").alias("fit"))
    q = queries.select("query", "name", "file", "line_no", F.col("file").isNotNull().alias("q_file"), F.col("line_no").isNotNull().alias("q_line"))
    met = (q.name == counts.n_name) & (q.q_file == counts.by_file) & (q.q_line == counts.by_line) & q.file.eqNullSafe(counts.n_file) & q.line_no.eqNullSafe(counts.n_line)
    g = q.join(counts, met, "left").groupBy("query").agg(F.coalesce(F.sum("fits"), F.lit(0)).alias("candidates"), F.min("fit").alias("node_id"))
    return g.select("query", F.when(F.col("candidates") == 0, "not_found").when(F.col("candidates") == 1, "found").otherwise("ambiguous").alias("outcome"), F.when(F.col("candidates") == 1, F.col("node_id")).alias("node_id"), "candidates")
