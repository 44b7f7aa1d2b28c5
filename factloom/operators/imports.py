"""Import specifiers: aliases, probing for files, labels, and names that they bind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.paths import is_relative_specifier, normalize

# The order in which extensions are probed.
FOR_SOURCE = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs")
FOR_RUNTIME = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".d.ts")
REWRITES = {".js": (".ts", ".tsx", ".d.ts"), ".jsx": (".tsx",), ".mjs": (".mts", ".d.mts"), ".cjs": (".cts", ".d.cts")}
# End of fixed values.


def runtime_first(importer: Column) -> Column:
    return importer.rlike(r"\.(js|jsx|mjs|cjs)$")


def probe_paths(path: Column, importer: Column) -> Column:
    """The paths that a normalised path may stand for, the best first."""
    tail = lambda ends, mid="": F.array(*[F.concat(path, F.lit(mid + e)) for e in ends])
    rewritten = F.array().cast("array<string>")
    for end, others in REWRITES.items():
        stem = F.regexp_replace(path, end.replace(".", r"\.") + "$", "")
        rewritten = F.when(path.endswith(end), F.array(*[F.concat(stem, F.lit(o)) for o in others])).otherwise(rewritten)
    source = F.concat(rewritten, F.array(path), tail(FOR_SOURCE), tail(FOR_SOURCE, "/index"))
    runtime = F.concat(F.array(path), tail(FOR_RUNTIME), tail(FOR_RUNTIME, "/index"), rewritten)
    return F.when(runtime_first(importer), runtime).otherwise(source)


def probe(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path): of ``wanted(id, ordinal, path, importer)`` the first path that ``files(path)`` has, by ordinal and probing order."""
    tried = wanted.select("id", "ordinal", F.posexplode(probe_paths(F.col("path"), F.col("importer"))).alias("place", "path"))
    return tried.join(files.select("path").distinct(), "path").groupBy("id").agg(F.min_by("path", F.struct("ordinal", "place")).alias("path"))


def scopes_above(importer: Column) -> Column:
    """All directories above a file, ``./`` first, as aliases name their scopes."""
    parts = F.split(importer, "/")
    return F.concat(F.array(F.lit("./")), F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def resolve_aliases(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, importer, targets): of ``imports(id, importer, specifier)`` what the best alias makes of the specifier.

    ``aliases(ordinal, scope_dir, pattern, targets)``: the deepest scope above the importer, then the longest text
    before ``*`` (a pattern without ``*`` before all), then the least ordinal. Imports meet aliases in an equi join on
    the importer's directories.
    """
    a = aliases.select("ordinal", F.when(F.col("scope_dir").isin("", "./"), "./").otherwise(F.regexp_replace("scope_dir", "/$", "")).alias("scope"), F.length("scope_dir").alias("deep"), "pattern", "targets")
    i = imports.select("id", "importer", "specifier", F.explode(F.array_distinct(scopes_above(F.col("importer")))).alias("scope"))
    star = F.instr("pattern", "*")
    before, after = F.expr("substring(pattern, 1, instr(pattern, '*') - 1)"), F.expr("substring(pattern, instr(pattern, '*') + 1, length(pattern))")
    s = F.col("specifier")
    fits = F.when(star == 0, s == F.col("pattern")).otherwise((F.length(s) >= F.length(before) + F.length(after)) & s.startswith(before) & s.endswith(after))
    held = F.when(star > 0, F.substring(s, F.length(before) + 1, F.length(s) - F.length(before) - F.length(after)))
    met = i.join(a, "scope").where(fits).select("id", "importer", "targets", held.alias("held"), F.struct((-F.col("deep")).alias("deep"), F.when(star == 0, -(1 << 30)).otherwise(-F.length(before)).alias("sharp"), "ordinal").alias("key"))
    best = met.groupBy("id", "importer").agg(F.min_by(F.struct("targets", "held"), "key").alias("b"))
    once = lambda t: F.when(F.col("b.held").isNotNull() & (F.instr(t, "*") > 0), F.concat(F.substring_index(t, "*", 1), F.col("b.held"), F.substring(t, F.instr(t, "*") + 1, F.length(t)))).otherwise(t)
    return best.select("id", "importer", F.transform("b.targets", once).alias("targets"))


def canonical_imports(imports: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path): the project file that each import names; none for packages and what isn't there.

    Relative specifiers start from the importer's directory; others go through the aliases.
    """
    parent = F.when(F.col("importer").contains("/"), F.regexp_replace("importer", "/[^/]*$", "")).otherwise(".")
    bare = F.regexp_replace("specifier", r"[?#].*$", "")
    i = imports.withColumn("specifier", bare)
    near = i.where(is_relative_specifier(F.col("specifier"))).select("id", F.lit(0).alias("ordinal"), normalize(F.concat(parent, F.lit("/"), "specifier")).alias("path"), "importer")
    far = resolve_aliases(i.where(~is_relative_specifier(F.col("specifier"))), aliases)
    far = far.select("id", "importer", F.posexplode("targets").alias("ordinal", "target")).select("id", "ordinal", normalize(F.col("target")).alias("path"), "importer")
    return probe(near.unionByName(far), files)


def bound_names(label: Column) -> Column:
    """array of struct(exported, local) that an import label binds: ``default as x, {a as b, type c}``."""
    inner = F.regexp_replace(F.regexp_replace(label, r"[{}]", ","), r"\s+", " ")
    items = F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^type ", "")), lambda x: x != "")
    return F.transform(items, lambda x: F.struct(F.split_part(x, F.lit(" as "), F.lit(1)).alias("exported"), F.regexp_replace(x, "^.* as ", "").alias("local")))


def label_mentions(label: Column, name: Column) -> Column:
    """Whether a label imports the exported ``name``."""
    return F.exists(bound_names(label), lambda x: x["exported"] == name)


def exported_for(label: Column, local: Column) -> Column:
    """The exported names that the local name stands for, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(bound_names(label), lambda x: (x["local"] == local) & (x["exported"] != x["local"])), lambda x: x["exported"])))


def template_fits(prefix: Column, suffix: Column, candidate: Column) -> Column:
    """Whether a template import's fixed ends fit and leave something for the hole."""
    return candidate.startswith(prefix) & candidate.endswith(suffix) & (F.length(candidate) > F.length(prefix) + F.length(suffix))


def specifier_variants(importer: Column, target: Column) -> Column:
    """How a file may be written in an import of another: relative, without its extension, and an index as its directory."""
    a, b = F.split(importer, "/"), F.split(target, "/")
    up = F.slice(a, 1, F.size(a) - 1)
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.size(up), F.size(b) - 1), F.lit(1))), F.lit(0), lambda n, k: F.when((n == k - 1) & (k <= F.least(F.size(up), F.size(b) - 1)) & (F.get(up, k - 1) == F.get(b, k - 1)), k).otherwise(n))
    ups = F.size(up) - same
    rest = F.array_join(F.slice(b, same + 1, F.size(b)), "/")
    whole = F.when(ups == 0, F.concat(F.lit("./"), rest)).otherwise(F.concat(F.repeat(F.lit("../"), ups), rest))
    short = F.regexp_replace(whole, r"(\.d)?\.[^./]+$", "")
    return F.array_distinct(F.array_compact(F.array(whole, short, F.when(short.endswith("/index"), F.regexp_replace(short, "/index$", "")))))


def unique_suffixes(items: DataFrame) -> DataFrame:
    """(suffix, node): of ``items(path, node)`` every ``::`` suffix of a path that one item alone has."""
    parts = F.split("path", "::")
    d = items.select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "::"))).alias("suffix"))
    return d.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1").drop("n")


def declarations_named(names: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, node_id): what a name may mean: declarations so named, exported under it, or imported under it.

    ``edges(kind, src, dst, label)``: an export's label is the name it exports; an import's label binds names in
    ``src`` to declarations in the file ``dst``. Members of interfaces and type aliases don't count.
    """
    own = nodes.where(F.col("kind").isin("function", "class", "variable", "property", "interface", "type_alias")).select("name", "node_id")
    exported = edges.where("kind = 'exports'").select(F.col("label").alias("name"), F.col("dst").alias("node_id"))
    bound = edges.where("kind = 'imports'").select("dst", F.explode(bound_names(F.col("label"))).alias("b")).where("b.local <> b.exported").select("dst", F.col("b.local").alias("name"), F.col("b.exported").alias("exported")).distinct()
    inside = edges.where("kind = 'contains'").select(F.col("src").alias("dst"), F.col("dst").alias("node_id")).join(nodes.select("node_id", F.col("name").alias("exported")), "node_id")
    imported = bound.join(inside, ["dst", "exported"]).select("name", "node_id")
    types = nodes.where(F.col("kind").isin("interface", "type_alias")).select(F.col("node_id").alias("src"))
    members = edges.where("kind = 'contains'").join(types, "src", "left_semi").join(nodes.where("kind = 'property'").select(F.col("node_id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("node_id"))
    every = own.unionByName(exported).unionByName(imported).distinct().join(members, "node_id", "left_anti")
    return every.join(names.select("name").distinct(), "name", "left_semi").select("name", "node_id")


def import_rows(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(node_id, name, file_id, label): who imports a declaration by name, or its whole file; one row for each importing file.

    ``files(node_id, file_id)`` is the enclosing file of each node.
    """
    d = nodes.join(files, "node_id").select("node_id", "name", F.col("file_id").alias("dst"))
    i = edges.where("kind = 'imports' and src <> dst").select(F.col("src").alias("importer"), "dst", "label", "seq")
    # Of each importing file only its first import that names a name counts, and its first of the whole file.
    first = F.min(F.struct("seq", "label")).alias("first")
    whole = i.where("label = '*'").groupBy("dst", "importer").agg(first)
    named = i.select("importer", "dst", "label", "seq", F.explode(F.array_distinct(F.transform(bound_names(F.col("label")), lambda x: x["exported"]))).alias("name")).groupBy("dst", "name", "importer").agg(first)
    met = d.join(whole, "dst").select("node_id", "name", "importer", "first").unionByName(d.join(named, ["dst", "name"]).select("node_id", "name", "importer", "first"))
    return met.groupBy("node_id", "importer").agg(F.min(F.struct("first", "name")).alias("x")).select("node_id", "x.name", F.col("importer").alias("file_id"), "x.first.label")


def merged_exports(rows: DataFrame) -> DataFrame:
    """(file, name, value_node, type_node): same-name exports of a file: the latest value and the latest type each.

    ``rows(file, name, space, node, seq)`` with space ``value`` or ``type``.
    """
    last = lambda s: F.max_by(F.when(F.col("space") == s, F.col("node")), F.when(F.col("space") == s, F.col("seq")))
    return rows.groupBy("file", "name").agg(last("value").alias("value_node"), last("type").alias("type_node"))


def first_resolved(refs: DataFrame, *tables: DataFrame) -> DataFrame:
    """(ref_id, node): of ``refs(ref_id, file, name)`` the first of ``tables(file, name, node)`` that has the name."""
    out = refs
    for k, t in enumerate(tables):
        out = out.join(t.select("file", "name", F.col("node").alias(f"n{k}")), ["file", "name"], "left")
    return out.select("ref_id", F.coalesce(*[F.col(f"n{k}") for k in range(len(tables))]).alias("node"))
