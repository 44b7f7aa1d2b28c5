"""Linking source events: what each exported, imported, used and called name stands for, across files.

Tables are those of ``sources.code.events``, with ``path`` as the file. Each pass is an equi join; re-exports are followed
in rounds over what is new (written after each), so their number is that of re-exports in a row, and circles end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.imports import bound_names
from factloom.plans.stages import written

#: Kinds of events that declare a name which others may use.
TYPESCRIPT = ("function", "class", "interface", "enum", "namespace", "type_alias", "variable")
RUST = ("function", "struct", "enum", "trait", "module", "type_alias", "union", "const", "static", "macro")


def _inside(label: Column) -> Column:
    return F.regexp_extract(label, r"\{([^}]*)\}", 1)


def import_bindings(events: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, local, target, name): what each imported name stands for; ``*`` for a whole file, ``default`` for its default.

    ``targets(path, specifier, target)`` are the files that specifiers mean; imports of others (packages) bind nothing.
    """
    i = events.where("kind = 'import'").select("path", F.col("name").alias("specifier"), F.col("detail").alias("label")).join(targets, ["path", "specifier"])
    outside = F.regexp_replace("label", r"\{[^}]*\}", "")
    whole, first = F.regexp_extract(outside, r"\*\s*as\s+([\w$]+)", 1), F.regexp_extract(outside, r"^\s*([\w$]+)", 1)
    pair = lambda name, local: F.struct(name.alias("name"), local.alias("local"))
    named = F.transform(bound_names(_inside(F.col("label"))), lambda x: pair(x["exported"], x["local"]))
    rest = F.array(F.when(whole != "", pair(F.lit("*"), whole)), F.when(first != "", pair(F.lit("default"), first)))
    return i.select("path", "target", F.explode(F.concat(named, F.array_compact(rest))).alias("x")).select("path", "x.local", "target", "x.name").distinct()


def direct_exports(events: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, name, source, source_name) that a file exports by name, its own names or those of another file (``*``: all of
    it as one name), and (path, source) of the files all of whose names it passes on.
    """
    own = events.where(F.col("kind").isin(*TYPESCRIPT) & F.col("owner").isNull() & (F.col("detail") == "export")).select("path", "name", F.col("path").alias("source"), F.col("name").alias("source_name"))
    default = events.where("kind = 'export_default'").select("path", F.lit("default").alias("name"), F.col("path").alias("source"), F.col("name").alias("source_name"))
    lists = events.where("kind = 'export'").select("path", F.col("name").alias("specifier"), F.col("detail").alias("label"))
    lists = lists.join(targets, ["path", "specifier"], "left").where("specifier is null or target is not null").withColumn("source", F.coalesce("target", "path"))
    named = lists.where("startswith(label, '{')").select("path", "source", F.explode(bound_names(_inside(F.col("label")))).alias("x")).select("path", F.col("x.local").alias("name"), "source", F.col("x.exported").alias("source_name"))
    stars = lists.where("startswith(label, '*') and specifier is not null")
    whole = F.regexp_extract("label", r"\*\s*as\s+([\w$]+)", 1)
    spaces = stars.where(whole != "").select("path", whole.alias("name"), "source", F.lit("*").alias("source_name"))
    return own.unionByName(default).unionByName(named).unionByName(spaces).distinct(), stars.where(whole == "").select("path", "source").where("path <> source").distinct()


def resolved_exports(events: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, name, file, symbol): the declaration that each exported name of a file comes from; symbol ``*`` is a whole file.

    A name that a file exports itself comes before those that it passes on from others; of these, ``default`` isn't passed
    on, and a name that stands for two declarations is dropped. Names that lead nowhere (or in a circle) have no row.
    """
    named, stars = direct_exports(events, targets)
    named, stars = written(named), written(stars)
    known = events.where(F.col("kind").isin(*TYPESCRIPT) & F.col("owner").isNull()).select(F.col("path").alias("source"), F.col("name").alias("source_name")).distinct()
    imported = import_bindings(events, targets)
    mine = named.where("path = source")
    front = mine.join(known, ["source", "source_name"], "left_semi").unionByName(named.where("source_name = '*'")).select("path", "name", F.col("source").alias("file"), F.col("source_name").alias("symbol"))
    # An imported name that is exported again is one of the other file's.
    again = mine.join(known, ["source", "source_name"], "left_anti").join(imported.select(F.col("path").alias("source"), F.col("local").alias("source_name"), F.col("target").alias("t"), F.col("name").alias("n")), ["source", "source_name"])
    front = front.unionByName(again.where("n = '*'").select("path", "name", F.col("t").alias("file"), F.col("n").alias("symbol")))
    follow = named.where("path <> source and source_name <> '*'").unionByName(again.where("n <> '*'").select("path", "name", F.col("t").alias("source"), F.col("n").alias("source_name")))
    follow = written(follow)
    front = found = written(front.distinct())
    taken = named.select("path", "name").distinct()
    k = 0
    while not front.isEmpty():
        k += 1
        f = front.select(F.col("path").alias("source"), F.col("name").alias("passed"), "file", "symbol")
        by_name = follow.join(f.withColumnRenamed("passed", "source_name"), ["source", "source_name"]).select("path", "name", "file", "symbol")
        by_star = stars.join(f.where("passed <> 'default'"), "source").select("path", F.col("passed").alias("name"), "file", "symbol").join(taken, ["path", "name"], "left_anti")
        front = written(by_name.unionByName(by_star).distinct().join(found, ["path", "name", "file", "symbol"], "left_anti"))
        found = written(found.unionByName(front)) if k % 8 == 0 else found.unionByName(front)
    one = found.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "symbol")).alias("x"))
    return one.where("n = 1").select("path", "name", "x.file", "x.symbol")


def _owners(owner: Column, mark: str) -> Column:
    """Nearest first: the owner, what is around it, and ``''`` for the file's top."""
    parts = F.split(owner, rf"\Q{mark}\E")
    around = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), mark))
    return F.concat(F.coalesce(around, F.array().cast("array<string>")), F.array(F.lit("")))


def linked_uses(events: DataFrame, targets: DataFrame, exports: DataFrame) -> DataFrame:
    """(path, seq, kind, name, file, symbol): calls and heritage with the declaration that they mean.

    A name means the nearest declaration around it, else what is imported under it, followed to where it is declared. The
    call of a member means an exported name of a file that is imported as a whole. Names that are parameters or local
    variables aren't told apart from outer ones. What isn't resolved has no row.
    """
    member = events.where("kind = 'member_call'").select("path", "start", F.col("detail").alias("receiver"))
    u = events.where(F.col("kind").isin("call", "extends", "implements")).select("path", "seq", "kind", "name", "owner", "start", (F.coalesce(F.col("detail") == "member", F.lit(False)) | F.col("name").contains(".")).alias("is_member"))
    d = events.where(F.col("kind").isin(*TYPESCRIPT)).select("path", F.coalesce("owner", F.lit("")).alias("around"), "name").distinct()
    plain = u.where("not is_member").select("path", "seq", "kind", "name", F.posexplode(_owners(F.col("owner"), ".")).alias("far", "around"))
    near = plain.join(d, ["path", "around", "name"]).groupBy("path", "seq").agg(F.min("kind").alias("kind"), F.min("name").alias("name"), F.min_by("around", "far").alias("around"))
    near = near.select("path", "seq", "kind", "name", F.col("path").alias("file"), F.when(F.col("around") == "", F.col("name")).otherwise(F.concat_ws(".", "around", "name")).alias("symbol"))
    bound = import_bindings(events, targets)
    left = u.where("not is_member").join(near.select("path", "seq"), ["path", "seq"], "left_anti")
    e = exports.select(F.col("path").alias("target"), F.col("name").alias("wanted"), "file", "symbol")
    far = left.join(bound.where("name <> '*'").select("path", F.col("local").alias("name"), "target", F.col("name").alias("wanted")), ["path", "name"]).join(e, ["target", "wanted"]).select("path", "seq", "kind", "name", "file", "symbol")
    dotted = u.where("kind <> 'call' and is_member").select("path", "seq", "kind", "name", F.substring_index("name", ".", 1).alias("receiver"), F.substring_index("name", ".", -1).alias("wanted"))
    called = u.where("kind = 'call' and is_member").join(member, ["path", "start"]).select("path", "seq", "kind", "name", "receiver", F.col("name").alias("wanted"))
    spaces = bound.where("name = '*'").select("path", F.col("local").alias("receiver"), "target")
    # A name that passes a whole file on is a space as well.
    passed = bound.where("name <> '*'").select("path", F.col("local").alias("receiver"), "target", F.col("name").alias("wanted")).join(e.where("symbol = '*'"), ["target", "wanted"]).select("path", "receiver", F.col("file").alias("target"))
    whole = dotted.unionByName(called).join(spaces.unionByName(passed).distinct(), ["path", "receiver"]).join(e, ["target", "wanted"]).select("path", "seq", "kind", "name", "file", "symbol")
    return near.unionByName(far).unionByName(whole).distinct()


def rust_items(events: DataFrame, modules: DataFrame) -> DataFrame:
    """(item, path, kind): each item by its path of modules; ``modules(path, module)`` names a file's module (``crate::a``)."""
    i = events.where(F.col("kind").isin(*RUST)).join(modules, "path")
    return i.select(F.concat_ws("::", "module", "owner", "name").alias("item"), "path", "kind").distinct()


def _absolute(path: Column, module: Column) -> Column:
    """A path from the crate's root: ``crate`` stays, ``self`` is the module, each ``super`` one module less."""
    ups = F.size(F.filter(F.split(path, "::"), lambda x: x == "super"))
    parts = F.split(module, "::")
    rest = F.regexp_replace(path, "^((self|super)::)+|^(self|super)$", "")
    above = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - ups, F.lit(0))), "::")
    return F.when(path.rlike("^crate(::|$)"), path).when(path.rlike("^(self|super)(::|$)"), F.regexp_replace(F.concat_ws("::", above, rest), "::$", ""))


def rust_aliases(events: DataFrame, modules: DataFrame, items: DataFrame) -> DataFrame:
    """(alias, item): what each name that a ``use`` binds (module path and name) stands for, followed through other uses.

    A path without ``crate``, ``self`` or ``super`` begins in its own module, else at the crate's root. All of a module
    (``*``) binds each of its items, unless the module has the name itself.
    """
    inner = F.concat_ws("::", "module", F.regexp_replace("owner", "(^|::)[a-z_0-9]*!$", ""))
    b = events.where("kind = 'binding'").join(modules, "path").select(inner.alias("module"), F.col("name").alias("local"), F.col("detail").alias("to"))
    starts = F.array_compact(F.array(_absolute(F.col("to"), F.col("module")), F.when(~F.col("to").rlike("^(crate|self|super)(::|$)"), F.concat_ws("::", "module", "to")), F.when(~F.col("to").rlike("^(crate|self|super)(::|$)"), F.concat(F.lit("crate::"), "to"))))
    b = written(b.select("module", "local", F.posexplode(starts).alias("try", "to")))
    own = items.select("item").distinct()
    globs = b.where("local = '*'").select("module", F.regexp_replace("to", "::\\*$", "").alias("from"))
    named = b.where("local <> '*'").select(F.concat_ws("::", "module", "local").alias("alias"), "try", "to").where("alias <> to")
    front = found = written(named.join(own, F.col("to") == F.col("item")).groupBy("alias").agg(F.min_by("item", "try").alias("item")))
    last = lambda c: F.regexp_replace(c, "^.*::", "")
    over = lambda c: F.regexp_replace(c, "::[^:]*$", "")
    in_module = own.select(over(F.col("item")).alias("from"), last(F.col("item")).alias("name"), "item")
    spread = globs.join(in_module, "from").select(F.concat_ws("::", "module", "name").alias("alias"), "item").where("alias <> item")
    spread = spread.join(own.withColumnRenamed("item", "alias"), "alias", "left_anti").join(found.select("alias"), "alias", "left_anti")
    front = found = written(found.unionByName(spread.groupBy("alias").agg(F.min("item").alias("item"))))
    while not front.isEmpty():
        f = front.select(F.col("alias").alias("to"), "item")
        by_name = named.join(f, "to").groupBy("alias").agg(F.min_by("item", "try").alias("item"))
        g = front.select(over(F.col("alias")).alias("from"), last(F.col("alias")).alias("name"), "item")
        by_glob = globs.join(g, "from").select(F.concat_ws("::", "module", "name").alias("alias"), "item").join(own.withColumnRenamed("item", "alias"), "alias", "left_anti")
        new = by_name.unionByName(by_glob).where("alias <> item").groupBy("alias").agg(F.min("item").alias("item"))
        front = written(new.join(found.select("alias"), "alias", "left_anti"))
        found = written(found.unionByName(front))
    return found


def rust_paths(refs: DataFrame, items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, seq, name, item): the item that each path of ``refs(path, seq, name, module, owner)`` means.

    By its module and those around it inside of the file, by what a use binds there, or from the crate's root. A path's
    first names may be bound by a use (``a::f`` with ``use crate::x::a``).
    """
    around = F.transform(_owners(F.col("owner"), "::"), lambda o: F.when(o == "", F.col("module")).otherwise(F.concat_ws("::", "module", o)))
    tries = F.concat(F.array_compact(F.array(_absolute(F.col("name"), F.col("module")))), F.transform(around, lambda m: F.concat_ws("::", m, F.col("name"))), F.array(F.concat(F.lit("crate::"), "name")))
    t = refs.select("path", "seq", "name", F.posexplode(tries).alias("try", "to"))
    own = t.join(items.select(F.col("item").alias("to")).distinct(), "to").select("path", "seq", "name", "try", F.col("to").alias("item"))
    whole = t.join(aliases.select(F.col("alias").alias("to"), "item"), "to").select("path", "seq", "name", "try", "item")
    head, tail = F.regexp_replace("to", "::[^:]*$", ""), F.regexp_replace("to", "^.*::", "")
    part = t.where("name like '%::%'").select("path", "seq", "name", "try", head.alias("alias"), tail.alias("tail")).join(aliases.withColumnRenamed("item", "head"), "alias").select("path", "seq", "name", "try", F.concat_ws("::", "head", "tail").alias("item"))
    part = part.join(items.select("item").distinct(), "item", "left_semi").select("path", "seq", "name", "try", "item")
    found = own.unionByName(whole).unionByName(part)
    return found.groupBy("path", "seq", "name").agg(F.min_by("item", F.struct("try", "item")).alias("item"))


def linked_rust_calls(events: DataFrame, modules: DataFrame, items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, seq, name, item): calls with the item that they mean (see ``rust_paths``). Methods aren't resolved."""
    c = events.where("kind = 'call' and (detail is null or detail <> 'member')").join(modules, "path")
    return rust_paths(c.select("path", "seq", "name", "module", "owner"), items, aliases)


def rust_impls(events: DataFrame, modules: DataFrame, items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, seq, type, trait): implementations whose type is an item, with the trait's item (null for none, or one that isn't resolved)."""
    i = events.where("kind = 'impl'").join(modules, "path")
    told = lambda c: rust_paths(i.where(F.col(c).isNotNull()).select("path", "seq", F.col(c).alias("name"), "module", "owner"), items, aliases).select("path", "seq", "item")
    return told("name").withColumnRenamed("item", "type").join(told("detail").withColumnRenamed("item", "trait"), ["path", "seq"], "left")


def re_exports(events: DataFrame, targets: DataFrame, exports: DataFrame) -> DataFrame:
    """(file, symbol, path, kind, alias): files that export another file's declaration: by name, under an alias, or with all names."""
    named, stars = direct_exports(events, targets)
    e = exports.where("path <> file and symbol <> '*'")
    own = named.select("path", "name").distinct()
    by_name = e.join(own, ["path", "name"]).select("file", "symbol", "path", F.lit("named").alias("kind"), F.col("name").alias("alias"))
    by_star = e.join(own, ["path", "name"], "left_anti").join(stars.select("path").distinct(), "path", "left_semi").select("file", "symbol", "path", F.lit("wildcard").alias("kind"), F.lit(None).cast("string").alias("alias"))
    return by_name.unionByName(by_star).distinct()


def registry_exports(events: DataFrame, targets: DataFrame, exports: DataFrame) -> DataFrame:
    """(file, symbol, path, start, key, loader): entries of object literals that load a file, for each declaration that the file exports itself.

    Templates are not resolved here; ``symbols.possible_loads`` tells what they may load.
    """
    r = events.where("kind = 'registry'").select("path", "start", F.col("name").alias("key"), F.substring_index("detail", ":", 1).alias("loader"), F.expr("substring(detail, instr(detail, ':') + 1)").alias("specifier"))
    loaded = r.where("loader <> 'template'").join(targets, ["path", "specifier"]).where("path <> target").withColumnRenamed("target", "file")
    own = exports.where("path = file and symbol <> '*'").select("file", "symbol").distinct()
    return loaded.join(own, "file").select("file", "symbol", "path", "start", "key", "loader")


def provider_tables(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``providers(service, provider)`` and ``compositions(file, provider)``, as ``evidence.provider_context`` takes them."""
    p = events.where("kind = 'provider'").select(F.col("detail").alias("service"), F.col("name").alias("provider")).distinct()
    return p, events.where("kind = 'composition'").select(F.col("path").alias("file"), F.col("name").alias("provider")).distinct()
