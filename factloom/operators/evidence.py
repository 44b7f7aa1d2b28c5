"""Evidence bundles: rows of decoded documents and graphs, their ids, statuses and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import codes
from factloom.functions import text as tx
from factloom.plans.stages import doubled, numbered, written

# Kinds of nodes that are claims, and what a fact of each other kind says.
CLAIMS = ("requirement", "adr_decision", "api_contract", "runbook_step", "architecture_claim")
PREDICATES = {"doc_page": "defines_page", "doc_section": "defines_section", "code_reference": "references_code"}
# End of fixed values.


def is_claim(kind: Column) -> Column:
    return kind.isin(*CLAIMS)


def fact_predicate(kind: Column) -> Column:
    return codes.by(kind, PREDICATES, "documents_claim")


def fact_object(kind: Column, target: Column, symbol: Column, title: Column) -> Column:
    """Of a code reference ``target#symbol`` or the one there is; else the title."""
    return F.when((kind == "code_reference") & (target.isNotNull() | symbol.isNotNull()), F.concat_ws("#", target, symbol)).otherwise(title)


def claims_and_facts(nodes: DataFrame) -> DataFrame:
    """(evidence_id, table, subject, predicate, object, status) of ``nodes(evidence_id, file, kind, parent, target, symbol, title)``.

    Claims await verification; other nodes are facts about their parent (the document where there is none).
    """
    claim = is_claim(F.col("kind"))
    subject = F.coalesce("parent", F.when(~claim, F.concat(F.lit("doc:"), "file")))
    return nodes.select(
        "evidence_id", F.when(claim, "doc_claims").otherwise("doc_facts").alias("table"), subject.alias("subject"), F.when(~claim, fact_predicate(F.col("kind"))).alias("predicate"),
        F.when(claim, F.col("title")).otherwise(fact_object(F.col("kind"), F.col("target"), F.col("symbol"), F.col("title"))).alias("object"), F.when(claim, "unverified").alias("status"),
    )


def shapes(nodes: DataFrame, diagnostics: DataFrame, verifications: DataFrame) -> DataFrame:
    """(evidence_id, kind, proof_status, confidence): flat rows of nodes and diagnostics, claims with the status they got."""
    claim = is_claim(F.col("kind"))
    v = verifications.groupBy(F.col("evidence_id").alias("of")).agg(F.max("status").alias("got"))
    n = nodes.join(v, (nodes.evidence_id == v.of) & claim, "left")
    status = F.when(claim, F.coalesce("got", F.lit("unverified"))).otherwise("decoded")
    own = n.select("evidence_id", F.when(claim, "doc_claim").otherwise("doc_fact").alias("kind"), status.alias("proof_status"), F.when(claim & F.col("got").isNotNull(), codes.status_confidence(F.col("got"))).when(claim, "medium").otherwise("high").alias("confidence"))
    return own.unionByName(diagnostics.select("evidence_id", F.lit("doc_diagnostic").alias("kind"), F.lit("diagnostic").alias("proof_status"), F.lit("high").alias("confidence")))


def all_ids(*tables: DataFrame) -> DataFrame:
    """Distinct ids of all tables: ``evidence_id`` and, where there is one, the array ``evidence_ids``."""
    out = None
    for t in tables:
        ids = t.select("evidence_id")
        if "evidence_ids" in t.columns:
            ids = ids.unionByName(t.select(F.explode("evidence_ids").alias("evidence_id")))
        out = ids if out is None else out.unionByName(ids)
    return out.where("evidence_id is not null").distinct()


def graph_freshness(worlds: DataFrame, epochs: tuple[str, ...] = ("decode", "graph", "truth", "capability", "verification")) -> DataFrame:
    """(repo, freshness): unknown if one of the epochs is empty or null, else fresh."""
    full = F.lit(True)
    for e in epochs:
        full = full & (F.coalesce(e, F.lit("")) != "")
    return worlds.select("repo", F.when(full, "fresh").otherwise("unknown").alias("freshness"))


def truth_verdicts(claims: DataFrame, diffs: DataFrame) -> DataFrame:
    """(claim_id, status, silent): verified if no silent divergence is left of a claim's report, else contradicted."""
    n = diffs.where("classification = 'silent_divergence'").groupBy("claim_id").agg(F.count(F.lit(1)).alias("silent"))
    return claims.select("claim_id").join(n, "claim_id", "left").select("claim_id", F.when(F.col("silent").isNull(), "verified").otherwise("contradicted").alias("status"), F.coalesce("silent", F.lit(0)).alias("silent"))


def apply_checks(verifications: DataFrame, checks: DataFrame) -> DataFrame:
    """(claim_id, status, evidence_ids) after ``checks(claim_id, status, evidence_ids)`` of contracts.

    A contradiction always wins; a verified check lifts only a claim that is unverified; all else stays as it is.
    """
    c = checks.groupBy(F.col("claim_id").alias("c")).agg(F.bool_or(F.col("status") == "contradicted").alias("no"), F.bool_or(F.col("status") == "verified").alias("yes"), F.array_distinct(F.flatten(F.collect_set("evidence_ids"))).alias("more"))
    d = verifications.join(c, verifications.claim_id == c.c, "left")
    status = F.when(F.col("no"), "contradicted").when(F.col("yes") & (F.col("status") == "unverified"), "verified").otherwise(F.col("status"))
    return d.select("claim_id", status.alias("status"), F.array_sort(F.array_union("evidence_ids", F.coalesce("more", F.array().cast("array<string>")))).alias("evidence_ids"))


def dependents(facts: DataFrame, inputs: DataFrame) -> DataFrame:
    """(target, file, start, kind): facts that depend on the given targets: one for each span, that with most detail."""
    f = facts.join(inputs.select("target").distinct(), "target", "left_semi")
    best = Window.partitionBy("target", "file", "start").orderBy(F.col("expected").isNotNull().desc(), F.col("symbol").isNotNull().desc(), "kind")
    return f.withColumn("n", F.row_number().over(best)).where("n = 1").select("target", "file", "start", "kind")


def reference_candidates(facts: DataFrame) -> DataFrame:
    """(target, symbol, places): distinct references with where they stand (sorted); links to the web are none.

    The set of places is as long as a reference is often cited; its parts are distinct before they are gathered.
    """
    d = facts.where(F.col("kind").isin("file_ref", "symbol_ref") & ~F.col("target").rlike("^[a-z][a-z0-9+.-]*://"))
    return d.groupBy("target", "symbol").agg(F.array_sort(F.collect_set(F.struct("file", "line_no", "col"))).alias("places"))


def known_references(candidates: DataFrame, resolved: DataFrame) -> DataFrame:
    """(target, symbol, outcome, known, reason) of candidates against ``resolved(target, symbol, outcome, reason)``.

    Resolved ones and gaps are known (a gap says why it can't be told); unresolved ones aren't. A symbol without a
    target always passes; what nobody looked up is unresolved.
    """
    r = resolved.select(F.col("target").alias("t"), F.col("symbol").alias("s"), "outcome", "reason")
    d = candidates.join(r, candidates.target.eqNullSafe(r.t) & candidates.symbol.eqNullSafe(r.s), "left")
    outcome = F.coalesce("outcome", F.lit("unresolved"))
    return d.select("target", "symbol", outcome.alias("outcome"), (F.col("target").isNull() | outcome.isin("resolved", "gap")).alias("known"), F.when(outcome != "resolved", F.coalesce("reason", F.lit("not_found"))).alias("reason"))


def resolve_references(references: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, outcome, reason, node_id) of ``references(id, target, symbol)``: a cascade in which each failure has its reason.

    ``files(path, complete)`` (whether it was read in full), ``nodes(node_id, path, name, owner)``. A dotted symbol
    must have the owner path before its last part. Files that are known but incomplete give gaps.
    """
    from factloom.functions.paths import documented_path

    r = references.withColumn("path", documented_path(F.col("target"))).withColumn("name", F.substring_index("symbol", ".", -1))
    r = r.withColumn("within", F.when(F.col("symbol").contains("."), F.regexp_replace("symbol", r"\.[^.]*$", "")))
    d = r.join(files.select(F.col("path").alias("p"), "complete"), F.col("path") == F.col("p"), "left")
    n = nodes.select(F.col("path").alias("n_path"), F.col("name").alias("n_name"), "owner", "node_id")
    d = d.join(n, (F.col("p") == F.col("n_path")) & (F.col("name") == F.col("n_name")), "left")
    own = F.col("node_id").isNotNull() & (F.col("within").isNull() | (F.col("owner") == F.col("within")))
    g = d.groupBy("id").agg(
        F.first("target").alias("target"), F.first("symbol").alias("symbol"), F.first("path").alias("path"), F.first("p").alias("p"), F.first("complete").alias("complete"),
        F.count("node_id").alias("named"), F.count_if(own).alias("fit"), F.min(F.when(own, F.col("node_id"))).alias("node_id"),
    )
    say = lambda o, why, node=None: F.struct(F.lit(o).alias("outcome"), F.lit(why).cast("string").alias("reason"), (F.col(node) if node else F.lit(None)).cast("bigint").alias("node_id"))
    out = (
        F.when(F.col("path").isNull(), say("unresolved", "invalid_path")).when(F.col("p").isNull(), say("unresolved", "file_not_found")).when(F.col("symbol").isNull(), say("resolved", None)).when(~F.col("complete"), say("gap", "file_incomplete"))
        .when(F.col("named") == 0, say("unresolved", "symbol_not_found")).when(F.col("fit") == 0, say("unresolved", "owner_not_found")).when(F.col("fit") > 1, say("gap", "symbol_ambiguous")).otherwise(say("resolved", None, "node_id"))
    )
    return g.select("id", out.alias("o")).select("id", "o.*")


def history_paths(references: DataFrame, most: int = 64) -> DataFrame:
    """Distinct paths (documents and targets) of the first ``most`` resolved references, by file and position."""
    first = references.where("resolved").orderBy("file", "start", "target").limit(most)
    return first.select(F.explode(F.array("file", "target")).alias("path")).where("path is not null").distinct()


def line_changes(ranges: DataFrame, history: DataFrame) -> DataFrame:
    """(id, commit): of ``ranges(id, path, first, last)`` the latest commit that touched one of the lines.

    ``history(path, line_no, commit, seq)`` is joined by line: a range has a row for each of its lines.
    """
    each = ranges.select("id", "path", F.explode(F.sequence("first", "last")).alias("line_no"))
    return each.join(history, ["path", "line_no"]).groupBy("id").agg(F.max_by("commit", "seq").alias("commit"))


def section_of(nodes: DataFrame) -> DataFrame:
    """(node_id, section_id): the nearest ancestor that is a section, of ``nodes(node_id, parent, kind)``. Pointers double."""
    kinds = nodes.select(F.col("node_id").alias("k"), F.col("kind").alias("up_kind"))
    n = nodes.select("node_id", F.col("parent").alias("up"))
    n = written(n.join(kinds, n.up == kinds.k, "left").select("node_id", F.when(F.col("up_kind") == "doc_section", F.col("up")).alias("section_id"), F.when(F.col("up_kind") != "doc_section", F.col("up")).alias("at")))

    def jump(n: DataFrame) -> DataFrame:
        above = n.select(F.col("node_id").alias("x"), F.col("section_id").alias("x_section"), F.col("at").alias("x_at"))
        section = F.coalesce("section_id", "x_section")
        return n.join(above, n["at"] == above.x, "left").select("node_id", section.alias("section_id"), F.when(section.isNull(), F.col("x_at")).alias("at"))

    return doubled(n, jump, "at").select("node_id", "section_id")


def report_diagnostics(diagnostics: DataFrame, unproven: DataFrame) -> DataFrame:
    """(code, classification, surface, file, severity): evidence diagnostics but unresolved references, and claims that nothing proves."""
    d = diagnostics.where("code <> 'unresolved_reference'").select("code", codes.diagnostic_class(F.col("code")).alias("classification"), codes.diagnostic_surface(F.col("code")).alias("surface"), "file", F.lit("warning").alias("severity"))
    u = unproven.select(F.lit("docs_claim_unverified").alias("code"), F.lit("truth_source_gap").alias("classification"), F.lit("docs.claims").alias("surface"), "file", F.lit("warning").alias("severity"))
    return d.unionByName(u)


def report_cards(drifts: DataFrame, diagnostics: DataFrame, stale: DataFrame) -> DataFrame:
    """Cards of contract drifts, unresolved references and stale claims, each (file, evidence_id), ready to be clustered."""
    card = lambda t, kind, surface, severity: t.select(
        F.lit(kind).alias("kind"), F.lit("silent_divergence").alias("classification"), F.lit(surface).alias("graph_surface"), F.lit("documentation").alias("truth_source"), F.lit(kind).alias("diagnostic_code"),
        F.lit("docs_truth").alias("suspected_subsystem"), F.lit(1).alias("occurrence_count"), F.col("file").alias("path"), "evidence_id", F.lit(severity).alias("severity"),
    )
    out = card(drifts, "docs_return_contract_mismatch", "docs.return_contracts", "high").unionByName(card(diagnostics.where("code = 'unresolved_reference'"), "docs_code_reference_unresolved", "docs.code_refs", "medium"))
    return out.unionByName(card(stale, "docs_claim_stale", "docs.claims", "medium"))


def render(scorecard: DataFrame, drifts: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(place, line): the report as lines of Markdown: the scorecard's columns, then drifts, then diagnostics, each sorted."""
    head = scorecard.select(F.explode(F.array(*[F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for c in scorecard.columns])).alias("line")).select(F.lit(1).alias("part"), "line")
    rows = lambda t, part, text: t.select(F.lit(part).alias("part"), text.alias("line"))
    d = rows(drifts, 3, F.concat(F.lit("- `"), "file", F.lit("`: expected `"), "expected", F.lit("`, found `"), "actual", F.lit("`")))
    g = rows(diagnostics, 5, F.concat(F.lit("- `"), "file", F.lit("`: "), "code"))
    titles = scorecard.sparkSession.createDataFrame([(0, "# Documentation truth"), (2, "## Drifts"), (4, "## Diagnostics")], "part int, line string")
    every = titles.unionByName(head).unionByName(d).unionByName(g)
    return numbered(every, "part", "line").select("place", "line")


def within_bytes(rows: DataFrame, most: int) -> DataFrame:
    """``rows(line)`` as they are; raises if their bytes (with line ends) are over ``most``: nothing is cut."""
    total = rows.select((F.octet_length("line") + 1).alias("n")).agg(F.sum("n").alias("n")).scalar()
    return rows.withColumn("line", F.when(total <= most, F.col("line")).otherwise(F.raise_error(F.lit(f"output over {most} bytes")).cast("string")))


def within_rows(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` as they are; raises when they are read if there are more than ``most``: nothing is cut."""
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    first = rows.columns[0]
    return rows.withColumn(first, F.when(n <= most, F.col(first)).otherwise(F.raise_error(F.lit(f"over {most} rows")).cast(rows.schema[first].dataType)))


# Pressure that a declaration's users put on its type.


def pressure(kind: Column, line: Column, name: Column) -> Column:
    """struct(level, reason) of a use by its edge kind and source line; null for kinds that put none."""
    say = lambda level, reason: F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))
    named = tx.mentions_identifier(line, name)
    layer = line.contains("Layer") | line.contains("Effect") | line.contains("Context.Tag")
    whole = lambda before, after="": F.rlike(line, F.concat(F.lit(before + r"(?<![A-Za-z0-9_$])\Q"), name, F.lit(r"\E(?![A-Za-z0-9_$])" + after)))
    keyof = tx.mentions_identifier(line, F.lit("keyof"))
    of_type = (
        F.when(line.contains("satisfies") & layer, say("high", "satisfies_layer_provider_type_contract")).when(line.contains("satisfies"), say("high", "satisfies_type_contract")).when(layer, say("high", "layer_provider_type_contract"))
        .when(named & line.contains(" extends ") & line.contains("?"), say("high", "conditional_type_contract")).when(named & (keyof | whole("", r"\s*\[")), say("high", "mapped_keyof_indexed_type_contract"))
        .when(named & line.contains("<") & line.contains(">") & line.contains(" extends "), say("high", "generic_constraint")).when(whole(r"\)\s*:\s*"), say("high", "return_type_contract")).when(whole(r":\s*"), say("medium", "parameter_property_annotation"))
        .when(line.contains("<") & line.contains(">"), say("medium", "generic_type_argument")).otherwise(say("low", "type_reference"))
    )
    return F.when(kind.isin("extends", "implements"), say("high", "heritage_contract")).when(kind == "type_ref", of_type)


def pressure_rows(uses: DataFrame) -> DataFrame:
    """(file, line_no, level, reason) of ``uses(file, line_no, kind, line, name, seq)``, each once, the first by seq."""
    d = uses.withColumn("p", pressure(F.col("kind"), F.col("line"), F.col("name"))).where("p is not null")
    return d.groupBy("file", "line_no", "p.level", "p.reason").agg(F.min("seq").alias("seq"))


def service_calls(bindings: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, line_no, binding, method): calls ``binding.method(`` in a file that has the binding, in an equi join on both.

    ``bindings(file, binding)``; a line's member calls are taken from it once, whatever the number of bindings.
    """
    calls = F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][\w$]*\.[A-Za-z_$][\w$]*)\s*\("), F.lit(1))
    c = lines.select("file", "line_no", F.explode(calls).alias("call")).select("file", "line_no", F.split_part("call", F.lit("."), F.lit(1)).alias("binding"), F.split_part("call", F.lit("."), F.lit(2)).alias("method"))
    return c.join(bindings.select("file", "binding").distinct(), ["file", "binding"]).select("file", "line_no", "binding", "method").distinct()


def provider_context(calls: DataFrame, providers: DataFrame, compositions: DataFrame) -> DataFrame:
    """(file, line_no, provider, status) of dispatch calls: composed where a composition of the provider is in the file; else the first provider, missing.

    ``calls(file, line_no, service)``, ``providers(service, provider)``, ``compositions(file, provider)``.
    """
    met = calls.join(providers, "service").join(compositions.select("file", "provider", F.lit(True).alias("composed")).distinct(), ["file", "provider"], "left")
    g = met.groupBy("file", "line_no", "service").agg(F.array_sort(F.collect_set(F.when(F.col("composed"), F.col("provider")))).alias("found"), F.min("provider").alias("first"))
    some = F.size("found") > 0
    return g.select("file", "line_no", F.explode(F.when(some, F.col("found")).otherwise(F.array("first"))).alias("provider"), F.when(some, "composed").otherwise("missing_composition").alias("status"))
