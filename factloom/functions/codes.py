"""Fixed vocabularies, checks of identifiers and numbers, and hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, kinds of fact and the surfaces of each language.
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}
NODE_LIKE = ("node", "span", "kind", "owner", "route", "query", "test")
PLURAL = ("import", "export", "call", "type_ref", "module_ref", "cross_file_dependent", "route", "query", "test")
SURFACES = {
    "typescript": ("imports", "exports", "calls", "type_refs", "module_refs", "cross_file_dependents", "routes", "queries"),
    "rust": ("imports", "calls", "type_refs", "module_refs", "items", "packages", "macro_expansion", "tests"),
    "python": ("imports", "exports", "calls", "type_refs", "module_refs", "cross_file_dependents", "routes", "queries", "tests"),
}
RUST_ITEMS = ("item", "items", "module", "impl", "struct", "union", "enum", "trait", "type", "type_alias", "function", "const", "static", "extern_block", "macro", "associated_type", "associated_const", "method")
RUST_PACKAGES = ("package", "packages", "cargo_package", "cargo_packages", "cargo_target:lib", "cargo_target")
EDGE_FACTS = {"imports": "import", "exports": "export", "calls": "call", "type_ref": "type_ref", "type_refs": "type_ref", "module_ref": "module_ref", "module_refs": "module_ref", "cross_file_dependent": "cross_file_dependent", "cross_file_dependents": "cross_file_dependent"}
# End of fixed values.


def by(c: Column, table: dict, default: object = None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def severity_weight(c: Column) -> Column:
    return by(c, SEVERITY, 0)


def status_confidence(c: Column) -> Column:
    return F.when(c.isin("verified", "contradicted"), "high").when(c == "unverified", "medium").when(c.isin("stale", "unknown", "unsupported"), "low")


def diagnostic_class(c: Column) -> Column:
    return (
        F.when(c == "document_excluded", "coverage_exclusion").when(c == "unresolved_reference", "silent_divergence")
        .when(c.isin("unsupported_contract_target", "unsupported_format", "unsupported_reference_language", "unsupported_syntax"), "unsupported_construct").otherwise("truth_source_gap")
    )


def diagnostic_surface(c: Column) -> Column:
    contracts = c.startswith("contract_source_re") | (c == "unsupported_contract_target")
    return F.when(contracts, "docs.return_contracts").when(c.isin("code_reference_unverifiable", "unresolved_reference", "unsupported_reference_language"), "docs.code_refs").otherwise("docs.claims")


def edge_fact_kind(c: Column) -> Column:
    return by(c, EDGE_FACTS, "edge")


def surface(language: Column, kind: Column) -> Column:
    """The capability that a fact kind belongs to in a language, else null. Singular and plural kinds are alike."""
    name = kind
    for k in PLURAL:
        many = k[:-1] + "ies" if k.endswith("y") else k + "s"
        name = F.when(kind == k, many).otherwise(name)
    name = F.when((language == "rust") & kind.isin(*RUST_ITEMS), "items").when((language == "rust") & kind.isin(*RUST_PACKAGES), "packages").when(kind.isin("macro_expansion", "macro_expansions"), "macro_expansion").otherwise(name)
    out = F.lit(None).cast("string")
    for lang, names in SURFACES.items():
        out = F.when((language == lang) & name.isin(*names), F.concat(F.lit(lang + "."), name)).otherwise(out)
    return out


def is_commit(c: Column) -> Column:
    return c.rlike("^[0-9A-Fa-f]{40}$")


def is_identifier(c: Column) -> Column:
    return c.rlike("^[a-z][a-z0-9_-]{0,63}$")


def is_model_identifier(c: Column) -> Column:
    return c.rlike("^[a-z][a-z0-9_.-]{0,127}$")


def is_safe_id(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9][A-Za-z0-9_.-]{0,95}$")


def is_probability(c: Column) -> Column:
    return F.coalesce(c.between(0, 1) & ~F.isnan(c), F.lit(False))


def nano(v: Column) -> Column:
    """A double as a whole number of billionths, half to even; null if not finite or beyond 2^53 - 1."""
    scaled = F.rint(v * 1e9)
    return F.when(F.abs(scaled) <= 9007199254740991.0, scaled.cast("bigint"))


def identity_parts(c: Column) -> Column:
    """struct(algorithm, scheme, digest) of ``algorithm:scheme:hex``, else null."""
    part = lambda i: F.regexp_extract(c, r"^([^:]+):([^:]+):([0-9a-f]+)$", i)
    return F.when(part(1) != "", F.struct(part(1).alias("algorithm"), part(2).alias("scheme"), part(3).alias("digest")))


def source_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def absence_evidence(*parts: Column) -> Column:
    """SHA-256 of the parts, each ended by NUL."""
    return F.sha2(F.concat(*[F.concat(p, F.lit("\0")) for p in parts]), 256)


def _fnv1a(content: pd.Series) -> pd.Series:
    """All texts at once, longest first: a step takes the next byte of those that have one."""
    raw = [None if x is None else x.encode() if isinstance(x, str) else bytes(x) for x in content]
    order = sorted((i for i, x in enumerate(raw) if x is not None), key=lambda i: -len(raw[i]))
    lengths = np.array([len(raw[i]) for i in order], np.int64)
    flat = np.frombuffer(b"".join(raw[i] for i in order), np.uint8).astype(np.uint64)
    starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)[:-1])) if len(order) else lengths
    h = np.full(len(order), 0xCBF29CE484222325, np.uint64)
    k, steps = len(order), int(lengths[0]) if len(order) else 0
    for step in range(steps):
        while lengths[k - 1] <= step:
            k -= 1
        h[:k] = (h[:k] ^ flat[starts[:k] + step]) * np.uint64(0x100000001B3)
    out: list[str | None] = [None] * len(raw)
    for i, x in zip(order, h.tolist(), strict=True):
        out[i] = f"{x:016x}"
    return pd.Series(out, index=content.index, dtype=object)


def fnv1a(content: Column) -> Column:
    """FNV-1a (64 bits) of a string's UTF-8 or of bytes, as 16 hex digits. Spark's 64-bit product would overflow."""
    return F.pandas_udf(_fnv1a, "string")(content)


def freshness(section: Column, reference: Column, order: Column) -> Column:
    """struct(freshness, reason) of two change ids and their order."""
    say = lambda a, b: F.struct(F.lit(a).alias("freshness"), F.lit(b).alias("reason"))
    odd = lambda c: ~F.octet_length(c).between(1, 256)
    same = section == reference
    return (
        F.when(section.isNull() | reference.isNull(), say("unknown", "history_unavailable")).when(odd(section) | odd(reference), say("unknown", "invalid_change_identity"))
        .when(same & (order == "same_change"), say("fresh", "same_change")).when(~same & (order == "section_before_reference"), say("stale", "reference_changed_after_section"))
        .when(~same & (order == "reference_before_section"), say("fresh", "section_changed_after_reference")).when(~same & (order == "diverged"), say("unknown", "diverged_history"))
        .when(~same & (order == "unknown"), say("unknown", "order_unavailable")).otherwise(say("unknown", "inconsistent_evidence"))
    )
