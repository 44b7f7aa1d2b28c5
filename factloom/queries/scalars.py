"""Scalar functions: each query applies one to a derived input; the SQL says the same in DuckDB's own words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import codes, paths, scope, text
from factloom.queries.inputs import FNV, load, with_views

c = F.col
joined = lambda a: F.array_join(a, "|")
_FOLD = "list_reduce(list_concat([''], string_split({p}, '/')), lambda a, s: CASE WHEN s IN ('', '.') THEN a WHEN s <> '..' THEN a || '/' || s WHEN a = '' OR ends_with(a, '/..') THEN a || '/..' ELSE regexp_replace(a, '/[^/]*$', '') END)"


def _clean(p: str) -> str:
    return f"trim(replace({p}, '\\', '/'))"


def _kind(p: str) -> str:
    t, f = _clean(p), _FOLD.format(p=_clean(p))
    bare = f"rtrim(regexp_replace({t}, '^(\\./)+', ''), '/')"
    return f"CASE WHEN {t} IN ('.', '/') THEN 'repo' WHEN {t} = '' OR {bare} = '' THEN NULL WHEN lower({bare}) IN ('none', 'no-write', 'read-only', 'readonly') THEN 'none' WHEN starts_with({t}, '/') OR regexp_matches({t}, '^[A-Za-z]:') THEN NULL WHEN starts_with({f}, '/..') THEN 'cross' WHEN {f} <> '' THEN 'path' END"


_SCOPES = f""", k AS (SELECT id, a, b, {_kind('a')} AS ka, {_kind('b')} AS kb, {_FOLD.format(p=_clean('a'))} AS fa, {_FOLD.format(p=_clean('b'))} AS fb FROM claims2),
h AS (SELECT *, len(regexp_extract_all(fa, '/\\.\\.')) AS ha, len(regexp_extract_all(fb, '/\\.\\.')) AS hb, starts_with(fb || '/', fa || '/') AS ab, starts_with(fa || '/', fb || '/') AS ba FROM k),
o AS (SELECT *, CASE WHEN ka IS NULL OR kb IS NULL THEN NULL WHEN 'none' IN (ka, kb) THEN false WHEN 'repo' IN (ka, kb) THEN 'cross' NOT IN (ka, kb) WHEN ka = 'cross' AND kb = 'cross' THEN ha <> hb OR ab OR ba WHEN 'cross' IN (ka, kb) THEN false ELSE ab OR ba END AS overlap,
  CASE WHEN ka IS NULL OR kb IS NULL THEN NULL WHEN 'none' IN (ka, kb) THEN false WHEN ka = 'repo' THEN kb <> 'cross' WHEN kb = 'repo' THEN false WHEN ka = kb THEN ha = hb AND ab ELSE false END AS cover FROM h)"""

#: name -> (input, {output: column}, {output: SQL} or whole SQL or None)
SPEC: dict[str, tuple[str, dict[str, Column | Callable[[], Column]], dict[str, str] | str | None]] = {}


def add(name: str, view: str, out: Callable[[], dict[str, Column]], sql: dict[str, str] | str | None) -> None:
    SPEC[name] = (view, out, sql)  # type: ignore[assignment]


_level = "CASE WHEN regexp_matches(line, '^#{1,6} ') THEN length(regexp_extract(line, '^#+')) END"
add("fn_heading", "md", lambda: {"level": text.heading_level(c("line")), "title": text.heading_text(c("line"))}, {"level": _level, "title": "CASE WHEN regexp_matches(line, '^#{1,6} ') THEN trim(substr(line, length(regexp_extract(line, '^#+')) + 1)) END"})
add("fn_task", "md", lambda: {"checked": text.task_checked(c("line"))}, {"checked": "CASE WHEN line LIKE '- [ ] %' OR line LIKE '* [ ] %' THEN false WHEN lower(line) LIKE '- [x] %' OR lower(line) LIKE '* [x] %' THEN true END"})
add("fn_requirement", "md", lambda: {"hit": text.is_requirement(c("line"))}, {"hit": "regexp_matches(line, '^([-*] )?(MUST |SHOULD |MAY |Requirement:)')"})
add("fn_ordered_item", "md", lambda: {"hit": text.is_ordered_item(c("line"))}, {"hit": "regexp_matches(line, '^[0-9]+[.] ')"})
add("fn_looks_like_claim", "md", lambda: {"hit": text.looks_like_claim(c("line"))}, {"hit": "line LIKE '%.' AND len(regexp_extract_all(line, '[^ ]+')) >= 4"})
add("fn_opening_fence", "md", lambda: {"mark": text.opening_fence(c("line"))["mark"], "width": text.opening_fence(c("line"))["width"]}, {"mark": "CASE WHEN regexp_matches(line, '^(`{3,}[^`]*$|~{3,})') THEN substr(line, 1, 1) END", "width": "CASE WHEN regexp_matches(line, '^(`{3,}[^`]*$|~{3,})') THEN length(regexp_extract(line, '^(`+|~+)')) END"})
add("fn_closing_fence", "md", lambda: {"hit": text.is_closing_fence(c("line"), F.lit("~"), F.lit(3))}, {"hit": "regexp_matches(line, '^~{3,}[ \t]*$')"})
add("fn_autolink", "md", lambda: {"hit": text.is_autolink(c("line"))}, {"hit": "regexp_matches(line, '^[A-Za-z][A-Za-z0-9+.-]{1,31}:[^ \t\n<>]*$') OR regexp_matches(line, '^[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?([.][A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$')"})
_file = "CASE WHEN {p} = '' OR starts_with({p}, '/') OR contains({p}, '..') OR contains({p}, '\\') OR contains({p}, ' ') THEN false ELSE contains({p}, '/') OR string_split({p}, '.')[-1] IN ('rs', 'ts', 'tsx', 'js', 'jsx', 'py', 'md', 'json', 'toml') END"
add("fn_file_ref", "paths", lambda: {"hit": text.is_file_ref(F.concat(c("path"), F.lit("#x")))}, {"hit": _file.format(p="path")})
add("fn_file_part", "paths", lambda: {"part": text.file_part(F.concat(c("path"), F.lit("#x#y")))}, {"part": "path"})
add("fn_identifier_path", "md", lambda: {"hit": text.is_identifier_path(F.replace(c("line"), F.lit(" "), F.lit(".")))}, {"hit": "regexp_full_match(replace(line, ' ', '.'), '[A-Za-z0-9_$]+([.][A-Za-z0-9_$]+)*')"})
add("fn_command", "md", lambda: {"hit": text.is_command(c("line"))}, {"hit": "regexp_extract(line, '[^ ]+') IN ('cargo', 'npm', 'pnpm', 'yarn', 'git', 'python', 'pytest', 'bash')"})
add("fn_code_reference", "paths", lambda: {"target": text.code_reference(F.concat(c("path"), F.when(c("id") % 2 == 0, "#a.b").otherwise("")))["target"], "symbol": text.code_reference(F.concat(c("path"), F.when(c("id") % 2 == 0, "#a.b").otherwise("")))["symbol"]}, {"target": f"CASE WHEN {_file.format(p='path')} THEN path END", "symbol": f"CASE WHEN id % 2 = 0 AND {_file.format(p='path')} THEN 'a.b' END"})
add("fn_inline_code_spans", "md", lambda: {"spans": joined(F.transform(text.inline_code_spans(c("line")), lambda s: F.concat_ws("@", s["code"], s["col"].cast("string"))))},
    """SELECT id, coalesce((SELECT string_agg(p[i] || '@' || (strlen(array_to_string(p[:i - 1], '`')) + 2), '|' ORDER BY i) FROM (SELECT unnest(range(2, len(p), 2)) AS i)), '') AS spans FROM (SELECT id, string_split(line, '`') AS p FROM md)""")
add("fn_return_contract", "md", lambda: {k: text.return_contract(c("line"))[k] for k in ("target", "symbol", "expected", "col")},
    """SELECT id, CASE WHEN ok THEN regexp_extract(line, '`([^#]*)#', 1) END AS target, CASE WHEN ok THEN 'f' END AS symbol, CASE WHEN ok THEN regexp_extract(line, 'returns `([^`]*)`', 1) END AS expected, CASE WHEN ok THEN strlen(string_split(line, 'Contract:')[1]) + 1 END AS col
    FROM (SELECT id, line, regexp_matches(line, 'Contract: `[^ `#]*/[^ `#]*#f` returns `') AS ok FROM md)""")
add("fn_section_words", "md", lambda: {"words": joined(text.section_words(c("line")))}, {"words": "array_to_string(list_transform(regexp_extract_all(line, '[A-Za-z0-9]+'), lambda x: lower(x)), '|')"})
add("fn_section_role", "md", lambda: {"role": text.section_role(c("line"))},
    """SELECT id, CASE WHEN list_has_any(w, ['requirement', 'requirements']) THEN 'requirements' WHEN list_has_any(w, ['adr', 'adrs']) OR (list_has_all(w, ['architecture', 'decision']) AND list_has_any(w, ['record', 'records'])) THEN 'adr'
    WHEN list_contains(w, 'api') AND list_has_any(w, ['contract', 'contracts']) THEN 'api_contract' WHEN list_has_any(w, ['runbook', 'runbooks']) THEN 'runbook' WHEN list_contains(w, 'architecture') THEN 'architecture' END AS role FROM (SELECT id, string_split(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g'), ' ') AS w FROM md)""")
add("fn_sanitize_id", "md", lambda: {"out": text.sanitize_id(c("line"))}, {"out": "regexp_replace(line, '[^A-Za-z0-9_-]', '_', 'g')"})
add("fn_id_fragment", "md", lambda: {"out": text.id_fragment(c("line"))}, {"out": "trim(regexp_replace(line, '[^A-Za-z0-9]', '-', 'g'), '-')"})
add("fn_is_escaped", "md", lambda: {"hit": text.is_escaped(F.concat(c("line"), F.repeat(F.lit("\\"), (c("id") % 4).cast("int"))))}, {"hit": "id % 2 = 1"})
add("fn_symbol_query", "md", lambda: {k: text.symbol_query(c("line"))[k] for k in ("name", "file", "line")}, """SELECT id, CASE WHEN ok THEN array_to_string(p[:-3], ':') ELSE line END AS name, CASE WHEN ok THEN p[-2] END AS file, CASE WHEN ok THEN p[-1]::BIGINT END AS line FROM (SELECT id, line, string_split(line, ':') AS p, regexp_matches(line, ':[^:]*:[0-9]+$') AS ok FROM md)""")
add("fn_mentions_identifier", "md", lambda: {"hit": text.mentions_identifier(c("line"), F.lit("f"))}, {"hit": "list_contains(regexp_extract_all(line, '[A-Za-z0-9_$]+'), 'f')"})

add("fn_directory_kind", "paths", lambda: {"kind": paths.directory_kind(F.split_part(c("path"), F.lit("/"), F.lit(2)))}, {"kind": "CASE WHEN string_split(path, '/')[2] IN ('.git', '.hg', '.svn') THEN 'history' WHEN string_split(path, '/')[2] IN ('node_modules', 'build', 'dist', 'target', 'coverage', 'venv', '.venv', '__pycache__') THEN 'generated' END"})
_ext = "lower(regexp_extract(path, '[^/][.]([^./]+)$', 1))"
add("fn_language", "paths", lambda: {"language": paths.language(c("path"))}, {"language": f"CASE WHEN {_ext} IN ('ts', 'tsx', 'js', 'jsx') THEN 'typescript' WHEN {_ext} = 'rs' THEN 'rust' WHEN {_ext} = 'py' THEN 'python' END"})
ROLE = """CASE WHEN list_contains(p, 'gen') OR regexp_matches(p[-1], '[.]gen[.]') THEN 'generated' WHEN list_has_any(p, ['bench', 'perf']) THEN 'benchmark'
    WHEN list_has_any(p, ['fixtures', 'node_modules', 'vendor']) OR len(list_filter(p, lambda x: regexp_matches(x, '[-_]fixtures?$'))) > 0 THEN 'vendor_fixture'
    WHEN list_contains(p, 'tests') OR regexp_matches(p[-1], '([.]test[.]tsx?|_test[.](py|rs))$') THEN 'contract_test' ELSE 'product' END"""
add("fn_source_role", "paths", lambda: {"role": paths.source_role(c("path"))}, f"SELECT id, {ROLE} AS role FROM (SELECT id, string_split(lower(path), '/') AS p FROM paths)")
add("fn_role_in_profile", "paths", lambda: {"product": paths.role_in_profile(paths.source_role(c("path")), "product"), "corpus": paths.role_in_profile(paths.source_role(c("path")), "corpus")}, f"SELECT id, r IN ('product', 'contract_test') AS product, r NOT IN ('product', 'contract_test') AS corpus FROM (SELECT id, {ROLE} AS r FROM (SELECT id, string_split(lower(path), '/') AS p FROM paths))")
add("fn_hidden", "paths", lambda: {"hit": paths.has_hidden_component(c("path"))}, {"hit": "len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.') AND x NOT IN ('.', '..'))) > 0"})
add("fn_skipped", "paths", lambda: {"hit": paths.has_skipped_component(c("path"))}, {"hit": "list_has_any(string_split(path, '/'), ['node_modules', 'build', 'dist', 'target', 'coverage', 'venv', '.venv', '__pycache__', '.git', '.hg', '.svn'])"})
add("fn_admitted_shape", "paths", lambda: {"hit": paths.admitted_shape(c("path"))}, {"hit": "NOT regexp_matches(path, '(^|/)([.]|$|node_modules/)') AND NOT contains(path, '//') AND NOT starts_with(path, '/')"})
add("fn_glob", "paths", lambda: {"hit": paths.glob_match(F.lit("*/*_?*.t?"), c("path")), "dot": paths.glob_match(F.lit("a.b*"), c("path"))}, {"hit": "path GLOB '*/*_?*.t?'", "dot": "path GLOB 'a.b*'"})
add("fn_ancestor", "paths", lambda: {"hit": paths.is_ancestor(F.lit("src/"), c("path"))}, {"hit": "starts_with(path, 'src/')"})
add("fn_relative_specifier", "paths", lambda: {"hit": paths.is_relative_specifier(c("path"))}, {"hit": "path IN ('.', '..') OR starts_with(path, './') OR starts_with(path, '../')"})
add("fn_external_uri", "pages", lambda: {"hit": paths.is_external_uri(c("url"))}, "SELECT page_id AS id, starts_with(url, 'http://') OR starts_with(url, 'https://') OR starts_with(url, 'data:') OR starts_with(url, 'file://') AS hit FROM pages")
add("fn_normalize_path", "paths", lambda: {"out": paths.normalize(c("path"))}, {"out": f"'.' || CASE WHEN {_FOLD.format(p='path')} = '' THEN '/' ELSE {_FOLD.format(p='path')} END"})
add("fn_canonical_relative", "paths", lambda: {"out": paths.canonical_relative(c("path"))}, {"out": "CASE WHEN NOT contains(path, '\\') AND NOT list_has_any(string_split(path, '/'), ['', '.', '..']) THEN path END"})
add("fn_marker", "paths", lambda: {"out": paths.marker(F.concat(c("path"), F.when(c("id") % 2 == 0, "/**").otherwise("/*")))}, {"out": "trim(regexp_replace(path, '^([.]/)+', ''), '/')"})
add("fn_same_relative", "paths", lambda: {"hit": paths.same_relative(c("path"), F.concat(F.lit("./"), c("path")))}, {"hit": "regexp_replace(path, '^[.]/', '') = path"})
add("fn_documented_path", "paths", lambda: {"out": paths.documented_path(c("path"))}, {"out": "CASE WHEN NOT list_has_any(string_split(regexp_replace(path, '^[.]/', ''), '/'), ['', '.', '..']) THEN regexp_replace(path, '^[.]/', '') END"})

_SCOPE = "claims2"
add("scope_parse", _SCOPE, lambda: {"kind": scope.parse(c("a"))["kind"], "hops": scope.parse(c("a"))["hops"], "normal": scope.text(scope.parse(c("a")))}, _SCOPES + " SELECT id, ka AS kind, CASE WHEN ka IS NULL THEN NULL WHEN ka = 'cross' THEN ha ELSE 0 END AS hops, CASE ka WHEN 'repo' THEN '.' WHEN 'none' THEN 'none' WHEN 'path' THEN fa[2:] WHEN 'cross' THEN fa[2:] END AS normal FROM o")
add("scope_overlaps", _SCOPE, lambda: {"hit": scope.overlaps(scope.parse(c("a")), scope.parse(c("b")))}, _SCOPES + " SELECT id, overlap AS hit FROM o")
add("scope_covers", _SCOPE, lambda: {"hit": scope.covers(scope.parse(c("a")), scope.parse(c("b")))}, _SCOPES + " SELECT id, cover AS hit FROM o")
add("scope_claims_overlap", _SCOPE, lambda: {"closed": scope.claims_overlap(c("a"), c("b")), "readable": scope.overlap_if_readable(c("a"), c("b"))}, _SCOPES + " SELECT id, coalesce(overlap, true) AS closed, coalesce(overlap, false) AS readable FROM o")
add("scope_fail_closed", _SCOPE, lambda: {"hit": scope.overlap_fail_closed(c("a"), c("b"))}, _SCOPES + " SELECT id, CASE WHEN coalesce(ka, '') = 'none' OR coalesce(kb, '') = 'none' OR trim(a) = '' OR trim(b) = '' THEN false ELSE coalesce(overlap, true) END AS hit FROM o")
_filed = "CASE WHEN b = '' OR starts_with(b, '/') OR starts_with(fb, '/..') OR fb = '' THEN NULL WHEN ka IS NULL THEN NULL WHEN ka = 'none' THEN false WHEN ka = 'repo' THEN true WHEN ka = 'path' THEN ab ELSE false END"
add("scope_grants", _SCOPE, lambda: {"grants": scope.grants(c("a"), c("b")), "touches": scope.touches(c("a"), c("b"))}, _SCOPES + f" SELECT id, coalesce({_filed}, false) AS grants, coalesce({_filed}, true) AS touches FROM o")
_norm = "CASE k{0} WHEN 'repo' THEN '.' WHEN 'none' THEN 'none' WHEN 'path' THEN f{0}[2:] WHEN 'cross' THEN f{0}[2:] ELSE trim({0}) END"
add("scope_normalized", _SCOPE, lambda: {"out": joined(scope.normalized(F.array("a", "b", "a")))}, _SCOPES + f", z AS (SELECT id, {_norm.format('a')} AS x, {_norm.format('b')} AS y FROM o) SELECT id, concat_ws('|', CASE WHEN x NOT IN ('', 'none') THEN x END, CASE WHEN y NOT IN ('', 'none') AND (y <> x) THEN y END) AS out FROM z")
add("scope_allows", _SCOPE, lambda: {"hit": scope.allows(F.array("a"), F.array("b", F.lit("none")))}, _SCOPES + " SELECT id, coalesce(kb = 'none', false) OR coalesce(cover, false) AS hit FROM o")

add("code_severity_weight", "codes", lambda: {"w": codes.severity_weight(c("severity"))}, {"w": "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"})
add("code_status_confidence", "codes", lambda: {"v": codes.status_confidence(c("status"))}, {"v": "CASE WHEN status IN ('verified', 'contradicted') THEN 'high' WHEN status = 'unverified' THEN 'medium' ELSE 'low' END"})
add("code_diagnostic_class", "codes", lambda: {"v": codes.diagnostic_class(c("diagnostic"))}, {"v": "CASE diagnostic WHEN 'document_excluded' THEN 'coverage_exclusion' WHEN 'unresolved_reference' THEN 'silent_divergence' WHEN 'x' THEN 'truth_source_gap' WHEN 'contract_source_read_failed' THEN 'truth_source_gap' WHEN 'code_reference_unverifiable' THEN 'truth_source_gap' ELSE 'unsupported_construct' END"})
add("code_diagnostic_surface", "codes", lambda: {"v": codes.diagnostic_surface(c("diagnostic"))}, {"v": "CASE WHEN diagnostic IN ('contract_source_read_failed', 'unsupported_contract_target') THEN 'docs.return_contracts' WHEN diagnostic LIKE '%reference%' THEN 'docs.code_refs' ELSE 'docs.claims' END"})
add("code_edge_fact_kind", "codes", lambda: {"v": codes.edge_fact_kind(c("graph_kind"))}, {"v": "CASE graph_kind WHEN 'contains' THEN 'edge' ELSE rtrim(graph_kind, 's') END"})
add("code_surface", "codes", lambda: {"v": codes.surface(c("language"), c("fact_kind"))}, {"v": """CASE language || '.' || fact_kind WHEN 'typescript.import' THEN 'typescript.imports' WHEN 'python.import' THEN 'python.imports' WHEN 'rust.import' THEN 'rust.imports' WHEN 'typescript.queries' THEN 'typescript.queries' WHEN 'python.queries' THEN 'python.queries'
    WHEN 'rust.struct' THEN 'rust.items' WHEN 'rust.tests' THEN 'rust.tests' WHEN 'python.tests' THEN 'python.tests' WHEN 'rust.package' THEN 'rust.packages' WHEN 'rust.macro_expansions' THEN 'rust.macro_expansion' WHEN 'typescript.exports' THEN 'typescript.exports' WHEN 'python.exports' THEN 'python.exports' END"""})
add("code_freshness", "codes", lambda: {k: codes.freshness(c("section"), c("reference"), c("change_order"))[k] for k in ("freshness", "reason")},
    """SELECT id, CASE reason WHEN 'same_change' THEN 'fresh' WHEN 'section_changed_after_reference' THEN 'fresh' WHEN 'reference_changed_after_section' THEN 'stale' ELSE 'unknown' END AS freshness, reason FROM (SELECT id,
    CASE WHEN section IS NULL OR reference IS NULL THEN 'history_unavailable' WHEN section = '' OR reference = '' THEN 'invalid_change_identity' WHEN (section = reference) <> (change_order = 'same_change') THEN 'inconsistent_evidence' WHEN change_order = 'same_change' THEN 'same_change'
    WHEN change_order = 'section_before_reference' THEN 'reference_changed_after_section' WHEN change_order = 'reference_before_section' THEN 'section_changed_after_reference' WHEN change_order = 'diverged' THEN 'diverged_history' ELSE 'order_unavailable' END AS reason FROM codes)""")
add("code_identifiers", "md", lambda: {"hash_is_commit": codes.is_commit(F.sha1("line")), "identifier": codes.is_identifier(F.split_part(c("line"), F.lit(" "), F.lit(1))), "model": codes.is_model_identifier(F.split_part(c("line"), F.lit(" "), F.lit(1))), "safe": codes.is_safe_id(c("line"))},
    {"hash_is_commit": "true", "identifier": "regexp_full_match(string_split(line, ' ')[1], '[a-z][a-z0-9_-]{0,63}')", "model": "regexp_full_match(string_split(line, ' ')[1], '[a-z][a-z0-9_.-]{0,127}')", "safe": "regexp_full_match(line, '[A-Za-z0-9][A-Za-z0-9_.-]{0,95}')"})
add("code_probability", "codes", lambda: {"hit": codes.is_probability(c("price") / 100000)}, {"hit": "price / 100000 BETWEEN 0 AND 1"})
add("code_nano", "codes", lambda: {"nano": codes.nano(c("price"))}, {"nano": "CASE WHEN abs(round_even(price * 1e9, 0)) <= 9007199254740991 THEN CAST(round_even(price * 1e9, 0) AS BIGINT) END"})
add("code_identity_parts", "codes", lambda: {k: codes.identity_parts(F.when(c("id") % 2 == 0, F.concat(F.lit("sha256:v1:"), F.hex("id"))).otherwise(F.concat(F.lit("sha256:v1:"), F.lower(F.hex("id")))))[k] for k in ("algorithm", "scheme", "digest")}, """SELECT id, CASE WHEN ok THEN 'sha256' END AS algorithm, CASE WHEN ok THEN 'v1' END AS scheme, CASE WHEN ok THEN lower(printf('%x', id)) END AS digest FROM (SELECT id, id % 2 = 1 OR NOT regexp_matches(printf('%X', id), '[A-F]') AS ok FROM codes)""")
add("code_source_hash", "sources", lambda: {"hash": codes.source_hash(c("source"))}, "SELECT file AS id, 'sha256:' || sha256(source) AS hash FROM sources")
add("code_absence_evidence", "paths", lambda: {"hash": codes.absence_evidence(F.lit("sha"), F.lit("clean"), c("path"))}, {"hash": "sha256('sha' || chr(0) || 'clean' || chr(0) || path || chr(0))"})
add("code_fnv1a", "paths", lambda: {"hash": codes.fnv1a(c("path"))}, f"SELECT id, lpad(lower(to_hex({FNV.format('hex(path)')})), 16, '0') AS hash FROM paths")


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        view, out, _ = SPEC[name]
        d = load(spark, sf_dir, view)
        key = {"pages": "page_id", "sources": "file"}.get(view, "id")
        return d.select(F.col(key).alias("id"), *[v.alias(k) for k, v in out().items()])  # type: ignore[operator]

    return run


def _sql(name: str) -> str | None:
    view, _, sql = SPEC[name]
    if sql is None:
        return None
    if isinstance(sql, dict):
        sql = "SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in sql.items()) + f" FROM {view}"
    return sql if view == "pages" else with_views(sql, view)


QUERIES = {n: _query(n) for n in SPEC}
ORACLE_SQL = {n: s for n in SPEC if (s := _sql(n))}
