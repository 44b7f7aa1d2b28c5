"""Paths: normal forms, languages and roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names, extensions and the path components that tell a role.
VERSION_CONTROL = (".git", ".hg", ".svn")
GENERATED = (".venv", "__pycache__", "build", "coverage", "dist", "node_modules", "target", "venv")
LANGUAGES = {"typescript": ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"), "rust": ("rs",), "python": ("py", "pyi")}
GENERATED_PARTS = ("generated", "__generated__", "codegen", "gen", "autogen")
ROLES = (
    ("calibration_sample", ("calibration", "calibrations", "calibration-samples", "calibration_samples")),
    ("corpus", ("corpus", "corpora", "experiment", "experiments", "eval", "evals", "evaluation", "golden", "goldens", "snapshot", "snapshots", "testdata", "test_data")),
    ("benchmark", ("bench", "benches", "benchmark", "benchmarks", "perf", "performance")),
    ("vendor_fixture", ("fixture", "fixtures", "__fixtures__", "vendor", "vendors", "node_modules", "third_party", "third-party", "external")),
    ("contract_test", ("test", "tests", "__tests__", "spec", "specs")),
)
# End of fixed values.


def _any(parts: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(parts, F.array(*map(F.lit, names)))


def directory_kind(name: Column) -> Column:
    """history for version control, generated for build output, else null."""
    return F.when(name.isin(*VERSION_CONTROL), "history").when(name.isin(*GENERATED), "generated")


def extension(path: Column) -> Column:
    """The lower-case extension of the last component, null without one (a leading dot makes none)."""
    return F.nullif(F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)), F.lit(""))


def language(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, ends in LANGUAGES.items():
        out = F.when(extension(path).isin(*ends), name).otherwise(out)
    return out


def source_role(path: Column) -> Column:
    """The first role whose marks the components show; product if none does."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    out = F.when(_any(parts, GENERATED_PARTS) | name.rlike(r"\.(generated|gen)\.|_generated\.(rs|py)$|\.pb\.rs$"), "generated")
    for role, names in ROLES:
        test = _any(parts, names)
        if role == "vendor_fixture":
            test = test | F.exists(parts, lambda c: c.rlike("[_-]fixtures?$"))
        if role == "contract_test":
            test = test | name.rlike(r"(\.(test|spec)\.tsx?|_test\.(rs|py))$")
        out = out.when(test, role)
    return out.otherwise("product")


def role_in_profile(role: Column, profile: str) -> Column:
    """product: product code and its tests; corpus: all else; all: every role."""
    own = role.isin("product", "contract_test")
    return {"product": own, "corpus": ~own, "all": F.lit(True)}[profile]


def has_hidden_component(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.startswith(".") & ~s.isin(".", ".."))


def has_skipped_component(path: Column) -> Column:
    return _any(F.split(path, "/"), VERSION_CONTROL + GENERATED)


def admitted_shape(path: Column) -> Column:
    """A relative path of plain components, none of them hidden or skipped."""
    plain = ~path.startswith("/") & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    return plain & ~has_hidden_component(path) & ~has_skipped_component(path)


def glob_match(pattern: Column, text: Column) -> Column:
    """Whole-string match of a pattern with ``*`` and ``?``; all else stands for itself."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.rlike(text, F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$")))


def is_ancestor(directory: Column, file: Column) -> Column:
    return (directory == "./") | file.startswith(F.concat(F.rtrim(directory, F.lit("/")), F.lit("/")))


def is_relative_specifier(s: Column) -> Column:
    return s.rlike(r"^\.{1,2}(/|$)")


def is_external_uri(s: Column) -> Column:
    return s.rlike("^(data:|file://|https?://)")


def _fold(parts: Column) -> Column:
    """struct(hops, parts) of components with ``..`` taken back where there is something to take back."""
    start = F.struct(F.lit(0).alias("hops"), F.array().cast("array<string>").alias("parts"))
    back = lambda a: F.when(F.size(a["parts"]) > 0, F.struct(a["hops"].alias("hops"), F.slice(a["parts"], 1, F.greatest(F.size(a["parts"]) - 1, F.lit(0))).alias("parts"))).otherwise(F.struct((a["hops"] + 1).alias("hops"), a["parts"].alias("parts")))
    steps = F.aggregate(parts, start, lambda a, s: F.when(s.isin("", "."), a).when(s == "..", back(a)).otherwise(F.struct(a["hops"].alias("hops"), F.concat(a["parts"], F.array(s)).alias("parts"))))
    # Most paths take nothing back, and need no steps.
    return F.when(~F.array_contains(parts, ".."), F.struct(F.lit(0).alias("hops"), F.array_remove(F.array_remove(parts, ""), ".").alias("parts"))).otherwise(steps)


def normalize(path: Column) -> Column:
    """``./``-prefixed, without ``.`` and inner ``..``; leading ``..`` that leave the root stay."""
    f = _fold(F.split(path, "/"))
    return F.concat(F.lit("./"), F.array_join(F.concat(F.array_repeat(F.lit(".."), f["hops"]), f["parts"]), "/"))


def canonical_relative(raw: Column) -> Column:
    """The path itself if it is relative, with ``/`` and plain components; else null."""
    bad = raw.startswith("/") | raw.contains("\\") | F.exists(F.split(raw, "/"), lambda s: s.isin("", ".", ".."))
    return F.when(~bad, raw)


def marker(path: Column) -> Column:
    """A role marker's path: ``./``, ``/**``, ``/*`` and outer slashes taken off."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return F.btrim(F.regexp_replace(p, r"/\*{1,2}$", ""), F.lit("/"))


def same_relative(a: Column, b: Column) -> Column:
    return F.regexp_replace(a, r"^\./", "") == F.regexp_replace(b, r"^\./", "")


def documented_path(path: Column) -> Column:
    """A documented path without ``./``; null if absolute, with ``\\`` or ``:``, or with other than plain components."""
    p = F.regexp_replace(path, r"^\./", "")
    bad = (p == "") | p.startswith("/") | p.contains("\\") | p.contains(":") | F.exists(F.split(p, "/"), lambda s: s.isin(".", "..", ""))
    return F.when(~bad, p)
