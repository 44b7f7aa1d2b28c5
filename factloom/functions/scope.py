"""Write scopes: struct(kind, hops, parts) with kind repo, none, path or cross; null if the claim can't be read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.paths import _fold

# Claims of no write authority.
NO_WRITE = ("none", "no-write", "read-only", "readonly")
# End of fixed values.


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: inside a lambda, where common subexpressions aren't shared."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _scope(kind: str, hops: Column | None = None, parts: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (hops if hops is not None else F.lit(0)).alias("hops"), (parts if parts is not None else F.array().cast("array<string>")).alias("parts"))


def parse(raw: Column) -> Column:
    """A claim's scope. Empty, absolute and self-cancelling claims are null."""
    t = F.replace(F.trim(raw), F.lit("\\"), F.lit("/"))

    def kind(x: Column) -> Column:
        t, f = x["t"], x["f"]
        bare = F.rtrim(F.regexp_replace(t, r"^(\./)+", ""), F.lit("/"))
        absolute = t.startswith("/") | t.rlike("^[A-Za-z]:")
        return (
            F.when(t.isin(".", "/"), _scope("repo")).when((t == "") | (bare == ""), None).when(F.lower(bare).isin(*NO_WRITE), _scope("none"))
            .when(absolute, None).when(f["hops"] > 0, _scope("cross", f["hops"], f["parts"])).when(F.size(f["parts"]) > 0, _scope("path", None, f["parts"]))
        )

    return let(F.struct(t.alias("t"), _fold(F.split(t, "/")).alias("f")), kind)


def from_file(raw: Column) -> Column:
    """A file's scope; null for empty and absolute paths and those that leave the repository."""
    t = F.replace(raw, F.lit("\\"), F.lit("/"))

    def kind(x: Column) -> Column:
        t, f = x["t"], x["f"]
        bad = (t == "") | t.startswith("/") | t.rlike("^[A-Za-z]:") | (f["hops"] > 0)
        return F.when(~bad & (F.size(f["parts"]) > 0), _scope("path", None, f["parts"]))

    return let(F.struct(t.alias("t"), _fold(F.split(t, "/")).alias("f")), kind)


def text(s: Column) -> Column:
    return let(s, _text)


def _text(s: Column) -> Column:
    return F.when(s["kind"] == "repo", ".").when(s["kind"] == "none", "none").when(s["kind"].isNotNull(), F.array_join(F.concat(F.array_repeat(F.lit(".."), s["hops"]), s["parts"]), "/"))


def _prefix(a: Column, b: Column) -> Column:
    return (F.size(a) <= F.size(b)) & (F.slice(b, 1, F.size(a)) == a)


def overlaps(a: Column, b: Column) -> Column:
    """Symmetric. Null if either can't be read."""
    return _of(_overlaps, a, b)


def covers(a: Column, b: Column) -> Column:
    """Whether permission ``a`` includes ``b``. Null if either can't be read."""
    return _of(_covers, a, b)


def _overlaps(a: Column, b: Column) -> Column:
    either = lambda k: (a["kind"] == k) | (b["kind"] == k)
    met = _prefix(a["parts"], b["parts"]) | _prefix(b["parts"], a["parts"])
    return (
        F.when(a.isNull() | b.isNull(), None).when(either("none"), False).when(either("repo") & either("cross"), False).when(either("repo"), True)
        .when((a["kind"] == "cross") & (b["kind"] == "cross"), (a["hops"] != b["hops"]) | met).when(either("cross"), False).otherwise(met)
    )


def _covers(a: Column, b: Column) -> Column:
    inside = _prefix(a["parts"], b["parts"])
    return (
        F.when(a.isNull() | b.isNull(), None).when((a["kind"] == "none") | (b["kind"] == "none"), False).when(a["kind"] == "repo", b["kind"] != "cross").when(b["kind"] == "repo", False)
        .when(a["kind"] == b["kind"], (a["hops"] == b["hops"]) & inside).otherwise(False)
    )


def _of(test: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: test(x["a"], x["b"]))


def claims_overlap(a: Column, b: Column) -> Column:
    """Of raw claims: one that can't be read is a conflict."""
    return F.coalesce(_of(_overlaps, parse(a), parse(b)), F.lit(True))


def overlap_if_readable(a: Column, b: Column) -> Column:
    return F.coalesce(_of(_overlaps, parse(a), parse(b)), F.lit(False))


def overlap_fail_closed(a: Column, b: Column) -> Column:
    """Of effective claims: a claim of no writes is no conflict, one that can't be read is."""
    none = lambda c: F.coalesce(parse(c)["kind"] == "none", F.lit(False)) | (F.trim(c) == "")
    return F.when(none(a) | none(b), False).otherwise(claims_overlap(a, b))


def grants(claim: Column, path: Column) -> Column:
    return F.coalesce(_of(_covers, parse(claim), from_file(path)), F.lit(False))


def touches(claim: Column, path: Column) -> Column:
    return F.coalesce(_of(_covers, parse(claim), from_file(path)), F.lit(True))


def normalized(claims: Column) -> Column:
    """An array of claims in normal form, first seen first, without claims of no writes; unreadable ones stay trimmed."""
    named = F.transform(claims, lambda c: F.coalesce(text(parse(c)), F.trim(c)))
    return F.array_distinct(F.filter(named, lambda c: ~c.isin("none", "")))


def allows(have: Column, want: Column) -> Column:
    """Arrays of claims: every wanted scope but no-write is covered by one that is had."""
    own, wanted = F.transform(have, parse), F.filter(F.transform(want, parse), lambda c: F.coalesce(c["kind"] != "none", F.lit(True)))
    return let(own, lambda h: F.forall(wanted, lambda r: F.exists(h, lambda a: F.coalesce(_covers(a, r), F.lit(False)))))


def writes_nothing(claims: Column) -> Column:
    """Of an array of claims: whether all of them (or none at all) are claims of no writes."""
    return F.forall(claims, lambda c: F.coalesce(parse(c)["kind"] == "none", F.lit(False)))


def crosses(claims: Column) -> Column:
    """Whether one of the claims leaves the repository."""
    return F.exists(claims, lambda c: F.coalesce(parse(c)["kind"] == "cross", F.lit(False)))


def first_overlap(left: Column, right: Column) -> Column:
    """struct(left, right): the first pair of readable claims that overlap, in the order of the left ones, then the right; else null."""
    read = lambda claims: F.transform(claims, lambda c: F.struct(c.alias("claim"), parse(c).alias("scope")))
    hit = let(read(right), lambda r: F.flatten(F.transform(read(left), lambda a: F.transform(F.filter(r, lambda b: F.coalesce(_overlaps(a["scope"], b["scope"]), F.lit(False))), lambda b: F.struct(a["claim"].alias("left"), b["claim"].alias("right"))))))
    return F.get(hit, F.lit(0))
