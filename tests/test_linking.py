"""Linking of small projects, told by hand."""

import pytest

from factloom.operators import linking
from factloom.sources import code

FILES = {
    "a.ts": "export function f() {}\nexport class C { run() { f(); } }\nfunction hidden() {}\nexport default C;\nexport const v = 1;\n",
    "b.ts": "export { f as g, C } from './a';\nexport * from './c';\nexport * as space from './a';\nexport { default as D } from './a';\n",
    "c.ts": "import { f } from './a';\nexport { f as again };\nexport function C() {}\nexport function only() {}\nexport * from './b';\n",
    "d.ts": "export * from './b';\nexport * from './e';\n",
    "e.ts": "export function only() {}\nexport function mine() {}\nexport { lost } from './none';\nexport { x } from './x';\n",
    "x.ts": "export { x } from './e';\n",
    "m.ts": "import Base, { g as h, only } from './b';\nimport * as all from './d';\nimport D from './a';\nimport { space } from './b';\nimport pkg from 'pkg';\n"
    "class K extends D implements all.C { go() { function h() {} h(); } }\nh(); only(); all.mine(); all.nothing(); all.g(); space.v(); space.f(); pkg(); K(); hidden(); Base();\n",
}
RUST = {
    "lib.rs": "pub mod a; mod b;\npub use a::deep::{go as run, Thing};\nuse b::*;\nfn main() { run(); a::top(); helper(); crate::b::helper(); missing(); self::own(); }\nfn own() {}\n",
    "a.rs": "pub fn top() { deep::go(); super::own(); inner(); fn inner() {} }\npub mod deep { pub fn go() {} pub struct Thing; use super::top as up; fn call() { up(); go(); } }\n",
    "b.rs": "use crate::a as alpha;\nuse crate::run as indirect;\npub fn helper() { alpha::top(); indirect(); }\n",
}


def table(spark, files, language):
    return code.events(spark.createDataFrame([(p, s, language) for p, s in files.items()], "path string, source string, language string")).cache()


@pytest.fixture(scope="module")
def project(spark):
    events = table(spark, FILES, "typescript")
    targets = spark.createDataFrame([(p, f"./{q[0]}", q) for p in FILES for q in FILES], "path string, specifier string, target string")
    return events, targets, linking.resolved_exports(events, targets).cache()


def test_exports_are_followed(project):
    got = {(r.path, r.name): (r.file, r.symbol) for r in project[2].collect()}
    assert {n: got["a.ts", n] for n in ("f", "C", "v", "default")} == {"f": ("a.ts", "f"), "C": ("a.ts", "C"), "v": ("a.ts", "v"), "default": ("a.ts", "C")}
    assert got["b.ts", "g"] == ("a.ts", "f") and got["b.ts", "C"] == ("a.ts", "C") and got["b.ts", "only"] == ("c.ts", "only") and got["b.ts", "again"] == ("a.ts", "f")
    assert got["b.ts", "space"] == ("a.ts", "*") and got["b.ts", "D"] == ("a.ts", "C") and ("b.ts", "default") not in got and ("b.ts", "f") not in got
    assert got["c.ts", "C"] == ("c.ts", "C") and got["c.ts", "g"] == ("a.ts", "f")
    assert got["d.ts", "mine"] == ("e.ts", "mine") and ("d.ts", "only") not in got  # two declarations
    assert not any(n in ("lost", "x", "hidden") for _, n in got)


def test_uses_are_linked(project):
    events, targets, exports = project
    got = {(r.kind, r.name): (r.file, r.symbol) for r in linking.linked_uses(events, targets, exports).where("path = 'm.ts'").collect()}
    assert got["extends", "D"] == ("a.ts", "C") and got["implements", "all.C"] == ("a.ts", "C")
    assert got["call", "only"] == ("c.ts", "only") and got["call", "mine"] == ("e.ts", "mine") and got["call", "g"] == ("a.ts", "f") and got["call", "v"] == ("a.ts", "v") and got["call", "f"] == ("a.ts", "f")
    assert got["call", "K"] == ("m.ts", "K") and not {("call", n) for n in ("nothing", "pkg", "hidden", "Base")} & set(got)
    heads = sorted((r.file, r.symbol) for r in linking.linked_uses(events, targets, exports).where("path = 'm.ts' and name = 'h'").collect())
    assert heads == [("a.ts", "f"), ("m.ts", "K.go.h")]


def test_rust_is_linked(spark):
    events = table(spark, RUST, "rust")
    modules = spark.createDataFrame([("lib.rs", "crate"), ("a.rs", "crate::a"), ("b.rs", "crate::b")], "path string, module string")
    items = linking.rust_items(events, modules)
    aliases = linking.rust_aliases(events, modules, items)
    got = {r.alias: r["item"] for r in aliases.collect()}
    assert got["crate::run"] == "crate::a::deep::go" and got["crate::Thing"] == "crate::a::deep::Thing" and got["crate::helper"] == "crate::b::helper" and got["crate::a::deep::up"] == "crate::a::top" and got["crate::b::indirect"] == "crate::a::deep::go"
    calls = {(r.path, r.name): r["item"] for r in linking.linked_rust_calls(events, modules, items, aliases).collect()}
    assert calls == {
        ("lib.rs", "run"): "crate::a::deep::go", ("lib.rs", "a::top"): "crate::a::top", ("lib.rs", "helper"): "crate::b::helper", ("lib.rs", "crate::b::helper"): "crate::b::helper", ("lib.rs", "self::own"): "crate::own",
        ("a.rs", "deep::go"): "crate::a::deep::go", ("a.rs", "super::own"): "crate::own", ("a.rs", "inner"): "crate::a::top::inner", ("a.rs", "up"): "crate::a::top", ("a.rs", "go"): "crate::a::deep::go",
        ("b.rs", "alpha::top"): "crate::a::top", ("b.rs", "indirect"): "crate::a::deep::go",
    }


def test_scanners(spark):
    ts = [x[:2] for x in code.typescript("const r = /[\"'`/]/g; f(a / b, `x${g(`y${'}'}`)}z`); /* ' */ class A<T> extends N.B<X> implements I, J.K {} const t = `open${x}`; h()")]
    assert ("gap", None) not in ts and [x for x in ts if x[0] == "call"] == [("call", "f"), ("call", "h")]
    assert [x for x in ts if x[0] in ("extends", "implements")] == [("extends", "N.B"), ("implements", "I"), ("implements", "J.K")]
    assert ("gap", None) in [x[:2] for x in code.typescript("f(`open${x}")]
    rs = [x[:2] for x in code.rust("/* a /* fn no() {} */ */ fn yes() { let x = 'a'; let y: &'a str = r#\"} \"#; go(1.0, b'\\'') }")]
    assert rs == [("function", "yes"), ("call", "go")] and ("gap", None) in [x[:2] for x in code.rust("/* /* */ fn f() {}")]
    uses = [(x[1], x[5]) for x in code.rust("use a::{self, b::{c as d, *}, e}; use crate::x as _; pub use f::g;") if x[0] == "binding"]
    assert uses == [("a", "a"), ("d", "a::b::c"), ("*", "a::b::*"), ("e", "a::e"), ("g", "f::g")]


def test_directives(spark):
    text = "﻿#!/usr/bin/env node\n/* ///<reference path=\"no\" /> */\n/// <reference path=\"./a\" />\n//// <reference path='no'/>\n  ///<reference types='b'/>\n/// <reference lib=\"no\" />\n/// <referencepath=\"no\" />\nconst x = 1;\n/// <reference path=\"late\" />"
    rows = spark.createDataFrame([("f", text), ("g", "x"), ("h", None), ("i", "")], "path string, source string")
    assert [(r.path, r.place, r.attribute, r.target) for r in code.directives(rows).orderBy("place").collect()] == [("f", 0, "path", "./a"), ("f", 1, "types", "b")]
