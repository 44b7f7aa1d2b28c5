import json

from factloom.functions import jsonc
from factloom.sources import code

TSX = '''import d, { a as b, type T } from "./m"; // import x from "no"
import * as ns from '../n';
export * from "./all";
export { p, q as r } from './some';
export default class Küche extends Base { run(): number { return 7; } helper() { if (x) { return 1 } return go(2) } }
export function f(a: string) { const s = "} return 3"; return -5; }
function g() { const inner = () => { return 1; }; return `t`; }
export const top = f(1), other = 2;
interface I { x: string }
export type A = { y: number };
const lazy = import(`./p/${name}.ts`); new Thing(3); obj.method(4);
'''
RS = '''use crate::a::{b, c as d};
pub struct S<T> { x: T }
impl<T: Clone> Display for S<T> { fn fmt(&self) -> u8 { helper::go(1) } }
pub(crate) mod inner { pub fn f<'a>(x: &'a str) -> char { 'x' } /* fn no() {} */ }
trait T2 { fn need(&self); }
const N: usize = 3;
'''


def test_typescript_events():
    got = [(k, n, o, d) for k, n, o, _, _, d in code.typescript(TSX)]
    for want in (
        ("import", "./m", None, "d, { a as b, type T }"), ("import", "../n", None, "* as ns"), ("export", "./all", None, "*"), ("export", "./some", None, "{ p, q as r }"), ("class", "Küche", None, "export"), ("method", "run", "Küche", None),
        ("return_literal", "run", "run", "7"), ("call", "go", "Küche.helper", None), ("function", "f", None, "export"), ("return_literal", "f", "f", "-5"), ("function", "g", None, None), ("variable", "top", None, "export"), ("interface", "I", None, None),
        ("type_alias", "A", None, "export"), ("dynamic_import", "./p/${name}.ts", None, "template"), ("call", "Thing", None, "new"), ("call", "method", None, "member"),
    ):
        assert want in got, want
    assert sorted(x[1] for x in got if x[0] == "call") == ["Thing", "f", "go", "method"]
    assert not [x for x in got if x[0] == "return_literal" and x[1] in ("g", "helper")] and "gap" not in {x[0] for x in got}


def test_rust_events():
    got = [(k, n, o, d) for k, n, o, _, _, d in code.rust(RS)]
    for want in (("use", "crate::a::{b,c as d}", None, None), ("struct", "S", None, "pub"), ("impl", "S", None, "Display"), ("function", "fmt", "S", None), ("call", "helper::go", "S::fmt", None), ("module", "inner", None, "pub"), ("function", "f", "inner", "pub"), ("trait", "T2", None, None), ("const", "N", None, None)):
        assert want in got, want
    assert "no" not in {x[1] for x in got} and "gap" not in {x[0] for x in got}


def test_gaps_are_told(spark):
    rows = [("a.ts", 'function f() { return 1; }\nconst s = "open', "typescript"), ("b.ts", "f(", "typescript"), ("c.go", "x", "go"), ("d.ts", None, "typescript"), ("e.ts", TSX, "typescript")]
    found = code.events(spark.createDataFrame(rows, "path string, source string, language string")).cache()
    assert {r.path for r in found.where("kind = 'gap'").collect()} == {"a.ts", "b.ts", "c.go"}
    raw = TSX.encode()
    assert {r.name: raw[r.start : r.stop].decode().split("(")[0] for r in found.where("path = 'e.ts' and kind = 'function'").collect()} == {"f": "function f", "g": "function g"}
    assert {(r.path, r.symbol, r.literal, r.n) for r in code.literal_returns(found).where("symbol in ('f', 'run', 'g')").collect()} == {("a.ts", "f", "1", 1), ("e.ts", "f", "-5", 1), ("e.ts", "run", "7", 1), ("e.ts", "g", None, 1)}
    assert {(r.path, r.declarations) for r in code.declaration_counts(found).collect()} == {("a.ts", 2), ("b.ts", 0), ("c.go", 0), ("e.ts", 9)}


def test_canonical_json():
    assert jsonc.canonical('{"b": [1, null, true], "a": "x\\u0001\\n\\u00e9", "\\ud83d\\ude00": 1, "\\ufb33": 2}') == '{"a":"x\\u0001\\né","b":[1,null,true],"😀":1,"\ufb33":2}'
    assert [jsonc.canonical(x) for x in ("1.5", "9007199254740992", "{", None, "9007199254740991")] == [None, None, None, None, "9007199254740991"]


def test_jsonc_and_commas():
    assert json.loads(jsonc.stripped('{"a": "// no, /* no */", /* x */ "b": [1, 2,], // y\n}')) == {"a": "// no, /* no */", "b": [1, 2]}
    assert jsonc.top_level("a, f(b, c), \"d,e\", {g: [h, i]}, ") == ["a", "f(b, c)", '"d,e"', "{g: [h, i]}"]
    assert jsonc.top_level("") == [] and jsonc.top_level("'a\\',b', c") == ["'a\\',b'", "c"]
