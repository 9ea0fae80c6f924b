"""Symbols and references of source text."""

import pytest
from hypothesis import given, settings, strategies as st

from tremor.sources import scripts
from tremor.sources.scripts import Reader

SOURCE = """import { a as b, type C } from "./m"; import * as ns from '../x/y'; import Def from './d';
// class Not {
@dec({x: 1}) export class Foo<T extends Map<string, number>> extends base.Bar implements I<T>, J {
  readonly n = 5; static s: string | null = `a${b + {q:1}.q}c`;
  private m?: Map<string, number>
  arrow = (x: number) => { return this.run(x); }
  constructor(private z: number, y = 'k') { super(); b(z); }
  get v(): number { return this.n }
  over(a: string): void;
  over(a: any): void { if (/[/{]/.test(a)) { ns.thing(a); } helper(a); }
  async *run<U>(q: U, ...rest: string[]): AsyncGenerator<{ a: U }> { const helper = 1; yield helper; }
}
function helper(a: { x: 1 }, { p, q }: P = d): { r: number } { return other(a.x) }
export default function (x) { return x }
declare function amb(x: string): void;
export interface Shape { b: string; a(x: number): void, c?: { d: 1; e: 2 } }
type T1<K> = | 'x' | "y"
  | K
export const enum E { A, B = 1 << 3, C, D = "s", F = A | B }
const one = 1, two: string = 'x', fn = async (p: Foo): Promise<void> => { one + helper(two) }
let { k, l: [mm] } = one
namespace N.M { export function f(): void {} class C2 { m() {} p = 1 } interface X { a: 1 } namespace In { function g() {} } const z = 3; type Q = 1 }
declare module "ext" { function hh(): void {} }
export { helper as default, one };
"""


def declared(text):
    return {(d["kind"], d["name"]): d for d in Reader("/w/a.ts", text).declared()}


def test_declarations():
    got = Reader("/w/a.ts", SOURCE).declared()
    assert [d["name"] for d in got] == (
        ["helper", "Foo", "Foo.over", "Foo.run", "Foo.n", "Foo.s", "Foo.m", "Foo.arrow", "Shape", "T1", "E", "one", "two", "fn", "{ k, l: [mm] }"]
        + ["N.M.f", "N.M.C2", "N.M.C2.m", "N.M.X", "N.M.In.g", '"ext".hh']
    )
    by = {d["name"]: d for d in got}
    assert {n for n, d in by.items() if d["is_exported"]} == {"helper", "Foo", "Foo.over", "Foo.run", "Foo.n", "Foo.s", "Foo.m", "Foo.arrow", "Shape", "E", "one", "N.M.f"}
    text = lambda n: SOURCE[by[n]["start_pos"] : by[n]["end_pos"]]
    assert text("Foo.over") == "over(a: any): void { if (/[/{]/.test(a)) { ns.thing(a); } helper(a); }"
    assert text("two") == "two: string = 'x'" and text("Foo.n") == "readonly n = 5;" and text("Foo").startswith("@dec") and text("Foo").endswith("helper; }\n}")
    assert (by["Foo"]["start_line"], by["Foo"]["end_line"], by["T1"]["end_line"]) == (3, 12, 18)
    assert by["E"]["names"] == ["A", "B", "C", "D", "F"] and by["E"]["types"] == ["0", "8", "9", "s", "8"]
    assert by["Foo"]["result"] == "Bar" and by["Foo"]["names"] == ["I", "J"]
    assert by["Foo.run"]["names"] == ["q", "rest"] and by["Foo.run"]["types"] == ["U", "string[]"] and by["Foo.run"]["result"] == "AsyncGenerator<{ a: U }>"
    assert by["Shape"]["types"] == ["b: string;", "a(x: number): void,", "c?: { d: 1; e: 2 }"]
    assert by["N.M.C2.m"]["parent"] == "N.M.C2" and by["fn"]["result"] == "(p: Foo) => Promise<void>"


def test_references_have_owners():
    got = {(owners[0], base, member) for owners, _, base, member in Reader("/w/a.ts", SOURCE).references()}
    assert {("Foo", "base", "Bar"), ("Foo", "I", None), ("Foo", "J", None), ("Foo", "this.Foo", "run"), ("Foo.over", "ns", "thing"), ("Foo.over", "helper", None), ("Foo.v", "this.Foo", "n"), ("helper", "other", None), ("fn", "Foo", None), ("fn", "one", None), ("fn", "two", None)} <= got
    assert not any(base in ("a", "q", "p", "x", "z") for _, base, _ in got)  # parameters, members of types
    assert ("Foo.run", "helper", None) not in got  # a local name stands for itself


def test_positions_count_utf16_units_and_texts_may_be_odd():
    d = declared("const s = '😀'; function f() {}")
    assert d["function", "f"]["start_pos"] == 16
    assert Reader("/w/a.ts", "").declared() == [] and list(Reader("/w/a.ts", "").references()) == []
    assert declared("const r = a / b / c; const q = /x'}/g; class K { 'a-b' = 1; [x] = 2; #p() {} }").keys() == {("variable", "r"), ("variable", "q"), ("class", "K"), ("method", "K.#p"), ("property", "K.'a-b'"), ("property", "K.[x]")}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["class A", "function f", "{", "}", "(", ")", "<", ">", "=>", "=", ":", ";", ",", "`", "${", "'", "/", "*", "\n", "x", "const", "enum E", "interface I", "type T", "namespace N", "import", "export", "@d", "1", "."]), max_size=40))
def test_any_text_ends(parts):
    for sep in ("", " "):
        r = Reader("/w/a.ts", sep.join(parts))
        for d in r.declared():
            assert d["start_pos"] < d["end_pos"]
        assert all(owners for owners, *_ in r.references())


def test_edges_go_through_imports(spark):
    files = [
        ("/ws/a.ts", "import { go as run, Kit } from './lib/b';\nimport * as lib from './lib/b.js';\nexport function main() { run(); lib.stop(); Kit.make(); main(); }"),
        ("/ws/lib/b.ts", "export function go() { return stop() }\nexport function stop() {}\nexport class Kit { make() { return this.make() ?? new Kit() } size = go() }"),
        ("/ws/node_modules/c.ts", "export function other() { main() }"), (None, "x"), ("/ws/empty.ts", None),
    ]
    df = spark.createDataFrame(files, "file_path string, content string")
    symbols = scripts.extract_symbols(df)
    edges = lambda **k: {(r.src, r.dst) for r in scripts.walk_references(df, symbols, "/ws", **k).collect()}
    b = "/ws/lib/b.ts#"
    inside = {(b + "go", b + "stop"), (b + "Kit.make", b + "Kit"), (b + "Kit", b + "go"), ("/ws/a.ts#main", b + "stop")}
    assert edges(strict=True) == inside | {("/ws/a.ts#main", b + "Kit.make")}
    assert edges() == inside | {("/ws/a.ts#main", b + n) for n in ("go", "Kit", "Kit.make")}
    assert scripts.extract_symbols(df.limit(0)).collect() == [] and scripts.walk_references(df.limit(0), symbols, "/ws").collect() == []


def test_files_from_a_folder(spark, tmp_path):
    from tremor.sources import formats

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("export const x = 1;\n")
    (tmp_path / "b.md").write_text("const y = 2")
    got = scripts.extract_symbols(formats.read_project(spark, str(tmp_path))).collect()
    assert [(r.name, r.is_exported, r.parent_id, r.ord) for r in got] == [("x", True, None, 0)] and got[0].id == f"{tmp_path}/src/a.ts#x"


def named(text):
    return {(tuple(owners), base) for owners, _, base, _ in Reader("/w/a.ts", text).references()}


def test_long_type_lists_lose_nothing():
    many = ", ".join(f"T{i} extends Map<string, X{i}>" for i in range(900))
    assert ("function", "wide") in declared(f"function wide<{many}>(a: T1): void {{}}")
    members = "; ".join(f"p{i}: number" for i in range(300))
    for result in (f"{{ {members} }}", " | ".join(f"A{i}" for i in range(300)), "{ x: number }", "A | { x: 1 } & B"):
        got = named(f"const f = (a: number): {result} => g(a)")
        assert (("f",), "g") in got and (("f",), "a") not in got, result[:20]
    assert (("h",), "k") in named("function h(c) { return c ? (a) : { k: k } }")


def test_comparisons_are_no_type_lists():
    assert (("f",), "b") in named("function f(x) { if (x < a && b > c) { return b < d } }")


def test_catch_binds_its_name():
    got = named("function f() { try { g() } catch (e) { h(e) } e2() } function k() { p.catch(e => e) } function m() { try {} catch { n() } return e }")
    assert {(("f",), "g"), (("f",), "h"), (("f",), "e2"), (("m",), "n"), (("m",), "e")} <= got and (("f",), "e") not in got
    assert (("f",), "w") in named("function f() { try {} catch ({ v, message: m }: any) { w(v, m) } }") and (("f",), "v") not in named("function f() { try {} catch ({ v }) { v() } }")
