"""Literal cases of index, roots, diffs, text, intents, reports, formats and maintenance."""

import json

import pytest
from pyspark.sql import functions as F

from tremor import engine
from tremor.functions import text as X, types as Y
from tremor.operators import diff, incremental, index, intent, report, roots as R
from tremor.sources import formats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_root_dedup(spark):
    rows = [("s", "body-change", 0), ("s", "renamed", 1), ("s", "signature-ripple", 2), ("s", "deleted", 3), ("t", "body-change", 4), ("t", "body-change", 5)]
    got = R.dedup(spark.createDataFrame(rows, "symbol_id string, reason string, ord long")).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [("s", "deep", "deleted", 0), ("t", "shallow", "body-change", 4)]


def test_signature_diff(spark):
    frame = lambda d: spark.createDataFrame(list(d.items()), "id string, signature_hash string")
    old, new = frame({"p": "h1", "q": "h2", "r": "h3"}), frame({"p": "h1", "q": "h9", "z": "h4"})
    changes = lambda df: {r.symbol_id: r.change for r in df.collect()}
    want = {"p": "safe", "q": "ripple", "z": "added", "r": "removed"}
    assert changes(diff.signature_diff(old, new)) == want
    assert changes(diff.signature_diff(old, new, frame({"r": "h3"}))) == {k: v for k, v in want.items() if k != "r"}


@pytest.mark.parametrize(("text", "lines", "want"), [("ab\ncd\n", (1, 1), (0, 2)), ("ab\ncd\n", (2, 2), (3, 5)), ("ab\ncd\n", (3, 3), (6, 5)), ("ab\ncd\n", (0, 99), (0, 5)), ("", (1, 1), (0, -1))])
def test_line_ranges(spark, text, lines, want):
    assert tuple(one(spark, index.char_range(F.lit(text), *map(F.lit, lines)))) == want


def test_overlap_is_closed_and_innermost_prefers_the_smaller(spark):
    symbols = spark.createDataFrame([("s", "f", 0, 3, 1, 10, 5), ("t", "f", 9, 9, 4, 6, 9), ("u", "f", 9, 9, 4, 6, 7)], "id string, file_path string, start_pos int, end_pos int, start_line int, end_line int, ord long")
    hit = index.overlapping(spark.createDataFrame([("f", 3, 5)], "file_path string, start int, end int"), symbols)
    assert [r.id for r in hit.collect()] == ["s"]
    probes = spark.createDataFrame([(1, "f", 5), (2, "f", 99)], "probe_id int, file_path string, line int")
    assert {r.probe_id: r.id for r in index.innermost(probes, symbols).collect()} == {1: "u", 2: None}


@pytest.mark.parametrize(("name", "want"), [("getUserByID", ["get", "user"]), ("a_b", ["a", "b"]), ("XMLHttpRequest", ["xml", "http", "request"])])
def test_tokenise(spark, name, want):
    assert one(spark, X.tokenise(F.lit(name))) == want


@pytest.mark.parametrize(("hint", "name", "want"), [("Auth", "auth", 1.0), ("auth", "authenticate", None), ("plot", "barPlot", 0.5 + 0.3 * 4 / 7), ("plotBar", "barPlot", 0.9)])
def test_hint_scores(spark, hint, name, want):
    assert one(spark, X.symbol_hint_score(F.lit(hint), F.lit(name))) == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize(("prompt", "want"), [("Rename the invoice totals for every supplier", ["rename", "invoice", "totals", "supplier"]), ("Let customers merge 2 open ORDERS, then order", ["let", "customers", "merge", "open", "orders", "order"])])
def test_keywords(spark, prompt, want):
    assert one(spark, X.keywords(F.lit(prompt))) == want


def test_confidence_cuts(spark):
    assert [one(spark, X.confidence(F.lit(s))) for s in (0.85, 0.45, 0.4499)] == ["high", "medium", "low"]
    assert [one(spark, X.demote(F.lit(s))) for s in ("high", "medium", "low")] == ["medium", "low", "low"]


def test_small_text_functions(spark):
    assert one(spark, X.units16(F.lit("😀é"))) == 3
    assert one(spark, X.escape_html(F.lit('<a b="&">'))) == "&lt;a b=&quot;&amp;&quot;&gt;"
    assert one(spark, X.short_path(F.lit("/a/b/c/d"))) == "b/c/d"
    assert tuple(one(spark, X.symbol_parts(F.lit("__phantom__#Foo")))) == ("", "Foo", True)
    assert tuple(one(spark, X.symbol_parts(F.lit("/ws/a/x.ts#C.m")))) == ("x.ts", "C.m", False)
    assert one(spark, X.file_of_last(F.lit("/ws/x.ts#C.#p"))) == "/ws/x.ts#C."
    assert one(spark, X.relative_path(F.lit("C:\\ws\\a.ts"), "C:/ws")) == "a.ts"


DIFF = "+++ b/src/a.ts\n@@ -1,2 +3,4 @@\n@@ -9 +12 @@\n@@ -20,3 +22,0 @@\n+++ /dev/null\n@@ -1,5 +0,0 @@\n+++ src/b.ts\n@@ -0,0 +1,2 @@ fn()\n"


def test_version_control_text(spark):
    hunks = formats.diff_hunks(spark.createDataFrame([(DIFF,)], "raw string")).collect()
    assert sorted(map(tuple, hunks)) == [("src/a.ts", 3, 4), ("src/a.ts", 12, 1), ("src/b.ts", 1, 2)]
    listing = "M\tx.ts\nR100\told.ts\tnew.ts\n\nD\tgone.ts\nR100\tonly.ts"
    files = formats.name_status(spark.createDataFrame([(listing,)], "raw string")).collect()
    assert {tuple(r) for r in files} == {("M", "x.ts", None), ("R", "new.ts", "old.ts"), ("D", "gone.ts", None), ("R", "only.ts", None)}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("string | number", "number | string"), ("{ b: 1; a: 2 }", "{ a: 2; b: 1 }"), ("B | A<x | y>", "A<x | y> | B"), ("() => b | a", "() => b | a"), ("b & a", "a & b"), ("  a\n b ", "a b"), ("", ""),
        ("{ b: 1; a: 2; }", "{ a: 2;; b: 1 }"),  # the last member keeps its semicolon
    ],
)
def test_canonical_types(spark, raw, want):
    assert one(spark, Y.canonical_type(F.lit(raw))) == want
    assert one(spark, Y.canonical_types(F.array(F.lit(raw), F.lit(None)))) == [want, ""]


def test_closing_brackets_hide_separators_behind_arrows(spark):
    assert one(spark, Y.split_top(F.lit("a, b"), ", ")) == ["a", "b"]
    assert one(spark, Y.split_top(F.lit("() => b | a"), " | ")) == ["() => b | a"]
    assert one(spark, Y.split_top(F.lit("a | "), " | ")) == ["a"]


def _intents(spark, rows):
    return spark.createDataFrame(rows, "intent_id long, prompt string, change_type string, symbol_hints array<string>, file_hints array<string>, affects_public_api boolean")


def _symbols(spark, rows):
    return spark.createDataFrame([(i, n, "function", f, 1, e, k) for k, (i, n, f, e) in enumerate(rows)], "id string, name string, kind string, file_path string, start_line int, is_exported boolean, ord long")


def test_file_hints_alone_need_an_exported_symbol(spark):
    symbols = _symbols(spark, [("/ws/a.ts#A", "A", "/ws/a.ts", True), ("/ws/a.ts#B", "B", "/ws/a.ts", False)])
    got = intent.resolve(_intents(spark, [(1, "", "modify", [], ["a.ts"], False)]), symbols, "/ws").collect()
    assert [(r.symbol_id, r.confidence, r.matched_hints) for r in got] == [("/ws/a.ts#A", "medium", ["a.ts"])]


def test_matched_hints_are_those_that_raised_the_score(spark):
    symbols = _symbols(spark, [("/ws/a.ts#barPlot", "barPlot", "/ws/a.ts", False)])
    got = intent.resolve(_intents(spark, [(1, "", "modify", ["plot", "plotBar", "bar", "barplot"], [], False)]), symbols, "/ws").collect()
    assert [(r.matched_hints, r.score) for r in got] == [(["plot", "plotBar", "barplot"], 1.0)]


def test_phantoms_and_deletion_scope(spark):
    symbols = _symbols(spark, [("/ws/f.ts#foo", "foo", "/ws/f.ts", True), ("/ws/f.ts#in", "inside", "/ws/f.ts", True), ("/ws/g.ts#out", "outside", "/ws/g.ts", True)])
    asked = _intents(spark, [(1, "", "add", ["Foo", "bar"], [], False), (2, "", "delete", ["foo"], [], False)])
    resolved = intent.resolve(asked, symbols, "/ws")
    assert [(r.intent_id, r.symbol_id) for r in intent.phantoms(asked, resolved).collect()] == [(1, "__phantom__#bar")]
    edges = spark.createDataFrame([("/ws/f.ts#in", "/ws/f.ts#foo"), ("/ws/g.ts#out", "/ws/f.ts#in")], "src string, dst string")
    got = intent.predict(asked.filter("intent_id = 2"), resolved.filter("intent_id = 2"), edges).collect()
    assert [(r.symbol_id, r.depth, r.confidence) for r in got] == [("/ws/g.ts#out", 2, "medium")]


def test_confidence_falls_once(spark):
    symbols = _symbols(spark, [(f"/ws/{n}.ts#{n}", n, f"/ws/{n}.ts", False) for n in ("handler", "b", "c", "d")])
    asked = _intents(spark, [(1, "", "modify", ["handler"], [], True)])
    chain = spark.createDataFrame([("/ws/b.ts#b", "/ws/handler.ts#handler"), ("/ws/c.ts#c", "/ws/b.ts#b"), ("/ws/d.ts#d", "/ws/c.ts#c")], "src string, dst string")
    got = intent.predict(asked, intent.resolve(asked, symbols, "/ws"), chain).collect()
    assert {r.symbol_id[-1]: r.confidence for r in got} == {"b": "high", "c": "medium", "d": "medium"}


def test_risks(spark):
    rows = [("r", "root", "deleted", 0, "high"), ("n", "indirect", None, 3, "high"), ("l", "direct", None, 1, "low"), ("m", "indirect", None, 3, "low"), ("b", "root", "body-change", 0, "high")]
    listed = spark.createDataFrame(rows, "symbol_id string, role string, reason string, depth int, conf string")
    got = {r.symbol_id: (r.level, r.reasons) for r in report.risks(listed, F.col("conf")).collect()}
    far, vague = "deep transitive (depth 3)", "low prediction confidence"
    assert got == {"r": ("high", ["root: deleted"]), "n": ("medium", [far]), "l": ("low", [vague]), "m": ("medium", [far, vague])}


def _files(spark, d):
    rows = [(f"{p}#{n}", n, "function", p, 1, 2, 0, 5, True, h, k) for k, (p, n, h) in enumerate(d)]
    return spark.createDataFrame(rows, "id string, name string, kind string, file_path string, start_line int, end_line int, start_pos int, end_pos int, is_exported boolean, signature_hash string, ord long")


def test_staged_impact_and_report(spark):
    live = _files(spark, [("/ws/a.ts", "f", "1"), ("/ws/a.ts", "g", "1"), ("/ws/b.ts", "h", "1"), ("/ws/c.ts", "k", "1"), ("/ws/d.ts", "m", "1")])
    edges = spark.createDataFrame([("/ws/b.ts#h", "/ws/a.ts#f"), ("/ws/c.ts#k", "/ws/b.ts#h"), ("/ws/c.ts#k", "/ws/a.ts#g"), ("/ws/b.ts#h", "/ws/d.ts#m")], "src string, dst string")
    staged = spark.createDataFrame([("M", "/ws/a.ts", None), ("D", "/ws/d.ts", None)], "status string, file_path string, old_file_path string")
    new = _files(spark, [("/ws/a.ts", "f", "2")])
    contents = spark.createDataFrame([("/ws/a.ts", "x")], "file_path string, text string")
    hunks = spark.createDataFrame([("/ws/a.ts", 1, 1)], "file_path string, new_start int, new_count int")
    got = engine.staged_impact(incremental.State(live, edges), staged, contents, hunks, new, edges.limit(0), "/ws")
    assert {(r.symbol_id, r.reason) for r in got.roots.collect()} == {("/ws/a.ts#f", "signature-ripple"), ("/ws/a.ts#g", "deleted"), ("/ws/d.ts#m", "deleted")}
    assert {(r.symbol_id, r.depth) for r in got.impact.collect()} == {("/ws/b.ts#h", 1), ("/ws/c.ts#k", 1)}
    doc = got.report("staged").first()
    assert (doc.summary.total_roots, doc.summary.total_direct, doc.summary.unknown_count, doc.summary.high_risk_count) == (3, 2, 2, 3)
    assert {r.reason for r in engine.staged_impact(incremental.State(live, edges), staged, contents, hunks, new, edges.limit(0), "/ws", strict=True).roots.collect()} == {"signature-ripple"}


def test_ghost_names(spark):
    ids = spark.createDataFrame([("/ws/x.ts#C.#priv",)], "symbol_id string")
    r = report.refs(ids, _files(spark, [("/ws/a.ts", "f", "1")]), "/ws").first()
    assert (r["name"], r.rel_path, r.kind, r.start_line, r.exported) == ("C.#priv", "x.ts", "unknown", 0, False)


def test_caches(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"a#f": {"id": "a#f", "name": "f", "kind": "function", "filePath": "a", "startLine": 1, "isExported": True}}))
    got = formats.read_symbols(spark, str(tmp_path / "s.json")).first()
    assert (got.id, got.file_path, got.is_exported, got.parent_id) == ("a#f", "a", True, None)
    for name, body in (("g1", {"present": {"forward": {"a": ["b", "c"]}, "reverse": {}}}), ("g2", {"forward": {"a": ["b", "c"]}})):
        (tmp_path / name).write_text(json.dumps(body))
        assert sorted(map(tuple, formats.read_edges(spark, str(tmp_path / name)).collect())) == [("a", "b"), ("a", "c")]
    for name, body in (("e1", "{}"), ("e2", " "), ("e3", "nonsense")):
        (tmp_path / name).write_text(body)
        assert formats.read_edges(spark, str(tmp_path / name)).isEmpty()
    assert formats.read_symbols(spark, str(tmp_path / "none.json")).isEmpty()
    (tmp_path / "m").write_text(json.dumps({"projectHash": "x", "createdAt": ""}))
    assert formats.read_metadata(spark, str(tmp_path / "m")).isEmpty()


def test_sinks_keep_other_sections(spark, tmp_path):
    folder = str(tmp_path / "cache")
    formats.ensure_cache(spark, folder)
    assert formats.cache_ready(spark, folder)
    pair = lambda a, b: spark.createDataFrame([(a, b)], "src string, dst string")
    formats.write_edges(pair("a", "b"), folder, "present")
    formats.write_edges(pair("c", "d"), folder, "future")
    formats.write_edges(pair("e", "f"), folder, "present")
    got = spark.read.parquet(f"{folder}/edges").collect()
    assert sorted((r.src, r.section) for r in got) == [("c", "future"), ("e", "present")]
    formats.write_metadata(spark, folder, "h")
    assert spark.read.parquet(f"{folder}/metadata").first().version == "1.0.0"


def test_rename_and_warm_start(spark):
    state = incremental.State(_files(spark, [("/ws/a.ts", "f", "1"), ("/ws/b.ts", "g", "1")]), spark.createDataFrame([("/ws/b.ts#g", "/ws/a.ts#f")], "src string, dst string"))
    moved = incremental.rename_file(state, "/ws/a.ts", _files(spark, [("/ws/n.ts", "f", "1")]), state.edges.limit(0))
    assert {r.id for r in moved.symbols.collect()} == {"/ws/n.ts#f", "/ws/b.ts#g"}
    assert moved.edges.isEmpty()
    hashes = lambda d: spark.createDataFrame(list(d.items()), "file_path string, sha1 string")
    fresh = _files(spark, [("/ws/a.ts", "f2", "2")])
    warm = incremental.warm_start(state, hashes({"/ws/a.ts": "y"}), hashes({"/ws/a.ts": "x", "/ws/b.ts": "z"}), fresh, state.edges.limit(0))
    assert {r.id for r in warm.symbols.collect()} == {"/ws/a.ts#f2"}
    assert not incremental.cache_valid(warm.symbols, warm.edges, "h", "h")


def test_prompt_and_stream(spark):
    text = one(spark, intent.prompt_text(F.lit("do it"), F.lit("CONTEXT")))
    assert "CONTEXT" in text and text.endswith("do it")
    chunks = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "intent_id long, seq int, text string")
    assert intent.joined_stream(chunks).first().response == "ab"


def test_keys_find_every_pair_that_scores(spark, monkeypatch):
    """Pairs by shared keys against all pairs, on short names and hints that contain and overlap each other."""
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choices(["a", "ab", "Ab", "bc", "Abc", "abcd", "Z", "9", "_", "é", "😀"], k=r.randint(0, 4)))
    symbols = spark.createDataFrame([(f"/ws/{word()}.ts#{k}", word(), f"/ws/{word()}.ts", k % 3 == 0, k) for k in range(70)], "id string, name string, file_path string, is_exported boolean, ord int").cache()
    rows = [(k, f"{word()} {word()}c {word()}abc", "modify", [word() for _ in range(k % 3)], [f"{word()}.ts" for _ in range(k % 2)], True) for k in range(50)]
    rows += [(100 + k, "", "modify", [], [s.file_path[4:].upper()], True) for k, s in enumerate(symbols.limit(10).collect())]
    intents = spark.createDataFrame(rows, "intent_id long, prompt string, change_type string, symbol_hints array<string>, file_hints array<string>, affects_public_api boolean")
    score = lambda df: {(x.intent_id, x.id, round(x.score, 9)) for x in df.collect()}
    both = lambda: (score(intent.hint_candidates(intents, symbols, "/ws")), score(intent.keyword_candidates(intents, symbols)))
    found = both()
    paired, same = intent._paired, F.array(F.lit("k"))
    monkeypatch.setattr(intent, "_paired", lambda s, i: paired(s.withColumn("keys", same), i.withColumn("keys", same)))
    assert both() == found and all(len(x) > 100 for x in found)


def test_numbers_are_dense_along_the_order(spark):
    from tremor.operators.numbering import numbered

    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("k"), F.lit("x").alias("at"))
    got = numbered(df, "n", F.desc("k")).collect()
    assert sorted((r.n, r.k) for r in got) == [(n, 4999 - n) for n in range(5000)] and got[0].at == "x"
    assert numbered(df.limit(0), "n", "k").collect() == []


def test_positions_count_utf16_units(spark):
    text = "a😀\né\n😀x"
    assert tuple(one(spark, index.char_range(F.lit(text), F.lit(2), F.lit(2)))) == (4, 5)
    assert tuple(one(spark, index.char_range(F.lit(text), F.lit(3), F.lit(9)))) == (6, 8)
