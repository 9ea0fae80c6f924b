"""Spelling variants, phrases and url filters against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tremor.llm import phrases, queries, spelling, urls

SF = "/root/testdata/sf0.001"


# Spelling variants.


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def low(x):
    return re.sub("[A-Z]", lambda m: m.group().lower(), x)


def brute_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute_variants(known):
    by_length = defaultdict(list)
    for w in known:
        by_length[len(w)].append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if one_apart(w, x)] for w in known}
    form = {}
    for w, n in known.items():
        best = min(near[w], key=lambda x: (-known[x], x), default=None)
        form[w] = best if best is not None and known[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), known[form[w]] if form[w] else None) for w, n in known.items()}


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, word string, n long, lang string")


@pytest.mark.parametrize("large,sample", [(spelling.LARGE, spelling.SAMPLE), (4, 1)])
def test_variants_equal_brute_force(spark, large, sample):
    r = random.Random(large)
    stems = ["".join(r.choice("aaaabé") for _ in range(r.randrange(7, 10))) for _ in range(150)] + ["prefixes" + "".join(r.choice("xyz") for _ in range(2)) for _ in range(9)]
    docs = [(None if i == 3 else i, " ".join(r.choice(stems) + r.choice([",", "", "."]) for _ in range(120)), "w", 1, None) for i in range(12)]
    docs += [(50, "Manifold manifold " * 40 + "manifolt manifolt manifoldt manifoldt", "w", 1, "x"), (50, None, None, None, None), (51, "", "", 0, ""), docs[4]]
    got = spelling.variants(table(spark, docs), large=large, sample=sample)
    assert rows_of(got) == brute_variants(brute_words([d[:2] for d in docs]))
    assert got.filter("form is not null").count() > 0 and got.count() == got.select("word").distinct().count()


def test_chains_lead_to_their_last_form(spark):
    known = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "ccccccc": 2}
    docs = [(1, " ".join(w for w, n in known.items() for _ in range(n)), "", 0, "")]
    got = {r.word: (r.n, r.root) for r in spelling.variants(table(spark, docs)).collect()}
    want = brute_variants(brute_words([d[:2] for d in docs]))
    assert got == {w: (n, root) for w, _, root, n, _, _ in want} and len({w for w, f, *_ in want if f}) >= 2


def test_runs_of_long_texts_are_cut_nowhere(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLAB", 64)
    r = random.Random(5)
    text = "".join(r.choice(["é", "a", "B", "\u00ff", " ", "日", "x" * 90, "-"]) for _ in range(3000))
    raw, offs = text.encode(), np.array([0, len(text.encode())])
    batch = pa.record_batch([["7"], [text]], ["id", "text"])
    got = [x for b in spelling._found(iter([batch]), 3) for x in b["run"].to_pylist()]
    assert got == [low(x) for x in re.findall("[A-Za-z\u00c0-\u00ff]+", text) if len(x) >= 3] and len(raw) == offs[1]


def test_no_words_give_no_rows(spark):
    assert spelling.variants(table(spark, [])).count() == 0 == spelling.variants(table(spark, [(1, "short words", "", 0, "")])).count()


def test_variants_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {tuple(None if x != x else x for x in r) for r in con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({spelling.ORACLE})").fetchall()}
    assert rows_of(queries.op11_spelling_variants(spark, SF)) == want and len(want) > 500


# Phrases.


def brute_phrases(docs, least, best=2000):
    count = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            count["und" if lang is None else lang].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in count.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        found = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        gone = {k[i : i + m] for k, v in found.items() for m in range(2, len(k)) for i in range(len(k) - m + 1) if 100 * v >= 100 * found[k[i : i + m]]}
        rows = []
        for k, a in found.items():
            if k not in gone:
                score, _, l, r = min((1000 * a * n // (c[k[:j]] * c[k[j:]]), j, c[k[:j]], c[k[j:]]) for j in range(1, len(k)))
                rows.append((-score, -a, " ".join(k).encode(), l, r))
        out |= {(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:best])}
    return out


def phrase_rows(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def test_phrases_equal_brute_force(spark):
    r = random.Random(3)
    draw = lambda: "".join(r.choice(["Aa", "b", "é", "a b"]) + r.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(200))
    docs = [(i, draw(), r.choice(["en", "de", None, ""])) for i in range(14)]
    docs += [docs[0], (99, None, "en"), (100, "", None), (101, "only", "xx"), (102, " . ,\t", "yy"), (None, "b b b b b b b", "en")]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, lang string, phrase string, n long")
    for least, best in ((2, 2000), (9, 5)):
        got = phrases.collocations(df, least=least, best=best)
        assert phrase_rows(got) == brute_phrases([(lang, text) for _, text, lang in docs], least, best)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_phrases_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_phrases([(r.lang, r.text) for r in docs.collect()], 12)
    assert phrase_rows(phrases.collocations(docs, least=12)) == want and len(want) > 50
    assert phrase_rows(queries.op12_phrases(spark, SF)) == brute_phrases([(r.lang, r.text) for r in docs.collect()], 100)


def test_scores_are_exact_beyond_64_bits(spark):
    r = random.Random(1)
    rows = [(a := r.randrange(1, 10**12), r.randrange(10**12, 10**14), a + r.randrange(10**12), a + r.randrange(10**12)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").select("*", phrases._score("a", "n", F.col("l"), F.col("r")).alias("s"))
    assert all(x.s == 1000 * x.a * x.n // (x.l * x.r) for x in df.collect())


def test_blocks_are_counted_over_their_borders(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 1 << 10)
    monkeypatch.setattr(phrases, "CHUNK", 7)
    monkeypatch.setattr(phrases.B, "numbered", lambda: iter(range(10**6)).__next__)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).select("lang", "text").collect()
    batch = pa.record_batch([[d.lang for d in docs], [d.text for d in docs]], ["lang", "text"])
    pieces = list(phrases._pieces(iter([batch])))
    asks = [b for b in phrases._blocks(iter(pieces), 3)]
    assert len(asks) > 5
    found = [r for b in phrases._count(iter([b.filter(pc.greater_equal(b["shard"], 0)) for b in asks]), 1, 3, 1) for r in b.to_pylist()]
    want = Counter((d.lang, w) for d in docs for p in re.split(r"[.,;:!?\x0A-\x0D]", low(d.text)) for w in re.findall(r"[^\x20\x09]+", p))
    assert {(r["lang"], r["word"]): r["f"] for r in found if r["num"] is not None} == dict(want)
    numbers = [r["num"] for r in found if r["num"] is not None]
    assert len(set(numbers)) == len(numbers)


# Url filters.

URLS = [
    "http://Example.NET/en/x?q#f", "https://a.b.example.net/de/1", "http://notexample.net/en/", "http://example.com/de/", "http://x.example.com/de", "ftp://m.org/fr/é", "http://org?x=/fr/", "http://net", "http://net/", "no scheme.net/en/",
    "", None, "://", "a://b://c/d", "http://EXAMPLE.ORG:80/fr/", "HTTP://É.Org/fr/", "http://free-casino.example.de/" + "a1/" * 3000, "http://x.com#/de/", "x\ny://h.net/en/\nz", "https://shop.example.org/en/77",
]


def plain_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (low(m.group(1)), m.group(2)) if m else ("", "")


def plain_rule(host, path):
    fit = [(len(h + p), len(h), -i, h + p, v) for i, (v, h, p) in enumerate(urls.RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, None)


def vector(url):
    """Features by plain Python."""
    out = Counter()
    for mark, text in zip("hp", plain_parts(url)):
        text = "^" + re.sub("[0-9]+", "0", text) + "$"
        out.update(zlib.crc32((mark + text[i : i + n]).encode()) % urls.BUCKETS for n in urls.SIZES for i in range(len(text) - n + 1))
    m = sum(out.values())
    x = np.zeros(urls.BUCKETS + 1)
    for k, c in out.items():
        x[k] = c / np.sqrt(m)
    x[-1] = 1
    return x


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(urls.labels(spark))


@pytest.fixture(scope="module")
def plain_weights():
    known = [(urls.PLACES[i % len(urls.PLACES)].format(n), y) for y, names in ((1.0, urls.BLOCKED), (0.0, urls.ALLOWED)) for i, n in enumerate(names)]
    x, y = np.stack([vector(u) for u, _ in known]), np.array([y for _, y in known])
    w = np.zeros(x.shape[1])
    for _ in range(urls.STEPS):
        w -= urls.RATE * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + urls.DECAY * w)
    return w


def test_training_equals_plain_gradient_descent(model, plain_weights):
    assert np.allclose(np.append(model.weights, model.bias), plain_weights, atol=1e-6)


def judged(pages, model, **k):
    return {r.page_id: tuple(r)[1:] for r in urls.judge(pages, model, **k).collect()}


def want(url, w):
    host, path = plain_parts(url)
    rule, verdict = plain_rule(host, path)
    return host, path, rule, verdict or ("block" if vector(url) @ w >= 0 else "allow")


def test_urls_are_judged_as_by_plain_python(spark, model, plain_weights):
    pages = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string, rule string")
    got = judged(pages, model, keep=("host",))
    assert got == {i: (*want(u, plain_weights), "h") for i, u in enumerate(URLS)}
    assert {v[2] for v in got.values()} == {None, "net/", "example.net/en/", "example.com/de/", "org/fr/"}
    twice = pages.union(pages).withColumn("page_id", F.lit(None).cast("long"))
    assert urls.judge(twice, model).count() == 2 * len(URLS) and judged(pages.limit(0), model) == {}


def test_url_query_judges_all_pages(spark, plain_weights):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    found = queries.op13_url_filters(spark, SF)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert {r.page_id: tuple(r)[1:] for r in found.collect()} == {p.page_id: want(p.url, plain_weights) for p in pages}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|Join", plan) and "html" not in plan


def test_the_model_tells_new_names_apart(spark, model):
    new = [("http://bets-casino.example.edu/x/1", True), ("https://www.cheap-lottery.example.de/", True), ("http://spam-pills.example.info/a", True), ("https://library.example.edu/x/1", False), ("http://forest.example.de/", False), ("http://www.kitchen.example.info/a", False)]
    host, path = urls.parts(F.col("url"))
    got = spark.createDataFrame(new, "url string, y boolean").select("y", urls.probability(host, path, model).alias("p")).collect()
    assert all((r.p >= 0.5) == r.y for r in got)


def test_training_needs_both_kinds_and_a_small_table(spark):
    one = spark.createDataFrame([("http://a/", True), (None, False), ("http://b/", None)], "url string, blocked boolean")
    many = spark.range(urls.MOST_LABELS + 2).select(F.concat(F.lit("http://a/"), "id").alias("url"), (F.col("id") % 2 == 0).alias("blocked"))
    for bad in (one, one.limit(0), many):
        with pytest.raises(ValueError):
            urls.train(bad)
