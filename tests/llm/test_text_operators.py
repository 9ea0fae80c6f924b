"""Jaccard join, suffix dedup, language model, classifier, chats and the pipeline against plain versions."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tremor.llm import chat, cnn, jaccard, lm, queries, suffix
from tremor.llm.trie import Trie

SF = "/root/testdata/sf0.001"
TAIL = "é".join(str(k) for k in range(90))
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    passage = "".join(chr(97 + x) for x in np.random.default_rng(2).integers(0, 26, 700))
    near = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, "a b c d e f"), (1, "a b c d e f"), (2, "A  b c d\ne f"), (3, None), (4, ""), (5, " \n"), (None, "x"), (None, "x"), (7, "x"), (None, "q w"), (8, "a b c d e g"),
        (9, passage), (10, passage[:500] + TAIL), (11, "z" * 1000), (12, near), (13, near + " more"), (14, near.replace("w30", "v")), (15, near.upper()), (20, "tail " + passage[150:]),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "block", "shard", "hash", "node", "held", "label")})


def brute_jaccard(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    link = [{b for b in range(n) if b != a and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])} for a in range(n)]
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[a][0], len(link[a]), min(ids, default=None)))
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_jaccard(spark, table, request, monkeypatch):
    monkeypatch.setattr(jaccard, "LARGE", 150)  # groups are dealt by pairs of blocks
    df = request.getfixturevalue(table)
    got = sorted(((r.doc_id, r.n_links, r.component_id) for r in jaccard.links(df).collect()), key=key)
    assert got == sorted(brute_jaccard([(r.doc_id, r.text) for r in df.collect()]), key=key)


def test_one_of_each_group_stays(spark, odd):
    kept = jaccard.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(
        {(r.doc_id, r.text) for r in odd.collect() if (r.doc_id, r.text) in {(1, "a b c d e f"), (3, None), (4, ""), (5, " \n"), (7, "x"), (None, "q w"), (8, "a b c d e g")} or r.doc_id in (9, 10, 11, 12, 20)}, key=key
    )
    assert jaccard.links(odd.limit(0)).collect() == []


def brute_suffix(texts, size=400):
    texts = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[x : x + size] for t in texts for x in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for x in range(len(t) - size + 1):
            if seen[t[x : x + size]] > 1:
                gone[x : x + size] = True
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


DIGEST = {"finish": suffix.digests, "result": "n_bytes long, n_removed long, n_spans long, kept_sha256 string"}


def test_texts_without_words_all_stay(spark):
    bare = [(i, t) for i in (None, 4) for t in (None, "", " \n\x0b\t")] * 2 + [(6, None)]
    rows = [(k, *r) for k, r in enumerate([*bare, (9, "a b"), (9, "a b"), (None, "\u00a0"), (None, "\u00a0")])]
    df = spark.createDataFrame(rows, "place long, doc_id long, text string")
    got = jaccard.deduplicate(df)
    assert got.columns == df.columns
    left = [tuple(r) for r in got.collect()]
    assert sorted(r[0] for r in left if r[0] < len(bare)) == list(range(len(bare))) and all(r == rows[r[0]] for r in left)
    assert sorted((r[1:] for r in left if r[0] >= len(bare)), key=key) == [(9, "a b"), (None, "\u00a0")]


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5, 0.6, 0.8, 0.9, 1.0])
def test_bands_follow_the_threshold(threshold):
    bands, rows = jaccard.banding(threshold)
    assert 1 - (1 - threshold**rows) ** bands >= 0.9997 and jaccard.banding(0.8) == (16, 4)


def test_pairs_at_a_low_threshold_meet(spark):
    pair = lambda k: [(2 * k + j, " ".join([f"a{k}x{i}" for i in range(14)] + [f"b{k}x{j}x{i}" for i in range(5)])) for j in (0, 1)]
    df = spark.createDataFrame([row for k in range(150) for row in pair(k)], "doc_id long, text string")
    assert {r.n_links for r in jaccard.links(df, threshold=0.5).collect()} == {1}  # ten of twenty shingles are shared


def test_large_groups_are_dealt_by_members(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", 16)
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(k, f"{same} tail{k}") for k in range(90)] + [(100, "others have other words here")]
    got = {r.doc_id: r for r in jaccard.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].n_links == 89 and got[k].component_id == 0 for k in range(90)) and got[100].n_links == 0


def test_pairs_of_many_members():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 12, 6)) for _ in range(600)]
    a, b = jaccard.linked(sets, jaccard.Fraction(4, 5))
    plain = [set(x.tolist()) for x in sets]
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j])}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_long_texts(spark):
    """Texts far over the usual length are joined, scored, formatted and judged whole."""
    long = " ".join(f"v{k * k % 9973}" for k in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "short one"), (11, long[1000:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.links(df).collect()}
    assert [got[k].component_id for k in (1, 2, 3, 11)] == [1, 1, 3, 1]
    scored = {r.doc_id: r for r in lm.score_documents(df).collect()}
    assert scored[1].n_tokens == 300_001 and scored[1].n_known == 300_001
    turns = spark.createDataFrame([(1, 0, "user", long), (2, 0, "user", long), (2, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    (only,) = chat.format_chats(turns).collect()
    assert only.conv_id == 2 and long in only.text
    net = cnn.Net.new(2)
    raw = np.frombuffer(long.encode(), np.uint8)
    assert np.isclose(cnn.score(df, net).filter("doc_id = 1").first().score, cnn.scores(net, raw, np.array([0, len(raw)]))[0], atol=1e-6)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_suffix_dedup(spark, table, request):
    df = request.getfixturevalue(table)
    rows = df.collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, brute_suffix([r.text for r in rows]))]
    got = [tuple(r) for r in suffix.remove_repeats(df, **DIGEST).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(x[2] for x in want)


def brute_passages(texts, words, size):
    """Number and bytes of the repeated runs of each text that have size bytes or over so many words."""
    length, texts = 2 * words + 1, [(t or "").encode() for t in texts]
    seen = collections.Counter(t[x : x + length] for t in texts for x in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for x in range(len(t) - length + 1):
            if seen[t[x : x + length]] > 1:
                gone[x : x + length] = b"\1" * length
        runs = [t[m.start() : m.end()] for m in re.finditer(b"\1+", bytes(gone))]
        runs = [r for r in runs if len(r) >= size or len(re.findall(rb"[^\x20\x09-\x0D]+", r)) > words]
        out.append((len(runs), sum(map(len, runs))))
    return out


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_two_lengths_in_one_run(spark, table, request):
    df = request.getfixturevalue(table)
    texts = [r.text for r in df.collect()]
    want = [(r.doc_id, *x, *y) for r, x, y in zip(df.collect(), brute_suffix(texts), brute_passages(texts, 50, 400))]
    result = DIGEST["result"] + ", n_passages long, passage_bytes long"
    got = suffix.remove_repeats(df, finish=suffix.digests_and_passages(400, 50), result=result, length=(400, suffix.least_bytes(50)))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(x[5] > x[3] for x in want) > 0


def test_suffixes_of_one_passage_cross_buckets(spark):
    r = np.random.default_rng(4)
    noise = lambda n: "".join(chr(97 + x) for x in r.integers(0, 26, n))
    passage = noise(620)
    df = spark.createDataFrame([(k, noise(int(r.integers(0, 90))) + passage[int(r.integers(0, 120)) :] + noise(int(r.integers(0, 90)))) for k in range(300)], "doc_id long, text string")
    rows = df.collect()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = [tuple(x)[1:] for x in suffix.remove_repeats(df, **DIGEST).orderBy("doc_id").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute_suffix([x.text for x in rows])


def test_removed_spans_and_texts(spark, odd):
    got = {r.doc_id: r for r in suffix.remove_repeats(odd.filter("doc_id in (9, 10)"), keep=("doc_id", "label")).collect()}
    assert got[9].spans == [[0, 500]] and len(got[9].text) == 200 and got[9].label == 1
    assert got[10].spans == [[0, 500]] and got[10].text == TAIL
    assert suffix.remove_repeats(odd.limit(0)).collect() == []


@pytest.mark.parametrize("size", [40, 101, 250])
def test_suffix_dedup_of_other_lengths(spark, docs, size):
    rows = docs.collect()
    got = [tuple(r) for r in suffix.remove_repeats(docs, **DIGEST, length=size).collect()]
    assert sorted(got, key=key) == sorted(((r.doc_id, *x) for r, x in zip(rows, brute_suffix([r.text for r in rows], size))), key=key)


def test_pipeline_cuts_passages_of_over_fifty_short_words(spark):
    words = lambda a, n: " ".join(f"{chr(97 + (a + i) % 26)}{chr(97 + i // 26)}{i % 10}" for i in range(n))
    long, short, wide, tiny = words(0, 59), words(5, 40), "y" * 450, " ".join(chr(97 + i * i % 26) for i in range(51))
    own = "ABCDEFGH"
    rows = [(k, f"{own[k]} {p} {own[k]}") for k, p in enumerate([long, long, short, short, wide, wide, tiny, tiny])]
    got = {r.doc_id: r.text for r in corpus_pipeline.passages(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert all(len(long) < 400 and got[k] == 2 * own[k] for k in (0, 1, 4, 5, 6, 7))
    assert all(got[k] == rows[k][1] for k in (2, 3))


def test_multikey_sort_and_prefixes():
    r = np.random.default_rng(1)
    strings = [bytes(r.integers(97, 99, r.integers(0, 40)).astype(np.uint8)) for _ in range(400)]
    order, common = suffix.multikey(strings)
    s = [strings[i] for i in order]
    assert s == sorted(strings)
    lcp = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert common.tolist() == [max(lcp(s[i], s[i - 1]) if i else 0, lcp(s[i], s[i + 1]) if i + 1 < len(s) else 0) for i in range(len(s))]


def test_a_prefix_that_ends_before_high_bits():
    # the exclusive or of the two digits has 53 leading ones or more, which a float would round up
    order, common = suffix.multikey([("A" + "éééé").encode(), b"A<V<V<V<V"])
    assert sorted(order.tolist()) == [0, 1] and common.tolist() == [1, 1]


def test_suffix_dedup_of_texts_over_a_block(spark, monkeypatch):
    r = np.random.default_rng(8)
    noise = lambda n: "".join(map(chr, r.integers(97, 123, n).tolist()))
    passage = noise(1000)
    long = noise(suffix.BLOCK) + passage + noise(300_000)
    df = spark.createDataFrame([(1, long), (2, "x" + passage[100:]), (3, noise(5000))], "doc_id long, text string")
    got = {x.doc_id: x for x in suffix.remove_repeats(df).collect()}
    at = suffix.BLOCK + 100
    assert got[1].spans == [[at, at + 900]] and got[2].text == "x" and got[3].spans == []
    assert got[1].text == long[:at] + long[at + 900 :]


def brute_lm(rows, mu):
    texts = [(i, words(t), i is not None and zlib.crc32(str(i).encode()) % 10 == 0) for i, t in rows]
    one, two, context = collections.Counter(), collections.Counter(), collections.Counter()
    pairs = lambda w: zip(["<s>", *w], [*w, ("end",)])
    for _, w, held in texts:
        if not held:
            for a, b in pairs(w):
                one[b] += 1
                two[a, b] += 1
                context[a] += 1
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for i, w, held in texts:
        base = sum(math.log10(p(b)) for _, b in pairs(w))
        score = sum(math.log10((two[a, b] + mu * p(b)) / (context[a] + mu)) for a, b in pairs(w))
        out.append((i, held, len(w) + 1, sum(one[b] > 0 for _, b in pairs(w)), n, base, score))
    return out


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_language_model(spark, table, request):
    df = request.getfixturevalue(table)
    got = sorted((tuple(r) for r in lm.score_documents(df).collect()), key=key)
    want = sorted(brute_lm([(r.doc_id, r.text) for r in df.collect()], lm.MU), key=key)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-6)
        assert a[6] == pytest.approx(b[6], abs=2e-4 * a[2] + 1e-3)


def test_the_model_beats_its_base_on_held_out_text(spark, docs):
    held = lm.score_documents(docs).filter("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert held.s > held.b
    assert lm.score_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 12, 90_000])
def test_trie(n):
    r = np.random.default_rng(n)
    pairs = np.unique(np.stack([r.integers(0, n // 5 + 1, n) * 7, (r.pareto(1, n) * 50).astype(np.int64)], 1), axis=0).reshape(-1, 2)
    value = r.standard_normal(len(pairs))
    trie = Trie(pairs[:, 0], pairs[:, 1], value)
    ask = np.concatenate([pairs, np.stack([r.integers(0, n + 5, n + 3) * 7, r.integers(0, 300, n + 3)], 1)])
    ask = ask[np.lexsort((ask[:, 1], ask[:, 0]))]
    known = {tuple(p): v for p, v in zip(pairs.tolist(), value)}
    hit, out = trie.find(ask[:, 0], ask[:, 1])
    trie.close()
    assert hit.tolist() == [tuple(a) in known for a in ask.tolist()]
    assert all(abs(known[tuple(a)] - v) < 1e-3 for a, h, v in zip(ask.tolist(), hit, out) if h)


def test_quality_network(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = cnn.train(docs, labels)
    held = cnn.score(docs, net).join(labels, "doc_id").filter(cnn.in_fold("doc_id", keep=False)).collect()
    right = np.mean([(r.score >= 0.7) == (r.quality == 1) for r in held])
    assert right > 0.93
    again = cnn.train(docs, labels)
    assert all((a == b).all() for a, b in zip(net.parts(), again.parts()))


def test_scores_do_not_depend_on_neighbours_or_slabs(spark, odd):
    net = cnn.Net.new(1)
    texts = [r.text or "" for r in odd.collect()] + ["ab cd " * 4000]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    all_ = cnn.scores(net, raw, offsets)
    alone = [cnn.scores(net, raw[a:b], np.array([0, b - a]))[0] for a, b in zip(offsets, offsets[1:])]
    assert np.allclose(all_, alone, atol=1e-5) and ((all_ >= 0) & (all_ <= 1)).all()
    halves, first = cnn.halves_max(net, raw, offsets, slab=7)
    assert np.allclose(halves, cnn.halves_max(net, raw, offsets)[0]) and len(first) == len(texts) + 1
    scored = cnn.score(odd, net, keep=("label",))
    assert scored.columns == ["doc_id", "label", "score"] and scored.count() == odd.count()
    assert cnn.score(odd.limit(0), net).collect() == []
    with pytest.raises(ValueError):
        cnn.train(odd, odd.select("doc_id", F.lit(1).alias("quality")))


def naive_score(net, text):
    """One filter place, chunk and layer after another."""
    halves = []
    for lo in range(0, max(1, len(text)), cnn.HALF):
        best = np.full(cnn.FILTERS, -np.inf)
        for place in range(lo, lo + cnn.HALF, cnn.STEP):
            own = sum(net.taps[k][text[place + k] if place + k < len(text) else 0].astype(float) for k in range(cnn.WIDTH))
            best = np.maximum(best, own)
        halves.append(best)
    hidden = []
    for k in range(len(halves)):
        chunk = np.maximum(np.maximum(halves[k], halves[min(k + 1, len(halves) - 1)]) + net.bias, 0)
        hidden.append(np.maximum(chunk @ net.w1 + net.b1, 0))
    z = np.concatenate([np.mean(hidden, axis=0), np.max(hidden, axis=0)]) @ net.w2 + net.b2[0]
    return 1 / (1 + math.exp(-z))


def test_scores_equal_a_plain_loop(odd):
    net = cnn.Net.new(5)
    texts = [(r.text or "").encode() for r in odd.collect()] + [bytes(range(256)) * 3, b"a" * 64, b"a" * 65]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert np.allclose(cnn.scores(net, raw, offsets), [naive_score(net, t) for t in texts], atol=1e-5)


def test_gradients_equal_differences():
    net = cnn.Net(*(p.astype(np.float64) for p in cnn.Net.new(6).parts()))
    texts, labels, weights = [b"some words, and more of them" * 9, b"x", b"", b"zq!" * 70], np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 3])
    _, grads = cnn.gradients(net, texts, labels, weights)
    r = np.random.default_rng(0)
    for part, grad in zip(net.parts(), grads, strict=True):
        flat, own = part.reshape(-1), np.asarray(grad).reshape(-1)
        for k in {int(np.abs(own).argmax()), *r.integers(0, len(flat), 5).tolist()}:
            was, step = flat[k], 1e-6
            flat[k] = was + step
            up = cnn.gradients(net, texts, labels, weights)[0]
            flat[k] = was - step
            down = cnn.gradients(net, texts, labels, weights)[0]
            flat[k] = was
            assert abs((up - down) / (2 * step) - own[k]) < 1e-6 + 1e-4 * abs(own[k])


def test_training_takes_long_texts_and_looks_past_empty_ones(spark):
    good, bad = "plain words stand in this line of text. ", "zz%% ## 00 @@ !! "
    rows = [(k, None) for k in range(40)] + [(40 + k, (good if k % 2 else bad) * (3 + 700 * (k < 4))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    net = cnn.train(df, df.select("doc_id", (F.col("doc_id") % 2).alias("quality")), sample=6)
    score = {r.doc_id: r.score for r in cnn.score(df, net).collect()}
    assert all((score[k] > 0.5) == (k % 2 == 1) for k in range(40, 80))


def _chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "pos", "h1", "n")})


def test_snapshots_collapse(spark):
    turn = lambda c, *ts: [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(ts)]
    rows = turn(1, "a") + turn(2, "a", "b") + turn(3, "a", "b", "c") + turn(4, "a", "x") + turn(5, "a", "b", "c") + turn(6, "b") + turn(6, "b") + turn(7, None) + turn(8, "") + turn(9, "", "y") + [(None, 0, "user", "lost"), (10, None, None, "q"), (10, 3, "user", "r")]
    df = _chats(spark, rows)
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.format_chats(df).collect()}
    assert set(got) == {3, 4, 6, 7, 9, 10}
    assert got[3] == (3, 2, "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n")
    assert got[7][2] == "<|user|>\n<|end|>\n" and got[10][2].startswith("<||>\nq")
    c = duckdb.connect()
    c.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert {r[0]: r[1:] for r in c.sql(chat.ORACLE).fetchall()} == got
    assert chat.format_chats(df.limit(0)).collect() == []


def test_queries_and_oracles(spark):
    assert {f"op{k}" for k in range(1, 11)} == {n.split("_")[0] for n in queries.QUERIES}
    c = duckdb.connect()
    for t in ("embeddings", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(sql).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        assert sorted(got[cols].itertuples(index=False, name=None)) == sorted(want[cols].itertuples(index=False, name=None)), name


def test_pipeline(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "packing"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
    source, good, single, cut, packed = seen
    assert all(d.columns == docs.columns for d in (good, single, cut))
    text = {r.doc_id: r.text for r in source.collect()}
    assert all(text[r.doc_id] == r.text for r in good.collect()) and good.count() < source.count()
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for (i, _), (_, _, least) in zip(rows, brute_jaccard(rows)) if i == least)
    rows = sorted((r.doc_id, r.text) for r in single.collect())
    left = {i: n - gone for (i, _), (n, gone, _, _) in zip(rows, brute_suffix([t for _, t in rows]))}
    assert all(len(r.text.encode()) <= left[r.doc_id] and r.n_chars == len(r.text) for r in cut.collect())
    sizes = lambda df: sorted({(r.doc_id, r.doc_tokens) for r in df.collect()})
    whole = lambda df: all(r.n == r.doc_tokens for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect())
    again = corpus_pipeline.run(spark, sf).cache()  # ranges end by a sample, so pieces may be cut elsewhere
    assert len(sizes(packed)) == cut.count() == len(left) and sizes(again) == sizes(packed)
    assert whole(packed) and whole(again)


def test_pipeline_takes_a_very_long_text(spark):
    line = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 2000").orderBy("doc_id").first().text
    long = " ".join(f"{line[k % 1500 : k % 1500 + 40]} {k}" for k in range(40_000))
    docs = spark.createDataFrame([(1, long), (2, long), (3, line)], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
        assert docs.count() >= 2, name


def test_pipeline_stages_take_odd_rows(spark, odd):
    plain = odd.select("doc_id", "text", F.lit("x").alias("c0"), F.lit("y").alias("_score"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, plain, SF)
        assert got.columns == plain.columns or name == "packing"
        assert stage(spark, plain.limit(0), SF).collect() == []
        if name != "quality classifier":
            assert got.count() > 0
