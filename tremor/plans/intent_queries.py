"""Queries over described changes: part names are symbols, conversations and literals are prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tremor.functions import text as X
from tremor.operators import intent, roots as R
from tremor.plans.registry import query
from tremor.sources.workspaces import Workspace, oracle

ROOT = "/ws"
NAMES = ["getUserByID", "a_b", "XMLHttpRequest", "Auth", "authenticate", "barPlot", "plotBar", "applyRateLimiting", "x", "", "HTTPServer2Go"]
_NAMES_SQL = "names AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT p_type FROM part UNION SELECT p_brand FROM part UNION SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]))"


def tokens_sql(x: str) -> str:
    spaced = f"regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array(lower({spaced}), '[^a-z0-9]+'), lambda t: t <> '' AND (length({x}) <= 4 OR length(t) > 2))"


def names(w: Workspace) -> DataFrame:
    part = w.table("part")
    out = w.spark.createDataFrame([(n,) for n in NAMES], "name string")
    for c in ("p_name", "p_type", "p_brand"):
        out = out.union(part.select(c))
    return out.distinct()


@query(f"WITH {_NAMES_SQL} SELECT name, array_to_string({tokens_sql('name')}, ' ') AS tokens FROM names")
def tokenise(w: Workspace) -> DataFrame:
    return names(w).select("name", F.array_join(X.tokenise(F.col("name")), " ").alias("tokens"))


HINTS = ["auth", "plot", "plotBar", "rate limiting", "small ring", "red", "ECONOMY", "Brand#12"]
_HINTS_SQL = "hints AS (SELECT unnest([" + ", ".join(f"'{h}'" for h in HINTS) + "]) AS hint)"
_PAIRS = f"""pairs AS (SELECT hint, name, list_distinct({tokens_sql("hint")}) AS th, list_distinct({tokens_sql("name")}) AS tn FROM hints CROSS JOIN names),
o AS (SELECT *, CASE WHEN hint = name THEN 1.0::DOUBLE WHEN len(th) = 0 OR len(tn) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(th, tn))::DOUBLE / (len(th) + len(tn) - len(list_intersect(th, tn))) END AS shared,
  least(length(hint), length(name))::DOUBLE / greatest(length(hint), length(name)) AS ratio FROM pairs)"""


def _hints(w: Workspace) -> DataFrame:
    return w.spark.createDataFrame([(h,) for h in HINTS], "hint string")


@query(f"WITH {_NAMES_SQL}, {_HINTS_SQL}, {_PAIRS} SELECT hint, name, CAST(round(shared * 1000000) AS BIGINT) AS jaccard FROM o")
def jaccard(w: Workspace) -> DataFrame:
    both = names(w).crossJoin(F.broadcast(_hints(w)))  # eight literal hints
    return both.select("hint", "name", F.round(X.overlap(F.col("hint"), F.col("name")) * 1000000).cast("long").alias("jaccard"))


@query(
    f"""WITH {_NAMES_SQL}, {_HINTS_SQL}, {_PAIRS},
s AS (SELECT hint, name, CASE WHEN lower(hint) = lower(name) THEN 1.0::DOUBLE WHEN contains(lower(name), lower(hint)) OR contains(lower(hint), lower(name)) THEN CASE WHEN ratio >= 0.40::DOUBLE THEN 0.5::DOUBLE + 0.3::DOUBLE * ratio END
  WHEN shared >= 0.25::DOUBLE THEN shared * 0.9::DOUBLE END AS score FROM o)
SELECT hint, name, CAST(round(score * 1000000) AS BIGINT) AS score FROM s WHERE score IS NOT NULL"""
)
def hint_scores(w: Workspace) -> DataFrame:
    both = names(w).crossJoin(F.broadcast(_hints(w)))  # eight literal hints
    score = X.symbol_hint_score(F.col("hint"), F.col("name"))
    return both.withColumn("s", score).filter("s is not null").select("hint", "name", F.round(F.col("s") * 1000000).cast("long").alias("score"))


_STOP = "[" + ", ".join(f"'{s}'" for s in X.STOPWORDS) + "]"


def keywords_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({_STOP}, t))"


@query(
    f"""WITH p AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
w AS (SELECT conv_id, turn, unnest({keywords_sql("text")}) AS word, unnest(range(len({keywords_sql("text")}))) AS n FROM p),
f AS (SELECT conv_id, turn, word, min(n) AS n FROM w GROUP BY ALL)
SELECT p.conv_id, p.turn, coalesce(k.words, '') AS words FROM p LEFT JOIN (SELECT conv_id, turn, string_agg(word, ' ' ORDER BY n) AS words FROM f GROUP BY ALL) k USING (conv_id, turn)"""
)
def prompt_keywords(w: Workspace) -> DataFrame:
    user = w.table("conversations").filter("role = 'user'")
    return user.select("conv_id", "turn", F.array_join(X.keywords(F.col("text")), " ").alias("words"))


# Intents over the star-shaped graph.

INTENTS = [
    (1, "Add rate limiting to Nation3", "modify", ["Nation3", "nation"], [], True),
    (2, "Remove customers of nation five", "delete", ["Customer12", "Customer120"], ["src/customer/n5.ts"], False),
    (3, "Add a Widget beside Region2", "add", ["Region2", "Widget", "region2", "Gadget"], [], False),
    (4, "region tables", "refactor", [], [], False),
    (5, "quantum teleportation", "unknown", [], [], False),
    (6, "tidy one file", "refactor", [], ["src/region/all.ts"], False),
    (7, "order77 wants renaming", "modify", ["Zebra"], ["nowhere.ts"], True),
]
_INTENT = "intent_id long, prompt string, change_type string, symbol_hints array<string>, file_hints array<string>, affects_public_api boolean"


def intents(w: Workspace) -> DataFrame:
    return w.spark.createDataFrame(INTENTS, _INTENT)


def symbols(w: Workspace) -> DataFrame:
    return w.placed_symbols()


def _list(xs: list[str]) -> str:
    return "CAST([" + ", ".join(f"'{x}'" for x in xs) + "] AS VARCHAR[])"


_INTENTS_SQL = "intents AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{p}', '{c}', {_list(s)}, {_list(f)}, {a})" for i, p, c, s, f, a in INTENTS) + ") t(intent_id, prompt, change_type, sh, fh, api))"
_WHERE = "sy AS (SELECT *, CASE tbl WHEN 'region' THEN 0 WHEN 'nation' THEN 1000 WHEN 'customer' THEN 10000 WHEN 'supplier' THEN 1000000000000 ELSE 2000000000000 END + k AS ord FROM star_symbols)"


def _overlap_sql(a: str, b: str, ta: str, tb: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN len({ta}) = 0 OR len({tb}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({ta}, {tb}))::DOUBLE / (len({ta}) + len({tb}) - len(list_intersect({ta}, {tb}))) END"


_RESOLVE = f""", {_INTENTS_SQL}, {_WHERE},
h AS (SELECT intent_id, unnest(sh) AS hint, unnest(range(len(sh))) AS n, 's' AS kind FROM intents UNION ALL SELECT intent_id, unnest(fh), unnest(range(len(fh))), 'f' FROM intents),
hx AS (SELECT h.*, s.id, s.name, s.file_path, s.is_exported, s.ord, lower(hint) AS hl, lower(name) AS nl, lower(substr(file_path, 5)) AS rel FROM h CROSS JOIN sy s),
ht AS (SELECT *, CASE kind WHEN 's' THEN list_distinct({tokens_sql("hint")}) ELSE list_distinct({tokens_sql("hl")}) END AS ta, CASE kind WHEN 's' THEN list_distinct({tokens_sql("name")}) ELSE list_distinct({tokens_sql("rel")}) END AS tb FROM hx),
ho AS (SELECT *, CASE kind WHEN 's' THEN {_overlap_sql("hint", "name", "ta", "tb")} ELSE {_overlap_sql("hl", "rel", "ta", "tb")} END AS shared, least(length(hl), length(nl))::DOUBLE / greatest(length(hl), length(nl)) AS ratio FROM ht),
hs AS (SELECT *, CASE WHEN kind = 's' THEN CASE WHEN hl = nl THEN 1.0::DOUBLE WHEN contains(nl, hl) OR contains(hl, nl) THEN CASE WHEN ratio >= 0.40::DOUBLE THEN 0.5::DOUBLE + 0.3::DOUBLE * ratio END WHEN shared >= 0.25::DOUBLE THEN shared * 0.9::DOUBLE END
  ELSE CASE WHEN rel = hl THEN 1.0::DOUBLE WHEN contains(rel, hl) THEN 0.6::DOUBLE WHEN shared >= 0.2::DOUBLE THEN shared * 0.5::DOUBLE END END AS s FROM ho),
best AS (SELECT intent_id, id, any_value(name) AS name, any_value(file_path) AS file_path, any_value(is_exported) AS is_exported, any_value(ord) AS ord,
  coalesce(max(s) FILTER (kind = 's'), 0) AS ss, coalesce(max(s) FILTER (kind = 'f'), 0) AS fs FROM hs GROUP BY intent_id, id),
comb AS (SELECT b.*, CASE WHEN len(sh) > 0 AND len(fh) > 0 THEN 0.7::DOUBLE * ss + 0.3::DOUBLE * fs WHEN len(sh) > 0 THEN ss ELSE 0.4::DOUBLE * fs END AS raw FROM best b JOIN intents USING (intent_id)),
cand AS (SELECT *, CASE WHEN is_exported THEN least(1.0::DOUBLE, raw + 0.05::DOUBLE) ELSE raw END AS score FROM comb WHERE ss > 0 OR fs > 0),
hc AS (SELECT *, row_number() OVER (PARTITION BY intent_id ORDER BY score DESC, ord) AS rank FROM cand WHERE score >= 0.45::DOUBLE),
kw AS (SELECT intent_id, word FROM (SELECT intent_id, unnest({keywords_sql("prompt")}) AS word FROM intents) GROUP BY ALL),
kp AS (SELECT kw.intent_id, kw.word, s.id, s.name, s.file_path, s.is_exported, s.ord, {tokens_sql("s.name")} AS t, lower(s.name) AS nl FROM kw CROSS JOIN sy s),
kq AS (SELECT *, CASE WHEN list_contains(t, word) THEN 1.0::DOUBLE WHEN len(list_filter(t, lambda x: starts_with(x, word) OR starts_with(word, x))) > 0 THEN 0.7::DOUBLE WHEN contains(nl, word) THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS pts FROM kp),
ks AS (SELECT intent_id, id, any_value(name) AS name, any_value(file_path) AS file_path, any_value(is_exported) AS is_exported, any_value(ord) AS ord, least(1.0::DOUBLE, sum(pts) / count(*)) AS raw FROM kq GROUP BY intent_id, id HAVING sum(pts) > 0),
kc AS (SELECT *, least(1.0::DOUBLE, CASE WHEN is_exported THEN raw + 0.05::DOUBLE ELSE raw END) AS score FROM ks),
kr AS (SELECT *, row_number() OVER (PARTITION BY intent_id ORDER BY score DESC, ord) AS rank FROM kc WHERE score >= 0.25::DOUBLE),
resolved AS (SELECT intent_id, rank, id AS symbol_id, name, substr(file_path, 5) AS file_path, score, 'hints' AS source FROM hc WHERE rank <= 20
  UNION ALL SELECT intent_id, rank, id, name, substr(file_path, 5), score, 'keywords' FROM kr WHERE rank <= 10 AND intent_id NOT IN (SELECT intent_id FROM hc)),
rc AS (SELECT *, CASE WHEN score >= 0.85::DOUBLE THEN 'high' WHEN score >= 0.45::DOUBLE THEN 'medium' ELSE 'low' END AS confidence FROM resolved)
"""


def _sql(body: str, recursive: bool = False) -> str:
    return oracle(_RESOLVE + body, "star_edges", recursive=recursive)


@query(_sql("SELECT intent_id, CAST(rank AS INTEGER) AS rank, symbol_id, name, file_path, confidence, CAST(round(score * 1000000) AS BIGINT) AS score, source FROM rc"))
def resolve_topk(w: Workspace) -> DataFrame:
    return intent.resolve(intents(w), symbols(w), ROOT).withColumn("score", F.round(F.col("score") * 1000000).cast("long")).drop("matched_hints")


@query(_sql("SELECT intent_id, id, CAST(round(score * 1000000) AS BIGINT) AS score FROM kc"))
def keyword_scores(w: Workspace) -> DataFrame:
    return intent.keyword_candidates(intents(w), symbols(w)).select("intent_id", "id", F.round(F.col("score") * 1000000).cast("long").alias("score"))


@query(
    _sql(
        """SELECT i.intent_id, CAST(round(coalesce(k.best, 0) * 1000000) AS BIGINT) AS best_keyword, (i.intent_id IN (SELECT intent_id FROM hc) OR coalesce(k.best, 0) >= 0.30::DOUBLE) AS is_relevant
FROM intents i LEFT JOIN (SELECT intent_id, max(score) AS best FROM kc GROUP BY intent_id) k USING (intent_id)"""
    )
)
def relevance(w: Workspace) -> DataFrame:
    return intent.relevance(intents(w), symbols(w), ROOT).withColumn("best_keyword", F.round(F.col("best_keyword") * 1000000).cast("long"))


@query("SELECT item_id, CASE WHEN c = 'delete' THEN 'deleted' WHEN api THEN 'signature-ripple' ELSE 'body-change' END AS reason, CASE WHEN c = 'delete' OR api THEN 'deep' ELSE 'shallow' END AS mode FROM (SELECT item_id, ['add', 'modify', 'delete', 'refactor', 'unknown'][item_id % 5 + 1] AS c, item_id % 2 = 0 AS api FROM benchmark)")
def virtual_roots(w: Workspace) -> DataFrame:
    kinds = F.array(*map(F.lit, ("add", "modify", "delete", "refactor", "unknown")))
    root = R.of_intent(F.element_at(kinds, (F.col("item_id") % 5 + 1).cast("int")), F.col("item_id") % 2 == 0)
    return w.table("benchmark").select("item_id", root["reason"].alias("reason"), root["mode"].alias("mode"))


@query(
    _sql(
        """, hn AS (SELECT intent_id, unnest(sh) AS hint FROM intents WHERE change_type = 'add')
SELECT DISTINCT intent_id, '__phantom__#' || hint AS symbol_id FROM hn WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.intent_id = hn.intent_id AND lower(r.name) = lower(hint))"""
    )
)
def phantoms(w: Workspace) -> DataFrame:
    return intent.phantoms(intents(w), intent.resolve(intents(w), symbols(w), ROOT)).select("intent_id", "symbol_id")


_PREDICT = """, rt AS (SELECT r.intent_id AS run, r.symbol_id AS id, CASE WHEN i.change_type = 'delete' OR i.api THEN 'deep' ELSE 'shallow' END AS mode, r.rank AS ord,
  CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS conf FROM rc r JOIN intents i USING (intent_id)),
b AS (SELECT run, id AS root, id, 0 AS depth FROM rt WHERE mode = 'deep' UNION SELECT b.run, b.root, e.src, b.depth + 1 FROM b JOIN star_edges e ON e.dst = b.id WHERE b.depth < 20),
reach AS (SELECT run, id, min(depth) AS depth FROM b GROUP BY run, id),
near AS (SELECT rt.run, e.src AS id, arg_min(rt.id, rt.ord) AS root FROM rt JOIN star_edges e ON e.dst = rt.id WHERE rt.mode = 'shallow'
  AND NOT EXISTS (SELECT 1 FROM rt o WHERE o.run = rt.run AND o.id = e.src) AND NOT EXISTS (SELECT 1 FROM reach q WHERE q.run = rt.run AND q.id = e.src) GROUP BY rt.run, e.src),
imp AS (SELECT q.run, q.id, q.depth FROM reach q WHERE NOT EXISTS (SELECT 1 FROM rt o WHERE o.run = q.run AND o.id = q.id) UNION ALL SELECT run, id, 1 FROM near),
via AS (SELECT DISTINCT run, id, root FROM b UNION SELECT run, id, root FROM near),
cf AS (SELECT i.run, i.id, i.depth, max(rt.conf) AS conf FROM imp i JOIN via v ON v.run = i.run AND v.id = i.id JOIN rt ON rt.run = v.run AND rt.id = v.root GROUP BY ALL),
pr AS (SELECT run AS intent_id, id AS symbol_id, CAST(depth AS INTEGER) AS depth, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS role,
  ['low', 'medium', 'high'][greatest(conf - CASE WHEN depth > 1 THEN 1 ELSE 0 END, 0) + 1] AS confidence, regexp_replace(id, '#[^#]*$', '') AS file FROM cf),
scope AS (SELECT DISTINCT r.intent_id, regexp_replace(symbol_id, '#[^#]*$', '') AS file FROM rc r JOIN intents i USING (intent_id) WHERE i.change_type = 'delete'),
kept AS (SELECT * FROM pr p WHERE NOT EXISTS (SELECT 1 FROM scope s WHERE s.intent_id = p.intent_id AND s.file = p.file))
"""


def _predicted(w: Workspace) -> DataFrame:
    resolved = intent.resolve(intents(w), symbols(w), ROOT)
    return intent.predict(intents(w), resolved, w.star_edges())


@query(_sql(_PREDICT + "SELECT intent_id, symbol_id, depth, role, confidence FROM kept", recursive=True))
def predict_confidence(w: Workspace) -> DataFrame:
    return _predicted(w)


@query(_sql(_PREDICT + "SELECT intent_id, confidence, count(*) AS n FROM kept GROUP BY ALL", recursive=True))
def confidence_histogram(w: Workspace) -> DataFrame:
    return _predicted(w).groupBy("intent_id", "confidence").agg(F.count("*").alias("n"))


@query(
    oracle(
        f""", rel AS (SELECT *, substr(file_path, 5) AS f, CASE tbl WHEN 'region' THEN 0 WHEN 'nation' THEN 1000 WHEN 'customer' THEN 10000 WHEN 'supplier' THEN 1000000000000 ELSE 2000000000000 END + k AS ord FROM star_symbols),
fs AS (SELECT f, min(ord) AS ord FROM rel GROUP BY f),
ff AS (SELECT * FROM fs ORDER BY ord LIMIT {intent.FILES_SHOWN}),
ss AS (SELECT * FROM rel ORDER BY is_exported DESC, file_path, name, ord LIMIT {intent.SYMBOLS_SHOWN}),
n AS (SELECT (SELECT count(*) FROM fs) AS f, (SELECT count(*) FROM rel) AS s)
SELECT '## Repository context' || chr(10) || chr(10) || 'Source files (' || least(n.f, {intent.FILES_SHOWN}) || CASE WHEN n.f > {intent.FILES_SHOWN} THEN ' (' || (n.f - {intent.FILES_SHOWN}) || ' more not shown)' ELSE '' END || '):' || chr(10) || (SELECT string_agg('  ' || f, chr(10) ORDER BY ord) FROM ff) || chr(10) || chr(10)
  || 'Indexed symbols (' || least(n.s, {intent.SYMBOLS_SHOWN}) || CASE WHEN n.s > {intent.SYMBOLS_SHOWN} THEN ' (' || (n.s - {intent.SYMBOLS_SHOWN}) || ' more not shown)' ELSE '' END || ', exported first):' || chr(10)
  || (SELECT string_agg('  ' || name || ' [' || kind || CASE WHEN is_exported THEN ', exported' ELSE '' END || '] — ' || f || ':' || start_line, chr(10) ORDER BY is_exported DESC, file_path, name, ord) FROM ss) AS context FROM n""",
        "star_symbols",
    )
)
def repo_context(w: Workspace) -> DataFrame:
    return intent.repo_context(symbols(w), ROOT)


@query(
    f"""SELECT CASE WHEN p THEN '' ELSE 'f' || k || '.ts' END AS file, 'n' || k AS name, p AS phantom,
CASE WHEN k % 4 = 0 THEN '{X.NO_MATCH}' WHEN k % 3 > 0 THEN (k % 4) || '{X.AT_RISK[0]}' || (k % 3) || '{X.AT_RISK[1]}' WHEN k % 2 > 0 THEN '{X.ONLY_NEW}' ELSE (k % 4) || '{X.ALONE}' END AS status,
'&lt;' || k || '&gt; &amp;&quot;' AS html FROM (SELECT p_partkey AS k, p_partkey % 5 = 0 AS p FROM part)"""
)
def display_texts(w: Workspace) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    sid = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(X.PHANTOM + "n"), k)).otherwise(F.concat(F.lit("/ws/a#b/f"), k, F.lit(".ts#n"), k))
    part, n = X.symbol_parts(sid), F.col("p_partkey")
    status = X.prediction_status(n % 4, n % 3, n % 2)
    return w.table("part").select(part["file"].alias("file"), part["name"].alias("name"), part["phantom"].alias("phantom"), status.alias("status"), X.escape_html(F.concat(F.lit("<"), k, F.lit('> &"'))).alias("html"))


@query("SELECT 'v1' AS vendor, 'f' || min(p_size % 7 + 2) AS family, 1 AS rank FROM part WHERE p_size % 7 + 2 = 4")
def first_model(w: Workspace) -> DataFrame:
    models = w.table("part").select(F.lit("v1").alias("vendor"), F.concat(F.lit("f"), (F.col("p_size") % 7 + 2).cast("string")).alias("family")).distinct()
    wanted = w.spark.createDataFrame([(0, "v1", "f99"), (1, "v1", "f4"), (2, "v1", None)], "rank int, vendor string, family string")
    return intent.first_available(models, wanted)


RESPONSES = [
    (1, 'Sure:\n```json\n{"changeType": "add", "symbolHints": ["a", 1, null, "b"], "fileHints": [], "affectsPublicApi": true, "summary": "s"}\n``` done', (None, "add", "a,b", "", True, "s")),
    (2, '{"changeType": "explode", "affectsPublicApi": "yes", "summary": 5}', (None, "unknown", "", "", False, "")),
    (3, "no braces", ("no JSON object", None, None, None, None, None)),
    (4, "{", ("no JSON object", None, None, None, None, None)),
    (5, "} {", ("no JSON object", None, None, None, None, None)),
    (6, "{broken}", ("JSON parse failed", None, None, None, None, None)),
    (7, '{"changeType": 7, "symbolHints": "a", "fileHints": ["x.ts", ["y"]]}', (None, "unknown", "", "x.ts", False, "")),
]


def _lit(v: object) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, bool) else f"'{v}'"


@query("SELECT CAST(i AS BIGINT) AS intent_id, e AS error, c AS change_type, s AS symbol_hints, f AS file_hints, CAST(a AS BOOLEAN) AS affects_public_api, m AS summary FROM (VALUES " + ", ".join(f"({i}, {', '.join(map(_lit, x))})" for i, _, x in RESPONSES) + ") t(i, e, c, s, f, a, m)")
def parse_response(w: Workspace) -> DataFrame:
    raw = w.spark.createDataFrame([(i, "p", r) for i, r, _ in RESPONSES], "intent_id long, prompt string, response string")
    join = lambda c: F.array_join(c, ",").alias(c)
    return intent.parse_response(raw).select("intent_id", "error", "change_type", join("symbol_hints"), join("file_hints"), "affects_public_api", "summary")


