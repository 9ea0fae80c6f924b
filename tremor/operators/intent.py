"""Described changes: resolution to symbols, virtual roots and predicted impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tremor.functions import text as X
from tremor.operators import roots as R, traversal
from tremor.plans.lineage import cut

HINTS, KEYWORDS = 20, 10
#: Below so many characters names also have keys of one and two; a shorter text inside a longer one has two fifths of it.
SHORT = 10
#: Keys of all intents together that are sent to the executors.
FEW = 100_000


def _grams(text: Column) -> Column:
    """Strings of three characters in a text; of a short one also those of one and two, of an empty one itself."""
    n, none = F.length(text), F.array().cast("array<string>")
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))).otherwise(none)
    return F.concat(of(3), F.when(n < SHORT, F.concat(of(1), of(2))).otherwise(none), F.when(n == 0, F.array(F.lit(""))).otherwise(none))


def _tagged(tag: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(tag), v))


def _name_keys(name: Column, tokens: Column) -> Column:
    """What a name can meet a hint or word by: strings in it (i), its own start (s), its tokens (t)."""
    low = F.lower(name)
    return F.concat(_tagged("i", _grams(low)), _tagged("s", F.array(F.substring(low, 1, 3))), _tagged("t", tokens))


def _hint_keys(hint: Column, tokens: Column) -> Column:
    """Equal names, a name around the hint, one inside of it, or shared tokens: one key at least is a name's, too."""
    low = F.lower(hint)
    return F.concat(_tagged("i", F.array(F.substring(low, 1, 3))), _tagged("s", _grams(low)), _tagged("t", tokens))


def _word_keys(word: Column) -> Column:
    """A word in a name, at a token's start or going on from a token, which may be of one or two letters."""
    return F.concat(_tagged("i", F.array(F.substring(word, 1, 3))), _tagged("t", F.array(F.substring(word, 1, 1), F.substring(word, 1, 2))))


def _paired(symbols: DataFrame, intents: DataFrame) -> DataFrame:
    """Symbols and intents that share a key, each pair once; both have an array ``keys``, which goes.

    Symbols are many, so they are never what a join sends whole to the executors: intents are, up to FEW keys, which are
    counted; beyond that both are shuffled by their keys.
    """
    asked = intents.select("intent_id", F.explode(F.array_distinct("keys")).alias("_key"))
    if asked.count() > FEW:
        each = symbols.select("id", F.explode(F.array_distinct("keys")).alias("_key")).hint("merge").join(asked, "_key")
        return each.select("id", "intent_id").distinct().join(symbols.drop("keys").hint("merge"), "id").join(intents.drop("keys").hint("merge"), "intent_id")
    each = symbols.withColumn("_key", F.explode(F.array_distinct("keys"))).join(F.broadcast(asked), "_key")
    both = each.join(F.broadcast(intents.withColumnRenamed("keys", "_asked")), "intent_id")
    return both.filter(F.col("_key") == F.array_intersect("keys", "_asked")[0]).drop("_key", "keys", "_asked")  # of several shared keys the first


def _improving(hints: Column, score) -> Column:
    """Running maximum over hints: (best, matched), matched being the hints that raised it."""
    start = F.struct(F.lit(0.0).alias("best"), F.array().cast("array<string>").alias("matched"))

    def step(acc: Column, h: Column) -> Column:
        s = score(h)
        better = s.isNotNull() & (s > acc["best"])
        return F.struct(F.when(better, s).otherwise(acc["best"]).alias("best"), F.when(better, F.concat(acc["matched"], F.array(h["hint"]))).otherwise(acc["matched"]).alias("matched"))

    return F.aggregate(hints, start, step)


def _with_tokens(hints: Column, text=lambda h: h) -> Column:
    return F.transform(F.coalesce(hints, F.array().cast("array<string>")), lambda h: F.struct(h.alias("hint"), X.tokenise(text(h)).alias("tokens")))


def hint_candidates(intents: DataFrame, symbols: DataFrame, root: str) -> DataFrame:
    """Symbols that hints point to: intent_id, id, name, file_path, ord, score (0.45 and above), matched_hints."""
    asked = intents.select("intent_id", _with_tokens(F.col("symbol_hints")).alias("sh"), _with_tokens(F.col("file_hints"), lambda h: F.lower(X.normal_path(h))).alias("fh")).filter("size(sh) + size(fh) > 0")
    # By the least score that counts, an intent with name hints needs one that scores, another one the very file.
    by_names = F.flatten(F.transform("sh", lambda h: _hint_keys(h["hint"], h["tokens"])))
    by_files = _tagged("f", F.transform("fh", lambda h: F.lower(X.normal_path(h["hint"]))))
    asked = asked.withColumn("keys", F.when(F.size("sh") > 0, by_names).otherwise(by_files))
    key = X.file_key(F.col("file_path"), root)
    own = symbols.select("id", "name", "file_path", "is_exported", "ord", X.tokenise(F.col("name")).alias("tokens"), key.alias("key"), X.tokenise(key).alias("key_tokens"))
    pairs = _paired(own.withColumn("keys", F.concat(_name_keys(F.col("name"), F.col("tokens")), _tagged("f", F.array("key")))), asked)
    by_name = _improving(F.col("sh"), lambda h: X.symbol_hint_score(h["hint"], F.col("name"), h["tokens"], F.col("tokens")))
    by_file = _improving(F.col("fh"), lambda h: X.file_hint_score(h["hint"], F.col("key"), h["tokens"], F.col("key_tokens")))
    s, f = F.col("s.best"), F.col("f.best")
    plain = F.when((F.size("sh") > 0) & (F.size("fh") > 0), F.lit(0.7) * s + F.lit(0.3) * f).when(F.size("sh") > 0, s).otherwise(F.lit(0.4) * f)
    score = F.when(F.col("is_exported"), F.least(F.lit(1.0), plain + 0.05)).otherwise(plain)
    scored = pairs.withColumn("s", by_name).withColumn("f", by_file).withColumn("score", score).withColumn("matched_hints", F.array_distinct(F.concat("s.matched", "f.matched")))
    return scored.filter((F.col("score") >= 0.45) & (F.size("matched_hints") > 0)).select("intent_id", "id", "name", "file_path", "ord", "score", "matched_hints")


def keyword_candidates(intents: DataFrame, symbols: DataFrame, least: float = 0.0) -> DataFrame:
    """Symbols that words of the prompt point to, like hint_candidates."""
    asked = intents.select("intent_id", X.keywords(F.col("prompt")).alias("words")).filter("size(words) > 0")
    own = symbols.select("id", "name", "file_path", "is_exported", "ord", X.tokenise(F.col("name")).alias("tokens"))
    pairs = _paired(own.withColumn("keys", _name_keys(F.col("name"), F.col("tokens"))), asked.withColumn("keys", F.flatten(F.transform("words", _word_keys))))
    plain = X.keyword_score(F.col("words"), F.col("name"), F.col("tokens"))
    scored = pairs.withColumn("plain", plain).filter("plain is not null")
    score = F.least(F.lit(1.0), F.when(F.col("is_exported"), F.col("plain") + 0.05).otherwise(F.col("plain")))
    return scored.withColumn("score", score).filter(F.col("score") >= least).select("intent_id", "id", "name", "file_path", "ord", "score", F.col("words").alias("matched_hints"))


def _top(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("intent_id").orderBy(F.desc("score"), "ord")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def resolve(intents: DataFrame, symbols: DataFrame, root: str) -> DataFrame:
    """Ranked symbols of each intent: hints' best 20, or the keywords' best 10 where no hint matches anything."""
    hinted = cut(_top(hint_candidates(intents, symbols, root), HINTS)).withColumn("source", F.lit("hints"))  # asked for twice
    words = _top(keyword_candidates(intents, symbols, 0.25), KEYWORDS).withColumn("source", F.lit("keywords"))
    words = words.join(hinted.select("intent_id").distinct(), "intent_id", "left_anti")
    both = hinted.unionByName(words)
    return both.select("intent_id", "rank", F.col("id").alias("symbol_id"), "name", X.relative_path(F.col("file_path"), root).alias("file_path"), X.confidence(F.col("score")).alias("confidence"), "matched_hints", "score", "source")


def relevance(intents: DataFrame, symbols: DataFrame, root: str) -> DataFrame:
    """intent_id, best_keyword (0 if nothing), is_relevant: a hint matched or a keyword scores 0.3."""
    hinted = hint_candidates(intents, symbols, root).select("intent_id").distinct().withColumn("hinted", F.lit(True))
    best = keyword_candidates(intents, symbols).groupBy("intent_id").agg(F.max("score").alias("best"))
    out = intents.select("intent_id").join(hinted, "intent_id", "left").join(best, "intent_id", "left")
    score = F.coalesce("best", F.lit(0.0))
    return out.select("intent_id", score.alias("best_keyword"), (F.col("hinted").isNotNull() | (score >= 0.30)).alias("is_relevant"))


def virtual_roots(intents: DataFrame, resolved: DataFrame) -> DataFrame:
    """Roots of each intent (run is the intent): resolved symbols, and phantoms of additions."""
    kind = R.of_intent(F.col("change_type"), F.col("affects_public_api"))
    real = resolved.join(intents.select("intent_id", "change_type", "affects_public_api"), "intent_id")
    real = real.select(F.col("intent_id").alias("run"), "symbol_id", kind["mode"].alias("mode"), kind["reason"].alias("reason"), F.col("rank").cast("long").alias("ord"))
    made = phantoms(intents, resolved).join(intents.select("intent_id", "change_type", "affects_public_api"), "intent_id")
    made = made.select(F.col("intent_id").alias("run"), "symbol_id", kind["mode"].alias("mode"), kind["reason"].alias("reason"), (F.lit(1000) + F.col("at")).cast("long").alias("ord"))
    return real.unionByName(made)


def phantoms(intents: DataFrame, resolved: DataFrame) -> DataFrame:
    """Symbols that an addition would make: hints whose name resolved to nothing, whatever the case. Each once."""
    hints = intents.filter("change_type = 'add'").select("intent_id", F.posexplode("symbol_hints").alias("at", "hint"))
    have = resolved.select("intent_id", F.lower("name").alias("low")).distinct()
    new = hints.withColumn("low", F.lower("hint")).join(have, ["intent_id", "low"], "left_anti")
    new = new.groupBy("intent_id", "hint").agg(F.min("at").alias("at"))
    return new.select("intent_id", F.concat(F.lit(X.PHANTOM), F.col("hint")).alias("symbol_id"), F.col("hint").alias("name"), F.lit("function").alias("kind"), F.lit(True).alias("is_exported"), "at")


def predict(intents: DataFrame, resolved: DataFrame, edges: DataFrame) -> DataFrame:
    """Predicted impact: intent_id, symbol_id, depth, role, confidence.

    Phantoms have no dependents and start nothing.  A symbol has the best confidence of the roots that reach it, one tier
    lower beyond depth 1 (once, however far).  For a deletion, symbols in the files of resolved symbols go with it and are
    not listed.
    """
    resolved = cut(resolved)  # a few rows for each intent, used five times
    roots = cut(virtual_roots(intents, resolved).filter(~F.col("symbol_id").startswith(X.PHANTOM)))
    reach = traversal.reach_by_root(edges, roots)
    rank = X.confidence_rank(F.col("confidence"))
    of_root = resolved.select(F.col("intent_id").alias("run"), F.col("symbol_id").alias("root_id"), rank.alias("rank"))
    known = reach.join(of_root, ["run", "root_id"], "left").groupBy("run", "symbol_id").agg(F.min("depth").alias("depth"), F.max("rank").alias("rank"))
    known = known.withColumn("role", traversal.role_of(F.col("depth")))
    level = F.coalesce("rank", F.lit(0)) - F.when(F.col("depth") > 1, 1).otherwise(0)
    listed = known.select(F.col("run").alias("intent_id"), "symbol_id", "depth", "role", X.rank_confidence(F.greatest(level, F.lit(0))).alias("confidence"))
    scope = resolved.join(_deleting(intents), "intent_id", "left_semi").select("intent_id", X.file_of_last(F.col("symbol_id")).alias("file")).distinct()
    return listed.withColumn("file", X.file_of_last(F.col("symbol_id"))).join(scope, ["intent_id", "file"], "left_anti").drop("file")


def confidence_histogram(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("confidence").agg(F.count("*").alias("n"))


def _deleting(intents: DataFrame) -> DataFrame:
    """Ids of intents that delete. Few of them are sent to the resolved symbols, as a shuffle by intent would put all symbols
    of one in one task."""
    ids = cut(intents.filter("change_type = 'delete'").select("intent_id").distinct())
    return F.broadcast(ids) if ids.count() <= FEW else ids


def deletions(intents: DataFrame, resolved: DataFrame) -> DataFrame:
    """What each intent that deletes takes from the index (intent_id, id)."""
    return resolved.join(_deleting(intents), "intent_id", "left_semi").select("intent_id", F.col("symbol_id").alias("id")).distinct()


def without_deleted(intents: DataFrame, resolved: DataFrame, symbols: DataFrame, intent_id: int) -> DataFrame:
    """The index as one intent's deletion would leave it; the graph stays as it is."""
    own = F.col("intent_id") == intent_id
    return symbols.join(deletions(intents.filter(own), resolved.filter(own)).select("id"), "id", "left_anti").select(*symbols.columns)


# Text for a language model, and its answer.

FILES_SHOWN, SYMBOLS_SHOWN = 150, 400


def repo_context(symbols: DataFrame, root: str) -> DataFrame:
    """One row, ``context``: the first files of the index and the first symbols, exported ones first."""
    rel = X.relative_path(F.col("file_path"), root)
    files = symbols.groupBy(rel.alias("f")).agg(F.min("ord").alias("ord"))
    counts = symbols.agg(F.count_distinct(rel).alias("n_files"), F.count("*").alias("n_symbols"))
    shown = files.orderBy("ord").limit(FILES_SHOWN).agg(F.array_sort(F.collect_list(F.struct("ord", "f"))).alias("files"))
    order = [F.desc("is_exported"), F.collate("file_path", "UNICODE"), F.collate("name", "UNICODE"), F.col("ord")]
    line = F.concat(F.lit("  "), F.col("name"), F.lit(" ["), F.col("kind"), F.when(F.col("is_exported"), ", exported").otherwise(""), F.lit("] — "), rel, F.lit(":"), F.col("start_line").cast("string"))
    first = symbols.orderBy(*order).limit(SYMBOLS_SHOWN).withColumn("line", line).withColumn("at", F.row_number().over(Window.orderBy(*order)))
    lines = first.agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))

    def more(total: str, most: int) -> Column:
        return F.when(F.col(total) > most, F.concat(F.lit(" ("), (F.col(total) - most).cast("string"), F.lit(" more not shown)"))).otherwise("")

    one = counts.crossJoin(shown).crossJoin(lines)  # one row each
    text = F.concat(
        F.lit("## Repository context\n\nSource files ("), F.size("files").cast("string"), more("n_files", FILES_SHOWN), F.lit("):\n"),
        F.array_join(F.transform("files", lambda x: F.concat(F.lit("  "), x["f"])), "\n"),
        F.lit("\n\nIndexed symbols ("), F.size("lines").cast("string"), more("n_symbols", SYMBOLS_SHOWN), F.lit(", exported first):\n"), F.array_join(F.col("lines.line"), "\n"),
    )
    return one.select(text.alias("context"))


PROMPT = """Read the planned change of a code base below and answer with one JSON object and nothing else.
Its fields: changeType (add, modify, delete, refactor or unknown), symbolHints (names), fileHints (paths),
affectsPublicApi (true or false) and summary (a sentence).
{context}
Planned change: {prompt}"""


def prompt_text(prompt: Column, context: Column | None = None, template: str = PROMPT) -> Column:
    """The text for a model; with a context, names and paths must come from it."""
    only = "Use only names and paths of this list; leave a list empty if nothing fits.\n"
    shown = F.lit("") if context is None else F.when(context.isNull(), "").otherwise(F.concat(F.lit(only), context))
    before, _, rest = template.partition("{context}")
    middle, _, after = rest.partition("{prompt}")
    return F.concat(F.lit(before), shown, F.lit(middle), prompt, F.lit(after))


def first_available(models: DataFrame, preferences: DataFrame) -> DataFrame:
    """The model that the first satisfied preference names. models: vendor, family; preferences: rank, vendor, family
    (null: any). No row if none fits."""
    p = preferences.select("rank", F.col("vendor").alias("v"), F.col("family").alias("f"))
    fit = models.join(p, (F.col("vendor") == F.col("v")) & (F.col("f").isNull() | (F.col("family") == F.col("f"))))
    return fit.orderBy("rank", "family").limit(1).select("vendor", "family", "rank")


def joined_stream(chunks: DataFrame) -> DataFrame:
    """Whole responses of chunks (intent_id, seq, text)."""
    return chunks.groupBy("intent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("response"))


def parse_response(responses: DataFrame) -> DataFrame:
    """Descriptors of model responses (intent_id, prompt, response): typed columns, or error.

    Fences are stripped and the text from the first { to the last } is parsed.  An unknown change type is 'unknown',
    list items that aren't strings are dropped, a flag that isn't a boolean is false, a summary that isn't text is empty.
    """
    bare = F.trim(F.regexp_replace("response", "(?i)```(?:json)?", ""))
    first, back = F.instr(bare, "{"), F.instr(F.reverse(bare), "}")
    last = F.when(back > 0, F.length(bare) - back + 1).otherwise(0)
    found = (first > 0) & (last > first)
    body = F.when(found, bare.substr(first, last - first + 1))
    rows = responses.withColumn("found", found).withColumn("v", F.try_parse_json(body))
    get = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    is_a = lambda v, kind: F.coalesce(F.schema_of_variant(v) == kind, F.lit(False))

    def strings(name: str) -> Column:
        items = F.try_variant_get("v", f"$.{name}", "array<variant>")
        kept = F.filter(items, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
        return F.coalesce(F.transform(kept, lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))

    kind = F.try_variant_get("v", "$.changeType", "string")
    valid = is_a(get("changeType"), "STRING") & kind.isin("add", "modify", "delete", "refactor", "unknown")
    parsed = F.col("v").isNotNull()
    error = F.when(~F.col("found"), "no JSON object").when(~parsed, "JSON parse failed")
    blank = F.trim("prompt") == ""
    return rows.select(
        "intent_id", "prompt", F.when(blank, "empty prompt").otherwise(error).alias("error"),
        F.when(parsed, F.when(valid, kind).otherwise("unknown")).alias("change_type"), F.when(parsed, strings("symbolHints")).alias("symbol_hints"), F.when(parsed, strings("fileHints")).alias("file_hints"),
        F.when(parsed, F.when(is_a(get("affectsPublicApi"), "BOOLEAN"), F.try_variant_get("v", "$.affectsPublicApi", "boolean")).otherwise(False)).alias("affects_public_api"),
        F.when(parsed, F.when(is_a(get("summary"), "STRING"), F.try_variant_get("v", "$.summary", "string")).otherwise("")).alias("summary"),
    )
