"""Scalar functions over names, paths and prompts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words without domain signal.
STOPWORDS = """
a an the and or but in on at to for of with by
from as is was are were be been being have has had
do does did will would could should may might shall can
new add make create all this that it its into onto
up out about our my we i you some any each every
more most other another so also just than then when
where which who how what there here get set not no
if want need use using used update change modify delete
remove implement existing current code codebase repo feature
file files module modules function class method type interface
support allow enable ensure provide return call pass handle
""".split()


def short_hash(text: Column) -> Column:
    """Sixteen hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def make_id(file_path: Column, name: Column) -> Column:
    return F.concat(file_path, F.lit("#"), name)


def units16(text: Column) -> Column:
    """Length in UTF-16 code units, in which editors count positions; texts of ASCII alone need no encoding."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_path(path: Column, root: str) -> Column:
    """Path below root with forward slashes; other paths stay whole."""
    p, top = normal_path(path), root.rstrip("/") + "/"
    return F.when(p.startswith(top), F.substring(p, len(top) + 1, 1 << 30)).otherwise(p)


def file_of_first(symbol_id: Column) -> Column:
    """What stands before the first ``#``."""
    return F.substring_index(symbol_id, "#", 1)


def name_of_first(symbol_id: Column) -> Column:
    """What stands after the first ``#``; the whole id if there is none."""
    at = F.instr(symbol_id, "#")
    return F.when(at > 0, symbol_id.substr(at + 1, F.length(symbol_id))).otherwise(symbol_id)


def file_of_last(symbol_id: Column) -> Column:
    """What stands before the last ``#``; the whole id if there is none."""
    return F.when(F.instr(symbol_id, "#") > 0, F.regexp_replace(symbol_id, r"(?s)#[^#]*$", "")).otherwise(symbol_id)


def short_path(path: Column, parts: int = 3) -> Column:
    return F.substring_index(path, "/", -parts)


def path_label(path: Column) -> Column:
    """A path of names: up to three in full, else first, an ellipsis and the last two."""
    n = F.size(path)
    cut = F.concat(F.slice(path, 1, 1), F.array(F.lit("…")), F.slice(path, -2, 2))
    return F.array_join(F.when(n <= 3, path).otherwise(cut), "→")


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


PHANTOM = "__phantom__#"


def symbol_parts(symbol_id: Column) -> Column:
    """(file, name, phantom) of an id for display: file and name part at the last ``#``, phantoms have no file."""
    phantom = symbol_id.startswith(PHANTOM)
    rest = F.substring(symbol_id, len(PHANTOM) + 1, 1 << 30)
    name = F.when(phantom, rest).otherwise(F.substring_index(symbol_id, "#", -1))
    file = F.when(phantom | (F.instr(symbol_id, "#") == 0), F.lit("")).otherwise(F.substring_index(file_of_last(symbol_id), "/", -1))
    return F.struct(file.alias("file"), name.alias("name"), phantom.alias("phantom"))


# What a prediction's status line says.
NO_MATCH = "No matching symbols found."
ALONE = " symbol(s) in scope — none have tracked dependents."
ONLY_NEW = "New symbol(s) to be added — no existing dependents affected."
AT_RISK = (" symbol(s) in scope → ", " dependent(s) at risk")


def prediction_status(n_roots: Column, n_impacted: Column, n_phantoms: Column) -> Column:
    roots = n_roots.cast("string")
    risk = F.concat(roots, F.lit(AT_RISK[0]), n_impacted.cast("string"), F.lit(AT_RISK[1]))
    return F.when(n_roots == 0, NO_MATCH).when(n_impacted > 0, risk).when(n_phantoms > 0, ONLY_NEW).otherwise(F.concat(roots, F.lit(ALONE)))


def tokenise(text: Column) -> Column:
    """Lower-case tokens at case changes and at what is neither letter nor digit; short ones only of short texts."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    raw = F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: t != "")
    return F.when(units16(text) <= 4, raw).otherwise(F.filter(raw, lambda t: F.length(t) > 2))  # tokens are ASCII


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of token sets; 1 for equal texts, 0 if a set is empty."""
    return token_overlap(a, b, tokenise(a), tokenise(b))


def token_overlap(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """As overlap, with the token lists at hand."""
    both = F.size(F.array_intersect(ta, tb)).cast("double")
    return F.when(a == b, F.lit(1.0)).when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(ta, tb)))


def symbol_hint_score(hint: Column, name: Column, hint_tokens: Column | None = None, name_tokens: Column | None = None) -> Column:
    """1 for equal names, a length ratio for containment (nothing below 0.4), else scaled token overlap; or null."""
    h, n = F.lower(hint), F.lower(name)
    lh, ln = units16(h), units16(n)
    ratio = F.least(lh, ln).cast("double") / F.greatest(lh, ln)
    shared = token_overlap(hint, name, tokenise(hint) if hint_tokens is None else hint_tokens, tokenise(name) if name_tokens is None else name_tokens)
    inside = F.when(ratio >= 0.40, F.lit(0.5) + F.lit(0.3) * ratio)
    return F.when(h == n, F.lit(1.0)).when(n.contains(h) | h.contains(n), inside).when(shared >= 0.25, shared * 0.9)


def file_key(path: Column, root: str) -> Column:
    """What file hints are held against: the lower-case path below root."""
    return F.lower(F.replace(normal_path(path), F.lit(root.rstrip("/") + "/"), F.lit("")))


def file_hint_score(hint: Column, key: Column, hint_tokens: Column | None = None, key_tokens: Column | None = None) -> Column:
    """1 for the file's key, 0.6 for a part of it, else half the token overlap; or null. Tokens: of the lower-case texts."""
    h = F.lower(normal_path(hint))
    shared = token_overlap(h, key, tokenise(h) if hint_tokens is None else hint_tokens, tokenise(key) if key_tokens is None else key_tokens)
    return F.when(key == h, F.lit(1.0)).when(key.contains(h), F.lit(0.6)).when(shared >= 0.2, shared * 0.5)


def confidence(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.45, "medium").otherwise("low")


def confidence_rank(level: Column) -> Column:
    return F.when(level == "high", 2).when(level == "medium", 1).otherwise(0)


def rank_confidence(rank: Column) -> Column:
    return F.when(rank >= 2, "high").when(rank == 1, "medium").otherwise("low")


def demote(level: Column) -> Column:
    return F.when(level == "high", "medium").otherwise("low")


def keywords(prompt: Column) -> Column:
    """Words of three letters and more that are no stop words, each once, in order."""
    words = F.filter(F.split(F.lower(prompt), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOPWORDS)))


def keyword_score(words: Column, name: Column, name_tokens: Column | None = None) -> Column:
    """Mean over the words of 1 (a token), 0.7 (a prefix either way), 0.4 (inside the name); null if all are 0."""
    tokens, low = tokenise(name) if name_tokens is None else name_tokens, F.lower(name)

    def points(w: Column) -> Column:
        near = F.exists(tokens, lambda t: t.startswith(w) | w.startswith(t))
        return F.when(F.array_contains(tokens, w), 1.0).when(near, 0.7).when(low.contains(w), 0.4).otherwise(0.0)

    total = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + points(w))
    return F.when(total > 0, F.least(F.lit(1.0), total / F.size(words)))
