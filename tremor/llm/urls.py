"""URL filters in DataFrame functions alone: host and path rules, then logistic regression on hashed character n-grams.

A url has a host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and a path (from there up
to ``?``, ``#`` or the end).  A rule fits its host and all subdomains if the path starts with the rule's path; the
longest rule that fits wins (then the longer host, then the earlier rule).  Where no rule fits, a model judges.

The model has a weight for each of ``buckets`` hashes of character n-grams.  Host and path are hashed apart, marked at
both ends, with each run of digits written as 0; a url's vector is the sum of its n-grams, divided by the square root of their
number.  It is trained from a table of labelled urls, which is small by contract (``MOST_LABELS``; a larger table is a
ValueError): all descent steps then run in the space of the examples, on their table of inner products, inside one
expression; weights of buckets are a grouped sum afterwards.  The weights are one constant array of ``buckets`` numbers,
so judging is a projection: no shuffle, no join, and only the url is read.

A null url, or one without ``://``, has empty host and path and is judged by the model like any other; so is an empty
host.  A very long url is hashed whole.  Repeated rows and null ids are rows like any other; other columns are ignored or
kept (``keep``); an empty table gives no rows.  Labelled rows that are null in url or label teach nothing; without any
labelled row of each kind training is a ValueError.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: (verdict, host, path) of the rules of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The labelled urls that the model of the query learns from: names of both kinds take turns in the places, so that only
#: names tell the kinds apart.
BLOCKED = """
casino-royal online-casino win-casino free-bets bets-today sports-bets cheap-pills cheap-meds pills-online adult-x adult-video
xxx-adult spam-farm link-farm spam-links ads-track ad-tracker track-ads poker-win slots-jackpot free-lottery replica-watches
payday-loans cheap-viagra big-jackpot porn-site hot-singles fast-loans click-bait buy-followers malware-download crypto-giveaway
""".split()
ALLOWED = """
weather the-times nations theory thinking stations gardening history mountain reader cooking painting education others weaving
handbook tables research letters anthem island shelter nestling thread together theatre
university school market travel recipes football bridge village hospital journal garden concert orchestra biology physics chemistry
""".split()
PLACES = ("http://{}.example.com/en/1204", "https://www.{}.example.org/de/77.html", "http://blog.{}.example.net/fr/310/?page=2", "https://m.{}.example.com/es/942#top",
          "http://{}.com/news/12", "https://www.{}.edu/index.html", "http://{}.de/", "https://blog.{}.info/a/b")

SIZES, BUCKETS = (2, 3, 4), 32768
MOST_LABELS, STEPS, RATE, DECAY = 500, 400, 2.0, 0.0005


class Model(NamedTuple):
    """bias, and a weight for each bucket; a url is blocked from a probability of ``least`` on."""

    bias: float
    weights: list[float]
    sizes: tuple[int, ...] = SIZES
    least: float = 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """Text (host and path) and verdict of the longest rule that fits; nulls where none does."""
    name = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(reversed(rules), key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):  # stable: an earlier rule is put on top
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _grams(text: Column, mark: str, sizes: tuple[int, ...], buckets: int) -> list[Column]:
    """For each size, the buckets of all n-grams of a text between marks."""
    whole = F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$"))

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(whole) - (n - 1))
        found = F.transform(starts, lambda i: (F.crc32(F.concat(F.lit(mark), F.substring(whole, i, F.lit(n)))) % buckets).cast("int"))
        return F.when(F.length(whole) >= n, found).otherwise(F.array().cast("array<int>"))

    return [of(n) for n in sizes]


def features(host: Column, path: Column, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> Column:
    """Buckets of a url's n-grams, repeated ones as often as they stand."""
    return F.concat(*_grams(host, "h", sizes, buckets), *_grams(path, "p", sizes, buckets))


def labels(spark: SparkSession) -> DataFrame:
    """url, blocked: the small labelled table."""
    rows = [F.struct(F.lit(PLACES[i % len(PLACES)].format(name)).alias("url"), F.lit(y).alias("blocked")) for y, names in ((True, BLOCKED), (False, ALLOWED)) for i, name in enumerate(names)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, least: float = 0.5) -> Model:
    """Logistic regression by ``steps`` steps of gradient descent over all labelled urls."""
    known = labelled.select(F.col(url_col).cast("string").alias("url"), F.col(label_col).cast("boolean").alias("y")).filter("url is not null and y is not null").distinct()
    rows = known.select(F.struct("url", "y").alias("a"), features(*parts(F.col("url")), sizes, buckets).alias("f"))
    n, good = rows.agg(F.count("*"), F.count_if(~F.col("a.y"))).first()
    if n > MOST_LABELS or not 0 < good < n:
        raise ValueError(f"labelled urls must be 2 to {MOST_LABELS} and of both kinds")
    grams = rows.select("a", F.explode("f").alias("bucket"), F.sqrt(F.size("f")).alias("norm")).groupBy("a", "bucket").agg((F.count("*") / F.first("norm")).alias("x"))
    each = grams.union(rows.select("a", F.lit(buckets).alias("bucket"), F.lit(1.0).alias("x")))  # the bias is one more bucket, which all examples have
    other = each.select(F.col("a").alias("b"), "bucket", F.col("x").alias("z"))
    products = each.join(other, "bucket").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("z")).alias("k"))  # n * n, n bounded
    lines = products.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "k"))).alias("line"))
    table = lines.agg(F.array_sort(F.collect_list(F.struct("a", "line"))).alias("t"))

    def step(alpha: Column, _) -> Column:
        def one(e: Column, i: Column) -> Column:
            margin = F.aggregate(F.zip_with(e["line"], alpha, lambda c, a: c["k"] * a), F.lit(0.0), lambda s, v: s + v)
            return F.get(alpha, i) * (1 - rate * decay) - (1 / (1 + F.exp(-margin)) - e["a"]["y"].cast("double")) * (rate / n)

        return F.transform("t", one)

    fit = table.select("t", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.transform("t", lambda _: F.lit(0.0)), step).alias("alpha"))
    shares = fit.select(F.inline(F.zip_with("t", "alpha", lambda e, v: F.struct(e["a"].alias("a"), v.alias("v")))))
    weight = each.join(shares, "a").groupBy("bucket").agg(F.round(F.sum(F.col("x") * F.col("v")), 9).alias("w"))
    found = {r["bucket"]: r["w"] for r in weight.collect()}  # buckets + 1 rows at most
    return Model(found[buckets], [found.get(k, 0.0) for k in range(buckets)], sizes, least)


def probability(host: Column, path: Column, model: Model) -> Column:
    """The model's probability that a url is to be blocked."""
    f = features(host, path, model.sizes, len(model.weights))
    weights = F.split(F.lit(",".join(map(str, model.weights))), ",").cast("array<double>")  # folded to a constant once
    margin = F.aggregate(f, F.lit(0.0), lambda s, k: s + F.get(weights, k)) / F.sqrt(F.greatest(F.size(f), F.lit(1))) + F.lit(model.bias)
    return 1 / (1 + F.exp(-margin))


def judge(pages: DataFrame, model: Model, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, host, path, rule (null: none fits), verdict and the columns of ``keep`` for each row."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    host, path = parts(F.col("_url"))
    split = rows.withColumn("_host", host).withColumn("_path", path)
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    own = F.when(probability(F.col("_host"), F.col("_path"), model) >= model.least, "block").otherwise("allow")
    return split.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)))
