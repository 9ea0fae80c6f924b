"""Project settings: which files belong to which project, by include, exclude and files with chains of extends.

A setting that a project lacks comes from what it extends, the nearest first, of several the last; a pattern is seen from
the folder of the settings that it stands in.  ``files`` are there whatever is excluded.  Without files and include all
files below the project's folder are included; without exclude, folders of packages are left out, as they are below any
wildcard.  A pattern that ends in a folder's name means all files below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tremor.functions.text import normal_path
from tremor.operators.traversal import _levels

#: Folders that wildcards pass by, and endings of files that are read.
PACKAGES = ("node_modules", "bower_components", "jspm_packages")
SCRIPTS = r"\.(ts|tsx|mts|cts)$"
LISTS = ("files", "include", "exclude")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _joined(folder: Column, path: Column) -> Column:
    """A path seen from a folder, without dots."""
    parts = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path)), "/")

    def step(done: Column, p: Column) -> Column:
        return F.when((p == ".") | (p == "") & (F.size(done) > 0), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(p)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def settings(texts: DataFrame) -> DataFrame:
    """config, bases (paths it extends, the last first), files, include, exclude (null: not set) of settings files
    (file_path, content): JSON with comments and trailing commas; broken text sets nothing."""
    text = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'  # strings stay as they are
    bare = F.regexp_replace("content", rf"(?s){text}|//[^\n]*|/\*.*?\*/", "$1")
    plain = F.regexp_replace(bare, rf"(?s){text}|,(\s*[}}\]])", "$1$2")
    schema = "struct<extends: string, files: array<string>, include: array<string>, exclude: array<string>>"
    v = texts.select(normal_path(F.col("file_path")).alias("config"), F.from_json(plain, schema).alias("v"))
    named = F.coalesce(F.from_json("v.extends", "array<string>"), F.array("v.extends"))
    full = F.transform(F.filter(named, lambda x: x.startswith(".") | x.startswith("/")), lambda x: _joined(_folder(F.col("config")), F.when(x.endswith(".json"), x).otherwise(F.concat(x, F.lit(".json")))))
    return v.select("config", F.reverse(F.when(F.col("v.extends").isNull(), F.array().cast("array<string>")).otherwise(full)).alias("bases"), *(F.col(f"v.{c}").alias(c) for c in LISTS))


def resolved(known: DataFrame) -> DataFrame:
    """config and, for each of LISTS, the list that counts and the folder it is seen from (null: none is set)."""
    links = known.select(F.col("config").alias("at"), F.posexplode("bases").alias("k", "next"))
    start = known.select("config", F.col("config").alias("at"), F.array().cast("array<int>").alias("way"))

    def step(frontier: DataFrame) -> DataFrame:
        found = frontier.join(links, "at").select("config", F.col("next").alias("at"), F.concat("way", F.array("k")).alias("way"))
        return found.groupBy("config", "at").agg(F.min("way").alias("way"))

    chain = _levels(start, ["config", "at"], step, 1000)  # a circle ends where it closes
    own = chain.join(known.select(F.col("config").alias("at"), *LISTS), "at")
    first = lambda c: F.min_by(F.struct(F.col(c).alias("list"), _folder(F.col("at")).alias("folder")), F.when(F.col(c).isNotNull(), F.col("way"))).alias(c)
    return own.groupBy("config").agg(*map(first, LISTS))


def _regex(pattern: Column) -> Column:
    """A regular expression for a pattern with full folders."""
    inner = "(?!(?:" + "|".join(PACKAGES) + ")/)"
    x = F.regexp_replace(pattern, r"([.+^$()|\[\]{}\\])", r"\\$1")
    x = F.regexp_replace(x, r"/\*\*(?=/)", "\u0001")
    x = F.regexp_replace(F.regexp_replace(x, r"\*+", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("^"), F.replace(x, F.lit("\u0001"), F.lit(f"(?:/{inner}[^/]+)*")), F.lit("$"))


def _patterns(of: DataFrame, name: str, folder: bool) -> DataFrame:
    """config, regex, top: patterns of a list, and the folder in front of their first wildcard."""
    each = of.filter(F.col(f"{name}.list").isNotNull()).select("config", F.explode(F.transform(f"{name}.list", lambda x: _joined(F.col(f"{name}.folder"), x))).alias("p"))
    last = F.regexp_extract("p", "[^/]*$", 0)
    below = F.when(F.col("p").endswith("/**"), F.concat("p", F.lit("/*"))).when(F.lit(folder) & ~last.rlike(r"[.*?]"), F.concat("p", F.lit("/**/*"))).otherwise(F.col("p"))
    own = each.select("config", below.alias("p"))
    return own.select("config", _regex(F.col("p")).alias("regex"), F.regexp_replace(F.regexp_replace("p", r"[*?].*$", ""), "/[^/]*$", "").alias("top")).distinct()


def included(known: DataFrame, paths: DataFrame) -> DataFrame:
    """config, file_path: the files (file_path) of each project. known: what ``settings`` gives.

    A pattern meets the files below its first folders only: files are looked up by the folders they lie in.
    """
    of = resolved(known)
    everything = F.struct(F.array(F.lit("**/*")).alias("list"), _folder(F.col("config")).alias("folder"))
    packages = F.struct(F.array(*(F.lit(p) for p in PACKAGES)).alias("list"), _folder(F.col("config")).alias("folder"))
    unset = lambda c: F.col(c).isNull() | F.col(f"{c}.list").isNull()
    of = of.withColumn("include", F.when(unset("include") & unset("files"), everything).otherwise(F.col("include"))).withColumn("exclude", F.when(unset("exclude"), packages).otherwise(F.col("exclude")))
    own = paths.select(normal_path(F.col("file_path")).alias("file_path")).distinct()
    parts = F.split("file_path", "/")
    above = own.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("top"))
    hit = lambda name: above.join(_patterns(of, name, True), "top").filter(F.expr("file_path rlike regex")).select("config", "file_path").distinct()
    # A file that is excluded by name or lies below a folder that is.
    named = F.transform("files.list", lambda x: _joined(F.col("files.folder"), x))
    listed = of.filter(F.col("files.list").isNotNull()).select("config", F.explode(named).alias("file_path")).join(own, "file_path", "left_semi").select("config", "file_path")
    found = hit("include").filter(F.col("file_path").rlike(SCRIPTS)).join(hit("exclude"), ["config", "file_path"], "left_anti")
    return found.union(listed).distinct()
