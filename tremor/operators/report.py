"""Impact reports: roots and impacted symbols made into interfaces, modules, risks and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tremor.functions.text import file_of_first, name_of_first, relative_path
from tremor.operators.numbering import numbered

ROLE_ORDER = ("root", "direct", "indirect")
HIGH_RISK = ("deleted", "signature-ripple")


def involved(roots: DataFrame, impact: DataFrame) -> DataFrame:
    """Roots and impacted symbols: symbol_id, role, reason, depth (0 for roots)."""
    r = roots.select("symbol_id", F.lit("root").alias("role"), "reason", F.lit(0).alias("depth"))
    return r.unionByName(impact.select("symbol_id", "role", F.lit(None).cast("string").alias("reason"), "depth"))


def refs(ids: DataFrame, symbols: DataFrame, root: str) -> DataFrame:
    """ids with name, kind, rel_path, start_line, exported, indexed; unknown ids are read from themselves."""
    known = symbols.select(F.col("id").alias("symbol_id"), "name", "kind", "file_path", "start_line", F.col("is_exported").alias("exported"), F.lit(True).alias("indexed"))
    out = ids.join(known, "symbol_id", "left")
    sid = F.col("symbol_id")
    return out.withColumns(
        {
            "name": F.coalesce("name", name_of_first(sid)), "kind": F.coalesce("kind", F.lit("unknown")), "rel_path": relative_path(F.coalesce("file_path", file_of_first(sid)), root),
            "start_line": F.coalesce("start_line", F.lit(0)), "exported": F.coalesce("exported", F.lit(False)), "indexed": F.coalesce("indexed", F.lit(False)),
        }
    ).drop("file_path")


def role_rank(role: Column) -> Column:
    return F.when(role == "root", 0).when(role == "direct", 1).otherwise(2)


def impacted_apis(listed: DataFrame) -> DataFrame:
    """Exported symbols and all roots. listed: involved with refs."""
    return listed.filter("exported or role = 'root'")


def impacted_modules(listed: DataFrame) -> DataFrame:
    """Counts by role for each file."""
    count = lambda r: F.count_if(F.col("role") == r)
    return listed.groupBy("rel_path").agg(count("root").alias("root_count"), count("direct").alias("direct_count"), count("indirect").alias("indirect_count"), F.count("*").alias("total"))


def ranked_modules(listed: DataFrame) -> DataFrame:
    """Files with rank (from 0): most roots first, then most symbols, then by path."""
    return numbered(impacted_modules(listed), "rank", F.desc("root_count"), F.desc("total"), F.col("rel_path"))


def ranked_risks(listed: DataFrame, confidence: Column | None = None) -> DataFrame:
    """Risky symbols with rank (from 0): high to low, roots before direct and indirect ones, then by id."""
    return numbered(risks(listed, confidence), "rank", risk_rank(F.col("level")), role_rank(F.col("role")), F.col("symbol_id"))


def downstream(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct dependents of each root (root_id, dependent); roots without are left out."""
    return roots.select(F.col("symbol_id").alias("dst")).join(edges, "dst").select(F.col("dst").alias("root_id"), F.col("src").alias("dependent")).distinct()


def risks(listed: DataFrame, confidence: Column | None = None) -> DataFrame:
    """Risky symbols with level and reasons (an array). confidence: a column of listed, for predicted impact."""
    destructive = F.coalesce((F.col("role") == "root") & F.col("reason").isin(*HIGH_RISK), F.lit(False))
    far = (F.col("role") != "root") & (F.col("depth") >= 3)
    vague = F.coalesce(confidence == "low", F.lit(False)) if confidence is not None else F.lit(False)
    said = [F.when(destructive, F.concat(F.lit("root: "), F.col("reason"))), F.when(far, F.concat(F.lit("deep transitive (depth "), F.col("depth"), F.lit(")"))), F.when(vague, F.lit("low prediction confidence"))]
    level = F.when(destructive, "high").when(far, "medium").otherwise("low")
    return listed.withColumn("reasons", F.array_compact(F.array(*said))).filter(F.size("reasons") > 0).withColumn("level", level)


def risk_rank(level: Column) -> Column:
    return F.when(level == "high", 0).when(level == "medium", 1).otherwise(2)


def zones(listed: DataFrame, confidence: Column | None = None) -> DataFrame:
    """listed with zone: unknown for symbols outside the index or predicted with low confidence."""
    vague = F.coalesce(confidence == "low", F.lit(False)) if confidence is not None else F.lit(False)
    return listed.withColumn("zone", F.when(~F.col("indexed") | vague, "unknown").otherwise("known"))


def summary(listed: DataFrame, confidence: Column | None = None) -> DataFrame:
    """One row of totals."""
    count = lambda c: F.count_if(c).alias
    zoned = zones(listed, confidence)
    high = F.coalesce((F.col("role") == "root") & F.col("reason").isin(*HIGH_RISK), F.lit(False))
    return zoned.agg(
        count(F.col("role") == "root")("total_roots"), count(F.col("role") == "direct")("total_direct"), count(F.col("role") == "indirect")("total_indirect"),
        F.count_distinct("rel_path").alias("total_files"), count(high)("high_risk_count"), count(F.col("zone") == "unknown")("unknown_count"),
    )


def named_paths(paths: DataFrame, symbols: DataFrame) -> DataFrame:
    """Paths as arrays of names; an id without symbol names itself."""
    steps = paths.select("run", "symbol_id", "root_id", F.posexplode("path").alias("at", "id"))
    named = steps.join(symbols.select("id", "name"), "id", "left").withColumn("name", F.coalesce("name", "id"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "name")))
    return named.groupBy("run", "symbol_id", "root_id").agg(F.transform(ordered, lambda x: x["name"]).alias("names"))


def sections(listed: DataFrame, roots: DataFrame, edges: DataFrame, confidence: Column | None = None) -> dict[str, DataFrame]:
    """The lists of the document as tables, a row for each entry, with rank (from 0) in the document's order.

    Downstream dependencies are a row for each dependent, so that a root with many of them is not one row.
    """
    ref = F.struct("symbol_id", "name", "kind", "rel_path", "start_line", "exported")
    zoned, by_role = zones(listed, confidence), role_rank(F.col("role"))
    ranked = lambda df, *order: numbered(df, "rank", *order)
    return {
        "impacted_apis": ranked(impacted_apis(listed), by_role, F.col("symbol_id"), F.col("depth"), F.col("reason")).select("rank", ref.alias("symbol"), "role", "reason", "depth"),
        "impacted_modules": ranked_modules(listed).select("rank", "rel_path", "root_count", "direct_count", "indirect_count"),
        "downstream_dependencies": ranked(downstream(roots, edges), F.col("root_id"), F.col("dependent")),
        "high_risk_areas": ranked_risks(listed, confidence).select("rank", ref.alias("symbol"), "level", "reasons"),
        "impact_zones": ranked(zoned, F.col("zone"), F.col("symbol_id")).select("rank", "zone", ref.alias("symbol")),
    }


def document(listed: DataFrame, roots: DataFrame, edges: DataFrame, source: str, confidence: Column | None = None) -> DataFrame:
    """The whole report as one row of nested columns, for a report that a person reads.

    One task holds all of it; ``sections`` are the same lists for a report of any size.
    """
    ref = F.struct("symbol_id", "name", "kind", "rel_path", "start_line", "exported")

    def gather(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
        return df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), value.alias("v")))), lambda x: x["v"]).alias(name))

    apis = gather(impacted_apis(listed), [role_rank(F.col("role")), F.col("symbol_id")], F.struct(ref.alias("symbol"), "role", "reason", "depth"), "impacted_apis")
    modules = gather(impacted_modules(listed), [-F.col("root_count"), -F.col("total"), F.col("rel_path")], F.struct("rel_path", "root_count", "direct_count", "indirect_count"), "impacted_modules")
    down = downstream(roots, edges).groupBy("root_id").agg(F.array_sort(F.collect_list("dependent")).alias("dependents"))
    deps = gather(down, [F.col("root_id")], F.struct("root_id", "dependents"), "downstream_dependencies")
    risky = gather(risks(listed, confidence), [risk_rank(F.col("level")), role_rank(F.col("role")), F.col("symbol_id")], F.struct(ref.alias("symbol"), "level", "reasons"), "high_risk_areas")
    zoned = zones(listed, confidence)
    known = gather(zoned.filter("zone = 'known'"), [F.col("symbol_id")], ref, "known")
    unknown = gather(zoned.filter("zone = 'unknown'"), [F.col("symbol_id")], ref, "unknown")
    total = summary(listed, confidence).select(F.struct("*").alias("summary"))
    out = apis
    for part in (modules, deps, risky, known, unknown, total):
        out = out.crossJoin(part)  # one row each
    return out.select(F.current_timestamp().alias("generated_at"), F.lit(source).alias("source"), "impacted_apis", "impacted_modules", "downstream_dependencies", "high_risk_areas", F.struct("known", "unknown").alias("impact_zones"), "summary")
