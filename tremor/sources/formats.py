"""Readers of version-control text and of JSON caches, and sinks for the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tremor.operators.numbering import carried, numbered


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
SYMBOLS = _schema(id=_S, name=_S, kind=_S, file_path=_S, start_line=_I, end_line=_I, start_pos=_I, end_pos=_I, is_exported=_B, parent_id=_S, signature_hash=_S, ord=_L)
EDGES = _schema(src=_S, dst=_S)
HASHES = _schema(file_path=_S, sha1=_S)
METADATA = _schema(project_hash=_S, created_at=_S, version=_S)
VERSION = "1.0.0"


def name_status(raw: DataFrame, column: str = "raw", key: str | None = None) -> DataFrame:
    """Staged files (status, file_path, old_file_path) of tab-separated listings, one line for each file."""
    by = [key] if key else []
    lines = raw.select(*by, F.explode(F.split(column, "\n")).alias("line")).select(*by, F.rtrim("line").alias("line")).filter("line <> ''")
    f = F.split("line", "\t")
    status, moved = F.substring(f[0], 1, 1), F.substring(f[0], 1, 1).isin("R", "C") & (F.size(f) >= 3)
    get = lambda i: F.try_element_at(f, F.lit(i))
    return lines.filter(F.size(f) >= 2).select(*by, status.alias("status"), F.when(moved, get(3)).otherwise(get(2)).alias("file_path"), F.when(moved, get(2)).alias("old_file_path"))


_HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def _named_path() -> Column:
    """The path that a line names as a diff's new file; empty for none, null for other lines."""
    named = F.rtrim(F.substring("line", 5, 1 << 30))
    return F.when(F.col("line").startswith("+++ "), F.when(named == "/dev/null", "").otherwise(F.regexp_replace(named, "^b/", "")))


def _ranges(lines: DataFrame, *by: str) -> DataFrame:
    """file_path, new_start, new_count of hunk headers in lines (line, path: the file they belong to)."""
    hit = lines.filter(F.col("line").rlike(_HUNK) & (F.coalesce("path", F.lit("")) != ""))
    number = lambda k: F.regexp_extract("line", _HUNK, k)
    return hit.select(*by, F.col("path").alias("file_path"), number(1).cast("int").alias("new_start"), F.when(number(2) == "", 1).otherwise(number(2).try_cast("int")).alias("new_count")).filter("new_count > 0")


def diff_hunks(raw: DataFrame, column: str = "raw", key: str | None = None) -> DataFrame:
    """Changed ranges (file_path, new_start, new_count) of a unified diff without context; empty ranges are dropped.

    key: the column that tells several diffs apart; without it, all rows are one diff, in the order of nothing but lines.
    """
    lines = raw.select(*([key] if key else []), F.posexplode(F.split(column, "\n")).alias("at", "line"))
    if key is None:
        return diff_lines(lines)
    order = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _ranges(lines.withColumn("path", F.last(_named_path(), ignorenulls=True).over(order)), key)


def diff_lines(lines: DataFrame, order: str = "at") -> DataFrame:
    """The same for one diff of any length as a table of lines (column line, and their order): its lines stay dealt."""
    return _ranges(carried(lines, "path", _named_path(), order))


# JSON caches. A file that is missing, blank, broken, {} or [] reads as nothing.


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    """One row ``v`` with the file's text, or none."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as e:  # noqa: BLE001  a path that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "v string")
    return raw.select(F.trim("value").alias("v")).filter("v not in ('', '{}', '[]')")


_ENTRY = (
    "struct<id:string, name:string, kind:string, filePath:string, startLine:int, endLine:int, startPos:int, endPos:int,"
    " isExported:boolean, parentId:string, signatureHash:string>"
)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a JSON object keyed by id, in its order."""
    entries = read_json_text(spark, path).select(F.posexplode(F.map_entries(F.from_json("v", f"map<string, {_ENTRY}>"))).alias("ord", "e"))
    return _symbols(entries)


def _symbols(entries: DataFrame) -> DataFrame:
    v = lambda n: F.col(f"e.value.{n}")
    return entries.select(
        F.col("e.key").alias("id"), v("name"), v("kind"), v("filePath").alias("file_path"), v("startLine").alias("start_line"), v("endLine").alias("end_line"), v("startPos").alias("start_pos"), v("endPos").alias("end_pos"),
        v("isExported").alias("is_exported"), v("parentId").alias("parent_id"), v("signatureHash").alias("signature_hash"), F.col("ord").cast("long").alias("ord"),
    )


def write_symbol_lines(entries: DataFrame, folder: str) -> None:
    """Entries (id, entry: a struct) as one JSON object in the order of ids, a line for each; its files are its parts in order."""
    whole = numbered(entries, "_n", "id")
    pair = F.to_json(F.create_map("id", "entry"))
    body = F.substring(pair, F.lit(2), F.length(pair) - 2)
    text = F.concat(F.when(F.col("_n") == 0, "{").otherwise(","), body, F.when(F.col("_n") == entries.count() - 1, "\n}").otherwise(""))
    whole.select(text.alias("value")).write.text(folder)


def read_symbol_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of an object written by ``write_symbol_lines``, in its order; no task reads all of it."""
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    text = F.concat(F.lit("{"), F.substring("value", 2, 1 << 30), F.lit("}"))
    entries = lines.filter("value <> '}'").select("_f", "_b", "_i", F.explode(F.from_json(text, f"map<string, {_ENTRY}>")).alias("key", "value"))
    return _symbols(numbered(entries, "ord", "_f", "_b", "_i").select(F.struct("key", "value").alias("e"), "ord"))


def read_edges(spark: SparkSession, path: str, section: str = "present") -> DataFrame:
    """Edges of a sectioned or flat graph file, from its forward lists."""
    lists = "map<string, array<string>>"
    flat = F.from_json("v", f"struct<forward: {lists}>")
    parts = F.from_json("v", f"map<string, struct<forward: {lists}>>")
    forward = F.coalesce(F.try_element_at(parts, F.lit(section))["forward"], flat["forward"]) if section == "present" else F.try_element_at(parts, F.lit(section))["forward"]
    pairs = read_json_text(spark, path).select(F.explode(forward).alias("src", "to"))
    return pairs.select("src", F.explode("to").alias("dst")).distinct()


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    return read_json_text(spark, path).select(F.explode(F.from_json("v", "map<string, string>")).alias("file_path", "sha1"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row, or none unless hash and time are both there."""
    m = read_json_text(spark, path).select(F.from_json("v", "struct<projectHash: string, createdAt: string, version: string>").alias("m"))
    return m.select(F.col("m.projectHash").alias("project_hash"), F.col("m.createdAt").alias("created_at"), F.col("m.version").alias("version")).filter("project_hash <> '' and created_at <> ''")


def read_project(spark: SparkSession, root: str, pattern: str = "*.{ts,tsx,js,jsx}") -> DataFrame:
    """Source files below root: file_path, content, sha1."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", "^file:", "").alias("file_path"), F.decode("content", "UTF-8").alias("content"), F.coalesce(F.sha1("content"), F.lit("")).alias("sha1"))


def project_hash(text: str | None) -> str:
    """SHA-256 of the project's settings; 'unknown' without."""
    import hashlib

    return "unknown" if text is None else hashlib.sha256(text.encode()).hexdigest()


def content_hashes(contents: DataFrame) -> DataFrame:
    """file_path, sha1 of contents (file_path, text); empty for a missing text."""
    return contents.select("file_path", F.coalesce(F.sha1(F.encode("text", "UTF-8")), F.lit("")).alias("sha1"))


# Sinks. Tables are Parquet; the graph is partitioned by section, and writing one section leaves the others.


def write_symbols(symbols: DataFrame, folder: str) -> None:
    symbols.write.mode("overwrite").parquet(f"{folder}/symbols")


def write_edges(edges: DataFrame, folder: str, section: str = "present") -> None:
    out = edges.select("src", "dst").withColumn("section", F.lit(section))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section").parquet(f"{folder}/edges")


def write_hashes(hashes: DataFrame, folder: str) -> None:
    hashes.select("file_path", "sha1").write.mode("overwrite").parquet(f"{folder}/hashes")


def write_metadata(spark: SparkSession, folder: str, hash_: str) -> None:
    row = spark.range(1).select(F.lit(hash_).alias("project_hash"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"), F.lit(VERSION).alias("version"))
    row.write.mode("overwrite").parquet(f"{folder}/metadata")


def write_report(report: DataFrame, folder: str) -> None:
    """A report (one row of nested columns) as JSON text."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{folder}/impact")


def write_report_sections(sections: dict[str, DataFrame], summary: DataFrame, source: str, folder: str) -> None:
    """A report of any size as JSON text: a folder for each section with a line for each entry, and one for the summary."""
    total = summary.select(F.current_timestamp().alias("generated_at"), F.lit(source).alias("source"), F.struct("*").alias("summary"))
    for name, rows in (sections | {"summary": total}).items():
        rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{folder}/impact/{name}")


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cache_ready(spark: SparkSession, folder: str) -> bool:
    return all(_there(spark, f"{folder}/{n}") for n in ("symbols", "edges", "hashes", "metadata"))


def ensure_cache(spark: SparkSession, folder: str) -> None:
    """Empty tables where there are none; existing ones stay."""
    for name, schema in (("symbols", SYMBOLS), ("hashes", HASHES), ("metadata", METADATA), ("edges", T.StructType([*EDGES, T.StructField("section", T.StringType())]))):
        if not _there(spark, f"{folder}/{name}"):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")


def latest_by_type(messages: DataFrame) -> DataFrame:
    """The last payload of each message type (type, ts, payload), to show again what was shown."""
    return messages.groupBy("type").agg(F.max_by("payload", "ts").alias("payload"))
