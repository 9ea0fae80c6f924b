"""Workspaces: symbols, dependency edges, snapshots, hunks and file events derived from the test tables.

``edges(src, dst)`` reads "src depends on dst".  ``Workspace`` gives DataFrames; ``SQL`` has the same relations as
common table expressions for the oracles, written independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tremor.functions.text import short_hash


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def star_symbols(self) -> DataFrame:
        """Regions, nations, customers, suppliers and orders as symbols; parents by foreign key (ptbl, pk)."""
        c = F.col
        none = F.lit(None)

        def part(source: str, tbl: str, key: str, ptbl: str | None, pkey: str | None, path: Column, name: Column, kind: str, exported: Column) -> DataFrame:
            return self.table(source).select(
                F.lit(tbl).alias("tbl"), c(key).cast("long").alias("k"), F.lit(ptbl).cast("string").alias("ptbl"),
                (c(pkey) if pkey else none).cast("long").alias("pk"), path.alias("file_path"), name.alias("name"),
                F.lit(kind).alias("kind"), exported.alias("is_exported"),
            )

        parts = [
            part("region", "region", "r_regionkey", None, None, F.lit("/ws/src/region/all.ts"), _text("Region", c("r_regionkey")), "interface", F.lit(True)),
            part("nation", "nation", "n_nationkey", "region", "n_regionkey", _text("/ws/src/nation/r", c("n_regionkey"), ".ts"), _text("Nation", c("n_nationkey")), "class", F.lit(True)),
            part("customer", "customer", "c_custkey", "nation", "c_nationkey", _text("/ws/src/customer/n", c("c_nationkey"), ".ts"), _text("Customer", c("c_custkey")), "function", c("c_mktsegment") != "HOUSEHOLD"),
            part("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", _text("/ws/dist/supplier/n", c("s_nationkey"), ".ts"), _text("Supplier", c("s_suppkey")), "variable", c("s_suppkey") % 2 == 0),
            part("orders", "orders", "o_orderkey", "customer", "o_custkey", _text("/ws/src/orders/c", c("o_custkey") % 100, ".ts"), _text("Order", c("o_orderkey")), "method", c("o_orderstatus") == "F"),
        ]
        nodes = parts[0]
        for p in parts[1:]:
            nodes = nodes.unionByName(p)
        slot = c("k") % 50
        return nodes.select(
            _text(c("file_path"), "#", c("name")).alias("id"), "name", "kind", "file_path",
            (slot * 10 + 1).cast("int").alias("start_line"), (slot * 10 + 13).cast("int").alias("end_line"),
            (slot * 100).cast("int").alias("start_pos"), (slot * 100 + 120).cast("int").alias("end_pos"),
            "is_exported", short_hash(_text(c("name"), "|", c("kind"))).alias("signature_hash"), "tbl", "k", "ptbl", "pk",
        )

    def placed_symbols(self) -> DataFrame:
        """All symbols of the star, placed by table and key (ord)."""
        base = F.lit(0)
        for tbl, first in {"nation": 1000, "customer": 10_000, "supplier": 10**12, "orders": 2 * 10**12}.items():
            base = F.when(F.col("tbl") == tbl, first).otherwise(base)
        return self.star_symbols().withColumn("ord", base + F.col("k"))

    def star_edges(self) -> DataFrame:
        s = self.star_symbols()
        child = s.filter("ptbl is not null").select(F.col("id").alias("src"), "ptbl", "pk")
        parent = s.select(F.col("id").alias("dst"), F.col("tbl").alias("ptbl"), F.col("k").alias("pk"))
        return child.hint("merge").join(parent, ["ptbl", "pk"]).select("src", "dst")  # files are small, the rows made of them are not

    def cyc_edges(self, most: float | None = None) -> DataFrame:
        """Parts and suppliers of all line items, or of those of at most so many pieces."""
        line = self.table("lineitem")
        if most is not None:
            line = line.filter(F.col("l_quantity") <= most)
        part, supplier = _text("part#", F.col("l_partkey")), _text("supplier#", F.col("l_suppkey"))
        uses = line.filter("l_returnflag = 'A'").select(part.alias("src"), supplier.alias("dst"))
        gives = line.filter("l_returnflag = 'R'").select(supplier.alias("src"), part.alias("dst"))
        return uses.union(gives).distinct()

    def doc_old(self) -> DataFrame:
        return self.table("documents").filter("doc_id % 11 <> 0").select(_text("/ws/doc/", F.col("doc_id"), ".ts").alias("file_path"), "doc_id", "text")

    def doc_new(self) -> DataFrame:
        text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
        return self.table("documents").filter("doc_id % 7 <> 0").select(_text("/ws/doc/", F.col("doc_id"), ".ts").alias("file_path"), "doc_id", text.alias("text"))

    def hunks(self) -> DataFrame:
        new = self.doc_new().filter("doc_id % 3 <> 0")
        return new.select("file_path", (F.col("doc_id") % 4 + 1).cast("int").alias("new_start"), (F.col("doc_id") % 3).cast("int").alias("new_count"))

    def doc_symbols(self) -> DataFrame:
        """A symbol for each line of each new document, by character offsets."""
        lines = self.doc_new().select("file_path", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
        before = Window.partitionBy("file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
        at = F.coalesce(F.sum(F.length("body") + 1).over(before), F.lit(0))
        return lines.select(
            _text(F.col("file_path"), "#p", F.col("line")).alias("id"), "file_path", (F.col("line") + 1).cast("int").alias("start_line"), (F.col("line") + 1).cast("int").alias("end_line"),
            at.cast("int").alias("start_pos"), (at + F.length("body")).cast("int").alias("end_pos"), (F.col("doc_id") * 1000 + F.col("line")).alias("ord"),
        )

    def file_events(self, events: DataFrame | None = None) -> DataFrame:
        """Events (a table, a stream, or those of the workspace) as file events."""
        kinds = {"view": "edit", "click": "save", "signup": "create", "error": "delete"}
        kind = F.lit("external")
        for event, own in kinds.items():
            kind = F.when(F.col("event_type") == event, own).otherwise(kind)
        return (self.table("events") if events is None else events).select("event_id", F.col("ts").cast("timestamp").alias("ts"), _text("/ws/u/", F.col("user_id"), ".ts").alias("file_path"), kind.alias("kind"), F.lit("h1").alias("handler"))

    def links(self) -> DataFrame:
        """References found in raw pages: a row for each href."""
        found = F.expr(r"""regexp_extract_all(html, 'href="([^"]+)"', 1)""")
        return self.table("pages").select(F.col("url").alias("src"), F.posexplode(found).alias("pos", "dst"))


#: The relations above in DuckDB's SQL, by name; ``oracle`` puts what a query needs in front of it.
SQL = {
    "star_nodes": """
SELECT 'region' AS tbl, CAST(r_regionkey AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS ptbl, CAST(NULL AS BIGINT) AS pk, '/ws/src/region/all.ts' AS file_path, 'Region' || r_regionkey AS name, 'interface' AS kind, TRUE AS is_exported FROM region
UNION ALL SELECT 'nation', n_nationkey, 'region', n_regionkey, '/ws/src/nation/r' || n_regionkey || '.ts', 'Nation' || n_nationkey, 'class', TRUE FROM nation
UNION ALL SELECT 'customer', c_custkey, 'nation', c_nationkey, '/ws/src/customer/n' || c_nationkey || '.ts', 'Customer' || c_custkey, 'function', c_mktsegment <> 'HOUSEHOLD' FROM customer
UNION ALL SELECT 'supplier', s_suppkey, 'nation', s_nationkey, '/ws/dist/supplier/n' || s_nationkey || '.ts', 'Supplier' || s_suppkey, 'variable', s_suppkey % 2 = 0 FROM supplier
UNION ALL SELECT 'orders', o_orderkey, 'customer', o_custkey, '/ws/src/orders/c' || (o_custkey % 100) || '.ts', 'Order' || o_orderkey, 'method', o_orderstatus = 'F' FROM orders""",
    "star_symbols": """
SELECT file_path || '#' || name AS id, name, kind, file_path, CAST(10 * (k % 50) + 1 AS INTEGER) AS start_line, CAST(10 * (k % 50) + 13 AS INTEGER) AS end_line,
  CAST(100 * (k % 50) AS INTEGER) AS start_pos, CAST(100 * (k % 50) + 120 AS INTEGER) AS end_pos, is_exported, substr(sha256(name || '|' || kind), 1, 16) AS signature_hash, tbl, k, ptbl, pk FROM star_nodes""",
    "star_edges": "SELECT c.id AS src, p.id AS dst FROM star_symbols c JOIN star_symbols p ON c.ptbl = p.tbl AND c.pk = p.k",
    "cyc_edges": """
SELECT DISTINCT 'part#' || l_partkey AS src, 'supplier#' || l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'A'
UNION SELECT DISTINCT 'supplier#' || l_suppkey, 'part#' || l_partkey FROM lineitem WHERE l_returnflag = 'R'""",
    "doc_old": "SELECT '/ws/doc/' || doc_id || '.ts' AS file_path, doc_id, text FROM documents WHERE doc_id % 11 <> 0",
    "doc_new": "SELECT '/ws/doc/' || doc_id || '.ts' AS file_path, doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' changed' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0",
    "doc_hunks": "SELECT file_path, CAST(1 + doc_id % 4 AS INTEGER) AS new_start, CAST(doc_id % 3 AS INTEGER) AS new_count FROM doc_new WHERE doc_id % 3 <> 0",
    "doc_lines": "SELECT file_path, doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line FROM doc_new",
    "doc_symbols": """
SELECT file_path || '#p' || line AS id, file_path, CAST(line + 1 AS INTEGER) AS start_line, CAST(line + 1 AS INTEGER) AS end_line, CAST(offs AS INTEGER) AS start_pos, CAST(offs + length(body) AS INTEGER) AS end_pos, doc_id * 1000 + line AS ord
FROM (SELECT *, coalesce(sum(length(body) + 1) OVER (PARTITION BY file_path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs FROM doc_lines)""",
    "file_events": """
SELECT event_id, ts, '/ws/u/' || user_id || '.ts' AS file_path,
  CASE event_type WHEN 'view' THEN 'edit' WHEN 'click' THEN 'save' WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'external' END AS kind, 'h1' AS handler FROM events""",
    "links": """SELECT url AS src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dst, CAST(unnest(range(len(regexp_extract_all(html, 'href="([^"]+)"', 1)))) AS INTEGER) AS pos FROM pages""",
}
NEEDS = {"star_symbols": ["star_nodes"], "star_edges": ["star_symbols"], "doc_hunks": ["doc_new"], "doc_lines": ["doc_new"], "doc_symbols": ["doc_lines"]}


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """body with the named relations in front; body may go on the list of expressions with a leading comma."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in order) + body
