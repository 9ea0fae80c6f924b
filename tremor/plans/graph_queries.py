"""Queries over the index, the graph and its traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tremor.operators import diff, index, roots as R, traversal
from tremor.plans import lineage
from tremor.plans.registry import query
from tremor.sources import adjacency as adjacency_store
from tremor.sources.workspaces import Workspace, oracle

ROOT = "/ws"
REGION1 = "/ws/src/region/all.ts#Region1"
NATION2 = "/ws/src/nation/r2.ts#Nation2"


def roots_of(w: Workspace, *rows: tuple[str, str, str]) -> DataFrame:
    """Roots (symbol_id, mode, reason) in the given order."""
    return w.spark.createDataFrame([(s, m, r, i) for i, (s, m, r) in enumerate(rows)], "symbol_id string, mode string, reason string, ord long")


def reach_sql(edges: str, root: str, most: int = 60) -> str:
    """Smallest depths of what a deep root reaches, as expressions named b and reach."""
    return f""", b AS (SELECT '{root}' AS id, 0 AS depth UNION SELECT e.src, b.depth + 1 FROM b JOIN {edges} e ON e.dst = b.id WHERE b.depth < {most}),
reach AS (SELECT id AS symbol_id, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY id)"""


IMPACT_SQL = " SELECT symbol_id, depth, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS role FROM reach WHERE depth > 0"


@query(oracle(reach_sql("star_edges", REGION1) + IMPACT_SQL, "star_edges", recursive=True))
def impact_star_depth(w: Workspace) -> DataFrame:
    return traversal.propagate(w.star_edges(), roots_of(w, (REGION1, "deep", "deleted"))).drop("run")


@query(oracle(reach_sql("cyc_edges", "supplier#0") + IMPACT_SQL, "cyc_edges", recursive=True))
def impact_cyclic(w: Workspace) -> DataFrame:
    return traversal.propagate(w.cyc_edges(), roots_of(w, ("supplier#0", "deep", "deleted"))).drop("run")


MIXED = [("supplier#0", "deep", "deleted"), ("part#3", "deep", "renamed"), ("supplier#7", "shallow", "body-change"), ("part#11", "shallow", "body-change")]


@query(
    oracle(
        """, r AS (SELECT * FROM (VALUES ('supplier#0', 'deep'), ('part#3', 'deep'), ('supplier#7', 'shallow'), ('part#11', 'shallow')) t(id, mode)),
b AS (SELECT id, 0 AS depth FROM r WHERE mode = 'deep' UNION SELECT e.src, b.depth + 1 FROM b JOIN cyc_edges e ON e.dst = b.id WHERE b.depth < 60),
reach AS (SELECT id, min(depth) AS depth FROM b GROUP BY id),
near AS (SELECT DISTINCT e.src AS id, 1 AS depth FROM r JOIN cyc_edges e ON e.dst = r.id WHERE r.mode = 'shallow' AND e.src NOT IN (SELECT id FROM r) AND e.src NOT IN (SELECT id FROM reach)),
a AS (SELECT * FROM reach WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT * FROM near)
SELECT id AS symbol_id, CAST(depth AS INTEGER) AS depth, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS role FROM a""",
        "cyc_edges", recursive=True,
    )
)
def impact_mixed(w: Workspace) -> DataFrame:
    return traversal.propagate(w.cyc_edges(), roots_of(w, *MIXED)).drop("run")


def _paths_sql(levels: int) -> str:
    """Level by level: of the paths of a level the one with the smallest list of edge places."""
    parts = [""", e AS (SELECT src, dst, src || '>' || dst AS place FROM cyc_edges),
l0 AS (SELECT id AS root_id, ord AS root_ord, id, [id] AS path, CAST([] AS VARCHAR[]) AS places FROM (VALUES ('supplier#0', 0), ('part#3', 1)) t(id, ord)),
s0 AS (SELECT root_id, id FROM l0)"""]
    for k in range(1, levels + 1):
        parts.append(f"""
l{k} AS (SELECT root_id, root_ord, src AS id, arg_min(path, places) AS path, min(places) AS places FROM (
  SELECT l.root_id, l.root_ord, e.src, list_append(l.path, e.src) AS path, list_append(l.places, e.place) AS places FROM l{k - 1} l JOIN e ON e.dst = l.id
  WHERE NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.root_id = l.root_id AND s.id = e.src)) GROUP BY root_id, root_ord, src),
s{k} AS (SELECT * FROM s{k - 1} UNION SELECT root_id, id FROM l{k})""")
    every = " UNION ALL ".join(f"SELECT root_id, id, path FROM l{k}" for k in range(1, levels + 1))
    tail = f"""
deep AS ({every}),
roots AS (SELECT unnest(['supplier#0', 'part#3', 'supplier#7', 'part#11']) AS id, unnest(range(4)) AS ord),
near AS (SELECT arg_min(r.id, r.ord) AS root_id, e.src AS id FROM roots r JOIN cyc_edges e ON e.dst = r.id WHERE r.ord >= 2
  AND e.src NOT IN (SELECT id FROM roots) AND e.src NOT IN (SELECT id FROM s{levels}) GROUP BY e.src),
a AS (SELECT * FROM deep WHERE id NOT IN (SELECT id FROM roots) UNION ALL SELECT root_id, id, [root_id, id] FROM near)
SELECT id AS symbol_id, root_id, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS depth FROM a"""
    return ",".join(parts) + "," + tail


@query(oracle(_paths_sql(24), "cyc_edges", recursive=True))
def impact_paths(w: Workspace) -> DataFrame:
    edges = w.cyc_edges().withColumn("ord", F.concat("src", F.lit(">"), "dst"))
    found = traversal.explain(edges, roots_of(w, *MIXED))
    return found.select("symbol_id", "root_id", F.array_join("path", ">").alias("path"), "depth")


# Index and lookups.


def _twice(w: Workspace) -> DataFrame:
    """The star symbols, some of them declared again later with another end."""
    s = w.star_symbols()
    first = s.withColumn("ord", F.col("k") * 10)
    again = s.filter("k % 7 = 0").withColumn("end_line", F.col("end_line") + 100).withColumn("ord", F.col("k") * 10 + 5)
    return first.unionByName(again)


@query(
    oracle(
        """, twice AS (SELECT *, k * 10 AS ord FROM star_symbols UNION ALL SELECT * REPLACE (end_line + 100 AS end_line), k * 10 + 5 FROM star_symbols WHERE k % 7 = 0),
f AS (SELECT * FROM twice WHERE starts_with(file_path, '/ws') AND NOT contains(file_path, '/node_modules/') AND NOT contains(file_path, '/.next/') AND NOT contains(file_path, '/dist/') AND NOT contains(file_path, '/out/'))
SELECT id, arg_max(name, ord) AS name, arg_max(kind, ord) AS kind, arg_max(file_path, ord) AS file_path, arg_max(start_line, ord) AS start_line, arg_max(end_line, ord) AS end_line,
  arg_max(is_exported, ord) AS is_exported, arg_max(signature_hash, ord) AS signature_hash, min(ord) AS ord FROM f GROUP BY id""",
        "star_symbols",
    )
)
def symbol_index(w: Workspace) -> DataFrame:
    return index.build_index(_twice(w), ROOT).select("id", "name", "kind", "file_path", "start_line", "end_line", "is_exported", "signature_hash", "ord")


@query(oracle(f" SELECT DISTINCT dst, src FROM star_edges WHERE dst IN ('{REGION1}', '{NATION2}')", "star_edges"))
def dependents(w: Workspace) -> DataFrame:
    return index.dependents(w.star_edges(), [REGION1, NATION2])


_BOTH = f" SELECT 'dependent' AS way, dst AS id, src AS other FROM star_edges WHERE dst IN ('{REGION1}', '{NATION2}') UNION SELECT 'dependency', src, dst FROM star_edges WHERE src IN ('{REGION1}', '{NATION2}')"


@query(oracle(_BOTH, "star_edges"))
def stored_neighbours(w: Workspace) -> DataFrame:
    """Both lookups in edges stored by src and by dst; a folder holds a thousand edges."""
    kept = adjacency_store.store(w.star_edges(), lineage.folder(w.spark), 1000)
    ids = [REGION1, NATION2]
    up = kept.dependents(ids).select(F.lit("dependent").alias("way"), F.col("dst").alias("id"), F.col("src").alias("other"))
    return up.union(kept.dependencies(ids).select(F.lit("dependency"), "src", "dst"))


@query(oracle(f" SELECT DISTINCT src, dst FROM star_edges WHERE src IN ('{REGION1}', '{NATION2}')", "star_edges"))
def dependencies(w: Workspace) -> DataFrame:
    return index.dependencies(w.star_edges(), [REGION1, NATION2])


@query(oracle(" SELECT count(DISTINCT src) AS owners, count(*) AS edges, count(DISTINCT dst) AS targets FROM star_edges", "star_edges"))
def graph_stats(w: Workspace) -> DataFrame:
    return index.graph_stats(w.star_edges())


@query(oracle(" SELECT dst, string_agg(src, ',' ORDER BY src) AS neighbours FROM (SELECT DISTINCT * FROM cyc_edges) GROUP BY dst", "cyc_edges"))
def adjacency(w: Workspace) -> DataFrame:
    return index.adjacency(w.cyc_edges(), "dst", "src").select("dst", F.array_join("neighbours", ",").alias("neighbours"))


@query(
    oracle(
        """, known AS (SELECT id FROM star_symbols WHERE NOT contains(file_path, '/dist/'))
SELECT id FROM (SELECT src AS id FROM star_edges UNION SELECT dst FROM star_edges) WHERE id NOT IN (SELECT id FROM known)""",
        "star_edges",
    )
)
def ghosts(w: Workspace) -> DataFrame:
    return index.ghosts(w.star_edges(), w.star_symbols().filter(index.in_index(F.col("file_path"), ROOT)))


_PATHS = ["/ws/a.ts", "/ws/node_modules/x/b.js", "/ws/.next/c.tsx", "/ws/out/d.jsx", "/other/e.ts", "/ws/typescript/lib/lib.dom.d.ts", "/ws/f.css", "/ws/.tremor/g.ts", "C:\\ws\\h.ts"]
_OK = "starts_with(p, '/ws') AND NOT contains(p, '/node_modules/') AND NOT contains(p, '/.next/') AND NOT contains(p, '/dist/') AND NOT contains(p, '/out/')"


@query(
    oracle(
        f""", f AS (SELECT DISTINCT file_path FROM star_symbols UNION ALL SELECT unnest([{", ".join(f"'{p}'" for p in _PATHS)}])),
n AS (SELECT file_path, replace(file_path, '\\', '/') AS p FROM f)
SELECT file_path, ({_OK}) AS in_index, ({_OK} AND NOT regexp_matches(p, '/typescript/lib/lib\\..*\\.d\\.ts')) AS in_graph,
  (starts_with(p, '/ws') AND NOT contains(p, '/node_modules/') AND NOT contains(p, '/.tremor/') AND regexp_matches(p, '\\.(ts|tsx|js|jsx)$')) AS watched, regexp_matches(file_path, '\\.(ts|tsx|js|jsx)$') AS staged FROM n""",
        "star_symbols",
    )
)
def workspace_filter(w: Workspace) -> DataFrame:
    p = F.col("file_path")
    files = w.star_symbols().select("file_path").distinct().union(w.spark.createDataFrame([(x,) for x in _PATHS], "file_path string"))
    return files.select("file_path", index.in_index(p, ROOT).alias("in_index"), index.in_graph(p, ROOT).alias("in_graph"), index.watched(p, ROOT).alias("watched"), index.script(p).alias("staged"))


@query(oracle(" SELECT DISTINCT src, dst FROM links", "links"))
def link_graph(w: Workspace) -> DataFrame:
    return index.upsert_edges(w.links())


@query(oracle(" SELECT DISTINCT dst AS id FROM links WHERE dst NOT IN (SELECT url FROM pages) UNION SELECT DISTINCT src FROM links WHERE src NOT IN (SELECT url FROM pages)", "links"))
def link_ghosts(w: Workspace) -> DataFrame:
    return index.ghosts(w.links(), w.table("pages").select(F.col("url").alias("id")))


@query(
    oracle(
        """, probe AS (SELECT file_path, CAST(p0 AS INTEGER) AS pos, 'x' || p0 AS dst FROM (SELECT DISTINCT file_path FROM star_symbols) CROSS JOIN (SELECT unnest([0, 50, 130, 1000, 2105, 4900, 9999]) AS p0)),
hit AS (SELECT p.file_path, p.pos, p.dst, s.id, s.end_pos - s.start_pos AS size, s.k FROM probe p JOIN star_symbols s ON s.file_path = p.file_path AND s.start_pos <= p.pos AND p.pos <= s.end_pos)
SELECT file_path, pos, dst, arg_min(id, k * 1000 + size) AS src FROM hit GROUP BY file_path, pos, dst""",
        "star_symbols",
    )
)
def reference_owners(w: Workspace) -> DataFrame:
    symbols = w.star_symbols().withColumn("ord", F.col("k"))
    at = w.spark.createDataFrame([(x,) for x in (0, 50, 130, 1000, 2105, 4900, 9999)], "pos int")
    refs = symbols.select("file_path").distinct().crossJoin(F.broadcast(at)).withColumn("dst", F.concat(F.lit("x"), F.col("pos").cast("string")))
    return index.owners(refs, symbols)


# Roots.


def _changes(w: Workspace) -> DataFrame:
    """Candidate roots from labels and ids of documents."""
    d = w.table("documents").join(w.table("labels"), "doc_id", "left").withColumn("symbol_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return R.candidates(deleted=d.filter("toxic = 1"), ripple=d.filter("doc_id % 5 = 0"), renamed=d.filter("doc_id % 7 = 0"), body=d.filter("quality = 0 or doc_id % 3 = 0"))


@query(
    """WITH d AS (SELECT d.doc_id, 'd' || d.doc_id AS symbol_id, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)),
c AS (SELECT symbol_id, 'deleted' AS reason, 3 AS p, 0 AS s FROM d WHERE toxic = 1 UNION ALL SELECT symbol_id, 'signature-ripple', 2, 1 FROM d WHERE doc_id % 5 = 0
  UNION ALL SELECT symbol_id, 'renamed', 1, 2 FROM d WHERE doc_id % 7 = 0 UNION ALL SELECT symbol_id, 'body-change', 0, 3 FROM d WHERE quality = 0 OR doc_id % 3 = 0)
SELECT symbol_id, arg_max(reason, p) AS reason, CASE WHEN max(p) = 0 THEN 'shallow' ELSE 'deep' END AS mode, CAST(min(s) AS INTEGER) AS source FROM c GROUP BY symbol_id"""
)
def root_dedup(w: Workspace) -> DataFrame:
    return R.dedup(_changes(w)).select("symbol_id", "reason", "mode", F.col("ord.source").alias("source"))


@query(
    oracle(
        """, g AS (SELECT unnest(['supplier#0', 'supplier#3']) AS id),
before AS (SELECT DISTINCT dst AS id, src FROM cyc_edges WHERE dst IN (SELECT id FROM g)),
now AS (SELECT * FROM cyc_edges WHERE dst NOT IN (SELECT id FROM g) AND src NOT IN (SELECT id FROM g)),
t AS (SELECT * FROM now UNION SELECT src, id FROM before),
b AS (SELECT id, 0 AS depth FROM g UNION SELECT e.src, b.depth + 1 FROM b JOIN t e ON e.dst = b.id WHERE b.depth < 60),
reach AS (SELECT id AS symbol_id, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY id)
SELECT symbol_id, depth, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS role FROM reach WHERE depth > 0""",
        "cyc_edges", recursive=True,
    )
)
def in_editor(w: Workspace) -> DataFrame:
    edges = w.cyc_edges()
    gone = w.spark.createDataFrame([("supplier#0",), ("supplier#3",)], "id string")
    before = diff.dependents_before(edges, gone)
    now = edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
    roots = gone.select(F.col("id").alias("symbol_id"), F.lit("deep").alias("mode"))
    return traversal.propagate(diff.restored_edges(now, before), roots).drop("run")


@query(
    oracle(
        """, f AS (SELECT DISTINCT file_path FROM star_symbols WHERE tbl = 'customer' AND k % 3 = 0 UNION SELECT DISTINCT file_path FROM star_symbols WHERE tbl = 'nation')
SELECT id AS symbol_id FROM star_symbols WHERE file_path IN (SELECT file_path FROM f)""",
        "star_symbols",
    )
)
def renamed_roots(w: Workspace) -> DataFrame:
    s = w.star_symbols()
    copied = s.filter("tbl = 'customer' and k % 3 = 0").select(F.lit("C").alias("status"), "file_path", F.lit("/ws/none.ts").alias("old_file_path"))
    moved = s.filter("tbl = 'nation'").select(F.lit("R").alias("status"), F.lit("/ws/new.ts").alias("file_path"), F.col("file_path").alias("old_file_path"))
    edited = s.filter("tbl = 'orders'").select(F.lit("M").alias("status"), "file_path", F.lit(None).cast("string").alias("old_file_path"))
    return R.renamed(s, copied.union(moved).union(edited))


_ROLES = f""", {reach_sql("star_edges", NATION2)[2:]},
ends AS (SELECT src AS id FROM star_edges UNION SELECT dst FROM star_edges),
n AS (SELECT 'n' || (row_number() OVER (ORDER BY id) - 1) AS id, id AS symbol_id FROM ends),
nodes AS (SELECT n.id, n.symbol_id, s.name AS label, CASE WHEN r.depth = 0 THEN 'root' WHEN r.depth = 1 THEN 'direct' WHEN r.depth > 1 THEN 'indirect' ELSE 'other' END AS role,
  (SELECT count(*) FROM star_edges e WHERE e.src = n.symbol_id OR e.dst = n.symbol_id) AS degree FROM n JOIN star_symbols s ON s.id = n.symbol_id LEFT JOIN reach r ON r.symbol_id = n.symbol_id),
arrows AS (SELECT 'e' || (row_number() OVER (ORDER BY e.src, e.dst) - 1) AS id, a.id AS source, b.id AS target, a.role AS ra, b.role AS rb
  FROM star_edges e JOIN nodes a ON a.symbol_id = e.src JOIN nodes b ON b.symbol_id = e.dst)
"""


def _elements(w: Workspace) -> tuple[DataFrame, DataFrame]:
    edges, roots = w.star_edges(), roots_of(w, (NATION2, "deep", "deleted"))
    return index.graph_elements(edges, w.star_symbols(), roots, traversal.propagate(edges, roots))


@query(oracle(_ROLES + "SELECT id, symbol_id, label, role, degree FROM nodes", "star_edges", recursive=True))
def graph_nodes(w: Workspace) -> DataFrame:
    return _elements(w)[0]


@query(oracle(_ROLES + "SELECT id, source, target FROM arrows", "star_edges", recursive=True))
def graph_edges(w: Workspace) -> DataFrame:
    return _elements(w)[1]


@query(oracle(_ROLES + "SELECT id, source, target FROM arrows WHERE ra <> 'other' AND rb <> 'other'", "star_edges", recursive=True))
def session_view(w: Workspace) -> DataFrame:
    return index.session_view(*_elements(w))[1]


@query(
    oracle(
        """, p AS (SELECT k AS probe_id, file_path, CAST(10 * (k % 50) + 12 AS INTEGER) AS line FROM star_symbols WHERE tbl = 'customer' UNION ALL SELECT 1000000 + k, file_path, 100000 FROM star_symbols WHERE tbl = 'nation'),
h AS (SELECT p.probe_id, s.id, row_number() OVER (PARTITION BY p.probe_id ORDER BY s.end_line - s.start_line, s.k) AS n FROM p JOIN star_symbols s ON s.file_path = p.file_path AND s.start_line <= p.line AND p.line <= s.end_line)
SELECT p.probe_id, p.file_path, p.line, h.id FROM p LEFT JOIN h ON h.probe_id = p.probe_id AND h.n = 1""",
        "star_symbols",
    )
)
def innermost_symbol(w: Workspace) -> DataFrame:
    s = w.star_symbols().withColumn("ord", F.col("k"))
    near = s.filter("tbl = 'customer'").select(F.col("k").alias("probe_id"), "file_path", ((F.col("k") % 50) * 10 + 12).cast("int").alias("line"))
    far = s.filter("tbl = 'nation'").select((F.col("k") + 1000000).alias("probe_id"), "file_path", F.lit(100000).alias("line"))
    return index.innermost(near.union(far), s).select("probe_id", "file_path", "line", "id")


@query(oracle(" SELECT file_path, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM star_symbols WHERE tbl IN ('nation', 'region') GROUP BY file_path", "star_symbols"))
def symbols_by_file(w: Workspace) -> DataFrame:
    few = w.star_symbols().filter("tbl in ('nation', 'region')")
    return few.groupBy("file_path").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


