"""Queries over impact reports, on the star-shaped graph with three roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tremor.functions.text import path_label
from tremor.operators import report, traversal
from tremor.plans.graph_queries import roots_of
from tremor.plans.registry import query
from tremor.sources.workspaces import Workspace, oracle

ROOT = "/ws"
GHOST = "/ws/x.ts#C.#priv"
ROOTS = [
    ("/ws/src/region/all.ts#Region1", "deep", "deleted"),
    ("/ws/src/nation/r2.ts#Nation8", "deep", "renamed"),
    ("/ws/src/nation/r0.ts#Nation5", "shallow", "body-change"),
    (GHOST, "deep", "signature-ripple"),
]

_LISTED = """, roots AS (SELECT * FROM (VALUES """ + ", ".join(f"('{s}', '{m}', '{r}')" for s, m, r in ROOTS) + """) t(id, mode, reason)),
b AS (SELECT id, 0 AS depth FROM roots WHERE mode = 'deep' UNION SELECT e.src, b.depth + 1 FROM b JOIN star_edges e ON e.dst = b.id WHERE b.depth < 20),
reach AS (SELECT id, min(depth) AS depth FROM b GROUP BY id),
near AS (SELECT DISTINCT e.src AS id, 1 AS depth FROM roots r JOIN star_edges e ON e.dst = r.id WHERE r.mode = 'shallow' AND e.src NOT IN (SELECT id FROM roots) AND e.src NOT IN (SELECT id FROM reach)),
impact AS (SELECT * FROM reach WHERE id NOT IN (SELECT id FROM roots) UNION ALL SELECT * FROM near),
inv AS (SELECT id AS symbol_id, 'root' AS role, reason, 0 AS depth FROM roots UNION ALL SELECT id, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END, NULL, depth FROM impact),
listed AS (SELECT i.*, coalesce(s.name, substr(i.symbol_id, instr(i.symbol_id, '#') + 1)) AS name, coalesce(s.kind, 'unknown') AS kind,
  substr(coalesce(s.file_path, string_split(i.symbol_id, '#')[1]), 5) AS rel_path, coalesce(s.start_line, 0) AS start_line, coalesce(s.is_exported, FALSE) AS exported, s.id IS NOT NULL AS indexed
  FROM inv i LEFT JOIN star_symbols s ON s.id = i.symbol_id)
"""


def _sql(body: str) -> str:
    return oracle(_LISTED + body, "star_edges", recursive=True)


def _parts(w: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, roots and everything involved."""
    edges, roots = w.star_edges(), roots_of(w, *ROOTS)
    impact = traversal.propagate(edges, roots)
    return edges, roots, report.refs(report.involved(roots, impact), w.star_symbols(), ROOT)


@query(_sql("SELECT symbol_id, role, reason, CAST(depth AS INTEGER) AS depth, name, kind, rel_path, start_line FROM listed WHERE exported OR role = 'root'"))
def impacted_apis(w: Workspace) -> DataFrame:
    return report.impacted_apis(_parts(w)[2]).select("symbol_id", "role", "reason", "depth", "name", "kind", "rel_path", "start_line")


@query(_sql("SELECT rel_path, count(*) FILTER (role = 'root') AS root_count, count(*) FILTER (role = 'direct') AS direct_count, count(*) FILTER (role = 'indirect') AS indirect_count, count(*) AS total FROM listed GROUP BY rel_path"))
def impacted_modules(w: Workspace) -> DataFrame:
    return report.impacted_modules(_parts(w)[2])


@query(_sql("SELECT e.dst AS root_id, e.src AS dependent FROM roots r JOIN star_edges e ON e.dst = r.id"))
def downstream(w: Workspace) -> DataFrame:
    edges, roots, _ = _parts(w)
    return report.downstream(roots, edges)


@query(_sql("SELECT symbol_id, level, CASE level WHEN 'high' THEN 'root: ' || reason ELSE 'deep transitive (depth ' || depth || ')' END AS reasons FROM (SELECT *, CASE WHEN role = 'root' AND reason IN ('deleted', 'signature-ripple') THEN 'high' WHEN role <> 'root' AND depth >= 3 THEN 'medium' END AS level FROM listed) WHERE level IS NOT NULL"))
def risk_areas(w: Workspace) -> DataFrame:
    return report.risks(_parts(w)[2]).select("symbol_id", "level", F.array_join("reasons", "; ").alias("reasons"))


@query(_sql("SELECT symbol_id, CASE WHEN indexed THEN 'known' ELSE 'unknown' END AS zone FROM listed"))
def impact_zones(w: Workspace) -> DataFrame:
    return report.zones(_parts(w)[2]).select("symbol_id", "zone")


@query(
    _sql(
        """SELECT count(*) FILTER (role = 'root') AS total_roots, count(*) FILTER (role = 'direct') AS total_direct, count(*) FILTER (role = 'indirect') AS total_indirect, count(DISTINCT rel_path) AS total_files,
count(*) FILTER (role = 'root' AND reason IN ('deleted', 'signature-ripple')) AS high_risk_count, count(*) FILTER (NOT indexed) AS unknown_count FROM listed"""
    )
)
def impact_summary(w: Workspace) -> DataFrame:
    return report.summary(_parts(w)[2])


@query(
    oracle(
        """, p AS (SELECT id, [id] AS path FROM star_symbols WHERE id = '/ws/src/region/all.ts#Region1' UNION ALL SELECT e.src, list_append(p.path, e.src) FROM p JOIN star_edges e ON e.dst = p.id),
n AS (SELECT id, list_transform(path, lambda x: string_split(x, '#')[2]) AS names FROM p WHERE len(path) > 1)
SELECT id AS symbol_id, CASE WHEN len(names) <= 3 THEN array_to_string(names, '→') ELSE names[1] || '→…→' || names[-2] || '→' || names[-1] END AS label FROM n""",
        "star_edges", recursive=True,
    )
)
def path_labels(w: Workspace) -> DataFrame:
    paths = traversal.explain(w.star_edges(), roots_of(w, ROOTS[0]))
    return report.named_paths(paths, w.star_symbols()).select("symbol_id", path_label(F.col("names")).alias("label"))
