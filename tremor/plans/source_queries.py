"""Queries over source text: a file for each customer, made of its row, and one that all of them import."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tremor.plans.registry import query
from tremor.sources import projects, scripts
from tremor.sources.workspaces import Workspace

#: A file in parts; <k> stands for the customer's key and <n> for its nation's.
_PARTS = (
    "import { Base, type Kind as K } from './base';\n/* class Not<k> { } */\n",
    "export class C<k> extends Base implements Zed, Able {\n  ",
    "readonly size: K | null = null;",
    "\n  // run() {\n  ",
    "run(first: string, n = <n>): Able & Zed {\n    const text = `a${help<k>(first)}b`;\n    return this.size ?? text;\n  }",
    "\n}\n",
    "function help<k>(x: { b: 1; a: 2 }) {\n  const Base = x;\n  return Base;\n}",
    "\nexport const ",
    "make<k> = (K: number): Base => new Base(K, '}')",
    ";\n",
    "export enum Tone<k> { Low = <n>, High, Loud = 'x' }",
    "\n",
)
_BASE = "export class Base {}\nexport type Kind = 'b' | 'a';\n"


def _pieces(part: str) -> list[str]:
    """Plain text and column names by turns."""
    return part.replace("<k>", "\0c_custkey\0").replace("<n>", "\0c_nationkey\0").split("\0")


def _sources(w: Workspace) -> DataFrame:
    text = lambda part: F.concat(*(F.col(x).cast("string") if j % 2 else F.lit(x) for j, x in enumerate(_pieces(part))))
    own = w.table("customer").select(F.concat(F.lit("/ws/c"), F.col("c_custkey").cast("string"), F.lit(".ts")).alias("file_path"), F.concat(*map(text, _PARTS)).alias("content"))
    return own.union(w.spark.createDataFrame([("/ws/base.ts", _BASE)], "file_path string, content string"))


def _sql(part: str) -> str:
    return " || ".join(x if j % 2 else "'" + x.replace("'", "''") + "'" for j, x in enumerate(_pieces(part)))


_TEXTS = ", ".join(f"{_sql(p)} AS p{j}" for j, p in enumerate(_PARTS))
_AT = ", ".join(f"length({' || '.join(['chr(0)', *(f'p{i}' for i in range(j))])}) - 1 AS a{j}" for j in range(len(_PARTS) + 1))
_FILES = f"WITH t AS (SELECT c_custkey AS k, c_nationkey AS n, '/ws/c' || c_custkey || '.ts' AS file_path, {_TEXTS} FROM customer), f AS (SELECT *, {_AT} FROM t) "


def _rows(name: str, kind: str, lines: tuple[int, int], start: str, end: str, exported: bool, parent: str, signature: str, ord_: int) -> str:
    return f"""SELECT file_path || '#' || {name} AS id, {name} AS name, '{kind}' AS kind, file_path, {lines[0]} AS start_line, {lines[1]} AS end_line, {start} AS start_pos, {end} AS end_pos, {exported} AS is_exported,
{parent} AS parent_id, substr(sha256({signature}), 1, 16) AS signature_hash, {ord_} AS ord FROM f"""


_CLASS = "file_path || '#C' || k"
_SYMBOLS = [
    _rows("'help' || k", "function", (11, 14), "a6", "a7", False, "NULL", "'(x:{ a: 2; b: 1 }):any'", 0),
    _rows("'C' || k", "class", (3, 10), "a1", "a6 - 1", True, "NULL", "'class:Base:[Able,Zed]'", 1),
    _rows("'C' || k || '.run'", "method", (6, 9), "a4", "a5", True, _CLASS, "'(first:string,n:number):Able & Zed'", 2),
    _rows("'C' || k || '.size'", "property", (4, 4), "a2", "a3", True, _CLASS, "'K | null'", 3),
    _rows("'Tone' || k", "enum", (16, 16), "a10", "a11", True, "NULL", "'High=' || (n + 1) || ',Loud=x,Low=' || n", 4),
    _rows("'make' || k", "variable", (15, 15), "a8", "a9", True, "NULL", "'(K: number) => Base'", 5),
    "SELECT '/ws/base.ts#Base', 'Base', 'class', '/ws/base.ts', 1, 1, 0, length('export class Base {}'), true, NULL, substr(sha256('class::[]'), 1, 16), 0",
    "SELECT '/ws/base.ts#Kind', 'Kind', 'type', '/ws/base.ts', 2, 2, 21, 21 + length('export type Kind = ''b'' | ''a'';'), true, NULL, substr(sha256('''a'' | ''b'''), 1, 16), 1",
]


@query(_FILES + " UNION ALL ".join(_SYMBOLS))
def extract_symbols(w: Workspace) -> DataFrame:
    return scripts.extract_symbols(_sources(w))


_REFERENCES = [
    ("'#C' || k", "'/ws/base.ts#Base'"), ("'#C' || k", "'/ws/base.ts#Kind'"), ("'#C' || k || '.run'", "file_path || '#help' || k"), ("'#C' || k || '.run'", "file_path || '#C' || k || '.size'"),
    ("'#make' || k", "'/ws/base.ts#Base'"),
]


@query(_FILES + " UNION ALL ".join(f"SELECT file_path || {src} AS src, {dst} AS dst FROM f" for src, dst in _REFERENCES))
def walk_references(w: Workspace) -> DataFrame:
    files = scripts.read(_sources(w))
    return scripts.walk_references(files, scripts.extract_symbols(files), "/ws")


@query(
    """WITH f AS (SELECT '/ws/n' || (p_partkey % 25) || '/' || ['src/', 'lib/', 'src/deep/', ''][p_size % 4 + 1] || CASE WHEN p_partkey % 6 = 0 THEN 'skip' ELSE 'f' END || p_partkey || CASE WHEN p_partkey % 10 = 0 THEN '.js' ELSE '.ts' END AS file_path,
  p_partkey % 25 AS n, p_size % 2 = 0 AND p_partkey % 10 <> 0 AS own, p_partkey % 6 = 0 AS skip FROM part),
c AS (SELECT n_nationkey AS k, n_nationkey % 3 AS r FROM nation)
SELECT '/ws/n' || k || '/tsconfig.json' AS config, file_path FROM c JOIN f ON f.n = k - r WHERE own AND NOT (r > 0 AND skip)
UNION ALL SELECT '/ws/n' || k || '/tsconfig.json', '/ws/n' || k || '/only.ts' FROM c WHERE r = 2"""
)
def project_files(w: Workspace) -> DataFrame:
    """Files of a project for each nation: every third has settings of its own, the next two extend the one before."""
    n, p = F.col("n_nationkey"), F.col("p_partkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    above = text('{"extends": "../n', n - 1, '/tsconfig.json", ')
    own = F.when(n % 3 == 0, '{"include": ["src"], /* the rest is not */}').when(n % 3 == 1, F.concat(above, F.lit('"exclude": ["../**/skip*"]}'))).otherwise(F.concat(above, F.lit('"files": ["only.ts"]}')))
    configs = w.table("nation").select(text("/ws/n", n, "/tsconfig.json").alias("file_path"), own.alias("content"))
    folder = F.element_at(F.array(*map(F.lit, ("src/", "lib/", "src/deep/", ""))), (F.col("p_size") % 4 + 1).cast("int"))
    named = text("/ws/n", p % 25, "/", folder, F.when(p % 6 == 0, "skip").otherwise("f"), p, F.when(p % 10 == 0, ".js").otherwise(".ts"))
    paths = w.table("part").select(named.alias("file_path")).union(w.table("nation").select(text("/ws/n", n, "/only.ts")))
    return projects.included(projects.settings(configs), paths)
