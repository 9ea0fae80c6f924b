"""Files of projects by their settings."""

from tremor.sources import projects

CONFIGS = {
    "/ws/tsconfig.json": '{ // all\n "include": ["src", "lib/**/*.ts", /* , ] */ ], "exclude": ["**/skip*", "src/old"] }',
    "/ws/app/tsconfig.json": '{"extends": "../tsconfig", "files": ["main.ts", "src/old.ts"]}',
    "/ws/two/tsconfig.json": '{"extends": ["../tsconfig.json", "./base.json"], "exclude": []}',
    "/ws/two/base.json": '{"include": ["a?/*.ts"], "extends": "./tsconfig.json"}',
    "/ws/plain/tsconfig.json": "{}",
    "/ws/broken/tsconfig.json": "{ not json",
}
PATHS = [
    "/ws/src/a.ts", "/ws/src/deep/b.tsx", "/ws/src/c.js", "/ws/src/skip1.ts", "/ws/src/old/d.ts", "/ws/src/old.ts", "/ws/lib/e.ts", "/ws/lib/x/f.ts", "/ws/lib/g.tsx", "/ws/other.ts", "/ws/src/node_modules/m/i.ts",
    "/ws/app/main.ts", "/ws/app/x.ts", "/ws/two/a1/k.ts", "/ws/two/a12/k.ts", "/ws/two/a1/q/k.ts", "/ws/plain/z.ts", "/ws/plain/q/y.d.ts", "/ws/plain/node_modules/p.ts", "/ws/broken/w.ts", "/ws/broken/w.css",
]


def test_files_of_projects(spark):
    known = projects.settings(spark.createDataFrame(list(CONFIGS.items()), "file_path string, content string"))
    got = {}
    for r in projects.included(known, spark.createDataFrame([(p,) for p in PATHS], "file_path string")).collect():
        got.setdefault(r.config, set()).add(r.file_path)
    base = {"/ws/src/a.ts", "/ws/src/deep/b.tsx", "/ws/src/old.ts", "/ws/lib/e.ts", "/ws/lib/x/f.ts"}
    assert got == {
        "/ws/tsconfig.json": base, "/ws/app/tsconfig.json": base | {"/ws/app/main.ts"}, "/ws/two/tsconfig.json": {"/ws/two/a1/k.ts"}, "/ws/two/base.json": {"/ws/two/a1/k.ts"},
        "/ws/plain/tsconfig.json": {"/ws/plain/z.ts", "/ws/plain/q/y.d.ts"}, "/ws/broken/tsconfig.json": {"/ws/broken/w.ts"},
    }
    assert projects.included(known.limit(0), spark.createDataFrame([("/a.ts",)], "file_path string")).count() == 0
