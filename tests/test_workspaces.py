from pyspark.sql import functions as F

from tessella.sources import workspaces as W


def test_discovery_and_persistence(spark):
    paths = ["package.json", "tsconfig.json", "web/pyproject.toml", "web/requirements.txt", "web/a.py", "cs/b.csproj", "cs/a.sln", "node_modules/x/package.json", ".hidden/go.mod", "a/b/c/go.mod", "a/b/c/d/go.mod", "a/readme.md"]
    found = W.discover(spark.createDataFrame([(p,) for p in paths], "path string"), "app")
    got = {r.name: (r.rel_path, r.types, r.build_files, r.group_name) for r in found.collect()}
    assert got == {"app": (".", ["node", "typescript"], ["package.json", "tsconfig.json"], None), "web": ("web", ["python"], ["requirements.txt", "pyproject.toml"], "web"), "cs": ("cs", ["csharp"], ["a.sln"], "cs"), "a-b-c": ("a/b/c", ["go"], ["go.mod"], "a")}
    schema = "name string, rel_path string, types array<string>, build_files array<string>, group_name string, source string, last_active_at long"
    stored = spark.createDataFrame([("web", "old", ["x"], [], "g", "auto", 7), ("gone", "gone", [], [], None, "auto", 8), ("cs", "mine", ["y"], [], None, "manual", 9)], schema)
    after = {r.name: (r.rel_path, r.source, r.last_active_at) for r in W.persist(stored, found).collect()}
    assert after == {"app": (".", "auto", 0), "web": ("web", "auto", 7), "cs": ("mine", "manual", 9), "a-b-c": ("a/b/c", "auto", 0)}


def test_resolution_by_tiers(spark):
    rows = [("click", "python/click", "python"), ("python-flask", "python/flask", "Py"), ("Web", "apps/web", "apps"), ("api_v1", "srv/api", "srv"), ("x-1", "x/1", "x"), ("x-2", "x/2", "x")]
    w = spark.createDataFrame(rows, "name string, rel_path string, group_name string")
    want = {"click": ("click", 1), "python/click": ("click", 2), "python\\click": ("click", 2), "web": ("Web", 2), "WEB": ("Web", 3), "py": ("python-flask", 4), "api": ("api_v1", 2), "api_v": (None, None), "python": ("click", 4), "x": (None, None), "deep/Web": ("Web", 2), "none": (None, None), "1": ("x-1", 2)}
    d = spark.createDataFrame([(q,) for q in [*want, "click", None]], "query string")
    assert {r.query: (r.name, r.tier) for r in W.resolve(w, d).collect()} == want
    assert W.resolve(w.where(F.lit(False)), d).where("name is not null").count() == 0
