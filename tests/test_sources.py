import json
import subprocess

from pyspark.sql import functions as F

from tremor.operators import checks
from tremor.sources import cache, files, git


def repository(at, *commits):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-c", "init.defaultBranch=main", *a], cwd=at, check=True, capture_output=True)
    at.mkdir(exist_ok=True)
    run("init", "-q")
    for contents in commits:
        for name, text in contents.items():
            path = at / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.unlink(missing_ok=True) if text is None else path.write_text(text)
        run("add", "-A")
        run("commit", "-q", "-m", "c")
    return run


def test_change_lists_and_snapshots(spark, tmp_path):
    root = tmp_path / "r"
    long = "".join(f"line {k}\n" for k in range(30))
    run = repository(root, {"a.py": "x = 1\n", "b.py": long, "c.py": "z\n"}, {"a.py": "x = 2\n", "b.py": None, "d/b2.py": long, "c.py": None})
    got = {tuple(r) for r in git.change_list(spark, str(root), from_ref="HEAD~1", to_ref="HEAD").collect()}
    assert got == {("a.py", "M", None, "py"), ("c.py", "D", "c.py", "py"), ("d/b2.py", "R100", "b.py", "py")}
    assert {r.path: r.text for r in git.snapshot(spark, str(root), "HEAD~1").collect()} == {"a.py": "x = 1\n", "b.py": long, "c.py": "z\n"}
    assert git.blob(str(root), "HEAD", "c.py") == "" and git.blob(str(root), "HEAD", "a.py") == "x = 2\n"
    (root / "a.py").write_text("x = 3\ny = 4\n")
    (root / "e.py").write_text("new\n")
    run("add", "e.py")
    assert {(r.path, r.status) for r in git.change_list(spark, str(root)).collect()} == {("a.py", "M"), ("e.py", "A")}
    assert {r.path for r in git.change_list(spark, str(root), staged=True).collect()} == {"e.py"}
    scope = git.Scope(spark, str(root), str(tmp_path / "kept"))
    assert [r.path for r in scope.files().collect()] == ["a.py", "e.py"]
    assert {tuple(r) for r in scope.changed_lines().collect()} == {("a.py", 1), ("a.py", 2), ("e.py", 1)}
    assert [r.path for r in scope.files(from_ref="HEAD~1", to_ref="HEAD").collect()] == ["a.py", "d/b2.py"]
    run("update-ref", "refs/remotes/origin/main", "HEAD~1")
    assert scope.anchor("HEAD~1", "HEAD") == "refs/remotes/origin/main"
    run("update-ref", "-d", "refs/remotes/origin/main")
    assert scope.anchor("HEAD~1", "HEAD") == "refs/remotes/origin/main" and scope.anchor() is None  # kept, and asked again


def test_change_base_of_upstream(spark, tmp_path):
    root = tmp_path / "r"
    run = repository(root, {"a": "1"}, {"b": "1"}, {"c": "1"}, {"d": "1"})
    assert git.change_base(spark, str(root)) is None
    for name, at in (("origin/main", "HEAD"), ("upstream/master", "HEAD~3"), ("upstream/sprint/1", "HEAD~2"), ("upstream/sprint/2", "HEAD~1")):
        run("update-ref", f"refs/remotes/{name}", at)
    assert git.remotes(str(root)) == ["upstream", "origin"]
    assert git.change_base(spark, str(root)) == "refs/remotes/upstream/sprint/2"
    run("update-ref", "refs/remotes/upstream/master", "HEAD")
    assert git.base_candidates(str(root), "upstream") == [("refs/remotes/upstream/master", 0)]


def test_cache(spark, tmp_path):
    at = str(tmp_path / "cache")
    assert cache.load(spark, at).count() == 0
    rows = spark.createDataFrame([("py", "a.py", "h1", 3, "old a"), ("py", "gone.py", "h", 3, "x"), ("py", "b.py", "h0", 3, "old b"), ("templates", "t.html", "h", 3, "t")], cache.CACHE)
    assert cache.save(rows, at) and cache.load(spark, at, "py").count() == 3
    now = spark.createDataFrame([("a.py", "h1"), ("b.py", "h2"), ("c.py", "h3")], "path string, hash string")
    looked = []

    def analyse(stale):
        looked.extend(sorted(r.path for r in stale.collect()))
        return stale.select("path", F.concat(F.lit("new "), "path").alias("payload"))

    assert cache.save(cache.refreshed(cache.load(spark, at), "py", now, analyse, 3), at)
    assert looked == ["b.py", "c.py"]
    assert {(r.section, r.path, r.hash, r.payload) for r in cache.load(spark, at).collect()} == {("py", "a.py", "h1", "old a"), ("py", "b.py", "h2", "new b.py"), ("py", "c.py", "h3", "new c.py"), ("templates", "t.html", "h", "t")}
    (tmp_path / "flat.json").write_text(json.dumps({"a.py": {"hash": "h", "analysis": {"v": 3, "usages": []}}}))
    (tmp_path / "parts.json").write_text(json.dumps({"py": {}, "templates": {"t.html": {"hash": "g"}}, "frontend": 7}))
    (tmp_path / "bad.json").write_text("{")
    assert [tuple(r)[:4] for r in cache.load_json(spark, str(tmp_path / "flat.json")).collect()] == [("py", "a.py", "h", 3)]
    assert [tuple(r)[:4] for r in cache.load_json(spark, str(tmp_path / "parts.json")).collect()] == [("templates", "t.html", "g", None)]
    assert cache.load_json(spark, str(tmp_path / "bad.json")).count() == 0


def test_baselines_and_reports(spark, tmp_path):
    message = {"line": 3, "column": 1, "ruleId": "semi", "message": "m"}
    shapes = {"list": [{"filePath": "/r/a.ts", "messages": [message, {"line": 1}]}], "results": {"results": [{"filePath": "/r/a.ts", "messages": [message]}]}, "keys": {"./a.ts": ["3:1:semi"], "b": 4}, "none": 3}
    for name, data in shapes.items():
        (tmp_path / name).write_text(json.dumps(data))
        got = {tuple(r) for r in files.lint_baseline(spark, str(tmp_path / name)).collect()}
        assert got == {"keys": {("a.ts", "3:1:semi")}, "none": set()}.get(name, {("/r/a.ts", "3:1:semi")}), name
    assert files.lint_baseline(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "fmt").write_text("./src/a.ts\n\nsrc/b.ts\n")
    assert {r.path for r in files.format_baseline(spark, str(tmp_path / "fmt")).collect()} == {"src/a.ts", "src/b.ts"}
    text = spark.createDataFrame([(json.dumps([{"filePath": "/r/a.ts", "messages": [message, {**message, "line": 9}]}, {"filePath": "/r/b.ts", "messages": []}]),)], "text string")
    found = checks.nested_messages(text)
    assert {(r.path, r.line, r.code) for r in found.collect()} == {("/r/a.ts", 3, "semi"), ("/r/a.ts", 9, "semi")}
    assert [r.line for r in checks.not_in_baseline(found, files.lint_baseline(spark, str(tmp_path / "keys"))).collect()] == [9]
    said = spark.createDataFrame([("Checking formatting...\n[warn] src/a.ts\n[warn] src/b.ts\n[warn] Code style issues found in 2 files.\n",)], "text string")
    assert {r.path for r in checks.unformatted(said).collect()} == {"src/a.ts", "src/b.ts"}
    diff = spark.createDataFrame([("f", "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n a\n-b\n+B\n--- a/y.py\n+++ b/y.py\n@@ -5 +5 @@\n-q\n+Q")], "name string, text string")
    lines = spark.createDataFrame([("x.py", 2), ("y.py", 7)], "path string, line int")
    assert [r.text for r in checks.format_hunks(checks.diff_rows(diff), lines).orderBy("pos").collect()] == ["-b", "+B"]


def test_texts_and_tracked(spark):
    f = spark.createDataFrame([("a.py", bytearray(b"\xef\xbb\xbfx\xff"), True), ("jquery-1.js", bytearray(b"y"), True), ("n.js", bytearray(b"z"), False)], "path string, content binary, tracked boolean")
    assert {r.path: r.text for r in files.texts(f, mark=True).collect()}["a.py"] == "x�"
    assert [r.path for r in files.tracked_by(f, ["*.js"], vendor=False).collect()] == [] and [r.path for r in files.tracked_by(f, ["*.js"]).collect()] == ["jquery-1.js"]


def test_project_configuration(tmp_path):
    at = str(tmp_path / "c.json")
    assert files.project_config(at)["impact"]["profile"] == "generic"
    assert files.save_config(at, {"ignore_paths": ["x/**"], "impact": {"profile": "django", "urls_globs": ["**/routes.py"], "reverse": False}, "guard": {"blocking": "strict", "checks": ["syntax/json-syntax"]}})
    got = files.project_config(at)
    assert got["impact"]["urls_globs"] == ["**/urls.py", "**/routes.py"] and got["impact"]["reverse"] is False and got["ignore_paths"][-1] == "x/**"
    assert got["guard"] == {"blocking": "strict", "checks": ["syntax/json-syntax"]} and files.PROFILES["django"]["impact"]["urls_globs"] == ["**/urls.py"]
    (tmp_path / "c.json").write_text('{"impact": {"profile": 7}, "guard": {"checks": "all"}}')
    got = files.project_config(at)
    assert got["impact"]["profile"] == "generic" and got["guard"]["checks"] == []
    (tmp_path / "c.json").write_text("[1]")
    assert files.project_config(at)["guard"]["blocking"] == "warn" and not files.save_config(str(tmp_path / "no" / "c.json"), {})
