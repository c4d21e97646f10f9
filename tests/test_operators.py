import json

from pyspark.sql import functions as F

from tremor.operators import binding, changes, checks, closures, routes, scoring
from tremor.plans import impact, report


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_name_status(spark):
    stream = lambda *t: frame(spark, "pos int, token string", *enumerate(t))
    rows = lambda *t: [tuple(r) for r in changes.parse_name_status(stream(*t)).collect()]
    got = rows("M", "a.py", "A", "new.py", "D", "del.py", "R100", "old.py", "renamed.py")
    assert got == [("a.py", "M", None, "py"), ("new.py", "A", None, "py"), ("del.py", "D", "del.py", "py"), ("renamed.py", "R100", "old.py", "py")]
    assert rows("M") == [] and rows("junk", "A", "x.py") == [("x.py", "A", None, "py")]


def test_hunks(spark):
    diffs = frame(spark, "path string, text string", ("a", "@@ -10,0 +12,2 @@\n+x\n+y\n@@ -5,3 +5,0 @@ f"), ("b", "@@ -1 +1 @@"))
    h = changes.parse_hunks(diffs)
    assert {tuple(r) for r in h.collect()} == {("a", 10, 0, 12, 2), ("a", 5, 3, 5, 0), ("b", 1, 1, 1, 1)}
    assert {tuple(r) for r in changes.hunk_lines(h).collect()} == {("a", 12), ("a", 13), ("b", 1)}
    entities = frame(spark, "path string, name string, line int, end_line int", ("a", "f", 1, 12), ("a", "g", 14, 200), ("b", "h", 2, 3), ("b", "i", 1, 1))
    assert {r.name for r in changes.overlapping(entities, changes.hunk_lines(h)).collect()} == {"f", "i"}
    scope = frame(spark, "path string, scope_mode string", ("a", "all"), ("b", "lines"))
    assert {r.name for r in changes.in_scope(entities, scope, changes.hunk_lines(h)).collect()} == {"f", "g", "i"}
    assert changes.in_scope(entities, frame(spark, "path string, scope_mode string", ("a", "none"), ("b", "none")), changes.hunk_lines(h)).count() == 0


def test_change_base(spark):
    c = frame(spark, "name string, ord int, differing int", ("master", 0, 4), ("sprint-2", 1, 2), ("sprint-1", 2, 2))
    assert changes.change_base(c).first().name == "sprint-2"


USAGE = "path string, own_module string, seq int, line int, name string, kind string, base string, module string, level int, alias string, ctx_qname string, ctx_kind string, callee string, kwarg string"


def usage(path, seq, name, kind, **more):
    row = {"path": path, "own_module": path[:-3].replace("/", "."), "seq": seq, "line": seq, "name": name, "kind": kind, "ctx_qname": "f", "ctx_kind": "function"} | more
    return tuple(row.get(c.split()[0]) for c in USAGE.split(", "))


def test_binding(spark):
    u = frame(
        spark, USAGE,
        usage("a.py", 1, "pay", "import", module="shop.services", level=0), usage("a.py", 2, "pay", "name"),  # imported from the entity's module
        usage("b.py", 3, "pay", "name"),  # never imported
        usage("c.py", 4, "services", "import", module="shop", level=0), usage("c.py", 5, "pay", "attr", base="services"),  # through its module
        usage("d.py", 6, "services", "import", module="other", level=0), usage("d.py", 7, "pay", "attr", base="services"),  # the other services
        usage("e.py", 8, "pay", "attr", base=""), usage("e.py", 9, "pay", "attr", base="x"),
        usage("shop/g.py", 10, "pay", "import", module="services", level=1, alias="p"), usage("shop/g.py", 11, "p", "name"),
        usage("h.py", 12, "status", "attr", base="x"),  # a weak name of an unknown object
        usage("shop/services.py", 13, "pay", "name"),
    )
    e = frame(spark, "name string, kind string, deleted boolean, modules array<string>", ("pay", "function", False, ["shop.services"]), ("status", "class_field", False, ["shop.services"]))
    changed = frame(spark, "path string", ("shop/services.py",))
    assert {r.seq for r in binding.references(u, e, changed).collect()} == {1, 2, 5, 8, 10, 13}
    assert {r.seq for r in binding.references(u, e, changed, need_base=True).collect()} == {1, 2, 5, 10, 13}
    assert {r.seq for r in binding.references(u, e, changed.limit(0)).collect()} == {1, 2, 3, 5, 7, 8, 9, 10, 12, 13}  # nothing changed, nothing is filtered
    sure = {r.seq: (r.bound, r.own) for r in binding.references(u, e, changed).collect()}
    assert sure[2] == (True, False) and sure[13] == (False, True) and sure[8] == (False, False)


def test_closures(spark):
    edges = frame(spark, "src string, dst string", ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))
    seed = frame(spark, "node string", ("a",))
    assert {tuple(r) for r in closures.reach(edges, seed).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r.node for r in closures.reach(edges, seed, hops=1).collect()} == {"a", "b"}
    assert {r.node for r in closures.reach(edges, seed, nodes=2).collect()} == {"a", "b"}
    assert closures.descendants(edges, "a").count() == 0  # on a cycle
    tree = frame(spark, "src string, dst string", ("c", "b"), ("b", "a"))
    assert {tuple(r) for r in closures.descendants(tree, "c").collect()} == {("b", "b"), ("a", "b")}
    rows = frame(
        spark, "n int, severity string, path string, category string, ctx_qname string", (1, "High", "m.py", "python", "f"), (2, "High", "x.py", "python", "A.g"), (3, "Low", "x.py", "python", "g"),
        (4, "Medium", "x.py", "python", "m"), (5, "High", "x.py", "python", ""), (6, "High", "x.html", "template", "g"), (7, "High", "x.py", "python", "C.run"))
    names, modules = frame(spark, "node string", ("run",)), frame(spark, "node string", ("m",))
    got = closures.downgraded(rows, names, modules)
    # names and modules are apart: m is a module, and no function; only Python rows are judged
    assert {(r.n, r.severity, r.reachability[0]) for r in got.collect()} == {(1, "High", "r"), (2, "Medium", "u"), (3, "Low", "u"), (4, "Low", "u"), (5, "High", "r"), (6, "High", "r"), (7, "High", "r")}
    none = frame(spark, "node string")
    assert {r.reachability for r in closures.downgraded(rows, none, none).collect()} == {"reachable"}


def test_severity_table(spark):
    c = "deleted boolean, n int, inside boolean, path boolean, change boolean, tier string, ref string"
    rows = [((True, 1, False, True, True, None, ""), "High"), ((False, 2, False, True, True, None, ""), "High"), ((False, 1, True, True, True, None, ""), "Low"), ((False, 1, False, False, True, None, ""), "Low"), ((False, 1, False, True, False, None, ""), "Low"),
            ((False, 1, False, True, True, None, ""), "Medium"), ((True, 1, False, True, True, "backend", ""), "High"), ((False, 1, False, True, True, "frontend", "changed a.js"), "High"), ((False, 2, False, True, True, "backend", ""), "Medium"), ((False, 2, False, True, True, "heuristic", ""), "Medium")]
    df = spark.createDataFrame([r for r, _ in rows], c)
    col = scoring.severity(F.col("n"), F.col("deleted"), F.col("inside"), F.col("path"), F.col("change"), F.col("tier"), F.col("ref"))
    assert [r[0] for r in df.select(col).collect()] == [w for _, w in rows]


def test_owners_last_match_wins(spark):
    from tremor.sources.files import ownership_rules

    rules = ownership_rules(spark, "*.py @all\napps/orders/* @team @orders # last\n")
    got = {r.path: r.owner for r in routes.owners(frame(spark, "path string", ("apps/orders/a.py",), ("b.py",), ("c.md",)), rules).collect()}
    assert got == {"apps/orders/a.py": "orders", "b.py": "all", "c.md": ""}
    many = frame(spark, "ord int, regex string, owner string", *[(k, f"^f{k}[.]py$", f"o{k}") for k in range(300)])
    assert {r.path: r.owner for r in routes.owners(frame(spark, "path string", ("f7.py",), ("x",)), many).collect()} == {"f7.py": "o7", "x": ""}


def test_url_stages(spark):
    table = frame(spark, "ord int, full string, handler string", (0, "/api/v1/orders/<int:id>/", "detail"), (1, "/api/v1/orders/", "list"), (2, "/api/v1/other/x", "x"))
    refs = frame(spark, "file string, line int, ref string", ("a", 1, "/api/v1/orders/5/"), ("a", 2, "api/v1/orders/?q=1"), ("a", 3, "/api/v1/other/"), ("a", 4, "/nope/"))
    matched, missed = routes.match_urls(refs, table)
    assert {(r.line, r.handler) for r in matched.collect()} == {(1, "detail"), (2, "list"), (3, "x")}
    assert [tuple(r) for r in missed.collect()] == [("a", "/nope/", "unknown-url")]


def test_handlers(spark):
    handlers = frame(spark, "handler string, module string", ("shop.views.pay", "u.py"), ("run", "u.py"), ("none", "u.py"))
    defs = frame(spark, "name string, path string", ("pay", "a/views.py"), ("pay", "shop/views.py"), ("run", "b.py"), ("run", "a.py"))
    assert {tuple(r) for r in routes.handler_definitions(handlers, defs).collect()} == {("shop.views.pay", "shop/views.py"), ("run", "a.py")}
    bound = frame(spark, "module string, path string", ("u.py", "b.py"))
    assert {tuple(r) for r in routes.handler_roots(handlers, defs, bound).collect()} == {("run", "b.py")}


def test_format_hunks(spark):
    diff = ["--- a", "+++ a", "@@ -1,4 +1,4 @@", " a", "-b", "+B", " c", "-d", "+D", "@@ -20,2 +20,2 @@", "-x", "+X", " y"]
    d = frame(spark, "path string, pos int, text string", *[("a", k, t) for k, t in enumerate(diff)])
    lines = frame(spark, "path string, line int", ("a", 4), ("a", 20))
    assert [r.text for r in checks.format_hunks(d, lines).orderBy("pos").collect()] == ["-d", "+D", "-x", "+X"]


def test_checks(spark):
    rows = [("a.json", b'{"a": 1} x'), ("b.json", b"  "), ("tsconfig.json", b'{"a": 1, } // c'), ("c.py", b"def ("), ("d.py", b"\xef\xbb\xbfx = 1\n"), ("e.txt", b"<<<<<<< a\n=======\n========\n>>>>>>> b\n"), ("E.TXT", b"-----BEGIN PRIVATE KEY-----\n")]
    files = spark.createDataFrame([(p, bytearray(c), len(c), True) for p, c in rows], "path string, content binary, length long, tracked boolean")
    issues = checks.run_checks(files, files)
    got = {(r.check_id, r.path, r.line) for r in issues.collect()}
    assert got == {
        ("syntax/json-syntax", "a.json", 1), ("syntax/ast-syntax", "c.py", 1), ("syntax/merge-conflict", "e.txt", 1), ("syntax/merge-conflict", "e.txt", 2), ("syntax/merge-conflict", "e.txt", 4), ("repo/private-key", "E.TXT", None), ("repo/case-conflict", "E.TXT", None), ("repo/case-conflict", "e.txt", None),
        *(("hygiene/end-of-file-fixer", p, None) for p in ("a.json", "b.json", "tsconfig.json", "c.py")), ("hygiene/trailing-whitespace", "b.json", None)}
    fold = {r.check_id: r.blocked for r in checks.verdict(issues, ("syntax/json-syntax",), strict=False).collect()}
    assert fold["repo/private-key"] and not fold["syntax/json-syntax"]
    scope = frame(spark, "path string, scope_mode string", ("e.txt", "lines"))
    assert [r.line for r in checks.merge_conflicts(files, scope, frame(spark, "path string, line int", ("e.txt", 2))).collect()] == [2]


def test_linter_reports(spark):
    text = json.dumps([{"filename": "/r/a.py", "location": {"row": 3, "column": 1}, "code": "E1", "message": "m"}, {"filename": "/r/b.py", "location": {"row": 4, "column": 2}, "code": "E2", "message": "n"}])
    m = checks.linter_messages(frame(spark, "text string", (text,)))
    left = checks.not_in_baseline(m, frame(spark, "path string, key string", ("a.py", "3:1:E1")))
    assert [(r.path, r.line, r.code) for r in left.collect()] == [("/r/b.py", 4, "E2")]
    f = frame(spark, "path string", ("src/a.ts",), ("src/b.ts",), ("lib/c.ts",), ("src/d.py",))
    old, new = frame(spark, "path string", ("src/a.ts",), ("src/b.ts",)), frame(spark, "path string", ("src/b.ts",))
    assert [r.path for r in checks.formatter_scope(f, old, new).collect()] == ["src/b.ts"]


def sample_rows(spark):
    schema = "seq int, path string, module string, category string, ref string, line int, entity string, deleted boolean, tier string, confidence string, ctx_qname string"
    return frame(
        spark, schema, (0, "a.py", "a", "python", "f (name at 3)", 3, "f", False, None, "high", "g"), (1, "a.py", "a", "python", "f (name at 3)", 3, "f", False, None, "high", "g"), (2, "b.py", "b", "template", "f (str at 9)", 9, "f", False, None, "high", "h"),
        (3, "c.py", "c", "python", "k (attr at 1)", 1, "k", True, None, "high", ""), (4, "d.py", "d", "python", "k (attr at 2)", 2, "k", True, None, "low", ""), (5, "z.py", "z", "python", "m (name at 4)", 4, "m", False, None, "medium", "g"))


def test_report(spark):
    changed = frame(spark, "path string", ("z.py",))
    ranked, hidden = impact.compose(sample_rows(spark), changed, frame(spark, "path string", ("tests/test_a.py",)))
    got = {r.path: r for r in ranked.collect()}
    assert set(got) == {"a.py", "b.py", "c.py", "z.py"} and hidden.count() == 1
    assert (got["a.py"].severity, got["a.py"].missing_test, got["a.py"].section, got["a.py"].key) == ("High", 0, "Breaking", "a.py:3")
    assert (got["z.py"].severity, got["z.py"].badge, got["z.py"].action, got["z.py"].why_matters) == ("Low", "Changed", "ok", None)
    assert (got["a.py"].action, got["b.py"].action, got["c.py"].action) == ("run tests/test_a.py", "update call site", "remove import") and got["b.py"].missing_test == 0
    assert got["c.py"].why_matters == "k (attr at 1) uses deleted symbol k (unresolved import)"
    assert [r.path for r in ranked.orderBy("rank").collect()] == ["c.py", "a.py", "b.py", "z.py"]
    s = scoring.summary(ranked, changed).first()
    assert (s.high, s.medium, s.low, s.impacted, s.summary_risk) == (3, 0, 1, 3, 75)
    unresolved = frame(spark, "file string, ref string, reason string", ("a", "x", "dynamic-ref"))
    shown = report.render(ranked, unresolved, changed, top=2)
    assert "75/100" in shown and "dynamic-ref 1" in shown and "1 more in b" in shown
    assert "| # |" in report.render(ranked, unresolved, changed, markdown=True)
    full = report.render(ranked, unresolved, changed, top=None, endpoints=frame(spark, "url string, handler string", ("a/", "v")), hidden_count=1)
    assert "  a/ -> v" in full and "1 row(s) of low confidence are hidden" in full and "uses deleted symbol k" in full
    doc = json.loads(report.sarif(ranked))
    assert report.sarif_problems(doc) == [] and [x["level"] for x in doc["runs"][0]["results"]] == ["error", "error", "error", "note"]
    assert report.sarif_problems({"version": "1"}) == ["version is not 2.1.0", "runs is empty"]
    p = json.loads(report.payload(ranked, unresolved, frame(spark, "url string, handler string", ("/a/", "v")), 1, 1, top=3))
    assert (p["shown_count"], p["hidden_counts"], p["unresolved_by_reason"], len(p["rows"])) == (3, {"z": 1}, {"dynamic-ref": 1}, 4)
    assert scoring.gate((0, 1, 2), "high") == 0 and scoring.gate((0, 1, 2), "medium") == 1 and scoring.gate((1, 0, 0), "low", advisory=True) == 0


def test_wrapping():
    assert report.wrapped("aaa bbb ccc", 7) == ["aaa bbb", "ccc"] and report.wrapped("abc/defgh/ij", 6) == ["abc/", "defgh/", "ij"] and report.wrapped("abcdefghij", 4) == ["abcd", "efgh", "ij"]
    lines = report.table_lines([{"number": 1, "path": "a/very/long/path/that/does/not/fit/in/the/column.py"}])
    assert len({len(x) for x in lines}) == 1


def test_chains(spark):
    graph = spark.createDataFrame([("base.html", [], ["js/app.js"]), ("child.html", ["base.html"], []), ("far.html", ["child.html"], [])], "template_name string, extends array<string>, assets array<string>")
    u = frame(spark, USAGE, usage("v.py", 1, "base.html", "str", callee="render"), usage("w.py", 2, "base.html", "str", callee="log"))
    got = {(r.child, r.kind) for r in impact.template_chain(frame(spark, "template string", ("base.html",)), graph, u).collect()}
    assert got == {("child.html", "extends"), ("far.html", "transitive"), ("v.py", "render"), ("w.py", "literal")}
    assets = impact.asset_chain(frame(spark, "path string", ("static/js/app.js",)), graph, u).collect()
    assert [(r.asset, r.template, r.view) for r in assets] == [("static/js/app.js", "base.html", "v.py")]
    edges = frame(spark, "src string, dst string", ("a.ts", "m.ts"), ("b.ts", "a.ts"))
    direct, far = impact.import_chain(frame(spark, "path string, name string", ("m.ts", "X")), edges, frame(spark, "path string, word string", ("a.ts", "X")))
    assert [tuple(r) for r in direct.collect()] == [("X", "a.ts")] and [r.path for r in far.collect()] == ["b.ts"]
    calls = frame(spark, "file string, line int, ref string", ("a.ts", 1, "/x/"))
    table = frame(spark, "ord int, full string, handler string", (0, "/x/", "views.pay"))
    got = impact.endpoint_chain(calls, table, frame(spark, "src string, dst string", ("pay", "charge"))).collect()
    assert {(r.url, r.callee, r.hop) for r in got} == {("/x/", "pay", 0), ("/x/", "charge", 1)}


def test_template_chain_is_whole_and_drops_cycles(spark):
    chain = [(f"t{k}.html", [f"t{k - 1}.html"], []) for k in range(1, 26)] + [("a.html", ["c.html"], []), ("b.html", ["a.html"], []), ("c.html", ["b.html"], [])]
    graph = spark.createDataFrame(chain, "template_name string, extends array<string>, assets array<string>")
    got = {(r.template, r.child, r.kind) for r in impact.template_chain(frame(spark, "template string", ("t0.html",), ("a.html",)), graph, frame(spark, USAGE, usage("v.py", 1, "x", "str"))).collect()}
    assert got == {("t0.html", "t1.html", "extends"), ("a.html", "b.html", "extends")} | {("t0.html", f"t{k}.html", "transitive") for k in range(2, 26)}
