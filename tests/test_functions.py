import pytest
from pyspark.sql import functions as F

from tremor.functions import paths, text, urls
from tremor.sources import scripts


def values(spark, rows, column, schema="v string"):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_names(spark):
    v = F.col("v")
    assert values(spark, ["a/b/c.py", "a/__init__.py", "__init__.py", "x.pyc"], paths.module_of(v)) == ["a.b.c", "a", "__init__", "x.pyc"]
    assert values(spark, ["IMG.PNG", ".gitignore", "Makefile", "a.tar.gz", "d.x/f", ".a.b"], paths.extension(v)) == ["png", "", "", "gz", "", "b"]
    assert values(spark, ["app/templates/a/templates/x.html", "templates/y.html", "nottemplates/z.html"], paths.template_name_of(v)) == ["x.html", "y.html", None]
    assert values(spark, ["a/b.py", "tests/test_b.py", "b"], paths.test_path_of(v)) == ["tests/test_b.py", None, "tests/test_b.py"]
    assert values(spark, ["tsconfig.app.json", "a/.vscode/s.json", "x.code-workspace", "a.json"], paths.is_jsonc(v)) == [True, True, True, False]
    assert values(spark, ["lib/node_modules/a.js", "jquery-3.js", "x/app.min.js", "src/app.js"], paths.is_vendor(v)) == [True, True, True, False]


def test_globs(spark):
    cases = [("a/node_modules/x.js", "**/node_modules/**", True), ("node_modules/x.js", "**/node_modules/**", True), ("a/b/node_modules", "**/node_modules/**", True), ("a/other/x.js", "**/node_modules/**", False),
             ("src/a/b.py", "src/**/b.py", True), ("src/b.py", "src/**/b.py", True), ("x/src/b.py", "src/*.py", True), ("src/b.pyc", "src/*.py", False), ("v1.2/a", "v1?2/*", True)]
    for path, glob, want in cases:
        assert values(spark, [path], paths.matches_glob(F.col("v"), [glob])) == [want], (path, glob)
    for path, pattern, want in [("a/b.py", "*.py", True), ("apps/orders/x.py", "apps/orders/*", True), ("apps/other/x.py", "apps/orders/*", False), ("docs/a/b.md", "/docs/**", True)]:
        assert values(spark, [path], F.col("v").rlike(paths.owner_regex(pattern))) == [want], (path, pattern)


def test_assets_and_imports(spark):
    v = F.col("v")
    got = values(spark, ["{{ MEDIA_URL }}shop/app.js?v=1", "{% static 'a/b.css'", "./x.js", "/y.js", "https://c/d.js", "//c/d.js", "{{ x }}", "a.html", "url('i.png')"], paths.asset_ref(v))
    assert got == ["shop/app.js", "a/b.css", "x.js", "y.js", None, None, None, None, "i.png')"]
    assert values(spark, ["a/./b/../c", "../x", "a/../../x", "a//b"], paths.folded(v)) == ["a/c", None, None, "a/b"]
    assert values(spark, ["a/b/c"], paths.suffixes(v)) == [["a/b/c", "b/c", "c"]]
    got = values(spark, [("../m", "src/a/x.ts"), ("react", "src/a/x.ts")], paths.import_candidates(F.col("s"), F.col("p")), "s string, p string")
    assert got[0][:3] == ["src/m", "src/m.ts", "src/m.tsx"] and got[1] is None


def test_urls(spark):
    v = F.col("v")
    assert values(spark, ["/api/x/", "api/x/", "a/b", "//c/d/", "/a b/", "text/html/", "/x/app.js", "/"], urls.is_url_like(v)) == [True, True, False, False, False, False, False, False]
    assert values(spark, ["/a/?q=1", "/a/${id}/", "/a/' + b"], urls.plain_ref(v)) == ["/a/", "/a/", "/a/"]
    assert values(spark, ["^api/<int:id>/", "/x/{id}", "(?P<a>x)/", "^orders/$"], urls.needle(v)) == ["api", "x", "", "orders"]
    assert values(spark, ["views.Orders.as_view()", "views.list", "f"], urls.handler_leaf(v)) == ["Orders", "list", "f"]
    got = values(spark, [("/a/<int:i>/b", "/a/5/b"), ("/a/<int:i>/b", "/a/5/6/b"), ("/a.b/{x}", "/aXb/1"), ("/a.b/{x}", "/a.b/1")], F.regexp_like("u", urls.route_regex(F.col("r"))), "r string, u string")
    assert got == [True, False, False, True]
    assert values(spark, [("/a/", "/a/<x>/"), ("/a", "/a/b"), ("/a", "/ab"), ("/a/b", "/a/b")], urls.is_prefix(F.col("u"), F.col("r")), "u string, r string") == [True, True, False, False]


def test_hygiene_and_reasons(spark):
    v = F.col("v")
    assert values(spark, ["a\r\nb\rc\n", "a\n"], text.line_feeds(v)) == ["a\nb\nc\n", "a\n"]
    assert values(spark, ["a  \nb\t\n\n\n", "a\n", " \n \n", "a", "a  b "], text.no_trailing_white(v)) == ["a\nb\n", "a\n", "", "a", "a  b\n"]
    assert values(spark, ["a \r\n", "\n", "a\n \n\t", "\ta"], text.no_trailing_white(v)) == ["a \r\n", "", "a\n", "\ta"]
    assert values(spark, ["a", "a\n\n\n", "\n\n", "", "a\r\n"], text.one_final_line_feed(v)) == ["a\n", "a\n", "\n", "", "a\r\n"]
    assert values(spark, ["dynamic-ref", "Dynamic x", "unsupported y", "no importer", None, "z"], text.reason_bucket(v)) == ["dynamic-ref", "dynamic-ref", "binary/unsupported", "no-import-chain", "unknown-url", "unknown-url"]
    assert values(spark, ["x (name at 12)", "line 7", "none"], text.line_of(v, F.lit(None))) == [12, 7, 0]
    assert values(spark, ["<a><!-- x\ny --><b>"], text.strip_html_comments(v)) == ["<a><b>"]
    got = values(spark, [("High", 1.0, 0.0, 0.0), ("Low", 7.0, -1.0, None)], F.round(text.risk(F.col("s"), F.col("a"), F.col("b"), F.col("c")), 6), "s string, a double, b double, c double")
    assert got == [0.7, 0.3]
    assert values(spark, [("p", 3, None), ("p", None, None)], text.issue_text(F.lit("p"), F.col("l"), F.col("c"), F.lit("E1"), F.lit("bad")), "v string, l int, c int") == ["p:3:-: E1 bad", "p: E1 bad"]


@pytest.mark.parametrize(("source", "want"), [("a /* x\ny */ b // c\nd", "a \n b \nd"), ("u = 'http://x'", "u = 'http://x'")])
def test_js_comments(source, want):
    assert scripts.without_comments(source) == want


def test_literals_and_json():
    assert scripts.blank_literals("import x from './a'; s = 'import'; require(\"b\")") == "import x from './a'; s =         ; require(\"b\")"
    assert scripts.blank_literals("s = `a\nb`", keep_operands=False) == "s =   \n  "
    assert scripts.blank_literals("export { a as 'b' }; x = { 'c': 1 }", keep_exports=True) == "export { a as 'b' }; x = {    : 1 }"
    assert text.json_error(b'{"a": 1}', False) is None and text.json_error(b'{"a":1} x', False)[0] == 1 and text.json_error(b"\xff\xfe{", False) is not None
    assert text.json_error(b'{"u": "http://x", /* c */ "a": [1,],} // d', True) is None and text.json_error(b'{"a": 1,}', False) is not None
