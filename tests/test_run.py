"""Whole runs over two snapshots of small repositories."""

import json

from tremor.plans import guard, report, run

URLS = "from django.urls import path\nfrom . import views\n\nurlpatterns = [\n    path('orders/', views.orders, name='order-list'),\n    path('api/v1/orders/', views.orders, name='api-order-list'),\n]\n"
VIEWS = "from django.http import HttpResponse\n\ndef orders(request):\n    return HttpResponse('%s')\n"
MODEL = "from django.db import models\n\nclass Book(models.Model):\n    status = models.CharField(max_length=20%s)\n"
READER = "from app.models import Book\n\ndef %s():\n    return Book.status\n"
DJANGO = {"profile": "django", "template_globs": ["**/templates/**/*.html"], "frontend_globs": ["**/src/**/*.ts", "src/*.ts"]}


def snapshot(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def report_of(spark, before, edits, config=None):
    after = {p: t for p, t in (before | edits).items() if t is not None}
    return run.run(spark, snapshot(spark, before), snapshot(spark, after), config)


def test_django_run(spark):
    tree = {
        "app/__init__.py": "", "app/urls.py": URLS, "app/views.py": VIEWS % "orders", "app/templates/orders.html": "<a href=\"{% url 'order-list' %}\">orders</a>{% url other %}\n",
        "src/orders.service.ts": "import { HttpClient } from '@angular/common/http';\nthis.http.get('/api/v1/orders/');\nthis.http.get(environment.apiUrl + '/api/v1/dynamic/');\n", "CODEOWNERS": "*.ts @web\n",
    }
    found = report_of(spark, tree, {"app/views.py": VIEWS % "orders updated"}, DJANGO)
    rows = {(r.path, r.ref): r for r in found.rows.collect()}
    assert set(rows) == {("app/urls.py", "orders (attr at 5)"), ("app/urls.py", "orders (attr at 6)"), ("app/templates/orders.html", "{% url 'order-list' %}"), ("src/orders.service.ts", 'http.get("/api/v1/orders/") at 2')}
    assert {r.severity for r in rows.values()} == {"High"} and {r.entity for r in rows.values()} == {"orders"}  # seen in three layers
    assert rows["src/orders.service.ts", 'http.get("/api/v1/orders/") at 2'].owner == "web"
    assert {(r.ref, r.reason) for r in found.unresolved.collect()} == {("/api/v1/dynamic/", "unknown-url"), (None, "dynamic-ref")}
    assert {r.url for r in found.endpoints.collect()} == {"orders/", "api/v1/orders/"}
    assert [(r.path, r.status) for r in found.changes.collect()] == [("app/views.py", "M")]
    assert report.sarif_problems(json.loads(report.sarif(found.rows))) == []


def test_fastapi_run(spark):
    main = "from fastapi import FastAPI\napp = FastAPI()\n\n@app.get('/api/v1/orders/')\ndef read_orders():\n    return %s\n"
    tree = {"main.py": main % "[]", "src/orders.service.ts": "this.http.get('/api/v1/orders/');\n"}
    found = report_of(spark, tree, {"main.py": main % "['orders']"}, {"profile": "fastapi", "urls_globs": ["**/*.py"], "template_globs": [], "frontend_globs": ["**/src/**/*.ts", "src/*.ts"]})
    assert [(r.path, r.category, r.severity) for r in found.rows.collect()] == [("src/orders.service.ts", "frontend", "Medium")]


def test_plain_and_deleted(spark):
    found = report_of(spark, {"app/models.py": MODEL % "", "app/views.py": READER % "describe"}, {"app/models.py": MODEL % ", default='new'"})
    got = {(r.ref, r.severity, r.confidence) for r in found.rows.collect() if r.path == "app/views.py"}
    assert got == {("status (attr at 4)", "Medium", "high"), ("Book (import at 1)", "Medium", "high"), ("Book (name at 4)", "Medium", "high")}
    tree = {"app/legacy.py": "def legacy_helper():\n    return 1\n\ndef keep_me():\n    return 2\n", "app/service.py": "from app.legacy import legacy_helper\n\ndef call_it():\n    return legacy_helper()\n"}
    for config in ({}, {"fast": True}):
        found = report_of(spark, tree, {"app/legacy.py": "def keep_me():\n    return 2\n"}, config)
        rows = found.rows.filter("path = 'app/service.py'").collect()
        assert {(r.ref, r.severity, r.action) for r in rows} == {("legacy_helper (import at 1)", "High", "remove import"), ("legacy_helper (name at 4)", "High", "remove import")}
        assert rows[0].why_matters.endswith("uses deleted symbol legacy_helper via app.legacy")
        assert {(r.path, r.ref) for r in found.rows.filter("category = 'breaking'").collect()} == {("app/legacy.py", "breaking API change: legacy_helper")}


def test_reachability(spark):
    tree = {
        "app/urls.py": URLS, "app/views.py": "from django.http import HttpResponse\nfrom app.helpers import helper_a\n\ndef orders(request):\n    return HttpResponse(helper_a())\n", "app/helpers.py": READER % "helper_a",
        "app/orphan.py": READER % "orphan", "app/models.py": MODEL % "",
        "app/management/commands/run_thing.py": "from django.core.management.base import BaseCommand\nfrom app.models import Book\n\nclass Command(BaseCommand):\n    def handle(self, *args, **options):\n        return Book.status\n",
    }
    found = report_of(spark, tree, {"app/models.py": MODEL % ", default='new'"}, DJANGO)
    got = {(r.path, r.ref): (r.severity, r.reachability) for r in found.rows.collect() if r.category == "python"}
    assert got["app/helpers.py", "status (attr at 4)"] == ("Medium", "reachable")
    assert got["app/management/commands/run_thing.py", "status (attr at 6)"] == ("Medium", "reachable")
    assert got["app/orphan.py", "status (attr at 4)"] == ("Low", "unreachable")
    assert got["app/orphan.py", "Book (import at 1)"] == ("Medium", "reachable")  # stands in no function


def test_template_run(spark):
    tree = {
        "app/templates/base.html": "<p>old</p>", "app/templates/child.html": "{% extends 'base.html' %}{% include page.x %}", "app/templates/far.html": "{% extends 'child.html' %}",
        "app/views.py": "from django.shortcuts import render\n\ndef orders(request):\n    return render(request, 'base.html')\n\ndef other(request):\n    return log('child.html')\n", "app/urls.py": URLS,
    }
    found = report_of(spark, tree, {"app/templates/base.html": "<p>new</p>{% include page.y %}"}, DJANGO | {"reverse": True, "show_all": True})
    got = {(r.path, r.ref, r.tier, r.confidence, r.severity) for r in found.rows.collect() if r.tier}
    assert {("app/templates/base.html", "changed", "frontend", "high", "High"), ("app/templates/child.html", "extends 'base.html'", "frontend", "high", "Medium"), ("app/templates/far.html", "extends (transitive)", "heuristic", "low", "Medium"),
            ("app/views.py", "renders 'base.html' (line 4)", "backend", "medium", "Medium"), ("app/views.py", "renders 'child.html' (line 7)", "heuristic", "low", "Medium")} <= got
    assert {p for p, _, tier, *_ in got if tier == "heuristic" and p == "app/urls.py"} == {"app/urls.py"}
    assert {r.url for r in found.endpoints.collect()} == {"orders/", "api/v1/orders/"}
    assert ("app/templates/base.html", "dynamic include; manual check required") in {(r.file, r.reason) for r in found.unresolved.collect()}


def test_guard(spark):
    files = spark.createDataFrame([("a.py", bytearray(b"x = 1 \n"), True), ("k.txt", bytearray(b"-----BEGIN PRIVATE KEY-----\n"), True), ("b.json", bytearray(b"{"), True)], "path string, content binary, tracked boolean")
    done = guard.run(files, {"guard": {"blocking": "warn"}})
    assert {(r.check_id, r.n, r.blocked) for r in done.summary.collect() if r.n} == {("hygiene/trailing-whitespace", 1, False), ("hygiene/end-of-file-fixer", 1, False), ("repo/private-key", 1, True), ("syntax/json-syntax", 1, False)}
    assert done.code == 1 and "FAIL  repo/private-key" in done.text and "FIXED hygiene/trailing-whitespace" in done.text and "PASS  syntax/ast-syntax" in done.text
    only = guard.run(files.filter("path = 'b.json'"), {"guard": {"blocking": "strict", "checks": [{"id": "syntax/json-syntax", "blocking": True}]}})
    assert only.code == 1 and [r.check_id for r in only.summary.collect()] == ["syntax/json-syntax"]
    assert guard.run(files.filter("path = 'b.json'"), {"guard": {"checks": [{"id": "syntax/json-syntax", "blocking": "off"}, {"id": "no/such"}]}}).code == 0
    assert guard.is_true("off") is False and guard.is_true(None) is False and guard.is_true("yes") and guard.is_true("0") is False
    assert guard.command_line(["lint", "--x", "{file}"], "a b.py") == ["lint", "--x", "a b.py"] and guard.command_line(["lint"], "a.py") == ["lint", "a.py"]
