"""The whole impact run: two snapshots of a tree to changed definitions, what refers to them, and a ranked report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.functions import paths
from tremor.operators import binding, changes, closures, routes, scope, scoring
from tremor.plans import impact
from tremor.session import stored
from tremor.sources import extract
from tremor.sources import files as sources

DEFAULTS = {
    "profile": "generic", "urls_globs": ["**/urls.py"], "template_globs": ["**/*.html"], "frontend_globs": ["**/*.ts", "**/*.js", "**/*.tsx", "**/*.jsx"], "ignore_paths": list(paths.DEFAULT_IGNORES),
    "ignore_symbols": [], "show_all": False, "fast": False, "reverse": False,
}
OWNER_FILES = ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS")


class Impact(NamedTuple):
    rows: DataFrame  # ranked
    hidden: DataFrame
    endpoints: DataFrame
    unresolved: DataFrame
    changes: DataFrame
    entities: DataFrame


def _matching(files: DataFrame, globs: list[str]) -> DataFrame:
    return files.filter(paths.matches_glob(F.col("path"), globs))


def changed_definitions(old: DataFrame, new: DataFrame, change_list: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, lines): changed definitions of Python files, and the changed lines (path, side, line) of those that are not new, gone or renamed."""
    python = change_list.filter("ext = 'py'").withColumn("was", F.when(F.col("status").startswith("R"), F.col("old_path")).otherwise(F.col("path")))
    texts = python.join(old.select(F.col("path").alias("was"), F.col("text").alias("before")), "was", "left").join(new.select("path", F.col("text").alias("after")), "path", "left")
    texts = stored(texts.select("path", "was", "status", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after")), "changed-texts")
    lines = stored(changes.changed_lines(texts.filter("status LIKE 'M%'")), "changed-lines")
    modes = texts.select("path", F.when(F.col("status").startswith("M"), changes.LINES).otherwise(changes.ALL).alias("scope_mode"))
    found = {}
    for side, column in (("old", "before"), ("new", "after")):
        defs = stored(extract.diff_entities(texts.select("path", F.col(column).alias("text"))), "defs")
        found[side] = defs, changes.in_scope(defs, modes, lines.filter(F.col("side") == side).select("path", "line"))
    modules = texts.select("path", paths.module_of(F.col("path")).alias("module")).union(texts.filter("was <> path").select("path", paths.module_of(F.col("was")))).distinct()
    entities = changes.changed_entities(found["old"][0], found["new"][0], found["old"][1], found["new"][1], modules)
    return stored(entities, "entities"), lines


def affected_routes(route_table: DataFrame, reached: DataFrame, usages: DataFrame, weak: tuple[str, ...]) -> DataFrame:
    """Routes whose handler is reached (name, modules) and bound where the route stands."""
    asked = reached.select("name", F.lit(binding.ANY_KIND).alias("kind"), F.lit(True).alias("deleted"), "modules")
    there = usages.join(route_table.select(F.col("module").alias("path")).distinct(), "path", "left_semi")
    any_path = usages.sparkSession.createDataFrame([("",)], "path string")
    bound = binding.references(there, asked, any_path, weak).filter("how <> 'str'").select("path", "name")
    at = route_table.select(F.col("module").alias("path"), paths.module_of(F.col("module")).alias("own")).distinct()
    inside = at.join(reached.select("name", F.explode("modules").alias("own")), "own").select("path", "name")
    return routes.affected_routes(route_table, reached.select(F.col("name").alias("node")), bound.union(inside).distinct())


def breaking_changes(change_list: DataFrame, entities: DataFrame, lines: DataFrame, old: DataFrame) -> DataFrame:
    """path, rule, symbol of changes that break."""
    module = lambda c: paths.module_of(F.col(c))
    listed = change_list.select("path", "status", "old_path", module("path").alias("module"), F.when(F.col("status").startswith("R"), module("old_path")).alias("old_module"))
    totals = old.join(change_list.select("path"), "path", "left_semi").select("path", F.size(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("n"))
    ratios = changes.removed_ratio(lines.filter("side = 'old'").select("path", "line"), totals)
    return scoring.breaking(listed, ratios, entities.filter("deleted").select(F.explode("modules").alias("module"), "name"))


def ownership(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Ownership rules of the first ownership file among the files (path, text)."""
    found = {r["path"]: r["text"] for r in files.filter(F.col("path").isin(*OWNER_FILES)).select("path", "text").collect()}
    return sources.ownership_rules(spark, next((found[p] or "" for p in OWNER_FILES if p in found), ""))


def run(spark: SparkSession, old: DataFrame, new: DataFrame, config: dict | None = None) -> Impact:
    """Impact of what differs between two snapshots (path, text) of a tree.

    config: see DEFAULTS. Python references always; routes of the profile (django, fastapi) link templates and scripts
    to the handlers that callers of a change lead to, and entry points tell what is reachable. With reverse, changed
    templates lead to what extends and renders them, and the functions that do to their routes. Fast runs look at changed
    files and those that import a changed name, at Python alone. A snapshot's null texts count as empty.
    """
    cfg = DEFAULTS | (config or {})
    old, new = (s.select("path", F.coalesce("text", F.lit("")).alias("text")) for s in (old, new))
    change_list = stored(changes.diff_snapshots(old.withColumnRenamed("text", "content"), new.withColumnRenamed("text", "content")), "changes")
    entities, lines = changed_definitions(old, new, change_list)
    changed = change_list.select("path")
    kept = scope.without_ignored(new, cfg["ignore_paths"])
    python = kept.filter(F.col("path").endswith(".py"))
    usages = stored(extract.python_usages(python).withColumn("own_module", paths.module_of(F.col("path"))), "usages")
    if cfg["fast"]:
        usages = usages.join(binding.fast_subset(python, usages, entities, changed), "path", "left_semi")
    weak = tuple(cfg["ignore_symbols"])
    producers, seeds = [impact.python_rows(binding.references(usages, entities, changed, weak))], entities
    none = spark.createDataFrame([], "file string, ref string, reason string")
    unresolved, endpoints, reached = none, spark.createDataFrame([], "url string, handler string, name string, module string"), None
    if not cfg["fast"]:
        definitions = stored(extract.python_definitions(python), "definitions")
        pseudo = None
        if cfg["reverse"]:
            rendered, views, unresolved = impact.template_rows(changed.filter(F.col("path").endswith(".html")), _matching(kept, cfg["template_globs"]), usages)
            pseudo = stored(views.join(entities.select("name"), "name", "left_anti"), "views")
            context = binding.references(usages, pseudo.select("name", "kind", "deleted", "modules"), changed, weak, need_base=True)
            producers = [rendered, *producers, impact.python_rows(context, "heuristic")]
            seeds = entities.select("name", "modules").unionByName(pseudo.select("name", "modules"))
        route_files = _matching(python, cfg["urls_globs"])
        found = {"django": extract.composed_routes, "fastapi": extract.fastapi_routes}.get(cfg["profile"])
        if found is not None:
            table = changes.numbered(found(route_files).withColumnRenamed("ord", "at"), "ord", "module", "at").drop("at")
            table = stored(table, "routes")
            touched = stored(affected_routes(table, closures.callers(usages, seeds.select("name", "modules"), weak=weak), usages, weak), "affected")
            templates, frontend = _matching(kept, cfg["template_globs"]), _matching(kept, cfg["frontend_globs"])
            tags, no_tag = routes.match_template_refs(extract.url_tags(templates, touched.select("name").filter("name IS NOT NULL")), touched)
            calls, no_call = routes.match_urls(extract.frontend_refs(scope.with_needles(frontend, touched)), touched)
            gone = entities.select(F.col("name").alias("name_of_handler"), "deleted")
            linked = lambda hits, ref, line: impact_columns(_tiered(hits.drop("name_of_handler").withColumn("name_of_handler", routes.leaf("handler")).join(gone, "name_of_handler", "left"), pseudo, changed), ref, line)
            producers += [
                impact.linked_rows(linked(tags, "name", F.lit(0)), "template", F.format_string("{%% url '%s' %%}", "name")),
                impact.linked_rows(linked(calls, "ref", F.col("line")), "frontend", F.format_string('http.%s("%s") at %d', F.coalesce("method", F.lit("get")), "ref", "line"))]
            unresolved = unresolved.union(no_tag.select("file", "ref", "reason")).union(no_call.select("file", "ref", "reason"))
            endpoints = scope.endpoints(touched)
            entries = stored(closures.entry_points(table, definitions, python), "entries")
            if not entries.isEmpty():
                reached = closures.reached_by_entries(usages, definitions, entries)
        producers.append(impact.symbol_rows(extract.script_symbols(_matching(kept, cfg["frontend_globs"])), entities))
    rows, hidden = impact.compose(
        impact.append(*producers), changed, new, ownership(spark, new), reached, cfg["show_all"], not changed.isEmpty(), breaking_changes(change_list, entities, lines, old))
    return Impact(rows, hidden, endpoints, unresolved, change_list, entities)


def _tiered(hits: DataFrame, pseudo: DataFrame | None, changed: DataFrame) -> DataFrame:
    """Matched references with their tier: context only, where the handler is affected by a template alone and the file did not change."""
    if pseudo is None:
        return hits.withColumn("tier", F.lit(None).cast("string"))
    out = hits.join(pseudo.select(F.col("name").alias("name_of_handler"), F.lit(True).alias("__view")), "name_of_handler", "left").join(changed.select(F.col("path").alias("file"), F.lit(True).alias("__in")).distinct(), "file", "left")
    return out.withColumn("tier", F.when(F.col("__view") & F.col("__in").isNull(), "heuristic")).drop("__view", "__in")


def impact_columns(hits: DataFrame, ref: str, line: F.Column) -> DataFrame:
    """Matched references with the order of arrival and the line that rows need."""
    return hits.withColumn("line", line.cast("int")).withColumn("seq", F.xxhash64("file", ref, "line"))
