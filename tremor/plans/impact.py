"""The impact query: from usages and changed definitions to scored, ranked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions import paths, urls
from tremor.operators import binding, closures, routes, scoring
from tremor.session import stored
from tremor.sources import extract

ROW = ("seq", "path", "module", "category", "ref", "line", "entity", "deleted", "tier", "confidence", "chain", "ctx_qname", "related")


def no_related() -> F.Column:
    return F.lit(None).cast("array<string>").alias("related")


def python_rows(hits: DataFrame, tier: str | None = None) -> DataFrame:
    """Rows of the reference join; those of a heuristic tier are of low confidence."""
    own, bound = F.col("own"), F.col("bound")
    place = F.when(F.coalesce("ctx_qname", F.lit("")) != "", F.col("ctx_qname")).otherwise(paths.dir_of(F.col("path")))
    return hits.select(
        "seq", "path", place.alias("module"), F.lit("python").alias("category"), F.format_string("%s (%s at %d)", "name", "how", "line").alias("ref"), "line", F.col("name").alias("entity"), "deleted",
        F.lit(tier).cast("string").alias("tier"), (F.lit("low") if tier == "heuristic" else scoring.confidence(bound, own)).alias("confidence"),
        (F.lit(None).cast("array<string>") if tier == "heuristic" else scoring.evidence(bound, own, F.col("modules"), F.col("own_module"))).alias("chain"), "ctx_qname", no_related())


def linked_rows(matched: DataFrame, category: str, ref: F.Column) -> DataFrame:
    """Rows of references (seq, file, line, handler, deleted) that a route links to a handler."""
    module = paths.dir_of(F.col("file"))
    if "tier" not in matched.columns:
        matched = matched.withColumn("tier", F.lit(None).cast("string"))
    return matched.select(
        "seq", F.col("file").alias("path"), module.alias("module"), F.lit(category).alias("category"), ref.alias("ref"), "line", urls.handler_leaf(F.col("handler")).alias("entity"), F.coalesce("deleted", F.lit(False)).alias("deleted"),
        "tier", scoring.tier_confidence(F.col("tier")).alias("confidence"), F.when(F.coalesce("tier", F.lit("")) != "heuristic", F.array(module)).alias("chain"), F.lit(None).cast("string").alias("ctx_qname"), no_related())


def symbol_rows(symbols: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows of scripts (file, line, name) that bind a changed definition by its name."""
    hit = symbols.join(entities.select("name", "deleted"), "name")
    return hit.select(
        F.xxhash64("file", "name").alias("seq"), F.col("file").alias("path"), paths.dir_of(F.col("file")).alias("module"), F.lit("frontend-symbol").alias("category"), F.concat("name", F.lit(" (imported symbol)")).alias("ref"), "line",
        F.col("name").alias("entity"), "deleted", F.lit(None).cast("string").alias("tier"), F.lit("medium").alias("confidence"), F.lit(None).cast("array<string>").alias("chain"), F.lit(None).cast("string").alias("ctx_qname"), no_related())


def append(*producers: DataFrame) -> DataFrame:
    """Rows of all producers; the producer's place in the list comes first in the order of arrival."""
    out = None
    for k, p in enumerate(producers):
        p = p.select(*ROW).withColumn("seq", F.struct(F.lit(k).alias("producer"), F.col("seq").cast("long").alias("seq")))
        out = p if out is None else out.unionByName(p)
    return out


def compose(rows: DataFrame, changed: DataFrame, files: DataFrame, rules: DataFrame | None = None, reached: tuple[DataFrame, DataFrame] | None = None, show_all: bool = False, any_change: bool = True, breaking: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked rows, hidden rows): de-dup, layers before hiding, fan-in after it, severity, reachability, risk, rank.

    reached: (names, modules) that entry points reach. The de-duplicated rows are written once and read by each use.
    """
    if "chain" not in rows.columns:
        rows = rows.withColumn("chain", F.lit(None).cast("array<string>"))
    rows = stored(scoring.deduplicated(rows), "rows")
    seen = scoring.layers(rows)
    visible, hidden = scoring.hidden(rows, show_all)
    out = visible.join(seen, "entity").join(changed.select("path", F.lit(True).alias("__c")).distinct(), "path", "left")
    inside, has_path, change = F.coalesce("__c", F.lit(False)), F.col("path").isNotNull() & (F.col("path") != ""), F.lit(any_change)
    plain = scoring.severity(F.size("layers"), F.col("deleted"), inside, has_path, change)
    out = out.withColumn("severity", scoring.severity(F.size("layers"), F.col("deleted"), inside, has_path, change, F.col("tier"), F.col("ref")))
    out = out.withColumn("reason", scoring.severity_reason(F.col("layers"), F.col("deleted"), inside, has_path, change, F.col("tier"), F.col("ref"), plain)).drop("__c")
    if reached is not None:
        out = closures.downgraded(out, *reached)
    out = scoring.with_missing_test(scoring.finished(out, changed), files).withColumn("churn", F.lit(0.0))
    out = scoring.action(out)
    if breaking is not None:
        out = out.unionByName(scoring.breaking_rows(breaking), allowMissingColumns=True)
    out = routes.owners(out, rules) if rules is not None else out.withColumn("owner", F.lit(""))
    return scoring.ranked(scoring.scored(out, scoring.fan_in(visible))), hidden


def template_chain(changed_templates: DataFrame, graph: DataFrame, usages: DataFrame) -> DataFrame:
    """template, child, kind: direct children, transitive ones (none of a template on a cycle), and render sites of changed templates (template)."""
    edges = graph.select(F.explode("extends").alias("src"), F.col("template_name").alias("dst"))
    direct = edges.join(changed_templates.select(F.col("template").alias("src")), "src").select(F.col("src").alias("template"), F.col("dst").alias("child"), F.lit("extends").alias("kind"))
    reached = stored(closures.reach_from_each(edges, changed_templates.select(F.col("template").alias("node"))), "templates")
    cyclic = reached.join(edges, (F.col("node") == F.col("src")) & (F.col("seed") == F.col("dst"))).select("seed").distinct()
    far = reached.filter("hop > 1").join(cyclic, "seed", "left_anti").select(F.col("seed").alias("template"), F.col("node").alias("child"), F.lit("transitive").alias("kind"))
    far = far.join(direct.select("template", "child"), ["template", "child"], "left_anti")
    sites = binding.render_sites(usages, changed_templates).select("template", F.col("path").alias("child"), F.when(F.col("certain"), "render").otherwise("literal").alias("kind"))
    return direct.unionByName(far).unionByName(sites)


def template_rows(changed: DataFrame, templates: DataFrame, usages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, views, unresolved) of changed templates (path) among templates (path, text).

    Rows: a changed template and what extends it directly (frontend; one row with all of them if they are many), what
    extends it through others (heuristic), functions that render it by a known call (backend) and other places that name
    it or what extends it (heuristic). Views (name, kind, deleted, modules) are the functions that render it.
    """
    graph = stored(extract.template_graph(templates).withColumn("template", F.coalesce("template_name", "path")), "template-graph")
    there = graph.groupBy("template").agg(F.min("path").alias("at"))
    named = changed.select(paths.template_name_of(F.col("path")).alias("name")).filter("name IS NOT NULL").distinct()
    edges = graph.select(F.explode("extends").alias("src"), F.col("template").alias("dst")).distinct()
    direct = stored(edges.join(named.select(F.col("name").alias("src")), "src").join(there.withColumnRenamed("template", "dst"), "dst"), "direct")
    few = named.join(direct.groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("at")).alias("children")), "name", "left")
    few = few.join(there.withColumnRenamed("template", "name"), "name", "left").withColumn("at", F.coalesce("at", "name"))
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, order: int, path: F.Column, ref: F.Column, entity: F.Column, tier: str, module: F.Column | None = None, category: str = "template", line: F.Column | None = None, related: F.Column | None = None) -> DataFrame:
        module = paths.dir_of(path) if module is None else module
        chain = {"frontend": F.array(path), "backend": F.array(module)}.get(tier, F.lit(None).cast("array<string>"))
        return df.select(
            F.xxhash64(F.lit(order), path, ref).alias("seq"), path.alias("path"), module.alias("module"), F.lit(category).alias("category"), ref.alias("ref"), (F.lit(0) if line is None else line).cast("int").alias("line"), entity.alias("entity"),
            F.lit(False).alias("deleted"), F.lit(tier).alias("tier"), scoring.tier_confidence(F.lit(tier)).alias("confidence"), chain.alias("chain"), none.alias("ctx_qname"), no_related() if related is None else related.alias("related"))

    many = F.coalesce("n", F.lit(0)) > scoring.INLINE_CHILDREN
    entity = F.concat(F.lit("changed:"), "name")
    out = rows(few.filter(~many), 0, F.col("at"), F.lit("changed"), entity, "frontend")
    out = out.unionByName(rows(few.filter(many), 0, F.col("at"), F.format_string("changed - %d templates directly extend it", "n"), entity, "frontend", related=F.col("children")))
    child = lambda c: F.concat(F.lit("extends:"), c)
    shown = direct.join(few.filter(~many).select(F.col("name").alias("src")), "src", "left_semi")
    out = out.unionByName(rows(shown, 1, F.col("at"), F.format_string("extends '%s'", "src"), child("dst"), "frontend"))
    far = stored(closures.reach_from_each(edges, named.select(F.col("name").alias("node"))), "descendants")
    cyclic = far.join(edges, (F.col("node") == F.col("src")) & (F.col("seed") == F.col("dst"))).select("seed").distinct()
    below = far.filter("hop > 0").join(cyclic, "seed", "left_anti").select(F.col("node").alias("dst")).distinct()
    transitive = below.join(direct.select("dst"), "dst", "left_anti").join(there.withColumnRenamed("template", "dst"), "dst")
    out = out.unionByName(rows(transitive, 2, F.col("at"), F.lit("extends (transitive)"), child("dst"), "heuristic"))
    sites = binding.render_sites(usages, named.select(F.col("name").alias("template")).union(below).distinct()).filter("ctx_leaf <> ''").withColumn("module", paths.module_of(F.col("path")))
    sites = sites.join(named.select(F.col("name").alias("template"), F.lit(True).alias("is_changed")), "template", "left").withColumn("sure", F.col("certain") & F.coalesce("is_changed", F.lit(False)))
    said = F.format_string("renders '%s' (line %d)", "template", "line")
    sure = stored(sites.filter("sure"), "render-sites")
    out = out.unionByName(rows(sure, 3, F.col("path"), said, F.col("ctx_leaf"), "backend", F.col("module"), "python", F.col("line")))
    other = sites.filter("NOT sure").join(sure.select("path", "line"), ["path", "line"], "left_anti")
    out = out.unionByName(rows(other, 4, F.col("path"), said, F.format_string("render:%s:%d", "path", "line"), "heuristic", F.col("module"), "python", F.col("line")))
    views = sure.groupBy(F.col("ctx_leaf").alias("name")).agg(F.array_sort(F.collect_set("module")).alias("modules")).select("name", F.lit("function").alias("kind"), F.lit(False).alias("deleted"), "modules")
    unresolved = graph.filter("dynamic_include").join(changed.select("path"), "path", "left_semi").select(F.col("path").alias("file"), none.alias("ref"), F.lit("dynamic include; manual check required").alias("reason"))
    return out, views, unresolved


def asset_chain(changed: DataFrame, graph: DataFrame, usages: DataFrame) -> DataFrame:
    """asset, template, view: changed assets to the templates that load them and the code that renders those."""
    loads = routes.match_assets(graph.select(F.col("template_name").alias("file"), F.explode("assets").alias("asset")), changed).select(F.col("path").alias("asset"), F.col("file").alias("template")).distinct()
    sites = binding.render_sites(usages, loads.select("template").distinct(), certain=True).select("template", F.col("path").alias("view"))
    return loads.join(sites, "template", "left")


def import_chain(exports: DataFrame, edges: DataFrame, words: DataFrame, nodes: int = 500) -> tuple[DataFrame, DataFrame]:
    """(direct users of changed exports by name, files that import the changed files through others)."""
    direct = routes.export_users(exports, edges, words)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    far = closures.reach(back, exports.select(F.col("path").alias("node")), nodes=nodes).filter("hop > 0").select(F.col("node").alias("path"), "hop")
    return direct, far.join(direct.select("path"), "path", "left_anti")


def endpoint_chain(calls: DataFrame, route_table: DataFrame, callees: DataFrame, hops: int = 3) -> DataFrame:
    """url, handler, callee, hop: HTTP literals to routes, their handlers and what those call (src, dst)."""
    matched, _ = routes.match_urls(calls, route_table)
    roots = matched.select("ref", "handler", F.element_at(F.split("handler", r"\."), -1).alias("node")).distinct()
    far = closures.reach_from_each(callees, roots.select("node").distinct(), hops)
    return roots.join(far.withColumnRenamed("node", "callee"), roots["node"] == far["seed"]).select(F.col("ref").alias("url"), "handler", "callee", "hop")
