"""Joins of references with routes, assets, importers and handlers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions import paths, urls
from tremor.operators.changes import first_by


#: Ownership rules that are put into one expression.
RULES = 100


def match_template_refs(refs: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, unresolved): refs (file, name) with the route (ord, name, full, handler) of that name, the last of equals."""
    last = first_by(routes.filter("name IS NOT NULL"), ["name"], F.desc("ord"))
    joined = refs.join(last, "name", "left")
    unresolved = joined.filter("full IS NULL").select("file", F.col("name").alias("ref"), F.when(F.col("name").isNull(), "dynamic-ref").otherwise("unknown-url").alias("reason"))
    return joined.filter("full IS NOT NULL"), unresolved


def match_urls(refs: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, unresolved): refs (file, line, ref) with the first route that is equal, else by pattern, else by prefix.

    Equality is a hash join on the normalised path. Patterns are tried only against routes with as many components and
    the same first one, or one of the few whose first is a parameter, and prefixes by exploding a route's own prefixes,
    so both are hash joins too. Routes may carry an expression (regex) of their own; only those whose first component it
    leaves open are tried on every URL.
    """
    u = refs.withColumn("__url", urls.one_slash(urls.plain_ref(F.col("ref"))))
    distinct = u.select("__url").distinct()
    r = routes.select("ord", "full", "handler", F.col("regex") if "regex" in routes.columns else F.lit(None).cast("string").alias("regex")).withColumn("__full", urls.one_slash(F.col("full")))
    depth = lambda c: F.size(F.split(c, "/"))
    first = lambda c: F.regexp_extract(c, r"^/*([^/]*)", 1)
    equal = distinct.join(r, F.col("__url") == F.col("__full")).select("__url", F.lit(0).alias("stage"), "ord")
    # an expression of its own is free to cross components: its first one is known if it is plain
    given = F.col("regex").isNotNull()
    plain_first = F.regexp_extract("regex", r"^\^(?:\\Q)?([\w\-]+)/", 1)
    patterns = r.filter(given | F.col("__full").rlike(r"[<{]"))
    patterns = patterns.withColumn("__pattern", F.when(given, F.concat(F.lit("^/"), F.regexp_replace("regex", r"^\^", ""))).otherwise(urls.route_regex(F.col("__full"))))
    patterns = patterns.withColumn("__depth", F.when(~given, depth(F.col("__full")))).withColumn("__first", F.when(given, plain_first).otherwise(first(F.col("__full"))))
    patterns = patterns.withColumn("__open", F.when(given, F.col("__first") == "").otherwise(F.col("__first").rlike(r"[<{]")))
    shaped = distinct.withColumn("__d", depth(F.col("__url"))).withColumn("__f", first(F.col("__url")))
    here = F.expr("__url rlike __pattern")
    stage = lambda df: df.select("__url", F.lit(1).alias("stage"), "ord")
    by_pattern = stage(shaped.join(patterns.filter("NOT __open AND __depth IS NOT NULL"), (F.col("__d") == F.col("__depth")) & (F.col("__f") == F.col("__first")) & here))
    by_pattern = by_pattern.unionByName(stage(shaped.join(patterns.filter("__open AND __depth IS NOT NULL"), (F.col("__d") == F.col("__depth")) & here)))
    by_pattern = by_pattern.unionByName(stage(shaped.join(patterns.filter("NOT __open AND __depth IS NULL"), (F.col("__f") == F.col("__first")) & here)))
    by_pattern = by_pattern.unionByName(stage(shaped.join(patterns.filter("__open AND __depth IS NULL"), here)))
    parts = F.split("__full", "/")
    leads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    lead = r.select("ord", "__full", F.explode(F.concat(leads, F.transform(leads, lambda x: F.concat(x, F.lit("/"))))).alias("__lead")).distinct()
    by_prefix = distinct.join(lead, F.col("__url") == F.col("__lead")).filter(urls.is_prefix(F.col("__url"), F.col("__full"))).select("__url", F.lit(2).alias("stage"), "ord")
    best = equal.unionByName(by_pattern).unionByName(by_prefix).groupBy("__url").agg(F.min(F.struct("stage", "ord")).alias("b")).select("__url", "b.stage", "b.ord")
    joined = u.join(best, "__url", "left").drop("__url")
    unresolved = joined.filter("ord IS NULL").select("file", "ref", F.lit("unknown-url").alias("reason"))
    return joined.filter("ord IS NOT NULL").join(routes, "ord"), unresolved


def match_assets(refs: DataFrame, changed: DataFrame) -> DataFrame:
    """refs (file, asset) with the changed path that is the asset or ends with it."""
    ends = changed.select("path", F.explode(paths.suffixes(F.col("path"))).alias("asset"))
    return refs.join(ends, "asset")


def import_edges(graph: DataFrame, tracked: DataFrame) -> DataFrame:
    """(src, dst) of script imports (path, specifier): the first candidate path that is there."""
    tried = graph.select("path", "specifier", F.posexplode(paths.import_candidates(F.col("specifier"), F.col("path"))).alias("ord", "dst")).filter("dst IS NOT NULL")
    found = tried.join(tracked.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi")
    return found.groupBy("path", "specifier").agg(F.min_by("dst", "ord").alias("dst")).select(F.col("path").alias("src"), "dst").distinct()


def leaf(handler: str) -> F.Column:
    return urls.handler_leaf(F.col(handler))


def affected_routes(routes: DataFrame, reached: DataFrame, bindings: DataFrame) -> DataFrame:
    """Routes whose handler's leaf is reached (name) and bound in the route's own module (path, name)."""
    r = routes.withColumn("name_of_handler", urls.handler_leaf(F.col("handler")))
    r = r.join(reached.select(F.col("node").alias("name_of_handler")).distinct(), "name_of_handler", "left_semi")
    return r.join(bindings.select(F.col("path").alias("module"), F.col("name").alias("name_of_handler")).distinct(), ["module", "name_of_handler"], "left_semi")


def handler_definitions(handlers: DataFrame, defs: DataFrame) -> DataFrame:
    """handler and the path that defines it: where the handler's module part fits, else the first path."""
    h = handlers.select("handler").distinct().withColumn("name", urls.handler_leaf(F.col("handler"))).withColumn("lead", F.regexp_extract("handler", r"^(.*)\.[^.]*$", 1))
    d = defs.select("name", "path").withColumn("module", paths.module_of(F.col("path")))
    fits = (F.col("lead") != "") & ((F.col("module") == F.col("lead")) | F.col("module").endswith(F.concat(F.lit("."), F.col("lead"))))
    return first_by(h.join(d, "name"), ["handler"], F.desc(fits), "path").select("handler", "path")


def handler_roots(handlers: DataFrame, defs: DataFrame, bindings: DataFrame) -> DataFrame:
    """handler, path: the only definition of its name, else those that the route's module binds, else none."""
    h = handlers.withColumn("name", urls.handler_leaf(F.col("handler")))
    d = defs.select("name", "path").distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name")))
    joined = h.join(d, "name")
    bound = joined.join(bindings.select("module", "path").distinct(), ["module", "path"], "left_semi")
    return joined.filter("n = 1").select("handler", "path").union(bound.filter("n > 1").select("handler", "path")).distinct()


def export_users(exports: DataFrame, edges: DataFrame, words: DataFrame) -> DataFrame:
    """(name, path): files that import a changed export's file (path, name) and hold the name as a word (path, word)."""
    users = exports.join(edges.select(F.col("src").alias("user"), F.col("dst").alias("path")), "path").select("name", F.col("user").alias("path"))
    return users.distinct().join(words.select("path", F.col("word").alias("name")).distinct(), ["path", "name"], "left_semi").select("name", "path")


def owners(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with the owner of their path: the last matching rule (ord, regex, owner) decides, empty if none does.

    Up to RULES rules are one CASE over compiled patterns, without a join; more meet the distinct paths in a join by condition.
    """
    few = rules.orderBy(F.desc("ord")).limit(RULES + 1).collect()
    if len(few) > RULES:
        found = rows.select("path").distinct().join(rules, F.expr("path rlike regex")).groupBy("path").agg(F.max_by("owner", "ord").alias("owner"))
        return rows.join(found, "path", "left").withColumn("owner", F.coalesce("owner", F.lit("")))
    owner = F.lit("")
    for r in few[::-1]:
        owner = F.when(F.col("path").rlike(r.regex), F.lit(r.owner)).otherwise(owner)
    return rows.withColumn("owner", owner)


def resolve_constants(consts: DataFrame) -> DataFrame:
    """file, name, value: literals by name, and one prefix joined to a literal; names declared twice are left out.

    consts: (file, name, prefix or null, literal).
    """
    once = consts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file", "name"))).filter("n = 1").drop("n")
    plain = once.filter("prefix IS NULL").select("file", "name", F.col("literal").alias("value"))
    joined = once.filter("prefix IS NOT NULL").join(plain.select("file", F.col("name").alias("prefix"), F.col("value").alias("lead")), ["file", "prefix"])
    return plain.unionByName(joined.select("file", "name", F.concat("lead", "literal").alias("value")))
