"""Bounded graph closures as frontier loops over edge tables.

Each hop joins the frontier with the edges and takes out what is known; hops are written to the shared folder, so that
plans do not grow and lost executors cost no more than a hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions import paths, urls
from tremor.operators import binding
from tremor.operators.changes import numbered
from tremor.operators.routes import handler_definitions
from tremor.session import stored


def reach(edges: DataFrame, seeds: DataFrame, hops: int | None = None, nodes: int | None = None) -> DataFrame:
    """node, hop of all that seeds (node) reach over edges (src, dst), seeds at hop 0.

    No hop begins once `nodes` are known, so a hop may go past that number.
    """
    edges = edges.select("src", "dst").distinct()
    known = stored(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "reach")
    frontier, hop = known, 0
    while (hops is None or hop < hops) and (nodes is None or known.count() < nodes):
        hop += 1
        new = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = stored(new.join(known.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "reach")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def reach_from_each(edges: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """seed, node, hop: what each seed reaches by itself, from many seeds at once; all of it without hops."""
    edges = edges.select("src", "dst").distinct()
    known = stored(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("hop", F.lit(0)), "reach")
    frontier, hop = known, 0
    while hops is None or hop < hops:
        hop += 1
        new = frontier.select("seed", F.col("node").alias("src")).join(edges, "src").select("seed", F.col("dst").alias("node")).distinct()
        frontier = stored(new.join(known.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)), "reach")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def descendants(edges: DataFrame, seed: str) -> DataFrame:
    """node, via: what extends a template over others, with the child through which it does; empty if the template is on a cycle.

    edges: (src, dst), dst extends src.
    """
    spark = edges.sparkSession
    start = edges.filter(F.col("src") == seed).select(F.col("dst").alias("node"), F.col("dst").alias("via")).distinct()
    known = stored(start.groupBy("node").agg(F.min("via").alias("via")), "descend")
    frontier = known
    while not frontier.isEmpty():
        new = frontier.select(F.col("node").alias("src"), "via").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("via").alias("via"))
        frontier = stored(new.join(known.select("node"), "node", "left_anti"), "descend")
        known = known.unionByName(frontier)
    known = stored(known, "descend")
    if not known.filter(F.col("node") == seed).isEmpty():
        return spark.createDataFrame([], known.schema)
    return known


def composed_prefixes(includes: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """module, prefix, regex: URL prefix and expression of every route module; the first visit in breadth-first order fixes them.

    includes: (parent, child, path or prefix, regex, ord), of which path or regex is null; modules: (module, path) of
    the modules there are, in whose order of paths roots are visited, or none for all that includes name. Roots are
    modules that nothing includes; those that only a cycle reaches have no prefix and no row.
    """
    if "path" not in includes.columns:
        includes = includes.withColumnRenamed("prefix", "path")
    if "regex" not in includes.columns:
        includes = includes.withColumn("regex", F.lit(None).cast("string"))
    if modules is None:
        every = includes.select(F.col("parent").alias("module")).union(includes.select(F.col("child").alias("module"))).distinct()
        modules = every.withColumn("path", F.col("module"))
    else:
        includes = includes.join(modules.select(F.col("module").alias("child")), "child", "left_semi")
    roots = modules.join(includes.select(F.col("child").alias("module")), "module", "left_anti")
    # the place in the queue: the root's path, then the number of the include taken at each level
    known = stored(roots.select("module", F.lit("").alias("prefix"), F.lit(None).cast("string").alias("regex"), F.array("path").alias("place")), "prefix")
    frontier = known
    while not frontier.isEmpty():
        step = includes.join(frontier.select(F.col("module").alias("parent"), F.col("prefix").alias("before"), F.col("regex").alias("before_regex"), "place"), "parent")
        shown = F.coalesce("path", urls.literal_of(F.col("regex")))
        source = F.when(F.col("path").isNotNull(), urls.route_source(F.col("path"))).otherwise(F.col("regex"))
        step = step.select(F.col("child").alias("module"), F.concat("before", shown).alias("prefix"), urls.joined_source(F.col("before_regex"), source).alias("regex"), F.concat("place", F.array(F.format_string("%012d", F.col("ord").cast("long")))).alias("place"))
        first = step.groupBy("module").agg(F.min(F.struct("place", "prefix", "regex")).alias("f")).select("module", "f.prefix", "f.regex", "f.place")
        frontier = stored(first.join(known.select("module"), "module", "left_anti"), "prefix")
        known = known.unionByName(frontier)
    return known.select("module", "prefix", "regex")


def callers(usages: DataFrame, entities: DataFrame, hops: int = 5, nodes: int = 500, weak: tuple[str, ...] = ()) -> DataFrame:
    """name, modules: changed definitions (name, modules) and the functions that use them, one hop behind another.

    A caller is the innermost definition that a usage stands in; usages as text and attributes of nothing do not count.
    No hop begins once `nodes` names are known. Of a caller that several names reach in a hop, the first of them, in the
    order in which they were found, tells its modules.
    """
    known = stored(numbered(entities.select("name", "modules"), "ord", "name"), "callers")
    frontier, hop, reached = known, 0, known.count()
    any_path = usages.sparkSession.createDataFrame([("",)], "path string")
    while hop < hops and reached < nodes:
        hop += 1
        asked = frontier.filter(F.size("modules") > 0).select("name", F.lit(binding.ANY_KIND).alias("kind"), F.lit(True).alias("deleted"), "modules")
        hits = binding.references(usages, asked, any_path, weak, need_base=True).filter("ctx_qname <> ''")
        hits = hits.join(frontier.select("name", F.col("ord").alias("from")), "name").withColumn("caller", F.element_at(F.split("ctx_qname", r"\."), -1))
        hits = hits.join(known.select(F.col("name").alias("caller")), "caller", "left_anti")
        first = hits.groupBy("caller").agg(F.min(F.struct("from", "path", "seq")).alias("first"))
        new = hits.join(first, "caller").filter(F.col("from") == F.col("first.from")).groupBy("caller", "first").agg(F.array_sort(F.collect_set("own_module")).alias("modules"))
        frontier = numbered(new.select(F.col("caller").alias("name"), "modules", "first"), "ord", "first", "name").select("name", "modules", (F.col("ord") + reached).alias("ord"))
        frontier = stored(frontier, "callers")
        found = frontier.count()
        if not found:
            break
        reached += found
        known = known.unionByName(frontier)
    return known.select("name", "modules")


def reachable(usages: DataFrame, defs: DataFrame, entries: DataFrame, hops: int = 5, nodes: int = 500) -> DataFrame:
    """entry_path, entry, name, module: what the bodies of entry points (path, name) call, one hop behind another, each entry by itself.

    defs: (path, name, kind, qname). A usage counts if it stands in the entry's body or below; it means a function or
    method of its name in a module if it is bound to that module. No hop begins for an entry that knows `nodes` names.
    """
    own = paths.module_of(F.col("path"))
    functions = defs.filter(F.col("kind").isin("function", "method")).select("name", own.alias("module"), "path", "qname")
    asked = functions.select("name", F.lit(binding.ANY_KIND).alias("kind"), F.lit(True).alias("deleted"), F.array("module").alias("modules")).distinct()
    where = defs.select("path", "name", "qname")
    any_path = usages.sparkSession.createDataFrame([("",)], "path string")
    scopes = entries.join(where, ["path", "name"], "left").select(F.col("path").alias("entry_path"), F.col("name").alias("entry"), "path", F.coalesce("qname", "name").alias("qname"))
    seen = frontier = stored(scopes.distinct(), "scopes")
    reached, hop = None, 0
    parts = F.split("ctx_qname", r"\.")
    bodies = usages.filter(F.col("kind").isin("name", "attr") & (F.coalesce("ctx_qname", F.lit("")) != ""))
    bodies = bodies.withColumn("qname", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))))
    while hop < hops:
        hop += 1
        inside = bodies.join(frontier, ["path", "qname"]).filter(F.col("name") != F.col("entry"))
        inside = stored(inside.drop("qname"), "bodies")
        if inside.isEmpty():
            break
        looked = inside.drop("entry_path", "entry").distinct()
        means = binding.references(looked, asked, any_path, weak=None, imports=usages).select("path", "seq", "name", F.explode("modules").alias("module"))
        new = inside.select("entry_path", "entry", "path", "seq").join(means, ["path", "seq"]).select("entry_path", "entry", "name", "module").distinct()
        new = stored(new if reached is None else new.join(reached, ["entry_path", "entry", "name", "module"], "left_anti"), "reachable")
        reached = new if reached is None else reached.unionByName(new)
        full = reached.groupBy("entry_path", "entry").agg(F.countDistinct("name").alias("n")).filter(F.col("n") >= nodes)
        on = new.join(functions, ["name", "module"]).select("entry_path", "entry", "path", "qname").distinct().join(full, ["entry_path", "entry"], "left_anti")
        frontier = stored(on.join(seen, ["entry_path", "entry", "path", "qname"], "left_anti"), "scopes")
        seen = seen.unionByName(frontier)
    return reached if reached is not None else scopes.select("entry_path", "entry", F.lit("").alias("name"), F.lit("").alias("module")).limit(0)


def entry_points(routes: DataFrame, defs: DataFrame, files: DataFrame) -> DataFrame:
    """path, name: the definitions of route handlers (module, handler), or where there are none the route's own file, and files of commands (name null)."""
    handled = routes.withColumn("name", urls.handler_leaf(F.col("handler"))).filter("name <> ''")
    at = handler_definitions(handled.select("handler"), defs).withColumnRenamed("path", "defined")
    handlers = handled.join(at, "handler", "left").select(F.coalesce("defined", "module").alias("path"), "name")
    commands = files.filter(paths.matches_glob(F.col("path"), paths.COMMANDS)).select("path", F.lit(None).cast("string").alias("name"))
    return handlers.union(commands).distinct()


def reached_by_entries(usages: DataFrame, defs: DataFrame, entries: DataFrame, hops: int = 5, nodes: int = 500) -> tuple[DataFrame, DataFrame]:
    """(names, modules) (node) of all that entry points (path, name) reach; of a file of commands, all its definitions."""
    named = entries.filter("name IS NOT NULL")
    far = stored(reachable(usages, defs, named, hops, nodes), "reached")
    commands = entries.filter("name IS NULL").join(defs.select("path", F.col("name").alias("node")), "path").select("node")
    names = named.select(F.col("name").alias("node")).union(far.select("name")).union(commands).distinct()
    modules = entries.select(paths.module_of(F.col("path")).alias("node")).union(far.select("module")).distinct()
    return names, modules


def downgraded(rows: DataFrame, names: DataFrame, modules: DataFrame) -> DataFrame:
    """Rows with reachability and, where no entry point reaches them, severity one level lower.

    names and modules (node): what entry points reach. Only rows of Python code are judged; one is reached by its file's
    module, by standing in no function, or by the function it stands in. Without any entry point all rows are reachable.
    """
    if names.isEmpty() and modules.isEmpty():
        return rows.withColumn("reachability", F.lit("reachable"))
    out = rows.join(modules.select(F.col("node").alias("__mod"), F.lit(True).alias("__m")).distinct(), paths.module_of(F.col("path")) == F.col("__mod"), "left").drop("__mod")
    out = out.join(names.select(F.col("node").alias("__name"), F.lit(True).alias("__c")).distinct(), F.element_at(F.split("ctx_qname", r"\."), -1) == F.col("__name"), "left").drop("__name")
    hit = (F.coalesce("category", F.lit("")) != "python") | F.col("__m").isNotNull() | F.col("__c").isNotNull() | (F.coalesce("ctx_qname", F.lit("")) == "")
    lower = F.when(F.col("severity") == "High", "Medium").when(F.col("severity") == "Medium", "Low").otherwise(F.col("severity"))
    return out.withColumn("reachability", F.when(hit, "reachable").otherwise("unreachable")).withColumn("severity", F.when(hit, F.col("severity")).otherwise(lower)).drop("__m", "__c")
