"""Which usages of a name mean a changed definition: the reference join and its module bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.session import stored

# --- fixed values: usages that can mean an entity of a kind, and attribute names too common to mean one ---
USAGE_KINDS = {
    "class_field": ("attr",), "function": ("name", "attr", "import"), "module_field": ("name", "attr", "import"), "method": ("name", "attr"), "class": ("name", "attr", "import"),
}
OTHER_KINDS = ("name",)
#: Kind of an entity that every usage but text can mean.
ANY_KIND = "any"
WEAK_NAMES = ("client_id", "id", "name", "status", "update", "uuid")
RENDER_CALLS = ("render", "render_to_string", "get_template", "select_template", "TemplateResponse")


def kinds_of(kind) -> F.Column:
    """Kinds of usage that can mean an entity of a kind."""
    out = F.array(*[F.lit(k) for k in OTHER_KINDS])
    for name, kinds in USAGE_KINDS.items():
        out = F.when(kind == name, F.array(*[F.lit(k) for k in kinds])).otherwise(out)
    return F.when(kind == ANY_KIND, F.array(F.lit("name"), F.lit("attr"), F.lit("import"))).otherwise(out)


def import_targets(usages: DataFrame) -> DataFrame:
    """path, bound (name or alias), target (module, or module.name) of every import."""
    imports = usages.filter("kind = 'import'")
    package = F.regexp_replace("own_module", r"\.?[^.]*$", "")
    up = F.array_join(F.slice(F.split(package, r"\."), F.lit(1), F.greatest(F.size(F.split(package, r"\.")) - F.coalesce("level", F.lit(0)) + 1, F.lit(0))), ".")
    base = F.when(F.coalesce("level", F.lit(0)) > 0, F.concat_ws(".", F.nullif(up, F.lit("")), F.nullif(F.col("module"), F.lit("")))).otherwise(F.col("module"))
    both = imports.select("path", "name", "alias", F.array(base, F.concat_ws(".", F.nullif(base, F.lit("")), "name")).alias("targets"))
    return both.select("path", F.explode(F.array_distinct(F.array_compact(F.array("name", "alias")))).alias("bound"), "targets").select("path", "bound", F.explode("targets").alias("target")).filter("target IS NOT NULL AND target <> ''").distinct()


def references(usages: DataFrame, entities: DataFrame, changed: DataFrame, weak: tuple[str, ...] | None = (), need_base: bool = False, imports: DataFrame | None = None) -> DataFrame:
    """Usages that can mean a changed entity: name, path, line, how, ctx_qname, ctx_kind, kind_of, deleted, modules.

    usages: (path, own_module, seq, line, name, kind, base, module, level, alias, ctx_qname, ctx_kind); entities: of
    changed_entities(); changed: (path). One join on the name gives the hits, which are written once. Each hit asks the
    imports of its own file (of the usages, or of imports) for its own name and modules, so no join makes more rows than
    hits have modules. Without any changed path no hit is filtered by what it is bound to. weak: further names that are
    too common to mean an entity without an import; None for no such names at all.
    """
    e = entities.select("name", F.col("kind").alias("entity_kind"), "deleted", "modules")
    hits = usages.join(e, "name").filter(F.array_contains(kinds_of(F.col("entity_kind")), F.col("kind")))
    head = F.when(F.col("kind") == "attr", F.substring_index("base", ".", 1)).otherwise(F.col("name"))
    kept = ("name", "path", "line", "kind", "base", "seq", "own_module", "ctx_qname", "ctx_kind", "entity_kind", "deleted", "modules")
    hits = stored(hits.select(*kept, head.alias("head")), "hits")
    targets = import_targets(usages if imports is None else imports).withColumnRenamed("bound", "head")
    targets = stored(targets.join(hits.select("path", "head").distinct(), ["path", "head"], "left_semi"), "targets")
    asked = hits.select("path", "head", "name", "modules", F.explode("modules").alias("target")).distinct()
    bound = asked.join(targets, ["path", "head", "target"], "left_semi").select("path", "head", "name", "modules", F.lit(True).alias("from_entity")).distinct()
    anywhere = targets.select("path", "head", F.lit(True).alias("imported")).distinct()
    hits = hits.join(bound, ["path", "head", "name", "modules"], "left").join(anywhere, ["path", "head"], "left")
    fine, other = F.coalesce("from_entity", F.lit(False)), F.coalesce("imported", F.lit(False))
    if not changed.isEmpty():
        inside = changed.select("path", F.lit(True).alias("is_changed")).distinct()
        hits = hits.join(inside, "path", "left")
        own = F.array_contains("modules", F.col("own_module"))
        attr, bare = F.col("kind") == "attr", F.coalesce(F.col("base"), F.lit("")) == ""
        is_weak = F.lit(False) if weak is None else F.col("name").isin(*WEAK_NAMES, *weak) | (F.col("entity_kind") == "class_field")
        resolved = (
            F.when(F.size("modules") == 0, True).when(~attr, own | fine).when(is_weak, fine & ~bare).when(bare, True).when(fine, True).when(other, False).otherwise(own))
        hits = hits.filter((F.col("is_changed").isNotNull() & ~F.col("deleted")) | resolved)
    if need_base:
        hits = hits.filter((F.col("kind") != "attr") | (F.coalesce(F.col("base"), F.lit("")) != ""))
    return hits.select("name", "path", "line", F.col("kind").alias("how"), "seq", "own_module", "ctx_qname", "ctx_kind", F.col("entity_kind").alias("kind_of"), "deleted", "modules", fine.alias("bound"), other.alias("imported"), F.array_contains("modules", F.col("own_module")).alias("own"))


def render_sites(usages: DataFrame, templates: DataFrame, certain: bool = False) -> DataFrame:
    """Usages of a template's name as a string: path, line, template, ctx_qname, ctx_leaf, certain."""
    sure = F.coalesce(F.col("callee").isin(*RENDER_CALLS) | (F.col("kwarg") == "template_name"), F.lit(False))
    sites = usages.filter("kind = 'str'").join(templates.select(F.col("template").alias("name")), "name").select("path", "line", F.col("name").alias("template"), "ctx_qname", F.element_at(F.split("ctx_qname", r"\."), -1).alias("ctx_leaf"), sure.alias("certain"))
    return sites.filter("certain") if certain else sites


def fast_subset(files: DataFrame, usages: DataFrame, seeds: DataFrame, changed: DataFrame) -> DataFrame:
    """Files (path) that changed, or import a seed (name): all that fast mode looks at."""
    names = usages.filter("kind = 'import'").select("path", F.explode(F.array_distinct(F.array_compact(F.array("name", "alias", F.element_at(F.split("module", r"\."), 1), F.element_at(F.split("module", r"\."), -1))))).alias("name"))
    linked = names.join(seeds.select("name"), "name", "left_semi").select("path")
    return files.select("path").join(linked.union(changed.select("path")).distinct(), "path", "left_semi").distinct()
