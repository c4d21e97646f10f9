"""Classification, scoring, ranking and roll-ups of impact rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions import paths, text
from tremor.operators.changes import first_by, numbered

# --- fixed values: display order and gates ---
SECTIONS = ("Breaking", "Direct", "Transitive")
TIERS = ("frontend", "backend", "heuristic")
INLINE_CHILDREN, TOP_ROWS, TOP_PATHS = 8, 20, 5


def _ordinal(column: str, values: tuple[str, ...]) -> F.Column:
    return F.coalesce(*[F.when(F.col(column) == v, k) for k, v in enumerate(values)], F.lit(len(values)))


def deduplicated(rows: DataFrame, keys: tuple[str, ...] = ("path", "category", "ref")) -> DataFrame:
    """The first arrival (seq) of each key."""
    return first_by(rows, list(keys), "seq")


def layers(rows: DataFrame) -> DataFrame:
    """entity, layers: the categories in which an entity is seen, counted before anything is hidden."""
    return rows.groupBy("entity").agg(F.array_sort(F.collect_set("category")).alias("layers"))


def hidden(rows: DataFrame, show_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """(visible, hidden) rows: heuristic and low-confidence ones are hidden unless all are shown."""
    low = (F.coalesce("tier", F.lit("")) == "heuristic") | (F.coalesce("confidence", F.lit("")) == "low")
    return (rows, rows.limit(0)) if show_all else (rows.filter(~low), rows.filter(low))


def fan_in(rows: DataFrame) -> DataFrame:
    """entity, fan_in: distinct paths that refer to it, among visible rows."""
    return rows.groupBy("entity").agg(F.countDistinct("path").alias("fan_in"))


def severity(n_layers, deleted, is_changed, has_path, any_change, tier=None, ref=None) -> F.Column:
    plain = F.when(deleted, "High").when(n_layers >= 2, "High").when(is_changed, "Low").when(~has_path | ~any_change, "Low").otherwise("Medium")
    if tier is None:
        return plain
    tiered = F.when(deleted, "High").when((tier == "frontend") & ref.startswith("changed"), "High").when(tier == "backend", "Medium").when(plain == "High", "Medium").otherwise(plain)
    return F.when(tier.isNull(), plain).otherwise(tiered)


# --- fixed values: why a row has its severity ---
def severity_reason(layers_, deleted, is_changed, has_path, any_change, tier=None, ref=None, base=None) -> F.Column:
    """The reason of a severity; base is what severity() gives without a tier."""
    plain = (
        F.when(deleted, "symbol was deleted or renamed in this change-set")
        .when(F.size(layers_) >= 2, F.concat(F.lit("referenced from multiple layers ("), F.array_join(layers_, " + "), F.lit(")")))
        .when(is_changed, "reference is inside the changed file itself").when(~has_path | ~any_change, "no external reference beyond the change-set").otherwise("referenced from a file outside the change-set"))
    if tier is None:
        return plain
    tiered = F.when(deleted, plain).when((tier == "frontend") & ref.startswith("changed"), "the file itself is in the change-set").when(tier == "backend", "renders a changed template")
    return F.when(tier.isNull(), plain).otherwise(tiered.when(base == "High", "reachable through the template/import graph").otherwise(plain))


# --- fixed values: what a breaking change says ---
BREAKING = {
    "deleted-test": ("deleted test coverage", "restore or justify removal"), "removed-export": ("breaking API change: ", "restore export or justify breaking change"),
    "signature-changed": ("breaking API change: signature changed", "restore export or justify breaking change"), "migration-infra": ("migration/infra change - needs rollout note", "add rollout note"),
}


def breaking_rows(found: DataFrame) -> DataFrame:
    """Rows of a report for breaking changes (path, rule, symbol): High, changed, each for itself."""
    of = lambda k: F.coalesce(*[F.when(F.col("rule") == rule, said[k]) for rule, said in BREAKING.items()])
    ref = F.concat(of(0), F.when(F.col("rule") == "removed-export", F.coalesce("symbol", F.lit(""))).otherwise(""))
    return found.select(
        "path", paths.dir_of(F.col("path")).alias("module"), F.lit("breaking").alias("category"), ref.alias("ref"), F.lit(0).alias("line"), F.col("symbol").alias("entity"), F.lit(True).alias("deleted"),
        F.lit("high").alias("confidence"), F.lit("High").alias("severity"), F.lit("Breaking").alias("section"), F.lit("Changed").alias("badge"), F.concat("path", F.lit(":0")).alias("key"), of(1).alias("action"),
        F.concat(F.col("path"), F.lit(" "), ref, F.lit(" in this change-set")).alias("why_matters"), F.lit(0).alias("missing_test"), F.lit(0.0).alias("churn"))


def confidence(bound, own) -> F.Column:
    """How sure a Python reference is: an import binds it, it stands in a defining module, or neither."""
    return F.when(bound, "high").when(own, "medium").otherwise("low")


def evidence(bound, own, modules, own_module) -> F.Column:
    """What a Python reference goes through: the defining modules, its own module, or null."""
    return F.when(bound, F.array_sort(modules)).when(own, F.array(own_module))


def tier_confidence(tier) -> F.Column:
    """How sure a row of templates or scripts is, by its tier."""
    return F.when(tier == "frontend", "high").when(tier == "heuristic", "low").otherwise("medium")


def finished(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows with badge, section and key; needs severity, deleted, confidence, tier, ref, line."""
    out = rows.join(changed.select("path", F.lit(True).alias("__c")).distinct(), "path", "left")
    weak = (F.coalesce("confidence", F.lit("")) == "low") | (F.coalesce("tier", F.lit("")) == "heuristic")
    section = F.when(F.col("deleted") | (F.col("severity") == "High"), "Breaking").when(weak, "Transitive").otherwise("Direct")
    key = F.concat(F.coalesce("path", F.lit("")), F.lit(":"), text.line_of(F.col("ref"), F.col("line")).cast("string"))
    return out.withColumn("badge", F.when(F.col("__c"), "Changed").otherwise("Impacted")).withColumn("section", section).withColumn("key", key).drop("__c")


# --- fixed values: what to do, and why ---
def action(rows: DataFrame) -> DataFrame:
    """Rows (ref, entity, severity, deleted, chain, test_path) with what to do, and for those above Low why they matter."""
    todo = F.when(F.col("severity") == "Low", "ok").when(F.col("deleted"), "remove import").when(F.col("test_path").isNotNull(), F.concat(F.lit("run "), F.col("test_path"))).otherwise("update call site")
    symbol = F.regexp_replace("entity", "^(?:changed|extends):", "")
    through = F.when(F.size(F.coalesce("chain", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" via "), F.array_join("chain", "->"))).otherwise(" (unresolved import)")
    why = F.concat(F.coalesce("ref", F.lit("")), F.when(F.col("deleted"), " uses deleted symbol ").otherwise(" uses "), symbol, through)
    return rows.withColumn("action", todo).withColumn("why_matters", F.when(F.col("severity") != "Low", why))


def with_missing_test(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with test_path, the conventional test of their path if it is among files (path), and missing_test: 1 for Python rows without one, else 0."""
    tests = files.select(F.col("path").alias("__test")).distinct()
    python = F.col("category") == "python"
    out = rows.withColumn("__want", F.when(python, paths.test_path_of(F.col("path")))).join(tests, F.col("__want") == F.col("__test"), "left")
    return out.withColumn("missing_test", F.when(python & F.col("__test").isNull(), 1).otherwise(0)).withColumnRenamed("__test", "test_path").drop("__want")


def scored(rows: DataFrame, fans: DataFrame) -> DataFrame:
    """Rows with fan_in (1 for breaking changes) and risk; fan_in counts in shares of the largest, 1 at least."""
    most = fans.agg(F.greatest(F.coalesce(F.max("fan_in"), F.lit(1)), F.lit(1)).alias("most"))
    out = rows.join(fans, "entity", "left").withColumn("fan_in", F.when(F.col("category") == "breaking", 1).otherwise(F.coalesce("fan_in", F.lit(0)))).crossJoin(F.broadcast(most))  # one row
    return out.withColumn("risk", text.risk(F.col("severity"), F.col("fan_in") / F.col("most"), F.col("missing_test"), F.coalesce("churn", F.lit(0.0)))).drop("most")


def ranked(rows: DataFrame) -> DataFrame:
    """Rows with rank from 1: risk falling (to 9 places), path, arrival."""
    return numbered(rows, "rank", F.desc(F.round("risk", 9)), F.coalesce("path", F.lit("")), F.asc_nulls_last("seq"), "ref")


def displayed(rows: DataFrame, top: int | None = TOP_ROWS) -> tuple[DataFrame, DataFrame]:
    """(shown, hidden) of ranked rows in display order, numbered by `number`; top None shows all, below 0 none."""
    out = numbered(rows, "number", _ordinal("section", SECTIONS), _ordinal("tier", TIERS), "rank")
    if top is None:
        return out, out.limit(0)
    return out.filter(F.col("number") <= max(0, top)), out.filter(F.col("number") > max(0, top))


def overflow(rows: DataFrame) -> DataFrame:
    """module, hidden, high: what the display leaves out."""
    return rows.groupBy("module").agg(F.count(F.lit(1)).alias("hidden"), F.count_if(F.col("severity") == "High").alias("high"))


def top_paths(rows: DataFrame, changed: DataFrame, limit: int = TOP_PATHS) -> DataFrame:
    """The distinct paths outside the change-set with the highest risk."""
    best = first_by(rows.join(changed.select("path").distinct(), "path", "left_anti"), ["path"], F.desc("risk"), "seq")
    return best.orderBy(F.desc("risk"), "path").limit(limit)


def summary(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """One row: counts by severity, summary risk (0 to 100, halves to even), impacted paths."""
    s = F.col("severity")
    n = rows.join(changed.select("path", F.lit(True).alias("__c")).distinct(), "path", "left").agg(
        F.count_if(s == "High").alias("high"), F.count_if(s == "Medium").alias("medium"), F.count_if(s == "Low").alias("low"), F.countDistinct(F.when(F.col("__c").isNull(), F.col("path"))).alias("impacted"))
    total = F.col("high") + F.col("medium") + F.col("low")
    share = F.when(total > 0, F.lit(100) * (F.col("high") + F.lit(0.5) * F.col("medium")) / total).otherwise(0.0)
    return n.withColumn("summary_risk", F.least(F.bround(share.cast("double"), 0), F.lit(100.0)).cast("int"))


def unresolved_counts(unresolved: DataFrame) -> DataFrame:
    return unresolved.groupBy(text.reason_bucket(F.col("reason")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def rolled_up(children: DataFrame, keys: list[str], limit: int = INLINE_CHILDREN) -> DataFrame:
    """One row per child (child, related null) where a group has few, else one row per group with all of them in related."""
    n = children.groupBy(*keys).agg(F.countDistinct("child").alias("n"))
    joined = children.select(*keys, "child").distinct().join(n, keys)
    inline = joined.filter(F.col("n") <= limit).select(*keys, "child", F.lit(None).cast("array<string>").alias("related"))
    return inline.unionByName(joined.filter(F.col("n") > limit).groupBy(*keys).agg(F.min("child").alias("child"), F.array_sort(F.collect_set("child")).alias("related")))


def hit_rate(looked_up: DataFrame) -> DataFrame:
    """hit_rate to 3 places of (hit boolean); null if nothing was looked up."""
    return looked_up.agg(F.round(F.try_divide(F.count_if("hit"), F.count(F.lit(1))), 3).alias("hit_rate"))


def breaking(changes: DataFrame, ratios: DataFrame, deleted: DataFrame) -> DataFrame:
    """path, rule, symbol of changes that break: deleted tests, removed exports or changed signatures, migrations and infrastructure; additions do not.

    changes: (path, status, old_path, module, old_module, and signature_changed if that is known); ratios: (path,
    removed_ratio), of which more than a half makes a test a deleted one; deleted: (module, name).
    """
    gone = deleted.groupBy("module").agg(F.min("name").alias("symbol"))
    c = changes.filter(~F.col("status").startswith("A")).join(ratios, "path", "left")
    c = c.join(gone.select("module", F.col("symbol").alias("s1")), "module", "left").join(gone.select(F.col("module").alias("old_module"), F.col("symbol").alias("s2")), "old_module", "left")
    symbol = F.least("s1", "s2")
    lost = F.col("status").startswith("D") | (F.coalesce("removed_ratio", F.lit(0.0)) > 0.5)
    signature = F.coalesce(F.col("signature_changed"), F.lit(False)) if "signature_changed" in changes.columns else F.lit(False)
    rule = F.when(paths.is_test_path(F.col("path")) & lost, "deleted-test").when(symbol.isNotNull(), "removed-export").when(signature, "signature-changed").when(paths.is_migration_or_infra(F.col("path")), "migration-infra")
    return c.withColumn("rule", rule).withColumn("symbol", symbol).filter("rule IS NOT NULL").select("path", "rule", "symbol")


def gate(counts: tuple[int, int, int], fail_on: str | None, advisory: bool = False) -> int:
    """Exit code: 1 if rows at or above the gate's severity are there."""
    order = ("high", "medium", "low")
    if advisory or not fail_on:
        return 0
    return int(sum(counts[: order.index(fail_on.lower()) + 1]) > 0)
