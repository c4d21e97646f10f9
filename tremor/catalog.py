"""Queries over the driver tables that apply the library's operators, with equivalent SQL.

The tables hold no source code, so each query first projects one of them onto the operator's own schema: usages and
imports from lineitem, changed definitions from part, change lists and hunks from orders, ownership rules from nation,
references and routes from pages, file contents from documents. The projections are plain SQL that both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.functions import paths, text, urls
from tremor.operators import binding, changes, checks, closures, routes, scope, scoring
from tremor.plans import impact, report
from tremor.session import table
from tremor.sources import extract

FLAGSHIP = "impact_report"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- projections, in SQL of both engines; {t} is the table ---
USAGES = """
SELECT 'app/m' || l_suppkey || '.py' AS path, 'app.m' || l_suppkey AS own_module, l_orderkey * 10 + l_linenumber AS seq, l_linenumber AS line, 'sym_' || l_partkey AS name,
       CASE l_linenumber % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'attr' WHEN 2 THEN 'import' ELSE 'str' END AS kind,
       CASE WHEN l_linenumber % 4 <> 1 THEN NULL WHEN l_orderkey % 3 = 0 THEN '' WHEN l_orderkey % 3 = 1 THEN 'sym_' || (l_partkey % 50) || '.x' ELSE 'self' END AS base,
       CASE WHEN l_linenumber % 4 = 2 THEN 'pkg.b' || (l_partkey % 25) END AS module, CASE WHEN l_linenumber % 4 = 2 THEN 0 END AS level,
       CASE WHEN l_linenumber % 4 = 2 AND l_orderkey % 2 = 0 THEN 'as_' || l_partkey END AS alias, l_returnflag || '.f' AS ctx_qname, 'function' AS ctx_kind,
       CASE WHEN l_orderkey % 2 = 0 THEN 'render' ELSE 'log' END AS callee, CASE WHEN l_orderkey % 5 = 0 THEN 'template_name' END AS kwarg
FROM {t}"""
ENTITIES = """
SELECT 'sym_' || p_partkey AS name, CASE p_size % 5 WHEN 0 THEN 'class_field' WHEN 1 THEN 'method' WHEN 2 THEN 'class' WHEN 3 THEN 'function' ELSE 'module_field' END AS kind,
       p_partkey % 21 = 0 AS deleted, CASE WHEN p_partkey % 4 = 0 THEN 'app.m' || (p_partkey % 90 + 1) ELSE 'pkg.b' || (p_partkey % 25) END AS module, 'app/p' || (p_partkey % 40) || '.py' AS path, p_size AS line, p_size + p_partkey % 7 AS end_line
FROM {t}"""
CHANGED = "SELECT DISTINCT 'app/m' || (o_custkey % 40) * 5 || '.py' AS path FROM {t}"
HUNKS = "SELECT 'app/p' || (o_custkey % 40) || '.py' AS path, CAST(o_custkey % 100 + 1 AS INT) AS new_start, CAST(o_custkey % 4 AS INT) AS new_count, CAST(o_custkey % 90 + 1 AS INT) AS old_start, CAST(o_custkey % 3 AS INT) AS old_count FROM {t}"
EDGES = "SELECT DISTINCT l_suppkey AS src, (l_suppkey * 7 + l_linenumber) % 97 + 1 AS dst FROM {t}"


def _view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.format(t="{t}"), t=table(spark, sf_dir, name))


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


U, E, C = USAGES.format(t="lineitem"), ENTITIES.format(t="part"), CHANGED.format(t="orders")
_HITS = f"""
u AS ({U}), e AS ({E}), c AS ({C}),
imports AS (
  SELECT DISTINCT path, unnest([name, alias]) AS bound, module FROM u WHERE kind = 'import'),
targets AS (
  SELECT path, bound, module AS target FROM imports WHERE bound IS NOT NULL UNION
  SELECT u.path, b, u.module || '.' || u.name FROM u, unnest([u.name, u.alias]) AS x(b) WHERE u.kind = 'import' AND b IS NOT NULL),
h0 AS (
  SELECT u.*, e.kind AS entity_kind, e.deleted, e.module AS entity_module, CASE WHEN u.kind = 'attr' THEN split_part(u.base, '.', 1) ELSE u.name END AS head, u.path IN (SELECT path FROM c) AS is_changed
  FROM u JOIN e ON u.name = e.name
  WHERE CASE e.kind WHEN 'class_field' THEN u.kind = 'attr' WHEN 'method' THEN u.kind IN ('name', 'attr') ELSE u.kind IN ('name', 'attr', 'import') END),
h1 AS (
  SELECT h0.*, own_module = entity_module AS own, EXISTS (SELECT 1 FROM targets t WHERE t.path = h0.path AND t.bound = h0.head AND t.target = h0.entity_module) AS fine,
         EXISTS (SELECT 1 FROM targets t WHERE t.path = h0.path AND t.bound = h0.head) AS other FROM h0),
hits AS (
  SELECT * FROM h1 WHERE (is_changed AND NOT deleted) OR CASE
    WHEN kind <> 'attr' THEN own_module = entity_module OR fine
    WHEN entity_kind = 'class_field' THEN fine AND base <> ''
    WHEN base = '' THEN true WHEN fine THEN true WHEN other THEN false ELSE own_module = entity_module END)"""


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _view(spark, sf_dir, ENTITIES, "part").select("name", "kind", "deleted", F.array("module").alias("modules"))
    changed = _view(spark, sf_dir, CHANGED, "orders")
    return binding.references(_view(spark, sf_dir, USAGES, "lineitem"), e, changed), changed


@query(f"WITH {_HITS} SELECT name, path, line, kind AS how, seq, deleted, fine AS bound FROM hits")
def references(spark, sf_dir):
    return _hits(spark, sf_dir)[0].select("name", "path", "line", "how", "seq", "deleted", "bound")


_REPORT = f"""{_HITS},
r0 AS (
  SELECT seq, path, ctx_qname AS module, CASE WHEN seq % 5 = 0 THEN 'template' ELSE 'python' END AS category, name || ' (' || kind || ' at ' || line || ')' AS ref, line, name AS entity, deleted,
         CASE WHEN fine THEN 'high' WHEN own THEN 'medium' ELSE 'low' END AS confidence, ctx_qname FROM hits),
r1 AS (SELECT * FROM r0 QUALIFY row_number() OVER (PARTITION BY path, category, ref ORDER BY seq) = 1),
la AS (SELECT entity, string_agg(DISTINCT category, '+' ORDER BY category) AS layers, count(DISTINCT category) AS n_layers FROM r1 GROUP BY entity),
v AS (SELECT * FROM r1 WHERE confidence <> 'low'),
fan AS (SELECT entity, count(DISTINCT path) AS fan_in FROM v GROUP BY entity),
r2 AS (
  SELECT v.*, la.layers, fan.fan_in, v.path IN (SELECT path FROM c) AS inside,
         CASE WHEN deleted OR n_layers >= 2 THEN 'High' WHEN v.path IN (SELECT path FROM c) THEN 'Low' ELSE 'Medium' END AS severity,
         CASE WHEN category <> 'python' THEN 0 WHEN CAST(substr(v.path, 6, length(v.path) - 8) AS INT) % 3 = 0 AND v.path LIKE 'app/m%' THEN 0 ELSE 1 END AS missing_test
  FROM v JOIN la USING (entity) JOIN fan USING (entity)),
r3 AS (
  SELECT *, CASE WHEN deleted OR severity = 'High' THEN 'Breaking' ELSE 'Direct' END AS section, CASE WHEN inside THEN 'Changed' ELSE 'Impacted' END AS badge, path || ':' || line AS key,
         0.4::DOUBLE * CASE severity WHEN 'High' THEN 1.0::DOUBLE WHEN 'Medium' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + 0.3::DOUBLE * least(fan_in / (SELECT greatest(max(fan_in), 1) FROM fan), 1.0::DOUBLE) + 0.2::DOUBLE * missing_test + 0.1::DOUBLE * 0.0::DOUBLE AS risk
  FROM r2)"""


def _report(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    hits, changed = _hits(spark, sf_dir)
    rows = impact.python_rows(hits).withColumn("category", F.when(F.col("seq") % 5 == 0, "template").otherwise("python"))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("tests/test_m"), (F.col("s_suppkey") * 3).cast("string"), F.lit(".py")).alias("path"))
    ranked, hidden = impact.compose(rows, changed, files)
    return ranked, hidden, changed


@query(f"""WITH {_REPORT} SELECT row_number() OVER (ORDER BY round(risk, 9) DESC, path, seq, ref) AS rank, path, module, category, ref, entity, severity, section, badge, key, fan_in, missing_test, layers, round(risk, 9) AS risk FROM r3""")
def impact_report(spark, sf_dir):
    ranked, _, _ = _report(spark, sf_dir)
    return ranked.withColumn("risk", F.round("risk", 9)).select("rank", "path", "module", "category", "ref", "entity", "severity", "section", "badge", "key", "fan_in", "missing_test", F.array_join("layers", "+").alias("layers"), "risk")


@query(f"""WITH {_REPORT}, s AS (SELECT count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low, count(DISTINCT CASE WHEN NOT inside THEN path END) AS impacted FROM r3)
SELECT *, least(round_even(100 * (high + 0.5::DOUBLE * medium) / (high + medium + low), 0), 100)::INT AS summary_risk FROM s""")
def report_summary(spark, sf_dir):
    ranked, _, changed = _report(spark, sf_dir)
    return scoring.summary(ranked, changed)


@query(f"""WITH {_REPORT}, n AS (SELECT *, row_number() OVER (ORDER BY CASE section WHEN 'Breaking' THEN 0 ELSE 1 END, round(risk, 9) DESC, path, seq) AS number FROM r3)
SELECT module, count(*) AS hidden, count(*) FILTER (severity = 'High') AS high FROM n WHERE number > 20 GROUP BY module""")
def report_overflow(spark, sf_dir):
    ranked, _, _ = _report(spark, sf_dir)
    return scoring.overflow(scoring.displayed(ranked)[1])


@query(f"""WITH {_REPORT}, b AS (SELECT path, round(risk, 9) AS risk FROM r3 WHERE NOT inside QUALIFY row_number() OVER (PARTITION BY path ORDER BY risk DESC, seq) = 1)
SELECT path, risk FROM b ORDER BY risk DESC, path LIMIT 5""")
def top_impacted_paths(spark, sf_dir):
    ranked, _, changed = _report(spark, sf_dir)
    return scoring.top_paths(ranked.withColumn("risk", F.round("risk", 9)), changed).select("path", "risk")


@query(f"""WITH {_REPORT} SELECT row_number() OVER (ORDER BY round(risk, 9) DESC, path, seq, ref) AS rank, 'impact/' || lower(severity) AS rule, CASE severity WHEN 'High' THEN 'error' WHEN 'Medium' THEN 'warning' ELSE 'note' END AS level, ref AS text, path AS uri, greatest(line, 1) AS line FROM r3""")
def sarif_results(spark, sf_dir):
    ranked, _, _ = _report(spark, sf_dir)
    return report.sarif_results(ranked)


@query(f"""WITH {_REPORT}, mods AS (SELECT 'app.m' || s_suppkey * 2 AS node FROM supplier),
j AS (SELECT *, category <> 'python' OR replace(replace(path, '.py', ''), '/', '.') IN (SELECT node FROM mods) OR split_part(ctx_qname, '.', 1) = 'N' AS hit FROM r3)
SELECT seq, CASE WHEN hit THEN 'reachable' ELSE 'unreachable' END AS reachability, CASE WHEN hit THEN severity WHEN severity = 'High' THEN 'Medium' ELSE 'Low' END AS severity FROM j""")
def reachability_downgrade(spark, sf_dir):
    ranked, _, _ = _report(spark, sf_dir)
    modules = table(spark, sf_dir, "supplier").selectExpr("'app.m' || s_suppkey * 2 AS node")
    rows = ranked.withColumn("ctx_qname", F.substring_index("ctx_qname", ".", 1))
    return closures.downgraded(rows, spark.sql("SELECT 'N' AS node"), modules).select("seq", "reachability", "severity")


@query(f"""WITH {_HITS} SELECT name AS entity, string_agg(DISTINCT CASE WHEN seq % 5 = 0 THEN 'template' ELSE 'python' END, '+' ORDER BY CASE WHEN seq % 5 = 0 THEN 'template' ELSE 'python' END) AS layers FROM hits GROUP BY name""")
def entity_layers(spark, sf_dir):
    hits, _ = _hits(spark, sf_dir)
    rows = hits.select(F.col("name").alias("entity"), F.when(F.col("seq") % 5 == 0, "template").otherwise("python").alias("category"))
    return scoring.layers(rows).select("entity", F.array_join("layers", "+").alias("layers"))


@query(f"""WITH u AS ({U}), t AS (SELECT DISTINCT 'sym_' || p_partkey * 11 AS template FROM part)
SELECT path, line, name AS template, split_part(ctx_qname, '.', 2) AS ctx_leaf, callee IN ('render', 'render_to_string', 'get_template', 'select_template', 'TemplateResponse') OR coalesce(kwarg = 'template_name', false) AS certain
FROM u JOIN t ON u.name = t.template WHERE kind = 'str'""")
def render_sites(spark, sf_dir):
    templates = table(spark, sf_dir, "part").selectExpr("'sym_' || p_partkey * 11 AS template")
    return binding.render_sites(_view(spark, sf_dir, USAGES, "lineitem"), templates).select("path", "line", "template", "ctx_leaf", "certain")


@query(f"""WITH u AS ({U}), c AS ({C}), s AS (SELECT 'sym_' || p_partkey * 97 AS name FROM part),
i AS (SELECT path FROM u WHERE kind = 'import' AND (name IN (SELECT name FROM s) OR alias IN (SELECT name FROM s) OR split_part(module, '.', 1) IN (SELECT name FROM s) OR split_part(module, '.', 2) IN (SELECT name FROM s)))
SELECT DISTINCT path FROM u WHERE path IN (SELECT path FROM i) OR path IN (SELECT path FROM c)""")
def fast_subset(spark, sf_dir):
    u = _view(spark, sf_dir, USAGES, "lineitem")
    seeds = table(spark, sf_dir, "part").selectExpr("'sym_' || p_partkey * 97 AS name")
    return binding.fast_subset(u, u, seeds, _view(spark, sf_dir, CHANGED, "orders"))


_DEFS = "SELECT 'app/p' || (p_partkey % 40) || '.py' AS path, 'sym_' || (p_partkey % 300) AS name, 'k' || (p_size % 5) AS kind, CAST(p_size AS INT) AS line, CAST(p_size + p_partkey % 7 AS INT) AS end_line, p_partkey FROM {t}"
_D = _DEFS.format(t="part")


@query(f"""WITH d AS ({_D}), o AS (SELECT * REPLACE (CASE WHEN p_partkey % 5 = 0 THEN 'was_' || name ELSE name END AS name) FROM d), n AS (SELECT * REPLACE (CASE WHEN p_partkey % 3 = 0 THEN 'now_' || name ELSE name END AS name) FROM d), h AS ({HUNKS.format(t="orders")}),
ol AS (SELECT DISTINCT path, unnest(range(old_start, old_start + old_count)) AS line FROM h), nl AS (SELECT DISTINCT path, unnest(range(new_start, new_start + new_count)) AS line FROM h),
t_old AS (SELECT DISTINCT o.* FROM o JOIN ol ON o.path = ol.path AND ol.line BETWEEN o.line AND o.end_line), tn AS (SELECT DISTINCT n.* FROM n JOIN nl ON n.path = nl.path AND nl.line BETWEEN n.line AND n.end_line),
x AS (SELECT path, name, kind, line, NOT EXISTS (SELECT 1 FROM n WHERE n.path = t.path AND n.name = t.name) AS deleted FROM t_old t UNION ALL SELECT path, name, kind, line, false FROM tn)
SELECT name, arg_min(kind, struct_pack(a := deleted, b := path, c := line, d := kind)) AS kind, bool_and(deleted) AS deleted, string_agg(DISTINCT replace(replace(path, '.py', ''), '/', '.'), ',' ORDER BY replace(replace(path, '.py', ''), '/', '.')) AS modules FROM x GROUP BY name""")
def changed_entities(spark, sf_dir):
    d = _view(spark, sf_dir, _DEFS, "part")
    named = lambda k, lead: d.withColumn("name", F.when(F.col("p_partkey") % k == 0, F.concat(F.lit(lead), "name")).otherwise(F.col("name")))
    old, new = named(5, "was_"), named(3, "now_")
    h = _view(spark, sf_dir, HUNKS, "orders")
    touched = lambda x, side: changes.overlapping(x, changes.hunk_lines(h, side)).drop("p_partkey")
    modules = d.select("path", paths.module_of(F.col("path")).alias("module")).distinct()
    found = changes.changed_entities(old.drop("p_partkey"), new.drop("p_partkey"), touched(old, "old"), touched(new, "new"), modules)
    return found.select("name", "kind", "deleted", F.array_join("modules", ",").alias("modules"))


@query(f"WITH h AS ({HUNKS.format(t='orders')}) SELECT DISTINCT path, unnest(range(new_start, new_start + new_count)) AS line FROM h")
def hunk_lines(spark, sf_dir):
    return changes.hunk_lines(_view(spark, sf_dir, HUNKS, "orders"))


@query("""WITH t AS (SELECT doc_id, '@@ -' || (doc_id % 90 + 1) || CASE WHEN doc_id % 2 = 0 THEN ',3' ELSE '' END || ' +' || (doc_id % 80 + 1) || CASE WHEN doc_id % 3 = 0 THEN ',0' ELSE '' END || ' @@' AS h FROM documents)
SELECT 'd' || doc_id AS path, (doc_id % 90 + 1)::INT AS old_start, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END AS old_count, (doc_id % 80 + 1)::INT AS new_start, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS new_count FROM t""")
def parsed_hunks(spark, sf_dir):
    diffs = table(spark, sf_dir, "documents").selectExpr(
        "'d' || doc_id AS path", "'diff --git\\n@@ -' || (doc_id % 90 + 1) || CASE WHEN doc_id % 2 = 0 THEN ',3' ELSE '' END || ' +' || (doc_id % 80 + 1) || CASE WHEN doc_id % 3 = 0 THEN ',0' ELSE '' END || ' @@ f\\n-a\\n+b' AS text")
    return changes.parse_hunks(diffs)


@query("""WITH a AS (SELECT 'app/m' || (o_custkey % 70) * 3 || '.py' AS path, max(CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'M' ELSE 'A' END) AS status, 0 AS k FROM orders GROUP BY 1),
b AS (SELECT 'app/m' || (o_custkey % 130) * 2 || '.PY' AS path, max(CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'M' ELSE 'A' END) AS status, 1 AS k FROM orders GROUP BY 1),
c AS (SELECT 'app/m' || (o_custkey % 200) || '.py' AS path, 'M' AS status, 2 AS k FROM orders GROUP BY 1)
SELECT path, status, 'py' AS ext FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) QUALIFY row_number() OVER (PARTITION BY path ORDER BY k, status) = 1""")
def merged_change_lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'M' ELSE 'A' END AS s")
    none = F.lit(None).cast("string").alias("old_path")
    a = o.groupBy(F.expr("'app/m' || (o_custkey % 70) * 3 || '.py'").alias("path")).agg(F.max("s").alias("status")).select("path", "status", none)
    b = o.groupBy(F.expr("'app/m' || (o_custkey % 130) * 2 || '.PY'").alias("path")).agg(F.max("s").alias("status")).select("path", "status", none)
    c = o.select(F.expr("'app/m' || (o_custkey % 200) || '.py'").alias("path"), F.lit("M").alias("status"), none).distinct()
    return changes.merge_change_lists(a, b, c).select("path", "status", "ext")


_OLD = "SELECT CASE WHEN doc_id % 11 = 0 THEN 'g/' ELSE 'd/' END || doc_id || '.txt' AS path, coalesce(text, '') || CASE WHEN doc_id % 11 = 0 THEN ' gone ' ELSE ' #' END || doc_id AS content FROM {t}"
_NEW = "SELECT CASE WHEN doc_id % 17 = 0 THEN 'e/' WHEN doc_id % 13 = 0 THEN 'n/' ELSE 'd/' END || doc_id || '.txt' AS path, coalesce(text, '') || CASE WHEN doc_id % 17 = 0 THEN ' #' WHEN doc_id % 13 = 0 THEN ' fresh ' WHEN doc_id % 7 = 0 THEN ' edited ' ELSE ' #' END || doc_id AS content FROM {t}"


@query(f"""WITH o AS ({_OLD.format(t='documents')}), n AS ({_NEW.format(t='documents')}),
j AS (SELECT coalesce(o.path, n.path) AS path, sha1(o.content) AS was, sha1(n.content) AS now, CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' WHEN o.content <> n.content THEN 'M' END AS status FROM o FULL JOIN n ON o.path = n.path),
r AS (SELECT a.path, d.path AS gone FROM j a JOIN j d ON a.status = 'A' AND d.status = 'D' AND a.now = d.was)
SELECT path, 'R100' AS status, gone AS old_path, 'txt' AS ext FROM r
UNION ALL SELECT path, status, CASE WHEN status = 'D' THEN path END, 'txt' FROM j WHERE status IS NOT NULL AND path NOT IN (SELECT path FROM r) AND path NOT IN (SELECT gone FROM r)""")
def snapshot_diff(spark, sf_dir):
    return changes.diff_snapshots(_view(spark, sf_dir, _OLD, "documents"), _view(spark, sf_dir, _NEW, "documents"))


@query("""WITH c AS (SELECT doc_id, sha1(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS hash, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 3 END AS v FROM documents)
SELECT 'd/' || d.doc_id AS path, sha1(d.text) AS hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = d.doc_id AND c.v = 3 AND c.hash = sha1(d.text))""")
def stale_analyses(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.expr("'d/' || doc_id").alias("path")
    cache = d.select(path, text.content_hash(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "!").otherwise(""))).alias("hash"), F.when(F.col("doc_id") % 5 == 0, 2).otherwise(3).alias("v"))
    return changes.stale(d.select(path, text.content_hash(F.col("text")).alias("hash")), cache, extract.ANALYSIS_VERSION).select("path", "hash")


@query("""WITH l AS (SELECT DISTINCT 'app/m' || (o_custkey % 200) || '.py' AS path, o_orderkey % 40 AS line FROM orders), t AS (SELECT DISTINCT 'app/m' || s_suppkey || '.py' AS path, 50 + s_suppkey % 9 AS n FROM supplier)
SELECT t.path, round(count(l.line) / max(t.n), 9) AS removed_ratio FROM t LEFT JOIN l ON t.path = l.path GROUP BY t.path""")
def removed_ratio(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").selectExpr("'app/m' || (o_custkey % 200) || '.py' AS path", "o_orderkey % 40 AS line")
    totals = table(spark, sf_dir, "supplier").selectExpr("'app/m' || s_suppkey || '.py' AS path", "50 + s_suppkey % 9 AS n")
    return changes.removed_ratio(lines, totals).withColumn("removed_ratio", F.round("removed_ratio", 9))


@query("""WITH p AS (SELECT DISTINCT 'lib/s' || s_suppkey || '/m.py' AS path, s_suppkey AS k FROM supplier), r AS (SELECT n_nationkey AS ord, n_name AS owner FROM nation)
SELECT p.path, coalesce(arg_max(r.owner, r.ord) FILTER (r.ord = k % 40 OR (r.ord = 7 AND k % 3 = 0)), '') AS owner FROM p LEFT JOIN r ON true GROUP BY p.path""")
def owners(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr("'lib/s' || s_suppkey || '/m.py' AS path")
    numbers = table(spark, sf_dir, "supplier").selectExpr("s_suppkey % 40 AS ord", "s_suppkey AS k")
    exact = numbers.groupBy("ord").agg(F.concat(F.lit("^lib/s(?:"), F.array_join(F.array_sort(F.collect_set(F.col("k").cast("string"))), "|"), F.lit(")/m\\.py$")).alias("regex"))
    third = numbers.filter("k % 3 = 0").agg(F.lit(7).alias("ord"), F.concat(F.lit("^lib/s(?:"), F.array_join(F.array_sort(F.collect_set(F.col("k").cast("string"))), "|"), F.lit(")/m\\.py$")).alias("regex"))
    rules = exact.select(F.col("ord").cast("int").alias("ord"), "regex").union(third.select(F.col("ord").cast("int"), "regex")).join(table(spark, sf_dir, "nation").selectExpr("n_nationkey AS ord", "n_name AS owner"), "ord")
    return routes.owners(rows, rules).select("path", "owner")


@query(f"""WITH RECURSIVE e AS ({EDGES.format(t='lineitem')}), r(node, hop) AS (SELECT DISTINCT s_suppkey // 40 * 40 + 1, 0 FROM supplier UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.node WHERE r.hop < 3)
SELECT node, min(hop) AS hop FROM r GROUP BY node""")
def reach_three_hops(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").selectExpr("s_suppkey div 40 * 40 + 1 AS node")
    return closures.reach(_view(spark, sf_dir, EDGES, "lineitem"), seeds, hops=3)


@query(f"""WITH RECURSIVE e AS ({EDGES.format(t='lineitem')}), r(seed, node, hop) AS (SELECT DISTINCT s_suppkey // 10 * 10 + 1, s_suppkey // 10 * 10 + 1, 0 FROM supplier UNION SELECT r.seed, e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.node WHERE r.hop < 2)
SELECT seed, node, min(hop) AS hop FROM r GROUP BY seed, node""")
def reach_from_each_entry(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").selectExpr("s_suppkey div 10 * 10 + 1 AS node")
    return closures.reach_from_each(_view(spark, sf_dir, EDGES, "lineitem"), seeds, hops=2)


_TEMPLATES = "SELECT DISTINCT 't' || (l_suppkey % 60) AS src, 't' || (l_suppkey % 60 + 1 + l_linenumber % 5) AS dst FROM {t}"


@query(f"""WITH RECURSIVE e AS ({_TEMPLATES.format(t='lineitem')}), r(node) AS (SELECT dst FROM e WHERE src = 't40' UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r""")
def template_descendants(spark, sf_dir):
    return closures.descendants(_view(spark, sf_dir, _TEMPLATES, "lineitem"), "t40").select("node")


_INCLUDES = "SELECT DISTINCT CASE WHEN n_nationkey = 0 THEN 'root' ELSE 'u' || (n_nationkey // 3) END AS parent, 'u' || n_nationkey AS child, n_name || '/' AS prefix, n_nationkey AS ord FROM nation"


@query(f"""WITH RECURSIVE i AS ({_INCLUDES}), r(module, prefix) AS (SELECT 'root', '' UNION ALL SELECT i.child, r.prefix || i.prefix FROM r JOIN i ON i.parent = r.module) SELECT module, prefix FROM r""")
def url_prefixes(spark, sf_dir):
    i = table(spark, sf_dir, "nation").selectExpr("CASE WHEN n_nationkey = 0 THEN 'root' ELSE 'u' || (n_nationkey div 3) END AS parent", "'u' || n_nationkey AS child", "n_name || '/' AS prefix", "n_nationkey AS ord")
    return closures.composed_prefixes(i).select("module", "prefix")


_REFS = "SELECT 'p' || page_id AS file, CAST(page_id AS INT) AS line, '/' || split_part(split_part(url, '://', 2), '/', 2) || '/' || split_part(split_part(split_part(url, '://', 2), '/', 3), '#', 1) AS ref FROM {t}"
_ROUTES = """SELECT 0 AS ord, '/en/<int:id>' AS full, 'views.en' AS handler UNION ALL SELECT 1, '/fr/<int:id>/more', 'views.more' UNION ALL SELECT 2, '/de/7', 'views.seven' UNION ALL SELECT 3, '/de/<slug>', 'views.de' UNION ALL SELECT 4, '/es/<int:id>/', 'views.es'"""


@query(f"""WITH r AS ({_REFS.format(t='pages')}), q AS (SELECT *, split_part(ref, '?', 1) AS u FROM r),
m AS (SELECT *, CASE WHEN u = '/de/7' THEN 2 WHEN u LIKE '/en/%' AND length(u) > 4 AND instr(substr(u, 5), '/') = 0 THEN 0 WHEN u LIKE '/de/%' AND length(u) > 4 AND instr(substr(u, 5), '/') = 0 THEN 3
  WHEN u IN ('/en/', '/en') THEN 0 WHEN u IN ('/fr/', '/fr') THEN 1 WHEN u IN ('/de/', '/de') THEN 3 WHEN u IN ('/es/', '/es') THEN 4 END AS ord FROM q)
SELECT file, line, ref, CASE ord WHEN 0 THEN 'views.en' WHEN 1 THEN 'views.more' WHEN 2 THEN 'views.seven' WHEN 3 THEN 'views.de' WHEN 4 THEN 'views.es' END AS handler FROM m""")
def url_matches(spark, sf_dir):
    refs, table_ = _view(spark, sf_dir, _REFS, "pages"), spark.sql(_ROUTES)
    matched, unresolved = routes.match_urls(refs, table_)
    missed = refs.join(unresolved.select("file", "ref"), ["file", "ref"], "left_semi").select("file", "line", "ref", F.lit(None).cast("string").alias("handler"))
    return matched.select("file", "line", "ref", "handler").unionByName(missed)


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"\\r\\n]{1,500})"', 1)) AS ref FROM pages)
SELECT ref, count(*) AS n FROM l WHERE length(ref) BETWEEN 3 AND 500 AND instr(ref, '/') > 0 AND NOT regexp_matches(ref, '\\s') AND NOT regexp_matches(ref, '^(?:@|\\.|//|http://|https://|www\\.)') AND (starts_with(ref, '/') OR ends_with(ref, '/'))
AND NOT regexp_matches(lower(ref), '^(?:application|text|image|audio|video|multipart|font)/') AND NOT regexp_matches(lower(ref), '\\.(?:js|ts|json|css|svg|png|jpg|jpeg|gif|ico|woff|woff2|map|html)$') GROUP BY ref""")
def url_like_literals(spark, sf_dir):
    refs = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"\\r\\n]{1,500})"'), F.lit(1))).alias("ref"))
    return refs.filter(urls.is_url_like(F.col("ref"))).groupBy("ref").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT 't' || page_id AS file, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'route_' || (page_id % 40) END AS name FROM pages), t AS (SELECT 'route_' || (n_nationkey % 20) AS name, n_nationkey AS ord, n_name AS full FROM nation),
l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord DESC) = 1)
SELECT r.file, r.name, l.full, CASE WHEN l.full IS NOT NULL THEN NULL WHEN r.name IS NULL THEN 'dynamic-ref' ELSE 'unknown-url' END AS reason FROM r LEFT JOIN l ON r.name = l.name""")
def template_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "pages").selectExpr("'t' || page_id AS file", "CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'route_' || (page_id % 40) END AS name")
    named = table(spark, sf_dir, "nation").selectExpr("'route_' || (n_nationkey % 20) AS name", "n_nationkey AS ord", "n_name AS full", "'h' AS handler")
    matched, missed = routes.match_template_refs(refs, named)
    return matched.select("file", "name", "full", F.lit(None).cast("string").alias("reason")).union(missed.select("file", F.col("ref").alias("name"), F.lit(None).cast("string"), "reason"))


@query("""WITH a AS (SELECT DISTINCT 'page' || p_size AS file, 'js/f' || (p_partkey % 90) || '.js' AS asset FROM part), c AS (SELECT 'static/app' || (s_suppkey % 4) || '/js/f' || s_suppkey || '.js' AS path FROM supplier)
SELECT file, asset, path FROM a JOIN c ON path = asset OR ends_with(path, '/' || asset)""")
def asset_matches(spark, sf_dir):
    refs = table(spark, sf_dir, "part").selectExpr("'page' || p_size AS file", "'js/f' || (p_partkey % 90) || '.js' AS asset").distinct()
    changed = table(spark, sf_dir, "supplier").selectExpr("'static/app' || (s_suppkey % 4) || '/js/f' || s_suppkey || '.js' AS path")
    return routes.match_assets(refs, changed).select("file", "asset", "path")


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier), g AS (SELECT 'src/d' || (k % 7) || '/m' || k || '.ts' AS path, CASE k % 3 WHEN 0 THEN './m' || (k + 7) WHEN 1 THEN '../d' || ((k + 1) % 7) || '/m' || (k + 1) || '?x' ELSE '../../../out' END AS specifier, CASE k % 3 WHEN 0 THEN 'src/d' || (k % 7) || '/m' || (k + 7) WHEN 1 THEN 'src/d' || ((k + 1) % 7) || '/m' || (k + 1) END AS base FROM s),
f AS (SELECT path FROM g)
SELECT g.path AS src, f.path AS dst FROM g JOIN f ON f.path = g.base || '.ts'""")
def import_edges(spark, sf_dir):
    g = table(spark, sf_dir, "supplier").selectExpr("'src/d' || (s_suppkey % 7) || '/m' || s_suppkey || '.ts' AS path", "CASE s_suppkey % 3 WHEN 0 THEN './m' || (s_suppkey + 7) WHEN 1 THEN '../d' || ((s_suppkey + 1) % 7) || '/m' || (s_suppkey + 1) || '?x' ELSE '../../../out' END AS specifier")
    return routes.import_edges(g, g.select("path"))


@query("""WITH c AS (SELECT 'f' || (p_partkey // 12) AS file, 'N' || CASE WHEN p_partkey % 12 < 10 THEN p_partkey % 12 ELSE 3 END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'N' || (p_partkey % 5) END AS prefix, p_brand AS literal FROM part),
o AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY file, name) = 1), p AS (SELECT file, name, literal AS value FROM o WHERE prefix IS NULL)
SELECT * FROM p UNION ALL SELECT o.file, o.name, p.value || o.literal FROM o JOIN p ON o.file = p.file AND o.prefix = p.name""")
def constants(spark, sf_dir):
    c = table(spark, sf_dir, "part").selectExpr("'f' || (p_partkey div 12) AS file", "'N' || CASE WHEN p_partkey % 12 < 10 THEN p_partkey % 12 ELSE 3 END AS name", "CASE WHEN p_partkey % 3 = 0 THEN 'N' || (p_partkey % 5) END AS prefix", "p_brand AS literal")
    return routes.resolve_constants(c)


@query("""WITH c AS (SELECT DISTINCT p_brand AS g, p_type AS k, 'c' || (p_size % 12) AS child FROM part), n AS (SELECT g, k, count(DISTINCT child) AS n FROM c GROUP BY ALL)
SELECT c.g, c.k, c.child, NULL::VARCHAR AS related FROM c JOIN n USING (g, k) WHERE n <= 8 UNION ALL SELECT c.g, c.k, min(child), string_agg(child, ',' ORDER BY child) FROM c JOIN n USING (g, k) WHERE n > 8 GROUP BY c.g, c.k""")
def rolled_up_children(spark, sf_dir):
    c = table(spark, sf_dir, "part").selectExpr("p_brand AS g", "p_type AS k", "'c' || (p_size % 12) AS child")
    return scoring.rolled_up(c, ["g", "k"]).select("g", "k", "child", F.array_join("related", ",").alias("related"))


_REASON = "CASE event_id % 6 WHEN 0 THEN 'dynamic-ref' WHEN 1 THEN 'a Dynamic include' WHEN 2 THEN 'no importer found' WHEN 3 THEN 'unsupported file' WHEN 4 THEN NULL ELSE 'other' END"


@query(f"""WITH r AS (SELECT {_REASON} AS reason FROM events) SELECT CASE WHEN lower(reason) LIKE '%dynamic%' THEN 'dynamic-ref' WHEN reason = 'unsupported file' THEN 'binary/unsupported' WHEN reason = 'no importer found' THEN 'no-import-chain' ELSE 'unknown-url' END AS reason, count(*) AS n FROM r GROUP BY 1""")
def unresolved_counts(spark, sf_dir):
    return scoring.unresolved_counts(table(spark, sf_dir, "events").selectExpr(f"{_REASON} AS reason"))


@query("""SELECT event_id, round(0.4::DOUBLE * CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + 0.3::DOUBLE * least(greatest(value / 100, 0), 1) + 0.2::DOUBLE * (user_id % 2) + 0.1::DOUBLE * least(greatest(value / 10 - 1, 0), 1), 6) AS risk FROM events""")
def risk_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("severity", F.when(F.col("event_type") == "click", "High").when(F.col("event_type") == "view", "Medium").otherwise("Low"))
    return e.select("event_id", F.round(text.risk(F.col("severity"), F.col("value") / 100, F.col("user_id") % 2, F.col("value") / 10 - 1), 6).alias("risk"))


@query("""SELECT round(count(*) FILTER (value > 50) / count(*), 3) AS hit_rate FROM events""")
def cache_hit_rate(spark, sf_dir):
    return scoring.hit_rate(table(spark, sf_dir, "events").select((F.col("value") > 50).alias("hit")))


_PATHS = """SELECT CASE p_partkey % 9 WHEN 0 THEN 'app/pkg/__init__.py' WHEN 1 THEN 'tests/test_m' || p_size || '.py' WHEN 2 THEN 'web/templates/base/t' || p_size || '.html' WHEN 3 THEN 'static/vendor/x' || p_size || '.js' WHEN 4 THEN 'a/jquery-' || p_size || '.min.js'
 WHEN 5 THEN 'db/migrations/00' || p_size || '.py' WHEN 6 THEN '.gitignore' WHEN 7 THEN 'cfg/tsconfig.' || p_size || '.json' ELSE 'img/I' || p_size || '.PNG' END AS path FROM {t}"""


@query(f"""WITH p AS (SELECT DISTINCT path FROM ({_PATHS.format(t='part')}))
SELECT path, CASE WHEN path LIKE '%.PNG' THEN 'png' WHEN path = '.gitignore' THEN '' ELSE split_part(path, '.', -1) END AS ext,
       replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '/__init__$', ''), '/', '.') AS module, CASE WHEN path LIKE 'web/templates/%' THEN substr(path, 15) END AS template_name,
       path LIKE '%/vendor/%' OR path LIKE '%.min.js' AS vendor, path NOT LIKE '%.min.%' AS graph_file, path LIKE 'tests/%' AS test, path LIKE '%migrations/%' AS infra, path LIKE '%tsconfig.%' AS jsonc,
       CASE WHEN path LIKE 'tests/%' THEN NULL WHEN path = '.gitignore' THEN NULL ELSE 'tests/test_' || regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') || '.py' END AS test_path,
       path LIKE '%/migrations/%' AS ignored FROM p""")
def path_functions(spark, sf_dir):
    p = F.col("path")
    d = _view(spark, sf_dir, _PATHS, "part").distinct()
    return d.select(
        "path", paths.extension(p).alias("ext"), paths.module_of(p).alias("module"), paths.template_name_of(p).alias("template_name"), paths.is_vendor(p).alias("vendor"), paths.is_graph_file(p).alias("graph_file"), paths.is_test_path(p).alias("test"),
        paths.is_migration_or_infra(p).alias("infra"), paths.is_jsonc(p).alias("jsonc"), paths.test_path_of(p).alias("test_path"), paths.matches_glob(p, paths.DEFAULT_IGNORES).alias("ignored"))


# --- file contents: documents with faults by doc_id ---
_FILES = """SELECT 'd/' || doc_id || '.txt' AS path, CASE doc_id % 6 WHEN 0 THEN replace(t, ' ', chr(13) || chr(10)) WHEN 1 THEN replace(t, chr(10), '  ' || chr(10)) || chr(10) || chr(10) WHEN 2 THEN t || chr(10)
 WHEN 3 THEN '<<<<<<< a' || chr(10) || t || chr(10) || '=======' || chr(10) || '========' WHEN 4 THEN t || '-----BEGIN RSA PRIVATE KEY-----' ELSE t END AS body, doc_id FROM (SELECT doc_id, coalesce(text, '') AS t FROM {t})"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _view(spark, sf_dir, _FILES, "documents")
    return f.select("path", F.encode("body", "UTF-8").alias("content"), F.octet_length("body").cast("long").alias("length"), F.lit(True).alias("tracked"))


@query(f"""WITH f AS ({_FILES.format(t='documents')}), b AS (SELECT path, body, rtrim(body, chr(10)) AS strip, rtrim(array_to_string([rtrim(x, ' ' || chr(9)) FOR x IN string_split(body, chr(10))], chr(10)), chr(10)) AS clean FROM f)
SELECT 'hygiene/mixed-line-ending' AS check_id, path, md5(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content FROM b WHERE instr(body, chr(13)) > 0
UNION ALL SELECT 'hygiene/end-of-file-fixer', path, md5(strip || chr(10)) FROM b WHERE body <> '' AND length(body) - length(strip) <> 1
UNION ALL SELECT 'hygiene/trailing-whitespace', path, md5(CASE WHEN clean = '' THEN '' ELSE clean || chr(10) END) FROM b WHERE clean <> body AND body <> CASE WHEN clean = '' THEN '' ELSE clean || chr(10) END""")
def hygiene_fixes(spark, sf_dir):
    f = _files(spark, sf_dir)
    out = checks.fixed(f, "hygiene/mixed-line-ending").unionByName(checks.fixed(f, "hygiene/end-of-file-fixer")).unionByName(checks.fixed(f, "hygiene/trailing-whitespace"))
    return out.select("check_id", "path", F.md5("content").alias("content"))


@query(f"""WITH f AS ({_FILES.format(t='documents')}), l AS (SELECT path, unnest(string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS t, generate_subscripts(string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS line FROM f)
SELECT path, line::INT AS line FROM l WHERE t = '=======' OR starts_with(t, '<<<<<<< ') OR starts_with(t, '>>>>>>> ')""")
def merge_conflicts(spark, sf_dir):
    return checks.merge_conflicts(_files(spark, sf_dir)).select("path", "line")


@query(f"""WITH f AS ({_FILES.format(t='documents')}) SELECT 'repo/private-key' AS check_id, path FROM f WHERE instr(body, '-----BEGIN RSA PRIVATE KEY-----') > 0
UNION ALL SELECT 'repo/large-files', path FROM f WHERE strlen(body) > 8 * 1024""")
def repository_checks(spark, sf_dir):
    f = _files(spark, sf_dir)
    return checks.private_keys(f).unionByName(checks.large_files(f, 8)).select("check_id", "path")


_CASED = "SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END || '/' || p_size AS path FROM {t}"


@query(f"""WITH p AS ({_CASED.format(t='part')}) SELECT a.path, 'differs by case only from ' || min(b.path) AS message FROM p a JOIN p b ON lower(a.path) = lower(b.path) AND a.path <> b.path GROUP BY a.path""")
def case_conflicts(spark, sf_dir):
    p = _view(spark, sf_dir, _CASED, "part")
    return checks.case_conflicts(p, p).select("path", "message")


_JSON = "SELECT 'e/' || event_id || '.json' AS path, coalesce(CASE WHEN event_id % 3 = 0 THEN substr(props, 1, 5) ELSE props END, '') AS body FROM {t}"


@query(f"WITH f AS ({_JSON.format(t='events')}) SELECT path FROM f WHERE trim(body) <> '' AND NOT json_valid(body)")
def json_syntax(spark, sf_dir):
    f = _view(spark, sf_dir, _JSON, "events").select("path", F.encode("body", "UTF-8").alias("content"))
    return checks.json_syntax(f).select("path")


_MESSAGES = "SELECT 'app/m' || l_suppkey || '.py' AS path, CAST(l_linenumber AS INT) AS line, CAST(l_partkey % 50 AS INT) AS `column`, 'E' || (l_orderkey % 20) AS code, l_orderkey FROM {t}"
_M = _MESSAGES.format(t="lineitem").replace("`column`", '"column"')


@query(f"""WITH m AS ({_M}), b AS (SELECT DISTINCT 'm' || s_suppkey || '.py' AS path, '1:' || (s_suppkey % 50) || ':E' || (s_suppkey % 20) AS key FROM supplier),
s AS (SELECT 'app/m' || s_suppkey || '.py' AS path, CASE s_suppkey % 3 WHEN 0 THEN 'lines' WHEN 1 THEN 'all' ELSE 'none' END AS scope_mode FROM supplier), l AS (SELECT DISTINCT 'app/m' || s_suppkey || '.py' AS path, 1 + s_suppkey % 4 AS line FROM supplier)
SELECT m.path, m.line, m."column", m.code, count(*) AS n FROM m JOIN s USING (path) WHERE (scope_mode = 'all' OR (scope_mode = 'lines' AND EXISTS (SELECT 1 FROM l WHERE l.path = m.path AND l.line = m.line)))
AND NOT EXISTS (SELECT 1 FROM b WHERE b.key = m.line || ':' || m."column" || ':' || m.code AND (m.path = b.path OR ends_with(m.path, '/' || b.path))) GROUP BY ALL""")
def linter_findings(spark, sf_dir):
    m = _view(spark, sf_dir, _MESSAGES, "lineitem")
    s = table(spark, sf_dir, "supplier")
    scope = s.selectExpr("'app/m' || s_suppkey || '.py' AS path", "CASE s_suppkey % 3 WHEN 0 THEN 'lines' WHEN 1 THEN 'all' ELSE 'none' END AS scope_mode")
    lines = s.selectExpr("'app/m' || s_suppkey || '.py' AS path", "CAST(1 + s_suppkey % 4 AS INT) AS line")
    baseline = s.selectExpr("'m' || s_suppkey || '.py' AS path", "'1:' || (s_suppkey % 50) || ':E' || (s_suppkey % 20) AS key")
    return checks.not_in_baseline(checks.on_changed_lines(m, scope, lines), baseline).groupBy("path", "line", "column", "code").agg(F.count(F.lit(1)).alias("n"))


_CHANGES = "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'tests/test_x' || o_custkey || '.py' WHEN 1 THEN 'app/migrations/' || o_custkey || '.py' ELSE 'app/m' || o_custkey || '.py' END AS path, CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'M' ELSE 'A' END AS status, 'pkg.b' || (o_custkey % 60) AS module, o_orderkey % 7 = 0 AS signature_changed FROM {t}"
_RATIOS = "SELECT 'tests/test_x' || c_custkey || '.py' AS path, (c_custkey % 5) / 4.0 AS removed_ratio FROM {t}"


@query(f"""WITH c AS ({_CHANGES.format(t='orders')}), q AS ({_RATIOS.format(t='customer')}), d AS (SELECT 'pkg.b' || (p_partkey % 25) AS module, min('sym_' || p_partkey) AS symbol FROM part GROUP BY 1),
j AS (SELECT path, status, symbol, path LIKE 'tests/%' AND (status = 'D' OR coalesce(removed_ratio, 0) > 0.5) AS lost, signature_changed FROM c LEFT JOIN d USING (module) LEFT JOIN q USING (path))
SELECT path, CASE WHEN lost THEN 'deleted-test' WHEN symbol IS NOT NULL THEN 'removed-export' WHEN signature_changed THEN 'signature-changed' ELSE 'migration-infra' END AS rule, symbol FROM j
WHERE status <> 'A' AND (lost OR symbol IS NOT NULL OR signature_changed OR path LIKE '%migrations/%')""")
def breaking_changes(spark, sf_dir):
    none = F.lit(None).cast("string")
    c = _view(spark, sf_dir, _CHANGES, "orders").withColumn("old_path", none).withColumn("old_module", none)
    return scoring.breaking(c, _view(spark, sf_dir, _RATIOS, "customer"), table(spark, sf_dir, "part").selectExpr("'pkg.b' || (p_partkey % 25) AS module", "'sym_' || p_partkey AS name"))


@query(f"""WITH r AS ({_REFS.format(t='pages')}), n AS (SELECT unnest(['en', 'de']) AS needle) SELECT DISTINCT file FROM r WHERE EXISTS (SELECT 1 FROM n WHERE instr(ref, needle) > 0)""")
def needle_files(spark, sf_dir):
    files = _view(spark, sf_dir, _REFS, "pages").select(F.col("file").alias("path"), F.col("ref").alias("text"))
    leads = spark.sql("SELECT '^en/<int:id>/$' AS full UNION ALL SELECT 'de/{slug}' UNION ALL SELECT '<x>'")
    return scope.with_needles(files, leads).select(F.col("path").alias("file")).distinct()


@query(f"""WITH u AS ({U}) SELECT path, name, kind, line, arg_min(coalesce(base, '-'), seq) AS base FROM u GROUP BY ALL""")
def first_bases(spark, sf_dir):
    u = _view(spark, sf_dir, USAGES, "lineitem").withColumn("base", F.coalesce("base", F.lit("-")))
    return scope.first_bases(u)


@query("""WITH f AS (SELECT 'app/m' || s_suppkey || '.py' AS path, s_suppkey % 4 <> 0 AS tracked FROM supplier), l AS (SELECT DISTINCT 'app/m' || (s_suppkey * 6 % 100) || '.py' AS path FROM supplier)
SELECT path, CASE WHEN NOT tracked THEN 'all' WHEN path IN (SELECT path FROM l) THEN 'lines' ELSE 'none' END AS scope_mode FROM f""")
def scope_modes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    files = s.selectExpr("'app/m' || s_suppkey || '.py' AS path", "s_suppkey % 4 <> 0 AS tracked")
    return scope.scope_modes(files, s.selectExpr("'app/m' || (s_suppkey * 6 % 100) || '.py' AS path"))


@query("""SELECT n_name AS url, arg_min(n_nationkey, n_nationkey) AS handler FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'a' || (n_nationkey % 6) ELSE 'b' || (n_nationkey % 5) END AS n_name, n_nationkey FROM nation) GROUP BY 1""")
def endpoint_rows(spark, sf_dir):
    r = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS ord", "CASE WHEN n_nationkey % 2 = 0 THEN 'a' || (n_nationkey % 6) ELSE 'b' || (n_nationkey % 5) END AS full", "n_nationkey AS handler", "n_name AS name", "'m' AS module")
    return scope.endpoints(r).select("url", "handler")


# --- sources written from table rows: every file of a table is read by the extractors, and SQL states what they must find ---
_Q, _N = "chr(39)", "chr(10)"


def _braced(sql: str) -> str:
    """SQL whose texts have braces, which both formatting steps would read, in the place of « and »."""
    return sql.replace("«", "' || chr(123) || '").replace("»", "' || chr(125) || '")


def _texts(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return _view(spark, sf_dir, sql, name).select("path", "text")


_CALL_FILES = _braced(f"""SELECT 'src/c' || c_custkey || '.ts' AS path, 'const API = ' || {_Q} || '/api/' || c_nationkey || '/' || {_Q} || ';' || {_N} || '// http.get(' || {_Q} || '/no/' || {_Q} || ')' || {_N}
 || 'this.http.' || CASE WHEN c_custkey % 2 = 0 THEN 'get' ELSE 'put' END || '(' || {_Q} || '/c/' || c_custkey || '/' || {_Q} || ');' || {_N} || 'fetch(base + ' || {_Q} || '/n/' || c_nationkey || '/' || {_Q} || ', « method: ' || {_Q} || 'DELETE' || {_Q} || ' »);' || {_N} || 'axios.post(API);' AS text, c_custkey, c_nationkey FROM {{t}}""")


@query("""SELECT 'src/c' || c_custkey || '.ts' AS file, line, method, ref FROM customer, LATERAL (VALUES (3, CASE WHEN c_custkey % 2 = 0 THEN 'get' ELSE 'put' END, '/c/' || c_custkey || '/'), (4, 'delete', '/n/' || c_nationkey || '/'), (5, 'post', '/api/' || c_nationkey || '/')) AS v(line, method, ref)""")
def frontend_calls(spark, sf_dir):
    return extract.frontend_calls(_texts(spark, sf_dir, _CALL_FILES, "customer"))


@query("""WITH v AS (SELECT 'src/c' || c_custkey || '.ts' AS file, line, method, ref FROM customer, LATERAL (VALUES (3, CASE WHEN c_custkey % 2 = 0 THEN 'get' ELSE 'put' END, '/c/' || c_custkey || '/'), (4, 'delete', '/n/' || c_nationkey || '/'), (5, 'post', '/api/' || c_nationkey || '/')) AS v(line, method, ref))
SELECT row_number() OVER (ORDER BY first, method, ref) AS ord, method, ref FROM (SELECT method, ref, min(file || ' ' || line) AS first FROM v GROUP BY method, ref)""")
def call_pairs(spark, sf_dir):
    return extract.call_pairs(_texts(spark, sf_dir, _CALL_FILES, "customer"))


_SCRIPT_FILES = _braced(f"""SELECT 'src/s' || p_partkey || CASE WHEN p_partkey % 9 = 0 THEN '.min.js' ELSE '.ts' END AS path, 'import « A' || p_size || ', B as b, type T » from ' || {_Q} || './m' || (p_partkey % 7) || {_Q} || ';' || {_N} || 'import ' || {_Q} || 'react' || {_Q} || ';' || {_N}
 || 'const R' || p_size || ' = require(' || {_Q} || '../r' || {_Q} || ');' || {_N} || 'const s = ' || {_Q} || 'export const no = 1' || {_Q} || ';' || {_N} || 'export const V' || p_partkey || ' = 1;' || {_N} || 'export «' || {_N} || '  x as Y' || p_size || ',' || {_N} || '  b' || {_N} || '»;' AS text, p_partkey, p_size FROM {{t}}""")
_SCRIPT_PATH = "'src/s' || p_partkey || CASE WHEN p_partkey % 9 = 0 THEN '.min.js' ELSE '.ts' END"


@query(f"""SELECT {_SCRIPT_PATH} AS path, seq, specifier FROM part, LATERAL (VALUES (0, './m' || (p_partkey % 7)), (1, '../r')) AS v(seq, specifier) WHERE p_partkey % 9 <> 0""")
def script_imports(spark, sf_dir):
    return extract.script_imports(_texts(spark, sf_dir, _SCRIPT_FILES, "part"))


@query(f"""SELECT {_SCRIPT_PATH} AS path, name, line FROM part, LATERAL (VALUES ('V' || p_partkey, 5), ('Y' || p_size, 7), ('b', 8)) AS v(name, line)""")
def script_exports(spark, sf_dir):
    return extract.script_exports(_texts(spark, sf_dir, _SCRIPT_FILES, "part"))


@query(f"""SELECT {_SCRIPT_PATH} AS file, name, line, kind FROM part, LATERAL (VALUES ('A' || p_size, 1, 'import'), ('B', 1, 'import'), ('T', 1, 'import'), ('R' || p_size, 3, 'import'), ('V' || p_partkey, 5, 'export'), ('Y' || p_size, 7, 'export'), ('b', 8, 'export')) AS v(name, line, kind)""")
def script_symbols(spark, sf_dir):
    return extract.script_symbols(_texts(spark, sf_dir, _SCRIPT_FILES, "part"))


_TEMPLATE_FILES = _braced(f"""SELECT 'web/templates/t' || p_partkey || '.html' AS path, '«% extends ' || {_Q} || 'base' || (p_size % 5) || '.html' || {_Q} || ' %»«% include "nav' || p_size || '.html" %»<!-- «% include "old.html" %» -->' || CASE WHEN p_partkey % 2 = 0 THEN '«% include page.body %»' ELSE '' END
 || '<script defer src="«« MEDIA_URL »»js/a' || p_partkey || '.js?v=2"></script><link rel=x href=' || {_Q} || '/c.css' || {_Q} || '>«% static ' || {_Q} || 'd.png' || {_Q} || ' %»«% url ' || {_Q} || 'r' || p_size || {_Q} || ' %»«% url ' || {_Q} || 'with' || {_Q} || ' arg %»«% url view_name %»' AS text, p_partkey, p_size FROM {{t}}""")


@query("""SELECT 'web/templates/t' || p_partkey || '.html' AS path, 't' || p_partkey || '.html' AS template_name, 'base' || (p_size % 5) || '.html' AS extends, 'nav' || p_size || '.html' AS includes, 'c.css,d.png,js/a' || p_partkey || '.js' AS assets, p_partkey % 2 = 0 AS dynamic_include FROM part""")
def template_graph(spark, sf_dir):
    g = extract.template_graph(_texts(spark, sf_dir, _TEMPLATE_FILES, "part"))
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return g.select("path", "template_name", joined("extends"), joined("includes"), joined("assets"), "dynamic_include")


@query("""SELECT 'web/templates/t' || p_partkey || '.html' AS file, name FROM part, LATERAL (VALUES ('r' || p_size), (NULL)) AS v(name) WHERE name IS NULL OR p_size <= 25""")
def url_tags(spark, sf_dir):
    names = spark.range(1, 26).selectExpr("'r' || id AS name")
    return extract.url_tags(_texts(spark, sf_dir, _TEMPLATE_FILES, "part"), names)


_PYTHON_FILES = f"""SELECT 'app/c' || c_custkey || '.py' AS path, 'from pkg.b' || c_nationkey || ' import thing as t' || {_N} || 'LIMIT = 3' || {_N} || 'class C' || c_custkey || ':' || {_N} || '    field = 1' || {_N} || '    def run(self):' || {_N} || '        return t(LIMIT, key="v")' || {_N}
 || 'try:' || {_N} || '    pass' || {_N} || 'except ValueError:' || {_N} || '    def fallback(): ...' || {_N} || 'def outer():' || {_N} || '    def inner(): ...' || {_N} || '    class Local:' || {_N} || '        def method(self): return helper(' || c_nationkey || ')' || {_N}
 || CASE WHEN c_custkey % 10 = 0 THEN 'def broken(' ELSE '' END AS text, c_custkey, c_nationkey FROM {{t}}"""


@query("""SELECT 'app/c' || c_custkey || '.py' AS path, name, kind, line, end_line, qname FROM customer, LATERAL (VALUES ('LIMIT', 'module_field', 2, 2, 'LIMIT'), ('C' || c_custkey, 'class', 3, 6, 'C' || c_custkey), ('field', 'class_field', 4, 4, 'C' || c_custkey || '.field'), ('run', 'method', 5, 6, 'C' || c_custkey || '.run'),
 ('fallback', 'function', 10, 10, 'fallback'), ('outer', 'function', 11, 14, 'outer'), ('Local', 'class', 13, 14, 'outer.Local'), ('method', 'method', 14, 14, 'outer.Local.method')) AS v(name, kind, line, end_line, qname) WHERE c_custkey % 10 <> 0""")
def diff_entities(spark, sf_dir):
    return extract.diff_entities(_texts(spark, sf_dir, _PYTHON_FILES, "customer"))


@query("""SELECT 'app/c' || c_custkey || '.py' AS path, line, name, kind, ctx_qname, base, module FROM customer, LATERAL (VALUES (1, 'thing', 'import', '', NULL, 'pkg.b' || c_nationkey), (6, 't', 'name', 'C' || c_custkey || '.run', NULL, NULL), (6, 'LIMIT', 'name', 'C' || c_custkey || '.run', NULL, NULL), (6, 'v', 'str', 'C' || c_custkey || '.run', NULL, NULL),
 (9, 'ValueError', 'name', '', NULL, NULL), (14, 'helper', 'name', 'outer.Local.method', NULL, NULL)) AS v(line, name, kind, ctx_qname, base, module) WHERE c_custkey % 10 <> 0""")
def python_usages(spark, sf_dir):
    return extract.python_usages(_texts(spark, sf_dir, _PYTHON_FILES, "customer")).select("path", "line", "name", "kind", "ctx_qname", "base", "module")


@query("""SELECT 'syntax/ast-syntax' AS check_id, 'app/c' || c_custkey || '.py' AS path FROM customer WHERE c_custkey % 10 = 0""")
def python_syntax(spark, sf_dir):
    files = _texts(spark, sf_dir, _PYTHON_FILES, "customer").select("path", F.encode("text", "UTF-8").alias("content"))
    return checks.python_syntax(files).select("check_id", "path")


_URL_FILES = f"""SELECT 'u' || n_nationkey || '.py' AS path, 'urlpatterns = [path(' || {_Q} || 'p' || n_nationkey || '/' || {_Q} || ', include(' || {_Q} || 'u' || (2 * n_nationkey + 1) || {_Q} || ')), re_path(r' || {_Q} || '^q' || n_nationkey || '/' || {_Q} || ', include(' || {_Q} || 'u' || (2 * n_nationkey + 2) || {_Q} || ')),'
 || ' path(' || {_Q} || '<int:id>/' || {_Q} || ', views.h' || n_nationkey || ', name=' || {_Q} || 'r' || n_nationkey || {_Q} || ')]' AS text FROM {{t}}"""


@query("""WITH RECURSIVE t(k, lead) AS (SELECT min(n_nationkey), '' FROM nation UNION ALL SELECT n.n_nationkey, t.lead || CASE WHEN n.n_nationkey % 2 = 1 THEN 'p' ELSE 'q' END || t.k || '/' FROM t JOIN nation n ON n.n_nationkey IN (2 * t.k + 1, 2 * t.k + 2))
SELECT 'u' || k || '.py' AS module, 'r' || k AS name, 'views.h' || k AS handler, lead || '<int:id>/' AS full FROM t""")
def composed_routes(spark, sf_dir):
    return extract.composed_routes(_texts(spark, sf_dir, _URL_FILES, "nation")).select("module", "name", "handler", "full")


_API_FILES = f"""SELECT 'api/n' || s_suppkey || '.py' AS path, '@router.get(' || {_Q} || '/s/' || s_suppkey || {_Q} || ')' || {_N} || 'async def read' || s_suppkey || '(): ...' || {_N} || '@other.get(' || {_Q} || '/no' || {_Q} || ')' || {_N} || 'def no(): ...' || {_N} || '@app.options(' || {_Q} || '/o' || {_Q} || ', status_code=1)' || {_N} || 'def o(): ...' AS text FROM {{t}}"""


@query("""SELECT 'api/n' || s_suppkey || '.py' AS module, ord, path, handler FROM supplier, LATERAL (VALUES (0, '/s/' || s_suppkey, 'read' || s_suppkey), (1, '/o', 'o')) AS v(ord, path, handler)""")
def fastapi_routes(spark, sf_dir):
    return extract.fastapi_routes(_texts(spark, sf_dir, _API_FILES, "supplier")).select("module", "ord", "path", "handler")


@query("""SELECT CASE WHEN o_orderstatus = 'P' THEN 'new/' ELSE 'f/' END || o_orderkey AS path, CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'M' ELSE 'R100' END AS status, CASE o_orderstatus WHEN 'F' THEN 'f/' || o_orderkey WHEN 'P' THEN 'old/' || o_orderkey END AS old_path FROM orders""")
def name_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'M' ELSE 'R100' END AS s", "CASE WHEN o_orderstatus = 'P' THEN array('old/' || o_orderkey, 'new/' || o_orderkey) ELSE array('f/' || o_orderkey) END AS p")
    tokens = o.select("k", F.posexplode(F.concat(F.array(F.lit("junk")), F.array("s"), F.col("p"))).alias("n", "token"))
    return changes.parse_name_status(tokens.select((F.col("k") * 8 + F.col("n")).alias("pos"), "token")).select("path", "status", "old_path")


_FORMAT = "SELECT 'app/s' || s_suppkey || '.py' AS path, s_suppkey AS k FROM {t}"


@query("""WITH h AS (SELECT 'app/s' || s_suppkey || '.py' AS path, s_suppkey AS k FROM supplier), d AS (SELECT path, k, pos, text, old_line, block FROM h, LATERAL (VALUES (1, '-a' || k, k + 1, 1), (2, '+A' || k, k + 2, 1), (4, '-b', k + 3, 2), (5, '+B', k + 4, 2)) AS v(pos, text, old_line, block))
SELECT path, pos, text FROM d WHERE (block = 1 AND k % 3 IN (0, 2)) OR (block = 2 AND k % 3 = 1)""")
def format_hunks(spark, sf_dir):
    h = _view(spark, sf_dir, _FORMAT, "supplier")
    lines = F.array(F.concat(F.lit("@@ -"), (F.col("k") + 1).cast("string"), F.lit(",3 +"), (F.col("k") + 1).cast("string"), F.lit(",3 @@")), F.concat(F.lit("-a"), F.col("k").cast("string")), F.concat(F.lit("+A"), F.col("k").cast("string")), F.lit(" same"), F.lit("-b"), F.lit("+B"))
    diff = h.select("path", F.posexplode(lines).alias("pos", "text"))
    touched = h.select("path", F.when(F.col("k") % 3 == 0, F.col("k") + 1).when(F.col("k") % 3 == 1, F.col("k") + 3).otherwise(F.col("k") + 2).alias("line"))
    return checks.format_hunks(diff, touched).select("path", "pos", "text")


@query("""WITH h AS (SELECT DISTINCT 'm' || (p_size % 4) || '.f' || (p_partkey % 50) AS handler, 'f' || (p_partkey % 50) AS name, 'm' || (p_size % 4) AS lead FROM part), d AS (SELECT DISTINCT 'f' || s_suppkey % 50 AS name, 'x/m' || (s_suppkey % 3) || '.py' AS path, 'm' || (s_suppkey % 3) AS lead FROM supplier)
SELECT handler, arg_min(path, (CASE WHEN h.lead = d.lead THEN 0 ELSE 1 END) || path) AS path FROM h JOIN d USING (name) GROUP BY handler""")
def handler_definitions(spark, sf_dir):
    h = table(spark, sf_dir, "part").selectExpr("'m' || (p_size % 4) || '.f' || (p_partkey % 50) AS handler")
    return routes.handler_definitions(h, table(spark, sf_dir, "supplier").selectExpr("'f' || s_suppkey % 50 AS name", "'x/m' || (s_suppkey % 3) || '.py' AS path"))


@query("""WITH e AS (SELECT DISTINCT 'lib/m' || (p_partkey % 30) || '.ts' AS path, 'X' || (p_size % 9) AS name FROM part), g AS (SELECT DISTINCT 'src/c' || (c_custkey % 200) || '.ts' AS src, 'lib/m' || (c_custkey % 40) || '.ts' AS dst FROM customer), w AS (SELECT DISTINCT 'src/c' || (c_custkey % 200) || '.ts' AS path, 'X' || (c_nationkey % 11) AS word FROM customer)
SELECT DISTINCT e.name, g.src AS path FROM e JOIN g ON g.dst = e.path JOIN w ON w.path = g.src AND w.word = e.name""")
def export_users(spark, sf_dir):
    e = table(spark, sf_dir, "part").selectExpr("'lib/m' || (p_partkey % 30) || '.ts' AS path", "'X' || (p_size % 9) AS name").distinct()
    c = table(spark, sf_dir, "customer")
    return routes.export_users(e, c.selectExpr("'src/c' || (c_custkey % 200) || '.ts' AS src", "'lib/m' || (c_custkey % 40) || '.ts' AS dst").distinct(), c.selectExpr("'src/c' || (c_custkey % 200) || '.ts' AS path", "'X' || (c_nationkey % 11) AS word"))


@query("""WITH r AS (SELECT DISTINCT 'u' || (p_size % 6) || '.py' AS module, 'v.h' || (p_partkey % 80) || CASE WHEN p_partkey % 2 = 0 THEN '.as_view()' ELSE '' END AS handler, 'h' || (p_partkey % 80) AS name FROM part), b AS (SELECT DISTINCT 'u' || (s_suppkey % 5) || '.py' AS module, 'h' || s_suppkey AS name FROM supplier)
SELECT module, handler FROM r WHERE EXISTS (SELECT 1 FROM b WHERE b.module = r.module AND b.name = r.name)""")
def affected_routes(spark, sf_dir):
    r = table(spark, sf_dir, "part").selectExpr("'u' || (p_size % 6) || '.py' AS module", "'v.h' || (p_partkey % 80) || CASE WHEN p_partkey % 2 = 0 THEN '.as_view()' ELSE '' END AS handler").distinct()
    s = table(spark, sf_dir, "supplier")
    return routes.affected_routes(r, s.selectExpr("'h' || s_suppkey AS node"), s.selectExpr("'u' || (s_suppkey % 5) || '.py' AS path", "'h' || s_suppkey AS name")).select("module", "handler")


_CODE_OWNERS = "*.py @all\n/lib/s1* @x @ones # the last counts\nlib/s2?/** @twenties\nm.txt @text\n"


@query("""SELECT 'lib/s' || s_suppkey || '/m' || CASE WHEN s_suppkey % 2 = 0 THEN '.py' ELSE '.txt' END AS path, CASE WHEN s_suppkey % 2 = 1 THEN 'text' WHEN length(s_suppkey::VARCHAR) = 2 AND s_suppkey::VARCHAR LIKE '2%' THEN 'twenties' WHEN s_suppkey::VARCHAR LIKE '1%' THEN 'ones' ELSE 'all' END AS owner FROM supplier""")
def code_owners(spark, sf_dir):
    from tremor.sources import files

    p = table(spark, sf_dir, "supplier").selectExpr("'lib/s' || s_suppkey || '/m' || CASE WHEN s_suppkey % 2 = 0 THEN '.py' ELSE '.txt' END AS path")
    return routes.owners(p, files.ownership_rules(spark, _CODE_OWNERS))


@query("""WITH RECURSIVE r(k, hop) AS (SELECT 1, 0 UNION ALL SELECT s.s_suppkey, hop + 1 FROM r JOIN supplier s ON s.s_suppkey IN (3 * r.k, 3 * r.k + 1, 3 * r.k - 1) AND s.s_suppkey > r.k WHERE hop < 5) SELECT DISTINCT 'f' || k AS name FROM r""")
def callers(spark, sf_dir):
    """Function f(k) in module m(k) calls the function of a third of its number, which it imports; f1 changed."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "cast((s_suppkey + 1) div 3 AS long) AS of")
    null = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    at = [F.concat(F.lit("m"), F.col("k").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("m"), F.col("k").cast("string")).alias("own_module"), F.concat(F.lit("f"), F.col("of").cast("string")).alias("name")]
    inside = F.concat(F.lit("f"), F.col("k").cast("string")).alias("ctx_qname")
    imports = s.select(*at, F.lit(0).alias("seq"), F.lit(1).alias("line"), F.lit("import").alias("kind"), F.concat(F.lit("m"), F.col("of").cast("string")).alias("module"), F.lit(0).alias("level"), F.lit("").alias("ctx_qname"), *null("string", "alias", "base"), F.lit("module").alias("ctx_kind"))
    uses = s.select(*at, F.lit(1).alias("seq"), F.lit(2).alias("line"), F.lit("name").alias("kind"), *null("string", "module"), *null("int", "level"), inside, *null("string", "alias", "base"), F.lit("function").alias("ctx_kind"))
    return closures.callers(imports.unionByName(uses), spark.sql("SELECT 'f1' AS name, array('m1') AS modules"), nodes=1 << 30).select("name")


@query("""SELECT DISTINCT e.e AS entry, 'f' || k AS name FROM (SELECT s_suppkey AS k0, 'f' || s_suppkey AS e FROM supplier) e, LATERAL (SELECT unnest([(k0 + 1) // 3, ((k0 + 1) // 3 + 1) // 3]) AS k) WHERE k < k0""")
def reachable(spark, sf_dir):
    """What each function reaches within two hops, of functions that call the one of a third of their number."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "cast((s_suppkey + 1) div 3 AS long) AS of")
    text = lambda lead, c, end="": F.concat(F.lit(lead), F.col(c).cast("string"), F.lit(end))
    none = F.lit(None).cast("string")
    both = s.select(text("m", "k", ".py").alias("path"), text("m", "k").alias("own_module"), text("f", "of").alias("name"), text("m", "of").alias("of_module"), text("f", "k").alias("inside"))
    imports = both.select("path", "own_module", "name", F.lit(0).alias("seq"), F.lit(1).alias("line"), F.lit("import").alias("kind"), F.col("of_module").alias("module"), F.lit(0).alias("level"), F.lit("").alias("ctx_qname"), none.alias("alias"), none.alias("base"), F.lit("module").alias("ctx_kind"))
    uses = both.select("path", "own_module", "name", F.lit(1).alias("seq"), F.lit(2).alias("line"), F.lit("name").alias("kind"), none.alias("module"), F.lit(None).cast("int").alias("level"), F.col("inside").alias("ctx_qname"), none.alias("alias"), none.alias("base"), F.lit("function").alias("ctx_kind"))
    defs = both.select("path", F.col("inside").alias("name"), F.lit("function").alias("kind"), F.col("inside").alias("qname"))
    return closures.reachable(imports.unionByName(uses), defs, defs.select("path", "name"), hops=2).select("entry", "name").distinct()


@query("""WITH m AS (SELECT 'src/app/f' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.SCSS' WHEN 2 THEN '.py' ELSE '.html' END AS path, s_suppkey AS k FROM supplier) SELECT path FROM m WHERE k % 4 <> 2 AND NOT (k % 5 = 0 AND k % 3 <> 0)""")
def formatter_scope(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").selectExpr("'src/app/f' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.SCSS' WHEN 2 THEN '.py' ELSE '.html' END AS path", "s_suppkey AS k")
    listed = m.select(F.when(F.col("k") % 5 == 0, F.col("path")).otherwise("-").alias("path"))
    return checks.formatter_scope(m, listed, m.select(F.when(F.col("k") % 3 == 0, F.col("path")).otherwise("--").alias("path"))).select("path")


@query("""SELECT event_id, 'f' || (event_id % 9) || CASE WHEN event_id % 3 = 0 AND event_id % 4 = 0 THEN '' ELSE ':' || CASE WHEN event_id % 3 = 0 THEN '-' ELSE (event_id % 100)::VARCHAR END || ':' || CASE WHEN event_id % 4 = 0 THEN '-' ELSE (event_id % 7)::VARCHAR END END || ': E' || (event_id % 5) || ' ' || event_type AS text,
 CASE WHEN event_id % 2 = 0 THEN event_id % 1000 ELSE event_id % 77 END AS line FROM events""")
def issue_texts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 100)
    column = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 7)
    ref = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("x (name at "), (F.col("event_id") % 1000).cast("string"), F.lit(")"))).otherwise("x")
    said = text.issue_text(F.concat(F.lit("f"), (F.col("event_id") % 9).cast("string")), line, column, F.concat(F.lit("E"), (F.col("event_id") % 5).cast("string")), F.col("event_type"))
    return e.select("event_id", said.alias("text"), text.line_of(ref, F.col("event_id") % 77).cast("long").alias("line"))


@query("""WITH i AS (SELECT 'c' || (l_partkey % 4) AS check_id FROM lineitem UNION ALL SELECT 'repo/private-key' FROM supplier) SELECT check_id, count(*) AS n, check_id IN ('repo/private-key', 'c1') AS blocked FROM i GROUP BY check_id""")
def verdicts(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").selectExpr("'c' || (l_partkey % 4) AS check_id").union(table(spark, sf_dir, "supplier").selectExpr("'repo/private-key'"))
    return checks.verdict(i, ("c1",), strict=True)
