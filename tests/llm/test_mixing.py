import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import data
from tremor.llm import mixing as op


def test_against_sql(spark, tmp_path):
    docs = data.documents(spark)
    docs.select("doc_id", "text", "source").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(con.sql(op.OP3_SQL).fetchall(), key=repr)
    for block in (3, 1024):
        got = op.mix(docs, block=block).select("doc_id", "size", "source_size", "target", "taken").collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
        per = {}
        for r in op.mix(docs, block=block).join(docs.select("doc_id", "source").distinct(), "doc_id").collect():
            assert r["taken"] <= 3 * r["size"]
            per[r["source"]] = r["target"]


def test_limits_and_empty(spark):
    one = [(1, "a b c", None, "a", 0, 1, 0.0, 1, 1), (2, "w " * 900, None, "b", 0, 1, 0.0, 1, 1), (3, None, None, "c", 0, 1, 0.0, 1, 1)]
    got = {r["doc_id"]: (r["size"], r["target"], r["taken"]) for r in op.mix(data.documents(spark, one)).collect()}
    assert got[1] == (3, 9.0, 9) and got[3] == (0, 0.0, 0) and got[2][2] == 894
    assert op.mix(data.documents(spark, [])).count() == 0
    assert op.mix(data.documents(spark, [(3, None, None, "c", 0, 1, 0.0, 1, 1)])).collect()[0]["taken"] == 0


def test_lattice_and_schedule(spark):
    for n in (1, 2, 3, 10, 4096, 99991):
        g, back = op.lattice(n)
        assert math.gcd(g, n) == 1 and g * back % n == 1 % n
    sources = spark.createDataFrame([("a", 0, 100, 150.0, 150), ("b", 1, 50, 70.0, 70)], "source string, ord long, source_size long, target double, want long")
    got = sorted(tuple(r) for r in op.schedule(sources, 10).collect())
    assert [r[0] for r in got] == list(range(22))
    for ord_, n, per, want in ((0, 15, 10, 150), (1, 7, 5, 70)):
        own = [r for r in got if r[1] == ord_]
        assert [r[2] for r in own] == list(range(n)) and all(r[3] == r[2] // per and r[4] == r[2] % per for r in own)
        assert sum(10 if r[5] is None else r[5] for r in own) == want
        share = n / 22
        for k in range(1, 23):  # low discrepancy
            assert abs(sum(r[0] < k for r in own) - k * share) < 2


def test_pipeline_emits_the_mix_in_the_order_of_the_schedule(spark, tmp_path):
    import corpus_pipeline

    # one block a document, so that slots and documents agree: 3 sources by weights 5, 2, 1
    rows = [(k, "w " * 1024, None, "abc"[k % 3], 2048, 1, 0.0, 1, 1) for k in range(240)]
    data.documents(spark, rows).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    mixed = op.mix(docs).collect()
    assert all(len(r["slots"]) >= r["taken"] // 1024 for r in mixed)
    slots = sorted(s for r in mixed for s in r["slots"])
    assert slots == list(range(len(slots)))
    order = {s: r["doc_id"] for r in mixed for s in r["slots"]}
    got = [r.doc_id for r in corpus_pipeline.mixture(spark, docs, "").collect()]
    assert got == [order[s] for s in slots]
    for n in range(1, len(got) + 1):  # every prefix is near the targets
        for j, w in enumerate((5, 2, 1)):
            assert abs(sum(d % 3 == j for d in got[:n]) - n * w / 8) < 3


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Repeated rows and ids, ids with several texts, null ids and rows without words, in five sources, one of them null."""
    rows = data.rows(seed=3, n=400)
    same = [(7, f"{'w ' * (1 + k % 5)}{k % 3}", None, "s0", None, 1, 0.0, 1, 1) for k in range(90)]
    nameless = [(None, f"n {'x ' * (k % 4)}", None, None, None, 1, 0.0, 1, 1) for k in range(60)]
    at = str(tmp_path_factory.mktemp("odd") / "d")
    data.documents(spark, rows + same + nameless).repartition(3).write.parquet(at)
    return spark.read.parquet(at)


@pytest.mark.parametrize(("partitions", "most"), [(2, op.SPANS), (7, op.SPANS), (64, op.SPANS), (7, 0)])
def test_scheduled_rows_against_the_uses_of_the_mix(spark, odd, partitions, most):
    block = 5
    docs = {r["uid"]: r for r in odd.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", "source").collect()}
    want = []
    for r in op.mix(odd.select("doc_id", "text", "source"), block=block).filter("taken > 0").collect():
        lengths = [0] * (r["taken"] // r["size"]) + [r["partial"]] * (r["partial"] > 0)
        d = docs[r["uid"]]
        want += [(r["slots"][k], r["start"], r["uid"], (d["doc_id"], d["text"], d["source"], n)) for k, n in enumerate(lengths)]
    want = [w[3] for w in sorted(want, key=lambda w: w[:3])]
    assert len({w[2] for w in want}) == 5 and len(want) > 600 and any(w[3] for w in want)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = [tuple(r) for r in op.scheduled(odd, ("doc_id", "text", "source"), "use", block=block, most=most).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter(got) == Counter(want)
    assert got == want


def test_pipeline_moves_each_text_once(spark, odd):
    """Of the exchanges of the mixture stage one carries texts: the one to the parts of the schedule."""
    import corpus_pipeline

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # tables of one row a document are not small
    try:
        plan = corpus_pipeline.mixture(spark, odd, "")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

    def exchanges(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if node.nodeName() == "Exchange" and re.search(r"\btext#", node.output().mkString(" ")):
            yield node.simpleString(100)
        for k in range(node.children().size()):
            yield from exchanges(node.children().apply(k))

    found = list(exchanges(plan))
    assert len(found) == 1 and "rangepartitioning(__part" in found[0]
