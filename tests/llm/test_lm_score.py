import duckdb
import numpy as np

from tests.llm import data
from tremor.llm import lm_score as op


def test_against_sql(spark, tmp_path):
    docs = data.documents(spark)
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(((a, b, c, None if d is None else round(d, 9)) for a, b, c, d in con.sql(op.OP5_SQL).fetchall()), key=repr)
    got = op.score(docs.repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.log_micro, None if r.mean_log is None else round(r.mean_log, 9)) for r in got), key=repr) == want
    assert op.score(data.documents(spark, [])).count() == 0


def test_chunks_and_parts_do_not_matter(spark, monkeypatch):
    docs = data.documents(spark)
    want = sorted(map(tuple, op.score(docs).collect()), key=repr)
    monkeypatch.setattr(op, "PARTITION", 2_000)
    assert sorted(map(tuple, op.score(docs).collect()), key=repr) == want
    small, large = op.Chunk([b"a b c a b"], 3), op.Chunk([b"a b c a b"], 1 << 15)
    assert sorted(small.counts) == sorted(large.counts) == [1, 1, 1, 1, 1, 1, 2, 2, 2]  # c; bc, ca; abc, bca, cab; a, b; ab


def test_codes():
    rng = np.random.default_rng(4)
    for top in (5, 1 << 20, 1 << 50):
        keys = np.unique(rng.integers(0, top, 300).astype(np.uint64))
        assert (op.read_keys(op.code_keys(keys)) == keys).all()
    counts = rng.integers(1, 1 << 40, 50)
    assert (op.read_counts(op.code_counts(counts)) == counts).all()


def test_slices(monkeypatch):
    text = ("Ab cd\tef " * 200).encode()
    whole = op.word_hashes(text)
    monkeypatch.setattr(op, "SLICE", 7)
    assert (op.word_hashes(text) == whole).all() and len(whole) == 600
