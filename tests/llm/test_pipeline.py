"""Every stage against a brute-force version of it on a small table."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import data
from tests.llm.test_near_dedup import brute_kept

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = corpus_pipeline.COLUMNS


def stored_docs(spark, rows, path):
    data.documents(spark, rows).repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


def key(rows):
    return Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return stored_docs(spark, data.rows(n=150), tmp_path_factory.mktemp("p") / "documents.parquet")


def test_language(spark, docs):
    out = corpus_pipeline.language(spark, docs, "")
    assert tuple(out.columns) == COLUMNS
    kept = {r.doc_id for r in out.collect()}
    for r in docs.collect():
        letters = r.text is not None and any(map(str.isalpha, r.text))
        assert letters or r.doc_id is None or r.doc_id not in kept
        if letters and r.lang and r.doc_id is not None and r.doc_id < 150 and len(r.text) > 20:
            assert r.doc_id in kept


def test_exact(spark, docs):
    got = corpus_pipeline.exact(spark, docs, "").collect()
    groups = defaultdict(list)
    for r in docs.select(*COLUMNS).collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == Counter(min(g)[1:] for g in groups.values())
    assert not key(got) - key(docs.select(*COLUMNS).collect())


def test_near(spark, docs):
    rows = docs.select(*COLUMNS).collect()
    got = corpus_pipeline.near(spark, docs, "").collect()
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == brute_kept([(r.doc_id, r.text) for r in rows])


def test_mixture(spark, docs):
    from tremor.llm import mixing

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text)
    got = Counter()
    for r in corpus_pipeline.mixture(spark, docs, "").collect():
        got[r.doc_id] += len(words(r.text))
        assert any(t is not None and t.startswith(r.text) for t in texts[r.doc_id]) and len(words(r.text)) > 0
    assert got == +taken


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "source_mixing", "packing"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    used = defaultdict(int)
    for r in out:
        used[r.sequence_id] += r.length
    assert out and max(used.values()) <= 2048
    from tremor.llm import packing

    encode = packing.encoder(None)
    whole = {}
    for r in docs.collect():
        if r.text:
            whole.setdefault(r.doc_id, set()).add(encode([r.text])[0] + np.array([1], "<u4").tobytes())
    full = [r for r in out if r.start == 0 and r.length == r.doc_tokens]
    assert full and sum(any(zlib.crc32(b) == r.ids_crc32 for b in whole[r.doc_id]) for r in full) >= len(full) - 4  # but for texts that the mix cuts


def test_stages_number_rows_of_any_input_alike(spark, docs):
    """An input that is no table of files gives other row numbers in another scan, so it is written first."""
    shuffled = docs.repartition(5, "doc_id").withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        want = Counter((r.doc_id is None, r.doc_id or 0) for r in stage(spark, docs, "").collect())
        assert Counter((r.doc_id is None, r.doc_id or 0) for r in stage(spark, shuffled, "").collect()) == want


def test_clashing_columns(spark, docs, tmp_path):
    """Columns that the stages use themselves do no harm in the input of a run."""
    wide = docs.withColumn("__uid", F.lit(1)).withColumn("keep_id", F.lit(2)).withColumn("lang_pred", F.lit("x")).withColumn("slots", F.lit(None).cast("array<long>"))
    wide.write.parquet(str(tmp_path / "documents.parquet"))
    narrow = tmp_path / "narrow"
    docs.select(*COLUMNS).write.parquet(str(narrow / "documents.parquet"))

    def tokens(at):
        out = Counter()
        for r in corpus_pipeline.run(spark, str(at)).collect():
            out[r.doc_id] += r.length
        return out

    assert tokens(tmp_path) == tokens(narrow)


def test_empty(spark, tmp_path):
    empty = stored_docs(spark, [], tmp_path / "documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
