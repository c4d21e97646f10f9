import hashlib
import re
from collections import Counter

import numpy as np

from tests.llm import data
from tremor.llm import exact_dedup as op


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        text = text or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), doc_id is None, doc_id or 0, doc_id))
    out = Counter()
    for text, members in groups.items():
        for k, m in enumerate(sorted(members, key=lambda m: m[:3])):
            out[(m[3], sorted(members, key=lambda m: m[:3])[0][3], len(members), k == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def test_against_brute_force(spark):
    found = Counter(tuple(r) for r in op.exact_dedup(data.documents(spark)).drop("uid").collect())
    assert found == brute(data.rows())


def test_hot_group_and_empty_table(spark):
    hot = [(k, "same  text" + " " * (k % 5), None, None, None, 1, 0.0, 1, 1) for k in range(500)] + data.rows()
    assert Counter(tuple(r) for r in op.exact_dedup(data.documents(spark, hot)).drop("uid").collect()) == brute(hot)
    assert op.exact_dedup(data.documents(spark, [])).count() == 0


def test_mph_is_minimal_and_checked():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (5000, 4), dtype=np.uint64)
    sizes, bits, slot = op.build_mph(keys)
    assert sorted(slot) == list(range(5000))
    assert (op.probe_mph(sizes, bits, keys) == slot).all()
    assert op.probe_mph(*op.build_mph(keys[:0])[:2], keys).max() == -1


def test_incremental(spark):
    docs = data.documents(spark)
    history = op.winners(op.digested(docs.filter("doc_id < 30")))
    new = {r["text_sha256"] for r in op.unseen(docs, history).collect()}
    old = {hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r[1] or "").encode()).hexdigest() for r in data.rows() if r[0] is not None and r[0] < 30}
    assert new == {h for *_, h in brute(data.rows())} - old
