import random
from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm import data
from tremor.llm import near_dedup as op


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def rows():
    """Texts with copies of one to eight single-word edits, on both sides of similarity 0.8."""
    rng = random.Random(5)
    out = []
    for k in range(60):
        words = data.words(rng, "aa", rng.choice((30, 150, 400))).split()
        out.append((10 * k, " ".join(words)))
        for j in range(1, 4):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.choice((1, 2, 4, 8))):
                copy[at] = f"edit{j}"
            out.append((10 * k + j, " ".join(copy)))
    out += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  b"), (1005, "a b c"), (None, out[0][1]), (None, None)]
    return [(*r, None, "s", 0, 5, 0.5, 9, 3) for r in out]


def brute_kept(texts):
    sets, root = [shingles(t[1]) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or similarity(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    best = {}
    for k, t in enumerate(texts):
        best[find(k)] = min(best.get(find(k), (True, 1 << 62)), (t[0] is None, t[0] or 0))
    return Counter(best.values())


def test_near_copies_against_brute_force(spark, tmp_path):
    data.documents(spark, rows()).repartition(3).write.parquet(str(tmp_path / "d"))
    got = corpus_pipeline.near(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == brute_kept(rows())


def test_bands_hold_pairs_of_least_similarity():
    rng = random.Random(9)
    met = total = 0
    while total < 300:
        a = data.words(rng, "bb", 200).split()
        b = list(a)
        for at in rng.sample(range(200), rng.randint(3, 5)):
            b[at] = "edit"
        a, b = " ".join(a), " ".join(b)
        if 0.8 <= similarity(shingles(a), shingles(b)) < 0.86:
            total += 1
            met += bool((op.band_keys(op.shingle_set(a.encode())) == op.band_keys(op.shingle_set(b.encode()))).any())
    assert met == total


def test_long_texts_are_read_in_slices(monkeypatch):
    text = (" ".join(f"w{k % 90}" for k in range(900)) + " " + "y" * 400).encode()
    whole = op.shingle_set(text)
    monkeypatch.setattr(op.simhash, "SLICE", 64)
    monkeypatch.setattr(op, "SLICE", 7)
    assert (op.shingle_set(text) == whole).all() and len(whole) == len(shingles(text.decode()))
    assert (op.band_keys(whole) == op.band_keys(op.shingle_set(text))).all()


def test_fingerprint_bits_by_majority(monkeypatch):
    """SimHash: a bit is set if it is set in over half of the shingles' hashes."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 300, 1000):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        ones = [[sum(int(x) >> k & 1 for x in op.simhash._mix(h ^ salt)) for k in range(64)] for salt in op._SALT]
        want = [sum(1 << k for k in range(64) if 2 * o[k] > n) for o in ones]
        assert op.fingerprint(h).tolist() == want
        monkeypatch.setattr(op, "SLICE", 7)
        assert op.fingerprint(h).tolist() == want
        monkeypatch.undo()


def test_radius_holds_pairs_of_least_similarity():
    rng = random.Random(12)
    fps, met, total = [], 0, 0
    while total < 300:
        n = rng.choice((5, 12, 60, 200, 700))
        a = data.words(rng, "bb", n).split()
        b = a + ["tail"] if n < 20 else a[:-1] + ["edit"] + ["more"] * (n // 9)
        a, b = " ".join(a), " ".join(b)
        if (n < 20 and len(shingles(a)) >= 4) or 0.8 <= similarity(shingles(a), shingles(b)) < 0.86:
            total += 1
            pair = np.stack([op.fingerprint(op.shingle_set(t.encode())) for t in (a, b)])
            met += len(op.close(pair[:1], pair[1:], op.RADIUS)[0])
            fps.append(pair[0])
    assert met == total
    x, y = op.close(np.stack(fps), np.stack(fps), op.RADIUS)
    assert (x == y).all() and len(x) == total


def test_fingerprints_decide_what_is_compared(spark):
    """Without a radius only equal fingerprints meet, whatever the Jaccard similarity."""
    rows_ = [r for r in rows() if r[0] is None or r[0] < 40 or r[0] >= 1000]
    docs = data.documents(spark, rows_)
    roots = {}
    for r in op.components_of(docs, radius=0).collect():
        roots.setdefault(r.root, []).append(r.doc_id)
    want = {}
    for r in rows_:
        want.setdefault(frozenset(shingles(r[1])), []).append(r[0])
    order = lambda groups: sorted(sorted(map(str, g)) for g in groups.values())
    assert order(roots) == order(want)


def test_dense_leaves_and_large_components_lose_no_link(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "LEAF", 16)
    monkeypatch.setattr(op, "MEMBERS", 12)
    rng = random.Random(6)
    base = data.words(rng, "aa", 150).split()
    group = []
    for k in range(90):
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(0, 3)):
            copy[at] = f"edit{k % 7}"
        group.append((2000 + k, " ".join(copy)))
    for k in range(40):  # a chain: the first and the last have nothing in common
        group.append((3000 + k, " ".join(f"w{4 * k + n}" for n in range(50))))
    every = rows()[-48:] + [(*r, None, "s", 0, 5, 0.5, 9, 3) for r in group]
    data.documents(spark, every).repartition(3).write.parquet(str(tmp_path / "d"))
    got = corpus_pipeline.near(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == brute_kept(every)
