import random
from collections import Counter

import numpy as np
from xxhash import xxh64_intdigest

from tests.llm import data
from tremor.llm import graph
from tremor.llm import simhash as op


def brute_fp(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[find(i)] = find(j)
    return [find(k) for k in range(len(fps))]


def test_against_brute_force(spark):
    rows = data.rows() + [(k + 200, (data.rows()[3][1] + " tail" * (k % 3)), None, None, None, 1, 0.0, 1, 1) for k in range(30)]
    got = op.near_duplicates(data.documents(spark, rows)).select("doc_id", "fp", "component_id").collect()
    fps = [brute_fp(r[1]) for r in rows]
    roots = brute_components(fps)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = Counter((r[0], f - (1 << 64) if f >> 63 else f, least.get(root)) for r, f, root in zip(rows, fps, roots, strict=True))
    assert Counter(tuple(r) for r in got) == want
    assert op.near_duplicates(data.documents(spark, [])).count() == 0


def test_trees_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(op, "LEAF", 16)
    monkeypatch.setattr(op, "BLOCK", 24)
    monkeypatch.setattr(op, "BALL", 32)
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(800)}
    for f in list(fps)[:250]:
        for _ in range(3):
            x = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    hub = rng.getrandbits(64)  # a dense cluster
    fps |= {hub ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(600)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {r.node % (1 << 64): r.root for r in graph.components(op.links(nodes, len(fps))).collect()}
    roots = brute_components(fps)
    groups, mine = {}, {}
    for f, r in zip(fps, roots, strict=True):
        groups.setdefault(r, set()).add(f)
        mine.setdefault(found.get(f, ("alone", f)), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_shards_hold_every_pair_and_four_rows_a_fingerprint():
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(400)]
    near = [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for f in base]
    a, b = np.array(base, np.uint64), np.array(near, np.uint64)
    for depth in (0, 5, 16):
        x, y = op.first_shards(a, depth), op.first_shards(b, depth)
        assert x.shape == (400, 4)
        agrees = np.stack([op._quarter(a, k) == op._quarter(b, k) for k in range(4)], axis=1)
        assert agrees.any(axis=1).all() and (x == y)[agrees].all()
        k = agrees.argmax(axis=1)
        u, v = (op.second_shards(z, s[np.arange(400), k], 12) for z, s in ((a, x), (b, y)))
        assert (u == v).any(axis=1).all()
    assert len(np.unique(op.first_shards(a, 7)[:, 0])) > 60


def test_forest_prunes_no_pair(monkeypatch):
    monkeypatch.setattr(op, "BALL", 16)
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(500):
        fps.append(rng.choice(fps) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    fp = np.unique(np.array(fps, np.uint64))
    a, b = op.forest(fp, 3)
    label = graph.union(np.arange(len(fp)), np.searchsorted(fp, a), np.searchsorted(fp, b))
    roots = brute_components(fp.tolist())
    assert len({(x, y) for x, y in zip(label.tolist(), roots, strict=True)}) == len(set(label.tolist())) == len(set(roots))


def test_slices(monkeypatch):
    text = (" ".join(f"w{k % 50} " for k in range(900)) + "y" * 400).encode()
    whole = op.fingerprint(text)
    monkeypatch.setattr(op, "SLICE", 64)
    assert op.fingerprint(text) == whole == brute_fp(text.decode())


def test_union():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    label = graph.union(np.arange(300), a, b)
    assert (label[a] == label[b]).all() and (label[label] == label).all()
