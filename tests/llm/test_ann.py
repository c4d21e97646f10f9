import numpy as np

from tremor.llm import ann as op

SCHEMA = "vec_id long, embedding array<float>, label int, uid long, score double"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 0.5) for r in rows], SCHEMA)


def brute(rows, k):
    fine = [(i, n, np.array(v, np.float32).astype(float)) for n, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, n, q in fine:
        if i is not None and i % 50 == 0:
            s = sorted((-(q * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum())), 1 << 62 if j is None else j, m) for j, m, v in fine if m != n)
            out.setdefault(i, []).append([(None if j == 1 << 62 else j, -c) for c, j, m in s[:k]])
    return out


def test_recall_and_hard_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    rows = [(k, (centres[k % 20] + 0.5 * rng.normal(size=24)).tolist()) for k in range(1200)]
    rows += [(5000 + k, rows[0][1]) for k in range(300)]  # one very common vector
    rows += [(2000, None), (2050, [0.0] * 24), (2100, [None] + [1.0] * 23), (2150, [float("nan")] * 24), (2200, [float("inf")] * 24), (2250, []), (None, rows[3][1]), (50, rows[50][1]), (2300, [1.0, 2.0])]
    found = {}
    for r in op.nearest(table(spark, rows).repartition(3), "vec_id % 50 = 0", 5).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute([r for r in rows if not r[1] or len(r[1]) == 24], 5)
    assert found.keys() == want.keys()
    hits = total = 0
    for q, lists in want.items():
        got = sorted(found[q])
        assert len(got) == sum(map(len, lists))
        for w in lists:
            hits += sum(any(j == v and abs(c - s) < 1e-12 for _, v, s in got) for j, c in w)
            total += len(w)
    assert hits >= 0.95 * total
    assert [v for _, v, _ in sorted(found[5000])] == [0, 5001, 5002, 5003, 5004]  # ties go to smaller ids


def test_few_and_none(spark):
    got = op.nearest(table(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (3, [0.0, 2.0])]), "vec_id % 50 = 0", 5).collect()
    assert [(r.rank, r.vec_id, round(r.score, 6)) for r in sorted(got)] == [(1, 1, 0.707107), (2, 3, 0.0)]
    assert op.nearest(table(spark, [(0, [1.0])]), "vec_id % 50 = 0", 5).count() == 0
    assert op.nearest(table(spark, []), "vec_id % 50 = 0", 5).count() == 0


def test_index_gives_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 1 << 63, (400, op.CODES), dtype=np.uint64)
    query = code[:5].copy()
    query[:, 0] ^= np.uint64(0b1011)
    for radius in (0, 3, 40, 180, 215, 512):
        want = np.bitwise_count(code[None] ^ query[:, None]).sum(axis=2) <= radius
        for m in op.SPLITS:
            index = op.Index(code, m)
            assert sum(index.share(k, radius) + 1 for k in range(m)) == radius + 1
            assert (index.within(query, radius) == want).all() and (index.probe(query, radius) | ~want).all()


def test_close_codes_are_looked_up():
    """Where neighbours are near, many short substrings cost less, and a probe retrieves few other codes."""
    rng = np.random.default_rng(2)
    code = rng.integers(0, 1 << 63, (20_000, op.CODES), dtype=np.uint64)
    query = code[:32] ^ np.uint64(1 << 7)
    assert min(op.SPLITS, key=lambda m: op.Index(code, m).cost(query, 12)) == 32
    assert op.Index(code, 32).probe(query, 12).mean() < 0.01


def test_recall_on_the_embeddings(spark):
    """Against brute force on a whole table; a probe retrieves less than a fifth of the codes."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    found = {}
    for r in op.op6_ann(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    rows = [(i, np.array(v, float)) for i, v in zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True) if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0).tolist():
        s = x @ x[q]
        s[q] = -2
        want = ids[np.lexsort((ids, -s))[:5]].tolist()
        hits += sum(v in found[ids[q]] for v in want)
        total += 5
    assert hits >= 0.93 * total, hits / total
    model, radius, split = op.fit(op.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")), len(ids), 5)
    code = op.encode(x, model)
    assert op.Index(code, split).probe(code[::500], radius).mean() < 0.2


def test_extreme_magnitudes(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 8))
    rows = [(k, (v * (1e200 if k % 3 == 0 else 1e-200 if k % 3 == 1 else 1.0)).tolist()) for k, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in op.nearest(df, "vec_id % 50 = 0", 5).collect()}
    s = base @ base[0] / np.sqrt((base * base).sum(axis=1) * (base[0] @ base[0]))
    want = [int(k) for k in np.argsort(-s) if k][:5]
    assert [got[0, r][0] for r in range(1, 6)] == want and abs(got[0, 1][1] - s[want[0]]) < 1e-12


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=24 if k % 3 else 10 if k % 2 else 3).tolist()) for k in range(400)]
    found = {}
    for r in op.nearest(table(spark, rows), "vec_id % 50 = 0", 5).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found.keys() == {0, 50, 100, 150, 200, 250, 300, 350}
    hits = 0
    for q, got in found.items():
        assert len(got) == 5 and all(len(rows[v][1]) == len(rows[q][1]) for _, v, _ in got)
        hits += len({v for _, v, _ in got} & {v for v, _ in brute([r for r in rows if len(r[1]) == len(rows[q][1])], 5)[q][0]})
    assert hits >= 0.95 * 5 * len(found)
