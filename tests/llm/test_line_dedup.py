import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm import data
from tremor.llm import line_dedup as op
from tremor.session import ship, stored


def rows():
    rng = random.Random(11)
    base = [data.words(rng, "aa", n) for n in (3, 8, 20, 40, 60, 60, 90)]
    out = []
    for k in range(40):
        lines = [rng.choice(base) for _ in range(3)] + [data.words(rng, "bb", rng.randint(1, 30))]
        if k % 3 == 0:  # near copies
            w = rng.choice(base[3:]).split()
            w[rng.randrange(len(w))] = "changed"
            lines.append(" ".join(w))
        rng.shuffle(lines)
        out.append((k, "\n".join(lines) + rng.choice(("", "\n", "\n\n  \n", "\r\n")), None, None, None, 1, 0.0, 1, 1))
    return out + [(50, None, None, None, None, 1, 0.0, 1, 1), (51, "", None, None, None, 1, 0.0, 1, 1), (52, " \n\t", None, None, None, 1, 0.0, 1, 1), (None, base[2], None, None, None, 1, 0.0, 1, 1), (53, "ab\nab\nabc", None, None, None, 1, 0.0, 1, 1), (0, out[0][1], None, None, None, 1, 0.0, 1, 1)]


def brute(data_rows):
    places = []
    for n, (doc_id, text, *_) in enumerate(data_rows):
        for k, line in enumerate((text or "").split("\n")):
            if line := line.strip(" \t\n\x0b\x0c\r"):
                places.append((doc_id is None, doc_id or 0, n, k, line))
    lines = sorted({p[4] for p in places})
    sets = [{line[i : i + op.SHINGLE] for i in range(max(1, len(line) - op.SHINGLE + 1))} for line in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= op.SIMILARITY * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    seen, kept = set(), defaultdict(list)
    for p in sorted(places):
        r = find(lines.index(p[4]))
        if r in seen:
            kept[p[2]].append(p[3])
        seen.add(r)
    return kept


def test_against_brute_force(spark):
    all_rows = rows()
    want = []
    dropped = brute(all_rows)
    for n, (doc_id, text, *_) in enumerate(all_rows):
        lines = (text or "").split("\n")
        solid = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in lines) if text else 0
        gone = sorted(dropped[n])
        kept = None if text is None else text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want.append((doc_id, solid, solid - len(gone), gone, kept))
    docs = data.documents(spark, all_rows)
    got = [tuple(r) for r in op.dedup_lines(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert op.dedup_lines(data.documents(spark, [])).count() == 0


def hot_rows():
    """Many lines that are mostly alike, with some on the verge of it, in one hot bucket and across others."""
    rng = random.Random(3)
    base = data.words(rng, "aa", 40)
    out = []
    for k in range(90):
        line = list(base)
        for at in rng.sample(range(len(line)), rng.choice((0, 1, 2, 3, 3, 4))):
            line[at] = rng.choice("xyz")
        out.append((k, "".join(line) + "\n" + data.words(rng, "bb", 9), None, None, None, 1, 0.0, 1, 1))
    return out


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    """With tiny limits every bucket is divided, compared with a head, then block by block."""
    all_rows = hot_rows()
    want = sorted((r[0], sorted(brute(all_rows)[n])) for n, r in enumerate(all_rows))
    for limits in ({}, {"FEW": 2, "BUCKET": 4, "OFTEN": 3, "LOOK": 2}, {"FEW": 1, "BUCKET": 1, "OFTEN": 2, "LOOK": 1}, {"FEW": 2, "BUCKET": 8, "OFTEN": 1 << 40}):
        for name, value in limits.items():
            monkeypatch.setattr(op, name, value)
        got = sorted((r.doc_id, list(r.dropped)) for r in op.dedup_lines(data.documents(spark, all_rows)).collect())
        assert got == want, limits


def test_rows_of_a_hot_bucket_grow_with_it(spark, monkeypatch):
    """All lines share a bucket and are alike: as many rows are compared as there are lines, but for a head a block."""
    ship(spark)
    monkeypatch.setattr(op, "BUCKET", 16)
    monkeypatch.setattr(op, "FEW", 4)
    line, seen = "the quick brown fox jumps over the lazy dog and does so again and again until it is tired ", []
    for n in (200, 800):
        lines = spark.createDataFrame([(k, line + str(k)) for k in range(n)], "node long, line string")
        read = spark.sparkContext.accumulator(0)
        keep = op._verify

        def counted(similarity, shingle_set, known, read=read, keep=keep):
            run = keep(similarity, shingle_set, known)

            def counting(batches):
                for b in batches:
                    read.add(len(b))
                    yield b

            return lambda batches: run(counting(batches))

        monkeypatch.setattr(op, "_verify", counted)
        keys = stored(lines.select("node", F.array(F.lit(7).cast("long")).alias("keys")), "t")
        links = op.linked(keys, keys.filter(op.looked_at()), lines, 0.8).collect()
        monkeypatch.setattr(op, "_verify", keep)
        assert len({x for r in links for x in r}) == n
        seen.append(read.value / n)
    assert seen[1] < 1.2 * seen[0] and seen[1] < 40


def test_packed_pairs_come_out_as_buckets(monkeypatch):
    """Whatever the batches and parts, buckets of two members at least come out whole, and hot ones row by row."""
    rng = random.Random(4)
    rows = [(k, [rng.choice((1, 1, 1, -7, rng.randint(2, 400))), 1000 if k % 3 == 0 else 2000 + k]) for k in range(900)]
    want = defaultdict(set)
    for node, keys in rows:
        for bucket in keys:
            want[bucket].add(node)
    for size, parts, pairs in ((1, 3, 64), (7, 1, 1 << 20), (900, 11, 512)):
        monkeypatch.setattr(op, "PAIRS", pairs)
        table = pa.table({"node": [r[0] for r in rows], "keys": pa.array([r[1] for r in rows], pa.list_(pa.int64()))})
        packed = pa.Table.from_batches(op._dealt(parts, np.array([1000]))(iter(table.to_batches(size)))).sort_by("part")
        lists, long, hot = [], defaultdict(list), set()
        for batch in op._runs(iter(packed.to_batches(size))):
            for r in batch.to_pylist():
                if r["members"] is not None:
                    lists.append(tuple(r["members"]))
                elif r["bucket"] == 1000:
                    assert r["at"] == -1
                    hot.add(r["node"])
                else:
                    assert r["at"] == len(long[r["bucket"]])
                    long[r["bucket"]].append(r["node"])
        assert hot == want[1000]
        rest = {k: sorted(x) for k, x in want.items() if k != 1000 and len(x) > 1}
        assert sorted(lists) == sorted(tuple(x) for x in rest.values() if len(x) <= op.FEW)
        assert long == {k: x for k, x in rest.items() if len(x) > op.FEW}


def test_band_keys_of_a_batch_are_those_of_each_line(monkeypatch):
    rng = random.Random(2)
    lines = ["".join(rng.choice("ab cé漢") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    every = op.band_keys(lines)
    assert all((op.band_keys([x])[0] == k).all() for x, k in zip(lines, every, strict=True))
    long = "".join(rng.choice("ab cé漢") for _ in range(5000))
    whole = op.band_keys([long, "ab"])
    monkeypatch.setattr(op, "SLICE", 300)
    assert (op.band_keys([long, "ab"]) == whole).all() and (op.band_keys(lines) == every).all()
    assert len(op.shingle_set("abcdefghij")) == 3 and len(op.shingle_set("ab")) == 1
    assert np.unique(op.band_keys(["same line"] * 3), axis=0).shape[0] == 1


def test_long_lines_and_many_dropped_ones(spark):
    rng = random.Random(21)
    long = "".join(rng.choice("abcdefgh ijklé") for _ in range(300_000)).strip()
    near = long[:150_000] + "XYZ" + long[150_000:]
    many = [f"a line of its own number {k} {rng.random()}" for k in range(3000)]
    rows = [(1, long + "\n" + "\n".join(many)), (2, near), (3, "\n".join(many + many[:10]) + "\nlast of all these"), (4, "x" * 9)]
    docs = data.documents(spark, [(*r, None, None, None, 1, 0.0, 1, 1) for r in rows])
    got = {r.doc_id: r for r in op.dedup_lines(docs).collect()}
    assert got[1].n_kept <= 3001 and 0 not in got[1].dropped and list(got[2].dropped) == [0] and got[2].text == ""
    assert got[3].n_kept == 1 and got[3].text == "last of all these" and got[4].n_kept == 1
