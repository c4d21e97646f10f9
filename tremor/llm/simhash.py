"""SimHash near-duplicates: fingerprints of word shingles, and every pair within a Hamming radius by vantage-point trees.

Fingerprints of 64 bits concentrate at distance 32 of any vantage point, where a ball of radius 3 reaches over nearly
every boundary, and a tree on whole fingerprints would send most of them into most shards. Two fingerprints that differ
in at most 3 bits agree in one of their four 16-bit quarters; so there are four trees, one on each quarter, in which
the radius is 0: a node has a vantage point (from a seed, the same on every machine) and deals its fingerprints by their
distance to it, near or far, and no ball crosses the boundary. Every fingerprint goes to four shards, whatever the
depth. Shards that are dense (those of full trees, or of many alike fingerprints) are dealt again by trees on the four
12-bit quarters of the other 48 bits, one of which agrees too.

Inside a shard a vantage-point tree on whole fingerprints gives the pairs: a ball is split at the median distance,
near and far side go on by themselves, and fingerprints whose balls overlap the boundary by the triangle inequality are
compared with those on the other side that they can reach; all other branches are pruned. A shard gives a spanning
forest of the links it finds. A shard that is still dense is cut into blocks that are compared pair by pair of blocks
in tasks of their own.

Defined results: null text, and text without words, has fingerprint zero and links like any other; equal fingerprints
are one node; null doc_ids are ignored in component_id, which is null if a component has no other; repeated rows are
separate rows of one component; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import graph
from tremor.session import ship, small, stored, table

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a shard on average, of one block of a dense shard, and of a ball that is compared without splitting it.
LEAF, BLOCK, BALL = 1024, 4096, 512
#: Bits of a fingerprint that a tree looks at: quarters of the whole, and quarters of what is left.
QUARTER, REST = 16, 12
#: Bytes of text that are split into words at a time.
SLICE = 4 << 20


def _slices(text: bytes) -> Iterator[bytes]:
    """text in pieces that end at white space."""
    k = 0
    while k < len(text):
        end = k + SLICE
        if end < len(text):
            cut = max(text.rfind(c, k, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            while cut <= k and end < len(text):  # one word longer than a slice
                more = min((x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(c, end)) >= 0), default=len(text))
                cut = end = more
            end = cut
        yield text[k:end]
        k = end


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits, unsigned: bit set if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest as h64

    before: list[bytes] = []
    seen, ones, total = False, np.zeros(64, np.int64), 0
    for piece in _slices((text or b"").lower()):
        words = before + piece.split()
        seen = seen or bool(words)
        if len(words) >= shingle:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            joined = b" ".join(words)
            hashes = [h64(joined[a:b], SEED) for a, b in zip([0, *ends[:-shingle].tolist()], (ends[shingle - 1 :] - 1).tolist(), strict=True)]
            for k in range(0, len(hashes), 1 << 16):
                part = np.array(hashes[k : k + (1 << 16)], dtype=np.uint64)
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
            before = words[len(words) - shingle + 1 :]
        else:
            before = words
    if not seen:
        return 0
    if not total:
        return h64(b" ".join(before), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *keep: str) -> DataFrame:
    """The columns named in keep and fp, a long with the fingerprint's bits."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(0)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], names=[*keep, "fp"])

    kept = docs.select(F.col("text").cast("string").cast("binary").alias("__text"), *[F.col(f"`{k}`") for k in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(run, f"{schema}, fp long" if keep else "fp long")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shards(bits: np.ndarray, width: int, depth: int, seed: int) -> np.ndarray:
    """Leaf of each value of so many bits in a vantage-point tree for radius 0: equal values meet in one."""
    path = np.zeros(len(bits), np.uint64)
    for level in range(depth):
        vantage = _mix(path + np.uint64(1 + (seed << 56) + (level << 48))) >> np.uint64(64 - width)
        far = np.bitwise_count(bits ^ vantage) > width // 2 - level % 2
        path = (path << np.uint64(1)) | far.astype(np.uint64)
    return path


def _quarter(fp: np.ndarray, k: int) -> np.ndarray:
    return (fp >> np.uint64(QUARTER * k)) & np.uint64((1 << QUARTER) - 1)


def first_shards(fp: np.ndarray, depth: int) -> np.ndarray:
    """The four shards (columns) of each fingerprint; two low bits tell the tree."""
    return np.stack([(_shards(_quarter(fp, k), QUARTER, depth, k) << np.uint64(2)) | np.uint64(k) for k in range(4)], axis=1)


def second_shards(fp: np.ndarray, shard: np.ndarray, depth: int) -> np.ndarray:
    """The four shards of each fingerprint inside the one that it is in; 2 bits more, and as many as depth."""
    k = shard & np.uint64(3)
    low = (np.uint64(1) << (k * np.uint64(QUARTER))) - np.uint64(1)
    high = np.where(k == np.uint64(3), np.uint64(0), fp >> np.minimum((k + np.uint64(1)) * np.uint64(QUARTER), np.uint64(63)))
    rest = (fp & low) | (high << (k * np.uint64(QUARTER)))
    parts = [(rest >> np.uint64(REST * j)) & np.uint64((1 << REST) - 1) for j in range(4)]
    return np.stack([(((shard << np.uint64(REST)) | _shards(p, REST, depth, 8 + j)) << np.uint64(2)) | np.uint64(j) for j, p in enumerate(parts)], axis=1)


def _across(fp: np.ndarray, label: np.ndarray, a: np.ndarray, b: np.ndarray | None, radius: int) -> np.ndarray:
    """label after linking all pairs within the radius of rows a with rows b, or among rows a."""
    for k in range(0, len(a), BALL):
        rows = a[k : k + BALL]
        other = a[: k + BALL] if b is None else b
        for j in range(0, len(other), 16 * BALL):
            some = other[j : j + 16 * BALL]
            x, y = np.nonzero(np.bitwise_count(fp[rows, None] ^ fp[None, some]) <= radius)
            label = graph.union(label, rows[x], some[y])
    return label


def forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of all pairs within the radius: a vantage-point tree over the fingerprints."""
    label, todo = np.arange(len(fp)), [np.arange(len(fp))]
    while todo:
        rows = todo.pop()
        if len(rows) > BALL:
            d = np.bitwise_count(fp[rows] ^ fp[rows[len(rows) // 2]])
            edge = int(np.median(d))
            near = d <= edge
            if 0 < near.sum() < len(rows):
                todo += [rows[near], rows[~near]]
                label = _across(fp, label, rows[near & (d > edge - radius)], rows[~near & (d <= edge + radius)], radius)
                continue
        label = _across(fp, label, rows, None, radius)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def _halves(base: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of all pairs (base, query) within the radius."""
    every = np.concatenate((base, query))
    label = _across(every, np.arange(len(every)), np.arange(len(base)), len(base) + np.arange(len(query)), radius)
    linked = np.flatnonzero(label != np.arange(len(every)))
    return every[linked], every[label[linked]]


def _links(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def _dense(dealt: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows of other shards, rows of dense ones with their number of blocks) of (shard, fp)."""
    dense = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 4 * BLOCK)
    dense = stored(dense.select("shard", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), name)
    if dense.isEmpty():
        return dealt, dealt.withColumn("blocks", F.lit(1)).limit(0)
    dense = small(dense)
    return dealt.join(dense, "shard", "left_anti"), dealt.join(dense, "shard")


def links(nodes: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints fp of nodes that leave no pair within the radius unconnected."""
    if radius > 3:
        raise ValueError("of four quarters one agrees only in pairs that differ in 3 bits at most")
    ship(nodes.sparkSession)
    depth = min(QUARTER, max(0, math.ceil(math.log2(max(1, count) / LEAF))))

    def dealt_by(shards, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            shard = shards(fp, batch)
            yield pa.RecordBatch.from_arrays([pa.array(shard.view(np.int64).ravel()), pa.array(np.repeat(fp, 4).view(np.int64))], names=["shard", "fp"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return dealt_by(lambda fp, batch: first_shards(fp, depth), batches)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return dealt_by(lambda fp, batch: second_shards(fp, np.asarray(batch.column(1)).view(np.uint64), REST), batches)

    def inside(t: pa.Table) -> pa.Table:
        return _links(*forest(np.asarray(t["fp"]).view(np.uint64), radius))

    def blocks(t: pa.Table) -> pa.Table:
        fp, is_base = np.asarray(t["fp"]).view(np.uint64), np.asarray(t["base"])
        return _links(*(forest(fp, radius) if is_base.all() else _halves(fp[is_base], fp[~is_base], radius)))

    schema = "a long, b long"
    few, dense = _dense(nodes.select("fp").mapInArrow(first, "shard long, fp long"), "dense")
    found = few.groupBy("shard").applyInArrow(inside, schema)
    dense = stored(dense.select("fp", "shard"), "dense-rows")
    if dense.isEmpty():
        return found.filter("a <> b")
    few, dense = _dense(dense.mapInArrow(second, "shard long, fp long"), "dense-again")
    found = found.unionByName(few.groupBy("shard").applyInArrow(inside, schema))
    dense = stored(dense, "dense-blocks").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    if not dense.isEmpty():
        # a task (i, j) holds block i as base and, where j differs, block j as queries
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), (F.col("own") <= k).alias("base")))
        tasks = dense.select("shard", "fp", F.explode(pair).alias("t")).select("shard", "t.i", "t.j", "t.base", "fp")
        found = found.unionByName(tasks.groupBy("shard", "i", "j").applyInArrow(blocks, schema))
    return found.filter("a <> b")


def components_of(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """uid, doc_id, fp, root of every row; uid numbers the rows, root is the same for all rows of a component."""
    rows = stored(fingerprints(docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid")), shingle, "uid", "doc_id"), "fingerprints")
    nodes = stored(rows.select("fp").distinct(), "nodes")
    found = stored(graph.components(links(nodes, nodes.count(), radius), "links"), "components")
    return rows.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("uid", "doc_id", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """uid, doc_id, fp and component_id of every row: the smallest doc_id of its component."""
    rows = stored(components_of(docs, shingle, radius), "rooted")
    least = stored(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")  # of its own, so that a large component's rows can be split
    return rows.join(least, "root").select("uid", "doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
