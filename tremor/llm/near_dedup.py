"""Near copies of whole documents: SimHash of word shingles, vantage-point trees, exact Jaccard verification, components.

A document is the set of its runs of SHINGLE words (ASCII lower case, split at ASCII white space; fewer words are one
shingle). Equal sets are one node. Every node gets a SimHash fingerprint of WORDS * 64 bits: a bit is 1 if it is set in
over half of its shingles' hashes. Documents of Jaccard similarity 0.8 differ in a bit with probability 0.152 (0.161 at
most, and 0.188 where a set of four shingles meets one of five), unrelated ones with 0.5.

Candidates come from the fingerprints alone. There is a vantage-point tree of radius 0 on every byte of the fingerprint,
as simhash has on its quarters: equal bytes meet in one leaf, and no ball crosses a boundary. Trees are as deep as the
number of nodes asks for, and as many as their depth asks for: a pair of similarity 0.8 shares no leaf with probability
1e-6 at most (2e-5 for four shingles and five). In a leaf all pairs are compared whose set sizes allow the similarity,
and those that differ in at most RADIUS of 256 bits are linked: five deviations beyond what a pair of similarity 0.8
differs in on average (four for the smallest sets). Leaves that hold more than twice their share are compared block by
block.

What the links connect is verified: inside each component the pairs within the radius that are not yet connected are
compared by the exact Jaccard similarity of their sets, and only those of the least similarity stay connected. A
component beyond MEMBERS is compared with one member, in blocks, and what is not like it with all members, block by
block; nothing is left out.

Defined results: null text and text without words have the same empty set and are copies of each other; null doc_ids
and repeated rows are rows like any other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm import graph, line_dedup, simhash
from tremor.session import fixed, ship, small, stored

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Words of 64 bits in a fingerprint, and trees (each on a byte of its own) by their depth.
WORDS, TREES = 5, (1, 10, 14, 20, 24, 29, 34, 38, 40)
#: Words that travel to the leaves, bits of these in which linked fingerprints differ at most, and of the first two.
SENT, RADIUS, FIRST = 4, 72, 46
#: Nodes of a leaf on average, leaves of a deepest tree that would all be of the usual size, and rows that are compared at a time, in a tile with as many as fit the cache.
LEAF, SHARE, ROWS, TILE = 4096, 48, 256, 16
#: Members of a component that are verified in one go.
MEMBERS = 1024
#: Shingles whose bits are counted at a time.
SLICE = 4096
_SALT = np.random.default_rng(20_241).integers(0, 1 << 64, WORDS, dtype=np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles; a single zero without words."""
    from xxhash import xxh64_intdigest as h64

    words = [np.fromiter((h64(w, SEED) for w in piece.split()), np.uint64) for piece in simhash._slices((text or b"").lower())]
    words = np.concatenate(words) if words else np.zeros(0, np.uint64)
    if not len(words):
        return np.zeros(1, np.uint64)
    m = max(1, len(words) - SHINGLE + 1)
    h = np.full(m, 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(SHINGLE, len(words))):
            h = (h ^ words[k : k + m]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return line_dedup.distinct(h)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """WORDS words: a bit is set if it is in over half of the shingles' hashes, which are drawn out to as many words."""
    ones = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(shingles), SLICE):
        hashes = simhash._mix(shingles[k : k + SLICE, None] ^ _SALT)
        bits = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # as many as a byte counts
            ones += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")


def leaves(fp: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of each fingerprint (row) in each tree (column) of so many levels."""
    fp = np.ascontiguousarray(fp).view(np.uint8).astype(np.uint64)
    return np.stack([(simhash._shards(fp[:, k], 8, depth, k) << np.uint64(8)) | np.uint64(k) for k in range(TREES[depth])], axis=1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The leaves of the deepest trees that a set is in."""
    return leaves(fingerprint(shingles)[None], len(TREES) - 1)[0]


def close(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows x of a and y of b, fingerprints of SENT words or more, that are within the radius."""
    wide = -(-len(b) // 8) * 8
    words, two = np.empty((TILE, len(b)), np.uint64), np.empty((TILE, len(b)), np.uint8)
    d, few = np.full((TILE, wide), 255, np.uint8), np.empty((TILE, wide), bool)
    columns = np.ascontiguousarray(b[:, :2].T)
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(a), TILE):
        some = a[k : k + TILE]
        n = len(some)
        np.bitwise_count(np.bitwise_xor(some[:, 0, None], columns[0], out=words[:n]), out=d[:n, : len(b)])
        np.bitwise_count(np.bitwise_xor(some[:, 1, None], columns[1], out=words[:n]), out=two[:n])
        d[:n, : len(b)] += two[:n]
        np.less_equal(d[:n], min(FIRST, radius), out=few[:n])
        at = np.flatnonzero(few[:n].view(np.uint64))  # eight pairs at a time
        if len(at):
            r, c = np.nonzero(few[:n].reshape(-1, 8)[at])
            x, y = np.divmod(8 * at[r] + c, wide)
            near = np.bitwise_count(some[x, :SENT] ^ b[y, :SENT]).sum(axis=1, dtype=np.int64) <= radius
            xs.append(k + x[near])
            ys.append(y[near])
    return np.concatenate(xs), np.concatenate(ys)


def forest(fp: np.ndarray, size: np.ndarray, base: np.ndarray, similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows) that span all pairs within the radius whose sizes allow the similarity, among base rows, or between these and the others if there are others."""
    label = np.arange(len(fp))
    order = np.argsort(size, kind="stable")
    a = order[base[order]]
    b = a if base.all() else order[~base[order]]
    sizes = size[b]
    for k in range(0, len(a), ROWS):
        rows = a[k : k + ROWS]
        first, last = np.searchsorted(sizes, similarity * size[rows[0]] - 1e-6), np.searchsorted(sizes, size[rows[-1]] / similarity + 1e-6, "right")
        if b is a:
            first = max(first, k)  # pairs with smaller sets were compared from these
        for j in range(first, last, 16 * ROWS):
            some = b[j : min(last, j + 16 * ROWS)]
            x, y = close(fp[rows], fp[some], radius)
            if len(x):
                label = graph.union(label, rows[x], some[y])
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return linked, label[linked]


_DEALT = "leaf long, i int, j int, base boolean, packed binary"


def links(nodes: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that leave no two nodes (node, size, fp) unconnected that share a leaf, whose sizes allow the similarity and whose fingerprints are within the radius."""
    ship(nodes.sparkSession)
    count = nodes.count()
    depth = min(len(TREES) - 1, max(0, math.ceil(math.log2(max(1, count) / LEAF))))
    most = max(4 * LEAF, 2 * count // SHARE)

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        fp = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, WORDS)
        rows = np.empty((len(fp), 2 + SENT), np.uint64)
        rows[:, 0], rows[:, 1], rows[:, 2:] = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), fp[:, :SENT]
        return leaves(fp, depth), rows

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, n = np.unique(read(batch)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), pa.array(n.astype(np.int64))], names=["leaf", "n"])

    sizes = nodes.select("node", "size", "fp").mapInArrow(counted, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).filter(F.col("n") > most)
    dense = {r.leaf: -(-r.n // most) for r in sizes.collect()}  # a few for each tree

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, rows = read(batch)
            out = []
            for tree in range(TREES[depth]):
                order = np.argsort(leaf[:, tree], kind="stable")
                edges = np.flatnonzero(np.diff(leaf[order, tree].astype(np.int64), prepend=-1, append=-1))
                for at, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    here, some = int(leaf[order[at], tree]), rows[order[at:end]]
                    blocks = dense.get(here, 1)
                    own = simhash._mix(some[:, 0] + np.uint64(tree)) % np.uint64(blocks)
                    for b in np.unique(own).astype(int).tolist():
                        packed = some[own == b].tobytes() if blocks > 1 else some.tobytes()
                        # a task (i, j) holds block i as base and, where j differs, block j as the others
                        out += [(here, min(b, k), max(b, k), b <= k, packed) for k in range(blocks)]
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["leaf", "i", "j", "base", "packed"])

    def inside(t: pa.Table) -> pa.Table:
        packed = t["packed"].to_pylist()
        rows = np.frombuffer(b"".join(packed), np.uint64).reshape(-1, 2 + SENT)
        base = np.repeat(np.array(t["base"].to_pylist(), bool), [len(p) // (8 * (2 + SENT)) for p in packed])
        if t["i"][0].as_py() != t["j"][0].as_py() and base.all():  # the other block is empty
            rows, base = rows[:0], base[:0]
        a, b = forest(rows[:, 2:], rows[:, 1].astype(np.int64), base, similarity, radius)
        node = rows[:, 0].view(np.int64) if len(rows) else np.zeros(0, np.int64)
        return pa.table({"a": node[a], "b": node[b]})

    return nodes.select("node", "size", "fp").mapInArrow(dealt, _DEALT).groupBy("leaf", "i", "j").applyInArrow(inside, "a long, b long")


def _verify(similarity: float, radius: int):
    """Rows (root, i, j, base, node, line) of groups in sorted batches, to links of the pairs that are alike."""

    def alike(i: int, j: int, base: list[bool], nodes: list[int], lines: list[bytes]) -> Iterator[tuple[int, int]]:
        sets = [shingle_set(x) for x in lines]
        fp = np.stack([fingerprint(s) for s in sets])
        a = np.flatnonzero(base)
        b = a if i == j else np.flatnonzero(~np.array(base))
        root = list(range(len(nodes)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for k in range(0, len(a), ROWS):
            x, y = close(fp[a[k : k + ROWS]], fp[b], radius)
            for x, y in zip(a[k + x].tolist(), b[y].tolist(), strict=True):
                if (i == j and x <= y) or nodes[x] == nodes[y] or (u := find(x)) == (v := find(y)):
                    continue
                s, t = sets[x], sets[y]
                if min(len(s), len(t)) >= similarity * max(len(s), len(t)) and line_dedup.jaccard(s, t) >= similarity:
                    root[u] = v
                    yield nodes[x], nodes[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for batch in batches:
            new = []
            for group, i, j, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (group, i, j) != now:
                    new += alike(*now[1:], *held) if now else ()
                    now, held = (group, i, j), ([], [], [])
                for values, value in zip(held, row, strict=True):
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in new], pa.int64()) for k in (0, 1)], names=["a", "b"])
        new = list(alike(*now[1:], *held)) if now else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in new], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def verified(found: DataFrame, lines: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect what is alike of the members (node, root) of each component; lines are (node, line)."""

    def compared(tasks: DataFrame) -> DataFrame:
        joined = tasks.join(lines, "node").select("root", "i", "j", "base", "node", "line")
        return joined.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node").mapInArrow(_verify(similarity, radius), "a long, b long")

    hot = found.groupBy("root").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > MEMBERS)
    hot = stored(hot.select("root", "head", F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks")), "near-hot")
    if hot.isEmpty():
        return compared(found.select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("base"), "node"))
    hot = small(hot)
    few = compared(found.join(hot, "root", "left_anti").select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("base"), "node"))
    members = stored(found.join(hot, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "near-members")
    heads = members.filter("node = head").select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(-1).alias("j"), F.lit(True).alias("base"), "node")
    star = heads.unionByName(members.filter("node <> head").select("root", F.col("own").alias("i"), F.lit(-1).alias("j"), F.lit(False).alias("base"), "node"))
    star = stored(compared(star), "near-star")
    apart = stored(members.filter("node <> head").join(star.select(F.col("b").alias("node")), "node", "left_anti"), "near-apart")
    if apart.isEmpty():
        return few.unionByName(star)
    own = small(stored(apart.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("rows")), "near-rows"))
    base = apart.join(own, "root").select("root", F.pmod(F.xxhash64("node"), F.col("rows")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("base"), "node")
    others = members.join(own, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.col("own").alias("j"), F.lit(False).alias("base"), "node")
    return few.unionByName(star).unionByName(compared(base.unionByName(others).withColumn("j", -2 - F.col("j"))))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same, size, fp = [], [], []
        for text in batch.column(0):
            s = shingle_set(text.as_py())
            same.append(hashlib.md5(s.tobytes()).digest())
            size.append(len(s))
            fp.append(fingerprint(s).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(same, pa.binary()), pa.array(size, pa.int64()), pa.array(fp, pa.binary())], names=["uid", "doc_id", "same", "size", "fp"])


def components_of(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """uid, doc_id, root of every row; uid numbers the rows, root is the same for all rows of a component.

    docs (doc_id, text) is read twice, so what is not a table of files is written first.
    """
    docs = fixed(docs)
    ship(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").cast("binary").alias("text"), F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = stored(texts.mapInArrow(_signed, "uid long, doc_id long, same binary, size long, fp binary"), "signed")
    # equal sets have equal sizes and fingerprints
    heads = stored(rows.groupBy("same").agg(F.min("uid").alias("node"), F.first("size").alias("size"), F.first("fp").alias("fp")), "near-nodes")
    found = stored(graph.components(links(heads, similarity, radius), "near-links"), "near-found")
    found = graph.components(verified(found, texts.select(F.col("uid").alias("node"), F.col("text").alias("line")), similarity, radius), "near-verified")
    heads = heads.select("same", "node").join(found, "node", "left").select("same", F.coalesce("root", "node").alias("root"))
    return rows.select("uid", "doc_id", "same").join(heads, "same").select("uid", "doc_id", "root")
