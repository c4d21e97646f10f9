"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Rotations are learned on a bounded sample (iterative quantisation: principal axes turned until signs lose least); eight
of them give 512-bit codes. A code is split into substrings, each indexed; of two codes within the radius at least one
substring pair lies within the substring's share of the radius, so probing every indexed value within that retrieves
every code in the radius. Retrieved codes are checked in full and their vectors reranked by cosine in double precision.
The radius is the code distance that holds nearly all true neighbours in the sample, whose neighbours are farther than
those of the whole table. Into how many substrings codes are split is settled on the sample too, by what a probe costs
and retrieves: many short ones, whose near values are looked up one by one, where neighbours are close; few long ones,
whose distinct values are compared with the query's, where they are far. Vectors of each length have a model and a
search of their own.

Every vector is indexed, in one block of BLOCK vectors. A block is one task's: its vectors come first and are indexed,
then the queries pass by in batches, so vectors are never copied and a query is copied once a block.

Defined results: vectors that are null, empty, zero, or that hold null or non-finite components take no part, as queries
or candidates; vectors are neighbours of those of their own length only; a block that holds fewer than k
codes within the radius gives its nearest by code and cosine all the same, so a query gets k neighbours if there are as
many; equal scores go to the smaller vec_id, null last; repeated rows are separate candidates; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.session import ship, stored, table

#: Vectors that the rotations and the radius are learned on (about), queries among them, and share of true neighbours that the radius holds.
SAMPLE, SAMPLE_QUERIES, HOLD = 20_000, 400, 0.985
#: Words of 64 bits of a code, and numbers of substrings it may be split into (of 16, 32, 64 or 128 bits).
CODES, SPLITS = 8, (32, 16, 8, 4)
#: Vectors of an indexed block, and queries that are probed at a time.
BLOCK, QUERIES = 32_768, 128
_NULL_ID = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """uid, vec_id (null as the largest long), embedding (doubles)."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("vec_id").cast("long"), F.lit(_NULL_ID)).alias("vec_id"), e.alias("embedding")).filter(e.isNotNull() & (F.size(e) > 0) & fine)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of doubles. Those whose squares would leave the range of doubles are scaled by a power of two, which changes no cosine."""
    column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    top = np.abs(x).max(axis=1)
    far = (top > 1e140) | (top < 1e-140)
    return np.where(far[:, None], np.ldexp(x, -np.frexp(top)[1][:, None]), x) if far.any() else x


def learn(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) whose signs are the code."""
    d = vectors.shape[1]
    mean = vectors.mean(axis=0)
    centred = vectors - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    bits = 64
    axes = np.concatenate([axes[:, ::-1]] * math.ceil(bits / d), axis=1)[:, :bits]
    z = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(30):
        u, _, v = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
        turn = (u @ v).T
    return mean, axes @ turn


def encode(vectors: np.ndarray, model: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of CODES words of 64 bits for each vector."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.concatenate([np.packbits((unit - m) @ p > 0, axis=1, bitorder="little").view("<u8") for m, p in model], axis=1)


def fit(vectors: DataFrame, n: int, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, int]:
    """(model, radius, substrings) of n vectors of one length, from about SAMPLE of them."""
    drawn = vectors
    if n > SAMPLE:
        drawn = drawn.filter(F.pmod(F.xxhash64(F.lit("sample"), "vec_id", "uid"), F.lit(1 << 30)) < int(SAMPLE / n * (1 << 30)))
    x = _matrix(drawn.orderBy("vec_id", "uid").select("embedding").toArrow()["embedding"])
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    model = [learn(unit, s) for s in range(CODES)]
    code = encode(x, model)
    asked = np.arange(0, len(x), max(1, len(x) // SAMPLE_QUERIES))
    near = []
    for q in asked.tolist():
        s = unit @ unit[q]
        s[q] = -np.inf
        top = np.argpartition(-s, min(k, len(s) - 1))[: min(k, len(s) - 1)]
        near.append(np.bitwise_count(code[top] ^ code[q]).sum(axis=1))
    near = np.concatenate(near) if near else np.zeros(0)
    radius = int(np.quantile(near, HOLD)) if len(near) else 64 * CODES
    return model, radius, min(SPLITS, key=lambda m: Index(code, m).cost(code[asked[:64]], radius))


def _masks(bits: int, radius: int) -> np.ndarray:
    """All values of so many bits with at most radius bits set."""
    every = np.arange(1 << bits, dtype=np.uint16 if bits == 16 else np.uint32)
    return every[np.bitwise_count(every) <= radius]


class Index:
    """Multi-index over the codes of one block, split into m substrings."""

    def __init__(self, code: np.ndarray, m: int):
        self.code, self.m, self.bits = code, m, 64 * CODES // m
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(m):
            part = self._part(code, k)
            if self.bits <= 32:
                values, place = np.unique(part[:, 0], return_inverse=True)
                self.parts.append((values[:, None], place))
            else:  # long substrings hardly repeat
                self.parts.append((part, np.arange(len(part))))

    def _part(self, code: np.ndarray, k: int) -> np.ndarray:
        """Substring k of each code, as a row of one word, or two of 64 bits."""
        kind = {16: "<u2", 32: "<u4"}.get(self.bits, "<u8")
        words = np.ascontiguousarray(code).view(kind)
        width = words.shape[1] // self.m
        return words[:, k * width : (k + 1) * width]

    def share(self, k: int, radius: int) -> int:
        """Radius of substring k: with one bit less for all but one of them, the radii add up to the whole radius."""
        spare = radius - self.m + 1
        return spare // self.m + (k < spare % self.m)

    def probe(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Whether a probe of any substring retrieves each code (column) for each query code (row)."""
        found = np.zeros((len(query), len(self.code)), bool)
        for k, (values, place) in enumerate(self.parts):
            own = self.share(k, radius)
            if own < 0 or not len(values):
                continue
            asked = self._part(query, k)
            masks = _masks(16, min(own, 16)) if self.bits == 16 else None
            if masks is not None and len(masks) < len(values):  # look the values up
                at = np.full(1 << 16, -1)
                at[values[:, 0]] = np.arange(len(values))
                near = at[asked[:, :1] ^ masks[None, :]]
                hit = np.zeros((len(query), len(values)), bool)
                row, column = np.nonzero(near >= 0)
                hit[row, near[row, column]] = True
            else:
                hit = sum(np.bitwise_count(values[None, :, w] ^ asked[:, w, None]).astype(np.int16) for w in range(values.shape[1])) <= own
            found |= hit[:, place]
        return found

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Whether each code (column) is within the radius of each query code (row)."""
        found = self.probe(query, radius)
        for j in range(len(query)):
            c = np.flatnonzero(found[j])
            found[j, c[np.bitwise_count(self.code[c] ^ query[j]).sum(axis=1) > radius]] = False
        return found

    def cost(self, query: np.ndarray, radius: int) -> float:
        """Words that a query looks at: values or masks of each substring, then the codes that are retrieved."""
        looked = sum(min(len(v) * v.shape[1], len(_masks(16, max(0, min(self.share(k, radius), 16)))) if self.bits == 16 else len(v) * v.shape[1]) for k, (v, _) in enumerate(self.parts))
        return looked + CODES * float(self.probe(query, radius).sum(axis=1).mean()) if len(query) else 0.0


def _distinct_few(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows without those that follow `most` equal vectors of smaller ids: they are among the nearest of no query."""
    _, same = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    first = np.concatenate(([True], np.diff(same[order]) > 0))
    at = np.arange(len(order))
    return np.sort(order[at - np.maximum.accumulate(np.where(first, at, 0)) < most])


def search_block(index: Index, x: np.ndarray, norm: np.ndarray, ids: np.ndarray, uid: np.ndarray, q: np.ndarray, q_uid: np.ndarray, model: list, radius: int, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, cosines) of the k nearest found in a block, nearest first."""
    q_norm, q_code, out = np.sqrt((q * q).sum(axis=1)), encode(q, model), []
    code = index.code
    for first in range(0, len(q), QUERIES):
        hits = index.within(q_code[first : first + QUERIES], radius)
        for j in range(len(hits)):
            i = first + j
            c = np.flatnonzero(hits[j])
            c = c[uid[c] != q_uid[i]]
            if len(c) < k:  # the nearest codes make up what the radius lacks
                c = np.flatnonzero(uid != q_uid[i])
                far = np.bitwise_count(code[c] ^ q_code[i]).sum(axis=1)
                if len(c) > k:
                    c = c[far <= np.partition(far, k - 1)[k - 1]]
            s = (x[c] * q[i]).sum(axis=1) / (norm[c] * q_norm[i])
            top = np.lexsort((ids[c], -s))[:k]
            out.append((i, c[top], s[top]))
    return out


def nearest(vectors: DataFrame, queries: str, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine that are found for the rows where `queries` holds."""
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(usable(vectors), "vectors")
    asked = rows.filter(F.col("vec_id") != _NULL_ID).filter(queries)
    number = {r["d"]: r["n"] for r in asked.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = None
    for d, n in sorted((r["d"], r["n"]) for r in rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()):
        if n > 1 and d in number:  # a vector that is alone, or that nothing asks for, has no result
            same = F.size("embedding") == d
            found = _nearest_of_length(rows.filter(same), n, asked.filter(same), number[d], k)
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _nearest_of_length(rows: DataFrame, n_rows: int, asked: DataFrame, n_asked: int, k: int) -> DataFrame:
    """nearest() for n_rows vectors of one length and n_asked queries among them."""
    model, radius, split = fit(rows, n_rows, k)
    blocks = max(1, math.ceil(n_rows / BLOCK))
    columns = ["uid", "vec_id", "embedding"]
    indexed = rows.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asked"), *columns)
    queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asked"), *columns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index = None, [], None

        def ready():
            """The index of the open block, when its vectors are there."""
            t = pa.Table.from_batches(held) if held else None
            if t is None:
                return None
            x, ids, uid = _matrix(t["embedding"]), np.asarray(t["vec_id"]), np.asarray(t["uid"])
            kept = _distinct_few(x, ids, k + 1)
            x = x[kept]
            return Index(encode(x, model), split), x, np.sqrt((x * x).sum(axis=1)), ids[kept], uid[kept]

        for batch in batches:
            where, is_asked = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(where) | np.diff(is_asked.view(np.int8))) + 1
            for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(where)], strict=True):
                some = batch.slice(first, last - first)
                if not len(some):
                    continue
                if int(where[first]) != block:
                    block, held, index = int(where[first]), [], None
                if not is_asked[first]:
                    held.append(some)
                    continue
                if index is None:
                    index, held = ready(), []
                if index is None:
                    continue
                q = pa.Table.from_batches([some])
                q_uid, q_ids, found = np.asarray(q["uid"]), np.asarray(q["vec_id"]), []
                for i, c, s in search_block(*index, _matrix(q["embedding"]), q_uid, model, radius, k):
                    found.append((np.full(len(c), q_uid[i]), np.full(len(c), q_ids[i]), index[3][c], index[4][c], s))
                cols = [np.concatenate(f) for f in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_uid", "query_id", "vec_id", "uid", "score"])

    ordered = indexed.unionByName(queries).repartition(blocks, "block").sortWithinPartitions("block", "asked")
    found = ordered.mapInArrow(search, "query_uid long, query_id long, vec_id long, uid long, score double")
    found = found.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_uid ORDER BY score DESC, vec_id, uid)")).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", F.when(F.col("vec_id") != _NULL_ID, F.col("vec_id")).alias("vec_id"), "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)
