"""Stupid-backoff scores (Brants et al., 2007) from n-gram counts over all documents.

Three joins in one pattern, all partitioned by hash. Documents are dealt into chunks of bounded size. Every chunk sends
its distinct n-grams (orders 1 to 3) with their counts to the count tables, which are partitioned by n-gram hash; a
partition sums the counts of all chunks; every chunk gets the sums of its own n-grams back, joined by chunk and hash
partition, looks up its exploded n-grams in them and sums log scores per document. N-grams travel as sorted, delta-coded
blocks, one for each chunk and hash partition, so a chunk's repeats are combined before the shuffle and a frequent
n-gram is one entry per chunk.

Score of a word after at most two words: the ratio of counts at the longest order whose n-gram occurs MIN_COUNT times in
the corpus, times BACKOFF for each order given up; at order 1, the word's count over all words. Log scores are rounded
to millionths of a nat and added as integers, so sums do not depend on order.

Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case. N-grams are told apart by hashes of at least 50 bits plus those that
choose the partition; with 10**9 distinct n-grams, few share one.

Defined results: null text, and text without words, has 0 tokens, score 0 and a null mean; repeated rows are separate
documents and count each; null doc_ids are carried; texts of any length are read whole; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.session import fixed, ship, shuffle_partitions, stored, table

BACKOFF, MIN_COUNT = 0.4, 2
#: Bytes of text of a chunk, text that one hash partition counts the n-grams of, and of a piece that is split at once.
CHUNK, PARTITION, SLICE = 3_000_000, 8_000_000, 1 << 20
_REST = np.uint64((1 << 50) - 1)
_WORDS_KEPT = 250_000


class _Hashes(dict):
    """Hash of each word, remembered for the words last seen."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= _WORDS_KEPT:
            self.clear()
        h = self[word] = xxh64_intdigest(word, 1)
        return h


_HASHES = _Hashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    out, text, k = [], text or b"", 0
    while k < len(text):
        end = k + SLICE
        if end < len(text):
            while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
                end += 1
        words = text[k:end].lower().split()
        out.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
        k = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """The n-grams of some documents: at each word those of orders 1, 2 and 3 that end there, as numbers of keys."""

    def __init__(self, texts: list[bytes | None], parts: int):
        hashes = [word_hashes(t) for t in texts]
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        one = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        n = len(one)
        starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(n) - np.repeat(starts, self.sizes)  # of each word in its document
        with np.errstate(over="ignore"):
            two = _mixed(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) if n > 1 else np.zeros(0, np.uint64)
            three = _mixed(two[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + one[2:] + np.uint64(1)) if n > 2 else np.zeros(0, np.uint64)
        keys = [one, two[self.place[1:] > 0], three[self.place[2:] > 1]]
        every = np.concatenate(keys)
        # sorted by partition, then by what is left of the hash
        part, rest = every % np.uint64(parts), (every // np.uint64(parts)) & _REST
        packed = (part << np.uint64(50)) | rest if parts <= 1 << 14 else None
        if packed is not None:
            found, inverse, self.counts = np.unique(packed, return_inverse=True, return_counts=True)
            self.part, self.rest = (found >> np.uint64(50)).astype(np.int64), found & _REST
        else:
            order = np.lexsort((rest, part))
            new = np.concatenate(([True], (np.diff(part[order]) != 0) | (np.diff(rest[order]) != 0))) if len(order) else np.zeros(0, bool)
            inverse = np.empty(len(order), np.int64)
            inverse[order] = np.cumsum(new) - 1
            self.part, self.rest, self.counts = part[order][new].astype(np.int64), rest[order][new], np.bincount(inverse)
        self.one = inverse[:n]
        self.two = np.full(n, -1)
        self.two[1:][self.place[1:] > 0] = inverse[n : n + len(keys[1])]
        self.three = np.full(n, -1)
        self.three[2:][self.place[2:] > 1] = inverse[n + len(keys[1]) :]

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(partition, coded keys, coded counts)."""
        edges = np.flatnonzero(np.diff(self.part, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if len(self.part) else ():
            yield int(self.part[a]), code_keys(self.rest[a:b]), code_counts(self.counts[a:b])

    def scores(self, total: dict[int, np.ndarray], words: int) -> np.ndarray:
        """Sum of log scores of each document in millionths; total has the corpus counts by partition."""
        n = len(self.place)
        count = np.concatenate([total[p] for p in np.unique(self.part).tolist()]).astype(np.float64) if n else np.zeros(0)
        of = lambda at: np.where(at >= 0, count[at], 0.0) if n else np.zeros(0)
        one, two, three = of(self.one), of(self.two), of(self.three)
        before = lambda x: np.concatenate(([1.0], x[:-1])) if n else x
        by3, by2 = three >= MIN_COUNT, two >= MIN_COUNT
        top = np.where(by3, three, np.where(by2, two, one))
        low = np.where(by3, before(two), np.where(by2, before(one), float(max(1, words))))
        given_up = np.minimum(self.place, 2) - np.where(by3, 2, np.where(by2, 1, 0))
        micro = np.rint((np.log(top) - np.log(np.maximum(low, 1.0)) + given_up * math.log(BACKOFF)) * 1e6).astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(micro)))
        ends = np.cumsum(self.sizes)
        return sums[ends] - sums[ends - self.sizes]


def code_keys(keys: np.ndarray) -> bytes:
    """Differences of sorted keys in as many bytes as the largest needs; the first byte tells how many."""
    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def read_keys(data: bytes) -> np.ndarray:
    width = data[0]
    step = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    step[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64)


def code_counts(counts: np.ndarray) -> bytes:
    kind = "<u4" if not len(counts) or int(counts.max()) < 1 << 32 else "<u8"
    raw = counts.astype(kind).tobytes()
    return len(raw).to_bytes(8, "little") + kind[2:].encode() + pa.compress(raw, codec="zstd", asbytes=True)


def read_counts(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[9:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{data[8:9].decode()}").astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """(chunk, doc_ids, texts) of the documents of a partition in their order."""
    first, n, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py())
            size += len(texts[-1] or b"")
            if size >= CHUNK:
                yield first + n, ids, texts
                n, ids, texts, size = n + 1, [], [], 0
    if ids:
        yield first + n, ids, texts


def _count(t: pa.Table) -> pa.Table:
    """Sums over all chunks of one hash partition, back in each chunk's own order."""
    keys = [read_keys(k) for k in t["keys"].to_pylist()]
    counts = np.concatenate([read_counts(c) for c in t["counts"].to_pylist()])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(inverse, weights=counts).astype(np.int64)[inverse]
    ends = np.cumsum([len(k) for k in keys])
    back = [code_counts(s) for s in np.split(sums, ends[:-1])]
    return pa.table({"chunk": t["chunk"], "part": t["part"], "counts": pa.array(back, pa.binary())})


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_micro (sum of log scores in millionths) and mean_log of every document.

    docs is read twice and its documents are dealt alike both times, so what is not a table of files is written first.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = fixed(docs.select("doc_id", "text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), math.ceil(size / PARTITION))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts in _chunks(batches):
            c = Chunk(texts, parts)
            found = list(c.blocks())
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(found), pa.int64()), *(pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary())))], names=["chunk", "part", "keys", "counts"])

    sent = rows.mapInArrow(send, "chunk long, part long, keys binary, counts binary")
    back = stored(sent.repartition(parts, "part").groupBy("part").applyInArrow(_count, "chunk long, part long, counts binary"), "ngram-counts")
    total = rows.mapInArrow(_word_counts, "words long").agg(F.sum("words")).first()[0] or 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["chunk", "doc_id", "text"])

    def join(text: pa.Table, counts: pa.Table) -> pa.Table:
        c = Chunk(text["text"].to_pylist(), parts)
        corpus = {p: read_counts(x) for p, x in zip(counts["part"].to_pylist(), counts["counts"].to_pylist(), strict=True)}
        return pa.table({"doc_id": text["doc_id"], "n_tokens": c.sizes, "log_micro": c.scores(corpus, total)})

    dealt = rows.mapInArrow(deal, "chunk long, doc_id long, text binary")
    out = dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(join, "doc_id long, n_tokens long, log_micro long")
    return out.withColumn("mean_log", F.when(F.col("n_tokens") > 0, F.col("log_micro") / 1e6 / F.col("n_tokens")))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(len((t.as_py() or b"").split()) for t in batch.column(1))], pa.int64())], names=["words"])


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "log_micro", F.round("mean_log", 9).alias("mean_log"))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
t AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT rid, i, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM t WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (
  SELECT g.*, count(*) OVER (PARTITION BY w) AS c1, count(*) OVER (PARTITION BY v, w) AS c2, count(*) OVER (PARTITION BY u, v, w) AS c3, count(*) OVER () AS n FROM g),
b AS (
  SELECT *, lag(c1) OVER o AS b1, lag(c2) OVER o AS b2 FROM c WINDOW o AS (PARTITION BY rid ORDER BY i)),
s AS (
  SELECT rid, round_even((CASE WHEN i > 2 AND c3 >= 2 THEN ln(c3) - ln(b2) WHEN i > 1 AND c2 >= 2 THEN ln(c2) - ln(b1) ELSE ln(c1) - ln(n) END
    + (least(i - 1, 2) - CASE WHEN i > 2 AND c3 >= 2 THEN 2 WHEN i > 1 AND c2 >= 2 THEN 1 ELSE 0 END) * ln(0.4::DOUBLE)) * 1e6::DOUBLE, 0)::BIGINT AS micro
  FROM b)
SELECT d.doc_id, len(d.ws) AS n_tokens, coalesce(sum(s.micro), 0)::BIGINT AS log_micro, round(sum(s.micro)::BIGINT / 1e6::DOUBLE / len(d.ws), 9) AS mean_log
FROM d LEFT JOIN s ON d.rid = s.rid GROUP BY d.rid, d.doc_id, d.ws
"""
