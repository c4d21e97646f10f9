"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text becomes a run of lower-case letters with single spaces between words; n-grams of the given orders may begin or end
with such a space and hash to a fixed number of buckets. Counts are gathered over a sample of the labelled rows of
stated size (whole texts), smoothed, and turned into a languages x buckets matrix of log probabilities, which is
broadcast; batches are scored in numpy by gathering the columns of the n-grams that occur.

Defined results: null text, or text without a letter, is `und` with score 0, as is everything if nothing was learned;
null doc_ids are never learned from and not held out; repeated rows are separate; ties go to the first language in
code-point order; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.session import ship, table

ORDERS, BUCKET_BITS, SMOOTHING = (2, 3), 16, 0.5
#: Labelled documents of a language that are learned from (about).
SAMPLE_DOCS = 3_000
UNKNOWN = "und"
#: Characters that are scored at a time.
SLICE = 1 << 20
#: Numbers of the matrix that are gathered at a time.
GATHERED = 1 << 20
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, or 0 if it is no letter."""
    if not _TABLE:
        t = np.zeros(0x110000, dtype=np.uint32)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                t[k] = ord(low) if len(low) == 1 else k
        _TABLE.append(t)
    return _TABLE[0]


def _buckets(text: str, before: str = "") -> np.ndarray:
    """Buckets of all n-grams of one piece of text; empty if it has no letter. before: what stands before a later piece."""
    c = _letters()[np.frombuffer((before + text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    c = np.concatenate((np.zeros(1 if not before else 0, np.uint32), c, np.zeros(1, np.uint32)))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    out = []
    for n in ORDERS:
        m = len(c) - n + 1
        if m < 1:
            continue
        h = np.full(m, 0x9E3779B1 * n & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            h = (h ^ c[k : k + m]) * np.uint32(0x85EBCA6B + 2 * k)
            h ^= h >> np.uint32(15)
        inside = np.ones(m, bool)
        for k in range(1, n - 1):
            inside &= c[k : k + m] != 0
        h = (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS)
        out.append(h[inside])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a whole text, in pieces of bounded size that end between words where they can."""
    text, k = text or "", 0
    while k < len(text):
        end = k + SLICE
        if end < len(text):
            cut = text.rfind(" ", k + 1, end)
            end = cut if cut > 0 else end
        piece = _buckets(text[k:end])
        if len(piece):
            yield piece
        k = end


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities: a row per language, a column per bucket and last the log prior).

    labelled: doc_id, text, lang. Every language is learned; only language x bucket sums come to the driver, and the matrix has 256 KB a language.
    """
    ship(labelled.sparkSession)
    labelled = labelled.filter("lang IS NOT NULL AND doc_id IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return [], np.zeros((0, (1 << BUCKET_BITS) + 1), np.float32)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    below = F.create_map(*[F.lit(x) for n in names if sizes[n] > SAMPLE_DOCS for x in (n, int(SAMPLE_DOCS / sizes[n] * (1 << 30)))]) if max(sizes.values()) > SAMPLE_DOCS else None
    keep = F.lit(True) if below is None else F.coalesce(draw < below[F.col("lang")], F.lit(True))
    number = {n: k for k, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[int, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for b in buckets(text.as_py()):
                    s = sums.setdefault(number[lang], np.zeros(1 << BUCKET_BITS, np.int64))
                    s += np.bincount(b, minlength=1 << BUCKET_BITS)
            for k, s in sums.items():
                at = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["k", "bucket", "n"])

    gathered = labelled.filter(keep).select("lang", "text").mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    k, bucket, n = (np.asarray(gathered[c]) for c in ("k", "bucket", "n"))
    order = np.argsort(k, kind="stable")
    ends = np.searchsorted(k[order], np.arange(len(names) + 1))
    matrix = np.empty((len(names), (1 << BUCKET_BITS) + 1), np.float32)
    for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        counts = np.full(1 << BUCKET_BITS, SMOOTHING)
        counts[bucket[order[a:b]]] += n[order[a:b]]
        matrix[row, :-1] = np.log(counts) - np.log(counts.sum())
    matrix[:, -1] = np.log(np.array([sizes[x] for x in names], np.float64) / sum(sizes.values()))
    return names, matrix


def posteriors(texts: Iterable[str | None], matrix: np.ndarray) -> np.ndarray:
    """A row of probabilities of each language for every text; a row of zeros without letters or languages.

    matrix: a row per bucket and last the log priors, a column per language. N-grams of many texts are scored at once:
    their rows of the matrix are gathered and summed by text.
    """
    texts = list(texts)
    total, seen = np.zeros((len(texts), matrix.shape[1])), np.zeros(len(texts), bool)
    at, pieces, size = [], [], 0
    if not matrix.shape[1]:
        return total

    def add() -> None:
        if pieces:
            starts = np.cumsum([0, *map(len, pieces[:-1])])
            np.add.at(total, at, np.add.reduceat(matrix[np.concatenate(pieces)], starts, axis=0, dtype=np.float64))

    for k, text in enumerate(texts):
        for b in buckets(text):
            seen[k] = True
            at.append(k)
            pieces.append(b)
            size += len(b)
            if size * matrix.shape[1] >= GATHERED:
                add()
                at, pieces, size = [], [], 0
    add()
    total += matrix[-1]
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return np.where(seen[:, None], p / p.sum(axis=1, keepdims=True), 0.0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *keep: str) -> DataFrame:
    """The columns named in keep, then lang_pred and score."""
    spark = docs.sparkSession
    ship(spark)
    names, matrix = model
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(matrix.T))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = posteriors((t.as_py() for t in batch.column(0)), shared.value)
            best = p.argmax(axis=1) if names else np.zeros(len(p), np.int64)
            most = p.max(axis=1) if names else np.zeros(len(p))
            lang = [names[k] if x > 0 else UNKNOWN for k, x in zip(best.tolist(), most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(most)], names=[*keep, "lang_pred", "score"])

    kept = docs.select(F.col("text").cast("string").alias("__text"), *[F.col(f"`{k}`") for k in keep])
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]]
    return kept.mapInArrow(score, ", ".join([*schema, "lang_pred string", "score double"]))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(learnable(docs)), "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
