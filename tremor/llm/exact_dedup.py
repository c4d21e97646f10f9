"""Exact de-duplication through a minimal perfect hash over historical distinct digests.

Digests (SHA-256 of the text without ASCII white space) are dealt into shards by hash. For each shard a minimal
perfect hash is built level by level: a key that is alone in its cell of a level settles there, the others go on to
the next level, and the rank of a settled cell is the key's slot. Slots hold the full digest and the locator of the
row that stays, so a lookup compares all 32 bytes before it reports a member.

Defined results: null text counts as empty; all empty and all-white texts are equal to each other; a null doc_id is
the last in order; of wholly equal rows exactly one stays; an empty table gives an empty result; columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.session import ship, shuffle_partitions, stored, table

SPACE = " \t\n\x0b\x0c\r"
#: Distinct digests that a shard of the index holds on average (about 2.5 MB a shard).
SHARD_KEYS = 50_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)
_INDEX = "shard long, slice int, cells binary, levels binary, digests binary, keep_id binary, keep_null binary, keep_uid binary, size binary"
_FOUND = "uid long, doc_id long, n_points long, digest binary, member boolean, keep_id long, keep_uid long, group_size long"


def digested(docs: DataFrame) -> DataFrame:
    """uid, doc_id, n_points (code points of the original text), digest. The text itself goes no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("n_points"),
        F.unhex(F.sha2(F.translate(text, SPACE, "").cast("binary"), 256)).alias("digest"),
    )


def winners(rows: DataFrame) -> DataFrame:
    """One row per distinct digest: who stays, and how many rows there are. Combined before the shuffle."""
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no"), "doc_id", "uid")).alias("best")
    return rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "group_size")


def _cell(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
    """Cell of each key (rows of four 64-bit words) in a level."""
    with np.errstate(over="ignore"):
        x = keys[:, level % 4] ^ (np.uint64(level + 1) * _MIX[0])
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        x ^= x >> np.uint64(31)
    return (x % np.uint64(cells)).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells of each level, bits of all levels, slot of each key) for distinct keys."""
    sizes, bits, slot = [], [], np.full(len(keys), -1, dtype=np.int64)
    left, start, level = np.arange(len(keys)), 0, 0
    while len(left):
        cells = max(64, 2 * len(left))
        at = _cell(keys[left], level, cells)
        alone = np.bincount(at, minlength=cells) == 1
        settled = alone[at]
        slot[left[settled]] = start + np.cumsum(alone)[at[settled]] - 1
        start += int(alone.sum())
        sizes.append(cells)
        bits.append(alone)
        left, level = left[~settled], level + 1
    return np.array(sizes, dtype=np.int64), np.concatenate(bits) if bits else np.zeros(0, bool), slot


def probe_mph(sizes: np.ndarray, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Slot of each key; for a key that was not built in, any slot or -1."""
    slot, rank = np.full(len(keys), -1, dtype=np.int64), np.cumsum(bits) - 1
    left, offset = np.arange(len(keys)), 0
    for level, cells in enumerate(sizes):
        if not len(left):
            break
        at = offset + _cell(keys[left], level, int(cells))
        hit = bits[at]
        slot[left[hit]] = rank[at[hit]]
        left, offset = left[~hit], offset + int(cells)
    return slot


def _words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Digests as rows of four 64-bit words."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype="<u8").reshape(-1, 4)


def _build(t: pa.Table) -> pa.Table:
    keys = _words(t["digest"])
    sizes, bits, slot = build_mph(keys)
    order = np.argsort(slot, kind="stable")
    null = np.asarray(t["keep_id"].is_null())
    keep = np.asarray(t["keep_id"].fill_null(0))
    row = {
        "shard": t["shard"][0].as_py(), "slice": 0, "cells": sizes.tobytes(), "levels": np.packbits(bits).tobytes(), "digests": keys[order].tobytes(), "keep_id": keep[order].astype("<i8").tobytes(),
        "keep_null": null[order].astype("u1").tobytes(), "keep_uid": np.asarray(t["keep_uid"])[order].astype("<i8").tobytes(), "size": np.asarray(t["group_size"])[order].astype("<i8").tobytes(),
    }
    return pa.table({k: pa.array([v], type=pa.binary() if isinstance(v, bytes) else pa.int64() if k == "shard" else pa.int32()) for k, v in row.items()})


def _lookup(rows: pa.Table, index: pa.Table) -> pa.Table:
    n = rows.num_rows
    member, keep, no, uid, size = np.zeros(n, bool), np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n and index.num_rows:
        get = lambda k, kind: np.frombuffer(index[k][0].as_py(), dtype=kind)
        keys, sizes = _words(rows["digest"]), get("cells", "<i8")
        slot = probe_mph(sizes, np.unpackbits(get("levels", "u1"), count=int(sizes.sum())).astype(bool), keys)
        found = np.flatnonzero(slot >= 0)
        same = (get("digests", "<u8").reshape(-1, 4)[slot[found]] == keys[found]).all(axis=1)
        found = found[same]
        at = slot[found]
        member[found] = True
        keep[found], no[found] = get("keep_id", "<i8")[at], get("keep_null", "u1")[at].astype(bool)
        uid[found], size[found] = get("keep_uid", "<i8")[at], get("size", "<i8")[at]
    out = {k: rows[k] for k in ("uid", "doc_id", "n_points", "digest")}
    return pa.table(out | {"member": member, "keep_id": pa.array(keep, mask=no), "keep_uid": uid, "group_size": size})


def lookup(rows: DataFrame, history: DataFrame) -> DataFrame:
    """rows (of digested()) with what the index over history (of winners()) says of each.

    Shards are cut into slices of about the mean partition's rows and the shard's index goes to each of its slices, so
    one digest with a third of all rows spreads over many tasks.
    """
    spark = rows.sparkSession
    ship(spark)
    shards = max(1, math.ceil(history.count() / SHARD_KEYS))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    dealt = rows.select("*", shard)
    total = rows.count()
    cap = max(1, math.ceil(total / max(shards, shuffle_partitions(spark))))
    slices = dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(cap)).cast("int").alias("slices"))
    slices = stored(slices, "slices")
    index = history.select("*", shard).groupBy("shard").applyInArrow(_build, _INDEX)
    index = index.join(slices, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    dealt = dealt.join(slices, "shard").withColumn("slice", F.pmod(F.xxhash64("uid"), F.col("slices")).cast("int")).drop("slices")
    return dealt.groupBy("shard", "slice").cogroup(index.groupBy("shard", "slice")).applyInArrow(_lookup, _FOUND)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256, uid.

    The history is every digest that occurs more than once; nonmembers are alone in their group.
    """
    rows = stored(digested(docs), "digests")
    history = stored(winners(rows).filter("group_size > 1"), "history")
    found = lookup(rows, history)
    return found.select(
        "doc_id",
        F.when(F.col("member"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.when(F.col("member"), F.col("group_size")).otherwise(F.lit(1)).cast("long").alias("group_size"),
        (~F.col("member") | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "uid",
    )


def unseen(docs: DataFrame, history: DataFrame) -> DataFrame:
    """Incremental use: one row (doc_id, text_sha256) per digest of docs that history (of winners()) does not hold."""
    rows = stored(digested(docs), "digests")
    new = lookup(rows, history).filter(~F.col("member"))
    return winners(new.select("uid", "doc_id", "n_points", "digest")).select(F.col("keep_id").alias("doc_id"), F.lower(F.hex("digest")).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("uid")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)
"""
