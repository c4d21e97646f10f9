"""Mixing sources to target weights by a low-discrepancy schedule.

The schedule has S slots of one block each. Slot s takes the golden-ratio lattice point (s * g mod S) / S, with g the
integer nearest to S / phi that shares no factor with S, and maps it through the cumulative block counts of the
sources; as the lattice visits every multiple of 1 / S once, each source gets exactly the slots that its target needs,
spread evenly over the schedule. The slots of a source are ranked, and rank r takes block r of that source's shuffled
words, epoch after epoch. All of it is DataFrame operations: slots are enumerated from the source side by the inverse
of g, so nothing is broadcast or collected but S and g.

Defined results: null text has size 0; sources stand in the order of their code points with null last; a source
without words has target 0; documents without words are in the result with taken 0; repeated rows are separate
documents; null doc_ids shuffle by their other columns; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.session import shuffle_partitions, stored, table

#: Words of a block, weights that repeat over the sources, and how often the mix may use a document.
BLOCK, WEIGHTS, EPOCHS = 1024, (5, 2, 1), 3
#: Slots that one row is expanded into, and slots of a rank bucket.
EXPAND, RANK_SLOTS = 4_096, 65_536
#: Columns that order the documents of a source, and columns that tell the uses of a document apart.
ORDER, USE = ("key", "doc_id", "size", "tie", "uid"), ("__part", "__uid", "__k")
#: Parts of the schedule that a shuffle partition takes, and entries of the table of parts by source that is broadcast (about 150 bytes each).
PARTS, SPANS = 2, 400_000
SPACE_RUN = r"[\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text: starts of words, counted as spaces of the trimmed, squeezed text."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " "))
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "))) + 1).cast("long")


def first_words(text, n) -> F.Column:
    """text up to the end of its n-th word (n of 1 to its number of words)."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")


def shuffle_key() -> F.Column:
    """60 bits that shuffle the documents (doc_id, text)."""
    nameless = F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))  # so that rows without a doc_id do not share a key
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), nameless)).cast("binary")), 1, 15), 16, 10).cast("long")


def text_tie() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def sized(docs: DataFrame) -> DataFrame:
    """uid, doc_id, source, size, key (60 bits that shuffle the documents), tie (of the text)."""
    return docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), shuffle_key().alias("key"), text_tie().alias("tie"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source, ord, source_size, target, want (whole words).

    Sources at their limit are a prefix in the order of limit over weight, so the level that the others share is found
    by running sums over the sources (one small row each).
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("ord"), F.lit(len(weights))) + 1).cast("int"))
    sources = sources.selectExpr("source", "source_size", "row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord").withColumn("weight", weight.cast("long"))
    sources = sources.withColumn("ratio", F.lit(epochs) * F.col("source_size") / F.col("weight"))
    order = "OVER (ORDER BY ratio, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sources = sources.selectExpr("*", "sum(source_size) OVER () AS total", "sum(weight) OVER () AS weights",
                                 f"coalesce(sum({int(epochs)} * source_size) {order}, 0) AS before_size", f"coalesce(sum(weight) {order}, 0) AS before_weight")
    # the first source that holds its share of what is left sets the level; from it on, none is above its limit
    sources = sources.withColumn("fits", F.col("weight") * (F.col("total") - F.col("before_size")) <= F.lit(epochs) * F.col("source_size") * (F.col("weights") - F.col("before_weight")))
    sources = sources.selectExpr("*", "min(CASE WHEN fits THEN struct(ratio, ord, total - before_size AS rest, weights - before_weight AS share) END) OVER () AS level")
    free = (F.col("level").isNotNull()) & (F.struct("ratio", "ord") >= F.struct("level.ratio", "level.ord"))
    target = F.when(free, (F.col("weight") * F.col("level.rest")).cast("double") / F.col("level.share")).otherwise((F.lit(epochs) * F.col("source_size")).cast("double"))
    return sources.select("source", "ord", "source_size", target.alias("target")).withColumn("want", F.floor(F.col("target") + 0.5).cast("long"))


def lattice(slots: int) -> tuple[int, int]:
    """(g, inverse of g) modulo the number of slots: g next to slots / golden ratio, without a common factor."""
    if slots <= 2:
        return 1 % max(slots, 1), 1 % max(slots, 1)
    near = round(slots * (math.sqrt(5) - 1) / 2)
    for d in range(slots):
        for g in (near + d, near - d):
            if 0 < g < slots and math.gcd(g, slots) == 1:
                return g, pow(g, -1, slots)
    raise AssertionError("1 has no common factor with any number")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, ord, rank, epoch, block, limit: which block of which source fills each slot; limit cuts the last one.

    sources: of targets(), stored.
    """
    blocks = sources.filter("want > 0").selectExpr(
        "ord", "source_size", "want", f"cast(ceil(source_size / {block}) AS long) AS per_epoch", "want div source_size AS full", "want % source_size AS rest")
    blocks = blocks.selectExpr("*", f"full * per_epoch + cast(ceil(rest / {block}) AS long) AS slots", f"CASE WHEN rest % {block} = 0 THEN NULL ELSE rest % {block} END AS cut")
    blocks = blocks.selectExpr("*", "sum(slots) OVER (ORDER BY ord) - slots AS first")
    total = blocks.agg(F.sum("slots")).first()[0] or 0
    g, back = lattice(int(total))
    points = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {EXPAND}")))).repartition("ord", "part")
    points = points.withColumn("point", F.explode(F.sequence(F.col("first") + F.col("part") * EXPAND, F.col("first") + F.least(F.col("slots"), (F.col("part") + 1) * EXPAND) - 1)))
    # the product of two longs needs 38 digits
    points = points.withColumn("slot", F.expr(f"cast((cast(point AS decimal(19,0)) * cast({back} AS decimal(19,0))) % cast({max(1, int(total))} AS decimal(19,0)) AS long)"))
    points = points.withColumn("bucket", F.expr(f"slot div {RANK_SLOTS}"))
    before = points.groupBy("ord", "bucket").count().selectExpr("ord", "bucket", "sum(count) OVER (PARTITION BY ord ORDER BY bucket) - count AS before")
    # Spark takes exploded rows for as few as they came from, so merge joins are asked for
    ranked = points.join(before.hint("merge"), ["ord", "bucket"]).withColumn("rank", F.expr("row_number() OVER (PARTITION BY ord, bucket ORDER BY slot) - 1 + before"))
    last = (F.col("rank") == F.col("slots") - 1) & F.col("cut").isNotNull()
    return ranked.select("slot", "ord", "rank", F.expr("rank div per_epoch").alias("epoch"), F.expr("rank % per_epoch").alias("block"), F.when(last, F.col("cut")).alias("limit"))


def laid_out(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """sizes with ord and start: where each document begins in its source's shuffled words.

    Shuffle keys are uniform, so their high bits cut a source of any size into buckets: about as many as the root of
    the rows, so that neither a bucket nor the list of a source's buckets grows faster than that root.
    """
    bits = math.ceil(math.log2(max(1, sizes.count())) / 2)
    joined = sizes.join(sources.select(F.col("source").alias("s"), "ord", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    joined = joined.withColumn("bucket", F.shiftright("key", 60 - bits))
    before = joined.groupBy("ord", "bucket").agg(F.sum("size").alias("words")).selectExpr("ord", "bucket", "sum(words) OVER (PARTITION BY ord ORDER BY bucket) - words AS before")
    inside = "sum(size) OVER (PARTITION BY ord, bucket ORDER BY key, doc_id, size, tie, uid ROWS UNBOUNDED PRECEDING) - size"
    return joined.withColumn("inside", F.expr(inside)).join(before, ["ord", "bucket"]).withColumn("start", F.col("before") + F.col("inside")).drop("bucket", "before", "inside")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """uid, doc_id, size, source_size, target, taken, partial, start, slots: words the mix takes of each document.

    taken counts repeats; partial is what remains of it after whole uses, always the document's first words. Use k of a
    document begins in slot slots[k] of the schedule, behind documents of smaller start.
    """
    return _mixed(docs, weights, epochs, block).select("uid", "doc_id", "size", "source_size", "target", "taken", "partial", "start", "slots")


def _mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """The columns of mix(), source and those of ORDER."""
    sizes = stored(sized(docs), "sizes")
    sources = stored(targets(sizes, weights, epochs), "sources")
    placed = stored(laid_out(sizes, sources), "placed")
    uses = schedule(sources, block).groupBy("ord", "block").agg(F.count(F.when(F.col("limit").isNull(), 1)).alias("whole"), F.coalesce(F.max("limit"), F.lit(0)).alias("cut"), F.sort_array(F.collect_list("slot")).alias("slots"))
    pieces = placed.filter("size > 0").select("uid", "ord", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    pieces = pieces.selectExpr("uid", "ord", "block", f"greatest(start, block * {block}) - block * {block} AS a", f"least(start + size, (block + 1) * {block}) - block * {block} AS b")
    taken = pieces.join(uses.hint("merge"), ["ord", "block"]).groupBy("uid").agg(F.sum(F.expr("whole * (b - a) + greatest(0, least(b, cut) - a)")).alias("taken"), F.min(F.struct("block", "slots")).alias("first"))
    out = placed.join(taken, "uid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.select("source", *ORDER, "source_size", "target", "taken", F.when(F.col("size") > 0, F.expr("taken % size")).otherwise(0).alias("partial"), "start", F.coalesce("first.slots", F.array().cast("array<long>")).alias("slots"))


def _parts_by_order(rows: DataFrame, uses: DataFrame, parts: int) -> DataFrame:
    """rows (with __uid) once for each use (__k) that the document has, with its part (__part), found where the rows are read.

    Within a source and a use, slots never fall as the order of the documents rises. So the first and the last document
    of each part hold between them all that belong to it; besides these, only rows without words can lie there.
    """
    shift = 60 - max(0, parts.bit_length() - 4)  # ranges of keys: fewer than parts, so that few parts reach into more than two
    at = F.struct(*ORDER)
    spans = uses.groupBy("source", "k", "part").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    spans = spans.withColumn("range", F.explode(F.sequence(F.shiftright("first.key", shift), F.shiftright("last.key", shift))))
    spans = stored(spans.groupBy(F.col("source").alias("__source"), F.col("range").alias("__range")).agg(F.collect_list(F.struct("k", "part", "first", "last")).alias("__spans")), "spans")
    # keys are rarely equal; the rest of the order, which reads the text, is made up only where they are
    rest = F.struct(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("size"), text_tie().alias("tie"), F.col("__uid").alias("uid"))
    others = lambda c: F.struct(*[c[name].alias(name) for name in ORDER[1:]])
    key = F.col("__key")
    within = lambda s: (
        ((s["first"]["key"] < key) | ((s["first"]["key"] == key) & (others(s["first"]) <= rest)))
        & ((s["last"]["key"] > key) | ((s["last"]["key"] == key) & (others(s["last"]) >= rest))))
    found = F.transform(F.filter("__spans", within), lambda s: F.struct(s["k"].alias("__k"), s["part"].alias("__part")))
    keyed = rows.withColumn("__key", shuffle_key())
    joined = keyed.join(F.broadcast(spans), F.col("source").cast("string").eqNullSafe(F.col("__source")) & (F.shiftright("__key", shift) == F.col("__range")))
    return joined.select(*rows.columns, F.inline(found))


def _parts_by_row(rows: DataFrame, uses: DataFrame) -> DataFrame:
    """The same by a join on the row's number, which moves the texts once more."""
    of = uses.groupBy(F.col("uid").alias("__uid")).agg(F.collect_list(F.struct(F.col("k").alias("__k"), F.col("part").alias("__part"))).alias("__parts"))
    return rows.join(of, "__uid").select(*rows.columns, F.inline("__parts"))


def scheduled(docs: DataFrame, columns: tuple[str, ...], use: str, block: int = BLOCK, most: int = SPANS) -> DataFrame:
    """columns of docs in the order of the schedule: a row for every use of a document, with its words in use (0: all).

    docs: a table of files, for it is read again; columns are among its own and have doc_id, text and source. Texts move
    once, to the part of the schedule where they are used, and meet what is to be done with them there. Where sources
    and shuffle partitions are so many that the table of their parts would have more than most entries, they move twice.
    """
    taken = stored(_mixed(docs.select("doc_id", "text", "source"), block=block).filter("taken > 0").drop("source_size", "target"), "taken")
    whole = F.array_repeat(F.lit(0).cast("long"), F.expr("cast(taken div size AS int)"))
    lengths = F.concat(whole, F.when(F.col("partial") > 0, F.array("partial")).otherwise(F.array().cast("array<long>")))
    uses = taken.select("source", *ORDER, "start", "slots", F.posexplode(lengths).alias("k", "use")).withColumn("slot", F.element_at("slots", F.col("k") + 1)).drop("slots")
    last, sources = uses.agg(F.max("slot")).first()[0] or 0, taken.select("source").distinct().count()
    partitions = shuffle_partitions(docs.sparkSession)
    fit = (most // max(1, sources) - EPOCHS - 1) // 2  # parts: a source has an entry for each, one more for each use, and half as many where ranges of keys meet
    parts = min(PARTS * partitions, fit) if fit >= partitions else PARTS * partitions
    uses = uses.withColumn("part", F.expr(f"cast(slot * {parts} div {last + 1} AS int)"))
    rows = docs.select(*columns, F.monotonically_increasing_id().alias("__uid"))
    rows = _parts_by_order(rows, uses, parts) if fit >= partitions else _parts_by_row(rows, uses)
    told = uses.select(F.col("uid").alias("__uid"), F.col("k").alias("__k"), F.col("part").alias("__part"), F.col("use").alias("__use"), F.col("slot").alias("__slot"), F.col("start").alias("__start"))
    both = rows.withColumn("__sent", F.lit(1)).unionByName(told, allowMissingColumns=True).repartitionByRange("__part")
    same = Window.partitionBy(*USE)
    both = both.select(*columns, "__uid", F.col("__sent").alias("__row"), *[F.max(c).over(same).alias(c) for c in ("__sent", "__use", "__slot", "__start")])
    met = F.when(F.col("__sent").isNull(), F.raise_error(F.lit("a use of a document has not met its text"))).otherwise(F.col("__row").isNotNull() & F.col("__slot").isNotNull())
    return both.filter(met).sortWithinPartitions("__slot", "__start", "__uid").select(*columns, F.col("__use").alias(use))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS key
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS ord FROM s0),
s2 AS (SELECT *, CASE ord % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s1),
-- the level at which the free sources share what the full ones leave: tried with every source's own limit
lv AS (
  SELECT a.ord, a.weight, a.source_size,
         (SELECT sum(source_size) FROM s2) - coalesce(sum(3 * b.source_size) FILTER (b.source_size * a.weight < a.source_size * b.weight OR (b.source_size * a.weight = a.source_size * b.weight AND b.ord < a.ord)), 0) AS rest,
         (SELECT sum(weight) FROM s2) - coalesce(sum(b.weight) FILTER (b.source_size * a.weight < a.source_size * b.weight OR (b.source_size * a.weight = a.source_size * b.weight AND b.ord < a.ord)), 0) AS share
  FROM s2 a, s2 b GROUP BY ALL),
level AS (SELECT * FROM lv WHERE weight * rest <= 3 * source_size * share ORDER BY 3.0 * source_size / weight, ord LIMIT 1),
s3 AS (
  SELECT s2.*, CASE WHEN s2.source_size * l.weight > l.source_size * s2.weight OR (s2.source_size * l.weight = l.source_size * s2.weight AND s2.ord >= l.ord)
                    THEN (s2.weight * l.rest)::DOUBLE / l.share ELSE (3 * s2.source_size)::DOUBLE END AS target
  FROM s2 LEFT JOIN level l ON true),
s4 AS (SELECT *, floor(target + 0.5)::BIGINT AS want FROM s3),
p AS (
  SELECT d.doc_id, d.size, s.source_size::BIGINT AS source_size, s.target, s.want,
         sum(d.size) OVER (PARTITION BY s.ord ORDER BY d.key, d.doc_id, d.size, d.rid ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN s4 s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE ((want // source_size) * size + greatest(0, least(size, want % source_size - start)))::BIGINT END AS taken
FROM p
"""
