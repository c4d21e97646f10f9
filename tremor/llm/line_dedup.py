"""Fuzzy line de-duplication: MinHash of character shingles, banding, exact Jaccard verification, union-find.

Equal lines (after trimming ASCII white space) are one node. Every distinct line gets BANDS keys of ROWS minima each;
lines that share a key meet in a bucket, where pairs that are not yet connected are compared by the exact Jaccard
similarity of their shingle sets. A bucket gives a spanning forest of its links, so a bucket of alike lines costs about
one comparison a line; linked() tells how buckets beyond BUCKET lines are divided, so that a hot one is never sorted,
held or paired off in one task. At the least similarity 0.8 a pair shares a key with probability
1 - (1 - 0.8**5)**16 = 0.998. Of each component the first line (smallest doc_id, null last, then row and place) stays.

Defined results: null text has no lines and stays null; blank lines stay and are never linked; lines shorter than a
shingle are one shingle; repeated rows are separate documents, of which the first keeps its lines; null doc_ids come
last; lines of any length are read whole; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import graph
from tremor.session import fixed, ship, shuffle_partitions, small, stored, table

SHINGLE, SIMILARITY, BANDS, ROWS = 8, 0.8, 16, 5
#: Lines of a bucket that are compared in one go, of one whose list of members is compared with other lists, and characters whose minima are taken at a time.
BUCKET, FEW, SLICE = 1024, 64, 1 << 16
#: One node in so many is looked at for hot buckets, and rows among those that make a bucket hot.
LOOK, OFTEN = 64, 32
#: Hot buckets that are told to every task (8 bytes each), and pairs of bucket and node (16 bytes each) in a part.
HOT, PAIRS = 1 << 18, 1 << 21
#: Bytes of shingle sets, and lines and pairs, that a task remembers.
SETS, KNOWN = 48 << 20, 200_000
#: Documents that are split into lines at a time.
ROWS_AT_ONCE = 256
WHITE = " \t\n\x0b\x0c\r"
_rng = np.random.default_rng(20_240)
_MULTIPLY = _rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FURTHER = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def numbered(docs: DataFrame, *keep: str) -> DataFrame:
    """Of uid, doc_id, place, key and line those in keep, of every line that is not blank; lines are trimmed, keys are their MD5."""
    ship(docs.sparkSession)
    schema = ", ".join(f for f in ("uid long", "doc_id long", "place int", "key binary", "line string") if f.split()[0] in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), ROWS_AT_ONCE):
                some = batch.slice(k, ROWS_AT_ONCE)
                lines, place, at = [], [], []
                for row, text in enumerate(some.column(2)):
                    for n, line in enumerate((text.as_py() or b"").split(b"\n")):
                        if line := line.strip():
                            lines.append(line)
                            place.append(n)
                            at.append(row)
                at = pa.array(at, pa.int64())
                made = {"uid": lambda at=at, some=some: some.column(0).take(at), "doc_id": lambda at=at, some=some: some.column(1).take(at), "place": lambda place=place: pa.array(place, pa.int32()), "key": lambda lines=lines: pa.array([hashlib.md5(x).digest() for x in lines], pa.binary()), "line": lambda lines=lines: pa.array(lines, pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_arrays([make() for name, make in made.items() if name in keep], names=[name for name in made if name in keep])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)


def _shingles(points: np.ndarray) -> np.ndarray:
    """64-bit hash of the shingle at each position of a run of code points (positions near its end are cut off)."""
    if len(points) < SHINGLE:
        points = np.concatenate((points, np.full(SHINGLE - len(points), 0xFFFFFFFF, np.uint64)))
    h, width = points, 1
    with np.errstate(over="ignore"):
        while width < SHINGLE:  # the hash of a run of 2n from those of its halves
            h = (h[:-width] * np.uint64(0xBF58476D1CE4E5B9)) ^ h[width:]
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(29)
            width *= 2
    return h


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    h = np.sort(h)
    new = np.empty(len(h), bool)
    new[:1] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def shingle_set(line: str) -> np.ndarray:
    return distinct(_shingles(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.concatenate((a, b))
    both.sort()
    both = np.count_nonzero(both[1:] == both[:-1])
    return both / (len(a) + len(b) - both)


def _minima(lines: list[str], width: int) -> np.ndarray:
    """The BANDS * ROWS minima (columns) of lines of about width characters, longest last; each is one row of a matrix, filled up with its own first shingle."""
    points = np.frombuffer("".join(x.ljust(width, "\0") for x in lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (_shingles(points) >> np.uint64(32)).astype(np.uint32)
    h = np.concatenate((h, np.zeros(SHINGLE - 1, np.uint32))).reshape(len(lines), width)[:, : width - SHINGLE + 1]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) - SHINGLE + 1
    h = np.where(np.arange(h.shape[1]) < np.maximum(sizes, 1)[:, None], h, h[:, :1])
    turned, out = np.empty_like(h), np.empty((BANDS * ROWS, len(lines)), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            np.multiply(h, _MULTIPLY[k], out=turned)
            turned.min(axis=1, out=out[k])
    return out.T


def band_keys(lines: list[str]) -> np.ndarray:
    """A row of BANDS keys for each line."""
    least = np.empty((len(lines), BANDS * ROWS), np.uint32)
    order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
    first = 0
    while first < len(order):
        short, last = len(lines[order[first]]), first + 1
        while last < len(order) and (width := len(lines[order[last]])) <= 1.1 * short + 16 and (last - first + 1) * width <= SLICE:
            last += 1
        group = [lines[i] for i in order[first:last]]
        if len(group[-1]) <= SLICE:
            least[order[first:last]] = _minima(group, max(SHINGLE, len(group[-1])))
        else:  # one line, in pieces that overlap by all but a character of a shingle
            pieces = (group[0][k : k + SLICE] for k in range(0, len(group[0]) - SHINGLE + 1, SLICE - SHINGLE + 1))
            least[order[first]] = np.min([_minima([x], len(x))[0] for x in pieces], axis=0)
        first = last
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(lines), 1))
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = (key ^ least[:, r::ROWS]) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(31)
    return key


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = band_keys(batch.column(1).to_pylist()).view(np.int64).ravel()
        keys = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32), keys)
        yield pa.RecordBatch.from_arrays([batch.column(0), keys], names=["node", "keys"])


def _further(shingle_set):
    """(bucket, node, line) to keys of a hot bucket's members: bands of further minima, which belong to that bucket alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty((len(batch), BANDS), np.uint64)
            for i, (bucket, line) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                h = shingle_set(line)
                with np.errstate(over="ignore"):
                    for b in range(BANDS):
                        key = np.uint64(bucket & 0xFFFFFFFFFFFFFFFF) ^ np.uint64(b + 1)
                        for r in range(ROWS):
                            mixed = (h ^ _FURTHER[b * ROWS + r]) * np.uint64(0xD6E8FEB86659FD93)
                            key = (key ^ (mixed ^ (mixed >> np.uint64(32))).min()) * np.uint64(0x94D049BB133111EB)
                            key ^= key >> np.uint64(31)
                        out[i, b] = key
            keys = pa.ListArray.from_arrays(np.arange(0, out.size + 1, BANDS, dtype=np.int32), out.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(1), keys], names=["node", "keys"])

    return run


def _dealt(parts: int, hot: np.ndarray):
    """(node, keys) to packed pairs of buckets and nodes for each part of the buckets; pairs of hot buckets (sorted) go to a part by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            buckets, nodes = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            is_hot = np.isin(buckets, hot) if len(hot) else np.zeros(len(buckets), bool)
            part = (np.where(is_hot, nodes, buckets).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)
            part = part.astype(np.int64) * 2 + is_hot
            order = np.argsort(part, kind="stable")
            buckets, nodes, part = buckets[order], nodes[order], part[order]
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            of = lambda x: pa.array([x[i:j].tobytes() for i, j in spans], pa.binary())
            first = part[edges[:-1]]
            return pa.RecordBatch.from_arrays([pa.array((first // 2).astype(np.int32)), pa.array(first % 2 == 1), of(buckets), of(nodes)], names=["part", "hot", "buckets", "nodes"])

        for batch in batches:
            keys = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            held.append((keys, np.repeat(nodes, len(keys) // max(1, len(nodes)))))
            size += len(keys)
            if size >= PAIRS // 2:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    return run


_GROUPED = "bucket long, members array<long>, node long, at long"


def _grouped(buckets: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All pairs of a part to its buckets of two members at least: a row with the sorted list of FEW members or less, or rows (node, its place) of more."""
    order = np.argsort(buckets, kind="stable")
    buckets = buckets[order]
    same = buckets[1:] == buckets[:-1]
    inside = np.concatenate((same, [False])) | np.concatenate(([False], same))
    buckets, nodes = buckets[inside], nodes[order[inside]]
    order = np.lexsort((nodes, buckets))
    buckets, nodes = buckets[order], nodes[order]
    edges = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1], [True]))) if len(buckets) else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    few = np.repeat(sizes <= FEW, sizes)
    lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes[sizes <= FEW]))).astype(np.int32), nodes[few])
    none = pa.nulls(len(lists), pa.int64())
    yield pa.RecordBatch.from_arrays([none, lists, none, none], names=["bucket", "members", "node", "at"])
    at = np.arange(len(nodes)) - np.repeat(edges[:-1], sizes)
    yield pa.RecordBatch.from_arrays([pa.array(buckets[~few]), pa.nulls(int((~few).sum()), pa.list_(pa.int64())), pa.array(nodes[~few]), pa.array(at[~few])], names=["bucket", "members", "node", "at"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed pairs, sorted by part, to buckets: those of one part at a time. Rows of hot buckets pass, with place -1."""
    open_, held = None, []

    def grouped() -> Iterator[pa.RecordBatch]:
        if held:
            yield from _grouped(*(np.concatenate([np.frombuffer(h[k], np.int64) for h in held]) for k in (0, 1)))

    for batch in batches:
        for part, hot, buckets, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if hot:
                b, n = np.frombuffer(buckets, np.int64), np.frombuffer(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.nulls(len(b), pa.list_(pa.int64())), pa.array(n), pa.array(np.full(len(b), -1))], names=["bucket", "members", "node", "at"])
                continue
            if part != open_:
                yield from grouped()
                open_, held = part, []
            held.append((buckets, nodes))
    yield from grouped()


class _Links:
    """Links of a spanning forest, over the buckets of one task: what earlier ones connected, or told apart, is not compared again."""

    def __init__(self, similarity: float, shingle_set=shingle_set, known: bool = False):
        """With known, a link is also given where earlier ones connect the two."""
        self.similarity, self.shingle_set, self.known = similarity, shingle_set, known
        self.root: dict[int, int] = {}
        self.sets: dict[int, np.ndarray] = {}
        self.unlike: set[tuple[int, int]] = set()
        self.size = 0

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    def shingles(self, node: int, line: str) -> np.ndarray:
        found = self.sets.get(node)
        if found is None:
            found = self.sets[node] = self.shingle_set(line)
            self.size += found.nbytes
        return found

    def add(self, base: list[tuple[int, str]], query: list[tuple[int, str]], within: bool) -> list[tuple[int, int]]:
        """New links among the pairs (query, base), and with within among those inside base, that are alike."""
        if self.size > SETS or len(self.root) + len(self.unlike) > KNOWN:  # forgetting costs comparisons, no links
            self.sets.clear()
            self.root.clear()
            self.unlike.clear()
            self.size = 0
        out, every = [], base + query
        for k in range(0 if within else len(base), len(every)):
            a = every[k]
            root = self.find(a[0])
            for j in range(min(k, len(base))):
                b = every[j]
                if (other := self.find(b[0])) == root:
                    if self.known:
                        out.append((a[0], b[0]))
                    continue
                pair = (a[0], b[0]) if a[0] < b[0] else (b[0], a[0])
                if pair in self.unlike:
                    continue
                x, y = self.shingles(*a), self.shingles(*b)
                if min(len(x), len(y)) >= self.similarity * max(len(x), len(y)) and jaccard(x, y) >= self.similarity:
                    self.root[root] = other
                    root = self.find(a[0])
                    out.append((a[0], b[0]))
                else:
                    self.unlike.add(pair)
        return out


def _verify(similarity: float, shingle_set=shingle_set, known: bool = False):
    """Buckets in sorted batches, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, now, base, query = _Links(similarity, shingle_set, known), None, [], []

        def written(new: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in new], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            new = []
            for bucket, i, j, is_base, node, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (bucket, i, j) != now:
                    if now is not None:
                        new += links.add(base, query, now[1] == now[2])
                    now, base, query = (bucket, i, j), [], []
                (base if is_base else query).append((node, line))
            yield written(new)
        if now is not None:
            yield written(links.add(base, query, now[1] == now[2]))

    return run


def alike(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between the nodes of lines (node, line): enough to connect all lines that are alike."""
    ship(lines.sparkSession)
    signed = lambda some: some.select("node", "line").mapInArrow(_keys, "node long, keys array<long>")
    return linked(signed(lines), signed(lines.filter(looked_at())), lines, similarity)


def looked_at() -> F.Column:
    """The share of nodes by which hot buckets are found before they are sorted; others are found in their task."""
    return F.pmod(F.xxhash64(F.lit("hot"), "node"), F.lit(LOOK)) == 0


def _divided(keys: DataFrame, some: DataFrame, nodes: int) -> tuple[DataFrame, DataFrame]:
    """(buckets, hot) of (node, keys) of so many nodes; some are the keys of the nodes that looked_at() takes.

    hot (bucket, node) are the members of buckets beyond BUCKET. The largest HOT of those that show among some are dealt
    to many tasks; any other is sorted in the task of its part. Pairs travel packed, in parts of about PAIRS.
    """
    spark = keys.sparkSession
    often = some.select(F.explode("keys").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    hot = np.sort(np.asarray(often.orderBy(F.desc("n"), "bucket").limit(HOT).select("bucket").toArrow()["bucket"]).astype(np.int64))
    parts = max(shuffle_partitions(spark), -(-nodes * BANDS // PAIRS))
    packed = keys.select("node", "keys").mapInArrow(_dealt(parts, hot), "part int, hot boolean, buckets binary, nodes binary")
    runs = packed.repartition(parts, "part").sortWithinPartitions("part").select("part", "hot", "buckets", "nodes")
    buckets = stored(runs.mapInArrow(_runs, _GROUPED), "buckets")
    hot = stored(buckets.filter((F.col("at") == BUCKET) | (F.col("at") == -1)).select("bucket").distinct(), "hot")
    if hot.isEmpty():
        return buckets, buckets.select("bucket", "node").limit(0)
    beyond = small(hot)
    return buckets.join(beyond, "bucket", "left_anti"), buckets.filter("members IS NULL").join(beyond, "bucket", "left_semi").select("bucket", "node")


def _tasks(buckets: DataFrame) -> DataFrame:
    """bucket, node, i, j, base, deal of buckets that are compared in one go."""
    # alike lines share most of their buckets: equal lists of members are compared once; lists with the same first member go to one task
    few = buckets.filter("members IS NOT NULL").select("members").distinct()
    number = F.pmod(F.xxhash64("members"), F.lit((1 << 31) - 1)).cast("int")
    few = few.select(F.element_at("members", 1).alias("bucket"), number.alias("i"), F.explode("members").alias("node"))
    rest = buckets.filter("members IS NULL").select("bucket", F.lit(-1).alias("i"), "node")
    return few.unionByName(rest).select("bucket", "node", "i", F.col("i").alias("j"), F.lit(True).alias("base"), F.lit(0).cast("long").alias("deal"))


def linked(keys: DataFrame, some: DataFrame, lines: DataFrame, similarity: float, shingle_set=shingle_set) -> DataFrame:
    """Links (a, b) between the nodes of lines (node, line) that share one of their keys (node, keys array) and are alike.

    some are the keys of those nodes that looked_at() takes.

    Members of a bucket beyond BUCKET get bands of further minima, by which they meet in smaller buckets. What is still
    beyond BUCKET are mostly copies of one line: all are compared with one member, in blocks, and only those that are not
    like it with all members, block by block. No link within those buckets is lost.
    """
    lines = lines.select("node", "line")

    def compared(tasks: DataFrame, known: bool = False) -> DataFrame:
        joined = tasks.join(lines, "node").select("bucket", "i", "j", "base", "node", "line", "deal")
        return joined.repartition("bucket", "deal").sortWithinPartitions("bucket", "i", "j", "node").drop("deal").mapInArrow(_verify(similarity, shingle_set, known), "a long, b long")

    nodes = lines.count()
    buckets, hot = _divided(keys, some, nodes)
    found = compared(_tasks(buckets))
    hot = stored(hot, "hot-members")
    if hot.isEmpty():
        return found
    again = stored(hot.join(lines, "node").select("bucket", "node", "line").mapInArrow(_further(shingle_set), "node long, keys array<long>"), "further")
    buckets, hot = _divided(again, again.filter(looked_at()), nodes)
    found = found.unionByName(compared(_tasks(buckets)))
    hot = stored(hot, "hot-again")
    if hot.isEmpty():
        return found
    blocks = stored(hot.groupBy("bucket").agg(F.min("node").alias("head"), F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("blocks")), "hot-buckets")
    hot = stored(hot.join(small(blocks), "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "hot-blocks")
    heads = hot.filter("node = head").select("bucket", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(True).alias("base"))
    star = heads.unionByName(hot.filter("node <> head").select("bucket", "node", F.col("own").alias("i"), F.lit(False).alias("base")))
    star = stored(compared(star.select("bucket", "node", "i", F.lit(-1).alias("j"), "base", F.col("i").cast("long").alias("deal")), known=True), "star")
    apart = hot.filter("node <> head").join(star.select(F.col("a").alias("node"), F.col("b").alias("head")), ["node", "head"], "left_anti")
    apart = stored(apart, "apart")
    if apart.isEmpty():
        return found.unionByName(star)
    own = small(stored(apart.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("rows")), "apart-buckets"))
    base = apart.join(own, "bucket").select("bucket", "node", F.pmod(F.xxhash64("node"), F.col("rows")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("base"))
    query = hot.join(own, "bucket").select("bucket", "node", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.col("own").alias("j"), F.lit(False).alias("base"))
    both = base.withColumn("j", -2 - F.col("j")).unionByName(query.withColumn("j", -2 - F.col("j")))
    return found.unionByName(star).unionByName(compared(both.withColumn("deal", F.xxhash64("i", "j"))))


def decide(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """uid, place of every line that is not blank, and whether it goes."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "uid", "place")).alias("first")
    lines = numbered(docs, "uid", "doc_id", "place", "key", "line").groupBy("key").agg(F.max("line").alias("line"), first, F.count(F.lit(1)).alias("n"))
    lines = stored(lines.withColumn("node", F.monotonically_increasing_id()), "lines")
    found = graph.components(alike(lines, similarity), "line-links")
    # a line without links is a component of its own, and its first occurrence stays
    nodes = stored(lines.select("node", "key", "first", "n").join(found, "node", "left").filter("n > 1 OR root IS NOT NULL"), "line-nodes")
    heads = nodes.filter("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("stays"))
    many = nodes.filter("root IS NOT NULL").join(heads, "root").select("key", "n", "first", "stays").unionByName(nodes.filter("root IS NULL").select("key", "n", "first", F.col("first").alias("stays")))
    many = many.filter("n > 1 OR stays <> first").select("key", F.col("stays.uid").alias("at"), F.col("stays.place").alias("at_place"))
    places = numbered(docs, "uid", "place", "key").join(many, "key", "left")
    return places.select("uid", "place", F.coalesce((F.col("at") != F.col("uid")) | (F.col("at_place") != F.col("place")), F.lit(False)).alias("goes"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines (not blank), n_kept, dropped (places of dropped lines, from 0) and the text that remains."""
    docs = fixed(docs.select("doc_id", "text"))
    lines = decide(docs, similarity).groupBy("uid").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.when(F.col("goes"), F.col("place")))).alias("dropped"))
    # whether each line up to the last dropped one goes
    gaps = F.zip_with("dropped", F.concat(F.array(F.lit(-1)), F.slice("dropped", F.lit(1), F.greatest(F.size("dropped") - 1, F.lit(0)))), lambda x, before: x - before - 1)
    goes = F.flatten(F.transform(gaps, lambda n: F.concat(F.array_repeat(F.lit(False), n), F.array(F.lit(True)))))
    lines = lines.withColumn("goes", F.when(F.size("dropped") > 0, goes))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.join(lines, "uid", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)).cast("long")).withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.get("goes", i), F.lit(False))), "\n")
    text = F.when(F.size("dropped") == 0, F.col("text")).otherwise(kept)
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), "dropped", text.alias("text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_kept", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
