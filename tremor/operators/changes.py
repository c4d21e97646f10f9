"""What changed: change lists, hunks, changed lines and changed definitions, from two snapshots of a tree."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions import paths
from tremor.session import ship, stored

#: Lines of a file that a change covers: some of them, all of them, or none on that side.
LINES, ALL, NONE = "lines", "all", "none"
_STATUS = re.compile(r"[AMDCTR]\d*")


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key. For rows that are few per key; ties must be settled by order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def numbered(rows: DataFrame, column: str, *order: Column | str) -> DataFrame:
    """Rows with their number from 1 in a global order: sorted by ranges, written in order, and counted on from the parts before."""
    parts = stored(rows.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % (1 << 33)), "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return parts.join(sizes, "__part").withColumn(column, (F.col("__before") + F.col("__at") + 1).cast("long")).drop("__part", "__at", "__before")


def merge_change_lists(*lists: DataFrame) -> DataFrame:
    """Union of change lists (path, status, old_path); of a path that several name, the first list's row."""
    tagged = [d.withColumn("__list", F.lit(k)) for k, d in enumerate(lists)]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d)
    return first_by(out, ["path"], "__list", "status").drop("__list").withColumn("ext", paths.extension(F.col("path")))


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (A, M, D, R100), old_path, ext between snapshots (path, content); an added file with a deleted one's content is a rename."""
    digest = F.sha1(F.col("content").cast("binary"))
    a, b = old.select("path", digest.alias("was")), new.select("path", digest.alias("now"))
    both = a.join(b, "path", "full_outer").withColumn("status", F.when(F.col("was").isNull(), "A").when(F.col("now").isNull(), "D").when(F.col("was") != F.col("now"), "M")).filter("status IS NOT NULL")
    rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("path"))
    gone = both.filter("status = 'D'").select(F.col("path").alias("gone_path"), F.col("was").alias("digest"), rank("was").alias("nth"))
    come = both.filter("status = 'A'").select("path", F.col("now").alias("digest"), rank("now").alias("nth"))
    renames = come.join(gone, ["digest", "nth"]).select("path", F.lit("R100").alias("status"), F.col("gone_path").alias("old_path"))
    rest = both.join(renames.select("path"), "path", "left_anti").join(renames.select(F.col("old_path").alias("path")), "path", "left_anti")
    rest = rest.select("path", "status", F.when(F.col("status") == "D", F.col("path")).alias("old_path"))
    return rest.unionByName(renames).withColumn("ext", paths.extension(F.col("path")))


def parse_name_status(stream: DataFrame) -> DataFrame:
    """Change list of a stream (pos, token) of status letters and paths: two paths after R and C, one after others.

    A token is a status if it looks like one and is not taken as a path, which depends on all before it: one task reads
    the stream of a change-set in order, batch by batch, and holds no more than an open entry. What is cut off at the
    end is dropped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        status, held = None, []
        for b in batches:
            rows = []
            for token in b["token"]:
                if status is None:
                    status = token if _STATUS.fullmatch(token) else None
                    continue
                held.append(token)
                pair = status[0] in "RC"
                if len(held) == 1 + pair:
                    rows.append((held[-1], status, held[0] if pair or status[0] == "D" else None))
                    status, held = None, []
            yield pd.DataFrame(rows, columns=["path", "status", "old_path"])

    ship(stream.sparkSession)
    ordered = stream.select("pos", "token").repartition(1).sortWithinPartitions("pos")
    return ordered.mapInPandas(run, "path string, status string, old_path string").withColumn("ext", paths.extension(F.col("path")))


def parse_hunks(diffs: DataFrame) -> DataFrame:
    """path and old_start, old_count, new_start, new_count of every hunk of diffs (path, text)."""
    lines = diffs.select("path", F.explode(F.split("text", "\n")).alias("line"))
    m = lambda k: F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", k)
    number = lambda k: F.try_to_number(F.nullif(m(k), F.lit("")), F.lit("9999999999")).cast("int")
    return lines.filter(m(1) != "").select("path", number(1).alias("old_start"), F.coalesce(number(2), F.lit(1)).alias("old_count"), number(3).alias("new_start"), F.coalesce(number(4), F.lit(1)).alias("new_count"))


def _edits(before: str, after: str) -> Iterator[tuple[str, int]]:
    """(side, line) of every line that differs, both sides cut to what is between their common ends."""
    a, b = before.splitlines(), after.splitlines()
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a[lead : len(a) - tail], b[lead : len(b) - tail], autojunk=False).get_opcodes():
        if op != "equal":
            yield from (("old", lead + i + 1) for i in range(i1, i2))
            yield from (("new", lead + j + 1) for j in range(j1, j2))


def changed_lines(texts: DataFrame) -> DataFrame:
    """path, side (old, new), line of every line that differs between the texts before and after (path, before, after)."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *e) for p, x, y in zip(b["path"], b["before"], b["after"], strict=True) for e in _edits(x, y)]
            yield pd.DataFrame(rows, columns=["path", "side", "line"]).astype({"line": "int32"})

    return texts.select("path", "before", "after").mapInPandas(run, "path string, side string, line int")


def hunk_lines(hunks: DataFrame, side: str = "new") -> DataFrame:
    """path, line of every line that hunks cover on one side; a count of 0 covers none."""
    start, count = F.col(f"{side}_start"), F.col(f"{side}_count")
    return hunks.filter(count > 0).select("path", F.explode(F.sequence(start, start + count - 1)).alias("line")).distinct()


def overlapping(entities: DataFrame, lines: DataFrame) -> DataFrame:
    """Entities (path, line, end_line) that a changed line (path, line) falls in.

    Lines are bucketed by 64 so that the range join is an equality join on path and bucket.
    """
    cells = entities.withColumn("__cell", F.explode(F.sequence(F.shiftright("line", 6), F.shiftright("end_line", 6))))
    at = lines.select(F.col("path").alias("__path"), F.col("line").alias("__line"), F.shiftright("line", 6).alias("__at"))
    hit = cells.join(at, (F.col("path") == F.col("__path")) & (F.col("__cell") == F.col("__at")) & F.col("__line").between(F.col("line"), F.col("end_line")), "left_semi")
    return hit.drop("__cell").distinct()


def in_scope(entities: DataFrame, scope: DataFrame, lines: DataFrame) -> DataFrame:
    """Entities that a change touches: scope (path, scope_mode) tells whether lines, all or none of a file count."""
    moded = entities.join(scope, "path")
    some = overlapping(moded.filter(F.col("scope_mode") == LINES).drop("scope_mode"), lines)
    return some.unionByName(moded.filter(F.col("scope_mode") == ALL).drop("scope_mode"))


def changed_entities(old: DataFrame, new: DataFrame, touched_old: DataFrame, touched_new: DataFrame, modules: DataFrame) -> DataFrame:
    """name, kind, deleted, modules: what changed, by leaf name over the whole change-set.

    old, new: definitions (path, name, kind, line, end_line) of both sides; touched_*: those that changed lines touch;
    modules: (path, module). Deleted is what the whole new side of its file lacks.
    """
    alive = new.select("path", "name").distinct()
    gone = touched_old.join(alive, ["path", "name"], "left_anti").withColumn("deleted", F.lit(True))
    stay = touched_new.unionByName(touched_old.join(alive, ["path", "name"], "left_semi")).withColumn("deleted", F.lit(False))
    every = gone.unionByName(stay).join(modules, "path")
    # a live definition counts before a deleted one; of several, the first by path and line names the kind
    return every.groupBy("name").agg(
        F.min(F.struct("deleted", "path", "line", "kind"))["kind"].alias("kind"), F.min("deleted").alias("deleted"), F.array_sort(F.collect_set("module")).alias("modules"))


def removed_ratio(old_lines: DataFrame, totals: DataFrame) -> DataFrame:
    """path and share of its old lines that a change removes. old_lines: (path, line); totals: (path, n)."""
    return totals.join(old_lines.groupBy("path").agg(F.countDistinct("line").alias("k")), "path", "left").select("path", (F.coalesce("k", F.lit(0)) / F.greatest("n", F.lit(1))).alias("removed_ratio"))


def stale(files: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """Files (path, hash) whose analysis the cache (path, hash, v) does not hold: only these are analysed again."""
    return files.join(cache.filter(F.col("v") == version).select("path", "hash"), ["path", "hash"], "left_anti")


def change_base(candidates: DataFrame) -> DataFrame:
    """The candidate (name, ord, differing) whose tree differs least; the first of equals."""
    return candidates.orderBy("differing", "ord").limit(1)
