"""Which files and lines a run looks at, and what a cache keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions import paths, urls
from tremor.operators.changes import ALL, LINES, NONE

#: Leads that are put into one condition.
NEEDLES = 200


def developer_files(*lists: DataFrame) -> DataFrame:
    """Distinct paths of all lists, in order."""
    out = lists[0].select("path")
    for d in lists[1:]:
        out = out.union(d.select("path"))
    return out.distinct().orderBy("path")


def chosen_files(files: DataFrame, changed: DataFrame | None = None, named: DataFrame | None = None, staged: DataFrame | None = None, all_files: bool = False, developer: DataFrame | None = None) -> DataFrame:
    """Files of a check run: of the changed, named, staged, all or the developer's paths, the first that is given."""
    for some in (changed, named, staged):
        if some is not None:
            return files.join(some.select("path").distinct(), "path", "left_semi")
    if all_files or developer is None:
        return files
    return files.join(developer.select("path").distinct(), "path", "left_semi")


def without_ignored(files: DataFrame, ignores: tuple[str, ...] | list[str], listed: DataFrame | None = None) -> DataFrame:
    """Files that no ignore pattern matches and version control does not ignore (path)."""
    out = files.filter(~paths.matches_glob(F.col("path"), list(ignores)))
    return out if listed is None else out.join(listed.select("path"), "path", "left_anti")


def scope_modes(files: DataFrame, lines: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """(path, scope_mode): lines where there are changed lines, all for untracked files and those named whole, else none."""
    out = files.select("path", "tracked").join(lines.select("path", F.lit(True).alias("__some")).distinct(), "path", "left")
    mode = F.when(~F.col("tracked"), ALL).when(F.col("__some"), LINES).otherwise(NONE)
    out = out.select("path", mode.alias("scope_mode"))
    if whole is None:
        return out
    return out.join(whole.select("path").distinct(), "path", "left_anti").unionByName(out.join(whole.select("path").distinct(), "path", "left_semi").withColumn("scope_mode", F.lit(ALL)))


def with_needles(files: DataFrame, routes: DataFrame) -> DataFrame:
    """Files (path, text) that hold the static lead of a route (full); all files if no route has one.

    Up to NEEDLES leads are one condition on the text; more meet the text in a join by condition.
    """
    needles = routes.select(urls.needle(F.col("full")).alias("needle")).filter("needle <> ''").distinct()
    few = [r.needle for r in needles.limit(NEEDLES + 1).collect()]
    if not few:
        return files
    if len(few) > NEEDLES:
        return files.join(needles, F.col("text").contains(F.col("needle")), "left_semi")
    held = F.lit(False)
    for n in few:
        held = held | F.col("text").contains(n)
    return files.filter(held)


def pruned_cache(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cache rows of paths that are still there."""
    return cache.join(files.select("path").distinct(), "path", "left_semi")


def first_bases(usages: DataFrame) -> DataFrame:
    """(path, name, kind, line) with the base of the first usage there."""
    return usages.groupBy("path", "name", "kind", "line").agg(F.min_by("base", "seq").alias("base"))


def endpoints(routes: DataFrame) -> DataFrame:
    """url, handler, name, module: the first route (ord) of each URL, as the route states it."""
    return routes.groupBy(F.col("full").alias("url")).agg(F.min(F.struct("ord", "handler", "name", "module")).alias("r")).select("url", "r.handler", "r.name", "r.module")
