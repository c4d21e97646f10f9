"""File trees and small text files as DataFrames."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.functions import paths

FILES = "path string, ext string, content binary, length long, tracked boolean"


def tree(spark: SparkSession, root: str, tracked: DataFrame | None = None, globs: list[str] | None = None, ignores: tuple[str, ...] = paths.DEFAULT_IGNORES) -> DataFrame:
    """Files below root; tracked (path) marks those under version control, globs and ignores filter by path."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^{paths.quoted([os.path.abspath(root)])}/", "")
    files = read.select(at.alias("path"), "content", "length")
    files = files.filter(~paths.matches_glob(F.col("path"), ignores))
    if globs:
        files = files.filter(paths.matches_glob(F.col("path"), globs))
    if tracked is None:
        return files.withColumn("tracked", F.lit(True)).withColumn("ext", paths.extension(F.col("path"))).select(*[c.split()[0] for c in FILES.split(", ")])
    files = files.join(tracked.select("path", F.lit(True).alias("tracked")), "path", "left").withColumn("tracked", F.coalesce("tracked", F.lit(False)))
    return files.withColumn("ext", paths.extension(F.col("path"))).select(*[c.split()[0] for c in FILES.split(", ")])


def texts(files: DataFrame, mark: bool = False) -> DataFrame:
    """(path, text) of files (path, content): UTF-8 with replacement characters, and with mark without a byte order mark."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("path", (F.regexp_replace(text, "^\ufeff", "") if mark else text).alias("text"))


def tracked_by(files: DataFrame, globs: list[str], ignores: tuple[str, ...] = paths.DEFAULT_IGNORES, vendor: bool = True) -> DataFrame:
    """Tracked files that a glob matches and no ignore pattern, without vendor's unless those are wanted."""
    out = files.filter(F.col("tracked") & paths.matches_glob(F.col("path"), globs) & ~paths.matches_glob(F.col("path"), ignores))
    return out if vendor else out.filter(~paths.is_vendor(F.col("path")))


def lint_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(path, key) of a linter's accepted findings: a list of files with messages, the same under results, or keys by path."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        data = []
    if isinstance(data, dict) and "results" in data:
        data = data["results"]
    rows = []
    if isinstance(data, dict):
        rows = [(p.removeprefix("./"), k) for p, keys in data.items() if isinstance(keys, list) for k in keys]
    elif isinstance(data, list):
        for item in (x for x in data if isinstance(x, dict) and x.get("filePath")):
            rows += [(item["filePath"], f"{m['line']}:{m['column']}:{m['ruleId']}") for m in item.get("messages") or [] if m.get("line") and m.get("column") and m.get("ruleId")]
    return spark.createDataFrame([(p, str(k)) for p, k in rows], "path string, key string").distinct()


def format_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(path) of files that a formatter leaves alone, one a line."""
    try:
        with open(path, encoding="utf-8") as f:
            listed = f.read().split("\n")
    except (OSError, ValueError):
        listed = []
    return spark.createDataFrame([(x.strip().removeprefix("./"),) for x in listed if x.strip()], "path string").distinct()


def ownership(spark: SparkSession, root: str) -> DataFrame:
    """(ord, regex, owner) of the first ownership file there is."""
    for at in ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS"):
        full = os.path.join(root, at)
        if os.path.isfile(full):
            with open(full, encoding="utf-8", errors="replace") as f:
                return ownership_rules(spark, f.read())
    return ownership_rules(spark, "")


def ownership_rules(spark: SparkSession, content: str) -> DataFrame:
    """(ord, regex, owner) of lines of a pattern and owners, of which the last counts, without its @."""
    rules = []
    for line in content.splitlines():
        parts = line.split("#")[0].split()
        if len(parts) >= 2:
            rules.append((len(rules), paths.owner_regex(parts[0]), parts[-1].lstrip("@")))
    return spark.createDataFrame(rules, "ord int, regex string, owner string")


def merged(base: dict, over: dict) -> dict:
    """Configuration over defaults: dicts merge, lists append, all else replaces."""
    out = dict(base)
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v)
        elif isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = out[k] + v
        else:
            out[k] = v
    return out


# --- fixed values: what each kind of project looks at ---
_SCRIPTS = ["**/src/**/*.ts", "**/app/**/*.js"]
PROFILES = {
    "django": {"impact": {"urls_globs": ["**/urls.py"], "template_globs": ["**/templates/**/*.html"], "frontend_globs": _SCRIPTS, "reverse": True}, "guard": {"checks": [{"id": "ruff"}, {"id": "ruff-format"}]}},
    "fastapi": {"impact": {"urls_globs": ["**/*.py"], "template_globs": [], "frontend_globs": _SCRIPTS}, "guard": {"checks": [{"id": "ruff"}, {"id": "ruff-format"}]}},
    "frontend": {"impact": {"urls_globs": [], "template_globs": ["**/*.html"], "frontend_globs": _SCRIPTS, "reverse": True}, "guard": {"checks": [{"id": "eslint"}, {"id": "prettier"}]}},
    "python": {"impact": {"urls_globs": [], "template_globs": [], "frontend_globs": []}, "guard": {"checks": [{"id": "ruff"}, {"id": "ruff-format"}]}},
    "generic": {"impact": {"urls_globs": [], "template_globs": [], "frontend_globs": []}},
}
BASE = {"ignore_paths": list(paths.DEFAULT_IGNORES), "guard": {"blocking": "warn", "checks": []}, "impact": {"reverse": False, "experimental": False, "ignore_symbols": []}}


def project_config(path: str, defaults: dict = BASE) -> dict:
    """Configuration of a project: the user's file over its profile over the defaults.

    Lists append, but the user's list of checks stands alone. An unknown profile counts as generic; a file that can't be
    read, or is no object, as none.
    """
    user = config(path, {})
    impact = user.get("impact") if isinstance(user.get("impact"), dict) else {}
    name = impact.get("profile") if impact.get("profile") in PROFILES else "generic"
    out = merged(merged(defaults, PROFILES[name]), user)
    guard = user.get("guard") if isinstance(user.get("guard"), dict) else {}
    if "checks" in guard:
        out["guard"] = dict(out["guard"]) | {"checks": guard["checks"] if isinstance(guard["checks"], list) else defaults["guard"]["checks"]}
    out["impact"] = dict(out["impact"]) | {"profile": name}
    return out


def save_config(path: str, data: dict) -> bool:
    """Writes a configuration beside its place, then renames it; whether that worked."""
    beside = f"{path}.{os.getpid()}"
    try:
        with open(beside, "w", encoding="utf-8") as f:
            json.dump(data, f, indent=2)
            f.write("\n")
        os.replace(beside, path)
    except (OSError, TypeError, ValueError):
        return False
    return True


def config(path: str, defaults: dict) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            user = json.load(f)
    except (OSError, ValueError):
        return defaults
    return merged(defaults, user) if isinstance(user, dict) else defaults


def stack_of(files: DataFrame) -> DataFrame:
    """One row: the first of django, fastapi, frontend, python, generic that the files (path, text) show."""
    base = paths.base_name(F.col("path"))
    mentions = lambda word: F.max((base.isin("requirements.txt", "pyproject.toml", "setup.py", "Pipfile") & F.lower("text").contains(word)).cast("int"))
    seen = files.agg(
        F.max((base == "manage.py").cast("int")).alias("django"), mentions("django").alias("django2"), mentions("fastapi").alias("fastapi"),
        F.max((base.isin("package.json", "angular.json")).cast("int")).alias("frontend"), F.max((F.col("path").endswith(".py") | base.isin("setup.py", "pyproject.toml")).cast("int")).alias("python"))
    return seen.select(F.when((F.col("django") == 1) | (F.col("django2") == 1), "django").when(F.col("fastapi") == 1, "fastapi").when(F.col("frontend") == 1, "frontend").when(F.col("python") == 1, "python").otherwise("generic").alias("stack"))
