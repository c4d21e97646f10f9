"""The guard run: configured checks over files, folded to one verdict."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions import paths, text
from tremor.operators import checks
from tremor.session import stored

#: Issues of a check that the text lists; all of them are in the issues table.
LISTED = 50
# --- fixed values: how a finding can be mended ---
HINTS = {"ruff": "ruff check --fix {path}", "ruff-format": "ruff format {path}", "eslint": "eslint --fix {path}", "prettier": "prettier --write {path}"}
OFF = ("", "0", "false", "no", "off")


class Check(NamedTuple):
    id: str
    blocking: bool
    always: bool
    args: tuple[str, ...]


class Guard(NamedTuple):
    issues: DataFrame  # check_id, path, line, column, code, message
    fixes: DataFrame  # check_id, path, content
    summary: DataFrame  # check_id, state, n, blocked
    warnings: list[str]
    text: str
    code: int


def is_true(value) -> bool:
    """Whether a configured value means yes: nothing, false and the words of OFF do not."""
    if isinstance(value, str):
        return value.strip().lower() not in OFF
    return bool(value)


def command_line(command: list[str], path: str) -> list[str]:
    """Arguments of an external command for a file: in place of {file}, else at the end."""
    return [path if a == "{file}" else a for a in command] if "{file}" in command else [*command, path]


def check_of(entry: dict | str) -> Check | None:
    """A configured check; entries may override whether it blocks and add arguments. None if there is no such check."""
    e = entry if isinstance(entry, dict) else {"id": entry}
    name = e.get("id")
    if name not in checks.CHECKS:
        return None
    over = lambda key, default: default if e.get(key) is None else is_true(e[key])
    return Check(name, over("blocking", True), over("always_block", name in checks.ALWAYS_BLOCK), tuple(e.get("args") or ()))


def _found(check: Check, files: DataFrame, tracked: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(issues or fixed paths, fixed contents) of one check, written, so that a fault of it shows here and nowhere else."""
    if check.id.startswith("hygiene/"):
        fixes = stored(checks.fixed(files, check.id), "fixes")
        return fixes, fixes
    return stored(checks.CHECKS[check.id](files, tracked), "issues"), None


def run(files: DataFrame, config: dict | None = None, tracked: DataFrame | None = None, anchor: str | None = None) -> Guard:
    """Runs the checks of config["guard"] (all of them if it lists none) over files (path, content, tracked).

    A file that a fixer would change counts as fixed and not as an issue. A check blocks if it always does, or if it is
    blocking and the mode is strict. An unknown check, or one that fails, is a warning and takes no part.
    """
    cfg = (config or {}).get("guard") or {}
    spark = files.sparkSession
    if "length" not in files.columns:
        files = files.withColumn("length", F.octet_length("content").cast("long"))
    files = files.filter(~paths.matches_glob(F.col("path"), list((config or {}).get("ignore_paths") or ())))
    tracked = files if tracked is None else tracked
    strict = (cfg.get("blocking") or "warn") == "strict"
    mode = "strict" if strict else "warn"
    lines = ["=" * 70, "  Guard", f"  Diff base: {anchor or 'none'} | {files.count()} changed file(s) | {mode} mode", "=" * 70]
    warnings, folded = [], []
    issues = fixes = None
    always = False
    for entry in cfg.get("checks") or list(checks.CHECKS):
        check = check_of(entry)
        if check is None:
            warnings.append(f"unknown or invalid check {entry!r}; skipping")
            continue
        try:
            found, fixed = _found(check, files, tracked)
            n = found.count()
        except PySparkException as e:
            warnings.append(f"check {check.id!r} failed: {e}")
            continue
        state = "PASS" if not n else "FIXED" if fixed is not None else "FAIL"
        blocked = state == "FAIL" and (check.always or (check.blocking and strict))
        always = always or (blocked and check.always)
        folded.append((check.id, state, n, blocked))
        lines.append(f"  {state:<5} {check.id}")
        if state == "FIXED":
            lines += [f"      fixed {r.path}" for r in found.select("path").orderBy("path").limit(LISTED).collect()]
        elif state == "FAIL":
            first = found.orderBy("path", "line").limit(LISTED)
            said = first.select("path", text.issue_text(F.col("path"), F.col("line"), F.col("column"), F.col("code"), F.col("message")).alias("said")).collect()
            lines += [f"      {r.said}" for r in said]
            if check.id in HINTS:
                lines.append("      mend with: " + HINTS[check.id].format(path=said[0].path))
        if n > LISTED:
            lines.append(f"      and {n - LISTED} more")
        if fixed is None:
            issues = found if issues is None else issues.unionByName(found)
        else:
            fixes = fixed if fixes is None else fixes.unionByName(fixed)
    total = sum(n for _, state, n, _ in folded if state == "FAIL")
    blocked = any(b for *_, b in folded)
    lines += ["-" * 70, f"  {len(folded)} check(s), {total} issue(s), {sum(n for _, s, n, _ in folded if s == 'FIXED')} fixed"]
    if blocked:
        verdict = f"[BLOCKED] ({mode} mode; hard-block check: {total} issue(s))" if always else f"[BLOCKED] (strict mode: {total} issue(s))"
    else:
        verdict = f"[ALLOWED] ({mode} mode: {f'{total} issue(s) reported' if total else 'no issues'})"
    lines += [f"  Verdict: {verdict}", "=" * 70, *(f"warning: {w}" for w in warnings)]
    issues = spark.createDataFrame([], checks.ISSUE) if issues is None else issues
    fixes = spark.createDataFrame([], "check_id string, path string, content binary") if fixes is None else fixes
    summary = spark.createDataFrame(folded, "check_id string, state string, n long, blocked boolean")
    return Guard(issues, fixes, summary, warnings, "\n".join(lines), int(blocked))
