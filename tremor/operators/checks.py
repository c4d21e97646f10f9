"""Checks of files and lines: every check gives (check_id, path, line, column, code, message).

Checks read files (path, content binary, length, tracked). Fixers give the fixed content instead of writing files.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions import paths, text
from tremor.session import ship

# --- fixed values: headers of private keys, and endings that a formatter looks at ---
KEY_HEADERS = (
    "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----", "-----BEGIN DSA PRIVATE KEY-----", "-----BEGIN PGP PRIVATE KEY BLOCK-----",
)
FORMATTED = (".ts", ".js", ".html", ".css", ".scss", ".json")
MAX_KB = 250_000
ISSUE = "check_id string, path string, line int, `column` int, code string, message string"


def _issues(df: DataFrame, check_id: str, message: str | F.Column, line: F.Column | None = None) -> DataFrame:
    message = F.lit(message) if isinstance(message, str) else message
    none = F.lit(None)
    return df.select(F.lit(check_id).alias("check_id"), "path", (none if line is None else line).cast("int").alias("line"), none.cast("int").alias("column"), none.cast("string").alias("code"), message.alias("message"))


def as_text(files: DataFrame) -> F.Column:
    """Bytes as text one to one, so that byte patterns are text patterns."""
    return F.decode("content", "ISO-8859-1")


_FIXERS: dict[str, tuple[Callable, str]] = {
    "hygiene/mixed-line-ending": (text.line_feeds, "line endings fixed"),
    "hygiene/trailing-whitespace": (text.no_trailing_white, "trailing white space removed"),
    "hygiene/end-of-file-fixer": (text.one_final_line_feed, "end of file fixed"),
}


def fixed(files: DataFrame, check_id: str) -> DataFrame:
    """(check_id, path, content): files that a hygiene check would change, with their content after it."""
    was = as_text(files)
    now = _FIXERS[check_id][0](was)
    return files.withColumn("__now", now).filter(F.col("__now") != was).select(F.lit(check_id).alias("check_id"), "path", F.encode("__now", "ISO-8859-1").alias("content"))


def hygiene(files: DataFrame, check_id: str) -> DataFrame:
    return _issues(fixed(files, check_id), check_id, _FIXERS[check_id][1])


def merge_conflicts(files: DataFrame, scope: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Conflict markers on lines in scope; without a scope, on all lines."""
    at = files.select("path", F.posexplode(F.split(F.regexp_replace(as_text(files), r"\r\n?", "\n"), "\n")).alias("pos", "text")).withColumn("line", F.col("pos") + 1)
    at = at.filter((F.col("text") == "=======") | F.col("text").startswith("<<<<<<< ") | F.col("text").startswith(">>>>>>> "))
    if scope is not None:
        at = on_changed_lines(at, scope, lines)
    return _issues(at, "syntax/merge-conflict", "merge conflict marker", F.col("line"))


def large_files(files: DataFrame, max_kb: int = MAX_KB) -> DataFrame:
    return _issues(files.filter(F.col("length") > max_kb * 1024), "repo/large-files", F.concat(F.lit("file has "), F.col("length").cast("string"), F.lit(" bytes")))


def private_keys(files: DataFrame) -> DataFrame:
    t = as_text(files)
    hit = F.lit(False)
    for header in KEY_HEADERS:
        hit = hit | t.contains(header)
    return _issues(files.filter(hit), "repo/private-key", "private key")


def case_conflicts(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Files whose path is another tracked path but for case; the first of several is named."""
    other = tracked.select(F.lower("path").alias("__low"), F.col("path").alias("other")).distinct()
    hit = files.select("path", F.lower("path").alias("__low")).join(other, "__low").filter(F.col("other") != F.col("path")).groupBy("path").agg(F.min("other").alias("other"))
    return _issues(hit, "repo/case-conflict", F.concat(F.lit("differs by case only from "), F.col("other")))


def _parsed(files: DataFrame, check_id: str, find: Callable[[str, bytes], tuple | None]) -> DataFrame:
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(check_id, p, *e[:2], None, e[2]) for p, c in zip(b["path"], b["content"], strict=True) if (e := find(p, bytes(c)))]
            yield pd.DataFrame(rows, columns=["check_id", "path", "line", "column", "code", "message"]).astype({"line": "Int32", "column": "Int32"})

    return files.select("path", "content").mapInPandas(run, ISSUE)


def _json_problem(path: str, content: bytes) -> tuple | None:
    if not content.strip():
        return None
    base = path.rsplit("/", 1)[-1]
    loose = base in paths.JSONC_FILES or base.endswith(".code-workspace") or (base.startswith(("tsconfig.", "jsconfig.")) and base.endswith(".json")) or "/.vscode/" in f"/{path}"
    return text.json_error(content, loose)


def _python_problem(path: str, content: bytes) -> tuple | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(content.decode("utf-8-sig"))
    except SyntaxError as e:
        return e.lineno, e.offset, e.msg
    except ValueError as e:
        return None, None, str(e)
    return None


def json_syntax(files: DataFrame) -> DataFrame:
    """Strict JSON; comments and trailing commas where a file's name allows them. Blank files are not looked at."""
    return _parsed(files.filter(F.lower("path").endswith(".json") | F.col("path").endswith(".code-workspace")), "syntax/json-syntax", _json_problem)


def python_syntax(files: DataFrame) -> DataFrame:
    return _parsed(files.filter(F.col("path").endswith(".py")), "syntax/ast-syntax", _python_problem)


def on_changed_lines(found: DataFrame, scope: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings (path, line, ...) on changed lines: all of a file with scope all, those in lines with scope lines, else none."""
    moded = found.join(scope.select("path", "scope_mode"), "path")
    some = moded.filter("scope_mode = 'lines'").join(lines.select("path", "line").distinct(), ["path", "line"], "left_semi")
    return some.unionByName(moded.filter("scope_mode = 'all'")).drop("scope_mode")


def format_hunks(diff: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines (path, pos, text) of a formatter's diff in the blocks of -/+ lines that touch a changed old line.

    The old line number is a running count from the hunk header; blocks are islands between unchanged lines.
    """
    order = Window.partitionBy("path").orderBy("pos")
    head = F.regexp_extract("text", r"^@@ -(\d+)", 1)
    d = diff.withColumn("hunk", F.sum((head != "").cast("int")).over(order)).filter("hunk > 0")
    inside = Window.partitionBy("path", "hunk").orderBy("pos")
    start = F.first(F.try_to_number(F.nullif(head, F.lit("")), F.lit("9999999999")).cast("int"), ignorenulls=True).over(inside)
    sign = F.substring("text", 1, 1)
    counts = F.when(head != "", 0).when(sign == "+", 0).otherwise(1)
    d = d.withColumn("old_line", start + F.sum(counts).over(inside) - F.when((head == "") & (sign != "+"), 1).otherwise(0))
    edit = (head == "") & sign.isin("-", "+")
    d = d.withColumn("block", F.sum(F.when(edit, 0).otherwise(1)).over(inside)).filter(edit)
    touched = d.join(lines.select("path", F.col("line").alias("old_line")).distinct(), ["path", "old_line"], "left_semi").select("path", "hunk", "block").distinct()
    return d.join(touched, ["path", "hunk", "block"], "left_semi").select("path", "pos", "text", "old_line")


def not_in_baseline(messages: DataFrame, baseline: DataFrame) -> DataFrame:
    """Linter messages (path, line, column, code) that the baseline (path, key) does not list; paths are equal or one ends the other."""
    keyed = messages.withColumn("__key", F.concat_ws(":", "line", "column", "code")).withColumn("__row", F.monotonically_increasing_id())
    ends = keyed.select("__row", "__key", F.explode(paths.suffixes(F.col("path"))).alias("__end"))
    known = baseline.select(F.col("key").alias("__key"), F.col("path").alias("__end")).distinct()
    longer = baseline.select(F.col("key").alias("__key"), F.explode(paths.suffixes(F.col("path"))).alias("path")).distinct()
    listed = ends.join(known, ["__key", "__end"], "left_semi").select("__row").union(keyed.join(longer, ["__key", "path"], "left_semi").select("__row")).distinct()
    return keyed.join(listed, "__row", "left_anti").drop("__key", "__row")


def formatter_scope(files: DataFrame, baseline: DataFrame, changed: DataFrame) -> DataFrame:
    """Files that a formatter looks at: of its endings, under src or app, and outside the baseline unless changed."""
    fits = F.lower("path").rlike(rf"(?:{paths.quoted(FORMATTED)})$") & F.col("path").rlike(r"(?:^|/)(?:src|app)/")
    old = baseline.select("path").join(changed.select("path"), "path", "left_anti").distinct()
    return files.filter(fits).join(old, "path", "left_anti")


def linter_messages(reports: DataFrame) -> DataFrame:
    """path, line, column, code, message of JSON reports (text): [{filename, location: {row, column}, code, message}]."""
    schema = "array<struct<filename string, location struct<row int, `column` int>, code string, message string>>"
    return reports.select(F.explode(F.from_json("text", schema)).alias("m")).select(F.col("m.filename").alias("path"), F.col("m.location.row").alias("line"), F.col("m.location.column").alias("column"), "m.code", "m.message")


def nested_messages(reports: DataFrame) -> DataFrame:
    """path, line, column, code, message of JSON reports (text) by file: [{filePath, messages: [{line, column, ruleId, message}]}]."""
    schema = "array<struct<filePath string, messages array<struct<line int, `column` int, ruleId string, message string>>>>"
    each = reports.select(F.explode(F.from_json("text", schema)).alias("f")).select(F.col("f.filePath").alias("path"), F.explode("f.messages").alias("m"))
    return each.select("path", "m.line", F.col("m.column").alias("column"), F.col("m.ruleId").alias("code"), "m.message")


def unformatted(reports: DataFrame) -> DataFrame:
    """path of files that a formatter's text report (text) names in lines that begin with [warn], but for its summary."""
    lines = reports.select(F.explode(F.split("text", r"\r?\n")).alias("line")).filter(F.col("line").startswith("[warn] "))
    named = lines.select(F.trim(F.substring("line", 8, 1 << 20)).alias("path"))
    return named.filter((F.col("path") != "") & ~F.col("path").contains(" ")).distinct()


def diff_rows(reports: DataFrame) -> DataFrame:
    """path, pos, text of the lines of a formatter's unified diffs (name, text), as format_hunks() reads them; a file begins at its old name."""
    at = reports.select("name", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    head = F.when(F.col("text").startswith("--- "), F.regexp_replace(F.substring("text", 5, 1 << 20), r"^a/|\t.*$", ""))
    order = Window.partitionBy("name").orderBy("pos")
    return at.withColumn("path", F.last(head, ignorenulls=True).over(order)).filter("path IS NOT NULL").select("path", "pos", "text")


CHECKS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    **{k: (lambda files, tracked, k=k: hygiene(files, k)) for k in _FIXERS},
    "syntax/json-syntax": lambda files, tracked: json_syntax(files),
    "syntax/ast-syntax": lambda files, tracked: python_syntax(files),
    "syntax/merge-conflict": lambda files, tracked: merge_conflicts(files),
    "repo/large-files": lambda files, tracked: large_files(files),
    "repo/private-key": lambda files, tracked: private_keys(files),
    "repo/case-conflict": case_conflicts,
}
ALWAYS_BLOCK = ("repo/private-key",)


def run_checks(files: DataFrame, tracked: DataFrame, ids: tuple[str, ...] = tuple(CHECKS)) -> DataFrame:
    """Issues of all named checks over the files."""
    out = None
    for k in ids:
        found = CHECKS[k](files, tracked)
        out = found if out is None else out.unionByName(found)
    return out


def verdict(issues: DataFrame, blocking: tuple[str, ...], strict: bool) -> DataFrame:
    """check_id, n, blocked: a check blocks if it always does, or if it is blocking and the run is strict."""
    n = issues.groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))
    hard = F.col("check_id").isin(*ALWAYS_BLOCK)
    return n.withColumn("blocked", hard | (F.lit(strict) & F.col("check_id").isin(*blocking)))
