"""What is written of a ranked report: JSON, SARIF, Markdown and fixed-width tables."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions import text
from tremor.operators import scoring

#: Endpoints that the text lists.
LISTED = 50
# --- fixed values: levels and columns of the formats ---
LEVELS = {"High": "error", "Medium": "warning", "Low": "note"}
COLUMNS = ("#", "Impacted File Path", "Module / Subsystem", "Category", "Detected Reference / Usage", "Severity", "Action Required", "Badge")
WIDTHS = (2, 38, 20, 8, 38, 8, 26, 8)
FIELDS = ("number", "path", "module", "category", "ref", "severity", "action", "badge")


PAYLOAD = ("rank", "path", "module", "category", "ref", "entity", "severity", "risk", "badge", "section", "key", "action")


def write_payload(out: TextIO, rows: DataFrame, unresolved: DataFrame, endpoints: DataFrame, changed_count: int, hidden_count: int, top: int | None = scoring.TOP_ROWS) -> None:
    """Writes the whole report as one JSON object. Rows pass by one partition at a time, so a report may be of any length; counts by module and reason are held."""
    shown, left = scoring.displayed(rows, top)
    held = {
        "changed_count": changed_count, "unresolved_by_reason": {r["reason"]: r["n"] for r in scoring.unresolved_counts(unresolved).orderBy("reason").collect()}, "hidden_count": hidden_count, "shown_count": shown.count(),
        "hidden_counts": {r["module"]: r["hidden"] for r in scoring.overflow(left).orderBy("module").toLocalIterator()},
    }
    out.write(json.dumps(held)[:-1])
    listed = rows.orderBy("rank").select(F.to_json(F.struct(*PAYLOAD)).alias("json"))
    urls = endpoints.select("url", "handler").distinct().orderBy("url", "handler").select(F.to_json(F.struct("url", "handler")).alias("json"))
    for name, table in (("endpoints", urls), ("rows", listed)):
        out.write(f', "{name}": [')
        for k, r in enumerate(table.toLocalIterator()):
            out.write((", " if k else "") + r["json"])
        out.write("]")
    out.write("}")


def payload(rows: DataFrame, unresolved: DataFrame, endpoints: DataFrame, changed_count: int, hidden_count: int, top: int | None = scoring.TOP_ROWS) -> str:
    """The report as a JSON text, for reports that fit one; write_payload() writes any."""
    out = io.StringIO()
    write_payload(out, rows, unresolved, endpoints, changed_count, hidden_count, top)
    return out.getvalue()


def sarif_results(rows: DataFrame) -> DataFrame:
    """Rows as SARIF results: rule, level, text, uri, line (1 at least); an unknown severity counts as Low."""
    level = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in LEVELS.items()], F.lit("note"))
    line = F.greatest(F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("key", r":(\d{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(1)), F.lit(1))
    return rows.select("rank", F.concat(F.lit("impact/"), F.lower(F.when(F.col("severity").isin(*LEVELS), F.col("severity")).otherwise("Low"))).alias("rule"), level.alias("level"), F.col("ref").alias("text"), F.col("path").alias("uri"), line.alias("line"))


def write_sarif(out: TextIO, rows: DataFrame, tool: str = "tremor") -> None:
    """Writes a SARIF 2.1.0 document; rules in the order in which they are first seen, results one partition at a time."""
    results = sarif_results(rows)
    rules = [r["rule"] for r in results.groupBy("rule").agg(F.min("rank").alias("first")).orderBy("first").collect()]
    out.write('{"version": "2.1.0", "runs": [{"tool": {"driver": ' + json.dumps({"name": tool, "rules": [{"id": k} for k in rules]}) + '}, "results": [')
    for k, r in enumerate(results.orderBy("rank").toLocalIterator()):
        place = {"physicalLocation": {"artifactLocation": {"uri": r["uri"]}, "region": {"startLine": r["line"]}}}
        out.write((", " if k else "") + json.dumps({"ruleId": r["rule"], "level": r["level"], "message": {"text": r["text"]}, "locations": [place]}))
    out.write("]}]}")


def sarif(rows: DataFrame, tool: str = "tremor") -> str:
    """A SARIF document as a text, for reports that fit one; write_sarif() writes any."""
    out = io.StringIO()
    write_sarif(out, rows, tool)
    return out.getvalue()


def sarif_problems(document: dict) -> list[str]:
    """What makes a document no SARIF log of results."""
    out = []
    if document.get("version") != "2.1.0":
        out.append("version is not 2.1.0")
    runs = document.get("runs")
    if not isinstance(runs, list) or not runs:
        return [*out, "runs is empty"]
    for k, run in enumerate(runs):
        driver = (run.get("tool") or {}).get("driver") or {}
        if not driver.get("name"):
            out.append(f"run {k}: no tool name")
        known = {r.get("id") for r in driver.get("rules", [])}
        for n, result in enumerate(run.get("results", [])):
            if result.get("ruleId") not in known:
                out.append(f"run {k}, result {n}: unknown rule")
            if result.get("level") not in LEVELS.values():
                out.append(f"run {k}, result {n}: unknown level")
            for place in result.get("locations", []):
                region = (place.get("physicalLocation") or {}).get("region") or {}
                if not isinstance(region.get("startLine"), int) or region["startLine"] < 1:
                    out.append(f"run {k}, result {n}: line below 1")
    return out


def wrapped(value: str, width: int) -> list[str]:
    """Lines of at most width: by words, then after slashes, then anywhere."""
    lines, now = [], ""
    for word in re.findall(r"\S+", value) or [""]:
        parts = [word] if len(word) <= width else [p for piece in re.findall(r"[^/]*/|[^/]+", word) for p in (piece[k : k + width] for k in range(0, len(piece), width))]
        for n, part in enumerate(parts):
            gap = "" if n or not now else " "
            if len(now) + len(gap) + len(part) <= width:
                now += gap + part
            else:
                lines.append(now)
                now = part
    return [*lines, now]


def table_lines(rows: list[dict]) -> list[str]:
    """A fixed-width table of rows with FIELDS."""
    rule = "+" + "+".join("-" * (w + 2) for w in WIDTHS) + "+"
    out = [rule]
    for values in [COLUMNS, *([str(r.get(f) if r.get(f) is not None else "") for f in FIELDS] for r in rows)]:
        cells = [wrapped(v, w) for v, w in zip(values, WIDTHS, strict=True)]
        for k in range(max(map(len, cells))):
            out.append("| " + " | ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(cells, WIDTHS, strict=True)) + " |")
        out.append(rule)
    return out


def markdown_lines(rows: list[dict]) -> list[str]:
    safe = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    out = ["| " + " | ".join(COLUMNS) + " |", "|" + " --- |" * len(COLUMNS)]
    for r in rows:
        out.append("| " + " | ".join(safe(r.get(f)) for f in FIELDS) + " |")
        if r.get("related"):
            out += ["", f"<details><summary>{len(r['related'])} related</summary>", "", *(f"- {safe(x)}" for x in r["related"]), "", "</details>", ""]
    return out


def lines_of(rows: DataFrame, unresolved: DataFrame, changed: DataFrame, top: int | None = scoring.TOP_ROWS, markdown: bool = False, endpoints: DataFrame | None = None, hidden_count: int = 0) -> Iterator[str]:
    """Lines of the report: sums, the paths most at risk, a table by section, what the tables leave out, endpoints, reasons and unresolved references.

    Shown rows come to the driver one partition at a time, and a table is laid out a section at a time.
    """
    shown, left = scoring.displayed(rows, top)
    s = scoring.summary(rows, changed).first()
    yield f"Risk {s['summary_risk']}/100: {s['high']} High, {s['medium']} Medium, {s['low']} Low in {s['impacted']} files outside the change-set"
    yield from (f"  {k}. {r['path']} ({r['owner'] or 'unowned'})" for k, r in enumerate(scoring.top_paths(rows, changed).collect(), 1))
    for section in scoring.SECTIONS:
        part = [r.asDict() for r in shown.filter(F.col("section") == section).orderBy("number").toLocalIterator()]
        if part:
            yield from ("", section, *(markdown_lines(part) if markdown else table_lines(part)))
            yield from (f"  #{r['number']}: {r['why_matters']}" for r in part if r.get("why_matters"))
    yield from (f"... {r['hidden']} more in {r['module']} ({r['high']} High)" for r in scoring.overflow(left).orderBy("module").toLocalIterator())
    if hidden_count:
        yield f"{hidden_count} row(s) of low confidence are hidden"
    if endpoints is not None:
        listed = endpoints.orderBy("url").limit(LISTED + 1).collect()
        if listed:
            yield from ("", "Endpoints", *(f"  {r['url']} -> {r['handler']}" for r in listed[:LISTED]), *(["  ..."] if len(listed) > LISTED else []))
    reasons = [f"{r['reason']} {r['n']}" for r in scoring.unresolved_counts(unresolved).collect()]
    yield "Unresolved: " + (", ".join(sorted(reasons, key=lambda x: text.REASONS.index(x.split()[0]))) or "none")


def render(rows: DataFrame, unresolved: DataFrame, changed: DataFrame, top: int | None = scoring.TOP_ROWS, markdown: bool = False, endpoints: DataFrame | None = None, hidden_count: int = 0) -> str:
    """The report as text."""
    return "\n".join(lines_of(rows, unresolved, changed, top, markdown, endpoints, hidden_count))
