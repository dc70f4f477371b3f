"""Reports of findings: rollups as DataFrames, and text, log files and an HTML page from the collected rows.

Findings are at most a few per column, so the writers collect them.
"""

from __future__ import annotations

import html
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillsift.functions.registry import ICONS
from quillsift.operators.score import BY_VALUE

BANDS = ("High", "Medium", "Low")


def shown(findings: DataFrame, print_all: bool = False) -> DataFrame:
    return findings if print_all else findings.where(F.col("confidence") == "High")


def counters(findings: DataFrame) -> DataFrame:
    """tables, and findings by value and by name, each with those of Low confidence."""
    by_value, low = F.col("detector_type") == BY_VALUE, F.col("confidence") == "Low"
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return findings.agg(F.countDistinct("table").alias("tables"), n(by_value).alias("data"), n(~by_value).alias("meta"), n(by_value & low).alias("low_data"), n(~by_value & low).alias("low_meta"))


def summary(findings: DataFrame) -> DataFrame:
    """table, confidence, detector_type, items ("column as Label", in order)."""
    item = F.concat("column", F.lit(" as "), "label")
    return findings.groupBy("table", "confidence", "detector_type").agg(F.array_join(F.array_sort(F.collect_list(item)), ", ").alias("items"))


def _rows(findings: DataFrame, print_all: bool) -> list[Row]:
    return shown(findings, print_all).orderBy("table", "column", F.desc("detector_type"), F.desc("weight"), "label").collect()


def _grid(head: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    wide = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    line = "+".join("-" * (w + 2) for w in wide)
    show = lambda r: "|".join(f" {c.ljust(w)} " for c, w in zip(r, wide))
    return "\n".join([show(head), line, *map(show, rows)])


def text(findings: DataFrame, print_all: bool = False) -> str:
    """Data Scan and Meta Scan tables, with a hint where only High findings are shown."""
    rows, out = _rows(findings, print_all), []
    data = [(r["table"], r["column"], r["label"], f"{ICONS[r['confidence']]} {r['confidence']}", r["detector"], f"{r['matched_count']}/{r['scanned_count']}") for r in rows if r["detector_type"] == BY_VALUE]
    meta = [(r["table"], r["column"], r["label"], f"{ICONS[r['confidence']]} {r['confidence']}") for r in rows if r["detector_type"] != BY_VALUE]
    if data:
        out += ["Data Scan", _grid(("Table", "Column", "Label", "Confidence", "Detector", "Matched/Scanned"), data)]
    if meta:
        out += ["Meta Scan", _grid(("Table", "Column", "Label", "Confidence"), meta)]
    if not rows:
        out.append("No findings" if print_all else "No findings of high confidence")
    if not print_all:
        out.append("Only findings of high confidence are shown; print_all shows the others.")
    return "\n".join(out) + "\n"


def summary_text(findings: DataFrame) -> str:
    """High findings by table and kind of scan."""
    rows = summary(shown(findings)).orderBy("table", "detector_type").collect()
    return "".join(f"{r['table']} ({r['detector_type']}): {r['items']}\n" for r in rows) or "No findings of high confidence\n"


def write_logs(findings: DataFrame, folder: str, print_all: bool = False) -> list[str]:
    """One file for each confidence band: high whenever there are findings, medium and low with ``print_all``."""
    rows, written = _rows(findings, True), []
    os.makedirs(folder, exist_ok=True)
    for band in BANDS if print_all else BANDS[:1]:
        mine = [r for r in rows if r["confidence"] == band]
        if rows and (band == "High" or mine):
            path = os.path.join(folder, f"{band.lower()}_findings.log")
            with open(path, "w", encoding="utf-8") as f:
                f.writelines(f"{r['table']}.{r['column']}\t{r['label']}\t{r['detector_type']}\t{r['weight']:.4f}\t{r['matched_count']}/{r['scanned_count']}\n" for r in mine)
            written.append(path)
    return written


def html_page(findings: DataFrame, title: str = "Scan", print_all: bool = False, per_page: int = 25) -> str:
    """A page with counters, a tab for each kind of scan, match bars, and pages of 15, 25 or 50 rows."""
    c = counters(findings).first()
    cards = "".join(f"<div class=card><b>{c[k]}</b> {name}</div>" for k, name in (("tables", "tables"), ("data", "by value"), ("meta", "by name"), ("low_data", "low by value"), ("low_meta", "low by name")))

    def bar(r: Row) -> str:
        pct = r["matched_count"] * 100 // r["scanned_count"] if r["scanned_count"] else 0
        return f"<meter class={'high' if pct >= 95 else 'medium' if pct >= 70 else 'low'} max=100 value={pct}></meter> {pct}% ({r['matched_count']}/{r['scanned_count']})"

    def line(r: Row) -> str:
        fields = [html.escape(str(r[k])) for k in ("table", "column")] + [f"<span class='chip {r['confidence'].lower()}'>{html.escape(r['label'])}</span>", r["confidence"]]
        return "<tr>" + "".join(f"<td>{f}</td>" for f in [*fields, *([bar(r)] if r["detector_type"] == BY_VALUE else [])]) + "</tr>"

    rows = _rows(findings, print_all)
    tabs = ""
    for name, kind in (("Data Scan", True), ("Meta Scan", False)):
        body = "".join(line(r) for r in rows if (r["detector_type"] == BY_VALUE) == kind)
        head = "".join(f"<th>{h}</th>" for h in ["Table", "Column", "Label", "Confidence", *["Matched"] * kind])
        tabs += f"<details open><summary>{name}</summary><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></details>"
    sizes = "".join(f"<option{' selected' * (n == per_page)}>{n}</option>" for n in (15, 25, 50))
    script = (
        "const s=document.querySelector('select');function show(){document.querySelectorAll('tbody').forEach(b=>{const p=+(b.dataset.p||0),n=+s.value;"
        "[...b.rows].forEach((r,i)=>r.hidden=i<p*n||i>=(p+1)*n)})}s.onchange=show;document.querySelectorAll('button').forEach(q=>q.onclick=()=>{"
        "document.querySelectorAll('tbody').forEach(b=>b.dataset.p=Math.max(0,+(b.dataset.p||0)+(+q.value)));show()});show()"
    )
    style = "body{font:14px sans-serif}.card{display:inline-block;margin:8px}.chip{padding:2px 6px;border-radius:8px}.high{background:#fdd}.medium{background:#ffd}.low{background:#ddf}td,th{padding:4px 8px;text-align:left}"
    return (
        f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><style>{style}</style><h1>{html.escape(title)}</h1>{cards}"
        f"<p>Rows <select>{sizes}</select> <button value=-1>Back</button> <button value=1>Next</button></p>{tabs}<script>{script}</script>"
    )


def write_html(findings: DataFrame, path: str, title: str = "Scan", print_all: bool = False) -> str:
    with open(path, "w", encoding="utf-8") as f:
        f.write(html_page(findings, title, print_all))
    return path
