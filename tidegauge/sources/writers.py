"""Exporting results: data formats by Spark, small reports as text, Markdown, HTML, JSON or CSV."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame


def write_series(series: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    writer = series.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        getattr(writer, kind)(path)


def _cell(v: object, digits: int) -> str:
    return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def render(df: DataFrame, kind: str = "markdown", digits: int = 4, most: int = 1000, title: str = "Results") -> str:
    """A summary frame as text; frames of more than ``most`` rows are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write the frame instead")
    cells = [[_cell(v, digits) for v in r] for r in rows]
    if kind == "json":
        return json.dumps([{c: round(v, digits) if isinstance(v, float) else v for c, v in r.asDict(True).items()} for r in rows], default=str, indent=1)
    if kind == "csv":
        quote = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n') else x
        return "\n".join(",".join(map(quote, r)) for r in [df.columns, *cells]) + "\n"
    if kind == "markdown":
        bar = lambda x: x.replace("|", "\\|")
        return "\n".join([f"# {title}", "", "| " + " | ".join(map(bar, df.columns)) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(map(bar, r)) + " |" for r in cells]]) + "\n"
    if kind == "html":
        row = lambda r, t: "<tr>" + "".join(f"<{t}>{html.escape(x)}</{t}>" for x in r) + "</tr>"
        return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>{row(df.columns, 'th')}{''.join(row(r, 'td') for r in cells)}</table></body></html>"
    if kind == "text":
        widths = [max(len(c), *[len(r[i]) for r in cells], 0) if cells else len(c) for i, c in enumerate(df.columns)]
        line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip()
        return "\n".join([title, line(df.columns), *map(line, cells)]) + "\n"
    raise ValueError(f"no format {kind}")


def export(df: DataFrame, path: str, kind: str = "markdown", **options) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(render(df, kind, **options))
