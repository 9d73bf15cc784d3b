"""Small reports of aggregated tables: HTML and LaTeX text. Tables are cut at a number of rows and columns, as a report is."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame


def html_table(df: DataFrame, title: str, most_rows: int = 100, most_columns: int = 10) -> str:
    columns = df.columns[:most_columns]
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else f'{v:.4g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in df.select(*columns).limit(most_rows).collect())
    return f"<section><h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table></section>"


def html_report(title: str, sections: dict[str, DataFrame]) -> str:
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>" + "".join(html_table(df, name) for name, df in sections.items())


def latex_table(df: DataFrame, caption: str, most_rows: int = 50) -> str:
    cell = lambda v: "--" if v is None else f"{v:,.2f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    rows = " \\\\\n".join(" & ".join(map(cell, r)) for r in df.limit(most_rows).collect())
    return f"\\begin{{table}}\n\\caption{{{caption}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{' & '.join(map(cell, df.columns))} \\\\\n\\hline\n{rows} \\\\\n\\end{{tabular}}\n\\end{{table}}\n"
