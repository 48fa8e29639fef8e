"""Markdown of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(rows: list[dict], columns: list[str] | None = None) -> str:
    """A table of rows; numbers are rounded to four places, and bars in texts escaped."""
    columns = columns or (list(rows[0]) if rows else [])
    show = lambda v: "" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace("|", r"\|")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows)]) + "\n"


def report(title: str, parts: dict[str, DataFrame], most: int = 200) -> str:
    """A page with a table for each result, of a bounded number of rows."""
    out = [f"# {title}\n"]
    for name, df in parts.items():
        rows = [r.asDict() for r in df.limit(most + 1).collect()]
        out.append(f"## {name}\n\n{table(rows[:most], df.columns)}" + (f"\n(first {most} rows)\n" if len(rows) > most else ""))
    return "\n".join(out)


def mean_sd(mean: float, sd: float) -> str:
    return f"{mean:.4f}±{sd:.4f}"
