"""Text forms of results."""

from __future__ import annotations

from pyspark.sql import DataFrame


class Report(dict):
    """A result by name that prints as lines; entries that are lists print on one line each."""

    def __init__(self, title: str, values: dict):
        super().__init__(values)
        self.title = title

    def __repr__(self) -> str:
        lines = [self.title]
        for name, value in self.items():
            lines.append(f"  {name:<18}{_said(value)}")
        p = self.get("p_value")
        if isinstance(p, float):
            lines.append("  " + ("rejected at 5 %" if p < 0.05 else "not rejected at 5 %"))
        return "\n".join(lines)


def _said(value) -> str:
    if isinstance(value, float):
        return f"{value:.4f}"
    if isinstance(value, dict):
        return ", ".join(f"{k}: {_said(v)}" for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return ", ".join(_said(v) for v in value)
    return str(value)


def text(table: DataFrame, title: str = "", rows: int = 100) -> str:
    """A small result table as aligned text: its first rows, and a line that says so if there are more."""
    got = table.limit(rows + 1).collect()
    cells = [table.columns, *[[("" if v is None else _said(v)) for v in r] for r in got[:rows]]]
    width = [max(len(r[i]) for r in cells) for i in range(len(table.columns))]
    lines = ([title] if title else []) + ["  ".join(c.rjust(w) for c, w in zip(r, width, strict=True)) for r in cells]
    return "\n".join(lines + (["..."] if len(got) > rows else []))
