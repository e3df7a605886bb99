"""Report sinks for small tables."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Rows that a report may have; larger tables belong into Parquet.
MOST_ROWS = 10_000


def write_json(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").json(path)


def markdown(table: DataFrame, formats: dict[str, str] | None = None, order: tuple[str, ...] = ()) -> str:
    """table as Markdown; formats has a format for a column, such as ``.3f`` or ``.1%``."""
    rows = (table.orderBy(*order) if order else table).take(MOST_ROWS + 1)
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    formats = formats or {}
    cell = lambda name, v: "-" if v is None else format(v, formats.get(name, ""))
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(c, r[c]) for c in table.columns) + " |" for r in rows]) + "\n"


def curve(table: DataFrame, path: str, x: str = "docs", y: str = "recall", label: str = "config", size: tuple[int, int] = (640, 400)) -> None:
    """The points of a small table and the line through them by rising x, as an SVG file on the driver."""
    rows = table.select(x, y, label).orderBy(x, y).take(MOST_ROWS)
    low, high = [[f(float(r[k]) for r in rows) if rows else 0.0 for k in (0, 1)] for f in (min, max)]
    width, height = size
    spot = lambda r: tuple(40 + (n - 80) * ((float(r[k]) - low[k]) / ((high[k] - low[k]) or 1.0)) for k, n in ((0, width), (1, height)))
    points = [(a, height - b) for a, b in map(spot, rows)]
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">']
    parts.append(f'<polyline fill="none" stroke="black" points="{" ".join(f"{a:.1f},{b:.1f}" for a, b in points)}"/>')
    parts += [f'<circle cx="{a:.1f}" cy="{b:.1f}" r="3"><title>{escape(str(r[2]))}</title></circle>' for (a, b), r in zip(points, rows)]
    parts += [f'<text x="{width // 2}" y="{height - 8}">{escape(x)}</text>', f'<text x="4" y="16">{escape(y)}</text>', "</svg>"]
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(parts) + "\n")
