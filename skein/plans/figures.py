"""The report's figures as SVG text, from the small tables that they show."""

from __future__ import annotations

from collections.abc import Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

LEFT, ROW, WIDE = 150, 22, 420


def _svg(title: str, body: Sequence[str], rows: int) -> str:
    width, height = LEFT + WIDE + 40, 60 + ROW * rows
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11"><text x="8" y="18" font-size="13">{escape(title)}</text>{"".join(body)}</svg>'


def _label(i: int, text) -> str:
    return f'<text x="{LEFT - 8}" y="{50 + ROW * i}" text-anchor="end">{escape(str(text))}</text>'


def _x(value: float, top: float) -> float:
    return round(LEFT + WIDE * value / top, 1)


def ladder(series: DataFrame, top: int = 6) -> str:
    """bundle_id, paper, low, mean, high: a bar from the weakest to the strongest headline, the paper as a diamond."""
    rows, body = series.orderBy("bundle_id").collect(), []  # a row per bundle
    for i, r in enumerate(rows):
        y = 46 + ROW * i
        body.append(_label(i, r.bundle_id))
        body.append(f'<line x1="{_x(r.low, top)}" x2="{_x(r.high, top)}" y1="{y}" y2="{y}" stroke="#6a8caf" stroke-width="6"/><circle cx="{_x(r.mean, top)}" cy="{y}" r="4" fill="#1f3d5c"/>')
        if r.paper is not None:
            x = _x(r.paper, top)
            body.append(f'<path d="M{x} {y - 6}L{x + 6} {y}L{x} {y + 6}L{x - 6} {y}Z" fill="black"/>')
    body += [f'<text x="{_x(k, top)}" y="{56 + ROW * len(rows)}" text-anchor="middle">{k}</text>' for k in range(top + 1)]
    return _svg("Strength of headlines per bundle; diamond: the paper", body, len(rows))


def bars(rows: Sequence[tuple], title: str) -> str:
    """(label, share, low, high) with shares from 0 to 1; low and high may be None."""
    body = []
    for i, (label, share, low, high) in enumerate(rows):
        y = 38 + ROW * i
        body.append(_label(i, label))
        if share is None:
            continue
        body.append(f'<rect x="{LEFT}" y="{y}" width="{round(WIDE * share, 1)}" height="14" fill="#6a8caf"/><text x="{LEFT + 4}" y="{y + 11}">{100 * share:.1f} %</text>')
        if low is not None and high is not None:
            body.append(f'<line x1="{_x(low, 1)}" x2="{_x(high, 1)}" y1="{y + 7}" y2="{y + 7}" stroke="black"/>')
    return _svg(title, body, len(rows))


def heatmap(rows: Sequence[tuple], columns: Sequence[str], title: str) -> str:
    """(label, percent, ...) with one percent per column; darker is more."""
    step, body = WIDE / max(1, len(columns)), []
    for j, name in enumerate(columns):
        body.append(f'<text x="{LEFT + step * (j + 0.5):.1f}" y="32" text-anchor="middle">{escape(name)}</text>')
    for i, (label, *values) in enumerate(rows):
        body.append(_label(i, label))
        for j, v in enumerate(values):
            if v is not None:
                ink = "white" if v > 60 else "black"
                body.append(f'<rect x="{LEFT + step * j:.1f}" y="{36 + ROW * i}" width="{step:.1f}" height="{ROW}" fill="#1f3d5c" fill-opacity="{v / 100:.2f}"/><text x="{LEFT + step * (j + 0.5):.1f}" y="{51 + ROW * i}" text-anchor="middle" fill="{ink}">{v:.0f}%</text>')
    return _svg(title, body, len(rows))
