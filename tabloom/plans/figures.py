"""Plain SVG charts of a few dozen points."""

from __future__ import annotations

from collections.abc import Sequence
from xml.sax.saxutils import escape

INK, GREY, FILL = "#222", "#ccc", "#3a6ea5"


def _svg(width: int, height: int, title: str, parts: Sequence[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12" fill="{INK}">'
    return "\n".join([head, f'<rect width="{width}" height="{height}" fill="#fff"/>', f'<text x="12" y="20" font-size="14" font-weight="bold">{escape(title)}</text>', *parts, "</svg>\n"])


def _label(x, most: int = 24) -> str:
    s = "(missing)" if x is None else str(x)
    return escape(s if len(s) <= most else s[: most - 1] + "…")


def bars(points: Sequence[tuple], title: str) -> str:
    """A horizontal bar for each (label, value); unknown values have none, negative ones go left of zero."""
    values = [v for _, v in points if v is not None]
    low, high = min([0, *values]), max([0, *values])
    scale = 360 / ((high - low) or 1)
    zero = 200 - low * scale
    parts = []
    for k, (label, v) in enumerate(points):
        y = 40 + 20 * k
        parts.append(f'<text x="190" y="{y + 11}" text-anchor="end">{_label(label)}</text>')
        if v is not None:
            x, w = (zero, v * scale) if v >= 0 else (zero + v * scale, -v * scale)
            parts.append(f'<rect x="{x:.1f}" y="{y}" width="{w:.1f}" height="14" fill="{FILL}"/><text x="{max(x + w, zero) + 4:.1f}" y="{y + 11}">{v:.4g}</text>')
    parts.append(f'<line x1="{zero:.1f}" y1="34" x2="{zero:.1f}" y2="{44 + 20 * len(points)}" stroke="{GREY}"/>')
    return _svg(660, 60 + 20 * len(points), title, parts)


def line(points: Sequence[tuple], title: str) -> str:
    """A line through (label, value) in order, with the first and last label and the range of values."""
    values = [v or 0 for _, v in points]
    if not values:
        return _svg(660, 60, title, [])
    low, high = min(0, *values), max(values)
    at = [(60 + 560 * k / max(len(values) - 1, 1), 240 - 200 * (v - low) / ((high - low) or 1)) for k, v in enumerate(values)]
    path = " ".join(f"{x:.1f},{y:.1f}" for x, y in at)
    marks = [f'<text x="54" y="{y}" text-anchor="end">{v:.4g}</text><line x1="60" y1="{y - 4}" x2="620" y2="{y - 4}" stroke="{GREY}"/>' for v, y in ((high, 44), (low, 244))]
    ends = [f'<text x="60" y="262">{_label(points[0][0])}</text>', f'<text x="620" y="262" text-anchor="end">{_label(points[-1][0])}</text>']
    return _svg(660, 280, title, [*marks, f'<polyline points="{path}" fill="none" stroke="{FILL}" stroke-width="2"/>', *ends])
