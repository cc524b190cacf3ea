"""Figures of small tables as SVG text: bars, curves and a heat map. No plotting library is needed."""

from __future__ import annotations

from html import escape

WIDTH, HEIGHT, EDGE = 720, 360, 48


def _page(title: str, body: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="11">'
    return "\n".join([head, f'<text x="{EDGE}" y="20" font-size="14">{escape(title)}</text>', *body, "</svg>"])


def bars(rows: list[tuple[str, float]], title: str) -> str:
    """One bar per (label, value); values from 0."""
    most = max((v for _, v in rows), default=0) or 1
    step = (WIDTH - 2 * EDGE) / max(len(rows), 1)
    body = []
    for i, (label, v) in enumerate(rows):
        h = (HEIGHT - 2 * EDGE) * v / most
        x, y = EDGE + i * step, HEIGHT - EDGE - h
        body.append(f'<rect x="{x:.1f}" y="{y:.1f}" width="{0.8 * step:.1f}" height="{h:.1f}" fill="#4878a8"><title>{escape(str(label))}: {v:g}</title></rect>')
        body.append(f'<text x="{x + 0.4 * step:.1f}" y="{HEIGHT - EDGE + 14}" text-anchor="middle">{escape(str(label))}</text>')
    return _page(title, body)


def curves(series: dict[str, list[tuple[float, float]]], title: str) -> str:
    """One line per series of (x, y) points."""
    points = [p for s in series.values() for p in s]
    lo_x, hi_x = min((p[0] for p in points), default=0), max((p[0] for p in points), default=1)
    lo_y, hi_y = min((p[1] for p in points), default=0), max((p[1] for p in points), default=1)
    at = lambda p: f"{EDGE + (WIDTH - 2 * EDGE) * (p[0] - lo_x) / ((hi_x - lo_x) or 1):.1f},{HEIGHT - EDGE - (HEIGHT - 2 * EDGE) * (p[1] - lo_y) / ((hi_y - lo_y) or 1):.1f}"
    body = []
    for i, (name, s) in enumerate(series.items()):
        shade = f"hsl({i * 360 // max(len(series), 1)},60%,40%)"
        body.append(f'<polyline fill="none" stroke="{shade}" points="{" ".join(map(at, s))}"><title>{escape(name)}</title></polyline>')
        body.append(f'<text x="{WIDTH - EDGE}" y="{EDGE + 14 * i}" text-anchor="end" fill="{shade}">{escape(name)}</text>')
    return _page(title, body)


def heat(cells: list[tuple[int, int, float]], size: int, title: str) -> str:
    """A size x size map of (row, column, value): a confusion table, say."""
    most = max((v for *_, v in cells), default=0) or 1
    side = (HEIGHT - 2 * EDGE) / max(size, 1)
    body = [f'<rect x="{EDGE + c * side:.1f}" y="{EDGE + r * side:.1f}" width="{side:.1f}" height="{side:.1f}" fill="#20486f" fill-opacity="{v / most:.3f}"><title>{r}, {c}: {v:g}</title></rect>' for r, c, v in cells]
    return _page(title, body)
