"""Tables, tick labels, scale bars and web maps: driver-side text over collected rows."""

from __future__ import annotations

import html
import json
import math
import warnings
from bisect import bisect_left
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators.vector import FeatureCollection
from ..sources.features import geojson

#: Lengths in metres that a scale bar may have.
BAR_LENGTHS = (10, 25, 50, 100, 200, 250, 500, 1000, 2000, 2500, 5000, 10000, 15000, 20000, 25000, 50000, 100000, 200000, 500000, 1000000)
BASEMAPS = {"osm": "https://tile.openstreetmap.org/{z}/{x}/{y}.png"}


def degree_label(value: float, is_lat: bool, form: str = "DD", precision: int = 2) -> str:
    """A coordinate as decimal degrees (DD), degrees and minutes (DM), or degrees, minutes and seconds (DMS).

    It is rounded once, to the label's smallest unit (a tenth of a minute, a second), so that no part reaches 60.
    """
    letter = ("S" if is_lat else "W") if value < 0 else ("N" if is_lat else "E")
    kind = form.upper()
    if kind == "DMS":
        degrees, seconds = divmod(round(abs(value) * 3600), 3600)
        said = f"{degrees}° {seconds // 60:02d}' {seconds % 60:02d}\""
    elif kind == "DM":
        degrees, tenths = divmod(round(abs(value) * 600), 600)
        said = f"{degrees}° {tenths // 10:02d}.{tenths % 10}'"
    else:
        said = f"{abs(value):.{precision}f}°"
    return f"{said} {letter}"


def degree_precision(span: float) -> int:
    """Decimals that keep tick labels apart: two, and one more for each limit that the span of degrees lies below."""
    return 2 + sum(span < limit for limit in (0.05, 0.005))


def bar_length(width_m: float, max_fraction: float = 0.25) -> float:
    """The listed length nearest to that fraction of the map's width, the shorter of two as near."""
    goal = width_m * max_fraction
    above = bisect_left(BAR_LENGTHS, goal)
    around = BAR_LENGTHS[max(0, above - 1) : above + 1]
    return around[0] if len(around) == 1 or goal - around[0] <= around[1] - goal else around[1]


def scale_bar(width_m: float, max_fraction: float = 0.25, length_m: float | None = None) -> tuple[float, str]:
    """(metres, label) of a bar of the given length, or else of the one that suits the map's width."""
    metres = length_m if (length_m or 0) > 0 else bar_length(width_m, max_fraction)
    label = f"{int(metres)} m" if metres < 1000 else f"{metres / 1000:g} km"
    return metres, label


class Table:
    """A small result as Markdown, LaTeX, HTML or CSV."""

    def __init__(self, data: DataFrame | list[dict], caption: str = ""):
        rows = [r.asDict() for r in data.collect()] if isinstance(data, DataFrame) else list(data)
        self.names = list(data.columns) if isinstance(data, DataFrame) else list(rows[0]) if rows else []
        self.rows, self.caption = [[r[n] for n in self.names] for r in rows], caption

    @staticmethod
    def _cell(v) -> str:
        return "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)

    def to_markdown(self) -> str:
        line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
        return "\n".join([line(self.names), line(["---"] * len(self.names)), *(line(map(self._cell, r)) for r in self.rows)])

    def to_latex(self) -> str:
        safe = lambda s: "".join("\\" + c if c in "&%$#_{}" else c for c in s)
        line = lambda cells: " & ".join(map(safe, cells)) + r" \\"
        body = [line(self.names), r"\midrule", *(line(map(self._cell, r)) for r in self.rows)]
        return "\n".join([r"\begin{table}", rf"\caption{{{safe(self.caption)}}}", rf"\begin{{tabular}}{{{'l' * len(self.names)}}}", r"\toprule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])

    def to_html(self) -> str:
        row = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
        return f"<table><caption>{html.escape(self.caption)}</caption>{row('th', self.names)}{''.join(row('td', map(self._cell, r)) for r in self.rows)}</table>"

    def to_csv(self) -> str:
        quote = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n') else s
        return "\n".join(",".join(map(quote, r)) for r in [self.names, *([("" if v is None else str(v)) for v in r] for r in self.rows)]) + "\n"

    def save(self, path: str) -> None:
        """By the ending: .tex, .md, .html, else CSV."""
        made = {".tex": self.to_latex, ".md": self.to_markdown, ".html": self.to_html}.get(Path(path).suffix, self.to_csv)
        Path(path).write_text(made())


class Map:
    """A Leaflet page with feature layers, legends and colour bars; all data is escaped for script and markup."""

    def __init__(self, center: tuple[float, float] = (0.0, 0.0), zoom: int = 2):
        self.center, self.zoom = center, zoom
        self.basemap, self.layers, self.legends, self.colorbars = BASEMAPS["osm"], [], [], []

    def setCenter(self, lon: float, lat: float, zoom: int = 8) -> Map:
        self.center, self.zoom = (lat, lon), zoom
        return self

    def centerObject(self, fc: FeatureCollection) -> Map:
        x0, y0, x1, y1 = fc.reproject(4326).bounds
        span = max(x1 - x0, y1 - y0, 1e-6)
        return self.setCenter((x0 + x1) / 2, (y0 + y1) / 2, max(1, min(18, int(math.log2(360 / span)))))

    def add_basemap(self, name: str = "osm") -> Map:
        self.basemap = BASEMAPS.get(name, name)
        return self

    def addLayer(self, fc: FeatureCollection, style: dict | None = None, name: str = "layer", limit: int = 10_000) -> Map:
        """The first features by fid, in degrees; a warning tells where there are more than limit."""
        if fc.df.limit(limit + 1).count() > limit:
            warnings.warn(f"layer {name!r} shows the first {limit} features only", UserWarning, stacklevel=2)
        shown = fc.limit(limit)
        shown = shown if fc.crs.is_geographic else shown.reproject(4326)
        features = [json.loads(r.value) for r in geojson(shown).collect()]
        self.layers.append({"name": name, "style": style or {}, "data": {"type": "FeatureCollection", "features": features}})
        return self

    def add_legend(self, title: str, items: dict[str, str]) -> Map:
        self.legends.append({"title": title, "items": items})
        return self

    def add_colorbar(self, palette: list[str], low: float, high: float, label: str = "") -> Map:
        self.colorbars.append({"palette": palette, "low": low, "high": high, "label": label})
        return self

    def to_html(self) -> str:
        safe = lambda v: json.dumps(v).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
        esc = lambda s: html.escape(str(s), quote=True)
        legends = "".join(f"<div class='legend'><b>{esc(g['title'])}</b>{''.join(f'<div><i style=\"background:{esc(c)}\"></i>{esc(n)}</div>' for n, c in g['items'].items())}</div>" for g in self.legends)
        bars = "".join(f"<div class='legend'>{esc(b['label'])} {b['low']:g}<span style='background:linear-gradient(to right,{esc(','.join(b['palette']))})'></span>{b['high']:g}</div>" for b in self.colorbars)
        return (
            "<!DOCTYPE html><html><head><meta charset='utf-8'><link rel='stylesheet' href='https://unpkg.com/leaflet@1.9.4/dist/leaflet.css'>"
            "<script src='https://unpkg.com/leaflet@1.9.4/dist/leaflet.js'></script></head><body><div id='map' style='height:90vh'></div>"
            f"{legends}{bars}<script>const map = L.map('map').setView({safe(list(self.center))}, {safe(self.zoom)});"
            f"L.tileLayer({safe(self.basemap)}).addTo(map); const layers = {safe(self.layers)}; const control = L.control.layers({{}}, {{}}).addTo(map);"
            "for (const l of layers) { control.addOverlay(L.geoJSON(l.data, {style: l.style}).addTo(map), l.name); }</script></body></html>"
        )

    _repr_html_ = to_html

    def save(self, path: str) -> None:
        Path(path).write_text(self.to_html())
