"""Geometries as small driver-side values; membership of rows is tested by Columns."""

from __future__ import annotations

import json
import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import crs as crs_

Ring = list[tuple[float, float]]


class Geometry:
    """points, or polygons as [shell, holes...] with open rings."""

    def __init__(self, points: Ring | None = None, polygons: list[list[Ring]] | None = None, crs=None):
        self.points = [(float(x), float(y)) for x, y in points or []]
        self.polygons = [[[(float(x), float(y)) for x, y in (r[:-1] if len(r) > 1 and r[0] == r[-1] else r)] for r in p] for p in polygons or []]
        self.crs = crs_.CRS(crs)

    def __call__(self):
        return self

    # factories
    @staticmethod
    def Point(*xy, crs=None) -> Geometry:  # noqa: N802
        xy = xy[0] if len(xy) == 1 else xy
        if len(xy) < 2:
            raise ValueError("a point needs x and y")
        return Geometry(points=[tuple(xy[:2])], crs=crs)

    @staticmethod
    def MultiPoint(points, crs=None) -> Geometry:  # noqa: N802
        return Geometry(points=list(points), crs=crs)

    @staticmethod
    def Polygon(rings, crs=None) -> Geometry:  # noqa: N802
        """A shell, or a list of a shell and holes."""
        nested = isinstance(rings[0][0], (list, tuple))
        return Geometry(polygons=[list(rings) if nested else [list(rings)]], crs=crs)

    @staticmethod
    def MultiPolygon(polygons, crs=None) -> Geometry:  # noqa: N802
        return Geometry(polygons=[list(p) if isinstance(p[0][0], (list, tuple)) else [list(p)] for p in polygons], crs=crs)

    @staticmethod
    def Rectangle(*box, crs=None) -> Geometry:  # noqa: N802
        box = box[0] if len(box) == 1 else box
        if len(box) != 4:
            raise ValueError("a rectangle needs minx, miny, maxx, maxy")
        x0, y0, x1, y1 = box
        return Geometry(polygons=[[[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]], crs=crs)

    BBox = Rectangle

    @staticmethod
    def from_geojson(data, crs=None) -> Geometry:
        """A geometry, feature or feature collection; the parts of a collection are gathered."""
        g = json.loads(data) if isinstance(data, str) else data
        kind = g["type"]
        if kind == "FeatureCollection":
            parts = [Geometry.from_geojson(f, crs) for f in g["features"]]
            return Geometry([p for x in parts for p in x.points], [p for x in parts for p in x.polygons], crs)
        if kind == "Feature":
            return Geometry.from_geojson(g["geometry"], crs)
        c = g["coordinates"]
        made = {"Point": lambda: ([c[:2]], []), "MultiPoint": lambda: ([p[:2] for p in c], []), "Polygon": lambda: ([], [[[p[:2] for p in r] for r in c]]), "MultiPolygon": lambda: ([], [[[p[:2] for p in r] for r in q] for q in c])}
        if kind not in made:
            raise ValueError(f"unsupported geometry {kind}")
        return Geometry(*made[kind](), crs)

    @staticmethod
    def from_file(path: str, crs=None) -> Geometry:
        with open(path) as f:
            return Geometry.from_geojson(f.read(), crs)

    # measures
    @property
    def _vertices(self) -> Ring:
        return self.points + [v for p in self.polygons for r in p for v in r]

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*self._vertices, strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def is_box(self) -> bool:
        if len(self.polygons) != 1 or self.points or len(self.polygons[0]) != 1 or len(self.polygons[0][0]) != 4:
            return False
        x0, y0, x1, y1 = self.bounds
        return set(self.polygons[0][0]) == {(x0, y0), (x1, y0), (x1, y1), (x0, y1)}

    @property
    def area(self) -> float:
        return sum(abs(_area(p[0])) - sum(abs(_area(h)) for h in p[1:]) for p in self.polygons)

    @property
    def length(self) -> float:
        return sum(math.dist(a, b) for p in self.polygons for r in p for a, b in zip(r, r[1:] + r[:1], strict=True))

    @property
    def centroid(self) -> Geometry:
        if not self.polygons:
            n = len(self.points)
            return Geometry([(sum(x for x, _ in self.points) / n, sum(y for _, y in self.points) / n)], crs=self.crs)
        total = sx = sy = 0.0
        for p in self.polygons:
            for k, r in enumerate(p):
                sign = 1 if k == 0 else -1
                own, (cx, cy) = abs(_area(r)) * sign, _ring_centroid(r)
                total, sx, sy = total + own, sx + own * cx, sy + own * cy
        return Geometry([(sx / total, sy / total)], crs=self.crs)

    @property
    def convex_hull(self) -> Geometry:
        hull = convex_hull(self._vertices)
        return Geometry(polygons=[[hull]], crs=self.crs) if len(hull) > 2 else Geometry(hull, crs=self.crs)

    def buffer(self, d: float, quad_segs: int = 16) -> Geometry:
        """Points become circles, boxes grow with rounded corners, convex polygons likewise; ValueError for others."""
        turn = [math.pi / 2 * k / quad_segs for k in range(4 * quad_segs)]
        ring = lambda vs: convex_hull([(x + d * math.cos(t), y + d * math.sin(t)) for x, y in vs for t in turn])
        if any(len(p) > 1 or not _convex(p[0]) for p in self.polygons) or d < 0:
            raise ValueError("only points and convex polygons can be buffered, outwards")
        return Geometry(polygons=[[ring([p])] for p in self.points] + [[ring(p[0])] for p in self.polygons], crs=self.crs)

    def simplify(self, tolerance: float, preserve_topology: bool = True) -> Geometry:
        """Douglas-Peucker on each ring; rings keep at least three vertices."""
        return Geometry(self.points, [[_thin(r, tolerance) for r in p] for p in self.polygons], self.crs)

    def reproject(self, dst) -> Geometry:
        if self.crs == dst:
            return self
        move = lambda v: crs_.transform(v[0], v[1], self.crs, dst)
        return Geometry([move(v) for v in self.points], [[[move(v) for v in r] for r in p] for p in self.polygons], dst)

    # relations between values
    def contains_xy(self, x: float, y: float) -> bool:
        """Inside or on the edge of some polygon, or one of the points."""
        return (x, y) in self.points or any(_in_ring(p[0], x, y) >= 0 and all(_in_ring(h, x, y) <= 0 for h in p[1:]) for p in self.polygons)

    def intersects(self, other: Geometry) -> bool:
        crs_.check_compatible(self.crs, other.crs)
        if any(other.contains_xy(*v) for v in self._vertices) or any(self.contains_xy(*v) for v in other._vertices):
            return True
        return any(_cross(*e, *f) for e in self._edges() for f in other._edges())

    def contains(self, other: Geometry) -> bool:
        return all(self.contains_xy(*v) for v in other._vertices) and not any(_cross(*e, *f, proper=True) for e in self._edges() for f in other._edges())

    def _edges(self):
        return [(a, b) for p in self.polygons for r in p for a, b in zip(r, r[1:] + r[:1], strict=True)]

    def _overlay(self, other: Geometry, keep) -> Geometry:
        crs_.check_compatible(self.crs, other.crs)
        return Geometry(polygons=_overlay(self._edges(), other._edges(), keep), crs=self.crs)

    def intersection(self, other: Geometry) -> Geometry:
        """What lies in both: areas of polygons, and points that lie in the other."""
        made = self._overlay(other, lambda a, b: a and b)
        made.points = sorted({p for p in self.points if other.contains_xy(*p)} | {p for p in other.points if self.contains_xy(*p)})
        return made

    def difference(self, other: Geometry) -> Geometry:
        """What lies in the first alone."""
        made = self._overlay(other, lambda a, b: a and not b)
        made.points = [p for p in self.points if not other.contains_xy(*p)]
        return made

    def union(self, other: Geometry) -> Geometry:
        """What lies in either."""
        made = self._overlay(other, lambda a, b: a or b)
        area = Geometry(polygons=self.polygons + other.polygons, crs=self.crs)
        made.points = sorted({p for p in (*self.points, *other.points) if not area.contains_xy(*p)})
        return made

    def symmetric_difference(self, other: Geometry) -> Geometry:
        """What lies in one alone."""
        made = self._overlay(other, lambda a, b: a != b)
        made.points = [p for p in self.points if not other.contains_xy(*p)] + [p for p in other.points if not self.contains_xy(*p)]
        return made

    def __eq__(self, other) -> bool:
        """The same system and the same place, however the rings are written."""
        if not isinstance(other, Geometry) or not self.crs == other.crs or set(self.points) != set(other.points):
            return False
        return bool(self.polygons) == bool(other.polygons) and not _overlay(self._edges(), other._edges(), lambda a, b: a != b)

    __hash__ = None

    # Columns
    def contains_point(self, x: Column, y: Column) -> Column:
        """Whether (x, y) lies inside or on the edge."""
        x0, y0, x1, y1 = self.bounds
        near = x.between(x0, x1) & y.between(y0, y1)
        if self.is_box:
            return near
        made = F.lit(False)
        for px, py in self.points:
            made = made | (x == px) & (y == py)
        for p in self.polygons:
            inside = _ring_column(p[0], x, y)
            for h in p[1:]:
                inside = inside & ~_ring_column(h, x, y)
            made = made | inside
        return near & made

    def meets_box(self, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        """Whether the box (or point) of each row meets the geometry: bounds first, then corners, vertices and edges."""
        a0, b0, a1, b1 = self.bounds
        near = (x0 <= a1) & (x1 >= a0) & (y0 <= b1) & (y1 >= b0)
        if self.is_box:
            return near
        made = self.contains_point(x0, y0) | self.contains_point(x1, y1) | self.contains_point(x0, y1) | self.contains_point(x1, y0)
        for x, y in self._vertices:
            made = made | F.lit(x).between(x0, x1) & F.lit(y).between(y0, y1)
        for (ax, ay), (bx, by) in self._edges():
            # the edge crosses the box: the corners aren't all on one side of its line, and their extents meet
            side = [(cx - ax) * (by - ay) - (cy - ay) * (bx - ax) for cx in (x0, x1) for cy in (y0, y1)]
            cut = ~((F.greatest(*side) < 0) | (F.least(*side) > 0))
            made = made | cut & (x0 <= max(ax, bx)) & (x1 >= min(ax, bx)) & (y0 <= max(ay, by)) & (y1 >= min(ay, by))
        return near & made

    # text and bytes
    def to_geojson(self) -> dict:
        close = lambda r: [list(v) for v in (*r, r[0])]
        if self.polygons:
            rings = [[close(r) for r in p] for p in self.polygons]
            return {"type": "Polygon", "coordinates": rings[0]} if len(rings) == 1 else {"type": "MultiPolygon", "coordinates": rings}
        return {"type": "Point", "coordinates": list(self.points[0])} if len(self.points) == 1 else {"type": "MultiPoint", "coordinates": [list(p) for p in self.points]}

    __geo_interface__ = property(to_geojson)

    def to_wkt(self) -> str:
        pair = lambda v: " ".join(str(int(c)) if c.is_integer() and abs(c) < 1e15 else repr(c) for c in v)
        ring = lambda r: "(" + ", ".join(map(pair, (*r, r[0]))) + ")"
        if self.polygons:
            parts = ["(" + ", ".join(ring(r) for r in p) + ")" for p in self.polygons]
            return f"POLYGON {parts[0]}" if len(parts) == 1 else f"MULTIPOLYGON ({', '.join(parts)})"
        return f"POINT ({pair(self.points[0])})" if len(self.points) == 1 else "MULTIPOINT (" + ", ".join(f"({pair(p)})" for p in self.points) + ")"

    def to_wkb(self) -> bytes:
        """Little-endian WKB of a point, polygon, multipoint or multipolygon."""
        point = lambda v: struct.pack("<BIdd", 1, 1, *v)
        ring = lambda r: struct.pack("<I", len(r) + 1) + b"".join(struct.pack("<dd", *v) for v in (*r, r[0]))
        polygon = lambda p: struct.pack("<BII", 1, 3, len(p)) + b"".join(map(ring, p))
        one, many, parts = (polygon, 6, self.polygons) if self.polygons else (point, 4, self.points)
        return one(parts[0]) if len(parts) == 1 else struct.pack("<BII", 1, many, len(parts)) + b"".join(map(one, parts))


def _area(r: Ring) -> float:
    return sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True)) / 2


def _ring_centroid(r: Ring) -> tuple[float, float]:
    twice = [(ax * by - bx * ay, ax + bx, ay + by) for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True)]
    total = sum(t for t, _, _ in twice)
    if total == 0:
        return sum(x for x, _ in r) / len(r), sum(y for _, y in r) / len(r)
    return sum(t * x for t, x, _ in twice) / (3 * total), sum(t * y for t, _, y in twice) / (3 * total)


def _turn(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex_hull(points: Ring) -> Ring:
    """Counter-clockwise (monotone chain)."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    halves = []
    for run in (points, points[::-1]):
        half: Ring = []
        for p in run:
            while len(half) > 1 and _turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves += half[:-1]
    return halves


def _convex(r: Ring) -> bool:
    turns = [_turn(r[i - 2], r[i - 1], r[i]) for i in range(len(r))]
    return all(t >= 0 for t in turns) or all(t <= 0 for t in turns)


def _overlay(first: list, second: list, keep) -> list[list[Ring]]:
    """The polygons where keep(inside the first, inside the second) holds, by the edges of both.

    The plane is cut into slabs at the heights of all vertices and crossings. Within a slab no edges cross, so walking along it from
    left to right tells where the wanted area begins and ends. Sides of these trapezoids, and the parts of slab borders with area
    on one side only, are the outline, which is then followed into rings.
    """
    edges = [(*min(e, key=lambda v: v[1]), *max(e, key=lambda v: v[1]), k) for k, es in enumerate((first, second)) for e in es if e[0][1] != e[1][1]]
    if not edges:
        return []
    size = max(max(map(abs, e[:4])) for e in edges) or 1.0
    near = size * 1e-12
    heights = {y for e in edges for y in (e[1], e[3])}
    for n, (ax, ay, bx, by, _) in enumerate(edges):
        for cx, cy, dx, dy, _ in edges[:n]:
            turn = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if turn:
                t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / turn, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / turn
                if 0 < t < 1 and 0 <= u <= 1:
                    heights.add(ay + t * (by - ay))
    levels: list[float] = []
    for y in sorted(heights):
        if not levels or y - levels[-1] > near:
            levels.append(y)
    at = lambda e, y: e[0] + (e[2] - e[0]) * (min(max(y, e[1]), e[3]) - e[1]) / (e[3] - e[1])
    known: dict[float, list[float]] = {y: [] for y in levels}

    def corner(x: float, y: float) -> tuple[float, float]:
        for v in known[y]:
            if abs(v - x) <= 8 * near:
                return v, y
        known[y].append(x)
        return x, y

    steps: dict[tuple, list] = {}  # from a corner to others, the area on the left
    floors: dict[float, list[tuple[float, float]]] = {y: [] for y in levels}
    roofs: dict[float, list[tuple[float, float]]] = {y: [] for y in levels}
    for low, high in zip(levels, levels[1:], strict=False):
        middle = (low + high) / 2
        here = sorted(((at(e, middle), e) for e in edges if e[1] < middle < e[3]), key=lambda p: p[0])
        inside, was, k = [False, False], False, 0
        while k < len(here):
            x, e = here[k]
            while k < len(here) and here[k][0] - x <= near:  # edges that lie on each other count together
                inside[here[k][1][4]] ^= True
                k += 1
            now = bool(keep(*inside))
            if now != was:
                a, b = corner(at(e, low), low), corner(at(e, high), high)
                steps.setdefault(b if now else a, []).append(a if now else b)
                (floors[low] if now else roofs[low]).append(a[0])
                known.setdefault(("top", high), []).append(b[0])
            was = now
    for y in levels:
        below = sorted(known.get(("top", y), []))
        above = sorted(floors[y] + roofs[y])
        cuts = sorted({*below, *above})
        for a, b in zip(cuts, cuts[1:], strict=False):
            mid = (a + b) / 2
            under, over = (sum(v < mid for v in side) % 2 == 1 for side in (below, above))
            if under != over:
                p, q = ((a, y), (b, y)) if over else ((b, y), (a, y))
                steps.setdefault(p, []).append(q)
    return _nested([_straight(r) for r in _follow(steps)])


def _follow(steps: dict[tuple, list]) -> list[Ring]:
    """Rings along the steps; at a corner with several ways on, the one that turns left most keeps rings apart."""
    rings = []
    while steps:
        start = next(iter(steps))
        ring, here, before = [], start, None
        while True:
            ways = steps[here]
            if before is not None and len(ways) > 1:
                angle = lambda w, here=here, before=before: -math.atan2(
                    (here[0] - before[0]) * (w[1] - here[1]) - (here[1] - before[1]) * (w[0] - here[0]), (here[0] - before[0]) * (w[0] - here[0]) + (here[1] - before[1]) * (w[1] - here[1])
                )
                ways.sort(key=angle)
            there = ways.pop(0)
            if not ways:
                del steps[here]
            ring.append(here)
            before, here = here, there
            if here == start or here not in steps:
                break
        rings.append(ring)
    return rings


def _straight(r: Ring) -> Ring:
    """Without the corners at which a ring doesn't turn."""
    size = max(max(map(abs, v)) for v in r) or 1.0
    out = [v for k, v in enumerate(r) if abs(_turn(r[k - 1], v, r[(k + 1) % len(r)])) > 1e-12 * size * max(math.dist(r[k - 1], v), math.dist(v, r[(k + 1) % len(r)]))]
    return out if len(out) > 2 else []


def _nested(rings: list[Ring]) -> list[list[Ring]]:
    """Polygons of counter-clockwise shells and the clockwise holes in them."""
    rings = [r for r in rings if r]
    made = [[r] for r in sorted((r for r in rings if _area(r) > 0), key=_area)]
    for h in (r for r in rings if _area(r) < 0):
        x, y = (h[0][0] + h[1][0]) / 2, (h[0][1] + h[1][1]) / 2
        holder = next((p for p in made if _in_ring(p[0], x, y) > 0), None) or next((p for p in made if all(_in_ring(p[0], *v) >= 0 for v in h)), None)
        if holder:
            holder.append(h)
    return made


def _thin(r: Ring, tolerance: float) -> Ring:
    far = max(range(len(r)), key=lambda i: math.dist(r[0], r[i]))
    kept = {0, far}
    stack = [(0, far), (far, len(r))]
    closed = [*r, r[0]]
    while stack:
        a, b = stack.pop()
        (ax, ay), (bx, by) = closed[a], closed[b]
        size = math.hypot(bx - ax, by - ay) or 1.0
        off = [(abs((bx - ax) * (closed[i][1] - ay) - (by - ay) * (closed[i][0] - ax)) / size, i) for i in range(a + 1, b)]
        if off and max(off)[0] > tolerance:
            i = max(off)[1]
            kept.add(i)
            stack += [(a, i), (i, b)]
    thin = [r[i] for i in sorted(kept)]
    return thin if len(thin) > 2 else r


def _in_ring(r: Ring, x: float, y: float) -> int:
    """1 inside, 0 on the edge, -1 outside."""
    odd = False
    for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
        if _turn((ax, ay), (bx, by), (x, y)) == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return 0
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return 1 if odd else -1


def _cross(a, b, c, d, proper: bool = False) -> bool:
    s, t, u, v = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    return s * t < 0 and u * v < 0 if proper else s * t <= 0 and u * v <= 0 and max(a[0], b[0]) >= min(c[0], d[0]) and max(c[0], d[0]) >= min(a[0], b[0]) and max(a[1], b[1]) >= min(c[1], d[1]) and max(c[1], d[1]) >= min(a[1], b[1])


def _ring_column(r: Ring, x: Column, y: Column) -> Column:
    """Inside or on the edge of a ring, by the parity of crossings over an array of its edges."""
    edges = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("ax", "ay", "bx", "by"), (*a, *b), strict=True)]) for a, b in zip(r, r[1:] + r[:1], strict=True)])
    crossed = F.size(F.filter(edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * F.try_divide(y - e["ay"], e["by"] - e["ay"]) + e["ax"])))
    on = F.exists(edges, lambda e: ((e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"])) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])))
    return on | (crossed % 2 == 1)
