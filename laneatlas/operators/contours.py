"""Kernels over binary images: components, outer contours, boxes, hulls and repaired rings; areas, moments and features are columns (functions/polygons.py)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneatlas.functions import polygons
from laneatlas.session import ship

#: Clockwise neighbours (dr, dc) from east.
_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, last column) of the runs of set pixels, in reading order."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Labels from 1 in reading order of their first pixel; 0 is background. 8-connected, without `diagonal` 4-connected.

    Runs of the rows are linked to those they touch in the row above, and labels sink to the smallest linked one: work by runs, not by pixels."""
    row, first, last = _runs(mask)
    n, wide, by = len(row), mask.shape[1] + 3, int(diagonal)
    above = (row - 1) * wide
    lo = np.searchsorted(row * wide + last, above + first - by)
    hi = np.searchsorted(row * wide + first, above + last + by, side="right")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    number = np.cumsum(root == np.arange(n))[root]
    label = np.zeros(mask.shape, np.int32)
    flat, size = label.reshape(-1), last - first + 1
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(row * mask.shape[1] + first, size)
    flat[at] = np.repeat(number, size)
    return label


def outermost(mask: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The labels that lie in no hole of another: those that touch the background that reaches the border."""
    ground = components(~np.pad(mask, 1), diagonal=False)
    open_ = ground == ground[0, 0]
    beside = open_[:-2, 1:-1] | open_[2:, 1:-1] | open_[1:-1, :-2] | open_[1:-1, 2:]
    return np.unique(label[beside & mask])


def outline(part: np.ndarray) -> list[tuple[int, int]]:
    """Outer border (x, y) of one component, traced about it from its first pixel, runs of one direction reduced to their ends."""
    wide = part.shape[1] + 2
    on = np.pad(part, 1).tobytes()
    steps = [dr * wide + dc for dr, dc in _AROUND]
    start = at = on.index(1)
    path, way, first = [start], 7, None
    while True:
        for k in range(8):
            d = (way + k) % 8
            if on[at + steps[d]]:
                break
        else:
            return [(start % wide - 1, start // wide - 1)]
        if first is None:
            first = d
        elif at == start and d == first:
            break
        at += steps[d]
        path.append(at)
        way = (d + 6) % 8 if d % 2 == 0 else (d + 5) % 8
    path.pop()
    points = [(p % wide - 1, p // wide - 1) for p in path]
    if len(path) < 3:
        return points
    turn = [path[i - 1] + path[(i + 1) % len(path)] != 2 * path[i] for i in range(len(path))]
    return [p for p, t in zip(points, turn, strict=True) if t]


def shoelace(ring: list[tuple[float, float]]) -> float:
    """Polygon area through the points (not a count of pixels)."""
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def perimeter(ring: list[tuple[float, float]]) -> float:
    return sum(math.dist(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(p[::-1])


def rotated_box(points: list[tuple[float, float]]) -> tuple[float, float, float]:
    """(width, height, angle in radians) of the smallest rectangle, one side of which lies along a side of the hull."""
    h = hull(points)
    if len(h) < 2:
        return 0.0, 0.0, 0.0
    best = (math.inf, 0.0, 0.0, 0.0)
    p = np.array(h, float)
    for a, b in zip(h, h[1:] + h[:1], strict=True):
        t = math.atan2(b[1] - a[1], b[0] - a[0])
        u, v = p @ (math.cos(t), math.sin(t)), p @ (-math.sin(t), math.cos(t))
        w, g = float(np.ptp(u)), float(np.ptp(v))
        best = min(best, (w * g, w, g, t))
    return best[1:]


def simplified(ring: list[tuple[float, float]], share: float = 0.02) -> list[tuple[float, float]]:
    """Points that stray more than share of the perimeter; rings of 4 points at most stay as they are."""
    if len(ring) <= 4:
        return ring
    eps = share * perimeter(ring)

    def reduce(part):
        a, b = part[0], part[-1]
        base = math.dist(a, b)
        away = [abs((b[0] - a[0]) * (a[1] - p[1]) - (a[0] - p[0]) * (b[1] - a[1])) / base if base else math.dist(a, p) for p in part]
        i = max(range(len(part)), key=away.__getitem__)
        return reduce(part[: i + 1])[:-1] + reduce(part[i:]) if away[i] > eps else [a, b]

    far = max(range(len(ring)), key=lambda i: math.dist(ring[0], ring[i]))
    return reduce(ring[: far + 1])[:-1] + reduce(ring[far:] + ring[:1])[:-1]


def crossings(ring: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """Pairs of sides that cross inside both. A sweep over x: a side meets those that begin before it ends."""
    n = len(ring)
    p = np.array(ring, float)
    q = np.roll(p, -1, axis=0)
    order = np.argsort(np.minimum(p[:, 0], q[:, 0]), kind="stable")
    a, b = p[order], q[order]
    low, high = np.minimum(a, b), np.maximum(a, b)
    ends = np.searchsorted(low[:, 0], high[:, 0], side="right")
    side = lambda a, b, c: (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
    out = []
    for i in range(n):
        j = np.arange(i + 1, ends[i])
        j = j[(low[j, 1] <= high[i, 1]) & (high[j, 1] >= low[i, 1])]
        cross = (side(a[i], b[i], a[j]) * side(a[i], b[i], b[j]) < 0) & (side(a[j], b[j], a[i]) * side(a[j], b[j], b[i]) < 0)
        out += [tuple(sorted((int(order[i]), int(order[k])))) for k in j[cross]]
    return sorted(out)


def touches(ring: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """(corner, side) where a corner lies on a side that it does not end, or on another corner (as the first point of that one's side)."""
    p = np.array(ring, float)
    q = np.roll(p, -1, axis=0)
    order = np.argsort(p[:, 0], kind="stable")
    xs = p[order, 0]
    out = []
    for i in range(len(ring)):
        (ax, ay), (bx, by) = p[i], q[i]
        k = order[np.searchsorted(xs, min(ax, bx)) : np.searchsorted(xs, max(ax, bx), side="right")]
        x, y = p[k, 0], p[k, 1]
        on = ((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & (y >= min(ay, by)) & (y <= max(ay, by)) & ~((x == bx) & (y == by) & ((bx != ax) | (by != ay)))
        out += [(int(j), i) for j in k[on] if j != i]
    return out


def valid(ring: list[tuple[float, float]]) -> bool:
    """At least three points, no two sides that cross, and no corner on another side or corner."""
    return len(ring) >= 3 and not crossings(ring) and not touches(ring)


def split(ring: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """The simple rings that bound what a crossing ring winds around, outer ones counterclockwise (area positive), holes clockwise.

    Sides are cut where they cross; the pieces part the plane into faces, whose winding numbers follow from the outside inwards; the
    pieces between a face that is wound around and one that is not are joined to rings."""
    n = len(ring)
    cuts: dict[int, list[tuple[float, float]]] = {}
    for i, j in crossings(ring):
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n]
        t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / ((bx - ax) * (dy - cy) - (by - ay) * (dx - cx))
        at = (round(ax + t * (bx - ax), 9), round(ay + t * (by - ay), 9))
        cuts.setdefault(i, []).append(at)
        cuts.setdefault(j, []).append(at)
    for j, i in touches(ring):
        cuts.setdefault(i, []).append(ring[j])
    times: dict[tuple, int] = {}  # how often the ring goes along a piece, less the other way
    for i in range(n):
        a = ring[i]
        way = [a, *sorted(cuts.get(i, []), key=lambda p: math.dist(a, p)), ring[(i + 1) % n]]
        for p, q in zip(way, way[1:], strict=False):
            p, q = (float(p[0]), float(p[1])), (float(q[0]), float(q[1]))
            if p != q:
                times[p, q] = times.get((p, q), 0) + 1
                times[q, p] = times.get((q, p), 0) - 1
    spokes: dict[tuple, list] = {}
    for p, q in times:
        spokes.setdefault(p, []).append(q)
    for p, around in spokes.items():
        around.sort(key=lambda q: math.atan2(q[1] - p[1], q[0] - p[0]))
    place = {(p, q): k for p, around in spokes.items() for k, q in enumerate(around)}
    after = lambda p, q: (q, spokes[q][place[q, p] - 1])  # the next piece of the face on the left
    face: dict[tuple, int] = {}
    faces: list[list[tuple]] = []
    for piece in times:
        if piece not in face:
            way, at = [], piece
            while at not in face:
                face[at] = len(faces)
                way.append(at)
                at = after(*at)
            faces.append(way)
    if not faces:
        return []
    turn = lambda way: sum(p[0] * q[1] - q[0] * p[1] for p, q in way) / 2
    outside = min(range(len(faces)), key=lambda k: turn(faces[k]))
    winding, todo = {outside: 0}, [outside]
    while todo:
        for p, q in faces[todo.pop()]:
            other = face[q, p]
            if other not in winding:
                winding[other] = winding[face[p, q]] - times[p, q]
                todo.append(other)
    border = {(p, q) for p, q in times if winding[face[p, q]] and not winding[face[q, p]]}
    out = []
    while border:
        at = start = min(border)
        way = []
        while True:
            border.discard(at)
            way.append(at[0])
            p, q = at
            k = place[q, p]
            at = next((q, spokes[q][(k - s) % len(spokes[q])]) for s in range(1, len(spokes[q]) + 1) if (q, spokes[q][(k - s) % len(spokes[q])]) in border or (q, spokes[q][(k - s) % len(spokes[q])]) == start)
            if at == start:
                break
        out.append(way)
    return out


def repaired(ring: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """The rings of a valid shape: the ring itself if no two sides cross or it is a line of fewer than three points, else those of split()."""
    return [ring] if len(ring) < 3 or valid(ring) else split(ring)


def filled(ring: list[tuple[float, float]], high: int, wide: int) -> np.ndarray:
    """Pixels inside or on a polygon: the crossings of each row in pairs, and the sides' own pixels. The relational form is operators/fill.py."""
    out = np.zeros((high, wide), bool)
    rows: dict[int, list[float]] = {}
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        for y in range(max(0, math.ceil(min(y1, y2))), min(high - 1, math.floor(max(y1, y2))) + 1):
            if y1 == y2:
                a, b = sorted((x1, x2))
            else:
                a = b = x1 + (x2 - x1) * (y - y1) / (y2 - y1)
                if min(y1, y2) <= y < max(y1, y2):
                    rows.setdefault(y, []).append(a)
            a, b = max(0, math.ceil(a - 1e-9)), min(wide - 1, math.floor(b + 1e-9))
            out[y, a : max(0, b + 1)] = True
    for y, xs in rows.items():
        xs.sort()
        for a, b in zip(xs[::2], xs[1::2], strict=True):
            out[y, max(0, math.ceil(a)) : max(0, math.floor(b) + 1)] = True
    return out


#: Columns of a component's row after its key: what needs a walk over pixels or points; the rest follows from the ring by column functions.
_SHAPE = "part int, n_pixels int, ring array<struct<x:int,y:int>>, x int, y int, w int, h int, hull_area double, long double, short double, parts array<array<struct<x:double,y:double>>>"


def shapes_of(image: np.ndarray, external: bool = False) -> Iterator[tuple]:
    """For each component of a binary image: part, n_pixels, ring, x, y, w, h, hull_area, long, short, parts."""
    label = components(image)
    ys, xs = np.nonzero(label)
    order = np.argsort(label[ys, xs], kind="stable")
    ends = np.cumsum(np.bincount(label[ys, xs])[1:]) if len(ys) else np.zeros(0, int)
    kept = set(outermost(image, label).tolist()) if external else None
    for part, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False), 1):
        if kept is not None and part not in kept:
            continue
        r, c = ys[order[a:b]], xs[order[a:b]]
        top, left = int(r.min()), int(c.min())
        own = np.zeros((int(r.max()) - top + 1, int(c.max()) - left + 1), bool)
        own[r - top, c - left] = True
        ring = [(x + left, y + top) for x, y in outline(own)]
        w, h, _ = rotated_box(ring)
        points = lambda ring, kind: [{"x": kind(x), "y": kind(y)} for x, y in ring]
        yield part, b - a, points(ring, int), left, top, own.shape[1], own.shape[0], shoelace(hull(ring)), max(w, h), min(w, h), [points(p, float) for p in repaired(simplified(ring))]


def measured(found: DataFrame) -> DataFrame:
    """Rows of shapes_of() with area, perimeter, features and simple (the first of the repaired parts, on whole pixels), all by column functions of the ring."""
    c = F.col
    out = found.withColumn("area", polygons.area(c("ring"))).withColumn("perimeter", polygons.perimeter(c("ring")))
    out = out.withColumn("features", polygons.vector(c("ring"), c("area"), c("perimeter"), c("hull_area"), c("w"), c("h"), c("long"), c("short")))
    whole = F.transform(F.coalesce(F.get("parts", F.lit(0)), F.array().cast("array<struct<x:double,y:double>>")), lambda p: F.struct(F.round(p["x"]).cast("int").alias("x"), F.round(p["y"]).cast("int").alias("y")))
    return out.withColumn("simple", whole)


def contours(mask: DataFrame, key: str, high: int, wide: int, external: bool = False, chain: Callable[[np.ndarray], np.ndarray] | None = None, value: str = "gray") -> DataFrame:
    """mask (key, r, c of set pixels) to one row a component: key, part, n_pixels, ring, area, perimeter, x, y, w, h, hull_area, long, short, features,
    parts (the rings left when the ring is simplified by 2 % of its length and repaired) and simple (the first of them). external: without
    components that lie in holes of others. chain: makes the mask of gray images (key, r, c, value), in the same task. One shuffle, by image;
    each component is looked at within its own box."""
    ship(mask.sparkSession)
    gray = [value] * (chain is not None)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((high, wide), bool if chain is None else np.uint8)
        image[pdf["r"].to_numpy(), pdf["c"].to_numpy()] = True if chain is None else pdf[value].to_numpy()
        rows = [(pdf[key].iloc[0], *s) for s in shapes_of(image if chain is None else chain(image), external)]
        return pd.DataFrame(rows, columns=[key, "part", "n_pixels", "ring", "x", "y", "w", "h", "hull_area", "long", "short", "parts"])

    found = mask.select(key, "r", "c", *gray).groupBy(key).applyInPandas(run, f"{key} {dict(mask.dtypes)[key]}, {_SHAPE}")
    return measured(found)
