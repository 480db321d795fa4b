"""Column functions of rings, array<struct<x, y>> in order, closed by their first point: Green's theorem as folds over the sides."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from laneatlas.functions import shapes

#: Orders (p, q) of the moments, and the divisors that Green's theorem gives them.
ORDERS = {(0, 0): 2, (1, 0): 6, (0, 1): 6, (2, 0): 12, (1, 1): 24, (0, 2): 12, (3, 0): 20, (2, 1): 60, (1, 2): 60, (0, 3): 20}


def sides(ring: Column) -> Column:
    """array<struct<x0, y0, x1, y1>> from each point to the next, the last to the first, as doubles from the ring's first point, which keeps numbers small."""
    first = F.element_at(ring, 1)
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    at = lambda p, k: (p[k] - first[k]).cast("double")
    return F.zip_with(ring, after, lambda a, b: F.struct(at(a, "x").alias("x0"), at(a, "y").alias("y0"), at(b, "x").alias("x1"), at(b, "y").alias("y1")))


def _total(over: Column, term) -> Column:
    return F.aggregate(over, F.lit(0.0), lambda acc, s: acc + term(s))


def area(ring: Column) -> Column:
    """Area enclosed, whatever the ring's direction; 0 for fewer than three points."""
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(_total(sides(ring), lambda s: s["x0"] * s["y1"] - s["x1"] * s["y0"])) / 2)


def perimeter(ring: Column) -> Column:
    return F.when(F.size(ring) < 2, F.lit(0.0)).otherwise(_total(sides(ring), lambda s: F.hypot(s["x1"] - s["x0"], s["y1"] - s["y0"])))


def moments(ring: Column) -> Column:
    """struct m00 ... m03 of the region, about the ring's first point, positive for either direction."""

    def add(acc: Column, s: Column) -> Column:
        x0, y0, x1, y1 = s["x0"], s["y0"], s["x1"], s["y1"]
        turn = x0 * y1 - x1 * y0
        terms = {
            (0, 0): F.lit(1.0), (1, 0): x0 + x1, (0, 1): y0 + y1, (2, 0): x0 * x0 + x0 * x1 + x1 * x1, (0, 2): y0 * y0 + y0 * y1 + y1 * y1,
            (1, 1): x0 * (2 * y0 + y1) + x1 * (y0 + 2 * y1), (3, 0): (x0 + x1) * (x0 * x0 + x1 * x1), (0, 3): (y0 + y1) * (y0 * y0 + y1 * y1),
            (2, 1): x0 * x0 * (3 * y0 + y1) + 2 * x0 * x1 * (y0 + y1) + x1 * x1 * (y0 + 3 * y1),
            (1, 2): y0 * y0 * (3 * x0 + x1) + 2 * y0 * y1 * (x0 + x1) + y1 * y1 * (x0 + 3 * x1),
        }
        return F.struct(*[(acc[f"m{p}{q}"] + turn * terms[p, q]).alias(f"m{p}{q}") for p, q in ORDERS])

    zero = F.struct(*[F.lit(0.0).alias(f"m{p}{q}") for p, q in ORDERS])
    done = lambda m: F.struct(*[(F.when(m["m00"] < 0, -1.0).otherwise(1.0) * m[f"m{p}{q}"] / d).alias(f"m{p}{q}") for (p, q), d in ORDERS.items()])
    return F.aggregate(sides(ring), zero, add, done)


def hu(m: Column) -> Column:
    """The first four invariants of moments, array<double>; zeros for a region without area."""
    x, y = m["m10"] / m["m00"], m["m01"] / m["m00"]
    mu = {
        (2, 0): m["m20"] - x * m["m10"], (1, 1): m["m11"] - x * m["m01"], (0, 2): m["m02"] - y * m["m01"],
        (3, 0): m["m30"] - 3 * x * m["m20"] + 2 * x * x * m["m10"], (0, 3): m["m03"] - 3 * y * m["m02"] + 2 * y * y * m["m01"],
        (2, 1): m["m21"] - 2 * x * m["m11"] - y * m["m20"] + 2 * x * x * m["m01"], (1, 2): m["m12"] - 2 * y * m["m11"] - x * m["m02"] + 2 * y * y * m["m10"],
    }
    n = {k: v / F.pow(m["m00"], F.lit(1 + sum(k) / 2)) for k, v in mu.items()}
    a, b, c, d, e, f, g = n[2, 0], n[0, 2], n[1, 1], n[3, 0], n[1, 2], n[2, 1], n[0, 3]
    four = F.array(a + b, (a - b) * (a - b) + 4 * c * c, (d - 3 * e) * (d - 3 * e) + (3 * f - g) * (3 * f - g), (d + e) * (d + e) + (f + g) * (f + g))
    return F.when(m["m00"] > 0, four).otherwise(F.array(*[F.lit(0.0)] * 4))


#: Powers (p, q) of the sums that make up the scatter matrix of a conic.
POWERS = [(p, n - p) for n in range(5) for p in range(n, -1, -1)]


def scatter(ring: Column) -> Column:
    """Sums of x^p y^q over a ring's points from its first one, in the order of POWERS: all that a conic's 6 x 6 scatter matrix holds. The fit of a
    conic does not depend on where its plane's origin is."""
    first = F.element_at(ring, 1)
    power = lambda v, k: F.lit(1.0) if k == 0 else v if k == 1 else power(v, k - 1) * v

    def add(acc: Column, p: Column) -> Column:
        x, y = (p["x"] - first["x"]).cast("double"), (p["y"] - first["y"]).cast("double")
        return F.array(*[acc[i] + power(x, a) * power(y, b) for i, (a, b) in enumerate(POWERS)])

    return F.aggregate(ring, F.array(*[F.lit(0.0)] * len(POWERS)), add)


def ellipse_angles(sums: np.ndarray) -> np.ndarray:
    """For rows of scatter() the angle of the ellipse of least squares, as a share of a half turn: that of its shorter axis, from the x axis towards y.

    The direct fit: of all conics with 4ac - b^2 = 1 the one of least squared residuals, from the scatter matrix in its parts for the second-order and
    the other terms. 0.5 for fewer than five points, and where they fix no ellipse (on a line, a point, another conic)."""
    place = {k: i for i, k in enumerate(POWERS)}
    out = np.full(len(sums), 0.5)
    terms = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0)]
    for i, s in enumerate(sums):
        if s[0] < 5 or s[place[2, 0]] + s[place[0, 2]] <= 0:
            continue
        size = np.sqrt((s[place[2, 0]] + s[place[0, 2]]) / s[0])
        m = np.array([[s[place[a[0] + b[0], a[1] + b[1]]] / size ** (sum(a) + sum(b)) for b in terms] for a in terms]) / s[0]
        s1, s2, s3 = m[:3, :3], m[:3, 3:], m[3:, 3:]
        if np.linalg.cond(s3) > 1e10:
            continue
        t = s1 - s2 @ np.linalg.solve(s3, s2.T)
        value, vector = np.linalg.eig(np.array([t[2] / 2, -t[1], t[0] / 2]))
        vector = np.real(vector)
        good = np.flatnonzero(4 * vector[0] * vector[2] - vector[1] ** 2 > 0)
        if not len(good):
            continue
        a, b, c = vector[:, good[np.argmin(np.abs(value[good]))]]
        if a + c < 0:
            a, b, c = -a, -b, -c
        out[i] = np.degrees(0.5 * np.arctan2(b, a - c)) % 180 / 180
    return out


def orientation(ring: Column) -> Column:
    """ellipse_angles() of rings: the sums are columns, only the eigenvectors of three by three numbers a row are NumPy's."""

    def solve(sums: pd.Series) -> pd.Series:
        return pd.Series(ellipse_angles(np.stack(sums.to_numpy())) if len(sums) else np.zeros(0))

    return F.pandas_udf(solve, "double")(scatter(ring))


def vector(ring: Column, size: Column, around: Column, hull_area: Column, w: Column, h: Column, long: Column, short: Column) -> Column:
    """Nine numbers of a shape of that area and perimeter: rotated aspect (50 at most; 1 for a degenerate box), circularity, solidity, extent, orientation
    and four logarithms of the invariants; zeros for a ring without area or length. w, h: of the upright box; long, short: of the rotated one."""
    first = [
        F.coalesce(F.least(shapes.rotated_aspect(long, short), F.lit(50.0)), F.lit(1.0)), F.least(F.lit(1.0), shapes.circularity(size, around)),
        shapes.solidity(size, hull_area, floor=False), shapes.extent(size, w, h), orientation(ring),
    ]
    logs = F.transform(F.array(moments(ring)), lambda m: F.transform(hu(m), shapes.log_hu))[0]
    return F.when((size > 0) & (around > 0), F.concat(F.array(*first), logs)).otherwise(F.array(*[F.lit(0.0)] * 9))
