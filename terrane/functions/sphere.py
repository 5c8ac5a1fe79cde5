"""Geometry on the sphere in numpy: the exact tests and constructions that have no built-in counterpart.

Points are rows of unit vectors; loops leave out the repeated first point and
have their inside to the left.
"""

from __future__ import annotations

import numpy as np

#: Fixed value: metres.
R = 6_371_010.0


def unit(latlng) -> np.ndarray:
    """Unit vectors of ``(lat, lng)`` degrees."""
    a = np.radians(np.asarray(latlng, float).reshape(-1, 2))
    c = np.cos(a[:, 0])
    return np.column_stack([c * np.cos(a[:, 1]), c * np.sin(a[:, 1]), np.sin(a[:, 0])])


def latlng(v: np.ndarray) -> np.ndarray:
    v = np.atleast_2d(v)
    return np.degrees(np.column_stack([np.arctan2(v[:, 2], np.hypot(v[:, 0], v[:, 1])), np.arctan2(v[:, 1], v[:, 0])]))


def normal(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arctan2(np.linalg.norm(np.cross(a, b), axis=-1), np.sum(a * b, axis=-1))


def edge_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angle from a point to each edge."""
    n = normal(np.cross(a, b))
    foot = normal(p - n * np.sum(n * p, axis=-1, keepdims=True))
    on = (np.sum(np.cross(n, a) * foot, -1) >= 0) & (np.sum(np.cross(b, n) * foot, -1) >= 0) & (np.linalg.norm(np.cross(a, b), axis=-1) > 0)
    return np.where(on, angle(np.broadcast_to(p, a.shape), foot), np.minimum(angle(np.broadcast_to(p, a.shape), a), angle(np.broadcast_to(p, b.shape), b)))


def project(path: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, int, float]:
    """The point of a path nearest to ``p``, its edge, and its angle along the path from the start."""
    if len(path) == 1:
        return path[0], 0, 0.0
    a, b = path[:-1], path[1:]
    i = int(np.argmin(edge_distance(p, a, b)))
    n = normal(np.cross(a[i], b[i]))
    foot = normal(p - n * np.dot(n, p))
    if np.dot(np.cross(n, a[i]), foot) < 0 or np.dot(np.cross(b[i], n), foot) < 0 or not n.any():
        foot = a[i] if angle(p, a[i]) <= angle(p, b[i]) else b[i]
    return foot, i, float(angle(a[:i], b[:i]).sum() + angle(a[i], foot))


def projected(path: np.ndarray, points: np.ndarray, block: int = 64) -> np.ndarray:
    """The angle from a path's start to where each of ``points`` falls on it, as by ``project``.

    Edges lie in balls of ``block`` each, and those in balls of that many again, and so on; only balls that
    may hold a point's nearest edge are opened.
    """
    if len(path) == 1:
        return np.zeros(len(points))
    a, b = path[:-1], path[1:]
    d = angle(a, b)
    before = np.cumsum(d.astype(np.longdouble)) - d
    # Levels of balls from the edges up: centre and radius as chords.
    levels = [((a + b) / 2, np.linalg.norm(b - a, axis=1) / 2 + (1 - np.cos(np.minimum(d, np.pi) / 2)))]
    while len(levels[-1][0]) > block:
        c, r = levels[-1]
        at = np.arange(0, len(c), block)
        n = np.diff(np.append(at, len(c)))
        mid = np.add.reduceat(c, at) / n[:, None]
        levels.append((mid, np.maximum.reduceat(np.linalg.norm(c - np.repeat(mid, n, axis=0), axis=1) + r, at)))
    out = np.empty(len(points))
    for k in range(0, len(points), 1000):
        p = points[k : k + 1000]
        of, ball = np.repeat(np.arange(len(p)), len(levels[-1][0])), np.tile(np.arange(len(levels[-1][0])), len(p))
        for level in range(len(levels) - 1, -1, -1):
            c, r = levels[level]
            gap = np.linalg.norm(c[ball] - p[of], axis=1)
            most = np.full(len(p), np.inf)
            np.minimum.at(most, of, gap + r[ball])
            near = gap - r[ball] <= most[of] + 1e-9
            of, ball = of[near], ball[near]
            if level:
                size = np.minimum((ball + 1) * block, len(levels[level - 1][0])) - ball * block
                of, ball = np.repeat(of, size), np.repeat(ball * block, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        far = edge_distance(p[of], a[ball], b[ball])
        order = np.lexsort((ball, far, of))
        i = ball[order[np.concatenate([[True], of[order][1:] != of[order][:-1]])]]
        n = normal(np.cross(a[i], b[i]))
        foot = normal(p - n * np.sum(n * p, axis=-1, keepdims=True))
        off = (np.sum(np.cross(n, a[i]) * foot, -1) < 0) | (np.sum(np.cross(b[i], n) * foot, -1) < 0) | ~n.any(axis=1)
        end = np.where((angle(p, a[i]) <= angle(p, b[i]))[:, None], a[i], b[i])
        out[k : k + 1000] = (before[i] + angle(a[i], np.where(off[:, None], end, foot))).astype(float)
    return out


def along(path: np.ndarray, at: np.ndarray | None = None, fractions: np.ndarray | None = None) -> np.ndarray:
    """The places of a path at angles ``at`` from its start, or at fractions of its length."""
    d = angle(path[:-1], path[1:])
    far = np.cumsum(d.astype(np.longdouble))
    if len(path) == 1 or not far[-1]:
        return np.broadcast_to(path[-1], (len(at if fractions is None else fractions), 3))
    # Legs without length have no place of their own.
    legs = np.flatnonzero(d > 0)
    at = np.asarray(at, np.longdouble) if fractions is None else np.asarray(fractions) * far[-1]
    i = legs[np.minimum(np.searchsorted(far[legs], at), len(legs) - 1)]
    x = d[i]
    t = np.clip(((at - (far[i] - x)) / x).astype(float), 0.0, 1.0)
    out = normal((np.sin((1 - t) * x)[:, None] * path[i] + np.sin(t * x)[:, None] * path[i + 1]) / np.sin(x)[:, None])
    out[at <= 0] = path[0]
    out[at >= far[-1]] = path[-1]
    return out


def interpolate(path: np.ndarray, fraction: float) -> np.ndarray:
    if len(path) == 1 or fraction <= 0:
        return path[0]
    return along(path, fractions=np.array([fraction]))[0]


def loop_area(loop: np.ndarray) -> float:
    """Steradians to the left of a loop, by the angles of a fan of triangles."""
    if len(loop) < 3:
        return 0.0
    a, b, c = loop[0], loop[1:-1], loop[2:]
    num = np.sum(a * np.cross(b, c), axis=-1)
    den = 1 + b @ a + np.sum(b * c, axis=-1) + c @ a
    area = float(np.sum(2 * np.arctan2(num, den)))
    return area if area >= 0 else area + 4 * np.pi


def oriented(loop: np.ndarray) -> np.ndarray:
    """The loop turned so that it takes up no more than half the sphere."""
    return loop if loop_area(loop) <= 2 * np.pi else loop[::-1]


def inside(p: np.ndarray, loop: np.ndarray) -> bool:
    """Whether a loop of less than half the sphere contains a point: its angles seen from there turn full circle."""
    if len(loop) < 3:
        return False
    t = loop - np.outer(loop @ p, p)
    if np.any(np.linalg.norm(t, axis=1) < 1e-15):
        return bool(loop.mean(axis=0) @ p > 0)
    u, v = t, np.roll(t, -1, axis=0)
    turn = np.sum(np.arctan2(np.cross(u, v) @ p, np.sum(u * v, axis=1)))
    return bool(abs(turn) > np.pi and loop.mean(axis=0) @ p > 0)


def insides(loops: np.ndarray, points: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``inside`` of many loops of three corners or more that begin ``at``; ``of`` is each corner's loop, ``points`` has the loop's point at each corner."""
    t = loops - np.sum(loops * points, axis=1, keepdims=True) * points
    after = np.arange(1, len(loops) + 1)
    after[np.append(at[1:], len(loops)) - 1] = at
    turn = np.add.reduceat(np.arctan2(np.sum(np.cross(t, t[after]) * points, axis=1), np.sum(t * t[after], axis=1)), at)
    corner = np.maximum.reduceat(np.linalg.norm(t, axis=1) < 1e-15, at)
    ahead = np.add.reduceat(np.sum(loops * points, axis=1), at) > 0
    return ahead & (corner | (np.abs(turn) > np.pi))


def in_polygon(p: np.ndarray, polygon: list[np.ndarray]) -> bool:
    """Even-odd over a polygon's loops: the first is its shell, the rest are holes."""
    return sum(inside(p, loop) for loop in polygon) % 2 == 1


def crosses(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> bool:
    """Whether edge a-b meets any of the edges c-d."""
    ab = np.cross(a, b)
    cd = np.cross(c, d)
    s1, s2 = c @ ab, d @ ab
    s3, s4 = cd @ a, cd @ b
    return bool(np.any((s1 * s2 <= 0) & (s1 * s3 <= 0) & (s1 * s4 >= 0) & (np.sum((a + b) * (c + d), axis=-1) > 0)))


def polygons_meet(p: list[np.ndarray], q: list[np.ndarray]) -> bool:
    for x in p:
        for y in q:
            c, d = y, np.roll(y, -1, axis=0)
            if any(crosses(x[i], x[(i + 1) % len(x)], c, d) for i in range(len(x))):
                return True
    return in_polygon(p[0][0], q) or in_polygon(q[0][0], p)


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of points within a hemisphere, on the plane that touches the sphere at their middle; great circles are straight there."""
    points = np.unique(np.round(points, 15), axis=0)
    if len(points) < 3:
        return points
    c = normal(points.sum(axis=0))
    e = normal(np.cross([0.0, 0.0, 1.0] if abs(c[2]) < 0.9 else [1.0, 0.0, 0.0], c))
    n = np.cross(c, e)
    w = points @ c
    x, y = points @ e / w, points @ n / w
    order = np.lexsort((y, x))

    def half(idx):
        out: list[int] = []
        for i in idx:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[i] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[i] - x[out[-2]]) <= 0:
                out.pop()
            out.append(i)
        return out[:-1]

    return points[half(order) + half(order[::-1])]


def hull_areas(of: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in ``of`` (in order, one a point) and the steradians of the hull of each one's points, as by ``hull``."""
    if not len(of):
        return np.empty(0, np.int32), np.empty(0)
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    n = np.diff(np.append(begin, len(of)))
    c = normal(np.add.reduceat(points, begin))
    e = normal(np.cross(np.where(np.abs(c[:, 2:]) < 0.9, [[0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0]]), c))
    k = np.repeat(np.arange(len(begin)), n)
    w = np.sum(points * c[k], axis=-1)
    x, y = np.sum(points * e[k], axis=-1) / w, np.sum(points * np.cross(c, e)[k], axis=-1) / w
    order = np.lexsort((y, x, k))
    xs, ys, ids = x[order].tolist(), y[order].tolist(), order.tolist()
    corners, sizes = [], []

    def half(idx):
        out, ox, oy = [], [], []
        for i in idx:
            px, py = xs[i], ys[i]
            while len(out) > 1 and (ox[-1] - ox[-2]) * (py - oy[-2]) - (oy[-1] - oy[-2]) * (px - ox[-2]) <= 0:
                out.pop()
                ox.pop()
                oy.pop()
            out.append(i)
            ox.append(px)
            oy.append(py)
        return out[:-1]

    for i, m in zip(begin.tolist(), n.tolist()):
        h = half(range(i, i + m)) + half(range(i + m - 1, i - 1, -1)) if m > 2 else []
        corners += h if len(h) > 2 else ()
        sizes.append(len(h) if len(h) > 2 else 0)
    area, size = np.zeros(len(begin)), np.array(sizes)
    some = np.flatnonzero(size)
    if len(some):
        h, at = points[np.array(ids)[corners]], np.cumsum(size[some]) - size[some]
        first = np.repeat(h[at], size[some], axis=0)
        after = np.roll(h, -1, axis=0)
        after[np.append(at[1:], len(h)) - 1] = h[at]
        num = np.sum(first * np.cross(h, after), axis=-1)
        den = 1 + np.sum(first * h, axis=-1) + np.sum(h * after, axis=-1) + np.sum(after * first, axis=-1)
        # The side that is no more than half the sphere.
        area[some] = np.abs(np.add.reduceat(2 * np.arctan2(num, den), at))
    return of[begin], area


def centroid(points: np.ndarray, closed: bool) -> np.ndarray:
    """Of a path: weighted by length. Of an area: the centroid of its convex hull, by triangles."""
    if not closed:
        if len(points) == 1:
            return points[0]
        d = angle(points[:-1], points[1:])
        if not d.sum():
            return points[0]
        return normal(np.sum((points[:-1] + points[1:]) * d[:, None], axis=0))
    h = hull(points)
    if len(h) < 3:
        return normal(h.sum(axis=0))
    a, b, c = h[0], h[1:-1], h[2:]
    w = 2 * np.arctan2(np.sum(a * np.cross(b, c), axis=-1), 1 + b @ a + np.sum(b * c, axis=-1) + c @ a)
    return normal(np.sum((a + b + c) * w[:, None], axis=0))


def cap(center: np.ndarray, radius: float, n: int = 128) -> np.ndarray:
    """A regular loop around a centre, ``radius`` in radians."""
    e = normal(np.cross([0.0, 0.0, 1.0] if abs(center[2]) < 0.999 else [1.0, 0.0, 0.0], center))
    f = np.cross(center, e)
    t = 2 * np.pi * np.arange(n) / n
    return np.cos(radius) * center + np.sin(radius) * (np.cos(t)[:, None] * e + np.sin(t)[:, None] * f)


def simplify(path: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a path to keep so that none left out is farther than ``tolerance`` (radians) from what is kept."""
    keep = np.zeros(len(path), bool)
    keep[[0, -1]] = True
    todo = [(0, len(path) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d = np.array([edge_distance(path[k], path[i : i + 1], path[j : j + 1])[0] for k in range(i + 1, j)])
        k = int(np.argmax(d))
        if d[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep
