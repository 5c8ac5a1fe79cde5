"""Hierarchical cells on the faces of a cube, numbered along a Hilbert curve.

A point on the sphere falls on a face of the cube around it; the face's
coordinates are stretched by a quadratic so that cells are of like size, and cut
into quarters up to 30 times. A cell's id holds its face in the top three bits,
then two bits a level, then a one. Its token is the id in hex without trailing
zeros.
"""

from __future__ import annotations

import numpy as np

from terrane.functions import sphere as S

LEVELS = 30
#: The quarter of a cell at each place along the curve, by the curve's turn (swap axes 1, invert 2), and the turn within it.
PLACES = ((0, 1, 3, 2), (0, 2, 3, 1), (3, 2, 0, 1), (3, 1, 0, 2))
TURNS = (1, 0, 0, 3)


def _st(u: float) -> float:
    return 0.5 * (1 + 3 * u) ** 0.5 if u >= 0 else 1 - 0.5 * (1 - 3 * u) ** 0.5


def _uv(s: float) -> float:
    return (4 * s * s - 1) / 3 if s >= 0.5 else (1 - 4 * (1 - s) ** 2) / 3


def face_uv(p) -> tuple[int, float, float]:
    x, y, z = p
    a = [abs(x), abs(y), abs(z)]
    f = int(np.argmax(a))
    if p[f] < 0:
        f += 3
    u, v = ((y, z), (-x, z), (-x, -y), (z, y), (z, -x), (-y, -x))[f]
    return f, u / p[f % 3], v / p[f % 3]


def face_point(f: int, u: float, v: float) -> np.ndarray:
    return S.normal(np.array(((1, u, v), (-u, 1, v), (-u, -v, 1), (-1, -v, -u), (v, -1, -u), (v, u, -1))[f], float))


def _id(f: int, i: int, j: int, level: int) -> int:
    """The cell of a level that holds leaf ``(i, j)`` of a face."""
    turn, pos = f & 1, 0
    for k in range(LEVELS - 1, LEVELS - 1 - level, -1):
        quarter = ((i >> k) & 1) << 1 | (j >> k) & 1
        place = PLACES[turn].index(quarter)
        pos = pos << 2 | place
        turn ^= TURNS[place]
    return (f << 61) | (pos << (61 - 2 * level)) | (1 << (60 - 2 * level))


def from_point(p, level: int = LEVELS) -> int:
    f, u, v = face_uv(p)
    n = 1 << LEVELS
    i, j = (max(0, min(n - 1, int(_st(x) * n))) for x in (u, v))
    return _id(f, i, j, level)


def level_of(id: int) -> int:
    return LEVELS - ((id & -id).bit_length() - 1) // 2


def face_ij(id: int) -> tuple[int, int, int, int]:
    """Face, first leaf ``(i, j)`` and level of a cell."""
    f, level = id >> 61, level_of(id)
    turn, i, j = f & 1, 0, 0
    for k in range(level):
        place = (id >> (59 - 2 * k)) & 3
        quarter = PLACES[turn][place]
        i, j = i << 1 | quarter >> 1, j << 1 | quarter & 1
        turn ^= TURNS[place]
    return f, i << (LEVELS - level), j << (LEVELS - level), level


def parent(id: int, level: int) -> int:
    low = 1 << (2 * (LEVELS - level))
    return (id & -low) | low if level_of(id) > level else id


def children(id: int) -> list[int]:
    low = (id & -id) >> 2
    first = id - (id & -id) + low
    return [first + 2 * low * k for k in range(4)]


def token(id: int) -> str:
    return f"{id:016x}".rstrip("0") or "X"


def from_token(t: str) -> int:
    return int(t.ljust(16, "0"), 16) if t != "X" else 0


def corners(id: int) -> np.ndarray:
    f, i, j, level = face_ij(id)
    n, k = 1 << LEVELS, 1 << (LEVELS - level)
    at = lambda a, b: face_point(f, _uv(a / n), _uv(b / n))
    return np.array([at(i, j), at(i + k, j), at(i + k, j + k), at(i, j + k)])


def center(id: int) -> np.ndarray:
    f, i, j, level = face_ij(id)
    n, half = 1 << LEVELS, (1 << (LEVELS - level)) / 2
    return face_point(f, _uv((i + half) / n), _uv((j + half) / n))


def meets(id: int, polygons) -> bool:
    c = corners(id)
    return any(S.polygons_meet([c], p) for p in polygons)


def _holds(polygon, c: np.ndarray) -> bool:
    """Whether a polygon holds a whole cell: a corner, and no edge of any loop meets the cell's."""
    edge = any(S.crosses(c[k], c[(k + 1) % 4], loop, np.roll(loop, -1, axis=0)) for loop in polygon for k in range(4))
    return not edge and S.in_polygon(c[0], polygon)


def covering(polygons, low: int, high: int, most: int | None = 8) -> list[int]:
    """Cells of levels ``low`` to ``high`` that cover polygons: border cells are split, largest first, while no more than ``most`` come out; None splits all to ``high``."""
    if not polygons:
        return []
    faces = [f << 61 | 1 << 60 for f in range(6)]
    todo = [c for c in faces if meets(c, polygons)]
    out: list[int] = []
    while todo:
        todo.sort(key=lambda c: (level_of(c), c))
        c = todo.pop(0)
        level = level_of(c)
        within = level >= low and any(_holds(p, corners(c)) for p in polygons)
        if level >= high or level >= low and (most is not None and (within or len(out) + len(todo) + 4 > most)):
            out.append(c)
        else:
            todo += [x for x in children(c) if meets(x, polygons)]
    return merged(out, low)


def merged(cells: list[int], low: int = 0) -> list[int]:
    """Four siblings become their parent, down to level ``low``; in order of id."""
    have = set(cells)
    again = True
    while again:
        again = False
        for c in sorted(have):
            level = level_of(c)
            if level > low and c in have:
                four = children(parent(c, level - 1))
                if all(x in have for x in four):
                    have -= set(four)
                    have.add(parent(c, level - 1))
                    again = True
    return sorted(have)


# Columns ---------------------------------------------------------------------


def covering_tokens(polygons, low: int, high: int, most: int | None = 8):
    """Tokens of a covering, as an array column."""
    from terrane.functions import geo

    return geo._pandas("array<string>")(lambda polygons: [token(c) for c in covering(geo._polygons(polygons), low, high, most)])(geo.flat(polygons))


def grid_tokens(polygons, level: int):
    """Tokens of all cells of one level that meet an area, in order."""
    from terrane.functions import geo

    return geo._pandas("array<string>")(lambda polygons: sorted(token(c) for c in _grid(geo._polygons(polygons), level)))(geo.flat(polygons))


def _grid(polygons, level: int) -> list[int]:
    todo = [f << 61 | 1 << 60 for f in range(6)]
    for _ in range(level):
        todo = [x for c in todo if meets(c, polygons) for x in children(c)]
    return [c for c in todo if meets(c, polygons)]


def token_center(tokens):
    from terrane.functions import geo

    return geo._pandas(geo.POINT)(lambda t: geo._one(center(from_token(t))))(tokens)


def token_polygon(tokens):
    from terrane.functions import geo

    return geo._pandas(geo.AREA)(lambda t: [[geo._out(corners(from_token(t)))]])(tokens)


def point_token(point, level: int):
    from terrane.functions import geo

    return geo._pandas("array<string>")(lambda p: [token(from_point(S.unit([(p["lat"], p["lng"])])[0], level))])(point)[0]
