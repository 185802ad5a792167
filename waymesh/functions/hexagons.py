"""Hexagons on the faces of an icosahedron, seven to each of the next coarser resolution, in numpy.

A face is a plane (gnomonic projection) with the Eisenstein integers ``a + b w``, ``w = exp(i pi / 3)``, as its
cells of resolution 0; its corners lie at 2, 2 w^2 and 2 w^4.  A finer resolution multiplies places by
``3 - w`` (odd ones) or ``2 + w`` (even ones), both of norm 7.  So a cell's digit is its residue, and its parent
the exact quotient.  A base cell's digits are told in the frame of its home face; other faces' frames are
turned by sixths, which turns digits.  Around a corner five faces meet: the direction ``k`` isn't there, and
cells that would begin with it are told by the direction beside it.

Ids have 64 bits: the mode 1, the resolution, the base cell (122, from north to south) and a digit of three bits
for each resolution, 7 where there is none.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np

#: Latitude and longitude of the faces' centres, and the azimuth from there to the face's first corner, in radians. Fixed values.
FACES = np.array(
    [
        (0.803582649718989942, 1.248397419617396099, 5.619958268523939882),
        (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
        (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
        (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
        (0.491715428198773866, 0.401988202911306943, 6.130269123335111400),
        (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
        (0.605929321571350690, 2.953923329812411617, 2.982963003477243874),
        (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
        (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
        (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
        (0.079066118549212831, 2.408163140208925497, 5.930472956509811562),
        (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
        (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361),
        (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
        (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
        (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
        (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316),
        (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
        (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436),
        (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
    ]
)
#: Home faces of the base cells at corners. Fixed values.
CORNER_HOMES = (0, 11, 10, 12, 14, 13, 6, 7, 5, 8, 9, 17)
#: Digit of each direction, from 0 degrees by sixths. Fixed values.
DIGITS = np.array([4, 6, 2, 3, 1, 5])
MOST_RESOLUTION = 15

#: The length of a step at resolution 0 in the plane that touches a face's centre.
UNIT = (3 - math.sqrt(5)) / 2
_W = complex(0.5, math.sqrt(0.75))
_UNITS = np.array([(1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)], np.int64)
#: The direction of each digit.
_TURN_OF = np.full(8, -1, np.int64)
_TURN_OF[DIGITS] = np.arange(6)
_K = 1
_CORNERS = np.array([(2, 0), (-2, 2), (0, -2)], np.int64)
#: Directions of the faces' sides, which lie at a distance of 1.
_SIDES = np.exp(1j * np.radians([60.0, 180.0, 300.0]))


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b, c, d = x[..., 0], x[..., 1], y[..., 0], y[..., 1]
    return np.stack([a * c - b * d, a * d + b * c + b * d], -1)


def _plane(z: np.ndarray) -> np.ndarray:
    return z[..., 0] + z[..., 1] * _W


def _nearest(w: np.ndarray) -> np.ndarray:
    """The Eisenstein integer whose hexagon a point lies in."""
    b = w.imag / _W.imag
    a = w.real - b / 2
    c = -a - b
    ra, rb, rc = np.rint(a), np.rint(b), np.rint(c)
    da, db, dc = abs(ra - a), abs(rb - b), abs(rc - c)
    ra = np.where((da > db) & (da > dc), -rb - rc, ra)
    rb = np.where((da <= db) & (db > dc), -ra - rc, rb)
    return np.stack([ra, rb], -1).astype(np.int64)


def _step(resolution: int) -> np.ndarray:
    return np.array((3, -1) if resolution % 2 else (2, 1), np.int64)


@functools.cache
def _scale(resolution: int) -> tuple[np.ndarray, complex]:
    """How much finer than resolution 0: as an integer, and as a number of the plane."""
    z = np.array((1, 0), np.int64)
    for r in range(1, resolution + 1):
        z = _times(z, _step(r))
    return z, complex(_plane(z))


@functools.cache
def _residues(resolution: int) -> np.ndarray:
    """The direction of each residue by the step to a resolution (-1: the centre)."""
    root = 3 if resolution % 2 else 5
    out = np.full(7, -1, np.int64)
    for k, (a, b) in enumerate(_UNITS):
        out[(a + root * b) % 7] = k
    return out


def _parents(z: np.ndarray, resolution: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the next coarser resolution, and the directions from there."""
    turn = _residues(resolution)[(z[..., 0] + (3 if resolution % 2 else 5) * z[..., 1]) % 7]
    rest = z - np.where(turn[..., None] >= 0, _UNITS[turn], 0)
    a, b = _step(resolution)
    return _times(rest, np.array((a + b, -b), np.int64)) // 7, turn


# -- faces ------------------------------------------------------------------------------------------


@functools.cache
def _frames() -> tuple[np.ndarray, np.ndarray]:
    """Centres of the faces, and (face, 2, 3) the directions of their planes' axes."""
    lat, lon, turn = FACES.T
    centre = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)
    north = np.stack([-np.sin(lat) * np.cos(lon), -np.sin(lat) * np.sin(lon), np.cos(lat)], -1)
    east = np.stack([-np.sin(lon), np.cos(lon), np.zeros(20)], -1)
    c, s = np.cos(turn)[:, None], np.sin(turn)[:, None]
    return centre, np.stack([c * north + s * east, s * north - c * east], 1)


def to_sphere(face: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Unit vectors of points in faces' planes."""
    centre, axes = _frames()
    v = centre[face] + UNIT * (w.real[..., None] * axes[face, 0] + w.imag[..., None] * axes[face, 1])
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def to_plane(face: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Points in faces' planes of unit vectors (of their half of the sphere)."""
    centre, axes = _frames()
    along = (v * centre[face]).sum(-1) * UNIT
    return ((v * axes[face, 0]).sum(-1) + 1j * (v * axes[face, 1]).sum(-1)) / along


def vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    x, y = np.radians(np.asarray(lon, float)), np.radians(np.asarray(lat, float))
    return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], -1)


def degrees(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude."""
    return np.degrees(np.arctan2(v[..., 1], v[..., 0])), np.degrees(np.arctan2(v[..., 2], np.hypot(v[..., 0], v[..., 1])))


@functools.cache
def _across() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By face and side: the face beyond, and how its frame tells places: turned by sixths, then moved."""
    corner = to_sphere(np.arange(20)[:, None], _plane(_CORNERS)[None, :])
    beyond, turn, move = np.zeros((20, 3), int), np.zeros((20, 3), np.int64), np.zeros((20, 3, 2), np.int64)
    same = np.linalg.norm(corner[:, :, None, None] - corner[None, None], axis=-1) < 1e-6
    for f in range(20):
        for side, (p, q) in enumerate(((0, 1), (1, 2), (2, 0))):
            g = next(g for g in range(20) if g != f and same[f, p, g].any() and same[f, q, g].any())
            there = [_CORNERS[int(np.flatnonzero(same[f, k, g])[0])] for k in (p, q)]
            ratio = (_plane(there[0]) - _plane(there[1])) / (_plane(_CORNERS[p]) - _plane(_CORNERS[q]))
            k = round(np.angle(ratio) / (math.pi / 3)) % 6
            beyond[f, side], turn[f, side], move[f, side] = g, k, there[0] - _times(_CORNERS[p], _UNITS[k])
    return beyond, turn, move


def _outside(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The side that a point lies farthest beyond, and whether it does."""
    far = (w[..., None] * _SIDES.conj()).real
    side = far.argmax(-1)
    return side, np.take_along_axis(far, side[..., None], -1)[..., 0] > 1 + 1e-9


def _moved(face: np.ndarray, z: np.ndarray, resolution: int) -> tuple[np.ndarray, np.ndarray]:
    """Places on the faces that they lie on, from a face beside."""
    beyond, turn, move = _across()
    side, out = _outside(_plane(z) / _scale(resolution)[1])
    there = _times(z, _UNITS[turn[face, side]]) + _times(move[face, side], _scale(resolution)[0])
    return np.where(out, beyond[face, side], face), np.where(out[..., None], there, z)


# -- base cells -------------------------------------------------------------------------------------


class _Bases:
    """Base cells: home face and place there; and from any face, the base cell at a place, and the sixths that turn the face's digits into the home's."""

    def __init__(self):
        beyond, turn, move = _across()
        homes = [(f, (0, 0)) for f in range(20)] + [(f, tuple(_CORNERS[c] // 2)) for f in range(20) for c in range(3)] + [(f, (2, 0)) for f in CORNER_HOMES]
        # a side's middle is at home where it lies between the first two corners (outer faces and those of the
        # lower row), else where it lies opposite the first corner or the third lies before
        for f in range(20):
            for side, middle in enumerate(((0, 1), (-1, 0), (1, -1))):
                g = beyond[f, side]
                ring, other = f // 5, g // 5
                if ring == other:
                    own = side == 0
                elif {ring, other} == {1, 2}:
                    own = side == (2 if ring == 1 else 0)
                else:
                    own = ring in (0, 3)
                if own:
                    homes.append((f, middle))
        lat = [to_sphere(np.array(f), np.asarray(_plane(np.array(z))))[2] for f, z in homes]
        order = np.argsort(-np.array(lat))
        self.face = np.array([homes[k][0] for k in order])
        self.place = np.array([homes[k][1] for k in order], np.int64)
        at = to_sphere(self.face, _plane(self.place))
        self.corner = (self.place == (2, 0)).all(1)
        # by face and place (shifted by 4): base cell, sixths, and at corners which face clockwise from the home
        self.base = np.full((20, 9, 9), -1, np.int64)
        self.turn = np.zeros((20, 9, 9), np.int64)
        self.around = np.zeros((20, 9, 9), np.int64)
        self.faces_around = np.zeros((122, 5), int)
        self.corner_around = np.zeros((122, 5, 2), np.int64)
        middles = [(0, 1), (-1, 0), (1, -1)]
        inner = [(0, 0), *map(tuple, _CORNERS // 2), *middles]
        centre = _frames()[0]
        for f in range(20):
            for z in [*inner, *map(tuple, _CORNERS)]:
                found = np.linalg.norm(at - to_sphere(np.array(f), np.asarray(_plane(np.array(z)))), axis=1).argmin()
                k, n = 0, 0
                if self.corner[found]:
                    n = self._clockwise(at[found], centre[self.face[found]], centre[f])
                    toward = round(math.degrees(np.angle(-_plane(np.array(z)))) / 60)
                    k = (3 - n - toward) % 6
                    self.faces_around[found, n], self.corner_around[found, n] = f, z
                elif self.face[found] != f:
                    k = turn[f, middles.index(z)]
                self._put(f, z, found, k, n)
        for f in range(20):
            for side in range(3):
                # cells of the face beyond that lie beside the side
                g = beyond[f, side]
                for z in map(tuple, _CORNERS // 2):
                    back = _times(np.array(z) - move[f, side], _UNITS[-turn[f, side] % 6])
                    if abs(back).max() <= 4 and self.base[f, back[0] + 4, back[1] + 4] < 0 and (_plane(back) * _SIDES[side].conj()).real < 1.6:
                        self._put(f, tuple(back), self.base[g, z[0] + 4, z[1] + 4], turn[f, side], 0)

    def _put(self, f, z, base, k, n):
        self.base[f, z[0] + 4, z[1] + 4], self.turn[f, z[0] + 4, z[1] + 4], self.around[f, z[0] + 4, z[1] + 4] = base, k, n

    @staticmethod
    def _clockwise(corner, home, other) -> int:
        """How many faces clockwise, as seen from outside."""
        a, b = (x - (x @ corner) * corner for x in (home, other))
        angle = math.atan2(np.cross(b, a) @ corner, a @ b)
        return round(angle / (2 * math.pi / 5)) % 5


@functools.cache
def _bases() -> _Bases:
    return _Bases()


# -- cells ------------------------------------------------------------------------------------------


def _composed(base: np.ndarray, digits: np.ndarray, resolution: int) -> np.ndarray:
    out = np.full(base.shape, 1 << 59 | resolution << 52, np.int64) | base << 45
    for r in range(1, MOST_RESOLUTION + 1):
        out |= (digits[..., r - 1] if r <= resolution else np.int64(7)) << (45 - 3 * r)
    return out


def resolution_of(cells: np.ndarray) -> np.ndarray:
    return np.asarray(cells, np.int64) >> 52 & 15


def _turned(digits: np.ndarray, sixths: np.ndarray) -> np.ndarray:
    return np.where(digits > 0, DIGITS[(_TURN_OF[digits] + sixths[..., None]) % 6], 0)


def _leading(digits: np.ndarray) -> np.ndarray:
    """The first digit that isn't 0, or 0."""
    if not digits.shape[-1]:
        return np.zeros(digits.shape[:-1], np.int64)
    first = (digits > 0).argmax(-1)
    return np.take_along_axis(digits, first[..., None], -1)[..., 0]


def at_places(face: np.ndarray, z: np.ndarray, resolution: int) -> np.ndarray:
    """Ids of the cells at places of faces that they lie on."""
    bases = _bases()
    digits = np.zeros((*face.shape, resolution), np.int64)
    for r in range(resolution, 0, -1):
        z, turn = _parents(z, r)
        digits[..., r - 1] = np.where(turn >= 0, DIGITS[turn], 0)
    key = (face, z[..., 0] + 4, z[..., 1] + 4)
    base = bases.base[key]
    if (base < 0).any():
        raise ValueError("a place beyond its face")
    digits = _turned(digits, bases.turn[key])
    # what begins with k at a corner lies on the first or the last face around it
    lost = bases.corner[base] & (_leading(digits) == _K)
    return _composed(base, _turned(digits, np.where(lost, np.where(bases.around[key] == 0, 1, -1), 0)), resolution)


def cells_at(lon: np.ndarray, lat: np.ndarray, resolution: int) -> np.ndarray:
    """Ids of the cells that points (degrees) lie in."""
    v = vectors(lon, lat)
    face = (v @ _frames()[0].T).argmax(-1)
    return at_places(face, _nearest(to_plane(face, v) * _scale(resolution)[1]), resolution)


def _digits(cells: np.ndarray, resolution: int) -> np.ndarray:
    return np.stack([cells >> (45 - 3 * r) & 7 for r in range(1, resolution + 1)], -1) if resolution else np.zeros((*cells.shape, 0), np.int64)


def places_of(cells: np.ndarray, resolution: int) -> tuple[np.ndarray, np.ndarray]:
    """Faces that cells' centres lie on, and their places there."""
    bases, cells = _bases(), np.asarray(cells, np.int64)
    base, digits = cells >> 45 & 127, _digits(cells, resolution)
    z = bases.place[base]
    for r in range(1, resolution + 1):
        d = digits[..., r - 1]
        z = _times(z, _step(r)) + np.where(d[..., None] > 0, _UNITS[_TURN_OF[d]], 0)
    face, z = bases.face[base], z
    corner = bases.corner[base]
    if corner.any():
        some = np.flatnonzero(corner)
        lead, scale = _leading(digits[some]), _scale(resolution)
        v = z[some] - _times(bases.place[base[some]], scale[0])
        # clockwise from the direction of the home's centre, near that of the leading digit
        clockwise = 180 - np.degrees(np.angle(_plane(v) / scale[1]))
        middle = np.array([0, 0, 60, 0, 180, 240, 120, 0])[lead]
        clockwise = middle + (clockwise - middle + 180) % 360 - 180
        steps = np.where(lead > 0, np.rint(clockwise / 60), 0).astype(int)
        n = steps % 5
        f, at = bases.faces_around[base[some], n], bases.corner_around[base[some], n]
        toward = np.rint(np.degrees(np.angle(-_plane(at))) / 60).astype(int)
        back = (toward - (3 - steps)) % 6
        face = face.copy()
        face[some] = f
        z[some] = _times(v, _UNITS[back]) + _times(at, scale[0])
    plain = ~corner
    face2, z2 = _moved(face, z, resolution)
    return np.where(plain, face2, face), np.where(plain[..., None], z2, z)


def centres(cells: np.ndarray) -> np.ndarray:
    """Unit vectors of cells' centres; cells of any resolutions."""
    cells = np.asarray(cells, np.int64)
    out = np.zeros((len(cells), 3))
    for r in np.unique(resolution_of(cells)).tolist():
        some = np.flatnonzero(resolution_of(cells) == r)
        face, z = places_of(cells[some], r)
        out[some] = to_sphere(face, _plane(z) / _scale(r)[1])
    return out


def is_pentagon(cells: np.ndarray) -> np.ndarray:
    cells = np.asarray(cells, np.int64)
    held = np.zeros(cells.shape, bool)
    for r in range(1, MOST_RESOLUTION + 1):
        d = cells >> (45 - 3 * r) & 7
        held |= (d > 0) & (d < 7)
    return _bases().corner[cells >> 45 & 127] & ~held


def pentagons() -> list[int]:
    """Base cells at corners."""
    return np.flatnonzero(_bases().corner).tolist()


def around(v: np.ndarray, angle: float, resolution: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For points (unit vectors), the cells whose centres are up to *angle* away: numbers of points, ids, centres.

    Every centre lies on a face, so each face that is near a point is looked at for places near the point's
    own, in a circle that allows for the projection; places on a side are found from both of its faces.
    """
    centre, scale = _frames()[0], _scale(resolution)[1]
    corner = math.atan(2 * UNIT)
    reach = corner + angle
    if reach < 1.4:
        # lengths grow at most by 1 / cos^2 on the way from the point to the face
        radius = angle / math.cos(reach) ** 2 / UNIT
        point, face = np.nonzero(v @ centre.T >= math.cos(reach) - 1e-12)
        w = to_plane(face, v[point])
        near = (w[:, None] * _SIDES.conj()).real.max(1) <= 1 + radius
        point, face, w = point[near], face[near], w[near]
        at = _nearest(w * scale)
    else:  # more than half of the faces: all of their places
        radius = 2.0
        point, face = (x.ravel() for x in np.indices((len(v), 20)))
        at = np.zeros((len(point), 2), np.int64)
    span = math.ceil((radius * abs(scale) + 1) / _W.imag)
    a, b = (x.ravel() for x in np.mgrid[-span : span + 1, -span : span + 1])
    ring = np.stack([a, b], 1)
    ring = ring[abs(_plane(ring)) <= radius * abs(scale) + 1]
    most = max(1, (1 << 20) // len(ring))
    for lo in range(0, len(point), most):
        z = (at[lo : lo + most, None] + ring[None]).reshape(-1, 2)
        p, f = np.repeat(point[lo : lo + most], len(ring)), np.repeat(face[lo : lo + most], len(ring))
        w = _plane(z) / scale
        on = ~_outside(w)[1]
        p, f, z, c = p[on], f[on], z[on], to_sphere(f[on], w[on])
        hit = np.linalg.norm(c - v[p], axis=1) <= 2 * math.sin(angle / 2) + 1e-12
        p, f, z, c = p[hit], f[hit], z[hit], c[hit]
        cell = at_places(f, z, resolution)
        # of the faces that share a place, the one that it is told on
        own = places_of(cell, resolution)[0]
        side = (f != own) & (abs((_plane(z)[:, None] / scale * _SIDES.conj()).real.max(1) - 1) < 1e-9)
        yield p[~side], cell[~side], c[~side]


def neighbours(cells: np.ndarray, resolution: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each cell's number in *cells* and a cell beside it: six, of a pentagon five."""
    bases, cells = _bases(), np.asarray(cells, np.int64)
    face, z = places_of(cells, resolution)
    plain = np.flatnonzero(~is_pentagon(cells))
    at = (z[plain, None] + _UNITS[None]).reshape(-1, 2)
    f, there = _moved(np.repeat(face[plain], 6), at, resolution)
    who, found = np.repeat(plain, 6), at_places(f, there, resolution)
    five = np.flatnonzero(is_pentagon(cells))
    if len(five):
        base = cells[five] >> 45 & 127
        f = np.repeat(bases.faces_around[base].ravel(), 6)
        at = (_times(bases.corner_around[base].reshape(-1, 1, 2), _scale(resolution)[0]) + _UNITS[None]).reshape(-1, 2)
        on = ~_outside(_plane(at) / _scale(resolution)[1])[1]
        who, found = np.concatenate([who, np.repeat(five, 30)[on]]), np.concatenate([found, at_places(f[on], at[on], resolution)])
        pairs = np.unique(np.stack([who, found], 1), axis=0)
        who, found = pairs[:, 0], pairs[:, 1]
    return who, found


def disks(cells: np.ndarray, k: int, resolution: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each cell's number in *cells* and a cell up to *k* steps away, itself included."""
    if k < 0:
        raise ValueError("a disk has no negative radius")
    cells = np.asarray(cells, np.int64)
    pairs = last = np.stack([np.arange(len(cells)), cells], 1)
    for _ in range(k):
        who, found = neighbours(last[:, 1], resolution)
        new = np.unique(np.stack([last[who, 0], found], 1), axis=0)
        both = np.unique(np.concatenate([pairs, new]), axis=0)
        keys = {tuple(x) for x in pairs.tolist()}
        last = np.array([x for x in new.tolist() if tuple(x) not in keys], np.int64).reshape(-1, 2)
        pairs = both
        if not len(last):
            break
    return pairs[:, 0], pairs[:, 1]


def boundaries(cells: np.ndarray) -> list[np.ndarray]:
    """Each cell's corners as unit vectors, counter-clockwise; where a side crosses from one face to another, the crossing is among them."""
    cells = np.asarray(cells, np.int64)
    out: list[np.ndarray] = [None] * len(cells)  # type: ignore[list-item]
    beyond, turn, move = _across()
    bases = _bases()
    for r in np.unique(resolution_of(cells)).tolist():
        some = np.flatnonzero(resolution_of(cells) == r)
        five = is_pentagon(cells[some])
        scale = _scale(r)[1]
        face, z = places_of(cells[some], r)
        ring = np.exp(1j * np.radians(30 + 60 * np.arange(6))) / math.sqrt(3)
        w = (_plane(z)[:, None] + ring[None]) / scale
        side, off = _outside(w)
        f = face[:, None] + np.zeros(6, int)
        there = w * _plane(_UNITS[turn[f, side]]) + _plane(move[f, side])
        v = to_sphere(np.where(off, beyond[f, side], f), np.where(off, there, w))
        for i in np.flatnonzero(~five).tolist():
            points = []
            for n in range(6):
                points.append(v[i, n])
                m = (n + 1) % 6
                if off[i, n] != off[i, m]:
                    e = _SIDES[side[i, n] if off[i, n] else side[i, m]].conj()
                    p, q = (w[i, n] * e).real, (w[i, m] * e).real
                    if min(p, q) < 1 - 1e-9:  # a corner on the side itself needs no crossing
                        points.append(to_sphere(face[i], w[i, n] + (w[i, m] - w[i, n]) * (1 - p) / (q - p)))
            out[some[i]] = np.array(points)
        for i in np.flatnonzero(five).tolist():
            base = int(cells[some[i]] >> 45 & 127)
            length = 1 / math.sqrt(3) / abs(scale)
            first = (180 - 30 + math.degrees(np.angle(scale))) % 60  # clockwise from a face's centre
            first -= 60 if first > 30 + 1e-9 else 0
            points = []
            for n in (2, 1, 0, 4, 3):
                f, at = bases.faces_around[base, n], _plane(bases.corner_around[base, n])
                toward = -at / abs(at)
                place = lambda c, x: at + x * toward * np.exp(-1j * math.radians(c))  # noqa: B023, E731
                # counter-clockwise: the side's crossing with the face before comes first or last
                if first < 30 - 1e-9:
                    cross = length * math.cos(math.radians(30)) / math.cos(math.radians(30 - first - 30))
                    points += [to_sphere(f, place(30.0, cross)), to_sphere(f, place(first, length))]
                else:
                    points.append(to_sphere(f, place(first, length)))
            out[some[i]] = np.array(points)
    return out
