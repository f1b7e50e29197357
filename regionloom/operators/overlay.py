"""Boolean operations on polygons by one planar arrangement.

Edges of all shapes are cut where they meet, equal pieces are joined, and every piece learns which
shapes lie to its left and to its right by counting the pieces to its left at the height of its
middle (even-odd). A piece bounds the result where the two sides differ; bounding pieces walked with
the result on their left are its rings, and their shoelace sum is its area.

Edges meet in bands of about one edge's height, sorted by x within a band, so work follows the edges
that really lie beside each other. Many independent problems (the rows of an Arrow batch) are one
arrangement: edges carry their row, and only edges of one row meet.

A shape is a polygon column's value (parts of rings of points), read by the even-odd rule, so a bow
tie is two triangles. Points that are not finite take their ring along. Nulls are empty shapes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

MOST_SHAPES = 60  # of a row: their sides are bits of an integer
MOST_PIECES = 64  # of a ring that is walked together with those of other rows
_PAIRS = 1 << 22  # held at a time
_TURN = (0.7648421872844885, 0.644217687237691)  # cosine and sine of 0.7 rad, by which heights are measured along no usual direction


class Edges:
    """Edges with the row and the shape (a bit) that they belong to."""

    def __init__(self, row: np.ndarray, bit: np.ndarray, xy: np.ndarray):
        self.row, self.bit, self.xy = row, bit, xy


def edges_of_rows(shapes: list[list]) -> Edges:
    """Edges of rows of shapes; rings are closed if they aren't, repeated points add nothing."""
    flat, sizes, rows, bits = [], [], [], []
    for r, row in enumerate(shapes):
        for k, parts in enumerate(row):
            for rings in parts if parts is not None else ():
                for ring in rings if rings is not None else ():
                    if len(ring) < 3:
                        continue
                    for q in ring:
                        flat.extend(q)
                    sizes.append(len(ring))
                    rows.append(r)
                    bits.append(1 << k)
    if not sizes:
        return Edges(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 4)))
    p, size = np.array(flat, float).reshape(-1, 2), np.array(sizes)
    first = np.cumsum(size) - size
    after = np.arange(1, len(p) + 1)
    after[first + size - 1] = first
    finite = np.repeat(np.logical_and.reduceat(np.isfinite(p).all(1), first), size)
    xy = np.hstack([p, p[after]]) + 0.0
    keep = finite & ((xy[:, 0] != xy[:, 2]) | (xy[:, 1] != xy[:, 3]))
    return Edges(np.repeat(rows, size)[keep], np.repeat(bits, size)[keep], xy[keep])


def _spans(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and values of the ranges low, low + 1, ... of given lengths."""
    owner = np.repeat(np.arange(len(low)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + low[owner]


class Bands:
    """Horizontal bands, for each row about as high as its edges are on average."""

    def __init__(self, row: np.ndarray, y0: np.ndarray, y1: np.ndarray, rows: int):
        n = np.maximum(1, np.bincount(row, minlength=rows))
        self.base = np.full(rows, np.inf)
        np.minimum.at(self.base, row, y0)
        top = np.full(rows, -np.inf)
        np.maximum.at(top, row, y1)
        with np.errstate(invalid="ignore"):
            self.height = np.maximum((top - self.base) / n, np.bincount(row, y1 - y0, rows) / n)
        self.height[~(self.height > 0)] = 1.0
        self.most = int(n.max(initial=1)) + 2
        low, high = self.at(row, y0), self.at(row, y1)
        self.low = low
        self.owner, band = _spans(low, high - low + 1)
        self.key = row[self.owner] * self.most + band

    def at(self, row: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.clip((y - self.base[row]) / self.height[row], 0, self.most - 1).astype(np.int64)


def meeting(e: Edges, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of edges of one row whose boxes meet, each once, some millions at a time."""
    x0, x1 = np.minimum(e.xy[:, 0], e.xy[:, 2]), np.maximum(e.xy[:, 0], e.xy[:, 2])
    y0, y1 = np.minimum(e.xy[:, 1], e.xy[:, 3]), np.maximum(e.xy[:, 1], e.xy[:, 3])
    bands = Bands(e.row, y0, y1, rows)
    order = np.lexsort((x0[bands.owner], bands.key))
    owner, key = bands.owner[order], bands.key[order]
    n = len(owner)
    both = np.lexsort((np.r_[np.zeros(n), np.ones(n)], np.r_[x0[owner], x1[owner]], np.r_[key, key]))
    starts = np.cumsum(both < n)
    until = np.empty(n, np.int64)
    ends = both >= n
    until[both[ends] - n] = starts[ends]
    count = np.maximum(0, until - np.arange(n) - 1)
    total = np.cumsum(count)
    for k in range(0, int(total[-1]) if n else 0, _PAIRS):
        a, b = np.searchsorted(total, k, "right"), np.searchsorted(total, min(k + _PAIRS, int(total[-1])), "left") + 1
        first = np.arange(a, b)
        before = total[first] - count[first]
        skip = np.maximum(0, k - before)
        left, right = _spans(first + 1 + skip, np.minimum(count[first], k + _PAIRS - before) - skip)
        i, j = owner[first[left]], owner[right]
        keep = (y0[i] <= y1[j]) & (y0[j] <= y1[i]) & (key[first[left]] % bands.most == np.maximum(bands.low[i], bands.low[j]))
        yield i[keep], j[keep]


def _side(ax, ay, bx, by, px, py):
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def cut(e: Edges, rows: int) -> Edges:
    """Edges cut at all crossings and touching ends; repeated while the rounded crossings make new ones."""
    for _ in range(8):
        at, points = [], []
        crossed = False
        for i, j in meeting(e, rows):
            ax, ay, bx, by = e.xy[i].T
            cx, cy, dx, dy = e.xy[j].T
            ca, cb = _side(cx, cy, dx, dy, ax, ay), _side(cx, cy, dx, dy, bx, by)
            ac, ad = _side(ax, ay, bx, by, cx, cy), _side(ax, ay, bx, by, dx, dy)
            for on, px, py, edge, (qx, qy, rx, ry) in (
                (ca == 0, ax, ay, j, (cx, cy, dx, dy)), (cb == 0, bx, by, j, (cx, cy, dx, dy)),
                (ac == 0, cx, cy, i, (ax, ay, bx, by)), (ad == 0, dx, dy, i, (ax, ay, bx, by)),
            ):
                inside = on & (np.minimum(qx, rx) <= px) & (px <= np.maximum(qx, rx)) & (np.minimum(qy, ry) <= py) & (py <= np.maximum(qy, ry))
                inside &= ((px != qx) | (py != qy)) & ((px != rx) | (py != ry))
                at.append(edge[inside])
                points.append(np.stack([px[inside], py[inside]], 1))
            proper = np.flatnonzero((np.sign(ca) * np.sign(cb) < 0) & (np.sign(ac) * np.sign(ad) < 0))
            if len(proper):
                t = ca[proper] / (ca[proper] - cb[proper])
                p = np.stack([ax[proper] + t * (bx - ax)[proper], ay[proper] + t * (by - ay)[proper]], 1) + 0.0
                for edge in (i[proper], j[proper]):
                    ends = e.xy[edge]
                    new = ((p != ends[:, :2]).any(1)) & ((p != ends[:, 2:]).any(1))
                    at.append(edge[new])
                    points.append(p[new])
                    crossed |= bool(new.any())
        edge = np.concatenate(at) if at else np.zeros(0, np.int64)
        if not len(edge):
            break
        p = np.concatenate(points)
        along = ((p - e.xy[edge, :2]) * (e.xy[edge, 2:] - e.xy[edge, :2])).sum(1)
        n = len(e.row)
        order = np.lexsort((np.r_[np.full(n, -np.inf), along], np.r_[np.arange(n), edge]))
        of = np.r_[np.arange(n), edge][order]
        start = np.vstack([e.xy[:, :2], p])[order]
        last = np.r_[of[1:] != of[:-1], True]
        end = np.where(last[:, None], e.xy[of, 2:], np.roll(start, -1, 0))
        keep = (start != end).any(1)
        e = Edges(e.row[of][keep], e.bit[of][keep], np.hstack([start, end])[keep])
        if not crossed:
            break
    return e


class Arrangement:
    """Distinct pieces with the shapes (bits) on either side of the way from their smaller to their larger end."""

    def __init__(self, e: Edges, rows: int):
        e = cut(e, rows)
        self.rows = rows
        flip = (e.xy[:, 0] > e.xy[:, 2]) | ((e.xy[:, 0] == e.xy[:, 2]) & (e.xy[:, 1] > e.xy[:, 3]))
        xy = np.where(flip[:, None], e.xy[:, [2, 3, 0, 1]], e.xy)
        order = np.lexsort((*xy.T[::-1], e.row))
        xy, row, bit = xy[order], e.row[order], e.bit[order]
        if len(row):
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (xy[1:] != xy[:-1]).any(1)])
            bit, xy, row = np.bitwise_xor.reduceat(bit, first), xy[first], row[first]
        odd = bit != 0  # a piece that a shape uses twice is no border of it
        self.xy, self.row, self.bit = xy[odd], row[odd], bit[odd]
        self._sides()

    def _sides(self) -> None:
        c, s = _TURN
        x = self.xy[:, ::2] * c - self.xy[:, 1::2] * s
        y = self.xy[:, ::2] * s + self.xy[:, 1::2] * c
        up = y[:, 1] > y[:, 0]
        y0, y1 = y.min(1), y.max(1)
        n = len(self.row)
        self.below = np.zeros(n, np.int64)
        if not n:
            self.left = self.right = self.below
            return
        mx, my = x.mean(1), y.mean(1)
        bands = Bands(self.row, y0, y1, self.rows)
        order = np.argsort(bands.key, kind="stable")
        owner, key = bands.owner[order], bands.key[order]
        asked = self.row * bands.most + bands.at(self.row, my)
        low = np.searchsorted(key, asked)
        count = np.searchsorted(key, asked, "right") - low
        total = np.cumsum(count)
        k = 0
        while k < n:  # pieces by pieces, so that a chunk holds some millions of pairs
            until = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + _PAIRS, "right")))
            q, at = _spans(low[k:until], count[k:until])
            q, o = q + k, owner[at]
            spans = (y0[o] <= my[q]) & (my[q] < y1[o]) & (o != q)
            q, o = q[spans], o[spans]
            t = (my[q] - y[o, 0]) / (y[o, 1] - y[o, 0])
            beside = x[o, 0] + t * (x[o, 1] - x[o, 0]) < mx[q]
            q, o = q[beside], o[beside]
            if len(q):
                first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                self.below[q[first]] = np.bitwise_xor.reduceat(self.bit[o], first)
            k = until
        other = self.below ^ self.bit
        self.left, self.right = np.where(up, self.below, other), np.where(up, other, self.below)

    def border(self, holds: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, xy) of the pieces that bound the region whose shapes `holds` accepts, the region on their left."""
        left, right = holds(self.left), holds(self.right)
        pick = left != right
        xy = np.where(left[pick, None], self.xy[pick], self.xy[pick][:, [2, 3, 0, 1]])
        return self.row[pick], xy

    def areas(self, holds: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Area of the region, row by row."""
        row, xy = self.border(holds)
        near = np.zeros((self.rows, 2))
        near[self.row[::-1]] = self.xy[::-1, :2]  # any point of the row, so that far coordinates cost no digits
        p = xy - np.tile(near[row], 2)
        return np.bincount(row, (p[:, 0] * p[:, 3] - p[:, 2] * p[:, 1]) / 2, self.rows)

    def polygons(self, holds: Callable[[np.ndarray], np.ndarray]) -> list[list]:
        """The region as parts of rings, row by row: outer rings left-handed, their holes right-handed."""
        row, xy = self.border(holds)
        bounds = np.searchsorted(row, np.arange(self.rows + 1))
        single = single_rings(row, xy, bounds)
        return [single[r] if r in single else assemble(xy[a:b]) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]


def single_rings(row: np.ndarray, xy: np.ndarray, bounds: np.ndarray) -> dict[int, list]:
    """What `assemble` gives for rows without pieces and for those whose few pieces are one ring around the region, all rows at once."""
    size = np.diff(bounds)
    found: dict[int, list] = {r: [] for r in np.flatnonzero(size == 0).tolist()}
    if not len(row):
        return found
    start, end = np.lexsort((xy[:, 1], xy[:, 0], row)), np.lexsort((xy[:, 3], xy[:, 2], row))
    clear = (xy[start, :2] == xy[end, 2:]).all(1)  # of every vertex one piece leaves and one arrives
    clear[1:] &= (row[start[1:]] != row[start[:-1]]) | (xy[start[1:], :2] != xy[start[:-1], :2]).any(1)
    held = size > 0
    one = (size >= 3) & (size <= MOST_PIECES)
    one[held] &= np.logical_and.reduceat(clear, bounds[:-1][held])
    after = np.arange(len(row))
    good = one[row[start]] & clear
    after[end[good]] = start[good]
    rows = np.flatnonzero(one)
    first, n = bounds[rows], size[rows]
    path = np.zeros(len(row), np.int64)
    at, whole, step = first.copy(), np.ones(len(rows), bool), 0
    while True:
        going = np.flatnonzero(n > step)
        if not len(going):
            break
        if step:
            whole[going] &= at[going] != first[going]
        path[first[going] + step] = at[going]
        at[going] = after[at[going]]
        step += 1
    whole &= at == first
    rows, first, n = rows[whole], first[whole], n[whole]
    if not len(rows):
        return found
    of, k = _spans(first, n)
    p = xy[path[k], :2]
    begin = np.cumsum(n) - n
    before, behind = np.arange(len(p)) - 1, np.arange(len(p)) + 1
    before[begin], behind[begin + n - 1] = begin + n - 1, begin
    bent = _side(*p[before].T, *p[behind].T, *p.T) != 0
    p, of = p[bent], of[bent]
    n = np.bincount(of, minlength=len(rows))
    begin = np.cumsum(n) - n
    low = np.lexsort((p[:, 1], p[:, 0], of))[begin[n > 0]]  # each ring's smallest vertex
    turn = np.zeros(len(rows), np.int64)
    turn[n > 0] = low - begin[n > 0]
    rows, begin, n, turn = (v[n >= 3] for v in (rows, begin, n, turn))
    if not len(rows):
        return found
    of, k = _spans(np.zeros(len(n), np.int64), n + 1)
    p = p[begin[of] + (k + turn[of]) % n[of]]
    until = np.cumsum(n + 1)
    q = p - p[(until - n - 1)[of]]
    cross = np.r_[q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1], 0.0]
    cross[until - 1] = 0.0
    area, most = np.bincount(of, cross), np.bincount(of, np.abs(cross))
    points = p.tolist()
    for r, b, m, sure in zip(rows.tolist(), until.tolist(), n.tolist(), (area > 1e-9 * most).tolist()):
        if sure:
            found[r] = [[points[b - m - 1 : b]]]
    return found


def rings_of(xy: np.ndarray) -> list[list[tuple[float, float]]]:
    """Simple rings, open, of directed pieces with the region on their left.

    Where several pieces leave a vertex the sharpest turn to the left keeps to one face; a ring that comes back to a
    vertex is cut there, so rings touch but never run through a vertex twice.
    """
    points = [(tuple(a), tuple(b)) for a, b in zip(xy[:, :2].tolist(), xy[:, 2:].tolist())]
    leaving: dict[tuple, list[int]] = {}
    for k, (a, _) in enumerate(points):
        leaving.setdefault(a, []).append(k)
    angle = np.arctan2(xy[:, 3] - xy[:, 1], xy[:, 2] - xy[:, 0]).tolist()
    used, out = [False] * len(points), []
    for k in range(len(points)):
        path, place = [], {}
        while not used[k]:
            used[k] = True
            a, b = points[k]
            place[a] = len(path)
            path.append(a)
            if b in place:
                out.append(path[place[b] :])
                for p in path[place[b] :]:
                    del place[p]
                del path[len(path) - len(out[-1]) :]
            options = [o for o in leaving.get(b, ()) if not used[o]]
            if not options:
                break
            back = angle[k] + np.pi
            k = min(options, key=lambda o: (back - angle[o]) % (2 * np.pi) or 2 * np.pi)
    return out


def _signed(ring: list[tuple[float, float]]) -> float:
    p = np.array(ring) - ring[0]
    q = np.roll(p, -1, 0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def _straightened(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Without the vertices that lie exactly on the line between their neighbours; from the smallest vertex on."""
    p = np.array(ring)
    a, b = np.roll(p, 1, 0), np.roll(p, -1, 0)
    ring = p[_side(a[:, 0], a[:, 1], b[:, 0], b[:, 1], p[:, 0], p[:, 1]) != 0].tolist()
    k = ring.index(min(ring)) if ring else 0
    return [tuple(q) for q in ring[k:] + ring[:k]]


def _contains(ring: np.ndarray, p: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, 0)
    span = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    a, b = a[span], b[span]
    return bool((a[:, 0] + (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]) > p[0]).sum() % 2)


def assemble(xy: np.ndarray) -> list[list[list[list[float]]]]:
    """Parts (outer ring, then its holes) of directed pieces; rings are closed, parts and holes in order of their smallest vertex."""
    rings = [r for r in map(_straightened, rings_of(xy)) if len(r) >= 3]
    signed = [(_signed(r), r) for r in rings]
    outer = sorted((r for s, r in signed if s > 0))
    arrays = [np.array(r) for r in outer]
    sizes = [s for s, r in sorted(((s, r) for s, r in signed if s > 0), key=lambda x: x[1])]
    parts: list[list] = [[[list(p) for p in [*r, r[0]]]] for r in outer]
    boxes = np.array([[*a.min(0), *a.max(0)] for a in arrays]).reshape(-1, 4)
    for hole in sorted(r for s, r in signed if s < 0):
        middle = (np.array(hole[0]) + np.array(hole[1])) / 2
        near = np.flatnonzero((boxes[:, :2] <= middle).all(1) & (middle <= boxes[:, 2:]).all(1))
        around = [(sizes[k], k) for k in near.tolist() if _contains(arrays[k], middle)]
        if around:
            parts[min(around)[1]].append([list(p) for p in [*hole, hole[0]]])
    return parts


def in_all(n: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda sides: sides == (1 << n) - 1


def in_any(sides: np.ndarray) -> np.ndarray:
    return sides != 0


def areas(shapes: list[list], union: bool = False) -> np.ndarray:
    """Area of the intersection (or union) of each row's shapes."""
    n = max((len(r) for r in shapes), default=0)
    return Arrangement(edges_of_rows(shapes), len(shapes)).areas(in_any if union else in_all(n)) + 0.0


def intersections(shapes: list[list]) -> list[list]:
    """Each row's intersection as polygons."""
    n = max((len(r) for r in shapes), default=0)
    return Arrangement(edges_of_rows(shapes), len(shapes)).polygons(in_all(n))


def unions(shapes: list[list]) -> list[list]:
    """Each row's union as polygons, however many shapes: `MOST_SHAPES` at a time, then their unions."""
    while shapes and max(map(len, shapes)) > MOST_SHAPES:
        pieces = [(r, row[k : k + MOST_SHAPES]) for r, row in enumerate(shapes) for k in range(0, max(1, len(row)), MOST_SHAPES)]
        joined: list[list] = [[] for _ in shapes]
        for (r, _), u in zip(pieces, unions([p for _, p in pieces])):
            joined[r].append(u)
        shapes = joined
    return Arrangement(edges_of_rows(shapes), len(shapes)).polygons(in_any)
