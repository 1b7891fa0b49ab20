"""Points near other points, and regions around points, on the sphere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
SAMPLE_ROWS = 100_000
LEAF_ROWS = 4_000
BLOCK_ROWS = 20_000
NODE_ROWS = 8
FANOUT = 8
#: Centre axis and the two face axes of each side of the cube round the sphere; fixed values.
FACES = ((0, 1, 2), (1, 0, 2), (2, 0, 1))
MAX_LEVEL = 17  # cells of some 75 m; deeper ones would be smaller than the discs that are looked up


def to_xyz(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lo, la = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


def distance_m(lon1, lat1, lon2, lat2):
    """Great-circle distance (haversine) in metres."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def face_uv(xyz: np.ndarray, face: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gnomonic coordinates on a face (0..5) and the component along its axis, positive on the face's own half."""
    n, a, b = FACES[face // 2]
    axis = xyz[:, n] * (1 if face % 2 == 0 else -1)
    safe = np.where(axis > 0.05, axis, np.nan)
    return xyz[:, a] / safe, xyz[:, b] / safe, axis


def home_face(xyz: np.ndarray) -> np.ndarray:
    n = np.abs(xyz).argmax(axis=1)
    return n * 2 + (xyz[np.arange(len(xyz)), n] < 0)


def cell_code(face: np.ndarray | int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Z-order code of the deepest quadtree cell that holds (u, v) on a face."""
    side = 1 << MAX_LEVEL
    i, j = (np.clip(((w + 1) / 2 * side).astype(np.int64), 0, side - 1) for w in (u, v))
    code = np.zeros(len(i), np.int64)
    for bit in range(MAX_LEVEL):
        code |= (((i >> bit) & 1) << (2 * bit + 1)) | (((j >> bit) & 1) << (2 * bit))
    return (np.asarray(face, np.int64) << (2 * MAX_LEVEL)) | code


class QuadTree:
    """Leaves of a quadtree on the six faces: sorted first codes, with the number of blocks each leaf is worked in."""

    def __init__(self, starts: np.ndarray, blocks: np.ndarray):
        self.starts, self.blocks = starts, blocks

    @staticmethod
    def grow(codes: np.ndarray, scale: float, min_level_m: float, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
        """Divide every cell expected to hold more than leaf_rows rows; scale is the rows that a code stands for."""
        codes = np.sort(codes)
        deepest = max(0, min(MAX_LEVEL, int(np.floor(np.log2(EARTH_M / max(min_level_m, 1.0))))))
        starts, blocks = [], []
        todo = [(f << (2 * MAX_LEVEL), 0) for f in range(6)]
        while todo:
            first, level = todo.pop()
            width = 1 << (2 * (MAX_LEVEL - level))
            n = (np.searchsorted(codes, first + width) - np.searchsorted(codes, first)) * scale
            if n > leaf_rows and level < deepest:
                todo += [(first + k * (width >> 2), level + 1) for k in range(4)]
            else:
                starts.append(first)
                blocks.append(max(1, int(np.ceil(n / block_rows))))
        order = np.argsort(starts)
        return np.array(starts, np.int64)[order], np.array(blocks)[order]

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, codes, side="right") - 1

    def caps(self) -> tuple[np.ndarray, np.ndarray]:
        """Centre and angular radius of a cap that covers each leaf."""
        widths = np.append(self.starts[1:], 6 << (2 * MAX_LEVEL)) - self.starts
        level = MAX_LEVEL - np.round(np.log2(widths) / 2).astype(int)
        face, code = self.starts >> (2 * MAX_LEVEL), self.starts & ((1 << (2 * MAX_LEVEL)) - 1)
        i = np.zeros(len(code), np.int64)
        j = np.zeros(len(code), np.int64)
        for bit in range(MAX_LEVEL):
            i |= ((code >> (2 * bit + 1)) & 1) << bit
            j |= ((code >> (2 * bit)) & 1) << bit
        size = 2.0 ** (1 - level)
        u, v = i / (1 << MAX_LEVEL) * 2 - 1, j / (1 << MAX_LEVEL) * 2 - 1

        def xyz(u, v):
            out = np.zeros((len(u), 3))
            for f in range(6):
                n, a, b = FACES[f // 2]
                m = face == f
                out[m, n] = 1 if f % 2 == 0 else -1
                out[m, a], out[m, b] = u[m], v[m]
            return out / np.linalg.norm(out, axis=1)[:, None]

        mid = xyz(u + size / 2, v + size / 2)
        far = np.max([np.arccos(np.clip((mid * xyz(u + du, v + dv)).sum(1), -1, 1)) for du in (0 * size, size) for dv in (0 * size, size)], axis=0)
        return mid, far + 1e-9


def leaves_of_discs(tree: QuadTree, xyz: np.ndarray, radius_m: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf that a disc round a point may touch. Discs must be smaller than any leaf."""
    rows, leaves = [], []
    for face in range(6):
        u, v, axis = face_uv(xyz, face)
        grow = radius_m / EARTH_M * 1.01 * (1 + u * u + v * v) + 1e-12
        near = np.flatnonzero((axis > 0.05) & (np.abs(u) <= 1 + grow) & (np.abs(v) <= 1 + grow))
        if not len(near):
            continue
        u, v, grow = u[near], v[near], grow[near]
        for du in (-1, 1):
            for dv in (-1, 1):
                rows.append(near)
                leaves.append(tree.leaf(cell_code(face, np.clip(u + du * grow, -1, 1), np.clip(v + dv * grow, -1, 1))))
    pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(leaves)], axis=1), axis=0) if rows else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


class RTree:
    """Boxes packed by sort-tile-recursive: sorted into slices along the first axis, then along the second.

    Leaves hold node_rows boxes each; above them every FANOUT neighbours share a parent, up to a single root.
    """

    def __init__(self, lo: np.ndarray, hi: np.ndarray, node_rows: int = NODE_ROWS):
        mid, n = (lo + hi) / 2, len(lo)
        nodes = max(1, -(-n // node_rows))
        per = -(-n // max(1, int(np.ceil(np.sqrt(nodes)))))
        first = np.argsort(mid[:, 0], kind="stable")
        order = np.concatenate([s[np.argsort(mid[s, 1], kind="stable")] for s in (first[k : k + per] for k in range(0, n, max(1, per)))]) if n else first
        self.order, self.rows, self.lo, self.hi = order, node_rows, lo[order], hi[order]
        self.levels, size = [], node_rows  # from the leaves to the root: corners of each node's box
        lows, highs = self.lo, self.hi
        while n and (not self.levels or len(lows) > 1):
            at = np.arange(0, len(lows), size)
            lows, highs, size = np.minimum.reduceat(lows, at, axis=0), np.maximum.reduceat(highs, at, axis=0), FANOUT
            self.levels.append((lows, highs))

    def _below(self, node: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(position in node, child) of all children of the nodes of a level; below the leaves the children are boxes."""
        size, most = (FANOUT, len(self.levels[level - 1][0])) if level else (self.rows, len(self.order))
        child = node[:, None] * size + np.arange(size)
        at, k = np.nonzero(child < most)
        return at, child[at, k]

    def overlapping(self, other: RTree, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of boxes (places in what the trees were made of) that meet, in arrays made from some `most` tests at a time.

        Both trees are walked down from their roots together, a level of the taller one at a time.
        """
        if not self.levels or not other.levels:
            return
        root = np.zeros(1, np.int64)
        todo = [(root, root, len(self.levels) - 1, len(other.levels) - 1)]  # level -1: boxes themselves
        while todo:
            i, j, li, lj = todo.pop()
            (alo, ahi), (blo, bhi) = (t.levels[k] if k >= 0 else (t.lo, t.hi) for t, k in ((self, li), (other, lj)))
            meet = np.ones(len(i), bool)
            for a in range(alo.shape[1]):
                meet &= (alo[i, a] <= bhi[j, a]) & (ahi[i, a] >= blo[j, a])
            i, j = i[meet], j[meet]
            if li < 0 and lj < 0:
                yield self.order[i], other.order[j]
                continue
            left = li >= lj
            t, level, node = (self, li, i) if left else (other, lj, j)
            for k in range(0, len(i), max(1, most // (FANOUT if level else t.rows))):
                at, child = t._below(node[k : k + max(1, most // (FANOUT if level else t.rows))], level)
                at += k
                todo.append((child, j[at], li - 1, lj) if left else (i[at], child, li, lj - 1))


def _usable(points: DataFrame, lon: str, lat: str):
    return points.where(F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90) & ~((F.col(lon) == 0) & (F.col(lat) == 0)))


def _quadtree(points: DataFrame, radius_m: float, sample_rows: int, leaf_rows: int, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    n = points.count()
    part = points if n <= sample_rows else points.sample(sample_rows / n, seed=5)
    got = part.select("lon", "lat").toPandas()
    xyz = to_xyz(got["lon"].to_numpy(float), got["lat"].to_numpy(float)).reshape(-1, 3)
    face = home_face(xyz)
    codes = np.zeros(len(xyz), np.int64)
    for f in range(6):
        m = face == f
        u, v, _ = face_uv(xyz[m], f)
        codes[m] = cell_code(f, u, v)
    return QuadTree.grow(codes, n / max(1, len(xyz)), 6 * radius_m, leaf_rows, block_rows)


def _homes(tree: QuadTree, xyz: np.ndarray) -> np.ndarray:
    face, out = home_face(xyz), np.zeros(len(xyz), np.int64)
    for f in np.unique(face):
        m = face == f
        u, v, _ = face_uv(xyz[m], f)
        out[m] = tree.leaf(cell_code(f, u, v))
    return out


PLACED = "leaf long, bi long, bj long, role int, id long, entity string, lon double, lat double, radius double"


def near_pairs(
    points: DataFrame, *, radius_m: float = 40.0, point_id: str = "point_id", entity: str = "entity_id", lon: str = "lon", lat: str = "lat",
    sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of positions of different entities at most `radius_m` apart on the sphere.

    A sample of at most about `sample_rows` positions shapes a quadtree over the six faces of a cube round the
    sphere, where neither the date line nor the poles are special. Every position goes to its own leaf and, as a
    replica, to every leaf its disc may touch. Per leaf a bulk-loaded R-tree of the positions is probed and
    candidates are measured exactly. A pair is reported only in the leaf that is home to its smaller id, so none
    comes twice. Leaves stop dividing at six times the radius; one expected to hold more than `block_rows`
    positions is worked in blocks by blocks, so a crowded spot is never one task.

    Not used: null or out-of-range coordinates, (0, 0), null ids or entities. Rows repeated verbatim count once.
    Empty tables give no rows; extra columns are ignored. radius_m must be below 1,000,000.
    """
    p = _usable(points.where(F.col(point_id).isNotNull() & F.col(entity).isNotNull()), lon, lat)
    p = p.select(F.col(point_id).cast("long").alias("id"), F.col(entity).cast("string").alias("entity"), F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    tree = points.sparkSession.sparkContext.broadcast(_quadtree(p, radius_m, sample_rows, leaf_rows, block_rows))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = QuadTree(*tree.value)
        for d in parts:
            xyz = to_xyz(d["lon"].to_numpy(float), d["lat"].to_numpy(float))
            home, ids = _homes(t, xyz), d["id"].to_numpy(np.int64)
            row, leaf = leaves_of_discs(t, xyz, radius_m)
            nb = t.blocks[leaf]
            own, cut_at = home[row] == leaf, ids[row] % nb
            # a leaf of n blocks is worked as n x n pairs of blocks: a row goes to all pairs with its block on either side
            each = np.repeat(np.arange(len(row)), nb)
            step = np.arange(len(each)) - np.repeat(np.cumsum(nb) - nb, nb)
            mine = np.flatnonzero(own[each] & (nb[each] > 1))
            one, cuts = nb[each] == 1, cut_at[each]
            r = np.concatenate([row[each], row[each[mine]]])
            got = d.iloc[r]
            yield pd.DataFrame({
                "leaf": np.concatenate([leaf[each], leaf[each[mine]]]), "bi": np.concatenate([step, cuts[mine]]), "bj": np.concatenate([np.where(one, 0, cuts), step[mine]]),
                "role": np.concatenate([np.where(one & own[each], 3, 2), np.full(len(mine), 1)]), "id": got["id"].to_numpy(), "entity": got["entity"].to_numpy(), "lon": got["lon"].to_numpy(), "lat": got["lat"].to_numpy(), "radius": 0.0,
            })

    def match(d: pd.DataFrame) -> pd.DataFrame:
        d = d.drop_duplicates(["role", "id"])
        probe, build = d[(d["role"] & 1) > 0], d[(d["role"] & 2) > 0]
        a, b = [], []
        if len(probe) and len(build):
            ent = pd.factorize(pd.concat([probe["entity"], build["entity"]]))[0]
            pe, be = ent[: len(probe)], ent[len(probe) :]
            px, bx = (to_xyz(x["lon"].to_numpy(), x["lat"].to_numpy()) * EARTH_M for x in (probe, build))
            reach = radius_m * 1.001 + 0.01
            pt, bt = RTree(px - reach, px + reach), RTree(bx, bx)
            pid, bid = probe["id"].to_numpy(), build["id"].to_numpy()
            plon, plat, blon, blat = (x.to_numpy() for x in (probe["lon"], probe["lat"], build["lon"], build["lat"]))
            for x, y in pt.overlapping(bt):
                ok = (pid[x] < bid[y]) & (pe[x] != be[y])
                x, y = x[ok], y[ok]
                m = distance_m(plon[x], plat[x], blon[y], blat[y]) <= radius_m
                a.append(pid[x[m]])
                b.append(bid[y[m]])
        return pd.DataFrame({"id_a": np.concatenate(a) if a else np.zeros(0, np.int64), "id_b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    placed = p.mapInPandas(place, PLACED)
    return placed.groupBy("leaf", "bi", "bj").applyInPandas(match, "id_a long, id_b long")


def containing_regions(
    points: DataFrame, regions: DataFrame, *, point_id: str = "point_id", lon: str = "lon", lat: str = "lat", region_id: str = "node_id",
    region_lon: str = "center_lng", region_lat: str = "center_lat", radius: str = "radius_m", sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, region): every region (a disc on the sphere) round each position.

    The same quadtree as in near_pairs; a region goes to every leaf that its disc may touch, a position only to
    its own leaf, where an R-tree of the regions is probed and distances are measured exactly. A crowded leaf
    is worked in blocks of positions.

    Not used: positions as in near_pairs, regions with a null or out-of-range centre, null id, or a null, NaN or
    negative radius. Rows repeated verbatim count once. Empty tables give no rows; extra columns are ignored.
    """
    p = _usable(points.where(F.col(point_id).isNotNull()), lon, lat)
    p = p.select(F.col(point_id).cast("long").alias("id"), F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    r = regions.where(F.col(region_lon).between(-180, 180) & F.col(region_lat).between(-90, 90) & F.col(region_id).isNotNull() & (F.col(radius) >= 0) & ~F.isnan(radius))
    r = r.select(F.col(region_id).cast("string").alias("entity"), F.col(region_lon).alias("lon"), F.col(region_lat).alias("lat"), F.col(radius).cast("double").alias("radius")).distinct()
    tree = points.sparkSession.sparkContext.broadcast(_quadtree(p, 40.0, sample_rows, leaf_rows, block_rows))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = QuadTree(*tree.value)
        for d in parts:
            leaf, ids = _homes(t, to_xyz(d["lon"].to_numpy(float), d["lat"].to_numpy(float))), d["id"].to_numpy(np.int64)
            yield pd.DataFrame({"leaf": leaf, "bi": ids % t.blocks[leaf], "bj": 0, "role": 1, "id": ids, "entity": None, "lon": d["lon"], "lat": d["lat"], "radius": 0.0})

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = QuadTree(*tree.value)
        mid, far = t.caps()
        for d in parts:
            xyz = to_xyz(d["lon"].to_numpy(float), d["lat"].to_numpy(float))
            for k in range(0, len(d), 256):
                part = d.iloc[k : k + 256]
                angle = np.arccos(np.clip(xyz[k : k + 256] @ mid.T, -1, 1))
                row, leaf = np.nonzero(angle <= far[None] + part["radius"].to_numpy()[:, None] / EARTH_M * 1.0001 + 1e-7)
                nb = t.blocks[leaf]
                bi = np.arange(nb.sum()) - np.repeat(np.cumsum(nb) - nb, nb)
                got = part.iloc[np.repeat(row, nb)]
                yield pd.DataFrame({"leaf": np.repeat(leaf, nb), "bi": bi, "bj": 0, "role": 2, "id": 0, "entity": got["entity"].to_numpy(), "lon": got["lon"].to_numpy(), "lat": got["lat"].to_numpy(), "radius": got["radius"].to_numpy()})

    def match(d: pd.DataFrame) -> pd.DataFrame:
        probe, build = d[d["role"] == 1].drop_duplicates("id"), d[d["role"] == 2]
        a, b = [], []
        if len(probe) and len(build):
            px, bx = (to_xyz(x["lon"].to_numpy(), x["lat"].to_numpy()) * EARTH_M for x in (probe, build))
            rad = build["radius"].to_numpy()
            reach = (rad * 1.001 + 0.01)[:, None]
            pt, bt = RTree(px, px), RTree(bx - reach, bx + reach)
            pid, rid = probe["id"].to_numpy(), build["entity"].to_numpy()
            plon, plat, blon, blat = (x.to_numpy() for x in (probe["lon"], probe["lat"], build["lon"], build["lat"]))
            for x, y in pt.overlapping(bt):
                m = distance_m(plon[x], plat[x], blon[y], blat[y]) <= rad[y]
                a.append(pid[x[m]])
                b.append(rid[y[m]])
        return pd.DataFrame({"id": np.concatenate(a) if a else np.zeros(0, np.int64), "region": np.concatenate(b) if b else np.zeros(0, object)}).drop_duplicates()

    placed = p.mapInPandas(place, PLACED).unionByName(r.mapInPandas(spread, PLACED))
    return placed.groupBy("leaf", "bi").applyInPandas(match, "id long, region string")
