"""Topology healing by snapping: slits and slivers between polygons of a layer close, within a tolerance.

First vertices of different features that lie within the tolerance of each other are clustered, in tiles of a grid and by components over
the pairs of clusters that reach several tiles, and move to their cluster's most used vertex. Then a vertex that lies within the tolerance of
another feature's edge becomes a vertex of it. Ids and coordinates alone are sent to tiles; only features with a change are rebuilt.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodiag.functions import geometry as g
from geodiag.functions.flat import blocks, flat, grid, nth, polygonal, ranges, tiles
from geodiag.model import Dataset, compute_layers
from geodiag.runtime import discard, materialize, ship


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node reachable, for the nodes ``a`` and ``b`` of edges, by large and small stars until no edge changes."""
    now, mark = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        new = materialize(small, "edges")
        seen = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        discard(now)
        now = new
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen


def vertices(features: DataFrame) -> DataFrame:
    """``layer_idx, x, y, n, low, high``: vertices of polygons, how many features use each, the least and greatest feature with it. A place has a row for each batch of features; tiles sum them up."""

    def batch(batches):
        for b in batches:
            f, layer, feat = flat(b["geom"]), np.asarray(b["layer_idx"]), np.asarray(b["feat_idx"])
            row, x, y = f.row, f.x + 0.0, f.y + 0.0  # no -0.0
            some = polygonal(b["geom"])[row] & (abs(x) < 1e300) & (abs(y) < 1e300)
            row, x, y = row[some], x[some], y[some]
            yield _summed(layer[row], x, y, feat[row], row)

    return features.where(g.is_polygonal(F.col("geom"))).select("layer_idx", "feat_idx", "geom").mapInArrow(batch, VERTICES)


VERTICES = "layer_idx int, x double, y double, n long, low long, high long"


def _merged(group: np.ndarray, x: np.ndarray, y: np.ndarray, *minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by group and place, and where in it a place begins."""
    order = np.lexsort((*minor, y, x, group))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([v[order[1:]] != v[order[:-1]] for v in (group, x, y)])
    return order, np.flatnonzero(new)


def _summed(layer: np.ndarray, x: np.ndarray, y: np.ndarray, feat: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    """One row for each place; a feature counts once at each."""
    order, first = _merged(layer, x, y, row)
    once = np.ones(len(order), np.int64)
    once[1:] = row[order[1:]] != row[order[:-1]]
    once[first] = 1
    at, feat = order[first], feat[order]
    n, low, high = (f.reduceat(v, first) if len(first) else v for f, v in ((np.add, once), (np.minimum, feat), (np.maximum, feat)))
    return pa.RecordBatch.from_arrays([pa.array(layer[at], pa.int32()), *map(pa.array, (x[at], y[at], n, low, high))], names=[c.split()[0] for c in VERTICES.split(", ")])


#: cells of the tolerance's size along a tile's side
TILE = 251
#: bytes of tiles, and pairs, that a task handles at a time
HELD, PAIRS = 8 << 20, 1 << 20
LINKS = "layer_idx int, x double, y double, n long, u double, v double, m long, far boolean"


def _links(points: DataFrame, tolerance: float) -> DataFrame:
    """Vertices ``x, y`` of clusters with the place ``u, v`` that they move to; of clusters that reach another tile (``far``) each pair within the tolerance instead, with its numbers of users.

    A vertex goes to its tile, and to others beside it whose first or last row of cells is next to the vertex's own. So a tile has all pairs of
    its own vertices, and a cluster in which none is another tile's is whole.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    tile = lambda c, by: F.expr(f"({c} + {by} - pmod({c} + {by}, {TILE}L)) div {TILE}L")
    p = points.withColumns({"fx": cell("x"), "fy": cell("y")})
    for c in "xy":
        p = p.withColumn("t" + c, F.explode(F.array_distinct(F.array(*(tile("f" + c, by) for by in (-1, 0, 1))))))
    key = ["layer_idx", "tx", "ty"]
    dealt = p.select(*key, "x", "y", "fx", "fy", "n", "low", "high").repartition(*key).sortWithinPartitions(*key)

    def local(batches):
        for b, t in tiles(batches, key, HELD):
            x, y, n, low, high, fx, fy, tx, ty, layer = (np.asarray(b[c]) for c in ("x", "y", "n", "low", "high", "fx", "fy", "tx", "ty", "layer_idx"))
            order, first = _merged(t, x, y)
            n, low, high = np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
            x, y, fx, fy, tx, ty, layer, t = (v[order[first]] for v in (x, y, fx, fy, tx, ty, layer, t))
            u, v, width = fx - tx * TILE, fy - ty * TILE, TILE + 4
            own = (u >= 0) & (u < TILE) & (v >= 0) & (v < TILE)
            code = (t * width + u + 2) * width + v + 2
            order = np.argsort(code, kind="stable")
            c, pairs = code[order], []
            # each pair of neighbouring cells once
            for step in (0, width - 1, width, width + 1, 1):
                first = np.searchsorted(c, c + step, "left") if step else np.arange(1, len(c) + 1)
                size = np.searchsorted(c, c + step, "right") - first
                for s in blocks(size, PAIRS):
                    i, j = order[np.repeat(np.arange(len(c))[s], size[s])], order[ranges(first[s], size[s])]
                    one = (low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])
                    met = (own[i] | own[j]) & ~one & (np.hypot(x[i] - x[j], y[i] - y[j]) <= tolerance)
                    pairs.append((i[met], j[met]))
            i, j = (np.concatenate(z) for z in zip(*pairs))
            # the first of a cluster by users and place is where it moves
            rank = np.empty(len(x), np.int64)
            first = np.lexsort((y, x, -n))
            rank[first] = np.arange(len(x))
            root, before = rank.copy(), None
            while before is None or (root != before).any():
                before = root.copy()
                np.minimum.at(root, i, before[j])
                np.minimum.at(root, j, before[i])
                root = root[first[root]]
            far = np.zeros(len(x), bool)
            far[root[~own]] = True
            far = far[root]
            some, cut = np.flatnonzero((root != rank) & ~far), far[i]
            goal, i, j = first[root[some]], i[cut], j[cut]
            rows = [np.concatenate(z) for z in ((some, i), (goal, j), (np.zeros(len(some), bool), np.ones(len(i), bool)))]
            at, to, far = rows
            yield pa.RecordBatch.from_arrays([pa.array(layer[at], pa.int32()), *map(pa.array, (x[at], y[at], n[at], x[to], y[to], n[to], far))], names=[c.split()[0] for c in LINKS.split(", ")])

    return materialize(dealt.mapInArrow(local, LINKS), "links")


def _settled(links: DataFrame) -> DataFrame:
    """``layer_idx, x, y, tx, ty`` of :func:`_links`: clusters of several tiles are components of their pairs."""
    near = links.where("not far").select("layer_idx", "x", "y", F.col("u").alias("tx"), F.col("v").alias("ty"))
    far = links.where("far")
    if far.isEmpty():
        return near
    node = lambda n, x, y: F.struct("layer_idx", (-F.col(n)).alias("rank"), F.col(x).alias("x"), F.col(y).alias("y"))
    whole = components(far.select(node("n", "x", "y").alias("a"), node("m", "u", "v").alias("b")))
    return near.union(whole.select("node.layer_idx", "node.x", "node.y", F.col("root.x").alias("tx"), F.col("root.y").alias("ty")))


def clusters(points: DataFrame, tolerance: float) -> DataFrame:
    """``layer_idx, x, y, tx, ty``: vertices that move, and where to. Vertices of one feature alone don't attract each other."""
    return _settled(_links(points, tolerance))


#: an edge and a vertex as they travel
EDGE = np.dtype([("feat", "i8"), ("part", "i4"), ("ring", "i4"), ("pos", "i4"), ("ax", "f8"), ("ay", "f8"), ("bx", "f8"), ("by", "f8")])
POINT = np.dtype([("x", "f8"), ("y", "f8"), ("low", "i8"), ("high", "i8")])


def _edges(b: pa.RecordBatch, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a batch's polygons, their layers, and the levels of grids for them: tiles have sides of 8 to the level, twice an edge's length at least."""
    f, good, layer = flat(b["geom"]), polygonal(b["geom"]), np.asarray(b["layer_idx"])
    i = f.edges()
    row, pos = f.row[i], nth(f.ring)[i]
    e = np.empty(len(i), EDGE)
    e["feat"], e["part"], e["ring"], e["pos"] = np.asarray(b["feat_idx"])[row], nth(f.geom)[f.part[f.ring[i]]], nth(f.part)[f.ring[i]], pos
    e["ax"], e["ay"], e["bx"], e["by"] = f.x[i], f.y[i], f.x[i + 1], f.y[i + 1]
    some = good[row] & ((e["ax"] != e["bx"]) | (e["ay"] != e["by"])) & (abs(e["ax"]) + abs(e["ay"]) + abs(e["bx"]) + abs(e["by"]) < 1e300)
    e = e[some]
    level = np.ceil(np.log2(2 * np.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]) + 4 * tolerance) / 3)
    return e, layer[row[some]], level.astype(np.int64)


DEALT = "layer_idx int, level int, cx long, cy long, edges binary, points binary"


def _packed(name: str, rows: np.ndarray, layer: np.ndarray, level: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> pa.RecordBatch:
    """A row for each tile, with the bytes of what it has of the batch."""
    order = np.lexsort((cy, cx, level, layer))
    keys = [v[order] for v in (layer, level, cx, cy)]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in keys])
    first = np.flatnonzero(new)
    offsets = np.append(first, len(order)) * rows.dtype.itemsize
    made = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(rows[order].tobytes())])
    none = pa.nulls(len(first), pa.binary())
    return pa.RecordBatch.from_arrays([*(pa.array(v[first], t) for v, t in zip(keys, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))), *((made, none) if name == "edges" else (none, made))], names=[c.split()[0] for c in DEALT.split(", ")])


def _unpacked(column: pa.Array, tile: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Records of a column of bytes, and their tiles."""
    column, tile = column.drop_null(), tile[np.asarray(column.is_valid())]
    size = np.asarray(pc.binary_length(column)).astype(np.int64) // kind.itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), np.repeat(tile, size)


def insertions(features: DataFrame, points: DataFrame, tolerance: float) -> DataFrame:
    """``layer_idx, feat_idx, part, ring, pos, t, x, y``: vertices of other features on or near the inside of an edge (from vertex ``pos`` on, at ``t`` of it).

    Edges are dealt to the tiles that they are beside, in a grid for their length; vertices are entered once for each grid in use. Both travel as
    bytes, those of a batch in one tile together, and meet there along the axis that an edge is narrower in.
    """
    polygons = features.where(g.is_polygonal(F.col("geom"))).select("layer_idx", "feat_idx", "geom")

    def grids(batches):
        for b in batches:
            _, layer, level = _edges(b, tolerance)
            seen = np.unique(np.stack([layer, level]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(seen[0], pa.int32()), pa.array(seen[1], pa.int32())], names=["layer_idx", "level"])

    levels: dict[int, list[int]] = defaultdict(list)  # a few dozen whole numbers a layer at most
    for r in polygons.mapInArrow(grids, "layer_idx int, level int").distinct().collect():
        levels[r.layer_idx].append(r.level)

    def edges(batches):
        for b in batches:
            e, layer, level = _edges(b, tolerance)
            side, box = 8.0**level, {}
            for c in "xy":
                lo, hi = np.minimum(e["a" + c], e["b" + c]), np.maximum(e["a" + c], e["b" + c])
                box[c] = grid(lo - tolerance, side), grid(hi + tolerance, side)
            nx, ny = (box[c][1] - box[c][0] + 1 for c in "xy")
            at = np.repeat(np.arange(len(e)), nx * ny)
            k = ranges(np.zeros(len(e), np.int64), nx * ny)
            yield _packed("edges", e[at], layer[at], level[at], box["x"][0][at] + k // ny[at], box["y"][0][at] + k % ny[at])

    def places(batches):
        for b in batches:
            layer = np.asarray(b["layer_idx"])
            v = np.empty(len(layer), POINT)
            for c in POINT.names:
                v[c] = np.asarray(b[c])
            for n in np.unique(layer).tolist():
                own = v[layer == n]
                for level in levels.get(n, ()):
                    yield _packed("points", own, np.full(len(own), n), np.full(len(own), level), grid(own["x"], 8.0**level), grid(own["y"], 8.0**level))

    key = ["layer_idx", "level", "cx", "cy"]
    sent = polygons.mapInArrow(edges, DEALT).unionByName(points.select("layer_idx", "x", "y", "low", "high").mapInArrow(places, DEALT))
    dealt = sent.repartition(*key).sortWithinPartitions(*key)

    def meet(batches):
        for b, t in tiles(batches, key, HELD):
            e, own = _unpacked(b["edges"], t, EDGE)
            v, tile = _unpacked(b["points"], t, POINT)
            if len(v):
                order, first = _merged(tile, v["x"], v["y"])
                low, high = np.minimum.reduceat(v["low"][order], first), np.maximum.reduceat(v["high"][order], first)
                v, tile = v[order[first]], tile[order[first]]
                v["low"], v["high"] = low, high
            layer = np.zeros(int(t[-1]) + 1, np.int64)
            layer[t] = np.asarray(b["layer_idx"])
            wide = abs(e["bx"] - e["ax"]) > abs(e["by"] - e["ay"])
            for c, some in (("x", np.flatnonzero(~wide)), ("y", np.flatnonzero(wide))):
                # complex numbers are in order of tile and place
                z = tile + 1j * v[c]
                order = np.argsort(z)
                z, lo, hi = z[order], np.minimum(e["a" + c], e["b" + c])[some] - tolerance, np.maximum(e["a" + c], e["b" + c])[some] + tolerance
                first = np.searchsorted(z, own[some] + 1j * lo, "left")
                size = np.searchsorted(z, own[some] + 1j * hi, "right") - first
                for s in blocks(size, PAIRS):
                    i, j = np.repeat(some[s], size[s]), order[ranges(first[s], size[s])]
                    o = "y" if c == "x" else "x"
                    beside = (v[o][j] >= np.minimum(e["a" + o], e["b" + o])[i] - tolerance) & (v[o][j] <= np.maximum(e["a" + o], e["b" + o])[i] + tolerance)
                    i, j = i[beside], j[beside]
                    x, y, ax, ay, bx, by = v["x"][j], v["y"][j], e["ax"][i], e["ay"][i], e["bx"][i], e["by"][i]
                    dx, dy = bx - ax, by - ay
                    at = ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)
                    met = ~((v["low"][j] == v["high"][j]) & (v["low"][j] == e["feat"][i])) & (at > 0) & (at < 1) & ~((x == ax) & (y == ay)) & ~((x == bx) & (y == by)) & (np.hypot(ax + at * dx - x, ay + at * dy - y) <= tolerance)
                    i, j = i[met], j[met]
                    yield pa.RecordBatch.from_arrays([pa.array(layer[own[i]], pa.int32()), *(pa.array(e[c][i].copy()) for c in ("feat", "part", "ring", "pos")), pa.array(at[met]), pa.array(x[met]), pa.array(y[met])], names=["layer_idx", "feat_idx", "part", "ring", "pos", "t", "x", "y"])

    return dealt.mapInArrow(meet, "layer_idx int, feat_idx long, part int, ring int, pos int, t double, x double, y double")


def rebuilt(geom: dict, moves: list | None, adds: list | None) -> dict:
    """A polygon with moved and added vertices. A hole without area goes; one whose outer ring would lose its area stays as it was."""
    to = {(m["x"], m["y"]): (m["tx"], m["ty"]) for m in moves or ()}
    more = defaultdict(list)
    for a in adds or ():
        more[a["part"], a["ring"], a["pos"]].append((a["t"], a["x"], a["y"]))
    parts = []
    for i, part in enumerate(geom["parts"]):
        rings = []
        for j, ring in enumerate(part["rings"]):
            old = [to.get((p["x"], p["y"]), (p["x"], p["y"])) for p in ring]
            there, new = set(old), []
            for k, p in enumerate(old):
                for q in (p, *(a[1:] for a in sorted(more.get((i, j, k), ())) if a[1:] not in there)):
                    if not new or new[-1] != q:
                        new.append(q)
            area = sum((p[0] - new[0][0]) * (q[1] - new[0][1]) - (q[0] - new[0][0]) * (p[1] - new[0][1]) for p, q in zip(new, new[1:]))
            if len(new) < 4 or area == 0:
                if j == 0:
                    return geom
                continue
            rings.append([{"x": x, "y": y} for x, y in new])
        parts.append({"kind": part["kind"], "rings": rings})
    return {"gtype": geom["gtype"], "parts": parts}


def _moved(geom: pa.StructArray, moves: pa.ListArray) -> tuple[pa.StructArray, np.ndarray] | None:
    """Polygons with their moved vertices, and which of them :func:`rebuilt` has to make: those with a short ring, equal vertices in a row or an area near 0. None if something in them is null."""
    parts = geom.field("parts")
    rings = parts.values.field("rings")
    points = rings.values
    at = points.values
    if any(a.null_count for a in (geom, parts, parts.values, rings, points, at, at.field("x"), at.field("y"))):
        return None
    f, m = flat(geom), moves.flatten()
    mx, my, tx, ty = (np.asarray(m.field(c)) for c in ("x", "y", "tx", "ty"))
    # a move comes before the vertices at its place
    row, x, y = (np.concatenate(z) for z in ((np.asarray(pc.list_parent_indices(moves)), f.row), (mx, f.x), (my, f.y)))
    order = np.lexsort((np.arange(len(row)) >= len(mx), y, x, row))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([v[order[1:]] != v[order[:-1]] for v in (row, x, y)])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    hit = (head < len(mx)) & (order >= len(mx))
    p, k = order[hit] - len(mx), head[hit]
    x, y = f.x.copy(), f.y.copy()
    x[p], y[p] = tx[k], ty[k]
    odd = np.zeros(len(geom), bool)
    size = np.bincount(f.ring, minlength=len(f.part))
    e = f.edges()
    first = np.cumsum(size) - size
    dx, dy, nx, ny = (v[j] - v[first[f.ring[e]]] for j in (e, e + 1) for v in (x, y))
    turn = lambda v: np.bincount(f.ring[e], v, len(f.part))
    flat_ring = ~(abs(turn(dx * ny - nx * dy)) > 1e-9 * turn(abs(dx * ny) + abs(nx * dy)))
    odd[f.geom[f.part[flat_ring | (size < 4)]]] = True
    odd[f.row[e[(x[e] == x[e + 1]) & (y[e] == y[e + 1])]]] = True
    listed = lambda like, values: pa.ListArray.from_arrays(like.offsets, values, type=like.type)
    at = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], fields=list(at.type))
    inner = pa.StructArray.from_arrays([parts.values.field("kind"), listed(rings, listed(points, at))], fields=list(parts.type.value_type))
    return pa.StructArray.from_arrays([geom.field("gtype"), listed(parts, inner)], fields=list(geom.type)), odd


def _apply(features: DataFrame, changes: DataFrame, name: str) -> DataFrame:
    """Features with the changes of some of them (``layer_idx, feat_idx`` and the array ``name``)."""
    columns, schema = features.columns, features.schema

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # features without a change aren't taken apart
            some = np.flatnonzero(np.asarray(b[name].is_valid()))
            geom = b["geom"]
            place, made = np.arange(len(geom)), [geom]
            if len(some) and name == "moves" and (done := _moved(geom.take(pa.array(some)), b[name].take(pa.array(some)))):
                made.append(done[0])
                place[some] = len(geom) + np.arange(len(some))
                some = some[done[1]]
            if len(some):
                place[some] = sum(map(len, made)) + np.arange(len(some))
                changes = zip(geom.take(pa.array(some)).to_pylist(), b[name].take(pa.array(some)).to_pylist())
                made.append(pa.array([rebuilt(x, c if name == "moves" else None, c if name == "adds" else None) for x, c in changes], geom.type))
            if len(made) > 1:
                geom = pa.concat_arrays(made).take(pa.array(place))
            yield pa.RecordBatch.from_arrays([geom if c == "geom" else b[c] for c in columns], names=columns)

    # merged at every size, as both sides grow with the layer: packed lists are small as files and not as a broadcast
    return features.join(changes.hint("merge"), ["layer_idx", "feat_idx"], "left").select(*columns, name).mapInArrow(rebuild, schema)


def snap(data: Dataset, tolerance: float) -> tuple[Dataset, DataFrame]:
    """The dataset with its polygons snapped, and counts for each layer: ``layer_idx, moved`` (vertices, wherever used), ``added`` (to edges), ``features`` (changed ones).

    Vertices move by the tolerance for each link of their cluster at most, edges bend by the tolerance at most. Null, empty and other
    geometries, properties and ids stay; equal geometries stay equal. A tolerance of 0 or less is an error. Several features with one
    ``feat_idx`` in a layer are changed alike. Overlaps and gaps wider than the tolerance stay, and the rules go on reporting them.
    """
    if not tolerance > 0:
        raise ValueError("the tolerance must be above 0")
    ship(data.spark)
    links = _links(vertices(data.features), tolerance)
    moved = materialize(_settled(links), "moved")
    discard(links)
    users = data.features.where(g.is_polygonal(F.col("geom"))).select("layer_idx", "feat_idx", F.explode(F.array_distinct(g.points(F.col("geom")))).alias("p")).select("layer_idx", "feat_idx", "p.x", "p.y")
    # a feature's own vertices meet in one row, as its geometry does
    moves = materialize(users.join(moved.hint("merge"), ["layer_idx", "x", "y"]).groupBy("layer_idx", "feat_idx").agg(F.collect_set(F.struct("x", "y", "tx", "ty")).alias("moves")), "moves")
    first = materialize(_apply(data.features, moves, "moves"), "features")
    found = insertions(first, vertices(first), tolerance)
    adds = materialize(found.groupBy("layer_idx", "feat_idx").agg(F.collect_set(F.struct("part", "ring", "pos", "t", "x", "y")).alias("adds")), "adds")
    healed = first if adds.isEmpty() else materialize(_apply(first, adds, "adds"), "features")
    n = lambda df, c: df.groupBy("layer_idx").agg(c)
    changed = moves.select("layer_idx", "feat_idx").union(adds.select("layer_idx", "feat_idx")).distinct()
    report = data.layers.select("layer_idx").join(n(moved, F.count(F.lit(1)).alias("moved")), "layer_idx", "left").join(n(adds, F.sum(F.size("adds")).alias("added")), "layer_idx", "left").join(n(changed, F.count(F.lit(1)).alias("features")), "layer_idx", "left").na.fill(0)
    report = materialize(report, "report")
    for t in (moved, moves, adds, *(() if healed is first else (first,))):
        discard(t)
    return Dataset(compute_layers(healed, data.layers), healed, data.path), report
