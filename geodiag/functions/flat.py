"""Arrow batches of features as flat numpy arrays, and batches cut at the edges of grid tiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Flat:
    """Points of geometries in order: coordinates, the ring of each; of rings the part, of parts the geometry. Ring and part count from 0 in the array."""

    x: np.ndarray
    y: np.ndarray
    ring: np.ndarray
    part: np.ndarray
    geom: np.ndarray

    @property
    def row(self) -> np.ndarray:
        """Each point's geometry."""
        return self.geom[self.part[self.ring]]

    def edges(self) -> np.ndarray:
        """The points that have a next one in their ring."""
        return np.flatnonzero(self.ring[1:] == self.ring[:-1])


def flat(geom: pa.StructArray) -> Flat:
    parts = pc.struct_field(geom, "parts")
    rings = pc.struct_field(parts.flatten(), "rings")
    points = rings.flatten()
    at = points.flatten()
    up = lambda a: np.asarray(pc.list_parent_indices(a)).astype(np.int64)
    x, y = (pc.struct_field(at, c).to_numpy(zero_copy_only=False).astype(float) for c in "xy")
    return Flat(x, y, up(points), up(rings), up(parts))


def polygonal(geom: pa.StructArray) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.is_in(pc.struct_field(geom, "gtype"), pa.array(["Polygon", "MultiPolygon"])), False))


def nth(owner: np.ndarray) -> np.ndarray:
    """The place of each element among those of its owner, which stand together."""
    lead = np.ones(len(owner), bool)
    lead[1:] = owner[1:] != owner[:-1]
    at = np.arange(len(owner))
    return at - np.maximum.accumulate(np.where(lead, at, 0))


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first[0], first[0] + 1, ...``: ``size`` numbers from each of ``first``."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


def blocks(size: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose sizes sum to about ``most``; a larger element stands alone."""
    total, i = np.concatenate([[0], np.cumsum(size)]), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield slice(i, j)
        i = j


def grid(v: np.ndarray, side) -> np.ndarray:
    """Cells of coordinates, in a range that whole numbers hold."""
    return np.clip(np.floor(v / side), -(2.0**62), 2.0**62).astype(np.int64)


def tiles(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by ``keys`` in batches of whole tiles of ``most`` bytes or so, and the number of each row's tile within the batch."""

    def numbers(b):
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            v = np.asarray(b[k])
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    held, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [tuple(batch[k][i].as_py() for k in keys) for i in (0, batch.num_rows - 1)]
        # held rows go on where a tile has ended
        if size >= most and (ends[0] != last or ends[1] != last):
            cut = 0 if ends[0] != last else int(np.flatnonzero(numbers(batch))[0])
            whole = pa.concat_batches([*held, batch.slice(0, cut)])
            yield whole, numbers(whole)
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size, last = size + batch.nbytes, ends[1]
    if held:
        whole = pa.concat_batches(held)
        yield whole, numbers(whole)
