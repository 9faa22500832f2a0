"""Merging of overlapping boxes on the plane: tiles of bounded load, a sweep in each, rounds until nothing overlaps.

The result is the one set of boxes of which no two overlap that holds every given box and joins no more of them than it
must; merges may be made in any order and on any subset, so tiles can work on their own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionquarry.operators.written import written

BOUNDS = ("mzmin", "mzmax", "rtmin", "rtmax")
BOX = "mzmin double, mzmax double, rtmin double, rtmax double, mz double, rt double, ion_count double"
_COLUMNS = [c.split()[0] for c in BOX.split(", ")]
#: Boxes that a tile is made for, boxes of the sample that tiles are laid by, and the share of boxes that a round must
#: take away for the next one to be made without halos.
TILE, SAMPLE, WORTH = 20_000, 200_000, 0.1
#: Boxes that grew in a sweep, up to which they are compared with all others instead of another sweep.
FEW = 300


def sweep(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """A label for each box; boxes of a label belong together. One pass in order of x.

    The boxes that reach the sweep line hold disjoint intervals of y, in order: whatever overlaps there has been joined. A
    new box finds those that it overlaps by bisection, and takes them in.
    """
    n, order = len(x0), np.lexsort((y0, x0)).tolist()
    joined = list(range(n))
    x0, x1, y0, y1 = (v.tolist() for v in (x0, x1, y0, y1))
    low: list[float] = []
    high: list[float] = []
    top: list[float] = []
    own: list[int] = []

    def root(k: int) -> int:
        while joined[k] != k:
            joined[k] = joined[joined[k]]
            k = joined[k]
        return k

    for k in order:
        at, end, a, b, k_own = x0[k], x1[k], y0[k], y1[k], k
        i, j = bisect_right(high, a), bisect_left(low, b)
        for t in range(i, j):
            if top[t] > at:
                other = root(own[t])
                joined[root(k_own)] = other
                k_own, a, b, end = other, min(a, low[t]), max(b, high[t]), max(end, top[t])
        low[i:j], high[i:j], top[i:j], own[i:j] = [a], [b], [end], [k_own]
    return np.array([root(k) for k in range(n)], np.int64)


def _grown(boxes: np.ndarray, of: np.ndarray, grown: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``closed`` where all overlaps are ones of the rows ``grown``: each takes in what it overlaps until there is nothing left."""
    boxes, into = boxes.copy(), np.arange(len(boxes))
    alive = np.ones(len(boxes), bool)
    for k in grown:
        while alive[k]:
            x0, x1, y0, y1 = boxes[k]
            hit = alive & (boxes[:, 0] < x1) & (boxes[:, 1] > x0) & (boxes[:, 2] < y1) & (boxes[:, 3] > y0)
            hit[k] = False
            rows = np.flatnonzero(hit)
            if not len(rows):
                break
            alive[rows], into[rows] = False, k
            boxes[k, ::2] = np.minimum(boxes[k, ::2], boxes[rows, ::2].min(0))
            boxes[k, 1::2] = np.maximum(boxes[k, 1::2], boxes[rows, 1::2].max(0))
    while (into[into] != into).any():
        into = into[into]
    return boxes[alive], (np.cumsum(alive) - 1)[into][of]


def closed(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (x0, x1, y0, y1) of the merged boxes, and for each given box the row of the one that holds it.

    A merged box may reach back over one that the sweep has left behind, so sweeps are repeated until nothing merges. After
    a sweep only boxes that have just grown can overlap others; a few of them are settled by themselves.
    """
    of = np.arange(len(boxes))
    while len(boxes):
        label, joined, size = np.unique(sweep(*boxes.T), return_inverse=True, return_counts=True)
        if len(label) == len(boxes):
            break
        low, high = np.full((len(label), 2), np.inf), np.full((len(label), 2), -np.inf)
        np.minimum.at(low, joined, boxes[:, [0, 2]])
        np.maximum.at(high, joined, boxes[:, [1, 3]])
        boxes, of = np.stack([low[:, 0], high[:, 0], low[:, 1], high[:, 1]], 1), joined[of]
        if (size > 1).sum() <= FEW:
            return _grown(boxes, of, np.flatnonzero(size > 1).tolist())
    return boxes, of


class Tiles:
    """A plane cut in halves again and again, by the medians of sampled boxes, along the axis on which fewer of them straddle the cut."""

    def __init__(self, sample: np.ndarray, leaf: int) -> None:
        self.axis, self.cut, self.child = [], [], []
        self._grow(sample, max(1, leaf))
        self.axis, self.cut, self.child = np.array(self.axis), np.array(self.cut), np.array(self.child).reshape(-1, 2)

    def _grow(self, boxes: np.ndarray, leaf: int) -> int:
        node = len(self.axis)
        self.axis.append(-1)
        self.cut.append(0.0)
        self.child.append((node, node))
        best = None
        if len(boxes) > leaf:
            for axis in (0, 1):
                low, high = boxes[:, 2 * axis], boxes[:, 2 * axis + 1]
                cut = float(np.median(low))
                left = int((low < cut).sum())
                if 0 < left < len(boxes):
                    straddle = int(((low < cut) & (high > cut)).sum())
                    best = min(best or (straddle, axis, cut), (straddle, axis, cut))
        if best:
            _, axis, cut = best
            left = boxes[:, 2 * axis] < cut
            self.axis[node], self.cut[node] = axis, cut
            self.child[node] = (self._grow(boxes[left], leaf), self._grow(boxes[~left], leaf))
        return node

    def touched(self, boxes: np.ndarray, all_of_them: bool) -> tuple[np.ndarray, np.ndarray]:
        """(rows, tiles): the tiles that each box has a part of, or that of its lower corner alone."""
        rows, nodes = np.arange(len(boxes)), np.zeros(len(boxes), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            axis = self.axis[nodes]
            over = axis < 0
            done.append((rows[over], nodes[over]))
            rows, nodes, axis = rows[~over], nodes[~over], axis[~over]
            below = boxes[rows, 2 * axis] < self.cut[nodes]
            above = boxes[rows, 2 * axis + 1] > self.cut[nodes] if all_of_them else ~below
            left, right = self.child[nodes[below], 0], self.child[nodes[above], 1]
            rows, nodes = np.concatenate([rows[below], rows[above]]), np.concatenate([left, right])
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _in_tile(group: pd.DataFrame) -> pd.DataFrame:
    boxes, of = closed(group[list(BOUNDS)].to_numpy())
    size = np.bincount(of, minlength=len(boxes))
    first = np.unique(of, return_index=True)[1]
    out = pd.DataFrame(boxes, columns=BOUNDS)
    kept = group[["mz", "rt"]].to_numpy()[first]
    centre = (boxes[:, [0, 2]] + boxes[:, [1, 3]]) / 2
    out[["mz", "rt"]] = np.where((size > 1)[:, None], centre, kept)
    most = np.full(len(boxes), -np.inf)
    np.maximum.at(most, of, group["ion_count"].fillna(-np.inf).to_numpy())
    return out.assign(ion_count=np.where(np.isinf(most), np.nan, most), merged=(size > 1).astype("int64"))


def merge_boxes(boxes: DataFrame, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """Boxes (columns of ``BOX``) of which no two share an area: overlapping ones become their common bounds, again and again.

    A merged box has the centre as mz and rt and the largest ion_count; others stay as they are. Borders that touch don't
    overlap. Boxes that hold no area, or a null or NaN bound, overlap nothing and stay, repeated ones too; equal boxes with
    an area merge. An empty table stays empty.

    The plane is cut into tiles of about ``tile`` boxes by the medians of ``sample`` boxes at most, which move load but not
    results. First each box goes to one tile, which merges what it has: that alone settles dense places, where all boxes of
    a tile become a few, however many there are. When rounds of that kind take little away any more, each box goes to all
    tiles it has a part of, so that two overlapping boxes meet in one; when no tile merges anything, nothing overlaps. A tile's
    group then has its own boxes, which are disjoint but for those that others reach into it with.
    """
    proper = F.lit(True)
    for low, high in (("mzmin", "mzmax"), ("rtmin", "rtmax")):
        proper &= F.coalesce((F.col(low) < F.col(high)) & ~F.isnan(low) & ~F.isnan(high), F.lit(False))
    boxes = boxes.select(*[F.col(c).cast("double") for c in _COLUMNS])
    flat = boxes.filter(~proper)
    centre = lambda low, high, own: F.when(F.col("merged") > 0, (F.col(low) + F.col(high)) / 2).otherwise(F.col(own)).alias(own)

    def distinct(held: DataFrame, merged) -> DataFrame:
        one = held.groupBy(*BOUNDS).agg(F.min("mz").alias("mz"), F.min("rt").alias("rt"), F.max("ion_count").alias("ion_count"), merged.cast("long").alias("merged"))
        return one.select(*BOUNDS, centre("mzmin", "mzmax", "mz"), centre("rtmin", "rtmax", "rt"), "ion_count", "merged")

    held = written(distinct(boxes.filter(proper), F.count(F.lit(1)) > 1))
    count, halo = held.count(), False
    while count:
        if count <= tile:
            dealt = held.withColumn("tile", F.lit(0).cast("long"))
        else:
            drawn = held.select(*BOUNDS).sample(min(1.0, 0.9 * sample / count), 1).limit(sample).toPandas().to_numpy()
            tiles = Tiles(drawn, max(2, int(tile * len(drawn) / count)))

            def deal(batches, tiles=tiles, halo=halo):
                for batch in batches:
                    rows, of = tiles.touched(batch[list(BOUNDS)].to_numpy(), halo)
                    yield batch.iloc[rows].assign(tile=of)

            dealt = held.select(*_COLUMNS).mapInPandas(deal, f"{BOX}, tile long")
        done = dealt.groupBy("tile").applyInPandas(_in_tile, f"{BOX}, merged long")
        held = written(distinct(done, F.max("merged")))
        before = count
        count, merged = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("merged"), F.lit(0))).first()
        if before <= tile or halo and not merged:
            break
        halo = halo or count > (1 - WORTH) * before
    return held.select(*_COLUMNS).unionByName(flat)
