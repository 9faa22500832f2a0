import random

import numpy as np
import pandas as pd
import pytest

from ionquarry.operators import boxes, slicing


def fixpoint(rows):
    """Two boxes that share an area become their common bounds, as long as there are any; by plain search."""
    held = [tuple(r[:4]) for r in rows]
    while True:
        for i, a in enumerate(held):
            j = next((j for j in range(i) if min(a[1], held[j][1]) > max(a[0], held[j][0]) and min(a[3], held[j][3]) > max(a[2], held[j][2])), None)
            if j is not None:
                b = held[j]
                held = [x for k, x in enumerate(held) if k not in (i, j)] + [(min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]))]
                break
        else:
            return sorted(held)


def random_boxes(r, n, wide):
    out = []
    for _ in range(n):
        x, y = (r.choice([r.random() * 30, float(r.randrange(30))]) for _ in range(2))
        out.append((x, x + r.choice([0.3, 1, wide]) * r.random(), y, y + r.choice([0, 0.5, 1, wide]) * r.random(), x, y, r.random()))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_closed_equals_plain_search(seed, monkeypatch):
    monkeypatch.setattr(boxes, "FEW", (0, 2, 300)[seed % 3])
    r = random.Random(seed)
    rows = [b for b in random_boxes(r, r.randrange(0, 90), r.choice([1, 4, 25])) if b[3] > b[2] and b[1] > b[0]]
    got, of = boxes.closed(np.array([b[:4] for b in rows]).reshape(-1, 4))
    assert sorted(map(tuple, got.tolist())) == fixpoint(rows)
    for b, k in zip(rows, of, strict=True):
        assert got[k][0] <= b[0] and got[k][1] >= b[1] and got[k][2] <= b[2] and got[k][3] >= b[3]


@pytest.mark.parametrize(("wide", "tile"), [(1, 7), (6, 11), (40, 5)])
def test_tiles_equal_plain_search(spark, wide, tile):
    r = random.Random(wide)
    rows = random_boxes(r, 150, wide)
    rows += rows[:5] + [(5.0, 5.0, 1.0, 2.0, 5.0, 1.5, 3.0), (float("nan"), 1.0, 1.0, 2.0, 0.0, 0.0, 1.0), (None, 1.0, 1.0, 2.0, 0.0, 0.0, None)]
    got = boxes.merge_boxes(spark.createDataFrame(rows, boxes.BOX), tile=tile).collect()
    proper = [b for b in rows if b[0] is not None and b[0] < b[1] and b[2] < b[3]]
    flat = [b for b in rows if b not in proper]
    held = [x for x in got if x.mzmin is not None and x.mzmin < x.mzmax and x.rtmin < x.rtmax]
    assert sorted(tuple(x[:4]) for x in held) == fixpoint(proper) and len(got) - len(held) == len(flat)
    for x in held:
        inside = [b for b in proper if x.mzmin <= b[0] and b[1] <= x.mzmax and x.rtmin <= b[2] and b[3] <= x.rtmax]
        assert x.ion_count == max(b[6] for b in inside)
        assert (x.mz, x.rt) == (pytest.approx((x.mzmin + x.mzmax) / 2), pytest.approx((x.rtmin + x.rtmax) / 2)) if len(inside) > 1 else (x.mz, x.rt) == inside[0][4:6]
    assert boxes.merge_boxes(spark.createDataFrame([], boxes.BOX)).collect() == []


def test_a_hot_place_and_a_chain(spark):
    r = random.Random(1)
    hot = [(500 - r.random() * 1e-3, 500 + r.random() * 1e-3, 3.0 - r.random(), 3 + r.random(), 500.0, 3.0, 1.0) for _ in range(400)]
    chain = [(float(i), i + 1.5, i * 0.1, i * 0.1 + 0.2, i + 0.75, i * 0.1 + 0.1, 2.0) for i in range(0, 300)]
    rows = hot + chain
    got = boxes.merge_boxes(spark.createDataFrame(rows, boxes.BOX), tile=50).collect()
    assert sorted(tuple(x[:4]) for x in got) == fixpoint(hot[:60] + [(min(h[0] for h in hot), max(h[1] for h in hot), min(h[2] for h in hot), max(h[3] for h in hot))] + chain)


@pytest.fixture
def dense():
    draw = np.random.default_rng(4)
    mz, rt = draw.uniform(100, 1000, 200_000), draw.uniform(0, 60, 200_000)
    return pd.DataFrame({"mz": mz, "rt": rt, "intensity": draw.uniform(1, 9, 200_000)})


def test_200_000_dense_slices_in_groups_of_bounded_size(spark, dense, tmp_path, monkeypatch):
    inner, seen = boxes._in_tile, str(tmp_path)

    def counted(group):
        import uuid

        with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(group)))
        return inner(group)

    monkeypatch.setattr(boxes, "_in_tile", counted)
    around = slicing.around_points(spark.createDataFrame(dense), 20, 0.4)
    given = around.toPandas()[list(boxes.BOUNDS)].to_numpy()
    got = boxes.merge_boxes(around, tile=10_000).toPandas()
    want = boxes.closed(given)[0]
    assert sorted(map(tuple, got[list(boxes.BOUNDS)].to_numpy().tolist())) == sorted(map(tuple, want.tolist()))
    assert len(want) < 170_000
    assert max(int(p.read_text()) for p in tmp_path.iterdir()) <= 20_000


def plain_slices(points, ppm, rt_window, first_wins):
    """All slices of a tenth of a Da are searched for each point."""
    held = []
    for mz, rt, y in sorted(points, key=lambda p: (p[1], p[0], p[2])):
        low, high, inside = mz * (1 - ppm / 1e6), mz * (1 + ppm / 1e6), [s for s in held if s["bin"] == int(mz * 10) and s["mzmin"] <= mz <= s["mzmax"] and s["rtmin"] <= rt <= s["rtmax"]]
        if not inside:
            held.append({"bin": int(mz * 10), "mzmin": low, "mzmax": high, "rtmin": rt - 2 * rt_window, "rtmax": rt + 2 * rt_window, "mz": mz, "rt": rt, "ion_count": y})
        elif not first_wins:
            s = min(inside, key=lambda s: (abs(s["mz"] - mz), abs(s["rt"] - rt)))
            s["rtmin"], s["rtmax"], s["ion_count"] = min(s["rtmin"], rt - 2 * rt_window), max(s["rtmax"], rt + 2 * rt_window), max(s["ion_count"], y)
            s["mzmin"], s["mzmax"] = max(min(s["mzmin"], low), low), min(max(s["mzmax"], high), high)
            s["mz"], s["rt"] = (s["mzmin"] + s["mzmax"]) / 2, (s["rtmin"] + s["rtmax"]) / 2
    return sorted((s["mzmin"], s["mzmax"], s["rtmin"], s["rtmax"], s["mz"], s["rt"], s["ion_count"]) for s in held)


@pytest.mark.parametrize("first_wins", [False, True])
def test_slices_of_points_equal_plain_search(spark, first_wins):
    r = random.Random(9)
    points = [(100 + r.random() * 0.5, round(r.random() * 60, 1), float(r.randrange(9))) for _ in range(1500)] + [(100.25, 5.0, 1.0)] * 4
    table = spark.createDataFrame([*points, (None, 1.0, 1.0), (100.0, float("nan"), 1.0)], "mz double, rt double, intensity double")
    got = slicing.slice_points(table, 300, 0.4, first_wins).collect()
    assert sorted(map(tuple, got)) == plain_slices(points, 300, 0.4, first_wins)
    assert slicing.slice_points(table.limit(0), 300).collect() == []


def test_registered_queries_equal_plain_search(spark):
    from ionquarry.plans import catalog
    from ionquarry.sources import views

    sf = "/root/testdata/sf0.001"
    points = [(x.mz, x.rt / 60, float(x.intensity)) for x in views.signal(spark, sf).select("mz", "rt", "intensity").collect()]
    got = {n: sorted(map(tuple, catalog.QUERIES[n](spark, sf).select("mzmin", "mzmax", "rtmin", "rtmax", "mz", "rt", "ion_count").collect())) for n in ("slices_by_points", "slices_first", "slices_merged")}
    high = [p for p in points if p[2] > 200]
    assert np.allclose(got["slices_by_points"], plain_slices([p for p in points if p[2] > 150], 2000, 2.0, False), rtol=1e-12)
    assert np.allclose(got["slices_first"], plain_slices(high, 3000, 6.0, True), rtol=1e-12)
    around = np.array([(mz - mz * 3000 / 1e6, mz + mz * 3000 / 1e6, rt - 12.0, rt + 12.0) for mz, rt, _ in high])
    assert np.allclose([x[:4] for x in got["slices_merged"]], sorted(map(tuple, boxes.closed(around)[0].tolist())), rtol=1e-12)
