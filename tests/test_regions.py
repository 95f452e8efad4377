"""Regions and their outlines, in tiles, against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest

from sunlattice.operators import graph, segments


def raster(rng, h, w, gaps=0.1):
    base = [[rng.random() for _ in range(w)] for _ in range(h)]
    smooth = [[sum(base[min(h - 1, max(0, y + a))][min(w - 1, max(0, x + b))] for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9 for x in range(w)] for y in range(h)]
    return [(y, x, None if rng.random() < gaps else int(smooth[y][x] > 0.5)) for y in range(h) for x in range(w) if rng.random() > 0.03]


def flood(cells):
    left, label = {(y, x): c for y, x, c in cells if c is not None}, {}
    for start in sorted(left):
        if start in label:
            continue
        label[start], todo = start, [start]
        while todo:
            y, x = todo.pop()
            for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if left.get(p) == left[y, x] and p not in label:
                    label[p] = start
                    todo.append(p)
    return label


@pytest.mark.parametrize("tile", [4, 256])
def test_components_in_tiles(spark, tile):
    rng = random.Random(tile)
    rasters = {"a": raster(rng, 23, 31), "b": [(y, x, 1) for y in range(18) for x in range(18) if y % 4 != 1 or x == (0 if y % 8 == 1 else 17)], "c": [(3, 5, None)], "d": [(2, 2, 0)]}
    rows = [(k, *c) for k, cells in rasters.items() for c in cells]
    df = spark.createDataFrame(rows, "raster_id string, yi int, xi int, slope_class int")
    got = {(r.raster_id, r.yi, r.xi): r.label for r in segments.components8(df, tile=tile).collect()}
    assert len(got) == len(rows)
    for k, cells in rasters.items():
        label, width = flood(cells), max(x for _, x, _ in cells) + 1
        for y, x, _ in cells:
            own = label.get((y, x))
            assert got[k, y, x] == (own[0] * width + own[1] if own else None)
    assert segments.components8(df.limit(0), tile=tile).count() == 0


def test_cluster_ids_are_numbered_in_scan_order(spark):
    cells = raster(random.Random(3), 40, 30)
    df = spark.createDataFrame([("a", *c) for c in cells], "raster_id string, yi int, xi int, slope_class int")
    label, kind = flood(cells), {(y, x): c for y, x, c in cells}
    sizes = Counter(label.values())
    nth = {c: {p: i + 1 for i, p in enumerate(sorted(p for p in sizes if kind[p] == c))} for c in (0, 1)}
    for parity in (False, True):
        shared = Counter()
        for p, size in sizes.items():
            shared[nth[kind[p]][p]] += size
        for r in segments.cluster_ids(df, 6, parity=parity).collect():
            start = label.get((r.yi, r.xi))
            want = 0
            if start:
                n = nth[kind[start]][start]
                want = (n if kind[start] == 0 else -n) if (shared[n] if parity else sizes[start]) >= 6 else 0
            assert r.cluster_id == want


def ring_cells(ys, xs):
    """Cells inside a rectilinear ring, by counting the upright sides to the left."""
    sides = [(x1, min(y1, y2), max(y1, y2)) for y1, x1, y2, x2 in zip(ys, xs, ys[1:] + ys[:1], xs[1:] + xs[:1], strict=True) if x1 == x2]
    return {(y, x) for y in range(min(ys), max(ys)) for x in range(min(xs), max(xs)) if sum(a <= x and lo <= y < hi for a, lo, hi in sides) % 2}


@pytest.mark.parametrize("tile", [3, 256])
def test_outlines_hold_the_cells_of_their_cluster(spark, tile):
    cells = [c for c in raster(random.Random(tile), 26, 33) if c[2] is not None]
    cells += [(y + 40, x, 0) for y in range(20) for x in range(20) if not (5 <= y < 9 and 5 <= x < 15)] + [(60, 20, 0)]
    df = spark.createDataFrame([("a", *c) for c in cells], "raster_id string, yi int, xi int, slope_class int")
    marked = segments.cluster_ids(df, 3)
    want = {}
    for r in marked.collect():
        if r.cluster_id:
            want.setdefault(r.cluster_id, set()).add((r.yi, r.xi))
    rings = segments.outlines(marked, tile=tile).collect()
    got = {}
    for r in rings:
        inside = ring_cells(r.ys, r.xs)
        assert abs(r.area2) == 2 * len(inside) and all((a == b) != (c == d) for a, b, c, d in zip(r.ys, r.ys[1:] + r.ys[:1], r.xs, r.xs[1:] + r.xs[:1], strict=True))
        got.setdefault(r.cluster_id, Counter()).update({p: 1 if r.area2 > 0 else -1 for p in inside})
    assert {k: {p for p, n in c.items() if n} for k, c in got.items()} == want and {n for c in got.values() for n in c.values()} <= {0, 1}
    one_turn = {(r.cluster_id, tuple(r.ys), tuple(r.xs)) for r in rings}
    assert one_turn == {(r.cluster_id, tuple(r.ys), tuple(r.xs)) for r in segments.outlines(marked, tile=300).collect()}
    outer = segments.polygons(marked, tile=tile).collect()
    assert len(outer) == sum(r.area2 > 0 for r in rings) and all(p.ring[0] == p.ring[-1] for p in outer)
    assert segments.outlines(marked.limit(0), tile=tile).count() == 0


def test_one_cluster_is_traced_by_many_tasks(spark):
    df = spark.range(64 * 64).selectExpr("'a' raster_id", "cast(id div 64 as int) yi", "cast(id % 64 as int) xi", "1 cluster_id")
    ring = segments.outlines(df, tile=16).collect()
    assert [(r.ys, r.xs, r.area2) for r in ring] == [([0, 0, 64, 64], [0, 64, 64, 0], 2 * 64 * 64)]


def distance(p, ring):
    a, b = ring, np.roll(ring, -1, axis=0)
    d = b - a
    t = np.clip(((p - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return np.sqrt(((p - a - t[:, None] * d) ** 2).sum(1)).min()


def test_simplified_rings(spark):
    rng = random.Random(5)
    marked = segments.cluster_ids(spark.createDataFrame([("a", *c) for c in raster(rng, 40, 40, 0)], "raster_id string, yi int, xi int, slope_class int"), 5)
    fewer = 0
    for r in segments.outlines(marked).where("area2 > 0").collect():
        ring = np.column_stack([r.xs, r.ys]).astype(float)
        touches = segments._crosses(ring)
        for tolerance in (0.0, 0.6, 1.5):
            out = segments.simplified(ring, tolerance)
            assert len(out) >= 4 and all(distance(p, out) <= tolerance + 1e-9 for p in ring)
            assert {tuple(p) for p in out} <= {tuple(p) for p in ring} and (touches or not segments._crosses(out))
            fewer += len(out) < len(ring)
    assert fewer > 3
    square = np.array([[0.0, 0], [4, 0], [4, 4], [0, 4]])
    assert not segments._crosses(square) and segments._crosses(square[[0, 2, 1, 3]])
    frame = spark.createDataFrame([("a", 9.0, 48.0, 9.0 + 39 * 0.0003, 48.0 - 39 * 0.0003, 40, 40)], "raster_id string, lon0 double, lat0 double, lon1 double, lat1 double, rows int, columns int")
    exact = {(r.cluster_id, round(r.area_deg2 / (0.0003 * 39 / 40) ** 2)) for r in segments.polygons_in_degrees(marked, frame, 0).collect()}
    assert exact == {(r.cluster_id, round(r.area)) for r in segments.polygons(marked).collect()}


def test_graph_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7), (None, 3), (5, None)]
    part = list(range(500))
    for u, v in edges:
        if u is not None and v is not None:
            a, b = part[u], part[v]
            part = [min(a, b) if p in (a, b) else p for p in part]
    got = {r.node: r.label for r in graph.connected_components(spark.createDataFrame(edges, "u int, v int")).collect()}
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert got == {x: part[x] for x in nodes}
    assert graph.connected_components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_rings_that_close_in_a_tile_are_not_grouped(spark, monkeypatch):
    m = [[1 if y % 3 and x % 3 else None for x in range(24)] for y in range(24)]
    rows = [("r", y, x, v) for y, row in enumerate(m) for x, v in enumerate(row)]
    cells = spark.createDataFrame(rows, "raster_id string, yi int, xi int, slope_class int")
    ids = segments.cluster_ids(cells, 2)
    made = segments.outlines(ids)
    assert "FlatMapGroupsInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()
    whole = sorted((r.cluster_id, r.area2, r.ys, r.xs) for r in made.collect())
    assert len(whole) == 64 and all(r[1] == 8 for r in whole)
    assert whole == sorted((r.cluster_id, r.area2, r.ys, r.xs) for r in segments.outlines(ids, tile=4).collect())
