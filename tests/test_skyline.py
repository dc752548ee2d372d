"""Frontiers of three measures and more."""

import random

import numpy as np
import pytest

from quillstone.operators import decide, skyline


def plain(rows, signs):
    """Rows (id, group, values) that no row of their group dominates."""
    ok = [r for r in rows if all(v is not None and np.isfinite(v) for v in r[2])]
    by = {}
    for r in ok:
        by.setdefault(r[1], []).append(r)
    out = []
    for group in by.values():
        points = np.array([[v * s for v, s in zip(r[2], signs, strict=True)] for r in group])
        out += [r[0] for r, lost in zip(group, skyline.beaten(points, points), strict=True) if not lost]
    return sorted(out)


def asked(spark, rows, m, minimize):
    columns = [f"v{i}" for i in range(m)]
    df = spark.createDataFrame([(i, g, *v) for i, g, v in rows], "id long, g string, " + ", ".join(f"{c} double" for c in columns)).repartition(3)
    out = decide.pareto(df, minimize=columns[:minimize], maximize=columns[minimize:], group="g")
    assert out.columns == df.columns
    return sorted(r.id for r in out.collect())


@pytest.mark.parametrize("m,minimize,chunk,cells", [(3, 3, 512, 1000), (3, 1, 5, 30), (4, 2, 7, 16), (5, 5, 3, 1000)])
def test_against_all_pairs(spark, monkeypatch, m, minimize, chunk, cells):
    monkeypatch.setattr(skyline, "CHUNK", chunk)
    monkeypatch.setattr(skyline, "CELLS", cells)
    rng = random.Random(m * 10 + minimize)
    rows = []
    for i in range(600):
        kind = i % 3
        v = [rng.random() for _ in range(m)] if kind == 0 else [float(rng.randrange(4)) for _ in range(m)] if kind == 1 else [0.3 + rng.random() / 9] * m
        rows.append((i, rng.choice(["a", "a", "b", None]), v))
    rows += [(900, "a", [None] + [0.0] * (m - 1)), (901, "a", [float("nan")] * m), (902, "b", [float("inf")] * m), (903, "alone", [1.0] * m), (904, "alone", [1.0] * m)]
    signs = [1] * minimize + [-1] * (m - minimize)
    assert asked(spark, rows, m, minimize) == plain(rows, signs)


def test_a_large_group_of_which_nothing_is_dominated(spark, monkeypatch):
    """Points of a plane: all stay, and no comparison holds more than two chunks, of the grid's related cells only."""
    rng = np.random.default_rng(1)
    a, b = rng.random(6000), rng.random(6000)
    rows = [(i, "g", [float(x), float(y), float(2 - x - y)]) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    assert asked(spark, rows, 3, 3) == list(range(6000))
    cells = __import__("pandas").DataFrame({"gid": 0, "cell": sorted({int(x * 10) + 10 * int(y * 10) + 100 * int((2 - x - y) * 5) for x, y in zip(a, b, strict=True)})})
    related = skyline._related(cells, 10, 3)
    assert len(related) < len(cells) ** 2 / 4


def test_dominated_cells_go_whole():
    import pandas as pd

    cells = pd.DataFrame({"gid": 7, "cell": [0, 111, 110, 222, 101]})  # as digits: 000, 111, 110, 222, 101
    related = skyline._related(cells, 10, 3)
    assert set(related["cell"]) == {0, 110, 101} and set(map(tuple, related[["cell", "other"]].to_numpy())) == {(0, 0), (110, 110), (110, 0), (101, 101), (101, 0)}


def test_nothing(spark):
    assert asked(spark, [], 3, 3) == []
