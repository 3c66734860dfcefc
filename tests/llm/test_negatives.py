import numpy as np
import pytest
from pyspark.sql import functions as F

from grovespark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, part string"


def brute(rows, positives=5, negatives_=3):
    kept = []
    for i, e, label, *_ in rows:
        if i is None or label is None or e is None or any(v is None or not np.isfinite(v) for v in e):
            continue
        x = np.zeros(16)
        x[: len(e)] = np.floor(256 * np.float64(np.float32(e)))
        kept.append((i, label, x))
    out, anchors = [], {(i, label, tuple(x)): (i, label, x) for i, label, x in kept if i % 10 == 0}
    for i, label, x in anchors.values():
        scores = sorted((-int(x @ y), j, other == label) for j, other, y in kept if j != i)
        for p, j, _ in [s for s in scores if s[2]][:positives]:
            found = [s for s in scores if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives_]
            out += [(i, j, r + 1, s[1], -p, -s[0]) for r, s in enumerate(found)]
    return sorted(out)


def rows_of(seed, n=400, size=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, size))
    rows = []
    for k in range(n):
        x = centres[k % 6] * r.choice([0.5, 1.0, 2.0]) + r.normal(size=size) * r.choice([0.02, 0.5])
        rows.append((k, x.astype(np.float32).tolist(), int(r.integers(0, 3)), "a", "p"))
    rows += [(1000 + k, rows[20][1], int(k % 2), "a", "p") for k in range(60)]  # one hot cell, ties
    rows += [(2000, rows[5][1], 1, "a", "p")] * 3 + [(20, rows[20][1], rows[20][2], "a", "p"), (20, rows[7][1], 0, "a", "p")]
    odd = [None, [], [0.0] * size, [1.0, None], [float("nan")] * size, [float("inf")] * size, [0.5, 0.25], [-3.0] * size]
    rows += [(3000 + 5 * k, e, k % 2, None, None) for k, e in enumerate(odd)]
    return rows + [(4000, rows[0][1], None, "a", "p"), (None, rows[0][1], 0, "a", "p"), (4010, rows[0][1], 9, "a", "p")]


@pytest.mark.parametrize("seed,limits", [(1, {}), (2, {"CELL_ROWS": 4, "PART_ROWS": 16, "PROBE": 8, "BLOCK_PARTS": 2, "SLAB": 7, "SEND": 50}), (3, {"CELL_ROWS": 4, "PART_ROWS": 40, "PROBE": 32, "SAMPLE": 30})])
def test_matches_brute_force(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(negatives, name, value)
    rows = rows_of(seed)
    usable = negatives.usable(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("label"))
    assert sorted(map(tuple, negatives.mine(usable, F.col("vec_id") % 10 == 0).collect())) == brute(rows)


def test_sequence_descends():
    r = np.random.default_rng(1)
    one, two = r.normal(size=7), r.normal(size=5)
    got = list(negatives.sequence(one, two))
    assert len({(i, j) for i, j, _ in got}) == 35
    assert np.allclose([s for *_, s in got], np.sort((one[:, None] + two).ravel())[::-1])


def made(seed, n=600, k=6):
    r = np.random.default_rng(seed)
    x = np.floor(100 * r.normal(size=(n, 8)) + 300 * r.normal(size=(10, 8))[r.integers(0, 10, n)])
    index = negatives.Index(8, (negatives.codebook(x[:, :4], k), negatives.codebook(x[:, 4:], k)))
    cell, away = index.place(x)
    cells = np.unique(cell)
    index.learn_cells(cells, np.array([(cell == c).sum() for c in cells]), [np.array([a[cell == c].max() for c in cells]) for a in away])
    return x, index, cell


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold_and_walks_are_certified(monkeypatch, seed):
    monkeypatch.setattr(negatives, "PROBE", 60)
    x, index, cell = made(seed)
    halves = index.half_scores(x[:20])
    for k in range(20):
        s = x @ x[k]
        first = negatives.visited(index, halves, k, -np.inf, np.inf, None)
        seen = np.isin(cell, first)
        least = np.sort(s[seen])[-5]
        rest = negatives.visited(index, halves, k, -np.inf, np.inf, least)
        assert not set(first) & set(rest) and 60 <= seen.sum()
        assert np.isin(cell[s >= least], first + rest).all()
        lo, hi = np.percentile(s, [80, 90])
        window = negatives.visited(index, halves, k, lo, hi, None) + negatives.visited(index, halves, k, lo, hi, -np.inf)
        assert np.isin(cell[(s >= lo) & (s <= hi)], window).all()


def test_far_cells_are_not_visited():
    """Well separated clusters: an anchor's second round leaves most cells out."""
    r = np.random.default_rng(3)
    x = np.floor(1000 * np.eye(8)[r.integers(0, 8, 800)] + r.normal(size=(800, 8)))
    index = negatives.Index(8, (negatives.codebook(x[:, :4], 5), negatives.codebook(x[:, 4:], 5)))
    cell, away = index.place(x)
    cells = np.unique(cell)
    index.learn_cells(cells, np.array([(cell == c).sum() for c in cells]), [np.array([a[cell == c].max() for c in cells]) for a in away])
    near = np.sort(x @ x[0])[-5]
    rest = negatives.visited(index, index.half_scores(x[:1]), 0, -np.inf, np.inf, near)
    assert len(rest) <= 1 < len(cells)


def test_first_in_rows():
    s = np.array([[1.0, 3, 3, -np.inf, 2], [-np.inf] * 5, [5, 5, 5, 5, 5]])
    row, column = negatives.first_in_rows(s, 3)
    assert list(zip(row.tolist(), column.tolist())) == [(0, 1), (0, 2), (0, 4), (2, 0), (2, 1), (2, 2)]


def test_parts_hold_few_rows():
    index = negatives.Index(2, (np.zeros((2, 1)), np.zeros((3, 1))))
    index.learn_cells(np.arange(6), np.array([4000, 90, 20_000, 4096, 1, 1]), [np.zeros(6), np.zeros(6)])
    assert index.parts.tolist() == [1, 1, 5, 1, 1, 1]
    assert index.first.tolist() == [0, 0, 1, 6, 7, 7]


def test_empty(spark):
    for rows in ([], [(10, [1.0, 2.0], 1, None, None)], [(10, None, 1, None, None)]):
        usable = negatives.usable(spark.createDataFrame(rows, SCHEMA), F.col("label"))
        assert negatives.mine(usable, F.col("vec_id") % 10 == 0).count() == 0
