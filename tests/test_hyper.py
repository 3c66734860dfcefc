import math

import pytest

from grovespark.operators import hyper
from grovespark.operators.sampling import hyperparameters

ROWS = [("a", 30, 50, -6.0, 4), ("b", 12, 50, -9.0, 3), ("c", 1, 1, -1.0, 1), ("d", 5, 50, -40.0, 9), ("e", 2, 50, -5000.0, 12), ("f", 1, 50, -700.0, 30), ("g", 7, 9, -3.0, 2), ("h", 2, 9, -2.0, 2)]


@pytest.fixture(scope="module")
def fragments(spark):
    return spark.createDataFrame(ROWS, "rhs string, cnt long, total long, prior double, size int").coalesce(1).cache()


def value(x, y):
    alpha, mean, out = math.exp(x), 1 + math.exp(y), 0.0
    for _, cnt, total, prior, size in ROWS:
        prior += (size - 1) * math.log2(1 - 1 / mean) - math.log2(mean)
        first = math.log2(cnt - 1 + alpha * 2**prior) if cnt > 1 else math.log2(alpha) + prior
        out += cnt * (first - math.log2(total - 1 + alpha))
    return out


def test_values_and_slopes_against_differences(fragments):
    points = [(0.0, 1.0), (3.0, 2.0), (-4.0, -1.0), (8.0, 5.0)]
    for (x, y), (v, by_x, by_y) in zip(points, hyper.slopes(fragments, points)):
        e = 1e-5
        assert v == pytest.approx(value(x, y), rel=1e-9)
        assert by_x == pytest.approx((value(x + e, y) - value(x - e, y)) / (2 * e), rel=1e-4, abs=1e-4)
        assert by_y == pytest.approx((value(x, y + e) - value(x, y - e)) / (2 * e), rel=1e-4, abs=1e-4)


def test_beats_the_grid(fragments):
    got = hyper.fitted(fragments)
    grid = hyperparameters(fragments, [0.01, 0.1, 0.5, 1.0, 10.0, 100.0], [1.5, 2.0, 5.0, 8.0, 20.0]).collect()
    assert got["log2p"] >= max(r.log2p for r in grid) - 1e-6 * abs(got["log2p"])
    x, y = math.log(got["alpha"]), math.log(got["mean_size"] - 1)
    assert got["log2p"] == pytest.approx(value(x, y))
    fine = max(value(x + i / 10, y + j / 10) for i in range(-30, 31) for j in range(-30, 31))
    assert got["log2p"] >= fine - 1e-4 * abs(fine)
    other = hyper.fitted(fragments, alpha=200.0, mean_size=60.0)
    assert other["log2p"] == pytest.approx(got["log2p"], rel=1e-4)


def test_empty(fragments):
    assert hyper.fitted(fragments.limit(0))["log2p"] == 0.0
