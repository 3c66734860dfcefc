"""Concentration and mean fragment size that make a corpus most likely, by following the gradient."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths of a step that are tried at once.
TRIED = (2.0, 1.0, 0.3, 0.1, 0.03, 0.003)
#: The parameters stay within these bounds, as logarithms of alpha and of mean_size - 1.
LEAST, MOST = -25.0, 25.0


def slopes(fragments: DataFrame, points: list[tuple[float, float]]) -> list[tuple[float, float, float]]:
    """(log2p, its derivatives by x and y) of the corpus at every point, in one aggregate.

    x is ln(alpha), y is ln(mean_size - 1).  ``fragments``: distinct fragments with cnt, total,
    prior (log2, without the size's share) and size.
    """
    given = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for i, (x, y) in enumerate(points)]))
    rows = fragments.select("cnt", "total", "prior", "size", given.alias("p")).select("*", "p.*").withColumn("ln_mean", F.log1p(F.exp("y")))
    # the logarithm of alpha times the fragment's prior probability
    weight = F.col("x") + F.col("prior") * math.log(2) + (F.col("size") - 1) * F.col("y") - F.col("size") * F.col("ln_mean")
    rows = rows.withColumn("weight", weight)
    more, alpha = F.col("cnt") - 1, F.exp("x")
    # of a fragment that occurs once all comes from the prior, however unlikely it is
    share = F.when(more > 0, F.exp("weight") / (more + F.exp("weight"))).otherwise(1.0)
    value = F.when(more > 0, F.log(more + F.exp("weight"))).otherwise(F.col("weight")) - F.log(F.col("total") - 1 + alpha)
    by_x = share - alpha / (F.col("total") - 1 + alpha)
    by_y = share * (F.col("size") - 1 - F.col("size") * F.exp(F.col("y") - F.col("ln_mean")))
    sums = rows.groupBy("i").agg(*[F.sum(F.col("cnt") * c).alias(n) for n, c in (("value", value), ("by_x", by_x), ("by_y", by_y))])
    found = {r.i: tuple(v / math.log(2) for v in (r.value, r.by_x, r.by_y)) for r in sums.collect()}  # one row a point
    return [found.get(i, (0.0, 0.0, 0.0)) for i in range(len(points))]


def fitted(fragments: DataFrame, alpha: float = 1.0, mean_size: float = 10.0, most_steps: int = 40, enough: float = 1e-6) -> dict[str, float]:
    """alpha, mean_size and log2p where the corpus is most likely, from the given start, and the number of steps taken.

    Quasi-Newton steps in the logarithms of the parameters; each step costs one aggregate, which
    tries several lengths.  Ends when no length gains a share ``enough`` of the value.
    """
    inside = lambda v: min(max(v, LEAST), MOST)
    at = (math.log(alpha), math.log(mean_size - 1))
    now = slopes(fragments, [at])[0]
    h = [[1.0, 0.0], [0.0, 1.0]]  # the inverse of the curvature, learned from the steps
    scale = 1 / max(1.0, math.hypot(*now[1:]))
    h = [[scale, 0.0], [0.0, scale]]
    for step in range(most_steps):
        ways = [tuple(sum(a * g for a, g in zip(row, now[1:])) for row in h), tuple(scale * g for g in now[1:])]
        tried = [(inside(at[0] + t * w[0]), inside(at[1] + t * w[1])) for w in ways for t in TRIED]
        best, then = max(zip(tried, slopes(fragments, tried)), key=lambda x: x[1][0])
        if then[0] - now[0] <= enough * abs(now[0]):
            break
        s = [b - a for a, b in zip(at, best)]
        d = [g - k for g, k in zip(now[1:], then[1:])]  # of the negated value
        sd = s[0] * d[0] + s[1] * d[1]
        if sd > 1e-12:
            left = [[(i == j) - s[i] * d[j] / sd for j in range(2)] for i in range(2)]
            half = [[sum(left[i][k] * h[k][j] for k in range(2)) for j in range(2)] for i in range(2)]
            h = [[sum(half[i][k] * left[j][k] for k in range(2)) + s[i] * s[j] / sd for j in range(2)] for i in range(2)]
        at, now, scale = best, then, scale * 2
    else:
        step = most_steps
    return {"alpha": math.exp(at[0]), "mean_size": 1 + math.exp(at[1]), "log2p": now[0], "steps": step}
