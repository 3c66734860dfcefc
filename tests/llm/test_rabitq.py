import numpy as np
import pytest

from grovespark.llm import rabitq

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.98):
    def fine(e):
        return e and all(v is not None and np.isfinite(v) for v in e) and any(e)

    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(n):
        for j in range(i):
            (a, x, p, _), (b, y, q, _) = rows[i], rows[j]
            if p is None or p != q or not fine(x) or not fine(y) or len(x) != len(y):
                continue
            x, y = np.float64(np.float32(x)), np.float64(np.float32(y))
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return sorted((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(n))


def rows_of(seed, n=60, size=64):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = r.normal(size=size)
        for c in range(4):
            noise = r.choice([0, 0.1, 0.18, 0.2, 0.22, 0.4])
            rows.append((len(rows), (base * (c + 1) + (c + 1) * noise * r.normal(size=size)).astype(np.float32).tolist(), int(k % 3), "x"))
    odd = [None, [], [0.0] * size, [1.0, None] * (size // 2), [float("nan")] * size, [float("inf")] + [1.0] * (size - 1), [0.5, 0.25], [0.5, 0.25]]
    rows += [(1000 + i, e, 0, "x") for i, e in enumerate(odd)]
    return rows + [(2000, rows[0][1], None, "x"), (2001, rows[0][1], 0, "x"), (2002, rows[0][1], 0, "x"), (2003, [-0.0, 1.0], 1, "x"), (2004, [0.0, 1.0], 1, "x")]


@pytest.mark.parametrize("seed,block,choice", [(1, 1024, None), (2, 16, None), (3, 16, (24, 4))])
def test_matches_brute_force(spark, monkeypatch, seed, block, choice):
    monkeypatch.setattr(rabitq, "BLOCK", block)
    if choice:
        monkeypatch.setattr(rabitq, "tables_for", lambda *a: choice)
    rows = rows_of(seed)
    got = rabitq.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_tables():
    assert rabitq.tables_for(5000, 0.98) == (1, 0)
    tables, bits = rabitq.tables_for(10**8, 0.98)
    keep = (1 - np.arccos(0.98) / np.pi) ** bits
    assert bits > 8 and (1 - keep) ** tables <= 1.01e-6


def test_empty(spark):
    assert rabitq.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
