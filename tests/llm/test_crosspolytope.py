import numpy as np
import pyarrow as pa

from webgauge.llm import crosspolytope as C


def plain(rows):
    n = len(rows)
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    units = [None if label is None else unit(v) for _, v, label in rows]
    links, parent = [0] * n, list(range(n))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(n):
        for b in range(a + 1, n):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.98:
                links[a] += 1
                links[b] += 1
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return [(rows[k][0], links[k], rows[top(k)][0], top(k) == k) for k in range(n)]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(25):
        base, label = rng.normal(size=48), int(rng.integers(3))
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (base + rng.normal(size=48) * rng.choice([0.0, 0.02, 0.09, 0.14])).tolist(), label))
    crowd = rng.normal(size=48)
    rows += [(len(rows) + k, (crowd + rng.normal(size=48) * 0.1).tolist(), 1) for k in range(60)]
    rows += [(len(rows) + k, v, label) for k, (v, label) in enumerate([(None, 1), ([], 1), ([0.0] * 48, 1), ([None] * 48, 1), ([float("nan")] * 48, 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1), (crowd.tolist(), None)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as n", "3 as hi")
    small, C.BLOCK = C.BLOCK, 16
    try:
        got = sorted(tuple(r) for r in C.near_vectors(df).collect())
    finally:
        C.BLOCK = small
    assert got == plain(rows)
    assert C.near_vectors(df.limit(0)).count() == 0


def test_rotation_keeps_lengths_and_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(np.linalg.norm(C.hadamard(x), axis=1), 1)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z
    a, b = C.keys(C.corners(x)), C.keys(C.corners(y))
    met = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
    assert met.mean() > 0.99
    apart = np.bitwise_count((C.sketch(x) ^ C.sketch(y)).view(np.uint64))
    assert apart.max() <= C.APART and np.bitwise_count((C.sketch(x) ^ np.roll(C.sketch(y), 1)).view(np.uint64)).mean() > 14


def test_vectors_are_told_apart_in_full():
    x = np.array([0.1, 2.0, -3.5])
    assert C._unpacked(pa.array([C._packed(x)]))[0].tolist() == x.tolist() and len(C._packed(np.array([0.5, 2.0]))) == 9
