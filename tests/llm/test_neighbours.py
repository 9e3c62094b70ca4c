import numpy as np

from askmill.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, id int, v string"


def rows_of(x):
    return [(i, [float(a) for a in v], 1, "clash") for i, v in enumerate(x)]


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(i, j) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k]}


def run(spark, rows, dim, k, **how):
    return [(r.id, r.other, r.sim) for r in N.nearest(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", dim, k, **how).collect()]


def test_recall_with_many_small_nodes(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((400, 32)), 6, axis=0) + 0.25 * rng.standard_normal((2400, 32))
    got = {(a, b) for a, b, _ in run(spark, rows_of(x), 32, 5, candidates=24, span=256)}
    want = brute(x, 5)
    assert len(got) == len(want)
    assert len(got & want) / len(want) >= 0.9


def test_unusable_vectors_copies_and_ties(spark):
    rows = [(1, [1.0, 0.0], 1, ""), (2, [2.0, 0.0], 1, ""), (3, [3.0, 0.0], 1, ""), (4, [0.0, 1.0], 1, ""), (5, None, 1, ""), (6, [0.0, 0.0], 1, ""), (7, [1.0], 1, ""), (8, [float("inf"), 1.0], 1, ""), (9, [None, 1.0], 1, ""), (10, [1e30, 1e-30], 1, "")]
    got = sorted((a, b) for a, b, _ in run(spark, rows, 2, 2))
    assert got == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (4, 1), (4, 2), (10, 1), (10, 2)]
    assert run(spark, [], 2, 5) == []
    assert run(spark, rows[:1], 2, 5) == []


def test_a_third_of_all_rows_are_copies(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.tile(rng.standard_normal(8), (300, 1)), rng.standard_normal((600, 8))])
    rows = run(spark, rows_of(x), 8, 5, candidates=20, span=200)
    by = {}
    for a, b, s in rows:
        by.setdefault(a, []).append((b, s))
    assert len(by) == 900 and all(len(v) == 5 for v in by.values())
    assert all(b < 300 for a in range(300) for b, _ in by[a])


def test_pairs(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (3, 1, 0.2)], "id long, other long, sim double")
    assert sorted(tuple(r) for r in N.neighbour_pairs(df).collect()) == [(1, 2), (1, 3)]


def test_growth_against_brute_force():
    rng = np.random.default_rng(1)
    for bits in (6, 60):
        h = np.sort(rng.integers(0, 1 << bits, 200) & ~((1 << (bits // 2)) - 1) | rng.integers(0, 8, 200))
        got = N.growth(h, bits)
        for i in range(0, 200, 7):
            sizes = [int(((h >> (bits - d)) == (h[i] >> (bits - d))).sum()) for d in range(bits + 1)]
            for j in range(N.STEPS):
                want = max((d for d in range(bits + 1) if sizes[d] >= 2 ** (j + 1)), default=0)
                assert got[i, j] == want


def test_all_trees_ascend_together():
    steps = np.zeros((1, 2, N.STEPS), np.int8)
    steps[0, 0, :3], steps[0, 1, :2] = [9, 7, 4], [8, 2]  # nodes of 2, 4, 8 and of 2, 4 members
    assert [int(N.stop_depths(steps, m, 12)[0]) for m in (2, 3, 4, 6, 7, 10, 12, 13)] == [12, 9, 8, 7, 4, 4, 2, 0]


def test_ranges_spread_a_frequent_string():
    bounds = np.array([5, 9, 9, 9, 12])
    assert N._ranges(bounds, np.array([4, 5, 8, 13]), np.arange(4)).tolist() == [0, 1, 1, 5]
    assert set(N._ranges(bounds, np.full(30, 9), np.arange(30)).tolist()) == {2, 3, 4}


def test_a_region_denser_than_the_hash_strings(spark):
    """Thousands of vectors within one hash string: spread over ranges, the result still whole."""
    rng = np.random.default_rng(7)
    x = np.concatenate([1 + 1e-7 * rng.standard_normal((700, 4)), rng.standard_normal((300, 4))])
    by = {}
    for a, b, s in run(spark, rows_of(x), 4, 3, candidates=16, span=100):
        by.setdefault(a, []).append(s)
    assert len(by) == 1000 and all(len(v) == 3 for v in by.values()) and all(min(by[a]) > 0.9999 for a in range(700))


def test_largest_against_sorting():
    rng = np.random.default_rng(2)
    for width in (1, 9, 40, 400, 1003):
        s = rng.uniform(-1, 1, (17, width)).astype(np.float32)
        s[3] = -2
        row, col = N._largest(s, 10)
        for i in range(17):
            want = [] if i == 3 else sorted(s[i], reverse=True)[:10]
            assert s[i, col[row == i]].tolist() == [float(v) for v in want]


def test_close_neighbours_are_told_apart(spark):
    """Sixty vectors whose cosines differ by 1e-5: less than 8-bit codes, and some lists of ten by them, can tell."""
    rng = np.random.default_rng(11)
    base, off = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    angles = np.arccos(1 - 1e-5 * np.arange(60))
    x = (np.cos(angles)[:, None] * base + np.sin(angles)[:, None] * off)[rng.permutation(60)].astype(np.float32)
    x = np.concatenate([base[None].astype(np.float32) * 3, x[np.abs(x @ base.astype(np.float32)) < 1 - 5e-6], rng.standard_normal((200, 64)).astype(np.float32)])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = {(a, b) for a, b, _ in run(spark, rows_of(x), 64, 5)}
    assert got == brute(u, 5)
