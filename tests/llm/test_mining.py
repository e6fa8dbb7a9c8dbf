"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from paylens.llm import mining
from paylens.llm.mining import Lists, hard_negatives, products
from tests.llm.helpers import clashing

ROWS = "doc_id long, vec_id long, embedding array<double>, label int"


def frame(spark, rows):
    made = [(0, *r) for r in rows]
    return spark.createDataFrame(made, ROWS).repartition(3) if rows else spark.createDataFrame([], ROWS)


def brute(rows, positives=5, negatives=10):
    kept = []
    for key, v, label in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((key, [math.floor(256 * x) for x in v], label))
    late = lambda key: (key is None, key or 0)
    out = []
    for key, v, label in kept:
        if key is None or key % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), k, l) for k, w, l in kept if len(w) == len(v)]
        mine = sorted(((-s, late(k), k) for s, k, l in scored if l == label and k != key))[:positives]
        for minus, _, positive in mine:
            ps = -minus
            band = sorted((-s, late(k), k) for s, k, l in scored if l != label and 30 * ps <= 100 * s <= 90 * ps)
            out += [(key, positive, i + 1, k, ps, -s) for i, (s, _, k) in enumerate(band[:negatives])]
    return sorted(out, key=repr)


def found(df, **options):
    got = hard_negatives(df, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    return sorted((tuple(r) for r in got), key=repr)


def vectors(n, dim=12, centres=9, seed=1, spread=0.3):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, dim))
    x = middle[draw.integers(0, centres, n)] + spread * draw.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i * 5, v, int(l)) for i, v, l in zip(range(n), x.astype(np.float32).astype(float).tolist(), draw.integers(0, 4, n))]


@pytest.mark.parametrize("options", [{}, {"group": 7, "slice_rows": 100}, {"positives": 2, "negatives": 3}])
def test_negatives_match_brute_force(spark, options):
    rows = vectors(700)
    df = clashing(frame(spark, rows), "v", "node", "score", "rank", "g", "anchor_id")
    own = {k: v for k, v in options.items() if k in ("positives", "negatives")}
    want = brute(rows, **own)
    assert len(want) > 100 and found(df, **options) == want


def test_small_blocks_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(mining, "BLOCK", 64)
    monkeypatch.setattr(mining, "LEAST_SLICES", 2)
    rows = vectors(400, dim=3, spread=0.05)
    assert found(frame(spark, rows)) == brute(rows)
    # products beyond 24 and beyond 53 bits
    for factor in (1e3, 2.0**21):
        large = [(k, [x * factor for x in v], l) for k, v, l in rows[:200]]
        assert found(frame(spark, large)) == brute(large)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(150, dim=4)
    rows += [(1000, None, 1), (1100, [], 1), (1200, [nan] * 4, 1), (1300, [1.0, None, 0.0, 0.0], 1), (1400, [inf, 0.0, 0.0, 0.0], 1), (1500, [1.0] * 4, None)]
    rows += [(1600, [0.0] * 4, 1), (1700, [-1.0] * 4, 2), (1800, [1.0, 2.0], 1), (1801, [1.0, 2.5], 1), (1802, [0.5, 1.0], 2), (1900, [9.0], 3)]
    # repeated rows, a key with two vectors, no key
    rows += [rows[20], rows[20], rows[33], (700, [0.5] * 4, 1), (700, [0.5, 0.4, 0.5, 0.5], 2), (None, [0.5] * 4, 1), (None, [0.25] * 4, 3), (None, [0.25] * 4, 3)]
    assert found(frame(spark, rows)) == brute(rows)
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(100, [1.0, 0.0], 1)])) == []


def test_a_third_of_all_rows_is_one_vector(spark):
    rows = vectors(400, dim=8)
    same = rows[0][1]
    rows = [(k, same if i % 3 == 0 else v, l) for i, (k, v, l) in enumerate(rows)]
    assert found(frame(spark, rows)) == brute(rows)


def test_walks_end_early():
    """Members of a narrow cluster see a small part of far more candidates, and miss nothing."""
    draw = np.random.default_rng(2)
    near = np.floor(256 * (np.eye(16)[0] + 0.02 * draw.normal(size=(20, 16))))
    far = draw.normal(size=(20_000, 16))
    rows = np.floor(256 * np.concatenate([far / np.linalg.norm(far, axis=1)[:, None], near + 0.0]))
    lo, hi = np.full((20, 1), mining._NONE + 1), np.full((20, 1), mining._MOST)
    none = np.zeros(20, dtype=bool)
    lists = Lists(near, np.arange(20), none, np.zeros(20, dtype=np.int64), np.zeros(20, dtype=np.int32), lo, hi, 10, False)
    seen = []
    whole = mining.products
    try:
        mining.products = lambda a, b, length: seen.append(len(a) * len(b)) or whole(a, b, length)
        lists.block(rows, np.arange(100, 100 + len(rows)), np.zeros(len(rows), dtype=bool), np.ones(len(rows), dtype=np.int64))
    finally:
        mining.products = whole
    exact = near @ rows.T
    assert (lists.score[:, 0] == -np.sort(-exact, axis=1)[:, :10]).all()
    assert sum(seen) < 0.2 * exact.size


def test_products_are_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**52, 0.0], [-(2.0**52), 5.0]])
    assert products(a, b, 2.0**92).tolist() == [[2**60 + 3, 2**63 - 1, -(2**63) + 1]]
