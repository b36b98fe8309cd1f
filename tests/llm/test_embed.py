"""Inverted multi-index against brute force."""

import numpy as np
import pytest

from tapeloom.llm import embed


def brute(rows, threshold=0.98):
    good = [i for i, (_, v, y) in enumerate(rows) if y is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.abs(rows[i][1]).max() for i in good}
    unit = {i: x / np.sqrt((x * x).sum()) for i, x in unit.items()}
    return {i: [j for j in good if j != i and rows[j][2] == rows[i][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold] for i in good}


@pytest.mark.parametrize("most", [2048, 5])
def test_near_duplicates(spark, most):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    near = [base[i % 20] * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.04 for i in range(100)]
    rows = [(v.astype(np.float32).tolist(), int(i % 3)) for i, v in enumerate([*base, *near])]
    rows += [rows[0], rows[0], (rows[0][0], 99), (rows[1][0], None), (None, 1), ([], 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([float("inf")] + [1.0] * 15, 1), ([1.0, 2.0], 1), ([1.0, 2.0], 1), ([None] + [1.0] * 15, 1), ([1e-30] * 16, 5), ([1e30] * 16, 5)]
    rows = [(i, v, y) for i, (v, y) in enumerate(rows)]
    want = brute(rows)
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, cell long")
    got = {r.vec_id: r for r in embed.near_duplicates(df, most=most, recall=1.0).collect()}
    assert len(got) == len(rows)
    pairs = sum(map(len, want.values()))
    assert sum(r.n_links for r in got.values()) >= 0.97 * pairs
    for i, _, _ in rows:
        assert got[i].n_links <= len(want.get(i, [])) and got[i].kept == (got[i].component_id == i)
        if not want.get(i):
            assert got[i].component_id == i and got[i].n_links == 0
    if sum(r.n_links for r in got.values()) == pairs:
        comp = {i: i for i in got}
        for _ in got:
            comp = {i: min([comp[i], *(comp[j] for j in want.get(i, []))]) for i in comp}
        assert {i: r.component_id for i, r in got.items()} == comp
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_traversal_is_in_order_of_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    got = embed.traverse(a, b, 40)
    want = sorted(((a[i] + b[j], i, j) for i in range(9) for j in range(7)))[:40]
    assert [(i, j) for _, i, j in want] == got and len(embed.traverse(a, b, 1000)) == 63
