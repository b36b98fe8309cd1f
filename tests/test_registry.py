"""Nearest speakers against brute force; arrays that can't matter are skipped."""

import numpy as np
import pytest

from tapeloom.operators import registry as rg

SAMPLES = "sample_id long, speaker_id long, model int, vector array<double>"


def brute(queries, samples, k):
    def far(a, b):
        if a is None or b is None:
            return None
        size = np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))
        return 1.0 if size == 0 else 1 - np.dot(a, b) / size

    out = {}
    for q, model, v in queries:
        best = {}
        for s, speaker, m, w in samples:
            if m == model and s != q and (d := far(v, w)) is not None:
                best[speaker] = min(best.get(speaker, 9.0), d)
        out[q] = [(s, round(d, 9)) for d, s in sorted((d, s) for s, d in best.items())[:k]]
    return out


@pytest.mark.parametrize("most,per_part", [(4, 3), (64, 256)])
def test_nearest(spark, most, per_part):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8))
    samples = [(i, int(c), int(i % 9 == 0), (centres[c] + rng.normal(size=8) * 0.05).tolist()) for i, c in enumerate(rng.integers(0, 40, 600))]
    samples += [(700, 1, 0, [0.0] * 8), (701, 41, 0, None), (702, 42, 0, [0.0] * 8), (703, 2, 0, samples[0][3]), (704, 3, 0, samples[0][3])]
    queries = [(i, m, v) for i, _, m, v in samples if i % 20 == 0] + [(900, 0, [0.0] * 8), (901, 5, [1.0] * 8)]
    df = spark.createDataFrame(samples, SAMPLES)
    asked = spark.createDataFrame(queries, "query_id long, model int, vector array<double>")
    got = {}
    for r in rg.nearest(asked, df, 3, most, per_part).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.speaker_id, round(r.distance, 9)))
    want = brute(queries, samples, 3)
    assert {q: [d for _, d in v] for q, v in got.items()} == {q: [d for _, d in v] for q, v in want.items() if v}
    ties = {q for q, v in want.items() if len({d for _, d in v}) < len(v)}
    assert all(got[q] == want[q] for q in got if q not in ties) and 700 in ties
    skipped = rg.search(asked, df, 3, most, per_part).groupBy().agg({"*": "count"}).head()[0], rg.search(asked, df, 3, most, per_part).filter("skipped").count()
    assert skipped[1] > 0.7 * skipped[0]  # samples of a speaker lie close together, so most arrays are skipped
    assert rg.nearest(asked, df.limit(0), 3).count() == 0


def test_nearest_unrelated_vectors_and_null_speakers(spark):
    """Vectors that bounds can't skip, met in several query parts and arrays; samples without a speaker are a group, ranked last."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 6)).round(3)
    samples = [(i, None if i % 10 == 9 else i % 10, 0, v.tolist()) for i, v in enumerate(vectors)]
    samples += [(2000, None, 0, samples[0][3]), (2001, 3, 0, samples[0][3]), (2002, 4, None, samples[0][3]), (2003, 5, 0, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    queries = [(i, m, v) for i, _, m, v in samples[:200]]
    df = spark.createDataFrame(samples, SAMPLES)
    got = {}
    for r in rg.nearest(spark.createDataFrame(queries, "query_id long, model int, vector array<double>"), df, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.speaker_id, round(r.distance, 9)))
    want = brute(queries, [(i, 99 if s is None else s, m, v) for i, s, m, v in samples if i != 2003], 3)
    assert [s for s, _ in got[0][:2]] == [3, None]
    assert {q: [(99 if s is None else s, d) for s, d in v] for q, v in got.items()} == want
