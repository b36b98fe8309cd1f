"""Block-max search against brute force; held-out accuracy; the operator's edge cases."""

import random
import zlib
from collections import Counter

import numpy as np

from tapeloom.llm import toxicity


def test_nearest_is_exact():
    rng = random.Random(1)
    vectors = []
    for _ in range(700):
        x = {rng.randrange(40): rng.random() for _ in range(rng.randint(1, 5))}
        n = sum(w * w for w in x.values()) ** 0.5
        vectors.append({t: w / n for t, w in x.items()})
    ids = rng.sample(range(10_000), 700)
    index = toxicity.Index(vectors, [i % 2 for i in ids], ids, 40)
    for q in vectors[:100]:
        cos = sorted(((-round(sum(w * v.get(t, 0) for t, w in q.items()), 9), i) for v, i in zip(vectors, ids, strict=True)))
        want = [(-c, i) for c, i in cos if c < 0][:15]
        got = [(c, int(index.ids[r])) for c, r in index.nearest(q, 15)]
        assert got == want


def world(n=1500):
    rng = random.Random(2)
    bad = ["idiot", "scumbag", "moron"]
    rows, labels = [(-1, None), (-2, ""), (-3, " \n")], [(-1, 0, 0)]
    for i in range(n):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(1, 80))]
        y = int(rng.random() < 0.2)
        if y:
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad).upper() + "!")
        rows.append((i, " ".join(w)))
        labels.append((i, 0, y))
    return rows, labels


def test_operator(spark):
    rows, labels = world()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, evidence string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows)
    truth = {i: y for i, _, y in labels}
    held = [r for r in got.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert np.mean([r.predicted == truth.get(r.doc_id, 0) for r in held]) > 0.97
    assert got[-1].score == got[-2].score == got[-3].score < 0.5 and any(r.evidence for r in held)
    kept = toxicity.score(docs.select("doc_id", "text", "evidence"), model, keep=True)
    assert kept.columns == ["doc_id", "text", "evidence", "_score", "_predicted"] and kept.count() == len(rows)
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, lab.limit(0))
    assert {r.score for r in toxicity.score(docs.limit(5), none).collect()} == {0.5}


def test_terms():
    assert toxicity.words_of("Ab,c! É".encode()) == [b"ab", b"c", "É".encode()]
    assert toxicity.Counts({b"idio*": 0, b"x": 1}).of(b"idiotic idio X id") == Counter({0: 2, 1: 1})


def test_odd_labels_and_repeated_ids(spark):
    """Labels other than 0 and 1 don't count, half the labels may be toxic, and of texts that share an id the least is learned."""
    bad, good = ["you idiot there", "what an idiot"], ["a fine day", "the sun is out"]
    docs = spark.createDataFrame([(i, (bad if i % 2 else good)[i % 4 // 2]) for i in range(1, 401)] + [(2, "zzz idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 401)] + [(3, 7), (4, -1), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id != 2)


def test_quantile():
    assert abs(toxicity.quantile(0.05) - 3.8415) < 1e-3 and abs(toxicity.quantile(1e-6) - 23.928) < 1e-2
