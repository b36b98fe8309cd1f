"""Collocations, exact top-k and fill-in-the-middle against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import collocations, infill, topk

DOCS = "doc_id long, text string, lang string, gram string, words long, n long, form string, f long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, y, "x", 1, 2, "y", 3) for i, (t, y) in enumerate(rows)], DOCS)


def brute_phrases(rows, least, top, share=80):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang, text = "und" if lang is None else lang, (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    good = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    inside = lambda s, g: any(g[i : i + len(s)] == s for i in range(len(g) - len(s) + 1))
    out = []
    for (lang, g), a in good.items():
        if any(y == lang and len(h) > len(g) and inside(g, h) and 100 * b >= share * a for (y, h), b in good.items()):
            continue
        score, k = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.append((lang, -score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    rows = []
    for lang in total:
        mine = sorted(r for r in out if r[0] == lang)[:top]
        rows += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (_, s, a, p, x, y) in enumerate(mine)]
    return sorted(rows)


def mixed_texts():
    rng = random.Random(4)
    common, rare = ["of", "the", "in", "fox", "Über", "a"], [f"w{i}" for i in range(300)]
    rows = [(None, "en"), ("", None), ("one", "en"), (" \t ", "en"), ("...", "de")]
    for i in range(120):
        words = [rng.choice(common) if rng.random() < 0.7 else rng.choice(rare) for _ in range(rng.randint(1, 60))]
        words = [w + rng.choice(["", "", "", ".", ",\n", "\t", "!\r"]) for w in words]
        rows.append((rng.choice([" ", "  "]).join(words), rng.choice(["en", "de", None, ""])))
    return rows + [("Quick Brown Fox jumps over it", "en")] * 12 + [("quick brown dog", "en")] * 2 + [("the end " * 500, "de")]


@pytest.mark.parametrize("least,top,cut", [(1, 2000, None), (4, 2000, 64), (4, 7, None), (30, 2000, 64)])
def test_collocations(spark, least, top, cut):
    rows = mixed_texts()
    got = collocations.collocations(docs(spark, rows), least=least, top=top, **({"slice_bytes": cut} if cut else {}))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs(spark, [])).count() == 0
    assert collocations.collocations(docs(spark, [(None, None), ("a b", "en")])).count() == 0


def test_a_screen_may_let_rare_grams_through(spark):
    """With a map of few bits nearly every gram passes, with many bits few do; the result is the same."""
    rows = mixed_texts()
    sizes = [collocations.edges(docs(spark, rows).select("lang", "text").fillna("und"), 4, 4, bits).filter("words > 2").count() for bits in (6, 27)]
    assert sizes[0] > 1.5 * sizes[1]
    assert sorted(map(tuple, collocations.collocations(docs(spark, rows), least=4, map_bits=6).collect())) == brute_phrases(rows, 4, 2000)


VECTORS = "vec_id long, embedding array<double>, row long, block int, v int"


def brute_top(rows, k=5, every=50):
    good = [(i, r, [int(np.floor(256 * c)) for c in v]) for i, (r, v) in enumerate(rows) if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, q, a in good:
        if q is not None and q % every == 0:
            all_ = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), r is None, r or 0) for j, r, b in good if j != i and len(a) == len(b))
            out += [(q, n + 1, None if null else r, max(-(1 << 63), min(-s, (1 << 63) - 1))) for n, (s, null, r) in enumerate(all_[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [16384, 7])
def test_top_k(spark, block):
    rng = np.random.default_rng(6)
    base = [rng.normal(size=12).tolist() for _ in range(150)]
    rows = [(i, v) for i, v in enumerate(base)] + [(200, base[0]), (250, [0.0] * 12), (301, base[0]), (302, base[0]), (100, base[3]), (None, base[0])]
    rows += [(350, None), (400, [float("nan")] * 12), (450, [None] * 12), (500, [float("inf")] + [1.0] * 11), (550, [1.0, 2.0]), (551, [3.0, -4.0]), (600, []), (601, []), (650, [1.5])]
    rows += [(303, base[0])] * 30  # ties
    df = spark.createDataFrame([(r, v, 1, 2, 3) for r, v in rows], VECTORS)
    got = sorted((tuple(r) for r in topk.top_k(df, block=block).collect()), key=repr)
    assert got == brute_top(rows)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.filter("vec_id = 450")).count() == 0


def test_top_k_is_exact_for_large_components(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(-(2**28), 2**28, 3) / 256.0 * 4).tolist()) for i in range(60)]
    rows += [(50, [2.0**22, 1.0, 0.0]), (61, [2.0**22, 1.0, 0.0]), (62, [2.0**22, 1.0 + 2.0**-8, 0.0])]
    df = spark.createDataFrame([(r, v, 1, 2, 3) for r, v in rows], VECTORS)
    assert sorted((tuple(r) for r in topk.top_k(df).collect()), key=repr) == brute_top(rows)


def test_the_walk_stops_early():
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(size=(2000, 3)) * 256)
    lists = topk.Lists(x, np.arange(2000), list(range(2000)))
    q = np.array([900.0, -4.0, 1.0])
    found, scored = lists.search(q, 5, -1)
    assert scored < 1000 and [p for p, _ in found] == sorted(range(2000), key=lambda i: (-(x[i] @ q), i))[:5]
    assert lists.search(q, 5, -1, floor=int(9e9))[1] == 0  # no row can reach the k-th result of another block


def brute_fim(i, text, plain=90, spm=20):
    text = text or ""
    h = hashlib.sha256(f"1:{i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[a : a + 8], 16) for a in (0, 8, 16, 24))
    n = len(text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain:
        return i, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < spm else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return i, n, form, a, b - a, sha(out), sha(text)


def test_infill(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "é", "a<P>b", "<M>", "<", "<<S", "x" * 300_000, "日本語𝄞" * 5000, "\r\n\x00"]
    texts += ["".join(rng.choice("abé <>PSM𝄞") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    df = docs(spark, [(t, "en") for t in texts])
    got = infill.transform(df, with_text=True)
    rows = {r.doc_id: r for r in got.collect()}
    assert {r[:7] for r in rows.values()} == {brute_fim(i, t) for i, t in enumerate(texts)}
    assert {r.form for r in rows.values()} == {"plain", "psm", "spm"} and any(r.middle_chars == 0 for r in rows.values())
    back = {r.doc_id: r.restored for r in infill.undo(got).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert infill.transform(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "abc"), (5, "same"), (5, "same")], "doc_id long, text string")
    assert [r.n for r in infill.transform(odd).collect()] == [3, 4, 4]


def test_pieces():
    text = b"0123456789"
    pieces = infill.cut(infill.cut([(0, 0, 10)], 4), 4)
    assert pieces == [(0, 0, 4), (0, 4, 0), (0, 4, 6)] and infill.cut([(0, 0, 10)], 0) == [(0, 0, 0), (0, 0, 10)]
    assert infill.cut([(0, 0, 4), (0, 4, 6)], 10) == [(0, 0, 4), (0, 4, 6), (0, 10, 0)]
    marks = infill.Sentinels("[pre]", "[mid]", "[end]")
    out = b"".join(infill.read(infill.arrange(pieces, "spm", marks), (text, marks.buffer())))
    assert out == b"[end]456789[pre]0123[mid]"
    assert b"".join(infill.read(infill.restore(out, "spm", marks), (out, b""))) == text
    for bad in (("", "b", "c"), ("ab", "b", "c"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            infill.Sentinels(*bad)
