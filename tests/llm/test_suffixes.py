"""Deep-shallow sorting and the removal of repeated strings against brute force."""

import random
from collections import Counter

import pytest

from tapeloom.llm import suffixes


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_sort(seed):
    rng = random.Random(seed)
    strings = [b"head" + bytes(rng.choice(b"ab\0") for _ in range(rng.choice([0, 1, 7, 8, 9, 20, 60]))) for _ in range(150)]
    strings += [strings[0] + b"z" * k for k in range(30)] + [b"head" + b"q" * 40 + bytes([rng.randrange(256), rng.randrange(256)]) for _ in range(80)]
    order, lcp = suffixes.deep_shallow(strings, 4)
    got = [strings[i] for i in order]
    assert got == sorted(strings) and sorted(order) == list(range(len(strings)))
    assert lcp.tolist() == [-1] + [shared(a, b) for a, b in zip(got, got[1:], strict=False)]


def test_windows_choose_by_content_alone():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcd") for _ in range(5000)) + b"a" * 900
    grams = suffixes.Grams(40, 12)
    for t in (text, b"a" * 300, text[:40]):
        pos, h, first, last = grams.choose(t)
        assert first[0] == 0 and last[-1] == len(t) - 40 and (first[1:] == last[:-1] + 1).all() and ((first <= pos) & (pos + 12 <= first + 40)).all()
        assert len(set(zip(h.tolist(), (t[p : p + 12] for p in pos), strict=True))) == len({t[p : p + 12] for p in pos})
    chosen = {}
    pos, _, first, last = grams.choose(text)
    for p, a, b in zip(pos.tolist(), first.tolist(), last.tolist(), strict=True):
        for s in range(a, b + 1):
            assert chosen.setdefault(text[s : s + 40], p - s) == p - s


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(n)) for n in (7, 9, 12, 20, 60)]
    out = [None, "", "short", "ab" * 60, "x" * 39, "y" * 41, "z" * 40]
    for _ in range(60):
        t = [word() for _ in range(rng.randint(1, 40))]
        for _ in range(rng.randint(0, 3)):
            t.insert(rng.randrange(len(t) + 1), rng.choice(passage))
        out.append(" ".join(t))
    out += [out[10], out[10], out[11] + "!", "?" + out[12], out[13][:30] + "#" + out[13][30:], passage[4] * 2]
    return out


@pytest.mark.parametrize("seed,hot,few", [(1, 1000, 4096), (3, 3, 2), (4, 0, 1), (5, 0, 4096), (6, 1000, 1)])
def test_remove_repeats(spark, seed, hot, few):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, x long")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df, length=40, gram=12, hot=hot, few=few).collect()}
    want = brute(texts, 40)
    assert sum(w[1] > 0 for w in want) > 20
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i])


def test_repeated_and_missing_ids_and_real_length(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b, c = text(300), text(66), text(67)
    texts = [a, a[:900] + text(100), text(50) + b + text(50), text(40) + b, text(9) + c + text(9), c, text(500), text(70), text(70)]
    ids = [0, 1, 2, 3, 4, 5, 6, None, None]
    texts[8] = texts[7]
    df = spark.createDataFrame([*zip(ids, texts, strict=True), (6, texts[6])], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect())
    assert got == sorted((str(i), *w[1:]) for i, w in zip([*ids, 6], brute([*texts, texts[6]], 400), strict=True))
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_hot_grams_across_chunks(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    texts = []
    for k in range(40):
        passage = text(40)
        at = 200 + k % 4  # the only repeated window starts here, just behind a chunk's border
        texts += [text(at) + passage + text(300), text(77) + passage + text(60)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df, length=40, gram=12, hot=0, chunk=200).collect()}
    assert got == dict(enumerate(brute(texts, 40)))
