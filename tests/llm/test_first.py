"""Media, SimHash and line dedup against brute force on small fixtures."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from tapeloom.llm import linededup, media, simhash
from tapeloom.llm.graph import connected_components

SCHEMA = "doc_id long, text string, lang string, fp string, n_lines long, node long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", 1, 2) for i, t in enumerate(texts)], SCHEMA)


def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 200))) for _ in range(40)]
    out = [None, "", " \n ", "one", "two words", "ÄÖ É ſ", "a" * 70_000, *base, *base[:5] * 4]
    for t in base[:20]:
        w = t.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = "edit"
            out.append(" ".join(w))
    return out


def test_media_round_trip():
    for n in (0, 1, 63, 64, 65, 1024, 8191, 8192, 131_072, 300_001):
        text = os.urandom(n)
        data = media.mux(media.payload_of(text))
        got = media.parse(data)
        assert b"".join(data[a : a + s] for _, _, a, s, _, _ in got["packets"]) == media.payload_of(text)
        assert [c for _, _, c in got["cues"]] == got["clusters"] and got["doctype"] == "matroska"


def test_media_reads_all_lacings_groups_and_unknown_sizes():
    xiph = b"\x81\x00\x05\x02\x02" + bytes([255, 45, 3]) + b"x" * 300 + b"yyy" + b"zz"
    ebml = b"\x81\x00\x00\x06\x02" + b"\x44\x00" + b"\xba" + b"a" * 1024 + b"b" * 1019 + b"c" * 7
    body = media._uint(media.STAMP, 7) + media._element(media.GROUP, media._element(media.BLOCK, xiph)) + media._element(media.SIMPLE, ebml)
    data = media._id(media.SEGMENT) + b"\x01" + b"\xff" * 7 + media._id(media.CLUSTER) + b"\x01" + b"\xff" * 7 + body + media._element(media.CUES, b"")
    got = media.parse(data)
    assert [(p[1], p[3], p[4]) for p in got["packets"]] == [(12, 300, 1), (12, 3, 1), (12, 2, 1), (7, 1024, 3), (7, 1019, 3), (7, 7, 3)]
    with pytest.raises(ValueError):
        media.parse(data[:5] + b"\x00" * 9)


def test_media_query(spark):
    texts = corpus()
    rows = {r.doc_id: r for r in media.store_and_read(table(spark, texts), with_media=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pay = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
    bad = spark.createDataFrame([(1, bytes(rows[6].media)), (2, b"\x00junk"), (3, None)], "doc_id long, media binary")
    packets = media.packet_table(bad).collect()
    assert sum(p.byte_size for p in packets if p.doc_id == 1) == rows[6].payload_bytes
    assert [p.error is None for p in packets if p.doc_id == 2] == [False] and not [p for p in packets if p.doc_id == 3]
    assert media.store_and_read(table(spark, [])).count() == 0


def brute_fp(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def closure(n, linked):
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[j] for j in range(n) if linked(i, j)] + [comp[i]]) for i in range(n)]
        if new == comp:
            return comp
        comp = new


@pytest.mark.parametrize("most", [4096, 2])
def test_simhash(spark, most):
    texts = corpus()
    want = [brute_fp(t) for t in texts]
    comp = closure(len(texts), lambda i, j: (want[i] ^ want[j]).bit_count() <= 4)
    got = {r.doc_id: r for r in simhash.near_duplicates(table(spark, texts), most=most).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in want]
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert simhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("n,threshold", [(300, 4), (10**9, 4), (10**10, 4), (300, 11), (300_000, 13), (10**7, 11)])
def test_anchor_covering_finds_every_close_pair(spark, n, threshold):
    blocks = simhash.plan(n, threshold)
    assert sum(b.size for b in blocks) == 64 and sum(b.threshold + 1 for b in blocks) == threshold + 1 and any(b.code for b in blocks)
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(120)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, threshold + 2))) for f in fps]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f, 0) for i, f in enumerate(fps)], "node long, fp long, more long")
    cells = defaultdict(lambda: ([], []))
    for r in simhash._cells(df, blocks).collect():
        cells[r.cell][1].append(r.node)
        if r.home:
            cells[r.cell][0].append(r.node)
    met = {frozenset((a, b)) for h, v in cells.values() for a in h for b in v if a != b}
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                assert frozenset((i, j)) in met


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_one_of_each(spark):
    """Near copies go, their components judged against brute force; texts that share an id are judged by themselves."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:30]):  # one or two words changed: a similarity of 0.9 or more
        near = list(w)
        near[rng.randrange(10, 190)] = "other"
        if i % 2:
            near[100] = "more"
        rows.append((100 + i, " ".join(near)))
    rows += [(3, rows[4][1]), (5, " ".join(base[39][::-1])), (None, rows[6][1]), (None, "alone here"), (7, rows[7][1]), (7, rows[7][1]), (60, None), (61, ""), (None, None)]
    df = spark.createDataFrame([(i, t, k, "c") for k, (i, t) in enumerate(rows)], "doc_id long, text string, component long, kept string")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    fps = [simhash.fingerprint((t or "").encode(), 5) for _, t in rows]
    far = lambda i, j: [(x ^ y).bit_count() for x, y in zip(fps[i], fps[j], strict=True)]
    comp = closure(len(rows), lambda i, j: far(i, j)[0] <= 13 and sum(far(i, j)) <= 24)
    want = {}
    for k, c in enumerate(comp):
        i, t = rows[k]
        here = (i is None, i or 0)
        if c not in want or here < want[c][0]:
            want[c] = (here, {t})
        elif here == want[c][0]:
            want[c][1].add(t)
    assert sum(got.values()) == len(want) and sorted(x[0][1] for x in want.values()) == sorted(i or 0 for i, _ in got)
    assert all(any(t in w[1] for w in want.values()) for _, t in got)
    left = [shingles(t) for _, t in got]
    assert sum(len(a & b) >= 0.9 * len(a | b) for n, a in enumerate(left) for b in left[:n]) <= 2  # of 30 near copies
    assert simhash.one_of_each(df.limit(0)).count() == 0


def brute_lines(texts, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    docs = defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            docs[key(x)].add(i)
    bad = {k for k, d in docs.items() if k and len(d) >= min_docs}
    return [[x for x in (t or "").split("\n") if key(x) not in bad] for t in texts]


@pytest.mark.parametrize("keys", [1 << 16, 4])
def test_line_dedup(spark, keys, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", keys)
    rng = random.Random(1)
    pool = ["Line One", " line one\t", "ÀB", "àb", "", "  ", "x" * 9000, *[f"line {i}" for i in range(30)]]
    texts = [None, "", "\n\n", *["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(80)]]
    df = table(spark, texts)
    got = {r.doc_id: r for r in linededup.drop_repeated_lines(df).collect()}
    for i, want in enumerate(brute_lines(texts, 10)):
        n = len((texts[i] or "").split("\n"))
        assert (got[i].text, got[i].n_lines, got[i].n_dropped, got[i].lang) == ("\n".join(want), n, n - len(want), "en")
    assert linededup.drop_repeated_lines(df.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_rejects_strangers():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, (2, 5000), np.uint64)
    index = linededup.build(a, b, np.arange(5000) * 20)
    assert sorted(linededup.rank(index, a, b)) == list(range(5000))
    assert (linededup.probe([index], a, b) == np.arange(5000) * 20).all()
    c, d = rng.integers(0, 1 << 63, (2, 5000), np.uint64)
    assert not linededup.probe([index], c, d).any()


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 540)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    got = connected_components(spark.createDataFrame(pairs + [(None, 3)], "src long, dst long")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_recall_of_near_copies():
    """Of pairs with an exact similarity of 0.8 or more over five-word shingles at least 0.9 link; unrelated texts never do."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    linked, single = [], []
    for _ in range(400):
        base = [rng.choice(words) for _ in range(rng.randint(60, 600))]
        near = list(base)
        for _ in range(rng.randint(1, max(1, len(base) // 40))):
            near[rng.randrange(len(near))] = rng.choice(words)
        a, b = " ".join(base), " ".join(near)
        x, y = shingles(a), shingles(b)
        fps = [simhash.fingerprint(t.encode(), 5) for t in (a, b)]
        far = [(p ^ q).bit_count() for p, q in zip(*fps, strict=True)]
        if len(x & y) >= 0.8 * len(x | y):
            linked.append(far[0] <= 13 and sum(far) <= 24)
        single.append(fps[0])
    assert len(linked) > 150 and sum(linked) >= 0.9 * len(linked)
    assert min((p[0] ^ q[0]).bit_count() + (p[1] ^ q[1]).bit_count() for i, p in enumerate(single) for q in single[:i]) > 24
