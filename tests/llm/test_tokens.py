"""BPE against the tokenizers library; packing against its contract."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tapeloom.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [*" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　​", *"abcsSLlv12½²߀é中😀.,!-_'", "  ", " ", " ", "<|endoftext|>", "'ll", " don't", " the"]


def strange(n, seed=2):
    rng = random.Random(seed)
    return ["", " ", "  ", " \n a", "<|endoftext|>", "a" * 5000, "ab " * 500, "é" * 300, *("".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n))]


def test_encoder_equals_the_library():
    tables, library = bpe.load(PATH), Tokenizer.from_file(PATH)
    words = [" the", " of", " a", " é", " don't", " the\n"]
    lexicon = bpe.compile_words([w.encode() for w in words], [bpe.encode_chunk(w, tables) for w in words])
    texts = strange(3000)
    for t, ids in zip(texts, bpe.Encoder(tables, lexicon).encode([t.encode() for t in texts]), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert bpe.decode(ids, tables["token"]) == library.decode(want, skip_special_tokens=False)


def test_automaton_is_minimal_and_exact():
    rng = random.Random(4)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))) for _ in range(200)})
    lexicon = bpe.compile_words(words, [b"%04d" % i for i in range(len(words))])
    strangers = [b"", b"d", b"abcabca", *(w + b"d" for w in words)]
    assert bpe.numbers(lexicon, words + strangers).tolist() == [*range(len(words)), *[-1] * len(strangers)]
    suffixes = {tuple(sorted(w[len(p) :] for w in words if w.startswith(p))) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    used = {0, *lexicon["target"].tolist()}
    assert len(used) == len(suffixes)  # one state for each distinct set of continuations
    assert bpe.numbers(bpe.compile_words([], []), [b"x"]).tolist() == [-1]


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, ids long, length long")


def test_documents(spark):
    texts = [None, *strange(200)]
    library = Tokenizer.from_file(PATH)
    rows = {r.doc_id: r for r in bpe.encode_documents(table(spark, texts), PATH, words=50).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == library.encode(t or "", add_special_tokens=False).ids and rows[i].decoded == (t or "")
    assert bpe.encode_documents(table(spark, []), PATH).count() == 0


@pytest.mark.parametrize("length", [2048, 16])
def test_packing(spark, length):
    texts = [None, *strange(150), *["same text"] * 40]
    library = Tokenizer.from_file(PATH)
    rows = packing.pack(table(spark, texts), PATH, length=length).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(parts[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    assert packing.pack(table(spark, []), PATH).count() == 0


def test_histogram_is_worst_fit_in_falling_order():
    rng = random.Random(6)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    packs: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        best = min(packs, key=sum, default=None)
        if best is not None and sum(best) + x <= 100:
            best.append(x)
        else:
            packs.append([x])
    got = packing.pack_histogram(Counter(lengths), 100)
    assert Counter(x for p, n in got.items() for x in p * n) == Counter(lengths)
    assert max(map(sum, got)) <= 100 and sum(got.values()) == len(packs)
