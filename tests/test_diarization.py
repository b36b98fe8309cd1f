"""Words of entries against speaker turns: gluing, splitting, absorbing, and a brute-force model of the whole."""

import random

import pytest

from tapeloom.operators import compositions as co
from tapeloom.operators import sequences as sq

TURNS = "task_id long, seg_pos long, speaker string, start double, end double"
WORDS = "task_id long, pos long, word_pos long, word string, start double, end double"
ENTRIES = "task_id long, pos long, speaker string, start double, end double, text string"


def split(spark, entries, words, turns, least=(2, 0.8)):
    e = spark.createDataFrame([(1, i, None, float(a), float(z), t) for i, (a, z, t) in enumerate(entries)], ENTRIES)
    w = spark.createDataFrame([(1, p, i, t, a, z) for p, own in enumerate(words) for i, (t, a, z) in enumerate(own)], WORDS)
    t = spark.createDataFrame([(1, i, s, float(a), float(z)) for i, (s, a, z) in enumerate(turns)], TURNS)
    rows = co.split_entries(e, w, t, *least).orderBy("pos", "part").collect()
    return [(r.pos, r.part, r.speaker, r.start, r.end, r.text) for r in rows]


def glue(spark, tokens):
    df = spark.createDataFrame([(1, 0, i, t, float(a), float(z)) for i, (t, a, z) in enumerate(tokens)], WORDS)
    return [(r.word, r.start, r.end) for r in sq.glue_subwords(df, ["task_id", "pos"]).orderBy("word_no").collect()]


def test_subwords(spark):
    assert glue(spark, [(" wh", 0, 1), ("ich", 1, 2), (" one", 2, 3), ("?", 3, 4)]) == [("which", 0.0, 2.0), ("one?", 2.0, 4.0)]
    assert glue(spark, [("no", 0, 1), ("marks ", 1, 2), ("", 2, 3), ("here", 3, 4)]) == [("no", 0.0, 1.0), ("marks", 1.0, 2.0), ("here", 3.0, 4.0)]
    assert glue(spark, [("un", 0, 1), (" ", 1, 2), ("done", 2, 3), (None, 3, 4), (" it", 4, 5)]) == [("undone", 0.0, 3.0), ("it", 4.0, 5.0)]
    assert glue(spark, [(" ", 0, 1), ("", 1, 2)]) == []


def words(text, step=1.0, start=0.0):
    return [(w, start + i * step, start + i * step + step) for i, w in enumerate(text.split())]


def test_a_word_in_silence_goes_to_the_nearest_turn(spark):
    turns = [("A", 10, 13), ("B", 20.2, 30)]
    own = [("one", 0.0, 1.0), ("two", 1.0, 2.5), ("well", 9.5, 10.0), ("three", 10.5, 12.0), ("four", 12.0, 14.0)]
    assert split(spark, [(10, 30, "x")], [own], turns) == [(0, 0, "A", 10.0, 12.5, "one two"), (0, 1, "B", 19.5, 24.0, "well three four")]


def test_changes_of_speaker(spark):
    two = [("A", 0, 5), ("B", 5, 10)]
    assert split(spark, [(0, 3, "we are one")], [words("we are one")], two) == [(0, 0, "A", 0.0, 3.0, "we are one")]
    changed = words("yes sure", 2.0) + words("what about you", 1.0, 5.0)
    assert split(spark, [(0, 9, "t")], [changed], two) == [(0, 0, "A", 0.0, 4.0, "yes sure"), (0, 1, "B", 5.0, 8.0, "what about you")]
    moved = [("A", 100, 105), ("B", 105, 110)]  # words keep their entry's clock, turns the recording's
    assert [r[2:] for r in split(spark, [(100, 109, "t")], [changed], moved)] == [("A", 100.0, 104.0, "yes sure"), ("B", 105.0, 108.0, "what about you")]
    short = [("A", 0, 2), ("B", 2, 2.3), ("A", 2.3, 5)]
    said = [("I", 0.0, 1.0), ("think", 1.0, 2.0), ("aha", 2.0, 2.3), ("that", 2.3, 3.0), ("way", 3.0, 5.0)]
    assert split(spark, [(0, 5, "whole")], [said], short) == [(0, 0, "A", 0.0, 5.0, "whole")]
    lead = [("B", 0, 0.3), ("A", 0.3, 5)]
    said = [("aha", 0.0, 0.3), ("I", 0.3, 1.5), ("do", 1.5, 5.0)]
    assert split(spark, [(0, 5, "whole")], [said], lead) == [(0, 0, "A", 0.0, 5.0, "whole")]
    assert split(spark, [(0, 4, "a"), (6, 9, "b")], [], two) == [(0, 0, "A", 0.0, 4.0, "a"), (1, 0, "B", 6.0, 9.0, "b")]
    assert split(spark, [(0, 4, "a")], [], []) == [(0, 0, None, 0.0, 4.0, "a")]
    assert split(spark, [(0, 4, "a")], [[("x", 0.0, None), ("y", 5.0, 9.0)]], two) == [(0, 0, "A", 0.0, 4.0, "a")]


def brute(entries, tokens, turns, least_words, least_seconds):
    def at(a, z):
        if z <= a:
            return next((s for s, x, y in turns if x <= a <= y), None)
        best = max(((min(z, y) - max(a, x), -i) for i, (_, x, y) in enumerate(turns)), default=(0, 0))
        return turns[-best[1]][0] if best[0] > 0 else None

    def near(a, z):
        if (s := at(a, z)) is not None or not turns:
            return s
        m = (a + z) / 2
        return min((0.0 if x <= m <= y else min(abs(m - x), abs(m - y)), i) for i, (_, x, y) in enumerate(turns))[1]

    out = []
    for pos, (a, z, text) in enumerate(entries):
        own, marked = [], any(w.startswith(" ") for w, _, _ in tokens[pos])
        for w, x, y in tokens[pos]:
            if w.strip():
                if own and marked and not w.startswith(" "):
                    own[-1] = (own[-1][0] + w.strip(), own[-1][1], y)
                else:
                    own.append((w.strip(), x, y))
        runs = []
        for w, x, y in ((w, x + a, y + a) for w, x, y in own):
            if y > a and x < z:
                s = near(x, y)
                s = turns[s][0] if isinstance(s, int) else s
                if runs and runs[-1][0] == s:
                    runs[-1][1].append((w, x, y))
                else:
                    runs.append((s, [(w, x, y)]))
        kept, lead = [], []
        for s, ws in runs:
            if len(ws) >= least_words and ws[-1][2] - ws[0][1] >= least_seconds:
                kept.append([s, lead + ws])
                lead = []
            elif kept:
                kept[-1][1] += ws
            else:
                lead += ws
        merged = []
        for s, ws in kept:
            if merged and merged[-1][0] == s:
                merged[-1][1] += ws
            else:
                merged.append([s, list(ws)])
        if len(merged) <= 1:
            out.append((pos, 0, merged[0][0] if merged else at(a, z), a, z, text))
        else:
            out += [(pos, k, s, ws[0][1], ws[-1][2], " ".join(w for w, _, _ in ws)) for k, (s, ws) in enumerate(merged)]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    turns, t = [], 0.0
    for _ in range(40):
        t += rng.choice([0.0, 0.5, 6.0])
        turns.append((rng.choice("ABC"), t, t + rng.choice([1.0, 4.0, 9.0])))
        t = turns[-1][2]
    entries = [(i * 30.0, i * 30.0 + 30, f"e{i}") for i in range(8)]
    tokens = [[(rng.choice(["", " "]) + rng.choice(["", "w", "word"]) if i % 2 else f"t{j}", j * 0.75, j * 0.75 + 0.5) for j in range(44)] for i in range(8)]
    assert split(spark, entries, tokens, turns) == brute(entries, tokens, turns, 2, 0.8)


def test_entries_are_numbered_anew(spark):
    turns = [("AB"[i % 2], i * 4.0, i * 4.0 + 4) for i in range(1200)]
    many = [(f"w{i}", i * 2.0, i * 2.0 + 2) for i in range(2400)]
    e = spark.createDataFrame([(1, 0, None, 0.0, 4800.0, "long"), (1, 1, None, 4800.0, 4804.0, "next")], ENTRIES)
    w = spark.createDataFrame([(1, 0, i, t, a, z) for i, (t, a, z) in enumerate(many)], WORDS)
    t = spark.createDataFrame([(1, i, s, a, z) for i, (s, a, z) in enumerate(turns)], TURNS)
    names = spark.createDataFrame([], "task_id long, speaker string, name string")
    out = co.diarized(e, w, t, names, 2, 0.8, 0.0)[0].orderBy("pos").collect()
    assert [r.pos for r in out] == list(range(1201)) and out[-1].text == "next" and out[1199].start < out[1200].start
