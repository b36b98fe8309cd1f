"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted lists, distance-weighted votes.

A bounded sample of labelled rows gives the vocabulary (words, word beginnings and how dense these are, where they tell
the labels apart), its IDF and the examples. Every text is then scored by its nearest examples; whole blocks of examples are skipped where
the sum of their list maxima can't reach the k-th best cosine, which leaves the result exact.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tapeloom.llm.common import drop_table, texts, write_table

SAMPLE, NEIGHBOURS, BLOCK = 20_000, 15, 64
ERROR, RATIO, STEMS, CACHED, CALIBRATED = 1e-4, 4.0, (4, 5, 6), 400_000, 4096
DENSE, MARKED = (4, 8, 16, 32), 2.0  # words of a beginning in 1000; how much more a mark must tell than its beginning
# letters of ASCII are lower-cased, its other signs but digits separate words; bytes of other scripts are kept
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word and its beginnings, marked by an asterisk, so that inflected and clipped forms count together."""
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) >= n)]


def text_terms(text: bytes) -> set[bytes]:
    """The terms of a text: its words, their beginnings, and for each beginning the marks of density that it reaches.

    A cosine of few terms forgets how often they come: the marks keep apart a text that has a beginning once by chance
    and one that is full of it.
    """
    count = Counter(words_of(text))
    starts: Counter = Counter()
    for word, n in count.items():
        for t in terms_of(word)[1:]:
            starts[t] += n
    total = sum(count.values())
    return {*count, *starts, *(t + b"@%d" % d for t, n in starts.items() for d in DENSE if 1000 * n >= d * total)}


def quantile(p: float) -> float:
    """The chi-square (one degree of freedom) that chance exceeds with probability ``p``."""
    low, high = 0.0, 2000.0
    for _ in range(60):
        x = (low + high) / 2
        low, high = (x, high) if math.erfc(math.sqrt(x / 2)) > p else (low, x)
    return high


def select_terms(counts: DataFrame, toxic: int, clean: int) -> list:
    """The terms that tell the labels apart: all that pass two tests, whatever the labels' share and the sample's size.

    A term's rates among the two labels differ by the factor ``RATIO`` or more (words that nearly every text has would
    make lists long and neighbours meaningless), and chance would bring its chi-square with a probability of ``ERROR``
    over all terms together. A mark of density stays only if its rates are ``MARKED`` times further apart than those of
    its beginning.
    """
    n, share = toxic + clean, toxic / (toxic + clean)
    df = F.col("t") + F.col("c")
    gap = F.col("t") - df * share
    chi2 = gap * gap / (df * share * (1 - share)) * n / (n - df + 1)
    rates = (F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1))
    seen = Observation()
    near = counts.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("chi2", chi2)
    near = near.filter((F.col("chi2") >= quantile(ERROR)) & ((rates >= RATIO) | (rates <= 1 / RATIO))).collect()
    least = quantile(ERROR / max(1, seen.get["n"]))
    chosen = {bytes(r["term"]): r for r in near if r["chi2"] >= least}

    def lift(t: bytes) -> float:
        """How far the rates are apart; 0 for terms that aren't chosen."""
        r = chosen.get(t)
        return abs(math.log((r["t"] + 0.5) / (toxic + 1) / ((r["c"] + 0.5) / (clean + 1)))) if r else 0.0

    def more(t: bytes) -> bool:
        """Whether a mark of density says more than its beginning does."""
        start, at, _ = t.rpartition(b"@")
        return not at or lift(t) >= lift(start) + math.log(MARKED)

    return sorted((r for t, r in chosen.items() if more(t)), key=lambda r: (-r["chi2"], bytes(r["term"])))


class Index:
    """Block-max inverted lists over the examples' vectors."""

    def __init__(self, vectors: list[dict[int, float]], labels: list[int], ids: list[int], n_terms: int):
        order = sorted(range(len(vectors)), key=lambda i: (max(vectors[i], key=lambda t: (vectors[i][t], t)), ids[i]))  # like with like
        self.labels = np.array([labels[i] for i in order], np.float64)
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.blocks = max(1, -(-len(order) // BLOCK))
        sizes = [len(vectors[i]) for i in order]
        self.row = np.repeat(np.arange(len(order)), sizes)  # the lists' entries, block after block
        self.term = np.fromiter((t for i in order for t in vectors[i]), np.int64, sum(sizes))
        self.weight = np.fromiter((w for i in order for w in vectors[i].values()), np.float64, sum(sizes))
        self.top = np.zeros((n_terms, self.blocks))
        np.maximum.at(self.top, (self.term, self.row // BLOCK), self.weight)
        self.start = np.searchsorted(self.row, np.arange(self.blocks + 1) * BLOCK)

    def nearest(self, q: dict[int, float], k: int, skip: int | None = None) -> list[tuple[float, int]]:
        """(cosine, row) of the k nearest examples with a positive cosine, ties by id; ``skip`` leaves an id out.

        Blocks come by the most that their list maxima allow, a growing number at once, until the next can't hold one
        of the k nearest.
        """
        terms, weights = list(q), np.array(list(q.values()))
        dense = np.zeros(len(self.top))
        dense[terms] = weights
        bound = weights @ self.top[terms]
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[float, int, int]] = []
        at, size = 0, 4
        while at < self.blocks:
            floor = best[-1][0] - 1e-9 if len(best) == k else 0.0
            chosen = order[at : at + size]
            chosen = chosen[(bound[chosen] > 0) & (bound[chosen] >= floor)]
            if not len(chosen):
                break
            entries = np.concatenate([np.arange(self.start[b], self.start[b + 1]) for b in chosen.tolist()])
            score = np.bincount(self.row[entries], dense[self.term[entries]] * self.weight[entries], len(self.ids))
            rows = np.flatnonzero((score > 0) & (score >= floor))
            if skip is not None:
                rows = rows[self.ids[rows] != skip]
            if len(rows) > k:
                rows = rows[score[rows] >= np.partition(score[rows], len(rows) - k)[len(rows) - k] - 1e-8]
            best = sorted(best + [(round(float(score[r]), 9), -int(self.ids[r]), r) for r in rows.tolist()], reverse=True)[:k]
            at, size = at + size, size * 4
        return [(s, row) for s, _, row in best]

    def vote(self, near: list[tuple[float, int]], prior: float) -> float:
        """Votes weigh by the inverse distance; the prior counts like one far neighbour."""
        weight = [1 / (1.05 - s) for s, _ in near]
        return (prior + sum(w * self.labels[r] for w, (_, r) in zip(weight, near, strict=True))) / (1 + sum(weight))


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration of votes, with smoothed targets and a small ridge; Newton steps."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([x, np.ones(len(x))], axis=1)
    w = np.array([4.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


class Model:
    """What scoring needs; bounded by the sample's rows and terms."""

    def __init__(self, terms: dict[bytes, int], idf: list[float], base: float):
        self.terms, self.idf, self.base = terms, idf, base
        self.index: Index | None = None
        self.slope, self.shift, self.prior = 0.0, 0.0, base

    def vector(self, tf: Counter) -> dict[int, float]:
        raw = {t: (1 + math.log(n)) * self.idf[t] for t, n in sorted(tf.items())}
        size = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / size for t, w in raw.items()}

    def score(self, tf: Counter, skip: int | None = None) -> tuple[float, list]:
        """Probability of label 1 and the evidence [(example id, cosine, label)]."""
        near = self.index.nearest(self.vector(tf), NEIGHBOURS, skip) if self.index is not None and tf else []
        if not near:
            return self.base, []
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.index.vote(near, self.prior) + self.shift))))
        return p, [(int(self.index.ids[r]), s, int(self.index.labels[r])) for s, r in near]


class Counts(dict):
    """Term numbers of each word, and the beginnings of it that have marks of density, remembered up to a bound."""

    def __init__(self, terms: dict[bytes, int]):
        self.terms = terms
        self.marks: dict[bytes, list[tuple[int, int]]] = {}
        for t, i in terms.items():
            start, at, density = t.rpartition(b"@")
            if at:
                self.marks.setdefault(start, []).append((int(density), i))

    def __missing__(self, word: bytes) -> tuple[tuple[int, ...], tuple[bytes, ...]]:
        if len(self) > CACHED:
            self.clear()
        own = terms_of(word)
        out = self[word] = tuple(n for t in own if (n := self.terms.get(t)) is not None), tuple(t for t in own if t in self.marks)
        return out

    def of(self, text: bytes) -> Counter:
        words, found, starts = words_of(text), Counter(), Counter()
        for w in words:
            numbers, marked = self[w]
            if numbers:
                found.update(numbers)
            if marked:
                starts.update(marked)
        for t, n in starts.items():
            found.update(i for density, i in self.marks[t] if 1000 * n >= density * len(words))
        return found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows whose crc32(id as text) mod 5 isn't 0 (the smallest by a hash of the id).

    Rows with a null id or a label that is neither 0 nor 1 don't count; an id with several labels has the largest, one
    with several texts the least of them. With labels of one kind or none at all, the model gives their rate (0.5 without any) to every text.
    """
    lab = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    lab = lab.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).groupBy("id").agg(F.max("y").alias("y"))
    lab = lab.orderBy(F.xxhash64("id"), "id").limit(sample)
    text = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    rows = write_table(text.join(F.broadcast(lab), "id").groupBy("id", "y").agg(F.min("text").alias("text")), "labelled")  # the broadcast side has ``sample`` rows at most
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        drop_table(rows)
        return Model({}, [], toxic / (toxic + clean) if toxic + clean else 0.5)

    def count(batches):
        for batch, raw in texts(batches, "text"):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(raw, batch.column(batch.schema.get_field_index("y")).to_pylist(), strict=True):
                seen[y].update(text_terms(t))
            every = list(seen[0].keys() | seen[1].keys())
            if every:
                yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([seen[1][x] for x in every], pa.int64()), pa.array([seen[0][x] for x in every], pa.int64())], names=["term", "t", "c"])

    counts = rows.mapInArrow(count, "term binary, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    chosen = select_terms(counts, toxic, clean)
    known = {bytes(r["term"]): i for i, r in enumerate(chosen)}
    model = Model(known, [math.log((1 + toxic + clean) / (1 + r["t"] + r["c"])) + 1 for r in chosen], toxic / (toxic + clean))

    def vectors(batches):
        of = Counts(known)
        for batch, raw in texts(batches, "text"):
            tf = [of.of(t) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.schema.get_field_index("y")), pa.array([list(x) for x in tf], pa.list_(pa.int32())), pa.array([list(x.values()) for x in tf], pa.list_(pa.int32()))], names=["id", "y", "t", "n"])

    examples = rows.mapInArrow(vectors, "id long, y int, t array<int>, n array<int>").orderBy("id").collect()
    drop_table(rows)
    bare = [r["y"] for r in examples if not r["t"]]
    model.base = (sum(bare) + model.base) / (len(bare) + 1)
    full = [(r["id"], r["y"], Counter(dict(zip(r["t"], r["n"], strict=True)))) for r in examples if r["t"]]
    if full:
        model.index = Index([model.vector(tf) for _, _, tf in full], [y for _, y, _ in full], [i for i, _, _ in full], len(known))
        some = full[:: -(-len(full) // CALIBRATED)]  # each is scored without itself
        left_out = [(model.index.nearest(model.vector(tf), NEIGHBOURS, i), y) for i, y, tf in some]
        votes = [(model.index.vote(near, model.prior), y) for near, y in left_out if near]
        if votes:
            model.slope, model.shift = _platt(np.array([v for v, _ in votes]), np.array([y for _, y in votes], float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, held_out, score, predicted, evidence), or with ``keep`` all columns of ``docs`` and ``_score`` and ``_predicted``.

    Map-only. Null and empty texts, and texts without any term, have the score of the sample's texts without terms.
    Equal texts have equal scores. A null id is not held out. An empty table gives an empty one.
    """
    docs = docs.drop("_score", "_predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    add = [pa.field("score", pa.float64()), pa.field("predicted", pa.int32()), pa.field("evidence", pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])))]
    src = docs.withColumn(text_col, docs[text_col].cast("string")) if keep else docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col))
    shape = src.select("*", F.lit(0.0).alias("_score"), F.lit(0).alias("_predicted")) if keep else src.drop(text_col).select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.expr("cast(array() as array<struct<id:bigint,cosine:double,label:int>>)").alias("evidence"))

    def run(batches):
        of, known = Counts(sent.value.terms), {}
        for batch, raw in texts(batches, text_col):
            out = []
            for t in raw:
                tf = of.of(t)
                key = tuple(sorted(tf.items()))
                if key not in known:
                    if len(known) > CACHED // 10:
                        known.clear()
                    known[key] = sent.value.score(tf)
                out.append(known[key])
            cols = [pa.array([p for p, _ in out], pa.float64()), pa.array([int(p >= 0.5) for p, _ in out], pa.int32())]
            if keep:
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "_score", "_predicted"])
            else:
                evidence = pa.array([[{"id": i, "cosine": s, "label": y} for i, s, y in e] for _, e in out], add[2].type)
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols, evidence], names=[id_col, "score", "predicted", "evidence"])

    out = src.mapInArrow(run, shape.schema)
    if keep:
        return out
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select(id_col, held.alias("held_out"), "score", "predicted", "evidence")
