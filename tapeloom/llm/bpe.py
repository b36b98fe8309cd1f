"""Byte-level BPE: a minimal acyclic transducer encodes frequent words, exact merges encode the rest; and decoding.

Texts are cut, a slice of many texts at once, where a pre-token must end whatever stands around it: before a space
that follows no white space, and between ASCII letters, digits and signs. Each chunk then encodes alike wherever it
stands, so a slice's distinct chunks are encoded once. The transducer's words are the corpus's most frequent chunks;
along a path its arcs' outputs add up to the word's number, which finds its ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import drop_table, texts, write_table

# Fixed value: the pre-token pattern of the byte-level BPE format.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORDS, CACHED, NONE = 1 << 15, 500_000, 1 << 60
# One pre-token for sure: an optional space, then letters (of ASCII or the two-byte ones below), digits or signs alone.
_ONE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5\xd0\xd1][\x80-\xbf])+|[0-9]+|[!-/:-@\[-`{-~]+)")
_OTHER, _SPACE, _BLANK, _LETTER, _DIGIT, _SIGN, _APOSTROPHE = range(7)


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for i in range(128):
        c = chr(i)
        kinds[i] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SIGN if 32 < i < 127 else _BLANK if c in "\t\n\x0b\x0c\r" else _OTHER
    kinds[ord(" ")], kinds[ord("'")] = _SPACE, _APOSTROPHE
    return kinds


def _ends() -> np.ndarray:
    """Whether a pre-token always ends between two bytes of these kinds; an apostrophe may begin a contraction."""
    plain = (_LETTER, _DIGIT, _SIGN, _APOSTROPHE)
    ends = np.zeros((8, 8), bool)
    for a in plain:
        for b in (_SPACE, _BLANK, *plain):
            same = a == b or {a, b} == {_SIGN, _APOSTROPHE}
            ends[a, b] = not same and not (a == _APOSTROPHE and b == _LETTER)
    return ends.ravel()


_KINDS, _ENDS = _kinds(), _ends()
_LEADS = np.isin(np.arange(256), [0xC3, 0xC4, 0xC5, 0xD0, 0xD1])  # first bytes of two-byte characters that are letters
# The last bytes of the white space of other scripts, in UTF-8.
_WIDE = np.array([0xC285, 0xC2A0, 0x9A80, *range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F, 0xA08E], np.uint16)
_WORKER: dict = {}  # the encoder that this worker process made last, by lexicon, so that its cache outlives a task


def load(path: str) -> dict:
    """Read a tokenizer file on the driver into plain tables, small enough (one vocabulary) to send with the tasks."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the format writes as themselves
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab, added = model["model"]["vocab"], model["added_tokens"]
    token = [b""] * (max([*vocab.values(), *(t["id"] for t in added)]) + 1)
    for text, i in vocab.items():
        token[i] = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode()
    merges = {}
    for n, pair in enumerate(model["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[a] << 32 | vocab[b]] = n << 32 | vocab[a + b]
    for t in added:
        token[t["id"]] = t["content"].encode()
    first = {b: vocab[c] for c, b in byte_of.items()}
    return {"token": token, "merges": merges, "first": [first[b] for b in range(256)], "added": {t["content"]: t["id"] for t in added}}


def merge(ids: list[int], merges: dict[int, int]) -> list[int]:
    """Apply merges, lowest rank first and leftmost first."""
    if len(ids) > 96:
        return _merge_long(ids, merges)
    get = merges.get
    pairs = [get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
    while pairs and (best := min(pairs)) != NONE:
        i = pairs.index(best)
        ids[i : i + 2] = [best & 0xFFFFFFFF]
        del pairs[i]
        if i:
            pairs[i - 1] = get(ids[i - 1] << 32 | ids[i], NONE)
        if i < len(pairs):
            pairs[i] = get(ids[i] << 32 | ids[i + 1], NONE)
    return ids


def _merge_long(ids: list[int], merges: dict[int, int]) -> list[int]:
    """The same with a heap and a linked list, for pre-tokens of any length."""
    n = len(ids)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(m >> 32, i, m & 0xFFFFFFFF, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := merges.get(a << 32 | b)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, new, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = new, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (m := merges.get(ids[x] << 32 | ids[y])) is not None:
                heapq.heappush(heap, (m >> 32, x, m & 0xFFFFFFFF, ids[x], ids[y]))
    return [x for x in ids if x >= 0]


def merge_many(words: list[bytes], first: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge many short words at once: each round applies in every word its leftmost pair of lowest rank.

    ``keys`` are the pairs in order, ``values`` their rank and merged id. Only pairs beside a merge are looked up
    again. Gives all ids, word by word, and how many each word has.
    """
    size = np.array([len(w) for w in words], np.int64)
    ids = first[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), size)

    def look(left: np.ndarray) -> np.ndarray:
        """Rank and merged id of the pairs that begin at these places; ``NONE`` at a word's end."""
        right = np.minimum(left + 1, len(ids) - 1)
        key = ids[left] << 32 | ids[right]
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[i] == key) & (word[left] == word[right]) & (left < len(ids) - 1), values[i], NONE)

    done_ids, done_word = [], []
    rank = look(np.arange(len(ids))) if len(ids) else np.zeros(0, np.int64)
    while len(ids):
        start = np.flatnonzero(np.diff(word, prepend=-1))
        best = np.minimum.reduceat(rank, start)
        length = np.diff(np.append(start, len(ids)))
        over = np.repeat(best == NONE, length)
        if over.any():
            done_ids.append(ids[over])
            done_word.append(word[over])
            ids, word, rank = ids[~over], word[~over], rank[~over]
            if not len(ids):
                break
            length, best = length[best != NONE], best[best != NONE]
            start = np.cumsum(length) - length
        hits = np.flatnonzero(rank == np.repeat(best, length))
        at = hits[np.flatnonzero(np.diff(word[hits], prepend=-1))]
        ids[at] = rank[at] & 0xFFFFFFFF
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids, word, rank = ids[keep], word[keep], rank[keep]
        at -= np.arange(len(at))
        rank[at] = look(at)
        before = at[(at > 0) & (word[at - 1] == word[at])] - 1
        rank[before] = look(before)
    ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
    word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
    order = np.argsort(word, kind="stable")
    return ids[order].astype("<u4"), np.bincount(word, minlength=len(words))


def encode_chunk(chunk: str, tables: dict) -> bytes:
    """Ids of one chunk by exact merges, as little-endian unsigned 32-bit integers."""
    out: list[int] = []
    for t in PATTERN.findall(chunk):
        out += merge([tables["first"][b] for b in t.encode()], tables["merges"])
    return np.array(out, "<u4").tobytes()


def compile_words(words: list[bytes], ids: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of the words, its arcs carrying word numbers, as flat arrays."""
    order = sorted(range(len(words)), key=words.__getitem__)
    known: dict = {}
    final, arcs, count = [False], [{}], [0]  # of each state; a state is frozen once no later word can pass it
    path = [0]

    def freeze(depth: int, last: bytes) -> None:
        for d in range(len(path) - 1, depth, -1):
            s = path.pop()
            key = (final[s], tuple(arcs[s].items()))
            same = known.setdefault(key, s)
            arcs[path[-1]][last[d - 1]] = same
            if same == s:
                count[s] = final[s] + sum(count[t] for t in arcs[s].values())

    last = b""
    for k in order:
        w = words[k]
        shared = len(os.path.commonprefix([last, w]))
        freeze(shared, last)
        for _ in range(len(path) - 1, len(w)):
            final.append(False)
            arcs.append({})
            count.append(0)
            path.append(len(final) - 1)
        final[path[-1]] = True
        last = w
    freeze(0, last)
    keys, target, out = [], [], []
    for s in {0, *known.values()}:
        n = int(final[s])
        for byte, t in sorted(arcs[s].items()):
            keys.append(s << 8 | byte)
            target.append(t)
            out.append(n)
            n += count[t]
    rank = np.argsort(keys, kind="stable")
    flat = [ids[k] for k in order]
    return {
        "keys": np.array(keys, np.int64)[rank],
        "target": np.array(target, np.int32)[rank],
        "out": np.array(out, np.int32)[rank],
        "final": np.array(final, np.uint8),
        "start": np.cumsum([0, *map(len, flat)]).astype(np.int64),
        "ids": np.frombuffer(b"".join(flat), np.uint8),
    }


def numbers(lexicon: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The number of each word, -1 for a word that isn't in the lexicon; all words take a step at once."""
    size = np.array([len(w) for w in words], np.int64)
    flat, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
    state, number, keys = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), lexicon["keys"]
    live, j = np.arange(len(words)), 0
    out = np.full(len(words), -1, np.int64)
    while len(live):
        ended = live[size[live] == j]
        good = ended[lexicon["final"][state[ended]] > 0]
        out[good] = number[good]
        live = live[size[live] > j]
        if not len(live) or not len(keys):
            break
        key = state[live] << 8 | flat[at[live] + j]
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        found = keys[i] == key
        live, i = live[found], i[found]
        state[live] = lexicon["target"][i]
        number[live] += lexicon["out"][i]
        j += 1
    return out


def _save(lexicon: dict[str, np.ndarray], path: str) -> None:
    with open(path, "wb") as f:
        head, at = {}, 4096
        for k, v in lexicon.items():
            head[k] = (at, len(v), v.dtype.str)
            at += -(-v.nbytes // 64) * 64
        f.write(json.dumps(head).encode().ljust(4096))
        for v in lexicon.values():
            f.write(v.tobytes().ljust(-(-v.nbytes // 64) * 64, b"\0"))


def memory_map(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        head = json.loads(f.read(4096))
    return {k: np.memmap(path, dtype, "r", at, (n,)) if n else np.zeros(0, dtype) for k, (at, n, dtype) in head.items()}


def cuts(data: np.ndarray) -> np.ndarray:
    """Where a pre-token must end, as places after the first byte: see ``_ends``; before a space also after other scripts."""
    kinds = _KINDS[data]
    lead = np.flatnonzero(_LEADS[data[:-1]])
    lead = lead[(data[lead] != 0xC3) | (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of multiplication and division
    kinds[lead] = kinds[lead + 1] = _LETTER
    ends = _ENDS[kinds[:-1] << 3 | kinds[1:]]
    wide = np.flatnonzero((data[:-1] >= 128) & (kinds[:-1] == _OTHER) & (kinds[1:] == _SPACE))
    last = data[wide].astype(np.uint16) | data[wide - 1].astype(np.uint16) << 8  # never at 0: a character of 128 or more has two bytes
    ends[wide] = ~np.isin(last, _WIDE)
    return np.flatnonzero(ends) + 1


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs [start, start + size) of ``flat``, one after the other."""
    return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def split(raw: list[bytes], marks: re.Pattern | None = None) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Cut texts, laid end to end, into chunks: where each begins, and the chunks. ``marks`` are chunks of their own."""
    data, ends = b"".join(raw), np.cumsum([0, *map(len, raw)])
    own = [(base + m.start(), base + m.end()) for base, t in zip(ends.tolist(), raw, strict=False) for m in marks.finditer(t)] if marks else []
    first = np.zeros(len(data) + 1, bool)
    first[cuts(np.frombuffer(data, np.uint8))] = True
    for a, b in own:
        first[a:b] = False
    first[ends] = first[np.array(own, np.int64).ravel()] = True
    starts = np.flatnonzero(first[:-1])
    offsets = np.append(starts, len(data)).astype(np.int32)
    return starts, pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()


class Encoder:
    """Encodes texts in one worker: a bounded cache in front of the memory-mapped lexicon and the exact merges."""

    def __init__(self, tables: dict, lexicon: dict[str, np.ndarray]):
        self.tables, self.lexicon = tables, lexicon
        keys = np.array(list(tables["merges"]), np.int64)
        order = np.argsort(keys)
        self.arrays = np.array(tables["first"], np.int64), keys[order], np.array(list(tables["merges"].values()), np.int64)[order]
        special = {c.encode(): i for c, i in tables["added"].items()}
        self.marks = re.compile(b"|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        # the cache: chunks, special tokens first, and the runs of ``flat`` that are their ids
        self.known, self.flat, self.start = pa.array(list(special), pa.binary()), np.array(list(special.values()), "<u4"), np.arange(len(special) + 1)

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens by exact merges, and their numbers; long ones by a heap, one at a time."""
        sizes = np.array([len(w) for w in words], np.int64)
        short, long = np.flatnonzero(sizes <= 96), np.flatnonzero(sizes > 96)
        flat, count = merge_many([words[i] for i in short.tolist()], *self.arrays)
        if not len(long):
            return flat, count
        by_heap = [np.array(merge([self.tables["first"][b] for b in words[i]], self.tables["merges"]), "<u4") for i in long.tolist()]
        flat, count = np.concatenate([flat, *by_heap]), np.concatenate([count, [len(x) for x in by_heap]])
        back = np.argsort(np.concatenate([short, long]))
        return gather(flat, (np.cumsum(count) - count)[back], count[back]), count[back]

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks and their numbers: by the lexicon, by merges, or by the merges of their pre-tokens."""
        number = numbers(self.lexicon, words)
        found, rest = np.flatnonzero(number >= 0), np.flatnonzero(number < 0).tolist()
        whole = [_ONE.fullmatch(words[i]) is not None for i in rest]
        one, split = [i for i, w in zip(rest, whole, strict=True) if w], [i for i, w in zip(rest, whole, strict=True) if not w]
        parts = [[t.encode() for t in PATTERN.findall(words[i].decode())] for i in split]
        tokens = list({t for own in parts for t in own})
        at = {t: len(one) + k for k, t in enumerate(tokens)}
        flat, count = self._merged([words[i] for i in one] + tokens)
        start = np.cumsum(count) - count
        of = np.array([at[t] for own in parts for t in own], np.int64)
        many = np.array([len(own) for own in parts], np.int64)
        joined = gather(flat, start[of], count[of])
        size = np.add.reduceat(np.append(count[of], 0), np.cumsum(many) - many) if len(parts) else np.zeros(0, np.int64)
        first = self.lexicon["start"][number[found]] if len(found) else np.zeros(0, np.int64)
        length = self.lexicon["start"][number[found] + 1] - first if len(found) else first
        own = gather(self.lexicon["ids"].view("<u4"), first // 4, length // 4) if len(found) else np.zeros(0, "<u4")
        ones = int(count[: len(one)].sum())
        every, sizes = np.concatenate([own, flat[:ones], joined]), np.concatenate([length // 4, count[: len(one)], size])
        back = np.argsort(np.concatenate([found, np.array(one, np.int64), np.array(split, np.int64)]), kind="stable")
        return gather(every, (np.cumsum(sizes) - sizes)[back], sizes[back]), sizes[back]

    def _find(self, distinct: pa.Array) -> np.ndarray:
        """The cache's numbers of distinct chunks, after learning those that it lacks."""
        at = pc.index_in(distinct, self.known).fill_null(-1).to_numpy(zero_copy_only=False)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at
        if len(self.known) + len(missing) > CACHED:
            keep = np.union1d(np.arange(len(self.tables["added"])), at[at >= 0])
            size = np.diff(self.start)[keep]
            self.known, self.flat, self.start = self.known.take(pa.array(keep)), gather(self.flat, self.start[keep], size), np.concatenate([[0], np.cumsum(size)])
            at = pc.index_in(distinct, self.known).fill_null(-1).to_numpy(zero_copy_only=False)
        new = distinct.take(pa.array(missing))
        flat, size = self._learn(new.to_pylist())
        at = at.copy()
        at[missing] = len(self.known) + np.arange(len(missing))
        self.known = pa.concat_arrays([self.known, new])
        self.flat, self.start = np.concatenate([self.flat, flat]), np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
        return at

    def encode(self, raw: list[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        starts, chunks = split(raw, self.marks)
        number = self._find(chunks.dictionary)[chunks.indices.to_numpy()]
        size = np.diff(self.start)[number]
        total = np.append(0, np.cumsum(size))
        edges = total[np.searchsorted(starts, np.cumsum([0, *map(len, raw)]))].tolist()
        ids = memoryview(gather(self.flat, self.start[number], size).tobytes())
        for a, b in zip(edges, edges[1:], strict=False):
            yield bytes(ids[4 * a : 4 * b])


def decode(ids: bytes, token: list[bytes]) -> str:
    """The text of ids; bytes that aren't UTF-8 become replacement characters, special tokens are kept."""
    return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def frequent_chunks(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> list[bytes]:
    """The most frequent chunks over all texts, ``words`` at most: counts are summed per task, then shuffled.

    Words are taken by whole levels of frequency, so the driver gets a short histogram and the chosen words only.
    """

    def run(batches):
        held, n = [], 0
        for _, raw in texts(batches, "_text"):
            chunks = split(raw)[1]
            held.append(pa.table({"w": chunks.dictionary, "n": np.bincount(chunks.indices.to_numpy(), minlength=len(chunks.dictionary))}))
            n += held[-1].num_rows
            if n > CACHED:
                held, n = [total(held)], 0
                if held[0].num_rows > CACHED:
                    yield from held.pop().to_batches()
        if held:
            yield from total(held).to_batches()

    def total(held):
        return pa.concat_tables(held).group_by("w").aggregate([("n", "sum")]).rename_columns(["w", "n"])

    counts = docs.select(docs[text_col].cast("string").alias("_text")).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counts = write_table(counts.filter("n > 1").withColumn("level", F.floor(F.log2("n") * 16)), "chunks")
    least, taken = None, 0
    for r in counts.groupBy("level").agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect():  # 16 levels per power of two
        if taken + r.k > words:
            break
        least, taken = r.level, taken + r.k
    found = [bytes(r.w) for r in counts.filter(F.col("level") >= least).select("w").collect()] if taken else []
    drop_table(counts)
    return sorted(found)


def encoder_for(docs: DataFrame, tokenizer: str, text_col: str = "text", words: int = WORDS):
    """Compile the lexicon of ``docs`` (bounded by ``words``; 0: an empty one, no count) and return a function that gives a worker its encoder.

    The lexicon file goes to the executors by ``addFile``, which hands it to replacements of lost ones too; each
    worker memory-maps its executor's copy.
    """
    spark = docs.sparkSession
    tables = load(tokenizer)
    chunks = frequent_chunks(docs, text_col, words) if words else []
    lexicon = compile_words(chunks, [encode_chunk(c.decode(), tables) for c in chunks])
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), name)
    _save(lexicon, path)
    spark.sparkContext.addFile(path)
    sent = spark.sparkContext.broadcast(tables)

    def make() -> Encoder:
        if name not in _WORKER:
            _WORKER.clear()
            _WORKER[name] = Encoder(sent.value, memory_map(SparkFiles.get(name)))
        return _WORKER[name]

    return make


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, words: int = WORDS) -> DataFrame:
    """Encode each text and decode it again: (id, ids array<int>, decoded string), or their counts and SHA-256 digests.

    Equal to encoding with add_special_tokens=False and decoding with skip_special_tokens=False: a special token's
    text becomes its id. Null and empty texts have no ids and decode to an empty string. Rows are independent, so
    repeated rows repeat; other columns are not read; an empty table gives an empty one.
    """
    make = encoder_for(docs, tokenizer, text_col, words)
    schema = f"{id_col} long, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches):
        encoder = make()
        token = encoder.tables["token"]
        for batch, raw in texts(batches, "_text"):
            rows = []
            for ids in encoder.encode(raw):
                text = decode(ids, token)
                if digests:
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                else:
                    rows.append((np.frombuffer(ids, "<i4"), text))
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] if digests else [id_col, "ids", "decoded"]
            types = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("_text")).mapInArrow(run, schema)
