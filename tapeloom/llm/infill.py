"""Fill-in-the-middle by a piece table.

A document never moves: it is a list of descriptors (buffer, start, length) over two immutable buffers, the text's UTF-8
bytes and the sentinels. Cutting splits a descriptor in two, an arrangement permutes the list and puts sentinel
descriptors between, the inverse permutation restores the text, and hashes read the buffers through the descriptors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import texts

TEXT, MARKS = 0, 1
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
#: The order in which an arrangement writes the parts, and the sentinel before each (None: none).
ORDERS = {
    "psm": ((PREFIX, PREFIX), (SUFFIX, SUFFIX), (MIDDLE, MIDDLE)),
    "spm": ((SUFFIX, SUFFIX), (PREFIX, PREFIX), (MIDDLE, MIDDLE)),
}


@dataclass(frozen=True)
class Sentinels:
    """The marks before prefix, middle and suffix, and their shared buffer."""

    prefix: str = "<P>"
    middle: str = "<M>"
    suffix: str = "<S>"

    def __post_init__(self) -> None:
        marks = self.encoded()
        if not all(marks) or any(a in b for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j):
            raise ValueError("sentinels must be non-empty and none may hold another")
        if any(a[:k] == a[-k:] for a in marks for k in range(1, len(a))):
            raise ValueError("no sentinel may begin as it ends: behind a text it could then be found too early")

    def encoded(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.middle.encode(), self.suffix.encode()

    def buffer(self) -> bytes:
        return b"".join(self.encoded())

    def piece(self, part: int) -> tuple[int, int, int]:
        marks = self.encoded()
        return MARKS, sum(map(len, marks[:part])), len(marks[part])


def offsets(text: bytes, units: Iterable[int]) -> tuple[int, list[int]]:
    """The text's number of code points, and the byte at which each of ``units`` begins (n: the end)."""
    bytes_of = np.frombuffer(text, np.uint8)
    if text.isascii():
        return len(text), list(units)
    starts = np.flatnonzero((bytes_of & 0xC0) != 0x80)
    return len(starts), [int(starts[u]) if u < len(starts) else len(text) for u in units]


def cut(pieces: list[tuple[int, int, int]], at: int) -> list[tuple[int, int, int]]:
    """Split the first descriptor that holds byte ``at`` of the document or ends there; at its border, one half is empty."""
    i, before = 0, 0
    while before + pieces[i][2] < at:
        before += pieces[i][2]
        i += 1
    buffer, start, length = pieces[i]
    left = at - before
    return [*pieces[:i], (buffer, start, left), (buffer, start + left, length - left), *pieces[i + 1 :]]


def arrange(parts: list[tuple[int, int, int]], form: str, marks: Sentinels) -> list[tuple[int, int, int]]:
    """Descriptors of the output: the three parts permuted, each behind its sentinel."""
    pieces = []
    for part, mark in ORDERS[form]:
        pieces += [marks.piece(mark), parts[part]]
    return pieces


def read(pieces: list[tuple[int, int, int]], buffers: tuple[bytes, bytes]) -> Iterable[memoryview]:
    views = memoryview(buffers[0]), memoryview(buffers[1])
    for buffer, start, length in pieces:
        yield views[buffer][start : start + length]


def digest(pieces: list[tuple[int, int, int]], buffers: tuple[bytes, bytes]) -> str:
    """SHA-256 of the document that the descriptors spell, streamed."""
    sha = hashlib.sha256()
    for view in read(pieces, buffers):
        sha.update(view)
    return sha.hexdigest()


def restore(output: bytes, form: str, marks: Sentinels) -> list[tuple[int, int, int]]:
    """Descriptors over ``output`` that spell the text again: its parts are found by their sentinels and put in order."""
    if form == "plain":
        return [(TEXT, 0, len(output))]
    encoded, found, at = marks.encoded(), {}, 0
    for part, mark in ORDERS[form]:
        at = output.find(encoded[mark], at)
        if at < 0:
            raise ValueError(f"no sentinel of part {part} in an output of form {form}")
        found[part] = at, at + len(encoded[mark])
        at += len(encoded[mark])
    ends = [*sorted(a for a, _ in found.values()), len(output)]
    stop = dict(pairwise(ends))
    return [(TEXT, found[part][1], stop[found[part][0]] - found[part][1]) for part in (PREFIX, MIDDLE, SUFFIX)]


def plan(doc_id: int | None, text: bytes, marks: Sentinels, seed: str, plain_share: int, spm_share: int) -> tuple[int, str, list[int], list[int]]:
    """(code points, form, code points of prefix and middle, bytes at which prefix and middle end), drawn from the id alone."""
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(drawn[i : i + 4]) for i in (0, 4, 8, 12))
    n = offsets(text, ())[0]
    if not n or h3 % 100 >= 100 - plain_share or any(m in text for m in marks.encoded()):
        return n, "plain", [], []
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < spm_share else "psm", [low, high - low], offsets(text, (low, high))[1]


COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    marks: Sentinels | None = None,
    seed: str = "1",
    plain_share: int = 10,
    spm_share: int = 20,
    with_text: bool = False,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): every text cut in three and rearranged.

    The cuts and the form come from the SHA-256 of ``seed:id``, so equal ids are cut alike and a lost task draws the
    same again. ``plain_share`` and ``spm_share`` are per cent. A null or empty text, and one that holds a sentinel,
    stays as it is (form plain; the two lengths are null). Texts are cut between code points. A null id draws from
    ``seed:`` alone. Repeated rows give repeated rows, an empty table an empty one; other columns are not read.
    ``with_text`` adds ``output``, the rearranged text. ``restored_sha256`` is that of the text that the output and the
    form alone give back. Map-only: a row at a time, within slices of 8 MB of text.
    """
    marks = marks or Sentinels()

    def each(batches):
        for part, raw in texts(batches, "text"):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), raw, strict=True):
                buffers = text, marks.buffer()
                n, form, chars, ends = plan(doc_id, text, marks, seed, plain_share, spm_share)
                pieces = [(TEXT, 0, len(text))]
                if form != "plain":
                    for at in ends:
                        pieces = cut(pieces, at)
                    pieces = arrange(pieces, form, marks)
                output = b"".join(read(pieces, buffers))
                back = digest(restore(output, form, marks), (output, b""))
                rows.append((doc_id, n, form, *(chars or (None, None)), digest(pieces, buffers), back, *([output.decode()] if with_text else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.large_string()] if with_text else [])]
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output"] if with_text else [])]
    schema = f"`{id_col}` long, {COLUMNS}" + (", output string" if with_text else "")
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(each, schema)


def undo(outputs: DataFrame, output_col: str = "output", form_col: str = "form", marks: Sentinels | None = None) -> DataFrame:
    """Add ``restored``, the text that ``transform`` began with, from its output and form alone; null outputs give null."""
    marks = marks or Sentinels()

    @F.pandas_udf("string")
    def back(output, form):
        def one(text, kind):
            if text is None:
                return None
            raw = text.encode()
            return b"".join(read(restore(raw, kind, marks), (raw, b""))).decode()

        return output.combine(form, one)

    return outputs.withColumn("restored", back(F.col(output_col), F.col(form_col)))
