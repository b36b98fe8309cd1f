"""Extension points: delivery adapters, pipeline stages, and models that run on Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = (1, 0)
STAGES: dict[str, Callable[[DataFrame], DataFrame]] = {}


@dataclass
class Adapter:
    """A sink for deliveries: ``deliver`` writes one micro-batch and raises to have it tried again."""

    name: str
    deliver: Callable[[DataFrame], None]
    version: tuple[int, int] = VERSION
    secrets: list[str] = field(default_factory=list)


class Adapters:
    def __init__(self) -> None:
        self._known: dict[str, Adapter] = {}

    def register(self, adapter: Adapter) -> None:
        """Adapters of another major version are refused, newer minor ones too."""
        if adapter.version[0] != VERSION[0] or adapter.version[1] > VERSION[1]:
            raise ValueError(f"adapter {adapter.name!r} has version {adapter.version}, this library {VERSION}")
        self._known[adapter.name] = adapter

    def deliver(self, claimed: DataFrame) -> DataFrame:
        """Hand claimed deliveries to their adapters; one outcome per delivery: ok, error or no_adapter.

        One write per adapter, of which there are as many as are registered.
        """
        outcome = F.when(~F.col("adapter").isin(list(self._known)), "no_adapter")
        for name, adapter in self._known.items():
            try:
                adapter.deliver(claimed.filter(F.col("adapter") == name))
                outcome = outcome.when(F.col("adapter") == name, "ok")
            except Exception:  # noqa: BLE001  whatever an adapter raises, its deliveries are tried again
                outcome = outcome.when(F.col("adapter") == name, "error")
        return claimed.select("attempt_id", outcome.alias("outcome"))


def stage(name: str):
    """Register a function DataFrame to DataFrame as a pipeline stage."""

    def add(f: Callable[[DataFrame], DataFrame]):
        if name in STAGES:
            raise ValueError(f"stage {name!r} is registered already")
        STAGES[name] = f
        return f

    return add


def run_stages(df: DataFrame, names: list[str]) -> DataFrame:
    for n in names:
        df = STAGES[n](df)
    return df


def model_column(load: Callable[[], Callable[[pd.Series], pd.Series]], returns: str) -> Callable[[Column], Column]:
    """A model as a column function: loaded once per task, called on Arrow batches."""

    @F.pandas_udf(returns)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield model(batch)

    return apply


class ContractError(ValueError):
    """A model's payload isn't what its contract says."""


def _number(value, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise ContractError(f"{what} is no number")
    try:
        out = float(value)
    except ValueError as e:
        raise ContractError(f"{what} is no number") from e
    if out != out or out in (float("inf"), float("-inf")):
        raise ContractError(f"{what} is not finite")
    return out


def _spans(payload: dict, strict: bool) -> list[dict]:
    """Segments of a payload that have a start and an end; one that hasn't is an error if ``strict``, else left out."""
    listed, out = payload.get("segments"), []
    if not isinstance(listed, list):
        if strict and listed is not None:
            raise ContractError("segments is no list")
        return out
    for i, x in enumerate(listed):
        try:
            if not isinstance(x, dict):
                raise ContractError(f"segment {i} is no object")
            out.append({**x, "start": _number(x.get("start"), f"start of segment {i}"), "end": _number(x.get("end"), f"end of segment {i}")})
        except ContractError:
            if strict:
                raise
    return out


def transcription(payload: dict) -> dict:
    """text, language, probability and segments (start, end, text, words) of a transcription payload.

    A payload without a text is an empty one; segments and words must have numbers as times.
    """
    segments = []
    for x in _spans(payload, strict=True):
        words = x.get("words") or []
        if not isinstance(words, list) or not all(isinstance(w, dict) for w in words):
            raise ContractError("words is no list of objects")
        timed = [{"word": str(w.get("word", "")), **{k: None if w.get(k) is None else _number(w[k], f"{k} of a word") for k in ("start", "end")}} for w in words]
        segments.append({"start": x["start"], "end": x["end"], "text": str(x.get("text") or ""), "words": timed})
    sure = payload.get("language_probability")
    language = payload.get("language")
    if language is not None and not isinstance(language, str):
        raise ContractError("language is no text")
    return {"text": str(payload.get("text") or "").strip(), "language": language, "probability": None if sure is None else _number(sure, "probability"), "segments": segments}


def diarization(payload: dict) -> dict:
    """segments (start, end, speaker), embeddings by speaker, num_speakers and embedding_model of a diarization payload.

    A broken segment is left out rather than the whole; embeddings must hold numbers. The number of speakers is counted
    where the payload has none.
    """
    segments = [{"start": x["start"], "end": x["end"], "speaker": str(x["speaker"])} for x in _spans(payload, strict=False) if x.get("speaker")]
    given = payload.get("embeddings")
    vectors = {}
    for k, v in (given if isinstance(given, dict) else {}).items():
        if not isinstance(v, list):
            raise ContractError(f"embedding of {k} is no list")
        vectors[str(k)] = [_number(c, f"embedding of {k}") for c in v]
    n, model = payload.get("num_speakers"), payload.get("embedding_model")
    n = n if isinstance(n, int) and not isinstance(n, bool) else len({s["speaker"] for s in segments})
    return {"segments": segments, "embeddings": vectors, "num_speakers": n, "embedding_model": model if isinstance(model, str) else ""}


def tokens(payload) -> dict:
    """ids of a tokenizer's payload: a list of whole numbers from 0 on, or an object that has one as ``tokens``."""
    ids = payload.get("tokens") if isinstance(payload, dict) else payload
    if not isinstance(ids, list) or not all(isinstance(i, int) and not isinstance(i, bool) and i >= 0 for i in ids):
        raise ContractError("tokens is no list of ids")
    return {"ids": ids, "n": len(ids)}


@dataclass(frozen=True)
class Contract:
    """What a model must give: ``check`` turns a payload into the result or raises ``ContractError``; ``schema`` is the result's."""

    name: str
    check: Callable[[dict], dict]
    schema: str
    objects: bool = True


_WORD = "struct<word:string,start:double,end:double>"
CONTRACTS = {
    c.name: c
    for c in (
        Contract("transcription", transcription, f"text string, language string, probability double, segments array<struct<start:double,end:double,text:string,words:array<{_WORD}>>>"),
        Contract("diarization", diarization, "segments array<struct<start:double,end:double,speaker:string>>, embeddings map<string,array<double>>, num_speakers int, embedding_model string"),
        Contract("tokens", tokens, "ids array<int>, n int", objects=False),
    )
}


def run_model(inputs: DataFrame, load: Callable[[], Callable[[dict], object]], contract: str | Contract, key: str = "task_id", done: DataFrame | None = None) -> DataFrame:
    """(key, result, error): a model over the rows of ``inputs``, its payloads checked against a contract.

    ``load`` makes the backend once per task of Spark; the backend takes a row as a dict and returns its payload, or its JSON as a
    text. Whatever goes wrong with a row, in the backend or in the payload, becomes that row's ``error`` and leaves
    its ``result`` null; no row fails the job. Rows whose key is in ``done`` have their result already and are skipped.
    A null key is never skipped.
    """
    agreed = CONTRACTS[contract] if isinstance(contract, str) else contract
    todo = inputs if done is None else inputs.join(done.select(key).distinct(), key, "left_anti")
    result = T.StructType.fromDDL(agreed.schema)
    out = T.StructType([inputs.schema[key], T.StructField("_json", T.StringType()), T.StructField("error", T.StringType())])

    def judged(backend: Callable[[dict], object], row: dict) -> tuple[str | None, str | None]:
        try:
            payload = backend(row)
            if isinstance(payload, (str, bytes)):
                payload = json.loads(payload)
            if agreed.objects and not isinstance(payload, dict):
                raise ContractError("payload is no object")
            return json.dumps(agreed.check(payload)), None
        except ContractError as e:
            return None, f"contract: {e}"
        except Exception as e:  # noqa: BLE001  a backend may raise anything, and its row alone has to bear it
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = None
        for batch in batches:
            backend = backend or load()
            pairs = [judged(backend, row) for row in batch.to_dict("records")]
            yield pd.DataFrame({key: batch[key], "_json": [p[0] for p in pairs], "error": [p[1] for p in pairs]})

    checked = todo.mapInPandas(run, out)
    return checked.select(key, F.from_json("_json", result).alias("result"), "error")


def white_space_tokens(c: Column) -> Column:
    """The default tokenizer: a deterministic stand-in where no model is plugged in."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")
