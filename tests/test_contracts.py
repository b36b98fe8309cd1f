"""Models behind contracts: malformed payloads become error rows, finished rows are skipped, other rows go on."""

import json

import pytest

from tapeloom.plans import hooks


def run(spark, payloads, contract, done=None):
    """A stub backend that gives each row's own payload; "!" makes it fail."""
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "task_id long, payload string")

    def load():
        def backend(row):
            if row["payload"] == "!":
                raise OSError("backend is gone")
            return row["payload"]

        return backend

    rows = hooks.run_model(df, load, contract, done=None if done is None else spark.createDataFrame([(d,) for d in done], "task_id long")).collect()
    assert all((r.result is None) == (r.error is not None) for r in rows)
    return {r.task_id: r.error or r.result.asDict(recursive=True) for r in rows}


def test_transcription(spark):
    good = {"text": " hi ", "language": "en", "language_probability": 1, "segments": [{"start": 0, "end": "1.5", "text": "hi", "words": [{"word": " hi", "start": 0, "end": None}]}], "more": 1}
    got = run(spark, [json.dumps(good), "{}", "!", "[1]", "{", '{"segments": 5}', '{"segments": [{"start": 0}]}', '{"segments": [{"start": 0, "end": true}]}', '{"language": 5}', '{"segments": [{"start": 0, "end": 1, "words": ["x"]}]}', '{"language_probability": "nan"}'], "transcription")
    assert got[0] == {"text": "hi", "language": "en", "probability": 1.0, "segments": [{"start": 0.0, "end": 1.5, "text": "hi", "words": [{"word": " hi", "start": 0.0, "end": None}]}]}
    assert got[1] == {"text": "", "language": None, "probability": None, "segments": []}
    assert got[2] == "OSError: backend is gone" and got[3] == "contract: payload is no object" and got[4].startswith("JSONDecodeError")
    assert [got[i].split(": ", 1)[1] for i in range(5, 11)] == ["segments is no list", "end of segment 0 is no number", "end of segment 0 is no number", "language is no text", "words is no list of objects", "probability is not finite"]


def test_diarization(spark):
    mixed = {"segments": [{"start": 0, "end": 2, "speaker": "A"}, {"start": 0, "end": "x", "speaker": "A"}, {"start": 1, "end": 2, "speaker": ""}, 5, {"start": "2", "end": 3, "speaker": 7}], "embeddings": {"A": [1, 0.5]}, "num_speakers": "2"}
    got = run(spark, [json.dumps(mixed), '{"segments": 5, "embeddings": [], "num_speakers": 3, "embedding_model": "m"}', '{"embeddings": {"A": 5}}', '{"embeddings": {"A": ["x"]}}'], "diarization")
    assert got[0] == {"segments": [{"start": 0.0, "end": 2.0, "speaker": "A"}, {"start": 2.0, "end": 3.0, "speaker": "7"}], "embeddings": {"A": [1.0, 0.5]}, "num_speakers": 2, "embedding_model": ""}
    assert got[1] == {"segments": [], "embeddings": {}, "num_speakers": 3, "embedding_model": "m"}
    assert got[2] == "contract: embedding of A is no list" and got[3] == "contract: embedding of A is no number"


def test_tokens_and_finished_rows(spark):
    got = run(spark, ["[1, 2]", '{"tokens": [3]}', "[-1]", '["a"]', '{"n": 1}'], "tokens", done=[1, 3])
    assert sorted(got) == [0, 2, 4] and got[0] == {"ids": [1, 2], "n": 2} and got[2] == got[4] == "contract: tokens is no list of ids"
    assert run(spark, [], "tokens") == {}


def test_unknown_contract(spark):
    with pytest.raises(KeyError):
        hooks.run_model(spark.range(1).withColumnRenamed("id", "task_id"), lambda: None, "nothing")
