"""What the comparison SQL of the composition queries doesn't reach: loops, streams, presets, strict parsing."""

import random

from pyspark.sql import functions as F

from tapeloom.functions import text as tx
from tapeloom.operators import compositions as co
from tapeloom.operators import sequences as sq


def test_pack_until_fits(spark):
    notes = [("a", i, "x" * 400) for i in range(20)] + [("b", 0, "y" * 40), ("b", 1, "z" * 40), ("c", 0, "w" * 100_000)]
    df = spark.createDataFrame(notes, "id string, pos long, text string")
    half = lambda c: F.substring(c, 1, 300)
    rows = co.pack_until_fits(df, 300, 220, half).collect()
    own = {k: sorted((r.pos, r.text) for r in rows if r.id == k) for k in "abc"}
    assert own["b"] == [(0, "y" * 40), (1, "z" * 40)] and own["c"] == [(0, "w" * 300)]  # one note is shortened once
    assert {(r.id, r.fits) for r in rows} == {("a", True), ("b", True), ("c", True)}
    sizes = [100] * 20  # brute force: batches of at most 220, each then 75
    while sum(sizes) > 300 and len(sizes) > 1:
        batches, n = [], 0
        for s in sizes:
            if batches and n + s <= 220:
                batches[-1].append(s)
                n += s
            else:
                batches.append([s])
                n = s
        sizes = [75] * len(batches)
    assert len(own["a"]) == len(sizes) and sum(len(t) // 4 for _, t in own["a"]) <= 300
    same = co.pack_until_fits(df.filter("id in ('a', 'c')"), 10, 10_000, lambda c: c).collect()
    assert sorted((r.id, r.fits) for r in same) == [("a", False), ("c", False)]  # single notes that don't fit
    stuck = co.pack_until_fits(df.filter("id in ('a', 'b')"), 5, 100, lambda c: c).collect()  # no note can join another
    assert len([r for r in stuck if r.id == "a" and not r.fits]) == 20 and len([r for r in stuck if r.id == "b"]) == 1
    slow = spark.createDataFrame([("s", i, "x" * 400) for i in range(60)], "id string, pos long, text string")
    rows = co.pack_until_fits(slow, 100, 150, lambda c: F.expr("substring(text, 1, length(text) - 20)")).collect()
    assert len(rows) < 60 and {r.fits for r in rows} == {sum(max(1, len(r.text) // 4) for r in rows) <= 100}  # far more than twenty passes
    assert co.pack_until_fits(df.limit(0), 10, 10, half).count() == 0


def test_live_totals_of_a_stream(spark, tmp_path):
    schema = "task_id long, stage string, t_wall_ms double"
    for n, rows in enumerate([[(1, "a", 1.0), (1, "a", 2.0)], [(1, "a", 4.0), (2, "b", None)]]):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/{n}")
    stream = co.live_totals(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("live_totals").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("live_totals").collect())) == [(1, "a", 3, 7.0, 4.0), (2, "b", 1, None, None)]


def test_presets(spark):
    shape = "options struct<language:string,audio_only:boolean,transcript:boolean,diarize:boolean,delivery:array<struct<deliver_to:string,variant:string,secret:string>>,prompts:array<struct<source:string,id:string,secret:string>>>, valid array<string>"
    df = spark.createDataFrame([((None, None, None, True, [("7", "", "s"), ("", "raw", "s"), (None, None, None)], [("system", "a", "s"), ("user", "1", "s"), ("user", "2", "s"), ("x", "1", "s"), None]), ["1"]), (("de", True, False, None, None, None), None)], shape)
    rows = [r.o.asDict(recursive=True) for r in df.select(co.expand_options(F.col("options"), F.col("valid")).alias("o")).collect()]
    assert rows[0] == {"language": None, "audio_only": False, "transcript": True, "diarize": True, "prompts": [{"source": "system", "id": "a"}, {"source": "user", "id": "1"}], "delivery": [{"deliver_to": "7", "variant": None}]}
    assert rows[1] == {"language": "de", "audio_only": True, "transcript": False, "diarize": False, "prompts": [], "delivery": []}
    refs = spark.createDataFrame([("system", "a"), ("user", "5"), ("user", "a"), ("x", "a")], "source string, id string")
    system = spark.createDataFrame([("a", "A")], "key string, options string")
    own = spark.createDataFrame([(5, "B")], "preset_id int, options string")
    assert sorted((r.source, r.id, r.options or "") for r in co.resolve_preset(refs, system, own).collect()) == [("system", "a", "A"), ("user", "5", "B"), ("user", "a", ""), ("x", "a", "")]


def test_strict_parsing(spark):
    raws = [None, "[]", '["system:summary", "user:5"]', '["user"]', "{}", "[", "5"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").select("i", co.parse_prompts(F.col("raw")).alias("p")).orderBy("i").collect()
    assert [r.p.error for r in rows] == [None, None, None, "invalid reference", "not a list", "not JSON", "not a list"]
    assert [[(x.source, x.id) for x in r.p.refs or []] for r in rows[:3]] == [[("system", "summary")], [], [("system", "summary"), ("user", "5")]]


def test_batches_and_split_of_nothing(spark):
    df = spark.createDataFrame([([],), ([500, 1],), ([1, 2, 3],)], "s array<int>")
    assert [r.b for r in df.select(co.batch_notes(F.col("s"), 3).alias("b")).collect()] == [[], [0, 1], [0, 0, 1]]
    entries = spark.createDataFrame([(1, 0, None, 0.0, 5.0, "a b")], "task_id long, pos long, speaker string, start double, end double, text string")
    words = spark.createDataFrame([], "task_id long, pos long, word_pos int, word string, start double, end double")
    turns = spark.createDataFrame([(1, 0, "A", 1.0, 2.0), (1, 1, "B", 2.0, 5.0)], "task_id long, seg_pos long, speaker string, start double, end double")
    assert [tuple(r) for r in co.split_entries(entries, words, turns, 2, 1.0).collect()] == [(1, 0, 0, "B", 0.0, 5.0, "a b")]


def test_folds_are_linear(spark):
    """A document of 100,000 sentences within seconds, and blocks that join to the same as one list."""
    import time

    rng = random.Random(3)
    for n in (0, 1, 2, 3, 10, 101):
        sizes = [rng.randint(1, 60) for _ in range(n)]
        row = spark.createDataFrame([(sizes, [f"u{i}" for i in range(n)])], "s array<int>, u array<string>").select(co.batch_notes(F.col("s"), 50).alias("b"), sq.pack_units(F.col("u"), F.col("s"), 50).alias("p")).head()
        batch, total, batches, packs, held = 0, 0, [], [], 0
        for i, s in enumerate(sizes):
            if i and total + s > 50:
                batch, total = batch + 1, 0
            total += s
            batches.append(batch)
            if s > 50:
                packs, held = [*packs, [f"u{i}"]], 51
            elif not packs or held + s > 50:
                packs, held = [*packs, [f"u{i}"]], s
            else:
                packs[-1].append(f"u{i}")
                held += s
        assert row.b == batches and row.p == packs
    text = " ".join(f"Sentence number {i} of Mr. Fox ends here." for i in range(100_000))
    df = spark.createDataFrame([(text,)], "t string")
    units = sq.chunk_sentences(F.col("t"))
    began = time.time()
    df.select(F.size(units)).collect()
    row = df.withColumn("u", units).select("u", F.transform("u", tx.estimate_tokens).alias("s")).select(F.size("u").alias("n"), F.size(sq.pack_units(F.col("u"), F.col("s"), 200)).alias("p"), F.array_max(co.batch_notes(F.col("s"), 200)).alias("b")).head()
    assert row.n == 100_000 and row.p == row.b + 1 and time.time() - began < 40
    points = spark.range(1).select(F.size(sq.thin_points(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: i / 2.0), 60.0)).alias("n")).head()
    assert points.n == 7693


def test_simhash_counts_any_number_of_tokens(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(70)), lambda i: (i * i % 13).cast("string"))
    row = spark.range(1).select(tx.simhash(words).alias("a"), tx.simhash(words, fits=10).alias("b")).head()
    assert row.a == row.b != 0


def test_delivery_lists(spark):
    good = [(None, None, ""), ("", None, ""), ("[]", None, ""), ('[{"deliver_to": 7, "variant": "raw"}]', None, "7/raw"), ('[{"deliver_to": "0", "variant": ""}]', None, "0"), ('[{"deliver_to": true, "variant": "user:1"}]', None, "true/user:1")]
    bad = [("[null]", "not an object"), ('["{}"]', "not an object"), ("[[]]", "not an object"), ("5", "not a list"), ('"x"', "not a list"), ("{}", "not a list"), ("[", "not JSON"), ("[{}]", "no target"), ('[{"deliver_to": "7", "variant": "odd"}]', "unknown variant")]
    bad += [('[{"deliver_to": %s}]' % x, "no target") for x in ("0", "0.0", "false", "null", '""', "[]", "{}", "-0.0")]
    bad += [('[{"deliver_to": 0}, 5]', "no target"), ('[5, {"deliver_to": 0}]', "not an object"), ('[{"deliver_to": "7", "variant": "x"}, 5]', "unknown variant")]
    rows = [*good, *((r, e, "") for r, e in bad)]
    got = spark.createDataFrame([(r,) for r, _, _ in rows], "r string").select("r", co.parse_delivery(F.col("r")).alias("p")).collect()
    assert [(r.r, r.p.error, ",".join("/".join(filter(None, e)) for e in r.p.entries)) for r in got] == rows


def test_measures_of_broken_artifacts(spark):
    texts = [(1, "transcript", "a.json", '{"text": " héllo "}'), (2, "transcript", "a.JSON", "{"), (3, "transcript", "a.txt", "{"), (4, "transcript", "a.json", '{"text": null}'), (1, "summary", "s.json", ' {"text": 1} '), (5, "other", "x", "x")]
    matches = [(1, '{"A": {"noise": true}, "B": {}, "C": 5, "D": {"noise": null}}'), (2, "[]"), (3, "oops"), (4, "{}")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = co.task_measures(
        frame([(i,) for i in range(1, 6)], "task_id long"), frame([], "task_id long, started_at timestamp, finished_at timestamp"), frame(texts, "task_id long, kind string, path string, text string"),
        frame([(1, 10, 3.9), (2, 0, -4.0), (3, 5, None)], "task_id long, size long, seconds double"), frame(matches, "task_id long, raw string"))
    got = {r.task_id: r for r in out.collect()}
    assert [got[i].transcript_chars for i in range(1, 6)] == [5, None, 1, None, None] and got[1].summary_chars == 11 and got[5].redacted_chars is None
    assert [got[i].media_seconds for i in range(1, 6)] == [3, 0, None, None, None] and [got[i].speaker_count for i in range(1, 6)] == [2, None, None, 0, None]
