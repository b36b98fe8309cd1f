"""The pipeline's stages on a small corpus, each held against what brute force expects of it."""

import random

import corpus_pipeline
from tapeloom.llm import simhash
from tests.llm.test_first import brute_lines, closure


def corpus():
    rng = random.Random(9)
    words = [f"wort{i}" for i in range(900)]
    rows, labels = [(-3, None), (-2, ""), (-1, " ")], []
    for i in range(400):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(8, 40))) for _ in range(rng.randint(1, 6)))
        toxic = int(i % 6 == 0)
        if toxic:
            text = text.replace(" ", f" {rng.choice(['idiot', 'moron', 'scum'])} ", 1)
        if i % 5 == 0:
            text += "\nAll rights reserved."
        if i % 7 == 0:
            text += f"\nwrite to u{i}@mail.example.com"
        rows.append((i, text))
        labels.append((i, 1, toxic))
    rows += [(500 + i, rows[10 + i][1]) for i in range(40)] + [(7, rows[10][1])]
    return rows, labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        now = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "toxicity":
            bad = lambda t: any(w in (t or "") for w in ("idiot", "moron", "scum"))
            assert sorted(now, key=str) == sorted((x for x in seen if not bad(x[1])), key=str)
        elif name == "line dedup":
            want = brute_lines([t for _, t in seen], 10)
            assert sorted(now) == sorted((i, "\n".join(x)) for (i, _), x in zip(seen, want, strict=True))
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "simhash near-dedup":
            seen.sort()
            fp = [simhash.fingerprint((t or "").encode(), 5) for _, t in seen]
            comp = closure(len(seen), lambda i, j: (d := (fp[i][0] ^ fp[j][0]).bit_count()) <= 13 and d + (fp[i][1] ^ fp[j][1]).bit_count() <= 24)
            assert sorted(i for i, _ in now) == sorted(seen[c][0] for c in set(comp)) and set(now) <= set(seen)
        else:
            assert sorted(i for i, _ in now) == sorted(i for i, _ in seen)
            before = dict(seen)
            assert all((t == before[i]) == ("@" not in before[i]) for i, t in now)
        seen = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in seen}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.ids_crc32) for r in packed)


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
