"""Registered queries against brute force on the given tables."""

import html
import re

import duckdb

from tapeloom.llm import pii, queries

SF = "/root/testdata/sf0.001"


def table(name, columns):
    return duckdb.connect().execute(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


def test_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.SQL.items():
        rel = con.execute(sql)
        cols = [c[0] for c in rel.description]
        assert sorted(map(tuple, queries.QUERIES[name](spark, SF).select(cols).collect())) == sorted(rel.fetchall()), name


def test_sql_of_links(spark, tmp_path):
    """Chains, copies, other labels, null and broken vectors."""
    step = lambda k: [1.0, 0.15 * k, 0.0, 0.0]
    rows = [(10 + k, "a", step(k)) for k in range(6)] + [(5, "b", step(0)), (6, None, step(0)), (7, "a", None), (8, "a", [0.0] * 4), (9, "a", [1.0, None, 0.0, 0.0]), (4, "a", [float("nan"), 1.0, 0.0, 0.0]), (30, "a", step(0)), (31, "b", [2.0, 0.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    rel = con.execute(queries.OP6_SQL)
    cols = [c[0] for c in rel.description]
    want = sorted(rel.fetchall())
    assert sum(r[1] for r in want) > 8 and sorted(map(tuple, queries.op6_multi_index(spark, str(tmp_path)).select(cols).collect())) == want


def test_main_texts(spark):
    """The given pages hold their article in one element: its blocks, by plain patterns."""
    want = {}
    for page, url, raw in table("pages", "page_id, url, html"):
        body = re.search("(?s)<article>(.*)</article>", raw)[1]
        blocks = re.split("</?(?:p|h1|h2)>", re.sub('(?s)<div class="ad">.*?</div>|<!--.*?-->', "", body))
        blocks = [" ".join(html.unescape(re.sub("</?[a-z][^>]*>", " " if "<br" in b else "", b)).split()) for b in blocks]
        want[page] = url, "\n\n".join(filter(None, blocks))
    rows = queries.op4_min_cut(spark, SF).collect()
    assert len(rows) == len(want) and all((r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text) for r in rows)


def test_surrogates(spark):
    """Only mentions change; a value has one surrogate, no other has it, and none is a real value."""
    given = dict(table("documents", "doc_id, text"))
    rows = queries.op7_pii(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(given)
    new, real = {}, {(k, v) for t in given.values() for _, _, k, v in pii.detect(t or "")}
    for r in rows:
        text = given[r.doc_id] or ""
        spans, at, form = pii.detect(text), 0, ""
        for a, b, _, _ in spans:
            form, at = form + re.escape(text[at:a]) + "(.+?)", b
        found = re.fullmatch(form + re.escape(text[at:]), r.text or "", re.S)
        assert found and r.n_entities == len(spans)
        for (_, _, kind, value), got in zip(spans, found.groups(), strict=True):
            new.setdefault((kind, value), set()).add(pii.canonical(kind, got))
    assert len(new) == len(real) > 10 and all(len(x) == 1 for x in new.values())
    gone = {(kind, *x) for (kind, _), x in new.items()}
    assert len(gone) == len(new) and not gone & real
