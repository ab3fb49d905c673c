"""The pipeline against a brute-force version of its stages, and its queries."""

import pytest

import corpus_pipeline
from sparkclin.llm import bpe_codec, queries
from sparkclin.llm.queries import pre_token_pattern, tokenizer_file
from tests.llm.test_operators import base_spans, components


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        out.append((name, before, docs))
    return out


def test_stages(spark, sf, stages):
    assert len(stages) == 5
    for name, before, after in stages[:-1]:
        assert after.columns == corpus_pipeline.COLUMNS, name
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0][2].select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)


def test_near_duplicates_stage(stages):
    _, before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {i for i, (_, root) in components(rows, 5, 80).items() if i == root}
    assert {r.doc_id for r in after.collect()} == want


def test_decontamination_stage(spark, sf, stages):
    _, before, after = stages[2]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id for r in after.collect()}
    for r in before.collect():
        if any(t in r.text for t in items):
            assert r.doc_id not in left


def test_secret_stage(stages):
    _, before, after = stages[3]
    assert before.count() == after.count()
    old = {r.doc_id: r for r in before.collect()}
    for r in after.collect():
        assert not base_spans(r.text) and r.n_chars == (old[r.doc_id].n_chars if r.text == old[r.doc_id].text else len(r.text))
        assert r.text == old[r.doc_id].text or base_spans(old[r.doc_id].text) or "[secret]" in r.text


def test_token_stage(stages):
    _, before, after = stages[4]
    codec = bpe_codec.codec(tokenizer_file("byte_bpe_multi_50k.tiktoken"), pre_token_pattern())
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(texts) and all(codec.decode(r.ids).decode() == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)


def test_run_equals_its_stages(spark, sf, stages):
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r.doc_id, r.n_tokens) for r in stages[-1][2].collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    result = db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    order = [columns.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in result.fetchall())


def test_all_ten_are_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 11)}


def test_stages_with_odd_rows(spark, sf):
    words = [f"word{k}" for k in range(120)]
    long = " ".join(words)
    rows = [(None, long, "en", "s", 5), (None, long + " more", None, None, None), (1, None, "en", "s", None), (1, "", "en", "s", 0), (2, long, "en", "s", 7), (2, long, "en", "s", 7), (2, " ".join(words[::-1]), "en", "s", 7), (None, None, None, None, None), (None, "some words of its own that nothing else has", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    left = stages["near duplicates"](spark, docs.withColumn("__extra", docs.text), sf)
    assert left.columns == corpus_pipeline.COLUMNS
    assert texts(left) == sorted([(2, long), (2, rows[6][1]), (1, None), (1, ""), (None, None), (None, rows[8][1])], key=str)
    assert texts(stages["decontamination"](spark, docs, sf)) == texts(docs)
    assert texts(stages["secret scans"](spark, docs, sf)) == texts(docs)
    assert stages["byte-level BPE"](spark, docs, sf).count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert stages["quality classifier"](spark, docs, sf).columns == corpus_pipeline.COLUMNS


def test_decontamination_is_fitted_on_all_documents(spark, sf, monkeypatch):
    from sparkclin.llm import decontaminate

    rows = [(k, f"word{k} of a text that holds nothing {k}", "en", "s", 30) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    fitted, svd = [], decontaminate.randomised_svd
    monkeypatch.setattr(decontaminate, "randomised_svd", lambda *a, **k: (fitted.append(a[0].count()), svd(*a, **k))[1])
    assert corpus_pipeline.decontamination(spark, docs, sf).count() == len(rows)
    assert fitted == [len(rows)]
