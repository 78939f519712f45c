"""The corpus queries over whole tables: SQL where there is some, libraries and brute force where there is none."""

import hashlib
import html
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from firnline.llm import line_dedup, quality_gam, queries, text_features
from tests.llm.test_corpus_operators import brute_components, brute_lines, tiktoken_codec


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    theirs = con.sql(queries.ORACLES[name])
    columns = theirs.columns
    ours = __spark_entry__.queries()[name](spark, sf_dir).select(*columns).collect()
    assert sorted(tuple(r) for r in ours) == sorted(theirs.fetchall())


def test_fingerprints_of_the_table(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.op4_fingerprints(spark, sf_dir).collect()}
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf_dir}/documents.parquet'").fetchall())
    order = sorted(texts, reverse=True)
    for i, following in zip(order, order[1:] + order[:1], strict=True):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[following][:half]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_line_dedup_of_the_table(spark, sf_dir):
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.line_report(docs).collect()}
    assert got == brute_lines(texts, line_dedup.TAU, line_dedup.LEAST_CHARS)


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf_dir}/documents.parquet'").fetchall())


def test_token_counts_of_the_table(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.op1_token_counts(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def token_digests(text):
    ids = tiktoken_codec().encode_ordinary(text)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_codec_of_the_table(spark, sf_dir, texts):
    rows = queries.op2_bpe_codec(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == token_digests(texts[r.doc_id]) for r in rows)


def quality_scores(rows, labels):
    """doc_id: score of (doc_id, text) rows by a model fitted on all labelled rows that are not held out."""
    known = {i: q for i, q in labels if q in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2}
    x = {i: text_features.features(pa.array([t or ""]))[0] for i, t in rows}
    fitted = sorted(i for i in x if i in known)
    model = quality_gam.fit(np.stack([x[i] for i in fitted]), np.array([known[i] for i in fitted], float))
    return {i: float(model.score(v[None])[0]) for i, v in x.items()}


def test_quality_scores_of_the_table(spark, sf_dir, texts):
    expected = quality_scores(texts.items(), duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    rows = queries.op10_quality_gam(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert abs(r.score - expected[r.doc_id]) < 1e-9 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def pipeline_by_hand(rows, labels):
    """The pipeline's rows for documents (doc_id, text, source), stage by stage in plain Python and SQL."""
    scores = quality_scores([r[:2] for r in rows], labels)
    rows = sorted(r for r in rows if scores[r[0]] >= 0.7)
    removed = brute_lines([t for _, t, _ in rows], line_dedup.TAU, line_dedup.LEAST_CHARS)
    cut = lambda k, t: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in removed[k][3])
    rows = [(i, cut(k, t), s) for k, (i, t, s) in enumerate(rows)]
    groups = brute_components([t for _, t, _ in rows])
    rows = [r for k, r in enumerate(rows) if groups[k][2]]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    taken = {i: (size, n) for i, size, n in con.sql(f"SELECT doc_id, size, taken FROM ({queries.ORACLES['op8_mixing']})").fetchall()}
    out = Counter()
    for i, t, _ in rows:
        if taken[i][0]:
            out[(i, *token_digests(t))] += int(taken[i][1] / taken[i][0] + 0.5)
    return +out


def test_pipeline_equals_its_stages_by_hand(spark, sf_dir, tmp_path):
    import corpus_pipeline

    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{sf_dir}/documents.parquet' WHERE length(text) < 4000 ORDER BY doc_id").fetchall()
    good = max((r for r in rows), key=lambda r: len(r[1]))[1]
    rows += [(10_000, good, "copies"), (10_001, good + " and a little more at its end", "copies"), (10_002, rows[3][1] + "\n" + rows[4][1], None), (10_003, "", None)]
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{sf_dir}/labels.parquet'").fetchall()
    frame = spark.createDataFrame([(i, t, "en", s, len(t), 5, "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, quality int, removed string")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    expected = pipeline_by_hand(rows, [x[:2] for x in labels])
    assert got == expected and len(expected) > 20
    assert 0 < sum(v > 1 for v in expected.values())  # the mix repeats some


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int, _id long, _kept long, _copies int, removed string, row string, key long, bucket int, hash64 string, base int, copies int, size string, draw long, position int, shard int, quota int, taken int, node long, component long, `a b` int"


def test_stages_take_any_columns_nulls_and_empty_tables(spark, sf_dir, tmp_path):
    """Columns that have the names that stages use themselves come through; rows without doc_id or text don't stop them."""
    import corpus_pipeline

    spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("text", F.lit("x")).write.parquet(f"{tmp_path}/labels.parquet")
    width = len(CLASHING.split(", ")) - 5
    values = [(0, "some text here that is long enough\nsome text here that is long enough"), (0, "some text here that is long enough"), (None, "no id\nno id"), (1, None), (2, ""), (None, None), (3, "word " * 3000)]
    docs = spark.createDataFrame([(i, t, None, None if k % 2 else "s", None, *[None] * width) for k, (i, t) in enumerate(values)], CLASHING)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = out.collect()
        assert {(r.doc_id) for r in rows} <= {i for i, _ in values}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(values)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op1_token_counts", "op2_bpe_codec", "op3_suffix_dedup", "op4_fingerprints", "op5_minhash", "op6_exact_dedup", "op7_line_dedup", "op8_mixing", "op10_quality_gam"])
def test_queries_give_each_row_once(spark, sf_dir, tmp_path, name):
    """A table with rows without doc_id or text, repeated rows and clashing columns: a row for each; none for none."""
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    width = len(CLASHING.split(", ")) - 5
    values = [(0, "some text"), (0, "some text"), (0, "other text"), (None, "no id"), (None, "no id"), (1, None), (None, None), (2, "")]
    rows = [(i, t, None, None if k % 2 else "s", None, *[None] * width) for k, (i, t) in enumerate(values)]
    for some in (rows, []):
        spark.createDataFrame(some, CLASHING).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in some)


def test_pages_have_their_article_and_nothing_else(spark, sf_dir):
    """Every page of the table against plain text surgery: what stands in its article, block by block."""
    rows = {r.page_id: r for r in queries.op9_html_extract(spark, sf_dir).collect()}
    pages = duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall()
    assert len(rows) == len(pages)
    for page_id, page in pages:
        article = page.split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:p|br|h1|ul|li)[^>]*>", article)
        told = [" ".join(html.unescape(re.sub(r"</?\w[^>]*>", "", part)).split()) for part in parts]
        expected = " ".join(t for t in told if t)
        assert (rows[page_id].text, rows[page_id].n_chars) == (expected, len(expected))


def test_the_pipeline_leaves_its_last_input_only(spark, sf_dir, tmp_path, monkeypatch):
    """Every other folder that stages write on the way is gone when the result is there."""
    import corpus_pipeline
    from firnline.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["pipeline-3"]
