"""Stored indexes: equal to full scans, from few reads."""

from __future__ import annotations

import random
import shutil
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import retrieval, search_index
from fieldtrace.plans import queries as Q
from fieldtrace.sources.versions import Manifests

WORDS = [f"word{i}" for i in range(120)] + ["the", "of", "日志分析", "车"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(WORDS, weights=[1] * 120 + [40, 30, 5, 2], k=rnd.randint(0, 60)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "word1 word1 word2"), (1003, "word1 word1 word2")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def terms(docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("terms"))
    search_index.index_terms(docs, folder, block=20)
    return folder


@pytest.mark.parametrize("query", ["word1 word2", "the of word7 nowhere", "日志 车 the", "nothing known", "word3 word3 word4 the the", "!!"])
@pytest.mark.parametrize(("k", "least"), [(5, 0.1), (1000, 0.0001)])
def test_terms_equal_the_full_scan(spark, docs, terms, query, k, least):
    want = [(r.doc, r.score) for r in retrieval.tfidf_topk(docs, query, k, least).collect()]
    assert [(r.doc, r.score) for r in search_index.search_terms(spark, terms, query, k, least).collect()] == want


@pytest.mark.parametrize("sent", [0, 5, 1000])
def test_rare_terms_are_joined_and_texts_are_not_dealt(spark, docs, terms, tmp_path, monkeypatch, sent):
    want = retrieval.tfidf_topk(docs, "word1 word2 nowhere", 50, 0.0001).collect()
    monkeypatch.setattr(retrieval, "MAX_SENT", sent)
    monkeypatch.setattr(search_index, "MAX_SENT", sent)
    assert retrieval.tfidf_topk(docs, "word1 word2 nowhere", 50, 0.0001).collect() == want
    search_index.index_terms(docs, str(tmp_path), block=20)
    assert search_index.search_terms(spark, str(tmp_path), "word1 word2 nowhere", 50, 0.0001).collect() == want
    index = search_index.Stored(spark, str(tmp_path))
    most = {(r.term, r.block): r.most for r in index.read("postings").groupBy("term", "block").agg(F.max("w").alias("most")).collect()}
    assert {(r.term, r.block): r.most for r in index.read("bounds").collect()} == most
    assert index.read("bounds").count() == len(most)
    counts = retrieval.term_counts(docs, "doc_id", "text")
    assert "hashpartitioning" not in counts._jdf.queryExecution().executedPlan().toString()


def test_counts_of_a_document_in_several_rows(spark):
    rows = [(1, "a b a"), (1, "b c c"), (1, "a"), (2, "日志 a"), (3, None), (4, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda d: {(r.doc, r.term, r.total): r["count"] for r in retrieval.term_counts(d, "doc_id", "text").collect()}
    one = {(2, "日志", 2): 1, (2, "a", 2): 1, (None, "x", 1): 1}
    assert got(df) == one | {(1, "a", 3): 2, (1, "b", 3): 2, (1, "c", 3): 2, (1, "a", 1): 1}
    assert got(df.filter("doc_id > 1 or doc_id is null")) == one


# Texts of many words, without any, and of documents with several rows.
LONG = [(1, "b a-1 b X.y " * 20_000), (2, None), (3, ""), (4, " .-1 "), (5, "a"), (6, "B b ab"), (None, "c")]


def _passes(df) -> int:
    """How often texts are searched for words in a plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("[a-z0-9]+)*")


@pytest.mark.parametrize("name", ["idf", "tokenize_terms"])
@pytest.mark.parametrize("more", [[], [(6, "b b a"), (6, "B b ab"), (5, "a")]])
def test_long_texts_are_cut_into_terms_once(spark, tmp_path, name, more):
    df = spark.createDataFrame(LONG + more, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.QUERIES[name](spark, str(tmp_path))
    assert _passes(got) == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(Q.SQL[name]).fetchall()
    assert {r[0] for r in want} == {"a", "a-1", "ab", "b", "c", "x.y"} and sorted(map(tuple, got.collect())) == sorted(want)


def test_what_is_asked_of_counts_cuts_no_text_in_a_lambda(spark, tmp_path):
    df = spark.createDataFrame(LONG, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "docs"))
    terms = retrieval.documents_terms(spark.read.parquet(str(tmp_path / "docs")), "doc_id", "text")
    assert _passes(terms) == 1
    # A filter is copied to below the counts: a text is cut once more for it, and not for each of its terms.
    several = terms.filter("size(terms) = 3").collect()
    assert [(r.doc, r.total, {t.term: t["count"] for t in r.terms}) for r in several] == [(1, 80_000, {"a-1": 20_000, "b": 40_000, "x.y": 20_000})]
    assert {(r.doc, r.total, len(r.terms)) for r in terms.collect()} == {(1, 80_000, 3), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 1, 1), (6, 3, 2), (None, 1, 1)}


def test_terms_read_their_own_folders_alone(spark, docs, terms, tmp_path):
    want = retrieval.tfidf_topk(docs, "word1 word2", 5).collect()
    copy = tmp_path / "copy"
    shutil.copytree(terms, copy)
    number, content = Manifests(str(copy)).read()
    place = content["place"].replace(terms, str(copy))
    mine = {r.b for r in spark.createDataFrame([("word1",), ("word2",)], "t string").select(search_index._bucket(F.col("t")).alias("b")).collect()}
    for name in ("postings", "bounds", "terms"):
        for d in Path(place, name).glob("bucket=*"):
            if int(d.name.split("=")[1]) not in mine:
                for f in d.iterdir():
                    f.write_bytes(b"spoilt")
    Manifests(str(copy)).publish(lambda now: now | {"place": place})
    # Spark reads a schema from some file: from one that is whole.
    index = search_index.Stored(spark, str(copy))
    index.read = lambda name, real=spark.read.parquet(f"{content['place']}/postings").schema: spark.read.schema(spark.read.parquet(f"{content['place']}/{name}").schema).parquet(f"{place}/{name}")
    real = search_index.Stored
    try:
        search_index.Stored = lambda *_: index
        got = search_index.search_terms(spark, str(copy), "word1 word2", 5).collect()
    finally:
        search_index.Stored = real
    assert got == want


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(i, [x + rnd.gauss(0, 0.15) for x in centres[i % 20]]) for i in range(600)]
    rows += [(900, None), (901, [0.0] * 8), (902, rows[3][1]), (903, [2 * x for x in rows[3][1]])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows


@pytest.mark.parametrize("cells", [1, 24, None])
def test_vectors_equal_the_full_scan(spark, vectors, tmp_path, cells):
    df, rows = vectors
    search_index.index_vectors(df, str(tmp_path), cells=cells, sample=200)
    rnd = random.Random(6)
    for query in (rows[3][1], [rnd.gauss(0, 1) for _ in range(8)], [0.0] * 8, [-x for x in rows[0][1]]):
        for k, least in ((5, 0.3), (700, -1.0), (60, 0.9)):
            want = [(r.vec_id, r.score) for r in retrieval.cosine_topk(df, query, k, least).collect()]
            assert [(r.key, r.score) for r in search_index.search_vectors(spark, str(tmp_path), query, k, least).collect()] == want


def test_vectors_read_the_cells_that_can_matter(spark, vectors, tmp_path):
    df, rows = vectors
    search_index.index_vectors(df, str(tmp_path), cells=24)
    want = [(r.vec_id, r.score) for r in retrieval.cosine_topk(df, rows[3][1], 5).collect()]
    place = Manifests(str(tmp_path)).read()[1]["place"]
    sizes = {int(d.name.split("=")[1]): d for d in Path(place, "vectors").glob("cell=*")}
    q = rows[3][1]
    near = sorted(spark.read.parquet(f"{place}/cells").filter("centre is not null").collect(), key=lambda r: -sum(a * b for a, b in zip(r.centre, q, strict=True)))
    for r in near[8:]:  # four cells are looked at first, and few more can hold a better one
        shutil.rmtree(sizes[r.cell])
    assert [(r.key, r.score) for r in search_index.search_vectors(spark, str(tmp_path), q, 5).collect()] == want


def test_a_new_index_takes_the_place_of_the_old(spark, docs, vectors, tmp_path):
    with pytest.raises(FileNotFoundError):
        search_index.search_terms(spark, str(tmp_path / "t"), "word1")
    search_index.index_terms(docs.filter("doc_id < 10"), str(tmp_path / "t"))
    search_index.index_terms(docs.filter("doc_id >= 1000"), str(tmp_path / "t"))
    assert [r.doc for r in search_index.search_terms(spark, str(tmp_path / "t"), "word1 word2").collect()] == [1002, 1003]
    none = vectors[0].filter("vec_id = 901")
    search_index.index_vectors(none, str(tmp_path / "v"))
    assert search_index.search_vectors(spark, str(tmp_path / "v"), [1.0] * 8).collect() == []
    with pytest.raises(ValueError, match="length"):
        search_index.index_vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"), str(tmp_path / "w"))
