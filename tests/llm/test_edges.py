"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodewell.llm import bpe, fim, langid, lexical, licenses, lines, nearjoin, packing, pii, quality, suffix, tokencounts, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g long, d string, n_removed int, host_failed string, ids string, __key string, __gone int, __host string, __source string, fails string, row string"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(20000))
WORDS = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of red wine and old honey for guests"


def rows():
    extra = (5, "x", 3, "y", "z", "k", 1, "h", "s", "f", "r")
    texts = [None, "", "   \n\n", "a", WORDS, WORDS, WORDS + " tonight", LONG, "ä€😀 " * 30, "mail me@mail.example.com or +1 (555) 123-4567 now\n" * 3, "x" * 50000]
    out = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 7, *extra) for i, t in enumerate(texts)]
    return [*out, out[4], (None, WORDS, None, None, None, *extra)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


BYTE, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
EDITS = "array(named_struct('start', 1L, 'stop', 2L, 'put', 'q'))"
OPERATORS = {
    "lines": lambda d: lines.dedup_lines(d, counts=("c1", "c2")),
    "packing": lambda d: packing.pack(d, BYTE),
    "suffix": suffix.remove_repeats,
    "quality": quality.judge,
    "quality keep": quality.keep_good,
    "pii": pii.detect,
    "pii redact": pii.redact,
    "langid": lambda d: langid.predict(d, langid.learn(d), ["doc_id", "g"]),
    "bpe": lambda d: bpe.encode_decode(d, MULTI, P.PATTERN),
    "counts": lambda d: tokencounts.count_edited(d.withColumn("edits", F.expr(EDITS)), P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "langid clash": lambda d: langid.predict(d.withColumn("score", F.lit("s")).withColumn("Lang_Pred", F.lit(1)), langid.learn(d), ["doc_id", "score", "Lang_Pred", "lang"]),
    "licenses": licenses.scan,
    "fim": fim.fill_in_middle,
    "near": nearjoin.near_components,
    "near keep": nearjoin.keep_one,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_whole_results(docs, name):
    n = len(OPERATORS[name](docs).collect())
    if name == "packing":
        assert n >= len(rows())
    elif name in ("quality keep", "near keep"):
        assert 0 < n < len(rows())
    else:
        assert n == len(rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, name):
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, none, name, stage):
    assert stage(spark, none, "").collect() == []
    out = stage(spark, docs, "")
    assert out.count() > 0
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.dtypes == docs.dtypes


def test_near_definitions(docs):
    got = {r.doc_id: r for r in nearjoin.near_components(docs).where("doc_id IS NOT NULL").collect()}
    assert [got[i].n_shingles for i in range(4)] == [0, 0, 0, 1]
    assert got[5].component_id == 4 and not got[5].kept and got[6].component_id == 4
    assert got[0].component_id == 0 and got[0].kept


def test_null_key_is_kept(docs):
    r = nearjoin.near_components(docs).where("doc_id IS NULL").first()
    assert r.component_id is None and r.kept


def test_suffix_repeated_rows_go(spark):
    t = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(20))
    d = spark.createDataFrame([(1, t), (2, t), (3, "short"), (4, "ab" * 400)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix.remove_repeats(d).collect()}
    assert got[1].n_removed == len(t) and got[2].n_spans == 1 and got[3].n_removed == 0 and got[4].n_removed == 800


def test_topk_edges(spark):
    v = [(0, [0.5, -0.5]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, []), (7, [float("inf"), 0.0]), (8, [0.5]), (None, [1.0, 1.0])]
    t = spark.createDataFrame([(*x, "clash") for x in v], "vec_id long, embedding array<float>, score string")
    got = [tuple(r) for r in topk.top_k(t, lambda i: i % 4 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [
        (0, 1, 4, 2048), (0, 2, 5, 2048), (0, 3, 8, 1024),
        (4, 1, 5, 4096), (4, 2, 0, 2048), (4, 3, 8, 2048),
        (8, 1, 4, 2048), (8, 2, 5, 2048), (8, 3, 0, 1024),
    ]
    assert topk.top_k(t.limit(0), lambda i: i % 4 == 0).count() == 0
    assert topk.top_k(t, lambda i: i < 0).count() == 0


def test_quality_null_host(spark):
    bad = [(i, "no", "h") for i in range(50)]
    t = spark.createDataFrame([*bad, (50, WORDS, "h"), (51, WORDS, None), (52, WORDS, "good")] + [(60 + i, WORDS, "good") for i in range(50)], "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in quality.judge(t).collect()}
    assert not got[50] and got[51] and got[52]


def test_und(docs):
    got = {r.doc_id: r for r in langid.predict(docs, {}, ["doc_id"]).collect()}
    assert got[4].lang_pred == "und"
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.learn(docs), ["doc_id"]).collect()}
    assert got[0] == ("und", 0.0) and got[2] == ("und", 0.0) and got[4][0] == "en"


def test_kept_columns_give_way(docs):
    d = docs.withColumn("score", F.lit("s")).withColumn("lang_pred", F.lit(1))
    got = langid.predict(d, langid.learn(d), ["doc_id", "score", "lang_pred"])
    assert got.dtypes == [("doc_id", "bigint"), ("lang_pred", "string"), ("score", "double")]
    assert {r.lang_pred for r in got.collect()} <= {"und", "en"}


def test_search_edges(docs, none):
    items = docs.select(F.col("doc_id").alias("item_id"), "text", "ids")
    assert lexical.search(docs, items.where("item_id = 4")).where("rank = 1 AND doc_id = 4").count() == 2  # the row is there twice
    assert lexical.search(none, items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []


def test_null_edits(spark):
    edit = "struct<start:bigint,stop:bigint,put:string>"
    rows = [(1, "some text here", None), (2, "some text here", [None]), (3, "some text here", [(0, 5, None)]), (4, None, [(0, 0, "new")]), (5, "some text here", [])]
    d = spark.createDataFrame(rows, f"doc_id long, text string, edits array<{edit}>")
    got = {r.doc_id: (r.n_edits, r.text_after) for r in tokencounts.count_edited(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert got == {1: (0, "some text here"), 2: (0, "some text here"), 3: (1, "text here"), 4: (1, "new"), 5: (0, "some text here")}


def test_habits_decide(spark):
    """A rule that a host's documents fail as a habit rejects them there, not on a host where it is rare, nor without a host."""
    signs = WORDS + " #" * 4
    rows = [(i, signs if i % 10 == 0 else WORDS, "often") for i in range(400)] + [(1000 + i, signs if i == 0 else WORDS, "seldom") for i in range(400)] + [(3000, signs, None)]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in quality.judge(t).collect()}
    assert not got[0] and got[1] and got[1000] and got[3000] and sum(not k for k in got.values()) == 40
    assert {r.doc_id for r in quality.keep_good(t).collect()} == {d for d, k in got.items() if k}
