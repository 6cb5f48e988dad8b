"""Operators against closed-form values, published worked examples and edge cases."""

import hashlib
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewell.functions import intervals, jsonx, text as T
from lodewell.operators import agreement as A, calibration as C, corpus, evidence as E, guard as G, ireval, positions, redact as R, resample, retrieval, sampling, substrings, sweep
from lodewell.sources import readers, sinks


def one(df):
    return df.first()[0]


def col(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


def test_squash(spark):
    assert col(spark, " a  b\n\tc ", T.squash) == "a b c"
    assert col(spark, None, T.squash) == ""


def test_sentences_and_claims(spark):
    assert len(col(spark, "One is. Two is! Three is?", T.sentences)) == 3
    assert col(spark, "It costs 5. 3 days. more text.", T.claims) == ["It costs 5.", "3 days. more text."]


def test_packing_cuts_long_sentences(spark):
    pieces = spark.createDataFrame([(["a" * 30, "bb", "cc", "d" * 9],)], "x array<string>")
    assert one(pieces.select(T.pack_greedily(F.col("x"), 12))) == ["a" * 12, "a" * 12, "a" * 6, "bb cc", "d" * 9]
    assert one(pieces.select(T.pack_greedily(F.col("x"), 12, least=6))) == ["a" * 12, "a" * 12, "a" * 6, "d" * 9]
    assert one(spark.createDataFrame([([],)], "x array<string>").select(T.pack_greedily(F.col("x"), 12))) == []


def test_distinct_folded(spark):
    assert col(spark, ["A", "b", "a", "B", "c"], T.distinct_folded, "array<string>") == ["A", "b", "c"]


def test_exact_interval():
    lo, hi = intervals.exact_bounds(3, 12)
    assert (round(lo, 4), round(hi, 4)) == (0.0549, 0.5719)
    assert intervals.exact_bounds(0, 10)[0] == 0 and intervals.exact_bounds(10, 10)[1] == 1
    assert math.isclose(intervals.exact_bounds(0, 10)[1], 1 - 0.025 ** 0.1, rel_tol=1e-9)


def test_t_tail(spark):
    p = spark.createDataFrame([(2.228, 10.0)], "t double, d double").select(intervals.t_two_sided("t", "d")).first()[0]
    assert math.isclose(p, 0.05, abs_tol=1e-4)


def test_first_object(spark):
    assert col(spark, 'say {"a": "}\\"", "b": {"c": 1}} and {"d": 2}', jsonx.first_object) == '{"a": "}\\"", "b": {"c": 1}}'
    assert col(spark, "{ never closed", jsonx.first_object) is None
    assert col(spark, '```json\n{"k": 3}\n```', lambda c: jsonx.parsed(c, "k INT")["k"]) == 3
    assert col(spark, '{"k": 3} {"k": 4}', lambda c: jsonx.parsed(c, "k INT")["k"]) is None


def test_choice_order_matters(spark):
    names = ["likely_match", "unlikely_match"]
    assert col(spark, "rather unlikely match", lambda c: jsonx.canonical_choice(c, names, "none")) == "likely_match"
    assert col(spark, "Unlikely Match", lambda c: jsonx.canonical_choice(c, names, "none")) == "unlikely_match"
    assert col(spark, None, lambda c: jsonx.canonical_choice(c, names, "none")) == "none"


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "d d d d")], "doc_id long, text string")
    topics = spark.createDataFrame([(7, "b b c")], "query_id long, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25(docs, topics).collect()}
    idf = math.log(2.5 / 1.5)
    b = 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 3))
    c = idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 3))
    assert got == pytest.approx({1: b, 2: c}, abs=1e-6)


def test_metric_families_differ(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, doc_id long, rank int")
    q = spark.createDataFrame([(1, 11, 2), (1, 99, 1)], "query_id long, doc_id long, rel int")
    within = ireval.run_metrics(ireval.graded(run, q), 2).first()
    judged = ireval.judged_metrics(run, q, 2).first()
    assert within.recall == 1.0 and judged.recall == 0.5
    assert within.ndcg == pytest.approx(1 / math.log2(3), abs=1e-6)
    none = ireval.run_metrics(run.withColumn("rel", F.lit(0)), 2).first()
    assert (none.ndcg, none.recall) == (0, 0)


def test_signals_of_single_group_and_empty_pool(spark):
    rows = spark.createDataFrame([(1, 5, 1, 2.0), (1, 5, 2, 1.0)], "query_id long, doc_id long, rank int, cross double")
    s = E.selector_signals(E.group_scores(rows))
    cases = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r.query_id: r for r in E.with_empty_pools(cases, s).collect()}
    assert got[1].dominance > 1e5 and got[1].share == 1
    assert (got[2].dominance, got[2].best_rank, got[2].n_groups, got[2].selected) == (0, 999, 0, None)


def test_single_group_is_the_same_in_any_order_of_rows(spark):
    """1/2 + 1/3 + 1/6 is 1 or a little less, by the order of adding; another group has 1/1."""
    rows = [(1, 7, 2), (1, 7, 3), (1, 7, 6), (1, 8, 1)]
    got = []
    for order in ((0, 1, 2, 3), (2, 1, 0, 3), (3, 2, 0, 1)):
        df = spark.createDataFrame([rows[i] for i in order], "query_id long, doc_id long, rank int").coalesce(1)
        got.append([tuple(r) for r in E.single_group(df).collect()])
    assert got[0] == got[1] == got[2]
    assert got[0][0][1] == 8 and got[0][0][3:] == (1, 2, "abstain", 1)


def test_pareto_keeps_ties(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.5, 0.1), (3, 0.4, 0.1), (4, 0.6, 0.2), (5, 0.6, 0.3)], "i int, f1 double, bad double")
    assert sorted(r.i for r in sweep.pareto(pts, "f1", "bad").collect()) == [1, 2, 4]


def test_leaks(spark):
    vocab = spark.createDataFrame([("NCT00000001", ["osteoporosis", "raloxifene"]), ("NCT00000002", ["pembrolizumab"])], "doc_id string, tokens array<string>")
    texts = [("a", "see nct00000002"), ("b", "on pembrolizumab now"), ("c", "on raloxifene now")]
    answers = spark.createDataFrame([(k, t, "NCT00000001", ["NCT00000001", "NCT00000002"]) for k, t in texts], "case string, answer string, own string, pool array<string>")
    narrow = {r[0]: r[1] for r in answers.select("case", G.narrow_leaks(F.col("answer"), F.col("own"), r"(?i)NCT\d{8}")).collect()}
    wide = {r.case: r.wide for r in G.wide_leaks(answers, vocab, "case").collect()}
    assert narrow == {"a": 1, "b": 0, "c": 0} and wide == {"a": 0, "b": 1, "c": 0}


def test_redaction_drops_only_the_foreign_sentence(spark):
    answers = spark.createDataFrame([(1, "The apple is red. The pear is green.")], "case int, body string")
    pool = spark.createDataFrame([(1, "o", "o", "the apple is red", 1), (1, "x", "o", "the pear is green", 2)], "case int, grp string, sel string, text string, rank int")
    claims = R.scored(R.extracted(answers, "case", ["body"], "-"), R.premises(pool, "case", "grp", "sel", "text", "rank"), "case")
    assert R.rebuilt(claims, "case", 0.9, "-").first().text == "The apple is red."
    alone = R.scored(R.extracted(answers, "case", ["body"], "-"), R.premises(pool.where("grp = 'o'"), "case", "grp", "sel", "text", "rank"), "case")
    assert R.rebuilt(alone, "case", 0.9, "-").first().n_dropped == 0
    assert R.calibrated(claims, [0.5, 0.9], most=0.6).first().threshold == 0.9
    assert R.calibrated(claims, [0.5, 0.9], most=0.1).first().threshold == 0.5


def test_citation_rules(spark):
    rows = spark.createDataFrame([("Risk is low", [1, 9]), ("", [1]), ("Risk", []), ("none", [])], "claim string, s array<int>")
    c = G.corrected(F.col("claim"), F.col("s"), F.array(F.lit(1), F.lit(2)), "none", ["risk"])
    got = [(r.c.claim, r.c.supports, r.c.change) for r in rows.select(c.alias("c")).collect()]
    assert got == [("Risk is low", [1], "dropped supports"), ("none", [], "missing claim"), ("none", [], "no supports"), ("none", [], "")]


def test_kappa_of_labels_used_by_one(spark):
    p = spark.createDataFrame([(1, 1), (1, 3), (5, 5), (5, 5)], "a int, b int")
    assert A.kappa(p).first().kappa == pytest.approx(1 - (1 / 4) / (1 - (2 * 1 + 2 * 2) / 16), abs=1e-6)
    same = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert A.kappa(same).first().kappa is None


def test_icc_perfect_and_alpha_missing(spark):
    p = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (4.0, 4.0)], "a double, b double")
    assert A.icc_two_way(p).first().icc == 1.0 and A.icc_simple(p).first().icc == 1.0
    v = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 3.0), (2, 3.0), (3, None), (3, 5.0)], "u int, x double")
    assert A.krippendorff(v, "u", "x").first().alpha == 1.0


def test_spearman_short_is_null(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a int, b int")
    assert A.spearman(p).first().rho is None
    assert A.spearman(p.union(spark.createDataFrame([(5, 6)], "a int, b int"))).first().rho == 1.0


def test_bin_edges(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.6, 0.7, 1.0)], "p double")
    assert [r[0] for r in rows.select(C.bin_of(F.col("p"))).collect()] == [0, 2, 5, 6, 9]


def test_brier_without_both_classes(spark):
    rows = spark.createDataFrame([(0.2, 1), (0.4, 1)], "p double, y int")
    assert C.brier(rows, F.col("p"), F.col("y")).first().skill is None


def test_passage_ids(spark):
    docs = spark.createDataFrame([(1, "x " * 50 + ". " + "y " * 50)], "doc_id long, text string")
    got = corpus.passages(docs, ["text"], most=110, least=20).collect()
    assert [r.passage_id for r in got] == ["1::text::0", "1::text::1"] and all(len(r.passage_text) <= 110 for r in got)


def test_resume_and_compaction(spark, tmp_path):
    work = spark.createDataFrame([(1,), (2,), (3,)], "k int").withColumn("error", F.when(F.col("k") == 2, "x"))
    log = str(tmp_path / "log")
    sinks.append_new(work, None, log, ["k"])
    back = spark.read.schema("k int, error string").json(log)
    assert [r.k for r in sampling.to_do(work, back, ["k"], F.col("error").isNotNull()).collect()] == [2]
    tolerant = readers.jsonl_tolerant(spark, log, "k INT")
    assert sorted(r.k for r in tolerant.collect()) == [1, 3]


def test_readers(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "case_1.json").write_text(json.dumps({"a": 1}))
    (tmp_path / "b" / "case_2.json").write_text("{ broken")
    got = readers.path_parts(readers.json_directory(spark, str(tmp_path), "a INT"), "model", "case").collect()
    assert [(r.a, r.model, r.case) for r in got] == [(1, "b", "case_1")]
    (tmp_path / "t.csv").write_text('id,text\n1,"two\nlines ""quoted"""\n2,\n')
    rows = readers.csv(spark, str(tmp_path / "t.csv"), "id INT, text STRING").collect()
    assert rows[0].text == 'two\nlines "quoted"' and rows[1].text is None
    assert [r.id for r in readers.csv_strings(spark, str(tmp_path / "t.csv")).collect()] == ["1", "2"]
    assert readers.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "t.csv")]).endswith("t.csv")
    assert readers.checksums(spark, str(tmp_path), ["/b/"]).count() == 1
    assert readers.config(spark, str(tmp_path / "b" / "case_1.json")) == {"a": 1}
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n\n{"a": 2, "error": "x"}\n')
    assert [r.a for r in readers.jsonl_tolerant(spark, str(tmp_path / "bad.jsonl"), "a INT").collect()] == [1]
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, str(tmp_path / "bad.jsonl"), "a INT").collect()


def test_quota_sample_fills_up(spark):
    rows = spark.range(100).withColumn("s", F.when(F.col("id") < 3, "rare").otherwise("common"))
    got = sampling.quotas(rows, "id", F.col("s"), {"rare": 5, "common": 4}, 12).collect()
    assert len(got) == 12 and sum(r.stratum == "rare" for r in got) == 3


def test_claims_and_premises_are_of_whole_texts(spark, tmp_path):
    from lodewell.plans import guards

    fill = " ".join(f"Filler sentence number {i} stands here." for i in range(40))
    spark.createDataFrame([(1, fill + " The last claim is here.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = guards.claim_extract(spark, str(tmp_path)).collect()
    assert len(got) == 41 and hashlib.md5(b"The last claim is here.").hexdigest() in {r.digest for r in got}
    turns = [(1, 0, "user", "Hello."), (1, 1, "assistant", "Zebras graze quietly. Hello."), (1, 2, "assistant", "Zebras graze."), (2, 0, "user", fill + " Zebras graze quietly."), (2, 1, "assistant", "Hello.")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    scored = R.scored(*guards._claims_and_evidence(spark, str(tmp_path)), "conv_id").collect()
    got = {(r.conv_id, r.turn, r.claim): (r.e_own, r.e_other) for r in scored}
    assert got == {(1, 1, "Zebras graze quietly."): (0.0, 1.0), (1, 1, "Hello."): (1.0, 0.0), (1, 2, "Zebras graze."): (0.0, 1.0), (2, 1, "Hello."): (0.0, 0.0)}
    kept = {(r.conv_id, r.turn): r.n_dropped for r in guards.claim_redact(spark, str(tmp_path)).collect()}
    assert kept == {(1, 1): 1, (1, 2): 1, (2, 1): 0}


def test_folds_of_one_class_are_skipped(spark):
    rows = [(i, float(i % 13), int(i % 13 > 6)) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, x double, y int")
    scores = C.cross_validated(d, ["x"], "y", "id")
    assert C.fold_summary(scores).first().folds == 5 and scores.agg({"brier": "max"}).first()[0] < 0.1
    lone = d.withColumn("y", (F.col("id") == 5).cast("int"))
    assert C.cross_validated(lone, ["x"], "y", "id").count() == 0


def test_leak_summary_has_exact_intervals(spark):
    d = spark.createDataFrame([("b", i < 3) for i in range(12)], "system string, narrow boolean")
    r = G.leak_summary(d, ["system"], ["narrow"]).first()
    assert (r.n, r.narrow_rate, r.narrow_lo, r.narrow_hi) == (12, 0.25, 0.0549, 0.5719)


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from lodewell.shared import shared_dir

    nothing = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: nothing))
    with pytest.raises(RuntimeError):
        shared_dir(cluster)


def test_scores_by_model_are_those_by_column(spark):
    from lodewell.functions.scoring import batch_scorer
    from lodewell.plans.casework import _shared_terms

    claims = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "x"), (2, 0, "q r")], "case_id int, position int, claim string")
    pool = spark.createDataFrame([(1, ["a b", "c d e"], ["x y"]), (3, [], None)], "case_id int, own array<string>, other array<string>")
    plain = {tuple(r) for r in R.scored(claims, pool, "case_id").collect()}
    model = batch_scorer(lambda: lambda premises, hypotheses: _shared_terms(hypotheses, premises))
    assert {tuple(r) for r in R.scored_by_model(claims, pool, "case_id", model).collect()} == plain


def test_tokens_are_found_inside_longer_words(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abc", k=n))
    tokens = {word(rng.randrange(5, 9)) for _ in range(120)}
    words = {word(rng.randrange(1, 14)) for _ in range(400)} | {"x" + t + "y" for t in list(tokens)[:20]} | {"é" * 3 + t for t in list(tokens)[:5]} | {"z" * 40}
    got = {tuple(r) for r in substrings.held_tokens(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    assert got == {(w, t) for w in words for t in tokens if t in w} and len(got) > 30


def test_wide_leaks_over_all_documents(spark):
    """Substrings count, one's own tokens don't, and the narrow rule is enough alone."""
    vocabulary = spark.createDataFrame([(1, ["aspirin", "warfarin"]), (2, ["heparin"]), (3, ["statin"])], "doc_id long, tokens array<string>")
    rows = [(1, 1, "took Aspirin", 0), (2, 1, "no PreHeparins here", 0), (3, 2, "aspirine", 0), (4, 2, "heparin and warfar in", 0), (5, 3, "nothing", 1), (6, None, "heparin", 0), (7, 3, "statin (warfarin).", 0), (8, 2, None, 0)]
    a = spark.createDataFrame(rows, "case int, own long, answer string, n int")
    got = {r.case: (r.narrow, r.wide) for r in G.leak_flags(a, vocabulary, "case", F.col("n")).collect()}
    assert {c for c, (_, w) in got.items() if w} == {2, 3, 5, 7} and {c for c, (n, _) in got.items() if n} == {5} and len(got) == 8


def test_no_answer_meets_the_whole_vocabulary(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    vocabulary = spark.createDataFrame([(1, ["aspirin"])], "doc_id long, tokens array<string>")
    a = spark.createDataFrame([(1, 1, "x", 0)], "case int, own long, answer string, n int")
    assert "NestedLoop" not in plan(G.leak_flags(a, vocabulary, "case", F.col("n"))) and "Cartesian" not in plan(G.leak_flags(a, vocabulary, "case", F.col("n")))


def _corpus(spark, rng):
    rare = [f"rare{i}" for i in range(300)]
    docs = [(i, " ".join(["the", "of", "and"] * rng.randrange(1, 6) + rng.choices(rare, k=rng.randrange(0, 12)))) for i in range(800)]
    asked = [(i, " ".join(["the", "of", "and", *rng.choices(rare, k=4)])) for i in range(12)] + [(90, "the of"), (91, "unheard"), (92, ""), (93, "rare1 rare1 the")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")


def test_pruned_search_gives_the_rows_of_the_full_ranking(spark, monkeypatch):
    docs, asked = _corpus(spark, random.Random(8))
    ix = retrieval.index(docs, asked)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())
    for k in (1, 5, 1000):
        want = rows(retrieval.search(ix).where(F.col("rank") <= k))
        monkeypatch.setattr(retrieval, "PRUNE_FROM", 0)
        assert rows(retrieval.search(ix, k)) == want
        monkeypatch.undo()


def test_pruning_scores_a_tenth_of_the_hits(spark):
    """Words of every document, which most hits come from, are not met at all."""
    docs, asked = _corpus(spark, random.Random(9))
    scoring = retrieval._Scoring(retrieval.index(docs, asked.where("query_id < 90")), "text", 1.5, 0.75)
    pairs, need = scoring.pruned(3)
    everything = scoring.hits(scoring.asks).count()
    assert 10 * scoring.hits(need).count() < everything and 10 * pairs.count() < everything


def test_search_scores_outright_where_bounds_leave_most_hits(spark, monkeypatch):
    """A topic of words of like weight: contenders would be nearly all documents; scoring is dealt by hits."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(12) if (i >> j % 6) & 1 or i % 12 == j)) for i in range(64)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, " ".join(f"w{j}" for j in range(12)))], "query_id long, text string")
    ix = retrieval.index(docs, asked, epsilon=-0.25)
    want = [tuple(r) for r in retrieval.search(ix).where("rank <= 5").orderBy("rank").collect()]
    monkeypatch.setattr(retrieval, "PRUNE_FROM", 0)
    monkeypatch.setattr(retrieval._Scoring, "full", lambda self, pairs: self.hits(self.asks) if "score" in pairs.columns else 1 / 0)
    assert [tuple(r) for r in retrieval.search(ix, 5).orderBy("rank").collect()] == want and len(want) == 5
    monkeypatch.setattr(retrieval, "HITS_OF_A_TASK", 50)
    assert retrieval._Scoring(ix, "text", 1.5, 0.75).parts.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("cells", [retrieval.CELLS, 40])
def test_few_asked_terms_are_scored_in_arrays(spark, monkeypatch, cells):
    """No hit is a row of a join; ranks, ties at the k-th place included, are those of the joins, and counts those of plain loops."""
    docs, asked = _corpus(spark, random.Random(11))
    docs = docs.unionByName(spark.createDataFrame([(900 + i, "The RARE1, rare2!") for i in range(40)] + [(1000, None), (1001, "")], docs.schema))
    monkeypatch.setattr(retrieval, "TERMS_OF_A_TASK", 20)
    monkeypatch.setattr(retrieval, "CELLS", cells)
    ix = retrieval.index(docs, asked)
    scoring = retrieval._Scoring(ix, "text", 1.5, 0.75)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())
    joined = retrieval.ranked(scoring.hits(scoring.asks).withColumn("score", F.round("score", 6)), ["query_id"], [F.desc("score"), F.asc("doc_id")])
    want = rows(joined)
    texts = {r.doc_id: re.findall("[a-z0-9]+", (r.text or "").lower()) for r in docs.collect()}
    for r in ix.asked.collect():
        assert r.n == sum(r.term in t for t in texts.values())
    assert ix.lengths["text"] == sum(map(len, texts.values())) / len(texts)
    monkeypatch.setattr(retrieval._Scoring, "hits", lambda self, asks: 1 / 0)
    assert rows(retrieval.search(ix)) == want
    for k in (1, 7, 50):
        assert rows(retrieval.search(ix, k)) == [r for r in want if r[3] <= k]


def test_rows_of_one_key_are_scored_together(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "b b"), (1, "a a c"), (2, "c c"), (None, "a")], "doc_id long, text string")
    ix = retrieval.index(d, spark.createDataFrame([(1, "a c")], "query_id long, text string"))
    got = {(r.doc_id, r.dl): {e.term: e.tf for e in r.entries} for r in ix.rows.collect()}
    assert got == {(1, 2): {"a": 1.0}, (1, 3): {"a": 2.0, "c": 1.0}, (2, 2): {"c": 2.0}, (None, 1): {"a": 1.0}}
    assert not retrieval._Scoring(ix, "text", 1.5, 0.75).arrays() and retrieval.search(ix).count() == 3
    d = spark.createDataFrame([(1, "a b"), (1, "a a")], d.schema)
    assert [e.tf for r in retrieval.index(d, spark.createDataFrame([(1, "a")], "query_id long, text string")).rows.collect() for e in r.entries] == [3.0]


def test_fields_have_their_own_statistics(spark):
    d = spark.createDataFrame([(1, "a b", "b"), (2, "b c", "c c"), (3, "c", None)], "doc_id long, text string, title string")
    q = spark.createDataFrame([(1, "a c")], "query_id long, text string")
    ix = retrieval.index(d, q, {"all": "text", "title": "title"})
    assert ix.lengths == {"all": 5 / 3, "title": 1.0}
    alone = lambda c: [tuple(r) for r in retrieval.bm25(d, q, text=c).collect()]
    assert [tuple(r) for r in retrieval.search(ix, field="title").collect()] == alone("title") and [tuple(r) for r in retrieval.search(ix, field="all").collect()] == alone("text")


def test_dense_search_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(300 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(30)] + [(-1, [1.0] * 6), (400, None), (401, [None] * 6), (402, [float("nan")] * 6), (403, [0.0] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    unit = {i: [x / (math.sqrt(sum(y * y for y in e)) or 1.0) for x in e] for i, e in rows if e and i >= 0 and None not in e and e[0] == e[0]}
    want = set()
    for q in [i for i in unit if i % 50 == 0]:
        best = sorted((-round(sum(a * b for a, b in zip(unit[q], u, strict=True)), 6), i) for i, u in unit.items())[:7]
        want |= {(q, i, -s + 0.0, n + 1) for n, (s, i) in enumerate(best)}
    for block in (10_000, 2):
        monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", block)
        got = {tuple(r) for r in retrieval.dense_top(v, v.where("vec_id % 50 = 0"), 7).collect()}
        assert got == want


def test_shared_judgements_equal_copied_ones(spark):
    run = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 3, 1), (3, 9, 1)], "query_id long, doc_id long, rank int")
    shared = spark.createDataFrame([(1, 2), (2, 0), (3, 1), (4, 1)], "doc_id long, rel int")
    copied = shared.withColumn("query_id", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ireval.judged_metrics(run, shared, 10)) == rows(ireval.judged_metrics(run, copied, 10))
    assert rows(ireval.recall_ceiling(run, shared, run)) == rows(ireval.recall_ceiling(run, copied))


def one_task(df):
    return "SinglePartition" in df._jdf.queryExecution().toString()


def test_positions_and_running_values(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(50), rng.choice([None, 1.5, -2.0, 4.0])) for i in range(500)]
    d = spark.createDataFrame(rows, "id int, v int, x double").repartition(7)
    p = positions.positioned(d, [F.desc("v"), "id"])
    assert not one_task(p)
    assert [r.id for r in p.orderBy("position").collect()] == [i for i, _, _ in sorted(rows, key=lambda r: (-r[1], r[0]))] and p.agg(F.max("position")).first()[0] == 500
    up, before = positions.running(d, ["v", "id"], "x", "s"), positions.running(d, ["v", "id"], "x", "m", "max", own=False)
    assert not one_task(up) and not one_task(before)
    total, most, want = None, None, {}
    for i, _, x in sorted(rows, key=lambda r: (r[1], r[0])):
        m = most
        if x is not None:
            total, most = (total or 0) + x, x if most is None else max(most, x)
        want[i] = (total, m)
    assert {r.id: r.s for r in up.collect()} == {i: s for i, (s, _) in want.items()} and {r.id: r.m for r in before.collect()} == {i: m for i, (_, m) in want.items()}
    assert positions.positioned(d.limit(0), ["id"]).count() == 0 and positions.running(d.limit(0), ["id"], "x", "s").count() == 0


def test_front_of_a_million_values(spark):
    """A front that no task holds: every point is on it, but those that others pass."""
    n = 1_000_000
    d = spark.range(n).select(F.col("id").alias("down"), F.when(F.col("id") % 100 == 7, F.col("id") - 50).otherwise(F.col("id")).alias("up"), F.lit("x").alias("other"))
    front = sweep.pareto(d, "up", "down")
    assert not one_task(front) and front.count() == n - n // 100
    assert sweep.pareto(d.limit(0), "up", "down").count() == 0


def test_draws_take_rows_as_poisson(spark):
    w = resample.draws_of(np.arange(1, 2001), np.arange(500), 42)
    share = np.bincount(w.ravel(), minlength=6)[:6] / w.size
    assert all(abs(s - math.exp(-1) / math.factorial(k)) < 0.002 for k, s in enumerate(share))
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]) < 0.01


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = [(i, float(i % 7), None if i % 5 else float(i)) for i in range(300)]
    d = spark.createDataFrame(rows, "id int, a double, b double")
    got = [sorted(map(tuple, resample.bootstrap(d.repartition(n), "id", ["a", "b"], 400).collect())) for n in (1, 9)]
    assert got[0] == got[1]
    (m, n, mean, lo, hi), (_, nb, *_rest) = got[0]
    assert (m, n, nb) == ("a", 300, 60) and lo < mean < hi and abs((hi - lo) / 2 - 1.96 * 2 / math.sqrt(300)) < 0.06
