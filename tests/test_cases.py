"""Prompts, candidates, wide rows, coverage and headlines: edge cases by hand."""

import pytest
from pyspark.sql import functions as F

from lodewell.functions import text as T
from lodewell.functions.intervals import exact_bounds
from lodewell.operators import agreement as A, cases as K

PASSAGES = "doc_id string, passage_id string, section string, passage_text string"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture
def pool(spark):
    p = [("a", "a1", "other", "a other"), ("a", "a2", "eligibility", "a fit"), ("b", "b1", "summary", "b sum"), ("b", "b2", "brief_summary", " b brief "), ("b", "b3", None, "b null"), ("d", "d1", "eligibility", None)]
    return spark.createDataFrame(p, PASSAGES)


def test_lookup_orders_sections_and_shortens(spark, pool):
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "doc_id string")
    assert rows(K.looked_up(asked, pool, 2, most=3), "doc_id") == [("a", ["a f…", "a o…"]), ("b", ["b s…", "b b…"])]
    assert K.looked_up(asked.limit(0), pool, 2).count() == 0


def test_candidates_take_scored_rows_or_the_run(spark, pool):
    selected = spark.createDataFrame([(1, "A"), (2, "a"), (3, "zz"), (4, None)], "query_id long, selected string")
    scored = spark.createDataFrame([(1, "a", "a1", 9.0, "a other"), (1, "b", "b3", 2.0, "b null"), (1, "b", "b1", 5.0, "b sum"), (1, "c", "c9", 5.0, "c own"), (2, "a", "a1", 1.0, "a other")], "query_id long, doc_id string, passage_id string, score double, passage_text string")
    run = spark.createDataFrame([(1, "d", 1), (2, "b", 1), (3, "c", 1), (3, "b", 2), (3, "a", 3), (4, "a", 1)], "query_id long, doc_id string, rank int")
    got = rows(K.candidates(selected, scored, run, pool, groups=2), "query_id", "position")
    assert got == [
        (1, 1, "b", "scored", ["b sum"]),  # its best row's passage is the one looked up first
        (1, 2, "c", "scored", ["c own"]),  # no passages to look up
        (3, 2, "b", "run", ["b sum", "b brief"]),  # c, the first, has none and isn't replaced; 2 has only the selected one's rows
        (4, 1, "a", "run", ["a fit", "a other"]),  # nothing selected
    ]
    assert K.candidates(selected, scored.limit(0), run.limit(0), pool).count() == 0


def test_prompts_name_what_is_empty(spark):
    cases = spark.createDataFrame([(1, "x", " ", "{n} braces"), (2, "y", "own", None)], "query_id long, selected string, own string, answer string")
    found = spark.createDataFrame([(2, 2, "c", ["p"]), (2, 1, "b", ["q", "r"])], "query_id long, position int, doc_id string, passages array<string>")
    got = rows(K.prompts(cases, found, "{selected}|{own}|{n}|{candidates}|{answer}", "#", "none"), "query_id")
    assert got == [(1, 0, "x|(empty)|0|none|{n} braces"), (2, 2, "y|own|2|# b\n- q\n- r\n\n# c\n- p\n|(empty)")]


def test_templates_and_tails(spark):
    df = spark.createDataFrame([("It hurts. Am I in?",), ("No tail",), (None,)], "q string")
    out = df.select(K.retold(F.col("q"), "Am I in?", F.lit("What now?")).alias("r"), K.filled("<{q}>", q=F.col("q")).alias("t"))
    assert [tuple(r) for r in out.collect()] == [("It hurts. What now?", "<It hurts. Am I in?>"), ("No tail What now?", "<No tail>"), (None, "<>")]


def test_packed_lines_are_never_empty(spark):
    df = spark.createDataFrame([(0, ["aa", " ", None, "bbb ", "c"]), (1, []), (2, None), (3, ["x" * 9, "y"]), (4, ["aa", "bbb", "ccc"])], "i int, p array<string>")
    got = dict(df.select("i", T.packed_lines(F.col("p"), 6)).collect())
    assert got == {0: ["aa\nbbb", "c"], 1: [""], 2: [""], 3: ["x" * 9, "y"], 4: ["aa\nbbb", "ccc"]}


def test_wide_record_keeps_cases_without_parts(spark):
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")
    part = spark.createDataFrame([(1, '{"status": "ok", "why": {"text": "so"}, "miss": ["a", "b"]}')], "case_id long, j string").select("case_id", F.from_json("j", "status STRING, why STRUCT<text: STRING>, miss ARRAY<STRING>").alias("body"))
    got = rows(K.wide_record(cases, {"one": part}, {"status": "one.status"}, {"why": "one.why"}, {"miss": "one.miss"}), "case_id")
    assert got == [(1, "ok", "so", "a ; b"), (2, "", "", "")]


def test_rebuilt_summary(spark):
    df = spark.createDataFrame([("a", None, ["x ", "NONE", ""]), ("None", " None ", None), (None, " b", [])], "p string, q string, u array<string>")
    got = [r[0] for r in df.select(K.rebuilt_summary({"P": F.col("p"), "Q": F.col("q")}, F.col("u"), "None")).collect()]
    assert got == ["P: a What is still unclear: x", "None", "Q: b"]


def test_flag_quality(spark):
    df = spark.createDataFrame([(True, True), (True, False), (None, True), (False, None)], "p boolean, g boolean")
    assert rows(K.flag_quality(df, F.col("p"), F.col("g"))) == [(4, 1, 1, 1, 1, 0.5, 0.5)]
    assert rows(K.flag_quality(df.limit(0), F.col("p"), F.col("g"))) == [(0, 0, 0, 0, 0, 0.0, 0.0)]


def test_missed_utility(spark):
    cases = spark.createDataFrame([(1, "no", "a", None), (2, "no", "b", True), (3, "no", None, False), (4, "yes", "a", False)], "query_id long, status string, gold string, relevant boolean")
    pool = spark.createDataFrame([(1, "a"), (1, "a"), (3, None), (4, "b")], "query_id long, doc_id string")
    got = rows(K.missed_utility(cases, pool), "status")
    assert [r[:7] for r in got] == [("no", 3, 2, 1, 2, 1, 0.666667), ("yes", 1, 1, 0, 0, 1, 0.0)]
    assert got[0][7:] == pytest.approx(exact_bounds(2, 3)) and got[1][7:] == pytest.approx(exact_bounds(0, 1))


def test_coverage(spark):
    run = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c")], "query_id long, doc_id string")
    texts = spark.createDataFrame([("a", "four"), ("b", "")], "doc_id string, text string")
    judged = spark.createDataFrame([("a",), ("a",), ("z",)], "doc_id string")
    assert rows(K.coverage(run, texts, judged)) == [(4, 3, 1, 1, 2, 2.0)]


def test_headline(spark):
    df = spark.createDataFrame([("m", "x", 1.0), ("m", "x", 2.0), ("m", "y", None), ("n", "y", 4.0)], "by string, dim string, v double")
    assert rows(K.headline(df, "by", "dim", "v"), "by") == [("m", 3, 1.5, {"x": 1.5, "y": None}), ("n", 1, 4.0, {"y": 4.0})]


def test_draw_in_turn_goes_on_when_a_stratum_ends(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("b", 4)], "s string, k int")
    assert rows(K.ranked_in_turn(df, "s", [F.col("k")], 3).select("k", "place"), "place") == [(1, 1), (2, 2), (3, 3)]


def test_dimensions_by_least_and_greatest(spark):
    sheet = spark.createDataFrame([("yes", "no"), ("?", "partial"), (None, None)], "topic_relevance string, eligibility_overstatement string")
    for how, want in {"mean": [3.0, 3.0, None], "min": [1.0, 3.0, None], "max": [5.0, 3.0, None]}.items():
        assert [r[0] for r in sheet.select(A.judged_dimensions(sheet, how)["factuality"]).collect()] == want


def test_passages_are_cut_of_found_documents_only(spark, tmp_path):
    """Twenty documents of a topic's run are cut, however many there are."""
    from lodewell.plans import cases

    text = " ".join(f"Sentence {i} speaks of apples and of pears at some length." for i in range(4))
    spark.createDataFrame([(i, text) for i in range(60)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, "apples pears")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    _, found, p = cases._found(spark, str(tmp_path))
    assert p.select("doc_id").distinct().count() == 20 and found.count() == 4
