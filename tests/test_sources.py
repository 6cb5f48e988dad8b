"""Collections read by file and in stretches, records written a file each, and logs compacted as streams."""

import json
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodewell.operators import calibration as C
from lodewell.plans import files
from lodewell.sources import collections, readers, vectors
from lodewell.streaming import logs


@pytest.mark.parametrize("split", [1, 7, 50, 1 << 20])
def test_every_line_is_read_once(tmp_path, monkeypatch, split):
    """Lines that begin before a stretch are the one before's, wherever the file is cut."""
    monkeypatch.setattr(collections, "SPLIT", split)
    rng = random.Random(split)
    (tmp_path / "queries" / "deep").mkdir(parents=True)
    texts = ["x" * rng.randrange(0, 40) + rng.choice(["", "é", "\t", "日本"]) for _ in range(60)]
    lines = [f"{i}\t{t}" for i, t in enumerate(texts)]
    (tmp_path / "queries" / "a.tsv").write_text("\n".join(lines[:30]), encoding="utf-8")
    (tmp_path / "queries" / "deep" / "b.tsv").write_text("\n\n" + "\n".join(lines[30:]) + "\n", encoding="utf-8")
    (tmp_path / "queries" / "_c").write_text("999\tnot read")
    (tmp_path / "queries" / "empty").write_text("")
    r = collections.RetrievalReader(collections.PARTS["queries"], f"file://{tmp_path}", "queries")
    got = [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
    assert sorted((x["query_id"], x["text"]) for x in got) == list(enumerate(texts))


def test_columns_and_parts(spark, tmp_path):
    collections.register(spark)
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels" / "q.txt").write_text("1 0 5 2\n1 0 6 0\n")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "d.jsonl").write_text('{"doc_id": 5, "text": "a", "other": 1}\n{"doc_id": 6}\n')
    load = lambda **o: spark.read.format("retrieval").options(path=f"file://{tmp_path}", **o).load()
    assert sorted(map(tuple, load(part="qrels").collect())) == [(1, 5, 2), (1, 6, 0)]
    assert sorted(map(tuple, load().collect())) == [(5, "a"), (6, None)]
    assert load(part="docs", columns="doc_id").columns == ["doc_id"] and load(part="qrels", columns="rel, doc_id").first().asDict() == {"rel": 2, "doc_id": 5}
    with pytest.raises(Exception, match="part is one of"):
        load(part="topics")


def test_records_are_files(spark, tmp_path):
    collections.register(spark)
    d = spark.createDataFrame([(i, f"m/{i % 2}", f"text {i}", [1, i]) for i in range(9)], "id int, model string, text string, xs array<int>").repartition(4)
    write = lambda df, mode: df.write.format("record-files").options(path=f"file://{tmp_path}/r", key="id", folders="model").mode(mode).save()
    write(d, "append")
    write(d, "append")  # the same files again
    names = sorted(str(p.relative_to(tmp_path / "r")) for p in (tmp_path / "r").rglob("*") if p.is_file() and not p.name.startswith("."))
    assert names == ["_SUCCESS", *sorted(f"model=m%2F{i % 2}/{i}.json" for i in range(9))] and not (tmp_path / "r" / "_jobs" / "x").exists()
    back = readers.path_parts(readers.json_directory(spark, f"{tmp_path}/r", "id int, text string, xs array<int>"), "folder", "stem")
    assert sorted((r.id, r.text, r.xs, r.folder, r.stem) for r in back.collect()) == [(i, f"text {i}", [1, i], f"model=m%2F{i % 2}", str(i)) for i in range(9)]
    write(d.where("id < 2"), "overwrite")
    assert len(list((tmp_path / "r").rglob("*.json"))) == 2


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    collections.register(spark)
    d = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, text string").coalesce(1)
    with pytest.raises(Exception, match="has no name"):
        d.write.format("record-files").options(path=f"file://{tmp_path}/r", key="id").mode("append").save()
    assert not (tmp_path / "r" / "_SUCCESS").exists()
    w = collections.RecordWriter(f"file://{tmp_path}/w", "id", [])
    from pyspark.sql import Row

    done = w.write(iter([Row(id=1, text="a"), Row(id=2, text="b")]))
    assert len(list((tmp_path / "w").glob("*.json"))) == 2
    w.abort([done, None])
    assert [p for p in (tmp_path / "w").rglob("*") if p.is_file()] == []


def test_configuration_bounds_orders(spark):
    got = {r.o_orderstatus: r.n for r in files.configuration(spark, "/root/testdata/sf0.001").collect()}
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    half = round(o.agg(F.max("o_totalprice").cast("double")).first()[0] / 2, 2)
    assert got == {r["o_orderstatus"]: r["count"] for r in o.where(F.col("o_totalprice") >= half).groupBy("o_orderstatus").count().collect()}


@pytest.mark.parametrize("highest", [499900.05, 499900.11, 499900.03, -3.05, None])
def test_configuration_rounds_halves_as_its_sql(spark, tmp_path, highest):
    """Half of an odd number of cents lies between two bounds; orders at either tell which was taken."""
    prices = [None] if highest is None else [highest, *(round(highest / 2 + d / 1000, 2) for d in (-15, -5, 5, 15) if highest > 0)]
    spark.createDataFrame([(i, "O", x) for i, x in enumerate(prices)], "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    query, sql = files.QUERIES["configuration"]
    want = duckdb.sql(sql.replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    assert [(r.o_orderstatus, r.n, r.name) for r in query(spark, str(tmp_path)).collect()] == want


def _run(spark, at, rows, **options):
    spark.createDataFrame(rows, "user long, event long, what string, ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(f"{at}/log")
    stream = logs.log_stream(spark, f"{at}/log", "user long, event long, what string, ts timestamp")
    logs.upserted(logs.latest(stream, "user", "ts", "event", **options), f"{at}/sink", f"{at}/state")
    return {r.user: r.what for r in logs.current(spark, f"{at}/sink", ["user"]).collect()}


def test_last_lines_of_a_growing_log(spark, tmp_path):
    """Later lines replace, earlier and null ones don't, ties go by the second order; a run without lines changes nothing."""
    from datetime import datetime as D

    day = lambda n: D(2024, 1, n)
    at = str(tmp_path)
    assert _run(spark, at, [(1, 1, "a", day(2)), (1, 2, "b", day(1)), (2, 3, "c", day(5)), (2, 4, "d", day(5)), (None, 5, "e", day(9)), (3, 6, "f", None)]) == {1: "a", 2: "d"}
    assert _run(spark, at, [(1, 7, "g", day(3)), (2, 2, "h", day(5)), (2, 8, "i", day(4)), (4, 9, "j", day(1))]) == {1: "g", 2: "d", 4: "j"}
    assert _run(spark, at, [(2, 10, "k", day(6)), (1, 1, "a", day(2))]) == {1: "g", 2: "k", 4: "j"}


def test_state_goes_by_a_timer_and_late_lines_are_not_looked_at(spark, tmp_path):
    from datetime import datetime as D

    at, options = str(tmp_path), {"late": "10 days", "keep_ms": 86_400_000}
    assert _run(spark, at, [(1, 1, "a", D(2024, 1, 1)), (2, 2, "z", D(2024, 3, 1))], **options) == {1: "a", 2: "z"}
    _run(spark, at, [(2, 3, "y", D(2024, 3, 2))], **options)  # the watermark has passed key 1's line
    assert _run(spark, at, [(1, 4, "late", D(2024, 1, 5)), (2, 5, "x", D(2024, 3, 3))], **options) == {1: "a", 2: "x"}


@pytest.mark.parametrize("c", [1.0, 0.05])
def test_folds_fitted_together_are_at_their_minima(spark, c):
    rng = random.Random(3)
    rows = [(i, rng.gauss(5, 2), rng.gauss(0, 30), 7.0, i % 3) for i in range(400)]
    rows = [(*r, float(rng.random() < 1 / (1 + np.exp(-(r[1] - 5) - r[2] / 30)))) for r in rows] + [(999, None, 1.0, 7.0, 0, 1.0)]
    d = spark.createDataFrame(rows, "id int, a double, b double, flat double, f int, y double").repartition(5)
    weights, mean, deviation = C.fitted(d, ["a", "b", "flat"], "y", "f", 3, c)
    for m in range(3):
        own = [r for r in rows if r[4] != m and r[1] is not None]
        x, y = np.array([r[1:4] for r in own]), np.array([r[5] for r in own])
        assert np.allclose(mean[m], x.mean(0)) and np.allclose(deviation[m][:2], x.std(0)[:2]) and deviation[m][2] == 1.0
        z = np.column_stack([(x - mean[m]) / deviation[m], np.ones(len(x))])
        gradient = z.T @ (y - 1 / (1 + np.exp(-z @ weights[m]))) - np.append(weights[m][:-1] / c, 0)
        assert np.abs(gradient).max() < 1e-7
    p = d.where("id = 0").select(C.probability(0, (weights, mean, deviation), ["a", "b", "flat"])).first()[0]
    z = np.append((np.array(rows[0][1:4]) - mean[0]) / deviation[0], 1.0)
    assert abs(p - 1 / (1 + np.exp(-z @ weights[0]))) < 1e-12


def test_json_of_a_record_file(spark, tmp_path):
    collections.register(spark)
    d = spark.createDataFrame([(1, (2, "x"), None)], "id int, s struct<a int, b string>, n double")
    d.write.format("record-files").options(path=f"file://{tmp_path}/r", key="id").mode("append").save()
    assert json.loads((tmp_path / "r" / "1.json").read_text()) == {"id": 1, "s": {"a": 2, "b": "x"}, "n": None}


def test_vectors_come_back_from_stretches(spark, tmp_path, monkeypatch):
    vectors.register(spark)
    at = f"file://{tmp_path}/v"
    df = spark.range(23).select((F.col("id") - 3).alias("k"), F.array(F.col("id") / 2, F.lit(-1.0)).cast("array<float>").alias("v"), F.lit("x").alias("note")).repartition(3)
    df.write.format("npy-vectors").option("key", "k").option("vector", "v").mode("overwrite").save(at)
    got = {r["vec_id"]: list(r["embedding"]) for r in spark.read.format("npy-vectors").load(at).collect()}
    assert got == {i - 3: [i / 2, -1.0] for i in range(23)}
    assert spark.read.format("npy-vectors").option("columns", "vec_id").load(at).agg(F.sum("vec_id")).first()[0] == sum(range(23)) - 69
    monkeypatch.setattr(vectors, "SPLIT", 24)
    monkeypatch.setattr(vectors, "BATCH", 2)
    reader = vectors.VectorReader(vectors.WHOLE, at)
    parts = reader.partitions()
    assert all(p.stop - p.start <= 3 for p in parts) and sum(p.stop - p.start for p in parts) == 23
    assert sorted(i for p in parts for b in reader.read(p) for i in b.column("vec_id").to_pylist()) == list(range(-3, 20))


def test_vectors_of_other_tools_and_faults(spark, tmp_path):
    vectors.register(spark)
    read = lambda: spark.read.format("npy-vectors").load(f"file://{tmp_path}")
    np.save(tmp_path / "a.ids.npy", np.arange(4, dtype=np.int32))
    np.save(tmp_path / "a.vectors.npy", np.ones((4, 3), dtype=np.float64))
    np.save(tmp_path / "_left.vectors.npy", np.ones((9, 3)))  # a task's that was lost
    assert [(r["vec_id"], list(r["embedding"])) for r in read().orderBy("vec_id").collect()] == [(i, [1.0] * 3) for i in range(4)]
    np.save(tmp_path / "a.ids.npy", np.arange(5))
    with pytest.raises(Exception, match="shape"):
        read().count()


def test_vectors_abort_leaves_nothing(spark, tmp_path):
    vectors.register(spark)
    w = vectors.VectorWriter(f"file://{tmp_path}/w", "k", "v")
    batch = lambda *v: pa.RecordBatch.from_pydict({"k": list(range(len(v))), "v": list(v)}, schema=pa.schema([("k", pa.int64()), ("v", pa.list_(pa.float32()))]))
    done = w.write(iter([batch([1.0, 2.0], [3.0, 4.0]), batch()]))
    assert vectors.VectorReader(vectors.WHOLE, f"file://{tmp_path}/w").partitions() == []
    w.abort([done, None])
    assert list((tmp_path / "w").iterdir()) == []
    for bad in ([None], [[1.0], [1.0, 2.0]], [[None]]):
        with pytest.raises(ValueError):
            w.write(iter([batch(*bad)]))
    empty = f"file://{tmp_path}/e"
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.format("npy-vectors").mode("append").save(empty)
    assert spark.read.format("npy-vectors").load(empty).count() == 0


def test_empty_parts_of_a_collection(spark, tmp_path):
    collections.register(spark)
    (tmp_path / "queries").mkdir()
    (tmp_path / "queries" / "none.tsv").write_text("")
    assert spark.read.format("retrieval").option("part", "queries").load(f"file://{tmp_path}").count() == 0
