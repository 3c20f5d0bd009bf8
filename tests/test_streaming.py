"""Streaming jobs over several batches, stopped and started again, and with batches that come twice."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from factloom.operators.points import PointStore
from factloom.streaming.jobs import CONTENT, Debounced, Store, alerts, contents, drain, indexed, ingested, statuses


def source(spark, at, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at))


def put(spark, at, schema, *rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(at))


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


DOC = "doc_id long, text string"


def test_ingestion_goes_on_after_a_stop(spark, tmp_path):
    first, second = [(1, "a"), (2, "b\nc"), (3, None)], [(4, "a"), (5, "d"), (5, "d")]
    put(spark, tmp_path / "in", DOC, *first)
    once = ingested(source(spark, tmp_path / "in", DOC), str(tmp_path / "job"))
    assert once.count() == 2
    put(spark, tmp_path / "in", DOC, *second)
    again = found(ingested(source(spark, tmp_path / "in", DOC), str(tmp_path / "job")))
    assert len(again) == 3  # "a" isn't new in the second batch, though the job was stopped in between
    whole = found(ingested(source(spark, tmp_path / "in", DOC), str(tmp_path / "other")))
    assert again == whole
    store = Store(spark, str(tmp_path / "job/contents"), CONTENT, "content_id")
    batch = contents(spark.createDataFrame(second, DOC))
    assert found(store.add(batch, 1)) == found(store.add(batch, 1)) and store.seen().count() == 3  # a repeated batch adds nothing


def test_a_store_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "COMPACT", 3)
    store = Store(spark, str(tmp_path / "s"), "id long", "id")
    for n in range(9):
        store.add(spark.createDataFrame([(n,), (n // 2,)], "id long"), n)
    assert sorted(r["id"] for r in store.seen().collect()) == list(range(9))
    assert (tmp_path / "s/base").exists()
    assert store.add(spark.createDataFrame([(8,), (0,)], "id long"), 9).count() == 0
    assert [r["id"] for r in store.add(spark.createDataFrame([(8,), (7,)], "id long"), 8).collect()] == [8]  # batch 8 again


EVENT = "user_id long, event_type string, ts timestamp"


def test_statuses_end_by_timers_and_survive_a_stop(spark, tmp_path):
    day = lambda d, h=0: datetime(2024, 1, 1) + timedelta(days=d, hours=h)
    put(spark, tmp_path / "in", EVENT, (1, "a", day(0)), (1, "b", day(1)), (2, "a", day(1, 1)), (3, "z", day(0, 3)))
    at = str(tmp_path / "job")
    got = found(statuses(source(spark, tmp_path / "in", EVENT), at).select("user_id", "status", "ended"))
    assert got == [(1, "b", False), (2, "a", False), (3, "z", False)]
    put(spark, tmp_path / "in", EVENT, (1, "c", day(1, 5)), (2, "old", day(0, 20)), (4, "new", day(2, 6)))
    got = found(statuses(source(spark, tmp_path / "in", EVENT), at).select("user_id", "status", "ended"))
    assert got == [(1, "c", False), (2, "a", False), (3, "z", True), (4, "new", False)]  # an older event changes nothing; 3 ran out
    put(spark, tmp_path / "in", EVENT, (4, "newer", day(3)))
    got = found(statuses(source(spark, tmp_path / "in", EVENT), at).select("user_id", "status", "ended"))
    assert got == [(1, "c", True), (2, "a", True), (3, "z", True), (4, "newer", False)]


def test_an_index_follows_its_documents(spark, tmp_path):
    def run(at, store):
        return found(indexed(source(spark, tmp_path / "in", DOC), PointStore(spark, str(store)), str(at)))

    put(spark, tmp_path / "in", DOC, (1, "one"), (2, "two"))
    assert run(tmp_path / "job", tmp_path / "store") == [(1, 1, 1, 0), (2, 1, 1, 0)]
    put(spark, tmp_path / "in", DOC, (1, "one"), (2, "changed"), (3, "one"))
    want = [(1, 1, 1, 0), (2, 1, 1, 0), (2, 1, 1, 1), (3, 1, 0, 1)]
    assert run(tmp_path / "job", tmp_path / "store") == want
    assert run(tmp_path / "job2", tmp_path / "store2") == want
    texts = lambda at: found(PointStore(spark, str(at)).points().select("document_id", "text"))
    assert texts(tmp_path / "store") == texts(tmp_path / "store2") == [(1, "one"), (2, "changed"), (3, "one")]


TITLED = "doc_id long, title string"


def test_alerts_are_silent_at_first_and_once(spark, tmp_path):
    watches = spark.createDataFrame([(1, "Fox"), (2, "ox"), (3, ""), (4, "bird of")], "topic_id long, keyword string")
    known = spark.createDataFrame([(10,)], "doc_id long")
    put(spark, tmp_path / "in", TITLED, (10, "fox"), (11, "A FOX, a fox"), (12, None), (13, "x"))
    run = lambda: found(alerts(source(spark, tmp_path / "in", TITLED), watches, known, str(tmp_path / "job")))
    assert run() == [(11, 1, "fox"), (11, 2, "ox")]
    put(spark, tmp_path / "in", TITLED, (11, "fox again"), (14, "Bird of prey"))
    assert run() == [(11, 1, "fox"), (11, 2, "ox"), (14, 4, "bird of")]


def test_regrouping_waits_and_sees_all_facts(spark, tmp_path):
    now = [0.0]
    job = lambda: Debounced(Store(spark, str(tmp_path / "facts"), "id long, kind string", "id"), lambda facts: facts.groupBy("kind").count(), 30, lambda: now[0])
    batch = lambda *rows: spark.createDataFrame(rows, "id long, kind string")
    count = lambda: len(job()._runs())
    job().batch(batch((1, "x"), (2, "y")), 0)
    assert count() == 1
    now[0] = 10
    job().batch(batch((3, "x")), 1)
    assert count() == 1 and job().pending()  # too soon, and another process knows it as well
    now[0] = 40
    job().batch(batch((3, "x")), 2)
    assert count() == 2 and not job().pending()  # what waited is done, though this batch brought nothing new
    now[0] = 90
    job().batch(batch((3, "x")), 3)
    assert count() == 2  # nothing new since
    job().batch(batch((4, "y")), 4)
    job().batch(batch((5, "y")), 5)
    assert count() == 3 and {r["kind"]: r["count"] for r in job().finish().collect()} == {"x": 2, "y": 3} and count() == 4
    assert found(job().finish()) == [("x", 2), ("y", 3)] and count() == 4


def test_a_drained_stream_keeps_the_last_row_of_a_key(spark, tmp_path):
    put(spark, tmp_path / "in", "k long, v long", (1, 1), (2, 1))
    put(spark, tmp_path / "in", "k long, v long", (1, 5))
    total = lambda: source(spark, tmp_path / "in", "k long, v long").groupBy("k").agg(F.sum("v").alias("v"))
    assert found(drain(total(), "update", keys=("k",))) == [(1, 6), (2, 1)]
