import json

from pyspark.sql import functions as F

from sparkloom.streaming import events as ev
from sparkloom.streaming import state


def payload(**change):
    base = {"action": "opened", "pull_request": {"number": 7, "draft": False, "head": {"sha": "abc"}}, "repository": {"full_name": "o/r", "clone_url": "https://host/o/r"}}
    return json.dumps(base | change)


def test_filter_chain(spark):
    rows = [("pull_request", payload()), ("ping", payload()), ("pull_request", payload(action="closed")), ("pull_request", payload(pull_request={"number": 7, "draft": True, "head": {"sha": "abc"}})), ("pull_request", payload(repository={"full_name": "o/r"})), ("pull_request", "{broken")]
    got = ev.accepted(spark.createDataFrame(rows, "kind string, payload string")).collect()
    assert [(r["number"], r["sha"], r["repo"]) for r in got] == [(7, "abc", "o/r")]


def test_stream_equals_batch(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    stream = ev.by_window(ev.read_events(spark, data, schema, "events.parquet"), "event_type", "value")
    batch = ev.by_window(spark.read.parquet(f"{data}/events.parquet"), "event_type", "value")
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["events"]) for r in df.collect())
    assert key(ev.drain(stream, str(tmp_path), "complete")) == key(batch)


def test_sessions(spark, data):
    got = ev.sessions(spark.read.parquet(f"{data}/events.parquet"), "user_id").agg(F.sum("events")).first()[0]
    assert got == spark.read.parquet(f"{data}/events.parquet").count()


def test_upsert_is_idempotent(spark, tmp_path):
    write = ev.upsert(str(tmp_path), ["k"], "v")
    write(spark.createDataFrame([(1, 1), (2, 5)], "k int, v int"), 0)
    write(spark.createDataFrame([(1, 3), (1, 2)], "k int, v int"), 1)
    write(spark.createDataFrame([(1, 3), (1, 2)], "k int, v int"), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/v1").collect()) == [(1, 3), (2, 5)]


def test_upsert_goes_on_with_a_new_checkpoint(spark, tmp_path):
    """A stream that begins anew counts its epochs from 0; what the table has stays, and old versions go."""
    path = str(tmp_path / "table")
    for values in ([(1, 1), (2, 5)], [(1, 3)], [(3, 1), (2, 4)]):
        ev.upsert(path, ["k"], "v")(spark.createDataFrame(values, "k int, v int"), 0)
    assert sorted(tuple(r) for r in ev.current(spark, path, "k int, v int").collect()) == [(1, 3), (2, 5), (3, 1)]
    assert ev.versions(spark, path) == [1, 2]


def test_state_does_not_depend_on_batches(spark, data, tmp_path):
    """The same events in one file and in five, one file a batch."""
    events = spark.read.parquet(f"{data}/events.parquet").where("event_type = 'purchase'").select("user_id", "event_id", "value", (F.col("value") > 20).alias("usable"))
    answers = []
    for files in (1, 5):
        folder = str(tmp_path / f"in{files}")
        events.repartitionByRange(files, "event_id").sortWithinPartitions("event_id").write.parquet(folder)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        rows = ev.drain(state.with_baseline(stream, "user_id", "value", "usable", ["event_id"]), str(tmp_path), "append")
        answers.append({(r["user_id"], r["event_id"]) for r in rows.collect()})
    assert answers[0] == answers[1] and len(answers[0]) == events.count()


def test_status_of_a_run(spark, tmp_path):
    rows = [("a", 1, "pending"), ("a", 2, "pending"), ("a", 3, "failure"), ("a", 4, "success"), ("b", 1, "success"), ("c", 1, "other"), ("c", 2, "pending")]
    spark.createDataFrame(rows, "run string, at int, said string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, at int, said string").parquet(str(tmp_path / "in"))
    got = ev.drain(state.status_changes(stream, "run", "said", ["at"]), str(tmp_path / "out"), "append").collect()
    assert sorted((r["run"], r["at"], r["was"] or "", r["became"]) for r in got) == [("a", 1, "", "pending"), ("a", 3, "pending", "failure"), ("b", 1, "", "pending"), ("b", 1, "pending", "success"), ("c", 2, "", "pending")]
