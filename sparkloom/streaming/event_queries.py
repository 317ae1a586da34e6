"""Streaming queries over `events`, each run to the end of what is there; a batch answer is the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.session import working_folder
from sparkloom.streaming import events as ev
from sparkloom.streaming import state


def _stream(s, d):
    path = f"{d}/events.parquet"
    schema = s.read.parquet(path).schema
    return ev.read_events(s, d, schema, "events.parquet") if not path.startswith("viewfs") and _is_file(s, path) else ev.read_events(s, path, schema)


def _is_file(s, path: str) -> bool:
    jvm = s.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile()


def _drained(s, rows, mode="append"):
    return ev.drain(rows, working_folder(s), mode)


def stream_filter(s, d):
    """Purchases of some value, as a filtered stream."""
    return _drained(s, _stream(s, d).where((F.col("event_type") == "purchase") & (F.col("value") > 50)).select("event_id", "user_id", "value"))


def stream_windows(s, d):
    """Events and value per day and type."""
    out = _drained(s, ev.by_window(_stream(s, d), "event_type", "value"), "complete")
    return out.select(F.to_date("start").alias("day"), "event_type", F.col("events").cast("long"), F.round("total", 4).alias("total"))


def stream_sliding(s, d):
    """Events per type in windows of two days, one beginning every day."""
    out = _drained(s, ev.by_window(_stream(s, d), "event_type", "value", length="2 days", slide="1 day"), "complete")
    return out.select(F.to_date("start").alias("day"), "event_type", F.col("events").cast("long"))


def _requests(s, d):
    """Events as deliveries of pull-request payloads: some are of another kind, closed, drafts, or lack a field."""
    key = F.col("event_id")
    action = F.when(key % 7 == 0, "closed").when(key % 3 == 0, "synchronize").otherwise("opened")
    request = F.struct(F.when(key % 13 != 0, key).alias("number"), (key % 5 == 0).alias("draft"), F.struct(F.md5(key.cast("string")).alias("sha")).alias("head"))
    repository = F.struct(F.concat(F.lit("o/r"), F.col("user_id")).alias("full_name"), F.concat(F.lit("https://host/o/r"), F.col("user_id")).alias("clone_url"))
    payload = F.when(key % 17 == 0, "{broken").otherwise(F.to_json(F.struct(action.alias("action"), request.alias("pull_request"), repository.alias("repository"))))
    return _stream(s, d).select(F.when(F.col("event_type") == "view", "ping").otherwise("pull_request").alias("kind"), payload.alias("payload"))


def stream_accepted(s, d):
    """Deliveries that are acted on."""
    return _drained(s, ev.accepted(_requests(s, d))).select(F.col("number").cast("long"), F.left("sha", F.lit(7)).alias("sha"), "repo")


def stream_upsert(s, d):
    """The newest event of each user, by upserts."""
    path = working_folder(s)
    rows = _stream(s, d).select("user_id", "event_id", "event_type")
    write = ev.upsert(path, ["user_id"], "event_id")
    rows.writeStream.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return ev.current(s, path, rows.schema)


def stream_baseline(s, d):
    """Each purchase against the user's last purchase of more than 20 before it."""
    rows = _stream(s, d).where("event_type = 'purchase'").select("user_id", "event_id", "value", (F.col("value") > 20).alias("usable"))
    out = _drained(s, state.with_baseline(rows, "user_id", "value", "usable", ["event_id"]))
    return out.select("user_id", "event_id", "baseline", F.round("delta", 4).alias("delta"))


def stream_status(s, d):
    """The steps of each user's status, of which clicks begin and other events end one."""
    said = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "error")
    rows = _stream(s, d).select("user_id", "event_id", said.alias("said"))
    return _drained(s, state.status_changes(rows, "user_id", "said", ["event_id"])).select("user_id", "event_id", "was", "became")


def stream_points(s, d):
    """Signups numbered in each user's series."""
    rows = _stream(s, d).where("event_type = 'signup'").select("user_id", "event_id")
    return _drained(s, state.numbered(rows, "user_id", ["event_id"]))


def stream_static_baseline(s, d):
    """Errors of the stream against the highest view that a table has for their user."""
    highest = s.read.parquet(f"{d}/events.parquet").where("event_type = 'view'").groupBy("user_id").agg(F.max("value").alias("baseline"))
    rows = _stream(s, d).where("event_type = 'error'").select("user_id", "event_id", "value")
    return _drained(s, state.against_table(rows, highest, "user_id", "value")).select("event_id", F.round("baseline", 4).alias("baseline"), F.round("delta", 4).alias("delta"))


QUERIES = {f.__name__: f for f in (stream_filter, stream_windows, stream_sliding, stream_accepted, stream_upsert, stream_baseline, stream_status, stream_points, stream_static_baseline)}
SQL = {
    "stream_filter": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 50",
    "stream_windows": "SELECT ts::DATE AS day, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "WITH w AS (SELECT ts::DATE AS day, event_type FROM events UNION ALL SELECT (ts::DATE - 1)::DATE, event_type FROM events) SELECT day, event_type, count(*) AS events FROM w GROUP BY 1, 2",
    "stream_accepted": "SELECT event_id AS number, left(md5(event_id::VARCHAR), 7) AS sha, 'o/r' || user_id AS repo FROM events WHERE event_type <> 'view' AND event_id % 17 <> 0 AND event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 13 <> 0",
    "stream_upsert": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "stream_baseline": """WITH b AS (SELECT user_id, event_id, value, last_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM events WHERE event_type = 'purchase')
SELECT user_id, event_id, baseline, round(value - baseline, 4) AS delta FROM b""",
    # until the first end, a step is the first event of a user, or the end itself
    "stream_status": """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'pending' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' END AS said FROM events WHERE event_type IN ('click', 'purchase', 'error')),
f AS (SELECT user_id, min(event_id) AS first_id FROM e GROUP BY 1), n AS (SELECT user_id, min(event_id) AS end_id, arg_min(said, event_id) AS ending FROM e WHERE said <> 'pending' GROUP BY 1)
SELECT user_id, first_id AS event_id, NULL AS was, 'pending' AS became FROM f UNION ALL SELECT user_id, end_id, 'pending', ending FROM n""",
    "stream_points": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS point FROM events WHERE event_type = 'signup'",
    "stream_static_baseline": "WITH m AS (SELECT user_id, max(value) AS baseline FROM events WHERE event_type = 'view' GROUP BY 1) SELECT event_id, round(baseline, 4) AS baseline, round(value - baseline, 4) AS delta FROM events LEFT JOIN m USING (user_id) WHERE event_type = 'error'",
}
