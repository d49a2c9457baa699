import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronoweave.sources.event_io import MESSAGE_SCHEMA, read_events, write_events
from chronoweave.streaming import events as ev

U = "00000000-0000-4000-8000-00000000000"
GOOD = {"id": U + "1", "snapshot_id": U + "2", "decided_by_user_id": U + "3", "agent": None, "action": "a.b", "decided_at": "2024-01-01T00:00:00Z", "receipt_sha256": "x", "later_field": 1}


def envelope(**change):
    e = {"specversion": "1.0", "id": U + "9", "type": "decision.recorded", "source": "chronoweave", "schema_version": 1,
         "organization_id": U + "0", "subject": U + "1", "time": "2024-01-01T23:30:00-02:00", "data": dict(GOOD)}
    drop = change.pop("drop", None)
    e.update(change)
    if drop:
        e.pop(drop)
    return json.dumps(e)


def messages(spark, values):
    return spark.createDataFrame([("t.v1", 0, i, "k", v) for i, v in enumerate(values)], MESSAGE_SCHEMA)


@pytest.mark.parametrize(
    "value,ok",
    [
        (envelope(), True), (envelope(drop="specversion"), True), (envelope(data={**GOOD, "agent": "x"}), True),
        (envelope(specversion="2.0"), False), (envelope(id="nope"), False), (envelope(type="who.knows"), False), (envelope(extra=1), False),
        (envelope(time="2024-01-01T00:00:00"), False), (envelope(source="other"), False), (envelope(drop="subject"), False),
        (envelope(data={k: v for k, v in GOOD.items() if k != "action"}), False), (envelope(data={**GOOD, "decided_at": "yesterday"}), False),
        (envelope(data={k: v for k, v in GOOD.items() if k != "agent"}), False), (envelope(data="text"), False), ("[1]", False), ("", False), (None, False),
    ],
)
def test_decoding(spark, value, ok):
    row = ev.decode(messages(spark, [value])).first()
    assert (row.problem is None) == ok
    if ok:
        assert row.time == datetime(2024, 1, 2, 1, 30)


def test_projection_carries_listed_columns_only(spark):
    row = spark.createDataFrame(
        [(U + "0", U + "1", U + "2", 1, U + "3", None, datetime(2024, 1, 1), None, 50, "PUBLIC", datetime(2024, 1, 1), "secret value")],
        "organization_id string, id string, fact_id string, version int, source_id string, supersedes_id string, valid_from timestamp, "
        "valid_until timestamp, authority int, privacy_scope string, recorded_at timestamp, value string",
    )
    event = ev.events_from(row, "fact.version_recorded", time="recorded_at", event_id=F.col("id"))
    data = json.loads(event.first().data)
    assert "value" not in data and data["supersedes_id"] is None and data["version"] == 1
    message = ev.envelopes(event).withColumn("partition", F.lit(0)).withColumn("offset", F.lit(0).cast("long"))
    assert message.first().key == U + "0" and message.first().topic == "chronoweave.facts.v1"
    assert ev.decode(message).first().problem is None


@pytest.fixture
def feed(spark, tmp_path):
    """Three files: fresh events, redeliveries of half of them, junk and ignored types."""
    day = lambda i: f"2024-01-0{1 + i % 3}T10:00:00Z"
    event = lambda i: envelope(id=f"00000000-0000-4000-8000-{i:012d}", time=day(i))
    context = {"id": U + "1", "captured_by_user_id": U + "1", "valid_at": day(0), "known_at": day(0), "embedding_model": "m", "created_at": day(0)}
    files = [
        [event(i) for i in range(20)],
        [event(i) for i in range(10)] + [event(i) for i in range(20, 25)] + ["junk"],
        [event(20), event(30), event(30)] + [envelope(type="context.captured", data=context, id=f"00000000-0000-4000-8000-{99:012d}")],
    ]
    for k, values in enumerate(files):
        messages(spark, values).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return tmp_path


def read_counts(spark, store):
    return {str(r.day): r.decisions_recorded for r in store.activity(spark).collect()}


def test_stream_counts_each_event_once(spark, feed):
    store = ev.ActivityStore(str(feed / "out"))
    stream = read_events(spark, folder=str(feed / "in"), files_per_trigger=1)
    ev.run_activity(stream, store, str(feed / "ckpt")).awaitTermination()
    batch = read_events(spark, folder=str(feed / "in"), streaming=False)
    decoded = ev.decode(batch)
    once = ev.activity_daily(ev.dedup_exact(decoded.where("problem is null")))
    assert read_counts(spark, store) == {str(r.day): r.decisions_recorded for r in once.collect()}
    assert sum(read_counts(spark, store).values()) == 26
    tally = {r.outcome: r.n for r in store.read(spark, "outcomes", "outcome string, messages long").groupBy("outcome").agg(F.sum("messages").alias("n")).collect()}
    assert tally == {"handled": 26, "duplicate": 12, "ignored": 1, "dead_lettered": 1}
    dead = spark.read.parquet(str(feed / "out" / "dead_letters")).collect()
    assert [(r.topic, r.dlq_attempts, r.value) for r in dead] == [("t.v1.dlq", 0, "junk")]
    # a restart with the same checkpoint has nothing left; replaying a batch changes nothing
    before = read_counts(spark, store)
    ev.run_activity(stream, store, str(feed / "ckpt")).awaitTermination()
    last = read_events(spark, folder=str(feed / "in"), streaming=False).where("offset < 4 and value not like '%junk%'")
    ev.apply_activity_batch(last, 7, store)
    first = read_counts(spark, store)
    ev.apply_activity_batch(last, 7, store)
    assert read_counts(spark, store) == first == before


def test_event_sink_and_source_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(U + "0", U + "1", "m", datetime(2024, 1, 1))], "organization_id string, fact_version_id string, model string, created_at timestamp")
    event = ev.events_from(rows, "fact.embedding_stored", time="created_at", event_id=F.lit(U + "5"))
    write_events(event, folder=str(tmp_path / "topic"))
    back = ev.decode(read_events(spark, folder=str(tmp_path / "topic"), streaming=False)).first()
    assert back.problem is None and back.type == "fact.embedding_stored" and back.data["model"] == "m"


def test_recent_activity_bounds(spark):
    days = spark.createDataFrame([("o", datetime(2024, 1, d).date()) for d in range(1, 11)], "organization_id string, day date")
    assert ev.recent_activity(days, 3, F.lit("2024-01-10").cast("date")).count() == 3
    with pytest.raises(ValueError):
        ev.recent_activity(days, 367, F.lit("2024-01-10").cast("date"))
